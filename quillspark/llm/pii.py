"""Personal data: regular expressions propose, checksums confirm, context adjusts.

Spans come from SQL functions alone. For one kind, ``regexp_extract_all`` gives the
matches and ``split`` by the same pattern the gaps between them; a running sum of
both lengths, taken block by block so that its work hardly grows faster than the
matches, gives code-point offsets. Validators (Luhn for cards, mod-97 for
IBANs, part ranges for addresses, digit counts for phones) then drop matches that
fail; there are no retries inside a dropped match.

Patterns are written so that the regex engine neither recurses nor rescans: groups
repeat possessively where nothing follows them, and a match may only start at the
start of a run of its first class (or where the previous match ended), which is
where the leftmost match of such a run must start anyway.

Beyond the base kinds the method adds ``iban`` and ``ssn`` spans. Every span has a
score: its kind's prior, raised where one of the kind's words stands within
CONTEXT_CHARS before it, though not before the previous match but one of its kind. Base spans are kept whatever their score; the added kinds
need ADDED_MIN.

Defined results: a null text is an empty one and has no spans; repeated ids give a
row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import keep_only

_LOCAL = r"[A-Za-z0-9._%+-]"
#: kind: pattern. The first four are the base kinds, in the order in which ties sort.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: A text without this cannot hold the kind, so its pattern is not run.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Prior score of a confirmed span, and the words before it that raise the score.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
WORDS = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|host|server|address",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto",
    "ssn": "ssn|social|security",
}
CONTEXT_BONUS = 0.3
CONTEXT_CHARS = 40
ADDED_MIN = 0.5


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def luhn_ok(match: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(_digits(match))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + _luhn_term(F.substr(d, i, F.lit(1)).cast("int"), i % 2 == 0),
    )
    return F.length(d).between(12, 19) & (total % 10 == 0)


def _luhn_term(digit: Column, doubled: Column) -> Column:
    twice = digit * 2
    return F.when(doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)


def ip_ok(match: Column) -> Column:
    """Every part is at most 255, leading zeros aside."""
    def fits(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(F.lit(False))

    return F.forall(F.split(match, r"\."), fits)


def phone_ok(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def iban_ok(match: Column) -> Column:
    """15 to 34 characters; mod-97 of the rearranged number is one."""
    bare = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    left = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))),
        F.lit(0),
        lambda acc, i: _mod97(acc, F.ascii(F.substr(turned, i, F.lit(1)))),
    )
    return F.length(bare).between(15, 34) & (left == 1)


def _mod97(acc: Column, code: Column) -> Column:
    return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)


OK = {"email": lambda m: F.lit(True), "ip": ip_ok, "card": luhn_ok, "phone": phone_ok, "iban": iban_ok, "ssn": lambda m: F.lit(True)}


def _found(kind: str, text: Column) -> Column:
    """Structs (gaps, hits): the text around the matches of one kind, and the matches."""
    pattern = F.lit(PATTERNS[kind])
    both = F.struct(F.split(text, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))
    needed = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    return F.when(needed & text.rlike(PATTERNS[kind]), both)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often a lambda reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... elements of an int array. Blocks of sqrt(n) elements are added up
    first, so that no element reads more than two stretches of that length."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x)

    def summed(xs: Column, width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda b: total(F.slice(xs, b * width + 1, width)))

        def of(bs: Column) -> Column:
            before = F.transform(bs, lambda _, b: total(F.slice(bs, F.lit(1), b)))
            return let(before, lambda base: F.transform(xs, lambda _, i: (
                F.element_at(base, F.floor(i / width).cast("int") + 1) + total(F.slice(xs, F.floor(i / width).cast("int") * width + 1, i % width + 1)))))

        return let(blocks, of)

    return F.when(F.size(numbers) > 0, let(numbers, lambda xs: let(F.ceil(F.sqrt(F.size(xs))).cast("int"), lambda width: summed(xs, width)))).otherwise(
        F.array().cast("array<int>"))


def _spans(kind: str, at: int, found: Column) -> Column:
    """Array of (start, kind_at, end, kind, score) of the confirmed matches."""
    gaps, hits = found["gaps"], found["hits"]
    ends = running_sums(F.transform(hits, lambda h, i: F.length(F.element_at(gaps, i + 1)) + F.length(h)))

    def context(i: Column) -> Column:
        """The end of what precedes match i, from the match before the previous one on."""
        before = F.when(i > 0, F.concat(F.element_at(gaps, i), F.element_at(hits, i))).otherwise(F.lit(""))
        return F.right(F.concat(before, F.element_at(gaps, i + 1)), F.lit(CONTEXT_CHARS))

    def span(hit: Column, end: Column) -> Column:
        score = F.lit(PRIOR[kind]) + F.when(hit["near"].rlike(f"(?i)(?:{WORDS[kind]})"), CONTEXT_BONUS).otherwise(0.0)
        good = OK[kind](hit["text"])
        if kind not in BASE:
            good = good & (score >= ADDED_MIN)
        return F.when(good, F.struct((end - F.length(hit["text"])).alias("start"), F.lit(at).alias("at"), end.alias("end"), F.lit(kind).alias("kind"), F.least(score, F.lit(1.0)).alias("score")))

    none = F.array().cast("array<struct<start:int,at:int,end:int,kind:string,score:double>>")
    placed = F.transform(hits, lambda h, i: F.struct(h.alias("text"), context(i).alias("near")))
    return F.coalesce(F.filter(F.zip_with(placed, ends, span), lambda s: s.isNotNull()), none)


def find_pii(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns and ``spans``: (start, at, end, kind, score), by start, then kind."""
    raw = keep_only(docs, *keep, text_col).withColumn("_text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    found = raw.select(*keep, "_text", *[_found(k, F.col("_text")).alias(f"_f_{k}") for k in PATTERNS])
    each = found.select(*keep, *[_spans(k, i, F.col(f"_f_{k}")).alias(f"_s_{k}") for i, k in enumerate(PATTERNS)])
    return each.select(*keep, F.array_sort(F.concat(*[f"_s_{k}" for k in PATTERNS])).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_pii(docs, "text", "doc_id")
    base = F.filter("spans", lambda s: s["at"] < len(BASE))

    def count_of(at: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["at"] == at)).cast("long")

    return found.select(
        "doc_id",
        *[count_of(at).alias(f"n_{k}") for at, k in enumerate(BASE)],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
