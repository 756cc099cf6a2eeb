"""Scalar text functions as column expressions; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that mark instructions hidden in stored text.
INJECTION = (
    r"ignore (all|any|previous|above|prior) instructions",
    r"do not follow (the )?(system|developer)",
    r"system prompt",
    r"developer message",
    r"<\s*(system|assistant|developer|tool|function|relevant-memories)\b",
    r"\b(run|execute|call|invoke)\b.{0,40}\b(tool|command)\b",
)
# Phrases that make a message worth remembering.
TRIGGERS = (
    r"(?i)\b(remember|don'?t forget|keep in mind|note that|take note)\b",
    r"(?i)\b(my (name|preference|style|setup|config) is)\b",
    r"(?i)\b(i (always|usually|never|prefer|like|hate|dislike|use|want))\b",
    r"(?i)\b(from now on|going forward|in the future)\b",
    r"(?i)\b(recuerda|no olvides|mi nombre es|prefiero)\b",
    r"(?i)\b(lembre|não esqueça|meu nome é|eu prefiro)\b",
    r"(?i)\b(merk dir|vergiss nicht|mein name ist|ich bevorzuge)\b",
    r"(?i)\b(rappelle-toi|n'?oublie pas|mon nom est|je préfère)\b",
    r"(记住|别忘了|我的名字是|我喜欢|我偏好|以后都|从现在开始)",
    r"(覚えて|忘れないで|名前は|好きな|嫌いな)",
    r"(기억해|잊지 마|내 이름은|나는 좋아|나는 싫어)",
)
# Categories in order of precedence, with the words that decide.
CATEGORIES = (
    ("preference", r"\b(prefer|like|dislike|hate|love|favorite|favour|favor|rather|style|taste|want|wish)\b"),
    ("decision", r"\b(decided|decision|chose|chosen|concluded|agreed|approach|strategy|resolved|settled|picked)\b"),
    ("entity", r"\b(name is|called|known as|named|alias|handle|username|team|project|repo)\b"),
    ("fact", r"\b(is located|works at|lives in|based in|runs on|built with|uses|version|port|path|url|endpoint)\b"),
)
# Code points that weigh a whole token.
WIDE = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}\x{ac00}-\x{d7af}\x{3040}-\x{30ff}\x{10000}-\x{10ffff}]"
CHARS_PER_TOKEN = 4
CAPTURE_MIN, CAPTURE_MAX = 10, 2000


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units: code points beyond the basic plane count twice."""
    return F.length(s) + F.length(F.regexp_replace(s, r"[^\x{10000}-\x{10FFFF}]", ""))


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def token_estimate(s: Column) -> Column:
    """Rounded quarter of the length."""
    return F.greatest(F.lit(0), half_up(utf16_length(F.coalesce(s, F.lit(""))) / CHARS_PER_TOKEN)).cast("long")


def token_ceiling(s: Column) -> Column:
    """Quarter of the length, rounded up."""
    return F.ceil(utf16_length(s) / CHARS_PER_TOKEN).cast("long")


def weighted_size(s: Column) -> Column:
    """Length in which wide characters count four."""
    return F.length(s) + (CHARS_PER_TOKEN - 1) * F.length(F.regexp_replace(s, WIDE.replace("[", "[^", 1), ""))


def sha_prefix(s: Column, n: int) -> Column:
    """First n hex digits of SHA-256."""
    return F.substring(F.sha2(s, 256), 1, n)


def bucket_hash(s: Column, tail: int = 4) -> Column:
    """Unsigned 32-bit rolling hash h*31+c of the last characters."""
    h = F.lit(0).cast("long")
    n = F.length(s)
    for k in range(tail, 0, -1):
        c = F.when(n >= k, F.ascii(F.substring(s, -k, 1))).otherwise(F.lit(0))
        h = (h * 31 + c) % (1 << 32)
    return h


def html_escape(s: Column) -> Column:
    """Escapes the five characters that could open or close markup."""
    out = s
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def numbered_block(items: Column, head: str, tail: str) -> Column:
    """An array of texts as a numbered, escaped block."""
    lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), html_escape(x)))
    return F.array_join(F.concat(F.array(F.lit(head)), lines, F.array(F.lit(tail))), "\n")


def looks_injected(s: Column) -> Column:
    """Whether any injection pattern occurs."""
    return s.rlike("(?i)(?:" + "|".join(INJECTION) + ")")


def worth_capturing(s: Column) -> Column:
    """The capture trigger with its guards."""
    n = utf16_length(s)
    skip = (
        s.contains("<relevant-memories>")
        | (s.startswith("<") & s.contains("</"))
        | (s.contains("**") & s.contains("\n-"))
        | (n < CAPTURE_MIN)
        | (n > CAPTURE_MAX)
    )
    hit = F.lit(False)
    for p in TRIGGERS:
        hit = hit | s.rlike(p)
    return ~skip & ~looks_injected(s) & hit


def category(s: Column) -> Column:
    """First matching category, else ``other``."""
    out = F.lit("other")
    for name, p in reversed(CATEGORIES):
        out = F.when(s.rlike(f"(?i){p}"), name).otherwise(out)
    return out


def short_number(x: Column) -> Column:
    """1234 as 1.2K, 1234567 as 1.2M (F32)."""
    return (
        F.when(x >= 1_000_000, F.concat(F.format_string("%.1f", x / 1_000_000), F.lit("M")))
        .when(x >= 1000, F.concat(F.format_string("%.1f", x / 1000), F.lit("K")))
        .otherwise(x.cast("string"))
    )


def duration(ms: Column) -> Column:
    """Milliseconds as ms, s, m s, h m or d h (F32); days come from the hour's remainder, as published."""
    whole = lambda a, b: F.floor(a / b).cast("string")
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.format_string("%.1f", ms / 1000), F.lit("s")))
        .when(ms < 3_600_000, F.concat(whole(ms, 60_000), F.lit("m "), whole(ms % 60_000, 1000), F.lit("s")))
        .when(ms < 86_400_000, F.concat(whole(ms, 3_600_000), F.lit("h "), whole(ms % 3_600_000, 60_000), F.lit("m")))
        .otherwise(F.concat(whole(ms % 3_600_000, 86_400_000), F.lit("d "), whole(ms, 3_600_000), F.lit("h")))
    )


def truncate(s: Column, n: int) -> Column:
    return F.when(utf16_length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 1), F.lit("…")))


def truncate_middle(s: Column, n: int = 35) -> Column:
    a, b = -(-(n - 1) // 2), (n - 1) // 2
    return F.when(utf16_length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, a), F.lit("…"), F.substring(s, -b, b)))


def pluralize(n: Column, one: str, many: str) -> Column:
    return F.replace(F.when(n == 1, one).otherwise(many), F.lit("{}"), n.cast("string"))


def title_case(s: Column) -> Column:
    """Upper-cases the first ASCII letter of each word, leaving the rest (F32)."""
    parts = F.regexp_extract_all(s, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    up = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    return F.array_join(F.transform(parts, lambda w: F.when(w.rlike("^[a-z]"), up(w)).otherwise(w)), "")


def masked_key(s: Column) -> Column:
    """first7...last4."""
    return F.concat(F.substring(s, 1, 7), F.lit("..."), F.substring(s, -4, 4))


def dedent(s: Column) -> Column:
    """Removes the indentation shared by all lines that are not blank."""
    lines = F.split(s, "\n")
    indents = F.transform(F.filter(lines, lambda x: F.length(F.trim(x)) > 0), lambda x: F.length(x) - F.length(F.ltrim(x)))
    cut = F.coalesce(F.array_min(indents), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.substr(x, cut + 1)), "\n")


def numstat(line: Column) -> Column:
    """additions TAB deletions TAB file; a dash marks a binary file and counts nothing."""
    part = F.split(line, "\t")
    add, gone = F.get(part, 0), F.get(part, 1)
    return F.struct(
        F.get(part, 2).alias("file"),
        F.coalesce(add.try_cast("long"), F.lit(0)).alias("additions"),
        F.coalesce(gone.try_cast("long"), F.lit(0)).alias("deletions"),
        ((add == "-") & (gone == "-")).alias("binary"),
    )


def summary_only(s: Column) -> Column:
    """Drops the first analysis block and opens the first summary block."""
    bare = F.regexp_replace(s, r"(?s)^(.*?)<analysis>.*?</analysis>", "$1")
    return F.trim(F.regexp_replace(bare, r"(?s)^(.*?)<summary>(.*?)</summary>", "$1$2"))


def share_id(url: Column) -> Column:
    """The id in .../s/<id> or .../share/<id>; null where there is none."""
    got = F.regexp_extract(url, r"^https?://[^/]+/(?:s|share)/([A-Za-z0-9_-]+)", 1)
    return F.when(F.length(got) > 0, got)


def wildcard(pattern: str) -> str:
    """An anchored regex for a pattern of * and ? (a trailing ' *' is optional)."""
    special = set(".+^${}()|[]\\")
    body = "".join("\\" + c if c in special else ".*" if c == "*" else "." if c == "?" else c for c in pattern.replace("\\", "/"))
    if body.endswith(" .*"):
        body = body[:-3] + "( .*)?"
    return f"(?s)^{body}$"


def wildcard_column(pattern: Column) -> Column:
    """The same, for a column of patterns."""
    body = F.replace(pattern, F.lit("\\"), F.lit("/"))
    body = F.regexp_replace(body, r"([.+^${}()|\[\]])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    body = F.when(F.endswith(body, F.lit(" .*")), F.concat(F.substr(body, F.lit(1), F.length(body) - 3), F.lit("( .*)?"))).otherwise(body)
    return F.concat(F.lit("(?s)^"), body, F.lit("$"))


#: Separates the tokens of a command in ``structured``.
TOKEN_END = "\x1f"


def structured(pattern: str) -> str:
    """A regex over tokens joined by TOKEN_END (P12): the first part is the head; the others must
    match tokens of the tail in order, with any between them; '*' alone asks for nothing."""
    def token(part: str) -> str:
        special = set(".+^${}()|[]\\")
        return "".join("\\" + c if c in special else "[^\\x1f]*" if c == "*" else "[^\\x1f]" if c == "?" else c for c in part.replace("\\", "/"))

    head, *rest = pattern.split()
    between = r"(?:\x1f[^\x1f]*)*?"
    wanted = "".join(f"{between}\\x1f{token(p)}" for p in rest if p != "*")
    return f"(?s)^{token(head)}{wanted}(?:\\x1f[^\\x1f]*)*$"


def or_default(x: Column, default) -> Column:
    """Null, zero and the empty string give the default (F51); ``coalesce`` is its strict twin."""
    return F.when(x.isNull() | (x.cast("string") == "0") | (x.cast("string") == ""), F.lit(default)).otherwise(x)
