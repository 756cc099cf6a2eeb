"""Canonical exact digests of documents, and classes of documents that share one.

A text's canonical form is NFKC, full case folding, NFKC again (folding can undo
it), with runs of white space folded to one blank and trimmed. Normalisation and
folding are the JVM's own ICU functions, called from SQL. The fingerprint is 128
bits: two XXH64 digests of the canonical bytes with unlike seeds, as 32 hex digits.

Grouping is by the digest, then by bytes: documents whose digest occurs more than
once are aggregated by (digest, canonical bytes), so copies meet in partial sums
before any shuffle and a large group never does in one task. A digest with two
canonical texts, a collision, therefore gives two classes. Likeness is 1 where both
digests and bytes agree, else 0; bytes are only compared where digests agree.

Defined results: a null text is an empty one (and all empty texts are equal);
repeated ids give a row each, in the order of their texts' hashes; null ids come
first, and after the last id comes the least id that is not null; a table of one
row has itself as its next document;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cell_bounds, cell_of, join_facts, keep_only, materialize, semi_by_id

_ICU_NORMALIZER = "com.ibm.icu.text.Normalizer"
_ICU_CHARACTER = "com.ibm.icu.lang.UCharacter"
_BLANKS = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"


def canonical(text: Column) -> Column:
    """The form under which texts count as equal; ASCII texts skip the Unicode steps."""
    def nfkc(x: Column) -> Column:
        return F.java_method(F.lit(_ICU_NORMALIZER), F.lit("compose"), x, F.lit(True))

    folded = F.java_method(F.lit(_ICU_CHARACTER), F.lit("foldCase"), nfkc(text), F.lit(True))
    same = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(nfkc(folded))
    return F.trim(F.regexp_replace(same, _BLANKS, " "))


def digest(canon: Column) -> Column:
    """32 hex digits: XXH64 with Spark's seed, and XXH64 seeded by a hashed constant."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("wide"), canon)), 16, "0")))


def fingerprints(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns and ``fingerprint``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return keep_only(docs, *keep, text_col).select(*keep, digest(canonical(text)).alias("fingerprint"))


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def marks(text: Column, digester=digest) -> dict[str, Column]:
    """fingerprint, and check: a second digest, that tells texts of a collision apart in a join."""
    canon = canonical(text)
    return {"fingerprint": digester(canon), "check": F.sha2(canon.cast("binary"), 256)}


def classed(marked: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digester=digest) -> DataFrame:
    """``marked`` (doc_id, fingerprint, check and more, a row a document) with ``class_id``: the least
    id among documents of the same canonical bytes, null if they have none."""
    shared = marked.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").withColumn("many", F.lit(1))
    shared = materialize(shared, "classes-shared")
    ids = join_facts(marked.select("doc_id", "fingerprint"), shared, ["fingerprint"], "n").where("many = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _text(docs, text_col).alias("text"))
    again = semi_by_id(rows, materialize(ids, "classes-ids"), "doc_id").unionByName(rows.where("doc_id IS NULL"))
    canon = again.select("doc_id", canonical(F.col("text")).alias("canon"))
    by_bytes = canon.groupBy(digester(F.col("canon")).alias("fingerprint"), "canon").agg(F.count("*").alias("n"), F.min("doc_id").alias("class_id"))
    classes = by_bytes.select("fingerprint", F.sha2(F.col("canon").cast("binary"), 256).alias("check"), "class_id", "n")
    out = join_facts(marked, materialize(classes, "classes"), ["fingerprint", "check"], "n")
    return out.withColumn("class_id", F.coalesce("class_id", "doc_id"))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digester=digest) -> DataFrame:
    """doc_id, fingerprint, class_id of every document (see classed)."""
    own = marks(_text(docs, text_col), digester)
    marked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[c.alias(n) for n, c in own.items()])
    return classed(materialize(marked, "digests"), docs, id_col, text_col, digester).select("doc_id", "fingerprint", "class_id")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", own=lambda text: {}) -> DataFrame:
    """doc_id, text, next_text: the text of the next id, after the last the first.

    ``own(text)`` names columns of a row's own; they are computed before texts are shuffled, and
    come with their ``next_`` counterparts.

    Rows are dealt by range cells of the id. The first row of every cell is sent once
    more, as a ghost, to the end of the cell before it (the very first to the last),
    so each text is shuffled once and no window sees more than a cell."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))
    total = rows.agg(F.count("*").alias("n")).first().n
    bounds = cell_bounds(rows, "doc_id", total)
    celled = rows.withColumn("cell", cell_of(F.col("doc_id"), bounds))
    first = celled.where("doc_id IS NOT NULL").groupBy("cell").agg(F.min("doc_id").alias("doc_id"))  # at most MAX_CELLS rows
    everywhere = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("cell").over(Window.orderBy("cell")), F.max("cell").over(everywhere))
    to_cell = first.select("doc_id", before.alias("to_cell"))
    more = own(F.col("text"))
    carried = ["text", *more]
    extra = [c.alias(n) for n, c in more.items()]
    ghosts = rows.join(F.broadcast(to_cell), "doc_id").select("doc_id", "text", F.col("to_cell").alias("cell"), F.lit(1).alias("ghost"), *extra)
    both = celled.select("doc_id", "text", "cell", F.lit(0).alias("ghost"), *extra).unionByName(ghosts)
    after = F.lead(F.struct(*carried)).over(Window.partitionBy("cell").orderBy("ghost", order))
    found = both.withColumn("_next", after).where("ghost = 0")
    return found.select("doc_id", *carried, *[F.coalesce(F.col("_next")[c], F.col(c)).alias(f"next_{c}") for c in carried])


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    staged = with_next(docs, own=marks).select(
        "doc_id", "text", "next_text", "fingerprint", "next_fingerprint", "check", n.cast("long").alias("n_chars"),
        F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), canonical(edited).alias("edited"))

    def alike(fingerprint: str, canon: Column) -> Column:
        """Equal digests and, behind them, equal bytes."""
        same = F.when(F.col("fingerprint") == F.col(fingerprint), canonical(F.col("text")) == canon).otherwise(F.lit(False))
        return same.cast("double")

    marked = staged.withColumn("edited_fingerprint", digest(F.col("edited"))).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "check",
        alike("edited_fingerprint", F.col("edited")).alias("near_edited"), alike("next_fingerprint", canonical(F.col("next_text"))).alias("near_next"))
    return classed(materialize(marked, "fingerprints"), docs).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id")
