"""From raw documents to training shards: five stages, each written before the next reads it.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` applies them in order and needs nothing but the
tables of ``sf_dir`` and the folder named by spark.checkpoint.dir, from which it removes
what a stage wrote for itself once its documents are written.

Defined results, for every stage: null and empty texts, repeated rows and null ids stay
rows like any other (the near-copy stage counts null texts as empty ones and keeps one of
them; of a repeated id all rows go or stay; rows of a null id are never dropped but by the
toxicity of their own text); an empty table gives an empty one; extra columns are passed on
whatever their names, but for the last stage, which leaves them out. Labels that are
missing, of one class or of other documents drop nothing, nor does an empty benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, kdtree, mixing, simhash, toxicity
from quillspark.llm.common import discard, materialize, table, temporary_tables

#: Share of the mix's expected tokens left to documents of low quality.
LOW_SHARE = 0.05
SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine holds toxic go, by the operator's own threshold."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies (5-word shingles, similarity 0.8) the least doc_id stays."""
    return simhash.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, edited or not, go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality are thinned to their share of the mix; the others stay."""
    labels = table(spark, sf_dir, "labels")
    known = labels.select("doc_id", F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))
    return mixing.thin(docs, known, {"low": LOW_SHARE})


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes; equal texts share one."""
    return kdtree.kd_shards(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: No stage's model or alignment can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of ``sf_dir``'s documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with temporary_tables() as keep:
            docs = keep(materialize(stage(spark, before, sf_dir), f"stage-{name}"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
