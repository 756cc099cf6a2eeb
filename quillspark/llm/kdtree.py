"""Sharding by a k-d tree over document metadata, balanced by bytes.

Every document is a point: log size, bytes per character and density of blanks.
All three, and the hash that breaks ties, are functions of the text, so documents
of equal text share a shard whatever else they differ in, and a shard can be
computed from a row without a join.

Groups of equal text that alone reach a shard's fair share get a shard of their
own (at most shards - 1 of them). The others are split recursively: along the
dimension that is widest in the node, relative to its range in the whole table,
at the weighted quantile that gives either side bytes in proportion to its
leaves, until every leaf holds the target bytes: a number of shards asked for sets
the target to their share of the whole, or a target sets their number. The quantile comes from histograms of at most BINS bins a node, each
round refining the bin that holds it, so the driver sees a bounded number of
rows whatever the table's size.

Defined results: a null text counts as the empty one (size 1, crc32 0); null and
repeated ids are numbered like any other; an empty table gives no rows; more
shards than groups leave shards empty; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_IDS, MAX_CELLS, materialize

BINS = 1024
#: A coordinate is scaled to SCALE steps, then SCALE steps of hash break ties.
SCALE = 1 << 20
#: A quantile is exact enough once the bin that holds it has this share of the node's bytes.
TOLERANCE = 1e-5
ROWS_PER_SLOT_CELL = 20_000
DIMENSIONS = ("log_size", "bytes_per_char", "blank_share")


@dataclass
class Node:
    leaves: int
    first: int  # shard of its leftmost leaf
    where: list[tuple[str, int, bool]] = field(default_factory=list)  # (key, cut, below)

    def holds(self) -> Column:
        out = F.lit(True)
        for key, cut, below in self.where:
            out = out & ((F.col(key) < cut) if below else (F.col(key) >= cut))
        return out


def points(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document; texts are read once and never shuffled."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    raw = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    size = (F.octet_length("text") + 1).cast("long")
    return raw.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit(1), F.col("text")).alias("h2"),
        F.log2(size.cast("double")).alias("log_size"),
        (size / (F.length("text") + 1)).alias("bytes_per_char"),
        ((F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))) / size).alias("blank_share"),
    )


def _heavy(rows: DataFrame, total: int, shards: int) -> list[tuple[int, int]]:
    """Groups of equal text that reach the fair share of the shards left to them."""
    top = (
        rows.groupBy("h1", "h2").agg(F.sum("size").alias("w"))
        .orderBy(F.desc("w"), "h1", "h2").limit(shards - 1).collect()
    )
    out, left, leaves = [], total, shards
    for g in top:
        if leaves < 2 or g.w * leaves < left:
            break
        out.append((g.h1, g.h2))
        left, leaves = left - g.w, leaves - 1
    return out


def _cuts(rows: DataFrame, nodes: list[tuple[Node, str, int]]) -> list[int]:
    """For each (node, key, bytes wanted on the left) the key at which to cut."""
    low = [0] * len(nodes)
    width = [SCALE * SCALE] * len(nodes)
    before = [0] * len(nodes)
    done = [False] * len(nodes)
    while not all(done):
        parts = None
        for i, (node, key, _) in enumerate(nodes):
            if not done[i]:
                inside = node.holds() & (F.col(key) >= low[i]) & (F.col(key) < low[i] + width[i])
                slot = F.struct(F.lit(i).alias("node"), F.floor((F.col(key) - low[i]) / max(1, width[i] // BINS)).cast("int").alias("bin"))
                parts = F.when(inside, slot) if parts is None else parts.when(inside, slot)
        got = (
            rows.select(parts.alias("at"), "size").where("at IS NOT NULL")
            .groupBy("at.node", "at.bin").agg(F.sum("size").alias("w")).collect()
        )
        bins = {}
        for r in got:
            bins.setdefault(r.node, {})[r.bin] = r.w
        for i, (_, _, want) in enumerate(nodes):
            if done[i]:
                continue
            step, here = max(1, width[i] // BINS), bins.get(i, {})
            at = max(here, default=0)
            for b in sorted(here):
                if before[i] + here[b] > want:
                    at = b
                    break
                before[i] += here[b]
            low[i], width[i] = low[i] + at * step, step
            held = here.get(at, 0)
            if step == 1 or held <= TOLERANCE * want or not here:
                if abs(before[i] + held - want) < abs(want - before[i]):
                    low[i] += step  # the bin is nearer to the aim on the left
                done[i] = True
    return low


def assign(rows: DataFrame, shards: int) -> tuple[DataFrame, list]:
    """``rows`` (see points) with a ``shard`` column; also the tree's cuts, for inspection."""
    stats = rows.agg(
        F.sum("size").alias("total"),
        *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    total = stats["total"] or 0
    if shards < 2 or not total:
        return rows.withColumn("shard", F.lit(0)), []
    keyed, keys = rows, {}
    for d in DIMENSIONS:
        lo, hi = stats[f"lo_{d}"], stats[f"hi_{d}"]
        scaled = F.least(F.lit(SCALE - 1), F.floor((F.col(d) - lo) / max(hi - lo, 1e-12) * SCALE)).cast("long")
        keys[d] = f"k_{d}"
        keyed = keyed.withColumn(keys[d], scaled * SCALE + F.pmod("h1", F.lit(SCALE)))
    heavy = _heavy(rows, total, shards)
    is_heavy = F.lit(False)
    for h1, h2 in heavy:
        is_heavy = is_heavy | ((F.col("h1") == h1) & (F.col("h2") == h2))
    light = keyed.where(~is_heavy)
    level, leaves, cuts = [Node(shards - len(heavy), len(heavy))], [], []
    while level:
        leaves += [n for n in level if n.leaves == 1]
        level = [n for n in level if n.leaves > 1]
        if not level:
            break
        which = None
        for i, n in enumerate(level):
            which = F.when(n.holds(), i) if which is None else which.when(n.holds(), i)
        spread = {
            r.node: r
            for r in light.withColumn("node", which).where("node IS NOT NULL").groupBy("node").agg(
                F.sum("size").alias("w"),
                *[(F.max(k) - F.min(k)).alias(f"r_{d}") for d, k in keys.items()],
            ).collect()
        }
        plan = []
        for i, n in enumerate(level):
            r = spread.get(i)
            wide = max(DIMENSIONS, key=lambda d: r[f"r_{d}"]) if r else DIMENSIONS[0]
            plan.append((n, keys[wide], (r.w if r else 0) * (n.leaves // 2) // n.leaves))
        below = []
        for (n, key, _), cut in zip(plan, _cuts(light, plan), strict=True):
            half = n.leaves // 2
            cuts.append((key, cut))
            below.append(Node(half, n.first, [*n.where, (key, cut, True)]))
            below.append(Node(n.leaves - half, n.first + half, [*n.where, (key, cut, False)]))
        level = below
    shard = None
    for i, (h1, h2) in enumerate(heavy):
        own = (F.col("h1") == h1) & (F.col("h2") == h2)
        shard = F.when(own, i) if shard is None else shard.when(own, i)
    for n in leaves:
        shard = F.when(n.holds(), n.first) if shard is None else shard.when(n.holds(), n.first)
    return keyed.withColumn("shard", shard.cast("int")).drop(*keys.values()), cuts


def number(rows: DataFrame, group: str, order: list[str], out: str = "slot") -> DataFrame:
    """Gapless numbers from 0 in every group, without a group ever meeting in one task."""
    n = rows.count()
    cells = max(1, min(MAX_CELLS, n // ROWS_PER_SLOT_CELL))
    celled = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = celled.groupBy(group, "_cell").count()
    starts = counts.select(
        group,
        "_cell",
        (F.sum("count").over(Window.partitionBy(group).orderBy("_cell")) - F.col("count")).alias("_start"),
    )
    small = starts.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    within = F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*order))
    return (
        celled.withColumn("_row", within)
        .join(F.broadcast(starts) if small else starts, [group, "_cell"])
        .withColumn(out, (F.col("_start") + F.col("_row") - 1).cast("long"))
        .drop("_cell", "_row", "_start")
    )


def kd_shards(docs: DataFrame, shards: int | None = 8, id_col: str = "doc_id", text_col: str = "text", target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless in a shard).

    With ``target_bytes`` there are as many shards as the whole has targets, rounded up."""
    rows = materialize(points(docs, id_col, text_col), "kd-points")
    if target_bytes is not None:
        shards = max(1, -(-int(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    placed, _ = assign(rows, shards)
    return number(placed, "shard", ["doc_id", "h1", "h2"]).select("doc_id", "size", "text_crc32", "shard", "slot")


def op8_kd_tree_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return kd_shards(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
