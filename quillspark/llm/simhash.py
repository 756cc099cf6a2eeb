"""SimHash near-duplicates by the generalised pigeonhole principle.

1. ``fingerprints``: 64-bit SimHash of word shingles (XXH64, seed 42; a bit is set
   if it is set in over half the shingles' hashes).
2. Bits that correlate over all distinct fingerprints are grouped into ``m`` parts,
   so that unlike parts select independently.
3. Two fingerprints within ``tau`` bits agree in some part i within t_i bits, for
   any thresholds of sum tau - m + 1 (t_i = -1 skips a part). For each fingerprint
   dynamic programming picks the thresholds of least cost: estimated candidates,
   from exact histograms of every part's values, plus the probes to be sent.
4. Every fingerprint goes to its own value of every part (index) and to all values
   within t_i (probes). Rows of one value meet in one sorted run; distances are
   exact. A value with more than BLOCK fingerprints is dealt out as pairs of blocks.
5. A run with few links gives them all. In a dense run, where nearly all pairs
   link, it gives the minimum spanning forest instead: it has at most one edge a
   fingerprint and the same components at every threshold up to ``tau``.

Only fixed-size figures reach the driver (bit correlations, histograms of m * 2^w
values). Links, components and fingerprints stay distributed.

Defined results: null texts are empty; an empty text has fingerprint zero and links
like any other; repeated ids count once each; documents with a null id get a
fingerprint and the component of their fingerprint's least id, null if it has
none; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import anti_by_id, join_facts, materialize, semi_by_id
from quillspark.llm.components import connected_components

SEED = 42
#: A value with more fingerprints than this is dealt out as pairs of blocks.
BLOCK = 20_000
MAX_BLOCKS = 4096
#: Cost of sending one probe, in candidates compared.
PROBE_COST = 16
#: A run gives all its links while they are at most this many times its rows.
SPARSE = 4
CHUNK = 1 << 16


# --- fingerprints -----------------------------------------------------------

def _bit_sums(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def simhash(text: bytes, words: int, second: bool = False) -> tuple[int, int]:
    """Unsigned 64-bit fingerprint of UTF-8 bytes (bytes.lower and bytes.split are ASCII-only) and,
    if asked for, a second one from the same hashes remixed, else 0."""
    w = text.lower().split()
    if not w:
        return 0, 0
    n = max(1, len(w) - words + 1)
    ones, more = np.zeros(64, np.int64), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = w[at:at + CHUNK + words - 1] if n > 1 else w
        tuples = zip(*[part[i:] for i in range(words)], strict=False) if n > 1 else [part]
        h = np.fromiter((digest(s, SEED) for s in map(b" ".join, tuples)), np.uint64)
        ones += _bit_sums(h)
        if second:
            x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            more += _bit_sums((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
    pack = lambda k: int(np.packbits(2 * k > n, bitorder="little").view(np.uint64)[0])
    return pack(ones), pack(more) if second else 0


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, their upper 32 bits, ascending."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint32)
    n = max(1, len(w) - words + 1)
    tuples = zip(*[w[i:] for i in range(words)], strict=False) if n > 1 else [w]
    return np.unique((np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, tuples)), np.uint64) >> np.uint64(32)).astype(np.uint32))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text", second: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), fp2 (a second one, or 0), sig (a hash of
    the word sequence)."""
    raw = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            fp = np.array([simhash(t, words, second) for t in texts], np.uint64).reshape(-1, 2).view(np.int64)
            sig = np.array([xxhash.xxh64_intdigest(b" ".join(t.lower().split()), SEED + 1) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), pa.array(sig)], ["doc_id", "fp", "fp2", "sig"])

    return raw.mapInArrow(run, "doc_id long, fp long, fp2 long, sig long")


# --- parts and thresholds ---------------------------------------------------

def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many of them bits i and j are both set."""
    def run(batches):
        both, n = np.zeros((64, 64)), 0
        for b in batches:
            bits = np.unpackbits(_fps(b).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*i.tolist(), -1], pa.int32()), pa.array([*j.tolist(), -1], pa.int32()), pa.array([*both[i, j].astype(np.int64).tolist(), n])], ["i", "j", "n"])

    rows = distinct.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((64, 64)), 0
    for r in rows:
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of near-equal width; each grows by the free bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    r = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(r, -1)
    free, parts = set(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        rest = sorted(free)
        sub = r[np.ix_(rest, rest)]
        part = [rest[int(np.argmax(sub.max(1)))]] if len(rest) > 1 else rest[:]
        free -= set(part)
        while len(part) < width:
            best = max(sorted(free), key=lambda b: r[b, part].sum())
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def part_values(fp: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for k, bit in enumerate(part):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` bits, nearest first."""
    out, ring = [0], [0]
    for _ in range(radius):
        ring = sorted({x | 1 << b for x in ring for b in range(width) if not x >> b & 1} - set(out))
        out += ring
    return np.array(out, np.int64)


def histograms(distinct: DataFrame, parts: list[list[int]]) -> list[np.ndarray]:
    def run(batches):
        hist = [np.zeros(1 << len(p), np.int64) for p in parts]
        for b in batches:
            fp = _fps(b)
            for h, p in zip(hist, parts, strict=True):
                h += np.bincount(part_values(fp, p), minlength=len(h))
        for i, h in enumerate(hist):
            v = np.nonzero(h)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v.astype(np.int32)), pa.array(h[v])], ["part", "value", "n"])

    out = [np.zeros(1 << len(p), np.int64) for p in parts]
    for r in distinct.select("fp").mapInArrow(run, "part int, value int, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).collect():
        out[r.part][r.value] = r.n
    return out


def costs(hist: np.ndarray, width: int, most: int) -> np.ndarray:
    """Row t + 1: for every value the cost of threshold t (-1: nothing, 0, 1, ... most)."""
    out, values = [np.zeros(len(hist), np.int64)], np.arange(len(hist))
    for t in range(most + 1):
        masks = ball(width, t)
        seen = sum(hist[values ^ x] for x in masks)
        out.append(seen + PROBE_COST * (len(masks) - 1))
    return np.array(out)


def allocate(values: list[np.ndarray], cost: list[np.ndarray], total: int) -> np.ndarray:
    """Thresholds (rows x parts) of sum ``total`` and least cost, by dynamic programming."""
    m, n = len(values), len(values[0])
    choices = cost[0].shape[0]  # thresholds -1 ... choices - 2, here counted from 0
    aim = total + m
    best = np.full((aim + 1, n), np.iinfo(np.int64).max // 4)
    best[0] = 0
    took = np.zeros((m, aim + 1, n), np.int8)
    for i in range(m):
        new = np.full_like(best, np.iinfo(np.int64).max // 4)
        for t in range(choices):
            c = cost[i][t][values[i]]
            for s in range(aim + 1 - t):
                got = best[s] + c
                less = got < new[s + t]
                new[s + t][less] = got[less]
                took[i, s + t][less] = t
        best = new
    out, s = np.zeros((n, m), np.int8), np.full(n, aim)
    for i in reversed(range(m)):
        t = took[i, s, np.arange(n)]
        out[:, i] = t - 1
        s = s - t
    return out


# --- keys and runs ----------------------------------------------------------

def keys_of(fp: np.ndarray, parts, hist, cost, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fp, role) rows; role 1: index, 2: probe, 3: both."""
    values = [part_values(fp, p) for p in parts]
    chosen = allocate(values, cost, total)
    ks, fs, rs = [], [], []

    def send(i, v, f, role):
        blocks = np.clip(-(-hist[i][v] // BLOCK), 1, MAX_BLOCKS)
        base = (np.int64(i) << np.int64(48)) | (v << np.int64(24))
        one = blocks == 1
        ks.append(base[one]), fs.append(f[one]), rs.append(np.full(one.sum(), role, np.int8))
        for nb in np.unique(blocks[~one]):
            at = blocks == nb
            own = ((f[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % nb
            for j in range(nb):
                ks.append(base[at] | np.minimum(own, j) * MAX_BLOCKS | np.maximum(own, j))
                fs.append(f[at]), rs.append(np.full(at.sum(), role, np.int8))

    for i, part in enumerate(parts):
        t = chosen[:, i]
        skipped = t < 0
        send(i, values[i][skipped], fp[skipped], 1)
        send(i, values[i][~skipped], fp[~skipped], 3)
        for d in range(1, int(t.max(initial=-1)) + 1):
            at = t >= d
            ring = ball(len(part), d)[len(ball(len(part), d - 1)):]
            for x in ring:
                v = values[i][at] ^ x
                some = hist[i][v] > 0
                send(i, v[some], fp[at][some], 2)
    return np.concatenate(ks), np.concatenate(fs), np.concatenate(rs)


def forest(fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum spanning forest (Prim) of the graph of distances up to tau: edges as positions."""
    n = len(fp)
    far = np.uint8(255)
    dist = np.full(n, far, np.uint8)
    parent = np.full(n, -1)
    left = np.arange(n)
    a, b = [], []
    while len(left):
        k = int(np.argmin(dist[left]))
        x = left[k]
        if dist[x] <= tau:
            a.append(int(parent[x])), b.append(int(x))
        left = np.delete(left, k)
        d = np.bitwise_count(fp[left] ^ fp[x])
        near = (d <= tau) & (d < dist[left])
        at = left[near]
        dist[at], parent[at] = d[near], x
    return np.array(a, np.int64), np.array(b, np.int64)


def links(fp: np.ndarray, role: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one run, all or (in a dense one) its spanning forest, as fingerprints."""
    probe, index = np.unique(fp[role >= 2]), np.unique(fp[(role & 1) == 1])
    none = np.zeros(0, np.uint64)
    if not len(probe) or not len(index) or (len(fp) == 1):
        return none, none
    most, found = SPARSE * (len(probe) + len(index)), 0
    pa_, pb_ = [], []
    rows = max(1, (1 << 22) // len(index))
    for at in range(0, len(probe), rows):
        some = probe[at:at + rows]
        i, j = np.nonzero(np.bitwise_count(some[:, None] ^ index[None, :]) <= tau)
        x, y = some[i], index[j]
        other = x != y
        x, y = x[other], y[other]
        pa_.append(np.minimum(x, y)), pb_.append(np.maximum(x, y))
        found += len(x)
        if found > most:
            u = np.unique(fp)
            i, j = forest(u, tau)
            return u[i], u[j]
    return np.concatenate(pa_), np.concatenate(pb_)


def plan(distinct: DataFrame, tau: int, m: int | None = None) -> tuple:
    """Parts, their histograms and costs, and the sum of thresholds, for searches up to ``tau``."""
    n, both = bit_counts(distinct)
    if m is None:
        m = 5 if n < 1 << 21 else 4
    total = tau - m + 1
    parts = group_bits(n, both, m)
    hist = histograms(distinct, parts)
    most = min(3, max(1, -(-total // m) + 1))
    return parts, hist, [costs(h, len(p), most) for h, p in zip(hist, parts, strict=True)], total


def runs_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[list[np.ndarray]]]:
    """The columns ``names`` of each run of equal k, batch by batch of rows sorted by k."""
    kept = None
    for batch in batches:
        k = batch.column("k").to_numpy(zero_copy_only=False)
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(k):
            continue
        cut = np.nonzero(np.diff(k))[0] + 1
        at = [0, *cut.tolist(), len(k)]
        runs = []
        for lo, hi in zip(at, at[1:], strict=False):
            if kept and kept[0] == k[lo]:
                kept[1].append([x[lo:hi] for x in own])
            else:
                if kept:
                    runs.append([np.concatenate(x) for x in zip(*kept[1], strict=True)])
                kept = (k[lo], [[x[lo:hi] for x in own]])
        yield [x for x in runs if len(x[0]) > 1]
    if kept:
        yield [[np.concatenate(x) for x in zip(*kept[1], strict=True)]]


def near_pairs(distinct: DataFrame, tau: int, m: int | None = None) -> DataFrame:
    """a, b, d: pairs of distinct fingerprints that link within ``tau`` bits (see 5 above)."""
    parts, hist, cost, total = plan(distinct, tau, m)

    def keyed(batches):
        for b in batches:
            if b.num_rows:
                k, f, r = keys_of(_fps(b), parts, hist, cost, total)
                for at in range(0, len(k), 1 << 20):
                    to = at + (1 << 20)
                    yield pa.RecordBatch.from_arrays([pa.array(k[at:to]), pa.array(f[at:to].view(np.int64)), pa.array(r[at:to])], ["k", "fp", "role"])

    def joined(batches):
        for runs in runs_of(batches, ["fp", "role"]):
            a, b = zip(*[links(f.view(np.uint64), r, tau) for f, r in runs], strict=True) if runs else ((), ())
            a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    rows = distinct.select("fp").mapInArrow(keyed, "k long, fp long, role byte")
    found = rows.repartition("k").sortWithinPartitions("k").mapInArrow(joined, "a long, b long")
    return found.distinct().withColumn("d", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))


# --- the operator -----------------------------------------------------------

def near_duplicates(docs: DataFrame, words: int = 4, tau: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the least id reachable by links of at most tau bits."""
    marked = materialize(fingerprints(docs, words, id_col, text_col), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-distinct")
    pairs = near_pairs(distinct, tau)
    ends = distinct.where("rep IS NOT NULL")
    edges = (
        pairs.join(ends.select(F.col("fp").alias("a"), F.col("rep").alias("rep_a")), "a")
        .join(ends.select(F.col("fp").alias("b"), F.col("rep").alias("rep_b")), "b")
    )
    found = connected_components(edges, "rep_a", "rep_b")
    of_fp = distinct.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    return join_facts(marked, materialize(of_fp, "simhash-of"), ["fp"], "n").select("doc_id", "fp", "component_id")


#: Of 128 bits of both fingerprints, as many may differ in a pair beyond ``tau`` that is worth comparing.
WORTH = 30
#: Bytes of shingles of one block of a crowd.
CROWD_BYTES = 16 << 20


def proposals(fp, fp2, node, group, crowd, role, tau: int, accept: int, hubs: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of nodes of one run that are worth comparing and not yet in one group or crowd; third,
    whether a pair says instead that its ends were together in a dense run.

    A run with few gives them all. A dense run gives what says that its nodes were together, by one
    node for each crowd (a node outside of crowds has one of its own), and with ``hubs`` hubs' pairs: again and again of the node with most pairs among those that no hub
    has yet, to all of these and to the nearest that one has."""
    node, first, at = np.unique(node, return_index=True, return_inverse=True)
    fp, fp2, group, crowd = fp[first], fp2[first], group[first], crowd[first]
    probe, index = np.unique(at[role >= 2]), np.unique(at[(role & 1) == 1])
    if not len(probe) or not len(index) or len(node) == 1:
        return

    def near(a, b):
        d = np.bitwise_count(fp[a][:, None] ^ fp[b][None, :])
        i, j = np.nonzero((d <= accept) & (group[a][:, None] != group[b][None, :]) & (crowd[a][:, None] != crowd[b][None, :]))
        d, x, y = d[i, j], a[i], b[j]
        worth = (d <= tau) | (d + np.bitwise_count(fp2[x] ^ fp2[y]) <= WORTH)
        return x[worth], y[worth], d[worth]

    def pairs(x, y):
        return np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), np.zeros(len(x), bool)

    rows, all_, found = max(1, (1 << 22) // len(index)), np.arange(len(node)), []
    blocks = [probe[k:k + rows] for k in range(0, len(probe), rows)]
    for some in blocks:
        x, y, _ = near(some, index)
        found.append(pairs(x, y))
        if sum(len(f[0]) for f in found) > (SPARSE if hubs else 1) * len(role):
            break
    else:
        yield from found
        return
    degree = np.zeros(len(node), np.int64)
    for some in blocks:
        x, y, _ = near(some, index)
        degree += np.bincount(x, minlength=len(node)) + np.bincount(y, minlength=len(node))
    free = degree > 0
    met = node[free][np.unique(crowd[free], return_index=True)[1]]
    yield np.full(len(met), met[0]), met, np.ones(len(met), bool)
    if not hubs:
        return
    for k in np.argsort(-degree, kind="stable").tolist():
        if not free[k]:
            continue
        _, y, d = near(all_[k:k + 1], all_)
        free[k] = False
        new, old = free[y], ~free[y]
        to = np.append(y[new], y[old][np.argmin(d[old])]) if old.any() else y
        free[y] = False
        yield pairs(np.full(len(to), k), to)


def search(nodes: DataFrame, parts, hist, cost, total: int, tau: int, accept: int, hubs: bool = False) -> DataFrame:
    """u, v, dense: pairs of reps of ``nodes`` (fp, fp2, rep, grp, crowd) by thresholds of sum ``total``, see proposals."""
    names, out = ["fp", "fp2", "rep", "grp", "crowd"], ["u", "v", "dense"]

    def keyed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            fp = _fps(b)
            order = np.argsort(fp, kind="stable")
            own, start, n = np.unique(fp[order], return_index=True, return_counts=True)
            k, f, r = keys_of(own, parts, hist, cost, total)
            i = np.searchsorted(own, f)
            row = np.repeat(np.arange(len(k)), n[i])
            pos = order[start[i][row] + np.arange(len(row)) - np.repeat(np.cumsum(n[i]) - n[i], n[i])]
            for at in range(0, len(row), 1 << 18):
                here, to = row[at:at + (1 << 18)], pa.array(pos[at:at + (1 << 18)])
                yield pa.RecordBatch.from_arrays([pa.array(k[here]), pa.array(r[here]), *(b.column(c).take(to) for c in names)], ["k", "role", *names])

    def joined(batches):
        for runs in runs_of(batches, ["role", *names]):
            for role, fp, fp2, rep, grp, crowd in runs:
                got, size = [], 0
                for p in proposals(fp.view(np.uint64), fp2.view(np.uint64), rep, grp, crowd, role, tau, accept, hubs):
                    got.append(p)
                    size += len(p[0])
                    if size > 1 << 18:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got, strict=True)], out)
                        got, size = [], 0
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got, strict=True)], out)

    rows = nodes.select(*names).mapInArrow(keyed, "k long, role byte, fp long, fp2 long, rep long, grp long, crowd long")
    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(joined, "u long, v long, dense boolean").distinct()


def _root(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def crowd_links(node: np.ndarray, group: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links of at least ``similarity`` Jaccard that join the groups of a crowd's two blocks (``side``),
    one for each two groups that meet; every pair of unlike groups is compared, exactly.

    Shingles that many nodes hold are counted by products of 0/1 matrices, the others by the lists
    of the nodes that hold them; those of one node only can't be shared. The largest group's nodes
    are compared with the others' alone."""
    size = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    _, at, df = np.unique(flat, return_index=True, return_counts=True)
    common = df >= max(32, len(node) // 32)
    rank = np.cumsum(common) - 1
    which = np.repeat(np.arange(len(df)), df)
    held = common[which]
    by_node = np.argsort(owner[held], kind="stable")
    counts = np.bincount(owner[held], minlength=len(node))
    dense = np.split(rank[which[held]][by_node], np.cumsum(counts)[:-1])
    rare = [[] for _ in sets]
    for k in np.nonzero(~common & (df > 1))[0].tolist():
        members = owner[at[k]:at[k] + df[k]]
        for x in members.tolist():
            rare[x].append(members)
    names, of, n = np.unique(group, return_inverse=True, return_counts=True)
    parent = {g: g for g in range(len(names))}
    rows = np.nonzero(of != int(np.argmax(n)))[0]
    width, us, vs = int(common.sum()), [], []
    step = 256
    for lo in range(0, len(rows), step):
        some = rows[lo:lo + step]
        both = np.zeros((len(some), len(node)), np.float32)
        for c in range(0, width, 1024):
            x = np.zeros((len(node), min(1024, width - c)), np.float32)
            for k, d in enumerate(dense):
                part = d[np.searchsorted(d, c):np.searchsorted(d, c + 1024)] - c
                x[k, part] = 1
            both += x[some] @ x.T
        for i, k in enumerate(some.tolist()):
            if rare[k]:
                both[i] += np.bincount(np.concatenate(rare[k]), minlength=len(node))
        alike = both >= similarity * (size[some][:, None] + size[None, :] - both)
        alike &= (of[some][:, None] != of[None, :]) & ((side[some][:, None] != side[None, :]) | (side.min() == side.max()))
        for i, k in zip(*(x.tolist() for x in np.nonzero(alike)), strict=True):
            a, b = _root(parent, int(of[some[i]])), _root(parent, int(of[k]))
            if a != b:
                parent[a] = b
                us.append(int(node[some[i]])), vs.append(int(node[k]))
    return us, vs


def crowds_compared(crowd: DataFrame, similarity: float) -> DataFrame:
    """u, v: links between groups within a crowd, from rows (crowd, id, grp, own: shingle set).

    A crowd of more than CROWD_BYTES of shingles is dealt out as pairs of blocks of about as many."""
    sizes = crowd.groupBy("crowd").agg(F.sum(F.octet_length("own") + 64).alias("bytes"), F.countDistinct("grp").alias("groups"))
    sizes = sizes.where("groups > 1").select("crowd", F.ceil(F.col("bytes") / CROWD_BYTES).cast("int").alias("blocks"))
    placed = crowd.join(sizes, "crowd").withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("crowd", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "id", "grp", "own")
    keyed = dealt.select(F.xxhash64("crowd", "a", "b").alias("k"), "side", "id", "grp", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []

        def links():
            if len(kept) > 1:
                side, node, group, own = zip(*kept, strict=True)
                u, v = crowd_links(np.array(node), np.array(group), np.array(side), [np.frombuffer(x, np.uint32) for x in own], similarity)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            for k, *row in zip(*(b.column(c).to_pylist() for c in ("k", "side", "id", "grp", "own")), strict=True):
                if k != now:
                    yield from links()
                    now, kept = k, []
                kept.append(row)
        yield from links()

    return keyed.repartition("k").sortWithinPartitions("k").mapInArrow(run, "u long, v long")


def similar_documents(docs: DataFrame, words: int = 5, tau: int = 9, accept: int = 14, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id over links of at least ``similarity`` Jaccard of word shingles.

    SimHash proposes, by two fingerprints of independent bits: all pairs within ``tau`` bits of
    either, and those up to ``accept`` bits that meet as well (a pair of similarity 0.8 differs in
    about 10 bits of 64, and meets in some part of one fingerprint with a chance of nine in ten),
    if the other fingerprint agrees. The Jaccard similarity of the whole
    texts' shingle sets (as 32-bit hashes) decides.

    Two searches, each checked by Jaccard before the next, list no pair whose ends the links so far
    connect. The first has exact parts alone, and dense runs give hubs' pairs: it connects most of a
    crowd of copies to the text that they were copied from. The second goes up to ``tau`` for all
    nodes, by either fingerprint. The nodes of dense runs of either search, joined where runs share
    nodes, are crowds: within a crowd every pair of nodes that nothing connects yet is compared,
    whatever its distance; only links leave the task, at most one for two groups that meet. So the
    second search takes a crowd of the first as one. Pairs of other nodes are listed.

    Defined results: as for ``near_duplicates``; texts of fewer words than a shingle are one shingle,
    texts without a word are alike; a repeated id goes by all its rows' links."""
    marked = materialize(fingerprints(docs, words, id_col, text_col, second=True), "similar")
    node = materialize(marked.groupBy("fp", "sig").agg(F.min("doc_id").alias("rep"), F.min("fp2").alias("fp2"), F.count("*").alias("n")).where("rep IS NOT NULL"), "similar-node")
    parts, hist, cost, total = plan(node, tau)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingle_set(t, words).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own, pa.binary())], ["doc_id", "own"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for u, v, x, y in zip(*(b.column(c).to_pylist() for c in ("u", "v", "x", "y")), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], ["u", "v"])

    def joined(links: DataFrame, known: DataFrame | None) -> DataFrame:
        """id, component by ``links`` and those so far."""
        if known is not None:
            links = links.unionByName(known.select(F.col("id").alias("u"), F.col("component").alias("v")))
        return materialize(connected_components(links, "u", "v"), "similar-groups")

    def linked(asked: DataFrame, known: DataFrame | None, own: DataFrame | None, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """id, component by the links so far and those of ``asked``; the shingle sets read so far,
        those of the ids in ``also`` too."""
        ids = asked.select(F.explode(F.array("u", "v")).alias("doc_id"))
        ids = (ids if also is None else ids.unionByName(also.select(F.col("id").alias("doc_id")))).distinct()
        ids = materialize(ids if own is None else ids.join(own.select("doc_id"), "doc_id", "left_anti"), "similar-ids")
        wanted = semi_by_id(rows, ids, "doc_id")
        more = wanted.mapInArrow(sets, "doc_id long, own binary")
        if wanted.select("doc_id").count() > ids.count():  # a repeated id stands for its greatest set
            more = more.groupBy("doc_id").agg(F.max("own").alias("own"))
        more = materialize(more, "similar-sets")
        own = more if own is None else own.unionByName(more)
        held = asked.join(own.select(F.col("doc_id").alias("u"), F.col("own").alias("x")), "u").join(own.select(F.col("doc_id").alias("v"), F.col("own").alias("y")), "v")
        return joined(held.mapInArrow(compared, "u long, v long"), known), own

    def unsettled(together: DataFrame, known: DataFrame) -> DataFrame:
        """id, crowd of the crowds in which the links so far leave more than one group."""
        crowd = materialize(connected_components(together, "u", "v").withColumnRenamed("component", "crowd"), "similar-met")
        held = crowd.join(known, "id", "left").select("crowd", "id", F.coalesce("component", "id").alias("grp"))
        facts = held.groupBy("crowd").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count("*").alias("n"))
        return materialize(join_facts(held, facts, ["crowd"], "n").where("low <> high").select("id", "crowd"), "similar-unsettled")

    def grouped(nodes: DataFrame, known: DataFrame, crowds: DataFrame) -> DataFrame:
        marked_ = nodes.join(known.withColumnRenamed("id", "rep"), "rep", "left").join(crowds.withColumnRenamed("id", "rep"), "rep", "left")
        return materialize(marked_.select("fp", "fp2", "rep", F.coalesce("component", "rep").alias("grp"), F.coalesce("crowd", "rep").alias("crowd")), "similar-grouped")

    first = materialize(search(node.withColumns({"grp": F.col("rep"), "crowd": F.col("rep")}), parts, hist, cost, 4 - len(parts) + 1, tau, accept, hubs=True), "similar-first")
    found, own = linked(first.where("NOT dense").select("u", "v"), None, None)
    met = unsettled(first.where("dense").select("u", "v"), found)
    now = grouped(node, found, met)
    turned = now.select(F.col("fp2").alias("fp"), F.col("fp").alias("fp2"), "rep", "grp", "crowd")
    both = search(now, parts, hist, cost, total, tau, accept).unionByName(search(turned, *plan(turned, tau), tau, accept))
    second = materialize(both.distinct(), "similar-second")
    asked, dense = second.where("NOT dense").select("u", "v"), second.where("dense").select("u", "v")
    dense = dense.unionByName(met.select(F.col("id").alias("u"), F.col("crowd").alias("v")))
    if dense.isEmpty():
        found, own = linked(asked, found, own)
    else:
        crowd = materialize(connected_components(dense, "u", "v").withColumnRenamed("component", "crowd"), "similar-crowds")
        of = lambda x: crowd.select(F.col("id").alias(x), F.col("crowd").alias(f"crowd_{x}"))
        outside = asked.join(of("u"), "u", "left").join(of("v"), "v", "left").where("crowd_u IS NULL OR crowd_v IS NULL OR crowd_u <> crowd_v")
        found, own = linked(materialize(outside.select("u", "v"), "similar-outside"), found, own, crowd)
        held = crowd.join(found, "id", "left").select("crowd", "id", F.coalesce("component", "id").alias("grp"))
        held = materialize(held.join(own.withColumnRenamed("doc_id", "id"), "id"), "similar-crowd")
        found = joined(crowds_compared(held, similarity), found)
    of_node = node.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fp", "sig", "n", F.coalesce("component", "rep").alias("component_id"))
    return join_facts(marked, materialize(of_node, "similar-of"), ["fp", "sig"], "n").where("component_id IS NOT NULL").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that are similar to one of a lesser id (see similar_documents)."""
    found = materialize(similar_documents(docs, id_col=id_col, text_col=text_col, **how), "similar-found")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return anti_by_id(docs, materialize(gone, "similar-gone"), id_col)


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words=4, tau=4).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
