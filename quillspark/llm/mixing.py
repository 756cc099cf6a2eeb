"""Mixing to target weights with soft domain membership.

1. A naive Bayes classifier over hashed token indicators is learned from labelled
   rows (at most MAX_TRAIN, those whose id hashes lowest). It keeps buckets more
   frequent in a domain (the commonest, the background, aside) than in the others by
   Z_MIN standard errors and by a factor; a text speaks by those it has and those it
   lacks; a single
   temperature, chosen on a tenth of the sample that the counts leave out, keeps its
   posteriors soft.
2. Every whole document gets its token count and a posterior for each domain.
3. Projected-gradient least squares finds document rates r >= 0 whose expected
   domain totals, sum r * tokens * posterior, meet the targets. Every document starts
   at rate 1; the gradient at a document is its posteriors times the domains'
   residuals, so the sum of all steps is K multipliers, and a rate is the projection
   of 1 less its posteriors times these on r >= 0. A step is scaled by the second
   moments of the documents whose rate is not at a bound, and halved until the
   objective falls; it needs one aggregate of K * (K + 3) / 2 + 1 sums. The term
   STAY * tokens * (r - 1)^2 / 2 makes the solution unique: of mixes that meet the
   targets equally well, the one nearest to the documents as they are.

All of it is SQL on the JVM. Texts are read once for scoring and once for the
sample, and never shuffled; documents of equal posteriors, which get equal rates, are
added up before the fit; only counts of BUCKETS buckets, and a few sums a step, reach
the driver. Of labelled rows that share their SKETCH least hashes of four tokens
running, which only copies do, the one of least id is learned from.

Defined results: a null or empty text has no token, the prior as its posterior and
the rate that this asks for; domains without labelled rows or targets get
weight 0; without any labelled row all rates are 1; repeated ids give a row each; an
empty table gives no rows; extra columns are ignored. Targets that no rates reach
are met as nearly as least squares can. Results do not depend on how rows are
partitioned, but for the last bits of sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import anti_by_id, discard, materialize, table

MAX_TRAIN = 20_000
BUCKETS = 1 << 14
Z_MIN = 6.0
RATIO_MIN = 1.0
MIN_ROWS = 8
SKETCH = 6
SMOOTHING = 0.5
TEMPERATURES = [0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0]
#: Posterior from which a document may be thinned out of a domain.
SURE = 0.8
#: Weight of staying at rate 1, against squared residuals as shares of all tokens.
STAY = 1e-7
#: The fit ends when no domain's derivative exceeds this share of all tokens; it raises if that takes more steps.
TOLERANCE = 1e-9
MOST_STEPS = 200
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def buckets(text: Column) -> Column:
    """A bucket for each token of a whole text."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))
    return F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _literal(values: list[float]) -> Column:
    """An array literal, small to send: the optimizer folds it once."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def _sample(docs: DataFrame, labelled: DataFrame, most: int) -> DataFrame:
    one = labelled.where("domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    tested = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 9
    split = rows.select("doc_id", "domain", tested.alias("tested"), buckets(F.col("text")).alias("all"))
    # copies would make every word of a copied text tell
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("all") - 3, F.lit(1))), lambda i: F.xxhash64(F.slice("all", i, 4)))
    like = F.slice(F.array_sort(F.array_distinct(runs)), 1, SKETCH)
    row = F.struct("doc_id", "tested", F.array_sort(F.array_distinct("all")).alias("have"))
    return split.select("domain", like.alias("like"), row.alias("row")).groupBy("domain", "like").agg(F.min("row").alias("row")).select("domain", "row.tested", "row.have")


def learn(docs: DataFrame, labelled: DataFrame, most: int = MAX_TRAIN) -> dict:
    """{"domains", "base", "weights": a list of BUCKETS log odds for each domain, "t"}."""
    rows = materialize(_sample(docs, labelled, most), "mix-sample")
    known = rows.where("NOT tested")
    n = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    domains, total = sorted(n), sum(n.values())
    if not domains:
        return {"domains": [], "base": [], "weights": [], "t": 1.0}
    counts: dict[int, dict[str, int]] = {}
    for r in known.select("domain", F.explode("have").alias("bucket")).groupBy("bucket", "domain").count().collect():
        counts.setdefault(r.bucket, {})[r.domain] = r["count"]
    # The commonest domain is the background: what tells for it is mostly what long texts have
    # and short ones lack, so that only the other domains' buckets are evidence.
    background = max(domains, key=lambda d: (n[d], d))
    telling = set()
    for b, by in counts.items():
        everywhere = sum(by.values())
        if everywhere < min(MIN_ROWS, max(3, total // 100)):
            continue
        share = everywhere / total
        for d in domains:
            if d == background and len(domains) > 1:
                continue
            inside, outside, rest = by.get(d, 0), everywhere - by.get(d, 0), max(total - n[d], 1)
            z = (inside / n[d] - outside / rest) / math.sqrt(max(share * (1 - share), 1e-9) * (1 / n[d] + 1 / rest))
            if z >= Z_MIN and math.log((inside + SMOOTHING) / (n[d] + 1) / ((outside + SMOOTHING) / (rest + 1))) >= RATIO_MIN:
                telling.add(b)
    weights, base = [[0.0] * BUCKETS for _ in domains], [math.log(n[d] / total) for d in domains]
    for k, d in enumerate(domains):
        for b in telling:
            p = (counts[b].get(d, 0) + SMOOTHING) / (n[d] + 2 * SMOOTHING)
            base[k] += math.log(1 - p)  # as if absent; a bucket that is present takes this back
            weights[k][b] = math.log(p / (1 - p))
    model = {"domains": domains, "base": base, "weights": weights, "t": 1.0}
    if len(domains) > 1:
        tested = rows.where("tested").select("domain", *logits(model, F.col("have")))
        losses = []
        for t in TEMPERATURES:
            z = [F.col(f"z_{k}") / t for k in range(len(domains))]
            top = F.greatest(*z)
            norm = top + F.log(sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top)))
            own = F.lit(None).cast("double")
            for k, d in enumerate(domains):
                own = F.when(F.col("domain") == d, z[k]).otherwise(own)
            losses.append(F.avg(norm - own))
        got = [x for x in tested.agg(*losses).first()]
        if got[0] is not None:
            model["t"] = TEMPERATURES[got.index(min(got))]
    return model


def logits(model: dict, have: Column) -> list[Column]:
    """z_k: log likelihood of which telling buckets a text has and lacks, with the prior."""
    each = enumerate(zip(model["base"], model["weights"], strict=True))
    return [_sum(have, p, _literal(w)).alias(f"z_{k}") for k, (p, w) in each]


def _sum(have: Column, start: float, weights: Column) -> Column:
    return F.aggregate(have, F.lit(float(start)), lambda acc, b: acc + F.element_at(weights, b + 1))


def posteriors(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens, p_0 ... p_K-1 of every document."""
    telling = [float(any(w[b] for w in model["weights"])) for b in range(BUCKETS)]
    mask = _literal(telling)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), buckets(F.col(f"`{text_col}`")).alias("all"))
    rows = rows.select("doc_id", F.size("all").cast("long").alias("tokens"), F.array_sort(F.array_distinct(F.filter("all", lambda b: F.element_at(mask, b + 1) > 0))).alias("have"))
    k = len(model["domains"])
    scored = rows.select("doc_id", "tokens", *logits(model, F.col("have")))
    z = [F.col(f"z_{i}") / model["t"] for i in range(k)]
    top = F.greatest(*z) if k > 1 else (z[0] if k else F.lit(0.0))
    e = [F.exp(x - top) for x in z]
    return scored.select("doc_id", "tokens", *[(x / sum(e[1:], e[0])).alias(f"p_{i}") for i, x in enumerate(e)])


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """x of a x = b for a small symmetric positive definite a, by elimination."""
    k = len(b)
    rows = [[*r, x] for r, x in zip(a, b, strict=True)]
    for i in range(k):
        for j in range(i + 1, k):
            f = rows[j][i] / rows[i][i]
            rows[j] = [y - f * x for x, y in zip(rows[i], rows[j], strict=True)]
    out = [0.0] * k
    for i in reversed(range(k)):
        out[i] = (rows[i][k] - sum(rows[i][j] * out[j] for j in range(i + 1, k))) / rows[i][i]
    return out


def rate_of(m: list[float], most: float | None, movable: Column | None = None) -> Column:
    """1 less the steps so far, projected on 0 to ``most``; 1 where a row may not move."""
    out = F.greatest(F.lit(0.0), 1 - _dot(m))
    out = out if most is None else F.least(F.lit(float(most)), out)
    return out if movable is None else F.when(movable, out).otherwise(F.lit(1.0))


def _dot(m: list[float]) -> Column:
    return sum((F.col(f"p_{k}") * F.lit(float(x)) for k, x in enumerate(m[1:], 1)), F.col("p_0") * F.lit(float(m[0])))


def rates(rows: DataFrame, targets: list[float], most: float | None = None, movable: Column | None = None) -> tuple[Column, dict]:
    """A column of rates over ``rows`` (tokens, p_k), and the fit: multipliers, totals, off, steps.

    ``targets`` are expected tokens of each domain; rows that are not ``movable`` keep rate 1,
    no rate exceeds ``most``. ``off`` is the largest residual as a share of all tokens."""
    k = len(targets)
    held = F.lit(True) if movable is None else F.coalesce(movable, F.lit(False))
    profiles = rows.select("tokens", *[F.col(f"p_{a}") for a in range(k)], held.alias("held")).where("tokens > 0")
    profiles = profiles.groupBy("held", *[f"p_{a}" for a in range(k)]).agg(F.sum("tokens").cast("double").alias("tokens"))
    profiles = materialize(profiles, "mix-profiles")
    total = float(profiles.agg(F.sum("tokens")).first()[0] or 0)
    if not total or not k:
        return F.lit(1.0), {"multipliers": [0.0] * k, "totals": [0.0] * k, "off": 0.0, "steps": 0}
    share = F.col("tokens") / total
    aims = [t / total for t in targets]
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    # in the term of movable rows the slope is minus the rate, so that its derivative is minus the expected total
    cap = F.lit(float("inf")) if most is None else F.lit(float(most))

    def at(m: list[float]) -> tuple[float, list[float], list[list[float]]]:
        x = F.lit(1.0) - _dot(m)
        inside = F.col("held") & (x > 0) & (x < cap)
        rate = rate_of(m, most, F.col("held"))
        term = F.when(~F.col("held"), x).when(x <= 0, F.lit(0.0)).when(x < cap, x * x / 2)
        term = term if most is None else term.otherwise(cap * x - cap * cap / 2)
        got = profiles.agg(
            F.sum(share * term).alias("f"), *[F.sum(share * rate * F.col(f"p_{a}")).alias(f"e_{a}") for a in range(k)],
            *[F.sum(F.when(inside, share * F.col(f"p_{a}") * F.col(f"p_{b}")).otherwise(0.0)).alias(f"h_{a}_{b}") for a, b in pairs]).first()
        value = got.f + sum(x * t + STAY * x * x / 2 for x, t in zip(m, aims, strict=True))
        h = [[got[f"h_{min(a, b)}_{max(a, b)}"] + STAY * (a == b) for b in range(k)] for a in range(k)]
        return value, [got[f"e_{a}"] for a in range(k)], h

    m, steps = [0.0] * k, 0
    value, expected, h = at(m)
    while True:
        slope = [t - e + STAY * x for x, t, e in zip(m, aims, expected, strict=True)]
        if max(map(abs, slope)) <= TOLERANCE:
            break
        move = _solve(h, [-g for g in slope])
        fall, size = sum(a * b for a, b in zip(move, slope, strict=True)), 1.0
        while True:
            steps += 1
            to = [x + size * y for x, y in zip(m, move, strict=True)]
            value_to, expected_to, h_to = at(to)
            if value_to <= value + 1e-4 * size * fall + 1e-13 * abs(value):
                break
            size /= 2
            if steps > MOST_STEPS:
                raise RuntimeError(f"rates did not settle in {MOST_STEPS} steps")
        m, value, expected, h = to, value_to, expected_to, h_to
    discard(profiles)
    off = max(abs(t - e) for t, e in zip(aims, expected, strict=True))
    return rate_of(m, most, movable), {"multipliers": m, "totals": [e * total for e in expected], "off": off, "steps": steps}


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total_tokens: float | None = None) -> DataFrame:
    """doc_id, tokens, domain (the likeliest), p_<domain> ..., rate of every document.

    ``labelled`` has doc_id and domain; ``weights`` the domains' shares of the mix, of
    ``total_tokens`` expected tokens (those of ``docs`` if None)."""
    model = learn(docs, labelled)
    domains = model["domains"]
    if not domains:
        none = buckets(F.col("text"))
        return docs.select("doc_id", F.size(none).cast("long").alias("tokens"), F.lit(None).cast("string").alias("domain"), F.lit(1.0).alias("rate"))
    rows = materialize(posteriors(docs, model), "mix-posteriors")
    share = sum(weights.get(d, 0.0) for d in domains) or 1.0
    total = total_tokens if total_tokens is not None else float(rows.agg(F.sum("tokens")).first()[0] or 0)
    rate, _ = rates(rows, [total * weights.get(d, 0.0) / share for d in domains])
    top = F.greatest(*[F.col(f"p_{k}") for k in range(len(domains))]) if len(domains) > 1 else F.col("p_0")
    likeliest = F.lit(domains[-1])
    for k in reversed(range(len(domains) - 1)):
        likeliest = F.when(F.col(f"p_{k}") == top, domains[k]).otherwise(likeliest)
    return rows.select("doc_id", "tokens", likeliest.alias("domain"), *[F.col(f"p_{k}").alias(f"p_{d}") for k, d in enumerate(domains)], rate.alias("rate"))


def thin(docs: DataFrame, labelled: DataFrame, shares: dict[str, float], sure: float = SURE) -> DataFrame:
    """``docs`` without some documents of the domains in ``shares``, so that each of these has at
    most that share of the mix's expected tokens; the other domains keep what they have.

    Only documents that belong to a domain to be thinned with a posterior of ``sure`` at least may
    go; all others keep rate 1, as does everything if no row is labelled with a domain to be thinned,
    or none with one that is not. The fit knows this, so the rates, 0 to 1, are those that the hash of a document's id, as a number
    from 0 to 1, is held against: what is expected to stay is the fitted mix. All columns are kept."""
    model = learn(docs, labelled)
    domains = model["domains"]
    if not set(domains) & set(shares) or not set(domains) - set(shares):
        return docs
    rows = materialize(posteriors(docs, model), "mix-posteriors")
    k = len(domains)
    now = [float(x or 0) for x in rows.agg(*[F.sum(F.col("tokens") * F.col(f"p_{i}")) for i in range(k)]).first()]
    rest = sum(x for x, d in zip(now, domains, strict=True) if d not in shares)
    whole = rest / max(1e-9, 1 - sum(shares[d] for d in domains if d in shares))
    aims = [min(x, shares[d] * whole) if d in shares else x for x, d in zip(now, domains, strict=True)]
    excess = F.lit(False)
    for i, d in enumerate(domains):
        if d in shares:
            excess = excess | (F.col(f"p_{i}") >= sure)
    rate, _ = rates(rows, aims, most=1.0, movable=excess)
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id")), F.lit(1_000_000)) / 1_000_000
    gone = rows.where(excess & (chance >= rate)).select("doc_id").distinct()
    return anti_by_id(docs, materialize(gone, "mix-gone"), "doc_id")


def label_domains(labels: DataFrame) -> DataFrame:
    """The domain that a row of ``labels`` puts its document in."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))


#: Shares of the mix for which the registered query asks.
TARGETS = {"clean": 0.85, "low": 0.1, "toxic": 0.05}


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGETS)
