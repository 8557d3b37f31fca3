"""Mixing sources to target weights with soft memberships, in DataFrame and SQL functions only.

A naive Bayes classifier over hashed words, trained on labelled rows (about TRAIN_ROWS of them at most, taken by hash; of an id
whose rows disagree the domain that comes first by name), gives every document a posterior over domains. Nonnegative document rates are then fitted by least squares so that the
expected tokens of each domain, sum of rate * tokens * posterior, match the targets: projected gradient steps from
rates of one, in the metric that weights documents by tokens, projected lazily, so that the rates are
``max(0, 1 + posterior . sum of steps)`` and only one number a domain is carried from pass to pass. Each pass is one
aggregate over a small table; texts are read once.

Words are tokens here (runs other than white space). Null and empty texts have no tokens, the prior as posterior, and a rate that
follows from it. Very long texts are split into rows of words where they are read. Equal texts get equal rates. Without labelled rows all posteriors are equal. A null
doc_id is kept. Repeated rows give repeated results; an empty table gives no rows. Extra columns are ignored by
``document_rates`` and kept by ``mixed``.

``mixed`` drops nothing: its rates are at least one, and the total is free. Of the rates from 1 to REPEATS whose expected tokens
have the targets' shares it takes those nearest to one, ``1 + posterior . steps`` held within these bounds with the steps orthogonal to
the targets, found by the same gradient steps. Where no rates within the bounds meet the targets, it warns and comes near.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, table

BUCKETS = 1 << 13
#: Bound of the training sample, rows.
TRAIN_ROWS = 20_000
#: Words that count at most towards a posterior, so that long texts keep a soft membership.
EVIDENCE = 64
STEPS = 80
TOLERANCE = 1e-4
#: Most times that a document is repeated.
REPEATS = 16

DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'high' ELSE 'low' END"
TARGETS = {"high": 0.85, "low": 0.1, "toxic": 0.05}


def _key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def _words(df: DataFrame, *keep: str) -> DataFrame:
    """keep, at, bucket of each word; the outer form keeps the optimiser from splitting each text twice."""
    parts = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+")
    cut = df.select(*keep, F.posexplode_outer(parts).alias("at", "word"))
    return cut.select(*keep, "at", (F.col("word") != "").cast("int").alias("real"), F.when(F.col("word") != "", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")).alias("bucket"))


def posteriors(docs: DataFrame, labels: DataFrame, domain: str = DOMAIN, domains: tuple[str, ...] = tuple(TARGETS), bound: int = TRAIN_ROWS) -> DataFrame:
    """key, copies, tokens, p (array of posteriors in the order of domains) of every distinct text."""
    tables = Tables(docs.sparkSession)
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(domain).alias("domain")).where(F.col("domain").isin(*domains))
    share = min(1.0, bound / max(1, named.count()))
    named = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(named, "doc_id")
    seen = [F.sum((F.col("domain") == d).cast("long")).alias(f"c{k}") for k, d in enumerate(domains)]
    counts = tables.write(_words(train, "domain").where("bucket IS NOT NULL").groupBy("bucket").agg(*seen), "mix-counts")
    total = counts.agg(*[F.sum(f"c{k}") for k in range(len(domains))]).first()
    mass = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    prior = [math.log((mass.get(d, 0) + 1) / (sum(mass.values()) + len(domains))) for d in domains]
    # thousandths of a log likelihood as whole numbers: sums do not depend on their order
    like = [F.round(1000 * F.log((F.col(f"c{k}") + 0.5) / ((t or 0) + 0.5 * BUCKETS))).cast("long").alias(f"l{k}") for k, t in enumerate(total)]
    none = [round(1000 * math.log(0.5 / ((t or 0) + 0.5 * BUCKETS))) for t in total]
    weights = F.broadcast(counts.select("bucket", *like))  # BUCKETS rows at most
    sums = [F.sum(F.when(F.col("bucket").isNotNull(), F.coalesce(f"l{k}", F.lit(v)))).alias(f"s{k}") for k, v in enumerate(none)]
    scored = (
        _words(docs.select(_key().alias("key"), "text"), "key")
        .join(weights, "bucket", "left")
        .groupBy("key")
        .agg(F.sum((F.col("at") == 0).cast("long")).alias("copies"), F.sum("real").alias("words"), *sums)
    )
    mean = F.least(F.col("words"), F.lit(EVIDENCE) * F.col("copies")) / F.greatest(F.lit(1), F.col("words")) / F.col("copies") / 1000
    score = F.array(*[F.lit(p) + F.coalesce(F.col(f"s{k}") * mean, F.lit(0.0)) for k, p in enumerate(prior)])
    raised = scored.select("key", "copies", (F.col("words") / F.col("copies")).cast("long").alias("tokens"), score.alias("s"))
    raised = raised.select("key", "copies", "tokens", F.expr("transform(s, x -> exp(x - array_max(s)))").alias("e"))
    return tables.result(raised.select("key", "copies", "tokens", F.expr("transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y))").alias("p")), "posteriors")


def fit_steps(soft: DataFrame, goal: list[float]) -> list[float]:
    """The sum of steps: one number a domain; goal: tokens wanted of each domain."""
    n = len(goal)
    moved = [0.0] * n
    load = F.col("copies") * F.col("tokens")
    square = soft.agg(*[F.sum(load * F.col("p")[k] * F.col("p")[k]) for k in range(n)], F.sum(load)).first()
    total = square[n] or 0
    if not total:
        return moved
    scale = sum((square[k] or 0) / total for k in range(n))  # the trace bounds the largest eigenvalue: steps of 1 / scale converge
    pace = 1 / max(scale, 1e-9)
    before = list(moved)
    for turn in range(STEPS):
        ahead = [m + turn / (turn + 3) * (m - b) for m, b in zip(moved, before, strict=True)]
        rate = F.greatest(F.lit(0.0), F.lit(1.0) + sum((F.lit(a) * F.col("p")[k] for k, a in enumerate(ahead)), F.lit(0.0)))
        got = soft.agg(*[F.sum(load * rate * F.col("p")[k]) for k in range(n)]).first()
        gap = [(g - (x or 0.0)) / total for g, x in zip(goal, got, strict=True)]
        before, moved = moved, [a + pace * g for a, g in zip(ahead, gap, strict=True)]
        if max(map(abs, gap)) < TOLERANCE:
            break
    return moved


def _bounded(step: list[float]) -> Column:
    return F.least(F.lit(float(REPEATS)), F.greatest(F.lit(1.0), F.lit(1.0) + sum((F.lit(a) * F.col("p")[k] for k, a in enumerate(step)), F.lit(0.0))))


def fit_growth(soft: DataFrame, share: list[float]) -> list[float]:
    """The sum of steps, orthogonal to the targets' shares, for rates of one and more whose total is free."""
    n = len(share)
    load = F.col("copies") * F.col("tokens")
    norm = sum(s * s for s in share)
    along = sum((F.lit(s) * F.col("p")[k] for k, s in enumerate(share)), F.lit(0.0)) / norm
    across = [F.col("p")[k] - F.lit(s) * along for k, s in enumerate(share)]
    moved = [0.0] * n
    first = soft.agg(F.sum(load), F.sum(load * sum((a * a for a in across), F.lit(0.0)))).first()
    total = first[0] or 0
    if not total:
        return moved
    pace = 1 / max((first[1] or 0) / total, 1e-9)  # the trace across the targets bounds the largest eigenvalue there
    before = list(moved)
    for turn in range(STEPS):
        ahead = [m + turn / (turn + 3) * (m - b) for m, b in zip(moved, before, strict=True)]
        got = [x or 0.0 for x in soft.agg(*[F.sum(load * _bounded(ahead) * F.col("p")[k]) for k in range(n)]).first()]
        gap = max(abs(g / sum(got) - s) for g, s in zip(got, share, strict=True))
        if gap < TOLERANCE:
            return ahead
        off = sum(g * s for g, s in zip(got, share, strict=True)) / norm
        before, moved = moved, [a - pace * (g - off * s) / total for a, g, s in zip(ahead, got, share, strict=True)]
    if gap > 0.01:
        warnings.warn(f"repeating documents up to {REPEATS} times leaves a domain {gap:.3f} off its target share", stacklevel=2)
    return moved


def rated(soft: DataFrame, targets: dict[str, float], grow: bool) -> DataFrame:
    """soft with each text's rate. grow: rates are one or more and the total follows; else the total stays."""
    share = [t / sum(targets.values()) for t in targets.values()]
    if grow:
        return soft.withColumn("rate", _bounded(fit_growth(soft, share)))
    load = F.col("copies") * F.col("tokens")
    now = soft.agg(*[F.sum(load * F.col("p")[k]) for k in range(len(share))]).first()
    total = sum(x or 0.0 for x in now)
    moved = fit_steps(soft, [s * total for s in share])
    return soft.withColumn("rate", F.greatest(F.lit(0.0), F.lit(1.0) + sum((F.lit(m) * F.col("p")[k] for k, m in enumerate(moved)), F.lit(0.0))))


def document_rates(docs: DataFrame, labels: DataFrame, domain: str = DOMAIN, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, tokens, rate and a posterior column a domain for every row."""
    soft = rated(posteriors(docs, labels, domain, tuple(targets)), targets, grow=False)
    cols = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(targets)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key")).join(soft, "key").select("doc_id", "tokens", "rate", *cols)


def mixed(docs: DataFrame, labels: DataFrame, domain: str, targets: dict[str, float], seed: int = 11) -> DataFrame:
    """docs, each row as often as its rate says: the whole part, and once more if a hash of id and text falls in the fraction.

    Rates are at least one, so that every document stays and scarce domains are repeated.
    """
    soft = rated(posteriors(docs, labels, domain, tuple(targets)), targets, grow=True).select(F.col("key").alias("_key"), "rate")
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")
    joined = docs.join(soft.hint("merge"), _key() == F.col("_key"))
    return joined.withColumn("_times", times).withColumn("_nth", F.explode(F.expr("sequence(1L, cast(_times as long))"))).select(*docs.columns)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
