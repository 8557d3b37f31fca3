"""Quality rules by weak supervision, in DataFrame and SQL functions only.

A base filter rejects texts of under MIN_WORDS words and texts more than half of whose words lie in repeated 3-word
windows. On the rest, rules vote *good* (1), *bad* (-1) or abstain (0). Equal vote patterns are counted, at most
3 ** len(RULES) of them whatever the size of the corpus; expectation-maximisation over the counted patterns estimates
the share of good texts and how each rule votes on good and on bad ones, and a text is kept if its posterior
probability of being good is at least KEEP_AT.

Null and empty texts have no words and fail the base filter; null ids are kept. A text whose posterior is just KEEP_AT is kept.
Very long texts are read whole, each in its row, up to 2 ** 30 words. Repeated rows give repeated results; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

MIN_WORDS = 50
REPEAT_PERCENT = 50
KEEP_AT = 0.5
ROUNDS = 60
#: Pseudo-counts of each vote under each class, so that no vote is impossible.
SMOOTHING = 1.0

_POS = 30  # bits of a packed value that hold the position

RULES = {
    "symbols": "CASE WHEN n_symbols > 0.2 * n_words THEN -1 WHEN n_symbols <= 0.05 * n_words THEN 1 ELSE 0 END",
    "word_length": "CASE WHEN word_chars < 3 * n_words OR word_chars > 9 * n_words THEN -1 WHEN word_chars <= 6.5 * n_words AND word_chars >= 4 * n_words THEN 1 ELSE 0 END",
    "plain_words": "CASE WHEN n_plain_words < 0.6 * n_words THEN -1 WHEN n_plain_words >= 0.8 * n_words THEN 1 ELSE 0 END",
    "repeats": "CASE WHEN n_repeat_words > 0.3 * n_words THEN -1 ELSE 0 END",
    "lines": "CASE WHEN n_dup_lines > 0.3 * n_lines THEN -1 ELSE 0 END",
    "line_ends": "CASE WHEN n_ended_lines < 0.5 * n_lines THEN -1 WHEN n_ended_lines >= 0.95 * n_lines THEN 1 ELSE 0 END",
}


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that base filter and rules read; one pass over the texts, no shuffle.

    Repeated 3-word windows are found by sorting, in each text, 34 hash bits and the position packed in a long;
    windows whose bits agree with a neighbour's are then compared word by word.
    """
    low = (1 << _POS) - 1
    same = f"shiftright(s[k], {_POS}) = shiftright(s[k {{0}}], {_POS})"
    tri = "e[k].a = e[k {0}].a AND e[k].b = e[k {0}].b AND e[k].c = e[k {0}].c"
    steps = [
        {"text": "coalesce(text, '')"},
        {
            "w": r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x != '')",
            "lines": r"filter(split(text, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')",
            "n_symbols": "cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '')) as long)",
        },
        {"n": "size(w)"},
        {"s": f"if(n < 3, cast(array() as array<long>), sort_array(transform(sequence(0, greatest(n - 3, 0)), i -> (shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), {_POS}) | cast(i as long)))))"},
        {
            "near": f"filter(transform(s, (x, k) -> if((k > 0 AND {same.format('- 1')}) OR (k < size(s) - 1 AND {same.format('+ 1')}), cast(x & {low} as int), -1)), i -> i >= 0)",
        },
        {"e": "sort_array(transform(near, i -> struct(w[i] as a, w[i + 1] as b, w[i + 2] as c, i as at)))"},
        {"p": f"sort_array(filter(transform(e, (x, k) -> if((k > 0 AND {tri.format('- 1')}) OR (k < size(e) - 1 AND {tri.format('+ 1')}), x.at, -1)), i -> i >= 0))"},
    ]
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for step in steps:
        df = df.select("*", *[F.expr(e).alias(c) for c, e in step.items() if c != "text"]) if "text" not in step else df.select("doc_id", F.expr(step["text"]).alias("text"))
    return df.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.expr("cast(length(array_join(w, '')) as long)").alias("word_chars"),
        "n_symbols",
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr("aggregate(transform(p, (x, k) -> if(k = size(p) - 1, 3, least(3, p[k + 1] - x))), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.expr("cast(size(lines) as long)").alias("n_lines"),
        F.expr(r"cast(size(filter(lines, x -> x rlike '[.!?:;\"”»)]\\s*$')) as long)").alias("n_ended_lines"),
        F.expr(r"cast(size(filter(w, x -> x rlike '^[^#*$%&|<>{}=_0-9]*\\p{L}[^#*$%&|<>{}=_]*$')) as long)").alias("n_plain_words"),
    )


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior probability of *good* for each counted vote pattern, by expectation-maximisation from the majority vote."""
    post = {v: min(0.95, max(0.05, 0.5 + 0.45 * sum(v) / max(1, sum(map(abs, v))))) for v, _ in patterns}
    for _ in range(rounds):
        good = sum(n * post[v] for v, n in patterns)
        total = sum(n for _, n in patterns)
        prior = (good + SMOOTHING) / (total + 2 * SMOOTHING)
        logs = []
        for j in range(n_rules):
            tally = {(c, x): SMOOTHING for c in (0, 1) for x in (-1, 0, 1)}
            for v, n in patterns:
                tally[1, v[j]] += n * post[v]
                tally[0, v[j]] += n * (1 - post[v])
            # a rule is taken to be right more often than wrong: on good texts its good votes are not rarer than on bad ones
            sums = {c: sum(tally[c, x] for x in (-1, 0, 1)) for c in (0, 1)}
            logs.append({x: math.log(tally[1, x] / sums[1]) - math.log(tally[0, x] / sums[0]) for x in (-1, 0, 1)})
        lift = {j: (max(0.0, logs[j][1]), min(0.0, logs[j][-1])) for j in range(n_rules)}
        post = {
            v: 1 / (1 + math.exp(-min(50.0, max(-50.0, math.log(prior / (1 - prior)) + sum(lift[j][0] if x > 0 else lift[j][1] if x < 0 else 0.0 for j, x in enumerate(v))))))
            for v, _ in patterns
        }
    return post


def quality_verdicts(docs: DataFrame, rules: dict[str, str] = RULES, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, base statistics, base_failed, kept and the posterior of every row."""
    stats = text_statistics(docs).withColumn(
        "base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")
    )
    votes = materialise(stats.select("*", *[F.expr(sql).cast("int").alias(f"vote_{k}") for k, sql in rules.items()]), "votes")
    cols = [f"vote_{k}" for k in rules]
    # at most 3 ** len(rules) rows
    counted = [(tuple(r[c] for c in cols), r["n"]) for r in votes.where("NOT base_failed").groupBy(*cols).agg(F.count("*").alias("n")).collect()]
    post = estimate(sorted(counted), len(cols))
    key = F.concat_ws(",", *cols)
    lookup = F.create_map(*[F.lit(x) for v, p in sorted(post.items()) for x in (",".join(map(str, v)), p)]) if post else F.create_map().cast("map<string,double>")
    return votes.withColumn("posterior", F.when(F.col("base_failed"), F.lit(0.0)).otherwise(F.coalesce(F.try_element_at(lookup, key), F.lit(0.0)))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at)
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the base filter alone, which SQL can express."""
    return text_statistics(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


QUALITY_BASE_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
tri AS (SELECT r, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT * FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN hit USING (r)"""
