"""Searches over many targets against plain loops: mining by branch and bound, refinement, names that match, similarity over many columns."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fixturelake.operators import history as H
from fixturelake.operators import patterns as P
from fixturelake.operators import refine as R

CASES = "match_id long, match_date string, ht_home int, ht_away int, ft_home int, ft_away int"


def rows_of(n, names, values, seed):
    rng = random.Random(seed)
    return [(i, f"2020-01-{rng.randint(1, 28):02d}", *[rng.randint(0, 2) for _ in range(4)], *[rng.choice(values) for _ in names]) for i in range(n)]


def frame(spark, rows, names):
    return spark.createDataFrame(rows, CASES + "".join(f", {c} double" for c in names))


def said(r):
    side = lambda x, y: "1" if x > y else "2" if x < y else "X"
    return side(r[2], r[3]) + side(r[4], r[5]), (r[4], r[5]), side(r[4], r[5])


def plain_score(targets, rows, at, cap, threshold):
    score = 0
    for t in targets:
        pool = [h for h in rows if h[0] != t[0] and all((h[k] or 0.0) == (t[k] or 0.0) for k in at)]
        pool = sorted(pool, key=lambda h: ([-ord(x) for x in h[1]], h[0]))[:cap]
        score += any(sum(said(h)[k] == said(t)[k] for h in pool) / len(pool) >= threshold for k in range(3)) if pool else 0
    return score


@pytest.mark.parametrize(("top", "batch"), [(6, 40), (1, 7)])
def test_branch_and_bound_is_the_exhaustive_search(spark, top, batch):
    names = [f"c{k:02d}" for k in range(12)]
    rows = rows_of(40, names, [None, 0.0, 1.5, 2.0], 3)
    targets = rows[::4]
    got = R.best_filter_sets(frame(spark, targets, names), frame(spark, rows, names), names, max_size=5, top=top, cap=5, threshold=0.7, batch=batch).collect()
    every = [s for n in range(1, 6) for s in itertools.combinations(range(12), n)]
    want = sorted((-plain_score(targets, rows, [6 + k for k in s], 5, 0.7), len(s), ",".join(names[k] for k in s)) for s in every)[:top]
    assert [(-r.score, r["size"], r.cols) for r in got] == want and want[0][0] < 0


def test_reach_bounds_every_larger_set(spark):
    names = ["a", "b", "c", "d"]
    rows = rows_of(60, names, [1.0, 2.0, None], 5)
    df = frame(spark, rows, names)
    sets = [list(s) for n in (1, 2, 3) for s in itertools.combinations(names, n)]
    reach = {tuple(sets[r.filter_id]): r.reach for r in H.filter_reach(sets, df, df).collect()}
    score = {tuple(r.cols.split(",")): r.score for r in H.score_filter_sets(sets, df, df, threshold=0.5).collect()}
    few = {tuple(r.cols.split(",")): r.score for r in H.score_filter_sets(sets, df.where("match_id < 9"), df, threshold=0.5, few=True).collect()}
    some = {tuple(r.cols.split(",")): r.score for r in H.score_filter_sets(sets, df.where("match_id < 9"), df, threshold=0.5).collect()}
    assert few == some
    for small in score:
        for large in score:
            if set(small) <= set(large):
                assert score[large] <= reach.get(small, 0)


def test_refinement_skips_active_columns(spark):
    names = list("abcdefg")
    rows = rows_of(150, names, [None, 0.0, 1.0, 2.0, 3.0], 8)
    defaults, extras = ["a", "b", "c"], ["d", "b", "e", "f", "g"]
    at = {c: 6 + k for k, c in enumerate(names)}
    known = lambda r, c: r[at[c]] or 0.0
    got = {r.target_id: (r.active, r.hits) for r in R.adaptive_filter(frame(spark, rows, names), frame(spark, rows, names), defaults, extras).collect()}
    want = {}
    for t in rows:
        pool = [h for h in rows if h[0] != t[0] and all(not known(t, c) or known(h, c) == known(t, c) for c in defaults)]
        active = 0
        if not pool:
            continue
        for k, c in enumerate(extras):
            less = [h for h in pool if known(h, c) == known(t, c)]
            if not 1 <= len(pool) <= 2 and c not in defaults and known(t, c) and less:
                pool, active = less, active | 1 << k
        want[t[0]] = (active, len(pool))
    assert got == want and len({a for a, _ in want.values()}) > 5


def test_names_meet_as_all_pairs_do(spark):
    rng = random.Random(6)
    parts = ["Atl.", "Atletico", "P.", "Polonia", "Warszawa", "U19", "FC", "Üye", "Slo", "Slovan", "S.Bratislava", "Bratislava", "x", "İst", "United", "Unit"]
    names = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["", " ", None, "..", "U19"]
    left = spark.createDataFrame([(k % 2, n) for k, n in enumerate(names)], "league int, name string")
    right = spark.createDataFrame([(k % 2, n) for k, n in enumerate(reversed(names))], "league int, name string")
    got = {tuple(r) for r in P.matching_names(left, right, ["league"]).collect()}
    both = left.withColumnRenamed("name", "a").join(right.withColumnRenamed("name", "b"), "league").distinct()
    want = {tuple(r) for r in both.where(P.teams_match(both.a, both.b)).select("league", "a", "b").collect()}
    assert got == want and len(want) > 100


def test_cross_report_is_nested(spark):
    hits = spark.createDataFrame([(1, 4, 1999, 10, 11, 7, 90, "home"), (1, 4, 1998, 10, 11, 7, 80, "away"), (1, 4, 1998, 10, 11, 8, 81, "home"), (1, 4, 1999, 10, 12, 7, 90, "home")], "league int, round int, season int, target_id long, other_id long, team int, match_id long, place string")
    past = spark.createDataFrame([(90, 1, 0, 2, 1), (80, 0, 0, 0, 3), (81, 1, 1, 1, 1)], "match_id long, ht_home int, ht_away int, ft_home int, ft_away int")
    (row,) = P.cross_fixture_report(hits, past).collect()
    assert (row.league, row.target_id, row.signals) == (1, 10, 4)
    assert [(o.other_id, [(c.team, [tuple(m) for m in c.matches]) for c in o.clubs]) for o in row.others] == [
        (11, [(7, [(1998, 4, 80, "0-0", "0-3", "away"), (1999, 4, 90, "1-0", "2-1", "home")]), (8, [(1998, 4, 81, "1-1", "1-1", "home")])]),
        (12, [(7, [(1999, 4, 90, "1-0", "2-1", "home")])]),
    ]


@pytest.mark.parametrize(("tolerances", "low"), [([0.0, 0.01], 0.95), ([0.02, 0.2], 0.8), ([0.0], 1.0)])
def test_similarity_over_many_columns_is_the_nested_loop(spark, tolerances, low):
    rng = random.Random(9)
    names = [f"k{k}" for k in range(40)]
    base = [[rng.choice([0.0, None, 1.5, 2.0, 2.01, 3.0]) for _ in names] for _ in range(6)]
    rows = []
    for i in range(90):
        v = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            v[rng.randrange(40)] = rng.choice([None, 1.5, 2.0, 2.02, 3.3])
        rows.append((i, "d", 0, 0, 0, 0, *v))
    df = frame(spark, rows, names)
    got = {(r.target_id, r.match_id): (r.known, *[r[f"near{k}"] for k in range(len(tolerances))]) for r in H.near_pairs(df.where("match_id % 3 = 0"), df, names, tolerances, low).collect()}
    want = {}
    for t in rows[::3]:
        known = [k for k in range(6, 46) if t[k]]
        for h in rows:
            near = [sum(abs((h[k] or 0.0) - t[k]) / t[k] <= tol for k in known) for tol in tolerances]
            if h[0] != t[0] and known and near[-1] >= low * len(known) - 1e-9:
                want[t[0], h[0]] = (len(known), *near)
    assert got == want and len(want) > 30


def test_copies_add_no_pairs_of_kinds(spark):
    rng = random.Random(4)
    names = [f"k{k}" for k in range(7)]
    base = [[rng.choice([0.0, None, 1.5, 2.0, 2.1]) for _ in names] for _ in range(25)]
    rows = [(i, "d", 0, 0, i % 3, 0, *base[i % 25]) for i in range(100)]
    few, df = frame(spark, rows[:25], names), frame(spark, rows, names)
    grid = (names, [0.02, 0.1], [1.0, 0.8])
    assert H.near_kinds(df, df, names, [0.02, 0.1], 0.8).pairs.count() == H.near_kinds(few, few, names, [0.02, 0.1], 0.8).pairs.count() > 25
    targets = df.where("match_id % 4 = 0")
    similar = H.similar_matches(targets, df, *grid)
    rows_of = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows_of(H.similar_top(targets, df, *grid, 3)) == rows_of(H.top_similar(similar, 3).select("target_id", "match_id", "tolerance", "threshold", "ratio", "rank"))
    counted = similar.join(df.select("match_id", "ft_home"), "match_id").groupBy("target_id", "tolerance", "threshold", "ft_home").count()
    assert rows_of(H.similar_counts(targets, df, *grid, "ft_home")) == rows_of(counted)
    best = H.best_combination(H.similarity_grid(similar), grid[1]).join(H.top_similar(similar, 3), ["target_id", "tolerance", "threshold"])
    assert rows_of(H.similarity_report(targets, df, *grid, 3)) == rows_of(best)


def test_a_step_of_refinement_counts_values_once(spark, monkeypatch):
    names = list("abc")
    rows = rows_of(20, names, [None, 1.0, 2.0], 2)
    copies = [(100 * k + r[0], *r[1:]) for k in range(5) for r in rows]
    written = {}
    write = R.Tables.write

    def noted(self, df, name):
        out = write(self, df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(R.Tables, "write", noted)
    df = frame(spark, copies, names)
    got = {r.target_id: r.hits for r in R.adaptive_filter(df, df, [], names).collect()}
    assert len(got) == 100 and all(got[100 * k + i] == got[i] for k in range(5) for i in range(20))
    assert written["refined"] <= 20 and written["refined-kinds"] <= 20


@pytest.mark.parametrize("cap", [1, 3, 200])
def test_a_cohort_is_cut_without_a_second_ranking(spark, cap):
    names = ["a", "b"]
    rows = rows_of(120, names, [None, 1.0, 2.0], 7)
    df = frame(spark, rows, names)
    targets = df.where("match_id % 3 <> 1").unionByName(df.where("match_id < 5").withColumn("match_id", df.match_id + 1000))
    flags = H.cohort_flags(H.cohort(targets, df, names, cap, labels=True))
    assert sorted(map(tuple, flags.select("target_id", "match_id", "same_htft").collect())) == sorted(map(tuple, H.cohort_flags(H.cohort(targets, df, names, cap), targets).select("target_id", "match_id", "same_htft").collect()))
    want = []
    for t in targets.collect():
        pool = [h for h in rows if h[0] != t[0] and all((h[k] or 0.0) == (t[k] or 0.0) for k in (6, 7))]
        want += [(t[0], h[0]) for h in sorted(pool, key=lambda h: ([-ord(x) for x in h[1]], h[0]))[:cap]]
    assert sorted((r.target_id, r.match_id) for r in flags.collect()) == sorted(want)
    plan = flags._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(target_id" not in plan
    assert H.score_filter_sets([names], targets, df, cap, 0.5).first().score == plain_score([tuple(t) for t in targets.collect()], rows, (6, 7), cap, 0.5)


def test_cross_lines_are_the_report_laid_flat(spark):
    rng = random.Random(3)
    match = lambda i, season: (i, i % 2, season, 1 + rng.randrange(2), rng.randrange(4), 4 + rng.randrange(3), 0, rng.randrange(2), rng.randrange(3), rng.randrange(3))
    names = "match_id long, league int, season int, round int, home int, away int, ht_home int, ht_away int, ft_home int, ft_away int"
    current, past = spark.createDataFrame([match(i, 9) for i in range(30)], names), spark.createDataFrame([match(100 + i, i % 4) for i in range(80)], names)
    hits = P.cross_fixture(current, past)
    report = P.cross_fixture_report(hits, past).selectExpr("league", "target_id", "signals", "inline(others)").selectExpr("league", "target_id", "signals", "other_id", "inline(clubs)")
    flat = report.selectExpr("league", "target_id", "signals", "other_id", "team", "posexplode(matches) as (pos, m)").select("league", "target_id", "signals", "other_id", "team", "pos", "m.season", "m.round", "m.match_id", "m.ht", "m.ft", "m.place")
    got = P.cross_fixture_lines(current, past).select(*flat.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, flat.collect())) and got.count() > 200


def test_pairs_in_blocks_are_neither_written_nor_dealt_out(spark, monkeypatch):
    rng = random.Random(12)
    names = [f"k{k}" for k in range(7)]
    base = [[rng.choice([0.0, None, 1.5, 2.0, 2.1]) for _ in names] for _ in range(40)]
    rows = [(i, "d", 0, 0, i % 3, 0, *base[i % 40]) for i in range(200)]
    tolerances, thresholds = [0.02, 0.1], [1.0, 0.8]
    want = []
    for t in rows[::4]:
        known = [k for k in range(6, 13) if t[k]]
        for h in rows:
            for tol in tolerances:
                ratio = sum(abs((h[k] or 0.0) - t[k]) / t[k] <= tol for k in known) / len(known) if known and h[0] != t[0] else 0.0
                want += [(t[0], h[0], tol, th, ratio) for th in thresholds if ratio >= th]
    written, write = {}, H.Tables.write

    def noted(self, df, name):
        out = write(self, df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(H.Tables, "write", noted)
    monkeypatch.setattr(H, "BLOCK_TOKENS", 20)
    monkeypatch.setattr(H, "LISTED", 2)
    monkeypatch.setattr(H, "FEW_ROWS", 30)
    df = frame(spark, rows, names)
    targets, rows_of = df.where("match_id % 4 = 0"), lambda x: sorted(tuple(r) for r in x.collect())
    grid = (names, tolerances, thresholds)
    near = H.near_kinds(targets, df, names, tolerances, 0.8)
    assert len(near.blocks) > 2 and near.pairs.count() == near.pairs.select("target", "kind").distinct().count()
    similar = H.similar_matches(targets, df, *grid)
    # lists of each block's tokens are dealt out by target once, pairs never
    assert "hashpartitioning(match_id" not in (plan := similar._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan and "Window" not in plan
    assert rows_of(similar) == sorted(want) and len(want) > 1_000
    assert max(n for name, n in written.items() if name not in ("similar-index", "similar-wanted")) <= 200 and "similar" not in written
    whole = spark.createDataFrame(want, similar.schema)
    assert rows_of(H.similar_top(targets, df, *grid, 3)) == rows_of(H.top_similar(whole, 3).select("target_id", "match_id", "tolerance", "threshold", "ratio", "rank"))
    counted = whole.join(df.select("match_id", "ft_home"), "match_id").groupBy("target_id", "tolerance", "threshold", "ft_home").count()
    assert rows_of(H.similar_counts(targets, df, *grid, "ft_home")) == rows_of(counted)
    best = H.best_combination(H.similarity_grid(whole), tolerances).join(H.top_similar(whole, 3), ["target_id", "tolerance", "threshold"])
    assert rows_of(H.similarity_report(targets, df, *grid, 3)) == rows_of(best)


def test_few_weeks_that_become_many_rows_go_to_every_task(spark):
    match = lambda i, season: (i, 1, season, 1, i % 10, (i + 1 + i // 10 % 5) % 10, 0, 0, i % 3, 1)
    names = "match_id long, league int, season int, round int, home int, away int, ht_home int, ht_away int, ft_home int, ft_away int"
    current, past = spark.createDataFrame([match(i, 9) for i in range(60)], names), spark.createDataFrame([match(100 + i, i % 4) for i in range(200)], names)
    for rows in (P.cross_fixture(current, past), P.cross_fixture_lines(current, past)):
        tasks = [r.n for r in rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
        assert len(tasks) >= 8 and max(tasks) < sum(tasks) / 3
