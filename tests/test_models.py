"""Operators against plain models in Python, and parsers against literal pages and files."""

import random

from fixturelake.operators import history as H
from fixturelake.operators import refine as R
from fixturelake.operators.patterns import opponent_sequence
from fixturelake.operators.schedule import section_ids
from fixturelake.sources import feeds as E
from fixturelake.sources import html_rows as W
from fixturelake.sources.sinks import export_relations, write_history


def rows_of(n, seed=1):
    rng = random.Random(seed)
    odds = lambda: rng.choice([None, 0.0, 1.1, 1.2, 1.3])
    return [(i, f"2020-01-{1 + i % 28:02d}", rng.randint(0, 2), rng.randint(0, 2), rng.randint(0, 3), rng.randint(0, 3), odds(), odds(), odds()) for i in range(n)]


SCHEMA = "match_id long, match_date string, ht_home int, ht_away int, ft_home int, ft_away int, a double, b double, c double"


def test_similarity_is_the_nested_loop(spark):
    rows = rows_of(60)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.target_id, r.match_id, r.tolerance, r.threshold) for r in H.similar_matches(df.where("match_id < 8"), df, ["a", "b", "c"], [0.05, 0.1], [0.5, 1.0]).collect()}
    want = set()
    for t in rows[:8]:
        for h in rows:
            for tol in (0.05, 0.1):
                known = [(x, y or 0.0) for x, y in zip(t[6:], h[6:]) if x]
                if t[0] != h[0] and known:
                    ratio = sum(abs(y - x) / x <= tol for x, y in known) / len(known)
                    want |= {(t[0], h[0], tol, th) for th in (0.5, 1.0) if ratio >= th}
    assert got == want
    wide = {(r.target_id, r.match_id, r.threshold) for r in H.similar_matches(df.where("match_id < 8"), df, ["a", "b", "c"], [0.3], [0.5, 1.0]).collect()}
    assert {(a, b, d) for a, b, c, d in got if c == 0.1} <= wide


def test_cohort_caps_and_voids(spark):
    rows = rows_of(120)
    df = spark.createDataFrame(rows, SCHEMA)
    pool = {t[0]: sorted((h for h in rows if h[0] != t[0] and [x or 0.0 for x in h[6:]] == [x or 0.0 for x in t[6:]]), key=lambda h: ([-ord(x) for x in h[1]], h[0])) for t in rows}
    got = {(r.target_id, r.match_id) for r in H.cohort(df, df, ["a", "b", "c"], cap=2).collect()}
    assert got == {(t, h[0]) for t, hs in pool.items() for h in hs[:2]}
    got = {(r.target_id, r.match_id) for r in H.cohort(df, df, ["a", "b", "c"], void_above=3).collect()}
    assert got == {(t, h[0]) for t, hs in pool.items() if len(hs) <= 3 for h in hs}
    got = {(r.target_id, r.match_id) for r in H.cohort(df.repartition(7), df.repartition(3), ["a", "b", "c"], void_above=3).collect()}
    assert got == {(t, h[0]) for t, hs in pool.items() if len(hs) <= 3 for h in hs}


def test_refinement_is_the_loop(spark):
    rows = rows_of(90, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.target_id: (r.active, r.hits) for r in R.adaptive_filter(df, df, ["a"], ["b", "c"]).collect()}
    for t in rows:
        val = lambda r, k: r[k] or 0.0
        pool = [h for h in rows if h[0] != t[0] and (not val(t, 6) or val(h, 6) == val(t, 6))]
        active = 0
        for k, col in ((0, 7), (1, 8)):
            less = [h for h in pool if val(h, col) == val(t, col)]
            if not 1 <= len(pool) <= 2 and val(t, col) and less:
                pool, active = less, active | 1 << k
        assert got.get(t[0], (0, 0)) == (active, len(pool)) or not pool


def test_empty_filter_and_sample(spark):
    df = spark.createDataFrame(rows_of(30), SCHEMA)
    assert H.filter_by_odds(df, {"a": "-", "zz": 1}).count() == 0
    assert R.sample_targets(df, 10, 1).count() == 10
    one = {r.match_id for r in R.sample_targets(df, 10, 1).collect()}
    assert one == {r.match_id for r in R.sample_targets(df.repartition(5), 10, 1).collect()}


def test_mining_keeps_the_best(spark):
    df = spark.createDataFrame(rows_of(60), SCHEMA)
    best = R.mine_filter_sets(df, df, ["a", "b", "c"], max_size=1, beam=3).collect()
    alone = {r.cols: r.score for r in H.score_filter_sets([["a"], ["b"], ["c"]], df, df).collect()}
    assert {r.cols: r.score for r in best} == alone


def plain_score(rows, cols, cap=21, threshold=0.8):
    """Targets with a valid case, by looking at every pair."""
    at = {"a": 6, "b": 7, "c": 8}
    side = lambda x, y: "1" if x > y else "2" if x < y else "X"
    said = lambda r: (side(r[2], r[3]) + side(r[4], r[5]), (r[4], r[5]), side(r[4], r[5]))
    score = 0
    for t in rows:
        pool = [h for h in rows if h[0] != t[0] and all((h[at[c]] or 0.0) == (t[at[c]] or 0.0) for c in cols)]
        pool = sorted(pool, key=lambda h: ([-ord(x) for x in h[1]], h[0]))[:cap]
        score += any(sum(said(h)[k] == said(t)[k] for h in pool) / len(pool) >= threshold for k in range(3)) if pool else 0
    return score


def test_mining_is_the_plain_beam_search(spark):
    rows = rows_of(70, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.cols, r["size"], r.score) for r in R.mine_filter_sets(df, df, ["a", "b", "c"], max_size=3, beam=2, cap=4, threshold=0.5).collect()]
    want, level = [], [("a",), ("b",), ("c",)]
    for size in (1, 2, 3):
        best = sorted((-plain_score(rows, x, 4, 0.5), ",".join(x)) for x in level)[:2]
        want += [(c, size, -n) for n, c in best]
        level = sorted({tuple(sorted({*c.split(","), x})) for _, c in best for x in "abc" if x not in c})
    assert got == want and any(n for *_, n in got)


def test_refinement_of_targets_outside_history(spark):
    rows = rows_of(80, 11)
    df = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([(1000 + r[0], *r[1:]) for r in rows[:10]], SCHEMA)
    got = {r.target_id: r.hits for r in R.adaptive_filter(known, df, ["a", "b", "c"], []).collect()}
    for r in rows[:10]:
        n = sum(all(not t or (h or 0.0) == t for h, t in zip(x[6:], r[6:])) for x in rows)
        assert got.get(1000 + r[0], 0) == n


def test_similarity_meets_in_every_group(spark):
    """More columns than a group has, against all pairs, down to thresholds of a half."""
    rng = random.Random(4)
    names = [f"c{k}" for k in range(9)]
    rows = [(i, *[rng.choice([None, 0.0, 1.0, 1.1, 1.25, 1.3, 2.0]) for _ in names]) for i in range(70)]
    df = spark.createDataFrame(rows, "match_id long, " + ", ".join(f"{n} double" for n in names))
    for low in (0.5, 0.75, 0.8, 1.0):
        got = {(r.target_id, r.match_id, r.tolerance): round(r.ratio, 9) for r in H.similar_matches(df, df, names, [0.05, 0.3], [low]).collect()}
        want = {}
        for t in rows:
            known = [k for k in range(1, 10) if t[k]]
            for h in rows:
                for tol in (0.05, 0.3):
                    near = sum(abs((h[k] or 0.0) - t[k]) / t[k] <= tol for k in known)
                    if h[0] != t[0] and known and near / len(known) >= low:
                        want[t[0], h[0], tol] = round(near / len(known), 9)
        assert got == want


def test_files_lose_their_headings(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}.csv").write_text("".join(f"{x}\n" for x in ("h1", "h2", *[f"{k}-{i}" for i in range(k)], "")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8")
    try:
        got = sorted(r.value for r in E.without_headings(spark.read.text(str(tmp_path))).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(f"{k}-{i}" for k in range(5) for i in range(k))


def test_nested_rows_belong_to_their_cell(spark):
    html = '<table><tr class="alt"><td>d<td>MS<td>A <table><tr class="alt"><td>inner</td></tr></table></td><td>1-0<td>B<td></tr><tr class="alt"><td>e</td></tr></table>'
    rows = W.extract_html_rows(spark.createDataFrame([(1, html)], "page_id long, html string"), "week").orderBy("seq").collect()
    assert [r.cells for r in rows] == [["d", "MS", "A inner", "1-0", "B", ""], ["e"]]


def test_fuzzy_sequence(spark):
    cols = "league int, team string, season int, seq int, match_id long, home string, away string, opponent string, played boolean, ht_home int, ht_away int, ft_home int, ft_away int"
    past = [(1, "T", 2000, k, k, "T", o, o, True, 1, 0, 0, 1) for k, o in enumerate(["Polonia W", "Goal", "Atletico"], 1)]
    now = [(1, "T", 2001, k, 10 + k, "T", o, o, k == 1, 0, 0, 0, 0) for k, o in enumerate(["P. Polonia", "Other", "Atl."], 1)]
    hits = opponent_sequence(spark.createDataFrame(past + now, cols), 2001, fuzzy=True).collect()
    assert {(r.match_id, r.combo) for r in hits} == {(2, "PREV1+NEXT1")}


PAGE = """<table><tbody><tr class="competition"><td><a>First League</a></td></tr><tr><td>1.9.25</td><td></td><td>A</td><td></td><td><b><a href="/m/1234567">2-1</a></b></td><td></td><td>B</td><td></td><td>0-1</td></tr>
<tr class="competition"><td>Cup</td></tr><tr><td>2.9.25</td><td></td><td>C</td><td></td><td>v</td><td></td><td>D</td><td></td><td></td></tr></tbody></table>"""


def test_html_layouts(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>none")], "page_id long, html string")
    got = [(r.page_id, r.section, r.competition, r.home, r.ft, r.away, r.ht) for r in W.parse_fixture_html(pages).orderBy("seq").collect()]
    assert got == [(1, 1, "First League", "A", "2-1", "B", "0-1"), (1, 2, "Cup", "C", "v", "D", None)]
    form = spark.createDataFrame([(1, '<tr class="row"><td>L</td><td>d</td><td>A</td><td><a href="/1234567/">2 - 1</a></td><td>B</td></tr>')], "page_id long, html string")
    assert [(r.completed, r.match_id) for r in W.parse_form_html(form).collect()] == [(True, "1234567")]
    week = spark.createDataFrame([(1, '<tr class="alt"><td>d</td><td>MS</td><td>A</td><td>1-0</td><td>B</td><td></td></tr><tr class="alt"><td>d</td><td>ERT</td><td>A</td><td>1-0</td><td>B</td></tr>')], "page_id long, html string")
    assert [(r.finished, r.ht) for r in W.parse_week_html(week).collect()] == [(True, "?-?")]
    row = '<div id="g_1_{0}"><div class="event__time">t</div>{1}<div class="event__score--home">1</div><div class="event__score--away">{2}</div></div>'
    named = '<div class="event__participant--home">A <b>x</b></div><div class="event__participant--away"><a>B</a></div>'
    results = spark.createDataFrame([(1, row.format("k1", named, "") + row.format("k2", "<p class=participantX>C</p><p class=participantY>D</p>", "2") + row.format("", named, "1"))], "page_id long, html string")
    assert [(r.id, r.time, r.home, r.away, r.home_score, r.away_score) for r in W.parse_results_html(results).orderBy("seq").collect()] == [("k1", "t", "A x", "B", None, None), ("k2", "t", "C", "D", 1, 2)]
    cards = spark.createDataFrame([(1, '<div class="product"><div>Year</div><div>2020</div><div>Views</div><div>9</div></div>')], "page_id long, html string")
    assert [r.fields for r in W.extract_listing(cards, {"Year": "year"}, ["views"]).collect()] == [{"year": "2020"}]


def test_sections_number_headers(spark):
    df = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True)], "page int, seq int, is_header boolean")
    assert [r.section for r in section_ids(df, "page").orderBy("seq").collect()] == [1, 1, 2]


def test_csv_and_lists(spark, tmp_path):
    (tmp_path / "odds.csv").write_text("head;\nhead;\n" + "k; 1-0 ;2-1;A;B;1,85;x;" + "\n\n" + "k2;;;C;D\n")
    got = E.read_odds_csv(spark, str(tmp_path / "odds.csv")).orderBy("code_kod").collect()
    assert [(r.ht_iy, r.ft_1_a, r.ft_x_a, r.date_time) for r in got] == [("1-0", 1.85, None, None), (None, None, None, None)]
    (tmp_path / "ids.txt").write_text("1, 2,x\n\n3,")
    assert sorted(r.id for r in E.read_id_list(spark, str(tmp_path / "ids.txt")).collect()) == [1, 2, 3]


def test_bad_feeds_are_null(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "AC÷2nd Half¬IG÷x¬IH÷1"), (4, "{")], "id long, f string")
    assert [(r.ht, r.ft) for r in E.parse_half_scores(df, "f").orderBy("id").collect()] == [(None, None), (None, None), (None, "x-1"), (None, None)]
    assert E.parse_match_feed(df, "f").count() == 0
    assert [r.odd_home for r in E.parse_1x2_feed(df, "f", "own").collect()] == [None] * 4
    assert E.parse_odds_json(df, "id", "f").count() == 0
    assert E.parse_schedule_json(df, "id", "f").count() == 0


def test_nested_schedule(spark):
    body = '{"ScheduleList":{"G":{"R_2":[[9,0,"4","",1,2,"1-0","0-0"]]},"R_1":[[8,0,"1","",3,4,"bad",""]]}}'
    got = E.parse_schedule_json(spark.createDataFrame([(1, body)], "id long, b string"), "id", "b").orderBy("round").collect()
    assert [(r["round"], r.home_id, r.ft, r.postponed) for r in got] == [(1, 3, None, False), (2, 1, "1-0", True)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(rows_of(20), SCHEMA)
    write_history(df, ["a", "b"], path=str(tmp_path / "h"))
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    jdbc = {"url": url, "dbtable": "hist", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    write_history(df.select("match_id", "a", "b"), ["a", "b"], jdbc=jdbc)
    n = df.where("coalesce(a, 0) <> 0 OR coalesce(b, 0) <> 0").count()
    assert spark.read.parquet(str(tmp_path / "h")).count() == n == spark.read.format("jdbc").options(**jdbc).load().count()
    export_relations({"m": df.select("match_id")}, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x/m")).count() == 20


def test_entry_has_stable_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
