"""Databases, links, ids, dynamic columns and reports: literal cases and plain loops."""

import random
import threading

import pyarrow as pa

from fixturelake.functions.catalogue import odds_columns
from fixturelake.sources import feeds as E
from fixturelake.sources import html_rows as W


def test_database_history_is_read_in_ranges_with_filters(spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    jdbc = {"url": url, "dbtable": "hist", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(k, k % 5, 1.0 + k / 10, float(k)) for k in range(100, 200)]
    spark.createDataFrame(rows, "match_id long, season int, a double, b double").write.format("jdbc").options(**jdbc).save()
    df = E.read_history_jdbc(spark, jdbc, ["a"], ["match_id", "season"], partitions=4)
    assert df.columns == ["match_id", "season", "a"] and df.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, df.collect())) == [r[:3] for r in rows]
    some = df.where("season = 3 AND a > 15").select("match_id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "*EqualTo(season,3)" in plan and "*GreaterThan(a,15.0)" in plan and "b#" not in plan
    assert [r.match_id for r in some.orderBy("match_id").collect()] == [r[0] for r in rows if r[1] == 3 and r[2] > 15]
    spark.createDataFrame([], "match_id long, season int, a double").write.format("jdbc").options(**{**jdbc, "dbtable": "nothing_yet"}).save()
    assert E.read_history_jdbc(spark, {**jdbc, "dbtable": "nothing_yet"}, ["a"], ["match_id"]).collect() == []


def test_dated_report_keeps_groups_and_labels(spark, tmp_path):
    columns = E.dated_columns()
    assert len(columns) == len({c["name"] for c in columns}) == 9 + 30 + 6 + 9 + 48
    assert [c["key"] for c in columns[:4]] == ["1x2|Full Time|Home", "1x2|Full Time|Draw", "1x2|Full Time|Away", "1x2|1st Half|Home"]
    long = spark.createDataFrame([(1, "Over/Under|1st Half|U 2.5", "1.80"), (1, "Correct score|Full Time|4:4", "90"), (3, "unknown", "2")], "match_id long, odds_key string, odds string")
    matches = spark.createDataFrame([("d", k, "H", "A", "1-0", "0-0") for k in (1, 2, 3)], "date string, match_id long, home string, away string, ft string, ht string")
    E.dated_odds_report(long, matches).write.parquet(str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    rows = {r.match_id: r for r in back.collect()}
    assert set(rows) == {1, 3} and back.columns[:6] == E.DATED_FIXED
    assert rows[1].over_under_1st_half_u_2_5 == "1.80" and rows[1].correct_score_full_time_4_4 == "90" and rows[3].over_under_1st_half_u_2_5 == "-"
    assert back.schema["over_under_1st_half_u_2_5"].metadata == {"group": "Over/Under | 1st Half", "label": "U 2.5", "key": "Over/Under|1st Half|U 2.5"}
    assert len(odds_columns()) == 100


def test_columns_come_in_order_of_appearance(spark):
    rng = random.Random(3)
    names = [f"n{k}" for k in range(30)]
    rows = [(f"f{k % 3}", k, {n: str(k) for n in rng.sample(names, rng.randint(0, 4))}) for k in range(40)]
    want = []
    for _, _, record in sorted(rows, key=lambda r: r[:2]):
        want += [n for n in record if n not in want and n not in ("n1", "n2", "n3")]
    for parts in (1, 5):
        listed = spark.createDataFrame([(f, k, list(m.items())) for f, k, m in rows], "file string, row int, m array<struct<k:string,v:string>>")
        df = listed.selectExpr("file", "row", "map_from_entries(m) AS m").repartition(parts)
        got = {r.name: r.place for r in E.appearance_order(df, "m", ["file", "row"], fixed=["n1", "n2"], skip=["n3"]).collect()}
        assert got == {n: k for k, n in enumerate(["n1", "n2", *want])}
        table, others = E.dynamic_columns(df, "row", "m", ["n1", "n2"], at=["file", "row"], skip=["n3"])
        assert others == want and table.columns == ["row", "n1", "n2", *want]


def test_seasons_of_a_page(spark):
    page = """<title>x</title><div id="season_url"> 2023-2024 </div><a href="/football/x/l.g-2022-2023/">2022</a><a class=q href='/football/x/l.g-2022-2023/archive/'>twice</a>
<a href="/football/x/l.g-2023-2024/">now</a><a href="/football/x/lxg-2019-2020/">dot</a><a data-x=1 href="/football/x/l.g-2020-2021/fixtures"> </a>"""
    rows = [(1, "l.g", "/football/x/l.g/", page), (2, "l.g", "/football/x/l.g/archive/", ""), (3, "l.g", "/u/", None), (4, "a", "/a/", "<title>A 2020-2021</title>")]
    got = {}
    for r in E.season_links(spark.createDataFrame(rows, "id int, slug string, url string, html string"), "id", "html").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.pos, r.season, r.name, r.href))
    assert got[1] == [
        (0, "2023-2024", "2023/2024", "/football/x/l.g/results/"),
        (1, "2022-2023", "2022", "https://www.example.org/football/x/l.g-2022-2023/results/"),
        (2, "2020-2021", "2020/2021", "https://www.example.org/football/x/l.g-2020-2021/fixtures/results/"),
    ]
    assert got[2] == [(0, "current", "current", "/football/x/l.g/results/")] and got[3] == [(0, "current", "current", "/u/results/")]
    assert got[4] == [(0, "2020-2021", "2020/2021", "/a/results/")]


def test_ids_of_several_groups(spark):
    df = spark.createDataFrame([(1, 'x[1,7,"a",8,"b",0,"",]"m":[[2,5,"a",6,"b",0,"",1],[3,6,"a",9,"b",4,"1-0",1],[4,6,"c",5,"d",0,"",1],[5,1,"",2,"",0,"",1]]'), (2, "none"), (3, None)], "feed int, t string")
    assert [(r.id, r.pos) for r in E.unstarted_team_ids(df, "feed", "t").orderBy("pos").collect()] == [("5", 0), ("6", 1), ("1", 4), ("2", 5)]


def test_schedules_are_parsed_side_by_side(spark):
    body = '{{"ScheduleList":{{"R_1":[[{0},0,"1","",{0},{0},"1-0","0-0"]]}},"LeagueInfo":[0,"L{0}"],"TeamInfo":[[{0},"T{0}"]]}}'
    frames = [spark.createDataFrame([(k, body.format(k))], "id long, b string") for k in range(4)]
    found: dict[int, tuple] = {}

    def parse(k):
        schedule, teams = E.parse_schedule_json(frames[k], "id", "b"), E.parse_schedule_teams(frames[k], "id", "b")
        found[k] = [r.home_id for r in schedule.collect()], [r.name for r in teams.collect()]

    threads = [threading.Thread(target=parse, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == {k: ([k], [f"T{k}"]) for k in range(4)}
    assert not [t.name for t in spark.catalog.listTables() if t.isTemporary]


def test_last_value_of_a_label(spark):
    html = "<div class='product'><div>Colour</div><div>zinc</div><div>Size</div><div>3</div><div>Colour</div><div>amber</div></div>"
    (row,) = W.extract_listing(spark.createDataFrame([(1, html)], "page_id long, html string"), {}, []).collect()
    assert sorted(row.fields.values()) == ["3", "amber"]


def test_sections_of_a_page_need_no_second_parse_and_no_shuffle(spark):
    page = "<tr><td>0</td></tr>" + "".join(f"<tr class='competition'><td>{c}</td></tr><tr><td>{c}1</td></tr><tr><td>{c}2</td></tr>" for c in "ab")
    pages = spark.createDataFrame([(1, page), (1, page), (2, None)], "page_id long, html string")
    out = W.parse_fixture_html(pages)
    assert sorted((r.page_id, r.section, r.competition or "", r.date) for r in out.collect()) == sorted(2 * [(1, 0, "", "0"), (1, 1, "a", "a1"), (1, 1, "a", "a2"), (1, 2, "b", "b1"), (1, 2, "b", "b2")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_rows_of_pages_are_given_back_a_few_at_a_time():
    card = "<div class='product'><div>Colour</div><div>zinc</div></div>"
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(3_000)), "html": [card * 3] * 3_000})
    out = list(W._row_batches(W.LAYOUTS["listing"], ["page_id", "seq", "cells"], {})(iter([batch])))
    assert max(b.num_rows for b in out) <= W._ROWS and sum(b.num_rows for b in out) == 9_000
    assert pa.Table.from_batches(out).column("seq").to_pylist() == [0, 1, 2] * 3_000


def test_pages_of_plain_tags_are_read_as_the_parser_reads_them():
    bits = ["<tr>", "<tr class='competition x'>", "<tr class=row>", '<tr class="alt row">', "<td>", "</td>", "</tr>", "<TD class='A/b'>", "<table>", "</table>", "<a href='/x?a=1&amp;b=2'>", "</a>", "<br/>", "<div id='g_1_7' class='event__match'>", "<div>", "</div>"]
    odd = ["text", "a &amp; b", "&nbs", "a < b", "<!-- c -->", "<script>var a='<tr>';</script>", "<title>", "<p a=b>", "<", "</", "<x y='>'>", "<td\xa0class='q'>", "</td >", "<td/>"]
    rng = random.Random(4)
    for k in range(2_000):
        page = "".join(rng.choice(bits + odd[: 2 + 12 * (k % 2)]) for _ in range(rng.randint(0, 30)))
        for layout in ("fixture", "results", "form", "week"):
            whole = W._Rows(W.LAYOUTS[layout])
            whole.feed(page)
            whole.close()
            whole.finish()
            assert W._Rows(W.LAYOUTS[layout]).read(page) == whole.rows


def test_odds_reports_have_no_pivot_and_name_each_odds_once(spark):
    body = '{"data":{"findOddsByEventId":{"odds":[null,{"bookmakerId":16,"bettingType":"HOME_DRAW_AWAY","bettingScope":"FULL_TIME","odds":[{"eventParticipantId":"h","value":"1"},{"value":"2"},{"eventParticipantId":"a","opening":"3","value":"4"}]},{"bookmakerId":16,"bettingType":"OVER_UNDER","bettingScope":"FULL_TIME"},{"bookmakerId":16,"bettingType":"HOME_DRAW_AWAY","bettingScope":"FULL_TIME","odds":[{"eventParticipantId":"h","value":"9"}]}]}}}'
    long = E.parse_odds_json(spark.createDataFrame([(1, body), (2, None), (3, "{}")], "id long, b string"), "id", "b")
    assert sorted(map(tuple, long.collect())) == [(1, "1x2|Full Time|Away", "3"), (1, "1x2|Full Time|Draw", "2"), (1, "1x2|Full Time|Home", "9")]
    assert E.parse_odds_json(spark.createDataFrame([(1, body)], "id long, b string"), "id", "b", markets=["OVER_UNDER"]).collect() == []
    report = E.odds_report(long, ["id"], ["1x2|Full Time|Home", "x", "1x2|Full Time|Away"])
    assert list(map(tuple, report.collect())) == [(1, "9", "-", "3")]
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "pivotfirst" not in plan.lower() and plan.count("Generate explode") == 1 and "posexplode" not in plan
    twice = spark.createDataFrame([(1, "a", "5"), (1, "a", "5"), (1, "b", None)], "id long, odds_key string, odds string")
    assert list(map(tuple, E.odds_report(twice, ["id"], ["a", "b"]).collect())) == [(1, "5", "-")]


def test_a_league_has_more_files_where_it_has_more_matches(spark, tmp_path):
    from fixturelake.plans.round_trips import _league_files

    lines = spark.range(40).selectExpr("CAST(id % 2 AS INT) AS league", "id AS match_id", "concat(id, ';') AS value")
    _league_files(lines, str(tmp_path / "f"), ids=10)
    assert len(list((tmp_path / "f").rglob("part-*.txt"))) == 8
    assert sorted(int(r.code_kod) for r in E.read_odds_csv(spark, str(tmp_path / "f")).collect()) == list(range(40))
