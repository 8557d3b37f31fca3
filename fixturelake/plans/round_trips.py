"""Queries that write fixtures as the texts, files and pages that sources read, and read them back; and queries of scalar functions and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fixturelake.cluster import folder
from fixturelake.functions import catalogue as G
from fixturelake.functions import scalars as S
from fixturelake.operators import history as H
from fixturelake.operators import patterns as P
from fixturelake.operators import refine as R
from fixturelake.operators import schedule as C
from fixturelake.plans.queries import ALL_SQL, AROUND, BASE, CUR, FIRST, FIXTURES, FULL_BASE, GOLDEN, JSON_SQL, LONG, ODDS_KEYS, OUTCOME, RULES_SQL, SETS, TEAMS, _odds_long, _score_sql, query
from fixturelake.plans.views import ALL_ODDS, ODDS, fixtures, full_history, history, odds_wide, read, team_view
from fixturelake.sources import feeds as E
from fixturelake.sources import html_rows as W
from fixturelake.sources import sinks as K

FT = "CAST(ft_home AS VARCHAR) || '-' || CAST(ft_away AS VARCHAR)"
HT = "CAST(ht_home AS VARCHAR) || '-' || CAST(ht_away AS VARCHAR)"


def _dash(*cols: str) -> Column:
    return F.concat_ws("-", *cols)


def _pages(rows: DataFrame, row: Column, lead: str = "", tail: str = "") -> DataFrame:
    """page_id, html: a page for ten match ids, its rows in order of id."""
    keyed = rows.select(F.expr("match_id div 10").alias("page_id"), F.struct("match_id", row.alias("row")).alias("r"))
    listed = keyed.groupBy("page_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return listed.select("page_id", F.concat(F.lit(lead), F.array_join(F.transform("r", lambda x: x["row"]), "\n"), F.lit(tail)).alias("html"))


# -- files

#: Ids that a file of a league covers.
FILE_IDS = 250_000


def _league_files(lines: DataFrame, path: str, ids: int = FILE_IDS) -> None:
    """Text files of lines (league, match_id, value), in order of id behind two headings each, of a league and a range of ids: their number grows with the table."""
    body = lines.withColumn("part", F.expr(f"match_id div {ids}"))
    heads = body.select("league", "part").distinct().select("league", "part", F.explode(F.array(F.lit(-2).cast("long"), F.lit(-1).cast("long"))).alias("match_id"), F.lit("heading;").alias("value"))
    placed = body.unionByName(heads).repartition("league", "part").sortWithinPartitions("league", "part", "match_id")
    placed.select("league", "part", "value").write.partitionBy("league", "part").text(path)


@query("odds_csv", f"""{BASE} SELECT CAST(match_id AS VARCHAR) AS code_kod, {HT} AS ht_iy, {FT} AS ft_ms, 'Club ' || home AS home_team, 'Club ' || away AS away_team, o1 AS ft_1_a, o2 AS ft_x_a, o3 AS ft_2_a,
CASE WHEN match_id % 2 = 1 THEN 'League ' || league END AS country_league, CASE WHEN match_id % 2 = 1 THEN CAST(match_date AS VARCHAR) END AS date_time FROM hist""")
def _(spark: SparkSession, d: str) -> DataFrame:
    odds = [F.coalesce(F.translate(F.col(c).cast("string"), ".", ","), F.lit("-")) for c in ("o1", "o2", "o3")]
    short = F.concat_ws(";", "match_id", F.concat(F.lit(" "), _dash("ht_home", "ht_away")), _dash("ft_home", "ft_away"), F.concat_ws(" ", F.lit("Club"), "home"), F.concat_ws(" ", F.lit("Club"), "away"), *odds)
    line = F.when(F.col("match_id") % 2 == 0, short).otherwise(F.concat(short, F.lit(";" * 98), F.concat_ws(";", F.concat_ws(" ", F.lit("League"), "league"), "match_date")))
    body = history(spark, d).select("league", "match_id", line.alias("value"))
    path = folder(spark, "odds-csv")
    _league_files(body, path)
    return E.read_odds_csv(spark, path).select("code_kod", "ht_iy", "ft_ms", "home_team", "away_team", "ft_1_a", "ft_x_a", "ft_2_a", "country_league", "date_time")


@query("history_written", f"{BASE} SELECT league, count(*) AS n, sum(o1) AS total FROM hist WHERE coalesce(o1, 0) <> 0 OR coalesce(o2, 0) <> 0 GROUP BY league")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "history")
    rows = history(spark, d)
    for k in (0, 1):  # two appends
        K.write_history(rows.where(F.col("match_id") % 2 == k), ["o1", "o2"], path=path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("league").agg(F.count("*").alias("n"), F.sum("o1").alias("total"))


@query("id_list", f"WITH {FIXTURES} SELECT id, count(*) AS n FROM (SELECT match_id AS id FROM fixtures UNION ALL SELECT match_id + 1 FROM fixtures) GROUP BY id")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "ids")
    fixtures(spark, d).select(F.concat_ws(",", "match_id", F.concat(F.lit(" "), F.col("match_id") + 1), F.lit("x"), F.lit("")).alias("value")).write.text(path)
    return E.read_id_list(spark, path).groupBy("id").agg(F.count("*").alias("n"))


@query("relations_exported", f"{BASE} SELECT 'matches' AS relation, count(*) AS n FROM fixtures UNION ALL SELECT 'odds', count(*) FROM odds_wide UNION ALL SELECT 'both', count(*) FROM fixtures JOIN odds_wide USING (match_id) WHERE o2 IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "relations")
    K.export_relations({"matches": fixtures(spark, d).select("match_id", "league"), "odds": odds_wide(spark, d)}, path)
    matches, odds = spark.read.parquet(f"{path}/matches"), spark.read.parquet(f"{path}/odds")
    both = matches.join(odds.where("o2 IS NOT NULL"), "match_id")
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in (("matches", matches), ("odds", odds), ("both", both))])


# -- pages


@query("fixture_html", f"""WITH {FIXTURES} SELECT match_id // 10 AS page_id, CAST(CASE WHEN postponed THEN 2 ELSE 1 END AS BIGINT) AS section, CASE WHEN postponed THEN 'Cup & more' ELSE 'League ' || (match_id // 10) END AS competition,
CAST(match_date AS VARCHAR) AS date, 'Club ' || home AS home, CASE WHEN played THEN {FT} ELSE 'v' END AS ft, 'Club ' || away AS away, CASE WHEN played THEN {HT} END AS ht FROM fixtures""")
def _(spark: SparkSession, d: str) -> DataFrame:
    cells = [F.col("match_date").cast("string"), F.lit(""), F.format_string("<a href='/c/%d'>Club %d</a>", "home", "home"), F.lit(""), F.format_string("<b><a href='/m'>%s</a></b>", F.when(F.col("played"), _dash("ft_home", "ft_away")).otherwise("v")), F.lit(""), F.format_string("Club <i>%d</i>", "away"), F.lit(""), F.when(F.col("played"), _dash("ht_home", "ht_away")).otherwise("")]
    row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>"))
    one = fixtures(spark, d).select(F.expr("match_id div 10").alias("page_id"), "postponed", F.struct("match_id", row.alias("row")).alias("r"))
    listed = one.groupBy("page_id").agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("postponed") == p, F.col("r")))), lambda x: x["row"]), "\n").alias(n) for n, p in (("league", False), ("cup", True))])
    head = "<tr class='competition'><td>%s</td></tr>"
    html = F.concat(F.lit("<table><tbody>"), F.format_string(head % "League %d", "page_id"), "league", F.lit(head % "Cup &amp; more"), "cup", F.lit("</tbody></table>"))
    return W.parse_fixture_html(listed.select("page_id", html.alias("html"))).drop("seq")


@query("league_rows", f"WITH {FIXTURES} SELECT match_id // 10 AS page_id, count(*) AS n FROM fixtures WHERE NOT postponed GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures(spark, d).select(F.expr("match_id div 10").alias("page"), F.col("postponed").cast("int").alias("part"), F.col("match_id").alias("id"), F.lit(False).alias("is_header"))
    heads = rows.select("page").distinct().select("page", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"), F.lit(-1).cast("long").alias("id"), F.lit(True).alias("is_header"))
    both = rows.unionByName(heads).withColumn("seq", F.row_number().over(Window.partitionBy("page").orderBy("part", "id")))
    first = C.main_competition(C.section_ids(both, "page"), "first").where("NOT is_header")
    return first.groupBy(F.col("page").alias("page_id")).agg(F.count("*").alias("n"))


RESULT_ROWS = {
    0: "<div id='g_1_%d' class='event__match'><div class='event__time'>%s</div><div class='event__participant event__participant--home'><span class='participant__participantName x'>Club %d</span></div><div class='event__participant event__participant--away'><a>Club %d</a></div>",
    1: "<div id='g_1_%d'><span class='event__time'>%s</span><div class='wcl_HomeTeam'><div class='wcl_participantName_a'>Club %d</div></div><div class='wcl_AwayTeam'><div class='wcl_participantName_a'>Club %d</div></div>",
    2: "<div id='g_1_%d'><div class='event__time'>%s</div><p class='some_participant_1'>Club %d</p><p class='some_participant_2'>Club %d</p>",
}


@query("results_html", f"WITH {FIXTURES} SELECT match_id // 10 AS page_id, CAST(match_id AS VARCHAR) AS id, CAST(match_date AS VARCHAR) AS time, 'Club ' || home AS home, 'Club ' || away AS away, CASE WHEN played THEN ft_home END AS home_score, CASE WHEN played THEN ft_away END AS away_score FROM fixtures")
def _(spark: SparkSession, d: str) -> DataFrame:
    start = F.coalesce(*[F.when(F.col("match_id") % 3 == k, F.format_string(t, "match_id", F.col("match_date").cast("string"), "home", "away")) for k, t in RESULT_ROWS.items()])
    score = F.format_string("<div class='event__score event__score--home'>%d</div><div class='event__score event__score--away'>%s</div></div>", "ft_home", F.when(F.col("played"), F.col("ft_away").cast("string")).otherwise(""))
    pages = _pages(fixtures(spark, d), F.concat(start, score), "<div class='event__header'>League</div>", "<div id='g_1_'></div>")
    return W.parse_results_html(pages).drop("seq")


@query("form_html", f"WITH {FIXTURES} SELECT match_id // 10 AS page_id, 'League ' || league AS league, CAST(match_date AS VARCHAR) AS date, 'Club ' || home AS home, CASE WHEN played THEN replace({FT}, '-', ' - ') ELSE 'v' END AS score, 'Club ' || away AS away, played AS completed, CAST(1000000 + match_id AS VARCHAR) AS match_id FROM fixtures")
def _(spark: SparkSession, d: str) -> DataFrame:
    row = F.format_string("<tr class='alt row'><td>League %d<td>%s<td>Club %d<td><a href='/match/%d/x'>%s</a><td>Club %d", F.col("league"), F.col("match_date").cast("string"), F.col("home"), F.col("match_id") + 1_000_000, F.when(F.col("played"), F.concat_ws(" - ", "ft_home", "ft_away")).otherwise("v"), F.col("away"))
    return W.parse_form_html(_pages(fixtures(spark, d), row, "<table>", "</table>")).drop("seq")


@query("week_html", f"WITH {FIXTURES} SELECT match_id // 10 AS page_id, CAST(match_date AS VARCHAR) AS date, played AS finished, 'Club ' || home AS home, CASE WHEN played THEN {FT} ELSE 'v' END AS score, 'Club ' || away AS away, CASE WHEN played THEN {HT} ELSE '?-?' END AS ht FROM fixtures WHERE NOT postponed OR played")
def _(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("played"), F.get(F.array(F.lit("MS"), F.lit("UZ"), F.lit("Pen")), (F.col("match_id") % 3).cast("int"))).when(F.col("postponed"), "ERT").otherwise("")
    score = F.when(F.col("played"), _dash("ft_home", "ft_away")).when(F.col("postponed"), "").otherwise("v")
    row = F.format_string("<tr class='alt'><td>%s</td><td>%s</td><td>Club %d</td><td>%s</td><td>Club <table><tr class='alt'><td>%d</td></tr></table></td><td>%s</td></tr>", F.col("match_date").cast("string"), status, F.col("home"), score, F.col("away"), F.when(F.col("played"), _dash("ht_home", "ht_away")).otherwise(""))
    return W.parse_week_html(_pages(fixtures(spark, d), row, "<table>", "</table>")).drop("seq")


@query("listing_html", "SELECT p_partkey // 10 AS page_id, p_name AS name, p_brand AS brand_name, CAST(p_size AS VARCHAR) AS engine_size FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    pairs = [("Name", F.col("p_name")), ("Marka", F.col("p_brand")), ("Engine size", F.col("p_size").cast("string")), ("Views", F.lit("9"))]
    row = F.concat(F.lit("<div class='product'>"), *[F.concat(F.lit(f"<div><b>{k}</b></div><div>"), v, F.lit("</div>")) for k, v in pairs], F.lit("</div>"))
    pages = _pages(read(spark, d, "part").withColumn("match_id", F.col("p_partkey")), row)
    cards = W.extract_listing(pages, {"Marka": "brand_name"}, ["views"])
    return cards.select("page_id", *[F.col("fields")[k].alias(k) for k in ("name", "brand_name", "engine_size")])


@query("html_tables")
def _(spark: SparkSession, d: str) -> DataFrame:
    return W.extract_html_rows(read(spark, d, "pages"), "links").select("page_id", "seq", "kind", "href", "cells")


@query("html_links", """SELECT page_id, href, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return W.extract_html_rows(read(spark, d, "pages"), "links").where("kind = 'row' AND href IS NOT NULL").groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("league_links", f"""WITH {FIXTURES}, l AS (SELECT DISTINCT league, season, '/cup/' || league || '/x/' || season || '/' || (season + 1) || '/' AS href FROM fixtures) SELECT league, season AS first_season, CAST(1 AS INT) AS pos, href, season || '-' || (season + 1) AS season FROM l WHERE season % 4 <> 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    link = F.concat_ws("/", F.lit(""), F.when(F.col("season") % 4 == 0, "blocked").otherwise("cup"), "league", F.lit("x"), "season", F.col("season") + 1, F.lit(""))
    html = F.concat(F.lit('<a href="/top">t</a><a href="'), link, F.lit('">x</a><a href="'), link, F.lit('">again</a>'))
    pages = fixtures(spark, d).select("league", "season").distinct().select(F.concat_ws(":", "league", "season").alias("id"), html.alias("html"))
    key = F.split("id", ":")
    return E.extract_links(pages, "id", "html", segments=5, blocked=("blocked",)).select(key[0].cast("int").alias("league"), key[1].cast("int").alias("first_season"), "pos", "href", "season")


@query("schedule_teams", f"WITH {FIXTURES} SELECT DISTINCT league || ':' || season AS id, 'League ' || league AS league, home AS team_id, 'Club ' || home AS name FROM fixtures")
def _(spark: SparkSession, d: str) -> DataFrame:
    teams = fixtures(spark, d).select("league", "season", "home").distinct()
    team = F.format_string('[%d,"Club %d"]', "home", "home")
    listed = teams.groupBy("league", "season").agg(F.array_join(F.collect_list(team), ",").alias("ts"))
    body = F.format_string('{"LeagueInfo":[7,"League %d"],"TeamInfo":[%s],"ScheduleList":{}}', "league", "ts")
    return E.parse_schedule_teams(listed.select(F.concat_ws(":", "league", "season").alias("id"), body.alias("body")), "id", "body")


# -- scalar functions


@query("odds_text_values", f"""{BASE} SELECT match_id, CASE match_id % 4 WHEN 0 THEN coalesce(o1, 0) WHEN 1 THEN coalesce(o1, 0) ELSE 0.0 END AS odds FROM odds_wide""")
def _(spark: SparkSession, d: str) -> DataFrame:
    comma = F.translate(F.col("o1").cast("string"), ".", ",")
    text = F.when(F.col("match_id") % 4 == 0, F.concat(F.lit(" "), comma)).when(F.col("match_id") % 4 == 1, F.col("o1").cast("string")).when(F.col("match_id") % 4 == 2, "-").otherwise("none")
    return odds_wide(spark, d).select("match_id", S.parse_odds(text).alias("odds"))


@query("score_predicates", f"""WITH {FIXTURES} SELECT match_id, least(ht_home, ht_away) = least(ft_home, ft_away) AND greatest(ht_home, ht_away) = greatest(ft_home, ft_away) AS alike, CAST(ft_away AS VARCHAR) || '-' || CAST(ft_home AS VARCHAR) AS reversed, {FT} IN ('1-0', '0-1') AS accepted FROM fixtures""")
def _(spark: SparkSession, d: str) -> DataFrame:
    ft, ht = F.concat_ws(" - ", "ft_home", "ft_away"), _dash("ht_home", "ht_away")
    return fixtures(spark, d).select("match_id", S.scores_equivalent(ht, ft).alias("alike"), S.reverse_score(_dash("ft_home", "ft_away")).alias("reversed"), S.score_in(ft, "1-0", "0-1").alias("accepted"))


@query("opponents_named", f"WITH {FIXTURES}, {TEAMS} SELECT match_id, team, opponent AS exact, repeat(chr(65 + opponent), 4) AS fuzzy, repeat(chr(65 + home), 4) || '/' || repeat(chr(65 + away), 4) AS neither FROM team_view")
def _(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.repeat(F.char(F.col(c) + 65), 4)
    fuzzy = S.opponent_of(name("home"), name("away"), F.concat(name("team"), F.lit(" FC")), fuzzy=True)
    return team_view(fixtures(spark, d)).select("match_id", "team", S.opponent_of(F.col("home"), F.col("away"), F.col("team")).alias("exact"), fuzzy.alias("fuzzy"), S.opponent_of(name("home"), name("away"), F.lit("?"), fuzzy=True).alias("neither"))


@query("result_flags", f"""WITH {FIXTURES}, {TEAMS}, g AS (SELECT match_id, team, CASE WHEN team = home THEN ft_home - ft_away ELSE ft_away - ft_home END AS lead, ft_home + ft_away AS goals, ft_home > 0 AND ft_away > 0 AS scored, team = home AS home FROM team_view)
SELECT match_id, team, lead > 0 AS win, lead < 0 AS loss, lead = 0 AS draw, goals > 2 AS over, goals <= 2 AS under, scored AS both_scored, home, NOT home AS away FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("team") == F.col("home"), F.col("ft_home") - F.col("ft_away")).otherwise(F.col("ft_away") - F.col("ft_home"))
    goals = F.col("ft_home") + F.col("ft_away")
    said = [F.when(lead > 0, "G").when(lead < 0, "M").otherwise("B"), F.when((goals > 2) & (goals % 2 == 0), "2.5 Ü").when(goals > 2, "2.5 U").otherwise("2.5 A"), F.when((F.col("ft_home") > 0) & (F.col("ft_away") > 0), "KG").otherwise("-"), F.when(F.col("team") == F.col("home"), "home").otherwise("away")]
    return team_view(fixtures(spark, d)).select("match_id", "team", S.result_flags(*said).alias("f")).select("match_id", "team", "f.*")


@query("shortened_names", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '-' WHEN length(p_name) > 10 THEN substr(p_name, 1, 9) || '…' ELSE p_name END AS short FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", S.truncate(F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")), 10).alias("short"))


@query("label_keys", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'fixed' ELSE lower(replace(replace(p_type || ' of/' || p_name, ' ', '_'), '/', '_')) END AS label FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("p_type") == "PROMO", F.lit(" Promoted ")).otherwise(F.concat("p_type", F.lit(" of/"), "p_name"))
    return read(spark, d, "part").select("p_partkey", S.label_key(label, {"Promoted": "fixed"}).alias("label"))


@query("year_labels", f"WITH {FIXTURES} SELECT match_id, CASE match_id % 3 WHEN 0 THEN season || '-' || (season + 1) WHEN 1 THEN CAST(season AS VARCHAR) END AS label, monthname(match_date) AS month FROM fixtures")
def _(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("match_id") % 3 == 0, F.format_string("/cup/%d/%d/", F.col("season"), F.col("season") + 1)).when(F.col("match_id") % 3 == 1, F.format_string("cup-%d", "season")).otherwise("cup 21")
    return fixtures(spark, d).select("match_id", S.year_label(title).alias("label"), S.month_name(F.month("match_date")).alias("month"))


@query("season_labels", f"""WITH {FIXTURES}, s AS (SELECT DISTINCT league, season FROM fixtures), k AS (SELECT *, unnest([0, 1, 2]) AS k FROM s)
SELECT league, season, k, CASE league % 3 WHEN 0 THEN (season - k) || '-' || (season + 1 - k) WHEN 1 THEN (season - k) || '/' || lpad(CAST((season + 1 - k) % 100 AS VARCHAR), 2, '0') ELSE CAST(season - k AS VARCHAR) END AS label FROM k""")
def _(spark: SparkSession, d: str) -> DataFrame:
    year = F.col("season")
    label = F.when(F.col("league") % 3 == 0, F.concat_ws("-", year, year + 1)).when(F.col("league") % 3 == 1, F.concat_ws("/", year, F.lpad(((year + 1) % 100).cast("string"), 2, "0"))).otherwise(year.cast("string"))
    return fixtures(spark, d).select("league", "season").distinct().select("league", "season", F.posexplode(E.seasons_back(label, 3)).alias("k", "label"))


@query("display_names", f'{BASE} SELECT match_id, o1 AS "Home win", o2 AS "Draw" FROM hist')
def _(spark: SparkSession, d: str) -> DataFrame:
    display = {"Home win": "o1", "Draw": "o2", "Away win": "o3"}
    known, unknown = G.resolve_columns(["Home win", "None", "Draw"], display)
    assert unknown == ["None"]
    return G.rename_display(history(spark, d).select("match_id", *known), display)


COMPETITIONS = ["Trendyol Süper Lig", "Championship", "Serie A", "Liga Profesional Apertura", "TÜRKİYE KUPASI", "Copa del Rey", "DFB Pokal", "World Qualifiers", "CLUB FRIENDLIES", "Taça da Liga", "Şampiyonlar Ligi", "Community Shield", "Super Cup", "Play-off A"]


@query("main_competitions", f"WITH {FIXTURES}, n AS (SELECT match_id, [" + ", ".join(f"'{c}'" for c in COMPETITIONS) + f"][1 + match_id % {len(COMPETITIONS)}] AS competition FROM fixtures) SELECT match_id, 'exclude' AS mode FROM n WHERE competition IN ('Trendyol Süper Lig', 'Championship', 'Serie A', 'Liga Profesional Apertura', 'Play-off A') UNION ALL SELECT match_id, 'short' FROM n WHERE competition NOT IN ('TÜRKİYE KUPASI', 'Super Cup', 'Play-off A')")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in COMPETITIONS])
    rows = fixtures(spark, d).select("match_id", F.get(names, (F.col("match_id") % len(COMPETITIONS)).cast("int")).alias("competition"))
    modes = [C.main_competition(rows, mode).select("match_id", F.lit(mode).alias("mode")) for mode in ("exclude", "short")]
    return modes[0].unionByName(modes[1])


TOKENS = "list_filter(list_transform(regexp_split_to_array(trim({0}), '\\s+'), lambda y: lower(regexp_replace(y, '[^A-Za-z0-9]', '', 'g'))), lambda y: y <> '')"


@query("fuzzy_names", f"""WITH b AS (SELECT p_partkey, p_name AS a, upper(p_name) || ' - x' AS u, lead(p_name || ' ' || p_brand, 1) OVER (ORDER BY p_partkey) AS b FROM part), n AS (SELECT *, lower(regexp_replace(a, '[^A-Za-z0-9]', '', 'g')) AS na, lower(regexp_replace(b, '[^A-Za-z0-9]', '', 'g')) AS nb, {TOKENS.format('a')} AS ta, {TOKENS.format('b')} AS tb FROM b)
SELECT p_partkey, na AS folded, contains(lower(regexp_replace(u, '[^A-Za-z0-9]', '', 'g')), na) AS contained, coalesce(na = nb OR contains(na, nb) OR contains(nb, na) OR list_has_any(list_filter(ta, lambda x: length(x) >= 3), tb)
 OR len(list_filter(ta, lambda x: len(list_filter(tb, lambda y: least(length(x), length(y)) >= 4 AND (starts_with(x, y) OR starts_with(y, x)))) > 0)) > 0, FALSE) AS same FROM n""")
def _(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat_ws(" ", "p_name", "p_brand").alias("other"))
    name = F.col("p_name")
    return part.join(after, "p_partkey", "left").select("p_partkey", S.normalize_name(name).alias("folded"), S.teams_match(name, F.concat(F.upper(name), F.lit(" - x"))).alias("contained"), S.teams_match(name, F.col("other")).alias("same"))


# -- selections, refinement and reports


@query("valid_results", f"WITH {FIXTURES} SELECT league, count(*) AS n FROM fixtures WHERE played AND match_id % 5 <> 0 GROUP BY league")
def _(spark: SparkSession, d: str) -> DataFrame:
    holes = fixtures(spark, d).withColumns({"ft_home": F.when(F.col("played"), F.col("ft_home")), "ht_away": F.when(F.col("match_id") % 5 != 0, F.col("ht_away"))})
    return H.valid_results(holes).groupBy("league").agg(F.count("*").alias("n"))


@query("dynamic_columns", f"{BASE} SELECT match_id, " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in ODDS) + " FROM odds_wide WHERE " + " OR ".join(f"{c} > 0" for c in ODDS))
def _(spark: SparkSession, d: str) -> DataFrame:
    wide = odds_wide(spark, d).where(" OR ".join(f"{c} > 0" for c in ODDS))
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in ODDS]), lambda x: x["v"].isNotNull())
    return E.dynamic_columns(wide.select("match_id", F.map_from_entries(entries).alias("m")), "match_id", "m", ["o1"])[0]


@query("odds_report_wide", f"{JSON_SQL} SELECT match_id, " + ", ".join(f"""coalesce(max(CASE WHEN odds_key = '{c["key"]}' THEN odds END), '-') AS "{c["name"]}" """ if c["key"] in ODDS_KEYS.values() else f"""'-' AS "{c["name"]}" """ for c in G.odds_columns()) + " FROM j GROUP BY match_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return E.odds_report(_odds_long(spark, d), ["match_id"]).withColumnsRenamed({c["key"]: c["name"] for c in G.odds_columns()})


@query("sampled_targets", f"{BASE} SELECT 'rows' AS what, least(10, count(*)) AS n FROM hist UNION ALL SELECT 'played', least(10, count(*)) FROM hist UNION ALL SELECT 'moved', 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = history(spark, d)
    one, again = (R.sample_targets(df, 10, 7).select("match_id") for df in (rows, rows.repartition(5)))
    found = {"rows": one, "played": one.join(rows.where("played"), "match_id"), "moved": one.join(again, "match_id", "left_anti")}
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in found.items()])


@query("sampled_matches", f"{BASE} SELECT match_id, league, season FROM hist ORDER BY md5('7:' || match_id), match_id LIMIT 25")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.sample_targets(history(spark, d), 25, 7).select("match_id", "league", "season")


@query("open_columns", f"{BASE}, {ALL_SQL}, {LONG}, {RULES_SQL} SELECT target_id, col FROM long EXCEPT SELECT target_id, col FROM (SELECT match_id AS target_id, unnest([side, htft, score]) AS outcome FROM (SELECT match_id, {OUTCOME} FROM targets)) JOIN rules USING (outcome)")
def _(spark: SparkSession, d: str) -> DataFrame:
    golden = R.golden_columns(H.outcomes(history(spark, d)), spark.createDataFrame(GOLDEN, "outcome string, col string"), ODDS)
    return R.open_columns(history(spark, d), golden, ODDS)


@query("filter_batch_summary", f"SELECT max(score) AS best, avg(score) AS mean FROM ({_score_sql()})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return H.score_summary(H.score_filter_sets(SETS, history(spark, d), history(spark, d)))


SAID = "home || ' ' || ft_home || ' - ' || ft_away || ' ' || away"


@query("hit_report", f"WITH {FIXTURES}, {TEAMS}, t AS (SELECT * FROM team_view WHERE (ht_home > ht_away AND ft_home < ft_away) OR (ht_home < ht_away AND ft_home > ft_away)) SELECT league, team, season, CAST(row_number() OVER (PARTITION BY league, team ORDER BY season, match_id) AS INT) AS line, match_id, {SAID} AS found FROM t ORDER BY league, team, season, line")
def _(spark: SparkSession, d: str) -> DataFrame:
    fx = fixtures(spark, d)
    return P.hit_report(C.only_comebacks(team_view(fx)), fx)


@query("signal_list", f"""WITH {FIXTURES}, {TEAMS}, {FIRST}, {AROUND}, r AS (SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY seq DESC) AS back, {FT} AS ft FROM team_view WHERE season = {CUR} AND played),
now AS (SELECT b.* FROM b JOIN fixtures USING (match_id) WHERE season = {CUR}),
sig AS (SELECT match_id, 'CROSS1' AS pattern FROM now WHERE hp1 = an1 AND hn1 = ap1 UNION SELECT match_id, 'CROSS2' FROM now WHERE hp2 = an2 AND hn2 = ap2
UNION SELECT match_id, 'POOL_HOME' FROM now WHERE hp1 <> hp2 AND hp1 IN (an1, an2) AND hp2 IN (an1, an2) UNION SELECT match_id, 'POOL_AWAY' FROM now WHERE ap1 <> ap2 AND ap1 IN (hn1, hn2) AND ap2 IN (hn1, hn2)
UNION SELECT match_id, 'PERFECT_X' FROM now WHERE hp1 = an1 AND hn1 = ap1 AND hp2 = an2 AND hn2 = ap2
UNION SELECT f.match_id, 'NETWORK' FROM first_open f JOIN r x ON x.league = f.league AND x.back = 1 AND x.opponent = f.home JOIN r y ON y.league = f.league AND y.back = 2 AND y.team = x.team AND y.opponent = f.away WHERE f.season = {CUR} AND f.team = f.home AND x.team <> f.home AND x.team <> f.away
UNION SELECT f.match_id, CASE WHEN f.team = f.home THEN 'SEQUENCE_HOME' ELSE 'SEQUENCE_AWAY' END FROM first_open f JOIN r x ON x.league = f.league AND x.team = f.team AND x.back = 1 AND x.ft IN ('2-1', '1-2') JOIN r y ON y.league = f.league AND y.team = f.team AND y.back = 2 AND y.ft IN ('1-0', '0-1') WHERE f.season = {CUR})
SELECT match_id, pattern, CASE pattern """ + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in P.SIGNALS.items()) + " END AS said FROM sig ORDER BY match_id, pattern")
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.signal_list(team_view(fixtures(spark, d)), CUR)


# -- databases, links, ids and reports in their second forms

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "url": "jdbc:derby:memory:fixturelake;create=true", "dbtable": "history"}


@query("history_from_database", f"{BASE} SELECT league, season, count(*) AS n, sum(o1) AS total, max(t5) AS most FROM hist WHERE season >= 1997 GROUP BY league, season")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A database in this process, so in local mode only: written, and read in ranges of the id."""
    history(spark, d).select("match_id", "league", "season", *ODDS).write.format("jdbc").options(batchsize="5000", **DERBY).mode("overwrite").save()
    rows = E.read_history_jdbc(spark, DERBY, ODDS, ["match_id", "league", "season"], partitions=4)
    return rows.where("season >= 1997").groupBy("league", "season").agg(F.count("*").alias("n"), F.sum("o1").alias("total"), F.max("t5").alias("most"))


@query("dated_odds_report", f"""{JSON_SQL}, w AS (SELECT match_id, {", ".join(f"max(CASE WHEN odds_key = '{k}' THEN odds END) AS {c}" for c, k in ODDS_KEYS.items())} FROM j GROUP BY match_id)
SELECT CAST(match_date AS VARCHAR) AS date, match_id, 'Club ' || home AS home, 'Club ' || away AS away, {FT} AS ft, {HT} AS ht, """ + ", ".join((f"coalesce(w.{next(o for o, k in ODDS_KEYS.items() if k == c['key'])}, '-')" if c["key"] in ODDS_KEYS.values() else "'-'") + f' AS "{c["name"]}"' for c in E.dated_columns()) + " FROM fixtures JOIN w USING (match_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    named = fixtures(spark, d).select(F.col("match_date").cast("string").alias("date"), "match_id", *[F.concat_ws(" ", F.lit("Club"), c).alias(c) for c in ("home", "away")], _dash("ft_home", "ft_away").alias("ft"), _dash("ht_home", "ht_away").alias("ht"))
    return E.dated_odds_report(_odds_long(spark, d), named)


YEARS = "CAST(season AS VARCHAR) || '-' || CAST(season + 1 AS VARCHAR)"


@query("season_links", f"""WITH {FIXTURES}, l AS (SELECT DISTINCT league, season, {YEARS} AS years FROM fixtures), now AS (SELECT league, max(season) AS last FROM fixtures GROUP BY league)
SELECT league, 0 AS pos, last || '-' || (last + 1) AS season, last || '/' || (last + 1) AS name, '/football/land/l.' || league || '/results/' AS href FROM now
UNION ALL SELECT league, CAST(row_number() OVER (PARTITION BY league ORDER BY season DESC) AS INT), years, CASE WHEN season % 2 = 0 THEN replace(years, '-', '/') ELSE 'Season & ' || season END,
CASE season % 3 WHEN 0 THEN 'https://www.example.org/football/land/l.' || league || '-' || years || '/results/' WHEN 1 THEN 'https://www.example.org/football/land/l.' || league || '-' || years || '/results/' ELSE 'http://other.org/football/land/l.' || league || '-' || years || '/results/' END FROM l JOIN now USING (league) WHERE season < last""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A page a league: its title names the current season, and its links come twice, with and without text, archive part, slash and host."""
    years = F.concat_ws("-", "season", F.col("season") + 1)
    path = F.concat(F.lit("/football/land/l."), F.col("league"), F.lit("-"), years)
    href = F.when(F.col("season") % 3 == 0, F.concat(path, F.lit("/"))).when(F.col("season") % 3 == 1, F.concat(path, F.lit("/archive/"))).otherwise(F.concat(F.lit("http://other.org"), path, F.lit("/results")))
    said = F.when(F.col("season") % 2 == 0, " ").otherwise(F.concat(F.lit(" <b>Season</b> &amp; "), F.col("season")))
    link = F.concat(F.lit('<a class="y" href="'), href, F.lit('">'), said, F.lit("</a>\n<a href='/football/land/lx"), F.col("league"), F.lit("-1990-1991/'>other</a>"))
    listed = fixtures(spark, d).select("league", "season").distinct().groupBy("league").agg(F.max("season").alias("last"), F.reverse(F.sort_array(F.collect_list(F.struct("season", link.alias("link"))))).alias("l"))
    links = F.array_join(F.transform("l", lambda x: x["link"]), "\n")
    html = F.concat(F.lit("<html><head><title>Results "), F.concat_ws("/", "last", F.col("last") + 1), F.lit(" of the league</title></head><body>"), links, links, F.lit("</body></html>"))
    slug = F.concat(F.lit("l."), F.col("league"))
    return E.season_links(listed.select("league", slug.alias("slug"), F.concat(F.lit("/football/land/"), slug, F.lit("/archive/")).alias("url"), html.alias("html")), "league", "html").select("league", "pos", "season", "name", "href")


@query("unstarted_teams", f"""WITH {FIXTURES}, o AS (SELECT league, match_id, home, away FROM fixtures WHERE season = {CUR} AND NOT played), u AS (SELECT league, match_id * 2 AS spot, home AS id FROM o UNION ALL SELECT league, match_id * 2 + 1, away FROM o),
f AS (SELECT league, id, min(spot) AS spot FROM u GROUP BY league, id), m AS (SELECT league, match_id, row_number() OVER (PARTITION BY league ORDER BY match_id) - 1 AS nth FROM o)
SELECT league, CAST(id AS VARCHAR) AS id, CAST(nth * 2 + spot % 2 AS INT) AS pos FROM f JOIN m USING (league) WHERE spot // 2 = match_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A live feed a league: matches that have not started have status 0 and no score."""
    row = F.when(F.col("played"), F.format_string('[%d,%d,"Club %d",%d,"Club %d",4,"%d-%d",1]', "match_id", "home", "home", "away", "away", "ft_home", "ft_away")).otherwise(F.format_string('[%d,%d,"Club %d",%d,"Club %d",0,"",1]', "match_id", "home", "home", "away", "away"))
    now = fixtures(spark, d).where(F.col("season") == CUR).groupBy("league").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("match_id", row.alias("row")))), lambda x: x["row"]), ",").alias("rows"))
    feed = now.select("league", F.concat(F.lit('{"t":[[1,99,"a",98,"b",0,"",1]],"m":['), "rows", F.lit("]}")).alias("feed"))
    return E.unstarted_team_ids(feed, "league", "feed")


@query("columns_by_appearance", f"""{BASE}, e AS (SELECT match_id, unnest([{", ".join(f"CASE WHEN {c} > 0 THEN '{c}' END" for c in ODDS)}]) AS name, unnest(range({len(ODDS)})) AS k FROM odds_wide),
f AS (SELECT name, min(match_id * 100 + CASE WHEN match_id % 2 = 0 THEN k ELSE {len(ODDS)} - k END) AS first FROM e WHERE name NOT IN ('o1', 't1') GROUP BY name)
SELECT name, CAST(row_number() OVER (ORDER BY first) AS INT) AS place FROM f UNION ALL SELECT 'o1', 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Records of odd ids name their columns in falling order; one column is fixed, one is skipped."""
    entries = [F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in ODDS]
    known = F.when(F.col("match_id") % 2 == 0, F.array(*entries)).otherwise(F.array(*entries[::-1]))
    records = odds_wide(spark, d).select("match_id", F.map_from_entries(F.filter(known, lambda x: x["v"].cast("double") > 0)).alias("m"))
    return E.appearance_order(records, "m", ["match_id"], fixed=["o1"], skip=["t1"])


@query("full_odds_csv", f"{FULL_BASE} SELECT CAST(match_id AS VARCHAR) AS code_kod, {HT} AS ht_iy, {FT} AS ft_ms, 'League ' || league AS country_league, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ALL_ODDS) + " FROM hist")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All odds columns as decimal-comma text in files of a league, behind two headings each, and back."""
    odds = F.transform(F.array(*[F.col(c).cast("double") for c in ALL_ODDS]), lambda x: F.coalesce(F.translate(x.cast("string"), ".", ","), F.lit("")))
    line = F.concat_ws(";", "match_id", _dash("ht_home", "ht_away"), _dash("ft_home", "ft_away"), F.lit("H"), F.lit("A"), odds, F.concat_ws(" ", F.lit("League"), "league"), "match_date")
    body = full_history(spark, d).select("league", "match_id", line.alias("value"))
    path = folder(spark, "full-odds-csv")
    _league_files(body, path)
    return E.read_odds_csv(spark, path).select("code_kod", "ht_iy", "ft_ms", "country_league", *ALL_ODDS)
