"""Parsing of landed text: odds JSON, score feeds, schedules, odds CSV, link and id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fixturelake.cluster import FEW_ROWS
from fixturelake.functions.catalogue import PERIODS, odds_columns
from fixturelake.functions.scalars import clean_text, participant_key, scope_label, trim, year_label

HISTORY_TEXT = ["code_kod", "ht_iy", "ft_ms", "home_team", "away_team"]
ODDS_JSON = """struct<data:struct<findOddsByEventId:struct<odds:array<struct<bookmakerId:int,bettingType:string,bettingScope:string,
    odds:array<struct<eventParticipantId:string,opening:string,value:string,bothTeamsToScore:boolean,handicap:struct<value:double>,selection:string,score:string,winner:string>>>>>>>""".replace("\n", "")


def read_odds_csv(spark: SparkSession, path: str) -> DataFrame:
    """The odds history of ``;`` files: two heading lines each, decimal commas, short rows padded with null."""
    names = [*HISTORY_TEXT, *[c["name"] for c in odds_columns()], "country_league", "date_time"]
    lines = without_headings(spark.read.text(path))
    # numbers are read in a loop over the cells: an expression a column makes methods that are too long for the JVM to compile
    cells = lines.select(F.transform(F.split("value", ";"), lambda x: F.nullif(trim(x), F.lit(""))).alias("c"))
    parsed = cells.select("c", F.transform("c", lambda x: F.translate(x, ",", ".").try_cast("double")).alias("n"))
    texts = {*HISTORY_TEXT, *names[-2:]}
    return parsed.select(*[F.get("c" if n in texts else "n", F.lit(k)).alias(n) for k, n in enumerate(names)])


def without_headings(lines: DataFrame, n: int = 2) -> DataFrame:
    """The lines of text files but the first n of each file and blank ones.

    Files are read in splits. Lines are numbered as they are read; the headings are the least numbers of a file's first
    split, one row a file.
    """
    placed = lines.select("value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    first = placed.groupBy("file").agg(F.min(F.when(F.col("block") == 0, F.col("at"))).alias("at")).where("at IS NOT NULL")
    heads = first.select(F.explode(F.sequence(F.col("at"), F.col("at") + (n - 1))).alias("at")).distinct()
    heads = F.broadcast(heads) if n * len(lines.inputFiles()) <= FEW_ROWS else heads
    return placed.join(heads, "at", "left_anti").where("trim(value) <> ''").select("value")


def parse_odds_json(df: DataFrame, key: str, col: str, bookmaker_id: int = 16, thresholds: list[float] | None = None, scores: list[str] | None = None, markets: list[str] | None = None) -> DataFrame:
    """key, odds_key, odds of one bookmaker (S4); of an odds key that comes twice the later counts."""
    entries = df.select(key, F.from_json(col, ODDS_JSON)["data"]["findOddsByEventId"]["odds"].alias("es"))
    own = entries.select(key, F.filter("es", lambda e: e["bookmakerId"] == bookmaker_id).alias("es"))
    full = F.get(F.filter("es", lambda e: (e["bettingType"] == "HOME_DRAW_AWAY") & (e["bettingScope"] == "FULL_TIME")), F.lit(0))["odds"]
    home = F.get(F.filter(F.transform(full, lambda o: o["eventParticipantId"]), lambda p: p.isNotNull()), F.lit(0))
    asked = lambda e: F.lit(True) if markets is None else e["bettingType"].isin(markets)
    one = lambda e, i: F.transform(e["odds"], lambda o, j: F.struct(_odds_key(e, o, F.col("home_id"), thresholds, scores).alias("odds_key"), F.coalesce(o["opening"], o["value"], F.lit("-")).alias("odds"), F.struct(i.alias("i"), j.alias("j")).alias("at")))
    # in one expression over arrays: as columns of exploded rows the keys are computed anew for each filter, in methods too long for the JVM to compile
    listed = F.flatten(F.transform(F.filter("es", lambda e: e["odds"].isNotNull() & asked(e)), one))
    out = own.withColumn("home_id", home).select(key, F.explode_outer(listed).alias("o")).select(key, "o.odds_key", "o.odds", "o.at").where("odds_key IS NOT NULL")
    return out.groupBy(key, "odds_key").agg(F.max_by("odds", "at").alias("odds"))


def _odds_key(entry: Column, o: Column, home_id: Column, thresholds: list[float] | None, scores: list[str] | None) -> Column:
    """Market, period and outcome of one of an entry's odds; null for others."""
    period, who = scope_label(entry["bettingScope"]), o["eventParticipantId"]
    kind, line, score = entry["bettingType"], o["handicap"]["value"], F.replace(o["score"], F.lit(" "))

    def named(market: str, *parts: Column | str) -> Column:
        cols = [F.lit(p) if isinstance(p, str) else p for p in (market, *parts)]
        return F.when(sum((c.isNull().cast("int") for c in cols), F.lit(0)) == 0, F.concat_ws("|", *cols))

    over = F.when(F.lit(True) if thresholds is None else line.isin(thresholds), F.concat(F.when(o["selection"] == "OVER", "O ").otherwise("U "), line.cast("string")))
    right = F.when((period != "2nd Half") & (F.lit(True) if scores is None else score.isin(scores)), score)
    return (
        F.when(kind == "HOME_DRAW_AWAY", named("1x2", period, participant_key(who, home_id, "Draw", "Home", "Away")))
        .when(kind == "BOTH_TEAMS_TO_SCORE", named("Both teams", period, F.when(o["bothTeamsToScore"], "Yes").when(~o["bothTeamsToScore"], "No")))
        .when(kind == "OVER_UNDER", named("Over/Under", period, over))
        .when(kind == "DOUBLE_CHANCE", named("Double chance", period, participant_key(who, home_id, "12", "1X", "X2")))
        .when(kind == "CORRECT_SCORE", named("Correct score", period, right))
        .when(kind == "HALF_FULL_TIME", named("HTFT", o["winner"]))
    )


def feed_fields(col: Column) -> Column:
    """The fields of all sections of a feed as a map; of a key that comes twice the last counts (Q17)."""
    pairs = F.filter(F.transform(F.split(col, "[~¬]"), lambda x: F.split(x, "÷", 2)), lambda p: F.size(p) == 2)
    # later fields are looked up first
    return F.reverse(pairs)


def field(pairs: Column, name: str) -> Column:
    return F.get(F.get(F.filter(pairs, lambda p: F.get(p, F.lit(0)) == name), F.lit(0)), F.lit(1))


def parse_half_scores(df: DataFrame, col: str) -> DataFrame:
    """df with ht and ft texts from sections of half scores: full time is both halves together, or the second as it stands."""
    sections = F.transform(F.split(F.col(col), "~"), lambda s: F.reverse(F.filter(F.transform(F.split(s, "¬"), lambda x: F.split(x, "÷", 2)), lambda p: F.size(p) == 2)))

    def half(name: str) -> Column:
        own = F.get(F.filter(sections, lambda s: field(s, "AC").contains(name)), F.lit(0))
        return F.when(own.isNotNull(), F.struct(field(own, "IG").alias("home"), field(own, "IH").alias("away")))

    out = df.withColumns({"_h1": half("1st"), "_h2": half("2nd")})
    whole = [(F.col(f"_h1.{s}").try_cast("int") + F.col(f"_h2.{s}").try_cast("int")).cast("string") for s in ("home", "away")]
    ht = F.when(F.col("_h1.home").isNotNull() & F.col("_h1.away").isNotNull(), F.concat_ws("-", "_h1.home", "_h1.away"))
    ft = F.when(whole[0].isNotNull() & whole[1].isNotNull(), F.concat_ws("-", *whole)).otherwise(F.when(F.col("_h2.home").isNotNull() & F.col("_h2.away").isNotNull(), F.concat_ws("-", "_h2.home", "_h2.away")))
    return out.withColumns({"ht": ht, "ft": ft}).drop("_h1", "_h2")


def parse_match_feed(df: DataFrame, col: str) -> DataFrame:
    """df with home, away, home_score, away_score, started; rows without either club go."""
    f = df.withColumn("_f", feed_fields(F.col(col)))
    out = f.withColumns({
        "home": F.nullif(clean_text(field(F.col("_f"), "HG")), F.lit("")), "away": F.nullif(clean_text(field(F.col("_f"), "AG")), F.lit("")),
        "home_score": field(F.col("_f"), "HS").try_cast("int"), "away_score": field(F.col("_f"), "AS").try_cast("int"), "started": field(F.col("_f"), "TU").try_cast("long"),
    })
    return out.where("home IS NOT NULL AND away IS NOT NULL").drop("_f")


def parse_1x2_feed(df: DataFrame, col: str, name: str, bookmaker: str = "16") -> DataFrame:
    """df with odd_home, odd_draw, odd_away of the first entry of the bookmaker, by id or a part of its name, that has three numbers."""
    entries = F.transform(F.split(F.col(col), "~"), lambda s: F.split(s, "¬"))

    def number(e: Column, k: int) -> Column:
        return F.translate(F.get(e, F.lit(k)), ",", ".").try_cast("double")

    good = F.filter(entries, lambda e: ((F.get(e, F.lit(0)) == bookmaker) | F.lower(F.get(e, F.lit(0))).contains(name)) & (F.size(e) >= 4) & number(e, 1).isNotNull() & number(e, 2).isNotNull() & number(e, 3).isNotNull())
    first = F.get(good, F.lit(0))
    return df.withColumns({f"odd_{s}": number(first, k) for k, s in enumerate(("home", "draw", "away"), 1)})


def _exploded(df: DataFrame, variant: str) -> DataFrame:
    """df with pos, key and value of every part of a variant column."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(variant).outer()))


def parse_schedule_json(df: DataFrame, key: str, col: str) -> DataFrame:
    """key, round, pos, status, home_id, away_id, ft, ht, postponed of every match of a season's rounds, nested groups included."""
    whole = df.select(F.col(key).alias("id"), F.try_parse_json(F.col(col).cast("string")).alias("v")).select("id", F.try_variant_get("v", "$.ScheduleList", "variant").alias("v"))
    top = _exploded(whole, "v").select("id", F.col("key").alias("name"), F.col("value").alias("v"))
    inner = _exploded(top.where(~F.col("name").startswith("R_")), "v").where(F.col("key").startswith("R_")).select("id", F.col("key").alias("name"), F.col("value").alias("v"))
    rounds = top.where(F.col("name").startswith("R_")).unionByName(inner)
    rows = _exploded(rounds, "v").select(F.col("id").alias(key), "name", "pos", F.col("value").alias("v"))

    def at(k: int, kind: str) -> Column:
        return F.try_variant_get("v", f"$[{k}]", kind)

    def score(k: int) -> Column:
        return F.when(at(k, "string").rlike(r"^\d+-\d+$"), at(k, "string"))

    status = at(2, "string")
    return rows.select(key, F.regexp_extract("name", r"R_(\d+)", 1).try_cast("int").alias("round"), "pos", status.alias("status"), at(4, "int").alias("home_id"), at(5, "int").alias("away_id"), score(6).alias("ft"), score(7).alias("ht"), F.coalesce(status.isin("4", "5") | F.lower(status).contains("post"), F.lit(False)).alias("postponed"))


def parse_schedule_teams(df: DataFrame, key: str, col: str) -> DataFrame:
    """key, league, team_id, name of every team of a season's schedule."""
    whole = df.select(F.col(key).alias("id"), F.try_parse_json(F.col(col).cast("string")).alias("v")).select("id", F.try_variant_get("v", "$.LeagueInfo[1]", "string").alias("league"), F.try_variant_get("v", "$.TeamInfo", "variant").alias("v"))
    rows = _exploded(whole, "v").select(F.col("id").alias(key), "league", F.col("value").alias("t"))
    return rows.select(key, "league", F.try_variant_get("t", "$[0]", "int").alias("team_id"), F.try_variant_get("t", "$[1]", "string").alias("name")).where("team_id IS NOT NULL")


def extract_links(pages: DataFrame, key: str, col: str, pattern: str = r'href="([^"]*)"', segments: int | None = None, blocked: tuple[str, ...] = ()) -> DataFrame:
    """key, pos, href, season of the distinct links of a page in order; with so many path segments and no blocked one."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(col, F.lit(pattern), F.lit(1))).alias("pos", "href"))
    parts = F.filter(F.split(F.regexp_replace("href", r"^[a-z]+://[^/]*", ""), "/"), lambda x: x != "")
    kept = found.where(F.size(parts) == segments) if segments is not None else found
    kept = kept.where(~F.arrays_overlap(parts, F.array(*[F.lit(b) for b in blocked]))) if blocked else kept
    first = kept.groupBy(key, "href").agg(F.min("pos").cast("int").alias("pos"))
    return first.select(key, "pos", "href", year_label(F.col("href")).alias("season"))


def extract_ids(df: DataFrame, key: str, col: str, pattern: str) -> DataFrame:
    """key, pos, id of the distinct matches of a pattern's first group, in order."""
    found = df.select(key, F.posexplode(F.regexp_extract_all(col, F.lit(pattern), F.lit(1))).alias("pos", "id"))
    return found.groupBy(key, "id").agg(F.min("pos").cast("int").alias("pos"))


def extract_id_groups(df: DataFrame, key: str, col: str, pattern: str, groups: tuple[int, ...]) -> DataFrame:
    """key, pos, id of the distinct values of several groups of a pattern, in the order of matches and groups."""
    found = F.arrays_zip(*[F.regexp_extract_all(col, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])
    each = df.select(key, F.posexplode(found).alias("nth", "m")).select(key, "nth", F.posexplode(F.array(*[F.col(f"m.g{g}") for g in groups])).alias("group", "id"))
    return each.groupBy(key, "id").agg(F.min(F.col("nth") * len(groups) + F.col("group")).cast("int").alias("pos"))


# Where the matches of a live feed begin, and a match that has not started, with the ids of both clubs.
LIVE_MATCHES = '"m":[['
UNSTARTED = r'\[\d+,(\d+),"[^"]*",(\d+),"[^"]*",0,"",'


def unstarted_team_ids(df: DataFrame, key: str, col: str) -> DataFrame:
    """key, pos, id of the clubs of a live feed's matches that have not started; a feed without matches has none."""
    at = F.instr(col, LIVE_MATCHES)
    body = df.where(at > 0).select(key, F.substr(F.col(col), at).alias(col))
    return extract_id_groups(body, key, col, UNSTARTED, (1, 2))


def season_links(pages: DataFrame, key: str, col: str, slug: str = "slug", url: str = "url", domain: str = "https://www.example.org") -> DataFrame:
    """key, pos, season, name, href of a league's seasons: the current one first, then those of archive links in page order, each once.

    The current season is what the page's ``season_url`` element says, or the years in its title, or ``current``. Addresses lead to results:
    the league's without its archive part, and archive links made absolute and rewritten.
    """
    said = F.trim(F.regexp_extract(col, r"""<[^>]*\sid=["']?season_url["']?[^>]*>([^<]*)<""", 1))
    titled = F.replace(F.regexp_extract(F.regexp_extract(col, r"(?s)<title[^>]*>(.*?)</title>", 1), r"(\d{4}/\d{4}|\d{4}-\d{4})", 1), F.lit("/"), F.lit("-"))
    now = F.when(said != "", said).when(titled != "", titled).otherwise("current")
    base = pages.select(key, slug, now.alias("now"), F.concat(F.replace(url, F.lit("archive/"), F.lit("")), F.lit("results/")).alias("now_href"), F.regexp_extract_all(col, F.lit(r"(?s)<a\s(?:[^>]*\s)?href=[^>]*>.*?</a>"), F.lit(0)).alias("links"))
    first = base.select(key, F.lit(0).alias("pos"), F.col("now").alias("season"), F.replace("now", F.lit("-"), F.lit("/")).alias("name"), F.col("now_href").alias("href"))
    each = base.select(key, slug, "now", F.posexplode("links").alias("nth", "link")).withColumns({
        "href": F.regexp_extract("link", r"""^<a\s(?:[^>]*\s)?href=["']?([^"'\s>]*)""", 1), "text": clean_text(F.col("link")),
    })
    each = each.withColumn("season", F.expr(f"regexp_extract(href, concat('/football/[^/]+/\\\\Q', {slug}, '\\\\E-([0-9]{{4}}-[0-9]{{4}})/'), 1)"))
    each = each.where("season <> '' AND season <> now")
    earliest = each.groupBy(key, "season").agg(F.min_by(F.struct("nth", "text", "href"), "nth").alias("m")).select(key, "season", "m.*")
    full = F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(F.concat(F.lit(domain), F.col("href")))
    full = F.replace(F.when(F.endswith(full, F.lit("/")), full).otherwise(F.concat(full, F.lit("/"))), F.lit("/archive/"), F.lit("/results/"))
    full = F.when(F.contains(full, F.lit("/results/")), full).otherwise(F.concat(full, F.lit("results/")))
    name = F.when(F.col("text") != "", F.col("text")).otherwise(F.replace("season", F.lit("-"), F.lit("/")))
    # some seasons a page
    rest = earliest.select(key, F.row_number().over(Window.partitionBy(key).orderBy("nth")).cast("int").alias("pos"), "season", name.alias("name"), full.alias("href"))
    return first.unionByName(rest)


def appearance_order(df: DataFrame, maps: str, at: list[str], fixed: list[str] = (), skip: list[str] = ()) -> DataFrame:
    """name, place of the columns of records with dynamic keys: the fixed ones as listed, then the others as they first appear in the order of ``at`` and within a record.

    The first appearance is a minimum, so that partitions don't matter; of the names only as many as there are columns meet in one task.
    """
    long = df.select(*at, F.posexplode(maps).alias("nth", "name", "value")).where(~F.col("name").isin(*fixed, *skip) if fixed or skip else F.lit(True))
    first = long.groupBy("name").agg(F.min(F.struct(*at, "nth")).alias("first"))
    others = first.select("name", (F.row_number().over(Window.orderBy("first")) + len(fixed) - 1).cast("int").alias("place"))
    listed = df.sparkSession.createDataFrame([(n, k) for k, n in enumerate(fixed)], "name string, place int")
    return listed.unionByName(others)


def dynamic_columns(df: DataFrame, key: str, maps: str, fixed: list[str], at: list[str] | None = None, skip: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """A table with the fixed columns and one for every other key that occurs and is not skipped, by name, or in order of appearance by ``at``; and those keys."""
    long = df.select(key, F.explode(maps).alias("name", "value"))
    if at:
        names = [r["name"] for r in appearance_order(df, maps, at, [], [*fixed, *skip]).orderBy("place").limit(MAX_COLUMNS + 1).collect()]
    else:
        names = [r["name"] for r in long.select("name").distinct().where(~F.col("name").isin(*fixed, *skip)).orderBy("name").limit(MAX_COLUMNS + 1).collect()]
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"over {MAX_COLUMNS} keys: keep the map")
    return long.groupBy(key).pivot("name", [*fixed, *names]).agg(F.first("value")), names


#: Columns that a table of dynamic keys may have.
MAX_COLUMNS = 2_000


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Whole numbers of a text file, separated by commas and lines; others are skipped."""
    return spark.read.text(path).select(F.explode(F.split("value", ",")).alias("t")).select(trim(F.col("t")).try_cast("long").alias("id")).where("id IS NOT NULL")


def season_range(label: str, n: int) -> list[str]:
    """The label and the n - 1 seasons before it, in its own format."""
    if "-" in label:
        a, b = map(int, label.split("-"))
        return [f"{a - k}-{b - k}" for k in range(n)]
    if "/" in label:
        a, b = label.split("/")
        return [f"{int(a) - k}/{(int(b) - k) % 100:02d}" for k in range(n)]
    return [str(int(label) - k) for k in range(n)]


def seasons_back(label: Column, n: int) -> Column:
    """The same for a column of labels, as an array."""
    parts = F.split(label, "[-/]")
    first, second = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    back = F.sequence(F.lit(0), F.lit(n - 1))
    return F.when(F.contains(label, F.lit("-")), F.transform(back, lambda k: F.concat_ws("-", first - k, second - k))).when(
        F.contains(label, F.lit("/")), F.transform(back, lambda k: F.concat_ws("/", first - k, F.lpad(F.pmod(second - k, F.lit(100)).cast("string"), 2, "0")))
    ).otherwise(F.transform(back, lambda k: (first - k).cast("string")))


def odds_report(long: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """One row a match with a column an odds key, ``-`` for missing ones; matches without odds have no row."""
    names = names or [c["key"] for c in odds_columns()]
    wide = _odds_arrays(long.where(F.col("odds_key").isin(names)), keys, names)
    return wide.select(*keys, *[F.get("odds", F.lit(k)).alias(n) for k, n in enumerate(names)])


def _odds_arrays(long: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, odds: the odds of the named keys in their order, ``-`` for missing ones.

    A match's few odds are one map, and its columns are looked up in a loop: a pivot holds and copies a row of all columns for each of the
    odds, and an expression a column makes methods that are too long for the JVM to compile.
    """
    once = long.groupBy(*keys, "odds_key").agg(F.first("odds").alias("odds"))
    maps = once.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("odds_key").isin(names), F.struct("odds_key", "odds")))).alias("m"))
    looked_up = lambda m: F.transform(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.try_element_at(m, n), F.lit("-")))
    # as an element of an array the map is built once, not for each name
    return maps.select(*keys, F.get(F.transform(F.array("m"), looked_up), F.lit(0)).alias("odds"))


# The groups of the dated report, their periods, and its correct scores in the order of its columns.
DATED_GROUPS = {"1x2": ["Home", "Draw", "Away"], "Over/Under": [f"{side} {whole}.5" for whole in range(5) for side in "OU"], "Both teams": ["Yes", "No"], "Double chance": ["1X", "12", "X2"]}
DATED_SCORES = "1:0 0:1 1:1 2:0 0:2 2:1 1:2 2:2 3:0 0:3 3:1 1:3 3:2 2:3 3:3 4:0 0:4 4:1 1:4 4:2 2:4 4:3 3:4 4:4".split()
DATED_FIXED = ["date", "match_id", "home", "away", "ft", "ht"]


def dated_columns() -> list[dict[str, str]]:
    """name, key, group and label of the odds columns of the dated report, generated from groups, periods and labels; there are no scores of second halves."""
    triples = [(g, p, x) for g, labels in DATED_GROUPS.items() for p in PERIODS.values() for x in labels]
    triples += [("Correct score", p, x) for p in list(PERIODS.values())[:2] for x in DATED_SCORES]
    name = lambda *t: "_".join("".join(c if c.isalnum() else "_" for c in x.lower()) for x in t)
    return [{"name": name(*t), "key": "|".join(t), "group": f"{t[0]} | {t[1]}", "label": t[2]} for t in triples]


def dated_odds_report(long: DataFrame, matches: DataFrame, key: str = "match_id") -> DataFrame:
    """The date-first report: six fixed columns and one an odds column, ``-`` for missing odds, of matches with any odds.

    Each column carries its group, label and key as metadata, which a Parquet file keeps.
    """
    columns = dated_columns()
    has = _odds_arrays(long.where("odds_key IS NOT NULL"), [key], [c["key"] for c in columns])
    odds = [F.get("odds", F.lit(n)).alias(c["name"], metadata={k: c[k] for k in ("group", "label", "key")}) for n, c in enumerate(columns)]
    fixed = [F.col(c).alias(c, metadata={"group": c, "label": c}) for c in DATED_FIXED]
    return matches.join(has, key).select(*fixed, *odds)


def read_history_jdbc(spark: SparkSession, jdbc: dict[str, str], odds: list[str], keep: list[str], key: str = "match_id", partitions: int = 8, fetch: int = 2_000) -> DataFrame:
    """The kept and odds columns of a database's history (S2), read in ranges of a numeric key, each its own task and query.

    The bounds are the table's least and largest key, asked of the database; the selection, and filters and columns of what follows, are
    part of the queries. An empty table has one range.
    """
    source = lambda: spark.read.format("jdbc").options(fetchsize=str(fetch), **{k: v for k, v in jdbc.items() if k != "dbtable"})
    named = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(jdbc["url"]).quoteIdentifier(key)
    ends = source().option("query", f"SELECT MIN({named}) AS lo, MAX({named}) AS hi FROM {jdbc['dbtable']}").load().first()
    whole = source().option("dbtable", jdbc["dbtable"])
    if ends[0] is not None:
        whole = whole.option("partitionColumn", key).option("lowerBound", str(ends[0])).option("upperBound", str(ends[1] + 1)).option("numPartitions", str(partitions))
    return whole.load().select(*keep, *odds)
