"""Patterns over season schedules: repeated pairs and scores, bridges, cross fixtures and networks of three."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixturelake.cluster import materialise, small_side
from fixturelake.functions.scalars import comeback, normalize_name, score_in, score_text, teams_match, tokens
from fixturelake.operators.schedule import SEASON, active_round, first_unplayed, neighbours, opponents_around, ordered

# How many opponents before and after a match a combination compares.
COMBINATIONS = [(3, 0), (0, 3), (3, 1), (3, 2), (3, 3), (2, 1), (2, 2), (2, 3), (1, 1), (1, 2), (1, 3)]


def combination_label(prev: int, nxt: int) -> str:
    return "+".join(filter(None, (f"PREV{prev}" if prev else "", f"NEXT{nxt}" if nxt else "")))


def _score(home: str = "ft_home", away: str = "ft_away") -> Column:
    return F.concat_ws("-", F.least(home, away), F.greatest(home, away))


def _turned(prefix: str = "") -> Column:
    return comeback(*[F.col(f"{prefix}{c}") for c in ("ht_home", "ht_away", "ft_home", "ft_away")])


def nback_pattern(view: DataFrame, current: int, n: list[int]) -> DataFrame:
    """Past matches of the same two clubs with the same score as the n-th last of the running season, and the matches before and n after."""
    pair = {"lo": F.least("home", "away"), "hi": F.greatest("home", "away")}
    back = F.row_number().over(Window.partitionBy(*SEASON).orderBy(F.desc("seq"))).cast("int")
    now = view.where((F.col("season") == current) & F.col("played")).withColumn("n", back).where(F.col("n").isin(n)).withColumns(pair)
    now = now.select("league", "team", "n", "lo", "hi", "ft_home", "ft_away", F.col("match_id").alias("pattern_id"))
    w = ordered()
    after = F.coalesce(*[F.when(F.col("n") == k, F.col(f"next{k}_id")) for k in n])
    past = view.where((F.col("season") < current) & F.col("played")).withColumns({"prev_id": F.lag("match_id", 1).over(w), **{f"next{k}_id": F.lead("match_id", k).over(w) for k in n}, **pair})
    keys = ["league", "team", "lo", "hi", "ft_home", "ft_away"]
    return past.join(now, keys).select("league", "team", "season", "n", "pattern_id", "match_id", "prev_id", after.alias("next_id"))


def pair_pattern(view: DataFrame, current: int) -> DataFrame:
    """Past consecutive pairs with the last two scores in either order and direction, a shared opponent, and a lead overturned in them or beside them."""
    played = view.where("played").withColumns({"ns": _score(), "turned": _turned()})
    back = F.row_number().over(Window.partitionBy(*SEASON).orderBy(F.desc("seq")))
    last = played.where(F.col("season") == current).withColumn("back", back).where("back <= 2")
    now = last.groupBy("league", "team").agg(F.sort_array(F.collect_list("ns")).alias("scores"), F.collect_set("opponent").alias("opponents")).where("size(scores) = 2")
    past = neighbours(played.where(F.col("season") < current), [-1, 1, 2], ["turned"])
    past = neighbours(past, [1], ["ns", "opponent", "match_id"]).where("next1_match_id IS NOT NULL")
    past = past.withColumn("scores", F.sort_array(F.array("ns", "next1_ns")))
    hits = past.join(now, ["league", "team", "scores"]).where(F.arrays_overlap(F.array("opponent", "next1_opponent"), "opponents"))
    beside = F.coalesce("turned", "next1_turned", "prev1_turned", "next2_turned").isNotNull()
    return hits.where(beside).select("league", "team", "season", "match_id", F.col("next1_match_id").alias("second_id"))


def triple_pattern(view: DataFrame, current: int) -> DataFrame:
    """Past three consecutive matches with the last three scores in any order and direction, and the matches around them."""
    played = view.where("played").withColumn("ns", _score())
    back = F.row_number().over(Window.partitionBy(*SEASON).orderBy(F.desc("seq")))
    last = played.where(F.col("season") == current).withColumn("back", back).where("back <= 3")
    now = last.groupBy("league", "team").agg(F.sort_array(F.collect_list("ns")).alias("scores")).where("size(scores) = 3")
    past = neighbours(played.where(F.col("season") < current), [-1, 1, 2, 3], ["ns", "match_id"]).where("next2_match_id IS NOT NULL")
    past = past.withColumn("scores", F.sort_array(F.array("ns", "next1_ns", "next2_ns")))
    return past.join(now, ["league", "team", "scores"]).select("league", "team", "season", "match_id", F.col("prev1_match_id").alias("prev_id"), F.col("next3_match_id").alias("next_id"))


def opponent_sequence(view: DataFrame, current: int, fuzzy: bool = False) -> DataFrame:
    """Past overturned leads with the same opponents before and after as the first unplayed match, by combination."""
    around = opponents_around(view)
    now = first_unplayed(around.where(F.col("season") == current)).select("league", "team", F.col("match_id").alias("target_id"), F.col("prev").alias("p"), F.col("next").alias("x"))
    past = around.where((F.col("season") < current) & F.col("played") & _turned().isNotNull())
    both = past.join(now, ["league", "team"])
    same = teams_match if fuzzy else (lambda a, b: a == b)

    def alike(n: int, a: str, b: str, end: bool) -> Column:
        enough = (F.size(a) >= n) & (F.size(b) >= n)
        pairs = [same(*[F.get(F.col(c), (F.size(c) - 1 - i) if end else F.lit(i)) for c in (a, b)]) for i in range(n)]
        return reduce(Column.__and__, pairs, enough)

    labels = [F.when(alike(i, "p", "prev", True) & alike(j, "x", "next", False), combination_label(i, j)) for i, j in COMBINATIONS]
    found = both.withColumn("combo", F.explode(F.filter(F.array(*labels), lambda c: c.isNotNull())))
    return found.select("league", "team", "season", "match_id", "target_id", "combo", _turned().alias("comeback"))


def matching_names(left: DataFrame, right: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """The by columns, left_name, right_name: names of left and right with equal by columns that mean one club.

    Names meet in an inverted index: of tokens of three characters or more, of the first four of longer ones, and of folded names with
    every piece of a folded name, so that one that holds the other meets it. What meets is verified; no other names are compared.
    """
    key = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind), x))
    long, begins = lambda n: F.filter(tokens(F.col("n")), lambda x: F.length(x) >= n), lambda c: F.transform(c, lambda x: F.substring(x, 1, 4))
    folded = normalize_name(F.col("n"))
    size = F.length(folded)
    pieces = F.when(size > 0, F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda k: F.substr(folded, i, k)))))
    shared = F.concat(key("=", long(3)), key("^", begins(long(4))))

    def keyed(df: DataFrame, side: str) -> DataFrame:
        names = df.select(*by, F.col(name).alias("n")).distinct().where(size > 0)
        whole, parts = F.array(folded), F.coalesce(pieces, F.array().cast("array<string>"))
        held = F.concat(key("<", whole if side == "left" else parts), key(">", parts if side == "left" else whole))
        return names.select(*by, F.col("n").alias(f"{side}_name"), F.explode(F.array_distinct(F.concat(shared, held))).alias("at"))

    met = keyed(left, "left").join(keyed(right, "right"), [*by, "at"]).drop("at").distinct()
    return met.where(teams_match(F.col("left_name"), F.col("right_name")))


def named_opponent_sequence(view: DataFrame, current: int) -> DataFrame:
    """As opponent_sequence with names as clubs: past opponents may be spelled otherwise than the current ones.

    Names are resolved once for each league, and then past and current opponents meet by club, place and name. A match's places
    that agree are the bits of a number in which each combination's bits are looked for.
    """
    around = opponents_around(view)
    now = first_unplayed(around.where(F.col("season") == current)).select("league", "team", F.col("match_id").alias("target_id"), "prev", "next")
    past = around.where((F.col("season") < current) & F.col("played") & _turned().isNotNull()).select("league", "team", "season", "match_id", _turned().alias("comeback"), "prev", "next")
    # places 0, 1, 2 lie before, nearest first, and 3, 4, 5 behind
    places = F.concat(F.transform(F.reverse("prev"), lambda x, k: F.struct(k.alias("place"), x.alias("name"))), F.transform("next", lambda x, k: F.struct((k + 3).alias("place"), x.alias("name"))))
    each = lambda df: df.withColumn("o", F.explode(places)).drop("prev", "next").select("*", "o.place", "o.name").drop("o")
    then, today = each(past), each(now)
    links = matching_names(then, today, ["league"])
    met = then.join(links.withColumnRenamed("left_name", "name"), ["league", "name"]).drop("name").join(today.withColumnRenamed("name", "right_name"), ["league", "team", "place", "right_name"])
    agree = met.groupBy("league", "team", "season", "match_id", "comeback", "target_id").agg(F.collect_set("place").alias("places"))
    wanted = lambda i, j: F.array(*[F.lit(k) for k in [*range(i), *range(3, 3 + j)]])
    labels = [F.when(F.size(F.array_except(wanted(i, j), F.col("places"))) == 0, combination_label(i, j)) for i, j in COMBINATIONS]
    found = agree.withColumn("combo", F.explode(F.array_compact(F.array(*labels))))
    return found.select("league", "team", "season", "match_id", "target_id", "combo", "comeback")


def _meetings(schedule: DataFrame) -> DataFrame:
    """One row a club, round and season with its opponent; of two matches in a round the later counts."""
    done = schedule.where("played AND NOT postponed")
    sides = done.select("league", "season", "round", "match_id", F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("away").alias("opponent")), F.struct(F.col("away").alias("team"), F.col("home").alias("opponent")))).alias("s"))
    return sides.groupBy("league", "season", "round", F.col("s.team").alias("team")).agg(F.max_by("s.opponent", "match_id").alias("opponent"))


def bridge_pattern(schedule: DataFrame, current: int, max_offset: int = 5, lookback: int = 15, only_turned: bool = True) -> DataFrame:
    """Upcoming pairs whose opponents k rounds ago met, in a past season, clubs that met each other in this round."""
    rounds = active_round(schedule.where(F.col("season") == current)).select("league", "active_round")
    coming = schedule.where((F.col("season") == current) & ~F.col("played") & ~F.col("postponed")).join(rounds, "league").where("round = active_round AND active_round >= 2")
    met = materialise(_meetings(schedule), "meetings")
    offsets = coming.select("league", F.col("match_id").alias("upcoming_id"), F.col("home").alias("a"), F.col("away").alias("b"), "active_round", F.explode(F.sequence(F.lit(1), F.lit(max_offset))).alias("offset"))
    offsets = offsets.withColumn("bridge", F.col("active_round") - F.col("offset")).where("bridge >= 1")
    now = met.where(F.col("season") == current)

    def step(left: DataFrame, side: DataFrame, of: str, to: str, keys: list[str]) -> DataFrame:
        return left.join(side.select("league", *keys[1:], F.col("round").alias("bridge"), F.col("team").alias(of), F.col("opponent").alias(to)), [*keys, "bridge", of])

    linked = step(step(offsets, now, "a", "b1", ["league"]), now, "b", "b2", ["league"])
    past = met.where((F.col("season") < current) & (F.col("season") >= current - lookback))
    seasons = past.select("league", "season", F.col("round").alias("bridge"), F.col("team").alias("b1"), F.col("opponent").alias("old_a"))
    found = step(linked.join(seasons, ["league", "bridge", "b1"]), past, "b2", "old_b", ["league", "season"])
    games = schedule.where((F.col("season") < current)).withColumns({"lo": F.least("home", "away"), "hi": F.greatest("home", "away"), "turned": _turned()})
    first = games.withColumn("at", F.row_number().over(Window.partitionBy("league", "season", "round", "lo", "hi").orderBy("match_id"))).where("at = 1 AND played")
    first = first.select("league", "season", F.col("round").alias("active_round"), "lo", "hi", "match_id", "turned")
    hits = found.withColumns({"lo": F.least("old_a", "old_b"), "hi": F.greatest("old_a", "old_b")}).join(first, ["league", "season", "active_round", "lo", "hi"])
    hits = hits.where("turned IS NOT NULL") if only_turned else hits
    return hits.select("league", "season", "active_round", "offset", "upcoming_id", "b1", "b2", "match_id", "turned")


def _crossed(current: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """weeks (league, round, th, ta, oh, oa, season, team), games (league, round, season, team, match ...), ids (league, round, home, away, match_id).

    Weeks are of pairs of clubs, whatever the number of fixtures that these have; games are those of the current rounds, in order within
    their club's week (at).
    """
    ids = materialise(current.select("league", "round", "home", "away", "match_id"), "cross-ids")
    fixtures = ids.select("league", "round", "home", "away").distinct()
    target = fixtures.select("league", "round", F.col("home").alias("th"), F.col("away").alias("ta"))
    other = fixtures.select("league", "round", F.col("home").alias("oh"), F.col("away").alias("oa"))
    past = history.join(fixtures.select("league", "round").distinct(), ["league", "round"], "left_semi")
    said = {"ht": F.concat_ws("-", "ht_home", "ht_away"), "ft": F.concat_ws("-", "ft_home", "ft_away")}
    games = past.select("league", "round", "season", "match_id", "home", "away", *[v.alias(k) for k, v in said.items()], F.explode(F.array_distinct(F.array("home", "away"))).alias("team"))
    games = games.withColumn("at", F.row_number().over(Window.partitionBy("league", "round", "season", "team").orderBy("match_id")))
    games = materialise(games.withColumn("place", F.when(F.col("team") == F.col("home"), "home").otherwise("away")), "cross-games")
    anchors = games.select("league", "round", "season", F.col("home").alias("oh"), F.col("away").alias("oa")).distinct()
    weeks = target.join(other, ["league", "round"]).where("NOT (th = oh AND ta = oa)").join(anchors, ["league", "round", "oh", "oa"])
    return weeks.withColumn("team", F.explode(F.array("th", "ta"))), games, ids


def _by_fixture(weeks: DataFrame, games: DataFrame, ids: DataFrame) -> DataFrame:
    """weeks of pairs of clubs for all fixtures of both, with the games of the team: the only step as large as the result."""
    target = ids.select("league", "round", F.col("home").alias("th"), F.col("away").alias("ta"), F.col("match_id").alias("target_id"))
    other = ids.select("league", "round", F.col("home").alias("oh"), F.col("away").alias("oa"), F.col("match_id").alias("other_id"))
    # weeks are few rows that become very many: each task takes a few of them, however little they are
    spark = weeks.sparkSession
    n = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    weeks = weeks.repartition(n, "league", "round", "th", "ta", "oh", "oa", "season", "team")
    each = weeks.join(small_side(target), ["league", "round", "th", "ta"]).join(small_side(other), ["league", "round", "oh", "oa"])
    return each.join(small_side(games.drop("home", "away")), ["league", "round", "season", "team"])


def cross_fixture(current: DataFrame, history: DataFrame) -> DataFrame:
    """For a target and another fixture of its week: results of the target's clubs in past weeks of that number in which the other was played.

    The result has a row for each target, other fixture and past match, so it grows with the third power of matches a week.
    """
    return _by_fixture(*_crossed(current, history)).select("league", "round", "season", "target_id", "other_id", "team", "match_id", "place")


def cross_fixture_lines(current: DataFrame, history: DataFrame) -> DataFrame:
    """cross_fixture_report laid flat: a row for each past match with its place (pos) in its club's list and its target's signals (T4).

    A list holds the weeks of its pair of clubs one after the other, so that places and numbers are those of weeks, counted before fixtures
    are told apart.
    """
    weeks, games, ids = _crossed(current, history)
    pair = ["league", "round", "th", "ta", "oh", "oa"]
    counted = weeks.join(games.groupBy("league", "round", "season", "team").agg(F.count("*").alias("n")), ["league", "round", "season", "team"])
    before = Window.partitionBy(*pair, "team").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    others = ids.groupBy("league", "round", F.col("home").alias("oh"), F.col("away").alias("oa")).agg(F.count("*").alias("others"))
    signals = counted.join(others, ["league", "round", "oh", "oa"]).groupBy("league", "round", "th", "ta").agg(F.sum(F.col("n") * F.col("others")).alias("signals"))
    rows = _by_fixture(counted.drop("n").join(signals, ["league", "round", "th", "ta"]), games, ids)
    pos = (F.col("before") + F.col("at") - 1).cast("int")
    return rows.select("league", "target_id", "signals", "other_id", "team", pos.alias("pos"), "season", "round", "match_id", "ht", "ft", "place")


def cross_fixture_report(hits: DataFrame, history: DataFrame) -> DataFrame:
    """league, target_id, signals, others: for each target the other fixtures, for each of those the target's clubs, and for each club its past matches by
    season as (season, round, ht, ft, place, match_id) (T4); hits are those of cross_fixture. Two aggregates nest them."""
    said = history.select("match_id", F.concat_ws("-", "ht_home", "ht_away").alias("ht"), F.concat_ws("-", "ft_home", "ft_away").alias("ft"))
    rows = hits.join(said, "match_id").groupBy("league", "target_id", "other_id", "team").agg(F.sort_array(F.collect_list(F.struct("season", "round", "match_id", "ht", "ft", "place"))).alias("matches"))
    clubs = rows.groupBy("league", "target_id", "other_id").agg(F.sort_array(F.collect_list(F.struct("team", "matches"))).alias("clubs"))
    signals = F.aggregate("others", F.lit(0), lambda n, o: n + F.aggregate(o["clubs"], F.lit(0), lambda m, c: m + F.size(c["matches"])))
    report = clubs.groupBy("league", "target_id").agg(F.sort_array(F.collect_list(F.struct("other_id", "clubs"))).alias("others"))
    return report.select("league", "target_id", signals.alias("signals"), "others")


def crossed_opponents(form: DataFrame) -> DataFrame:
    """Signals of a match from its clubs' opponents before and after: crossed neighbours and shared pools."""
    around = neighbours(form, [-2, -1, 1, 2], ["opponent"])
    cols = ["prev2_opponent", "prev1_opponent", "next1_opponent", "next2_opponent"]
    home = around.where("team = home").select("match_id", *[F.col(c).alias(f"h_{c[:5]}") for c in cols])
    away = around.where("team = away").select("match_id", *[F.col(c).alias(f"a_{c[:5]}") for c in cols])
    both = home.join(away, "match_id")
    pool = F.size(F.array_intersect(F.array_compact(F.array("h_prev2", "h_prev1")), F.array_compact(F.array("a_next1", "a_next2")))) >= 2
    mirror = F.size(F.array_intersect(F.array_compact(F.array("a_prev2", "a_prev1")), F.array_compact(F.array("h_next1", "h_next2")))) >= 2
    one, two = F.col("h_prev1") == F.col("a_next1"), F.col("h_next1") == F.col("a_prev1")
    far_one, far_two = F.col("h_prev2") == F.col("a_next2"), F.col("h_next2") == F.col("a_prev2")
    signals = {"CROSS1": one & two, "CROSS2": far_one & far_two, "POOL_HOME": pool, "POOL_AWAY": mirror, "PERFECT_X": one & two & far_one & far_two}
    return both.withColumn("pattern", F.explode(F.filter(F.array(*[F.when(c, n) for n, c in signals.items()]), lambda x: x.isNotNull()))).select("match_id", "pattern")


def triple_network(view: DataFrame, current: int) -> DataFrame:
    """Upcoming home-away matches whose common earlier opponent last met the away club and then the home club."""
    played = view.where((F.col("season") == current) & F.col("played"))
    back = F.row_number().over(Window.partitionBy(*SEASON).orderBy(F.desc("seq")))
    last = played.withColumn("back", back).where("back <= 2").groupBy("league", F.col("team").alias("x")).agg(
        F.max(F.when(F.col("back") == 1, F.col("opponent"))).alias("home"), F.max(F.when(F.col("back") == 2, F.col("opponent"))).alias("away")
    )
    coming = first_unplayed(view.where(F.col("season") == current)).where("team = home").select("league", "home", "away", "match_id")
    hits = coming.join(last, ["league", "home", "away"])
    return hits.where((F.col("x") != F.col("home")) & (F.col("x") != F.col("away"))).select("league", "match_id", "home", "away", "x")


def attach_odds(matches: DataFrame, odds: DataFrame, key: str = "match_id") -> DataFrame:
    """Matches with their odds, where they have any."""
    return matches.join(odds, key, "left")


def _windowed(view: DataFrame, transition: bool) -> DataFrame:
    """Played matches with month, window and score; transition: a month's last week and the next month's first are one window."""
    day, month = F.dayofmonth("match_date"), F.month("match_date")
    if transition:
        months = F.when(day.between(24, 31), month).when(day.between(1, 7), F.pmod(month - 2, F.lit(12)) + 1)
        keyed = view.where("played").withColumns({"month": months.cast("int"), "window": F.lit("transition")}).where("month IS NOT NULL")
        keyed = keyed.withColumn("month", F.when(F.col("month").isin(6, 7), 5).otherwise(F.col("month")).cast("int"))
    else:
        label = F.when(day.between(1, 7), "1-7").when(day.between(24, 31), "24-31")
        keyed = view.where("played").withColumns({"month": month.cast("int"), "window": label}).where("window IS NOT NULL")
    return keyed.withColumn("score", F.concat_ws("-", "ft_home", "ft_away"))


REPEATED = ["league", "team", "month", "window", "score"]


def repeated_outcomes(view: DataFrame, min_seasons: int = 3, transition: bool = False) -> DataFrame:
    """Scores of a club seen in a month's window in at least so many seasons (A6); transition: from a month's last week to the next month's first."""
    found = _windowed(view, transition).groupBy(*REPEATED).agg(F.count_distinct("season").alias("seasons"), F.count("*").alias("matches"), F.min("match_id").alias("first_id"), F.max("match_id").alias("last_id"))
    return found.where(F.col("seasons") >= min_seasons)


def repeated_outcome_matches(view: DataFrame, min_seasons: int = 3, transition: bool = False) -> DataFrame:
    """league, team, month, window, score, seasons, matches: with the repeated outcomes (A6, A7) their matches by season, as (season, match_id, home, away, ht, ft)."""
    keyed = _windowed(view, transition)
    said = F.struct("season", "match_id", "home", "away", F.concat_ws("-", "ht_home", "ht_away").alias("ht"), F.col("score").alias("ft"))
    # a club's matches of one window and score: some a season
    found = keyed.groupBy(*REPEATED).agg(F.count_distinct("season").alias("seasons"), F.sort_array(F.collect_list(said)).alias("matches"))
    return found.where(F.col("seasons") >= min_seasons)


def hit_summary(hits: DataFrame, *keys: str) -> DataFrame:
    """Hits of each key."""
    return hits.groupBy(*keys).agg(F.count("*").alias("hits"))


def hit_report(hits: DataFrame, matches: DataFrame) -> DataFrame:
    """league, team, season, line, match_id, found: a pattern's hits as lines in the order of team, season and match."""
    said = F.concat_ws(" ", "home", score_text(F.col("ft_home"), F.col("ft_away")), "away")
    named = hits.select("league", "team", "season", "match_id").distinct().join(matches.select("match_id", said.alias("found")), "match_id")
    order = Window.partitionBy("league", "team").orderBy("season", "match_id")
    return named.select("league", "team", "season", F.row_number().over(order).cast("int").alias("line"), "match_id", "found").orderBy("league", "team", "season", "line")


def score_sequence(view: DataFrame, current: int) -> DataFrame:
    """match_id, pattern: first unplayed matches of which a club's last two were 1-0 or 0-1 and then 2-1 or 1-2 (F8)."""
    own = view.where(F.col("season") == current)
    back = F.row_number().over(Window.partitionBy(*SEASON).orderBy(F.desc("seq")))
    last = own.where("played").withColumns({"back": back, "said": F.concat_ws("-", "ft_home", "ft_away")}).where("back <= 2")
    both = last.groupBy("league", "team").agg(*[F.max(F.when(F.col("back") == k, F.col("said"))).alias(f"last{k}") for k in (1, 2)])
    right = both.where(score_in(F.col("last2"), "1-0", "0-1") & score_in(F.col("last1"), "2-1", "1-2"))
    coming = first_unplayed(own).join(right, ["league", "team"])
    return coming.select("match_id", F.when(F.col("team") == F.col("home"), "SEQUENCE_HOME").otherwise("SEQUENCE_AWAY").alias("pattern"))


#: What a signal says.
SIGNALS = {
    "CROSS1": "next and previous opponents are crossed", "CROSS2": "opponents two matches away are crossed", "POOL_HOME": "the home club's past opponents are the away club's next ones",
    "POOL_AWAY": "the away club's past opponents are the home club's next ones", "PERFECT_X": "crossed one and two matches away", "NETWORK": "a third club has just met both",
    "SEQUENCE_HOME": "the home club's last two scores", "SEQUENCE_AWAY": "the away club's last two scores",
}


def signal_list(view: DataFrame, current: int) -> DataFrame:
    """match_id, pattern, said: the signals of the running season's matches."""
    own = view.where(F.col("season") == current)
    network = triple_network(view, current).select("match_id", F.lit("NETWORK").alias("pattern"))
    found = crossed_opponents(own).unionByName(network).unionByName(score_sequence(view, current)).distinct()
    said = F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv])
    return found.withColumn("said", F.try_element_at(said, F.col("pattern"))).orderBy("match_id", "pattern")
