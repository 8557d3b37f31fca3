"""Windows, statuses and selections over season schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixturelake.functions.scalars import FOLD_FROM, FOLD_TO, comeback, window_label

SEASON = ["league", "team", "season"]
# Words of competitions that are not a league, as one source of fixtures needs them, and as another does.
NOT_LEAGUE = (
    "kupa", "cup", "copa", "coppa", "pokal", "taça", "taca", "hazırlık", "hazirlik", "friendlies", "avrupa", "europe", "şampiyonlar ligi", "sampiyonlar ligi", "champions league", "uefa",
    "konferans", "conference", "trophy", "shield", "dünya", "dunya", "world", "turnuva", "tournament", "recopa", "sudamericana", "libertadores",
)
NOT_MAIN = ("kupa", "cup", "hazirlik", "hazırlık", "playoff", "play-off", "süper kupa")


def ordered(keys: list[str] = SEASON, by: str = "seq") -> Window:
    return Window.partitionBy(*keys).orderBy(by)


def nth_from_last_played(view: DataFrame, n: list[int]) -> DataFrame:
    """The n-th last played match of each club's season."""
    back = F.row_number().over(Window.partitionBy(*SEASON).orderBy(F.desc("seq"))).cast("int")
    return view.where("played").withColumn("n", back).where(F.col("n").isin(n))


def neighbours(view: DataFrame, offsets: list[int], cols: list[str]) -> DataFrame:
    """cols of the rows at each offset, as ``prev1_x`` or ``next2_x``."""
    w = ordered()
    new = {f"{'prev' if k < 0 else 'next'}{abs(k)}_{c}": F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w) for k in offsets for c in cols}
    return view.withColumns(new)


def opponents_around(view: DataFrame, n: int = 3) -> DataFrame:
    """Arrays of the n opponents before and after each match."""
    w = ordered()
    return view.withColumns({"prev": F.collect_list("opponent").over(w.rowsBetween(-n, -1)), "next": F.collect_list("opponent").over(w.rowsBetween(1, n))})


def next_matches_text(view: DataFrame, n: int) -> DataFrame:
    """Up to n following scores in one text."""
    said = F.concat_ws("-", "ft_home", "ft_away")
    return view.withColumn("following", F.array_join(F.collect_list(said).over(ordered().rowsBetween(1, n)), " | "))


def first_unplayed(view: DataFrame) -> DataFrame:
    """The first unplayed match after the last played one of each club's season."""
    last = F.max(F.when(F.col("played"), F.col("seq"))).over(Window.partitionBy(*SEASON))
    nxt = view.withColumn("last_played", last).where(~F.col("played") & (F.col("seq") > F.coalesce("last_played", F.lit(0))))
    at = F.row_number().over(ordered())
    return nxt.withColumn("at", at).where("at = 1").drop("at", "last_played")


def section_ids(rows: DataFrame, page: str, seq: str = "seq", is_header: str = "is_header") -> DataFrame:
    """The number of the last header seen, for each row of a page."""
    return rows.withColumn("section", F.count_if(F.col(is_header)).over(Window.partitionBy(page).orderBy(seq)))


def main_competition(rows: DataFrame, mode: str = "exclude", name: str = "competition") -> DataFrame:
    """Rows of the league: by name, with a long list of other competitions or a short one, or the first section only.

    Letters are folded before, so that a capital I without dot counts as i; a row without a name is of no league.
    """
    if mode == "first":
        return rows.where("section = 1")
    words = {"exclude": NOT_LEAGUE, "short": NOT_MAIN}[mode]
    folded = F.lower(F.translate(F.col(name), FOLD_FROM, FOLD_TO))
    plain = sorted({w.translate(str.maketrans(FOLD_FROM, FOLD_TO)) for w in words})
    return rows.where(~F.coalesce(folded.rlike("|".join(plain)), F.lit(True)))


def match_status(score: Column, status: Column) -> Column:
    """played, postponed or upcoming."""
    return F.when(score.rlike(r"^\d+\s*-\s*\d+$"), "played").when(F.lower(status).rlike("^[45]$|post|ert"), "postponed").otherwise("upcoming")


def only_comebacks(df: DataFrame) -> DataFrame:
    """Matches whose half-time lead was overturned."""
    c = comeback(F.col("ht_home"), F.col("ht_away"), F.col("ft_home"), F.col("ft_away"))
    return df.withColumn("comeback", c).where(F.col("comeback").isNotNull())


def month_window(df: DataFrame, date: str = "match_date") -> DataFrame:
    """Rows of the first or last week of a month, with month and window."""
    out = df.withColumns({"month": F.month(date).cast("int"), "window": window_label(F.dayofmonth(date))})
    return out.where("window <> 'mid'")


def current_window(df: DataFrame, today: str, date: str = "match_date") -> DataFrame:
    """Rows of the window that ``today`` is in, in any year; none from day 8 to 23."""
    day = F.lit(today).cast("date")
    return month_window(df, date).where((F.col("month") == F.month(day)) & (F.col("window") == window_label(F.dayofmonth(day))))


def same_half(df: DataFrame, current_round: str = "current_round", total: str = "total_rounds", round_: str = "round") -> DataFrame:
    """Rows of the half of the season that the current round is in."""
    early = F.col(round_) <= F.expr(f"{total} div 2")
    return df.where(early == (F.col(current_round) <= F.expr(f"{total} div 2")))


def last_seasons(df: DataFrame, n: int, season: str = "season", keys: tuple[str, ...] = ("league",)) -> DataFrame:
    """Rows of the latest n seasons of each league (P10, O5); seasons are ranked apart, not over all rows."""
    seasons = df.select(*keys, season).distinct()
    latest = seasons.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(season)))).where(F.col("at") <= n).drop("at")
    return df.join(latest, [*keys, season], "left_semi")


def days_back(df: DataFrame, n: int, today: str, date: str = "match_date") -> DataFrame:
    """Rows of the n days before today."""
    day = F.lit(today).cast("date")
    return df.where(F.col(date).between(F.date_sub(day, n), F.date_sub(day, 1)))


def active_round(schedule: DataFrame) -> DataFrame:
    """league, season, active_round: the last round played if it has matches to come, else the next with some, else the last; 1 if none is played."""
    upcoming = F.count_if(~F.col("played") & ~F.col("postponed"))
    rounds = schedule.groupBy("league", "season", "round").agg(F.count_if("played").alias("done"), upcoming.alias("coming"))
    last = rounds.groupBy("league", "season").agg(F.max(F.when(F.col("done") > 0, F.col("round"))).alias("last"))
    here = rounds.select("league", "season", F.col("round").alias("last"), F.col("coming").alias("here"))
    after = rounds.select("league", "season", (F.col("round") - 1).alias("last"), F.col("coming").alias("after"))
    found = last.join(here, ["league", "season", "last"], "left").join(after, ["league", "season", "last"], "left")
    pick = F.when(F.col("last").isNull(), 1).when(F.col("here") > 0, F.col("last")).when(F.col("after") > 0, F.col("last") + 1).otherwise(F.col("last"))
    return found.select("league", "season", pick.cast("int").alias("active_round"))


def dominant_name(fx: DataFrame, keys: tuple[str, ...] = ("league", "season"), order: str = "match_id") -> DataFrame:
    """The most frequent club of each group, first seen of equals, if it is in at least half of the rows."""
    both = fx.select(*keys, order, F.explode(F.array("home", "away")).alias("team"))
    counted = both.groupBy(*keys, "team").agg(F.count("*").alias("rows"), F.min(order).alias("first_seen"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rows"), "first_seen", "team"))
    total = fx.groupBy(*keys).agg(F.count("*").alias("total"))
    top = counted.withColumn("at", at).where("at = 1").join(total, list(keys))
    enough = F.col("rows") >= F.greatest(F.lit(1), F.expr("total div 2"))
    return top.select(*keys, F.when(enough, F.col("team")).alias("team"), "rows")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("at = 1").drop("at")
