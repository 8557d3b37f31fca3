"""Fixture and odds tables derived from the order tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fixturelake.functions.catalogue import odds_columns
from fixturelake.operators.history import load_history

#: The running season, and the first day that has not been played.
CURRENT_SEASON = 2001
TODAY = "2001-06-01"
ODDS = ["o1", "o2", "o3", "o4", "o5", "o6", "o7", "t1", "t2", "t3", "t4", "t5"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a match: league, season, round, clubs and scores."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.selectExpr(
        "cast(o_orderkey as bigint) match_id",
        "cast(c_nationkey % 5 as int) league",
        "cast(year(o_orderdate) as int) season",
        "cast(floor((dayofyear(o_orderdate) - 1) / 7) + 1 as int) round",
        "cast(o_orderdate as date) match_date",
        "cast(o_custkey % 10 as int) home",
        "cast((o_custkey % 10 + 1 + o_orderkey % 9) % 10 as int) away",
        "cast(o_orderkey % 3 as int) ht_home",
        "cast(floor(o_orderkey / 3) % 3 as int) ht_away",
        "cast(o_orderkey % 3 + floor(o_custkey / 10) % 3 as int) ft_home",
        "cast(floor(o_orderkey / 3) % 3 + floor(o_orderkey / 9) % 3 as int) ft_away",
        f"cast(o_orderdate as date) < date '{TODAY}' played",
        "(o_orderstatus = 'P' and o_orderkey % 10 = 0) postponed",
    )


def team_view(fx: DataFrame) -> DataFrame:
    """One row a club and match, numbered in a season by date and id."""
    both = fx.withColumns({"team": F.col("home"), "opponent": F.col("away")}).unionByName(fx.withColumns({"team": F.col("away"), "opponent": F.col("home")}))
    order = Window.partitionBy("league", "team", "season").orderBy("match_date", "match_id")
    return both.withColumn("seq", F.row_number().over(order).cast("int"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, those of an order together: a line is dealt out as it is, which is less than a row of all odds with one of them filled."""
    return read(spark, sf_dir, "lineitem").repartition("l_orderkey")


def odds_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a match with twelve odds, some missing."""
    lines = _lines(spark, sf_dir)
    cols = [F.max(F.when(F.col("l_linenumber") == k, F.col("l_discount"))).alias(f"o{k}") for k in range(1, 8)]
    cols += [F.max(F.when(F.col("l_linenumber") == k, F.col("l_tax"))).alias(f"t{k}") for k in range(1, 6)]
    return lines.groupBy(F.col("l_orderkey").alias("match_id")).agg(*cols)


ALL_ODDS = [c["name"] for c in odds_columns()]


def catalogue_rule() -> list[tuple[str, float, float, str]]:
    """(name, base, factor, source) of every column of the catalogue: its odds are base + factor * source, of which the sources are the lines' measures.

    Columns take the lines in turn, so that a match with fewer lines lacks their columns; of 25 one follows the quantity, the others by
    sevens the discount and the tax.
    """
    rule = []
    for j, name in enumerate(ALL_ODDS):
        measure = "q" if j % 25 == 24 else "dx"[j // 7 % 2]
        rule.append((name, 1.25 + 0.25 * (j % 5), [0.5, 1.0, 2.0, 4.0][j % 4], f"{measure}{j % 7 + 1}"))
    return rule


def odds_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a match with all odds of the catalogue, some missing."""
    lines = _lines(spark, sf_dir)
    measures = {"d": "l_discount", "x": "l_tax", "q": "l_quantity"}
    cols = [F.max(F.when(F.col("l_linenumber") == k, F.col(c))).alias(f"{m}{k}") for m, c in measures.items() for k in range(1, 8)]
    per_match = lines.groupBy(F.col("l_orderkey").alias("match_id")).agg(*cols)
    return per_match.select("match_id", *[(F.lit(base) + F.lit(factor) * F.col(source)).alias(name) for name, base, factor, source in catalogue_rule()])


def full_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Played matches with all odds of the catalogue."""
    played = fixtures(spark, sf_dir).where("played").join(odds_full(spark, sf_dir), "match_id")
    return load_history(played, ALL_ODDS, [c for c in played.columns if c not in ALL_ODDS])


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Played matches with their odds."""
    played = fixtures(spark, sf_dir).where("played").join(odds_wide(spark, sf_dir), "match_id")
    return load_history(played, ODDS, [c for c in played.columns if c not in ODDS])
