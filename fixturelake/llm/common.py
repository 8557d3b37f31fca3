"""What the operators of this subpackage share: reading tables, cutting lineage, naming and numbering documents."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fixturelake import cluster
from fixturelake.cluster import Tables, drop_results, materialise, ship

__all__ = ["Tables", "drop_results", "materialise", "numbered", "ship", "small_batches", "small_side", "table", "text_key"]

#: Rows that are sent to every task at most; larger sides are joined by a shuffle.
FEW_ROWS = cluster.FEW_ROWS
#: Rows with equal keys that are numbered in one task; more are numbered where they are read.
MANY_COPIES = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Texts go to Python in batches of few rows, so that long ones fit in memory, in what runs inside; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_side(df: DataFrame, bound: int | None = None) -> DataFrame:
    """df, which has to be a written table, broadcast where it has few rows."""
    return cluster.small_side(df, FEW_ROWS if bound is None else bound)


def text_key() -> Column:
    """Names a document by id and text: rows that are equal in both are copies of one row."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def numbered(df: DataFrame, keys: list[str], name: str, many: int = MANY_COPIES) -> DataFrame:
    """df with the number, from 1, of each row among those with equal keys, in order of a hash of the whole row (maps left out).

    A key with over ``many`` rows is not brought to one task: its rows are numbered in each input partition, behind those
    of the partitions before. df is read twice, and has to give the same partitions both times, as a table does.
    """
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"])
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > many).drop("_n")
    tables = Tables(df.sparkSession)
    hot = tables.write(counts, "hot-keys")
    one = F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long")
    if hot.isEmpty():
        tables.drop()
        return df.withColumn(name, one)
    tables.keep()
    same = lambda side: [df[k].eqNullSafe(side[k]) for k in keys]
    side = small_side(hot)
    cold = df.join(side, same(side), "left_anti").withColumn(name, one)
    rows = df.join(side, same(side), "left_semi").withColumn("_part", F.spark_partition_id())
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    parts = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), "_before")
    rows = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)))
    on = [rows[k].eqNullSafe(parts[f"_k_{k}"]) for k in keys] + [rows["_part"] == parts["_p"]]
    return cold.unionByName(rows.join(parts, on).select(*df.columns, (F.col("_own") + F.col("_before")).alias(name)))

