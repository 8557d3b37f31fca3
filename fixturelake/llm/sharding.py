"""Two-pass external shuffle into training shards (law ``rows``).

Pass one scatters the rows over memory-sized buckets by a seeded hash of the row and, of equal rows, the number of their part.
Pass two shuffles each bucket in memory: a bucket is a partition of its own, whose number and the seed start Spark's ``shuffle``
(Fisher-Yates) on the bucket's rows in a fixed order, so that slots depend on rows and seed only, and a task that runs
again gives the same ones. Buckets are laid end to end: place ``g`` of the whole order goes to shard ``g % n_shards`` as slot
``g div n_shards``, so that shard counts are at most one apart and slots have no gaps. Only ids, sizes and checksums are
shuffled in buckets, not texts.

Nulls: a null text has size 1 and the checksum of the empty string; a null doc_id is an id like any other.
Equal rows are kept, each in its own place; which of them gets which is left open. Very long texts are read where they are, and
only ``assign`` and ``write_shards`` move them. An empty table gives no rows. Extra columns are ignored by the query and kept by
``assign`` and ``write_shards``, but for columns named shard and slot, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, numbered, table

N_SHARDS = 8
SEED = 20240607
#: Rows of a bucket, at least and at most, and the buckets from which they grow; a row takes 40 bytes, so a bucket 40 MB at most.
BUCKET_ROWS, MOST_ROWS, BUCKETS = 20_000, 1_000_000, 20_000
#: Copies of a row that go to a bucket together.
PART_ROWS = 16
_KEY = ["doc_id", "text_crc32", "size"]


def _slim(docs: DataFrame) -> list:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]


def _placed(docs: DataFrame, seed: int, bucket_rows: int | None) -> DataFrame:
    """doc_id, size, text_crc32, nth (of equal rows, from 1), place (in the whole order) for every row."""
    tables = Tables(docs.sparkSession)
    slim = tables.write(docs.select(*_slim(docs)), "shard-slim")
    total = slim.count()
    rows = bucket_rows or min(MOST_ROWS, max(BUCKET_ROWS, total // BUCKETS))
    n_buckets = max(1, -(-total // rows))
    # equal rows are counted and dealt in parts of PART_ROWS, so that no bucket grows with a row's copies
    part = F.explode(F.sequence(F.lit(0), F.expr(f"cast((copies - 1) div {PART_ROWS} as int)")))
    keyed = slim.groupBy(*_KEY).agg(F.count("*").alias("copies")).select("*", part.alias("part"))
    keyed = keyed.withColumn("copies", F.least(F.lit(PART_ROWS), F.col("copies") - F.col("part") * F.lit(PART_ROWS)).cast("int"))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), *_KEY, "part"), F.lit(n_buckets)).cast("int"))
    # one row a bucket: some ten thousand, or one for a million rows
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("bucket").agg(F.sum("copies").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    one = F.struct("doc_id", "text_crc32", "size", "part", "copies")
    buckets = keyed.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket").agg(F.sort_array(F.collect_list(one)).alias("rows"))
    copies = F.transform("rows", lambda r: F.transform(F.sequence(F.lit(1), r["copies"]), lambda k: F.struct(r["doc_id"].alias("doc_id"), r["text_crc32"].alias("text_crc32"), r["size"].alias("size"), (r["part"] * F.lit(PART_ROWS) + k).cast("long").alias("nth"))))
    mixed = buckets.select("bucket", F.flatten(copies).alias("rows")).withColumn("rows", F.shuffle("rows", F.lit(seed)))
    out = mixed.join(starts, "bucket").select("first", F.posexplode("rows").alias("at", "row")).select("row.*", (F.col("first") + F.col("at")).alias("place"))
    return tables.result(out, "shard-slots")


def shard_slots(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, bucket_rows: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    return _placed(docs, seed, bucket_rows).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % n_shards).cast("int").alias("shard"),
        F.expr(f"place div {int(n_shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, seed: int = SEED) -> None:
    """Write the texts, one folder a shard, in slot order within each file range."""
    (
        assign(docs, n_shards, seed)
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


def assign(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """docs with shard and slot added; rows with the same id and text are numbered to join one to one."""
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    slots = _placed(docs, seed, None)
    slots = slots.select(*[F.col(k).alias(f"_slot_{k}") for k in [*_KEY, "nth"]], (F.col("place") % n_shards).cast("int").alias("shard"), F.expr(f"place div {int(n_shards)}").alias("slot"))
    own = dict(zip([f"_own_{k}" for k in ("doc_id", "size", "text_crc32")], _slim(docs), strict=True))
    left = numbered(docs.select(*keep).withColumns(own), [f"_own_{k}" for k in _KEY], "_own_nth")
    same = [left[f"_own_{k}"].eqNullSafe(slots[f"_slot_{k}"]) for k in [*_KEY, "nth"]]
    return left.join(slots, same).select(*keep, "shard", "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_slots(table(spark, sf_dir, "documents"))


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, slots and their gaps, and bytes of all shards: what the law says, which SQL can express."""
    slots = shard_slots(table(spark, sf_dir, "documents"))
    each = slots.groupBy("shard").agg(F.count("*").alias("n_rows"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots"), F.sum("size").alias("own"))
    return each.select("shard", "n_rows", "last_slot", "n_slots", F.sum("own").over(Window.partitionBy()).alias("all_bytes"))


SHARD_COUNTS_SQL = f"""WITH t AS (SELECT count(*) AS n, sum(coalesce(octet_length(encode(text)), 0) + 1) AS b FROM documents), s AS (SELECT unnest(range({N_SHARDS})) AS shard),
c AS (SELECT CAST(shard AS INT) AS shard, CAST(n // {N_SHARDS} + (shard < n % {N_SHARDS})::INT AS BIGINT) AS n_rows, CAST(b AS BIGINT) AS all_bytes FROM s, t)
SELECT shard, n_rows, n_rows - 1 AS last_slot, n_rows AS n_slots, all_bytes FROM c WHERE n_rows > 0"""
