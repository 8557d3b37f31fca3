"""The corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, mixing and sharding, stage by stage.

Each stage reads what the one before kept, and all but the last return the columns of documents, extra ones included. A null or empty text is
never toxic, near another or a leak; it stays, and is dealt out like others. A null doc_id stays null. Of rows equal in id and text the
near-copy stage keeps one, and of near-equal texts the row of the smallest doc_id (of equal ids the smallest hash of the text). Very
long texts are read whole. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixturelake.llm.common import materialise, table, text_key
from fixturelake.llm.decontam import clean_documents
from fixturelake.llm.jaccard import near_classes
from fixturelake.llm.mixing import mixed
from fixturelake.llm.sharding import assign
from fixturelake.llm.toxicity import learn, without_toxic

#: Of word shingles in the near-duplicate stage.
WIDTH, SIMILARITY = 5, 0.8
QUALITY_DOMAIN = "CASE WHEN quality = 1 THEN 'high' ELSE 'low' END"
QUALITY_TARGETS = {"high": 0.92, "low": 0.08}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return without_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each group of near-equal texts; of rows with equal id and text any one."""
    first = near_classes(docs, WIDTH, SIMILARITY).where("key = first_key").select(F.col("key").alias("_key")).distinct()
    return docs.withColumn("_key", text_key()).dropDuplicates(["_key"]).join(first.hint("merge"), "_key", "left_semi").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says."""
    return mixed(docs, table(spark, sf_dir, "labels"), QUALITY_DOMAIN, QUALITY_TARGETS)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot."""
    return assign(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix_quality),
    ("sharding", into_shards),
]

#: SQL can't express the learnt toxicity scores; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
