"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(edges: DataFrame, owner: Tables | None = None) -> DataFrame:
    """node, label: the smallest node reachable from each node of the edges (u, v).

    Labels are parents. Each round a node and its parent both take the least grandparent of the node's neighbours, and
    a node its own grandparent, until no label changes: then all trees are stars and every edge lies in one of them.
    As roots are hooked too, a long chain merges in pieces that grow from round to round instead of hop by hop. Labels are
    written to the shared folder each round, the ones before are deleted, and only whether any changed reaches the driver.
    The labels returned are a table of ``owner``, or stay until ``drop_results``.
    """
    tables = Tables(edges.sparkSession)
    both = tables.write(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    labels = tables.write(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        parents = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        wide = labels.join(parents, "label")
        near = both.join(wide.select(F.col("node").alias("v"), "far"), "v").groupBy(F.col("u").alias("node")).agg(F.min("far").alias("near"))
        step = wide.join(near, "node").select("node", F.col("label").alias("old"), F.least("far", "near").alias("label"), "near")
        hooks = step.groupBy(F.col("old").alias("node")).agg(F.min("near").alias("hook"))
        new = tables.write(step.join(hooks, "node", "left").select("node", "old", F.least("label", F.coalesce("hook", "label")).alias("label")), "labels")
        tables.drop(1, 2)
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            tables.drop(0, 1)
            if owner:
                owner.paths += tables.paths
            else:
                tables.keep()
            return labels
