"""Exact Jaccard join of word-shingle sets in the metric space of Jaccard distance, as connected components of near-equal texts.

Jaccard distance (1 - similarity) is a metric, but most texts are at distance 1 from any pivot, where no pivot tells them
apart. What can have no partner goes first, by two bounds that lose no link:

* Halving the universe of shingle hashes again and again, some slice of two linked sets is at least as similar as the whole sets
  are (the mean of ratios); slices of at most ``leaf`` shingles, where similarity below 1 is below the threshold, are then equal.
  A linked pair shares at least ``need`` equal slices, so a set with fewer slices that another one has, too, is alone.
* Of two linked sets each has at most ``1 - threshold`` of its shingles to itself, so a set with more shingles that no other has is alone.
  Of what is left, a linked pair shares one of the first shingles in the order of rarity (prefix filter).

The sets of one such shingle, and of all shingles with the same first member, are a region of the space. A region of over LEAF sets is
divided by pivots: all its members measure their distance to each pivot, the nearest pivot is a member's Voronoi cell, and a
member is replicated to every other cell in which a set within r = 1 - threshold of it can be: those whose pivot is at most 2r
further than the nearest, and at most r further than the cell's radius (triangle inequality). Pivots have met all and leave.
Cells are regions again, until they are small. A region in which all sets are about as far from each other does not get smaller; it is
compared block by block. In a region compared, sets inside one pivot's ball of radius r need not meet one another, and a
pair whose distances to a pivot differ by more than r can't be linked. Every link is checked on the two whole sets of 64-bit hashes.

Equal sets are one class from the start, so that copies cost no comparisons. Texts without words have an empty set and link
with nothing; a null doc_id is a document like others, in the classes of its text; equal ids with other texts are other documents.
Repeated rows are copies. An empty table gives no rows. Extra columns are ignored. A text is never cut: very long ones are hashed
in pieces, and blocks hold fewer of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, ship, small_batches, small_side, table, text_key
from .graph import components
from .shingles import mix, shingle_sets

#: Sets of a region that are compared without pivots.
LEAF = 300
#: Pivots of a region, about.
PIVOTS = 12
#: Sets and shingles of a block; blocks of a region meet pairwise, each pair in a task's memory.
BLOCK, BLOCK_SHINGLES = 400, 2_000_000


def leaf_size(threshold: float) -> int:
    """The most elements of a union that can't be as similar as the threshold without being equal."""
    b = 1
    while b / (b + 1) < threshold - 1e-12:
        b += 1
    return b


def regions(sets: list[np.ndarray], threshold: float) -> list[np.ndarray]:
    """Hash of each slice of each set that has at most leaf elements, under a slice that could count as larger."""
    leaf = leaf_size(threshold)
    larger = math.ceil(threshold * (leaf + 1) - 1e-9)
    size = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), size)
    h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    active = np.repeat(size, size) >= larger
    doc, h = doc[active], h[active]
    docs, keys, depth = [], [], 0
    while len(h) and depth < 63:
        depth += 1
        part = h >> np.uint64(64 - depth)
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]))))
        n = np.diff(np.append(first, len(h)))
        total = np.add.reduceat(mix(h), first)
        small = n <= leaf
        docs.append(doc[first[small]])
        keys.append(mix(total[small] + np.uint64(depth * 0x9E3779B97F4A7C15 & (2**64 - 1))))
        go = np.repeat(n >= larger, n)
        doc, h = doc[go], h[go]
    if not docs:
        return [np.empty(0, np.int64) for _ in sets]
    docs_, keys_ = np.concatenate(docs), np.concatenate(keys)
    order = np.argsort(docs_, kind="stable")
    cuts = np.searchsorted(docs_[order], np.arange(1, len(sets)))
    return np.split(keys_[order].view(np.int64), cuts)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _signature(s: np.ndarray) -> int:
    return int(mix(np.array([np.add.reduce(mix(s + np.uint64(1))) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) if len(s) else 0


def _sets(width: int, keep: list[str], items: bool):
    """keep, n, sig and, with items, the hashes of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                sets = shingle_sets(part.column("text"), width)
                cols = [*[part.column(c) for c in keep], pa.array([len(s) for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, _lists([s.view(np.int64) for s in sets])] if items else cols, [*keep, "n", "sig", *["items"][: int(items)]])

    return run


def _cells(width: int, threshold: float):
    """cell, sig of each region that each text's set is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                sets = shingle_sets(b.slice(at, 200).column("text"), width)
                cells = regions(sets, threshold)
                sig = np.repeat(np.array([_signature(s) for s in sets], np.int64), [len(c) for c in cells])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(sig)], ["cell", "sig"])

    return run


def near_classes(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, component_id, key and first_key (of the row to keep of its class) for every row of docs."""
    ship(docs.sparkSession)
    with small_batches(docs.sparkSession):
        return _near_classes(docs, width, threshold)


def _near_classes(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    tables = Tables(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key().alias("key"))
    slim = tables.write(keyed.mapInArrow(_sets(width, ["doc_id", "key"], False), "doc_id long, key long, n long, sig long"), "sets-of")
    by_sig = slim.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first"))
    links = linked(keyed, slim, width, threshold, tables)
    if links is not None:
        named = tables.write(by_sig.join(components(links, tables).withColumnRenamed("node", "sig"), "sig", "left"), "named")
        top = tables.write(named.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("_least"), F.min("first").alias("_first")), "tops")
        by_sig = named.join(top, "label", "left").select("sig", F.coalesce("_least", "least").alias("least"), F.coalesce("_first", "first").alias("first"))
    classes = tables.write(by_sig.select("sig", "least", F.col("first.key").alias("first_key")), "classes")
    some = slim.where("n > 0").join(classes, "sig").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), "key", "first_key")
    none = slim.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "key", F.col("key").alias("first_key"))
    return tables.result(some.unionByName(none), "components")


def candidates(keyed: DataFrame, slim: DataFrame, width: int, threshold: float, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Sets (sig, n, items) that can have a partner, and their first regions (region, node): all linked pairs meet in one."""
    percent, leaf = round(threshold * 100), leaf_size(threshold)
    below = (leaf - 1) / leaf
    share = (threshold - below) / (1 - below)  # of the union, at least, lies in equal slices
    need = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n") / leaf - 1e-9))
    # hashing the texts twice takes less than keeping all their slices; copies have one signature, so they do not crowd one
    cut = keyed.select("text").mapInArrow(_cells(width, threshold), "cell long, sig long")
    crowded = tables.write(cut.groupBy("cell").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("cell"), "crowded")
    met = cut.join(crowded, "cell").distinct().groupBy("sig").agg(F.count("*").alias("met"))
    reps = slim.where("n > 0").groupBy("sig").agg(F.min("key").alias("key"), F.min("n").alias("n"))
    near = tables.write(reps.join(met, "sig").where(F.col("met") >= need).select("key", "sig"), "near")
    texts = keyed.select("key", "text").join(small_side(near.select("key")), "key", "left_semi").dropDuplicates(["key"])
    whole = tables.write(texts.mapInArrow(_sets(width, ["key"], True), "key long, n long, sig long, items array<long>").drop("key"), "whole")

    shingles = whole.select("sig", "n", F.explode("items").alias("h"))
    shared = tables.write(shingles.groupBy("h").agg(F.count("*").alias("f")).where("f > 1"), "shared")
    rare = shingles.join(shared, "h").groupBy("sig", "n").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("held"))
    first = F.expr(f"slice(held, 1, cast(greatest(size(held) + 1 - (({percent} * n + 99) div 100), 0) as int))")
    firsts = tables.write(rare.select("sig", F.explode(first).alias("x")).select("sig", "x.h"), "firsts")
    lead = tables.write(firsts.groupBy("h").agg(F.min_by("sig", F.xxhash64("sig")).alias("region"), F.count("*").alias("m")).where("m > 1").drop("m"), "lead")
    rows = tables.write(firsts.join(lead, "h").select("region", F.col("sig").alias("node")).distinct(), "regions")
    return whole.join(rows.select(F.col("node").alias("sig")).distinct(), "sig", "left_semi"), rows


def linked(keyed: DataFrame, slim: DataFrame, width: int, threshold: float, tables: Tables) -> DataFrame | None:
    """u, v: signatures of sets of one component, enough of them to connect each; None without any."""
    sets, rows = candidates(keyed, slim, width, threshold, tables)
    sets = tables.write(sets, "sets")
    # d: distances to the pivots of the region above; ball: within r of the pivot whose ball has most members
    rows = rows.select("region", "node", F.array().cast("array<double>").alias("d"), F.lit(False).alias("ball"))
    found, done = [], []
    while True:
        size = tables.write(rows.groupBy("region").agg(F.count("*").alias("m")).where(F.col("m") > LEAF), "large")
        if size.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(size, "region", "left_anti"))
        links, cells, rest = divide(rows.join(size, "region"), sets, threshold, tables)
        found.append(links)
        done.append(rest)
        rows = cells
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    found.append(compare(tables.write(every, "leaves"), sets, threshold, tables))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = tables.write(links.distinct(), "links")
    return None if links.isEmpty() else links


def divide(rows: DataFrame, sets: DataFrame, threshold: float, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links with pivots; the Voronoi cells with their boundaries as new regions; and regions that cells do not make smaller.

    rows: region, node, m (members), and what came of the region above.
    """
    percent, r = round(threshold * 100), 1 - threshold
    # as many as a region should have, by chance; one without any is not divided
    by_chance = F.pmod(F.xxhash64("region", "node"), F.greatest(F.lit(1), F.expr(f"m div {PIVOTS}"))) == 0
    whole = sets.select(F.col("sig").alias("node"), "items")
    pivots = tables.write(rows.where(by_chance).select("region", "node").join(whole, "node").groupBy("region").agg(F.sort_array(F.collect_list(F.struct("node", "items"))).alias("p")), "pivots")
    inside = rows.select("region", "m", "node").join(whole, "node").join(pivots, "region")
    met = F.transform("p", lambda q: F.struct(q["node"].alias("q"), F.size(F.array_intersect("items", q["items"])).alias("both"), F.size(q["items"]).alias("n")))
    inside = inside.select("region", "m", "node", F.size("items").alias("own"), met.alias("met"))
    far = F.transform("met", lambda x: F.struct((1 - x["both"] / (F.col("own") + x["n"] - x["both"])).alias("d"), x["q"].alias("q"), (100 * x["both"] >= percent * (F.col("own") + x["n"] - x["both"])).alias("near")))
    measured = tables.write(inside.select("region", "m", "node", far.alias("far")), "measured")

    links = measured.select("node", F.explode(F.filter("far", lambda x: x["near"])).alias("x")).select(F.least("node", "x.q").alias("u"), F.greatest("node", "x.q").alias("v")).where("u <> v")
    d = F.transform("far", lambda x: x["d"])
    home = measured.select("*", d.alias("d"), F.array_min("far").alias("home"), F.exists("far", lambda x: x["q"] == F.col("node")).alias("pivot"))
    home = home.where("NOT pivot").select("region", "m", "node", "far", "d", "home")
    radius = home.groupBy("region", F.col("home.q").alias("q")).agg(F.max("home.d").alias("radius")).groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("q", "radius"))).alias("radius"))
    wide = home.join(tables.write(radius, "radius"), "region")
    reach = F.filter("far", lambda x: x["d"] <= F.least(F.coalesce(F.try_element_at("radius", x["q"]), F.lit(-2.0)) + r, F.col("home.d") + 2 * r) + 1e-9)
    placed = tables.write(wide.select("region", "m", "node", "d", F.explode(reach).alias("x")).select("region", "m", F.xxhash64("region", "x.q").alias("cell"), "node", "d", F.col("x.near").alias("ball")), "placed")
    # a cell of sets that are all in its pivot's ball is done; so is one of a single set
    cells = placed.groupBy("region", "m", "cell").agg(F.count("*").alias("n"), F.count_if(~F.col("ball")).alias("outs")).where("n > 1 AND outs > 0")
    # a division has to halve the pairs at least, so that all levels together never compare more than the region has
    slow = tables.write(cells.groupBy("region", "m").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs")).where("2 * pairs > cast(m AS double) * m").select("region"), "slow")
    smaller = placed.join(tables.write(cells.join(slow, "region", "left_anti").select("cell"), "cells"), "cell").select(F.col("cell").alias("region"), "node", "d", "ball")
    # the others stay whole, with the largest ball as the one whose members need not meet
    balls = measured.join(slow, "region", "left_semi").select("region", F.explode("far").alias("x")).where("x.near").groupBy("region", F.col("x.q").alias("q")).agg(F.count("*").alias("k"))
    main = tables.write(balls.groupBy("region").agg(F.max_by("q", F.struct("k", "q")).alias("q")), "balls")
    rest = home.join(main, "region").select("region", "node", "d", F.exists("far", lambda x: x["near"] & (x["q"] == F.col("q"))).alias("ball"))
    bare = rows.join(pivots.select("region"), "region", "left_anti").select("region", "node", "d", "ball")
    return links, tables.write(smaller, "smaller"), tables.write(rest.unionByName(bare), "rest")


def compare(rows: DataFrame, sets: DataFrame, threshold: float, tables: Tables) -> DataFrame:
    """u, v: enough links of the sets of each region to connect its components."""
    sized = rows.join(sets.select(F.col("sig").alias("node"), F.size("items").alias("n")), "node")
    groups = sized.groupBy("region").agg(
        F.count_if("ball").alias("balls"), F.count_if(~F.col("ball")).alias("outs"), F.sum(F.when(F.col("ball"), F.col("n")).otherwise(0)).alias("nb"), F.sum(F.when(F.col("ball"), 0).otherwise(F.col("n"))).alias("no")
    ).where("balls + outs > 1 AND outs > 0")
    blocks = tables.write(groups.select("region", *[F.ceil(F.greatest(F.col(k) / BLOCK, F.col(n) / BLOCK_SHINGLES)).cast("int").alias(b) for k, n, b in (("outs", "no", "ko"), ("balls", "nb", "kb"))], (F.col("nb") + F.col("no")).alias("shingles")), "blocks")
    # blocks of sets outside the ball meet one another and the blocks inside it, which need not meet
    part = F.when(F.col("ball"), F.col("ko") + F.pmod(F.xxhash64("node"), F.greatest("kb", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.greatest("ko", F.lit(1)))).cast("int")
    placed = rows.join(blocks, "region").withColumn("part", part)
    other = F.explode(F.when(F.col("ball"), F.sequence(F.lit(0), F.col("ko") - 1)).otherwise(F.sequence(F.lit(0), F.col("ko") + F.col("kb") - 1)))
    placed = placed.withColumn("other", other).withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other"))
    alone = (F.col("ko") + F.col("kb")) <= 2
    total = blocks.agg(F.sum("shingles")).first()[0] or 0
    n_tasks = max(8, int(total) // BLOCK_SHINGLES + 1)
    task = F.when(alone, F.pmod(F.xxhash64("region"), F.lit(n_tasks))).otherwise(F.xxhash64("region", "a", "b"))
    sent = placed.select(task.alias("task"), "region", "a", "b", "part", "node", "ball", "d").join(sets.select(F.col("sig").alias("node"), "items"), "node")
    return sent.groupBy("task").applyInArrow(_meet(threshold), "u long, v long")


def _forest(good: np.ndarray) -> np.ndarray:
    """The least member of the component of each of the sets of a symmetric matrix of links."""
    n = len(good)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(good, label[None, :], n).min(axis=1, initial=n))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _meet(threshold: float):
    """Links among the sets of two blocks of a region, for each of the block pairs of a task."""
    percent, r = round(threshold * 100), 1 - threshold

    def run(rows: pa.Table) -> pa.Table:
        region, a, b, part, node = (rows.column(c).to_numpy() for c in ("region", "a", "b", "part", "node"))
        ball = rows.column("ball").to_numpy(zero_copy_only=False)
        items, dist = (rows.column(c).combine_chunks() for c in ("items", "d"))
        flat, at = items.flatten().to_numpy(), items.offsets.to_numpy() - items.offsets[0].as_py()
        ds, d_at = dist.flatten().to_numpy(), dist.offsets.to_numpy() - dist.offsets[0].as_py()
        size = np.diff(at)
        order = np.lexsort((b, a, region))
        new = np.flatnonzero((np.diff(region[order]) != 0) | (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)) + 1
        us, vs = [], []
        for q in np.split(order, new):
            one = a[q[0]] == b[q[0]]
            left, right = q[part[q] == a[q[0]]], q[part[q] == b[q[0]]]
            if not len(left) or not len(right) or len(left) + len(right) - one * len(left) < 2:
                continue
            both = left if one else np.concatenate((left, right))
            common = np.zeros((len(both), len(both)), np.float32)
            owner = np.repeat(np.arange(len(both)), size[both])
            _, column, times = np.unique(np.concatenate([flat[at[i] : at[i + 1]] for i in both.tolist()]), return_inverse=True, return_counts=True)
            shared = times[column] > 1
            column, owner = column[shared], owner[shared]
            column = np.unique(column, return_inverse=True)[1] if len(column) else column
            width = int(column.max()) + 1 if len(column) else 0
            for c in range(0, width, 4096):
                here = (column >= c) & (column < c + 4096)
                m = np.zeros((len(both), min(4096, width - c)), np.float32)
                m[owner[here], column[here] - c] = 1
                common += m @ m.T
            union = size[both][:, None] + size[both][None, :] - common
            good = (100 * common >= percent * union) & ~np.eye(len(both), dtype=bool)
            # members whose distances to a pivot differ by more than r can't be linked
            n_pivots = np.diff(d_at)[both]
            if len(both) and n_pivots.min(initial=0) == n_pivots.max(initial=0) > 0:
                far = np.stack([ds[d_at[i] : d_at[i + 1]] for i in both.tolist()])
                for k in range(far.shape[1]):
                    good &= np.abs(far[:, k][:, None] - far[:, k][None, :]) <= r + 1e-9
            # those inside the ball are linked by its pivot
            label = _forest(good | (ball[both][:, None] & ball[both][None, :]))
            name = node[both]
            i = np.flatnonzero((label != np.arange(len(both))) & ~(ball[both] & ball[both][label]))
            us += np.minimum(name[i], name[label[i]]).tolist()
            vs += np.maximum(name[i], name[label[i]]).tolist()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), 4, 0.85).select("doc_id", "n_shingles", "component_id")
