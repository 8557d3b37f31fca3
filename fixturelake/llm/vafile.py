"""Centroid clustering over a VA-file: vectors are compressed to few-bit cells, and read in full where cells can't decide.

Components are integers, floor(scale * x). A cell of a dimension is one of 16 intervals between approximate percentiles of all vectors,
and a vector's cells take four bits each. For every centroid a lookup table gives the least and the greatest squared distance that a cell
of a dimension allows; their sums over the dimensions are an interval of the vector's distance. A vector goes to the only centroid whose
interval begins below the smallest interval's end; where several do, its full components are taken and compared exactly with those
centroids. The new centroid of a cluster needs the sum of all its vectors, so one scan of a round reads cells and components side by
side and nothing is joined or shuffled but a row of sums for each task and cluster. The percentiles move cells only, never a result.

Vectors that are null, of another length, or hold a null, NaN or infinite component are left out. A null vec_id hashes as an empty one and is
kept. Of equal hashes the smaller components come first; repeated rows are vectors of their own. Equal distances go to the smaller
centroid number. With fewer vectors than centroids there are as many centroids as vectors; an empty table gives no rows. Components of any finite
size are compared and summed exactly; a component is held at the range of a long, and a distance over it at its end; sums of distances
beyond it are null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, ship, table

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
#: Cells of a dimension: four bits.
CELLS = 16
#: Below this size squared distances and sums of a batch fit in 64 bits; above, Python's integers are used.
_NARROW = 1 << 27
_LONG = (1 << 63) - 1


def integer_vectors(df: DataFrame, dims: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, comps of the vectors that have ``dims`` finite components."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.where((F.size(v) == dims) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("comps"))


def cell_edges(vectors: DataFrame, dims: int) -> list[list[int]] | None:
    """For each dimension the first component of each cell, and one more than the last of all; None without vectors."""
    at = [F.element_at("comps", d + 1) for d in range(dims)]
    shares = [k / CELLS for k in range(1, CELLS)]
    every = vectors.agg(*[F.array(F.min(x), F.max(x)).alias(f"ends{d}") for d, x in enumerate(at)], *[F.percentile_approx(x, shares, 1000).alias(f"inner{d}") for d, x in enumerate(at)]).first()
    if every["ends0"][0] is None:
        return None
    # edges may be equal: the cells between them are empty
    return [[every[f"ends{d}"][0], *every[f"inner{d}"], every[f"ends{d}"][1] + 1] for d in range(dims)]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dims)


def packed_cells(vectors: np.ndarray, edges: list[list[int]]) -> np.ndarray:
    """The cells of each vector, two in a byte."""
    codes = np.empty(vectors.shape, np.uint8)
    for d, e in enumerate(edges):
        codes[:, d] = np.searchsorted(np.array(e[1:-1], np.int64), vectors[:, d], "right")
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] << 4 | codes[:, 1::2]


def unpacked_cells(packed: np.ndarray, dims: int) -> np.ndarray:
    return np.stack([packed >> 4, packed & 15], 2).reshape(len(packed), -1)[:, :dims]


def lookup_tables(centroids: list[list[int]], edges: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """low, high[dimension, cell, centroid]: bounds of the squared distance of a component in the cell, a little wide for rounding."""
    bounds = np.array([[e[:-1], [x - 1 for x in e[1:]]] for e in edges], float)
    first, last = bounds[:, 0, :, None], bounds[:, 1, :, None]
    c = np.array(centroids, float).T[:, None, :]
    low = np.maximum(np.maximum(first - c, c - last), 0) ** 2
    high = np.maximum(np.abs(c - first), np.abs(c - last)) ** 2
    return low * (1 - 1e-9), high * (1 + 1e-9)


def distances(vectors: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of every vector to every centroid."""
    wide = max(int(np.abs(vectors.astype(float)).max(initial=0)), max((abs(x) for c in centroids for x in c), default=0)) >= _NARROW
    kind = object if wide else np.int64
    v, c = vectors.astype(kind), np.array(centroids, kind)
    return np.stack([((v - x) ** 2).sum(1) for x in c], 1)


def nearest(cells: np.ndarray, full, centroids: list[list[int]], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each vector, and how many vectors were fetched: full(rows) gives the components of rows where intervals overlap."""
    least, most = np.zeros((len(cells), len(centroids))), np.zeros((len(cells), len(centroids)))
    for d in range(cells.shape[1]):
        least += low[d][cells[:, d]]
        most += high[d][cells[:, d]]
    may = least <= most.min(1)[:, None]
    out = may.argmax(1)
    open_ = np.flatnonzero(may.sum(1) > 1)
    if len(open_):
        exact = distances(full(open_), centroids)
        out[open_] = np.where(may[open_], exact, exact.max() + 1).argmin(1)
    return out, len(open_)


def _coded(edges: list[list[int]], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = packed_cells(matrix(b.column("comps"), dims), edges)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([x.tobytes() for x in packed], pa.binary()), b.column("comps")], ["vec_id", "cells", "comps"])

    return run


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], edges: list[list[int]]):
    """Each batch with its components and clusters."""
    dims, tables = len(edges), lookup_tables(centroids, edges)
    for b in batches:
        if b.num_rows:
            packed = np.frombuffer(b"".join(b.column("cells").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            comps = b.column("comps")
            near, _ = nearest(unpacked_cells(packed, dims), lambda rows: matrix(comps.take(pa.array(rows)), dims), centroids, *tables)  # noqa: B023
            yield b, matrix(comps, dims), near


def _sums(centroids: list[list[int]], edges: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * len(centroids), np.zeros((len(centroids), len(edges)), object)
        for _, vectors, near in _assigned(batches, centroids, edges):
            wide = np.abs(vectors.astype(float)).max(initial=0) >= _NARROW
            for c in np.unique(near):
                own = vectors[near == c]
                count[c] += len(own)
                total[c] += own.astype(object).sum(0) if wide else own.sum(0).astype(object)
        rows = [(c, d, count[c], Decimal(int(total[c, d]))) for c in range(len(centroids)) if count[c] for d in range(len(edges))]
        kinds = pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["cluster", "dim", "n", "total"])

    return run


def _labelled(centroids: list[list[int]], edges: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, vectors, near in _assigned(batches, centroids, edges):
            far = np.zeros(len(near), object)
            for c in np.unique(near):
                far[near == c] = distances(vectors[near == c], [centroids[c]])[:, 0]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(near, pa.int32()), pa.array([min(int(x), _LONG) for x in far], pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def clustered(df: DataFrame, dims: int = DIMENSIONS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector after ``rounds`` rounds from k hashed starts."""
    spark = df.sparkSession
    ship(spark)
    vectors, tables = integer_vectors(df, dims, scale), Tables(spark)
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r["comps"]) for r in vectors.orderBy(start, "comps").limit(k).collect()]
    edges = cell_edges(vectors, dims)
    if edges is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    file = tables.write(vectors.mapInArrow(_coded(edges, dims), "vec_id long, cells binary, comps array<long>"), "va-file")
    for _ in range(rounds):
        parts = file.mapInArrow(_sums(centroids, edges), "cluster int, dim int, n long, total decimal(38,0)")
        # at most k * dims rows
        for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            centroids[r["cluster"]][r["dim"]] = int(r["total"]) // r["n"]
    last = file.mapInArrow(_labelled(centroids, edges), "vec_id long, cluster int, distance long")
    last = tables.result(last, "clusters")
    inertia = {r["cluster"]: r["inertia"] for r in last.groupBy("cluster").agg(F.try_sum("distance").alias("inertia")).collect()}
    every = None if None in inertia.values() or sum(inertia.values()) > _LONG else sum(inertia.values())
    rows = [(c, i, every, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, i in inertia.items()]
    # one row a centroid
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))
