"""Substring deduplication by content-defined chunks.

A gear rolling hash over the bytes of each text cuts it where hash bits are zero, so that cuts depend on the last 32 bytes only
and find each other again after an insertion. Chunks are MIN to MAX bytes long. A chunk whose 128-bit digest occurs
elsewhere is repeated; of each digest the occurrence in the smallest (doc_id, position) stays. Repeated chunks are removed where consecutive ones together have at least MIN_RUN bytes or cover a whole text, so that a passage of
some 50 words and a copy of a short text are caught and a chance phrase is left alone.

Digests that have more than one FREQUENT-th part of the chunks of a sample of the documents, fewer than FREQUENT therefore, are counted
where they are read and their first places sent to every task; the others meet by a shuffle, in which none has much more than that part of all
chunks. The sample decides only which way a digest goes.

A document is named by id and text, so equal ids with other texts are documents of their own; a null id comes first. Of repeated rows one
stays and the others are repeated whole. Null and empty texts have no chunks. Very long texts are hashed in pieces. An
empty table gives no rows. Extra columns are ignored by ``repeated_spans`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, numbered, ship, small_batches, table, text_key

MIN, MAX = 8, 192
MASK_BITS = 4
MIN_RUN = 64
#: Bit of a place's length that marks a text's last chunk.
LAST = 1 << 11
#: Digests that are sent to every task (16 MB), at most: those with more than this part of the chunks of a sample of SAMPLE of the documents.
FREQUENT, SAMPLE = 1_000_000, 0.01

_GEAR = np.random.Generator(np.random.PCG64(99)).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sum of gear values of the last 32 bytes, shifted by age."""
    h = _GEAR[data]
    for k in range(5):
        n = 1 << k
        if len(h) > n:
            add = h[:-n] << np.uint32(n)
            h[n:] += add
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    n = len(data)
    if not n:
        return []
    marks = np.concatenate([np.flatnonzero(gear(data[max(0, a - 32) : a + (1 << 20)])[a - max(0, a - 32) :] >> np.uint32(32 - MASK_BITS) == 0) + a + 1 for a in range(0, n, 1 << 20)])
    out, last = [], 0
    for m in marks.tolist():
        while m - last > MAX:
            last += MAX
            out.append(last)
        if m - last >= MIN:
            out.append(m)
            last = m
    while n - last > MAX:
        last += MAX
        out.append(last)
    if last < n:
        out.append(n)
    return out


def among(d: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Which digests (rows of two longs) are in ``often``, which is in order."""
    found = np.zeros(len(d), bool)
    if len(often):
        # first halves hardly ever agree, so that few steps look at all digests of one
        at = np.searchsorted(often[:, 0], d[:, 0])
        open_ = np.arange(len(d))
        while len(open_):
            open_ = open_[at[open_] < len(often)]
            open_ = open_[often[at[open_], 0] == d[open_, 0]]
            found[open_] |= often[at[open_], 1] == d[open_, 1]
            at[open_] += 1
    return found


def _chunk_rows(often: np.ndarray, inside: bool):
    """d1, d2, id, key, place of the chunks whose digest is in ``often``, or is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        # a place packs the start, whether the chunk is the text's last, and 11 bits of length
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                which, starts, ends, last, digests = [], [], [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    raw = (text or "").encode()
                    end = cuts(np.frombuffer(raw, np.uint8))
                    start = [0, *end[:-1]] if end else []
                    which.append(np.full(len(end), k, np.int64))
                    starts += start
                    ends += end
                    last += [0] * (len(end) - 1) + [LAST] if end else []
                    digests += [xxh3_128_digest(raw[s:e]) for s, e in zip(start, end, strict=True)]
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                s = np.array(starts, np.int64)
                place = s << 12 | np.array(last, np.int64) | (np.array(ends, np.int64) - s)
                of = np.concatenate(which)
                if len(often) or inside:
                    kept = among(d, often) == inside
                    d, place, of = d[kept], place[kept], of[kept]
                names = [part.column(c).take(pa.array(of)) for c in ("id", "key")]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(d[:, k])) for k in (0, 1)], *names, pa.array(place)], ["d1", "d2", "id", "key", "place"])

    return run


def repeated_spans(docs: DataFrame, min_run: int = MIN_RUN, sample: float = SAMPLE) -> DataFrame:
    """doc_id, key, spans (start, end of removed byte runs), n_repeated (bytes of chunks that occur elsewhere) of documents with any.

    The documents of repeated rows are looked at once; see ``deduplicated`` for their copies.
    """
    ship(docs.sparkSession)
    with small_batches(docs.sparkSession):
        return _repeated_spans(docs, min_run, sample)


def _repeated_spans(docs: DataFrame, min_run: int, sample: float) -> DataFrame:
    tables = Tables(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), text_key().alias("key"), "text")
    cut = lambda df, often, inside: df.mapInArrow(_chunk_rows(often, inside), "d1 long, d2 long, id long, key long, place long")
    none = np.empty((0, 2), np.int64)
    some = cut(keyed.where(F.pmod(F.col("key"), F.lit(1_000_000)) < int(sample * 1_000_000)), none, False)
    counts = tables.write(some.groupBy("d1", "d2").agg(F.count("*").alias("n")), "sampled")
    least = max(20, (counts.agg(F.sum("n")).first()[0] or 0) // FREQUENT)
    often = counts.where(F.col("n") > least).select("d1", "d2").toArrow()
    often = np.stack([often[c].to_numpy() for c in ("d1", "d2")], axis=1)
    often = often[np.lexsort((often[:, 1], often[:, 0]))]
    ends = [F.min(F.struct("id", "key", "place")).alias("first"), F.max(F.struct("id", "key", "place")).alias("last")]
    hot = tables.write(cut(keyed, often, True), "frequent-places")
    first = tables.write(hot.groupBy("d1", "d2").agg(*ends).where("first <> last").select("d1", "d2", "first"), "frequent-firsts")
    rare = cut(keyed, often, False).repartition("d1", "d2")  # one shuffle for both sides of the join
    met = rare.groupBy("d1", "d2").agg(*ends).where("first <> last").select("d1", "d2", "first")
    place = [F.expr("shiftright(place, 12)").alias("s"), F.expr(f"place & {LAST - 1}").alias("n"), F.expr(f"place & {LAST} <> 0").alias("last"), (F.struct("id", "key", "place") == F.col("first")).alias("stays")]
    again = rare.join(met, ["d1", "d2"]).unionByName(hot.join(F.broadcast(first), ["d1", "d2"])).select("id", "key", *place)
    lists = again.distinct().groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("s", "n", "last", "stays"))).alias("c"))
    # runs: a chunk opens one unless the chunk before ends where it starts
    runs = lists.select("id", "key", F.expr("aggregate(c, 0L, (a, x) -> a + x.n)").alias("n_repeated"), F.expr("filter(c, x -> not x.stays)").alias("r"))
    runs = runs.select("id", "key", "n_repeated", "r", F.expr("filter(transform(r, (x, k) -> if(k = 0 OR r[k - 1].s + r[k - 1].n <> x.s, k, -1)), k -> k >= 0)").alias("at"))
    end = "r[if(k = size(at) - 1, size(r), at[k + 1]) - 1]"
    spans = f"filter(transform(at, (a, k) -> struct(r[a].s as s, {end}.s + {end}.n as e, {end}.last as last)), x -> x.e - x.s >= {int(min_run)} OR (x.s = 0 AND x.last))"
    spans = f"transform({spans}, x -> struct(x.s as s, x.e as e))"
    return tables.result(runs.select(F.col("id").alias("doc_id"), "key", "n_repeated", F.expr(spans).alias("spans")), "spans")


def _cut_out(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for text, spans, nth in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist(), b.column("_nth").to_pylist(), strict=True):
            if nth > 1 and text:
                text = ""
            elif spans:
                raw, at, parts = (text or "").encode(), 0, []
                for s in spans:
                    parts.append(raw[at : s["s"]])
                    at = s["e"]
                text = (b"".join(parts) + raw[at:]).decode(errors="ignore")
            texts.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in columns], columns)


def deduplicated(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """docs with repeated runs cut out of their texts; of repeated rows all but one lose their whole text."""
    spans = repeated_spans(docs, min_run).select(F.col("key").alias("_of"), F.col("spans").alias("_spans"))
    columns = docs.columns
    rows = numbered(docs.withColumn("_key", text_key()), ["_key"], "_nth")
    return rows.join(spans, F.col("_key") == F.col("_of"), "left").select(*[rows[c] for c in columns], "_spans", "_nth").mapInArrow(lambda it: _cut_out(it, columns), docs.schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    # one row for each different document, with how often it stands in the table
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), size.alias("n_bytes")).groupBy("doc_id", "key", "n_bytes").agg(F.count("*").alias("times"))
    rows = slim.join(repeated_spans(docs).drop("doc_id"), "key", "left").withColumn("nth", F.explode(F.expr("sequence(1L, times)")))
    again = F.col("nth") > 1
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("times") > 1, F.col("n_bytes")).otherwise(F.coalesce("n_repeated", F.lit(0))).cast("long").alias("n_repeated"),
        F.when(again, F.col("n_bytes")).otherwise(F.expr("coalesce(aggregate(spans, 0L, (a, x) -> a + x.e - x.s), 0L)")).alias("n_removed"),
        F.when(again, F.signum("n_bytes")).otherwise(F.expr("coalesce(size(spans), 0)")).cast("long").alias("n_spans"),
    )
