"""Suffix-array deduplication: bytes covered by a WIDTH-byte string that starts anywhere else too.

Every window of WIDTH bytes is sent where equal windows go: it is named by the least hash of its GRAM-byte substrings
(its anchor), and runs of windows with one anchor travel as one segment. Segments whose anchor occurs once are alone;
equal segments are counted, not repeated. Different segments of one anchor can only share a window if they agree in a longer
substring at the same place beside the anchor: a window that begins o bytes before it holds the WIDTH - d bytes from d * (o // d)
before it on, d being a BANDS-th of the places. Hashes of these BANDS substrings travel with a segment, and those that agree with
another meet in a shard, where induced sorting builds the suffix
array and permuted common prefixes of WIDTH or more mark repeated windows. A common passage shorter than WIDTH - d bytes thus sends
no bytes anywhere. Shards hold about SHARD bytes, and their number
grows with the input. Where an anchor has more than HOT bytes of different segments, these are cut again as texts of their own,
by anchors of longer substrings, which fewer windows share, up to whole windows: one anchor then has one window.

A segment that is longer than one anchor allows repeats its anchor. Its windows that are equal to an earlier one of the segment, byte by
byte, are marked at once and left out, so that a text that repeats one pattern for ever is sent as its pattern.

Matches never cross documents; overlapping matches in one text count. Very long texts are searched for anchors in pieces of
SLICE bytes. Null and empty texts, and texts shorter than
WIDTH, lose nothing. A repeated row is another document, so both lose all if they have WIDTH bytes. A null doc_id is kept as null. An
empty table gives no rows. Extra columns are ignored by ``cut_spans`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, ship, small_batches, small_side, table
from .shingles import mix

WIDTH = 400
GRAM = 64
#: Substrings beside an anchor of which windows that share the anchor have one in common.
BANDS = 4
SHARD = 1_000_000
HOT = 3_000_000
#: Bytes of text that are searched for anchors at a time.
SLICE = 1 << 20

_U = np.uint64
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _sums(data: np.ndarray) -> np.ndarray:
    """Sums of weighted bytes, of which differences are the hashes of substrings."""
    n = len(data)
    if not _powers or len(_powers[0]) <= n:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, SLICE + WIDTH) + 2, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers[0][:n], out=total[1:])
    return total


def _window_hashes(total: np.ndarray, width: int) -> np.ndarray:
    return mix((total[width:] - total[:-width]) * _powers[1][: len(total) - width])


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` bytes."""
    return _window_hashes(_sums(data), width) if len(data) >= width else np.empty(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x)
    pad = (-n) % width
    blocks = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _bands(total: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For segments whose anchors stand at ``at`` and whose windows begin from ``first`` to ``last``: hashes of the substrings one of
    which each window holds; 0 where none of the windows needs it."""
    step = -(-(width - gram) // BANDS)
    begin = at[:, None] - step * np.arange(BANDS)
    on = (first[:, None] <= begin) & (last[:, None] >= begin - step)
    x = begin[on]
    out = np.zeros(on.shape, np.uint32)
    out[on] = (mix((total[x + width - step] - total[x]) * _powers[1][x]) >> _U(32)) | _U(1)
    return out.view(np.int32)


def segments(raw: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor, first byte and end of each segment of a text, whether its anchor stands in it more than once, and its ``_bands``."""
    anchors, starts, ends, doubles, bands = [], [], [], [], []
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, max(0, len(data) - width + 1), SLICE):
        part = data[at : at + SLICE + width - 1]
        total = _sums(part)
        grams, span = _window_hashes(total, gram), width - gram + 1
        least = sliding_min(grams, span)
        # a gram is the least of some window if the largest least of its windows is its own
        edge = np.zeros(span - 1, np.uint64)
        places = np.flatnonzero(~sliding_min(~np.concatenate((edge, least, edge)), span) == grams)
        chosen = grams[places]
        other = np.concatenate(([True], chosen[1:] != chosen[:-1]))
        again = chosen[~other]
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        anchors.append(least[first].view(np.int64))
        doubles.append(np.isin(least[first], again) if len(again) else np.zeros(len(first), bool))
        starts.append(first + at)
        ends.append(np.append(first[1:], len(least)) + at + width - 1)
        # the least grams follow each other as the windows' segments do
        bands.append(_bands(total, places[other], first, np.append(first[1:], len(least)) - 1, width, gram))
    if not anchors:
        return (*(np.empty(0, np.int64),) * 3, np.empty(0, bool), np.empty((0, BANDS), np.int32))
    return tuple(np.concatenate(x) for x in (anchors, starts, ends, doubles, bands))


def own_repeats(data: np.ndarray, width: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Byte ranges covered by windows that occur twice in ``data``, and ranges that hold one of each of its different windows."""
    hashes = window_hashes(data, width)
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    back = np.zeros(len(hashes), np.int64)  # how far back the window stands once more; 0 if it does not
    back[order[same + 1]] = order[same + 1] - order[same]
    edges = np.flatnonzero(np.diff(back)) + 1
    covered, kept, at = [], [], 0
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(back)], strict=True):
        p = int(back[a])
        # hashes only propose; a run of windows is left out where its bytes are those of p bytes before
        if p and np.array_equal(data[a : b + width - 1], data[a - p : b + width - 1 - p]):
            covered += [(a - p, b + width - 1 - p), (a, b + width - 1)]
            if at < a:
                kept.append((at, a + width - 1))
            at = b
    if at < len(back):
        kept.append((at, len(data)))
    return covered, kept


def _raw(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode()


def cut_segments(raw: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``segments``, those longer than one anchor allows without their own repeats; last whether a row is a range known to be repeated instead."""
    cols = segments(raw, width, gram)
    anchor, start, end = cols[:3]
    known = np.zeros(len(anchor), bool)
    long = np.flatnonzero(end - start > 2 * width - gram)
    if not len(long):
        return (*cols, known)
    none = np.zeros(BANDS, np.int32)
    data, rows = np.frombuffer(raw, np.uint8), []
    for x, s, e in zip(anchor[long].tolist(), start[long].tolist(), end[long].tolist(), strict=True):
        covered, kept = own_repeats(data[s:e], width)
        rows += [(x, s + a, s + b, True, none, True) for a, b in covered] + [(x, s + a, s + b, True, none, False) for a, b in kept]
    return tuple(np.concatenate((np.delete(c, long, 0), np.array(more, c.dtype))) for c, more in zip((*cols, known), zip(*rows, strict=True), strict=True))


def _segment_rows(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            cols: list[list] = [[] for _ in range(6 + BANDS)]
            digests: list[bytes] = []
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = _raw(text)
                anchor, start, end, double, bands, known = cut_segments(raw, width, gram)
                for c, v in zip(cols, (anchor, np.full(len(anchor), key, np.int64), start, end, double, known, *bands.T), strict=True):
                    c.append(v)
                digests += [xxh3_128_digest(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            kinds = [*[pa.int64()] * 4, *[pa.bool_()] * 2, *[pa.int32()] * BANDS]
            whole = [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*whole, pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))], ["anchor", "key", "s", "e", "double", "known", *_BAND_NAMES, "d1", "d2"])

    return run


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [
            (w["anchor"], w["d1"], w["d2"], raw[w["s"] : w["e"]])
            for raw, wanted in ((_raw(t), w) for t, w in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True))
            for w in wanted
        ]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "d1", "d2", "piece"])


def _intervals(flags: np.ndarray, width: int) -> list[dict]:
    """Covered byte ranges of a piece from its repeated windows."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > width)
    first, last = at[np.concatenate(([0], gap + 1))], at[np.append(gap, len(at) - 1)]
    return [{"a": int(a), "b": int(b) + width} for a, b in zip(first, last, strict=True)]


_BAND_NAMES = [f"b{b}" for b in range(BANDS)]
_SEGMENTS_SQL = f"anchor long, key long, s long, e long, double boolean, known boolean, {', '.join(f'{b} int' for b in _BAND_NAMES)}, d1 long, d2 long"
_SPANS_SQL = "array<struct<a:bigint,b:bigint>>"
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _shard_rows(width: int):
    def run(shard: pa.Table) -> pa.Table:
        from .suffix_array import repeated_windows

        flags = repeated_windows(shard.column("piece").to_pylist(), width)
        spans = pa.array([_intervals(f, width) for f in flags], _SPANS)
        return pa.table({"anchor": shard.column("anchor"), "d1": shard.column("d1"), "d2": shard.column("d2"), "spans": spans})

    return run


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def cut_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD, hot_bytes: int = HOT) -> DataFrame:
    """key, spans: the maximal byte ranges (a, b) to remove, of documents with any."""
    ship(docs.sparkSession)
    with small_batches(docs.sparkSession, 200), Tables(docs.sparkSession) as tables:
        ranges = _repeated_ranges(tables, docs.select(_key().alias("key"), "text"), width, min(gram, max(1, width // 2)), shard_bytes, hot_bytes)
        return tables.result(_merged(ranges), "spans")


def _repeated_ranges(tables: Tables, texts: DataFrame, width: int, gram: int, shard_bytes: int, hot_bytes: int) -> DataFrame:
    """key, r: byte ranges (a, b) of repeated windows of texts (key, text), with overlaps."""
    cut = tables.write(texts.mapInArrow(_segment_rows(width, gram), _SEGMENTS_SQL), "segments")
    segments = cut.where("NOT known")
    kinds = segments.groupBy("anchor", "d1", "d2").agg(F.count("*").alias("times"), F.min(F.struct("key", "s", "e", *_BAND_NAMES)).alias("one"), F.bool_or("double").alias("double"))
    kinds = tables.write(kinds, "kinds")
    met = tables.write(_met(tables, kinds), "met")
    bytes_of = met.groupBy("anchor").agg(F.sum(F.expr("one.e - one.s")).alias("bytes"))
    # segments of one content that is met twice are repeated whole
    wanted = met.groupBy(F.col("one.key").alias("key")).agg(F.collect_list(F.struct("anchor", "d1", "d2", F.col("one.s").alias("s"), F.col("one.e").alias("e"))).alias("wanted"))
    wanted = tables.write(wanted, "wanted")
    # where few texts have segments to compare, only these are shuffled
    holders = texts.join(small_side(wanted.select("key")), "key", "left_semi")
    pieces = holders.join(wanted, "key").select("text", "wanted").mapInArrow(_piece_rows, "anchor long, d1 long, d2 long, piece binary").dropDuplicates(["anchor", "d1", "d2"])
    pieces = tables.write(pieces.join(bytes_of, "anchor"), "pieces")
    crowded = F.col("bytes") > (hot_bytes if gram < width else math.inf)
    total = pieces.where(~crowded).agg(F.sum(F.length("piece"))).first()[0] or 0
    n_shards = max(1, -(-total // shard_bytes))
    shards = pieces.where(~crowded).select(F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).alias("shard"), "anchor", "d1", "d2", "piece")
    found = shards.groupBy("shard").applyInArrow(_shard_rows(width), f"anchor long, d1 long, d2 long, spans {_SPANS_SQL}")
    hot = pieces.where(crowded).select("anchor", "d1", "d2", F.xxhash64("anchor", "d1", "d2").alias("key"), F.col("piece").alias("text"))
    if not hot.isEmpty():
        # windows of one anchor part by anchors of longer substrings; those of a whole window are one content each
        again = _merged(_repeated_ranges(tables, hot.select("key", "text"), width, (gram + width + 1) // 2, shard_bytes, hot_bytes))
        found = found.unionByName(hot.drop("text").join(again, "key").select("anchor", "d1", "d2", "spans"))
    found = tables.write(found.where("size(spans) > 0"), "found")
    twins = kinds.where("times > 1").select("anchor", "d1", "d2", "times")
    marks = twins.join(found, ["anchor", "d1", "d2"], "full").select("anchor", "d1", "d2", F.when(F.col("times") > 1, F.lit(True)).otherwise(F.lit(False)).alias("all"), "spans")
    marks = tables.write(marks, "marks")  # a plain table, so that a segment of very many documents can be split in the join
    shifted = F.when(F.col("all"), F.array(F.struct(F.col("s").alias("a"), F.col("e").alias("b")))).otherwise(F.transform("spans", lambda x: F.struct((x["a"] + F.col("s")).alias("a"), (x["b"] + F.col("s")).alias("b"))))
    ranges = segments.join(marks, ["anchor", "d1", "d2"]).select("key", F.explode(shifted).alias("r"))
    return ranges.unionByName(cut.where("known").select("key", F.struct(F.col("s").alias("a"), F.col("e").alias("b")).alias("r")))


def _met(tables: Tables, kinds: DataFrame) -> DataFrame:
    """The kinds of segments that have to be compared: with the anchor twice in one of the anchor, or with a substring beside it that another kind has."""
    crowd = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.bool_or("double").alias("double")).where("kinds > 1 OR double")
    crowd = small_side(tables.write(crowd.select("anchor", "double"), "crowd"))
    near = tables.write(kinds.drop("times", "double").join(crowd, "anchor"), "near")
    bands = F.array(*[F.col(f"one.{b}") for b in _BAND_NAMES])
    held = near.where("NOT double").select("anchor", "d1", "d2", F.posexplode(bands).alias("band", "hash")).where("hash <> 0")
    shared = held.groupBy("anchor", "band", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    agree = held.join(shared, ["anchor", "band", "hash"]).select("anchor", "d1", "d2").distinct()
    return near.where("double").drop("double").unionByName(near.where("NOT double").drop("double").join(agree, ["anchor", "d1", "d2"], "left_semi"))


def _merged(ranges: DataFrame) -> DataFrame:
    """key, spans: a text's ranges in order; one opens a span if it starts past all before."""
    lists = ranges.distinct().groupBy("key").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return lists.mapInArrow(_merge, f"key long, spans {_SPANS_SQL}")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for rows in b.column("r").to_pylist():
            spans: list[dict] = []
            for r in rows:
                if spans and r["a"] <= spans[-1]["b"]:
                    spans[-1]["b"] = max(spans[-1]["b"], r["b"])
                else:
                    spans.append(dict(r))
            out.append(spans)
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, _SPANS)], ["key", "spans"])


def kept_bytes(raw: bytes, spans: list[dict] | None) -> bytes:
    at, parts = 0, []
    for s in spans or ():
        parts.append(raw[at : s["a"]])
        at = s["b"]
    return b"".join(parts) + raw[at:]


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, raw_n = [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            raw = (text or "").encode()
            raw_n.append(len(raw))
            kept.append(kept_bytes(raw, spans))
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                pa.array(raw_n, pa.int64()),
                pa.array([n - len(k) for n, k in zip(raw_n, kept, strict=True)], pa.int64()),
                pa.array([len(s or ()) for s in b.column("spans").to_pylist()], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the repeated bytes cut out of their texts; bytes of a cut character are dropped."""
    spans = cut_spans(docs, width).select(F.col("key").alias("_key"), F.col("spans").alias("_spans"))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if not s else kept_bytes((t or "").encode(), s).decode(errors="ignore") for t, s in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in columns], columns)

    return docs.join(spans, _key() == F.col("_key"), "left").select(*columns, "_spans").mapInArrow(run, docs.schema)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key().alias("key"))
    spans = cut_spans(docs)
    # where few texts lose bytes, only these are shuffled and go to Python
    losing = small_side(spans.select("key"))
    cut = docs.join(losing, "key", "left_semi").join(spans, "key").select("doc_id", "text", "spans")
    text, none = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    whole = docs.join(losing, "key", "left_anti").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    return cut.mapInArrow(_digest_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").unionByName(whole)
