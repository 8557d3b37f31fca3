"""Token counts with overlap resynchronisation.

Texts up to CHUNK characters are counted in one task a batch. If no token of the vocabulary holds white space and other characters, and
white space gives no tokens (which is checked), none crosses it, and a text's count is the sum over its white-space-separated
pieces; pieces already counted in a batch or before are looked up, the others encoded by the library.

Longer texts are cut into chunks of CHUNK characters that overlap the next by an overlap. Each chunk is its own
row, encoded with offsets in its own task. Neighbours are spliced at a token start that both encodings have and that
follows white space, where neither side can change the other's tokens. Where the overlap has no such place, the
text is encoded again with an overlap eight times as wide, up to the whole text. With a vocabulary whose tokens hold white space
no such place is proven, and every text is encoded whole.

Null and empty texts have no tokens and no bytes; null ids are kept. Repeated rows give repeated results; equal long texts are encoded
once. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship, table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
CHUNK = 48_000
OVERLAP = 400
#: Counted pieces that a Python worker remembers.
MEMO = 400_000

_library: dict = {}


def _tokenizer(path: str):
    if path not in _library:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _library[path] = (tok, {})
    return _library[path]


def vocabulary_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Marks of white space in the vocabularies of byte-level and sentence-piece tokenizers.
_SPACE_MARKS = "\u0120\u010a\u0109\u010d\u2581"


def cut_at_white_space(path: str) -> bool:
    """Whether no token of the vocabulary holds white space beside other characters, and white space alone gives no token."""
    tok = _tokenizer(path)[0]
    for token in tok.get_vocab(with_added_tokens=True):
        spaces = [c.isspace() or c in _SPACE_MARKS for c in token.replace("</w>", "")]
        if any(spaces) and not all(spaces):
            return False
    alone, apart, one, other = (len(e) for e in tok.encode_batch([" \n\t\r ", "a \n b", "a", "b"], add_special_tokens=False))
    return alone == 0 and apart == one + other


def count_whole(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, encoded as it is."""
    return [len(e) for e in _tokenizer(path)[0].encode_batch(texts, add_special_tokens=False)]


def count_pieces(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the sum over its white-space-separated pieces."""
    tok, memo = _tokenizer(path)
    split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
    fresh = list({p for s in split for p in s}.difference(memo))
    if len(memo) + len(fresh) > MEMO:
        memo.clear()
        fresh = list({p for s in split for p in s})
    for i in range(0, len(fresh), 20_000):
        part = fresh[i : i + 20_000]
        memo.update(zip(part, (len(e) for e in tok.encode_batch(part, add_special_tokens=False)), strict=True))
    get = memo.__getitem__
    return [sum(map(get, s)) for s in split]


def _count_batches(path: str, pieces: bool):
    count = count_pieces if pieces else count_whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count(b.column("text").to_pylist(), path)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.cast(b.column("n_bytes"), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def encode_chunk(text: str, overlap: int, first: bool, last: bool, path: str) -> tuple[int, list[int], list[int], list[int], list[int]]:
    """Tokens of the chunk; white-space-led token starts in its head and tail overlap, with the number of tokens before them."""
    enc = _tokenizer(path)[0].encode(text, add_special_tokens=False)
    head_at, head_n, tail_at, tail_n = [], [], [], []
    edge = len(text) - overlap
    for k, (s, _) in enumerate(enc.offsets):
        if s and text[s - 1] in " \n\t\r":
            if not first and s < overlap:
                head_at.append(s)
                head_n.append(k)
            if not last and s >= edge:
                tail_at.append(s - edge)
                tail_n.append(k)
    return len(enc.ids), head_at, head_n, tail_at, tail_n


def _chunk_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            out = [encode_chunk(*x, path) for x in zip(d["piece"], d["overlap"], d["first"], d["last"], strict=True)]
            lists = [pa.array([o[k] for o in out], pa.list_(pa.int64())) for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays(
                [b.column("row_id"), b.column("chunk"), pa.array([o[0] for o in out], pa.int64()), *lists],
                ["row_id", "chunk", "n", "head_at", "head_n", "tail_at", "tail_n"],
            )

    return run


def count_long(long_docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """row_id, n_tokens of rows with row_id, text; chunks are encoded apart and spliced."""
    done, rest, parts = None, long_docs, max(8, long_docs.sparkSession.sparkContext.defaultParallelism * 2)
    width, step = overlap, chunk
    while True:
        n = f"greatest(1, cast(ceil((length(text) - {width}) / {step}) as int))"
        chunks = rest.selectExpr("row_id", "text", f"{n} as n_chunks").selectExpr("row_id", "text", "n_chunks", "explode(sequence(0, n_chunks - 1)) as chunk").selectExpr(
            "row_id", "chunk", f"substring(text, chunk * {step} + 1, if(chunk = n_chunks - 1, length(text), {step + width})) as piece",
            f"{width} as overlap", "chunk = 0 as first", "chunk = n_chunks - 1 as last",
        )
        coded = chunks.repartition(parts, "row_id", "chunk").mapInArrow(_chunk_batches(path), "row_id string, chunk int, n long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>")
        # tokens a chunk keeps: from the place shared with the one before to the place shared with the next
        whole = coded.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "n", "head_at", "head_n", "tail_at", "tail_n"))).alias("c"))
        shared = "transform(sequence(0, size(c) - 1), i -> if(i = 0, 0L, coalesce(get(array_sort(array_intersect(c[i-1].tail_at, c[i].head_at)), 0), -1L)))"
        cut = whole.withColumn("cut", F.expr(shared)).withColumn("fits", F.expr("forall(cut, x -> x >= 0)"))
        total = """aggregate(sequence(0, size(c) - 1), 0L, (acc, i) -> acc
            + if(i = size(c) - 1, c[i].n, c[i].tail_n[cast(array_position(c[i].tail_at, cut[i + 1]) as int) - 1])
            - if(i = 0, 0L, c[i].head_n[cast(array_position(c[i].head_at, cut[i]) as int) - 1]))"""
        cut = materialise(cut.select("row_id", "fits", F.expr(f"if(fits, {total}, null)").alias("n_tokens")), "chunks")
        good = cut.where("fits").select("row_id", "n_tokens")
        done = good if done is None else done.unionByName(good)
        failed = cut.where("not fits").select("row_id")
        if failed.isEmpty():
            return done
        rest = rest.join(failed, "row_id", "left_semi")
        width, step = width * 8, step if width * 8 < step else step * 8


def token_counts(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    path = path or vocabulary_path()
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    pieces = cut_at_white_space(path)
    if not pieces:
        every = base.mapInArrow(_count_batches(path, False), "doc_id long, n_bytes long, n_tokens long")
        return every.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    short = base.where(F.length("text") <= chunk).mapInArrow(_count_batches(path, True), "doc_id long, n_bytes long, n_tokens long")
    # equal long texts are encoded once: the row is named by its text
    long = base.where(F.length("text") > chunk).withColumn("row_id", F.sha2("text", 256))
    keys = materialise(long.select("doc_id", "n_bytes", "row_id"), "long-keys")
    if not keys.isEmpty():
        counted = count_long(long.select("row_id", "text").dropDuplicates(["row_id"]), path, chunk, overlap)
        short = short.unionByName(keys.join(counted, "row_id").select("doc_id", "n_bytes", "n_tokens"))
    return short.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
