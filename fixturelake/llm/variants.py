"""Spelling variants: near words by a bit-sliced position index, grouped under their most frequent forms.

Two words are near if they differ by one inserted, deleted or replaced code point. Of such a pair the shorter word a (of m letters) and the
other agree in all letters before the first difference and in all after it. Words are therefore brought together in blocks: a block
(m, lo, hi) holds words of m and m + 1 letters that agree in the first lo and the last m - hi letters, for the pairs that first differ at an
open place, from lo to hi. A word begins in the two halves of its own length and of one less. A block of over BLOCK words is cut into its
two halves again, until one place is open; then there are no more words than the alphabet allows (90 + 90 * 90). So each pair meets in
exactly one block, no block grows with the corpus, and no pair is written out.

In a block every (position, letter) has a bit set over the block's words. For each word the sets of words without an error and with one are
carried along its letters: a replacement keeps the position, a letter more in the other word shifts it up, one less shifts it
down; an error begins at the first difference. Words are numbered by falling count and rising code points, so that the number of near
words is the number of bits, and the candidate for the form is the lowest.

Null and empty texts have no words. A null doc_id hashes as an empty one. Rows that repeat count each time. Texts of any length are read
in slices that end between runs. Ties of count go to the smallest word in code-point order. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, ship, small_batches, small_side, table

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, RAREST, RATIO, RATE = 5, 3, 2, 97
#: Words that a block has at most where it can still be cut.
BLOCK = 2000
#: Words that a task holds before it hands their counts on, and characters that it takes from a text at once.
HELD, SLICE = 400_000, 1 << 20
KEY = ["m", "lo", "hi", "head", "tail"]

_RUN, _GAP = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")


def runs(text: str) -> Iterator[list[str]]:
    """The runs of a text, A-Z lower-cased, slice by slice."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        # of bytes lower() knows A-Z only
        yield _RUN.findall(text[at:end].encode().lower().decode())
        at = end


def shortened(run: str, h: int, rate: int = RATE) -> str:
    """The run, without one letter where the rate divides its hash."""
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % rate == 0 else run


def counted(doc_ids: list, texts: list[str], into: Counter, rate: int, shortest: int) -> None:
    """Add how often each word of some documents occurs."""
    for doc_id, text in zip(doc_ids, texts, strict=True):
        before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        for part in runs(text):
            for run, n in Counter(part).items():
                h = zlib.crc32(run.encode(), before)
                word = run if h % rate else shortened(run, h, rate)
                if len(word) >= shortest:
                    into[word] += n


def _counts(rate: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            counted(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), held, rate, shortest)
            if len(held) > HELD:
                yield _batch(held)
                held.clear()
        yield _batch(held)

    return run


def _batch(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, rate: int = RATE) -> DataFrame:
    """word, n of words that are long and frequent enough."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text <> ''")
    return texts.mapInArrow(_counts(rate, shortest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def _keyed(rows: DataFrame) -> DataFrame:
    """With the letters in which a block's words agree."""
    return rows.selectExpr("word", "n", "m", "lo", "hi", "substring(word, 1, lo) as head", "substring(word, length(word) - (m - hi) + 1, m - hi) as tail")


def _halves(rows: DataFrame) -> DataFrame:
    """Each row of a block (m, lo, hi) once for each half of its open places."""
    return _keyed(rows.selectExpr("word", "n", "m", "inline(array(struct(lo, lo + cast(floor((hi - lo) / 2) as int) as hi), struct(lo + cast(floor((hi - lo) / 2) as int) as lo, hi)))"))


def near_in_block(words: list[str], m: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(word, near words, first of them), by number, of the words of a block that have near words of which the first difference is open here.

    Words are numbered as they come; those of m and of m + 1 letters agree outside the places from lo to hi.
    """
    has: list[dict[str, int]] = [defaultdict(int) for _ in range(hi - lo + 1)]
    same = longer = 0
    for k, w in enumerate(words):
        bit = 1 << k
        more = len(w) > m
        if more:
            longer |= bit
        else:
            same |= bit
        for p in range(lo, hi + more):
            has[p - lo][w[p]] |= bit
    end, out = hi == m, []
    for k, w in enumerate(words):
        if len(w) == m:
            # exact: no difference yet; swapped: one letter replaced; ahead: one letter more, all positions shifted by one
            exact, swapped, ahead = same | longer, 0, 0
            for p in range(hi - lo):
                here, next_ = has[p].get(w[lo + p], 0), has[p + 1].get(w[lo + p], 0)
                begun = exact & ~here
                swapped = swapped & here | begun & same
                ahead = (ahead | begun & longer) & next_
                exact &= here
            near = swapped | ahead | (exact & longer if end else 0)
        else:
            # behind: one letter less
            exact, behind = same, 0
            for p in range(hi - lo):
                here = has[p].get(w[lo + p], 0)
                if behind:
                    behind &= has[p - 1].get(w[lo + p], 0)
                behind |= exact & ~here
                exact &= here
            near = (behind & has[hi - lo - 1].get(w[hi], 0) if behind else 0) | (exact if end else 0)
        if near:
            out.append((k, near.bit_count(), (near & -near).bit_length() - 1))
    return out


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        word, count, best, best_n = [], [], [], []
        for m, lo, hi, members in zip(*[b.column(c).to_pylist() for c in ("m", "lo", "hi", "members")], strict=True):
            members = sorted((-x["n"], x["word"]) for x in members)
            names = [w for _, w in members]
            for k, near, first in near_in_block(names, m, lo, hi):
                word.append(names[k])
                count.append(near)
                best.append(names[first])
                best_n.append(-members[first][0])
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(count, pa.int64()), pa.array(best, pa.string()), pa.array(best_n, pa.int64())], ["word", "near", "best", "best_n"])


def near_words(words: DataFrame, tables: Tables, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """word, n_near, best (the near word of the largest n, the smallest of equals), best_n of the words (word, n; a table) that have near words."""
    lengths = words.selectExpr("word", "n", "explode(array(length(word), length(word) - 1)) as m").where(F.col("m") >= shortest)
    rows, found, cut = _halves(lengths.selectExpr("*", "0 as lo", "m as hi")), [], "hi - lo > 1"
    while True:
        crowded = tables.write(rows.groupBy(*KEY).agg(F.count("*").alias("size")).where((F.col("size") > block) & F.expr(cut)).drop("size"), "crowded")
        last = crowded.isEmpty()
        # blocks of one word have no pairs; a block has at most ``block`` words, or one open place
        calm = rows if last else rows.join(small_side(crowded), KEY, "left_anti")
        blocks = calm.groupBy(*KEY).agg(F.collect_list(F.struct("word", "n")).alias("members")).where("size(members) > 1")
        with small_batches(words.sparkSession):
            found.append(tables.write(blocks.select("m", "lo", "hi", "members").mapInArrow(_near_batches, "word string, near long, best string, best_n long"), "near"))
        if last:
            break
        rows = tables.write(_halves(rows.join(small_side(crowded), KEY, "left_semi")), "halves")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return every.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def last_forms(forms: DataFrame, tables: Tables) -> DataFrame:
    """word, root of a table word, root (its form): each round every word jumps to what its root has, until none moves. Counts at least
    double from word to form, so that no chain is long."""
    while True:
        further = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = tables.write(forms.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forms = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return forms


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, ratio: int = RATIO, rate: int = RATE, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus that is long and frequent enough."""
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark)
    with small_batches(spark):
        words = tables.write(vocabulary(docs, shortest, rarest, rate), "words")
    near = near_words(words, tables, shortest, block)
    strong = F.col("best_n") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"))
    formed = tables.write(formed, "forms")
    roots = last_forms(formed.where("form is not null").select("word", F.col("form").alias("root")), tables)
    out = formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return tables.result(out, "variants")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
