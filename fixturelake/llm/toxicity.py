"""Toxicity by a weighted lexicon that is learnt from labelled rows and matched by Aho-Corasick.

Texts are folded first: lower case, accents off, homoglyphs to Latin letters, digit and symbol substitutions to
letters (``1``, ``!``, ``|``, ``l`` and ``i`` fold together), other punctuation to blanks. The lexicon holds beginnings of
folded words that occur after many different words in toxic training texts and after few in clean ones, weighted by
their log odds; counting different preceding words keeps copies of one text from voting twice. Pairs of words that
contain an entry but occur only in clean texts become exception phrases and take the entry's weight back. One
automaton finds entries and exceptions; their weights are summed, divided by a power of the text's length, and a
logistic curve fitted on the training rows turns this into a score from 0 to 1.

The training sample alone bounds the lexicon: every beginning and every exception that it shows is used.

Labels come from rows whose crc32(doc_id as text) mod 3 is not 1, at most about TRAIN_ROWS of them, taken by hash;
repeated rows are learnt from once, and an id of which any row says toxic is toxic. Every text is scored whole. Null and empty texts score as a text without hits does. A null doc_id is scored and not held
out. Very long texts are folded and matched whole, each alone; ties of strength have one score. Repeated rows give repeated
results; without labelled rows nothing is toxic, and an empty table gives no rows. Extra columns are ignored, and kept by ``without_toxic``.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, ship, table

#: Bound of the training sample, rows.
TRAIN_ROWS = 30_000
MIN_SUPPORT = 8
MIN_LOG_ODDS = 3.5
PREFIX = range(3, 13)
LENGTH_POWER = 0.25
THRESHOLD = 0.7

# Letters of other scripts that look like Latin ones, and the letters they stand for.
_LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "ɡ": "g", "н": "h", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h",
}
# Digits and symbols written for letters.
_SUBSTITUTE = {"0": "o", "1": "i", "l": "i", "!": "i", "|": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g", "€": "e"}

_TABLE = {i: " " for i in range(128) if not chr(i).isalnum()}
_TABLE |= {ord(k): v for k, v in _SUBSTITUTE.items()}
_WIDE = _TABLE | {i: None for i in range(0x300, 0x370)} | {ord(k): _SUBSTITUTE.get(v, v) for k, v in _LOOKALIKE.items()} | {i: None for i in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF)} | {i: " " for i in (0xA0, 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0xAB, 0xBB, 0xBF, 0xA1)}


def fold(text: str | None) -> str:
    """Folded words with a blank before, between and after them."""
    text = (text or "").lower()
    if text.isascii():
        return f" {text.translate(_TABLE)} "
    return f" {unicodedata.normalize('NFKD', text).translate(_WIDE)} "


def _train_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: set[tuple[str, str, int]] = set()
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = fold(text).split()
            # beginnings alone count, so that junk of very long words stays small
            seen.update((w[:24], p[:24], toxic) for p, w in zip(["", *words], words, strict=False) if len(w) >= PREFIX[0])
        yield _pair_rows(seen)


def _pair_rows(seen: set[tuple[str, str, int]]) -> pa.RecordBatch:
    rows = list(seen)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], ["word", "before", "toxic"])


def exceptions(train: DataFrame, kept: dict[str, float]) -> dict[str, float]:
    """Pairs of whole words, the second with a kept beginning, that stand in clean texts only, with the weight that they take back."""

    def own(word: str) -> str | None:  # kept beginnings do not nest, so a word has one at most
        return next((word[:k] for k in PREFIX if word[:k] in kept), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[tuple[str, str, int]] = set()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = fold(text).split()
                seen.update((w, p, toxic) for p, w in zip(words, words[1:], strict=False) if own(w))
            yield _pair_rows(seen)

    pairs = train.mapInArrow(run, "word string, before string, toxic int").groupBy("word", "before").agg(F.max("toxic").alias("toxic")).where("toxic = 0")
    return {f" {r['before']} {r['word']} ": -kept[own(r["word"])] for r in pairs.collect()}


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic of the labelled rows that may be learnt from, about ``bound`` at most."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    share = min(1.0, bound / max(1, usable.count()))
    usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(usable, "doc_id").dropDuplicates(["doc_id", "text"]).select("text", "toxic")


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Patterns and weights: `` start`` of a word, or `` before word`` as an exception with a negative weight."""
    tables = Tables(train.sparkSession)
    pairs = tables.write(
        train.mapInArrow(_train_words, "word string, before string, toxic int").groupBy("word", "before").agg(F.max("toxic").alias("pos"), F.max(1 - F.col("toxic")).alias("neg")),
        "tox-pairs",
    )
    words = pairs.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = words.agg(F.sum("pos"), F.sum("neg")).first()
    n_pos, n_neg = (total[0] or 0) + 1, (total[1] or 0) + 1
    odds = F.log((F.col("pos") + 0.5) / n_pos) - F.log((F.col("neg") + 0.5) / n_neg)
    lengths = F.sequence(F.lit(PREFIX[0]), F.least(F.length("word"), F.lit(PREFIX[-1])))
    starts = (
        words.select(F.explode(F.transform(lengths, lambda n: F.substring("word", F.lit(1), n))).alias("term"), "pos", "neg")
        .groupBy("term")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .withColumn("weight", odds)
        .where((F.col("pos") >= MIN_SUPPORT) & (F.col("weight") >= MIN_LOG_ODDS))
    )
    found = {r["term"]: (r["pos"], r["weight"]) for r in starts.collect()}
    # of nested starts the longest that keeps most of the support; what stays outside it is left to shorter ones
    longer: dict[str, int] = defaultdict(int)
    for t, (n, _) in found.items():
        if t[:-1] in found:
            longer[t[:-1]] = max(longer[t[:-1]], n)
    kept = {t: w for t, (n, w) in found.items() if longer[t] < 0.9 * n}
    kept = {t: w for t, w in kept.items() if not any(t[:k] in kept for k in range(PREFIX[0], len(t)))}
    lexicon = {f" {t}": w for t, w in kept.items()}
    if kept:
        lexicon |= exceptions(train, kept)
    tables.drop()
    return lexicon


_automata: dict = {}


def weigh(texts: list[str | None], lexicon: dict[str, float]) -> list[tuple[float, int]]:
    """Summed weight and number of words of each text."""
    key = tuple(sorted(lexicon.items()))
    if key not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, v in key:
            a.add_word(k, v)
        a.make_automaton()
        _automata.clear()
        _automata[key] = a
    a, out = _automata[key], []
    for t in texts:
        folded = fold(t)
        total = sum(w for _, w in a.iter(folded)) if lexicon else 0.0
        out.append((max(0.0, total), len(folded.split()) if total else 0))
    return out


def strength(total: float, n_words: int) -> float:
    return total / (1 + n_words) ** LENGTH_POWER if total else 0.0


def fit_curve(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (strength, toxic, count): Newton's method with a small ridge; slope not negative."""
    import numpy as np

    if not rows or len({y for _, y, _ in rows}) < 2:
        return 1.0, -6.0
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    n = np.array([r[2] for r in rows], float)
    a = np.c_[x, np.ones_like(x)]
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (n * (p * (1 - p) + 1e-6))[:, None]) + np.diag([1e-2, 1e-2])
        step = np.linalg.solve(h, a.T @ (n * (y - p)) - 1e-2 * w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return max(0.0, float(w[0])), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> tuple[dict[str, float], float, float]:
    """The lexicon, and slope and offset of its score."""
    ship(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    train = tables.write(training_rows(docs, labels, bound), "tox-train")
    lexicon = learn_lexicon(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [strength(*w) for w in weigh(b.column("text").to_pylist(), lexicon)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column("toxic")], ["x", "toxic"])

    # equal strengths are counted together; at most about ``bound`` rows unless an id has many texts
    counted = train.mapInArrow(run, "x double, toxic int").groupBy("x", "toxic").agg(F.count("*").alias("n"))
    rows = sorted((r["x"], r["toxic"], r["n"]) for r in counted.collect())
    tables.drop()
    return (lexicon, *fit_curve(rows))


def toxicity_scores(docs: DataFrame, model: tuple[dict[str, float], float, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    lexicon, slope, offset = model
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [1 / (1 + math.exp(-min(60.0, max(-60.0, slope * strength(*w) + offset)))) for w in weigh(b.column("text").to_pylist(), lexicon)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: tuple[dict[str, float], float, float], threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score is below the threshold, all columns kept."""
    lexicon, slope, offset = model
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [slope * strength(*w) + offset for w in weigh(b.column("text").to_pylist(), lexicon)]
            yield b.filter(pa.array([s < math.log(threshold / (1 - threshold)) for s in score], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, learn(docs, table(spark, sf_dir, "labels")))
