"""Benchmark decontamination, in DataFrame and SQL functions only.

Texts and benchmark items are lower-cased and stripped of punctuation, and become sequences of WIDTH-word shingle
hashes. A shingle weighs the more the fewer items have it, one that no item has as much as the rarest. A text leaks an item if
one of its windows of the item's length has a weighted Jaccard similarity of THRESHOLD or more with it.

1. Of an item's shingles, rarest first, those that hold over 1 - THRESHOLD of its weight are its seeds; a text without one of them
   leaks nothing of it.
2. For the other pairs every start of a window is looked at: each place of a shared shingle adds its weight to the starts whose
   window it is in, so the weight shared by all windows is a running sum over starts. Windows that share under THRESHOLD of
   the item's weight can't be similar enough. Moving a window by one to where it shares more never lowers the similarity, so
   of the rest those are kept that have no neighbour which shares more, the best of all among them.
3. Every window kept and every item gets a 64-bit SimHash of its weighted shingles. Fingerprints are cut into BLOCKS blocks; two at most
   RADIUS bits apart differ by at most PROBES bits in one of them, so windows look up each block among the items' blocks with up
   to PROBES bits turned, and no pair within the radius is missed.
4. Pairs within the radius are verified by their exact similarity.

The fingerprint itself is no proof: of pairs with a similarity of 0.8 some 4 in 1,000 are over 17 of 64 bits apart, of pairs with 0.9 none.

All steps work on distinct texts, named by their digest, and the documents are joined back at the end, so copies
cost nothing more; windows of a text that repeats itself are compared once, the first of them. Null and empty texts and items, and items of fewer than WIDTH words, match nothing: so short a text stands in clean
documents, too. Null doc_ids and item_ids are kept as null. Equal items are all reported; of equally similar windows the
first. Repeated rows give repeated results. Empty tables give no rows. Very long texts are looked at whole; no row holds more than one
text's shingles. Extra columns are ignored; ``clean_documents`` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, small_side, table

WIDTH = 5
THRESHOLD = 0.8
BITS = 64
#: Bits that fingerprints may differ by, blocks of a fingerprint, and bits that may differ in one of the blocks then.
RADIUS, BLOCKS = 17, 6
PROBES = RADIUS // BLOCKS


def _shingled(df: DataFrame, *keep: str) -> DataFrame:
    """keep, h (hashes of the word shingles in order, null of fewer than WIDTH words).

    Explode h by the outer forms only: for the others the optimiser repeats the whole expression in a filter, once a word.
    """
    plain = r"regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}\\s]+', '')"
    words = df.select(*keep, F.expr(rf"filter(split({plain}, '\\s+'), x -> x != '')").alias("w"))
    gram = ", ".join(f"w[i + {k}]" for k in range(WIDTH))
    hashes = f"if(size(w) < {WIDTH}, cast(null as array<long>), transform(sequence(0, greatest(size(w) - {WIDTH}, 0)), i -> xxhash64({gram})))"
    return words.select(*keep, F.expr(hashes).alias("h"))


def _bit(h: str, b: int) -> Column:
    return F.shiftright(F.col(h), b).bitwiseAND(F.lit(1)) == 1


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, weight (of all distinct shingles), fp (64-bit SimHash) of rows keys, shingle, w; shingles must be distinct by keys."""
    votes = [F.sum(F.when(_bit("shingle", b), F.col("w")).otherwise(-F.col("w"))).alias(f"b{b}") for b in range(BITS)]
    bits = [F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    return rows.groupBy(*keys).agg(F.sum("w").alias("weight"), *votes).select(*keys, "weight", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def _numbered_block(no: int, value: Column) -> Callable[[Column], Column]:
    return lambda mask: F.struct(F.lit(no).alias("no"), value.bitwiseXOR(mask).alias("value"))


def _blocks(fp: str, probes: int = 0) -> Column:
    """(block number, value) of the blocks of a fingerprint, each with up to ``probes`` bits turned."""
    cuts = [round(k * BITS / BLOCKS) for k in range(BLOCKS + 1)]
    parts = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        value = F.shiftrightunsigned(F.shiftleft(F.col(fp), BITS - b), BITS - (b - a))
        masks = [sum(1 << i for i in c) for n in range(probes + 1) for c in combinations(range(b - a), n)]
        turned = F.array(*[F.lit(m).cast("long") for m in masks])
        parts.append(F.transform(turned, _numbered_block(k, value)))
    return F.explode(F.concat(*parts))


def near_pairs(windows: DataFrame, items: DataFrame) -> DataFrame:
    """windows (length, fp and more) with the items (length, item_fp and more) of their length at most RADIUS bits apart."""
    wb, ib = windows.select("*", _blocks("fp").alias("block")), items.select("*", _blocks("item_fp", PROBES).alias("block"))
    near = wb.join(ib, ["length", "block"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    return near.drop("block").distinct()


def _starts(pairs: DataFrame, texts: DataFrame, sets: DataFrame, totals: DataFrame, threshold: float) -> DataFrame:
    """key, length, start of the windows that may share enough with an item, without those next to one that shares more."""
    places = texts.join(pairs, "key").select("key", "item", F.size("h").alias("n"), F.posexplode_outer("h").alias("at", "shingle"))
    met = places.join(small_side(sets), ["item", "shingle"])
    before = F.lag("at").over(Window.partitionBy("key", "item", "shingle").orderBy("at"))
    # a place counts for the starts that are after the place of the same shingle before it, and whose window reaches it
    met = met.withColumn("since", F.greatest(F.lit(0), F.coalesce(before + 1, F.lit(0)), F.col("at") - F.col("length") + 1)).withColumn("last", F.greatest(F.lit(0), F.col("n") - F.col("length")))
    events = met.select("key", "item", "length", "last", F.explode(F.array(F.struct(F.col("since").alias("start"), F.col("w").alias("w")), F.struct((F.col("at") + 1).alias("start"), (-F.col("w")).alias("w")))).alias("e"))
    steps = events.groupBy("key", "item", "length", "last", F.col("e.start").alias("start")).agg(F.sum("e.w").alias("w")).where(F.col("start") <= F.col("last"))
    order = Window.partitionBy("key", "item").orderBy("start")
    steps = steps.withColumn("shared", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumns({"prior": F.coalesce(F.lag("shared").over(order), F.lit(0)), "later": F.coalesce(F.lead("shared").over(order), F.lit(0)), "until": F.coalesce(F.lead("start").over(order) - 1, F.col("last"))})
    enough = steps.join(small_side(totals), "item").where(F.col("shared") >= threshold * F.col("item_weight") - 1e-9)
    # without a start next to one that shares more
    free = enough.select("key", "length", (F.col("start") + (F.col("prior") > F.col("shared")).cast("int")).alias("start"), (F.col("until") - (F.col("later") > F.col("shared")).cast("int")).alias("until"))
    return free.where("start <= until").select("key", "length", F.explode(F.sequence("start", "until")).alias("start")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key (digest of the text), item_id, similarity, start_word: the best window of each text for each item it leaks."""
    tables = Tables(docs.sparkSession)
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", F.xxhash64(F.col("item_id").cast("long"), "text").alias("item"))
    placed = tables.write(_shingled(named, "item_id", "item").select("item_id", "item", F.size("h").alias("length"), F.explode_outer("h").alias("shingle")).where("shingle IS NOT NULL").distinct(), "items")
    n_items = placed.select("item").distinct().count()
    rarity = F.round(1000 * F.log(1 + F.lit(n_items) / F.countDistinct("item"))).cast("long")
    weights = tables.write(placed.groupBy("shingle").agg(rarity.alias("w")), "weights")
    common = F.lit(max(1, round(1000 * math.log(1 + n_items)))).cast("long")  # of a shingle that no item has
    sets = tables.write(placed.select("item", "length", "shingle").join(weights, "shingle"), "sets")
    ip = tables.write(fingerprints(sets, ["item", "length"]).select("item", "length", F.col("weight").alias("item_weight"), F.col("fp").alias("item_fp")), "item-fingerprints")

    rarest = Window.partitionBy("item").orderBy(F.desc("w"), "shingle").rowsBetween(Window.unboundedPreceding, -1)
    heavy = sets.withColumn("above", F.coalesce(F.sum("w").over(rarest), F.lit(0))).join(ip.select("item", "item_weight"), "item")
    seeds = tables.write(heavy.where(F.col("above") <= (1 - threshold) * F.col("item_weight") + 1e-9).select("shingle", "item"), "seeds")
    base = docs.select("text", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    words = _shingled(base, "key").select("key", F.explode_outer("h").alias("shingle"))
    pairs = tables.write(words.join(small_side(seeds), "shingle").select("key", "item").distinct(), "pairs")

    keys = tables.write(pairs.select("key").distinct(), "keys")
    texts = tables.write(_shingled(base.join(small_side(keys), "key", "left_semi").dropDuplicates(["key"]), "key"), "texts")
    starts = tables.write(_starts(pairs, texts, sets, ip.select("item", "item_weight"), threshold), "starts")
    span = F.array_distinct(F.expr("slice(h, start + 1, length)"))
    # of windows with the same shingles in the same order the first; the rows stay where the join has put them
    windows = texts.join(starts, "key").select("key", "length", "start", span.alias("span")).groupBy("key", "length", "span").agg(F.min("start").alias("start"))
    parts = windows.select("key", "length", "start", F.explode_outer("span").alias("shingle"))
    parts = tables.write(parts.join(small_side(weights), "shingle", "left").select("key", "length", "start", "shingle", F.coalesce("w", common).alias("w")), "window-shingles")

    near = near_pairs(fingerprints(parts, ["key", "length", "start"]), ip).select("key", "length", "start", "weight", "item", "item_weight")
    shared = near.join(parts, ["key", "length", "start"]).join(sets.select("item", "shingle"), ["item", "shingle"])
    shared = shared.groupBy("key", "start", "item", "weight", "item_weight").agg(F.sum("w").alias("both"))
    alike = F.col("both") / (F.col("weight") + F.col("item_weight") - F.col("both"))
    good = shared.withColumn("similarity", alike).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start")))
    found = good.groupBy("key", "item").agg(best.alias("best")).join(placed.select("item", "item_id").distinct(), "item")
    return tables.result(found.select("key", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.start")).alias("start_word")), "leaks")


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that leak an item."""
    found = leaks(docs, benchmark, threshold).select(F.col("key").alias("_leak")).distinct()
    return docs.join(found.hint("merge"), F.md5(F.coalesce("text", F.lit(""))) == F.col("_leak"), "left_anti")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    return named.join(found, "key").select("doc_id", "item_id", "similarity", "start_word")
