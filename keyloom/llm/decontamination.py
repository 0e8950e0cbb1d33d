"""Benchmark decontamination, in DataFrame operations only.

A document leaks an item if one of its windows, as long as the item in words, has a weighted (multiset) Jaccard similarity
of SIMILARITY or more on 5-word shingles of lower-cased words. An item or a document of fewer than five words has one
shingle, the whole; a document shorter than the item has one window, the whole. An item of fewer than five words is leaked
by each window of as many words that equals it; its similarity is one.

1. Anchors. Two shingle multisets of n can only be that similar if they share all but a few; so a window must hold one of
   the item's rarest PREFIX shingles. Documents' shingle hashes meet those of the items, and only windows over a hit go on.
2. Fingerprints. Each such window gets a 64-bit SimHash, its bit counts added in lanes of packed longs.
3. Multi-index blocks. Fingerprints are cut into RADIUS + 1 blocks; a pair within RADIUS bits agrees on a block, so windows
   join items on (item, block, value), which loses no pair within RADIUS. RADIUS is chosen by measured recall: of pairs at a
   similarity of 0.8 to 0.85 over 99.9 % lie within it (tests/llm measures it). Blocks of so few bits remove few pairs that are
   not alike; step 1 does that, and the Hamming test behind the blocks.
4. Verification by exact weighted similarity.

The shingles of items are broadcast only while there are at most MAX_BROADCAST of them, and joined by shuffle beyond; so
are the hits. A passage that a third of all documents hold makes a row for each of them, dealt by document.

Defined results: null texts have no words and leak nothing, null items match nothing; repeated rows of a document count
once for each doc_id, and rows of null doc_id are rows of one document; extra columns are ignored, and kept by `drop_leaks`; empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import fits_broadcast, let, read, staged, unused, words

SHINGLE, SIMILARITY, RADIUS, BITS = 5, 0.8, 24, 64
MAX_BROADCAST = 200_000
#: Shingles of all items, repeats included, up to which the items themselves are broadcast.
MAX_SHINGLES = 2_000_000


def with_shingles(df: DataFrame, text: str, n_words: str, out: str) -> DataFrame:
    """df with the number of words of text and `out`, the hashes of its shingles (long each)."""
    lower = F.lower(F.col(text))
    df = df.withColumn("__w", F.transform(words(lower), lambda x: F.xxhash64(x)))
    whole = F.when(F.size("__w") > 0, F.array(F.aggregate("__w", F.lit(7).cast("long"), lambda a, x: F.xxhash64(a, x)))).otherwise(F.array().cast("array<long>"))
    many = F.transform(F.slice("__w", 1, F.greatest(F.size("__w") - SHINGLE + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get("__w", i + k) for k in range(1, SHINGLE))))
    return df.withColumn(n_words, F.size("__w")).withColumn(out, F.when(F.size("__w") >= SHINGLE, many).otherwise(whole)).drop("__w")


def simhash(hashes: Column, lane: int) -> Column:
    """The majority of each bit over an array of longs. lane: bits of a counter, at least two more than size(hashes) needs."""
    ones = sum(1 << (lane * k) for k in range(BITS // lane))
    half = F.floor(F.size(hashes) / 2).cast("long")
    out = F.lit(0).cast("long")
    for j in range(lane):
        total = F.aggregate(hashes, F.lit(0).cast("long"), _adder(j, ones))
        # the bit below a lane's top is set where its count is over half: count + (that - 1 - half) >= that; the top stays free of carries
        over = (total + ((1 << (lane - 2)) - 1 - half) * F.lit(ones)).bitwiseAND(F.lit(ones << (lane - 2)))
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(over, lane - 2), j))
    return out


def _adder(j: int, ones: int):
    return lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(ones))


def blocks(fp: Column) -> Column:
    """array<struct(block, value)> of the RADIUS + 1 blocks."""
    edges = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:]))))


def overlap(a: Column, counts: Column) -> Column:
    """Size of the multiset intersection of array a with a map of counts."""
    distinct = F.array_distinct(a)
    own = lambda x: F.size(F.filter(a, lambda y: y == x))
    return F.aggregate(F.filter(distinct, lambda x: F.map_contains_key(counts, x)), F.lit(0), lambda s, x: s + F.least(own(x), F.element_at(counts, x)))


def prepared_items(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, n_words, shingles, counts (hash -> times), need (the least overlap that can reach SIMILARITY)."""
    out = with_shingles(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("__text")), "__text", "n_words", "shingles").drop("__text").where("n_words > 0")
    n = F.size("shingles")
    counted = F.map_from_entries(F.transform(F.array_distinct("shingles"), lambda x: F.struct(x, F.size(F.filter("shingles", lambda y: y == x)))))
    return out.withColumn("counts", counted).withColumn("need", F.ceil(F.lit(SIMILARITY) * n - 1e-9).cast("int"))


def prefixes(items: DataFrame) -> DataFrame:
    """(h, item_id) of each item's rarest shingles among the items: without all of them, `need` cannot be reached."""
    rows = items.select("item_id", F.size("shingles").alias("n"), "need", F.explode(F.map_entries("counts")).alias("e")).select("item_id", "n", "need", F.col("e.key").alias("h"), F.col("e.value").alias("times"))
    rows = rows.join(rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "h")
    before = F.sum("times").over(Window.partitionBy("item_id").orderBy("df", "h")) - F.col("times")
    return rows.withColumn("before", before).where("before <= n - need").select("h", "item_id")


def short_leaks(texts: DataFrame, short: DataFrame, few: bool) -> DataFrame:
    """leaks of the items of fewer than SHINGLE words (rows of prepared_items) in texts (doc_id, text)."""
    parts = []
    hashed = texts.withColumn("__w", F.transform(words(F.lower(F.col("text"))), lambda x: F.xxhash64(x))).drop("text")
    for (k,) in short.select("n_words").distinct().collect():  # at most SHINGLE - 1

        def chain(x: Column, i: Column, k: int = k) -> Column:
            h = F.xxhash64(F.lit(7).cast("long"), x)
            for j in range(1, k):
                h = F.xxhash64(h, F.get("__w", i + j))
            return h

        windows = F.transform(F.slice("__w", 1, F.greatest(F.size("__w") - k + 1, F.lit(0))), lambda x, i: chain(x, i))
        keys = short.where(F.col("n_words") == k).select("item_id", F.element_at("shingles", 1).alias("h"))
        met = hashed.select("doc_id", F.posexplode_outer(windows).alias("at", "h")).join(F.broadcast(keys) if few else keys, "h")
        parts.append(met.groupBy("doc_id", "item_id").agg(F.min("at").cast("long").alias("start")).withColumn("similarity", F.lit(1.0)))
    return reduce(DataFrame.union, parts)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, similarity): the most similar window of each leaked item in each document, the first of equals."""
    prepared = staged(prepared_items(items), "leaks-items")
    ready, short = prepared.where(F.col("n_words") >= SHINGLE), prepared.where(F.col("n_words") < SHINGLE)
    keys = staged(prefixes(ready), "leaks-prefixes")
    most, total = ready.agg(F.coalesce(F.max(F.size("shingles")), F.lit(0)), F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()
    lane = next(b for b in (8, 16, 32) if most < 1 << (b - 2))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    hashed = with_shingles(texts, "text", "n_words", "shingles")
    # outer: else the optimiser tests the arrays' sizes first, in a filter that computes them again, word by word
    hits = hashed.select("doc_id", "n_words", F.posexplode_outer("shingles").alias("at", "h"))
    few = total <= MAX_SHINGLES and fits_broadcast(keys, MAX_BROADCAST)
    found = hits.join(F.broadcast(keys) if few else keys, "h").groupBy("doc_id", "item_id").agg(F.collect_set("at").alias("hits"))
    found = staged(found, "leaks-hits")

    # the shingles of the documents with a hit, again: their texts are read once more instead of shuffling all hashes
    with_hits = found.select(F.col("doc_id").alias("hit_id")).distinct()
    again = texts.join(F.broadcast(with_hits) if fits_broadcast(with_hits, MAX_BROADCAST) else with_hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
    pairs = with_shingles(again.distinct(), "text", "n_words", "shingles").withColumnRenamed("n_words", "doc_words").withColumnRenamed("shingles", "doc_shingles").drop("text")
    found = found.withColumnRenamed("doc_id", "hit_id")
    pairs = pairs.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id"))).drop("hit_id").join(F.broadcast(ready) if few else ready, "item_id")
    # a window of m shingles over hit p starts at p - m + 1 to p, within the document
    m = F.least(F.size("shingles"), F.size("doc_shingles"))
    last = F.size("doc_shingles") - m
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.when(F.greatest(p - m + 1, F.lit(0)) <= F.least(p, last), F.sequence(F.greatest(p - m + 1, F.lit(0)), F.least(p, last))).otherwise(F.array().cast("array<int>")))))
    # of a pair's windows, those whose shingles the item has often enough; the sums run along the document
    member = F.transform("doc_shingles", lambda x: F.map_contains_key("counts", x))
    pairs = pairs.withColumn("m", m).withColumn("starts", starts)
    able = let(member, lambda mine: F.filter("starts", lambda s: F.size(F.filter(F.slice(mine, s + 1, F.col("m")), lambda x: x)) >= F.col("need")))
    windows = pairs.select("doc_id", "item_id", "need", "counts", "shingles", F.explode_outer(F.transform(able, lambda s: F.struct(s.alias("start"), F.slice("doc_shingles", s + 1, F.col("m")).alias("own")))).alias("w"))
    windows = windows.select("doc_id", "item_id", "shingles", "counts", F.col("w.start").alias("start"), F.col("w.own").alias("own"))
    windows = windows.withColumn("fp", simhash(F.col("own"), lane)).withColumn("key", F.explode_outer(blocks(F.col("fp"))))
    index = ready.select("item_id", simhash(F.col("shingles"), lane).alias("item_fp")).withColumn("item_key", F.explode_outer(blocks(F.col("item_fp"))))
    index = index.select(F.col("item_id").alias("i"), "item_fp", F.col("item_key.block").alias("b"), F.col("item_key.value").alias("v"))
    on = (F.col("item_id") == F.col("i")) & (F.col("key.block") == F.col("b")) & (F.col("key.value") == F.col("v"))
    met = windows.join(F.broadcast(index) if few else index, on)
    near = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    # a pair meets in several blocks; it is verified in the first on which the two agree
    same = F.filter(F.arrays_zip(blocks(F.col("fp")).alias("x"), blocks(F.col("item_fp")).alias("y")), lambda z: z["x"]["value"] == z["y"]["value"])
    near = near.where(F.element_at(same, 1)["x"]["block"] == F.col("b"))
    shared = overlap(F.col("own"), F.col("counts"))
    scored = near.withColumn("o", shared).withColumn("similarity", F.col("o") / (F.size("own") + F.size("shingles") - F.col("o")))
    best = scored.where(F.col("similarity") >= SIMILARITY).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    long = best.select("doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.similarity").alias("similarity"))
    if short.isEmpty():
        return long
    return long.union(short_leaks(texts, short, fits_broadcast(short, MAX_BROADCAST)))


def drop_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that leak an item. Rows of null doc_id are judged together and kept if none leaks."""
    (name,) = unused(docs, "bad")
    bad = staged(leaks(docs, items, doc_id, text).select(F.col("doc_id").alias(name)).distinct(), "leaks-documents")
    bad = F.broadcast(bad) if fits_broadcast(bad, MAX_BROADCAST) else bad
    return docs.join(bad, F.col(doc_id).cast("long").eqNullSafe(F.col(name)), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
