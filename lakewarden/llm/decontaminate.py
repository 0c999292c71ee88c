"""Operator 2, benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document if at least ``threshold`` of the item's distinct
word shingles occur in the document; the rest of the document, however long, does not
count. Items are partitioned by their number of shingles s. The sketch of an item is
its s - ceil(threshold * s) + 1 least shingle hashes, a bottom-k MinHash whose k
follows from the size: a document that holds the threshold of the item's shingles
misses at most s - ceil(threshold * s) of them, so it holds one of the sketch. A
document whose hashes meet no sketch contains no item, at any length; the others are
verified by exact containment of the shingles' texts.

Only DataFrame functions are used. Hashes stay arrays within their row; those that pass a
Bloom filter of the sketches, of a fixed size, leave it to be joined with the sketches. The
more sketches there are, the more hashes pass it in vain; the result is the same. The filter
is one broadcast row, not a literal: the driver keeps each plan as text, with its literals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Slots of the filter of sketch hashes, a bit each, in longs; places that a hash takes in it.
FILTER_SLOTS, PROBES = 1 << 18, (0, 15, 30, 45)


def words(text: Column) -> Column:
    """Runs of letters, marks and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingle_hashes(w: Column, width: int) -> Column:
    n = F.size(w) - width
    at = lambda i, k: F.get(w, i + k)
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*(at(i, k) for k in range(width))))).otherwise(F.array().cast("array<long>"))


def shingle_texts(w: Column, width: int) -> Column:
    n = F.size(w) - width
    return F.when(n >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(w, i + 1, width), " ")))).otherwise(F.array().cast("array<string>"))


def sketches(items: DataFrame, width: int, threshold: float, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, size (distinct shingles), shingles, sketch (hashes); items without a
    shingle, and those with a null id or text, are left out."""
    base = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w"), F.monotonically_increasing_id().alias("k"))
    hashed = base.select("item_id", F.array_distinct(shingle_hashes(F.col("w"), width)).alias("h"), shingle_texts(F.col("w"), width).alias("shingles"))
    sized = hashed.withColumn("size", F.size("shingles")).where("size > 0")
    needed = F.ceil(F.col("size") * F.lit(threshold) - 1e-9).cast("int")
    return sized.select("item_id", "size", "shingles", F.slice(F.array_sort("h"), F.lit(1), F.col("size") - needed + 1).alias("sketch"))


def _at(h: Column, k: int) -> Column:
    return F.shiftrightunsigned(h, k).bitwiseAND(F.lit(FILTER_SLOTS - 1)).cast("int")


def _filter(sketched: DataFrame) -> DataFrame:
    """held: the filter's longs, as one row."""
    places = sketched.select(F.explode("sketch").alias("h")).select(F.explode(F.array(*(_at(F.col("h"), k) for k in PROBES))).alias("at")).distinct()
    longs = places.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)))).alias("x"))
    every = sketched.sparkSession.range(max(1, FILTER_SLOTS >> 6)).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("x"))
    filled = every.unionByName(longs).groupBy("i").agg(F.bit_or("x").alias("x"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("held"))


def _passes(h: Column) -> Column:
    """Whether a hash may be one of the sketches: false only if it is none."""
    bit = lambda at: F.getbit(F.get("held", F.shiftright(at, 6)), at.bitwiseAND(F.lit(63)))
    return reduce(lambda x, y: x & y, (bit(_at(h, k)) == 1 for k in PROBES))


def candidates(docs: DataFrame, sketched: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, w (words), met (hashes that pass the filter) of documents with such hashes."""
    # the row number also keeps the optimiser from moving the words into the lambdas below,
    # where they would be split again for every shingle
    base = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"), F.monotonically_increasing_id().alias("row"))
    met = F.filter(shingle_hashes(F.col("w"), width), _passes)
    held = base.crossJoin(F.broadcast(_filter(sketched)))
    return held.select("doc_id", "row", "w", F.array_distinct(met).alias("met")).where(F.size("met") > 0)


def contained(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, shared, size, containment (shared / size) of every pair whose
    containment reaches the threshold.

    A document row is judged on its own; rows with the same doc_id give one pair each, as
    do items with the same id. Null or short texts hold no shingle and so contain nothing;
    a null doc_id is kept as it is. Without items the result is empty. Other columns are
    not read."""
    sketched = materialise(sketches(items, width, threshold, item_id_col, item_text_col), "sketches")
    rows = materialise(candidates(docs, sketched, width, id_col, text_col), "candidates")
    # pairs to verify: ids only, then the texts of both sides
    by_hash = sketched.withColumn("item", F.monotonically_increasing_id())
    by_hash = materialise(by_hash, "items")
    pairs = rows.select("row", F.explode("met").alias("h")).join(by_hash.select("item", F.explode("sketch").alias("h")), "h").select("row", "item").distinct()
    texts = rows.select("row", "doc_id", shingle_texts(F.col("w"), width).alias("own"))
    both = pairs.join(by_hash.select("item", "item_id", "size", "shingles"), "item").join(texts, "row")
    shared = both.select("doc_id", "item_id", F.size(F.array_intersect("own", "shingles")).alias("shared"), "size")
    return shared.withColumn("containment", F.col("shared") / F.col("size")).where(F.col("containment") >= threshold - 1e-9)
