"""Operator 10: benchmark items inside documents, in DataFrame functions only.

Items are parted by their number of shingles.  Each part has a MinHash sketch
size: of an item with at most u shingles, the k = floor((1 - t) * u) + 1 with the
least hashes.  A document with at least a share t of an item's shingles must
hold one of any k of them, so documents of whatever length are searched for
sketch values alone and no containment is missed; every candidate pair is then
verified with the shingles themselves.  Sketches are broadcast while their count,
which is checked, is small; beyond that the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamellar.llm import common
from lamellar.llm import native as N

SHINGLE, THRESHOLD = 5, 0.8
#: Sketch values, and items, that are still broadcast: some 50 MB.
BROADCAST_ROWS = 1_000_000


def _grams(words: Column, size: Column | int) -> Column:
    """Distinct runs of size words, as strings; words must be bound or a column."""
    n = F.size(words)
    size = F.lit(size) if isinstance(size, int) else size
    return F.when((n < size) | (size < 1), F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))))


def _words(column: str) -> Column:
    return N.words(N.lower_ascii(F.col(column).cast("string")))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row per (doc_id, item_id) where the document holds the given share of the item's 5-word shingles: n_shingles, n_found, containment.

    Words are lower-cased A-Z and split at space and \\x09-\\x0D.  An item of fewer
    words is one shingle of that many words; an item without words, or null, is in
    no document, nor does a null or empty document hold any.  Rows that share a
    doc_id give one row with the largest containment; null ids match null ids.
    Repeated items give one row each only if their item_id differs.  Columns other
    than doc_id, text, item_id are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    tests = common.settled(
        items.select(F.col("item_id").cast("long").alias("item_id"), _words("text").alias("w"))
        .where(F.size("w") > 0)
        .withColumn("gram", F.least(F.size("w"), F.lit(SHINGLE)))
        .select("item_id", "gram", _grams(F.col("w"), F.col("gram")).alias("shingles"))
    )
    few = [r["gram"] for r in tests.select("gram").distinct().orderBy("gram").collect()]  # at most SHINGLE numbers
    n_items = tests.count()
    upper = F.pow(2, F.ceil(F.log2(F.size("shingles").cast("double"))))  # a part holds sizes up to a power of two
    k = (F.floor(upper * F.lit(round(1 - threshold, 9))) + 1).cast("int")
    hashed = F.transform("shingles", lambda s: F.xxhash64(s))
    sketch = tests.select("item_id", F.explode(F.slice(F.array_sort(hashed), F.lit(1), F.least(k, F.size("shingles")))).alias("h")).distinct()
    small = sketch.count() <= broadcast_rows and n_items <= broadcast_rows

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grams = [_hashes(g) for g in few] or [F.array().cast("array<bigint>")]
    probes = d.select("doc_id", F.explode(grams[0] if len(grams) == 1 else F.concat(*grams)).alias("h"))
    pairs = common.settled(probes.join(F.broadcast(sketch) if small else sketch, "h").select("doc_id", "item_id").distinct())

    # Texts are read again where they lie, for the candidates alone; they move only if these are very many.
    asked = pairs.withColumnRenamed("doc_id", "_doc")
    texts = d.join(F.broadcast(asked) if pairs.count() <= broadcast_rows else asked, F.col("_doc").eqNullSafe(F.col("doc_id"))).drop("_doc")
    both = texts.join(F.broadcast(tests) if small else tests, texts["item_id"].eqNullSafe(tests["item_id"])).drop(tests["item_id"])
    found = N.bind(_words("text"), lambda w: F.size(F.array_intersect(_grams(w, F.col("gram")), F.col("shingles"))))
    held = both.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_shingles"), found.cast("long").alias("n_found"))
    best = held.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_found").alias("n_found"))
    return best.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("n_found") >= F.col("n_shingles") * F.lit(threshold) - 1e-9)


def _hashes(size: int) -> Column:
    return N.bind(_words("text"), lambda w: F.transform(_pieces(w, size), lambda s: F.xxhash64(s)))


def _pieces(words: Column, size: int) -> Column:
    """Every run of size words, as a string."""
    return F.when(F.size(words) < size, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " ")))
