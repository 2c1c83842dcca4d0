"""A training corpus from raw documents: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns documents again, the last one
the pieces of packed sequences.  Every table between two stages is written to the
shared folder.  Extra columns of documents pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.llm import common, decontamination, jaccard_join, packing, pii, quality


def _row(docs: DataFrame) -> Column:
    """All columns of a document in one, so that no name of theirs meets an inner one."""
    return F.struct(*[F.col(common.quoted(c)) for c in docs.columns])


def _back(rows: DataFrame, row: str, columns: list[str], text: str | None = None) -> DataFrame:
    """The columns of documents from a row of them; with a new text, if one is given, and then n_chars counted anew."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")} if text else {}
    return rows.select(*[(new[c] if c in new else F.col(row).getField(c)).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines.  Null and empty texts don't pass; repeated rows fare alike."""
    kept = quality.clean(docs.select("text", _row(docs).alias("row"))).where("kept")
    return _back(kept, "row", docs.columns, "cleaned_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the least doc_id (a null one last), among equal ids the one whose text has the least hash.

    Rows that repeat both a doc_id and its text stay once.  Null texts and texts
    without words have no links: they all stay, repeats once.
    """
    own = jaccard_join.linked(docs).select("doc_id", "key", "root")
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.coalesce("key", F.lit(0)).alias("hash"))
    first = own.where("root is not null").groupBy("root").agg(F.min(best).alias("best")).select(F.col("best.id").alias("id"), F.col("best.hash").alias("hash"))
    alone = own.where("root is null").select(F.col("doc_id").alias("id"), F.col("key").alias("hash")).distinct()
    times = own.groupBy(F.col("doc_id").alias("own_id"), F.col("key").alias("own_hash")).agg(F.count("*").alias("n")).where("n > 1")
    again = times.select(F.struct("own_id", "own_hash").alias("twice"))
    stays = first.unionByName(alone).select(F.struct("id", "hash").alias("stays")).join(again, F.col("stays").eqNullSafe(F.col("twice")), "left")
    named = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash")).alias("name"), _row(docs).alias("row"))
    joined = named.join(stays, F.col("name").eqNullSafe(F.col("stays"))).select("name", "row", F.col("twice").isNotNull().alias("repeats"))
    once = joined.where("not repeats").select("name", "row").unionByName(joined.where("repeats").select("name", "row").dropDuplicates(["name"]))
    return _back(once, "row", docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; all rows with a doc_id of which one text holds an item go, null ids being one."""
    found = decontamination.contaminated(docs, common.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("held")).distinct()
    found = common.settled(found)
    few = F.broadcast(found) if found.count() <= decontamination.BROADCAST_ROWS else found  # ids alone: documents stay where they are
    kept = docs.select(F.col("doc_id").cast("long").alias("id"), _row(docs).alias("row")).join(few, F.col("id").eqNullSafe(F.col("held")), "left_anti")
    return _back(kept, "row", docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each span of personal data; a null text stays null."""
    out = pii.detect(docs.select("text", _row(docs).alias("row")), pii.fit(docs), redact=True)
    return _back(out, "row", docs.columns, "text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", without_benchmarks),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: EM, tokenizers and components are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
