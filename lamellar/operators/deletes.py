"""Rows deleted by position: delete files, deletion vectors, and positions among the rows that live."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.errors import InvalidArgument
from lamellar.manifest import Fragment
from lamellar.sources.store import normal, plain_path

#: Positions of deletes that are still broadcast; more are joined with a shuffle.
BROADCAST_ROWS = 1_000_000


def distinct_positions(deletes: DataFrame) -> DataFrame:
    """(file_path, pos), each once: files may repeat a position."""
    return deletes.select("file_path", F.col("pos").cast("long").alias("pos")).where("pos is not null").distinct()


def of_files(spark: SparkSession, fragments: Sequence[Fragment]) -> DataFrame | None:
    """(file_path, pos) of all deletes of external fragments, in one read for each kind; None if there are none."""
    tables = sorted({f.deletes for f in fragments if f.deletes and not f.vector})
    vectors = {normal(f.deletes): normal(f.path) for f in fragments if f.deletes and f.vector}
    out = spark.read.parquet(*tables).select(plain_path(F.col("file_path")).alias("file_path"), F.col("pos").cast("long").alias("pos")) if tables else None
    if vectors:
        file = plain_path(F.col("_metadata.file_path"))
        own = spark.read.parquet(*sorted({f.deletes for f in fragments if f.deletes and f.vector})).select(F.col("pos").cast("long").alias("pos"), F.explode(F.array(file, F.regexp_replace(file, "/[^/]*$", ""))).alias("__vector"))  # a vector is a file or a folder
        named = own.join(F.broadcast(spark.createDataFrame(sorted(vectors.items()), "__vector string, file_path string")), "__vector").select("file_path", "pos")
        out = named if out is None else out.unionByName(named)
    return out


def _against(deletes: DataFrame, small: bool) -> DataFrame:
    """deletes as the right side of a join.  Spark goes by the size of files, which positions compress to next to nothing, so it must be told."""
    return F.broadcast(deletes) if small else deletes.hint("merge")


def without_positions(rows: DataFrame, deletes: DataFrame, file: str = "__file", place: str = "__pos", small: bool | None = None) -> DataFrame:
    """rows whose (file, position) is in no delete; small: whether deletes may be broadcast, else their count is checked."""
    own = distinct_positions(deletes).where("file_path is not null")
    counts = own.groupBy("file_path").agg(F.count("*").alias("n")).collect()  # a number for each file
    small = sum(r["n"] for r in counts) <= BROADCAST_ROWS if small is None else small
    # Paths are long: files are joined by a number of theirs.
    names = rows.sparkSession.createDataFrame([(r["file_path"], i) for i, r in enumerate(counts)], "__name string, __number int")
    names = F.broadcast(names) if len(counts) <= BROADCAST_ROWS else names
    own = own.join(names, own["file_path"] == names["__name"]).select(F.col("__number").alias("__of"), F.col("pos").alias("__gone"))
    keyed = rows.join(names, rows[file] == names["__name"], "left").drop("__name")
    return keyed.join(_against(own, small), (F.col("__number") == F.col("__of")) & (F.col(place) == F.col("__gone")), "left_anti").drop("__number")


def without_vector(rows: DataFrame, positions: DataFrame, place: str = "__pos", small: bool | None = None) -> DataFrame:
    """rows whose position is not in a deletion vector (column pos)."""
    own = positions.select(F.col("pos").cast("long").alias("pos")).distinct()
    small = own.count() <= BROADCAST_ROWS if small is None else small
    own = _against(own, small)
    return rows.join(own, rows[place] == own["pos"], "left_anti")


def live_per_file(rows: DataFrame, deletes: DataFrame, file: str = "__file", place: str = "__pos") -> DataFrame:
    """file and the number of its rows that live; files without any are left out."""
    return without_positions(rows, deletes, file, place).groupBy(file).agg(F.count("*").alias("live"))


def latest(rows: DataFrame, key: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """Merge on read: of the rows with one key, that with the largest order; none if it is marked deleted."""
    others = [c for c in rows.columns if c not in key]
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in others if c not in order])
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*others), rank).alias("__last"))  # combines before the shuffle, so a hot key is no burden
    out = newest.select(*key, "__last.*").select(rows.columns)
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


#: Functions of the aggregation engine, given a column and the rows' order; last ones are those of the largest order.
AGGREGATES = {
    "sum": lambda c, o: F.sum(c),
    "min": lambda c, o: F.min(c),
    "max": lambda c, o: F.max(c),
    "count": lambda c, o: F.count(c),
    "bool_and": lambda c, o: F.bool_and(c),
    "bool_or": lambda c, o: F.bool_or(c),
    "first_value": lambda c, o: F.min_by(c, o),
    "last_value": lambda c, o: F.max_by(c, o),
    "last_non_null_value": lambda c, o: F.max_by(c, F.when(c.isNotNull(), o)),
}


def merged(rows: DataFrame, key: list[str], order: list[str], engine: str = "deduplicate", aggregates: dict[str, str] | None = None) -> DataFrame:
    """Merge on read by a table's engine: of the rows with one key deduplicate keeps the last, first-row the first; partial-update takes each column's last value that isn't null; aggregation each column by its function (the last value that isn't null, where none is named).

    All combine before the shuffle, so a hot key is no burden.
    """
    others = [c for c in rows.columns if c not in key]
    if engine == "deduplicate":
        return latest(rows, key, order)
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in others if c not in order])
    if engine == "first-row":
        return rows.groupBy(*key).agg(F.min_by(F.struct(*others), rank).alias("__first")).select(*key, "__first.*").select(rows.columns)
    if engine not in ("partial-update", "aggregation"):
        raise InvalidArgument(f"unknown merge engine {engine}")
    named = (aggregates or {}) if engine == "aggregation" else {}
    if unknown := [f for f in named.values() if f not in AGGREGATES]:
        raise InvalidArgument(f"unknown aggregates {unknown}")
    by = F.struct(*[F.col(c) for c in order])
    out = rows.groupBy(*key).agg(*[AGGREGATES[named.get(c, "last_non_null_value")](F.col(c), by).alias(c) for c in others])
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
