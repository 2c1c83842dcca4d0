"""Tables over files that others own: plain folders, pinned snapshots with positional deletes, files with deletion vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamellar.errors import InvalidArgument, NotSupported
from lamellar.manifest import ColumnGroup, Fragment
from lamellar.operators import deletes
from lamellar.operators.commit import Transaction
from lamellar.properties import FORMATS, Properties
from lamellar.sources.store import Store, normal, plain_path


@dataclass(frozen=True)
class DataFile:
    """A data file of a snapshot: its delete files by kind, and (on a keyed table) whether it must be merged on read."""

    path: str
    deletes: tuple[tuple[str, str], ...] = ()
    merged: bool = False


def row_counts(spark: SparkSession, paths: Sequence[str]) -> dict[str, int]:
    """Rows of each file: Spark counts them from the footers, reading no column."""
    if not paths:
        return {}
    found = spark.read.parquet(*paths).groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count("*").alias("n")).collect()  # a row for each file
    by = {normal(r["p"]): r["n"] for r in found}
    return {p: by.get(normal(p), 0) for p in paths}


def explore(spark: SparkSession, folder: str, format: str = "parquet") -> list[Fragment]:
    """The files right in a folder, in the order of their names; empty files are left out."""
    if format not in FORMATS:
        raise InvalidArgument(f"unknown format {format}")
    if format != "parquet":
        raise NotSupported(f"no reader for {format} here; give plan() its data files")
    store = Store(spark, folder)
    paths = [f"{folder.rstrip('/')}/{n}" for n in store.names("") if not n.startswith(("_", ".")) and n.endswith(".parquet")]
    n = row_counts(spark, paths)
    return [Fragment(p, 0, n[p], total=n[p]) for p in paths if n[p]]


def plan(spark: SparkSession, files: Sequence[DataFile], properties: Properties | None = None, pinned: bool = True) -> list[Fragment]:
    """Fragments of a snapshot's data files with their living rows.

    A snapshot must be pinned by iceberg.snapshot_id.  Positional delete files and
    deletion vectors are applied, and repeated positions count once; equality
    deletes are rejected and unknown kinds of deletes passed over.
    """
    if pinned and (properties or Properties())["iceberg.snapshot_id"] is None:
        raise InvalidArgument("iceberg.snapshot_id is required")
    if any(f.merged for f in files):
        raise NotSupported("files that need a merge have no positions; use deletes.latest()")
    if any(kind == "equality" for f in files for kind, _ in f.deletes):
        raise NotSupported("equality deletes are not supported")
    known = {f.path: [x for x in f.deletes if x[0] in ("positional", "vector")] for f in files}
    if any(len(x) > 1 for x in known.values()):
        raise NotSupported("several delete files for one data file; merge them first")
    n = row_counts(spark, [f.path for f in files])
    whole = [Fragment(f.path, 0, n[f.path], total=n[f.path], deletes=known[f.path][0][1] if known[f.path] else None, vector=bool(known[f.path]) and known[f.path][0][0] == "vector") for f in files]
    gone = deletes.of_files(spark, whole)
    less: dict[str, int] = {}
    if gone is not None:  # a number for each file
        sizes = spark.createDataFrame([(normal(p), k) for p, k in n.items()], "file_path string, n long")
        less = {r["file_path"]: r["k"] for r in deletes.distinct_positions(gone).join(F.broadcast(sizes), "file_path").where("pos >= 0 and pos < n").groupBy("file_path").agg(F.count("*").alias("k")).collect()}
    live = [replace(f, live=f.end - less.get(normal(f.path), 0)) if f.deletes else f for f in whole]
    return [f for f in live if f.rows]


def register(spark: SparkSession, root: str, fragments: Sequence[Fragment], columns: Sequence[str] | None = None) -> int:
    """Commit external fragments as the rows of one column group; their paths stay absolute."""
    if not fragments:
        raise InvalidArgument("no files")
    schema = spark.read.parquet(fragments[0].path).schema
    names = list(columns or schema.names)
    if missing := [c for c in names if c not in schema.names]:
        raise InvalidArgument(f"unknown columns {missing}")
    return Transaction(spark, root).append([ColumnGroup(tuple(names), tuple(fragments))], T.StructType([schema[c] for c in names])).commit()


def live_rows(spark: SparkSession, files: Sequence[DataFile]) -> DataFrame:
    """Number of living rows of each data file (file_path, live), counted by Spark."""
    rows = spark.read.parquet(*[f.path for f in files]).select(plain_path(F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__pos"))
    gone = sorted({p for f in files for kind, p in f.deletes if kind == "positional"})
    if not gone:
        return rows.groupBy(F.col("__file").alias("file_path")).agg(F.count("*").alias("live"))
    own = spark.read.parquet(*gone).select(plain_path(F.col("file_path")).alias("file_path"), "pos")
    return deletes.live_per_file(rows, own).withColumnRenamed("__file", "file_path")


@dataclass(frozen=True)
class Split:
    """What is known of a split of an external table: it decides whether its files can be read as they are."""

    format: str = "parquet"
    primary_keys: bool = False
    merge_engine: str = "none"
    files_overlap: bool = False
    level_zero: bool = False
    partition_keys: bool = False
    blob_columns: bool = False
    row_ranges: bool = False
    schema_changed: bool = False
    sidecar_files: bool = False
    deletion_vector_bits: int | None = None


#: Reasons against a direct read, in the order in which they are reported.
RULES = (
    ("format", lambda s: s.format != "parquet"),
    ("partition keys are not in the files", lambda s: s.partition_keys),
    ("blob columns", lambda s: s.blob_columns),
    ("row ranges", lambda s: s.row_ranges),
    ("schema changed", lambda s: s.schema_changed),
    ("sidecar files", lambda s: s.sidecar_files),
    ("merge engine", lambda s: s.primary_keys and s.merge_engine not in ("none", "deduplicate", "first-row")),
    ("unmerged level", lambda s: s.primary_keys and s.level_zero),
    ("overlapping keys", lambda s: s.primary_keys and s.files_overlap),
    ("deletion vector", lambda s: s.deletion_vector_bits not in (None, 32)),
)


def reasons(split: Split) -> list[str]:
    """Why the split needs a merge; none if its files can be read directly."""
    return [name for name, against in RULES if against(split)]


#: Reasons that a merge on read answers.
MERGED = frozenset(("merge engine", "unmerged level", "overlapping keys"))


def read_split(spark: SparkSession, split: Split, paths: Sequence[str], key: Sequence[str] = (), order: Sequence[str] = (), aggregates: dict[str, str] | None = None, rows: int | None = None) -> DataFrame:
    """The rows of a split's files: as they are, or merged by its engine where keys may repeat.

    rows: how many the snapshot declares; another number is an error.  A split
    that needs more than a merge is not supported.
    """
    against = reasons(split)
    if other := [x for x in against if x not in MERGED]:
        raise NotSupported(f"the split cannot be read: {', '.join(other)}")
    out = spark.read.parquet(*paths)
    if against:
        out = deletes.merged(out, list(key), list(order), split.merge_engine if split.merge_engine != "none" else "deduplicate", aggregates)
    if rows is not None and (n := out.count()) != rows:
        raise InvalidArgument(f"the split has {n} rows, {rows} were declared")
    return out
