"""Legacy layout: one Parquet file per column group with explicit column lists, columns identified by field id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamellar.errors import InvalidArgument
from lamellar.operators import grouping
from lamellar.sources.writer import ROW, numbered

#: Fixed value: the metadata key by which Spark knows a column's Parquet field id.
FIELD_ID = "parquet.field.id"


def with_ids(schema: T.StructType, ids: Sequence[int]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, FIELD_ID: i}) for f, i in zip(schema.fields, ids, strict=True)])


def _id(f: T.StructField) -> int:
    if FIELD_ID not in f.metadata:
        raise InvalidArgument(f"column {f.name} has no field id")
    return f.metadata[FIELD_ID]


def write(df: DataFrame, schema: T.StructType, paths: Sequence[str], groups: Sequence[Sequence[int]]) -> int:
    """Write the columns at each group's ordinals to its path, with their field ids; gives the number of rows."""
    if len(paths) != len(groups):
        raise InvalidArgument("a path is needed for each group")
    names = grouping.by_indices(df.columns, groups)
    rows, n = numbered(df)
    for path, own in zip(paths, names, strict=True):
        kept = rows.select(*[F.col(c).alias(c, metadata={FIELD_ID: _id(schema[c])}) for c in own], ROW)
        kept.repartitionByRange(1, ROW).sortWithinPartitions(ROW).drop(ROW).write.option("parquet.field.id.write.enabled", "true").parquet(path)
    return n


def read(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """The columns of schema, found by field id whatever their names in the files, rows of all files side by side.

    A column in no file is NULL.  Files pair rows by position; a file with fewer
    rows than another is an error.
    """
    held: dict[int, tuple[int, str]] = {}
    for i, p in enumerate(paths):
        for f in spark.read.parquet(p).schema.fields:
            held.setdefault(f.metadata.get(FIELD_ID, -1), (i, f.name))
    parts, counts = [], []
    for i, p in enumerate(paths):
        own = [F.col(held[_id(f)][1]).alias(f.name) for f in schema.fields if held.get(_id(f), (-1, ""))[0] == i]
        if own or not parts and i == len(paths) - 1:
            part = spark.read.parquet(p).select(*own, F.col("_metadata.row_index").alias(ROW))
            parts.append(part)
            counts.append(part.count())
    if len(set(counts)) > 1:
        raise InvalidArgument(f"files differ in their number of rows: {counts}")
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, ROW)
    there = set(out.columns)
    return out.select(*[F.col(f.name) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
