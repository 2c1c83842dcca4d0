"""How columns are divided into groups."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamellar.errors import InvalidArgument
from lamellar.properties import Properties

#: Fixed widths of types in bytes; all others are measured.
_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8}


def single(columns: list[str]) -> list[list[str]]:
    return [columns] if columns else []


def by_patterns(columns: list[str], patterns: tuple[str, ...]) -> list[list[str]]:
    """A group for each pattern, in their order, with the columns that it is the first to match as a whole; the rest form the last group."""
    regexes = [re.compile(p) for p in patterns]
    places = [next((i for i, r in enumerate(regexes) if r.fullmatch(c)), len(regexes)) for c in columns]
    return [own for i in range(len(regexes) + 1) if (own := [c for c, k in zip(columns, places, strict=True) if k == i])]


def by_indices(columns: list[str], groups: Sequence[Sequence[int]]) -> list[list[str]]:
    """Columns by their ordinals; each must be in one group."""
    if sorted(i for g in groups for i in g) != list(range(len(columns))):
        raise InvalidArgument("groups must have each ordinal once")
    return [[columns[i] for i in g] for g in groups]


def average_bytes(df: DataFrame, sample_rows: int = 1000) -> dict[str, float]:
    """Average width of each column over a few rows."""
    measured = [f for f in df.schema.fields if type(f.dataType) not in _WIDTH]
    if not df.take(1):
        raise InvalidArgument("an empty table has no column sizes")
    sizes = {f.name: float(_WIDTH[type(f.dataType)]) for f in df.schema.fields if type(f.dataType) in _WIDTH}
    if measured:
        column = lambda f: F.octet_length(F.col(f"`{f.name}`") if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(F.col(f"`{f.name}`"))))
        row = df.limit(sample_rows).agg(*[F.avg(F.coalesce(column(f), F.lit(0))).alias(str(i)) for i, f in enumerate(measured)]).first()
        sizes |= {f.name: float(row[i] or 0) for i, f in enumerate(measured)}
    return sizes


def by_size(columns: list[str], sizes: dict[str, float], largest: int, most: int) -> list[list[str]]:
    """Columns in order; a group closes when it is full or before a wide column, which begins the next."""
    if not largest or not most:
        raise InvalidArgument("size_based needs max_avg_column_size and max_columns_in_group")
    out: list[list[str]] = [[]]
    for c in columns:
        if out[-1] and (len(out[-1]) >= most or sizes[c] >= largest):
            out.append([])
        out[-1].append(c)
    return [g for g in out if g]


def groups_of(df: DataFrame, properties: Properties) -> list[list[str]]:
    policy = properties["writer.policy"]
    if policy == "single":
        return single(df.columns)
    if policy == "schema_based":
        formats, patterns = properties["writer.split.schema_based.formats"], properties["writer.split.schema_based.patterns"]
        if not patterns or formats and len(formats) != len(patterns):
            raise InvalidArgument("schema_based needs patterns, and as many formats if any")
        for f in formats:
            properties.writable_format(f)
        return by_patterns(df.columns, patterns)
    return by_size(df.columns, average_bytes(df), properties["writer.split.size_based.max_avg_column_size"], properties["writer.split.size_based.max_columns_in_group"])
