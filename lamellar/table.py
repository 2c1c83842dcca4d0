"""A table's snapshot: scans, random access and chunks as DataFrames."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamellar import faults
from lamellar.errors import InvalidArgument
from lamellar.functions import predicate as P
from lamellar.manifest import ColumnGroup, Fragment, Manifest
from lamellar.operators import deletes
from lamellar.operators.commit import load
from lamellar.properties import Properties
from lamellar.sources.store import normal, plain_path
from lamellar.sources.writer import RANGE, ROW

#: Positions of a file with deletes whose living rows are numbered together.
BLOCK_ROWS = 32_768
#: Ranges, and rows, that are listed in a filter; more are found by bounds, or by a join.
LISTED, LISTED_ROWS = 1000, 50
#: Rows of a request that one task sorts.
SORTED_ROWS = 10_000


class Table:
    """One version of a table.  schema: the logical columns, by default those stored; others read as NULL."""

    def __init__(self, spark: SparkSession, manifest: Manifest, schema: T.StructType | None = None, properties: Properties | None = None):
        self.spark, self.manifest, self.properties = spark, manifest, properties or Properties()
        self._frames: dict[tuple, DataFrame] = {}
        self.schema = schema or T.StructType([f for f in manifest.struct.fields if f.name in manifest.columns])
        if len({g.rows for g in manifest.groups}) > 1:
            raise InvalidArgument("column groups differ in their number of rows")

    @classmethod
    def load(cls, spark: SparkSession, root: str, version: int | None = None, schema: T.StructType | None = None, properties: Properties | None = None) -> "Table":
        faults.hit("open_reader")
        return cls(spark, load(spark, root, version), schema, properties)

    # Projection

    def _columns(self, columns: Sequence[str] | None) -> list[str]:
        names = self.schema.fieldNames()
        if not columns:
            if not names:
                raise InvalidArgument("an empty table needs a schema")
            return list(names)
        if len(set(columns)) != len(columns):
            raise InvalidArgument("columns repeat")
        if missing := [c for c in columns if c not in names]:
            raise InvalidArgument(f"unknown columns {missing}")
        return list(columns)

    def _fragment(self, group: ColumnGroup, k: int, columns: list[str], base: int, low: int | None = None, high: int | None = None, numbered: bool = True, only: Sequence[tuple[int, int]] | None = None, glued: bool = False) -> DataFrame:
        """Given columns and ROW, as stored in a fragment that begins at row base; low and high bound the table's rows, and only the runs of them that are asked for.

        glued adds RANGE, and then the rows come as Spark knows them to be bucketed and sorted by both.
        """
        f = group.fragments[k]
        types = {x.name: x for x in self.manifest.struct.fields}
        if not f.buckets:
            return self._external(f, T.StructType([types[c] for c in columns]), base, low, high, numbered)
        shift = base - f.start
        first = max(f.start, f.start if low is None else low - shift)
        last = min(f.end, f.end if high is None else high - shift)
        runs = [(first, last)] if only is None else [(max(first, a - shift), min(last, b - shift)) for a, b in only]
        asked = {i for a, b in runs if a < b for i in range(a // f.span, -(-b // f.span))}
        listed = len(asked) <= LISTED and len(asked) * f.span < f.total
        key = (f.path, group.columns, glued or listed)
        if key not in self._frames:  # files never change: they are listed once for a table
            inner = T.StructType([*(types[c] for c in group.columns), T.StructField(RANGE, T.IntegerType()), T.StructField(ROW, T.LongType())])
            self._frames[key] = self._bucketed(f, inner) if glued or listed else self.spark.read.schema(inner).parquet(f.path)
        rows = self._frames[key]
        if listed:
            rows = rows.where(F.col(RANGE).isin(sorted(asked)))  # so other files aren't opened
        if first > 0 or last < f.total:
            rows = rows.where((F.col(ROW) >= first) & (F.col(ROW) < last))
        if only is not None and len(only) <= LISTED_ROWS and all(b - a == 1 for a, b in only):
            rows = rows.where(F.col(ROW).isin([a for a, b in runs if a < b]))  # reaches Parquet's statistics
        return rows.select(*[F.col(f"`{c}`") for c in columns], *([RANGE] if glued else []), ROW)

    def _bucketed(self, f: Fragment, inner: T.StructType) -> DataFrame:
        for name in ("spark.sql.legacy.bucketedTableScan.outputOrdering", "spark.sql.requireAllClusterKeysForCoPartition"):
            self.spark.conf.set(name, str(name.endswith("Ordering")).lower())  # buckets are one sorted file each; groups meet by RANGE, then ROW
        name = f"lamellar_r_{uuid.uuid4().hex}"
        fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in inner.fields)
        self.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({RANGE}) SORTED BY ({RANGE}, {ROW}) INTO {f.buckets} BUCKETS LOCATION '{f.path}'")
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the catalog forgets it, the plan and the files stay

    def _external(self, f: Fragment, kept: T.StructType, base: int, low: int | None, high: int | None, numbered: bool) -> DataFrame:
        rows = self.spark.read.schema(kept).parquet(f.path).select("*", F.col("_metadata.row_index").alias("__pos"), F.col("_metadata.file_path").alias("__file"))
        rows = rows.where((F.col("__pos") >= f.start) & (F.col("__pos") < f.end))
        if f.deletes:
            dels = self.spark.read.parquet(f.deletes)
            gone = dels.where(plain_path(F.col("file_path")) == normal(f.path)) if "file_path" in dels.columns else dels
            rows = deletes.without_vector(rows, gone)
            if numbered:
                rows = self._living(rows, gone, f, None if low is None else low - base, None if high is None else high - base)
            else:
                rows = rows.withColumn(ROW, F.lit(None).cast("long"))
        else:
            rows = rows.withColumn(ROW, F.col("__pos") - f.start)
        out = rows.drop("__pos", "__file").withColumn(ROW, F.col(ROW) + base)
        for bound, keep in ((low, F.col(ROW) >= (low or 0)), (high, F.col(ROW) < (high or 0))):
            out = out if bound is None else out.where(keep)
        return out.withColumn(ROW, F.col(ROW) - base + f.start)

    def _external_files(self, fragments: Sequence[Fragment], columns: list[str]) -> DataFrame:
        """Given columns of whole external files, less what is deleted; ROW is NULL."""
        types = {x.name: x for x in self.manifest.struct.fields}
        kept = T.StructType([types[c] for c in columns])
        rows = self.spark.read.schema(kept).parquet(*[f.path for f in fragments])
        gone = deletes.of_files(self.spark, fragments)
        if gone is not None:
            rows = deletes.without_positions(rows.select("*", plain_path(F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__pos")), gone).drop("__file", "__pos")
        return rows.withColumn(ROW, F.lit(None).cast("long"))

    def _living(self, rows: DataFrame, gone: DataFrame, f: Fragment, low: int | None, high: int | None) -> DataFrame:
        """rows of one file that live, with ROW, their ordinal among them; low and high, ordinals too, leave out blocks of positions outside."""
        block = lambda pos: F.floor((pos - f.start) / BLOCK_ROWS)
        order = gone.select(F.col("pos").cast("long").alias("pos")).where((F.col("pos") >= f.start) & (F.col("pos") < f.end)).distinct()
        less = {r["b"]: r["n"] for r in order.groupBy(block(F.col("pos")).alias("b")).agg(F.count("*").alias("n")).collect()}  # a number for each block
        bases, before = [], 0
        for b, at in enumerate(range(f.start, f.end, BLOCK_ROWS)):
            live = min(BLOCK_ROWS, f.end - at) - less.get(b, 0)
            if live and (low is None or before + live > low) and (high is None or before < high):
                bases.append((b, before))
            before += live
        if bases:
            rows = rows.where((F.col("__pos") >= f.start + bases[0][0] * BLOCK_ROWS) & (F.col("__pos") < f.start + (bases[-1][0] + 1) * BLOCK_ROWS))
        known = self.spark.createDataFrame(bases, "__block long, __base long")
        place = F.row_number().over(Window.partitionBy("__block").orderBy("__pos"))
        numbers = rows.withColumn("__block", block(F.col("__pos"))).withColumn("__place", place)
        return numbers.join(F.broadcast(known) if len(bases) <= deletes.BROADCAST_ROWS else known, "__block").withColumn(ROW, F.col("__base") + F.col("__place") - 1).drop("__block", "__base", "__place")

    def rows(self, columns: Sequence[str] | None = None, low: int | None = None, high: int | None = None, numbered: bool = True, only: Sequence[tuple[int, int]] | None = None) -> DataFrame:
        """Given columns, in that order, and ROW, their number in the table; rows in [low, high), or at least the runs [a, b) of them in only.

        Only groups that hold a column are read.  The groups of one write are joined
        by their stored range and ordinal, file by file, without a shuffle or a sort.
        Columns that are not stored are NULL; if none is, the first group gives the
        number of rows.
        Where numbered is false, ROW may be NULL, as numbers among deletes cost a shuffle.
        """
        columns = self._columns(columns)
        types = {f.name: f.dataType for f in self.schema.fields}
        stored = [c for c in columns if self.manifest.group_of(c) is not None]
        if not self.manifest.groups:
            return self.spark.createDataFrame([], T.StructType([self.schema[c] for c in columns] + [T.StructField(ROW, T.LongType())]))
        used = sorted({self.manifest.group_of(c) for c in stored}) or [0]
        parts: list[DataFrame] = []
        groups = [self.manifest.groups[i] for i in used]
        bounded = low is not None or high is not None
        aligned = len({tuple(f.rows for f in g.fragments) for g in groups}) == 1
        if aligned:
            base, together = 0, {}
            if len(groups) == 1 and not numbered and not bounded:  # whole external files in one scan
                for k, f in enumerate(groups[0].fragments):
                    if not f.buckets and f.start == 0 and f.end == f.total:
                        together.setdefault(f.path, k)
                parts += [self._external_files([groups[0].fragments[k] for k in together.values()], stored)] if together else []
            done = set(together.values())
            for k, f in enumerate(groups[0].fragments):
                if k in done:
                    continue
                if (high is None or base < high) and (low is None or base + f.rows > low):
                    glued = None
                    shifts = {g.fragments[k].start for g in groups}
                    whole = len(groups) > 1 and len({(g.fragments[k].start, g.fragments[k].buckets, g.fragments[k].span) for g in groups}) == 1 and f.buckets > 0
                    for g in groups:
                        own = self._fragment(g, k, [c for c in stored if c in g.columns], base, low, high, numbered or bounded or len(groups) > 1, only, whole)
                        if len(shifts) > 1:
                            own = own.withColumn(ROW, F.col(ROW) - g.fragments[k].start)
                        glued = own if glued is None else glued.join(own.hint("merge"), [RANGE, ROW]) if whole else glued.join(own, ROW)
                    glued = glued.drop(RANGE)
                    shift = base - (0 if len(shifts) > 1 else groups[0].fragments[k].start)
                    parts.append(glued.withColumn(ROW, F.col(ROW) + shift) if shift else glued)
                base += f.rows
        else:  # a group added later: its fragments are cut at other rows
            glued = None
            for g in groups:
                base, own = 0, None
                for k, f in enumerate(g.fragments):
                    if (high is None or base < high) and (low is None or base + f.rows > low):
                        part = self._fragment(g, k, [c for c in stored if c in g.columns], base, low, high)
                        part = part.withColumn(ROW, F.col(ROW) + (base - f.start)) if base != f.start else part
                        own = part if own is None else own.unionByName(part)
                    base += f.rows
                if own is not None:
                    glued = own if glued is None else glued.join(own, ROW)
            parts = [glued] if glued is not None else []
        if not parts:
            return self.spark.createDataFrame([], T.StructType([self.schema[c] for c in columns] + [T.StructField(ROW, T.LongType())]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(*[F.col(f"`{c}`") if c in stored else F.lit(None).cast(types[c]).alias(c) for c in columns], ROW)

    # Scans

    def scan(self, columns: Sequence[str] | None = None, predicate: str | None = None, best_effort: bool = False, ordered: bool = False, limit: int | None = None) -> DataFrame:
        """Rows for which the predicate is true, which may use columns outside the projection; best_effort: a superset of them.  limit: at most so many, the first ones if ordered."""
        columns = self._columns(columns)
        if predicate is None:
            out = self.rows(columns, numbered=ordered)
        else:
            parsed = P.parse(self.spark, predicate, self.schema, best_effort)
            needed = _references(self.spark, self.schema.fieldNames(), parsed.text)  # groups without any are not read
            out = self.rows([*columns, *[c for c in needed if c not in columns]], numbered=ordered)
            out = out if parsed.text is None else out.where(parsed.column)
        out = out.orderBy(ROW) if ordered else out
        return (out if limit is None else out.limit(limit)).select(columns)

    def view(self, name: str) -> DataFrame:
        """Register the table for SQL: joins, aggregates and windows are Spark's."""
        out = self.scan()
        out.createOrReplaceTempView(name)
        return out

    def count(self) -> int:
        """From the manifest alone."""
        return self.manifest.rows

    # Random access

    def take(self, rows: Sequence[int] | DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """The rows with the given numbers, strictly rising, in that order; no predicate applies.

        Many numbers can be given as a DataFrame with one column and never pass the
        driver: then they may come in any order and repeatedly, null and unknown
        ones give no row.
        """
        faults.hit("take")
        columns = self._columns(columns)
        if isinstance(rows, DataFrame):
            wanted = rows.select(F.col(rows.columns[0]).cast("long").alias(ROW)).distinct()
            return self.rows(columns).join(wanted, ROW, "left_semi").orderBy(ROW).select(columns)
        rows = [int(r) for r in rows]
        if any(b <= a for a, b in zip(rows, rows[1:])):
            raise InvalidArgument("row numbers must rise")
        if rows and (rows[0] < 0 or rows[-1] >= self.manifest.rows):
            raise InvalidArgument("row number out of range")
        if not rows:
            return self.rows(columns).limit(0).select(columns)
        near = self.rows(columns, rows[0], rows[-1] + 1, only=[(r, r + 1) for r in rows])
        if len(rows) <= LISTED_ROWS:
            found = near.where(F.col(ROW).isin(rows))
        else:
            wanted = self.spark.createDataFrame([(r,) for r in rows], f"{ROW} long")
            found = near.join(F.broadcast(wanted) if len(rows) <= self.properties["reader.take.broadcast_rows"] else wanted, ROW, "left_semi")
        # A few rows are sorted by one task, without a job that samples them first.
        return (found.repartition(1).sortWithinPartitions(ROW) if len(rows) <= SORTED_ROWS else found.orderBy(ROW)).select(columns)

    # Chunks

    def chunks(self, group: int = 0, columns: Sequence[str] | None = None) -> "Chunks":
        return Chunks(self, group, columns)


def _references(spark: SparkSession, names: list[str], text: str | None) -> list[str]:
    """Columns that an expression uses, as Spark's parser sees them."""
    if text is None:
        return []
    tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    found: list[str] = []

    def walk(e) -> None:
        if e.getClass().getSimpleName() == "UnresolvedAttribute":
            found.append(e.nameParts().apply(0))
        children = e.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(tree)
    lower = {n.lower(): n for n in names}
    return sorted({lower[x.lower()] for x in found if x.lower() in lower})


class Chunks:
    """Runs of rows of a column group, at most reader.logical_chunk_rows long and never over a fragment's end."""

    def __init__(self, table: Table, group: int, columns: Sequence[str] | None):
        if not 0 <= group < len(table.manifest.groups):
            raise InvalidArgument("no such column group")
        own = table.manifest.groups[group]
        self.columns = [c for c in (columns or own.columns) if c in own.columns]
        if not self.columns:
            raise InvalidArgument("the group has none of these columns")
        self.table, self.group, size = table, group, table.properties["reader.logical_chunk_rows"]
        self.bounds, base = [], 0
        for f in own.fragments:
            self.bounds += [(base + a, base + min(a + size, f.rows)) for a in range(0, f.rows, size)]
            base += f.rows
        self._starts = [a for a, _ in self.bounds]

    def __len__(self) -> int:
        return len(self.bounds)

    def row_counts(self) -> list[int]:
        return [b - a for a, b in self.bounds]

    def of_rows(self, rows: Sequence[int]) -> list[int]:
        """Chunks of the given rows, each once, as first met."""
        if any(r < 0 or r >= (self.bounds[-1][1] if self.bounds else 0) for r in rows):
            raise InvalidArgument("row number out of range")
        return list(dict.fromkeys(bisect_right(self._starts, r) - 1 for r in rows))

    def read(self, chunk: int) -> DataFrame:
        return self.read_many([chunk])

    def read_many(self, chunks: Sequence[int]) -> DataFrame:
        """Rows of the chunks in the order given; a chunk named twice comes twice."""
        faults.hit("chunk")
        if any(not 0 <= c < len(self.bounds) for c in chunks):
            raise InvalidArgument("chunk out of range")
        if not chunks:
            return self.table.rows(self.columns).limit(0).select(self.columns)
        low, high = min(self.bounds[c][0] for c in chunks), max(self.bounds[c][1] for c in chunks)
        asked = self.table.spark.createDataFrame([(i, *self.bounds[c]) for i, c in enumerate(chunks)], "__ask long, __low long, __high long")
        rows = self.table.rows(self.columns, low, high, only=[self.bounds[c] for c in chunks])
        wanted = None
        for a, b in sorted({self.bounds[c] for c in chunks}):
            one = (F.col(ROW) >= a) & (F.col(ROW) < b)
            wanted = one if wanted is None else wanted | one
        rows = rows.where(wanted) if len(chunks) <= 100 else rows
        found = rows.join(F.broadcast(asked), (F.col(ROW) >= F.col("__low")) & (F.col(ROW) < F.col("__high")))
        return found.orderBy("__ask", ROW).select(self.columns)

    def sizes(self) -> list[int]:
        """Stored bytes of each chunk, as its share of its fragment's files; 0 for external files, whose sizes a manifest doesn't know."""
        own = self.table.manifest.groups[self.group].fragments
        each = [f.bytes / f.total if f.bytes and f.total else 0.0 for f in own]
        ends = [sum(f.rows for f in own[: k + 1]) for k in range(len(own))]
        return [round((b - a) * each[bisect_right(ends, a)]) for a, b in self.bounds]

    def statistics(self) -> DataFrame:
        """chunk, column, rows, nulls, nans, least, greatest (as text), total (the sum of numbers) and bytes of each column's values."""
        size = self.table.properties["reader.logical_chunk_rows"]
        starts = self.table.spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(self.bounds)], "chunk long, __low long, __high long")
        rows = self.table.rows(self.columns)
        if self._starts == list(range(0, len(self._starts) * size, size)):
            rows = rows.withColumn("chunk", F.floor(F.col(ROW) / size))
        else:
            rows = rows.join(F.broadcast(starts), (F.col(ROW) >= F.col("__low")) & (F.col(ROW) < F.col("__high")))
        aggs = []
        for i, c in enumerate(self.columns):
            v = F.col(f"`{c}`")
            text = v.cast("string") if not isinstance(self.table.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.to_json(F.struct(v))
            kind = self.table.schema[c].dataType
            number, broken = isinstance(kind, T.NumericType), isinstance(kind, (T.FloatType, T.DoubleType))
            nans = F.sum(F.isnan(v).cast("long")) if broken else F.lit(0).cast("long")
            total = F.sum((F.when(~F.isnan(v), v) if broken else v).cast("double")) if number else F.lit(None).cast("double")
            aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.sum(v.isNull().cast("long")).alias("nulls"), F.coalesce(nans, F.lit(0)).alias("nans"), total.alias("total"), (F.min(v) if not isinstance(self.table.schema[c].dataType, T.MapType) else F.lit(None)).cast("string").alias("least"), (F.max(v) if not isinstance(self.table.schema[c].dataType, T.MapType) else F.lit(None)).cast("string").alias("greatest"), F.sum(F.octet_length(text)).alias("bytes")).alias(f"s{i}"))
        out = rows.groupBy("chunk").agg(*aggs)
        return out.select("chunk", F.explode(F.array(*[F.col(f"s{i}") for i in range(len(self.columns))])).alias("s")).select("chunk", "s.*")
