"""DataFrames written as column groups.

Rows get ordinals once; every group is written from that same numbered table and
stores the ordinal and the range of ordinals that a row is in.  Ranges are dealt
into buckets, a file each, in order.  Groups of one write therefore join without
a shuffle or a sort, and a request for rows opens the files of their ranges alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lamellar import faults
from lamellar.errors import InvalidArgument
from lamellar.manifest import ColumnGroup, Fragment
from lamellar.operators import grouping
from lamellar.properties import Properties
from lamellar.sources.store import Store, shared_path

#: The stored ordinal, and the number of the range that it is in.
ROW, RANGE = "__row", "__range"
#: Spark's own limit of buckets, and ranges to a bucket on average, so that buckets are alike.
MOST_BUCKETS, RANGES = 100_000, 4
#: Rows that one task writes, to as many files as they make: tasks each report to the driver.
TASK_ROWS = 65_536


def _scans_files(df: DataFrame) -> bool:
    """Whether df reads files as they are, but for projections and filters, so that rows of one piece of a file stay together and in order."""

    def narrow(plan) -> bool:
        kind, inner = plan.getClass().getSimpleName(), plan.children()
        if inner.size() == 0:
            return kind == "LogicalRelation" and any(plan.metadataOutput().apply(i).name() == "_metadata" for i in range(plan.metadataOutput().size()))
        return kind in ("Project", "Filter", "SubqueryAlias") and narrow(inner.apply(0))

    return narrow(df._jdf.queryExecution().analyzed())


def numbered(df: DataFrame, order_by: Sequence[str] = (), settle: bool = True) -> tuple[DataFrame, int]:
    """df with ROW = 0, 1, ... and the number of rows.

    The numbers follow order_by; or else, in a scan of files, the order of their
    paths and of rows in them, whatever partitions Spark makes of them (it puts large
    files first); or else the order of partitions and of rows in them.  settle keeps
    the rows in the shared folder first, so that counting and all groups see one
    order; it may be left out for plain file scans alone, which repeat theirs.
    """
    spark, keys = df.sparkSession, ["__part"]
    if {ROW, RANGE} & set(df.columns):
        raise InvalidArgument(f"{ROW} and {RANGE} are reserved")
    if order_by:
        df = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order_by).sortWithinPartitions(*order_by)
    elif _scans_files(df):
        own, keys = df.metadataColumn("_metadata"), ["__path", "__start", "__part"]
        df = df.select("*", own.getField("file_path").alias("__path"), own.getField("file_block_start").alias("__start"))
    if settle or order_by:
        shared_path(spark, "rows")
        df = df.checkpoint()
    tagged = df.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = tagged.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__place").alias("first")).collect()  # a row for each partition, or piece of a file
    base, done = [], 0
    for piece in sorted(counts, key=lambda r: r[: len(keys)]):
        base.append((*piece[: len(keys)], done - piece["first"]))
        done += piece["n"]
    starts = spark.createDataFrame(base, ", ".join(f"{k} {tagged.schema[k].dataType.simpleString()}" for k in keys) + ", __base long")
    number = F.coalesce(F.col("__base") + F.col("__place"), F.raise_error(F.lit("the rows moved while they were numbered; write them with settle")).cast("long"))
    return tagged.join(F.broadcast(starts), keys, "left").withColumn(ROW, number).drop(*keys, "__place", "__base"), done


def write(df: DataFrame, root: str, properties: Properties | None = None, order_by: Sequence[str] = (), groups: Sequence[Sequence[str]] | None = None, settle: bool = True) -> list[ColumnGroup]:
    """Write the groups of df below root/_data; nothing refers to them before a commit.  An empty df gives no groups; a write that fails leaves no files."""
    faults.hit("write")
    properties = properties or Properties()
    fmt = properties.writable_format(properties["writer.format"])
    if len(set(df.columns)) != len(df.columns):
        raise InvalidArgument("column names repeat")
    if groups is None:
        groups = grouping.groups_of(df, properties) if properties["writer.policy"] != "size_based" or df.take(1) else grouping.single(df.columns)
    if sorted(c for g in groups for c in g) != sorted(df.columns):
        raise InvalidArgument("groups must have each column once")
    rows, n = numbered(df, order_by, settle)
    if not n:
        return []
    buckets = max(1, min(MOST_BUCKETS, -(-n // _file_rows(df, properties))))
    span = -(-n // (RANGES * buckets)) if buckets > 1 else n
    rows = rows.withColumn(RANGE, F.floor(F.col(ROW) / span).cast("int"))
    out, store = [], Store(df.sparkSession, root)
    paths = [f"{root.rstrip('/')}/_data/{i}_{uuid.uuid4().hex}.parquet" for i in range(len(groups))]
    try:
        for g, path in zip(groups, paths, strict=True):
            _write_group(rows.select(*[F.col(f"`{c}`") for c in g], RANGE, ROW), path, buckets, n, properties)
            out.append(ColumnGroup(tuple(g), (Fragment(path, 0, n, buckets, n, span, bytes=store.total_size(path)),), fmt))
    except Exception:
        for path in paths:
            store.delete(path)
        raise
    return out


def _file_rows(df: DataFrame, properties: Properties) -> int:
    """Rows of a file: writer.file_rolling.rows, or fewer if those exceed writer.file_rolling.size bytes, where that is set."""
    rows, size = properties["writer.file_rolling.rows"], properties["writer.file_rolling.size"]
    return max(1, min(rows, int(size / max(1.0, sum(grouping.average_bytes(df).values()))))) if size and df.take(1) else rows


def _write_group(rows: DataFrame, path: str, buckets: int, n: int, properties: Properties) -> None:
    table, seen = f"lamellar_w_{uuid.uuid4().hex}", Observation()
    tasks = max(1, min(buckets, -(-n // TASK_ROWS)))
    bucket = F.pmod(F.hash(RANGE), F.lit(buckets))  # as Spark deals rows into buckets, each of which is one task's
    dealt = (rows.repartition(buckets, RANGE) if tasks == buckets else rows.repartitionById(tasks, F.pmod(bucket, F.lit(tasks)))).observe(seen, F.count(F.lit(1)).alias("n"))
    writer = dealt.write.format("parquet").option("path", path).option("compression", properties["writer.compression"]).option("parquet.block.size", properties["writer.row_group_size"]).option("parquet.enable.dictionary", str(properties["writer.enable_dictionary"]).lower())
    if properties["writer.compression"] == "zstd":
        writer = writer.option("parquet.compression.codec.zstd.level", properties["writer.compression_level"])
    writer.bucketBy(buckets, RANGE).sortBy(RANGE, ROW).saveAsTable(table)
    rows.sparkSession.sql(f"DROP TABLE {table}")  # an external table: its files stay
    if (written := seen.get["n"]) != n:
        raise RuntimeError(f"{written} rows were written to {path}, {n} were counted; write them with settle")
