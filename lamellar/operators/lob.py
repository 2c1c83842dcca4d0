"""Large values kept apart: short ones stay in the row, long ones go to files of their own and are joined back on read."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamellar.errors import InvalidArgument
from lamellar.manifest import ColumnGroup, LobFile
from lamellar.properties import Properties
from lamellar.sources import writer
from lamellar.sources.store import Store
from lamellar.table import Table

#: Fixed values of the reference encoding: flags, and bytes of a reference to a file.
INLINE, STORED, REFERENCE_BYTES = b"\x00", b"\x01", 24


#: Rows of a request whose references are read first, so that only their values are.
LISTED = 1000


def encode_inline(value: bytes) -> bytes:
    return INLINE + value


def encode_reference(file_id: uuid.UUID, row: int) -> bytes:
    """Flag, three zero bytes, the file's id and the row in it."""
    return STORED + bytes(3) + file_id.bytes + struct.pack("<i", row)


def decode(reference: bytes) -> bytes | tuple[uuid.UUID, int]:
    """The value itself, or file and row."""
    if reference[:1] == INLINE:
        return reference[1:]
    if reference[:1] != STORED or len(reference) != REFERENCE_BYTES:
        raise InvalidArgument("not a reference")
    return uuid.UUID(bytes=reference[4:20]), struct.unpack("<i", reference[20:])[0]


def _value(c: str) -> Column:
    return F.col(f"`{c}`").cast("binary")


def split(df: DataFrame, column: str, path: str, properties: Properties | None = None) -> DataFrame:
    """df with the column as a reference: its bytes after a zero if they are fewer than the threshold, else where they lie below path.

    NULL stays NULL.  Equal values are stored once, under a hash of theirs, so a lost
    task or a second evaluation names them alike; a file's values are sorted by it,
    so that a reader of few values skips the others.
    """
    properties = properties or Properties()
    least = properties["lob.inline_threshold"]
    long = F.octet_length(_value(column)) >= least
    key = F.unhex(F.substring(F.sha2(_value(column), 256), 1, 40))  # file id and row of a reference, as one key of 20 bytes
    stored = df.where(long).select(key.alias("key"), _value(column).alias("value"))
    stored.dropDuplicates(["key"]).sortWithinPartitions("key").write.option("parquet.block.size", properties["writer.row_group_size"]).option("maxRecordsPerFile", properties["lob.rows_per_file"]).option("compression", properties["writer.compression"]).parquet(path)
    reference = F.when(long, F.concat(F.lit(STORED + bytes(3)), key)).otherwise(F.concat(F.lit(INLINE), _value(column)))
    return df.withColumn(column, F.when(_value(column).isNull(), F.lit(None).cast("binary")).otherwise(reference))


def resolve(df: DataFrame, column: str, stored: DataFrame, kind: str = "string") -> DataFrame:
    """df with values again in place of references; stored: key and value of all files.  A malformed reference is an error."""
    c = F.col(f"`{column}`")
    flag = F.substring(c, 1, 1)
    bad = ~((flag == F.lit(INLINE)) | (flag == F.lit(STORED)) & (F.octet_length(c) == REFERENCE_BYTES))
    keyed = df.withColumn("__key", F.when(flag == F.lit(STORED), F.substring(c, 5, 20)))
    joined = keyed.join(stored.select(F.col("key").alias("__stored"), F.col("value").alias("__value")), F.col("__key") == F.col("__stored"), "left")
    value = F.when(c.isNull(), F.lit(None)).when(bad, F.raise_error(F.lit("not a reference"))).when(flag == F.lit(INLINE), F.expr(f"substring(`{column}`, 2)")).otherwise(F.coalesce("__value", F.raise_error(F.lit("value missing"))))
    return joined.withColumn(column, value.cast(kind)).select(df.columns)


def statistics(df: DataFrame, column: str) -> DataFrame:
    """total, nulls, inline and stored references of a split column, and the bytes of the inline ones."""
    flag = F.substring(F.col(f"`{column}`"), 1, 1)
    return df.agg(F.count("*").alias("total"), F.sum(F.col(f"`{column}`").isNull().cast("long")).alias("nulls"), F.sum((flag == F.lit(INLINE)).cast("long")).alias("inline"), F.sum((flag == F.lit(STORED)).cast("long")).alias("stored"), F.sum(F.when(flag == F.lit(INLINE), F.octet_length(f"`{column}`") - 1)).alias("inline_bytes"))


class Segment:
    """A table with large columns: references in the column groups, values beside them."""

    def __init__(self, table: Table, stored: dict[str, list[LobFile]], kinds: dict[str, str]):
        self.table, self.stored, self.kinds = table, stored, kinds

    @staticmethod
    def write(df: DataFrame, root: str, columns: Sequence[str], properties: Properties | None = None) -> tuple[list[ColumnGroup], list[LobFile], T.StructType]:
        """Groups, large-object files and the stored schema; nothing is committed.  If a write fails, values already written are removed."""
        properties, files, paths, out = properties or Properties(), [], [], df
        store = Store(df.sparkSession, root)
        try:
            for c in columns:
                paths.append(path := store.at(f"_lobs/{c}/{uuid.uuid4().hex}.parquet"))
                out = split(out, c, path, properties)
                n = df.sparkSession.read.parquet(path).agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("b")).first()
                files.append(LobFile(c, path, n["n"], n["n"], n["b"] or 0))
            return writer.write(out, root, properties), files, out.schema
        except Exception:
            for path in paths:
                store.delete(path)
            raise

    @classmethod
    def open(cls, spark: SparkSession, root: str, kinds: dict[str, str], version: int | None = None) -> "Segment":
        """kinds: the type ("string" or "binary") of each large column."""
        table = Table.load(spark, root, version)
        return cls(table, {c: table.manifest.lobs_of(c) for c in kinds}, kinds)

    def _columns(self, columns: Sequence[str] | None) -> list[str]:
        """In the schema's order; unknown names are passed over."""
        own = [c for c in self.table.schema.fieldNames() if not columns or c in columns]
        if not own:
            raise InvalidArgument("no known column")
        return own

    def values(self, column: str, keys: Sequence[bytes] | None = None, paths: Sequence[str] | None = None) -> DataFrame:
        """key and value of a column's stored values: all, those of the given keys (file id and row, 20 bytes), those of some files.

        Few keys become a filter that skips files' parts by their statistics; many are joined.
        """
        spark = self.table.spark
        own = [f.path for f in self.stored[column] if paths is None or f.path in paths]
        if not own:
            return spark.createDataFrame([], "key binary, value binary")
        stored = spark.read.parquet(*own)
        if keys is not None and len(keys) <= LISTED:
            stored = stored.where(F.col("key").isin([F.lit(bytes(k)) for k in keys]) if keys else F.lit(False))
        elif keys is not None:
            asked = spark.createDataFrame([(bytearray(k),) for k in dict.fromkeys(map(bytes, keys))], "key binary")
            stored = stored.join(asked, "key", "left_semi")
        return stored.dropDuplicates(["key"]) if len(own) > 1 else stored

    def resolved(self, df: DataFrame, keys: dict[str, Sequence[bytes]] | None = None) -> DataFrame:
        for c, kind in self.kinds.items():
            if c in df.columns:
                df = resolve(df, c, self.values(c, keys and keys.get(c)), kind)
        return df

    def statistics(self, column: str) -> DataFrame:
        """statistics() of a column, and its stored_values, stored_bytes and files from the manifest: values that several rows share count once in each file."""
        files = self.stored[column]
        return statistics(self.table.scan([column]), column).select("*", F.lit(sum(f.rows for f in files)).cast("long").alias("stored_values"), F.lit(sum(f.bytes for f in files)).cast("long").alias("stored_bytes"), F.lit(len(files)).alias("files"))

    def scan(self, columns: Sequence[str] | None = None, predicate: str | None = None) -> DataFrame:
        """Rows with their values; a predicate may use large columns too, and then applies after they are joined."""
        own = self._columns(columns)
        if predicate is None:
            return self.resolved(self.table.scan(own))
        return self.resolved(self.table.scan()).where(F.expr(predicate)).select(own)

    def take(self, rows: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
        own = self._columns(columns)
        wanted, keys = self.table.take(rows, own).withColumn("__order", F.monotonically_increasing_id()), None
        if len(rows) <= LISTED:
            reference = lambda c: F.when(F.substring(c, 1, 1) == F.lit(STORED), F.substring(c, 5, 20))
            large = [c for c in self.kinds if c in own]
            seen = wanted.select([reference(F.col(f"`{c}`")).alias(c) for c in large]).collect() if large else []  # at most LISTED rows of 20 bytes
            keys = {c: list({bytes(r[c]) for r in seen if r[c] is not None}) for c in large}
        return self.resolved(wanted, keys).orderBy("__order").select(own)

    def chunks(self, group: int = 0):
        """Chunks hold references, not values."""
        return self.table.chunks(group)
