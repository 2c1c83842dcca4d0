"""Registered queries of the table layer with the SQL that gives their rows on the plain tables.

Each query writes whole tables under some layout and reads them back in some way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamellar.functions import vectors
from lamellar.manifest import Fragment
from lamellar.operators import deletes
from lamellar.operators.commit import Transaction
from lamellar.operators.lob import Segment
from lamellar.properties import Properties
from lamellar.sources import external, writer
from lamellar.sources.store import shared_path
from lamellar.streaming.sink import append_batches
from lamellar.table import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patterns(*p: str) -> Properties:
    return Properties({"writer.policy": "schema_based", "writer.split.schema_based.patterns": p})


def stored(df: DataFrame, properties: Properties | None = None) -> str:
    """A new table with the rows of df, which is a plain scan, in one append."""
    root = shared_path(df.sparkSession, "table")
    Transaction(df.sparkSession, root).append(writer.write(df, root, properties, settle=False), df.schema).commit()
    return root


def table(spark: SparkSession, sf_dir: str, name: str, properties: Properties | None = None, **more) -> Table:
    return Table.load(spark, stored(source(spark, sf_dir, name), properties), **more)


ORDERS = patterns("o_orderkey|o_custkey", "o_totalprice|o_orderdate")
SIZES = Properties({"writer.policy": "size_based", "writer.split.size_based.max_avg_column_size": 64, "writer.split.size_based.max_columns_in_group": 2})


# Scans and projections


@query("s01_scan_projected", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def _(spark, d):
    return table(spark, d, "orders", ORDERS).scan(["o_orderkey", "o_totalprice"], "o_totalprice > 100000")


@query("s01_scan_multi_group", "SELECT * FROM orders")
def _(spark, d):
    return table(spark, d, "orders", ORDERS).scan()


@query("s02_scan_single_group", "SELECT * FROM customer")
def _(spark, d):
    return table(spark, d, "customer").scan()


@query("s03_glue_size_groups", "SELECT * FROM events")
def _(spark, d):
    return table(spark, d, "events", SIZES).scan()


@query("s06_scan_all_missing", "SELECT CAST(NULL AS BIGINT) AS phantom FROM nation")
def _(spark, d):
    return table(spark, d, "nation", schema=T.StructType([T.StructField("phantom", T.LongType())])).scan(["phantom"])


@query("s08_append_two_files", "SELECT * FROM part")
def _(spark, d):
    part = source(spark, d, "part")
    root = stored(part.where("p_partkey % 2 = 0"), patterns("p_partkey|p_name"))
    more = part.where("p_partkey % 2 = 1")
    Transaction(spark, root).append(writer.write(more, root, patterns("p_partkey|p_name")), more.schema).commit()
    return Table.load(spark, root).scan()


@query("s09_subrange", "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def _(spark, d):
    def cut(files: list[Fragment]) -> list[Fragment]:
        base, out = 0, []
        for f in files:
            low, high = max(0, 100 - base), min(f.rows, 900 - base)
            out += [Fragment(f.path, low, high)] if low < high else []
            base += f.rows
        return out

    return external_table(spark, d, "orders", "o_orderkey", cut).scan()


@query("s27_row_numbers", "SELECT o_orderkey, o_orderkey AS row_number FROM orders WHERE o_totalprice > 200000")
def _(spark, d):
    return table(spark, d, "orders", ORDERS).rows(["o_orderkey", "o_totalprice"]).where("o_totalprice > 200000").select("o_orderkey", F.col(writer.ROW).alias("row_number"))


@query("p01_projection_reorder", "SELECT o_totalprice, o_orderkey FROM orders")
def _(spark, d):
    return table(spark, d, "orders", ORDERS).scan(["o_totalprice", "o_orderkey"])


@query("p02_null_fill", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS phantom, o_totalprice FROM orders")
def _(spark, d):
    schema = T.StructType([*source(spark, d, "orders").schema.fields, T.StructField("phantom", T.StringType())])
    return table(spark, d, "orders", ORDERS, schema=schema).scan(["o_orderkey", "phantom", "o_totalprice"])


@query("p09_filter_unprojected", "SELECT c_name FROM customer WHERE c_acctbal > 5000")
def _(spark, d):
    return table(spark, d, "customer", patterns("c_name")).scan(["c_name"], "c_acctbal > 5000")


# Predicates: name, table, columns, predicate, whether best effort, the condition that is left


for _name, _of, _cols, _text, _best, _left in [
    ("w01_eq", "lineitem", "l_orderkey, l_quantity", "l_quantity = 10", False, None),
    ("w02_ne", "customer", "c_custkey, c_mktsegment", "c_mktsegment <> 'BUILDING'", False, None),
    ("w03_gt", "customer", "c_custkey, c_acctbal", "c_acctbal > 5000", False, None),
    ("w04_ge", "lineitem", "l_orderkey, l_discount", "l_discount >= 0.05", False, None),
    ("w05_lt", "part", "p_partkey, p_size", "p_size < 10", False, None),
    ("w06_le", "part", "p_partkey, p_retailprice", "p_retailprice <= 1000", False, None),
    ("w07_and", "lineitem", "l_orderkey, l_quantity", "l_quantity > 10 AND l_discount < 0.03", False, None),
    ("w08_or", "lineitem", "l_orderkey, l_quantity", "l_quantity > 45 OR l_discount = 0.1", False, None),
    ("w09_not", "customer", "c_custkey", "NOT (c_acctbal > 0)", False, None),
    ("w10_in", "part", "p_partkey, p_size", "p_size IN (1, 5, 9)", False, None),
    ("w11_not_in", "part", "p_partkey, p_size", "p_size NOT IN (1, 5, 9)", False, None),
    ("w12_parentheses", "part", "p_partkey", "((p_size > 3) AND (p_size < 20 OR p_retailprice > 1500))", False, None),
    ("w13_negative_literal", "supplier", "s_suppkey, s_acctbal", "s_acctbal > -100.5", False, None),
    ("w14_column_column", "lineitem", "l_orderkey, l_linenumber", "l_quantity > l_tax", False, None),
    ("w15_literal_left", "part", "p_partkey, p_size", "40 < p_size", False, None),
    ("w18_like_between", "part", "p_partkey, p_name", "p_name LIKE '%a%' AND p_size BETWEEN 5 AND 30", False, None),
    ("w07_drop_function", "customer", "c_custkey", "c_acctbal > 5000 AND length(c_name) = 3", True, "c_acctbal > 5000"),
    ("w08_drop_or", "customer", "c_custkey", "c_acctbal > 5000 OR length(c_name) = 3", True, None),
    ("w09_drop_not", "customer", "c_custkey", "NOT (c_acctbal > 5000 AND length(c_name) = 3)", True, None),
    ("w17_type_gate", "customer", "c_custkey", "c_acctbal > 5000 AND c_name = 5", True, "c_acctbal > 5000"),
]:
    def _run(spark, d, of=_of, cols=_cols, text=_text, best=_best):
        return table(spark, d, of, SIZES if of == "part" else None).scan(cols.split(", "), text, best_effort=best)

    _where = _left if _best else _text
    query(_name, f"SELECT {_cols} FROM {_of}" + (f" WHERE {_where}" if _where else ""))(_run)


@query("w16_literals", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_totalprice < 1.5e5 AND o_orderpriority <> 'it''s'")
def _(spark, d):
    return table(spark, d, "orders", ORDERS).scan(["o_orderkey", "o_orderdate"], "o_orderdate >= TIMESTAMP '1995-01-01' AND o_totalprice < 1.5e5 AND o_orderpriority <> 'it''s'")


@query("w19_bare_boolean", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def _(spark, d):
    return table(spark, d, "orders", ORDERS).scan(["o_orderkey"], "true AND NOT false AND o_totalprice > 200000")


@query("w20_comments", "SELECT c_custkey FROM customer WHERE c_acctbal > 100")
def _(spark, d):
    return table(spark, d, "customer").scan(["c_custkey"], "c_acctbal > /* in whole units */ 100 -- and no more")


@query("w21_quoted_names", "SELECT c_custkey FROM customer WHERE c_acctbal > 100 AND c_name >= 'C'")
def _(spark, d):
    return table(spark, d, "customer", patterns("c_name")).scan(["c_custkey"], "\"c_acctbal\" > 100 AND `c_name` >= 'C'")


@query("w23_column_groups", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O' AND o_custkey > 10")
def _(spark, d):
    return table(spark, d, "orders", ORDERS).scan(["o_orderkey", "o_orderpriority"], "o_totalprice > 100000 AND o_orderstatus = 'O' AND o_custkey > 10")


# Random access and chunks


@query("s20_take", "SELECT * FROM orders WHERE o_orderkey IN (0, 10, 100, 1000)")
def _(spark, d):
    return table(spark, d, "orders", ORDERS).take([0, 10, 100, 1000])


@query("s20_take_projected", "SELECT o_totalprice, o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def _(spark, d):
    t = table(spark, d, "orders", ORDERS)
    return t.take(spark.range(0, t.count(), 5), ["o_totalprice", "o_orderkey"])


@query("s13_chunk", "SELECT * FROM events WHERE event_id >= 256 AND event_id < 512")
def _(spark, d):
    return _chunks(spark, d, "events", 256).read(1)


def _chunks(spark, d, name, rows, group=0, properties=None):
    root = stored(source(spark, d, name), properties)
    return Table.load(spark, root, properties=Properties({"reader.logical_chunk_rows": rows})).chunks(group)


@query("s14_chunks", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 200 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 300 AND o_orderkey < 400 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 100")
def _(spark, d):
    return _chunks(spark, d, "orders", 100, 0, ORDERS).read_many([3, 0, 1, 0])


@query("s16_chunk_rows", "SELECT CAST(floor(o_orderkey / 8192) AS BIGINT) AS chunk, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "orders", ORDERS)
    return t.rows(["o_orderkey"]).groupBy(F.floor(F.col(writer.ROW) / 8192).alias("chunk")).agg(F.count("*").alias("n"))


@query("a03_zone_stats", "SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS chunk, 'o_custkey' AS \"column\", count(*) AS rows, CAST(count(*) - count(o_custkey) AS BIGINT) AS nulls, CAST(min(o_custkey) AS VARCHAR) AS least, CAST(max(o_custkey) AS VARCHAR) AS greatest, CAST(0 AS BIGINT) AS nans, CAST(sum(o_custkey) AS DOUBLE) AS total FROM orders GROUP BY 1")
def _(spark, d):
    return _chunks(spark, d, "orders", 1000, 0, ORDERS).statistics().where(F.col("column") == "o_custkey").drop("bytes")


@query("s18_chunk_column_bytes", "SELECT CAST(floor(c_custkey / 500) AS BIGINT) AS chunk, 'c_name' AS \"column\", CAST(sum(strlen(c_name)) AS BIGINT) AS bytes FROM customer GROUP BY 1")
def _(spark, d):
    return _chunks(spark, d, "customer", 500).statistics().where(F.col("column") == "c_name").select("chunk", "column", "bytes")


@query("s10_all_chunks", "SELECT c_custkey, c_name FROM customer")
def _(spark, d):
    chunks = _chunks(spark, d, "customer", 700, 0, patterns("c_custkey|c_name"))
    return chunks.read_many(range(len(chunks)))


@query("s25_take_null_fill", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS phantom FROM orders WHERE o_orderkey % 5 = 0")
def _(spark, d):
    schema = T.StructType([*source(spark, d, "orders").schema.fields, T.StructField("phantom", T.StringType())])
    t = table(spark, d, "orders", ORDERS, schema=schema)
    return t.take(spark.range(0, t.count(), 5), ["o_orderkey", "phantom"])


@query("s26_row_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= (SELECT count(*) // 3 FROM orders) AND o_orderkey < (SELECT count(*) // 2 FROM orders)")
def _(spark, d):
    t = table(spark, d, "orders", Properties({"writer.policy": "schema_based", "writer.split.schema_based.patterns": ("o_orderkey|o_custkey", "o_totalprice"), "writer.file_rolling.rows": 1000}))
    return t.rows(["o_orderkey", "o_totalprice"], t.count() // 3, t.count() // 2).drop(writer.ROW)


@query("o04_scan_limit", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 70")
def _(spark, d):
    return table(spark, d, "orders", ORDERS).scan(["o_orderkey", "o_custkey"], "o_totalprice > 100000", ordered=True, limit=70)


@query("o03_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def _(spark, d):
    return table(spark, d, "orders", ORDERS).scan(["o_orderkey", "o_totalprice"], ordered=True).limit(100)


# Versions


@query("s35_time_travel", "SELECT * FROM part WHERE p_partkey % 2 = 0")
def _(spark, d):
    part = source(spark, d, "part")
    root = stored(part.where("p_partkey % 2 = 0"))
    more = part.where("p_partkey % 2 = 1")
    Transaction(spark, root).append(writer.write(more, root), more.schema).commit()
    return Table.load(spark, root, version=1).scan()


@query("t04_add_column_group", "SELECT *, p_retailprice * 2 AS p_double FROM part")
def _(spark, d):
    root = stored(source(spark, d, "part"), patterns("p_partkey|p_name"))
    new = Table.load(spark, root).scan(["p_retailprice"], ordered=True).select((F.col("p_retailprice") * 2).alias("p_double"))
    Transaction(spark, root).add_group(writer.write(new, root)[0], new.schema).commit()
    return Table.load(spark, root).scan()


@query("t05_drop_column", "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
def _(spark, d):
    root = stored(source(spark, d, "part"), patterns("p_partkey|p_name"))
    Transaction(spark, root).drop_column("p_name").commit()
    return Table.load(spark, root).scan()


@query("g02_group_layout", "SELECT * FROM (VALUES (0, 'o_orderkey'), (0, 'o_custkey'), (1, 'o_totalprice'), (1, 'o_orderdate'), (2, 'o_orderstatus'), (2, 'o_orderpriority')) AS t(place, name)")
def _(spark, d):
    return spark.createDataFrame([(i, c) for i, g in enumerate(table(spark, d, "orders", ORDERS).manifest.groups) for c in g.columns], "place int, name string")


@query("g08_write_after_join", "SELECT o_orderkey, o_totalprice, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    root = shared_path(spark, "table")
    joined = source(spark, d, "orders").join(source(spark, d, "customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_name", "c_acctbal")
    Transaction(spark, root).append(writer.write(joined, root), joined.schema).commit()
    return Table.load(spark, root).scan()


@query("g09_rolled_files", "SELECT * FROM events")
def _(spark, d):
    return table(spark, d, "events", Properties({"writer.policy": "schema_based", "writer.split.schema_based.patterns": ("event_id|user_id",), "writer.file_rolling.size": 1 << 18})).scan()


for _codec in ("uncompressed", "snappy", "gzip", "lz4", "zstd"):
    def _run(spark, d, codec=_codec):
        return table(spark, d, "part", Properties({"writer.compression": codec, "writer.enable_dictionary": codec != "gzip"})).scan()

    query(f"g11_codec_{_codec}", "SELECT * FROM part")(_run)


@query("g06_stream_append", "SELECT * FROM events")
def _(spark, d):
    root, folder = shared_path(spark, "table"), shared_path(spark, "ticks")
    events = source(spark, d, "events")
    events.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    stream.writeStream.foreachBatch(append_batches(root, "q")).option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return Table.load(spark, root).scan()


# Deletes and external files


#: Rows that one task sorts into a file.
FILE_ROWS = 1_000_000


def _quarters(df: DataFrame) -> int:
    """Files of at most about FILE_ROWS that a quarter of df makes."""
    return max(1, -(-df.count() // (4 * FILE_ROWS)))


def files_of(spark, d, name, key) -> str:
    """A folder of files that follow each other by the key: a few, or as many as keep one task's rows below FILE_ROWS."""
    folder, df = shared_path(spark, "files"), source(spark, d, name)
    df.repartitionByRange(4 * _quarters(df), key).sortWithinPartitions(key).write.parquet(folder)
    return folder


def external_table(spark, d, name, key, change=lambda files: files) -> Table:
    root = shared_path(spark, "table")
    external.register(spark, root, change(external.explore(spark, files_of(spark, d, name, key))))
    return Table.load(spark, root)


def deleted_table(spark, d, name, key, where: str, with_path: bool) -> Table:
    """A table over several files of which rows at some positions are deleted: by one delete table, or by a vector for each file."""
    folder, dels, root = files_of(spark, d, name, key), shared_path(spark, "deletes"), shared_path(spark, "table")
    files = [f.path for f in external.explore(spark, folder)]
    own = spark.read.parquet(folder).where(where).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("pos"))
    own = own.unionByName(own)  # positions may repeat
    (own.drop("file").write if with_path else own.drop("file_path").write.partitionBy("file")).parquet(dels)
    deleted = lambda path: ("positional", dels) if with_path else ("vector", f"{dels}/file={path.rsplit('/', 1)[1]}")
    external.register(spark, root, external.plan(spark, [external.DataFile(p, (deleted(p),)) for p in files], Properties({"iceberg.snapshot_id": 1})))
    return Table.load(spark, root)


@query("d01_positional_delete", "SELECT * FROM orders WHERE o_orderkey % 7 <> 0")
def _(spark, d):
    return deleted_table(spark, d, "orders", "o_orderkey", "o_orderkey % 7 = 0", True).scan()


@query("d02_deletion_vector", "SELECT event_id, user_id FROM events WHERE event_id % 3 <> 1")
def _(spark, d):
    return deleted_table(spark, d, "events", "event_id", "event_id % 3 = 1", False).scan(["event_id", "user_id"])


@query("d03_live_rows_per_file", "SELECT o_orderkey % 4 AS part, count(*) AS live FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1")
def _(spark, d):
    orders, folder, dels = source(spark, d, "orders"), shared_path(spark, "files"), shared_path(spark, "deletes")
    pieces = _quarters(orders)
    number = F.pmod(F.col("o_orderkey"), F.lit(4)) * pieces + F.pmod(F.xxhash64("o_orderkey"), F.lit(pieces))
    orders.withColumn("part", F.col("o_orderkey") % 4).repartitionById(4 * pieces, number.cast("int")).write.partitionBy("part").parquet(folder)
    rows = spark.read.parquet(folder).select("part", "o_orderkey", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__pos"))
    rows.where("o_orderkey % 7 = 0").select(F.col("__file").alias("file_path"), F.col("__pos").alias("pos")).write.parquet(dels)
    return deletes.without_positions(rows, spark.read.parquet(dels)).groupBy("part").agg(F.count("*").alias("live"))


@query("d04_take_after_delete", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders WHERE o_orderkey % 7 <> 0) WHERE r IN (0, 5, 6, 500, 1000)")
def _(spark, d):
    return deleted_table(spark, d, "orders", "o_orderkey", "o_orderkey % 7 = 0", True).take([0, 5, 6, 500, 1000], ["o_orderkey", "o_custkey"])


@query("f19_merge_dedup", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, d):
    return deletes.latest(source(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"])


def _split(spark, d, engine: str, aggregates=None):
    files = [f.path for f in external.explore(spark, files_of(spark, d, "events", "event_id"))]
    split = external.Split(primary_keys=True, merge_engine=engine, files_overlap=True)
    return external.read_split(spark, split, files, ["user_id"], ["event_id"], aggregates).select("user_id", "event_id", "value")


@query("f19_merge_first_row", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def _(spark, d):
    return _split(spark, d, "first-row")


@query("f19_merge_partial_update", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) FILTER (value IS NOT NULL) AS value FROM events GROUP BY user_id")
def _(spark, d):
    return _split(spark, d, "partial-update")


@query("f19_merge_aggregation", "SELECT user_id, min(event_id) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def _(spark, d):
    return _split(spark, d, "aggregation", {"event_id": "min", "value": "max"})


@query("f21_explore_dir", "SELECT * FROM supplier")
def _(spark, d):
    return external_table(spark, d, "supplier", "s_suppkey").scan()


@query("f22_row_count", "SELECT count(*) AS n FROM events")
def _(spark, d):
    return external_table(spark, d, "events", "event_id").rows(["event_id"]).agg(F.count("*").alias("n"))


# Large objects


def _segment(spark, d) -> tuple[str, Properties]:
    root, p = shared_path(spark, "table"), Properties({"lob.inline_threshold": 4096})
    groups, files, schema = Segment.write(source(spark, d, "documents"), root, ["text"], p)
    t = Transaction(spark, root).append(groups, schema)
    for f in files:
        t.add_lob(f)
    t.commit()
    return root, p


@query("l04_lob_resolve", "SELECT doc_id, text FROM documents")
def _(spark, d):
    return Segment.open(spark, _segment(spark, d)[0], {"text": "string"}).scan(["doc_id", "text"])


@query("l06_lob_rewrite", "SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0")
def _(spark, d):
    root, p = _segment(spark, d)
    kept, again = Segment.open(spark, root, {"text": "string"}).scan(["doc_id", "text"], "doc_id % 10 <> 0"), shared_path(spark, "table")
    groups, files, schema = Segment.write(kept, again, ["text"], p)
    t = Transaction(spark, again).append(groups, schema)
    for f in files:
        t.add_lob(f)
    t.commit()
    return Segment.open(spark, again, {"text": "string"}).scan()


@query("l07_lob_stats", "SELECT count(*) AS total, CAST(count(*) - count(text) AS BIGINT) AS nulls, count(*) FILTER (strlen(text) < 4096) AS inline, count(*) FILTER (strlen(text) >= 4096) AS stored, CAST(sum(strlen(text)) FILTER (strlen(text) < 4096) AS BIGINT) AS inline_bytes, (SELECT count(*) FROM (SELECT DISTINCT text FROM documents WHERE strlen(text) >= 4096)) AS stored_values, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM (SELECT DISTINCT text FROM documents WHERE strlen(text) >= 4096)) AS stored_bytes, 1 AS files FROM documents")
def _(spark, d):
    return Segment.open(spark, _segment(spark, d)[0], {"text": "string"}).statistics("text")


@query("l05_lob_values", "SELECT DISTINCT CAST(strlen(text) AS INTEGER) AS size, sha256(text) AS hash FROM documents WHERE strlen(text) >= 4096")
def _(spark, d):
    return Segment.open(spark, _segment(spark, d)[0], {"text": "string"}).values("text").select(F.octet_length("value").alias("size"), F.sha2("value", 256).alias("hash"))


@query("s29_segment_filter", "SELECT doc_id FROM documents WHERE length(text) > 5000 AND doc_id % 3 = 0")
def _(spark, d):
    return Segment.open(spark, _segment(spark, d)[0], {"text": "string"}).scan(["doc_id"], "length(text) > 5000 AND doc_id % 3 = 0")


@query("s31_segment_references", "SELECT doc_id, CAST(CASE WHEN strlen(text) >= 4096 THEN 24 ELSE strlen(text) + 1 END AS INTEGER) AS bytes FROM documents")
def _(spark, d):
    chunks = Segment.open(spark, _segment(spark, d)[0], {"text": "string"}).chunks()
    return chunks.read_many(range(len(chunks))).select("doc_id", F.octet_length("text").alias("bytes"))


@query("s30_segment_take", "SELECT doc_id, text FROM documents WHERE doc_id IN (1, 3, 90, 150)")
def _(spark, d):
    segment = Segment.open(spark, _segment(spark, d)[0], {"text": "string"})
    numbers = segment.table.rows(["doc_id"]).where("doc_id IN (1, 3, 90, 150)").select(writer.ROW).collect()
    return segment.take(sorted(r[0] for r in numbers), ["doc_id", "text"])


# SQL


@query("a05_sql_agg", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def _(spark, d):
    table(spark, d, "orders", ORDERS).view("lamellar_orders")
    return spark.sql("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM lamellar_orders WHERE o_totalprice > 1000 GROUP BY 1")


for _name, _join, _cols in [("j05_sql_join", "JOIN", "c_name, o_orderkey"), ("j06_left_join", "LEFT JOIN", "c_name, o_orderkey"), ("j06_semi_join", "LEFT SEMI JOIN", "c_name"), ("j06_anti_join", "LEFT ANTI JOIN", "c_name"), ("j06_right_join", "RIGHT JOIN", "c_name, o_orderkey"), ("j06_full_join", "FULL JOIN", "c_name, o_orderkey")]:
    def _run(spark, d, join=_join, cols=_cols, name=_name):
        table(spark, d, "orders", ORDERS).view(f"{name}_o")
        table(spark, d, "customer").view(f"{name}_c")
        return spark.sql(f"SELECT {cols} FROM {name}_c {join} {name}_o ON c_custkey = o_custkey AND o_totalprice > 150000")

    query(_name, f"SELECT {_cols} FROM customer {_join.replace('LEFT SEMI', 'SEMI').replace('LEFT ANTI', 'ANTI')} orders ON c_custkey = o_custkey AND o_totalprice > 150000")(_run)


@query("n01_sql_row_number", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def _(spark, d):
    table(spark, d, "customer", patterns("c_custkey|c_name")).view("lamellar_customer")
    return spark.sql("SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS place FROM lamellar_customer")


@query("o05_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, d):
    return table(spark, d, "orders", ORDERS).scan(["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("v01_vector_length", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS square FROM embeddings")
def _(spark, d):
    t = table(spark, d, "embeddings", SIZES)
    return t.scan(["vec_id", "embedding"]).select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("square"))
