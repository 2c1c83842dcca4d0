"""The table layer: predicates, access, transactions, large objects, imports, faults."""

import json
import random
import threading
import uuid
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamellar import __main__ as cli
from lamellar import faults
from lamellar.errors import CommitConflict, FileMissing, InjectedFault, InvalidArgument, InvalidProperty, NotSupported, PredicateError, RetriesExhausted
from lamellar.functions.predicate import parse
from lamellar.manifest import Fragment, Index, Manifest
from lamellar.operators import commit, deletes, grouping, lob
from lamellar.operators.commit import Transaction, load, overwrite
from lamellar.plans import registry
from lamellar.plans.registry import QUERIES, patterns, stored
from lamellar.properties import Properties
from lamellar.sources import external, writer
from lamellar.sources.store import Store, normal, shared_path
from lamellar.streaming.sink import append_batches
from lamellar.table import Table


@pytest.fixture(scope="module")
def people(spark):
    """100 rows: age 0..99, name name_0.. name_99."""
    return spark.range(100).select(F.col("id").alias("age"), F.concat(F.lit("name_"), F.col("id").cast("string")).alias("name"))


@pytest.fixture(scope="module")
def people_table(spark, people):
    return Table.load(spark, stored(people, patterns("age")))


#: What best effort understands, and what it leaves out.
KNOWN = ["qty > 3", "qty <= 7", "qty <> 5", "qty IN (1, 4, 9)", "qty NOT IN (2, 3)", "6 >= qty", "price < -0.5", "price >= qty", "word = 'ab'", "word > 'b'", "word IN ('ab', 'it''s')", "flag", "price = 2.5", "qty = -1", "price < 1e1"]
OTHER = ["length(word) = 2", "qty + 1 > 4", "word LIKE 'a%'", "qty IS NULL", "abs(price) > 2", "qty BETWEEN 2 AND 5"]


@pytest.fixture(scope="module")
def parcels(spark):
    """Rows with nulls, repeated values, signs and quotes, as a table of three groups and as a view of DuckDB."""
    rng = random.Random(11)
    rows = [(i, rng.choice([None, -1, *range(10)]), rng.choice([None, -2.25, 0.0, 2.5, 2.5, 7.75]), rng.choice([None, "", "a", "ab", "bc", "it's", "é"]), rng.choice([None, True, False])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, qty int, price double, word string, flag boolean")
    db = duckdb.connect()
    db.register("parcels", df.toArrow())
    return Table.load(spark, stored(df, patterns("id|qty", "price"))), lambda where: {r[0] for r in db.execute(f"SELECT id FROM parcels WHERE {where}").fetchall()}


def predicates(n):
    rng = random.Random(7)
    for i in range(n):
        a, b, c = (rng.choice(KNOWN if rng.random() < 0.7 else OTHER) for _ in range(3))
        yield rng.choice(["{a}", "NOT ({a})", "{a} AND {b}", "{a} OR {b}", "({a} OR {b}) AND {c}", "{a} OR {b} AND {c}", "NOT ({a} AND {b})", "NOT (NOT ({a}) OR {b})", "{a} AND NOT ({b} OR {c})", "({a} AND {b}) OR ({a} AND {c})"]).format(a=a, b=b, c=c)


@pytest.mark.parametrize("text", list(dict.fromkeys(predicates(60))))
def test_predicates_against_sql(spark, parcels, text):
    table, want = parcels
    assert {r.id for r in table.scan(["id"], text).collect()} == want(text)
    kept = parse(spark, text, table.schema, True).text
    best = {r.id for r in table.scan(["id"], text, best_effort=True).collect()}
    assert best >= want(text) and best == (want(kept.replace("`", '"').replace("\\'", "''")) if kept else set(range(400)))
    if not any(x in text for x in OTHER):
        assert best == want(text)


def test_comments_quotes_and_kinds(parcels):
    table, want = parcels
    assert table.scan(["id"], '"qty" /* a number */ > 5 -- of pieces').count() == len(want("qty > 5"))
    assert table.scan(["id"], "qty > 5 AND word = 5", best_effort=True).count() == len(want("qty > 5"))  # kinds differ: that part is left out
    assert table.scan(["id"], "qty > 5.5", best_effort=True).count() == 400 and table.scan(["id"], "qty > 5.5").count() == len(want("qty > 5.5"))
    assert table.scan(["id"], "qty = NULL").count() == 0 and table.scan(["id"], "true").count() == 400


@pytest.mark.parametrize("text", ["", "  ", "age >", "age > 1 2", "(age > 1", "nope > 1", "age > 1 AND nope = 2", '"no pe" = 1'])
def test_bad_predicates(spark, people, text):
    for best in (False, True):
        with pytest.raises(PredicateError):
            parse(spark, text, people.schema, best)


def test_scan_joins_groups_without_a_shuffle_and_prunes(spark, sf):
    table = Table.load(spark, stored(spark.read.parquet(f"{sf}/orders.parquet"), patterns("o_orderkey|o_custkey", "o_totalprice")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table.scan(["o_orderkey", "o_totalprice"], "o_totalprice > 100000")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "PushedFilters" in plan and "GreaterThan(o_totalprice" in plan
        plan = table.scan(["o_custkey"], "o_orderkey < 10")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("FileScan") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_projection_errors_and_empty(spark, people_table, people):
    with pytest.raises(InvalidArgument):
        people_table.scan(["age", "age"])
    with pytest.raises(InvalidArgument):
        people_table.scan(["nope"])
    assert people_table.scan([]).columns == ["age", "name"]
    none = shared_path(spark, "none")
    with pytest.raises(InvalidArgument):
        Table.load(spark, none).scan()
    assert Table.load(spark, none, schema=people.schema).scan().count() == 0
    assert writer.write(people.limit(0), none) == []


def test_take(people_table):
    assert [tuple(r) for r in people_table.take([0, 10, 99], ["name", "age"]).collect()] == [("name_0", 0), ("name_10", 10), ("name_99", 99)]
    assert people_table.take([]).count() == 0
    many = people_table.spark.createDataFrame([(99,), (10,), (10,), (None,), (500,)], "n int")
    assert [r.age for r in people_table.take(many, ["age"]).collect()] == [10, 99]
    for bad in ([2, 1], [1, 1], [-1], [100]):
        with pytest.raises(InvalidArgument):
            people_table.take(bad)


def test_chunks(spark, people):
    root = stored(people, patterns("age"))
    Transaction(spark, root).append(writer.write(people, root, patterns("age")), people.schema).commit()
    chunks = Table.load(spark, root, properties=Properties({"reader.logical_chunk_rows": 30})).chunks()
    assert chunks.row_counts() == [30, 30, 30, 10, 30, 30, 30, 10] and len(chunks) == 8
    assert chunks.of_rows([99, 5, 31, 100, 6]) == [3, 0, 1, 4]
    own = Table.load(spark, root).manifest.groups[0].fragments
    assert all(f.bytes > 0 for f in own) and abs(sum(chunks.sizes()) - sum(f.bytes for f in own)) <= len(chunks) and chunks.sizes()[0] > chunks.sizes()[3]
    assert [r.age for r in chunks.read(3).collect()] == list(range(90, 100))
    assert [r.age for r in chunks.read_many([4, 3, 4]).collect()] == [*range(30), *range(90, 100), *range(30)]
    stats = {(r.chunk, r.column): r for r in chunks.statistics().collect()}
    assert (stats[(3, "age")].least, stats[(3, "age")].greatest, stats[(3, "age")].rows, stats[(3, "age")].total) == ("90", "99", 10, 945.0)
    odd = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "x double").coalesce(1)
    (one,) = Table.load(spark, stored(odd)).chunks().statistics().collect()
    assert (one.rows, one.nulls, one.nans, one.total) == (3, 1, 1, 1.5)
    with pytest.raises(InvalidArgument):
        chunks.of_rows([200])
    with pytest.raises(InvalidArgument):
        Table.load(spark, root).chunks(0, ["name"])


def test_subrange_of_own_files(spark, people):
    root = shared_path(spark, "t")
    groups = writer.write(people, root, patterns("age"))
    from dataclasses import replace

    cut = [replace(g, fragments=(replace(g.fragments[0], start=10, end=25),)) for g in groups]
    Transaction(spark, root).append(cut, people.schema).append(groups, people.schema).commit()
    table = Table.load(spark, root)
    assert table.count() == 115 and [r.age for r in table.scan(ordered=True).collect()] == [*range(10, 25), *range(100)]
    assert [r.age for r in table.take([0, 14, 15, 114]).collect()] == [10, 24, 0, 99]


def test_groups():
    assert grouping.by_patterns(["a", "ab", "b"], ("a", "a.*")) == [["a"], ["ab"], ["b"]]
    assert grouping.by_size(["a", "b", "c", "d"], {"a": 8, "b": 8, "c": 900, "d": 8}, 64, 2) == [["a", "b"], ["c", "d"]]
    assert grouping.by_size(["a", "b"], {"a": 900, "b": 900}, 64, 2) == [["a"], ["b"]]
    with pytest.raises(InvalidArgument):
        grouping.by_size(["a"], {"a": 1}, 0, 0)
    for bad in ({"writer.policy": "x"}, {"nope": 1}, {"transaction.commit.num-retries": 11}, {"reader.logical_chunk_rows": "x"}):
        with pytest.raises(InvalidProperty):
            Properties(bad)
    with pytest.raises(NotSupported):
        Properties().writable_format("vortex")


def test_transactions(spark, people):
    root = stored(people, patterns("age"))
    with pytest.raises(InvalidArgument):
        Transaction(spark, root).commit()
    one, two = Transaction(spark, root), Transaction(spark, root)
    assert one.add_delta("_delta/x", 3).update_statistic("bloom", ["_stats/b"], {"k": "v"}).commit() == 2
    with pytest.raises(CommitConflict):
        two.drop_column("name").commit()
    again = Transaction(spark, root, version=1, resolver=overwrite).drop_column("name").drop_column("nope")
    assert again.commit() == 3
    m = load(spark, root)
    assert m.columns == ["age"] and not m.deltas and load(spark, root, 2).deltas[0].entries == 3
    assert Table.load(spark, root, 1).scan().columns == ["age", "name"]
    with pytest.raises(FileMissing):
        load(spark, root, 9)
    names = people.select("name")
    group = writer.write(names, root)[0]
    assert Transaction(spark, root).add_group(group, names.schema).commit() == 4
    assert {r.age: r.name for r in Table.load(spark, root).scan().collect()}[7] == "name_7"
    with pytest.raises(InvalidArgument):
        Transaction(spark, root).add_group(group, names.schema).commit()
    with pytest.raises(InvalidArgument):
        Transaction(spark, root).append(writer.write(people, root), people.schema).commit()
    short = people.limit(3).select(F.col("age").alias("x"))
    with pytest.raises(InvalidArgument):
        Transaction(spark, root).add_group(writer.write(short, root)[0], short.schema).commit()


def test_indexes(spark, people):
    root = stored(people)
    Transaction(spark, root).add_index(Index("age", "hnsw", 7)).add_index(Index("name", "inverted")).commit()
    Transaction(spark, root).add_index(Index("age", "ivf", 7)).add_index(Index("name", "inverted", params={"a": "b"})).commit()
    m = load(spark, root)
    assert [(i.kind, i.id, i.params) for i in m.indexes] == [("ivf", 7, {}), ("inverted", 0, {"a": "b"})]
    Transaction(spark, root).drop_index(7).commit()
    assert [i.kind for i in load(spark, root).indexes] == ["inverted"]
    Transaction(spark, root).append(writer.write(people, root), people.schema).commit()
    assert not load(spark, root).indexes


def test_races(spark, people, monkeypatch):
    root = stored(people)
    done, wrong = [], []

    def run(i):
        try:
            done.append(Transaction(spark, root).update_statistic(f"s{i}").commit())
        except CommitConflict:
            done.append(None)
        except Exception as e:
            wrong.append(e)

    for turn in range(3):
        threads = [threading.Thread(target=run, args=(4 * turn + i,)) for i in range(4)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    won = [d for d in done if d]
    assert not wrong and len(done) == 12
    assert won and len(set(won)) == len(won) and len(load(spark, root).statistics) == len(won)
    monkeypatch.setattr(Store, "create", lambda *a: False)
    with pytest.raises(RetriesExhausted):
        Transaction(spark, root).update_statistic("x").commit()


def test_a_writer_that_dies_leaves_no_torn_manifest(spark, people):
    root = stored(people)
    with faults.inject("publish"), pytest.raises(InjectedFault):
        Transaction(spark, root).update_statistic("x").commit()
    assert load(spark, root).version == 1 and Table.load(spark, root).scan().count() == 100
    assert Transaction(spark, root).update_statistic("x").commit() == 2
    store = Store(spark, root)
    assert store.create("_metadata/new", "one") and not store.create("_metadata/new", "two") and store.read("_metadata/new") == "one"
    assert sorted(store.names("_metadata"))[-3:] == ["manifest-1.json", "manifest-2.json", "new"]


def test_names_are_taken_once_by_rename(spark):
    """The way of HDFS and the like, here on the local disk."""
    store = Store(spark, shared_path(spark, "t"))
    store._fs = type("Renaming", (), {"__getattr__": lambda self, name, fs=store._fs: (lambda: "hdfs") if name == "getScheme" else getattr(fs, name)})()
    assert store.create("a/new", "one") and not store.create("a/new", "two") and store.read("a/new") == "one"


def test_write_after_a_join_keeps_all_rows(spark):
    """Adaptive execution may cut a join into other partitions each time it runs."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"}
    before = {k: spark.conf.get(k, None) for k in changed}
    [spark.conf.set(k, v) for k, v in changed.items()]
    try:
        joined = spark.range(200_000).withColumn("k", F.col("id") % 1000).join(spark.range(1000).withColumnRenamed("id", "k"), "k")
        for p in (None, patterns("id")):
            root = shared_path(spark, "t")
            groups = writer.write(joined, root, p)
            Transaction(spark, root).append(groups, joined.schema).commit()
            table = Table.load(spark, root)
            assert table.count() == 200_000 == table.scan().select("id").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_ranges_name_the_files_to_open(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    p = Properties({**patterns("o_orderkey|o_custkey", "o_totalprice"), "writer.file_rolling.rows": 100})
    root = shared_path(spark, "t")
    for _ in range(2):
        Transaction(spark, root).append(writer.write(orders, root, p), orders.schema).commit()
    table, n = Table.load(spark, root), orders.count()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(table.scan()) and "Sort [" not in plan(table.scan()) and table.scan().count() == 2 * n
    rows = [0, 7, n - 1, n, 2 * n - 3]
    assert [r.o_orderkey for r in table.take(rows).collect()] == [r % n for r in rows]
    fragment = table.manifest.groups[0].fragments[0]
    assert fragment.buckets == -(-n // 100) and len([x for x in Store(spark, root).names(fragment.path) if x.endswith(".parquet")]) <= fragment.buckets
    path = Store(spark, root).at(table.manifest.groups[1].fragments[0].path)
    own = spark.read.parquet(path).where("__row = 7").select("_metadata.file_name").first().file_name
    for file in Path(path.removeprefix("file:")).glob("*.parquet"):
        if file.name != own:
            file.write_bytes(b"not to be opened")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert [r.o_totalprice for r in table.take([7], ["o_totalprice"]).collect()] == [orders.where("o_orderkey = 7").first().o_totalprice]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lamellar_r_")]
    sized = writer.write(orders, shared_path(spark, "t"), Properties({"writer.file_rolling.size": 4096}))
    assert sized[0].fragments[0].buckets > n * 40 // 4096


def test_faults_keep_what_was_committed(spark, people):
    root = stored(people)
    with faults.inject("commit_manifest"), pytest.raises(InjectedFault):
        Transaction(spark, root).update_statistic("x").commit()
    with faults.inject("write"), pytest.raises(InjectedFault):
        writer.write(people, root)
    assert load(spark, root).version == 1 and Table.load(spark, root).scan().count() == 100
    with pytest.raises(InvalidArgument):
        faults.inject("nope").__enter__()


def test_manifest_round_trip(spark, people):
    root = stored(people, patterns("age"))
    m = load(spark, root)
    assert Manifest.loads(m.dumps()) == m
    raw = json.loads(Store(spark, root).read("_metadata/manifest-1.json"))
    assert raw["groups"][0]["fragments"][0]["path"].startswith("_data/")
    with pytest.raises(InvalidArgument):
        Manifest.loads(json.dumps({**json.loads(m.dumps()), "format_version": 99}))
    commit._CACHE.clear()
    assert load(spark, root).groups == m.groups


def test_references():
    u = uuid.uuid4()
    assert lob.decode(lob.encode_inline(b"abc")) == b"abc" and lob.decode(lob.encode_inline(b"")) == b""
    assert len(lob.encode_reference(u, 7)) == 24 and lob.decode(lob.encode_reference(u, 7)) == (u, 7)
    for bad in (b"", b"\x02x", b"\x01short"):
        with pytest.raises(InvalidArgument):
            lob.decode(bad)


def test_segment(spark):
    rows = [(0, "short"), (1, "long " * 20), (2, None), (3, ""), (4, "long " * 20), (5, "x" * 20)]
    df, root = spark.createDataFrame(rows, "id long, content string").coalesce(1), shared_path(spark, "t")
    p = Properties({"lob.inline_threshold": 20})
    groups, files, schema = lob.Segment.write(df, root, ["content"], p)
    Transaction(spark, root).append(groups, schema).add_lob(files[0]).commit()
    seg = lob.Segment.open(spark, root, {"content": "string"})
    assert sorted(map(tuple, seg.scan().collect())) == rows and files[0].rows == 2
    assert [tuple(r) for r in seg.take([1, 3, 5]).collect()] == [rows[1], rows[3], rows[5]]
    assert sorted(r.id for r in seg.scan(["id"], "length(content) > 50").collect()) == [1, 4]
    assert seg.scan(["content", "id", "nope"]).columns == ["id", "content"]
    assert bytes(seg.chunks().read(0).first().content)[:1] in (b"\x00", b"\x01")
    s = lob.statistics(seg.table.scan(), "content").first()
    assert (s.total, s.nulls, s.inline, s.stored) == (6, 1, 2, 3)
    with pytest.raises(InvalidArgument):
        seg.scan(["nope"])
    with faults.inject("write"), pytest.raises(InjectedFault):
        lob.Segment.write(df, root, ["content"], p)


def test_external(spark, people, tmp_path):
    folder, root = shared_path(spark, "ext"), shared_path(spark, "t")
    people.repartitionByRange(3, "age").sortWithinPartitions("age").write.parquet(folder)
    fragments = external.explore(spark, folder)
    assert sum(f.rows for f in fragments) == 100
    external.register(spark, root, fragments, ["name"])
    assert Table.load(spark, root).scan().columns == ["name"] and Table.load(spark, root).take([50]).first().name == "name_50"
    one, dels = fragments[0].path, shared_path(spark, "dels")
    spark.createDataFrame([(one, 0), (one, 0), (one, 2), ("file:/other", 1), (one, 5000)], "file_path string, pos long").write.parquet(dels)
    p = Properties({"iceberg.snapshot_id": 5})
    planned = external.plan(spark, [external.DataFile(one, (("positional", dels), ("unknown", "x")))], p)
    assert planned[0].rows == fragments[0].rows - 2
    root = shared_path(spark, "t")
    external.register(spark, root, planned)
    own = people.orderBy("age").limit(fragments[0].rows)
    want = [r.age for i, r in enumerate(own.collect()) if i not in (0, 2)]
    table = Table.load(spark, root)
    assert [r.age for r in table.scan(ordered=True).collect()] == want
    assert [r.age for r in table.take([0, 1, 5]).collect()] == [want[0], want[1], want[5]]
    assert {r.file_path: r.live for r in external.live_rows(spark, [external.DataFile(one, (("positional", dels),))]).collect()}[normal(one)] == len(want)
    with pytest.raises(NotSupported):
        external.plan(spark, [external.DataFile(one, (("equality", "x"),))], p)
    with pytest.raises(InvalidArgument):
        external.plan(spark, [external.DataFile(one)])
    with pytest.raises(NotSupported):
        external.explore(spark, folder, "lance-table")
    with pytest.raises(InvalidArgument):
        external.register(spark, root, [])


def test_many_external_files_are_one_scan(spark, tmp_path):
    folder = str(tmp_path / "files")
    spark.range(0, 1000, numPartitions=8).write.parquet(folder)
    files = external.explore(spark, folder)
    rows = spark.read.parquet(folder).select("id", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("pos"))
    rows.where("id % 5 = 0 and id < 500").select("file_path", "pos").write.parquet(str(tmp_path / "dels"))
    rows.where("id % 7 = 0 and id >= 500").select("file", "pos").write.partitionBy("file").parquet(str(tmp_path / "vectors"))
    data = [external.DataFile(f.path, (("positional", str(tmp_path / "dels")) if k < 4 else ("vector", f"{tmp_path}/vectors/file={f.path.rsplit('/', 1)[1]}"),)) for k, f in enumerate(files)]
    planned = external.plan(spark, data, Properties({"iceberg.snapshot_id": 1}))
    want = [i for i in range(1000) if (i % 5 if i < 500 else i % 7)]
    root = str(tmp_path / "t")
    external.register(spark, root, planned)
    external.register(spark, root, files[:2])
    table = Table.load(spark, root)
    assert table.count() == len(want) + 250
    scan = table.scan()
    assert sorted(r.id for r in scan.collect()) == sorted([*want, *range(250)])
    assert [r.id for r in table.scan(ordered=True).collect()] == [*want, *range(250)]
    assert scan._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 8  # the files, two kinds of deletes and the repeated ones


def test_paths():
    assert normal("file:///a/b%20c") == normal("file:/a/b c") == normal("/a/b c")
    assert normal("abfss://box@acc.dfs.core.windows.net/x") == "abfss://box/x" and normal("s3a://b/k") == "s3a://b/k"


def test_latest(spark):
    rows = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 3, None, True)], "k long, seq long, v string, gone boolean")
    assert [tuple(r)[:3] for r in deletes.latest(rows, ["k"], ["seq"], "gone").collect()] == [(1, 2, "b")]


def test_merge_engines(spark):
    rows = spark.createDataFrame([(1, 1, "a", 5), (1, 2, None, 7), (2, 1, "c", None), (2, 3, "d", None), (3, 1, None, None)], "k long, seq long, v string, n int")
    got = lambda *a, **b: sorted(tuple(r) for r in deletes.merged(rows, ["k"], ["seq"], *a, **b).collect())
    assert got() == [(1, 2, None, 7), (2, 3, "d", None), (3, 1, None, None)]
    assert got("first-row") == [(1, 1, "a", 5), (2, 1, "c", None), (3, 1, None, None)]
    assert got("partial-update") == [(1, 2, "a", 7), (2, 3, "d", None), (3, 1, None, None)]
    assert got("aggregation", {"n": "sum", "v": "last_non_null_value", "seq": "max"}) == [(1, 2, "a", 12), (2, 3, "d", None), (3, 1, None, None)]
    with pytest.raises(InvalidArgument):
        got("aggregation", {"n": "median"})
    with pytest.raises(InvalidArgument):
        got("other")
    folder = shared_path(spark, "split")
    rows.repartition(3).write.parquet(folder)
    files = [f.path for f in external.explore(spark, folder)]
    plain = external.Split(primary_keys=True, merge_engine="deduplicate")
    assert external.read_split(spark, plain, files).count() == 5
    keyed = external.Split(primary_keys=True, merge_engine="partial-update", level_zero=True)
    assert external.read_split(spark, keyed, files, ["k"], ["seq"], rows=3).count() == 3
    with pytest.raises(InvalidArgument):
        external.read_split(spark, keyed, files, ["k"], ["seq"], rows=4)
    with pytest.raises(NotSupported):
        external.read_split(spark, external.Split(blob_columns=True), files)


def test_types(spark):
    schema = "i8 byte, i16 short, i32 int, i64 long, f float, d double, b boolean, s string, x binary, l array<int>, st struct<a:int,b:string>, m map<string,int>, dec decimal(10,2), dt date, ts timestamp, n array<struct<q:int>>"
    import datetime
    import decimal

    full = (1, 2, 3, 4, 1.5, float("inf"), True, "é", bytearray(b"\x00\xff"), [1, None], (1, "z"), {"k": 1}, decimal.Decimal("1.25"), datetime.date(2020, 1, 1), datetime.datetime(2020, 1, 1), [(1,)])
    df = spark.createDataFrame([full, tuple([None] * 16)], schema)
    table = Table.load(spark, stored(df, patterns("i.*", "l|st|m")))
    assert sorted(map(str, table.scan(df.columns).collect())) == sorted(map(str, df.collect()))


def test_stream_batches_come_once(spark, people):
    root = shared_path(spark, "t")
    append = append_batches(root, "s")
    append(people, 0), append(people, 0), append(people.limit(5), 1)
    assert Table.load(spark, root).count() == 105


def test_command_line(spark, people, capsys):
    source, root = shared_path(spark, "src"), shared_path(spark, "t")
    people.coalesce(1).write.parquet(source)
    cli.main(["create", root, source, "--property", "writer.policy=schema_based", "--property", "writer.split.schema_based.patterns=age"], spark)
    cli.main(["describe", root], spark)
    assert '"version": 1' in capsys.readouterr().out
    cli.main(["read", root, "--take", "3,4", "--predicate", "age > 90", "--columns", "age"], spark)
    assert capsys.readouterr().out.split() == ['{"age":3}', '{"age":4}']
    cli.main(["create", shared_path(spark, "t"), source, "--external"], spark)


def test_layout_of_fragments():
    assert Fragment("p", 3, 10).rows == 7 and Fragment("p", 0, 10, live=4).rows == 4
    assert T.StructType.fromJson(Manifest().schema) == T.StructType([])


def test_numbers_among_deletes(spark, tmp_path, monkeypatch):
    from lamellar import table as module
    from lamellar.sources.writer import ROW

    folder, gone = str(tmp_path / "files"), {*range(0, 1000, 3), *range(64, 96), 999}
    spark.range(1000).coalesce(1).write.parquet(folder)
    path = external.explore(spark, folder)[0].path
    spark.createDataFrame([(p,) for p in [*gone, *gone, 5000]], "pos long").write.parquet(str(tmp_path / "dels"))
    monkeypatch.setattr(module, "BLOCK_ROWS", 32, raising=False)
    for start, end in ((0, 1000), (50, 930)):
        live = [i for i in range(start, end) if i not in gone]
        root = str(tmp_path / f"table{start}")
        external.register(spark, root, [external.Fragment(path, start, end, deletes=str(tmp_path / "dels"), live=len(live)), external.Fragment(path, 0, 10)])
        t, every = module.Table.load(spark, root), [*live, *range(10)]
        assert sorted((r[ROW], r.id) for r in t.rows().collect()) == list(enumerate(every))
        assert sorted((r[ROW], r.id) for r in t.rows(low=30, high=301).collect()) == list(enumerate(every))[30:301]
        assert [r.id for r in t.scan(ordered=True).collect()] == every and sorted(r.id for r in t.scan().collect()) == sorted(every)
        asked = [0, 20, 21, 22, len(live) - 1, len(live), len(every) - 1]
        assert [r.id for r in t.take(asked).collect()] == [every[k] for k in asked]
        for df in (t.scan(), t.rows(), t.take(asked)):
            assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in t.scan()._jdf.queryExecution().executedPlan().toString()


def test_scan_of_nothing_written(spark, sf, tmp_path):
    """A case of its own: as a query it would run on fixed small input alone."""
    from lamellar.plans import registry

    assert "s05_scan_empty" not in registry.QUERIES
    empty = Table.load(spark, str(tmp_path / "none"), schema=registry.source(spark, sf, "region").schema).scan()
    assert empty.columns == ["r_regionkey", "r_name"] and empty.collect() == []


def test_rows_of_files_are_numbered_by_path(spark, tmp_path):
    """Spark puts large files first; numbers follow paths, also behind filters, with rows settled or not."""
    folder, sizes = str(tmp_path / "documents.parquet"), [3, 40, 400, 90, 2000]
    for k, n in enumerate(sizes):
        low = sum(sizes[:k])
        spark.range(low, low + n, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.repeat(F.col("id").cast("string"), 1 + 2000 * (k % 2))).alias("text")).write.mode("append").parquet(f"{tmp_path}/{k}")
        own = next(Path(f"{tmp_path}/{k}").glob("*.parquet"))
        Path(folder).mkdir(exist_ok=True)
        Path(folder, f"part-{k:04}.parquet").write_bytes(own.read_bytes())
    df = spark.read.parquet(folder)
    assert [r[0] for r in df.select("doc_id").collect()] != list(range(sum(sizes)))
    for settle in (True, False):
        for where, step in (("true", 1), ("doc_id % 3 = 0", 3)):
            rows, n = writer.numbered(df.where(where), settle=settle)
            assert rows.where(f"doc_id <> {writer.ROW} * {step}").count() == 0 and n == rows.select(writer.ROW).distinct().count() == -(-sum(sizes) // step)
            assert rows.columns == ["doc_id", "text", writer.ROW]
    got = QUERIES["s30_segment_take"](spark, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 90, 150]
    shuffled, n = writer.numbered(df.orderBy(F.desc("doc_id")))
    assert shuffled.where(f"doc_id <> {n - 1} - {writer.ROW}").count() == 0


def test_many_deletes_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Files of positions are small, the rows in memory aren't: what is more than BROADCAST_ROWS is joined with a shuffle."""
    spark.range(2000).repartition(3).write.parquet(f"{tmp_path}/files")
    rows = spark.read.parquet(f"{tmp_path}/files").select("id", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__pos"))
    rows.where("id % 3 = 0").select(F.col("__file").alias("file_path"), F.col("__pos").alias("pos")).unionByName(spark.createDataFrame([(None, 1), ("elsewhere", 2), ("elsewhere", None)], "file_path string, pos long")).write.parquet(f"{tmp_path}/gone")
    gone, whole = spark.read.parquet(f"{tmp_path}/gone"), spark.range(2000).select("id", F.col("id").alias("__pos"))
    whole.where("id % 3 = 0").write.parquet(f"{tmp_path}/vector")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for most, join in ((10, "SortMergeJoin"), (10_000, "BroadcastHashJoin")):
        monkeypatch.setattr(deletes, "BROADCAST_ROWS", most)
        left = deletes.without_positions(rows, gone)
        vector = deletes.without_vector(whole, spark.read.parquet(f"{tmp_path}/vector").withColumnRenamed("__pos", "pos"))
        for df in (left, vector):
            assert [x.strip(" +-:").split(" ")[0] for x in plan(df).splitlines() if "LeftAnti" in x] == [join]
            assert sorted(r.id for r in df.collect()) == [i for i in range(2000) if i % 3]
        assert left.columns == rows.columns


def test_files_grow_in_number(spark, sf, monkeypatch):
    """No task sorts more than about FILE_ROWS rows into a file."""
    monkeypatch.setattr(registry, "FILE_ROWS", 100, raising=False)
    found = spark.read.parquet(registry.files_of(spark, sf, "orders", "o_orderkey")).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")).orderBy("low").collect()
    n = sum(r.n for r in found)
    assert len(found) > n // 150 and max(r.n for r in found) <= 300 and all(a.high < b.low for a, b in zip(found, found[1:]))
    assert registry.QUERIES["d03_live_rows_per_file"](spark, sf).count() == 4


def test_a_task_writes_many_small_files(spark, sf, monkeypatch):
    """Tasks grow with rows, not with files: each file is one bucket still, and groups meet without a sort."""
    monkeypatch.setattr(writer, "TASK_ROWS", 300, raising=False)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    n, root = orders.count(), shared_path(spark, "t")
    p = Properties({**patterns("o_orderkey|o_custkey", "o_totalprice"), "writer.file_rolling.rows": 20})
    Transaction(spark, root).append(writer.write(orders, root, p), orders.schema).commit()
    table = Table.load(spark, root)
    for g in table.manifest.groups:
        names = [x for x in Store(spark, root).names(g.fragments[0].path) if x.endswith(".parquet")]
        assert g.fragments[0].buckets == -(-n // 20) and len({x.rsplit("_", 1)[1] for x in names}) == len(names) > n // 60
        assert len({x.split("-")[1] for x in names}) <= -(-n // 300)
    plan = table.scan()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort [" not in plan
    assert sorted(table.scan().collect()) == sorted(orders.collect())
    assert [r.o_orderkey for r in table.rows(["o_orderkey", "o_totalprice"], n // 3, n // 2).orderBy(writer.ROW).collect()] == list(range(n // 3, n // 2))
