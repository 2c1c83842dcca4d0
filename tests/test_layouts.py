"""The legacy layout, routing of keyed splits, and the entry module without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

from lamellar.errors import InvalidArgument
from lamellar.operators import grouping
from lamellar.sources import packed
from lamellar.sources.external import Split, reasons
from lamellar.sources.store import shared_path


def test_packed_files_by_field_id(spark):
    schema = packed.with_ids(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.LongType()), T.StructField("c", T.StringType())]), [100, 200, 300])
    df = spark.createDataFrame([(i, i * 10, f"s{i}") for i in range(50)], "a int, b long, c string")
    paths = [shared_path(spark, "g0"), shared_path(spark, "g1")]
    assert packed.write(df, schema, paths, [[0, 2], [1]]) == 50
    asked = packed.with_ids(T.StructType([T.StructField("renamed", T.StringType()), T.StructField("b", T.LongType()), T.StructField("new", T.IntegerType())]), [300, 200, 900])
    out = packed.read(spark, paths, asked)
    assert sorted(map(tuple, out.collect())) == sorted((f"s{i}", i * 10, None) for i in range(50))
    with pytest.raises(InvalidArgument):
        packed.write(df, schema, paths[:1], [[0, 2], [1]])


def test_splitters():
    assert grouping.by_indices(["a", "b", "c"], [[2, 0], [1]]) == [["c", "a"], ["b"]]
    with pytest.raises(InvalidArgument):
        grouping.by_indices(["a", "b"], [[0], [0]])


def test_routing():
    assert reasons(Split()) == [] and reasons(Split(primary_keys=True, merge_engine="deduplicate")) == []
    assert reasons(Split(primary_keys=True, merge_engine="aggregation", level_zero=True)) == ["merge engine", "unmerged level"]
    assert reasons(Split(deletion_vector_bits=64)) == ["deletion vector"] and reasons(Split(format="orc")) == ["format"]


def test_entry_without_the_optional_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lamellar", tmp_path / "lamellar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(root / name, tmp_path / name)
    assert not (tmp_path / "lamellar" / "llm").exists()
    code = "import bench, __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_other_tests_run_without_the_optional_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for name in ("lamellar", "tests"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(root / name, tmp_path / name)
    run = lambda *more: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *more], cwd=tmp_path, check=True, capture_output=True, text=True).stdout
    assert "error" not in run("--collect-only", "tests").lower().splitlines()[-1]
    assert "passed" in run("tests/test_table.py", "-k", "test_groups or test_references or test_paths or test_layout_of_fragments")
