"""What the operators of this subpackage share: shipping code, shared folders, small helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, as Spark's own file server sends it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in a single local process, as in tests, a local one will do."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lamellar-"))
    return named or sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed now and kept in the shared folder; a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of DataFrames that are gone: it does so when the driver has collected garbage.

    What Python lets go in one round, the JVM finds unreachable in the next.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def quoted(name: str) -> str:
    """A column's name as an expression."""
    return "`" + name.replace("`", "``") + "`"


def free_names(taken: Sequence[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no taken column has it, in whatever case."""
    out, held = [], {c.lower() for c in taken}
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts(docs: DataFrame, part_bytes: int) -> int:
    """How many parts of at most about part_bytes of text to deal documents into; small tables still make work for all tasks."""
    n = text_bytes(docs)
    return max(1, -(-n // part_bytes), min(partitions(docs.sparkSession), n >> 20))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, for sizing groups of work."""
    return docs.agg(F.sum(F.octet_length(column)).cast("long").alias("n")).first()["n"] or 0
