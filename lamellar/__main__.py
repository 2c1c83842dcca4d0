"""python -m lamellar create | describe | read: tables from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lamellar.operators.commit import Transaction, load
from lamellar.properties import Properties
from lamellar.sources import external, writer
from lamellar.table import Table


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="lamellar")
    sub = p.add_subparsers(dest="command", required=True)
    create = sub.add_parser("create", help="write a Parquet path as a table, or refer to a folder of files")
    create.add_argument("root"), create.add_argument("source"), create.add_argument("--external", action="store_true"), create.add_argument("--property", action="append", default=[], metavar="NAME=VALUE")
    describe = sub.add_parser("describe", help="print a manifest")
    describe.add_argument("root"), describe.add_argument("--version", type=int)
    read = sub.add_parser("read", help="print rows; --take wins over --predicate")
    read.add_argument("root"), read.add_argument("--columns"), read.add_argument("--take"), read.add_argument("--predicate"), read.add_argument("--version", type=int), read.add_argument("--limit", type=int, default=20)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "create":
        if a.external:
            print(external.register(spark, a.root, external.explore(spark, a.source)))
        else:
            df = spark.read.parquet(a.source)
            print(Transaction(spark, a.root).append(writer.write(df, a.root, Properties(dict(x.split("=", 1) for x in a.property))), df.schema).commit())
    elif a.command == "describe":
        print(load(spark, a.root, a.version).dumps())
    else:
        table, columns = Table.load(spark, a.root, a.version), a.columns.split(",") if a.columns else None
        out = table.take([int(x) for x in a.take.split(",")], columns) if a.take else table.scan(columns, a.predicate)
        for row in out.limit(a.limit).toJSON().collect():
            print(row)


if __name__ == "__main__":
    main()
