"""Column expressions on words and shingles that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters between words, as a class's inside and as themselves.
WHITE_CLASS, WHITE_CHARS = "\\x20\\x09-\\x0D", " \t\n\x0b\x0c\r"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once per row, however often f and its inner lambdas use it."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    """Words of a text, none for null."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{WHITE_CLASS}]+"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def windows(items: Column, size: int, f: Callable[[Column], Column]) -> Column:
    """f of every run of so many consecutive items; items must be bound or a column of the table below."""
    n = F.size(items)
    return F.when(n < size, F.array()).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: f(F.slice(items, i, size))))
