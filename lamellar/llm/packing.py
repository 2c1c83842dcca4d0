"""Operator 2: documents packed into fixed-length training sequences, best fit decreasing.

Documents longer than a window are first cut into full windows, which are
sequences of their own and move no more.  The remaining tails are dealt into
groups of a few thousand; each group is packed by itself:
tails in falling length, each into the open window with the least sufficient
room, which a segment tree over remaining capacities finds.  Groups leave one
partly filled window each, so padding stays far below one percent at any size,
and no task sees more than a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.llm import common, tokens

WINDOW, END_ID, GROUP_ROWS = 4096, 2, 4000

#: Sequences of one full window are numbered from here on, those of tails below.
FULL = 1 << 62

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Room:
    """Segment tree over capacities 0..size: how many open windows have each; least() is the smallest one not under n."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int = 1) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, n: int) -> int | None:
        i = n + self.leaves
        if self.count[i]:
            return n
        while i > 1:  # up to the first right-hand sibling that has any window
            if not i & 1 and self.count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length; longest first, each into the tightest open window."""
    room, free = Room(window), {}
    where, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        capacity = room.least(size)
        if capacity is None:
            capacity, bin_ = window, n
            n += 1
        else:
            bin_ = free[capacity].pop()
            room.add(capacity, -1)
        where[k], offset[k] = bin_, window - capacity
        if capacity > size:
            free.setdefault(capacity - size, []).append(bin_)
            room.add(capacity - size)
    return where, offset


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Full windows and the tail of each document's ids; with_ids adds the ids themselves (little-endian 32-bit)."""
    schema = PIECE + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, ids, at in tokens.encoded(batch.column(1), tokenizer, end_id):
                n = np.diff(at)
                parts = -(-n // window)
                row = np.repeat(np.arange(len(n)), parts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(window, n[row] - start)
                raw = ids.astype("<u4")
                data = [raw[b:e].tobytes() for b, e in zip((at[row] + start).tolist(), (at[row] + start + length).tolist(), strict=True)]
                out = [batch.column(0).slice(first, len(n)).take(pa.array(row)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(n[row])]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(data, pa.binary())] if with_ids else []), names=[x.split()[0] for x in schema.split(", ")])

    common.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, group_rows: int = GROUP_ROWS, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    docs has doc_id and text; other columns are ignored.  A null or empty text is
    just the end id.  Rows that share a doc_id, or have none, are packed as
    documents of their own.  Pieces of one sequence lie without gaps from offset 0;
    a sequence that isn't full ends early and is padded by its reader.
    An empty table gives no rows.  The pieces, a few numbers each, are kept in the
    shared folder so that texts are encoded once.
    """
    cut = common.settled(pieces(docs, tokenizer, window, end_id, with_ids))
    schema = PIECE + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    whole, tails = cut.where(F.col("length") == window), cut.where(F.col("length") < window)
    alone = whole.select("*", (F.lit(FULL) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    groups = max(1, -(-tails.count() // group_rows))
    dealt = tails.withColumn("_group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int"))

    def fill(rows: pa.Table) -> pa.Table:
        group = rows.column("_group")[0].as_py()
        rows = rows.drop_columns(["_group"]).sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        where, offset = best_fit(rows.column("length").to_numpy(), window)
        return rows.append_column("sequence_id", pa.array((group << 32) + where)).append_column("offset", pa.array(offset))

    return alone.unionByName(dealt.repartitionById(groups, F.col("_group")).groupBy("_group").applyInArrow(fill, schema))
