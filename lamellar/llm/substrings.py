"""Operator 4: passages that repeat anywhere in the corpus, removed word by word.

Every window of a fixed number of words has a Rabin-Karp hash.  Spark counts the
hashes: texts are dealt into parts, each part sends its distinct hashes, in
order, to the bucket that their leading bits name, and a bucket finds those that
several parts hold.  Only one bit per hash comes back.  Repeats inside a part
are known there already, so that a passage found a million times crosses the
network once per part.  Repeated windows merge into maximal intervals of words,
which are cut from the text.

Hashes are polynomials modulo the prime 2**61 - 1 at bases drawn for each run.  A
window is known by 32 bits of one hash, which name its bucket, and 56 of
another: over 10**14 bytes of text less than one false window is to be expected.
A part has a message for each bucket that it has hashes for, so there are never
more messages than hashes; on larger executors, larger parts make fewer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.llm import common
from lamellar.llm import kernels as K

WINDOW = 35
#: Text bytes in a part and, in windows, in a bucket.  With executors of 16 GB and more, ten times that saves messages.
PART_BYTES = 12 << 20
#: Bytes of a window's second hash that are sent.
SENT = 7


def _hashes(texts: pa.ChunkedArray, size: int, seeds: tuple[int, int, int]) -> tuple[list, np.ndarray, np.ndarray]:
    """Blocks (bytes, offsets, word start, word end, row, first word of each window); all windows' hashes; their bucket keys."""
    parts, found, keys = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for _, _, raw, at in K.blocks(texts, 1 << 20):
        start, end, row = K.words(raw, at)
        words = K.slice_hashes(raw, start, end, seeds[0])
        first, hashed = K.window_hashes(words, row, size, seeds[1])
        _, key = K.window_hashes(words, row, size, seeds[2])
        parts.append((raw, at, *(x.astype(np.int32 if len(raw) < 1 << 31 else np.int64) for x in (start, end, row, first))))
        found.append(hashed & np.uint64((1 << 8 * SENT) - 1))
        keys.append((key >> np.uint64(29)).astype(np.uint32))
    return parts, np.concatenate(found), np.concatenate(keys)


def _distinct(hashed: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows by (key, hash); which of them in that order begin a new one."""
    order = np.lexsort((hashed, keys))
    h, k = hashed[order], keys[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    return order, new


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys; a bucket is a range of keys."""
    return np.searchsorted(keys, (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets))


def _planes(values: np.ndarray, size: int = 8) -> bytes:
    """The low bytes of numbers, those of one place together: of sorted numbers the high ones compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _values(blob: bytes, size: int = 8) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(size, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :size] = raw.T
    return out.view("<u8").reshape(-1)


def remove_repeats(docs: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, removed (word intervals, end exclusive), kept_text.

    Words are runs of characters other than space and \\x09-\\x0D, unchanged.  A
    word goes if a window covers it whose word sequence also starts elsewhere, in
    whatever document; all windows are judged on the input.  kept_text is the other
    words, joined by one space.  Null and empty texts have no words and an empty
    kept_text; rows with one doc_id are documents of their own; columns other than
    doc_id and text are ignored; an empty table gives no rows.  A document is
    handled whole, so one task needs some thirty times the longest text in memory.
    """
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count, seeds = common.parts(docs, part_bytes), (K.seed(), K.seed(), K.seed())
    texts = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int")).repartitionById(count, F.col("part"))

    def ordered(rows: pa.Table) -> pa.Table:
        return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])

    def send(rows: pa.Table) -> pa.Table:
        rows = ordered(rows)
        _, hashed, keys = _hashes(rows.column("text"), window, seeds)
        order, new = _distinct(hashed, keys)
        h, k = hashed[order[new]], keys[order[new]]
        bounds = _bounds(k, count)
        full = np.flatnonzero(np.diff(bounds))
        part = rows.column("part")[0].as_py()
        own = [slice(bounds[i], bounds[i + 1]) for i in full.tolist()]
        return pa.table({"bucket": pa.array(full, pa.int32()), "part": pa.array(np.full(len(full), part), pa.int32()), "keys": pa.array([_planes(k[i], 4) for i in own], pa.binary()), "hashes": pa.array([_planes(h[i], SENT) for i in own], pa.binary())})

    def meet(rows: pa.Table) -> pa.Table:
        blobs = [_values(x.as_buffer(), SENT) for x in rows.column("hashes")]
        keys = np.concatenate([_values(x.as_buffer(), 4).astype(np.uint32) for x in rows.column("keys")])
        ends, every = np.cumsum([len(x) for x in blobs]), np.concatenate(blobs)
        del blobs
        order = np.lexsort((every, keys))
        same = (every[order[1:]] == every[order[:-1]]) & (keys[order[1:]] == keys[order[:-1]])
        hit = np.zeros(len(every), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        bits = [np.packbits(x).tobytes() for x in np.split(hit, ends[:-1])]
        return pa.table({"bucket": rows.column("bucket"), "part": rows.column("part"), "found": pa.array(bits, pa.binary())})

    def cut(rows: pa.Table, flags: pa.Table) -> pa.Table:
        rows, flags = ordered(rows), flags.sort_by("bucket")
        blocks, hashed, keys = _hashes(rows.column("text"), window, seeds)
        order, new = _distinct(hashed, keys)
        sizes = np.diff(_bounds(keys[order[new]], count))
        full = np.flatnonzero(sizes)
        if flags.column("bucket").to_pylist() != full.tolist():
            raise RuntimeError("the documents changed between two reads; write them to a table first")
        away = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=int(n)).astype(bool) for x, n in zip(flags.column("found"), sizes[full], strict=True))])
        number = np.cumsum(new) - 1
        again = away[number] | (np.bincount(number, minlength=len(away)) > 1)[number] if len(number) else np.zeros(0, bool)
        repeated = np.zeros(len(hashed), bool)
        repeated[order] = again
        n_words, n_removed, spans, texts_, seen = [], [], [], [], 0
        for raw, at, start, end, row, first in blocks:
            n = len(at) - 1
            hits = first[repeated[seen : seen + len(first)]]
            seen += len(first)
            depth = np.zeros(len(start) + 1, np.int64)
            np.add.at(depth, hits, 1)
            np.add.at(depth, hits + window, -1)
            gone = np.cumsum(depth[:-1]) > 0
            n_words.append(K.counts_by_row(row, n))
            n_removed.append(K.counts_by_row(row[gone], n))
            base = np.searchsorted(row, np.arange(n))
            edge = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (row[1:] != row[:-1])])) if len(gone) else np.zeros(0, np.int64)
            stop = np.flatnonzero(gone & np.concatenate([~gone[1:] | (row[1:] != row[:-1]), [True]])) if len(gone) else np.zeros(0, np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(edge - base[row[edge]]), pa.array(stop + 1 - base[row[edge]])], ["start", "end"])
            spans.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row[edge], np.arange(n + 1)), pa.int32()), pairs))
            texts_.append(kept_text(raw, at, start[~gone], end[~gone], row[~gone]))
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(np.concatenate(n_words)), "n_removed": pa.array(np.concatenate(n_removed)), "removed": pa.chunked_array(spans), "kept_text": pa.chunked_array(texts_)})

    sent = texts.groupBy("part").applyInArrow(send, "bucket int, part int, keys binary, hashes binary")
    found = sent.repartitionById(count, F.col("bucket")).groupBy("bucket").applyInArrow(meet, "bucket int, part int, found binary").repartitionById(count, F.col("part"))
    return texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")


def kept_text(raw: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> pa.Array:
    """Each row's given words, joined by one space."""
    depth = np.zeros(len(raw) + 1, np.int8)
    depth[start] += 1
    depth[end] -= 1
    keep = np.cumsum(depth[:-1], dtype=np.int8) > 0
    out = raw.copy()
    joint = end[:-1][row[1:] == row[:-1]] if len(row) else end
    out[joint], keep[joint] = 0x20, True
    offsets = np.concatenate([[0], np.cumsum(keep)])[at]
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out[keep].tobytes()))
