"""Operator 6: token ids kept as one wavelet matrix per shard.

A shard holds the ids of a run of documents in ascending doc_id order.  Its
distinct ids are numbered densely; bit after bit, from the highest, is stored as
a plane with sampled ranks, and the sequence is stably parted by that bit.  A
plane is compressed in blocks of some thousand bits behind a table of offsets:
token access, counting, rank and occurrence lookup decompress the blocks that
they touch, two a plane and position at most, and nothing else of the shard.
Shards are rows of a Parquet dataset, so any store that Spark writes to holds
them, and a lost task writes its shards again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.llm import common, tokens

END_ID, SHARD_TOKENS = 2, 1 << 18
#: Fixed values of the file format: first bytes, bits between two sampled ranks, bytes of a block of bits, and its head: length, planes, ids in the alphabet.
MAGIC, SAMPLED, BLOCK, HEAD = b"WVM2", 512, 4096, "<4sQBQ"
#: Partitions are of about so many bytes of text.
PART_BYTES = 64 << 20
_CODEC = "zstd"


def encode_shard(ids: np.ndarray) -> bytes:
    """HEAD; where each plane begins and its number of zeros; the alphabet; of each plane the sampled ranks, the ends of its blocks, and the compressed blocks."""
    top = int(ids.max()) + 1 if len(ids) else 0
    there = np.zeros(top, bool)
    there[ids] = True
    alphabet = np.flatnonzero(there).astype("<u4")
    dense = np.zeros(top, np.uint32)
    dense[alphabet] = np.arange(len(alphabet))
    kind = np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
    now = dense[ids].astype(kind) if len(ids) else np.zeros(0, kind)
    planes = max(1, (len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    bodies, zeros_of = [], []
    for bit in range(planes - 1, -1, -1):
        ones = (now & kind(1 << bit)) != 0
        packed = np.packbits(ones)
        sums = np.add.reduceat(np.bitwise_count(packed).astype(np.int64), np.arange(0, len(packed), SAMPLED // 8)) if len(packed) else np.zeros(0, np.int64)
        raw = packed.tobytes()
        blocks = [pa.compress(raw[i : i + BLOCK], codec=_CODEC, asbytes=True) for i in range(0, len(raw), BLOCK)]
        bodies.append(b"".join([np.concatenate([[0], np.cumsum(sums)]).astype("<u4").tobytes(), np.cumsum([0, *map(len, blocks)]).astype("<u4").tobytes(), *blocks]))
        zeros = now[~ones]
        zeros_of.append(len(zeros))
        now = np.concatenate([zeros, now[ones]])
    first = struct.calcsize(HEAD) + 16 * planes + 4 * len(alphabet)
    begins = first + np.cumsum([0, *map(len, bodies)])[:planes]
    return b"".join([struct.pack(HEAD, MAGIC, len(ids), planes, len(alphabet)), np.stack([begins, zeros_of], axis=1).astype("<i8").tobytes() if planes else b"", alphabet.tobytes(), *bodies])


class Shard:
    """Reads what encode_shard() wrote, in place: a block of bits is decompressed when a query touches it."""

    def __init__(self, data: bytes, kept: int = 64):
        magic, self.n, self.planes, letters = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self._data, at = memoryview(data), struct.calcsize(HEAD)
        table = np.frombuffer(data, "<i8", 2 * self.planes, at).reshape(-1, 2)
        self._begins, self.zeros = table[:, 0].tolist(), table[:, 1].tolist()
        self.alphabet = np.frombuffer(data, "<u4", letters, at + 16 * self.planes)
        bits = -(-self.n // 8)
        self._samples, self._blocks = -(-bits // (SAMPLED // 8)) + 1, -(-bits // BLOCK)
        self.block = lru_cache(maxsize=kept)(self._block)

    def sampled(self, plane: int) -> np.ndarray:
        """Ones before each sampled position."""
        return np.frombuffer(self._data, "<u4", self._samples, self._begins[plane])

    def _block(self, plane: int, k: int) -> np.ndarray:
        """The k-th block of a plane's bits."""
        table = self._begins[plane] + 4 * self._samples
        low, high = struct.unpack_from("<II", self._data, table + 4 * k)
        body = table + 4 * (self._blocks + 1)
        size = min(BLOCK, -(-self.n // 8) - k * BLOCK)
        return np.frombuffer(pa.decompress(self._data[body + low : body + high], decompressed_size=size, codec=_CODEC, asbytes=True), np.uint8)

    def bits(self, plane: int) -> np.ndarray:
        """All bytes of a plane."""
        return np.concatenate([np.zeros(0, np.uint8), *(self._block(plane, k) for k in range(self._blocks))])

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position i."""
        sample = i // SAMPLED
        n, first = int(self.sampled(plane)[sample]), sample * (SAMPLED // 8)
        if i > sample * SAMPLED:
            block, at = self.block(plane, first // BLOCK), first % BLOCK
            n += int(np.bitwise_count(block[at : at + i // 8 - first]).sum())
            n += (int(block[at + i // 8 - first]) >> (8 - i % 8)).bit_count() if i % 8 else 0
        return n

    def _bit(self, plane: int, i: int) -> int:
        return int(self.block(plane, i // 8 // BLOCK)[i // 8 % BLOCK]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        code = 0
        for p in range(self.planes):
            bit, ones = self._bit(p, i), self._ones(p, i)
            code, i = code << 1 | bit, self.zeros[p] + ones if bit else i - ones
        return int(self.alphabet[code])

    def _range(self, token: int, end: int) -> tuple[int, int] | None:
        """Where the id's occurrences before end lie after the last plane."""
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return None
        low, high = 0, end
        for p in range(self.planes):
            a, b = self._ones(p, low), self._ones(p, high)
            low, high = (self.zeros[p] + a, self.zeros[p] + b) if code >> (self.planes - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, end: int) -> int:
        """Occurrences of an id before position end."""
        found = self._range(token, end)
        return found[1] - found[0] if found else 0

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        code = int(np.searchsorted(self.alphabet, token))
        i = self._range(token, self.n)[0] + k
        for p in range(self.planes - 1, -1, -1):
            one = code >> (self.planes - 1 - p) & 1
            i = self._find(p, one, i - self.zeros[p] if one else i)
        return i

    def _find(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value."""
        sampled = self.sampled(plane).astype(np.int64)
        if not bit:
            sampled = np.arange(len(sampled)) * SAMPLED - sampled
        sample = int(np.searchsorted(sampled, k, side="right")) - 1
        first = sample * (SAMPLED // 8)
        bits = np.unpackbits(self.block(plane, first // BLOCK)[first % BLOCK : first % BLOCK + SAMPLED // 8])
        return sample * SAMPLED + int(np.flatnonzero(bits == bit)[k - int(sampled[sample])])

    def ids(self) -> np.ndarray:
        """All ids, in order."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        now = np.zeros(self.n, kind)
        for p in range(self.planes - 1, -1, -1):
            ones = np.unpackbits(self.bits(p), count=self.n).view(bool)
            before = np.empty(self.n, kind)
            before[~ones] = now[: self.zeros[p]]
            before[ones] = now[self.zeros[p] :] | kind(1 << (self.planes - 1 - p))
            now = before
        return self.alphabet[now] if self.planes else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode documents and write their ids to a dataset of shards, in ascending doc_id order.

    docs has doc_id and text; other columns are ignored.  A null or empty text is
    just the end id; a null doc_id comes first; rows with one doc_id lie together, by
    a hash of their text, however many partitions they take.  An empty table gives an empty dataset.  A document is never divided,
    so a shard is longer than shard_tokens only for a longer document.
    """
    spark = docs.sparkSession
    common.ship(spark)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, done = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal shard, done
            ids = np.concatenate([x[2] for x in held])
            row = [part, shard, done, len(ids), np.concatenate([x[0] for x in held]).astype("<i8").tobytes(), np.concatenate([x[1] for x in held]).astype("<i8").tobytes(), encode_shard(ids)]
            shard, done = shard + 1, done + len(ids)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "shard", "start", "n", "doc_ids", "lengths", "matrix"])

        waiting = 0
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc = np.where(null, np.iinfo(np.int64).min, batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            for first, _, ids, at in tokens.encoded(batch.column(1), tokenizer, end_id):
                row = 0
                while row < len(at) - 1:
                    stop = max(row + 1, int(np.searchsorted(at, at[row] + shard_tokens - waiting, side="right")) - 1)
                    held.append((doc[first + row : first + stop], np.diff(at[row : stop + 1]), ids[at[row] : at[stop]]))
                    waiting, row = waiting + int(at[stop] - at[row]), stop
                    if waiting >= shard_tokens or row < len(at) - 1:
                        yield flush()
                        waiting = 0
        if held:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed, count = texts.withColumn("tie", F.xxhash64("text")), max(common.partitions(spark), -(-common.text_bytes(texts) // PART_BYTES))
    ordered = keyed.repartitionByRange(count, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    ordered.mapInArrow(build, "part int, shard int, start long, n long, doc_ids binary, lengths binary, matrix binary").write.option("compression", "uncompressed").parquet(path)


def _bases(shards: DataFrame) -> dict[int, int]:
    """Ids before each partition of the writer, of which there is one for PART_BYTES of text."""
    base, done = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        base[part], done = done, done + n
    return base


def tokens_at(spark: SparkSession, path: str, positions: Sequence[int]) -> DataFrame:
    """position and token of the given places among all ids of a dataset; places beyond its end give no row."""
    common.ship(spark)
    shards = spark.read.parquet(path)
    base, asked = _bases(shards), np.unique(np.array(positions, np.int64))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, n, matrix in zip(*(batch.column(k) for k in range(4)), strict=True):
                first = base[part.as_py()] + start.as_py()
                own = asked[np.searchsorted(asked, first) : np.searchsorted(asked, first + n.as_py())]
                shard = Shard(matrix.as_buffer()) if len(own) else None
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([shard.access(i) for i in (own - first).tolist()], pa.int64())], names=["position", "token"])

    return shards.select("part", "start", "n", "matrix").mapInArrow(look, "position long, token long")


def occurrences(spark: SparkSession, path: str, wanted: Sequence[int]) -> DataFrame:
    """token, doc_id and place (in the document) of every occurrence of the given ids in a dataset."""
    common.ship(spark)
    asked = list(dict.fromkeys(wanted))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, lengths, matrix in zip(*(batch.column(k) for k in range(3)), strict=True):
                shard, doc = Shard(matrix.as_buffer()), np.frombuffer(docs.as_buffer(), "<i8")
                at = np.concatenate([[0], np.cumsum(np.frombuffer(lengths.as_buffer(), "<i8"))])
                for token in asked:
                    place = np.array([shard.select(token, k) for k in range(shard.count(token))], np.int64)
                    row = np.searchsorted(at, place, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), token, np.int64)), pa.array(doc[row], mask=doc[row] == np.iinfo(np.int64).min), pa.array(place - at[row])], names=["token", "doc_id", "place"])

    return spark.read.parquet(path).select("doc_ids", "lengths", "matrix").mapInArrow(look, "token long, doc_id long, place long")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of a dataset of shards, in no order: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""
    common.ship(spark)
    shards = spark.read.parquet(path)
    base = _bases(shards)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc, n = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
                ids, at = Shard(row["matrix"]).ids().astype("<u4"), np.concatenate([[0], np.cumsum(n)])
                data = [ids[b:e].tobytes() for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == np.iinfo(np.int64).min), pa.array(at[:-1] + base[row["part"]] + row["start"]), pa.array(n), pa.array(data, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return shards.select("part", "start", "doc_ids", "lengths", "matrix").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
