"""Operator 9: exact Jaccard join on word shingles, as components of linked documents.

Jaccard distance is a metric, but documents that share nothing are all at
distance 1: Voronoi cells of sampled documents cannot tell such documents apart,
and their windows would replicate each document to every cell.  So the
top-level regions are cells of coarser pseudo-metrics: the shingle universe is
hashed into slices, and in each slice a document belongs to the cell of its own
content, at distance 0.  Linked documents differ in at most a known number k of
shingles for their sizes; with more than k non-empty slices they share a cell.

A cell's first document is its pivot, and its region are the documents of all its
cells; distances to it are exact.  Documents within the threshold r are linked to
it and so to each other.  By the triangle inequality those can link only to
documents within 2r of the pivot: that boundary is joined with them again, and
what lies further only with the boundary and among itself.  A region is joined by
sizes and by a bound from sketches; one that is too large is parted by further
slices, and joined by blocks if that does not help.  A cell of two needs no join.
No link between different texts is lost; links inside a component are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.llm import common
from lamellar.llm import kernels as K
from lamellar.llm.substrings import _planes, _values

SHINGLE = 5
#: Text bytes in a part: its sets and cells take some twenty times that in memory.
PART_BYTES = 12 << 20
#: The link threshold as a share; least bits of a sketch, as a power of two; times that a region is parted before blocks of it are compared by pairs.
NUMERATOR, DENOMINATOR = 4, 5
LEAST_BITS, ROUNDS = 6, 2
#: Documents of regions that one task compares; pairs of them, and shingles whose cells are found, at once.
REGION_ROWS, PAIRS, CELL_SHINGLES = 20_000, 1 << 17, 1 << 17
#: Shingles of a block of a region whose sets are compared, as long as these are BLOCKS or fewer; of a block at most; of all that one task compares.
BLOCK_SHINGLES, BLOCKS, MOST_SHINGLES, TASK_SHINGLES = 1 << 17, 8, 1 << 21, 1 << 18


class Levels:
    """Size classes [low, high): a partner of a document of class c that is not smaller is in c or c + 1.

    k is the most shingles in which a linked pair with the smaller one in the class
    differs, slices their number there, with some to spare for empty ones.
    """

    def __init__(self, largest: int):
        high, bounds = 2, [1]
        while bounds[-1] <= largest:
            bounds.append(high)
            high = max(high + 1, (high - 1) * DENOMINATOR // NUMERATOR + 1)
        top = np.array(bounds[1:], np.int64) - 1
        self.bounds = np.array(bounds, np.int64)
        # |A xor B| <= (1 - t) / (1 + t) (|A| + |B|)
        self.k = (top + top * DENOMINATOR // NUMERATOR) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
        self.slices = np.ceil((self.k + 1) * 1.07).astype(np.int64) + 2

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, sizes, side="right") - 1


def shingle_sets(texts: pa.ChunkedArray | pa.Array, seeds: tuple[int, int]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer words, the one of all words; none without words."""
    out: list[np.ndarray] = []
    for _, _, raw, at in K.blocks(texts, 1 << 20):
        lower = K.lower_ascii(raw)
        start, end, row = K.words(lower, at)
        hashed = K.slice_hashes(lower, start, end, seeds[0])
        n = len(at) - 1
        words = K.counts_by_row(row, n)
        first, found = K.window_hashes(hashed, row, SHINGLE, seeds[1])
        bounds = np.searchsorted(row[first], np.arange(n + 1))
        own = [found[bounds[k] : bounds[k + 1]] for k in range(n)]
        for size in range(1, SHINGLE):
            if (words == size).any():
                first, found = K.window_hashes(hashed, row, size, seeds[1])
                for i in np.flatnonzero(words[row[first]] == size).tolist():
                    own[int(row[first[i]])] = found[i : i + 1]
        out += [np.unique(x) for x in own]
    return out


def set_id(values: np.ndarray) -> int:
    """A 64-bit name of a set of hashes."""
    with np.errstate(over="ignore"):
        one, two = K.mix(values ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64), K.mix(values ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
        return int(K.mix(np.array([one + (two << np.uint64(1) | two >> np.uint64(63))], np.uint64) + np.uint64(len(values))).view(np.int64)[0])


def cells(sets: list[np.ndarray], salt: np.ndarray | None = None, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Name of each cell and the number of the set in it.  salt: the cell of each set that is being parted; turn: which slicing."""
    upto, low, out = np.cumsum([0, *map(len, sets)]), 0, [(np.zeros(0, np.uint64), np.zeros(0, np.int32))]
    while low < len(sets):  # some thousand shingles at once
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + CELL_SHINGLES, side="right")) - 1)
        name, own = _cells(sets[low:high], None if salt is None else salt[low:high], turn)
        out.append((name, (own + low).astype(np.int32)))
        low = high
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _cells(sets: list[np.ndarray], salt: np.ndarray | None, turn: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    levels = Levels(int(sizes.max()))
    place = K.mix(flat ^ np.uint64((0xD1B54A32D192ED03 * (turn + 1)) % (1 << 64)))
    content = K.mix(flat ^ np.uint64(0x8CB92BA72F3D8DD7))
    low, high = (content & np.uint64(0xFFFFFFFF)).astype(np.float64), (content >> np.uint64(32)).astype(np.float64)
    names, owners = [], []
    for down in (0, 1):
        level = levels.of(sizes) - down
        here = level >= 0
        m = np.where(here, levels.slices[np.maximum(level, 0)], 0)
        base = np.cumsum(m) - m
        use = here[doc]
        slot = (((place[use] >> np.uint64(32)) * m[doc[use]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        key, total = base[doc[use]] + slot, int(m.sum())
        n = np.bincount(key, minlength=total)
        own = np.repeat(np.arange(len(sets)), m)
        full = n > 0
        filled = np.bincount(own[full], minlength=len(sets))
        # A set with too few filled slices also has the cells of its empty ones.
        keep = full | (filled <= levels.k[np.maximum(level, 0)])[own]
        with np.errstate(over="ignore"):
            name = np.bincount(key, low[use], total).astype(np.uint64) + (np.bincount(key, high[use], total).astype(np.uint64) << np.uint64(24)) * np.uint64(0x9FB21C651E98DF25)
            name = K.mix(name + (np.arange(total) - base[own]).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + (level[own] + 1000 * turn).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
            if salt is not None:
                name = K.mix(name ^ salt[own])
        names.append(name[keep])
        owners.append(own[keep])
    return np.concatenate(names), np.concatenate(owners)


def sketch(values: np.ndarray) -> np.ndarray:
    """Parities of the shingles in each of 4 to 8 classes for a shingle, as bits: two sets differ in at least as many shingles as sketches in bits."""
    n = 1 << max(LEAST_BITS, (8 * len(values)).bit_length() - 1)
    return np.packbits(np.bincount((values >> np.uint64(5)).astype(np.int64) & (n - 1), minlength=n) & 1)


class Sketches:
    """Sketches of many sets, of one size together, for bounds on pairs."""

    def __init__(self, rows: list[np.ndarray]):
        self.size = np.array([len(x) // 8 for x in rows], np.int64)
        self.place, self.table = np.zeros(len(rows), np.int64), {}
        for n in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == n)
            self.place[own] = np.arange(len(own))
            self.table[n] = np.stack([rows[i] for i in own.tolist()]).view(np.uint64)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """At least so many shingles are in one of the sets a[i], b[i] alone.  The larger sketch is folded to the size of the smaller."""
        out = np.zeros(len(a), np.int64)
        kinds = self.size[a] << 32 | self.size[b]
        for kind in np.unique(kinds).tolist():
            one, two = kind >> 32, kind & 0xFFFFFFFF
            own, least = np.flatnonzero(kinds == kind), min(one, two)
            folded = lambda n, x: np.bitwise_xor.reduce(self.table[n][self.place[x]].reshape(len(x), -1, least), axis=1)  # noqa: B023,E731
            step = max(1, (1 << 18) // max(one, two))
            for i in range(0, len(own), step):
                k = own[i : i + step]
                out[k] = np.bitwise_count(folded(one, a[k]) ^ folded(two, b[k])).sum(axis=1, dtype=np.int64)
        return out


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((K.mix(names) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _sets_with_pivots(docs: DataFrame, part_bytes: int) -> DataFrame:
    """doc_id, n_shingles, node (name of the set, null if empty), uid, key and, for the first holder of a shared cell in its part, set and pivots (their uids, and whether such a cell has more documents than these two)."""
    count, seeds = common.parts(docs, part_bytes), (K.seed(), K.seed())
    texts = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int")).repartitionById(count, F.col("part"))

    def ordered(rows: pa.Table):
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        sets = shingle_sets(rows.column("text"), seeds)
        nodes = np.array([set_id(x) if len(x) else 0 for x in sets], np.int64)
        _, first = np.unique(nodes, return_index=True)
        lead = np.array(sorted(i for i in first.tolist() if len(sets[i])), np.int64)  # one of each set in the part
        return rows, sets, nodes, lead

    def send(rows: pa.Table) -> pa.Table:
        rows, sets, _, lead = ordered(rows)
        name, own = cells([sets[i] for i in lead.tolist()])
        del sets
        bucket = _bucket(name, count)
        order = np.lexsort((own, name, bucket))
        name, own, bounds = name[order], own[order], np.searchsorted(bucket[order], np.arange(count + 1))
        full = np.flatnonzero(np.diff(bounds)).tolist()
        part = rows.column("part")[0].as_py()
        kind = "<u2" if len(rows) <= 1 << 16 else "<u4"
        return pa.table({"bucket": pa.array(full, pa.int32()), "part": pa.array([part] * len(full), pa.int32()), "cells": pa.array([_planes(name[bounds[k] : bounds[k + 1]]) for k in full], pa.binary()), "docs": pa.array([lead[own[bounds[k] : bounds[k + 1]]].astype(kind).tobytes() for k in full], pa.binary())})

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        parts = rows.column("part").to_pylist()
        name = [_values(x.as_buffer()) for x in rows.column("cells")]
        uid = np.concatenate([np.frombuffer(x.as_buffer(), f"<u{len(x.as_buffer()) // len(n)}").astype(np.int64) + (p << 32) for p, n, x in zip(parts, name, rows.column("docs"), strict=True)])
        name = np.concatenate(name)
        order = np.lexsort((uid, name))
        name, uid = name[order], uid[order]
        begins = np.ones(len(name), bool)
        begins[1:] = name[1:] != name[:-1]
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(name)))
        more = np.repeat(size > 1, size)
        # A cell of two is settled by its pivot alone; larger ones may hold further pairs.
        found = np.stack([uid, np.repeat(uid[start], size), np.repeat(size > 2, size)], axis=1)[more]
        found = found[np.lexsort((-found[:, 2], found[:, 1], found[:, 0]))]
        fresh = np.ones(len(found), bool)
        fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        found = found[fresh]
        back = found[:, 0] >> 32
        bounds = np.flatnonzero(np.concatenate([[True], back[1:] != back[:-1]])) if len(back) else np.zeros(0, np.int64)
        ends = np.append(bounds[1:], len(back)) if len(back) else bounds
        return pa.table({"part": pa.array(back[bounds], pa.int32()), "found": pa.array([found[a:b].astype("<i8").tobytes() for a, b in zip(bounds, ends, strict=True)], pa.binary())})

    def join(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows, sets, nodes, _ = ordered(rows)
        part = rows.column("part")[0].as_py()
        own = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 3) for x in found.column("found"))])
        own = own[np.lexsort((-own[:, 2], own[:, 1], own[:, 0]))]
        fresh = np.ones(len(own), bool)
        fresh[1:] = (own[1:, :2] != own[:-1, :2]).any(axis=1)
        own = own[fresh]
        at = np.searchsorted(own[:, 0] & 0xFFFFFFFF, np.arange(len(sets) + 1))
        shared = [at[i + 1] > at[i] for i in range(len(sets))]
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                "node": pa.array([int(n) if len(x) else None for n, x in zip(nodes, sets, strict=True)], pa.int64()),
                "uid": pa.array(np.arange(len(sets)) + (part << 32)),
                "key": rows.column("key"),
                "set": pa.array([x.astype("<u8").tobytes() if s else None for x, s in zip(sets, shared, strict=True)], pa.binary()),
                "sketch": pa.array([sketch(x).tobytes() if s else None for x, s in zip(sets, shared, strict=True)], pa.binary()),
                "pivots": pa.array([[{"pivot": p, "open": bool(o)} for _, p, o in own[at[i] : at[i + 1]].tolist() if p != i + (part << 32)] if s else None for i, s in enumerate(shared)], pa.list_(pa.struct([("pivot", pa.int64()), ("open", pa.bool_())]))),
            }
        )

    sent = texts.groupBy("part").applyInArrow(send, "bucket int, part int, cells binary, docs binary")
    found = sent.repartitionById(count, F.col("bucket")).groupBy("bucket").applyInArrow(meet, "part int, found binary").repartitionById(count, F.col("part"))
    schema = "doc_id long, n_shingles long, node long, uid long, key long, set binary, sketch binary, pivots array<struct<pivot:bigint,open:boolean>>"
    return texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(join, schema)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b and their keys ka, kb among the sets: key, set) as a, b, common and joint, the sizes of intersection and union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common_, joint = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                n = len(np.intersect1d(one, two, assume_unique=True))
                common_.append(n)
                joint.append(len(one) + len(two) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common_, pa.int64()), pa.array(joint, pa.int64())], names=["a", "b", "common", "joint"])

    one, two = sets.select(F.col("key").alias("ka"), F.col("set").alias("_a")), sets.select(F.col("key").alias("kb"), F.col("set").alias("_b"))
    return pairs.join(two, "kb").join(one, "ka").select("a", "b", "_a", "_b").mapInArrow(compare, "a long, b long, common long, joint long")


def _stars(shared: DataFrame) -> DataFrame:
    """Pairs of a pivot a and a document b of one of its cells, with a key of each, open: whether one has further documents, and near: whether sketches leave it possible that they are within twice the threshold distance."""
    cast = shared.select(F.explode("pivots").alias("p"), F.col("uid").alias("kb"), F.col("node").alias("b"), F.col("sketch").alias("_kb"), F.col("n_shingles").alias("_nb")).select("p.pivot", "p.open", "kb", "b", "_kb", "_nb")
    heads = shared.select(F.col("uid").alias("pivot"), F.col("node").alias("a"), F.col("sketch").alias("_ka"), F.col("n_shingles").alias("_na"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes = batch.num_rows, batch.column(7).to_numpy() + batch.column(8).to_numpy()
            rows = [np.frombuffer(x.as_buffer(), np.uint8) for c in (5, 6) for x in batch.column(c)]
            apart = Sketches(rows).apart(np.arange(n), np.arange(n) + n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(apart * NUMERATOR <= sizes * (DENOMINATOR - NUMERATOR))], names=["a", "b", "ka", "kb", "open", "near"])

    pairs = cast.join(heads, "pivot").where("a <> b").select("a", "b", F.col("pivot").alias("ka"), "kb", "open", "_ka", "_kb", "_na", "_nb")
    found = pairs.mapInArrow(bound, "a long, b long, ka long, kb long, open boolean, near boolean")
    return found.groupBy("a", "b").agg(F.min("ka").alias("ka"), F.min("kb").alias("kb"), F.max("open").alias("open"), F.max("near").alias("near"))


_LINKED = f"common * {DENOMINATOR} >= joint * {NUMERATOR}"
#: Within twice the threshold distance: 1 - common / joint <= 2 (1 - t).
_NEAR = F"common * {DENOMINATOR} >= joint * {2 * NUMERATOR - DENOMINATOR}"


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node of the edges (a, b), by alternating large and small stars."""
    now, seen = common.settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        now = common.settled(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _parter(turn: int):
    """Sets (region, node, root, size, band, set), each with its cells within its region: region (now the cell), node, root, size, band."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                rows = batch.slice(low, 1000)
                name, doc = cells([np.frombuffer(x.as_buffer(), "<u8") for x in rows.column(5)], rows.column(0).to_numpy().view(np.uint64), turn)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), *(rows.column(k).take(pa.array(doc)) for k in range(1, 5))], names=["region", "node", "root", "size", "band"])

    return part


class _Regions:
    """Rows (region, node, root, size, band, sketch) of some regions; half, if given: 0, or which of two blocks a row is in, and then rows of one block don't meet."""

    def __init__(self, rows: pa.Table):
        column = lambda name: rows.column(name).to_numpy()
        self.node, self.first, doc = np.unique(column("node"), return_index=True, return_inverse=True)
        self.root, self.sizes = column("root")[self.first], column("size")[self.first]
        self.sketches = Sketches([np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("sketch").take(pa.array(self.first))])
        half = column("half") if "half" in rows.column_names else np.zeros(len(doc), np.int8)
        self.order = np.lexsort((self.sizes[doc], column("region")))
        self.name, self.doc, self.band, self.half = (x[self.order] for x in (column("region"), doc, column("band"), half))

    def pairs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Rows x and y (by size within regions), their nodes' numbers and the bound on what is in one of their sets alone, of pairs that are of different components (root, as it is by then) and that bands, sizes and sketches leave possible."""
        name, doc, band, half, sizes = self.name, self.doc, self.band, self.half, self.sizes
        rank = np.cumsum(np.concatenate([np.zeros(min(1, len(name)), np.int64), name[1:] != name[:-1]])) << 32
        # Of its region, a document meets those that are not smaller and not too large: a run of the rows after its own.
        reach = np.searchsorted(rank | sizes[doc], rank | sizes[doc] * DENOMINATOR // NUMERATOR, side="right")
        meets, low = reach - np.arange(len(name)) - 1, 0
        upto = np.concatenate([[0], np.cumsum(meets)])
        while low < len(name):  # some hundred thousand pairs at once
            high = max(low + 1, int(np.searchsorted(upto, upto[low] + PAIRS, side="right")) - 1)
            for start in range(0, int(upto[high] - upto[low]), PAIRS):
                k = np.arange(start, min(start + PAIRS, int(upto[high] - upto[low]))) + upto[low]
                x = np.searchsorted(upto, k, side="right") - 1
                y = x + 1 + k - upto[x]
                # Within the threshold of the pivot on one side, beyond twice that on the other: too far apart.
                fits = (self.root[doc[x]] != self.root[doc[y]]) & (np.abs(band[x] - band[y]) < 2) & ((half[x] == 0) | (half[x] != half[y]))
                x, y = x[fits], y[fits]
                a, b = doc[x], doc[y]
                apart = self.sketches.apart(a, b)
                close = apart * (DENOMINATOR + NUMERATOR) <= (sizes[a] + sizes[b]) * (DENOMINATOR - NUMERATOR)
                yield x[close], y[close], a[close], b[close], apart[close]
            low = high


def _busy(rows: pa.Table) -> pa.Table:
    """Rows (region, node) that are in any pair: no more than there are, however many pairs."""
    regions = _Regions(rows)
    busy = np.zeros(len(rows), bool)
    for x, y, *_ in regions.pairs():
        busy[regions.order[x]] = busy[regions.order[y]] = True
    return rows.select(["region", "node"]).filter(pa.array(busy))


def _comparer(rows: pa.Table) -> pa.Table:
    """Of rows with their sets: links that join components, and no more than it takes, so fewer than nodes.  Of rows without: all pairs that may be links."""
    regions, seen = _Regions(rows), [np.zeros((0, 2), np.int64)]
    if "set" not in rows.column_names:
        seen += [np.stack([regions.node[a], regions.node[b]], axis=1) for _, _, a, b, _ in regions.pairs()]
    else:
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in rows.column("set").take(pa.array(regions.first))]
        _, kin = np.unique(regions.root, return_inverse=True)
        parent, kin_of = list(range(len(sets))), kin.tolist()

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for _, _, a, b, apart in regions.pairs():
            links, order = [], np.argsort(apart, kind="stable")  # the closest first, so that most others are in one component by then
            for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
                p, q = find(kin_of[i]), find(kin_of[j])
                if p == q:
                    continue
                one, two = sets[i], sets[j]
                both = int(np.count_nonzero(one.take(np.searchsorted(one, two), mode="clip") == two))
                if both * DENOMINATOR >= (len(one) + len(two) - both) * NUMERATOR:
                    parent[q] = p
                    links.append((i, j))
            if links:
                regions.root = np.array([find(i) for i in range(len(sets))])[kin]
                seen.append(regions.node[np.array(links)])
    pairs = np.unique(np.sort(np.concatenate(seen), axis=1), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _joining(near: DataFrame, busy: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join components, among the rows near (region, node, root, size, band) that are in busy (region, node), with the sets of these alone."""
    own = near.join(busy, ["region", "node"], "left_semi")
    blocks = F.greatest(F.least(F.ceil(F.sum("size") / BLOCK_SHINGLES), F.lit(BLOCKS)), F.ceil(F.sum("size") / MOST_SHINGLES)).cast("int")
    large = own.groupBy("region").agg(blocks.alias("blocks")).where("blocks > 1")  # a number for a megabyte of sets at most
    cut = own.join(F.broadcast(large), "region", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.when(F.col("blocks") == 1, F.col("region")).otherwise(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")))
    half = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    cut = common.settled(cut.select(part.alias("region"), "node", "root", "size", "band", half.alias("half")))
    buckets = max(1, -(-(cut.agg(F.sum("size").alias("n")).first()["n"] or 0) // TASK_SHINGLES))
    dealt = cut.join(sets.select("node", "sketch", "set"), "node").withColumn("bucket", F.pmod(F.xxhash64("region"), F.lit(buckets)).cast("int")).repartitionById(buckets, F.col("bucket"))
    return common.settled(dealt.groupBy("bucket").applyInArrow(_comparer, "a long, b long"))


def _second(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among members (region, node, root, size, band) of a region that are of different components: enough to join these.

    No task gets a whole region of very many documents: it is parted by slices of
    its own, and what is as large after that is compared by pairs of blocks.  Sketches
    tell which documents may have a link; these come again with their sets, and each
    task joins its own, so that rows don't grow with pairs.
    """
    found = None
    for turn in range(1, ROUNDS + 1):
        mixed = members.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("region", F.ceil(F.col("n") / REGION_ROWS).cast("int").alias("blocks"))
        few = common.settled(members.join(mixed, "region"))
        if turn == ROUNDS:
            paired = few.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            part = F.when(F.col("blocks") == 1, F.col("region")).otherwise(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")))
            near = paired.select(part.alias("region"), "node", "root", "size", "band")
        else:
            near = few.where("blocks = 1").drop("blocks")
        buckets = max(1, -(-near.count() // REGION_ROWS))
        dealt = near.join(sets.select("node", "sketch"), "node").withColumn("bucket", F.pmod(F.xxhash64("region"), F.lit(buckets)).cast("int")).repartitionById(buckets, F.col("bucket"))
        busy = common.settled(dealt.groupBy("bucket").applyInArrow(_busy, "region long, node long"))
        pairs = _joining(near, busy, sets)
        found = pairs if found is None else found.unionByName(pairs)
        large = few.where("blocks > 1").drop("blocks")
        if turn == ROUNDS or not large.take(1):
            break
        members = large.join(sets.select("node", "set"), "node").select("region", "node", "root", "size", "band", "set").mapInArrow(_parter(turn), "region long, node long, root long, size long, band int")
    return found.distinct()


def linked(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row per document: doc_id, n_shingles, node (its set's name, null if it has no shingles), root (the name of its component, or null) and key (xxhash64 of its text).

    What jaccard_components() says of links and odd rows holds here too.
    """
    common.ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    spark = docs.sparkSession
    every = common.settled(_sets_with_pivots(docs, part_bytes))
    common.release(spark)
    narrow = common.settled(every.select("doc_id", "n_shingles", "node", "key"))
    shared = every.where("set is not null")
    star = common.settled(_stars(shared))
    exact = _verified(star.where("near").drop("near"), shared.select(F.col("uid").alias("key"), "set"))
    far = star.where("not near").select("a", "b", F.lit(0).cast("long").alias("common"), F.lit(1).cast("long").alias("joint"))
    first = common.settled(exact.unionByName(far).join(star.select("a", "b", "open"), ["a", "b"]))
    del exact, far, star
    common.release(spark)
    roots = components(first.where(_LINKED).select("a", "b"))

    # What a pivot leaves open in its region: documents off it, and those at it if others lie on its boundary.
    off = first.where(f"open and not ({_LINKED})").select(F.col("a").alias("region"), F.col("b").alias("node"), F.when(F.expr(_NEAR), 1).otherwise(2).alias("band"))
    edge = off.where("band = 1").select("region").distinct()
    at = first.where(f"open and {_LINKED}").select(F.col("a").alias("region"), F.col("b").alias("node"), F.lit(0).alias("band")).join(edge, "region", "left_semi")
    members = off.unionByName(at)
    chosen = shared.select("uid", "node").join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("uid").alias("uid")).join(roots, "node", "left").select("uid", "node", F.coalesce("root", "node").alias("root"))
    sets = common.settled(shared.select("uid", F.col("n_shingles").alias("size"), "set", "sketch").join(chosen, "uid").drop("uid"))
    members = common.settled(members.join(sets.select("node", "root", "size"), "node").select("region", "node", "root", "size", "band"))
    del every, shared, first, off, edge, at, chosen
    common.release(spark)
    second = common.settled(_second(members, sets))
    del sets, members
    if second.take(1):
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second))
    out = common.settled(narrow.join(roots, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("root", "node").alias("root"), "key"))
    common.release(spark)
    return out


def jaccard_components(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (least doc_id that links reach, itself included).

    Two documents link if 100 times the common shingles is at least 80 times all of
    theirs.  Words are runs of characters other than space and \\x09-\\x0D, A-Z in lower
    case; shingles are the distinct runs of five words, or all words if there are
    fewer.  A document without words, or a null text, has no shingles and no links.
    Rows with one doc_id are documents of their own, and a null doc_id is the last
    choice for component_id.  Columns but doc_id and text are ignored; an empty table
    gives no rows.  Shingles are named by hashes modulo 2**61 - 1 at a random base,
    and sets by 64 bits mixed from those.
    """
    rooted = linked(docs, part_bytes)
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("root", "least")
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.coalesce("least", "doc_id")).alias("component_id"))
