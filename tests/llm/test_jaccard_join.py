"""Operator 9 against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamellar.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        n = {}
        for x in s:
            for j in index[x]:
                if j < i:
                    n[j] = n.get(j, 0) + 1
        for j, k in n.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(sets[i]), d if not sets[i] else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(n, seed, words=60, edits=6):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randint(0, edits)):
            own[r.randrange(words)] = f"e{r.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


ODD = [(None, "no id at all here"), (1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A B c"), (6, "a b d"), (7, "x " * 300), (8, "x " * 9), (9, "one two three four five six seven eight nine"), (9, "one two three four five six seven eight nine ten")]


@pytest.mark.parametrize("part_bytes, region_rows", [(20 << 20, 20_000), (15_000, 20_000), (60_000, 60)])
def test_components(spark, sf, monkeypatch, part_bytes, region_rows):
    monkeypatch.setattr(J, "REGION_ROWS", region_rows)
    r = random.Random(9)
    stock = " ".join(f"stock{i}" for i in range(12))
    copies = [t for k in range(4) for t in near_copies(60, k, words=40 + 90 * k, edits=3 + 4 * k)]
    filler = [stock + " " + " ".join(f"f{r.randint(0, 10**6)}" for _ in range(r.randint(2, 60))) for _ in range(150)]
    chain = [" ".join(f"c{j}" for j in range(i * 4, i * 4 + 80)) for i in range(12)]
    rows = ODD + [(100 + i, t) for i, t in enumerate(copies + filler + chain + copies[:20])]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit(1).alias("part")).unionByName(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, part int"))
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in J.jaccard_components(docs, part_bytes).collect()), key=str)
    assert got == brute([(x.doc_id, x.text) for x in docs.collect()])


def test_empty(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_linked_sets_share_a_cell():
    r = np.random.default_rng(4)
    for _ in range(400):
        n = int(r.integers(1, 200))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = a[r.permutation(len(a))[: max(1, len(a) - int(r.integers(0, len(a) // 9 + 2)))]]
        b = np.unique(np.concatenate([b, r.integers(0, 2**63, int(r.integers(0, len(a) // 9 + 2))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if common * 5 >= 4 * (len(a) + len(b) - common) and len(a) and len(b):
            name, own = J.cells([a, b])
            assert np.intersect1d(name[own == 0], name[own == 1]).size
            apart = J.Sketches([J.sketch(a), J.sketch(b)]).apart(np.array([0, 1]), np.array([1, 0]))
            assert (apart <= len(a) + len(b) - 2 * common).all()


@pytest.mark.parametrize("pairs", [1, 7, 1 << 17])
def test_regions_are_compared_whole(monkeypatch, pairs):
    import pyarrow as pa

    monkeypatch.setattr(J, "PAIRS", pairs)
    r = np.random.default_rng(2)
    sets = []
    for k in range(40):
        base = r.integers(0, 2**61, int(r.integers(5, 60))).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[: len(base) - int(r.integers(0, 4))], r.integers(0, 2**61, int(r.integers(0, 4))).astype(np.uint64)])) for _ in range(3)]
    rows = [(k % 3, i, int(r.integers(0, 30)), len(x), int(r.integers(0, 3)), J.sketch(x).tobytes()) for k in range(3) for i, x in enumerate(sets)]
    rows = [(g, i, i % 50, n, b, s) for g, i, _, n, b, s in rows if (i + g) % 4]
    out = J._comparer(pa.table({n: pa.array([x[k] for x in rows], pa.binary() if n == "sketch" else pa.int64()) for k, n in enumerate(("region", "node", "root", "size", "band", "sketch"))}))
    got = set(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
    for g, i, ri, _, bi, _ in rows:
        for h, j, rj, _, bj, _ in rows:
            if g == h and i < j and ri != rj and abs(bi - bj) < 2:
                both = len(np.intersect1d(sets[i], sets[j]))
                if both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    assert (i, j) in got
    assert got and all(i < j for i, j in got)


def test_regions_give_few_links():
    """The links of a region join what brute force joins, and are fewer than its documents, however many pairs link."""
    import pyarrow as pa

    r = np.random.default_rng(6)
    base = r.integers(0, 2**61, 90).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[r.permutation(90)[: 90 - k]], r.integers(0, 2**61, k).astype(np.uint64)])) for k in r.integers(0, 14, 300).tolist()]
    rows = [(7, i, i, len(x), 1, J.sketch(x).tobytes(), x.astype("<u8").tobytes()) for i, x in enumerate(sets)]
    names = ("region", "node", "root", "size", "band", "sketch", "set")
    table = pa.table({n: pa.array([x[k] for x in rows], pa.binary() if n in ("sketch", "set") else pa.int64()) for k, n in enumerate(names)})

    def groups(pairs):
        root = list(range(len(sets)))
        for i, j in pairs:
            if root[i] != root[j]:
                root = [root[i] if x == root[j] else x for x in root]
        return {tuple(k for k, y in enumerate(root) if y == x) for x in set(root)}

    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    linked = [(i, j) for i in range(300) for j in range(i) if (n := both(i, j)) * 5 >= 4 * (len(sets[i]) + len(sets[j]) - n)]
    out = J._comparer(table)
    got = list(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
    assert len(linked) > 3000 and len(got) < 300
    assert groups(got) == groups(linked)


def test_components_by_blocks_of_sets(spark, monkeypatch):
    """Links found by _second are links, fewer than the rows compared, and none is lost between blocks."""
    for name, value in (("BLOCK_SHINGLES", 400), ("MOST_SHINGLES", 1000), ("TASK_SHINGLES", 2000)):
        monkeypatch.setattr(J, name, value, raising=False)
    second, seen = J._second, []
    monkeypatch.setattr(J, "_second", lambda members, sets: seen.append((second(members, sets).count(), sets.count())) or second(members, sets))
    rows = [(k * 1000 + i, t) for k in range(2) for i, t in enumerate(near_copies(250, k, words=70 + 40 * k, edits=5 + 2 * k))]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)
    assert all(n < m for n, m in seen)
