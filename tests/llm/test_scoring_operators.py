"""Operators 1 and 7: brute force where there is one, held-out accuracy, odd rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamellar.llm import pii, toxicity
from lamellar.llm.queries import op1_toxicity, op7_pii


def best_segments(values):
    """All maximal-scoring segments by definition: the best one, then both sides."""
    if not values:
        return []
    best = max(((sum(values[i:j]), -(j - i), -i) for i in range(len(values)) for j in range(i + 1, len(values) + 1)))
    if best[0] <= 1e-12:
        return []
    i, j = -best[2], -best[2] - best[1]
    return [(a, b) for a, b in best_segments(values[:i])] + [(i, j)] + [(a + j, b + j) for a, b in best_segments(values[j:])]


def test_segments_are_the_maximal_ones():
    r = random.Random(5)
    for _ in range(300):
        values = [r.choice([-0.37, -0.37, -0.37, 1.13, 2.21, 0.41]) for _ in range(r.randint(0, 14))]
        at = [i for i, v in enumerate(values) if v > 0]
        got = toxicity.segments(at, [values[i] for i in at], -0.37)
        assert sorted((a, b) for a, b, _ in got) == sorted(best_segments(values))
        for a, b, s in got:
            assert s == pytest.approx(sum(values[a:b]))


def test_rate_solves_the_moment_equation():
    p, s = np.array([0.05, 0.95]), np.array([2.0, -0.5])
    assert (p * np.exp(toxicity.rate_of(p, s) * s)).sum() == pytest.approx(1)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in out) >= 0.9 * len(out) and len(out) > 50
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, "you vile brute of a thing", "l") if i % 3 == 0 else (i, "a calm and kind line of words " * 3, "l") for i in range(90)] + [(200, None, "l"), (201, "", "l"), (None, "no id", "l"), (202, "vile brute\n" * 50, "l"), (202, "vile brute\n" * 50, "l")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(200, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, labels).collect()
    assert len(out) == 95 and all(0 <= r.score <= 1 for r in out)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.predicted for r in toxicity.score(docs, some).collect()} == {0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


CASES = [
    (1, "mail a.b+c@ex-ample.co.uk, x@y, 10.0.0.256 and 192.168.001.7.8 or 1.2.3.4"),
    (2, "card 4111 1111 1111 1111 and 4111-1111-1111-1112 x 378282246310005"),
    (3, "call +1 (425) 555-0123 or +44 20 7946 0958. +12 34 and + 5"),
    (4, "écrivez à é@b.fr ou é.x@b.fr 日本 8.8.8.8"),
    (5, None),
    (6, ""),
    (None, "z@z.zz"),
    (6, "contact: john at example dot com, phone (425) 555-0199, version 1.2.3.4"),
    (7, ("word " * 3000) + "last@mail.org"),
]


def base(text):
    text = text or ""
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.STRICT[kind].pattern, text):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and not all(int(x) <= 255 for x in s.split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_spans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(1).alias("spans")).unionByName(spark.createDataFrame([(i, t, 0) for i, t in CASES], "doc_id long, text string, spans int"))
    model = pii.fit(docs)
    got = sorted(((r.doc_id, r.text, [(x["kind"], x["start"], x["end"]) for x in r.spans if x["base"]]) for r in pii.detect(docs, model).collect()), key=str)
    want = sorted(((r.doc_id, r.text, base(r.text)) for r in docs.collect()), key=str)
    assert got == want
    spans = {r.doc_id: r for r in pii.detect(docs.where("doc_id = 6 and text <> ''"), model, redact=True).collect()}[6]
    assert "[EMAIL]" in spans.text and "[PHONE]" in spans.text
    assert pii.fit(docs.limit(0)) is None and pii.detect(docs.limit(0), None).count() == 0
    none = pii.detect(docs.where("text is null or text = ''"), None, redact=True).collect()
    assert [r.text for r in none if r.doc_id == 5] == [None] and all(r.spans == [] for r in none)


def test_query_digests(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in op7_pii(spark, sf).collect():
        own = base(texts[r.doc_id])
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in own)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, _, _ in own) for i in range(4))
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_expectation_maximisation_finds_the_reliable_labeler():
    r = random.Random(2)
    rows = {}
    for _ in range(4000):
        y = r.random() < 0.4
        sign = lambda p: (1 if y else -1) * (1 if r.random() < p else -1)  # noqa: B023, E731
        v = (sign(0.95), sign(0.7), sign(0.7), r.choice([-1, 0, 1]))
        rows[v] = rows.get(v, 0) + 1
    patterns = np.array(list(rows))
    prior, table, post = pii.expectation_maximisation(patterns, np.array(list(rows.values()), float))
    right = [table[j, 1, 2] / (table[j, 1, 2] + table[j, 1, 0]) for j in range(4)]
    assert right[0] > right[1] and abs(right[3] - 0.5) < 0.1 and abs(prior - 0.4) < 0.1
    assert all(p > 0.5 for v, p in zip(patterns.tolist(), post, strict=True) if v[:3] == [1, 1, 1])


def test_quick_rows_are_no_shortcut():
    """A row that is passed over holds no match of any pattern."""
    import pyarrow as pa

    parts = ["a", "1", "23", ".", "@", "+", "(", ")", " ", " at ", " dot ", "com", "[at]", "(dot)", ":", "ff", "-", "é", " ", "4444"]
    r = random.Random(3)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(4000)] + ["joe at ex dot com", "joe@ex.com", "1.2.3.4", "a:b:c:d:e:f:a:b"]
    seen = {i for i, _ in pii._texts(pa.array(texts))}
    for i, t in enumerate(texts):
        assert i in seen or not list(pii._found(t)), t


def test_order_of_kinds():
    assert list(itertools.chain(pii.STRICT)) == list(pii.KINDS) == list(pii.LOOSE)
