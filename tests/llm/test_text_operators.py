"""Operators 2, 4, 5 and 6 against brute force, on given tables and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lamellar.llm import common, packing, substrings, token_store, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 700}x" for i in range(3000))
ODD = [(1, ""), (2, None), (None, "no id"), (4, LONG), (4, LONG), (5, "  two  spaces\t\n and\x0bmore é日本 "), (5, "same id"), (6, "ab " * 200), (7, "it's 's x,y.z! Élan<|endoftext|> ok")]


def documents(spark, sf):
    """The given documents and odd rows, with a column whose name clashes with inner ones."""
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([(i, t, "part") for i, t in ODD], "doc_id long, text string, part string")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit("x").alias("part")).unionByName(odd)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return documents(spark, sf).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_tokenizers(rows, name):
    import pyarrow as pa

    path = public_tokenizers.path(name)
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    texts = [t for _, t in rows] + ["á, b×, ’, x   y éß, ≠ İI", " ", "\n\nx", "A,b;c'd's (e)", "x", "'s", "Été.Été"]
    got = [ids[at[i] : at[i + 1]].tolist() for a, b, ids, at in tokens.encoded(pa.array(texts), path, 2) for i in range(b - a)]
    assert got == [own.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def ids_of(rows, name):
    own = Tokenizer.from_file(public_tokenizers.path(name))
    own.encode_special_tokens = True
    return [(d, np.array(own.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for d, t in rows]


def test_packing_places_each_id_once(docs, rows):
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), group_rows=50).collect()
    ids = ids_of(rows, "word_bpe_49k.json")
    want = Counter((d, s, min(4096, len(x) - s), zlib.crc32(x[s : s + 4096].tobytes()), len(x)) for d, x in ids for s in range(0, len(x), 4096))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    inside = {}
    for r in out:
        inside.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(len(x) for _, x in ids)
    assert len(inside) <= total / 4096 + len(out) / 50 + 3


def test_best_fit_takes_the_tightest_window():
    where, offset = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert where.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 6, 5, 8]


def removed(rows, window):
    texts = [WORD.findall(t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), tuple((m.start(), m.end()) for m in re.finditer("1+", "".join("01"[g] for g in gone)))))
    return Counter(out)


@pytest.mark.parametrize("part_bytes", [20 << 20, 20_000])
def test_repeats_go(docs, rows, part_bytes):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text, tuple((x.start, x.end) for x in r.removed)) for r in substrings.remove_repeats(docs, part_bytes=part_bytes).collect())
    assert got == removed(rows, 35)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, page_id long, url string, html string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert substrings.remove_repeats(none).count() == 0
    assert packing.pack(none, path).count() == 0
    token_store.write_tokens(none, f"{tmp_path}/t", path)
    assert token_store.read_tokens(spark, f"{tmp_path}/t").count() == 0
    warc.write_warc(none, f"{tmp_path}/w")
    assert warc.read_warc(spark, f"{tmp_path}/w").count() == 0


def test_token_store_round_trip(spark, docs, rows):
    path = common.shared_path(spark, "t")
    token_store.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), shard_tokens=5000)
    got = sorted(((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_store.read_tokens(spark, path).collect()))
    ids = sorted(ids_of(rows, "byte_bpe_50k.json"), key=lambda x: (x[0] is not None, x[0]))
    assert [g[1] for g in got] == [d for d, _ in ids]
    assert Counter((g[1], g[3]) for g in got) == Counter((d, x.tobytes()) for d, x in ids)
    assert [g[0] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])])[:-1].tolist()


def test_wavelet_queries():
    ids = (np.random.default_rng(1).zipf(1.3, 9000) % 50257).astype(np.uint32)
    shard = token_store.Shard(token_store.encode_shard(ids))
    assert (shard.ids() == ids).all()
    for i in range(0, 9000, 97):
        t = int(ids[i])
        assert shard.access(i) == t and shard.rank(t, i) == (ids[:i] == t).sum() and shard.select(t, shard.rank(t, i)) == i
    assert shard.count(60000) == 0
    for few in ([], [7], [7, 7, 7]):
        assert token_store.Shard(token_store.encode_shard(np.array(few, np.uint32))).ids().tolist() == few


def pages_of(spark, sf):
    odd = [(900, "u", None), (901, None, ""), (902, "u", "z" * 2000), (903, "u v", "z" * 2000), (904, "u", "s" * 999), (905, "u", "s" * 999), (None, "u", "z" * 2000)]
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))


@pytest.mark.parametrize("split", ["128m", "3k"])
def test_warc_round_trip(spark, sf, split):
    pages = pages_of(spark, sf)
    path = common.shared_path(spark, "w")
    warc.write_warc(pages.coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = warc.read_warc(spark, path, payloads=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    data = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    latest = {}
    for p, h in data:
        if p is not None and len(h) >= 1000:
            latest[h] = max(latest.get(h, p), p)
    want = []
    for p, h in data:
        refers = latest[h] if h in latest and p is not None and latest[h] > p else None
        want.append((p, len(h), hashlib.sha1(h).hexdigest(), "response" if refers is None else "revisit", refers, h if refers is None else None))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == Counter(want)


def test_archives_are_plain_gzip_and_chance_magic_is_no_member(spark):
    import gzip
    import random
    from pathlib import Path

    members = warc.Members()
    body = warc._record(7, "u", b"x" + warc.MAGIC + b"y", "0" * 40, None).replace(b"0" * 40, hashlib.sha1(b"x" + warc.MAGIC + b"y").hexdigest().encode())
    squeeze = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: the magic stands in the member's bytes
    data = squeeze.compress(body) + squeeze.flush()
    assert data.count(warc.MAGIC) == 2
    out = [members.add(x) for x in data.split(warc.MAGIC)[1:]]
    assert out[0] == (None, True) and out[1][0]["page_id"] == 7
    assert warc.Members().add(b"y" + random.Random(1).randbytes(50)) == (None, False)
    path = common.shared_path(spark, "w")
    warc.write_warc(spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string"), path)
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path.removeprefix("file://")).glob("part-*"))
    assert whole.startswith(b"WARC/1.1") and b"hello" in whole


@pytest.mark.parametrize("suffix", [".warc", ".warc.gz"])
def test_archives_of_other_writers(spark, tmp_path, suffix):
    import base64
    import gzip

    html = b"<html>WARC/1.0 and WARC/1.1 " + bytes(range(256)) + warc.MAGIC * 3 + b"\r\n\r\n</html>"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(html).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + html
    parts = [
        ("warcinfo", "application/warc-fields", b"software: other\r\n", []),
        ("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", []),
        ("response", "application/http; msgtype=response", http, [f"WARC-Payload-Digest: {digest}", "warc-target-uri: http://a.example/\r\n  folded"]),
        ("revisit", "application/http; msgtype=response", b"", [f"WARC-Payload-Digest: {digest}", "WARC-Refers-To: <urn:uuid:2>"]),
        ("resource", "text/plain", b"plain \x00\xff bytes", []),
    ]
    records = []
    for i, (kind, content, block, more) in enumerate(parts):
        head = "\r\n".join([f"WARC/1.{i % 2}", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{i}>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Type: {content}", *more, f"Content-Length: {len(block)}"])
        records.append(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    for k in range(2):
        (tmp_path / f"file{k}{suffix}").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = sorted(((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to_id, None if r.payload is None else bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path), payloads=True).collect()), key=str)
    sha = lambda b: hashlib.sha1(b).hexdigest()
    info, rest = parts[0][2], parts[4][2]
    want = [("<urn:uuid:0>", "warcinfo", len(info), sha(info), None, info), ("<urn:uuid:1>", "request", 0, sha(b""), None, b""), ("<urn:uuid:2>", "response", len(html), sha(html), None, html), ("<urn:uuid:3>", "revisit", None, sha(html), "<urn:uuid:2>", None), ("<urn:uuid:4>", "resource", len(rest), sha(rest), None, rest)]
    assert got == sorted(want * 2, key=str)
