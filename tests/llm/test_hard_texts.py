"""Very long, unbroken and colliding texts, large and shared ids, clashing names: what no plain table shows."""

import random
import re
import time
from collections import Counter

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamellar.llm import common, jaccard_join, kernels, packing, pii, quality, secrets, substrings, token_store, tokens, toxicity

MB = 1 << 20
UNBROKEN = {
    "digits": "7" * (5 * MB), "upper": "ACGT" * (5 * MB // 4) + "a", "dots": "1." * (5 * MB // 2), "commas": "x," * (5 * MB // 2),
    "ats": "a@" * (5 * MB // 2), "plus": "+1 " * (5 * MB // 3), "dashes": "a-" * (5 * MB // 2), "equals": "key=" * (5 * MB // 4), "spaces": "A " * (5 * MB // 2) + "b", "paths": "/a" * (5 * MB // 2), "joined": "ab_" * MB,
}


def thue_morse(a: bytes, b: bytes, rounds: int) -> tuple[bytes, bytes]:
    """Two words that collide under every polynomial hash modulo 2**64."""
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("name", UNBROKEN)
def test_personal_data_in_linear_time(name):
    start = time.time()
    assert len(list(pii._found(UNBROKEN[name]))) < 2 * MB
    assert time.time() - start < 30


def test_native_rules_in_linear_time(spark):
    docs = spark.createDataFrame(list(enumerate(UNBROKEN.values())), "doc_id long, text string").repartition(3).persist()
    docs.count()
    start = time.time()
    out = {r.doc_id: r for r in quality.clean(docs).drop("text", "cleaned_text").collect()}
    assert time.time() - start < 90 and len(out) == len(UNBROKEN) and not any(r.kept for r in out.values())
    start = time.time()
    found = secrets.scan(docs).select("doc_id", F.length("secret").alias("n"), "distinct_share", "is_secret").collect()
    assert time.time() - start < 180 and {r.doc_id for r in found} >= {0, 1, 2} and max(r.n for r in found) == 5 * MB + 1


def test_strict_patterns_match_as_written():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("aB1.@-+% 0()25") for _ in range(rng.randrange(40)))
        for kind in pii.KINDS:
            assert [m.span() for m in pii.STRICT[kind].finditer(text)] == list(pii.matches(kind, text)), (kind, text)


def test_vocabulary_is_judged_alike_at_every_length(spark):
    rng = random.Random(1)
    words = [f"w{i}x" for i in range(5000)]
    lines = [" ".join(rng.choice(words[:70]) for _ in range(10_000)) + ".", " ".join(rng.choice(words) for _ in range(10_000)) + ".", " ".join(rng.choice(words[:4]) for _ in range(20)) + ".", " ".join(words[:20]) + "."]
    got = [r.fails for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, line string").select("i", quality.line_fails(F.col("line")).alias("fails")).orderBy("i").collect()]
    assert got == [True, False, True, False]


def test_hashes_modulo_a_prime():
    one, two = (np.frombuffer(x, np.uint8) for x in thue_morse(b"a", b"b", 11))
    for seed in range(5):
        roll = kernels.Rabin(seed)
        h = [roll.slices(np.concatenate([one, two]), np.array([0, len(one)]), np.array([len(one), 2 * len(one)]))]
        assert h[0][0] != h[0][1]
        power = lambda x: sum((int(c) + 1) * pow(roll.base, i, kernels.PRIME) for i, c in enumerate(x)) % kernels.PRIME  # noqa: B023,E731
        assert h[0][0] == power(one)
        values = kernels.mix(np.arange(100, dtype=np.uint64)) >> np.uint64(4)
        for size in (1, 5, 8, 35, 100):
            assert roll.windows(values, size)[0] == sum(int(v) * pow(roll.base, i, kernels.PRIME) for i, v in enumerate(values[:size])) % kernels.PRIME
    a = np.array([kernels.PRIME - 1, 0, 1, 12345678901234567], np.uint64)
    assert kernels.times(a, a[::-1]).tolist() == [int(x) * int(y) % kernels.PRIME for x, y in zip(a, a[::-1], strict=True)]


def test_a_very_long_slice_is_one_polynomial(monkeypatch):
    raw, roll = np.frombuffer(random.Random(1).randbytes(5000), np.uint8), kernels.Rabin(5)
    start, end = np.array([0, 5, 9, 100, 2000]), np.array([5, 5, 30, 1900, 5000])
    want = roll.slices(raw, start, end).tolist()
    monkeypatch.setattr(kernels, "SEGMENT", 64)
    assert roll.slices(raw, start, end).tolist() == want


def test_colliding_words_stay_apart(spark):
    x, y = (w.decode() for w in thue_morse(b"a", b"b", 10))
    base = [f"word{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join([*base[:20], x, *base[20:34]])), (2, " ".join([*base[:20], y, *base[20:34]]))], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_repeats(docs).collect()] == [0, 0]
    same = spark.createDataFrame([(1, f"{x} one two three four"), (2, f"{y} one two three four"), (3, f"{x} one two three four")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(same).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_colliding_pieces_get_their_own_ids(monkeypatch, name, collide):
    x, y = (w.decode() for w in thue_morse(b"a", b"b", 10))
    texts = [x, y, f"then {x} and {y}", "one two three, four: five", "five four three two one", f"{y} {x}"]
    path = public_tokenizers.path(name)
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    if collide:
        monkeypatch.setattr(tokens, "names", lambda raw, start, end: (end - start).astype(np.uint64) % np.uint64(2))
    own = Tokenizer.from_file(path)
    for _ in range(2):
        got = [ids[at[i] : at[i + 1]].tolist() for a, b, ids, at in tokens.encoded(pa.array(texts), path, None) for i in range(b - a)]
        assert got == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_keeps_large_ids_beside_null_ones(spark):
    big = 2**60
    docs = spark.createDataFrame([(big + 1, "one two"), (big + 3, "three"), (None, "four five six"), (big + 1, None)], "doc_id long, text string")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4, group_rows=100).collect()
    assert Counter(r.doc_id for r in out) == {big + 1: 2, big + 3: 1, None: 1}
    full = [r for r in out if r.length == 4]
    assert all(r.sequence_id >= packing.FULL and r.offset == 0 for r in full) and len({r.sequence_id for r in full}) == len(full) == 1


def test_lookups_in_a_dataset_of_shards(spark):
    texts = [(i, " ".join(random.Random(i).choice(["alpha", "beta", "gamma", "delta"]) for _ in range(50))) for i in range(60)] + [(7, "alpha"), (None, "beta beta")]
    docs, path = spark.createDataFrame(texts, "doc_id long, text string").repartition(5), common.shared_path(spark, "t")
    token_store.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), shard_tokens=200)
    rows = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in token_store.read_tokens(spark, path).collect()), key=lambda r: r[0])
    flat = [t for _, _, ids in rows for t in ids]
    asked = [0, 1, 500, len(flat) - 1, len(flat), 77]
    assert {r.position: r.token for r in token_store.tokens_at(spark, path, asked).collect()} == {i: flat[i] for i in asked if i < len(flat)}
    pick = [flat[0], flat[3], 49_999]
    want = Counter((t, d, k) for _, d, ids in rows for k, t in enumerate(ids) if t in pick)
    assert Counter((r.token, r.doc_id, r.place) for r in token_store.occurrences(spark, path, pick).collect()) == want


def test_a_query_decompresses_few_blocks():
    ids = (np.random.default_rng(1).zipf(1.3, 300_000) % 50_257).astype(np.uint32)
    shard = token_store.Shard(token_store.encode_shard(ids))
    assert shard.access(123_456) == ids[123_456]
    assert shard.block.cache_info().misses <= 2 * shard.planes < shard.planes * shard._blocks


def test_no_segment_means_the_same_everywhere():
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, 1.0, 0.0)
    assert toxicity.evidence(0, [], model) == toxicity.evidence(500, [], model)


def brute_cleaned(text):
    """Quality rules of a line in plain Python."""
    seen, kept = set(), []
    for line in (text or "").split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not words or line in seen:
            continue
        seen.add(line)
        n = len(words)
        fails = 100 * sum(c in quality.SYMBOLS for c in line) > quality.SYMBOL_PERCENT * n
        fails |= n < quality.NAVIGATION_WORDS and not re.search(quality.SENTENCE_END.replace("\\z", "\\Z"), line)
        fails |= n >= 3 and not re.search("[a-z]", line) and len(re.findall("[A-Z]", line)) >= 2
        fails |= n <= quality.BOILERPLATE_WORDS and bool(re.search(quality.BOILERPLATE, line))
        fails |= n >= quality.MANY_WORDS and len(set(words)) ** 2 < quality.DIFFERENT_SQUARE * n
        if not fails:
            kept.append(line)
    return "\n".join(kept)


def test_pipeline_stages_against_brute_force(spark, sf):
    from tests.llm.test_native_operators import measured

    clash = ["_id", "_n", "_row", "row", "_doc", "kept", "n_words", "part", "key", "name", "text_", "`odd`"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", *[F.lit(c).alias(c) for c in clash])
    mails = [(9000, "Write to some.one at example dot org, or to one@example.org, or call (212) 555-0187 or +1 212 555 0188 from 10.0.0.1 with card 4111 1111 1111 1111."), (9001, None), (9002, "")]
    docs = docs.unionByName(spark.createDataFrame(mails, "doc_id long, text string"), allowMissingColumns=True)
    rows = docs.collect()
    got = {r.doc_id: r.text for r in P.quality_rules(spark, docs, sf).collect()}
    for r in rows:
        n, _, _, _, repeated = measured(r.text)
        cleaned = brute_cleaned(r.text)
        stays = n >= 20 and 100 * repeated <= 30 * n and 100 * len(re.findall(r"[^\x20\x09-\x0D]+", cleaned)) >= quality.KEEP_PERCENT * n
        assert (r.doc_id in got) == stays and got.get(r.doc_id, cleaned) == cleaned, r.doc_id
    model = pii.fit(docs)
    out = P.without_personal_data(spark, docs, sf)
    assert out.columns == docs.columns
    after = {r.doc_id: r for r in out.collect()}
    for r in rows:
        spans = []
        for kind in pii.KINDS:
            base = [m.span() for m in pii.STRICT[kind].finditer(r.text or "") if pii.holds(kind, m.group())]
            for s, e, strict in [(*x, True) for x in base] + [(*x, False) for x in pii.loose_spans(kind, r.text or "", base)]:
                own = np.array([pii.features(kind, r.text, s, e, pii.votes(kind, r.text, s, e, strict))])
                if strict or model.probabilities(own)[0] >= 0.5:
                    spans.append((s, e, kind))
        want = None if r.text is None else pii.masked(r.text, sorted(spans))
        assert after[r.doc_id].text == want and after[r.doc_id]["_id"] == r["_id"]
    assert "[EMAIL]" in after[9000].text and "[CARD]" in after[9000].text and "@" not in after[9000].text
    for stage in (P.near_duplicates, P.without_benchmarks):
        assert stage(spark, docs, sf).columns == docs.columns


def test_near_duplicates_with_shared_ids(spark, sf):
    words = [f"w{i}" for i in range(100)]
    near = " ".join([*words[:99], "other"])
    rows = [(3, " ".join(words)), (5, near), (5, "quite another text that stands by itself here"), (None, near), (None, "no id and no twin in this table"), (7, None), (7, None), (8, ""), (6, "same text twice in one document"), (6, "same text twice in one document"), (4, near)]
    got = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[4], rows[5], rows[7], rows[8]], key=str)


def test_secrets_found_and_left_alone(spark, sf):
    """Precision and recall of the query's own training, on planted tokens."""
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = lambda n: "".join(rng.choice(letters) for _ in range(n))
    planted, clean = [], []
    for i in range(100):
        planted.append((10_000 + i, rng.choice(["the api_key = {} was in use", "export SECRET_TOKEN={}", "password: '{}' again", "we saw {} in the log"]).format("AKIA" + "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(16)) if i % 3 == 0 else token(40))))
        clean.append((10**6 + i, rng.choice(["see the path /usr/share/doc/packages/{}/readme", "an internationalization_of_{}_was made", "https://www.example.com/{}/index.html now", "order number 00012345678{} came"]).format(rng.choice(["common", "reading", "letters", "numbers"]) if i % 4 != 3 else rng.randrange(10**9))))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(planted + clean, "doc_id long, text string"))
    flagged = {r.doc_id for r in secrets.scan(docs).where("is_secret and doc_id >= 10000").select("doc_id").collect()}
    hit, false = sum(d < 10**6 for d in flagged), sum(d >= 10**6 for d in flagged)
    assert hit >= 90 and false <= 5, (hit, false)


def test_sampled_pivots_do_not_part_these_documents(spark, sf):
    """Why operator 9 finds its regions by hash slices: around sampled pivots nearly every document is in nearly every window."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    sets = [set(x.tolist()) for x in jaccard_join.shingle_sets(pa.array(texts), (1, 2)) if len(x)]
    pivots = random.Random(1).sample(sets, 16)
    distance = np.array([[1 - len(s & p) / len(s | p) for p in pivots] for s in sets])
    windows = (distance <= distance.min(axis=1, keepdims=True) + 0.4).sum(axis=1)
    assert windows.mean() > 0.8 * len(pivots)
