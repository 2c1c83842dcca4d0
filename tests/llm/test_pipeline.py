"""Each stage of the pipeline against brute force on what the one before kept."""

import zlib

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F

from lamellar.llm import pii
from tests.llm.test_jaccard_join import brute
from tests.llm.test_native_operators import shingles
from tests.llm.test_text_operators import ids_of


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.lit("extra"))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    odd = [(None, None), (5000, ""), (5001, f"Some words before it. {item} And some more words come after it, as they do."), (5002, "Write to me at some.one@mail.org if you would like to know more about this matter, which is a long one indeed.")]
    docs = docs.unionByName(spark.createDataFrame(odd + odd[-1:], "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"), F.lit("extra").alias("kept")))
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = docs.columns
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf).persist()
        assert out.columns == names and dict(out.dtypes) == dict(docs.dtypes), name
        before, after = [(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in out.collect()]
        assert all(r.n_chars == len(r.text) for r in out.where("doc_id > 0").collect()) or name in ("near_duplicates", "decontamination")
        if name == "quality_rules":
            assert set(d for d, _ in after) < set(d for d, _ in before)
            assert not {None, 5000} & {d for d, _ in after} and {5001, 5002} <= {d for d, _ in after}
        elif name == "near_duplicates":
            want = {d for d, _, c in brute(before) if d == c}
            assert sorted(d for d, _ in after) == sorted(want)
        elif name == "decontamination":
            sets = [shingles(t, 5) for t in items]
            held = {d for d, t in before if any(len(s & shingles(t, 5)) >= 0.8 * len(s) for s in sets if s)}
            assert sorted(d for d, _ in after) == sorted(d for d, _ in before if d not in held) and 5001 in held
        else:
            assert [d for d, _ in sorted(before)] == [d for d, _ in sorted(after)]
            changed = {d for (d, a), (_, b) in zip(sorted(before), sorted(after), strict=True) if a != b}
            strict = {d for d, t in before if any(pii.base_spans(k, t) for k in pii.KINDS)}
            loose = {d for d, t in before if any(pii.loose_spans(k, t, []) for k in pii.KINDS)}
            assert strict <= changed <= strict | loose and 5002 in changed  # test_hard_texts has the very texts
            assert not any(pii.base_spans(k, b) for _, b in after for k in ("email", "card"))
        docs = out
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = P.packed(spark, docs, sf).collect()
    want = [(d, s, zlib.crc32(x[s : s + 4096].tobytes())) for d, x in ids_of(rows, "word_bpe_49k.json") for s in range(0, len(x), 4096)]
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in got) == sorted(want)


def test_run_on_an_empty_table(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    assert np.all([callable(f) for _, f in P.STAGES])
