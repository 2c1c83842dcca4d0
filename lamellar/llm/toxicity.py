"""Operator 1: toxic passages by maximum-scoring segments.

A token's score is its log-odds between toxic and other labelled text with an
informative Dirichlet prior, where it is significant; all further tokens share
the log-odds of their pool, which is slightly below zero.  A linear-time scan finds
all maximal-scoring segments of a text.  By extreme-value theory a segment of
score S among n tokens has E = K n exp(-lambda S); lambda solves the moment
equation of the background, K is fitted to the best segments of clean labelled
texts.  The significant segments' evidence adds up, and a logistic fit on the
labelled texts turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamellar.llm import common
from lamellar.llm import kernels as K
from lamellar.llm.pii import logistic

#: Labelled documents learnt from: those with the least hashes.  This bounds the lexicon, which is sent to all tasks.
TRAIN_ROWS = 200_000
#: Bytes of a token's prefixes, which stand in, the longest first, for tokens that tell nothing as a whole.
PREFIXES = (8, 7, 6, 5, 4)
#: Draws the hash function that names tokens.
SEED = 1
#: The prior's weight as a share of the tokens, the least z and log-odds of a lexicon unit, and the E-value of a significant segment.
PRIOR_SHARE, LEAST_Z, LEAST_ODDS, LEAST_E = 0.05, 4.0, 0.7, 0.01
#: The best segment's evidence where there is no segment: in a clean text as in an empty one.
NO_SEGMENT = -10.0


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document may not be learnt from; false for a null id, which has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens' units (a row each: whole token, then prefixes, 0 where it is no longer than the prefix), each token's place among them, and its row.

    A token is a run of ASCII letters and digits, in lower case, and other characters' bytes.
    """
    lower = K.lower_ascii(raw)
    plain = np.where((lower >= 97) & (lower <= 122) | (lower >= 48) & (lower <= 57) | (lower >= 0x80), lower, 32).astype(np.uint8)
    start, end, row = K.words(plain, at)
    code, distinct = pd.factorize(K.slice_hashes(plain, start, end, SEED))
    first = np.empty(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    own, stop = start[first], end[first]
    units = np.zeros((len(distinct), 1 + len(PREFIXES)), np.uint64)
    units[:, 0] = distinct
    for i, size in enumerate(PREFIXES, 1):
        longer = stop - own > size
        with np.errstate(over="ignore"):
            units[longer, i] = K.mix(K.slice_hashes(plain, own[longer], own[longer] + size, SEED) + np.uint64(i))
    return units, code, row


@dataclass(frozen=True)
class Model:
    """hashes (sorted) and scores of the lexicon's units, the score of all other tokens, and the extreme-value parameters."""

    hashes: np.ndarray
    scores: np.ndarray
    other: float
    rate: float
    log_k: float

    def unit(self, units: np.ndarray) -> np.ndarray:
        """Place in the lexicon of the first unit of each row that is there, or -1."""
        out = np.full(len(units), -1, np.int64)
        if len(self.hashes):
            for i in range(units.shape[1]):
                place = np.minimum(np.searchsorted(self.hashes, units[:, i]), len(self.hashes) - 1)
                out = np.where((out < 0) & (units[:, i] != 0) & (self.hashes[place] == units[:, i]), place, out)
        return out


def segments(at: list[int], scores: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence with the given scores at the given places and other (< 0) elsewhere.

    The classical linear scan with a list of candidates, run on the scored tokens
    alone: between them the cumulative score falls at a constant rate.
    """
    found: list[list] = []  # start, end, cumulative score before and after
    total, last = 0.0, 0
    for i, s in zip(at, scores, strict=True):
        total += other * (i - last)
        last = i + 1
        left, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, left, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4] if len(found[j]) > 4 else j - 1
            if j < 0 or found[j][3] >= new[3]:
                new.append(j)  # the nearest candidate to the left with a lower start
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(x[0], x[1], x[3] - x[2]) for x in found]


def rate_of(probabilities: np.ndarray, scores: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1; the mean score is below zero."""
    low, high = 0.0, 1.0
    value = lambda x: float((probabilities * np.exp(np.clip(x * scores, -700, 700))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def lexicon(lines: DataFrame) -> Model:
    """The lexicon and its rates from distinct labelled lines (line, toxic).

    Lines count once for each label, so that copies of a document or stock phrases
    don't make their words telling.
    """
    names = [f"u{i}" for i in range(1 + len(PREFIXES))]
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, 1.0, 0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end, raw, at in K.blocks(batch.column(0)):
                units, code, row = tokens(raw, at)
                t = np.bincount(code, weights=toxic[first:end][row], minlength=len(units)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(u) for u in units.view(np.int64).T), pa.array(t), pa.array(np.bincount(code, minlength=len(units)) - t)], names=[*names, "t", "c"])

    kinds = ", ".join(f"{n} long" for n in names) + ", t long, c long"
    counts = common.settled(lines.mapInArrow(count, kinds).groupBy(*names).agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    total = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    nt, nc = total["t"] or 0, total["c"] or 0
    if not nt or not nc:
        return none
    units = counts.select(F.explode(F.array(*names)).alias("u"), "t", "c").where("u != 0").groupBy("u").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    prior = F.lit(PRIOR_SHARE) * (F.col("t") + F.col("c"))
    a0 = PRIOR_SHARE * (nt + nc)
    t, c = F.col("t") + prior, F.col("c") + prior
    odds = F.log(t / (F.lit(nt + a0) - t)) - F.log(c / (F.lit(nc + a0) - c))
    telling = units.withColumn("s", odds).where((F.col("s") / F.sqrt(1 / t + 1 / c) >= LEAST_Z) & (F.col("s") >= LEAST_ODDS)).select("u", "s").collect()
    if not telling:
        return none
    h, s = np.array([r["u"] for r in telling], np.int64).view(np.uint64), np.array([r["s"] for r in telling])
    order = np.argsort(h)
    first = Model(h[order], s[order], -1.0, 1.0, 0.0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.stack([batch.column(i).to_numpy() for i in range(len(names))], axis=1).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(first.unit(own)), batch.column(len(names)), batch.column(len(names) + 1)], names=["place", "t", "c"])

    used = counts.mapInArrow(assign, "place long, t long, c long").where("place >= 0").groupBy("place").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()
    lt, lc = sum(r["t"] for r in used), sum(r["c"] for r in used)
    other = min(np.log((nt - lt + 1) / (nt + 2)) - np.log((nc - lc + 1) / (nc + 2)), -0.01)
    background, scores = np.array([(r["c"] + 0.5) / (nc + 1) for r in used]), first.scores[[r["place"] for r in used]]
    mean = float((background * scores).sum() + (1 - background.sum()) * other)
    if mean >= 0:  # scores must fall on average for the theory to hold
        other -= mean + 0.01
    rate = rate_of(np.append(background, max(1 - background.sum(), 1e-9)), np.append(scores, other))
    return Model(first.hashes, first.scores, float(other), rate, 0.0)


def _scan(column: pa.Array, model: Model) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(row, tokens, maximal segments) of every row."""
    for first, end, raw, at in K.blocks(column):
        units, code, row = tokens(raw, at)
        n = K.counts_by_row(row, end - first)
        unit = model.unit(units)
        place = unit[code] if len(code) else np.zeros(0, np.int64)
        hit = np.flatnonzero(place >= 0)
        base = np.concatenate([[0], np.cumsum(n)])
        bounds = np.searchsorted(row[hit], np.arange(end - first + 1))
        scores = model.scores[place[hit]] if len(hit) else np.zeros(0)
        for k in range(end - first):
            own = slice(bounds[k], bounds[k + 1])
            yield first + k, int(n[k]), segments((hit[own] - base[k]).tolist(), scores[own].tolist(), model.other) if own.start < own.stop else []


def evidence(n: int, found: list[tuple[int, int, float]], model: Model) -> tuple[float, float, list[tuple[int, int, float, float]]]:
    """Best segment's and all significant segments' evidence, -log E; and the significant ones (start, end, score, E)."""
    if not found:
        return NO_SEGMENT, 0.0, []
    limit = model.log_k + np.log(n)
    every = [(a, b, s, model.rate * s - limit) for a, b, s in found]
    best = max(x[3] for x in every)
    good = [(a, b, s, float(np.exp(-v))) for a, b, s, v in every if v >= -np.log(LEAST_E)]
    return float(best), float(sum(-np.log(max(x[3], 1e-300)) for x in good)), good


def measured(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id with n_tokens, best, evidence and the significant segments (token intervals) of every text."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, best, total, parts = [], [], [], []
            for _, size, found in _scan(batch.column(1), model):
                b, t, good = evidence(size, found, model)
                n.append(size), best.append(b), total.append(t), parts.append([dict(zip(("start", "end", "score", "e_value"), x, strict=True)) for x in good])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(total, pa.float64()), pa.array(parts, kind)], names=["doc_id", "n_tokens", "best", "evidence", "segments"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, best double, evidence double, segments array<struct<start:bigint,end:bigint,score:double,e_value:double>>")


def _inputs() -> list[Column]:
    """What the logistic fit sees: the best segment's evidence, all evidence, and that for each hundred tokens."""
    return [F.least(F.greatest(F.col("best"), F.lit(NO_SEGMENT)), F.lit(40.0)) / 10, F.log1p("evidence"), F.log1p(F.col("evidence") * 100 / F.greatest("n_tokens", F.lit(20)))]


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted, n_tokens, best, evidence, segments.

    labels has doc_id and toxic; a document with several labels counts as toxic if
    one says so, null labels are ignored.  Labels of documents whose crc32(doc_id
    as text) is divisible by 5 are never read.  Without labels of both kinds, the
    score is the rate of toxic labels.  A null text counts as empty, and an empty
    one has no evidence.  Rows that share a doc_id are scored each; columns but
    doc_id and text are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic is not null").where(~held_out(F.col("_id")))
    known = common.settled(known.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id")).limit(train_rows))
    labelled = docs.join(F.broadcast(known), docs["doc_id"] == known["_id"])  # at most train_rows rows of two numbers
    lines = labelled.select(F.explode(F.split("text", "\n")).alias("line"), F.col("toxic").cast("long").alias("toxic")).where("line != ''").distinct()
    first = lexicon(lines)
    rows = known.agg(F.avg("toxic").alias("rate"), F.min("toxic").alias("low"), F.max("toxic").alias("high")).first()
    if not len(first.hashes) or rows["low"] == rows["high"]:
        return _verdicts(measured(docs, first), F.lit(float(rows["rate"] or 0.0)))
    train = common.settled(measured(labelled.select("doc_id", "text"), first).join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("n_tokens", "segments", "best", "toxic"))
    # The best segments of clean texts that have one follow a Gumbel law with mean log(K n) + Euler's constant, over lambda.
    clean = train.where((F.col("toxic") == 0) & (F.col("best") > NO_SEGMENT)).agg(F.avg("best").alias("m")).first()
    log_k = float(np.clip((clean["m"] if clean["m"] is not None else 0.0) - np.euler_gamma, -8.0, 8.0))
    model = replace(first, log_k=log_k)
    again = measured(labelled.select("doc_id", "text"), model).join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    fit = again.select(*[c.alias(f"x{i}") for i, c in enumerate(_inputs())], "toxic").toPandas()  # at most train_rows rows of four numbers
    w = logistic(fit.drop(columns="toxic").to_numpy(), fit["toxic"].to_numpy(float))
    logit = F.lit(float(w[-1]))
    for x, own in zip(_inputs(), w.tolist()[:-1], strict=True):
        logit = logit + x * own
    return _verdicts(measured(docs, model), 1 / (1 + F.exp(-logit)))


def _verdicts(out: DataFrame, probability: Column) -> DataFrame:
    scored = out.withColumn("score", probability)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", "best", "evidence", "segments")
