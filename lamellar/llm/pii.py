"""Operator 7: personal data by weak supervision.

Strict patterns give the base spans, which always stand.  Looser patterns give
further candidates.  Labelers - the strict pattern, formats and checksums,
gazetteers, the words around, the adjoining characters - vote on every
candidate of the corpus; Spark counts the vote patterns, of which there are a few
hundred at most, and expectation-maximisation on those counts estimates how
reliable each labeler is.  Its posteriors train the final span classifier, a
logistic regression on a sample of bounded size, which decides on the looser
candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamellar.llm import common
from lamellar.llm import kernels as K

#: Kinds in their order, and the strict patterns.
KINDS = ("email", "ip", "card", "phone")
STRICT = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same matches in linear time: a run of digits is tried at its start alone, and possessive runs are never tried shorter.  Of an address, what follows the @ and, backwards, what precedes it.
QUICK = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
DOMAIN, LOCAL = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"), re.compile(r"[A-Za-z0-9._%+-]*+")
LOOSE = {
    "email": re.compile(r"(?<![\w.-])[A-Za-z0-9._-]{2,}+\s?(?:[\[(]at[\])]|\sat\s)\s?[A-Za-z0-9-]++(?:\s?(?:[\[(]dot[\])]|\sdot\s)\s?[A-Za-z]{2,})+", re.I),
    "ip": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "card": re.compile(r"(?<![0-9.])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9.])"),
    "phone": re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w.-]?[0-9])"),
}
#: Gazetteers: top-level domains, and words that speak for or against personal data of a kind.
DOMAINS = frozenset("com org net edu gov int info biz io ai app dev co uk de fr es it nl eu us ca au ch at be se no dk fi pl pt br mx jp cn in ru".split())
FOR = {
    "email": frozenset("mail email e-mail contact write address correo courriel".split()),
    "ip": frozenset("ip ips address host server client from login adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit number payment karte carte tarjeta".split()),
    "phone": frozenset("call tel telephone phone mobile fax cell contact number telefon telefono".split()),
}
AGAINST = frozenset("version v release build isbn issn doi order invoice ticket sku serial section figure page chapter score".split())

SAMPLE_ROWS, EM_ROUNDS, VOTERS = 20_000, 60, 5
FEATURES = 18
MODEL_ROWS = 4 * 3**VOTERS


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def holds(kind: str, s: str) -> bool:
    """Whether a match of the strict pattern also passes the checks of its kind."""
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in s.split("."))
    if kind == "card":
        return 13 <= len(d := _digits(s)) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(_digits(s)) <= 15


def matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Spans of the strict pattern, leftmost and without overlap, in time linear in the text."""
    if kind != "email":
        yield from (m.span() for m in QUICK[kind].finditer(text))
        return
    done, at = 0, text.find("@")
    while at >= 0:  # the local part is what fits before the @, back to the last match or @
        local, rest = LOCAL.match(text[done:at][::-1]).end(), DOMAIN.match(text, at + 1)
        if local and rest:
            yield at - local, rest.end()
        done = rest.end() if local and rest else at + 1
        at = text.find("@", done)


def base_spans(kind: str, text: str) -> list[tuple[int, int]]:
    return [(s, e) for s, e in matches(kind, text) if holds(kind, text[s:e])]


def loose_spans(kind: str, text: str, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Matches of the loose pattern that touch no base span of their kind; base spans rise."""
    out, k = [], 0
    for m in LOOSE[kind].finditer(text):
        while k < len(base) and base[k][1] <= m.start():
            k += 1
        if k == len(base) or base[k][0] >= m.end():
            out.append(m.span())
    return out


def _words(s: str) -> list[str]:
    return [w.strip(".,;:!?()[]\"'=").lower() for w in s.split()]


def votes(kind: str, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """1 for, -1 against, 0 for no opinion: strict pattern, format, gazetteer, context, adjoining characters."""
    s = text[start:end]
    d = _digits(s)
    if kind == "email":
        form = 1 if re.search(r"[A-Za-z]", s) and not re.search(r"\.\.|^\.", s) else -1
        known = 1 if re.split(r"[.\s\])]+", s.strip(".])"))[-1].lower() in DOMAINS else -1
    elif kind == "ip":
        form = 1 if ":" in s or not any(len(x) > 1 and x[0] == "0" for x in s.split(".")) else -1
        known = 0 if ":" in s else -1 if s.startswith(("0.", "255.")) else 1
    elif kind == "card":
        form = 1 if luhn(d) else -1
        known = 1 if d[:1] in "3456" and len(d) in (14, 15, 16, 19) else -1
    else:
        form = 1 if 10 <= len(d) <= 13 and len(set(d)) > 2 else -1
        known = 0 if "+" in s else 1 if d[0] in "23456789" and d[3] in "23456789" else -1
    around = _words(text[max(0, start - 60) : start])[-5:] + _words(text[end : end + 30])[:2]
    context = -1 if any(w in AGAINST for w in around[:5]) else 1 if any(w in FOR[kind] for w in around) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    beside = -1 if left.isalnum() or left in ("/", "_", "=") and left or right.isalnum() or right in ("/", "_") and right else 1
    return (1 if base else 0, form, known, context, beside)


def features(kind: str, text: str, start: int, end: int, vote: tuple[int, ...]) -> list[float]:
    """What the classifier sees: kind, shape and surroundings, without the strict pattern's own vote."""
    s = text[start:end]
    n = len(s)
    d = len(_digits(s))
    shape = [d / n, sum(c.isupper() for c in s) / n, sum(c in " ().-/" for c in s) / n, min(n, 40) / 40, float("." in s), float(s[0].isdigit())]
    own = [float(v == x) for v in vote[1:] for x in (1, -1)]
    return [*(float(kind == k) for k in KINDS), *shape, *own]


@dataclass(frozen=True)
class Model:
    """reliabilities: for each labeler, P(vote | class) for votes -1, 0, 1; weights of the classifier, bias last."""

    prior: float
    reliabilities: np.ndarray
    weights: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior, P(vote | class) [labeler, class, vote + 1] and each pattern's posterior, starting from the majority vote."""
    post = 1 / (1 + np.exp(-patterns.sum(axis=1).astype(float)))
    prior, table = 0.5, np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        for v in range(3):
            table[:, :, v] = ((patterns == v - 1).T @ weight.T) + 1
        table /= table.sum(axis=2, keepdims=True)
        log = np.log(table)
        own = [sum(log[j, c, patterns[:, j] + 1] for j in range(patterns.shape[1])) for c in (0, 1)]
        post = 1 / (1 + np.exp(np.clip(own[0] + np.log(1 - prior) - own[1] - np.log(prior), -500, 500)))
    return prior, table, post


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, bias last, of a logistic regression on soft targets, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - target) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _hopeful(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that can hold any match: four digits, or an @, or - for spelt-out addresses - an a, t and d, o, t between breaks."""
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    lower = K.lower_ascii(raw)
    found = (sums((raw >= 48) & (raw <= 57)) >= 4) | (sums(raw == 64) > 0) | (sums(raw == 58) >= 7)
    if len(raw) >= 5:
        brk = np.isin(raw, np.frombuffer(b" \t\n\x0b\x0c\r([])", np.uint8)) | (raw >= 0x80)  # any Unicode space has high bytes
        dot = np.zeros(len(raw), bool)
        dot[:-4] = brk[:-4] & (lower[1:-3] == 100) & (lower[2:-2] == 111) & (lower[3:-1] == 116) & brk[4:]
        found |= sums(dot) > 0
    return found


def _found(text: str) -> Iterator[tuple[str, int, int, bool]]:
    for kind in KINDS:
        base = base_spans(kind, text)
        for s, e in base:
            yield kind, s, e, True
        for s, e in loose_spans(kind, text, base):
            yield kind, s, e, False


def _texts(column: pa.Array) -> Iterator[tuple[int, str]]:
    """Row and text of those rows that can hold a match."""
    for first, _, raw, at in K.blocks(column):
        data = raw.tobytes()
        for row in np.flatnonzero(_hopeful(raw, at)).tolist():
            yield first + row, data[at[row] : at[row + 1]].decode()


def candidates(docs: DataFrame) -> DataFrame:
    """A row per candidate of the corpus: kind, votes, features, and a hash that tells nothing of the text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, text in _texts(batch.column(0)):
                for kind, s, e, base in _found(text):
                    v = votes(kind, text, s, e, base)
                    out.append((KINDS.index(kind), list(v), features(kind, text, s, e, v), text[s:e]))
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["kind", "votes", "features", "value"])

    common.ship(docs.sparkSession)
    found = docs.select(F.col("text").cast("string")).mapInArrow(find, "kind int, votes array<int>, features array<double>, value string")
    return found.withColumn("order", F.xxhash64("value")).drop("value")


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Reliabilities from the votes on all candidates; the classifier from the sample_rows different ones with the least hashes.  None without candidates."""
    found = common.settled(candidates(docs))
    patterns = found.groupBy("votes").count().collect()  # at most 3**VOTERS rows
    if not patterns:
        return None
    table, counts = np.array([r["votes"] for r in patterns]), np.array([r["count"] for r in patterns], float)
    prior, reliabilities, post = expectation_maximisation(table, counts)
    known = {tuple(v): p for v, p in zip(table.tolist(), post.tolist(), strict=True)}
    different = found.select("order", "votes", "features").distinct()  # a value that a third of all texts hold is one of them
    sample = different.orderBy("order", "votes", "features").limit(sample_rows).select("votes", "features").collect()
    weights = logistic(np.array([r["features"] for r in sample]), np.array([known[tuple(r["votes"])] for r in sample]))
    return Model(prior, reliabilities, weights)


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())])


def detect(docs: DataFrame, model: Model | None, redact: bool = False) -> DataFrame:
    """docs with spans (kind, start, end, base, probability; by kind, then start) and, if asked for, the text with [KIND] for each span.

    Offsets count code points, ends are exclusive.  All strict matches are spans;
    looser candidates are if the classifier gives them one half or more.  A null
    text counts as empty and has no spans (redacted, it stays null).  Other columns
    pass through, but a column named spans is replaced.  Spans of different kinds
    may overlap; what they cover together gets the first one's mark.
    """
    names = [c for c in docs.columns if c != "spans"]
    schema = docs.select(*names).schema
    place = names.index("text")
    span = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("probability", T.DoubleType())])
    out_schema = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in schema.fields] + [T.StructField("spans", T.ArrayType(span))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            clean: dict[int, str] = {}
            for row, text in _texts(batch.column(place)):
                found = list(_found(text))
                seen = [features(kind, text, s, e, votes(kind, text, s, e, base)) for kind, s, e, base in found]
                own = model.probabilities(np.array(seen)).tolist() if model is not None and seen else [0.0] * len(seen)
                for (kind, s, e, base), p in zip(found, own, strict=True):
                    if base or p >= 0.5:
                        spans[row].append({"kind": KINDS.index(kind), "start": s, "end": e, "base": base, "probability": p})
                spans[row].sort(key=lambda x: (x["kind"], x["start"]))
                if redact and spans[row]:
                    clean[row] = masked(text, [(x["start"], x["end"], KINDS[x["kind"]]) for x in spans[row]])
            columns = list(batch.columns)
            if clean:
                texts = columns[place].to_pylist()
                for row, text in clean.items():
                    texts[row] = text
                columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(_SPAN))], names=[*names, "spans"])

    common.ship(docs.sparkSession)
    return docs.select(*[F.col("text").cast("string").alias("text") if c == "text" else F.col(common.quoted(c)) for c in names]).mapInArrow(mark, out_schema)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
