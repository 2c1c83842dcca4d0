"""Operator 3: secret scan with a random forest that removes false positives, in DataFrame functions only.

Candidates are long unbroken tokens, and shorter ones that are assigned to a
name that tells of a secret, whatever character stands around them.  The forest
sees a candidate's length, its transitions between classes of characters, the
share of it that frequent words of the corpus cover, whether it looks like a
path, and its neighbouring words.
It is trained from labelled findings: a given table, or else those candidates of
the corpus whose form or assignment leaves no doubt, in a sample of bounded size.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamellar.llm import common
from lamellar.llm import native as N

#: What a candidate consists of, forms with a published prefix, and words that name secrets.
BODY = "[A-Za-z0-9+/_.~-]"
ALPHABET = string.ascii_letters + string.digits + "+/_.~-="
PREFIXED = "^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,})$"
NAMES = "(?i)(pass|pwd|secret|token|api|key|auth|credential|private|bearer)"
#: What is no secret beyond doubt: a word, an address, or words and numbers that stand side by side or are joined, but no letters beside digits.  No group repeats, which would exhaust the stack on long tokens.
PLAIN, JOINED, BESIDE = "^[A-Za-z]+[.-]?$|^(https?:?)?//|^https?|^[a-z0-9._-]+\\.(html?|com|org|net|png|jpe?g|css|js)(/|$)", "^[a-z0-9.+~_/-]+$", "[a-z][0-9]|[0-9][a-z]"
#: What may open and close a quotation; what stands between a candidate and its name, read backwards.
QUOTE = "[\"'`]"
BETWEEN = f"[^A-Za-z0-9+/_.~\\-\\s=:\\p{{L}}\\p{{N}}]*+(?:\\s*+>?[=:]++\\s*+{QUOTE}?|\\s*+)"
#: Least length of a candidate, and of one that is assigned to a telling name; labelled findings used, by class; words of the dictionary; trees and their depth.
LEAST, ASSIGNED_LEAST, TRAIN_ROWS, DICTIONARY, TREES, DEPTH, SEED = 16, 6, 20_000, 300, 30, 8, 7

FEATURES = ["length", "transitions", "vowel_turns", "distinct_share", "digit_share", "upper_share", "hex", "coverage", "path", "assigned", "quoted", "named", "before_plain", "after_plain"]


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of three to twelve plain letters over all documents."""
    word = docs.select(F.explode(N.words(F.lower(F.col("text").cast("string")))).alias("w"))
    plain = word.select(F.regexp_replace("w", "[^a-z]+$", "").alias("w")).where(F.col("w").rlike("^[a-z]{3,12}$"))
    return [r["w"] for r in plain.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]


def candidates(docs: DataFrame, least: int = LEAST, assigned_least: int = ASSIGNED_LEAST) -> DataFrame:
    """A row per candidate: doc_id, n (its number in the text), before (an assigned name or the word before), joint (what stands between), secret, after.

    Candidates are all tokens of the least length, and those of assigned_least
    that are assigned to a telling name.  Two may be each other's neighbours;
    before and after are read from the text around and reach over one more
    token at most.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The sign after a name is no padding of the name; one before white space may be both.
    long = f"(?<!{BODY}){BODY}{{{least},}}+(?:=++(?!{QUOTE}?{BODY}))?"
    short = f"(?:[=:]>?|(?<==)(?=\\s))\\s*+{QUOTE}?{BODY}{{{assigned_least},{least - 1}}}+(?!{BODY})"
    token = f"{long}|{short}" if assigned_least < least else long
    gap = lambda x, i: F.coalesce(F.get(x["gaps"], i), F.lit(""))
    own = lambda x, i: F.coalesce(F.get(x["tokens"], i), F.lit(""))
    tail = f"{BODY}+=*$"  # a short one comes with its sign of assignment

    def around(x: Column) -> Column:
        cut = F.transform(x["tokens"], lambda t, i: F.struct(F.reverse(F.concat(gap(x, i - 1), own(x, i - 1), gap(x, i), F.regexp_replace(t, tail, ""))).alias("left"), F.regexp_extract(t, tail, 0).alias("secret"), F.concat(gap(x, i + 1), own(x, i + 1), gap(x, i + 2)).alias("right")))
        back = lambda m, i: F.reverse(F.regexp_extract(m["left"], f"^({BETWEEN})([^\\s=:\"'`]*)", i))
        read = F.transform(cut, lambda m: F.struct(back(m, 2).alias("before"), back(m, 1).alias("joint"), m["secret"].alias("secret"), F.regexp_extract(m["right"], "^[\"',;.]?(?:\\s+[^\\s]+)?", 0).alias("after")))
        return F.filter(read, lambda m: (F.length(F.rtrim(m["secret"], F.lit("="))) >= least) | (m["joint"].rlike("[=:]") & m["before"].rlike(NAMES)))

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(N.bind(F.struct(F.regexp_extract_all(text, F.lit(token), F.lit(0)).alias("tokens"), F.split(text, token).alias("gaps")), around)).alias("n", "m"))
    return found.select("doc_id", F.col("n").cast("long").alias("n"), "m.before", "m.joint", "m.secret", "m.after")


def features(found: DataFrame, words: list[str]) -> DataFrame:
    s, n = F.col("secret"), F.length("secret").cast("double")
    less = lambda c: n - F.length(c)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")
    covered = F.regexp_replace(F.lower(s), "|".join(words), "") if words else s  # longest words first, so that they win
    flag = lambda c: c.cast("double")
    plain = lambda c: flag(F.col(c).rlike("^[\\s\"',;.]*\\p{L}+[\\s\"',;.]*$"))
    value = {
        "length": n,
        "transitions": (F.length(classes) - 1) / n,
        "vowel_turns": F.regexp_count(F.lower(s), F.lit("[aeiou][^aeiou]")) / n,
        "distinct_share": sum((s.contains(c).cast("int") for c in ALPHABET), F.lit(0)) / F.least(n, F.lit(32.0)),
        "digit_share": less(F.regexp_replace(s, "[0-9]", "")) / n,
        "upper_share": less(F.regexp_replace(s, "[A-Z]", "")) / n,
        "hex": flag(s.rlike("^[0-9a-f]+$|^[0-9A-F]+$") & s.rlike("[A-Fa-f]") & s.rlike("[0-9]")),
        "coverage": less(covered) / n,
        "path": F.regexp_count(s, F.lit("[/.]")) / n,
        "assigned": flag(F.col("joint").rlike("[=:]")),
        "quoted": flag(F.col("joint").rlike(f"{QUOTE}$")),
        "named": flag(F.col("before").rlike(NAMES)),
        "before_plain": plain("before"),
        "after_plain": plain("after"),
    }
    return found.select("*", *[value[c].cast("double").alias(c) for c in FEATURES])


def doubtless() -> Column:
    """1 or 0 for candidates whose form or assignment tells what they are, null for all others."""
    s = F.col("secret")
    sure = s.rlike(PREFIXED) | ((F.col("named") == 1) & (F.col("assigned") == 1) & s.rlike("[0-9]") & s.rlike("[A-Za-z]"))
    plain = s.rlike(PLAIN) | (s.rlike(JOINED) & ~s.rlike(BESIDE))
    return F.when(sure, 1.0).when(plain & (F.col("named") == 0), 0.0)


def scan(docs: DataFrame, findings: DataFrame | None = None, train_rows: int = TRAIN_ROWS, least: int = LEAST) -> DataFrame:
    """A row per candidate: doc_id, n, before, joint, secret, after, the features, probability and is_secret.

    findings: labelled ones with before, joint, secret, after and label (0 or 1).
    At most train_rows of each label are used, those with the least hashes.  With
    findings of one label only, there is nothing to learn and that label is given
    to all.  Null and empty texts have no candidates; rows with one doc_id are
    scanned each; columns but doc_id and text are ignored.
    """
    words = sorted(dictionary(docs), key=lambda w: (-len(w), w))
    found = common.settled(features(candidates(docs, least), words))
    labelled = features(findings, words).withColumn("label", F.col("label").cast("double")) if findings is not None else found.withColumn("label", doubtless()).where("label is not null")
    hashed = labelled.select("label", *FEATURES, F.xxhash64("secret", "before", "after").alias("_h"))
    sample = None
    for label in (0.0, 1.0):
        own = hashed.where(F.col("label") == label).orderBy("_h").limit(train_rows).drop("_h")
        sample = own if sample is None else sample.unionByName(own)
    sample = common.settled(sample)
    labels = [r["label"] for r in sample.select("label").distinct().collect()]
    names = [*found.columns, "probability", "is_secret"]
    if len(labels) < 2:
        only = labels[0] if labels else 0.0
        return found.withColumn("probability", F.lit(only)).withColumn("is_secret", F.lit(bool(only))).select(names)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="_x")
    # Some true findings lack a telling neighbour: half of the sample is shown without its neighbours.
    blind = sample.select("label", *[F.lit(0.0).alias(c) if c in ("assigned", "quoted", "named") else F.col(c) for c in FEATURES])
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", probabilityCol="_p", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(assemble.transform(sample.unionByName(blind)))
    scored = forest.transform(assemble.transform(found)).withColumn("probability", vector_to_array("_p")[1])
    return scored.withColumn("is_secret", F.col("probability") >= 0.5).select(names)
