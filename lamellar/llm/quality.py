"""Operator 8: line-first cleaning, in DataFrame functions only.

Lines are judged one by one; failing ones go, and a document that would lose
too much of its text goes as a whole.  All work is within the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamellar.llm import common
from lamellar.llm import native as N

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A document must keep this share of its words; lines with fewer words must end as sentences do; symbols per 100 words that a line may have.
KEEP_PERCENT, NAVIGATION_WORDS, SYMBOL_PERCENT, BOILERPLATE_WORDS = 60, 10, 30, 30
#: A line with as many words must have so many different ones that their square is this many times the words: vocabulary grows with the root of a text's length.
MANY_WORDS, DIFFERENT_SQUARE = 15, 3
#: The symbols counted, what ends a sentence, and phrases of boilerplate lines.
SYMBOLS = "#*$%&|<>"
SENTENCE_END = f"[.!?:;…。！？»”’\"')\\]][{N.WHITE_CLASS}]*\\z"
BOILERPLATE = "(?i)(all rights reserved|cookie policy|privacy policy|terms of use|terms of service|licensed under|released under|subscribe to|enable javascript|click here|read more|copyright \\(c\\))"
SHOUTING, CALM = "[A-Z][^A-Z]*[A-Z]", "[a-z]"

_WORD = f"[^{N.WHITE_CLASS}]"


def line_fails(line: Column) -> Column:
    """Whether a line that has a word breaks a rule: symbols, navigation (short, no sentence end), shouting, boilerplate or the same words over and over."""
    n = F.regexp_count(line, F.lit(f"{_WORD}+"))
    symbols = F.length(F.regexp_replace(line, f"[^{SYMBOLS}]+", ""))
    return (symbols * 100 > n * SYMBOL_PERCENT) | ((n < NAVIGATION_WORDS) & ~line.rlike(SENTENCE_END)) | ((n >= 3) & line.rlike(SHOUTING) & ~line.rlike(CALM)) | ((n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)) | ((n >= MANY_WORDS) & (F.pow(F.size(F.array_distinct(N.words(line))), F.lit(2.0)) < n * DIFFERENT_SQUARE))


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that a text has twice or more; words must be bound."""

    def covered(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        again = lambda s: F.filter(F.transform(s, lambda e, i: F.when((e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"]), e["p"])), lambda p: p.isNotNull())
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(F.array_sort(N.bind(ordered, again)), start, step, lambda a: a["n"])

    found = N.windows(words, WINDOW, F.xxhash64)
    return N.bind(found.cast("array<bigint>"), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def clean(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned_text, kept_words and kept added.

    Needs text; other columns pass through, but those with the names above are
    replaced.  A null text counts as empty: no words, base_failed, not kept.  Equal
    lines after the first go as well as lines that break a rule.  Rows are judged
    alone, so repeated rows get equal verdicts, and an empty table stays empty.
    Every rule takes time linear in a line, however long.  Repeated windows of one
    text are told by 64-bit hashes: among 10**10 texts of 10,000 words, one
    mistaken window in thirty runs.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has_word = lambda line: line.rlike(_WORD)

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n"), F.length(F.array_join(words, "")).cast("long").alias("chars"), repeated_words(words).cast("long").alias("repeated"))

    def of_lines(lines: Column) -> Column:
        return N.bind(F.array_distinct(lines), lambda own: F.struct((F.size(lines) - F.size(own)).cast("long").alias("again"), F.array_join(F.filter(own, lambda x: ~line_fails(x)), "\n").alias("text")))

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned_text", "kept_words", "kept"]
    others = [c for c in docs.columns if c.lower() not in names]
    w, l = common.free_names(others + names, "_w", "_l")  # noqa: E741
    out = docs.select(*[F.col(common.quoted(c)) for c in others], N.bind(N.words(text), of_words).alias(w), N.bind(F.filter(F.split(text, "\n"), has_word), of_lines).alias(l), F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"))
    failed = (F.col(f"{w}.n") < MIN_WORDS) | (F.col(f"{w}.repeated") * 100 > F.col(f"{w}.n") * MAX_REPEAT_PERCENT)
    out = out.select("*", F.col(f"{w}.n").alias("n_words"), F.col(f"{w}.chars").alias("word_chars"), F.col(f"{l}.again").alias("n_dup_lines"), F.col(f"{w}.repeated").alias("n_repeat_words"), failed.alias("base_failed"), F.col(f"{l}.text").alias("cleaned_text"), F.regexp_count(F.col(f"{l}.text"), F.lit(f"{_WORD}+")).cast("long").alias("kept_words"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_words") * 100 >= F.col("n_words") * KEEP_PERCENT)).drop(w, l)
