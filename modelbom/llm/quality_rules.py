"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelbom.llm.common import SPACE, settled, words

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
MARKS = "[!?]"

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "a and are as at be by for from have in is it of on or that the this to was were with "
    "das dem den der des die ein eine für ist mit nicht sich sie und von zu "
    "au aux avec dans de des du elle en est et la le les ne pas pour que qui un une "
    "al con del el ella es las los no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails when ``count``, or its ratio to ``per``, leaves [least, most]; x / 0 passes."""

    name: str
    count: str
    per: str | None = None
    least: float | None = None
    most: float | None = None


#: The threshold table over the measured columns.
RULES = (
    Rule("word_count", "n_words", None, 10, None),
    Rule("mean_word_length", "word_chars", "n_words", 2, 12),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("marks_per_word", "n_marks", "n_words", None, 0.5),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeated_word_share", "n_repeat_words", "n_words", None, 0.2),
)


def measure(docs: DataFrame, text: str = "text", window: int = 5, more: dict | None = None) -> DataFrame:
    """Add the measured columns to ``docs``; all are longs and 0 for a null or empty text.

    ``more`` has further columns: names and functions of the array of words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, SPACE, " " * len(SPACE))) != "")
    a = docs.withColumns({"_words": words(t), "_lines": lines})
    a = a.withColumn("_grams", F.when(F.size("_words") >= window, F.transform(
        F.sequence(F.lit(0), F.size("_words") - window),
        lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(window)]),
    )).otherwise(F.array().cast("array<bigint>")))
    # Only texts with some window twice pay for the sort that finds the covered words.
    twice = F.size(F.array_distinct("_grams")) < F.size("_grams")
    at = F.transform(F.col("_grams"), lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    a = a.withColumn("_sorted", F.when(twice, F.sort_array(at)))
    near = F.filter(
        F.col("_sorted"),
        lambda x, j: F.coalesce(F.get(F.col("_sorted"), j - 1)["g"] == x["g"], F.lit(False))
        | F.coalesce(F.get(F.col("_sorted"), j + 1)["g"] == x["g"], F.lit(False)),
    )
    a = a.withColumn("_at", F.sort_array(F.transform(near, lambda x: x["i"])))
    gaps = F.transform(F.col("_at"), lambda x, j: F.least(F.lit(window), F.coalesce(F.get(F.col("_at"), j + 1) - x, F.lit(window))))
    covered = F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def count(marks: str) -> Column:  # most texts have none
        return F.when(F.rlike(t, F.lit(marks)), F.length(t) - F.length(F.regexp_replace(t, marks + "+", ""))).otherwise(0)

    return settled(a.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        count(MARKS).cast("long").alias("n_marks"),
        *[f(F.col("_words")).cast("long").alias(c) for c, f in (more or {}).items()],
    ))


def verdict(rules=RULES) -> tuple[Column, Column]:
    """(kept, names of the rules that fail) as expressions over the measured columns."""
    fails = []
    for r in rules:
        m = F.col(r.count) if r.per is None else F.col(r.count) / F.nullif(F.col(r.per), F.lit(0))
        out = F.lit(False)
        if r.least is not None:
            out = out | (m < F.lit(r.least))
        if r.most is not None:
            out = out | (m > F.lit(r.most))
        fails.append((r.name, F.coalesce(out, F.lit(False))))
    bad = F.lit(False)
    for _, f in fails:
        bad = bad | f
    names = F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in fails]))
    return ~bad, names


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, ...) with its measures and the verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    failed_rules and the other measures. One narrow projection: no shuffle, no user function. A null
    text counts as empty and fails; a null doc_id, repeated rows and further columns of any name
    change nothing; an empty table gives an empty result. Windows of a text are compared by their
    64-bit hash within that text.
    """
    m = measure(docs.select("doc_id", F.col(f"`{text}`").alias("_text")), "_text")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept, failed = verdict(rules)
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & kept).alias("kept"), failed.alias("failed_rules"),
        "n_lines", "n_stop_words", "n_marks",
    )


def passing(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass all rules, with all their columns as they came."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    m = measure(docs.select(row.alias("_row"), F.col(f"`{text}`").alias("_text")), "_text")
    return m.where(verdict(rules)[0]).select("_row.*")
