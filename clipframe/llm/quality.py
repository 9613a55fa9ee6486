"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition under which a document goes.  Costs and rejection shares are estimated on a sample that is
spread over the table; the rules then stand in one CASE expression by rejection per cost, so that a document pays only
for the rules up to the first that rejects it.  The cost of a rule on a text is a count of steps, not a time, so that
reruns agree.  The order never changes the verdict.  Null and empty texts have no words; texts may be of any length.
Rows are judged one by one, so repeated rows have equal results, and empty tables give empty tables.  Columns of the
table with the name of a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows, on average, on which costs and rejection shares are estimated.
SAMPLE_ROWS = 1000
SAMPLE_SEED = 11
SYMBOLS = "#*$%&|<>"
#: Steps that a word or line takes when it is made an element of an array.
WORD_STEPS = 10


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes, from the text column, the condition under which a document goes.

    ``steps`` makes the work that this takes: visits of a character, of which a word or line that is made or hashed
    counts as several.
    """

    name: str
    rejects: object
    steps: object = lambda t: F.char_length(t)


def word_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE_RUN, "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    full = F.filter(common.lines(text), lambda x: x.rlike(common.WORD))
    return common.let(full, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint")


def n_repeat_words(text: Column) -> Column:
    """Words in 3-word windows that are in the text twice or more.

    Windows are compared by a 64-bit hash.  Only texts in which a hash repeats are sorted.
    """

    def windows(ws):
        return F.zip_with(F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)), F.slice(ws, 3, F.greatest(F.size(ws) - 2, F.lit(0))), lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab, c)))

    def repeated(hs):
        """Sorted by hash, a window is repeated if a neighbour is equal."""
        n = F.size(hs)
        pairs = F.array_sort(F.zip_with(hs, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s):
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return common.let(pairs, covered)

    def count(hs):
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(repeated(hs))

    def of(ws):
        return F.when(F.size(ws) < 3, F.lit(0)).otherwise(common.let(F.filter(windows(ws), lambda h: h.isNotNull()), count))

    return common.let(common.words(text), of).cast("bigint")


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda t: common.n_words(t) < 50, lambda t: F.char_length(t) + WORD_STEPS * common.n_words(t)),
        Rule("repeats", lambda t: 100 * n_repeat_words(t) > 50 * common.n_words(t), lambda t: 2 * F.char_length(t) + 8 * WORD_STEPS * common.n_words(t)),
    ]


def further_rules() -> list[Rule]:
    """Rules for junk; the bounds are far from those of plain prose."""
    return [
        Rule("symbols", lambda t: 10 * n_symbols(t) > 3 * common.n_words(t), lambda t: 2 * F.char_length(t) + WORD_STEPS * common.n_words(t)),
        Rule("dup_lines", lambda t: 2 * n_dup_lines(t) > F.size(common.lines(t)), lambda t: 2 * F.char_length(t) + 2 * WORD_STEPS * F.size(common.lines(t))),
        Rule("word_length", lambda t: (word_chars(t) < 2 * common.n_words(t)) | (word_chars(t) > 20 * common.n_words(t)), lambda t: 3 * F.char_length(t) + 2 * WORD_STEPS * common.n_words(t)),
    ]


def ordered(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejected share of the sample per step that the rule takes on it, best first; ties by name."""
    n = docs.count()
    sample = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = sample.sample(min(1.0, sample_rows / n), SAMPLE_SEED) if n else sample
    text = F.col("text")
    found = sample.select(*[F.avg(F.coalesce(r.rejects(text), F.lit(False)).cast("int")).alias(f"share{i}") for i, r in enumerate(rules)], *[F.avg(r.steps(text)).alias(f"steps{i}") for i, r in enumerate(rules)]).first()
    worth = [(-(found[f"share{i}"] or 0.0) / max(found[f"steps{i}"] or 0.0, 1.0), rule.name, rule) for i, rule in enumerate(rules)]
    return [rule for _, _, rule in sorted(worth, key=lambda x: x[:2])]


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``failed_rule``: the name of the first rule that rejects the document, null if it stays."""
    failed = F.lit(None).cast("string")
    for rule in reversed(ordered(docs, rules or base_rules() + further_rules(), text_col, sample_rows)):
        failed = F.when(rule.rejects(F.col(text_col)), F.lit(rule.name)).otherwise(failed)
    return docs.withColumn("failed_rule", failed)


def measured(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with n_words, the four base counts (long), base_failed, failed_rule of the cascade, and kept.

    Here the counts are wanted for every document, so the cascade's rules use them; it short-circuits what
    stands behind them.
    """
    text = F.col(text_col)
    counts = {"n_words": common.n_words(text), "word_chars": word_chars(text), "n_symbols": n_symbols(text), "n_dup_lines": n_dup_lines(text), "n_repeat_words": n_repeat_words(text)}
    known = {
        "few_words": F.col("n_words") < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > 3 * F.col("n_words"),
        "dup_lines": 2 * F.col("n_dup_lines") > F.size(common.lines(text)),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
    }
    failed = F.lit(None).cast("string")
    for rule in reversed(ordered(docs, further_rules(), text_col, sample_rows)):
        failed = F.when(known[rule.name], F.lit(rule.name)).otherwise(failed)
    return docs.withColumns(counts).withColumn("base_failed", known["few_words"] | known["repeats"]).withColumn("failed_rule", failed).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
