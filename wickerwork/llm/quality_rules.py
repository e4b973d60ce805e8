"""Quality rules as a short-circuit cascade. DataFrame functions only.

Every rule is a condition that rejects a document. What a rule costs and how much it rejects is measured on a bounded sample;
the rules are then tried in the order of rejection per cost, and a document that one rejects is not shown to the next. The
order changes the time, never the verdict."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerwork.session import cut_lineage

#: Documents of the sample that costs and rejections are measured on, and how often a job judges each; rules of less than the
#: least cost, in seconds for the whole sample, cannot be told apart and go by what they reject.
SAMPLE, REPEATS, LEAST_COST = 1000, 32, 1e-4

# White space between words, and symbols.
WHITE = " \t\n\x0b\x0c\r"
BETWEEN_WORDS = "[ \t\n\x0b\f\r]+"
SYMBOLS = "[#*$%&|<>]+"
NO_LETTERS = "[\x00-@\\[-`{-\x7f]+"

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50  # percent of words


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often lambdas inside read it."""
    return F.transform(F.array(value), use)[0]


def count_of(text: Column, characters: str) -> Column:
    """How many of the text's characters the pattern's matches hold."""
    return (F.length(text) - F.length(F.regexp_replace(text, characters, ""))).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN_WORDS), "")


#: Up to so many different repeated windows, a text's windows are looked up among them one by one; beyond, they are sorted with
#: their places. Both give the same.
FEW_REPEATS = 64


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with ``_words``: words in a three-word window found twice or more, the first time included.

    Windows are hashed; after sorting, equal ones are neighbours, and the gaps between the places of the repeated ones tell how
    many words they cover. n log n in the words of a text."""
    no_longs = F.array().cast("array<bigint>")
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    hashed = F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window)).otherwise(no_longs)
    df = df.withColumn("_hashes", hashed).withColumn("_sorted", F.sort_array("_hashes"))
    df = df.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda h, j: h == F.get("_sorted", j + 1))))
    looked_up = F.filter(F.sequence(F.lit(0), F.size("_hashes") - 1), lambda i: F.array_contains("_twice", F.get("_hashes", i)))

    def neighbours(s: Column) -> Column:
        found = F.filter(s, lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    placed = let(F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))), neighbours)
    df = df.withColumn("_places", F.when(F.size("_twice") == 0, F.array().cast("array<int>"))
                       .when(F.size("_twice") <= FEW_REPEATS, looked_up).otherwise(placed))
    gaps = F.transform("_places", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("_places", j + 1) - x, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0), lambda a, b: a + b).cast("long")
    return df.withColumn("n_repeat_words", covered).drop("_hashes", "_sorted", "_twice", "_places")


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, replacing columns of these names.

    Null is a text without words. Characters are code points."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    duplicates = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = docs.withColumn("_words", words_of(t)).withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": count_of(t, SYMBOLS), "n_dup_lines": duplicates.cast("long")})
    out = _with_repeats(out)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words")


@dataclass(frozen=True)
class Rule:
    """A condition over a text (null read as empty) and the base columns that rejects a document."""

    name: str
    rejects: Callable[[Column], Column]


def _share(part: Column, whole: Column, most: float) -> Column:
    return part > most * whole


#: Bounds far from ordinary prose of any language.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda t: _share(F.col("n_symbols"), F.col("n_words"), 0.1)),
    Rule("short_words", lambda t: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", lambda t: F.col("word_chars") > 18 * F.col("n_words")),
    Rule("repeated_lines", lambda t: _share(F.col("n_dup_lines"), F.size(F.split(t, "\n")), 0.5)),
    Rule("capitals", lambda t: _share(count_of(t, "[A-Z]+"), F.col("word_chars"), 0.5)),
    Rule("exclamations", lambda t: _share(count_of(t, "!+"), F.col("n_words"), 0.3)),
    Rule("digits", lambda t: _share(count_of(t, "[0-9]+"), F.col("word_chars"), 0.3)),
    Rule("letters", lambda t: F.length(F.regexp_replace(t, NO_LETTERS, "")) < 0.5 * F.col("word_chars")),
    Rule("bullets", lambda t: let(F.split(t, "\n"), lambda lines: _share(
        F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]"))), F.size(lines), 0.9))),
    Rule("ellipses", lambda t: let(F.split(t, "\n"), lambda lines: _share(
        F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))), F.size(lines), 0.3))),
)


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """Each rule with the share of the sample that it rejects and the seconds it takes there.

    A job judges every document of the sample REPEATS times, so that it is the rule that is timed; what the same job takes
    without a rule is taken off. The sample is the documents of the ``sample`` smallest hashes of doc_id; with repeated ids it may hold some more. The base
    columns are made for it alone."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    picked = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")  # as many ids as the sample has
    staged = cut_lineage(base_columns(cut_lineage(picked, "rule-documents")).withColumn("_t", F.coalesce(F.col("text"), F.lit(""))), "rule-sample")
    rejected = staged.agg(F.count(F.lit(1)).alias("n"), *[F.sum(r.rejects(F.col("_t")).cast("int")).alias(r.name) for r in rules]).first()
    again = staged.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(judged: Column) -> float:
        took = []
        for _ in range(3):
            start = time.perf_counter()
            again.agg(F.sum(judged.cast("int"))).collect()
            took.append(time.perf_counter() - start)
        return min(took)

    none = seconds((F.col("_again") > F.col("n_words")) & F.col("_t").isNotNull())
    return [(rule, (rejected[rule.name] or 0) / max(rejected.n, 1), max(seconds(rule.rejects(F.col("_t"))) - none, 0.0) / REPEATS) for rule in rules]


def cascade(measured: Sequence[tuple[Rule, float, float]], text: str = "text") -> Column:
    """The name of the first rule that rejects, in the order of rejection per cost, null where none does."""
    t = F.coalesce(F.col(text), F.lit(""))
    order = sorted(measured, key=lambda x: (-x[1] / max(x[2], LEAST_COST), x[2], x[0].name))
    chain = F.when(order[0][0].rejects(t), F.lit(order[0][0].name))
    for rule, _, _ in order[1:]:
        chain = chain.when(rule.rejects(t), F.lit(rule.name))
    return chain


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, the base columns, base_failed and kept: neither the base nor a rule rejects it.

    Null and empty texts fail the base (no words). Repeated rows are judged one by one; other columns stay behind."""
    based = base_columns(docs.select("doc_id", F.col(text).alias("text")))
    first = cascade(measure(docs, rules, text, sample))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(first.isNull())
    return based.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
