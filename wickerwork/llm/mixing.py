"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a budget of words. Complete epochs come first: a source whose budget is twice its size is taken twice. What is
left is filled in the order of exponential keys, -ln(u) / w with u drawn from the hash of doc_id and w the quality of the text:
small keys first, so that good documents are likelier, until the running sum of sizes reaches the budget. The document on that
border gives only the words that are still missing.

Nulls and odd rows: a null text has no words and quality one; a null source is a source of its own, last in the order; a null
doc_id draws as an empty string would; rows that repeat are documents of their own, each taken by itself; documents without words
are returned with nothing taken. An empty table gives no rows. Extra columns are not read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerwork.operators.ranking import number_rows, running_sum
from wickerwork.session import cut_lineage

WEIGHTS = (1, 2, 3)
#: A source is taken so many times at most, and so is a document.
MOST_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
LETTERS = r"[A-Za-zÀ-ÿ]{3,}"


def text_quality(text: Column, size: Column) -> Column:
    """From 0.05 to 1: runs of three letters or more for each word."""
    runs = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(LETTERS))
    return F.when(size == 0, 1.0).otherwise(0.05 + 0.95 * F.least(F.lit(1.0), runs.cast("double") / size))


def draw(doc_id: Column) -> Column:
    """Uniform in (0, 1), from the first 48 bits of the md5 of the id."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the whole of all sizes shared by weight, the weights dealt in turn
    to the sources in code point order, null last. No target is over ``most`` times its source; the excess goes to the others by
    weight, round by round, until none is above. Only two sums of a round are read by the driver."""
    numbered = number_rows(sizes, [F.asc_nulls_last("source")], "_place")
    dealt = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    rows = cut_lineage(numbered.select("source", "source_size", dealt.alias("_w"), (most * F.col("source_size")).alias("_cap")), "mix-sources")
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped, known = F.lit(False), -1
    while True:
        found = rows.agg(F.count(F.when(capped, 1)).alias("n"), F.sum(F.when(capped, F.col("_cap")).otherwise(0)).alias("spent"),
                         F.sum(F.when(capped, 0).otherwise(F.col("_w"))).alias("weight")).first()
        if found.n == known or not found.weight:  # settled, or every source is at its cap
            break
        # shares only grow from round to round, so what is capped stays so
        known, share = found.n, (F.lit(total - found.spent).cast("double") * F.col("_w")) / float(found.weight)
        capped = share > F.col("_cap")
    target = F.col("_cap").cast("double") if not found.weight else F.when(capped, F.col("_cap").cast("double")).otherwise(share)
    return rows.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, quality, source_size, target, epochs (complete ones), taken.

    ``taken`` is the words of the mix that come from the document, repeats counted: epochs * size and, for those drawn before
    their source's budget ends, size or what was missing. Texts are read once; ranges of (source, key) are summed apart, so a
    source that holds most rows is spread over many tasks."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    read = docs.select("doc_id", "source", size.alias("size"), "text")
    rows = cut_lineage(read.select("doc_id", "source", "size", text_quality(F.col("text"), F.col("size")).alias("quality"),
                                   F.monotonically_increasing_id().alias("_row")), "mix-documents")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    keyed = rows.withColumn("_key", -F.log(draw(F.col("doc_id"))) / F.col("quality"))
    # rows alike in all that the order knows can change places without changing the result, so any number may part them
    order = [F.asc("_key"), F.asc_nulls_first("doc_id"), F.asc("size"), F.asc("_row")]
    placed = running_sum(keyed, order, "size", "_before", ["source"]).alias("d")
    joined = placed.join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    drawn = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_before")))
    return (joined.select("doc_id", "d.source", "size", "quality", "source_size", "target", "_before", epochs.alias("epochs"))
            .select("doc_id", "source", "size", "quality", "source_size", "target", "epochs",
                    (F.col("epochs") * F.col("size") + drawn).cast("long").alias("taken")))
