"""Boilerplate lines by how often they recur within one site. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerwork.llm.common import unused
from wickerwork.session import cut_lineage

#: A line on more than this share of a host's pages is boilerplate, where it is on MIN_PAGES pages or more.
RATIO = 0.1
MIN_PAGES = 5

#: White space of a line's edges; lines that differ in nothing else are the same.
_EDGES = " \t\x0b\x0c\r"


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(_EDGES))


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Host and 64-bit hash of every boilerplate line, with the pages that have it, the host's pages and their ratio.

    A line counts once a page. Lines without characters and null texts have no lines, but a page counts for its host's total in
    any case. A null host is a host of its own. Lines meet by hash, so that no text is shuffled, and map-side sums keep a hot
    line to one row a task; that another line of a host has a boilerplate line's hash happens once in about 10**15 lines."""
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("_text"))
    totals = pages.groupBy(F.col("host").alias("_ww_host")).agg(F.count(F.lit(1)).alias("host_pages"))
    keys = F.array_distinct(F.transform(F.split("_text", "\n"), _key))
    lines = pages.select("host", F.explode(keys).alias("line")).filter(F.col("line") != "")
    counted = (lines.groupBy("host", F.xxhash64("line").alias("line_hash")).agg(F.count(F.lit(1)).alias("pages"))
               .filter(F.col("pages") >= min_pages))
    joined = counted.join(totals, F.col("host").eqNullSafe(F.col("_ww_host"))).drop("_ww_host")
    return joined.withColumn("ratio", F.col("pages") / F.col("host_pages")).filter(F.col("ratio") > ratio)


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The documents without their hosts' boilerplate lines; other lines stay as they were, in order. A document of nothing else
    keeps its row, with an empty text; null texts stay null. Columns are those of ``docs``; n_chars, where there is one, is the
    new length of a text that changed.

    A host has at most its mean lines a page divided by ``ratio`` such lines, so they travel as one array a host. The arrays are
    staged: their size is known when the join is planned, and documents are shuffled only where it is too large to send."""
    names = docs.columns
    per_host = cut_lineage(boilerplate_lines(docs, host, text, ratio, min_pages).groupBy(F.col("host").alias("_ww_host"))
                           .agg(F.collect_set("line_hash").alias("_ww_drop")), "boilerplate")
    joined = docs.join(per_host, docs[host].eqNullSafe(per_host["_ww_host"]), "left")
    kept = F.filter(F.split(docs[text], "\n"), lambda line: ~F.array_contains(per_host["_ww_drop"], F.xxhash64(_key(line))))
    clean = unused("_ww_clean", names)
    out = joined.withColumn(clean, F.when(per_host["_ww_drop"].isNull(), docs[text]).otherwise(F.array_join(kept, "\n")))
    changed = {text: F.col(clean)}
    if "n_chars" in names and text != "n_chars":
        length = F.length(clean).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col(clean) != docs[text], length).otherwise(docs["n_chars"])
    return out.select(*[changed.get(c, docs[c]).alias(c) for c in names])
