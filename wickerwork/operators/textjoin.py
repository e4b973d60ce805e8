"""Substring search of many queries in many texts without comparing every query with every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerwork.session import cut_lineage

#: Letter groups are as long as the largest of these that a query has room for, so that two or a few cover it.
LENGTHS = (1, 2, 4, 8, 16)


def _placed_grams(text: Column, k: int) -> Column:
    """The letter groups of ``k`` of a text with the places they start at, from 1."""
    starts = F.when(F.length(text) >= k, F.sequence(F.lit(1), F.length(text) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.substr(text, i, F.lit(k)).alias("gram"), i.alias("place")))


def _covering(q: Column) -> Column:
    """Letter groups that cover a query from end to end, and how far into it each starts."""
    k = F.greatest(*[F.when(F.length(q) >= n, n) for n in LENGTHS])
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), F.length(q) - k, F.greatest(k, F.lit(1))), F.array(F.length(q) - k)))
    return F.transform(starts, lambda i: F.struct(F.substr(q, i + 1, k).alias("gram"), i.alias("offset")))


def contains_join(texts: DataFrame, queries: DataFrame, text: str, q: str = "q") -> DataFrame:
    """Rows of ``texts`` joined to the ``queries`` (keyed by ``query``) whose ``q`` their text contains.

    Texts are listed under the letter groups that queries ask for, with the places they have them at. Each query is looked up by its
    rarest group; a hit is verified by its other groups, which must lie where the query has them. Lists hold numbers only: texts
    are read a second time for the rows that were hit, and an empty query hits none."""
    wanted = queries.filter(F.length(q) >= 1)
    asked = cut_lineage(wanted.select("query", F.explode(_covering(F.col(q))).alias("g")).select("query", "g.gram", "g.offset").distinct(), "asked-grams")
    sizes = [r["k"] for r in asked.select(F.length("gram").alias("k")).distinct().collect()]  # as many as LENGTHS at most
    rows = cut_lineage(texts.withColumn("_row", F.monotonically_increasing_id()), "searched")
    grams = F.concat(*[_placed_grams(F.col(text), k) for k in sizes]) if sizes else F.array().cast("array<struct<gram:string,place:int>>")
    listed = rows.select("_row", F.explode(grams).alias("g")).select("_row", "g.gram", "g.place")
    listed = cut_lineage(listed.join(asked.select("gram").distinct(), "gram", "left_semi"), "listed-grams")
    held = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    counted = asked.join(held, "gram", "left").fillna(0, ["_n"])
    rarest = counted.groupBy("query").agg(F.min_by(F.struct("gram", "offset"), F.struct("_n", "gram", "offset")).alias("g"), F.count(F.lit(1)).alias("pieces"))
    first = listed.join(rarest.select("query", "g.gram", "g.offset", "pieces"), "gram")
    met = first.select("query", "_row", (F.col("place") - F.col("offset")).alias("start"), "offset", "pieces").filter("start > 0")
    whole = met.filter("pieces = 1").select("query", "_row")
    others = asked.select("query", "gram", F.col("offset").alias("other"))
    due = met.filter("pieces > 1").join(others, "query").filter("other <> offset")
    seen = due.withColumn("place", F.col("start") + F.col("other")).join(listed, ["_row", "gram", "place"])
    verified = (seen.groupBy("query", "_row", "start", "pieces").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == F.col("pieces") - 1).select("query", "_row"))
    hits = whole.unionByName(verified).distinct()
    return rows.join(hits, "_row").drop("_row").join(queries, "query")
