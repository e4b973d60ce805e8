"""Baskets from the records of two sources, and from pasted list texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickerwork.functions.text import fold
from wickerwork.sources.records import parse_lines

# ---- fixed values: record shapes and list grammar --------------------------------------------------------------
LISTED = """id string, name string, updatedAt string, createdAt string, edhBracket int, viewCount int,
    categories array<struct<name:string,includedInDeck:boolean>>,
    cards array<struct<categories:array<string>,quantity:int,card:struct<oracleCard:struct<uid:string>>>>"""
BOARDED = """publicId string, name string, lastUpdatedAtUtc string, createdAtUtc string, bracket int, viewCount int,
    boards map<string,struct<cards:map<string,struct<quantity:int,card:struct<scryfall_id:string>>>>>"""
SECTION = r"(?i)^(?://\s*)?(commanders?|deck|main(?:board)?|sideboard|maybeboard|considering|companion|tokens?)\s*:?\s*(?:\(\d+\))?$"
LINE = (r"^(?:(\d+)\s*x?\s+)?(.+?)(?:\s+\(([A-Za-z0-9]{2,6})\)(?:\s+([^\s*\[^]\S*))?)?((?:\s+\*[A-Z]+\*)*)"
        r"(?:\s+\[([^\]]*)\])?(?:\s+\^[^^]*\^)?\s*$")
OUTSIDE = ["sideboard", "maybeboard", "considering", "token", "tokens"]
LEAST_COPIES, MOST_COPIES = 95, 105
PARTS = 64
# -----------------------------------------------------------------------------------------------------------------


def _usable(rows: DataFrame, least: int, most: int) -> DataFrame:
    """Rows (basket, item, copies, lead) of the baskets with one or two leaders and about a hundred copies."""
    sums = rows.groupBy("basket").agg(F.sum("copies").alias("n"), F.sum(F.col("lead").cast("int")).alias("leads"))
    kept = sums.filter(F.col("n").between(least, most) & F.col("leads").between(1, 2)).select("basket")
    return rows.join(kept, "basket", "left_semi")


def listed_baskets(lines: DataFrame, least: int = LEAST_COPIES, most: int = MOST_COPIES) -> tuple[DataFrame, DataFrame]:
    """Source one: baskets(basket, name, updated, created, bracket, views) and items(basket, item, copies, lead). An entry's
    first category says whether it is in the basket."""
    records = parse_lines(lines, LISTED)
    out = F.transform(F.filter(F.coalesce("categories", F.array().cast("array<struct<name:string,includedInDeck:boolean>>")),
                               lambda c: ~F.coalesce(c["includedInDeck"], F.lit(True))), lambda c: c["name"])
    entries = records.select(F.col("id").alias("basket"), out.alias("_out"), F.explode("cards").alias("_e"))
    first = F.try_element_at(F.col("_e.categories"), F.lit(1))
    copies = F.coalesce("_e.quantity", F.lit(1))
    item = F.col("_e.card.oracleCard.uid")
    inside = entries.filter((first.isNull() | ~F.array_contains("_out", first)) & (item != "") & (copies >= 1))
    lead = F.coalesce(F.array_contains("_e.categories", "Commander"), F.lit(False))
    rows = inside.select("basket", item.alias("item"), copies.alias("copies"), lead.alias("lead"))
    items = _usable(rows, least, most).groupBy("basket", "item").agg(F.sum("copies").alias("copies"), F.bool_or("lead").alias("lead"))
    day = lambda c: F.substring(c, 1, 10).try_cast("date")
    heads = records.select(F.col("id").alias("basket"), "name", day("updatedAt").alias("updated"), day("createdAt").alias("created"),
                           F.col("edhBracket").alias("bracket"), F.coalesce("viewCount", F.lit(0)).alias("views"))
    return heads.join(items.select("basket").distinct(), "basket", "left_semi"), items


def boarded_baskets(lines: DataFrame, variant_items: DataFrame, least: int = LEAST_COPIES, most: int = MOST_COPIES) -> tuple[DataFrame, DataFrame]:
    """Source two, whose boards hold variants: those that resolve to no item are dropped, and may drop the basket."""
    records = parse_lines(lines, BOARDED)
    boards = records.select(F.col("publicId").alias("basket"), F.explode("boards").alias("board", "_b")).filter(F.col("board").isin("commanders", "mainboard"))
    entries = boards.select("basket", "board", F.explode("_b.cards").alias("_k", "_e"))
    rows = entries.select("basket", "board", F.col("_e.card.scryfall_id").alias("variant"), F.coalesce("_e.quantity", F.lit(1)).alias("copies")).filter("copies >= 1")
    found = rows.join(variant_items, "variant").withColumn("lead", F.col("board") == "commanders")
    merged = found.groupBy("basket", "item").agg(F.sum("copies").alias("copies"), F.bool_or("lead").alias("lead"))
    items = _usable(merged, least, most)
    day = lambda c: F.substring(c, 1, 10).try_cast("date")
    heads = records.select(F.col("publicId").alias("basket"), "name", day("lastUpdatedAtUtc").alias("updated"), day("createdAtUtc").alias("created"),
                           "bracket", F.coalesce("viewCount", F.lit(0)).alias("views"))
    return heads.join(items.select("basket").distinct(), "basket", "left_semi"), items


def leader_names(items: DataFrame) -> DataFrame:
    """(basket, leaders): a basket's one or two leading items, sorted."""
    return items.filter("lead").groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("leaders"))


def partition_of(leaders: Column, parts: int = PARTS) -> Column:
    """The partition a leader's baskets are kept in."""
    return F.pmod(F.crc32(F.encode(F.array_join(leaders, " "), "utf-8")), F.lit(parts)).cast("int")


def parse_lists(lists: DataFrame, names: DataFrame) -> DataFrame:
    """Pasted lists, line by line: (list, pos, line, kind, number, copies, set, collector, finish, possible).

    lists(list, text), names(key, number) as ``name_lookup`` gives. kind is leader, item, outside or unknown. Where no line is
    marked as a leader, ``possible`` marks the one or two items of the sideboard, or else of the last block, that may be."""
    rows = lists.select("list", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    header = F.lower(F.regexp_extract("line", SECTION, 1))
    order = W.partitionBy("list").orderBy("pos")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_head", F.nullif(header, F.lit("")))
    rows = rows.withColumns({"section": F.coalesce(F.last("_head", ignorenulls=True).over(upto), F.lit("deck")),
                             "block": F.sum(((F.col("line") == "") | F.col("_head").isNotNull()).cast("int")).over(upto)})
    rows = rows.withColumn("_blocks", F.max("block").over(W.partitionBy("list")))
    body = rows.filter((F.col("line") != "") & F.col("_head").isNull() & ~F.col("line").startswith("#"))
    part = lambda g: F.regexp_extract("line", LINE, g)
    body = body.withColumns({"copies": F.coalesce(F.nullif(part(1), F.lit("")).try_cast("int"), F.lit(1)),
                             "key": fold(F.regexp_replace(part(2), r"(?i)\s+\*CMDR\*$", "")), "set": F.nullif(F.lower(part(3)), F.lit("")),
                             "collector": F.nullif(part(4), F.lit("")), "_marks": part(5), "_cat": F.lower(F.trim(F.regexp_extract(part(6), r"^([^,{]*)", 1)))})
    body = body.join(names, "key", "left")
    lead = F.col("section").startswith("commander") | F.col("line").rlike(r"(?i)\*cmdr\*") | (F.col("_cat") == "commander")
    out = F.col("section").isin(OUTSIDE) | F.col("_cat").isin("sideboard", "maybeboard", "considering")
    kind = F.when(F.col("number").isNull(), "unknown").when(lead, "leader").when(out, "outside").otherwise("item")
    finish = F.when(F.col("_marks").contains("*E*"), 2).when(F.col("_marks").contains("*F*"), 1).otherwise(0)
    named = F.col("set").isNotNull() & F.col("collector").isNotNull() & F.col("number").isNotNull()
    body = body.withColumns({"kind": kind, "finish": F.when(named, finish)})
    body = body.withColumn("_side", (F.col("kind") == "outside") & ((F.col("section") == "sideboard") | (F.col("_cat") == "sideboard")))
    whole = W.partitionBy("list")
    count = lambda c: F.sum(c.cast("int")).over(whole)
    last = (F.col("kind") == "item") & (F.col("block") == F.col("_blocks"))
    earlier = (F.col("kind") == "item") & (F.col("block") < F.col("_blocks"))
    leaders, side, end = count(F.col("kind") == "leader"), count(F.col("_side")), count(last)
    possible = (leaders == 0) & F.when(side.between(1, 2), F.col("_side")).otherwise((count(earlier) > 0) & end.between(1, 2) & last)
    return body.select("list", "pos", "line", "kind", "number", "copies", F.when(named, F.col("set")).alias("set"),
                       F.when(named, F.col("collector")).alias("collector"), "finish", possible.alias("possible"))
