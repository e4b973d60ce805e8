"""Items, their variants, and tags, from JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerwork.functions.numeric import cents
from wickerwork.sources.records import parse_lines

# ---- fixed values ---------------------------------------------------------------------------------------------
SKIP_LAYOUTS = ["token", "double_faced_token", "emblem", "art_series", "augment", "host", "planar", "scheme", "vanguard"]
UNLISTED_SETS = ["token", "memorabilia", "minigame", "promo"]
PRICE_FIELDS = ["usd", "usd_foil", "usd_etched", "eur", "eur_foil"]
# ---------------------------------------------------------------------------------------------------------------

ITEM = """oracle_id string, name string, type_line string, oracle_text string, colors array<string>, color_identity array<string>,
    keywords array<string>, cmc double, legalities map<string,string>, edhrec_rank int, layout string, digital boolean, game_changer boolean,
    card_faces array<struct<oracle_text:string,colors:array<string>>>"""
VARIANT = """id string, oracle_id string, name string, set string, set_name string, set_type string, collector_number string, digital boolean,
    released_at string, lang string, flavor_name string, printed_name string, prices map<string,string>,
    card_faces array<struct<oracle_id:string,flavor_name:string,printed_name:string>>"""
TAG = "id string, slug string, label string, aliases array<string>, parent_ids array<string>, taggings array<struct<oracle_id:string>>"


def load_items(lines: DataFrame) -> DataFrame:
    """Item records: digital-only ones and odd layouts left out, text and colours taken from the faces where there are none."""
    rows = parse_lines(lines, ITEM)
    only_digital = F.coalesce("digital", F.lit(False)) & F.coalesce(F.col("legalities")["vintage"] == "not_legal", F.lit(False))
    rows = rows.filter(~only_digital & (F.col("layout").isNull() | ~F.col("layout").isin(SKIP_LAYOUTS)))
    faces = F.coalesce("card_faces", F.array().cast("array<struct<oracle_text:string,colors:array<string>>>"))
    empty = F.array().cast("array<string>")
    text = F.array_join(F.transform(faces, lambda f: F.coalesce(f["oracle_text"], F.lit(""))), "\n")
    shades = F.array_sort(F.array_distinct(F.flatten(F.transform(faces, lambda f: F.coalesce(f["colors"], empty)))))
    return rows.select(
        F.col("oracle_id").alias("item"), "name", F.coalesce("type_line", F.lit("")).alias("type_line"),
        F.coalesce(F.nullif("oracle_text", F.lit("")), text).alias("text"),
        F.when(F.size("colors") > 0, F.col("colors")).otherwise(shades).alias("colors"), F.coalesce("color_identity", empty).alias("color_identity"),
        F.coalesce("keywords", empty).alias("keywords"), F.coalesce("cmc", F.lit(0.0)).alias("value"), "legalities",
        F.col("edhrec_rank").alias("rank"), F.coalesce("game_changer", F.lit(False)).alias("limited"))


def load_variants(lines: DataFrame) -> DataFrame:
    """Paper variants with their item (the first face's where the record has none) and release date."""
    rows = parse_lines(lines, VARIANT)
    item = F.coalesce("oracle_id", F.try_element_at("card_faces", F.lit(1))["oracle_id"])
    return rows.withColumn("item", item).filter(F.col("item").isNotNull() & ~F.coalesce("digital", F.lit(False))).withColumn("released", F.col("released_at").try_cast("date"))


def item_summary(variants: DataFrame) -> DataFrame:
    """(item, price, released): cheapest dollar price over finishes and first release."""
    usd = F.least(*[F.nullif(F.col("prices")[f], F.lit("")).try_cast("double") for f in PRICE_FIELDS[:3]])
    return variants.groupBy("item").agg(F.min(usd).alias("price"), F.min("released").alias("released"))


def item_sets(variants: DataFrame) -> DataFrame:
    """(item, set) for the sets worth listing."""
    return variants.filter(F.col("set_type").isNull() | ~F.col("set_type").isin(UNLISTED_SETS)).select("item", "set").distinct()


def set_registry(variants: DataFrame) -> DataFrame:
    """(set, set_name, released, set_type), with the first release."""
    listed = variants.filter(F.col("set_type").isNull() | ~F.col("set_type").isin(UNLISTED_SETS))
    return listed.groupBy("set").agg(F.min("set_name").alias("set_name"), F.min("released").alias("released"), F.min("set_type").alias("set_type"))


def other_names(variants: DataFrame) -> DataFrame:
    """(item, name): the other names an item is printed under, less its own and its faces'."""
    english = lambda n: F.when(F.col("lang") == "en", n)
    faces = F.coalesce(F.transform("card_faces", lambda f: F.array(f["flavor_name"], english(f["printed_name"]))), F.array().cast("array<array<string>>"))
    told = F.concat(F.array(F.col("flavor_name"), english(F.col("printed_name"))), F.flatten(faces))
    own = F.transform(F.concat(F.array("name"), F.split("name", " // ")), F.lower)
    rows = variants.select("item", own.alias("_own"), F.explode(told).alias("other")).filter("other <> ''")
    return rows.filter(~F.array_contains("_own", F.lower("other"))).select("item", F.col("other").alias("name")).distinct()


def variant_items(lines: DataFrame) -> DataFrame:
    """(variant, item) for every variant, digital ones too."""
    rows = parse_lines(lines, VARIANT)
    item = F.coalesce("oracle_id", F.try_element_at("card_faces", F.lit(1))["oracle_id"])
    return rows.select(F.col("id").alias("variant"), item.alias("item")).filter("item is not null")


def load_tags(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """tags(tag, slug), edges(child, parent), item_tags(item, tag), names(tag, name)."""
    rows = parse_lines(lines, TAG)
    tags = rows.select(F.col("id").alias("tag"), "slug")
    edges = rows.select(F.col("id").alias("child"), F.explode("parent_ids").alias("parent"))
    item_tags = rows.select(F.col("id").alias("tag"), F.explode("taggings").alias("_t")).select(F.col("_t.oracle_id").alias("item"), "tag").filter("item is not null").distinct()
    names = F.array_distinct(F.concat(F.array("slug", "label"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return tags, edges, item_tags, rows.select(F.col("id").alias("tag"), F.explode(names).alias("name"))


def price_snapshot(lines: DataFrame) -> DataFrame:
    """(variant, field, cents): prices of item records, digital ones and missing prices left out."""
    rows = parse_lines(lines, "id string, digital boolean, prices map<string,string>").filter(~F.coalesce("digital", F.lit(False)))
    told = rows.select(F.col("id").alias("variant"), F.explode("prices").alias("field", "price"))
    return told.filter(F.col("field").isin(PRICE_FIELDS) & (F.col("price") != "")).select("variant", "field", cents(F.col("price")).alias("cents"))
