"""Prices of other files: nested maps, CSV, Parquet, and the pages and scripts of a second guide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerwork.functions.numeric import half_even
from wickerwork.sources.records import parse_lines

# ---- fixed values: providers and finishes of the files, and our names for them ---------------------------------
GUIDES = [("tcgplayer", "normal", "usd"), ("tcgplayer", "foil", "usd_foil"), ("tcgplayer", "etched", "usd_etched"),
          ("cardmarket", "normal", "eur"), ("cardmarket", "foil", "eur_foil")]
ANCHOR = r'data-card-id="([^"]*)"[^>]*href="(/price/[^"#]*)"'
HREF = r"^/price/([^/]+)/(?:([^/]+)/)?[^/]+$"
POINT = r"(\d{4}-\d\d-\d\d), ([\d.]+)"
CSV = "cardFinish string, currency string, date string, gameAvailability string, price string, priceProvider string, providerListing string, uuid string"
# -----------------------------------------------------------------------------------------------------------------

NESTED = "uuid string, paper map<string,struct<retail:map<string,map<string,double>>>>"
OLD = "scryfallId string, prices struct<paper:map<string,double>,paperFoil:map<string,double>>"


def guides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GUIDES, "provider string, price_finish string, field string")


def _named(rows: DataFrame) -> DataFrame:
    """(variant, provider, price_finish, day, price) to (day, variant, field, cents), by the guide table."""
    return (rows.join(F.broadcast(guides(rows.sparkSession)), ["provider", "price_finish"])  # five fixed rows
            .select(F.substring(F.col("day").cast("string"), 1, 10).try_cast("date").alias("day"), "variant", "field", half_even(F.col("price") * 100).cast("long").alias("cents")))


def nested_prices(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """One record per id, provider and finish maps inside. ids(uuid, variant)."""
    rows = parse_lines(lines, NESTED).select("uuid", F.explode("paper").alias("provider", "_p"))
    rows = rows.select("uuid", "provider", F.explode("_p.retail").alias("price_finish", "_d")).select("uuid", "provider", "price_finish", F.explode("_d").alias("day", "price"))
    return _named(rows.join(ids, "uuid"))


def csv_prices(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Paper retail rows of the CSV form, given as lines."""
    rows = lines.select(F.from_csv("value", CSV).alias("_r")).select("_r.*")
    kept = rows.filter("gameAvailability = 'paper' and providerListing = 'retail'").join(ids, "uuid")
    return _named(kept.select("variant", F.col("priceProvider").alias("provider"), F.col("cardFinish").alias("price_finish"), F.col("date").alias("day"), F.col("price").try_cast("double").alias("price")))


def table_prices(table: DataFrame) -> DataFrame:
    """The Parquet form: (variant, medium, provider, list_type, finish, date, price)."""
    kept = table.filter((F.col("medium") == "paper") & (F.col("list_type") == "retail") & F.col("variant").isNotNull() & (F.col("price") != 0))
    return _named(kept.select("variant", "provider", F.col("finish").alias("price_finish"), F.col("date").alias("day"), "price"))


def old_prices(lines: DataFrame) -> DataFrame:
    """The old nested form: some variants kept a price from weeks before, so only the day most variants have counts (the
    earliest of several)."""
    rows = parse_lines(lines, OLD).filter("scryfallId <> ''")
    each = [rows.select(F.col("scryfallId").alias("variant"), F.lit(f).alias("field"), F.explode(f"prices.{c}").alias("day", "price")) for c, f in (("paper", "usd"), ("paperFoil", "usd_foil"))]
    long = each[0].unionByName(each[1]).filter("price <> 0")
    counts = long.select("day", "variant").distinct().groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max(F.struct("n", (-F.unix_date(F.col("day").try_cast("date"))).alias("_m"), "day")).alias("_b")).select(F.col("_b.day").alias("day"))
    return long.join(best, "day", "left_semi").select(F.col("day").try_cast("date").alias("day"), "variant", "field", half_even(F.col("price") * 100).cast("long").alias("cents"))


def anchors(pages: DataFrame, pattern: str, first: str, second: str) -> DataFrame:
    """(page_id, pos, first, second): two groups of each match in a page, repeats dropped, in order of the first."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("b"))
    rows = pages.select("page_id", F.posexplode(both).alias("pos", "_z"))
    return rows.groupBy("page_id", F.col("_z.a").alias(first), F.col("_z.b").alias(second)).agg(F.min("pos").alias("pos"))


def listed_variants(pages: DataFrame) -> DataFrame:
    """(page_id, pos, slug, number, foil, code, tag, guide_id): the variants a guide's page links to."""
    def unescape(c):
        for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&#x27;", "'"), ("&quot;", '"'), ("&amp;", "&")):
            c = F.replace(c, F.lit(code), F.lit(sign))
        return c

    rows = anchors(pages, ANCHOR, "_id", "_href").withColumns({"guide_id": unescape(F.col("_id")), "href": unescape(F.col("_href"))})
    return rows.filter(F.col("href").rlike(HREF) & F.col("guide_id").rlike(r"\[[^\]]+\]")).select(
        "page_id", "pos", F.regexp_extract("href", HREF, 1).alias("slug"), F.nullif(F.regexp_extract("href", HREF, 2), F.lit("")).alias("number"),
        F.col("guide_id").endswith("(F)").alias("foil"), F.regexp_extract("guide_id", r"\[([^\]]+)\]", 1).alias("code"), F.regexp_extract("guide_id", "<([^>]*)>", 1).alias("tag"), "guide_id")


def script_history(scripts: DataFrame) -> DataFrame:
    """(guide_id, day, cents): the dated prices in script texts. scripts(guide_id, text)."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(POINT), F.lit(1)).alias("d"), F.regexp_extract_all("text", F.lit(POINT), F.lit(2)).alias("p"))
    return scripts.select("guide_id", F.explode(both).alias("_z")).select("guide_id", F.col("_z.d").try_cast("date").alias("day"), half_even(F.col("_z.p").try_cast("double") * 100).cast("long").alias("cents"))
