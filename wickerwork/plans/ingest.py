"""Registered ingest queries. The records they parse are first told from the given tables as the text a source would send."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerwork.operators import linkage
from wickerwork.plans.registry import query
from wickerwork.plans.tables import CTES, TODAY
from wickerwork.session import cut_lineage, scratch_path
from wickerwork.sources import baskets as SB
from wickerwork.sources import events as SE
from wickerwork.sources import items as SI
from wickerwork.sources import prices as SP
from wickerwork.sources import records as R
from wickerwork.sources import sinks


def told(df, **fields):
    """Rows as JSON lines."""
    return df.select(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("value"))


def item_lines(t):
    size = F.col("p_size")
    face = lambda i, s: F.struct(F.concat(F.lit(f"Face {i} of "), "p_name").alias("oracle_text"), F.array(F.lit(s)).alias("colors"))
    text = F.when(size > 10, F.concat(F.lit("Text of "), "p_name"))
    return told(t.read("part"), oracle_id=F.col("p_partkey").cast("string"), name=F.col("p_name"), type_line=F.lower("p_type"), oracle_text=text,
                colors=F.when(size > 10, F.array(F.lit("G"))), cmc=size.cast("double"), digital=size > 40,
                legalities=F.create_map(F.lit("vintage"), F.when(size > 45, "not_legal").otherwise("legal")),
                layout=F.when(F.col("p_type") == "PROMO", "emblem").otherwise("normal"), edhrec_rank=F.col("p_partkey"),
                card_faces=F.when(size <= 10, F.array(face(1, "W"), face(2, "B"))))


@query("s1_items", """SELECT CAST(p_partkey AS VARCHAR) AS item, p_name AS name, CASE WHEN p_size > 10 THEN 'Text of ' || p_name ELSE 'Face 1 of ' || p_name || chr(10) || 'Face 2 of ' || p_name END AS text,
    CASE WHEN p_size > 10 THEN 'G' ELSE 'B,W' END AS colors FROM part WHERE p_size <= 45 AND p_type <> 'PROMO'""")
def _(t):
    return SI.load_items(item_lines(t)).select("item", "name", "text", F.array_join("colors", ",").alias("colors"))


def variant_lines(t):
    size = F.col("p_size")
    price = lambda c, k: F.when(c, F.format_string("%.2f", F.col("p_retailprice") * k))
    return told(t.read("part"), id=F.concat(F.lit("v"), F.col("p_partkey").cast("string")), oracle_id=F.when(size > 10, F.col("p_name")), name=F.col("p_name"),
                set=F.lower("p_brand"), set_name=F.col("p_brand"), set_type=F.when(F.col("p_type") == "PROMO", "promo").otherwise("core"), collector_number=F.col("p_partkey").cast("string"),
                digital=size > 45, released_at=F.date_format(F.expr("date_add(date'1995-01-01', p_size * 30)"), "yyyy-MM-dd"), lang=F.lit("en"),
                flavor_name=F.when(size > 30, F.concat(F.lit("Other "), "p_type")), printed_name=F.upper("p_name"),
                prices=F.create_map(F.lit("usd"), price(size > 5, 1.0), F.lit("usd_foil"), price(size > 20, 0.5)),
                card_faces=F.when(size <= 10, F.array(F.struct(F.col("p_name").alias("oracle_id")))))


@query("s2_item_summary", """SELECT p_name AS item, min(CAST(printf('%.2f', p_retailprice * CASE WHEN p_size > 20 THEN 0.5 ELSE 1.0 END) AS DOUBLE)) FILTER (p_size > 5) AS price, DATE '1995-01-01' + CAST(min(p_size) * 30 AS INT) AS released
    FROM part WHERE p_size <= 45 GROUP BY 1""")
def _(t):
    return SI.item_summary(SI.load_variants(variant_lines(t)))


@query("s2_set_registry", "SELECT lower(p_brand) AS set, p_brand AS set_name, DATE '1995-01-01' + CAST(min(p_size) * 30 AS INT) AS released, 'core' AS set_type FROM part WHERE p_size <= 45 AND p_type <> 'PROMO' GROUP BY p_brand")
def _(t):
    return SI.set_registry(SI.load_variants(variant_lines(t)))


@query("s2_item_sets", "SELECT DISTINCT p_name AS item, lower(p_brand) AS set FROM part WHERE p_size <= 45 AND p_type <> 'PROMO'")
def _(t):
    return SI.item_sets(SI.load_variants(variant_lines(t)))


@query("s2_other_names", "SELECT DISTINCT p_name AS item, 'Other ' || p_type AS name FROM part WHERE p_size BETWEEN 31 AND 45")
def _(t):
    return SI.other_names(SI.load_variants(variant_lines(t)))


def tag_lines(t):
    rows = t.read("part").groupBy("p_brand").agg(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("oracle_id"))).alias("taggings"))
    return told(rows, id=F.col("p_brand"), slug=F.lower("p_brand"), label=F.upper("p_brand"), aliases=F.array(F.concat(F.lit("alias "), "p_brand")), parent_ids=F.array(F.lit("Brand#1")), taggings=F.col("taggings"))


@query("s3_item_tags", "SELECT CAST(p_partkey AS VARCHAR) AS item, p_brand AS tag FROM part")
def _(t):
    return SI.load_tags(tag_lines(t))[2]


@query("s3_tag_names", "SELECT DISTINCT p_brand AS tag, unnest([lower(p_brand), upper(p_brand), 'alias ' || p_brand]) AS name FROM part")
def _(t):
    return SI.load_tags(tag_lines(t))[3]


def listed_lines(t):
    first = F.when(F.col("l_returnflag") == "A", "Maybe").when(F.col("l_linenumber") == 1, "Commander").otherwise("Main")
    rows = t.lines.groupBy("basket", "made").agg(F.collect_list(F.struct(F.array(first).alias("categories"), (F.col("l_quantity") - 1).cast("int").alias("quantity"),
                                                 F.struct(F.struct(F.col("item").alias("uid")).alias("oracleCard")).alias("card"))).alias("cards"))
    day = F.concat(F.date_format("made", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    return told(rows, id=F.col("basket").cast("string"), name=F.lit("b"), updatedAt=day, createdAt=day, edhBracket=F.lit(3), viewCount=F.lit(1),
                categories=F.array(F.struct(F.lit("Maybe").alias("name"), F.lit(False).alias("includedInDeck")), F.struct(F.lit("Main").alias("name"), F.lit(True).alias("includedInDeck"))), cards=F.col("cards"))


@query("s4_listed_baskets", """WITH x AS (SELECT basket, item, CAST(l_quantity AS BIGINT) - 1 AS copies, l_linenumber = 1 AS lead FROM ln WHERE l_returnflag <> 'A' AND l_quantity >= 2)
    SELECT CAST(basket AS VARCHAR) AS basket, item, CAST(sum(copies) AS BIGINT) AS copies, bool_or(lead) AS lead FROM x WHERE basket IN (SELECT basket FROM x GROUP BY 1 HAVING sum(copies) BETWEEN 60 AND 140 AND count(*) FILTER (lead) BETWEEN 1 AND 2) GROUP BY basket, item""", "ln")
def _(t):
    return SB.listed_baskets(listed_lines(t), 60, 140)[1]


def boarded_lines(t):
    board = F.when(F.col("l_linenumber") == 1, "commanders").when(F.col("l_returnflag") == "A", "sideboard").otherwise("mainboard")
    rows = t.lines.withColumn("board", board)
    card = F.struct(F.col("l_quantity").cast("int").alias("quantity"), F.struct(F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("scryfall_id")).alias("card"))
    key = F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("string"), F.date_format("l_shipdate", "yyyyMMdd"))
    each = rows.groupBy("basket", "board", key.alias("_key")).agg(F.first(card).alias("_card"))
    boards = each.groupBy("basket", "board").agg(F.map_from_entries(F.collect_list(F.struct("_key", "_card"))).alias("cards"))
    whole = boards.groupBy("basket").agg(F.map_from_entries(F.collect_list(F.struct("board", F.struct("cards")))).alias("boards"))
    return told(whole, publicId=F.concat(F.lit("m"), F.col("basket").cast("string")), name=F.lit("m"), lastUpdatedAtUtc=F.lit("2001-01-01"), createdAtUtc=F.lit("2001-01-01"), bracket=F.lit(2), viewCount=F.lit(0), boards=F.col("boards"))


def known_variants(t):
    return t.read("part").filter("p_type <> 'LARGE'").select(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("variant"), F.col("p_name").alias("item"))


@query("s5_boarded_baskets", """WITH e AS (SELECT DISTINCT basket, l_partkey, l_linenumber, l_suppkey, l_quantity, l_shipdate, item, l_returnflag, p_type FROM ln), x AS (SELECT basket, item, sum(l_quantity) AS copies, bool_or(l_linenumber = 1) AS lead FROM e
      WHERE (l_linenumber = 1 OR l_returnflag <> 'A') AND p_type <> 'LARGE' GROUP BY ALL)
    SELECT 'm' || basket AS basket, item, CAST(copies AS BIGINT) AS copies, lead FROM x WHERE basket IN (SELECT basket FROM x GROUP BY 1 HAVING sum(copies) BETWEEN 60 AND 140 AND count(*) FILTER (lead) BETWEEN 1 AND 2)""", "ln")
def _(t):
    return SB.boarded_baskets(boarded_lines(t), known_variants(t), 60, 140)[1]


@query("s19_partitions")
def _(t):
    return SB.leader_names(SB.listed_baskets(listed_lines(t), 60, 140)[1]).select("basket", SB.partition_of(F.col("leaders")).alias("part"))


def event_lines(t):
    entry = F.struct(F.col("player").cast("string").alias("id"), F.concat(F.lit(" "), "player_name").alias("name"), F.when(F.col("standing") > 3, F.col("standing")).alias("standing"),
                     F.col("wins"), (F.col("games") - F.col("wins") - F.col("draws")).alias("losses"), F.when(F.col("draws") > 0, F.col("draws")).alias("draws"),
                     F.struct(F.when(F.col("nation") > 4, F.map_from_arrays(F.array("leader", F.lit("A")), F.array(F.lit("x"), F.lit("y")))).alias("Commanders"), F.map_from_arrays(F.array(F.lit("card")), F.array(F.lit("1"))).alias("Mainboard")).alias("deckObj"))
    rows = t.entries.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("standing", entry.alias("e"))), lambda a, b: (a["standing"] - b["standing"]).cast("int")).alias("_s"), F.max("top_cut").alias("cut"))
    return told(rows, TID=F.date_format("date", "yyyyMMdd"), tournamentName=F.lit(" day "), startDate=F.unix_timestamp(F.col("date").cast("timestamp")) + 3600, topCut=F.col("cut"), standings=F.transform("_s", lambda x: x["e"]))


@query("s6_event_entries", """SELECT strftime(date, '%Y%m%d') AS event, date, pos, 'A / ' || leader AS leader_text, CASE WHEN standing > 3 THEN standing ELSE pos + 1 END AS standing, wins, games - wins - draws AS losses, draws, CAST(player AS VARCHAR) AS profile, player_name, n AS size, top_cut
    FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY standing) - 1 AS pos, count(*) OVER (PARTITION BY date) AS n FROM en) WHERE nation > 4""", "en")
def _(t):
    events, entries, _ = SE.load_events(event_lines(t))
    return entries.join(events.drop("name"), "event").select("event", "date", "pos", "leader_text", "standing", "wins", "losses", "draws", "profile", "player_name", "size", "top_cut")


@query("s7_price_snapshot", """SELECT 'v' || p_partkey AS variant, 'usd' AS field, CAST(round_even(CAST(printf('%.2f', p_retailprice) AS DOUBLE) * 100, 0) AS INT) AS cents FROM part WHERE p_size BETWEEN 6 AND 45
    UNION ALL SELECT 'v' || p_partkey, 'usd_foil', CAST(round_even(CAST(printf('%.2f', p_retailprice * 0.5) AS DOUBLE) * 100, 0) AS INT) FROM part WHERE p_size BETWEEN 21 AND 45""")
def _(t):
    return SI.price_snapshot(variant_lines(t))


CTES["gm"] = (["ob"], """SELECT variant, day, cents, CASE finish WHEN 'view' THEN 'usd' WHEN 'click' THEN 'usd_foil' WHEN 'purchase' THEN 'eur' END AS field FROM ob WHERE finish IN ('view', 'click', 'purchase')""")


def guide_rows(t):
    f = F.col("finish")
    provider = F.when(f.isin("view", "click"), "tcgplayer").when(f.isin("purchase", "signup"), "cardmarket").otherwise("elsewhere")
    kind = F.when(f == "click", "foil").when(f == "signup", "etched").otherwise("normal")
    return t.observed.select(F.concat(F.lit("u"), F.col("variant").cast("string")).alias("uuid"), "variant", provider.alias("provider"), kind.alias("kind"), F.date_format("day", "yyyy-MM-dd").alias("day"), (F.col("cents") / 100).alias("price"))


def guide_ids(t):
    return t.observed.select("variant").distinct().select(F.concat(F.lit("u"), F.col("variant").cast("string")).alias("uuid"), "variant")


@query("s8_nested_prices", "SELECT day, variant, field, cents FROM gm", "gm")
def _(t):
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    days = guide_rows(t).groupBy("uuid", "provider", "kind").agg(entries("day", "price").alias("days"))
    retail = days.groupBy("uuid", "provider").agg(entries("kind", "days").alias("retail"))
    paper = retail.groupBy("uuid").agg(F.map_from_entries(F.collect_list(F.struct("provider", F.struct("retail")))).alias("paper"))
    return SP.nested_prices(told(paper, uuid=F.col("uuid"), paper=F.col("paper")), guide_ids(t))


@query("s9_csv_prices", "SELECT day, variant, field, cents FROM gm", "gm")
def _(t):
    rows = guide_rows(t)
    paper = rows.select("kind", F.lit("USD"), "day", F.lit("paper"), F.col("price").cast("string"), "provider", F.lit("retail"), "uuid")
    online = rows.select("kind", F.lit("USD"), "day", F.lit("online"), F.col("price").cast("string"), "provider", F.lit("retail"), "uuid")
    lines = paper.union(online).toDF("a", "b", "c", "d", "e", "f", "g", "h").select(F.concat_ws(",", "a", "b", "c", "d", "e", "f", "g", "h").alias("value"))
    return SP.csv_prices(lines, guide_ids(t))


@query("s10_table_prices", "SELECT day, variant, field, cents FROM gm WHERE cents <> 0", "gm")
def _(t):
    table = guide_rows(t).select("variant", F.lit("paper").alias("medium"), "provider", F.lit("retail").alias("list_type"), F.col("kind").alias("finish"), F.to_date("day").alias("date"), "price")
    return SP.table_prices(table.unionByName(table.withColumn("list_type", F.lit("buylist"))))


@query("s11_old_prices", """WITH x AS (SELECT * FROM gm WHERE field IN ('usd', 'usd_foil') AND cents <> 0), d AS (SELECT day FROM x GROUP BY day ORDER BY count(DISTINCT variant) DESC, day LIMIT 1) SELECT day, variant, field, cents FROM x SEMI JOIN d USING (day)""", "gm")
def _(t):
    entries = F.map_from_entries(F.collect_list(F.struct("day", "price")))
    rows = guide_rows(t).filter("provider = 'tcgplayer'").groupBy("variant", "kind").agg(entries.alias("m"))
    whole = rows.groupBy("variant").agg(F.first(F.when(F.col("kind") == "normal", F.col("m")), ignorenulls=True).alias("paper"), F.first(F.when(F.col("kind") == "foil", F.col("m")), ignorenulls=True).alias("foil"))
    lines = told(whole, scryfallId=F.col("variant").cast("string"), prices=F.struct(F.col("paper"), F.col("foil").alias("paperFoil")))
    return SP.old_prices(lines).withColumn("variant", F.col("variant").cast("long"))


@query("s12_recipe_items", "SELECT CAST(recipe AS VARCHAR) AS recipe, item, must_lead FROM ri JOIN part ON p_partkey = recipe WHERE p_type <> 'SMALL'", "ri")
def _(t):
    return SE.load_recipes(recipe_lines(t))[1]


@query("s12_recipes", "SELECT CAST(p_partkey AS VARCHAR) AS recipe, lower(p_type) AS needs, '1,2,3' AS makes FROM part WHERE p_type <> 'SMALL'")
def _(t):
    return SE.load_recipes(recipe_lines(t))[0].select("recipe", F.array_join("needs", ",").alias("needs"), F.array_join("makes", ",").alias("makes"))


def recipe_lines(t):
    from wickerwork.plans.bundles import recipe_items
    uses = recipe_items(t).groupBy(F.col("recipe").alias("p_partkey")).agg(F.collect_list(F.struct(F.struct(F.col("item").alias("oracleId")).alias("card"), F.col("must_lead").alias("mustBeCommander"))).alias("uses"))
    named = lambda xs: F.array(*[F.struct(F.struct(x.alias("name")).alias("feature")) for x in xs])
    return told(uses.join(t.read("part"), "p_partkey"), id=F.col("p_partkey").cast("string"), status=F.when(F.col("p_type") == "SMALL", "DRAFT").otherwise("OK"), uses=F.col("uses"),
                requires=F.array(F.struct(F.struct(F.lower("p_type").alias("name")).alias("template"))), produces=named([F.lit(str(i)) for i in (1, 2, 3, 4)]), manaNeeded=F.lit(""))


@query("s13_arrays_and_lines", "SELECT event_id, user_id, value FROM events")
def _(t):
    """Runs of 2,000 event ids come by turns as the lines of compressed files and as a compressed file of one JSON array."""
    one, schema = F.to_json(F.struct("event_id", "user_id", "value")), "event_id bigint, user_id bigint, value double"
    rows = t.read("events").withColumn("run", F.floor(F.col("event_id") / 2000))
    lines, arrays = scratch_path(t.spark, "lines"), scratch_path(t.spark, "arrays")
    rows.filter("run % 2 = 1").select(one.alias("value")).write.option("compression", "gzip").text(lines)
    whole = F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value")
    rows.filter("run % 2 = 0").groupBy("run").agg(whole).repartition("run").write.partitionBy("run").option("compression", "gzip").text(arrays)
    return R.parse_lines(R.read_lines(t.spark, lines), schema).unionByName(R.parse_texts(R.read_whole(t.spark, arrays).select("value"), schema))


@query("s14_cut_tails", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) > 1")
def _(t):
    """The last record of every user is cut off halfway."""
    one = F.to_json(F.struct("event_id", "user_id", "event_type"))
    last = t.read("events").groupBy("user_id").agg(F.max("event_id").alias("last"))
    rows = t.read("events").join(last, "user_id").select(F.when(F.col("event_id") == F.col("last"), F.substring(one, 1, 20)).otherwise(one).alias("value"))
    return R.parse_lines(rows, "event_id bigint, user_id bigint, event_type string").select("event_id", "user_id")


@query("s15_page_anchors", """SELECT page_id, href, text, min(pos) AS pos FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
    unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS pos FROM pages) GROUP BY ALL""")
def _(t):
    return SP.anchors(t.read("pages"), '<a href="([^"]*)">([^<]*)</a>', "href", "text").withColumn("pos", F.col("pos").cast("long"))


CTES["gp"] = ([], """SELECT p_brand AS page_id, p_partkey, p_name, p_brand, p_size, p_type, 'Set+' || p_type AS slug, CASE WHEN p_size > 5 THEN CAST(p_size AS VARCHAR) END AS number, p_size > 25 AS foil, upper(left(p_type, 3)) AS code,
    CASE WHEN p_size % 4 = 0 THEN 'prerelease' ELSE '' END AS tag FROM part""")


def guide_pages(t):
    p = t.read("part").withColumns({"tag": F.when(F.col("p_size") % 4 == 0, "<prerelease> ").otherwise(""), "number": F.when(F.col("p_size") > 5, F.concat(F.col("p_size").cast("string"), F.lit("/"))).otherwise("")})
    card = F.concat("p_name", F.lit(" "), "tag", F.lit("["), F.upper(F.substring("p_type", 1, 3)), F.lit("] #"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, " (F)").otherwise(""))
    anchor = F.concat(F.lit('<a data-card-id="'), card, F.lit('" class="x" href="/price/Set+'), "p_type", F.lit("/"), "number", F.replace("p_name", F.lit(" "), F.lit("+")), F.lit('">see</a>'))
    return p.groupBy(F.col("p_brand").alias("page_id")).agg(F.concat(F.lit("<html>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", anchor.alias("a")))), lambda x: x["a"]), "\n"), F.lit("</html>")).alias("html"))


@query("s15_listed_variants", """SELECT page_id, slug, number, foil, code, tag, p_name || ' ' || CASE WHEN tag <> '' THEN '<prerelease> ' ELSE '' END || '[' || code || '] #' || p_partkey || CASE WHEN foil THEN ' (F)' ELSE '' END AS guide_id FROM gp""", "gp")
def _(t):
    return SP.listed_variants(guide_pages(t)).drop("pos")


@query("s16_script_history", "SELECT variant AS guide_id, day, cents FROM ob WHERE finish = 'view'", "ob")
def _(t):
    line = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(", "), F.format_string("%.2f", F.col("cents") / 100))
    scripts = t.observed.filter("finish = 'view'").groupBy(F.col("variant").alias("guide_id")).agg(F.concat(F.lit('d += "'), F.array_join(F.collect_list(line), '\\n"; d += "'), F.lit('";')).alias("text"))
    return SP.script_history(scripts)


@query("s17_partitioned_table", "SELECT leader, item, count(*) AS baskets, CAST(sum(copies) AS BIGINT) AS copies FROM bi GROUP BY ALL", "bi")
def _(t):
    """Written by leader, read back and counted."""
    path = scratch_path(t.spark, "basket_items")
    sinks.write_partitioned(t.basket_items, path, ["leader"], ["item"])
    return t.spark.read.parquet(path).groupBy("leader", "item").agg(F.count(F.lit(1)).alias("baskets"), F.sum("copies").alias("copies"))


@query("s17_blocked_table", "SELECT block, count(*) AS rows, min(p_partkey) AS first FROM (SELECT p_partkey, CAST(p_partkey // 256 AS INT) AS block FROM part) GROUP BY block")
def _(t):
    path = scratch_path(t.spark, "blocks")
    sinks.write_partitioned(t.read("part").withColumn("block", sinks.block_of(F.col("p_partkey"), sinks.BLOCKS["items"])), path, ["block"], ["p_partkey"], files=1)
    return t.spark.read.parquet(path).groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.min("p_partkey").alias("first"))


def list_texts(t):
    """A basket as a pasted list: its first item under a heading, the rest below, open lines in the sideboard, one unknown."""
    rows = t.lines.groupBy("basket", "item").agg(F.sum("l_quantity").cast("int").alias("q"), F.max("l_linestatus").alias("s"), F.min("l_partkey").alias("p"))
    line = F.concat(F.col("q").cast("string"), F.lit("x "), F.initcap("item"), F.lit(" (SET) "), F.col("p").cast("string"), F.lit(" *F*"))
    each = rows.groupBy("basket").agg(F.array_sort(F.collect_list(F.struct("item", "s", line.alias("l")))).alias("a"))
    part = lambda s: F.array_join(F.transform(F.filter(F.slice("a", 2, F.size("a")), lambda x: x["s"] == s), lambda x: x["l"]), "\n")
    text = F.concat(F.lit("// Commander\n"), F.col("a")[0]["l"], F.lit("\n\nDeck:\n"), part("F"), F.lit("\n1 Nothing Known [x{top}]\n# note\nSideboard (9)\n"), part("O"))
    return each.select(F.col("basket").alias("list"), text.alias("text"))


@query("s18_parsed_lists", """WITH x AS (SELECT basket AS list, item, CAST(sum(l_quantity) AS INT) AS copies, max(l_linestatus) AS s, CAST(min(l_partkey) AS VARCHAR) AS collector, row_number() OVER (PARTITION BY basket ORDER BY item) AS r FROM ln GROUP BY basket, item)
    SELECT list, CASE WHEN r = 1 THEN 'leader' WHEN s = 'F' THEN 'item' ELSE 'outside' END AS kind, item, copies, 'set' AS set, collector, 1 AS finish FROM x UNION ALL SELECT DISTINCT list, 'unknown', NULL, 1, NULL, NULL, NULL FROM x""", "ln")
def _(t):
    names = t.once("names", lambda: t.read("part").select(F.col("p_name").alias("key"), F.col("p_name").alias("number")).distinct())
    return SB.parse_lists(list_texts(t), names).select("list", "kind", F.col("number").alias("item"), "copies", "set", "collector", "finish")


# ---- linkage: our variants are the parts, the guide's listings those of its pages ------------------------------


def link_inputs(t):
    part = t.read("part")
    ours = part.select(F.col("p_partkey").alias("variant"), F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("foil"), F.concat(F.lit("Set "), "p_type").alias("set_name"), F.array(F.lower(F.substring("p_type", 1, 3))).alias("codes"),
                       F.lit(None).cast("string").alias("parent_name"), F.array().cast("array<string>").alias("parent_codes"), F.col("p_size").cast("string").alias("number"),
                       F.when(F.col("p_size") % 4 == 0, F.array(F.lit("datestamped"))).otherwise(F.array().cast("array<string>")).alias("promo_types"))
    listed = SP.listed_variants(guide_pages(t))
    theirs = listed.withColumn("name", F.trim(F.regexp_extract("guide_id", r"^([^<\[]*)", 1))).withColumn("pos", F.regexp_extract("guide_id", r"#(\d+)", 1).cast("long"))
    return ours, theirs


CTES["lk"] = (["gp"], """SELECT variant, guide, score, ties = 1 AS sure FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY score DESC, guide) AS k, count(*) OVER (PARTITION BY variant, score) AS ties FROM (
    SELECT o.p_partkey AS variant, g.p_partkey AS guide, CASE WHEN g.number IS NULL THEN 0 ELSE 2 END + CASE WHEN g.tag <> '' THEN 2 ELSE 1 END AS score
    FROM part o JOIN gp g ON g.p_name = o.p_name AND g.foil = (o.p_size > 25) AND g.p_type = o.p_type AND (g.number IS NULL OR g.number = CAST(o.p_size AS VARCHAR)) AND (g.tag = '' OR o.p_size % 4 = 0))) WHERE k = 1""")


@query("j14_linked_variants", "SELECT variant, guide, score, sure FROM lk", "lk")
def _(t):
    found = linkage.link_variants(*link_inputs(t))
    return found.select("variant", F.regexp_extract("guide_id", r"#(\d+)", 1).cast("long").alias("guide"), "score", "sure")


@query("j15_plausible_links", "SELECT variant, guide FROM lk JOIN part o ON o.p_partkey = variant JOIN part g ON g.p_partkey = guide WHERE g.p_retailprice * (g.p_size % 7 + 1) / o.p_retailprice BETWEEN CASE WHEN sure THEN 0.2 ELSE 0.5 END::DOUBLE AND CASE WHEN sure THEN 5 ELSE 2 END::DOUBLE", "lk")
def _(t):
    part = t.read("part")
    links = cut_lineage(linkage.link_variants(*link_inputs(t)).withColumn("guide", F.regexp_extract("guide_id", r"#(\d+)", 1).cast("long")), "links")
    latest = links.select("guide_id", "guide").distinct().join(part.select(F.col("p_partkey").alias("guide"), (F.col("p_retailprice") * (F.col("p_size") % 7 + 1)).alias("theirs")), "guide").select("guide_id", "theirs")
    return linkage.plausible(links, latest, part.select(F.col("p_partkey").alias("variant"), F.col("p_retailprice").alias("ours"))).select("variant", "guide")


@query("j16_matched_sets", "SELECT DISTINCT lower(p_brand) AS set, 'G' || substr(p_brand, 7) AS code FROM part")
def _(t):
    brands = t.read("part").select("p_brand").distinct()
    theirs = brands.select(F.replace("p_brand", F.lit("#"), F.lit("-")).alias("slug"), F.upper("p_brand").alias("name"), F.concat(F.lit("G"), F.substring("p_brand", 7, 9)).alias("code"))
    return linkage.match_sets(theirs, brands.select(F.lower("p_brand").alias("set"), F.col("p_brand").alias("set_name")))
