"""Registered catalogue queries. The catalogue is the parts, told as items with type lines and rules text."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerwork.functions.text import fold
from wickerwork.operators import catalog as C
from wickerwork.operators.ranking import top_n
from wickerwork.plans.registry import query
from wickerwork.plans.tables import CTES

CTES["ct"] = ([], """SELECT p_partkey AS item, p_name AS name, adj, noun, CASE p_type WHEN 'ECONOMY' THEN 'Legendary Creature — ' || adj || ' ' || noun WHEN 'STANDARD' THEN 'Artifact Creature — ' || noun WHEN 'PROMO' THEN 'Enchantment Land'
    WHEN 'SMALL' THEN 'Sorcery // Land — ' || noun WHEN 'MEDIUM' THEN 'Instant' ELSE 'Planeswalker — ' || adj END AS type_line, p_type,
    'Create two 1/1 ' || CASE adj WHEN 'Red' THEN 'red' WHEN 'Blue' THEN 'blue' WHEN 'Old' THEN 'white' ELSE 'colorless' END || ' ' || noun || ' creature tokens with ' || CASE WHEN p_size > 25 THEN 'flying' ELSE 'first strike' END
    || '. Toward the reward, strike.' || CASE WHEN p_size > 40 THEN ' It can be your commander.' ELSE '' END AS text,
    CASE WHEN p_size % 3 > 0 THEN p_size END AS rank, p_size AS value, p_retailprice AS price, p_brand, CAST(substr(p_brand, 7) AS INT) AS b
    FROM (SELECT *, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS adj, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS noun FROM part)""")


def catalogue(t):
    adj, noun = F.split(F.initcap("p_name"), " ")[0], F.split(F.initcap("p_name"), " ")[1]
    line = (F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Legendary Creature — "), adj, F.lit(" "), noun)).when(F.col("p_type") == "STANDARD", F.concat(F.lit("Artifact Creature — "), noun))
            .when(F.col("p_type") == "PROMO", F.lit("Enchantment Land")).when(F.col("p_type") == "SMALL", F.concat(F.lit("Sorcery // Land — "), noun))
            .when(F.col("p_type") == "MEDIUM", F.lit("Instant")).otherwise(F.concat(F.lit("Planeswalker — "), adj)))
    color = F.when(adj == "Red", "red").when(adj == "Blue", "blue").when(adj == "Old", "white").otherwise("colorless")
    text = F.concat(F.lit("Create two 1/1 "), color, F.lit(" "), noun, F.lit(" creature tokens with "), F.when(F.col("p_size") > 25, "flying").otherwise("first strike"),
                    F.lit(". Toward the reward, strike."), F.when(F.col("p_size") > 40, " It can be your commander.").otherwise(""))
    b = F.substring("p_brand", 7, 9).cast("int")
    bits = lambda names: F.filter(F.array(*[F.when(F.shiftright(b, i).bitwiseAND(1) == 1, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    return t.read("part").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), line.alias("type_line"), text.alias("text"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("rank"), F.col("p_size").alias("value"), F.col("p_retailprice").alias("price"), "p_brand", "p_type",
        bits(C.COLORS).alias("color_identity"), bits(C.COLORS).alias("colors"), F.array(F.lit("Flying"), F.when(b > 12, "Strike").otherwise("First strike")).alias("keywords"),
        F.map_from_arrays(F.array(F.lit("modern"), F.lit("commander")), F.array(F.when(b > 5, "legal").otherwise("banned"), F.when(b > 20, "not_legal").otherwise("legal"))).alias("legalities"))


def part_tags(t):
    """Items tagged with their brand; the tag graph is built over the brands."""
    return t.read("part").select(F.col("p_partkey").alias("item"), F.lower("p_brand").alias("tag"))


# Brand b is a child of brands b / 2 and b / 3; the first three form a cycle.
EDGES = """SELECT DISTINCT 'brand#' || b AS child, 'brand#' || p AS parent FROM (SELECT CAST(substr(p_brand, 7) AS INT) AS b FROM part) x, unnest([b // 2, b // 3, CASE WHEN b = 1 THEN 3 ELSE 0 END]) u(p) WHERE p > 0"""


def edges(t):
    b = F.substring("p_brand", 7, 9).cast("int")
    parents = F.array(F.floor(b / 2), F.floor(b / 3), F.when(b == 1, 3).otherwise(0).cast("long"))
    rows = t.read("part").select(b.alias("b"), F.explode(parents).alias("p")).filter("p > 0").distinct()
    name = lambda c: F.concat(F.lit("brand#"), F.col(c).cast("string"))
    return rows.select(name("b").alias("child"), name("p").alias("parent")).distinct()


@query("f1_kinds", "SELECT item, CASE p_type WHEN 'ECONOMY' THEN 'Creature' WHEN 'STANDARD' THEN 'Creature' WHEN 'PROMO' THEN 'Land' WHEN 'SMALL' THEN 'Sorcery' WHEN 'MEDIUM' THEN 'Instant' ELSE 'Planeswalker' END AS kind FROM ct", "ct")
def _(t):
    return catalogue(t).select("item", C.kind_of(F.col("type_line")).alias("kind"))


@query("f2_subtypes", "SELECT item, unnest(CASE p_type WHEN 'ECONOMY' THEN [adj, noun] WHEN 'STANDARD' THEN [noun] WHEN 'SMALL' THEN [noun] WHEN 'LARGE' THEN [adj] ELSE [] END) AS subtype FROM ct", "ct")
def _(t):
    return catalogue(t).select("item", F.explode(C.subtypes(F.col("type_line"))).alias("subtype"))


CTES["fc"] = (["ct"], """SELECT item, b & 31 AS identity, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 9 WHEN 'PROMO' THEN 48 WHEN 'SMALL' THEN 36 WHEN 'MEDIUM' THEN 2 ELSE 64 END AS types,
    CASE WHEN b > 5 THEN 4 ELSE 0 END + CASE WHEN b > 20 THEN 0 ELSE 32 END AS legal, CAST(round_even(price * 100, 0) AS INT) AS cents, value FROM ct""")


@query("f3_filter_columns", "SELECT item, identity, types, legal, cents FROM fc", "fc")
def _(t):
    return C.filter_columns(catalogue(t)).select("item", "identity", "types", "legal", "cents")


@query("f4_item_filter", "SELECT item FROM fc WHERE identity = 10 AND types & 33 <> 0 AND legal & 4 <> 0 AND value BETWEEN 5 AND 45 AND cents <= 150000 UNION ALL SELECT item FROM fc WHERE identity = 3", "fc")
def _(t):
    rows = C.filter_columns(catalogue(t))
    one = C.item_filter(colors=["U", "R"], types=["Creature", "Land"], legal_in="modern", least=5, most=45, max_cents=150000)
    return rows.filter(one).select("item").unionByName(rows.filter(C.item_filter(colors=["W", "U"])).select("item"))


@query("a30_by_kind", """SELECT kind, count(*) AS items, CASE kind WHEN 'Creature' THEN 0 WHEN 'Planeswalker' THEN 1 WHEN 'Instant' THEN 3 WHEN 'Sorcery' THEN 4 ELSE 7 END AS place FROM (
    SELECT CASE p_type WHEN 'ECONOMY' THEN 'Creature' WHEN 'STANDARD' THEN 'Creature' WHEN 'PROMO' THEN 'Land' WHEN 'SMALL' THEN 'Sorcery' WHEN 'MEDIUM' THEN 'Instant' ELSE 'Planeswalker' END AS kind FROM ct) GROUP BY kind""", "ct")
def _(t):
    return C.by_kind(C.filter_columns(catalogue(t)))


CTES["nr"] = (["ct"], "SELECT item, name, row_number() OVER (ORDER BY rank IS NULL, rank, name, item) - 1 AS number FROM ct")


def numbered(t):
    return C.item_numbers(catalogue(t).select("item", "name", "rank"))


@query("w1_item_numbers", "SELECT item, number FROM nr", "nr")
def _(t):
    return numbered(t).select("item", "number")


@query("j1_name_lookup", """SELECT key, number FROM (SELECT lower(name) AS key, min(number) AS number, 0 AS s FROM nr GROUP BY 1 UNION ALL SELECT 'part ' || min(number), min(number), 1 FROM nr GROUP BY name)""", "nr")
def _(t):
    n = numbered(t)
    aliases = n.groupBy("name").agg(F.min("number").alias("number")).select("number", F.concat(F.lit("Part "), F.col("number").cast("string")).alias("name"))
    return C.name_lookup(n, aliases)


@query("j2_leader_keys", """WITH k AS (SELECT lower(name) AS key, min(number) AS number FROM nr GROUP BY 1), p AS (SELECT basket, item, row_number() OVER (PARTITION BY basket ORDER BY item DESC) AS r FROM bi),
    u AS (SELECT basket, number FROM p JOIN k ON key = item WHERE r <= 2 AND basket NOT IN (SELECT basket FROM p WHERE r <= 2 AND item LIKE 'new %'))
    SELECT basket AS id, string_agg(CAST(number AS VARCHAR), '-' ORDER BY number) AS leader FROM u GROUP BY 1""", "nr bi")
def _(t):
    """A basket's last two item names as its leader text; names that start with new are no items."""
    last = top_n(t.basket_items.select(F.col("basket").alias("id"), "item"), "id", [F.desc("item")], 2)
    texts = last.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item")), F.initcap), " / ").alias("text"))
    known = numbered(t).filter(~F.col("name").startswith("new "))
    return C.leader_key(texts, C.name_lookup(known))


@query("j3_folded_words", """SELECT doc_id, count(*) AS words, count(DISTINCT w) AS folded FROM (SELECT doc_id, strip_accents(lower(w)) AS w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)) GROUP BY 1""")
def _(t):
    words = t.read("documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    bare = F.translate(F.regexp_replace(F.col("w"), r"[\n\r\t]", " "), "’`", "''")
    return words.select("doc_id", fold_words(bare).alias("w")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.countDistinct("w").alias("folded"))


def fold_words(c):
    return fold(c)


@query("j20_full_names", "SELECT p_partkey AS query, upper(p_name) AS wanted, CASE WHEN p_type <> 'LARGE' OR p_name IN (SELECT p_name FROM part WHERE p_type <> 'LARGE') THEN p_name END AS name FROM part")
def _(t):
    part = t.read("part")
    wanted = part.select(F.col("p_partkey").alias("query"), F.upper("p_name").alias("wanted"))
    return C.full_names(wanted, part.filter("p_type <> 'LARGE'").select(F.col("p_name").alias("name")))


@query("k5_name_lookup", """WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 2)[1:2] AS q FROM part), n AS (SELECT name, min(number) AS number FROM nr GROUP BY 1)
    SELECT q AS query, name, rank FROM (SELECT q, name, row_number() OVER (PARTITION BY q ORDER BY starts_with(name, q) DESC, number) AS rank FROM q JOIN n ON contains(name, q)) WHERE rank <= 12""", "nr")
def _(t):
    queries = t.read("part").select(F.substring(F.split("p_name", " ")[1], 1, 2).alias("q")).distinct().withColumn("query", F.col("q"))
    names = numbered(t).groupBy("name").agg(F.min("number").alias("number"))
    return C.name_prefix_search(names, queries).select("query", "name", F.col("rank").cast("long").alias("rank"))


@query("f15_eligible_leaders", "SELECT item FROM ct WHERE rank IS NOT NULL AND b <= 20 AND (p_type = 'ECONOMY' OR value > 40) ORDER BY rank, item LIMIT 100", "ct")
def _(t):
    return C.leaders_eligible(catalogue(t), 100).select("item")


@query("f16_limited_items", "SELECT p_partkey AS item FROM part WHERE p_size > 45 AND p_type = 'PROMO'")
def _(t):
    return t.read("part").filter("p_size > 45 and p_type = 'PROMO'").select(F.col("p_partkey").alias("item"))


@query("k9_sets_newest_first", "SELECT set, released, row_number() OVER (ORDER BY released DESC, set) AS place FROM (SELECT p_brand AS set, min(made) AS released FROM ln GROUP BY 1)", "ln")
def _(t):
    rows = t.lines.select(F.col("p_brand").alias("set"), F.col("made").alias("released"))
    return C.sets_newest_first(rows).withColumn("place", F.col("place").cast("long"))


CLOSURE = f"""WITH RECURSIVE e AS ({EDGES}), up AS (SELECT child AS tag, parent AS ancestor FROM e UNION SELECT up.tag, e.parent FROM up JOIN e ON up.ancestor = e.child)"""


@query("j7_tag_closure", f"{CLOSURE} SELECT p_partkey AS item, lower(p_brand) AS tag FROM part UNION SELECT p_partkey, ancestor FROM part JOIN up ON tag = lower(p_brand)")
def _(t):
    tags = part_tags(t).select("tag").distinct()
    return C.tags_with_ancestors(part_tags(t), edges(t), tags)


@query("f13_without_trivia", f"{CLOSURE} SELECT DISTINCT lower(p_brand) AS tag FROM part WHERE lower(p_brand) <> 'brand#5' AND lower(p_brand) NOT IN (SELECT tag FROM up WHERE ancestor = 'brand#5')")
def _(t):
    return C.without_trivia(part_tags(t).select("tag").distinct(), edges(t), ["brand#5"])


@query("f12_telling_tags", """WITH x AS (SELECT p_partkey AS item, lower(p_brand) AS tag FROM part UNION ALL SELECT p_partkey, CASE WHEN p_size > 25 THEN 'cycle-' || p_size ELSE 'multiple-' || p_size || '-effect' END FROM part UNION ALL SELECT p_partkey, 'size-' || p_size FROM part)
    SELECT item, tag FROM x WHERE tag NOT LIKE 'cycle-%' AND tag NOT LIKE 'multiple-%' AND tag IN (SELECT tag FROM x GROUP BY 1 HAVING count(*) <= 60)""")
def _(t):
    part = t.read("part").withColumn("s", F.col("p_size").cast("string"))
    wording = F.when(F.col("p_size") > 25, F.concat(F.lit("cycle-"), "s")).otherwise(F.concat(F.lit("multiple-"), "s", F.lit("-effect")))
    tags = (part_tags(t).unionByName(part.select(F.col("p_partkey").alias("item"), wording.alias("tag")))
            .unionByName(part.select(F.col("p_partkey").alias("item"), F.concat(F.lit("size-"), "s").alias("tag"))))
    return C.telling_tags(tags, most=60)


def keyword_table(t):
    return t.once("keywords", lambda: catalogue(t).select(F.explode("keywords").alias("keyword")).distinct())


CTES["kw"] = (["ct"], """SELECT item, CASE WHEN value > 25 THEN 'Flying' ELSE 'First strike' END AS keyword FROM ct UNION ALL SELECT item, 'Strike' FROM ct""")


@query("n11_keywords_in_text", "SELECT item, keyword FROM kw", "kw")
def _(t):
    texts = catalogue(t).select(F.col("item").alias("id"), "text")
    return C.find_keywords(texts, keyword_table(t)).select(F.col("id").alias("item"), "keyword")


CTES["tf"] = (["ct"], """SELECT item, 'token:' || unnest([CASE adj WHEN 'Red' THEN 'R' WHEN 'Blue' THEN 'U' WHEN 'Old' THEN 'W' ELSE 'Colorless' END, 'Creature', noun, CASE WHEN value > 25 THEN 'Flying' ELSE 'First strike' END]) AS feature FROM ct""")


def tokens(t):
    return t.once("tokens", lambda: made_tokens(t))


def made_tokens(t):
    items = catalogue(t)
    names = items.select(F.explode(C.subtypes(F.col("type_line"))).alias("name")).filter(F.col("name").rlike(C.SUBTYPE)).distinct()
    return C.token_features(items, keyword_table(t), names)


@query("n12_token_features", "SELECT item, feature FROM tf", "tf")
def _(t):
    return tokens(t)


CTES["ff"] = (["ct", "kw", "tf"], """SELECT DISTINCT item, feature FROM (SELECT item, unnest(CASE WHEN b & 31 = 0 THEN ['Colorless'] ELSE list_filter([CASE WHEN b & 1 > 0 THEN 'W' END, CASE WHEN b & 2 > 0 THEN 'U' END, CASE WHEN b & 4 > 0 THEN 'B' END, CASE WHEN b & 8 > 0 THEN 'R' END, CASE WHEN b & 16 > 0 THEN 'G' END], lambda x : x IS NOT NULL) END) AS feature FROM ct
    UNION ALL SELECT item, unnest(CASE p_type WHEN 'ECONOMY' THEN ['Legendary', 'Creature', adj, noun] WHEN 'STANDARD' THEN ['Artifact', 'Creature', noun] WHEN 'PROMO' THEN ['Enchantment', 'Land'] WHEN 'SMALL' THEN ['Sorcery', 'Land', noun] WHEN 'MEDIUM' THEN ['Instant'] ELSE ['Planeswalker', adj] END) FROM ct
    UNION ALL SELECT item, unnest(['Flying', CASE WHEN b > 12 THEN 'Strike' ELSE 'First strike' END]) FROM ct UNION ALL SELECT item, keyword FROM kw UNION ALL SELECT item, CASE WHEN value < 7 THEN 'CMC_' || value ELSE 'CMC_7_plus' END FROM ct
    UNION ALL SELECT item, feature FROM tf UNION ALL SELECT item, 'Token Creation' FROM ct UNION ALL SELECT item, 'tag:' || lower(p_brand) FROM ct)""")


def features(t):
    return C.item_features(catalogue(t), keyword_table(t), tokens(t), part_tags(t))


@query("n13_item_features", "SELECT item, feature FROM ff", "ff")
def _(t):
    return features(t)


CTES["tm"] = (["ff", "ct"], """SELECT term, min(c) AS category FROM (SELECT unnest(['W','U','B','R','G','Colorless']) AS term, 0 AS c UNION ALL SELECT unnest(['Creature','Instant','Sorcery','Artifact','Enchantment','Land','Planeswalker','Battle','Legendary']), 1
    UNION ALL SELECT unnest(['Flying', 'Strike', 'First strike']), 2 UNION ALL SELECT term, 3 FROM (SELECT unnest(CASE p_type WHEN 'ECONOMY' THEN [adj, noun] WHEN 'STANDARD' THEN [noun] WHEN 'SMALL' THEN [noun] WHEN 'LARGE' THEN [adj] ELSE [] END) AS term FROM ct)
      WHERE lower(term) NOT IN ('new') GROUP BY term HAVING count(*) >= 3 UNION ALL SELECT unnest(['CMC_0','CMC_1','CMC_2','CMC_3','CMC_4','CMC_5','CMC_6','CMC_7_plus']), 4 UNION ALL SELECT 'Token Creation', 5 UNION ALL SELECT feature, 5 FROM ff WHERE feature LIKE 'token:%' GROUP BY 1 HAVING count(*) >= 3
    UNION ALL SELECT feature, 6 FROM ff WHERE feature LIKE 'tag:%' GROUP BY 1 HAVING count(*) BETWEEN 2 AND (SELECT count(*) FROM ct) / 2) GROUP BY term""")


def terms(t):
    items = catalogue(t)
    keywords = C.common_terms(items.select("item", F.explode("keywords").alias("feature")).distinct())
    names = C.common_terms(items.select("item", F.explode(C.subtypes(F.col("type_line"))).alias("feature")).distinct().filter(F.col("feature").rlike(C.SUBTYPE)))
    n = items.agg(F.count(F.lit(1))).scalar()
    return C.term_space(keywords, names, C.common_terms(tokens(t)), part_tags(t), n)


@query("a1_term_space", "SELECT term, category FROM tm", "tm")
def _(t):
    return terms(t)


@query("a2_postings", "SELECT term, item FROM (SELECT feature AS term, item FROM ff) SEMI JOIN tm USING (term)", "ff tm")
def _(t):
    return C.postings(features(t), terms(t))


@query("a2_term_counts", "SELECT feature AS term, count(*) AS d FROM ff WHERE feature IN (SELECT term FROM tm) GROUP BY 1", "ff tm")
def _(t):
    return C.term_counts(C.postings(features(t), terms(t)))
