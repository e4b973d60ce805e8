"""Registered search queries. Two catalogues are searched: part names, by what baskets hold, and documents, by passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerwork.functions.text import normalise, price_limit, spoken_price, words
from wickerwork.operators import catalog as C
from wickerwork.operators import search as S
from wickerwork.plans.catalogue import features, numbered, terms
from wickerwork.plans.registry import query, r6
from wickerwork.plans.tables import CTES

# Tags are part names (two words each); a query is the text of a basket.
CTES["tn"] = ([], "SELECT DISTINCT 'tag:' || p_name AS term, p_name AS name FROM part")
CTES["sd"] = ([], "SELECT 'tag:' || p_name AS term, count(*) AS d, pow(1 + ln((SELECT count(*) FROM part) / count(*)), 2) AS weight FROM part GROUP BY p_name")
CTES["qw"] = (["bt"], """SELECT DISTINCT query, unnest(string_split(text, ' ')) AS word FROM bt""")
CTES["mt"] = (["qw", "tn"], """SELECT query, term, 2.0::DOUBLE AS size FROM qw JOIN (SELECT term, split_part(name, ' ', 1) AS word FROM tn UNION ALL SELECT term, split_part(name, ' ', 2) FROM tn) USING (word)
    GROUP BY query, term HAVING count(*) = 2""")
CTES["qg"] = (["mt", "sd"], "SELECT query, 'tags:' || min(term) OVER (PARTITION BY query) AS grp, term, size * weight / max(size * weight) OVER (PARTITION BY query) AS credit FROM mt JOIN sd USING (term)")


def tag_names(t):
    return t.read("part").select(F.concat(F.lit("tag:"), "p_name").alias("term"), F.col("p_name").alias("name")).distinct()


def name_weights(t):
    part = t.read("part")
    counts = part.groupBy(F.concat(F.lit("tag:"), "p_name").alias("term")).agg(F.count(F.lit(1)).alias("d"))
    return S.term_weights(counts, part.agg(F.count(F.lit(1))).scalar())


def groups(t, texts):
    return S.parse(texts, tag_names(t), name_weights(t))


def matched(t, texts):
    v = S.tag_variants(tag_names(t))
    return S.matched_tags(S.query_words(S.spoken_words(texts, v), v), v)


@query("n1_normalised_texts", r"""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(lower(text), '\bnon[- ]+([a-z])', 'non\1', 'g'), '\bwins? the game\b', 'win condition', 'g'), '''', ''), '\bkill spells?\b', 'creature removal', 'g'),
    '\bland destruction\b', 'land removal', 'g'), '\btoken makers?\b', 'makes tokens', 'g') AS text FROM benchmark""")
def _(t):
    return t.read("benchmark").select("item_id", normalise(F.col("text")).alias("text"))


@query("n2_stemmed_words", """WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM bt) UNION SELECT DISTINCT lower(n_name) FROM nation), q AS (SELECT DISTINCT p_name || 's' AS said FROM part)
    SELECT said, CASE WHEN said LIKE '%ss' THEN said ELSE left(said, length(said) - 1) END AS stemmed FROM q""", "bt")
def _(t):
    """Plurals of the part names, word by word."""
    said = t.read("part").select(F.concat("p_name", F.lit("s")).alias("said")).distinct()
    return said.select("said", F.array_join(words(F.col("said")), " ").alias("stemmed"))


@query("n3_query_words", "SELECT query, word FROM qw", "qw")
def _(t):
    v = S.tag_variants(tag_names(t))
    texts, askers = S.different_texts(t.basket_text)
    return S.for_askers(S.query_words(S.spoken_words(texts, v), v).select("query", "word"), askers)


@query("n6_implied_words", """WITH v AS (SELECT DISTINCT adj || ' land' AS name, adj FROM (SELECT split_part(p_name, ' ', 1) AS adj, p_name FROM part)), u AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word, p_name FROM part)
    SELECT word, 'land' AS implied FROM u GROUP BY word HAVING count(DISTINCT p_name) >= 3""")
def _(t):
    """Names like "red land gear": every name saying red says land too."""
    named = t.read("part").select(F.concat(F.lit("tag:"), "p_name").alias("term"), F.concat_ws(" land ", F.split("p_name", " ")[0], F.lit("x")).alias("_n"), "p_name").distinct()
    named = named.select("term", F.concat(F.split("p_name", " ")[0], F.lit(" land "), F.split("p_name", " ")[1]).alias("name"))
    found = S.implied_words(S.tag_variants(named))
    firsts = t.read("part").select(F.split("p_name", " ")[0].alias("word")).distinct()
    return found.join(firsts, "word", "left_semi")


@query("j9_matched_tags", "SELECT query, term, size FROM mt", "mt")
def _(t):
    texts, askers = S.different_texts(t.basket_text)
    return S.for_askers(matched(t, texts).select("query", "term", "size"), askers)


@query("n5_term_weights", "SELECT term, d, round(weight, 6) AS weight FROM sd", "sd")
def _(t):
    return name_weights(t).withColumn("weight", r6(F.col("weight")))


@query("n7_tag_groups", "SELECT query, grp, term, round(credit, 6) AS credit FROM qg", "qg")
def _(t):
    texts, askers = S.different_texts(t.basket_text)
    return S.for_askers(S.tag_groups(matched(t, texts), name_weights(t)).withColumn("credit", r6(F.col("credit"))), askers)


@query("n8_parsed_queries", """WITH k AS (SELECT 'term:' || noun AS grp, noun AS term, lower(noun) AS w FROM ct GROUP BY noun) SELECT item AS query, grp, term, 1.0::DOUBLE AS credit FROM (SELECT item, lower(noun) AS w FROM ct) JOIN k USING (w) WHERE term IN (SELECT term FROM tm)
    UNION ALL SELECT item, 'term:Token Creation', 'Token Creation', 1.0 FROM ct UNION ALL SELECT item, 'term:token:' || noun, 'token:' || noun, 1.0 FROM ct WHERE 'token:' || noun IN (SELECT term FROM tm)
    UNION ALL SELECT item, 'term:' || c, c, 1.0 FROM (SELECT item, CASE adj WHEN 'Red' THEN 'R' WHEN 'Blue' THEN 'U' END AS c FROM ct) WHERE c IS NOT NULL
    UNION ALL SELECT item, 'term:' || adj, adj, 1.0 FROM ct WHERE adj IN (SELECT term FROM tm)
    UNION ALL SELECT item, 'value', unnest(['CMC_0', 'CMC_1', 'CMC_2', 'CMC_3']), 1.0 FROM ct WHERE adj = 'Small'
    UNION ALL SELECT item, 'term:Flying', 'Flying', 1.0 FROM ct WHERE value > 25""", "ct tm")
def _(t):
    """"red gears with flying that make gear tokens", for every part, over the catalogue's terms."""
    adj, noun = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    queries = t.read("part").select(F.col("p_partkey").alias("query"), F.concat(adj, F.lit(" "), noun, F.lit("s"), F.when(F.col("p_size") > 25, " with flying").otherwise(""),
                                    F.lit(" that makes "), noun, F.lit(" tokens")).alias("text"))
    weights = terms(t).select("term", F.lit(1.0).alias("weight"))
    none = t.read("part").select(F.lit("tag:zz").alias("term"), F.lit("zz").alias("name")).distinct()
    texts, askers = S.different_texts(queries)
    return S.for_askers(S.parse(texts, none, weights), askers)


@query("n4_phrases_in_queries", """WITH w AS (SELECT DISTINCT p_name AS term FROM part) SELECT basket AS query, item AS term FROM bi
    UNION SELECT a.basket, split_part(a.item, ' ', 2) || ' ' || split_part(b.item, ' ', 1) FROM bi a JOIN bi b ON a.basket = b.basket AND b.item = (SELECT min(item) FROM bi c WHERE c.basket = a.basket AND c.item > a.item)
    WHERE split_part(a.item, ' ', 2) || ' ' || split_part(b.item, ' ', 1) IN (SELECT term FROM w)""", "bi")
def _(t):
    texts, askers = S.different_texts(t.basket_text)
    known = t.read("part").select(F.col("p_name").alias("term"), F.col("p_name").alias("phrase")).distinct()
    return S.for_askers(S.phrase_hits(texts.select("query", F.split("text", " ").alias("words")), known), askers)


@query("n9_scores", """SELECT query, item, round(floor(round(credit, 12) * 1000000 + 0.5) / 1000000, 6) AS score FROM (SELECT query, substr(term, 5) AS item, credit * gw / gw AS credit FROM (SELECT qg.*, max(weight) OVER (PARTITION BY query) AS gw FROM qg JOIN sd USING (term)))""", "qg sd")
def _(t):
    posted = tag_names(t).select("term", F.col("name").alias("item"))
    texts, askers = S.different_texts(t.basket_text)
    return S.for_askers(S.score(groups(t, texts), posted, name_weights(t)), askers)


# Documents: features are the words on two to half of them, queries the passages.
CTES["dw"] = ([], "SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents) WHERE word <> ''")
CTES["dt"] = (["dw"], "SELECT word AS term, count(*) AS d, pow(1 + ln((SELECT count(*) FROM documents) / count(*)), 2) AS weight FROM dw GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= (SELECT count(*) FROM documents) / 2")
CTES["dq"] = (["dt"], "SELECT DISTINCT query, term, weight FROM (SELECT item_id AS query, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM benchmark) JOIN dt USING (term)")
CTES["ds"] = (["dq", "dw"], "SELECT query, doc_id AS item, floor(round(sum(weight) / any_value(total), 12) * 1000000 + 0.5) / 1000000 AS score FROM dq JOIN dw ON word = term JOIN (SELECT query, sum(weight) AS total FROM dq GROUP BY 1) USING (query) GROUP BY query, doc_id")


def document_search(t, near=0.0):
    split = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    docs = t.read("documents")
    posted = docs.select(F.col("doc_id").alias("item"), F.explode(F.array_distinct(split("text"))).alias("term"))
    n = docs.agg(F.count(F.lit(1))).scalar()
    weights = t.once("word_weights", lambda: S.term_weights(C.term_counts(posted).filter((F.col("d") >= 2) & (F.col("d") <= n / 2)), n))
    asked = t.read("benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(split("text"))).alias("term")).join(weights.select("term"), "term")
    return S.score(asked.select("query", F.col("term").alias("grp"), "term", F.lit(1.0).alias("credit")), posted, weights, near)


@query("j8_document_scores", "SELECT query, item, score FROM ds", "ds")
def _(t):
    return document_search(t)


@query("k1_sorted_results", """SELECT query, item, place, score FROM (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY n_chars, doc_id) AS place FROM (SELECT *, max(score) OVER (PARTITION BY query) AS b FROM ds) JOIN documents ON doc_id = item WHERE score >= 0.75::DOUBLE * b)""", "ds")
def _(t):
    items = t.read("documents").select(F.col("doc_id").alias("item"), F.col("doc_id").alias("number"), F.col("n_chars").alias("cents"), F.col("n_chars").alias("value"), F.lit(None).cast("date").alias("released"), F.col("source").alias("name"))
    found = S.sort_results(document_search(t, S.STRONG_MATCH), "price-asc", items)
    return found.select("query", "item", F.col("place").cast("long").alias("place"), "score")


#: What each order sorts by; the other keys of documents are made from their lengths and numbers, some of them unknown.
ORDERS = {"match": "score DESC", "popular": "doc_id", "newest": "released DESC NULLS LAST", "oldest": "released ASC NULLS LAST", "price-asc": "cents ASC NULLS LAST",
          "price-desc": "cents DESC NULLS LAST", "value-asc": "doc_id % 9", "value-desc": "doc_id % 9 DESC", "name": "source"}
ORDERED = """WITH i AS (SELECT doc_id, source, CASE WHEN n_chars % 7 > 0 THEN n_chars END AS cents, CASE WHEN n_chars % 5 > 0 THEN DATE '2000-01-01' + CAST(n_chars % 3000 AS INT) END AS released FROM documents)
    SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY {by}, doc_id) AS place, score
    FROM (SELECT *, max(score) OVER (PARTITION BY query) AS b FROM ds) JOIN i ON doc_id = item WHERE {kept} QUALIFY place <= 50"""


def ordered_documents(sort):
    @query(f"k1_by_{sort.replace('-', '_')}", ORDERED.format(by=ORDERS[sort], kept="true" if sort == "match" else "score >= 0.75::DOUBLE * b"), "ds")
    def _(t):
        size, number = F.col("n_chars"), F.col("doc_id")
        items = t.read("documents").select(number.alias("item"), number.alias("number"), F.when(size % 7 > 0, size).alias("cents"), (number % 9).alias("value"),
                                           F.when(size % 5 > 0, F.date_add(F.lit("2000-01-01").cast("date"), (size % 3000).cast("int"))).alias("released"), F.col("source").alias("name"))
        found = S.sort_results(document_search(t, 0.0 if sort == "match" else S.STRONG_MATCH), sort, items, first=50)
        return found.select("query", "item", F.col("place").cast("long").alias("place"), "score")


for each in S.SORTS:
    ordered_documents(each)


@query("n10_name_search", """WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS query FROM part) SELECT query, p_partkey AS item FROM q JOIN part ON contains(p_name, query) OR contains('part ' || lower(p_brand), query)""")
def _(t):
    part = t.read("part")
    names = part.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name")).unionByName(part.select(F.col("p_partkey").alias("item"), F.concat(F.lit("Part "), "p_brand").alias("name")))
    first = F.split("p_name", " ")[0]
    return S.name_search(names, part.select(first.alias("query"), F.upper(first).alias("text")).distinct())


@query("n10_exact_names", "SELECT basket AS query, p_partkey AS item FROM (SELECT basket, min(item) AS item FROM bi GROUP BY basket HAVING count(*) = 1) JOIN part ON p_name = item", "bi")
def _(t):
    names = t.read("part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"))
    return S.exact_names(t.basket_text, names)


@query("f7_spoken_prices", """SELECT p_partkey AS query, CASE p_type WHEN 'ECONOMY' THEN p_size WHEN 'STANDARD' THEN p_size WHEN 'PROMO' THEN p_size WHEN 'SMALL' THEN NULL WHEN 'MEDIUM' THEN NULL ELSE p_size + 0.5 END::DOUBLE AS said,
    CASE p_type WHEN 'ECONOMY' THEN p_size / 2 WHEN 'STANDARD' THEN p_size / 2 WHEN 'PROMO' THEN p_size / 2 WHEN 'SMALL' THEN NULL WHEN 'MEDIUM' THEN 1 ELSE (p_size + 0.5) / 2 END::DOUBLE AS most FROM part""")
def _(t):
    s = F.col("p_size").cast("string")
    kind = F.col("p_type")
    tail = (F.when(kind == "ECONOMY", F.concat(F.lit(" under $"), s)).when(kind == "STANDARD", F.concat(F.lit(" less than "), s, F.lit(" euros")))
            .when(kind == "PROMO", F.concat(F.lit(" €"), s, F.lit(" or less"))).when(kind == "SMALL", F.concat(F.lit(" under "), s, F.lit(" mana")))
            .when(kind == "MEDIUM", F.lit(" on a Budget")).otherwise(F.concat(F.lit(" <= US$"), s, F.lit(".5"))))
    text = F.concat("p_name", tail)
    return t.read("part").select(F.col("p_partkey").alias("query"), spoken_price(text).alias("said"), price_limit(text, 2.0).alias("most"))


SEARCHES = """SELECT DISTINCT term, text FROM (SELECT feature AS term, CASE WHEN feature LIKE 'token:%' THEN 'makes ' || lower(substr(feature, 7)) || ' tokens' ELSE lower(feature) END AS text, count(*) OVER (PARTITION BY feature) AS d FROM ff) JOIN tm USING (term)
    WHERE d >= 15 AND ((term LIKE 'token:%' AND length(term) > 7) OR category IN (2, 3)) UNION SELECT 'tag:' || lower(p_brand), 'brand ' || lower(p_type) FROM part WHERE (SELECT count(*) FROM part q WHERE q.p_brand = part.p_brand) >= 15"""


@query("n15_random_searches", SEARCHES, "ff tm")
def _(t):
    """Tags are named by the types their brand comes in."""
    counted = C.term_counts(C.postings(features(t), terms(t))).join(terms(t), "term")
    names = t.read("part").select(F.concat(F.lit("tag:"), F.lower("p_brand")).alias("term"), F.concat(F.lit("brand-"), "p_type").alias("name")).distinct()
    return S.random_searches(counted, names)


@query("w18_random_search", f"""WITH s AS ({SEARCHES}) SELECT term, text FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY term ORDER BY md5(concat_ws(':', '1', term, text))) = 1)
    ORDER BY md5(concat_ws(':', '1', term)) LIMIT 5""", "ff tm")
def _(t):
    counted = C.term_counts(C.postings(features(t), terms(t))).join(terms(t), "term")
    names = t.read("part").select(F.concat(F.lit("tag:"), F.lower("p_brand")).alias("term"), F.concat(F.lit("brand-"), "p_type").alias("name")).distinct()
    return S.pick_random(S.random_searches(counted, names), seed=1, n=5)


@query("n7_main_terms", "SELECT query, term FROM qg WHERE credit = 1", "qg")
def _(t):
    texts, askers = S.different_texts(t.basket_text)
    return S.for_askers(S.main_terms(groups(t, texts)), askers)


@query("k1_answers", """WITH x AS (SELECT CAST(basket AS VARCHAR) AS query, min(item) AS item FROM bi GROUP BY basket HAVING count(*) = 1), q AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS query FROM part WHERE split_part(p_name, ' ', 1) <> 'small')
    SELECT query, item, NULL::DOUBLE AS score, 'name' AS way FROM x
    UNION ALL SELECT CAST(query AS VARCHAR), substr(term, 5), round(floor(round(credit, 12) * 1000000 + 0.5) / 1000000, 6), 'features' FROM qg WHERE CAST(query AS VARCHAR) NOT IN (SELECT query FROM x)
    UNION ALL SELECT query, p_name, NULL, 'part of a name' FROM q JOIN (SELECT DISTINCT p_name FROM part) ON contains(p_name, query)""", "bi qg")
def _(t):
    """Baskets' texts and the first words of part names. Of those only "small" names a feature, and no part has it."""
    part = t.read("part")
    first = F.split("p_name", " ")[0]
    asked = t.basket_text.select(F.col("query").cast("string").alias("query"), "text").unionByName(part.select(first.alias("query"), F.upper(first).alias("text")).distinct())
    names = part.select(F.col("p_name").alias("item"), F.col("p_name").alias("name")).distinct()
    return S.answer(asked, names, tag_names(t), name_weights(t), tag_names(t).select("term", F.col("name").alias("item")))
