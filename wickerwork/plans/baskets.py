"""Registered basket queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerwork.operators import baskets as B
from wickerwork.operators import windows as wins
from wickerwork.operators.ranking import top_n
from wickerwork.operators.setjoin import similar_sets
from wickerwork.plans.registry import query, r6
from wickerwork.plans.tables import CTES, TODAY, Tables

# The fullest basket of each leader is the query basket.
CTES["fq"] = (["bi"], """SELECT bi.basket AS query, bi.leader, bi.item FROM bi JOIN (SELECT leader, basket,
    row_number() OVER (PARTITION BY leader ORDER BY count(*) DESC, basket) AS rn FROM bi GROUP BY leader, basket) t
    ON bi.basket = t.basket WHERE rn = 1""")
CTES["wt"] = (["pl", "sz"], """SELECT leader, item, plays, n, pow(ln(n / greatest(plays, 1)), 2) AS weight
    FROM pl JOIN sz USING (leader)""")
CTES["sm"] = (["fq", "wt", "bi"], """SELECT query, leader, basket, round(CASE WHEN dot > 0 THEN dot / sqrt(norm * theirs) ELSE 0.0 END, 9)
    AS similarity, shared FROM (SELECT fq.query, bi.leader, bi.basket, sum(weight) AS dot, count(*) AS shared
      FROM bi JOIN fq USING (leader, item) JOIN wt USING (leader, item) GROUP BY ALL)
    JOIN (SELECT leader, basket, sum(weight) AS theirs FROM bi JOIN wt USING (leader, item) GROUP BY ALL) USING (leader, basket)
    JOIN (SELECT query, sum(weight) AS norm FROM fq JOIN wt USING (leader, item) GROUP BY ALL) USING (query)""")
CTES["nb"] = (["sm"], """SELECT * FROM (SELECT *, row_number() OVER w AS rank, max(similarity) OVER (PARTITION BY query) AS best
    FROM sm WHERE similarity > 0 WINDOW w AS (PARTITION BY query ORDER BY similarity DESC, shared DESC, basket))
    WHERE rank <= 100 AND (rank <= 10 OR similarity >= 0.3 * best)""")
CTES["vt"] = (["nb", "bi"], """SELECT query, leader, item, sum(similarity) / any_value(total) AS share,
    count(*) AS baskets FROM nb JOIN bi USING (leader, basket) JOIN (SELECT query, sum(similarity) AS total FROM nb GROUP BY 1) USING (query)
    GROUP BY query, leader, item""")


def items_once(t: Tables):
    """The items of baskets, for plans that read them again and again."""
    return t.once("basket-items", lambda: t.basket_items)


def full_queries(t: Tables):
    counted = items_once(t).groupBy("leader", "basket").agg(F.count(F.lit(1)).alias("k"))
    picked = top_n(counted, "leader", [F.desc("k"), F.asc("basket")], 1).select("leader", "basket")
    return items_once(t).join(picked, ["leader", "basket"]).select(F.col("basket").alias("query"), "leader", "item")


def pool(t: Tables):
    return B.play_counts(t.basket_items), B.sizes(t.baskets)


def similar(t: Tables):
    items = items_once(t)
    return B.similarity(full_queries(t), items, B.play_counts(items), B.sizes(t.baskets))


def voted(t: Tables):
    return B.votes(B.neighbours(similar(t)), items_once(t))


@query("a3_play_counts", """SELECT leader, item, plays, CAST(sum(plays) OVER (PARTITION BY item) AS BIGINT) AS everywhere FROM pl""", "pl")
def _(t):
    plays = B.play_counts(t.basket_items)
    everywhere = plays.groupBy("item").agg(F.sum("plays").alias("everywhere"))
    return plays.join(everywhere, "item").select("leader", "item", "plays", "everywhere")


@query("b1_item_weights", "SELECT leader, item, round(weight, 6) AS weight FROM wt", "wt")
def _(t):
    return B.item_weights(*pool(t)).select("leader", "item", r6(F.col("weight")).alias("weight"))


@query("b2_similar_baskets", "SELECT query, leader, basket, round(similarity, 6) AS similarity, shared FROM sm", "sm")
def _(t):
    return similar(t).withColumn("similarity", r6(F.col("similarity")))


@query("b4_neighbours", "SELECT query, basket, rank, round(similarity, 6) AS similarity FROM nb", "nb")
def _(t):
    return B.neighbours(similar(t)).select("query", "basket", F.col("rank").cast("long").alias("rank"), r6(F.col("similarity")).alias("similarity"))


@query("b4_recommend_adds", """SELECT query, leader, item, round(share, 6) AS share, baskets, round(score, 6) AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM (
    SELECT query, leader, item, share, baskets, round(share - 0.5::DOUBLE * plays / n, 9) AS score FROM vt ANTI JOIN fq USING (query, item)
    JOIN wt USING (leader, item))) WHERE rank <= 20""", "vt fq wt")
def _(t):
    adds = B.recommend_adds(voted(t), full_queries(t), B.play_counts(items_once(t)), B.sizes(t.baskets))
    return (top_n(adds, "query", [F.desc("score"), F.asc("item")], 20)
            .select("query", "leader", "item", r6(F.col("share")).alias("share"), "baskets", r6(F.col("score")).alias("score"),
                    F.col("rank").cast("long").alias("rank")))


@query("b4_recommend_cuts", """SELECT query, leader, item, round(coalesce(share, 0.0), 6) AS share FROM fq LEFT JOIN vt USING (query, leader, item)""", "vt fq")
def _(t):
    return B.recommend_cuts(voted(t), full_queries(t)).withColumn("share", r6(F.col("share")))


@query("b5_shown_cuts", """SELECT query, item, rank, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY share, item) AS rank
    FROM (SELECT query, item, round(coalesce(share, 0.0), 9) AS share FROM fq LEFT JOIN vt USING (query, leader, item)) WHERE share < 0.3) WHERE rank <= 16""", "vt fq")
def _(t):
    cuts = B.recommend_cuts(voted(t), full_queries(t))
    return B.shown_cuts(cuts, below=0.3).select("query", "item", F.col("rank").cast("long").alias("rank"), r6(F.col("share")).alias("share"))


@query("b3_fold_copies")
def _(t):
    return B.fold_copies(similar(t), items_once(t), limit=3, alike=0.75)


@query("b3_copy_overlap", """SELECT query, basket, round(shared / (q.k + b.k - shared), 6) AS jaccard FROM sm
    JOIN (SELECT query, count(*) AS k FROM fq GROUP BY ALL) q USING (query) JOIN (SELECT basket, count(*) AS k FROM bi GROUP BY ALL) b USING (basket)""", "sm")
def _(t):
    both = similar(t).select(F.col("query").alias("a"), F.col("basket").alias("b"))
    found = B.jaccard(both, full_queries(t).select(F.col("query").alias("basket"), "item"), items_once(t).select("basket", "item"))
    return found.select(F.col("a").alias("query"), F.col("b").alias("basket"), r6(F.col("jaccard")).alias("jaccard"))


@query("u4_document_jaccard", """WITH w AS (SELECT DISTINCT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-zà-ÿ]+'))) AS word FROM documents),
    s AS (SELECT doc_id, list_sort(list(word)) AS ws FROM w GROUP BY doc_id), r AS (SELECT doc_id, ws, min(doc_id) OVER (PARTITION BY ws) AS rep FROM s),
    k AS (SELECT rep, len(ws) AS n FROM r WHERE doc_id = rep), v AS (SELECT rep, word FROM w JOIN r USING (doc_id) WHERE doc_id = rep),
    p AS (SELECT x.rep AS a, y.rep AS b, count(*) AS shared FROM v x JOIN v y ON x.word = y.word AND x.rep < y.rep GROUP BY ALL)
    SELECT a, b, shared, round(shared / (ka.n + kb.n - shared), 6) AS jaccard FROM p JOIN k ka ON a = ka.rep JOIN k kb ON b = kb.rep WHERE shared >= 0.8 * (ka.n + kb.n - shared)
    UNION ALL SELECT rep, doc_id, len(ws), 1.0 FROM r WHERE doc_id <> rep""")
def _(t):
    """Near-copies among documents, by the words they use: pairs of the first documents of each word set, and every other
    document beside the first of its set."""
    words = (t.read("documents").select(F.col("doc_id").alias("basket"), F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"), F.lit(1)))).alias("item")))
    return similar_sets(words, 0.8).select("a", "b", "shared", r6(F.col("jaccard")).alias("jaccard"))


@query("a6_typical_price_bracket", """SELECT leader, list_sort(list(cents))[count(*)//2+1] AS price, list_sort(list(bracket))[count(*)//2+1] AS bracket FROM (
    SELECT bk.leader, bk.basket, any_value(bracket) AS bracket, CAST(round_even(coalesce(sum(it.cents * bi.copies), 0), 0) AS BIGINT) AS cents
    FROM bk LEFT JOIN bi USING (basket) LEFT JOIN it USING (item) GROUP BY ALL) GROUP BY leader""", "bk bi it")
def _(t):
    priced = B.basket_prices(t.basket_items, t.items)
    priced = t.baskets.select("leader", "basket").join(priced, ["leader", "basket"], "left").fillna(0, ["cents"])
    n = B.sizes(t.baskets).select("leader")
    price = B.typical(priced, "cents", -1, n).withColumnRenamed("median", "price")
    return price.join(B.typical(t.baskets, "bracket", 0, n).withColumnRenamed("median", "bracket"), "leader")


@query("a7_months_made", """SELECT m.leader, CAST(month AS DATE) AS month, count(basket) AS made FROM (
    SELECT leader, unnest(generate_series(min(date_trunc('month', made)), max(date_trunc('month', made)), INTERVAL 1 MONTH)) AS month FROM bk GROUP BY leader)
    m LEFT JOIN bk ON bk.leader = m.leader AND date_trunc('month', made) = month GROUP BY ALL""", "bk")
def _(t):
    return wins.month_counts(t.baskets, ["leader"], "made")


@query("a8_signature", """SELECT leader, item, rank, round(lift, 6) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY lift DESC, item) AS rank FROM (
    SELECT leader, item, round(plays / n - sum(plays) OVER (PARTITION BY item) / (SELECT sum(n) FROM sz), 9) AS lift FROM wt)) WHERE rank <= 24""", "wt sz")
def _(t):
    return B.signature(*pool(t), count=24).select("leader", "item", F.col("rank").cast("long").alias("rank"), r6(F.col("lift")).alias("lift"))


@query("a9_staples", "SELECT item, count(*) AS plays FROM bi GROUP BY item HAVING count(*) >= 0.05 * (SELECT count(*) FROM bk)", "bi bk")
def _(t):
    return B.staples(t.basket_items, t.baskets.agg(F.count(F.lit(1)).alias("n")))


@query("a10_usual_tag_plays", "SELECT tag, round(count(*) / (SELECT count(*) FROM bk), 6) AS usual FROM bi JOIN tg USING (item) GROUP BY tag", "bi bk tg")
def _(t):
    found = B.usual_tag_plays(t.basket_items, t.item_tags, t.baskets.agg(F.count(F.lit(1)).alias("n")))
    return found.withColumn("usual", r6(F.col("usual")))


@query("a10_leader_tags", """SELECT leader, tag, item FROM (SELECT *, count(*) OVER (PARTITION BY leader, tag) AS k FROM wt JOIN tg USING (item)
    ANTI JOIN (SELECT item FROM it WHERE kind = 'PROMO') USING (item) WHERE n >= 100 AND plays >= greatest(2, 0.02 * n)) WHERE k >= 2""", "wt tg it")
def _(t):
    lands = t.items.filter("kind = 'PROMO'").select("item")
    return B.leader_tags(*pool(t), t.item_tags, lands)


@query("a11_first_set_items", """WITH s AS (SELECT p_brand AS set, min(p_retailprice) AS released FROM part GROUP BY 1), x AS (SELECT DISTINCT p_name AS item, p_brand AS set FROM part),
    l AS (SELECT leader, item FROM (SELECT leader, item, row_number() OVER (PARTITION BY leader ORDER BY plays DESC, item) AS rn FROM pl) WHERE rn = 1),
    o AS (SELECT leader, set FROM (SELECT leader, set, row_number() OVER (PARTITION BY leader ORDER BY released, set) AS rn FROM l JOIN x USING (item) JOIN s USING (set)
      WHERE CAST(substr(set, 7) AS INT) <= 20) WHERE rn = 1) SELECT DISTINCT leader, item FROM o JOIN x USING (set)""", "pl")
def _(t):
    part = t.read("part").select(F.col("p_name").alias("item"), F.col("p_brand").alias("set"), "p_retailprice")
    sets = part.groupBy("set").agg(F.min("p_retailprice").alias("released")).withColumn(
        "set_type", F.when(F.substring("set", 7, 9).cast("int") <= 20, "leader").otherwise("other"))
    leaders = top_n(B.play_counts(t.basket_items), "leader", [F.desc("plays"), F.asc("item")], 1).select("leader", "item")
    return B.first_set_items(leaders, part.select("item", "set").distinct(), sets, "leader")


@query("w2_newest_baskets", """SELECT leader, basket, rank FROM (SELECT leader, basket, row_number() OVER (PARTITION BY leader ORDER BY updated DESC, CAST(basket AS VARCHAR) DESC) AS rank
    FROM bk JOIN (SELECT l_orderkey AS basket, max(CAST(l_shipdate AS DATE)) AS updated FROM lineitem GROUP BY 1) USING (basket)) WHERE rank <= 1500""", "bk")
def _(t):
    updated = t.read("lineitem").groupBy(F.col("l_orderkey").alias("basket")).agg(F.max(F.to_date("l_shipdate")).alias("updated"))
    return B.newest(t.baskets.join(updated, "basket"), 1500).select("leader", "basket", F.col("rank").cast("long").alias("rank"))


@query("j4_made_as_of_number", """WITH b AS (SELECT basket AS id, CASE WHEN status <> 'O' THEN made END AS created, status = 'P' AS removed FROM bk)
    SELECT b.id, coalesce(b.created, a.created) AS made FROM b ASOF LEFT JOIN (SELECT * FROM b WHERE created IS NOT NULL AND NOT removed) a ON b.id >= a.id""", "bk")
def _(t):
    """Open orders have no date of their own; dates of pending ones do not count for others."""
    log = t.baskets.select(F.col("basket").alias("id"), "basket", F.when(F.col("status") != "O", F.col("made")).alias("created"),
                           F.when(F.col("status") == "P", F.col("made")).alias("removed"))
    return B.made_dates(log, width=500).select("id", "made")


@query("f9_normalised_baskets", """SELECT DISTINCT bk.leader, bk.basket, bi.item FROM bk JOIN bi USING (basket) JOIN it USING (item)
    JOIN (SELECT basket, min(item) AS lead FROM bi GROUP BY 1) USING (basket)
    WHERE status <> 'P' AND it.kind NOT IN ('PROMO', 'SMALL') AND bi.item <> lead""", "bk bi it")
def _(t):
    """Promo items count as basic, small ones as banned, pending orders as removed, a basket's first item leads it."""
    baskets = t.baskets.withColumn("removed", F.when(F.col("status") == "P", F.col("made")))
    leaders = t.basket_items.groupBy("basket").agg(F.min("item").alias("item"))
    kind = lambda k: t.items.filter(F.col("kind") == k).select("item")
    return B.normalise_baskets(baskets, t.basket_items, leaders, t.items.select("item"), kind("PROMO"), kind("SMALL"))


@query("b7_distinctive_items", """SELECT leader, grp, item, rank, round(lift, 6) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY leader, grp ORDER BY lift DESC, item) AS rank FROM (
    SELECT leader, grp, item, round(here / members - plays / n, 9) AS lift FROM (SELECT leader, bracket AS grp, item, count(*) AS here FROM bi JOIN bk USING (leader, basket) GROUP BY ALL)
    JOIN (SELECT leader, bracket AS grp, count(*) AS members FROM bk GROUP BY ALL) USING (leader, grp) JOIN wt USING (leader, item))) WHERE rank <= 12""", "bi bk wt")
def _(t):
    grouped = t.basket_items.join(t.baskets.select("basket", F.col("bracket").alias("grp")), "basket")
    members = t.baskets.groupBy("leader", F.col("bracket").alias("grp")).agg(F.count(F.lit(1)).alias("members"))
    return B.distinctive(grouped, *pool(t), members).select("leader", "grp", "item", F.col("rank").cast("long").alias("rank"), r6(F.col("lift")).alias("lift"))


CTES["ts"] = (["bi", "bk", "pl", "sz", "tg"], """SELECT leader, tag, more, round(more / sqrt(usual + 1), 9) AS score FROM (SELECT leader, tag, usual,
    round(sum(plays) / any_value(n) - usual, 9) AS more FROM pl JOIN tg USING (item) JOIN sz USING (leader)
    JOIN (SELECT tag, count(*) / (SELECT count(*) FROM bk) AS usual FROM bi JOIN tg USING (item) GROUP BY tag) USING (tag) GROUP BY leader, tag, usual) WHERE more >= 0.001""")


def theme_scores(t):
    plays, n = pool(t)
    usual = B.usual_tag_plays(t.basket_items, t.item_tags, t.baskets.agg(F.count(F.lit(1)).alias("n")))
    return B.tag_scores(plays, n.withColumnRenamed("n", "members"), usual, t.item_tags, ["leader"], least=0.001)


@query("b9_theme_scores", "SELECT leader, tag, round(more, 6) AS more, round(score, 6) AS score FROM ts", "ts")
def _(t):
    return theme_scores(t).select("leader", "tag", r6(F.col("more")).alias("more"), r6(F.col("score")).alias("score"))


@query("b9_leader_themes")
def _(t):
    tag_items = B.play_counts(t.basket_items).join(t.item_tags, "item").select("leader", "tag", "item")
    return B.pick_tags(theme_scores(t), tag_items, ["leader"], count=6)


@query("b8_group_tag_scores", """WITH u AS (SELECT leader, tag, sum(plays) / any_value(n) AS usual FROM pl JOIN tg USING (item) JOIN sz USING (leader) GROUP BY ALL)
    SELECT leader, grp, tag, round(more, 6) AS more, round(more / sqrt(usual + 1), 6) AS score FROM (SELECT leader, grp, tag, usual, round(count(*) / members - usual, 9) AS more
    FROM (SELECT leader, bracket AS grp, item FROM bi JOIN bk USING (leader, basket)) JOIN tg USING (item) JOIN u USING (leader, tag)
    JOIN (SELECT leader, bracket AS grp, count(*) AS members FROM bk GROUP BY ALL) USING (leader, grp) GROUP BY leader, grp, tag, usual, members) WHERE more >= 0.001""", "bi bk pl sz tg")
def _(t):
    return group_tag_scores(t).select("leader", "grp", "tag", r6(F.col("more")).alias("more"), r6(F.col("score")).alias("score"))


def group_tag_scores(t):
    plays, n = pool(t)
    usual = (plays.join(t.item_tags, "item").groupBy("leader", "tag").agg(F.sum("plays").alias("k")).join(n, "leader")
             .select("leader", "tag", (F.col("k") / F.col("n")).alias("usual")))
    grouped = t.basket_items.join(t.baskets.select("basket", F.col("bracket").alias("grp")), "basket")
    members = t.baskets.groupBy("leader", F.col("bracket").alias("grp")).agg(F.count(F.lit(1)).alias("members"))
    here = B.play_counts(grouped, ["leader", "grp"])
    return B.tag_scores(here, members, usual, t.item_tags, ["leader", "grp"], ["leader"], least=0.001)


@query("b8_group_tags")
def _(t):
    grouped = t.basket_items.join(t.baskets.select("basket", F.col("bracket").alias("grp")), "basket")
    tag_items = grouped.join(t.item_tags, "item").select("leader", "grp", "tag", "item").distinct()
    return B.pick_tags(group_tag_scores(t), tag_items, ["leader", "grp"], count=3)


@query("b10_average_basket", """SELECT leader, land, item, rank FROM (SELECT *, row_number() OVER (PARTITION BY leader, land ORDER BY plays DESC, item) AS rank,
    floor(sum(plays) OVER (PARTITION BY leader, land) / n + 0.5) AS wanted FROM (SELECT *, kind = 'PROMO' AS land FROM wt JOIN it USING (item))) WHERE rank <= wanted""", "wt it")
def _(t):
    lands = t.items.filter("kind = 'PROMO'").select("item")
    members = B.sizes(t.baskets).withColumnRenamed("n", "members")
    return B.average_basket(t.basket_items, members, lands).withColumn("rank", F.col("rank").cast("long"))


@query("b10_basic_fill", """WITH a AS (SELECT leader, count(*) AS held FROM (SELECT leader, row_number() OVER (PARTITION BY leader, land ORDER BY plays DESC, item) AS rank,
    floor(sum(plays) OVER (PARTITION BY leader, land) / n + 0.5) AS wanted FROM (SELECT *, kind = 'PROMO' AS land FROM wt JOIN it USING (item))) WHERE rank <= wanted GROUP BY 1),
    k AS (SELECT leader, bracket AS kind, bracket - 1 AS pos, count(*) OVER (PARTITION BY leader) AS kinds FROM bk GROUP BY leader, bracket)
    SELECT leader, kind, copies FROM (SELECT leader, kind, (99 - held) // kinds + CASE WHEN pos < (99 - held) % kinds THEN 1 ELSE 0 END AS copies FROM a JOIN k USING (leader)) WHERE copies > 0""", "wt it bk")
def _(t):
    lands = t.items.filter("kind = 'PROMO'").select("item")
    averaged = B.average_basket(t.basket_items, B.sizes(t.baskets).withColumnRenamed("n", "members"), lands)
    kinds = t.baskets.select("leader", F.col("bracket").alias("kind"), (F.col("bracket") - 1).alias("pos")).distinct()
    return B.basic_fill(averaged, kinds)


@query("b15_played_differently", """WITH g AS (SELECT leader, item, count(*) FILTER (bracket = 5) AS ka, count(*) FILTER (bracket = 1) AS kb FROM bi JOIN bk USING (leader, basket)
    WHERE bracket IN (1, 5) GROUP BY ALL), m AS (SELECT leader, count(*) FILTER (bracket = 5) AS na, count(*) FILTER (bracket = 1) AS nb FROM bk GROUP BY 1),
    r AS (SELECT leader, item, ka / na AS a, kb / nb AS b, round(kb / nb - ka / na, 9) AS gap, (ka + kb) / (na + nb) AS p, na, nb FROM g JOIN m USING (leader))
    SELECT leader, direction, item, rank, round(a, 6) AS a, round(b, 6) AS b, round(evidence, 6) AS evidence FROM (SELECT *,
    row_number() OVER (PARTITION BY leader, direction ORDER BY abs(gap) DESC, item) AS rank FROM (SELECT *, CASE WHEN gap > 0 THEN 'more' ELSE 'less' END AS direction,
    (b - a) / sqrt(p * (1 - p) * (1 / na + 1 / nb)) AS evidence FROM r WHERE greatest(a, b) >= 0.05 AND gap <> 0)) WHERE rank <= 6""", "bi bk")
def _(t):
    side = t.baskets.filter("bracket in (1, 5)").select("leader", "basket", F.col("bracket").alias("side"))
    grouped = t.basket_items.join(side, ["leader", "basket"])
    members = side.groupBy("leader", "side").agg(F.count(F.lit(1)).alias("members"))
    found = B.played_differently(grouped, members, ["leader"], 5, 1, least=0.05)
    return found.select("leader", "direction", "item", F.col("rank").cast("long").alias("rank"), *[r6(F.col(c)).alias(c) for c in ("a", "b", "evidence")])


CTES["ll"] = (["pl"], """SELECT leader, item FROM (SELECT leader, item, row_number() OVER (PARTITION BY leader ORDER BY plays, item) AS rn FROM pl)
    WHERE rn <= CASE WHEN leader < 'F' THEN 1 ELSE 2 END""")


def leader_items(t):
    """Stand-ins for a leader's own items: its one or two least played."""
    ranked = top_n(B.play_counts(t.basket_items), "leader", [F.asc("plays"), F.asc("item")], 2)
    return ranked.filter((F.col("rank") == 1) | (F.col("leader") >= "F")).select("leader", "item")


@query("b27_guess_leader", """SELECT query, guess FROM (SELECT basket AS query, l.leader AS guess, row_number() OVER (PARTITION BY basket ORDER BY parts > 1 DESC, n DESC, l.leader) AS rn
    FROM bi JOIN ll l USING (item) JOIN (SELECT leader, count(*) AS parts FROM ll GROUP BY 1) s ON s.leader = l.leader JOIN sz ON sz.leader = l.leader
    GROUP BY basket, l.leader, parts, n HAVING count(DISTINCT item) = parts) WHERE rn = 1""", "bi ll sz")
def _(t):
    return B.guess_leader(t.basket_items.select(F.col("basket").alias("query"), "item"), leader_items(t), B.sizes(t.baskets))


CTES["sg"] = (["wt", "sz"], """SELECT leader, item FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY lift DESC, item) AS rank FROM (
    SELECT leader, item, round(plays / n - sum(plays) OVER (PARTITION BY item) / (SELECT sum(n) FROM sz), 9) AS lift FROM wt)) WHERE rank <= 24""")
CTES["cl"] = (["bi", "sg", "sz"], """SELECT query, leader, overlap, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY overlap DESC, n DESC, leader) AS rank FROM (
    SELECT bi.basket AS query, sg.leader, count(*) AS overlap, any_value(n) AS n FROM bi JOIN sg USING (item) JOIN sz ON sz.leader = sg.leader GROUP BY 1, 2))""")


@query("k7_closest_leaders", "SELECT query, leader, overlap, rank FROM cl WHERE rank <= 2", "cl")
def _(t):
    plays, n = pool(t)
    mine = t.basket_items.select(F.col("basket").alias("query"), "item")
    return B.closest_leaders(mine, B.signature(plays, n, 24), n, 2).select("query", "leader", "overlap", F.col("rank").cast("long").alias("rank"))


@query("b27_leader_to_compare", """WITH g AS (SELECT query, guess FROM (SELECT basket AS query, l.leader AS guess, row_number() OVER (PARTITION BY basket ORDER BY parts > 1 DESC, n DESC, l.leader) AS rn
    FROM bi JOIN ll l USING (item) JOIN (SELECT leader, count(*) AS parts FROM ll GROUP BY 1) s ON s.leader = l.leader JOIN sz ON sz.leader = l.leader
    GROUP BY basket, l.leader, parts, n HAVING count(DISTINCT item) = parts) WHERE rn = 1)
    SELECT basket AS query, CASE WHEN status = 'F' THEN leader ELSE coalesce(guess, closest) END AS leader FROM bk LEFT JOIN g ON query = basket
    LEFT JOIN (SELECT query AS q, leader AS closest FROM cl WHERE rank = 1) ON q = basket""", "bk bi ll sz cl")
def _(t):
    """Finished orders name their leader; the others are guessed from what they hold."""
    plays, n = pool(t)
    mine = t.basket_items.select(F.col("basket").alias("query"), "item")
    closest = B.closest_leaders(mine, B.signature(plays, n, 24), n, 1).select("query", F.col("leader").alias("closest"))
    candidates = (t.baskets.select(F.col("basket").alias("query"), F.when(F.col("status") == "F", F.col("leader")).alias("own"))
                  .join(B.guess_leader(mine, leader_items(t), n), "query", "left").join(closest, "query", "left"))
    return B.leader_of(candidates, n)


@query("b28_evaluation")
def _(t):
    return B.evaluate(t.customer_baskets, t.customer_items, hidden=5, queries_per_leader=10)


@query("j18_basket_difference", """WITH av AS (SELECT leader, item FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY plays DESC, item) AS r FROM pl) WHERE r <= 4)
    SELECT basket AS query, item, 'cut' AS side FROM bi ANTI JOIN av USING (leader, item)
    UNION ALL SELECT basket, item, 'add' FROM (SELECT DISTINCT basket, leader FROM bi) JOIN av USING (leader) ANTI JOIN bi USING (basket, item)""", "pl bi")
def _(t):
    usual = top_n(B.play_counts(t.basket_items), "leader", [F.desc("plays"), F.asc("item")], 4).select("leader", "item")
    mine = t.basket_items.select(F.col("basket").alias("query"), "item")
    theirs = t.basket_items.select("leader", F.col("basket").alias("query")).distinct().join(usual, "leader").select("query", "item")
    return B.symmetric_difference(mine, theirs)


@query("j13_not_in_basket", """SELECT fq.query, pl.item, pl.plays FROM (SELECT DISTINCT query, leader FROM fq) fq JOIN pl USING (leader) ANTI JOIN fq f2 ON f2.query = fq.query AND f2.item = pl.item""", "fq pl")
def _(t):
    q = full_queries(t)
    return (q.select("query", "leader").distinct().join(B.play_counts(t.basket_items), "leader")
            .join(q.select("query", "item"), ["query", "item"], "left_anti").select("query", "item", "plays"))


@query("f10_within_colors", """WITH m AS (SELECT item, CAST(value & 31 AS BIGINT) AS identity FROM it), c AS (SELECT basket, bit_or(identity) AS colors FROM (SELECT basket, identity,
    row_number() OVER (PARTITION BY basket ORDER BY item) AS r FROM bi JOIN m USING (item)) WHERE r <= 2 GROUP BY 1)
    SELECT basket, item FROM bi JOIN m USING (item) JOIN c USING (basket) WHERE identity & ~colors = 0""", "bi it")
def _(t):
    """An item's identity is the low bits of its size; a basket's colours those of its first two items."""
    masks = t.once("masks", lambda: t.items.select("item", F.col("value").bitwiseAND(31).alias("identity")))
    held = t.lines.select("basket", "item").join(masks, "item").groupBy("basket").agg(F.array_sort(F.collect_set(F.struct("item", "identity"))).alias("held"))
    colors = F.aggregate(F.slice("held", 1, 2), F.lit(0).cast("long"), lambda c, x: c.bitwiseOR(x["identity"]))
    rows = held.select("basket", colors.alias("colors"), F.explode("held").alias("_i")).select("basket", "colors", "_i.*")
    return B.within_colors(rows, F.col("identity"), F.col("colors")).select("basket", "item")


@query("w18_random_niche", """SELECT leader, item, plays / n AS share FROM pl JOIN sz USING (leader) WHERE abs(plays / n - 0.15::DOUBLE) <= 0.1::DOUBLE
    QUALIFY row_number() OVER (PARTITION BY leader ORDER BY md5(concat_ws(':', '1', leader, item))) = 1""", "pl sz")
def _(t):
    plays, n = pool(t)
    return B.random_niche(plays.join(n, "leader").select("leader", "item", (F.col("plays") / F.col("n")).alias("share")), seed=1)
