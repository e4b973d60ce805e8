"""Registered trend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerwork.operators import baskets as B
from wickerwork.operators import outcomes as O
from wickerwork.operators import trends as T
from wickerwork.operators.ranking import top_n
from wickerwork.operators.textjoin import contains_join
from wickerwork.plans.bundles import recipe_sums
from wickerwork.plans.registry import query, r6
from wickerwork.plans.tables import CTES, TODAY

SINCE = "DATE '2001-08-02'"
WCOLS = f"count(*) AS ever, count(*) FILTER (made >= {SINCE} - 90) AS w90, count(*) FILTER (made >= {SINCE} - 30) AS w30, count(*) FILTER (made >= {SINCE} - 7) AS w7"
CTES["mw"] = (["bk"], f"SELECT leader, {WCOLS} FROM bk GROUP BY leader")
CTES["wp"] = (["bi", "bk"], f"SELECT leader, item, {WCOLS} FROM bi JOIN bk USING (leader, basket) GROUP BY leader, item")
CTES["tr"] = (["wp", "mw"], """SELECT item, CAST(sum(w30) AS BIGINT) AS now, sum(w30) / (SELECT sum(w30) FROM mw) AS share, sum(ever) / (SELECT sum(ever) FROM mw) AS was,
    (SELECT sum(w30) FROM mw) AS recent FROM wp GROUP BY item HAVING sum(w30) > 0""")


def made(t):
    return T.made_per_window(t.baskets, ["leader"], TODAY)


def plays(t):
    return T.window_plays(t.basket_items, t.baskets, ["leader"], TODAY)


def trends(t):
    return T.item_trends(plays(t), made(t), "w30")


@query("a4_window_plays", "SELECT leader, item, ever, w90, w30, w7 FROM wp UNION ALL SELECT NULL, item, sum(ever)::BIGINT, sum(w90)::BIGINT, sum(w30)::BIGINT, sum(w7)::BIGINT FROM wp GROUP BY item", "wp")
def _(t):
    return T.window_plays_with_total(t.basket_items, t.baskets, TODAY)


@query("j6_window_membership", f"SELECT leader, basket, w FROM bk JOIN (VALUES (90), (30), (7)) v(w) ON made >= {SINCE} - w", "bk")
def _(t):
    return T.membership(t.baskets, TODAY)


@query("a5_kept_items", """SELECT leader, item, wp.ever, wp.w90, wp.w30, wp.w7 FROM wp JOIN mw USING (leader) WHERE wp.ever >= greatest(3, 0.07 * mw.ever) OR wp.w90 >= greatest(3, 0.07 * mw.w90)
    OR wp.w30 >= greatest(3, 0.07 * mw.w30) OR wp.w7 >= greatest(3, 0.07 * mw.w7)""", "wp mw")
def _(t):
    return T.kept_items(plays(t), made(t), ["leader"], share=0.07)


@query("a21_leaders_playing", """SELECT item, leader, wp.ever AS baskets, round(wp.ever / mw.ever, 6) AS share FROM wp JOIN mw USING (leader) WHERE wp.ever >= greatest(3, 0.06 * mw.ever) OR wp.w90 >= greatest(3, 0.06 * mw.w90)
    OR wp.w30 >= greatest(3, 0.06 * mw.w30) OR wp.w7 >= greatest(3, 0.06 * mw.w7)""", "wp mw")
def _(t):
    return T.leaders_playing(T.kept_items(plays(t), made(t), ["leader"], share=0.06), made(t)).withColumn("share", r6(F.col("share")))


@query("a26_item_strategies", """SELECT item, tag, weight, rank FROM (SELECT item, tag, CAST(sum(ever) AS BIGINT) AS weight, row_number() OVER (PARTITION BY item ORDER BY sum(ever) DESC, tag) AS rank
    FROM wp JOIN ts USING (leader) GROUP BY item, tag) WHERE rank <= 12""", "wp ts")
def _(t):
    from wickerwork.plans.baskets import theme_scores
    playing = T.leaders_playing(T.kept_items(plays(t), made(t), ["leader"], share=0.0, least=0), made(t))
    return T.strategies(playing, theme_scores(t).select("leader", "tag")).withColumn("rank", F.col("rank").cast("long"))


@query("j21_leaders_with_item", "SELECT item, leader FROM (SELECT item, leader, row_number() OVER (PARTITION BY item ORDER BY parts > 1, n DESC, leader) AS rn FROM ll JOIN (SELECT leader, count(*) AS parts FROM ll GROUP BY 1) USING (leader) JOIN sz USING (leader)) WHERE rn = 1", "ll sz")
def _(t):
    from wickerwork.plans.baskets import leader_items
    return T.leaders_with(leader_items(t), B.sizes(t.baskets))


@query("f5_leader_filter", """WITH x AS (SELECT nation AS leader, nation & 3 AS identity, count(*) AS ever, count(*) FILTER (made >= DATE '2001-08-02' - 90) AS w90, list_sort(list(bracket))[count(*)//2+1] AS bracket,
    CASE WHEN nation <> 7 THEN CAST(round_even(sum(total) / count(*), 0) AS BIGINT) END AS price FROM bk GROUP BY nation) SELECT leader, identity, price, bracket, w90 FROM x WHERE w90 >= 10 AND identity = 1 AND price IS NOT NULL AND price <= 300000 AND bracket IN (2, 3, 4)""", "bk")
def _(t):
    from wickerwork.operators.ranking import upper_median
    nations = t.baskets.withColumn("leader", F.col("nation"))
    rows = (T.made_per_window(nations, ["leader"], TODAY).join(upper_median(nations, "leader", "bracket", "bracket"), "leader")
            .join(nations.groupBy("leader").agg(F.rint(F.sum("total") / F.count(F.lit(1))).cast("long").alias("_p")), "leader")
            .withColumns({"identity": F.col("leader").bitwiseAND(3), "price": F.when(F.col("leader") != 7, F.col("_p")), "parts": F.lit(1), "themes": F.array(F.lit("x"))}))
    ok = T.leader_filter(identity=1, max_price=300000, brackets=[2, 3, 4], kind="single", themes=["x"], window="w90", least=10)
    return rows.filter(ok).select("leader", "identity", "price", "bracket", "w90")


@query("f6_name_contains", "WITH q AS (SELECT DISTINCT lower(p_brand) AS q, p_brand AS query FROM part) SELECT query, p_partkey FROM q JOIN part ON contains(lower(p_name || ' ' || p_brand), q)")
def _(t):
    texts = t.read("part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("name"))
    queries = t.read("part").select(F.col("p_brand").alias("query"), F.lower("p_brand").alias("q")).distinct()
    return contains_join(texts, queries, "name").select("query", "p_partkey")


@query("t7_rising_leaders", """SELECT nation AS leader, now, round((now - e) / sqrt(e), 6) AS score, round(now / e, 6) AS ratio FROM (SELECT nation, w30 AS now, (SELECT sum(w30) FROM x) * ever / (SELECT sum(ever) FROM x) AS e FROM
    (SELECT nation, count(*) AS ever, count(*) FILTER (made >= DATE '2001-08-02' - 30) AS w30 FROM bk GROUP BY 1) x) WHERE now > e AND now >= 3""".replace("(SELECT sum(w30) FROM x)", "sum(w30) OVER ()").replace("(SELECT sum(ever) FROM x)", "sum(ever) OVER ()"), "bk")
def _(t):
    rows = T.made_per_window(t.baskets.withColumn("leader", F.col("nation")), ["leader"], TODAY)
    return T.trending_leaders(rows, "w30").withColumns({"score": r6(F.col("score")), "ratio": r6(F.col("ratio"))})


@query("t7_popular_leaders", "SELECT leader, w30, ever FROM mw WHERE w30 > 0", "mw")
def _(t):
    return made(t).filter("w30 > 0").orderBy(F.desc("w30"), F.desc("ever"), F.asc("leader")).limit(300).select("leader", "w30", "ever")


@query("t7_item_trends", "SELECT item, now, round(share, 6) AS share, round(was, 6) AS was FROM tr", "tr")
def _(t):
    return trends(t).select("item", "now", r6(F.col("share")).alias("share"), r6(F.col("was")).alias("was"))


@query("t7_rising_items", "SELECT item, now, round(share, 6) AS share, round(was, 6) AS was, round((share - was) / sqrt(was), 6) AS score FROM tr WHERE share > was AND now >= greatest(3, 0.01 * recent)", "tr")
def _(t):
    return T.rising_items(trends(t)).select("item", "now", *[r6(F.col(c)).alias(c) for c in ("share", "was", "score")])


@query("k4_rising_capped", """SELECT item, rank, score FROM (SELECT item, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, item) AS rank FROM (SELECT item, round((share - was) / sqrt(was), 9) AS score FROM tr
    WHERE share > was AND now >= greatest(3, 0.01 * recent))) WHERE rank <= 10""", "tr")
def _(t):
    best = T.rising_items(trends(t)).orderBy(F.desc("score"), F.asc("item")).limit(10).withColumn("_all", F.lit(1))
    ranked = top_n(best, "_all", [F.desc("score"), F.asc("item")], 10)
    return ranked.select("item", F.col("rank").cast("long").alias("rank"), r6(F.col("score")).alias("score"))


@query("t7_rising_recipes", """SELECT recipe AS item, now, round(share, 6) AS share, round(was, 6) AS was FROM (SELECT recipe, count(*) FILTER (made >= DATE '2001-08-02' - 90) AS now,
    count(*) FILTER (made >= DATE '2001-08-02' - 90) / (SELECT sum(w90) FROM mw) AS share, count(*) / (SELECT sum(ever) FROM mw) AS was FROM fr JOIN bk USING (leader, basket) GROUP BY recipe)
    WHERE now > 0 AND share >= 1.1::DOUBLE * was AND now >= greatest(3, 0.002 * (SELECT sum(w90) FROM mw))""", "fr bk mw")
def _(t):
    count = lambda dated: T.made_per_window(dated, ["leader", "set"], TODAY, known=t.baskets)
    counts = recipe_sums(t, t.baskets.select("leader", "basket", "made"), count).withColumnRenamed("recipe", "item")
    found = T.rising_items(T.item_trends(counts, made(t), "w90"), floor=0.002, ratio=1.1)
    return found.select("item", "now", r6(F.col("share")).alias("share"), r6(F.col("was")).alias("was"))


@query("w13_play_rate_by_month", """WITH s AS (SELECT leader, CAST(unnest(generate_series(min(date_trunc('month', made)), max(date_trunc('month', made)), INTERVAL 1 MONTH)) AS DATE) AS month FROM bk GROUP BY leader),
    m AS (SELECT leader, CAST(date_trunc('month', made) AS DATE) AS month, count(*) AS made FROM bk GROUP BY 1, 2), i AS (SELECT leader, item, CAST(date_trunc('month', made) AS DATE) AS month, count(*) AS playing FROM bi JOIN bk USING (leader, basket) GROUP BY 1, 2, 3)
    SELECT leader, item, month, coalesce(made, 0) AS made, coalesce(playing, 0) AS playing FROM (SELECT DISTINCT leader, item FROM i) JOIN s USING (leader) LEFT JOIN m USING (leader, month) LEFT JOIN i USING (leader, item, month)""", "bi bk")
def _(t):
    return T.play_rate_by_month(t.basket_items, t.baskets)


CTES["rl"] = (["ln"], "SELECT item, min(made) + CAST(min(p_size) * 50 AS INT) AS released FROM ln GROUP BY item")


@query("f11_new_items", "SELECT item, now, released FROM tr JOIN (SELECT p_name AS item, DATE '2001-08-02' - CAST(min(p_size) * 40 AS INT) AS released FROM part GROUP BY 1) USING (item) WHERE released >= DATE '2001-08-02' - 120", "tr")
def _(t):
    """An item's release here: 40 days back for every size of its smallest part."""
    released = t.read("part").groupBy(F.col("p_name").alias("item")).agg(F.expr(f"date_sub(date'{TODAY}', cast(min(p_size) * 40 as int))").alias("released"))
    return T.new_items(trends(t), released, TODAY).select("item", "now", "released")


# Each item's cheapest price now and a look-back ago: its cheapest shipped line in the last days of each.
CTES["px"] = (["sh"], """SELECT item, min(cents) FILTER (day > DATE '2001-08-02' - 30 AND day <= DATE '2001-08-02') AS now, min(cents) FILTER (day > DATE '2001-08-02' - 60 AND day <= DATE '2001-08-02' - 30) AS then FROM sh GROUP BY item""")


def item_prices(t):
    low = lambda a, b: F.min(F.when((F.col("day") > F.date_sub(F.lit(TODAY).cast("date"), a)) & (F.col("day") <= F.date_sub(F.lit(TODAY).cast("date"), b)), F.col("cents")))
    return t.shipped.groupBy("item").agg(low(30, 0).alias("now"), low(60, 30).alias("then"))


@query("t8_spec_buys", """SELECT item, price, px.then AS then, round(share / was, 6) AS times FROM (SELECT item, now AS price, px.then FROM px) px JOIN tr USING (item) WHERE share >= 0.003 AND share >= 1.0 * was AND abs(price / px.then - 1) < 0.9""", "px tr")
def _(t):
    found = T.spec_buys(trends(t), item_prices(t), played=1.0, flat=0.9)
    return found.select("item", "price", "then", r6(F.col("times")).alias("times"))


@query("t9_buyouts", "SELECT item, price, px.then AS then, round(price / px.then, 6) AS ratio FROM (SELECT item, now AS price, px.then FROM px) px LEFT JOIN tr USING (item) WHERE price / px.then >= 1.3 AND (share IS NULL OR share < 1.15 * was)", "px tr")
def _(t):
    return T.buyouts(trends(t), item_prices(t)).select("item", "price", "then", r6(F.col("ratio")).alias("ratio"))


@query("t10_outcome_spikes", """SELECT item, a.baskets, round(a.baskets / f.baskets, 6) AS share, round(b.baskets / g.baskets, 6) AS was, px.now AS price FROM (SELECT item, sum(baskets)::BIGINT AS baskets FROM ia WHERE w = 90 GROUP BY 1) a
    JOIN (SELECT item, sum(baskets) AS baskets FROM ia WHERE w = 365 GROUP BY 1) b USING (item) JOIN px USING (item) JOIN ft f ON f.w = 90 JOIN ft g ON g.w = 365 WHERE a.baskets >= 30 AND a.baskets / f.baskets >= 1.05 * (b.baskets / g.baskets) AND px.now IS NOT NULL""", "ia ft px")
def _(t):
    field = O.totals(t.entries, [], TODAY)
    counts = O.totals(O.played_items(t.entries, t.entry_items), ["item"], TODAY)
    found = T.outcome_spikes(counts, field, item_prices(t), played=1.05)
    return found.select("item", "baskets", r6(F.col("share")).alias("share"), r6(F.col("was")).alias("was"), "price")
