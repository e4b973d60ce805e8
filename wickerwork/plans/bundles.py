"""Registered queries on pairs, bundles, recipes and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerwork.operators import baskets as B
from wickerwork.operators import bundles as bundle_ops
from wickerwork.operators import clusters, graphs, outcomes, pairs, recipes, windows
from wickerwork.operators.ranking import fifths, number_rows, top_n
from wickerwork.plans.registry import query, r6
from wickerwork.plans.tables import CTES, TODAY

CTES["cp"] = (["ci"], "SELECT leader, item, count(*) AS plays FROM ci GROUP BY ALL")
CTES["cn"] = ([], "SELECT c_mktsegment AS leader, count(*) AS n FROM customer GROUP BY 1")
CTES["cc"] = (["ci"], """SELECT x.leader, x.item AS a, y.item AS b, count(*) AS k FROM ci x JOIN ci y ON x.basket = y.basket AND x.item < y.item GROUP BY ALL""")
CTES["c2"] = (["cc", "cp", "cn"], """SELECT cc.leader, cc.a, cc.b, cc.k, p.plays AS pa, q.plays AS pb, n FROM (SELECT * FROM cc UNION ALL SELECT leader, b, a, k FROM cc) cc
    JOIN cp p ON p.leader = cc.leader AND p.item = cc.a JOIN cp q ON q.leader = cc.leader AND q.item = cc.b JOIN cn ON cn.leader = cc.leader""")
PHI = "(k * n - pa * pb) / sqrt(pa::DOUBLE * (n - pa) * pb * (n - pb))"
CTES["bs"] = (["cp"], """SELECT leader, split_part(item, ' ', 1) AS bundle, item FROM cp
    QUALIFY row_number() OVER (PARTITION BY leader, split_part(item, ' ', 1) ORDER BY item) <= 3""")
CTES["cv"] = (["ci", "bs"], """SELECT leader, basket, bundle, count(*) AS held, 3 AS size FROM ci JOIN bs USING (leader, item) GROUP BY ALL""")
CTES["rn"] = (["cv"], "SELECT leader, bundle, basket FROM cv WHERE held = size")
# A recipe is a part with the next one, and for large parts the one after.
CTES["ri"] = ([], """SELECT p.p_partkey AS recipe, q.p_name AS item, bool_or(p.p_size > 45 AND q.p_partkey = p.p_partkey) AS must_lead FROM part p JOIN part q
    ON q.p_partkey BETWEEN p.p_partkey AND p.p_partkey + CASE WHEN p.p_size > 25 THEN 2 ELSE 1 END GROUP BY 1, 2""")
CTES["li"] = (["pl"], "SELECT leader, item FROM pl QUALIFY row_number() OVER (PARTITION BY leader ORDER BY plays, item) <= 2")
CTES["fr"] = (["bi", "ri", "li", "bk"], """SELECT leader, basket, recipe FROM (SELECT h.leader, h.basket, recipe FROM
    (SELECT leader, basket, item FROM bi UNION SELECT bk.leader, bk.basket, li.item FROM bk JOIN li USING (leader) WHERE basket IN (SELECT basket FROM bi)) h
    JOIN ri USING (item) GROUP BY ALL HAVING count(DISTINCT item) = (SELECT count(*) FROM ri r WHERE r.recipe = ri.recipe)) f
    WHERE NOT EXISTS (SELECT 1 FROM ri WHERE ri.recipe = f.recipe AND must_lead AND NOT EXISTS (SELECT 1 FROM li WHERE li.leader = f.leader AND li.item = ri.item))""")
CTES["rs"] = (["ri"], "SELECT recipe, count(*) AS size FROM ri GROUP BY 1")
CTES["fr"] = (["bi", "ri", "rs", "li"], """SELECT f.leader, f.basket, f.recipe FROM (SELECT h.leader, h.basket, recipe, count(*) AS k FROM
    (SELECT leader, basket, item FROM bi UNION SELECT d.leader, d.basket, li.item FROM (SELECT DISTINCT leader, basket FROM bi) d JOIN li USING (leader)) h
    JOIN ri USING (item) GROUP BY ALL) f JOIN rs ON rs.recipe = f.recipe AND rs.size = f.k
    LEFT JOIN (SELECT recipe, count(*) AS musts FROM ri WHERE must_lead GROUP BY 1) m ON m.recipe = f.recipe
    LEFT JOIN (SELECT leader, recipe, count(*) AS led FROM ri JOIN li USING (item) WHERE must_lead GROUP BY 1, 2) x ON x.recipe = f.recipe AND x.leader = f.leader
    WHERE coalesce(musts, 0) = coalesce(led, 0) OR musts IS NULL""")


def customer_pool(t):
    return B.play_counts(t.customer_items), B.sizes(t.customer_baskets)


def sets(t):
    plays = B.play_counts(t.customer_items).withColumn("bundle", F.split("item", " ")[0])
    return top_n(plays, ["leader", "bundle"], [F.asc("item")], 3).select("leader", "bundle", "item")


def recipe_items(t):
    part = t.read("part").select("p_partkey", "p_name", "p_size")
    reach = F.when(F.col("p_size") > 25, 2).otherwise(1)
    spread = part.select(F.col("p_partkey").alias("recipe"), F.col("p_size").alias("size"),
                         F.explode(F.sequence(F.col("p_partkey"), F.col("p_partkey") + reach)).alias("p_partkey"))
    return (spread.join(part.select("p_partkey", F.col("p_name").alias("item")), "p_partkey").groupBy("recipe", "item")
            .agg(F.bool_or((F.col("size") > 45) & (F.col("p_partkey") == F.col("recipe"))).alias("must_lead")))


def basket_items(t):
    return t.once("basket_items", lambda: t.basket_items.select("leader", "basket", "item"))


def own_items(t):
    return t.once("own_items", lambda: top_n(B.play_counts(basket_items(t)), "leader", [F.asc("plays"), F.asc("item")], 2).select("leader", "item"))


def counted_recipes(t):
    return recipes.recipe_counts(basket_items(t), recipe_items(t), own_items(t))


def recipe_sums(t, told, count):
    """What ``count`` makes of (leader, basket, set, told's columns), by leader and set, for each recipe of a set."""
    rows, own = recipe_items(t), own_items(t)
    members = recipes.recipe_sets(rows)
    return recipes.of_recipes(count(recipes.matched_sets(basket_items(t), rows, members, own, told)), rows, members, own)


def found_recipes(t):
    return recipes.baskets_with_recipes(basket_items(t), recipe_items(t), own_items(t))


@query("j12_pair_counts", "SELECT leader, a, b, k AS shared FROM cc", "cc")
def _(t):
    return pairs.pair_counts(t.customer_items).withColumnRenamed("both", "shared")


@query("b19_pair_phi", f"SELECT leader, a, b, round(round({PHI}, 9), 6) AS phi FROM c2 WHERE a < b", "c2")
def _(t):
    return pairs.pair_phi(pairs.pair_counts(t.customer_items), *customer_pool(t)).select("leader", "a", "b", r6(F.col("phi")).alias("phi"))


@query("b18_set_pair_counts", """WITH s AS (SELECT leader, bundle, count(*) AS k FROM rn GROUP BY ALL)
    SELECT a.leader, a.bundle AS a, b.bundle AS b, a.k AS ka, b.k AS kb, coalesce(x.k, 0) AS shared, n FROM s a JOIN s b ON a.leader = b.leader AND a.bundle < b.bundle JOIN cn ON cn.leader = a.leader
    LEFT JOIN (SELECT x.leader, x.bundle AS p, y.bundle AS q, count(*) AS k FROM rn x JOIN rn y ON x.basket = y.basket AND x.bundle < y.bundle GROUP BY ALL) x
      ON x.leader = a.leader AND x.p = a.bundle AND x.q = b.bundle""", "rn cn")
def _(t):
    running = bundle_ops.runs(sets(t), t.customer_items)
    found = bundle_ops.pair_set_counts(running, customer_pool(t)[1])
    return found.select("leader", "a", "b", "ka", "kb", F.col("both").alias("shared"), "n")


@query("j11_bundle_coverage", "SELECT leader, basket, bundle, held, CASE WHEN held = size THEN 'all' ELSE 'some' END AS has FROM cv", "cv")
def _(t):
    return bundle_ops.classify(bundle_ops.coverage(sets(t), t.customer_items)).select("leader", "basket", "bundle", "held", "has")


@query("b23_half_a_bundle", "SELECT leader, basket AS query, bundle, CASE WHEN held = size THEN 'all' ELSE 'some' END AS has FROM cv WHERE 2 * held >= size", "cv")
def _(t):
    mine = t.customer_items.withColumnRenamed("basket", "query")
    return bundle_ops.held_of(sets(t), mine).select("leader", "query", "bundle", "has")


@query("b17_played_more_with", """SELECT leader, x, item, round(base, 6) AS base, round(share, 6) AS share, shared, round(evidence, 6) AS evidence, round(round((shared - pa * base) / (pa + 20), 9), 6) AS score FROM (
    SELECT leader, a AS x, b AS item, pa, pb / n AS base, k / pa AS share, k AS shared, (k / pa - pb / n) / sqrt(pb / n * (1 - pb / n) / pa) AS evidence FROM c2 WHERE pa >= 10 AND k >= 5 AND k / pa > pb / n)
    WHERE evidence >= 1""", "c2")
def _(t):
    more = pairs.played_more_with(pairs.pair_counts(t.customer_items), *customer_pool(t), evidence=1)
    return more.select("leader", "x", "item", F.col("both").alias("shared"), *[r6(F.col(c)).alias(c) for c in ("base", "share", "evidence", "score")])


@query("b20_partners", f"""SELECT leader, x, item, rank, round(phi, 6) AS phi FROM (SELECT *, row_number() OVER (PARTITION BY leader, x ORDER BY phi DESC, item) AS rank FROM (
    SELECT leader, a AS x, b AS item, round({PHI}, 9) AS phi FROM c2 WHERE pa >= 10 AND k >= 5 AND k / pa > pb / n AND (k / pa - pb / n) / sqrt(pb / n * (1 - pb / n) / pa) >= 1)
    WHERE phi >= 0.08) WHERE rank <= 12""", "c2")
def _(t):
    return chosen_partners(t).select("leader", "x", "item", F.col("rank").cast("long").alias("rank"), r6(F.col("phi")).alias("phi"))


def chosen_partners(t):
    more = pairs.played_more_with(pairs.pair_counts(t.customer_items), *customer_pool(t), evidence=1)
    return pairs.partners(more, least=0.08)


def greedy(keys, pairs, link, stand_out, apart, typical_from=1):
    """Bindings after ``pairs`` (keys, a, b, k, phi) that end in ``shown``: a walk over each graph's pairs in order, the ends of what
    is shown so far in a list."""
    on = " AND ".join(f"walk.{k} = e.{k}" for k in keys)
    key, more = ", ".join(keys), ", ".join(f"e.{k}" for k in keys)
    count = lambda end: f"len(list_filter(used, lambda x: x = e.{end}))"
    free = f"CASE e.kind WHEN 'together' THEN {count('a')} < 2 OR {count('b')} < 2 ELSE {count('a')} < 2 AND {count('b')} < 2 END"
    return f"""{pairs},
    typical AS (SELECT {key}, CASE WHEN count(*) >= {typical_from} THEN list_sort(list(phi))[count(*) // 2 + 1] ELSE 0 END AS typical FROM pairs GROUP BY {key}),
    e AS (SELECT 'together' AS kind, {key}, a, b, phi, row_number() OVER (PARTITION BY {key} ORDER BY phi DESC, a, b) AS i
        FROM pairs JOIN typical USING ({key}) WHERE phi >= greatest({link}, typical + {stand_out}) AND k >= 5
      UNION ALL SELECT 'apart', {key}, a, b, phi, row_number() OVER (PARTITION BY {key} ORDER BY phi, a DESC, b DESC) FROM pairs WHERE phi <= {apart}),
    walk AS (SELECT DISTINCT kind, {key}, 0::BIGINT AS i, CAST([] AS VARCHAR[]) AS used, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::DOUBLE AS phi, false AS taken FROM e
      UNION ALL SELECT e.kind, {more}, e.i, CASE WHEN {free} THEN list_concat(used, [e.a, e.b]) ELSE used END, e.a, e.b, e.phi, {free}
      FROM walk JOIN e ON walk.kind = e.kind AND {on} AND e.i = walk.i + 1),
    shown AS (SELECT {key}, a, b, round(phi, 6) AS strength, kind FROM walk WHERE taken)"""


CTES["ch"] = (["c2"], f"""SELECT leader, x, item, base, share, phi FROM (SELECT *, row_number() OVER (PARTITION BY leader, x ORDER BY phi DESC, item) AS rank FROM (
    SELECT leader, a AS x, b AS item, pb / n AS base, k / pa AS share, round({PHI}, 9) AS phi FROM c2 WHERE pa >= 10 AND k >= 5 AND k / pa > pb / n AND (k / pa - pb / n) / sqrt(pb / n * (1 - pb / n) / pa) >= 1)
    WHERE phi >= 0.08) WHERE rank <= 12""")
#: Correlation of counts k, pa, pb among n baskets, 0 where one of the two never varies.
SAFE_PHI = f"round(CASE WHEN pa < n AND pb < n AND pa > 0 AND pb > 0 THEN {PHI} ELSE 0 END, 9)"
RING = f"""WITH RECURSIVE hb AS (SELECT ch.leader, ch.x AS centre, ch.item, ci.basket FROM ch JOIN ci h ON h.leader = ch.leader AND h.item = ch.x JOIN ci ON ci.leader = h.leader AND ci.basket = h.basket AND ci.item = ch.item),
    kk AS (SELECT leader, centre, item, count(*) AS c FROM hb GROUP BY ALL),
    bb AS (SELECT leader, centre, p.item AS a, q.item AS b, count(*) AS k FROM hb p JOIN hb q USING (leader, centre, basket) WHERE p.item < q.item GROUP BY ALL),
    pairs AS (SELECT leader, centre, a, b, k, {SAFE_PHI} AS phi FROM (SELECT u.leader, u.centre, u.item AS a, v.item AS b, coalesce(bb.k, 0) AS k, u.c AS pa, v.c AS pb, cp.plays AS n
      FROM kk u JOIN kk v ON u.leader = v.leader AND u.centre = v.centre AND u.item < v.item JOIN cp ON cp.leader = u.leader AND cp.item = u.centre
      LEFT JOIN bb ON bb.leader = u.leader AND bb.centre = u.centre AND bb.a = u.item AND bb.b = v.item))"""


@query("b20_synergy_edges", greedy(["leader", "centre"], RING, 0.05, 0.02, -0.05) + """
    SELECT leader, x AS centre, x AS a, item AS b, round(phi, 6) AS strength, 'spoke' AS kind FROM ch UNION ALL SELECT * FROM shown""", "ch ci cp")
def _(t):
    """Spokes to each item's partners, and the partners that go together, or apart, among baskets holding it."""
    chosen = t.once("partners", lambda: chosen_partners(t))
    held = t.customer_items.select("leader", F.col("item").alias("centre"), "basket")
    ring = pairs.ring_pairs(chosen.select("leader", F.col("x").alias("centre"), "item"), held, t.customer_items)
    edges = graphs.pick_edges(ring, ["leader", "centre"], link=0.05, stand_out=0.02, apart=-0.05)
    return graphs.spokes(chosen).unionByName(edges).withColumn("strength", r6(F.col("strength")))


#: A customer's finished orders are its results: games are orders, wins those that are fulfilled.
CTES["cr"] = (["bk"], "SELECT leader, customer AS basket, count(*) AS games, count(*) FILTER (status = 'F') AS wins FROM bk GROUP BY ALL")
CTES["wm"] = (["ch", "ci", "cr"], """SELECT leader, centre, node, lift, evidence FROM (SELECT *, (wins + r * 100) / (games + 100) - (k - wins + r * 100) / (g - games + 100) AS lift,
      (wins / games - (k - wins) / (g - games)) / sqrt(2 * r * (1 - r) * (1 / games + 1 / (g - games))) AS evidence FROM (
      SELECT b.*, n, g, t.k, t.k / t.g AS r FROM (SELECT h.leader, h.item AS centre, o.item AS node, count(*) AS held, sum(games) AS games, sum(wins) AS wins
        FROM ci h JOIN cr USING (leader, basket) JOIN ci o USING (leader, basket) WHERE (h.leader, h.item, o.item) IN (SELECT (leader, x, item) FROM ch) GROUP BY ALL) b
      JOIN (SELECT leader, item AS centre, count(*) AS n, sum(games) AS g, sum(wins) AS k FROM ci JOIN cr USING (leader, basket) GROUP BY ALL) t USING (leader, centre))
    WHERE held >= 5 AND n - held >= 5 AND games > 0 AND g > games AND r > 0 AND r < 1)""")


def customer_results(t):
    won = (F.col("status") == "F").cast("long")
    return (t.baskets.groupBy("leader", F.col("customer").alias("entry")).agg(F.count(F.lit(1)).alias("games"), F.sum(won).alias("wins")))


def won_with(t):
    """(leader, centre, node, lift, evidence): how baskets holding an item do with each of its partners."""
    chosen = t.once("partners", lambda: chosen_partners(t)).select("leader", "x", "item")
    holders = t.customer_items.select("leader", F.col("item").alias("x"), F.col("basket").alias("entry")).join(chosen.select("leader", "x").distinct(), ["leader", "x"])
    items = t.customer_items.select(F.col("basket").alias("entry"), "item")
    found = outcomes.wins_more_with(customer_results(t), holders, items, least=5, pairs=chosen)
    return found.select("leader", F.col("x").alias("centre"), F.col("item").alias("node"), "lift", "evidence")


@query("b20_synergy_nodes", """WITH w AS (SELECT leader, centre, node, lift FROM wm WHERE abs(round(evidence, 9)) >= 1)
    SELECT leader, x AS centre, item AS node, 'partner' AS kind, round(base, 6) AS base, round(share, 6) AS share, round(phi, 6) AS phi, round(lift, 6) AS lift FROM ch LEFT JOIN w ON w.leader = ch.leader AND w.centre = x AND w.node = item
    UNION ALL SELECT DISTINCT leader, x, x, 'centre', NULL, NULL, NULL, NULL FROM ch UNION ALL SELECT DISTINCT leader, centre, NULL, 'won', NULL, NULL, NULL, NULL FROM w""".replace("SELECT leader, x AS centre", "SELECT ch.leader, x AS centre"), "ch wm")
def _(t):
    nodes, _ = synergy(t)
    return nodes.select("leader", "centre", "node", "kind", *[r6(F.col(c)).alias(c) for c in ("base", "share", "phi", "lift")])


def synergy(t):
    won = graphs.clear_results(won_with(t), evidence=1)
    return graphs.with_won(graphs.synergy_nodes(t.once("partners", lambda: chosen_partners(t))), won, ["leader", "centre"])


@query("b20_won_edges", "SELECT leader, centre, node, round(lift, 6) AS lift FROM wm WHERE abs(round(evidence, 9)) >= 1", "wm")
def _(t):
    _, edges = synergy(t)
    return edges.withColumn("lift", r6(F.col("lift")))


@query("b21_bundle_pair_phi", """WITH s AS (SELECT leader, bundle, count(*) AS k FROM rn GROUP BY ALL), m AS (SELECT leader, bundle FROM s JOIN cn USING (leader)
      WHERE k >= greatest(3, 0.03 * n) QUALIFY row_number() OVER (PARTITION BY leader ORDER BY k DESC, bundle) <= 12), r AS (SELECT rn.* FROM rn JOIN m USING (leader, bundle))
    SELECT leader, a, b, round((k * n - pa * pb) / sqrt(pa::DOUBLE * (n - pa) * pb * (n - pb)), 6) AS phi FROM (SELECT a.leader, a.bundle AS a, b.bundle AS b, a.k AS pa, b.k AS pb, n,
      coalesce(x.k, 0) AS k FROM s a JOIN s b ON a.leader = b.leader AND a.bundle < b.bundle JOIN cn ON cn.leader = a.leader JOIN m u ON u.leader = a.leader AND u.bundle = a.bundle
      JOIN m v ON v.leader = b.leader AND v.bundle = b.bundle
      LEFT JOIN (SELECT x.leader, x.bundle AS p, y.bundle AS q, count(*) AS k FROM r x JOIN r y ON x.basket = y.basket AND x.bundle < y.bundle GROUP BY ALL) x ON x.leader = a.leader AND x.p = a.bundle AND x.q = b.bundle)""", "rn cn")
def _(t):
    return bundle_map_pairs(t).select("leader", "a", "b", r6(F.col("phi")).alias("phi"))


def bundle_map_pairs(t):
    n = customer_pool(t)[1]
    running = bundle_ops.runs(sets(t), t.customer_items)
    shown = bundle_ops.most_run(running, n).select("leader", "bundle")
    kept = running.join(shown, ["leader", "bundle"])
    return bundle_ops.pair_set_counts(kept, n)


CTES["mr"] = (["rn", "cn"], """SELECT leader, bundle, k AS runs FROM (SELECT leader, bundle, count(*) AS k FROM rn GROUP BY ALL) JOIN cn USING (leader)
    WHERE k >= greatest(3, 0.03 * n) QUALIFY row_number() OVER (PARTITION BY leader ORDER BY k DESC, bundle) <= 12""")
MAP_PAIRS = f"""WITH RECURSIVE pairs AS (SELECT leader, a, b, k, {SAFE_PHI} AS phi FROM (SELECT u.leader, u.bundle AS a, v.bundle AS b, u.runs AS pa, v.runs AS pb, n, coalesce(x.k, 0) AS k
      FROM mr u JOIN mr v ON u.leader = v.leader AND u.bundle < v.bundle JOIN cn ON cn.leader = u.leader
      LEFT JOIN (SELECT leader, p.bundle AS a, q.bundle AS b, count(*) AS k FROM rn p JOIN rn q USING (leader, basket) WHERE p.bundle < q.bundle GROUP BY ALL) x ON x.leader = u.leader AND x.a = u.bundle AND x.b = v.bundle))"""


@query("b21_bundle_map_edges", greedy(["leader"], MAP_PAIRS, 0.05, 0.02, -0.02) + " SELECT * FROM shown", "mr rn cn")
def _(t):
    edges = graphs.pick_edges(bundle_map_pairs(t), ["leader"], link=0.05, stand_out=0.02, apart=-0.02)
    return edges.withColumn("strength", r6(F.col("strength")))


#: How baskets running a bundle do against those holding none of its items.
CTES["br"] = (["cv", "cr"], """SELECT leader, bundle, (aw + r * 100) / (ag + 100) - (nw + r * 100) / (ng + 100) AS lift, (aw / ag - nw / ng) / sqrt(2 * r * (1 - r) * (1 / ag + 1 / ng)) AS evidence FROM (
    SELECT leader, bundle, ag, aw, tg - ag - sg AS ng, tw - aw - sw AS nw, tw / tg AS r FROM (
      SELECT leader, bundle, coalesce(sum(games) FILTER (held = size), 0) AS ag, coalesce(sum(wins) FILTER (held = size), 0) AS aw, coalesce(sum(games) FILTER (held < size), 0) AS sg, coalesce(sum(wins) FILTER (held < size), 0) AS sw
      FROM cv JOIN cr USING (leader, basket) GROUP BY ALL) JOIN (SELECT leader, sum(games) AS tg, sum(wins) AS tw FROM cr GROUP BY 1) USING (leader)) WHERE ag > 0 AND ng > 0 AND r > 0 AND r < 1""")


def bundle_wins(t):
    """(leader, bundle, lift, evidence)"""
    results = customer_results(t).withColumns({"cut_baskets": F.lit(0), "cuts": F.lit(0)})
    covered = bundle_ops.coverage(sets(t), t.customer_items).withColumnRenamed("basket", "entry")
    seen = covered.join(results.drop("leader"), "entry").groupBy("leader", "bundle").agg(
        *[F.coalesce(F.sum(F.when((F.col("held") == F.col("size")) == whole, F.col(c))), F.lit(0)).alias(f"{name}_{c}") for whole, name in ((True, "all"), (False, "some")) for c in ("games", "wins")])
    return outcomes.against_none(seen, results.groupBy("leader").agg(F.sum("games").alias("games"), F.sum("wins").alias("wins")))


@query("b21_bundle_map_nodes", """WITH w AS (SELECT leader, bundle, lift FROM br JOIN mr USING (leader, bundle) WHERE abs(round(evidence, 9)) >= 1),
    m AS (SELECT leader, bundle, string_agg(item, ' + ' ORDER BY item) AS name FROM (SELECT *, row_number() OVER (PARTITION BY leader, bundle ORDER BY item) AS i FROM bs) WHERE i <= 2 GROUP BY ALL)
    SELECT leader, bundle AS node, 'bundle' AS kind, runs, name, round(lift, 6) AS lift FROM mr JOIN m USING (leader, bundle) LEFT JOIN w USING (leader, bundle)
    UNION ALL SELECT DISTINCT leader, NULL, 'won', NULL, NULL, NULL FROM w""", "mr br bs")
def _(t):
    nodes, _ = bundle_map(t)
    return nodes.select("leader", "node", "kind", "runs", "name", r6(F.col("lift")).alias("lift"))


def bundle_map(t):
    shown = bundle_ops.most_run(bundle_ops.runs(sets(t), t.customer_items), customer_pool(t)[1])
    placed = top_n(sets(t), ["leader", "bundle"], [F.asc("item")], 3, "pos").withColumn("pos", F.col("pos") - 1)
    won = graphs.clear_results(bundle_wins(t), evidence=1).select("leader", F.col("bundle").alias("node"), "lift")
    return graphs.with_won(graphs.bundle_nodes(shown, placed), won, ["leader"])


@query("b21_won_edges", "SELECT leader, bundle AS node, round(lift, 6) AS lift FROM br JOIN mr USING (leader, bundle) WHERE abs(round(evidence, 9)) >= 1", "mr br")
def _(t):
    _, edges = bundle_map(t)
    return edges.withColumn("lift", r6(F.col("lift")))


@query("b22_bundle_extras", f"""WITH s AS (SELECT leader, bundle, count(*) AS pa FROM rn GROUP BY ALL HAVING count(*) >= 10),
    r AS (SELECT leader, bundle, item, share, base, k, phi FROM (SELECT leader, bundle, item, k / pa AS share, (pb - k) / (n - pa) AS base, k, round({PHI}, 9) AS phi FROM (
      SELECT rn.leader, rn.bundle, ci.item, count(*) AS k FROM rn JOIN ci USING (leader, basket) ANTI JOIN bs ON bs.leader = rn.leader AND bs.bundle = rn.bundle AND bs.item = ci.item GROUP BY ALL)
      JOIN s USING (leader, bundle) JOIN (SELECT leader, item, plays AS pb FROM cp) USING (leader, item) JOIN cn USING (leader) WHERE k >= 5) WHERE phi >= 0.05 AND share > base)
    SELECT leader, bundle, item, rank, k AS shared, round(share, 6) AS share, round(base, 6) AS base, round(phi, 6) AS phi FROM (SELECT *, row_number() OVER (PARTITION BY leader, bundle ORDER BY phi DESC, item) AS rank FROM r) WHERE rank <= 6""", "rn ci bs cp cn")
def _(t):
    found = bundle_ops.bundle_extras(bundle_ops.runs(sets(t), t.customer_items), sets(t), t.customer_items, *customer_pool(t), least=0.05)
    return found.select("leader", "bundle", "item", F.col("rank").cast("long").alias("rank"), F.col("both").alias("shared"), *[r6(F.col(c)).alias(c) for c in ("share", "base", "phi")])


CORE_PAIRS = f"""WITH RECURSIVE pairs AS (SELECT leader, bundle, a, b, k, {SAFE_PHI} AS phi FROM (SELECT u.leader, u.bundle, u.item AS a, v.item AS b, coalesce(cc.k, 0) AS k, p.plays AS pa, q.plays AS pb, n
      FROM bs u JOIN bs v ON u.leader = v.leader AND u.bundle = v.bundle AND u.item < v.item JOIN cp p ON p.leader = u.leader AND p.item = u.item JOIN cp q ON q.leader = v.leader AND q.item = v.item JOIN cn ON cn.leader = u.leader
      LEFT JOIN cc ON cc.leader = u.leader AND cc.a = u.item AND cc.b = v.item))"""


@query("b22_bundle_core_edges", greedy(["leader", "bundle"], CORE_PAIRS, 0.0, 0.001, -0.01, 3) + " SELECT * FROM shown", "bs cp cn cc")
def _(t):
    """The pairs of each bundle's own items that stand out among all its leader's baskets."""
    inside = graphs.core_pairs(sets(t), t.customer_items, *customer_pool(t))
    edges = graphs.pick_edges(inside, ["leader", "bundle"], link=0.0, stand_out=0.001, apart=-0.01, typical_from=3)
    return edges.withColumn("strength", r6(F.col("strength")))


@query("b22_bundle_graph_nodes", """SELECT leader, bundle, item AS node, 'core' AS kind, plays AS baskets FROM bs JOIN cp USING (leader, item)
    UNION ALL SELECT leader, bundle, NULL, 'bundle', count(*) FROM rn GROUP BY leader, bundle""", "bs cp rn")
def _(t):
    """Bundles and their items; ``b22_bundle_extras`` has the rest of the nodes."""
    running = bundle_ops.runs(sets(t), t.customer_items)
    counted = running.groupBy("leader", "bundle").agg(F.count(F.lit(1)).alias("runs"))
    extras = bundle_ops.bundle_extras(running, sets(t), t.customer_items, *customer_pool(t), least=0.05)
    nodes, _ = graphs.bundle_graph(sets(t), counted, customer_pool(t)[0], extras)
    return nodes.filter("kind <> 'extra'").select("leader", "bundle", "node", "kind", "baskets")


@query("b24_newest_running", """WITH u AS (SELECT customer AS basket, max(made) AS updated FROM bk GROUP BY 1)
    SELECT leader, bundle, basket, rank FROM (SELECT leader, bundle, basket, row_number() OVER (PARTITION BY leader, bundle ORDER BY updated DESC, basket) AS rank FROM rn JOIN u USING (basket)) WHERE rank <= 12""", "rn bk")
def _(t):
    updated = t.baskets.groupBy("leader", F.col("customer").alias("basket")).agg(F.max("made").alias("updated"))
    return bundle_ops.newest_running(bundle_ops.runs(sets(t), t.customer_items), updated).select("leader", "bundle", "basket", F.col("rank").cast("long").alias("rank"))


GROUPS = "SELECT c_custkey AS basket, c_mktsegment AS leader, CAST(c_nationkey % 5 AS BIGINT) AS grp FROM customer"


@query("b11_bundle_links", f"""WITH g AS ({GROUPS}), z AS (SELECT leader, grp, count(*) AS z FROM g GROUP BY ALL), p AS (SELECT ci.leader, grp, item, count(*) AS k FROM ci JOIN g USING (basket) GROUP BY ALL),
    s AS (SELECT leader, item, sum(k - k * k / z) AS s FROM p JOIN z USING (leader, grp) GROUP BY ALL)
    SELECT leader, a, b, shared, round(round((shared - chance) / sqrt(x.s * y.s), 9), 6) AS link FROM (SELECT cc.leader, cc.a, cc.b, cc.k AS shared, sum(p.k * q.k / z) AS chance FROM cc
      JOIN p ON p.leader = cc.leader AND p.item = cc.a JOIN p q ON q.leader = cc.leader AND q.item = cc.b AND q.grp = p.grp JOIN z ON z.leader = cc.leader AND z.grp = p.grp WHERE cc.k >= 5 GROUP BY ALL) c
    JOIN s x USING (leader) JOIN s y USING (leader) WHERE x.item = a AND y.item = b""", "cc ci")
def _(t):
    return customer_links(t).select("leader", "a", "b", F.col("both").alias("shared"), r6(F.col("link")).alias("link"))


def customer_groups(t):
    return t.read("customer").select(F.col("c_custkey").alias("basket"), F.col("c_mktsegment").alias("leader"), (F.col("c_nationkey") % 5).cast("long").alias("grp"))


def customer_links(t):
    return pairs.grouped_links(pairs.pair_counts(t.customer_items), t.customer_items, customer_groups(t))


@query("b11_bundles")
def _(t):
    none = t.items.filter("false").select("item")
    precon = sets(t).filter("false").select("leader", "item")
    plays, n = customer_pool(t)
    found, counts = bundle_ops.find_bundles(t.customer_items, plays, n, customer_groups(t), t.items.filter("kind = 'PROMO'").select("item"), none, precon, least=0.06)
    return found.join(counts, ["leader", "bundle"])


@query("b12_basket_groups")
def _(t):
    clustered = customer_groups(t).withColumnRenamed("grp", "cluster")
    lands = t.items.filter("kind = 'PROMO'").select("item")
    limited = t.items.filter("value > 40").select("item")
    found = bundle_ops.stratify(t.customer_items, clustered, lands, limited, top=20)
    return found.groupBy("leader", "grp").agg(F.count(F.lit(1)).alias("baskets"))


@query("j10_baskets_with_recipes", "SELECT leader, basket, recipe FROM fr", "fr")
def _(t):
    return found_recipes(t)


@query("f8_valid_recipes", """SELECT recipe, item, must_lead FROM ri WHERE recipe NOT IN (SELECT recipe FROM ri WHERE item NOT IN (SELECT item FROM it WHERE kind <> 'LARGE'))""", "ri it")
def _(t):
    return recipes.valid_recipes(recipe_items(t), t.items.filter("kind <> 'LARGE'").select("item"))


@query("f8_recipe_leaders_allowed", """SELECT leader, recipe FROM ri JOIN li USING (item) WHERE must_lead GROUP BY ALL HAVING count(*) = 1""", "ri li")
def _(t):
    return recipes.allowed_leaders(recipe_items(t), own_items(t))


@query("a20_leader_recipes", "SELECT leader, recipe, count(*) AS baskets FROM fr JOIN sz USING (leader) GROUP BY leader, recipe, n HAVING count(*) >= greatest(5, 0.02 * n)", "fr sz")
def _(t):
    return recipes.leader_recipes(counted_recipes(t), B.sizes(t.baskets))


@query("a20_top_recipes", "SELECT recipe, baskets, row_number() OVER (ORDER BY baskets DESC, recipe) AS rank FROM (SELECT recipe, count(*) AS baskets FROM fr GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 300)", "fr")
def _(t):
    return recipes.top_recipes(counted_recipes(t), 300).withColumn("rank", F.col("rank").cast("long"))


@query("a20_recipe_leaders", "SELECT recipe, leader, baskets, rank FROM (SELECT *, row_number() OVER (PARTITION BY recipe ORDER BY baskets DESC, leader) AS rank FROM (SELECT recipe, leader, count(*) AS baskets FROM fr GROUP BY ALL)) WHERE rank <= 3", "fr")
def _(t):
    return recipes.recipe_leaders(counted_recipes(t), 3).withColumn("rank", F.col("rank").cast("long"))


@query("a20_recipes_by_identity_window", """SELECT recipe, nation % 4 AS identity, count(*) AS ever, count(*) FILTER (made >= DATE '2001-08-02' - 90) AS w90, count(*) FILTER (made >= DATE '2001-08-02' - 30) AS w30,
    count(*) FILTER (made >= DATE '2001-08-02' - 7) AS w7 FROM fr JOIN bk USING (leader, basket) GROUP BY ALL""", "fr bk")
def _(t):
    inside = lambda w: F.sum((F.col("made") >= windows.cutoff(TODAY, w)).cast("long"))
    told = t.baskets.select("leader", "basket", "made", (F.col("nation") % 4).alias("identity"))
    count = lambda dated: dated.groupBy("leader", "set", "identity").agg(F.count(F.lit(1)).alias("ever"), *[inside(w).alias(f"w{w}") for w in windows.RECENT_DAYS])
    sums = recipe_sums(t, told, count)
    return sums.groupBy("recipe", "identity").agg(*[F.sum(c).alias(c) for c in ("ever", *[f"w{w}" for w in windows.RECENT_DAYS])])


@query("b13_near_recipes", """WITH c AS (SELECT recipe, count(*) AS baskets FROM fr GROUP BY 1), h AS (SELECT basket, recipe, count(*) AS k FROM bi JOIN ri USING (item) GROUP BY ALL)
    SELECT h.basket AS query, h.recipe, ri.item AS missing, baskets FROM h JOIN rs USING (recipe) JOIN c USING (recipe) JOIN ri USING (recipe)
    ANTI JOIN bi ON bi.basket = h.basket AND bi.item = ri.item WHERE k = size - 1 AND size = 3""", "fr bi ri rs")
def _(t):
    counts = counted_recipes(t).groupBy("recipe").agg(F.sum("baskets").alias("baskets"))
    big = recipe_items(t).join(recipe_items(t).groupBy("recipe").count().filter("count = 3").select("recipe"), "recipe")
    return recipes.near_recipes(basket_items(t).select(F.col("basket").alias("query"), "item"), big, counts)


@query("b13_near_recipes_all_sizes", """WITH c AS (SELECT recipe, count(*) AS baskets FROM fr GROUP BY 1), h AS (SELECT basket, recipe, count(*) AS k FROM bi JOIN ri USING (item) GROUP BY ALL)
    SELECT h.basket AS query, h.recipe, ri.item AS missing, baskets FROM h JOIN rs USING (recipe) JOIN c USING (recipe) JOIN ri USING (recipe)
    ANTI JOIN bi ON bi.basket = h.basket AND bi.item = ri.item WHERE k = size - 1""", "fr bi ri rs")
def _(t):
    counts = counted_recipes(t).groupBy("recipe").agg(F.sum("baskets").alias("baskets"))
    return recipes.near_recipes(basket_items(t).select(F.col("basket").alias("query"), "item"), recipe_items(t), counts)


@query("b14_recipe_groups")
def _(t):
    counts = recipes.leader_recipes(counted_recipes(t), B.sizes(t.baskets), least=5, common=0.0)
    arrays = recipe_items(t).groupBy("recipe").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = number_rows(counts, [F.desc("baskets"), F.asc("recipe")], "pos", keys=["leader"])
    listed = (listed.join(arrays, "recipe").withColumn("needs", F.array((F.col("recipe") % 3).cast("string")))
              .withColumn("makes", F.array((F.col("recipe") % 2).cast("string"))))
    return recipes.group_recipes(listed.select("leader", "recipe", "pos", "items", "needs", "makes")).withColumn("core", F.array_join("core", "+"))


@query("a31_recipes_with_bundle", """WITH s AS (SELECT leader, bundle, item FROM bs QUALIFY row_number() OVER (PARTITION BY leader, bundle ORDER BY item) = 1)
    SELECT leader, bundle, count(*) AS recipes FROM s JOIN ri USING (item) GROUP BY ALL""", "bs ri")
def _(t):
    single = top_n(sets(t), ["leader", "bundle"], [F.asc("item")], 1).select("leader", "bundle", "item")
    return bundle_ops.recipes_with(single, recipe_items(t))


@query("n16_recipe_text", """WITH a AS (SELECT recipe, string_agg(item, ' + ' ORDER BY item) AS names, string_agg('[[' || item || ']]', ' + ' ORDER BY item) AS cards FROM ri GROUP BY 1)
    SELECT recipe, '## ' || names || chr(10) || chr(10) || '**Cards:** ' || cards || chr(10) || chr(10) || '**First:**' || chr(10) || '- Any ' || lower(p_type) || chr(10) || '- [[symbol:g]] available' || chr(10) || chr(10) ||
    '**Steps:**' || chr(10) || '1. Use ' || p_brand || chr(10) || '2. Repeat.' || chr(10) || chr(10) || '**Result:** a combo' || chr(10) AS text FROM a JOIN part ON p_partkey = recipe""", "ri")
def _(t):
    arrays = recipe_items(t).groupBy("recipe").agg(F.array_sort(F.collect_set("item")).alias("names"))
    told = t.read("part").select(F.col("p_partkey").alias("recipe"), F.array(F.lower("p_type")).alias("needs"), F.array().cast("array<string>").alias("makes"),
                                 F.lit("{G}").alias("mana"), F.lit("").alias("easy"), F.lit("").alias("notable"),
                                 F.concat(F.lit("Use "), "p_brand", F.lit("\n Repeat. ")).alias("steps"))
    return recipes.recipe_text(arrays.join(told, "recipe"))


@query("b25_cheaper_alternatives", """WITH i AS (SELECT p_partkey AS item, CAST(round_even(p_retailprice * 100, 0) AS BIGINT) * (p_size % 7 + 1) AS cents, p_type AS kind, CAST(p_size & 7 AS BIGINT) AS identity FROM part),
    x AS (SELECT p_partkey AS item, unnest(string_split(p_name, ' ')) AS tag FROM part UNION ALL SELECT p_partkey, p_brand FROM part UNION ALL SELECT p_partkey, 'size ' || p_size // 5 FROM part),
    h AS (SELECT tag, count(*) AS held, ln((SELECT count(*) FROM i) / count(*)) AS weight FROM x GROUP BY 1), own AS (SELECT item, sum(weight) AS own FROM x JOIN h USING (tag) GROUP BY 1),
    s AS (SELECT a.item, b.item AS other, sum(weight) AS weight FROM x a JOIN h USING (tag) JOIN x b USING (tag) WHERE a.item <> b.item AND held <= 1500 GROUP BY ALL)
    SELECT item, other, rank, round(weight, 6) AS weight FROM (SELECT s.item, s.other, round(s.weight, 9) AS weight, row_number() OVER (PARTITION BY s.item ORDER BY round(s.weight, 9) DESC, s.other) AS rank
      FROM s JOIN own USING (item) JOIN i a ON a.item = s.item JOIN i b ON b.item = s.other AND b.kind = a.kind
      WHERE a.cents >= 500 AND round(s.weight, 9) >= round(0.35 * own, 9) AND b.identity & ~a.identity = 0 AND b.cents <= 0.5 * a.cents) WHERE rank <= 6""")
def _(t):
    part = t.read("part")
    items = part.select(F.col("p_partkey").alias("item"), (F.rint(F.col("p_retailprice") * 100).cast("long") * (F.col("p_size") % 7 + 1)).alias("cents"),
                        F.col("p_type").alias("kind"), F.col("p_size").bitwiseAND(7).cast("long").alias("identity"))
    tags = (part.select(F.col("p_partkey").alias("item"), F.explode(F.split("p_name", " ")).alias("tag"))
            .unionByName(part.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("tag")))
            .unionByName(part.select(F.col("p_partkey").alias("item"), F.concat(F.lit("size "), F.floor(F.col("p_size") / 5).cast("string")).alias("tag"))))
    found = bundle_ops.alternatives(items, tags)
    return found.select("item", "other", F.col("rank").cast("long").alias("rank"), r6(F.col("weight")).alias("weight"))


def document_words(t):
    """Documents as baskets of words, of each source."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"), F.lit(1)))
    return t.read("documents").select(F.col("source").alias("leader"), F.col("doc_id").alias("basket"), F.explode(words).alias("item"))


def clusters_by_language(t, found):
    langs = t.read("documents").select(F.col("doc_id").alias("basket"), "lang")
    return found.join(langs, "basket").groupBy("leader", "cluster", "lang").agg(F.count(F.lit(1)).alias("baskets"))


@query("b6_clusters")
def _(t):
    """Documents clustered by their words, and how many of each language a cluster has."""
    found = clusters.leader_clusters(document_words(t).withColumn("leader", F.lit("all")))
    return clusters_by_language(t, found).drop("leader")


def source_clusters(t):
    return t.once("source_clusters", lambda: clusters.leader_clusters(document_words(t), per_cluster=10))


@query("b6_clusters_of_all_leaders")
def _(t):
    """The clusters of every source's documents at once."""
    return clusters_by_language(t, source_clusters(t))


@query("b12_groups_of_clusters")
def _(t):
    """Documents of every source's clusters by how many of their cluster's words they have, and how many long ones."""
    words = document_words(t)
    long = words.filter(F.length("item") > 14).select("item").distinct()
    found = bundle_ops.stratify(words, source_clusters(t), words.filter("length(item) < 3").select("item").distinct(), long, top=20, band=10)
    return found.groupBy("leader", "grp").agg(F.count(F.lit(1)).alias("baskets"))


@query("b11_bundles_of_clusters")
def _(t):
    """Words that go together within groups of alike documents."""
    words = t.once("document_words", lambda: document_words(t))
    short = words.filter("length(item) < 3").select("item").distinct()
    none = words.filter("false")
    clustered = source_clusters(t)
    groups = t.once("source_groups", lambda: bundle_ops.stratify(words, clustered, short, none.select("item"), top=20, band=10))
    plays, n = B.play_counts(words), words.select("leader", "basket").distinct().groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    found, counts = bundle_ops.find_bundles(words, plays, n, groups, short, none.select("item"), none.select("leader", "item"), least=0.5, common=0.1)
    return found.join(counts, ["leader", "bundle"])


@query("b26_coordinates")
def _(t):
    return clusters.coordinates(t.customer_items)


CTES["dn"] = ([], "SELECT doc_id AS basket, lang AS leader, source AS grp, text AS name FROM documents")


@query("n14_group_names", r"""WITH w AS (SELECT DISTINCT leader, grp, basket, word FROM (SELECT leader, grp, basket, unnest(regexp_extract_all(lower(name), '[\p{L}\p{N}][\p{L}\p{N}''+-]*')) AS word FROM dn)
      WHERE length(word) > 2 AND word NOT IN ('the','of','a','an','and','my','deck','edh','commander','copy','v1','v2','v3','new','list','build','upgraded','upgrade','precon','budget','cedh','test','wip','in','to','with','for','is','on','de','la','el','untitled','version','primer','optimized','casual')),
    n AS (SELECT leader, count(*) AS n FROM dn GROUP BY 1), m AS (SELECT leader, grp, count(*) AS members FROM dn GROUP BY ALL), a AS (SELECT leader, word, count(*) AS everywhere FROM w GROUP BY ALL),
    h AS (SELECT leader, grp, word, count(*) AS k FROM w GROUP BY ALL)
    SELECT leader, grp, upper(word[1]) || word[2:] AS word, round(lift, 6) AS lift FROM (SELECT leader, grp, word, round(k / members - everywhere / n, 9) AS lift FROM h JOIN m USING (leader, grp) JOIN a USING (leader, word) JOIN n USING (leader)
      WHERE k >= greatest(3, 0.1 * members)) WHERE lift >= 0.08 QUALIFY row_number() OVER (PARTITION BY leader, grp ORDER BY lift DESC, word) = 1""", "dn")
def _(t):
    docs = t.read("documents").select(F.col("doc_id").alias("basket"), F.col("lang").alias("leader"), F.col("source").alias("grp"), F.col("text").alias("name"))
    return clusters.cluster_names(docs).withColumn("lift", r6(F.col("lift")))


@query("w14_ranking_fifths", "SELECT leader, item, (row_number() OVER (PARTITION BY leader ORDER BY plays DESC, item) - 1) * 5 // count(*) OVER (PARTITION BY leader) AS fifth FROM pl", "pl")
def _(t):
    plays = B.play_counts(t.basket_items)
    n = plays.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    ranked = number_rows(plays, [F.desc("plays"), F.asc("item")], "place", keys=["leader"])
    return ranked.join(n, "leader").select("leader", "item", fifths(F.col("place") + 1, F.col("n")).alias("fifth"))
