"""Registered queries on event outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerwork.functions.numeric import compare
from wickerwork.operators import baskets as B
from wickerwork.operators import outcomes as O
from wickerwork.operators.bundles import coverage, runs
from wickerwork.operators.ranking import top_n
from wickerwork.plans.registry import query, r6
from wickerwork.plans.tables import CTES, TODAY

DAYS = "(VALUES (90), (180), (365), (730)) v(w)"
TALLY = """count(*) AS baskets, CAST(sum(games) AS BIGINT) AS games, CAST(sum(wins) AS BIGINT) AS wins, count(*) FILTER (top_cut > 0) AS cut_baskets,
    count(*) FILTER (standing > 0 AND standing <= top_cut) AS cuts, CAST(sum(draws) AS BIGINT) AS draws"""
CTES["ew"] = (["en"], f"SELECT en.*, CAST(w AS INT) AS w FROM en JOIN {DAYS} ON date >= DATE '2001-08-02' - w")
CTES["lt"] = (["ew"], f"SELECT leader, w, {TALLY} FROM ew GROUP BY leader, w")
CTES["ft"] = (["ew"], f"SELECT w, {TALLY} FROM ew GROUP BY w")
CTES["ia"] = (["ew", "ei"], f"SELECT leader, item, w, {TALLY} FROM ew JOIN ei USING (entry) GROUP BY leader, item, w")
CTES["im"] = (["ia"], "SELECT * FROM ia SEMI JOIN (SELECT leader, item FROM ia WHERE w = 730 AND baskets >= 2) USING (leader, item)")
CMP = """(k1 + 100 * r) / (n1 + 100) - (k2 + 100 * r) / (n2 + 100) AS lift, (k1 / n1 - k2 / n2) / sqrt(2 * r * (1 - r) * (1 / n1 + 1 / n2)) AS evidence"""
CTES["ir"] = (["im", "lt"], f"""SELECT *, {CMP} FROM (SELECT im.leader, item, w, im.baskets, im.games, im.wins AS k1, im.games AS n1, lt.wins - im.wins AS k2, lt.games - im.games AS n2,
    lt.wins / lt.games AS r, im.baskets / lt.baskets AS share, CASE WHEN im.cut_baskets > 0 THEN im.cuts / im.cut_baskets END AS conversion,
    CASE WHEN lt.cut_baskets > im.cut_baskets THEN (lt.cuts - im.cuts) / (lt.cut_baskets - im.cut_baskets) END AS conversion_without
    FROM im JOIN lt USING (leader, w) WHERE lt.baskets >= 20 AND im.baskets >= 10 AND lt.baskets - im.baskets >= 10)""")


def leader_rows(t):
    return O.totals(t.entries, ["leader"], TODAY)


def item_rows(t):
    return O.item_totals(O.played_items(t.entries, t.entry_items), TODAY)


def field(t):
    return O.totals(t.entries, [], TODAY)


def results(t):
    return O.item_results(item_rows(t), leader_rows(t))


@query("a12_leader_totals", "SELECT * FROM lt", "lt")
def _(t):
    return leader_rows(t)


@query("a15_field_totals", f"SELECT leader, w, false AS field, baskets, games, wins, cut_baskets, cuts, draws FROM lt UNION ALL SELECT NULL, w, true, baskets, games, wins, cut_baskets, cuts, draws FROM ft", "lt ft")
def _(t):
    return O.totals_with_field(t.entries, TODAY)


@query("a13_item_totals", "SELECT leader, item, w, baskets, games, wins, cut_baskets, cuts FROM im", "im")
def _(t):
    return item_rows(t)


@query("a14_player_totals", f"SELECT leader, player, w, {TALLY} FROM ew GROUP BY leader, player, w", "ew")
def _(t):
    return O.totals(t.entries, ["leader", "player"], TODAY)


@query("a16_pooled_effects", """SELECT item, w, CAST(sum(d) AS BIGINT) AS baskets, count(*) FILTER (ok) AS leaders, round(coalesce(sum(wt * gap) FILTER (ok) / (sum(wt) FILTER (ok) + 100), 0), 6) AS lift,
    round(coalesce(sum(wt * gap) FILTER (ok) / sum(wt) FILTER (ok) / sqrt(2 * any_value(r) * (1 - any_value(r)) / sum(wt) FILTER (ok)), 0), 6) AS evidence FROM (
    SELECT nation, item, x.w, x.d, x.d >= 3 AND y.d - x.d >= 3 AND x.g > 0 AND x.g < y.g AS ok, 1 / (1 / x.g + 1 / nullif(y.g - x.g, 0)) AS wt, x.k / x.g - (y.k - x.k) / nullif(y.g - x.g, 0) AS gap, ft.wins / ft.games AS r FROM
    (SELECT nation, item, w, count(*) AS d, sum(games) AS g, sum(wins) AS k, FROM ew JOIN ei USING (entry) GROUP BY ALL) x
    JOIN (SELECT nation, w, count(*) AS d, sum(games) AS g, sum(wins) AS k FROM ew GROUP BY ALL) y USING (nation, w) JOIN ft ON ft.w = x.w) GROUP BY item, w""", "ew ei ft")
def _(t):
    """Leaders here are the 25 nations, so that there is something to pool."""
    entries = t.entries.drop("leader").withColumnRenamed("nation", "leader")
    counts = O.totals(O.played_items(entries, t.entry_items), ["leader", "item"], TODAY)
    found = O.pooled(counts, O.totals(entries, ["leader"], TODAY), field(t))
    return found.withColumns({"lift": r6(F.col("lift")), "evidence": r6(F.col("evidence"))})


@query("t1_compare_leaders", f"SELECT leader, w, round(lift, 6) AS lift, round(evidence, 6) AS evidence FROM (SELECT leader, w, {CMP} FROM (SELECT leader, w, lt.wins AS k1, lt.games AS n1, ft.wins - lt.wins AS k2, ft.games - lt.games AS n2, ft.wins / ft.games AS r FROM lt JOIN ft USING (w)))", "lt ft")
def _(t):
    rows = leader_rows(t).join(field(t).select("w", F.col("wins").alias("fw"), F.col("games").alias("fg")), "w")
    lift, evidence = compare(F.col("wins"), F.col("games"), F.col("fw") - F.col("wins"), F.col("fg") - F.col("games"), F.col("fw") / F.col("fg"))
    return rows.select("leader", "w", r6(lift).alias("lift"), r6(evidence).alias("evidence"))


@query("t2_item_results", """SELECT leader, item, w, baskets, games, round(share, 6) AS share, round(k1 / n1, 6) AS win_rate, round(k2 / n2, 6) AS win_rate_without, round(lift, 6) AS lift, round(evidence, 6) AS evidence,
    round(conversion, 6) AS conversion, round(conversion_without, 6) AS conversion_without FROM ir""", "ir")
def _(t):
    return results(t).select("leader", "item", "w", "baskets", "games", *[r6(F.col(c)).alias(c) for c in
                             ("share", "win_rate", "win_rate_without", "lift", "evidence", "conversion", "conversion_without")])


CTES["eb"] = (["ei", "en"], """SELECT DISTINCT leader, split_part(item, ' ', 1) AS bundle, item FROM en JOIN ei USING (entry)
    QUALIFY dense_rank() OVER (PARTITION BY leader, split_part(item, ' ', 1) ORDER BY item) <= 2""")
CTES["ev"] = (["eb", "ei", "en"], "SELECT leader, entry, bundle, count(*) AS held FROM en JOIN ei USING (entry) JOIN eb USING (leader, item) GROUP BY ALL")


def entry_sets(t):
    """Bundles of two: the first two items of each first word."""
    items = t.entries.join(t.entry_items, "entry").select("leader", "item").distinct().withColumn("bundle", F.split("item", " ")[0])
    return top_n(items, ["leader", "bundle"], [F.asc("item")], 2).select("leader", "bundle", "item")


def entry_baskets(t):
    return t.entries.select("leader", "entry").join(t.entry_items, "entry").withColumnRenamed("entry", "basket")


@query("t3_bundle_results", f"""WITH c AS (SELECT leader, bundle, CASE held WHEN 2 THEN 'all' ELSE 'some' END AS has, {TALLY} FROM en JOIN ev USING (leader, entry) GROUP BY ALL),
    a AS (SELECT leader, {TALLY} FROM en GROUP BY leader), b AS (SELECT DISTINCT leader, bundle FROM eb),
    x AS (SELECT b.*, coalesce(p.baskets, 0) AS all_baskets, coalesce(p.games, 0) AS all_games, coalesce(p.wins, 0) AS all_wins, coalesce(s.baskets, 0) AS some_baskets, coalesce(s.games, 0) AS some_games, coalesce(s.wins, 0) AS some_wins,
      a.baskets - coalesce(p.baskets, 0) - coalesce(s.baskets, 0) AS none_baskets, a.games - coalesce(p.games, 0) - coalesce(s.games, 0) AS none_games, a.wins - coalesce(p.wins, 0) - coalesce(s.wins, 0) AS none_wins, a.wins / a.games AS r
      FROM b JOIN a USING (leader) LEFT JOIN (SELECT * FROM c WHERE has = 'all') p USING (leader, bundle) LEFT JOIN (SELECT * FROM c WHERE has = 'some') s USING (leader, bundle))
    SELECT leader, bundle, all_baskets, all_wins, none_baskets, none_wins, some_baskets, some_wins,
      CASE WHEN n1 > 0 AND n2 > 0 AND r > 0 AND r < 1 THEN round(lift, 6) END AS lift, CASE WHEN n1 > 0 AND n2 > 0 AND r > 0 AND r < 1 THEN round(evidence, 6) END AS evidence
    FROM (SELECT *, {CMP} FROM (SELECT *, all_wins AS k1, all_games AS n1, none_wins AS k2, none_games AS n2 FROM x))""", "en ev eb")
def _(t):
    covered = coverage(entry_sets(t), entry_baskets(t)).withColumnRenamed("basket", "entry")
    found = O.bundle_results(t.entries, covered, entry_sets(t).select("leader", "bundle").distinct())
    return found.select("leader", "bundle", *[f"{s}_{c}" for s in ("all", "none", "some") for c in ("baskets", "wins")],
                        r6(F.col("lift")).alias("lift"), r6(F.col("evidence")).alias("evidence"))


@query("t4_wins_more_with", f"""WITH t AS (SELECT leader, item AS x, count(*) AS n, sum(games) AS g, sum(wins) AS k FROM en JOIN ei USING (entry) GROUP BY ALL),
    b AS (SELECT leader, p.item AS x, q.item, count(*) AS with_baskets, sum(games) AS wg, CAST(sum(wins) AS BIGINT) AS with_wins FROM en JOIN ei p USING (entry) JOIN ei q USING (entry) WHERE p.item <> q.item GROUP BY ALL)
    SELECT leader, x, item, with_baskets, with_wins, without_baskets, without_wins, round(lift, 6) AS lift, round(evidence, 6) AS evidence FROM (SELECT *, {CMP} FROM (SELECT leader, x, item, with_baskets, with_wins, n - with_baskets AS without_baskets,
      CAST(k - with_wins AS BIGINT) AS without_wins, with_wins AS k1, wg AS n1, k - with_wins AS k2, g - wg AS n2, k / g AS r FROM b JOIN t USING (leader, x))) WHERE with_baskets >= 20 AND without_baskets >= 20""", "en ei")
def _(t):
    found = O.items_winning_more_with(t.entries, t.entry_items)
    return found.withColumns({"lift": r6(F.col("lift")), "evidence": r6(F.col("evidence"))})


@query("t5_win_ties", f"""WITH r AS (SELECT leader, entry, bundle FROM ev WHERE held = 2), a AS (SELECT leader, sum(games) AS ag, sum(wins) AS aw FROM en GROUP BY 1),
    x AS (SELECT leader, bundle AS a, NULL AS b, count(*) AS baskets, sum(games) AS games, sum(wins) AS wins FROM r JOIN en USING (leader, entry) GROUP BY ALL UNION ALL
      SELECT leader, p.bundle, q.bundle, count(*), sum(games), sum(wins) FROM r p JOIN r q USING (leader, entry) JOIN en USING (leader, entry) WHERE p.bundle < q.bundle GROUP BY ALL)
    SELECT leader, a, b, baskets, CAST(games AS BIGINT) AS games, CAST(wins AS BIGINT) AS wins, CASE WHEN baskets >= 10 THEN round(lift, 6) END AS lift, CASE WHEN baskets >= 10 THEN round(evidence, 6) END AS evidence FROM (SELECT *, {CMP} FROM (
      SELECT *, wins AS k1, games AS n1, aw - wins AS k2, ag - games AS n2, aw / ag AS r FROM x JOIN a USING (leader)))""", "ev en")
def _(t):
    running = runs(entry_sets(t), entry_baskets(t)).select("leader", F.col("bundle").alias("node"), F.col("basket").alias("entry"))
    found = O.win_ties(t.entries, running)
    return found.withColumns({"lift": r6(F.col("lift")), "evidence": r6(F.col("evidence"))})


CUTS = "SELECT leader, entry AS basket, CASE WHEN standing > 0 AND standing <= top_cut THEN 'made' ELSE 'missed' END AS side FROM en WHERE top_cut > 0 AND date >= DATE '2001-08-02' - 730"


@query("b16_cut_groups", f"SELECT * FROM ({CUTS})", "en")
def _(t):
    return O.cut_groups(t.entries, TODAY, 730)


@query("b16_made_against_missed", f"""WITH s AS ({CUTS}), g AS (SELECT leader, item, count(*) FILTER (side = 'missed') AS ka, count(*) FILTER (side = 'made') AS kb FROM s JOIN ei ON entry = basket GROUP BY ALL),
    m AS (SELECT leader, count(*) FILTER (side = 'missed') AS na, count(*) FILTER (side = 'made') AS nb FROM s GROUP BY 1), r AS (SELECT leader, item, ka / nullif(na, 0) AS a, kb / nullif(nb, 0) AS b, round(kb / nullif(nb, 0) - ka / nullif(na, 0), 9) AS gap, (ka + kb) / (na + nb) AS p, na, nb FROM g JOIN m USING (leader))
    SELECT leader, direction, item, rank, round(a, 6) AS a, round(b, 6) AS b, round(evidence, 6) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY leader, direction ORDER BY abs(gap) DESC, item) AS rank FROM (
      SELECT *, CASE WHEN gap > 0 THEN 'more' ELSE 'less' END AS direction, (b - a) / sqrt(p * (1 - p) * (1 / na + 1 / nb)) AS evidence FROM r WHERE greatest(a, b) >= 0.05 AND gap <> 0)) WHERE rank <= 6""", "en ei")
def _(t):
    side = O.cut_groups(t.entries, TODAY, 730)
    grouped = side.join(t.entry_items.withColumnRenamed("entry", "basket"), "basket")
    members = side.groupBy("leader", "side").agg(F.count(F.lit(1)).alias("members"))
    found = B.played_differently(grouped, members, ["leader"], "missed", "made", least=0.05)
    return found.select("leader", "direction", "item", F.col("rank").cast("long").alias("rank"), *[r6(F.col(c)).alias(c) for c in ("a", "b", "evidence")])


@query("t6_highlights", """WITH x AS (SELECT nation, count(*) FILTER (w) AS n, count(*) FILTER (NOT w) AS n0, count(DISTINCT player) FILTER (w) AS players, (5 * sum(wins) FILTER (w) + sum(draws) FILTER (w)) / sum(games) FILTER (w) AS p,
      (5 * sum(wins) FILTER (NOT w) + sum(draws) FILTER (NOT w)) / sum(games) FILTER (NOT w) AS p0 FROM (SELECT *, date >= DATE '2001-08-02' - 30 AS w FROM en WHERE date >= DATE '2001-08-02' - 120) GROUP BY 1),
    s AS (SELECT nation, n, n0, players, round(p, 9) AS points, round(coalesce(p0, 0), 9) AS points0, round(n / sum(n) OVER () / ((n0 + 1) / (sum(n0) OVER () + 1)), 9) AS sh, n0 / sum(n0) OVER () AS was FROM x),
    b AS (SELECT * FROM s WHERE n >= 5 ORDER BY points DESC, nation DESC LIMIT 1), k AS (SELECT * FROM s WHERE n >= 3 AND nation NOT IN (SELECT nation FROM b) ORDER BY sh DESC, nation DESC LIMIT 1),
    r AS (SELECT * FROM s WHERE n >= 3 AND n0 >= 3 AND nation NOT IN (SELECT nation FROM b UNION ALL SELECT nation FROM k) ORDER BY round(points - points0, 9) DESC, nation DESC LIMIT 1)
    SELECT 'best' AS kind, nation AS leader, n AS baskets, round(points, 6) AS points, players, NULL::DOUBLE AS was FROM b UNION ALL SELECT 'breakout', nation, n, round(points, 6), players, round(was, 6) FROM k UNION ALL SELECT 'rising', nation, n, round(points, 6), players, round(points0, 6) FROM r""", "en")
def _(t):
    found = O.highlights(t.entries.drop("leader").withColumnRenamed("nation", "leader"), TODAY, best=5, breakout=3, rising=3)
    return found.withColumns({"points": r6(F.col("points")), "was": r6(F.col("was"))})


@query("k3_top_finishes", "SELECT leader, entry, standing, date, rank FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY date DESC, standing, entry) AS rank FROM en WHERE standing <= 4) WHERE rank <= 200", "en")
def _(t):
    return O.top_finishes(t.entries).select("leader", "entry", "standing", "date", F.col("rank").cast("long").alias("rank"))


@query("k2_leaderboard", "SELECT leader, w, baskets, round(wins / games, 6) AS rate, 5 * wins + draws AS points, round((5 * wins + draws) / games, 6) AS ppg, round(CASE WHEN cut_baskets > 0 THEN cuts / cut_baskets END, 6) AS cut_rate FROM lt", "lt")
def _(t):
    board = O.ranked_by(O.leaderboard(leader_rows(t)), "ppg")
    return board.select("leader", "w", "baskets", r6(F.col("rate")).alias("rate"), "points", r6(F.col("ppg")).alias("ppg"), r6(F.col("cut_rate")).alias("cut_rate"))


@query("w15_first_period", "SELECT leader, coalesce(min(w) FILTER (baskets >= 150), max(w)) AS w FROM lt GROUP BY 1", "lt")
def _(t):
    return O.first_period(leader_rows(t))


@query("a27_without_top_players", """WITH p AS (SELECT leader, player, sum(games) AS games, sum(wins) AS wins, count(*) AS baskets FROM en GROUP BY ALL), b AS (SELECT leader, sum(games) AS g, sum(wins) AS k FROM (SELECT * FROM p
      QUALIFY row_number() OVER (PARTITION BY leader ORDER BY wins DESC, baskets DESC, player) <= 2) GROUP BY 1), a AS (SELECT leader, CAST(sum(games) AS BIGINT) AS games, CAST(sum(wins) AS BIGINT) AS wins FROM en GROUP BY 1)
    SELECT leader, games, wins, round((wins - k) / (games - g), 6) AS rate_without FROM a JOIN b USING (leader)""", "en")
def _(t):
    sums = lambda keys: t.entries.groupBy(*keys).agg(*O.tallies())
    return O.without_top_players(sums(["leader", "player"]), sums(["leader"])).withColumn("rate_without", r6(F.col("rate_without")))


@query("a17_player_histories", "SELECT player, max(player_name) AS name, entry, date, row_number() OVER (PARTITION BY player ORDER BY date DESC, entry) AS place FROM en GROUP BY player, entry, date", "en")
def _(t):
    return O.player_histories(t.entries).select("player", "name", "entry", "date", F.col("place").cast("long").alias("place"))


@query("a17_player_index", "SELECT player, leader, baskets, CAST(sum(baskets) OVER (PARTITION BY player) AS BIGINT) AS total, row_number() OVER (PARTITION BY player ORDER BY baskets DESC, leader) AS place FROM (SELECT player, leader, count(*) AS baskets FROM en GROUP BY ALL)", "en")
def _(t):
    return O.player_index(t.entries).withColumn("place", F.col("place").cast("long"))


@query("a18_player_ranking", f"SELECT player, w, {TALLY} FROM ew SEMI JOIN (SELECT player FROM en GROUP BY 1 HAVING count(*) >= 5) USING (player) GROUP BY player, w", "ew en")
def _(t):
    return O.player_ranking(t.entries, TODAY)


@query("a19_player_favourites", """WITH s AS (SELECT leader, item, im.baskets / lt.baskets AS share FROM im JOIN lt USING (leader, w) WHERE w = 730), l AS (SELECT player, leader, count(*) AS k FROM en GROUP BY ALL),
    c AS (SELECT player, item, count(*) AS baskets, CAST(sum(games) AS BIGINT) AS games, CAST(sum(wins) AS BIGINT) AS wins FROM en JOIN ei USING (entry) SEMI JOIN (SELECT player FROM en GROUP BY 1 HAVING count(*) >= 2) USING (player) GROUP BY ALL HAVING count(*) >= 2),
    e AS (SELECT c.*, round(coalesce(x.e, 0), 9) AS e FROM c LEFT JOIN (SELECT player, item, sum(k * share) AS e FROM c JOIN l USING (player) JOIN s USING (leader, item) GROUP BY ALL) x USING (player, item))
    SELECT player, item, baskets, games, wins, round_even(e * 10, 0) / 10 AS expected, rank FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY round(e - baskets, 9), item) AS rank FROM e WHERE baskets > e) WHERE rank <= 48""", "im lt en ei")
def _(t):
    played = O.played_items(t.entries, t.entry_items).select("leader", "player", "entry", "item", "date", "games", "wins", "draws")
    found = O.favourites(t.entries, t.dealt(played, "player"), item_rows(t), leader_rows(t))
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("a28_player_profile", """SELECT player, baskets, points, round(ppg, 6) AS ppg, round(rate, 6) AS rate, round(cut_rate, 6) AS cut_rate, since, best_entry, best_standing, rank() OVER (ORDER BY points DESC) AS rank FROM (
    SELECT player, count(*) AS baskets, CAST(5 * sum(wins) + sum(draws) AS BIGINT) AS points, (5 * sum(wins) + sum(draws)) / sum(games) AS ppg, sum(wins) / sum(games) AS rate, min(date) AS since,
    CASE WHEN count(*) FILTER (top_cut > 0) > 0 THEN count(*) FILTER (standing <= top_cut) / count(*) FILTER (top_cut > 0) END AS cut_rate, first(entry ORDER BY round(standing / size, 9), -size, entry) AS best_entry,
    first(standing ORDER BY round(standing / size, 9), -size, entry) AS best_standing FROM en GROUP BY 1)""", "en")
def _(t):
    found = O.points_ranks(O.player_profile(t.entries))
    return found.select("player", "baskets", "points", r6(F.col("ppg")).alias("ppg"), r6(F.col("rate")).alias("rate"), r6(F.col("cut_rate")).alias("cut_rate"), "since", "best_entry", "best_standing", "rank")


@query("k8_player_search", """WITH q AS (SELECT DISTINCT p_partkey AS query, lower('#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS q FROM part), i AS (SELECT player, leader, count(*) AS lb FROM en GROUP BY ALL),
    p AS (SELECT player, max(player_name) AS name, count(*) AS baskets FROM en GROUP BY 1)
    SELECT query, player, name, baskets, 1 AS rank, leader, lb AS leader_baskets, place FROM q JOIN p ON contains(lower(name), q) JOIN (SELECT *, row_number() OVER (PARTITION BY player ORDER BY lb DESC, leader) AS place FROM i) USING (player) WHERE place <= 3""", "en")
def _(t):
    """Searched for: each part's number as it would end a customer's name."""
    queries = t.read("part").select(F.col("p_partkey").alias("query"), F.concat(F.lit("#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("q"))
    found = O.player_search(t.entries, queries)
    return found.withColumns({"rank": F.col("rank").cast("int"), "place": F.col("place").cast("long")})


@query("w16_list_versions", """WITH l AS (SELECT player, leader, entry, lag(entry) OVER (PARTITION BY player, leader ORDER BY date, entry) AS before FROM en)
    SELECT player, leader, l.entry, n.item, 'added' AS change FROM l JOIN ei n ON n.entry = l.entry ANTI JOIN ei b ON b.entry = l.before AND b.item = n.item WHERE l.before IS NOT NULL
    UNION ALL SELECT player, leader, l.entry, b.item, 'cut' FROM l JOIN ei b ON b.entry = l.before ANTI JOIN ei n ON n.entry = l.entry AND n.item = b.item""", "en ei")
def _(t):
    return O.list_versions(t.entries, t.entry_items)


@query("w17_halves", """SELECT player, leader, half, count(*) AS baskets, CAST(sum(games) AS BIGINT) AS games, CAST(sum(wins) AS BIGINT) AS wins FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY player, leader ORDER BY date, entry)
    <= count(*) OVER (PARTITION BY player, leader) // 2 THEN 1 ELSE 2 END AS half FROM en) GROUP BY ALL""", "en")
def _(t):
    return O.halves(t.entries)


@query("t14_clearest_changes", """WITH a AS (SELECT player, leader, count(*) AS n, sum(games) AS ag, sum(wins) AS aw FROM en GROUP BY ALL), h AS (SELECT player, leader, item, count(*) AS baskets, sum(games) AS g, sum(wins) AS k FROM en JOIN ei USING (entry) GROUP BY ALL)
    SELECT player, leader, item, baskets, round(k / g, 6) AS rate, round((aw - k) / (ag - g), 6) AS rate_without, round(abs(k / g - (aw - k) / (ag - g)) * sqrt(1 / (1 / g + 1 / (ag - g))), 6) AS clear
    FROM h JOIN a USING (player, leader) WHERE n >= 2 AND baskets < n AND g > 0 AND ag > g""", "en ei")
def _(t):
    found = O.clearest_changes(t.entries, t.entry_items, lambda played: t.dealt(played, "player", "leader"))
    return found.withColumns({c: r6(F.col(c)) for c in ("rate", "rate_without", "clear")})


AVERAGE = """av AS (SELECT leader, item FROM pl QUALIFY row_number() OVER (PARTITION BY leader ORDER BY plays DESC, item) <= 4),
    d AS (SELECT leader, basket AS query, item, 'cut' AS side FROM bi ANTI JOIN av USING (leader, item) UNION ALL SELECT leader, basket, item, 'add' FROM (SELECT DISTINCT leader, basket FROM bi) JOIN av USING (leader) ANTI JOIN bi USING (basket, item))"""


@query("t15_against_a_list", f"""WITH {AVERAGE} SELECT query, leader, item, side, round(lift, 6) AS lift, row_number() OVER (PARTITION BY query, side ORDER BY CASE WHEN side = 'add' THEN -round(lift, 9) ELSE round(lift, 9) END NULLS LAST, item) AS place
    FROM d LEFT JOIN (SELECT leader, item, lift FROM ir WHERE w = 730) USING (leader, item)""", "pl bi ir")
def _(t):
    usual = top_n(B.play_counts(t.basket_items), "leader", [F.desc("plays"), F.asc("item")], 4).select("leader", "item")
    mine = t.basket_items.select(F.col("basket").alias("query"), "item")
    heads = t.basket_items.select("leader", F.col("basket").alias("query")).distinct()
    diff = B.symmetric_difference(mine, heads.join(usual, "leader").select("query", "item")).join(heads, "query")
    found = O.rank_against(diff, results(t).filter("w = 730"))
    return found.select("query", "leader", "item", "side", r6(F.col("lift")).alias("lift"), F.col("place").cast("long").alias("place"))


@query("t16_basket_check", """WITH r AS (SELECT leader, item, lift, evidence FROM ir WHERE w = 730), f AS (SELECT item, kind FROM it)
    SELECT basket AS query, leader, item, 'mine_less' AS side, round(lift, 6) AS lift, round(evidence, 6) AS evidence FROM bi JOIN r USING (leader, item) WHERE lift < 0 AND evidence <= -1
    UNION ALL SELECT d.basket, d.leader, r.item, 'missing_more', round(lift, 6), round(evidence, 6) FROM (SELECT DISTINCT leader, basket FROM bi) d JOIN r ON r.leader = d.leader JOIN f ON f.item = r.item ANTI JOIN bi ON bi.basket = d.basket AND bi.item = r.item
      WHERE lift > 0 AND evidence >= 1 AND kind <> 'LARGE'""", "ir bi it")
def _(t):
    mine = t.basket_items.select(F.col("basket").alias("query"), "leader", "item")
    r = results(t).filter("w = 730").select("leader", "item", "lift", "evidence")
    fits = t.items.filter("kind <> 'LARGE'").select("item")
    strong = r.filter("lift > 0 and evidence >= 1").select("leader", "item").join(fits, "item")
    ok = mine.select("query", "leader").distinct().join(strong, "leader").select("query", "item")
    return O.basket_check(r, mine, ok, signal=1.0).withColumns({"lift": r6(F.col("lift")), "evidence": r6(F.col("evidence"))})


CTES["tp"] = (["bi", "en"], "SELECT bi.* FROM bi JOIN en ON entry = basket WHERE standing > 0 AND standing <= top_cut AND date >= DATE '2001-08-02' - 730")
CTES["tw"] = (["tp"], "SELECT leader, item, count(*) AS plays, any_value(n) AS n, pow(ln(any_value(n) / greatest(count(*), 1)), 2) AS weight FROM tp JOIN (SELECT leader, count(DISTINCT basket) AS n FROM tp GROUP BY 1) USING (leader) GROUP BY leader, item")


@query("t17_cut_pool_similarity", """WITH q AS (SELECT fq.query, leader, item, coalesce(weight, pow(ln(m.n), 2)) AS weight FROM fq LEFT JOIN tw USING (leader, item) JOIN (SELECT leader, any_value(n) AS n FROM tw GROUP BY 1) m USING (leader))
    SELECT query, leader, basket, shared, round(CASE WHEN dot > 0 THEN dot / sqrt(norm * theirs) ELSE 0 END, 6) AS similarity FROM (SELECT query, leader, basket, sum(tw.weight) AS dot, count(*) AS shared FROM tp JOIN q USING (leader, item) JOIN tw USING (leader, item) GROUP BY ALL)
    JOIN (SELECT query, sum(weight) AS norm FROM q GROUP BY 1) USING (query) JOIN (SELECT leader, basket, sum(weight) AS theirs FROM tp JOIN tw USING (leader, item) GROUP BY ALL) USING (leader, basket)""", "tp tw fq")
def _(t):
    """Similarity against only the entries that made the cut."""
    from wickerwork.plans.baskets import full_queries
    made = O.cut_groups(t.entries, TODAY, 730).filter("side = 'made'").select("leader", "basket")
    items = t.basket_items.join(made, ["leader", "basket"])
    held = items.select("leader", "basket").distinct()
    found = B.similarity(full_queries(t), items, B.play_counts(items), B.sizes(held))
    return found.withColumn("similarity", r6(F.col("similarity")))


@query("w13_results_by_month", """WITH s AS (SELECT leader, CAST(unnest(generate_series(min(date_trunc('month', date)), max(date_trunc('month', date)), INTERVAL 1 MONTH)) AS DATE) AS month FROM en GROUP BY leader),
    a AS (SELECT leader, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS all_baskets, CAST(sum(games) AS BIGINT) AS all_games, CAST(sum(wins) AS BIGINT) AS all_wins FROM en GROUP BY 1, 2),
    i AS (SELECT leader, item, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS baskets, CAST(sum(games) AS BIGINT) AS games, CAST(sum(wins) AS BIGINT) AS wins FROM en JOIN ei USING (entry) GROUP BY 1, 2, 3)
    SELECT leader, item, month, coalesce(all_baskets, 0) AS all_baskets, coalesce(all_games, 0) AS all_games, coalesce(all_wins, 0) AS all_wins, coalesce(baskets, 0) AS baskets, coalesce(games, 0) AS games, coalesce(wins, 0) AS wins
    FROM (SELECT DISTINCT leader, item FROM i) JOIN s USING (leader) LEFT JOIN a USING (leader, month) LEFT JOIN i USING (leader, item, month)""", "en ei")
def _(t):
    return O.results_by_month(t.entries, t.entry_items)
