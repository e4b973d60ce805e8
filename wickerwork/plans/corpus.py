"""Registered queries on logs and merges. A user's events are its log: views and purchases are versions from two sources,
clicks notes of when it was made, errors notes that it was gone."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerwork.operators import corpus as K
from wickerwork.plans.registry import query
from wickerwork.plans.tables import CTES

CTES["lg"] = ([], """SELECT user_id AS id, CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS source, event_id AS line, CAST(ts AS DATE) AS updated, CASE WHEN event_type <> 'error' AND value > 60 THEN CAST(ts AS DATE) - 100 END AS created,
    CASE WHEN event_type = 'error' THEN CAST(ts AS DATE) END AS removed, event_type IN ('click', 'error') AS note, value FROM events WHERE event_type <> 'signup'""")
CTES["fo"] = (["lg"], """SELECT b.id, b.updated, coalesce(won, first, noted) AS created, CASE WHEN gone >= b.updated THEN gone END AS removed, b.source, b.line FROM (SELECT * FROM lg WHERE NOT note QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated DESC, source DESC, line DESC) = 1) b
    LEFT JOIN (SELECT id, last(created ORDER BY source, line) FILTER (created IS NOT NULL AND updated >= top) AS won, first(created ORDER BY source, line) FILTER (created IS NOT NULL) AS first FROM (
      SELECT *, max(updated) OVER (PARTITION BY id ORDER BY source, line) AS top FROM lg WHERE NOT note) GROUP BY 1) c USING (id)
    LEFT JOIN (SELECT id, first(created ORDER BY source, line) FILTER (created IS NOT NULL) AS noted, max(removed) AS gone FROM lg WHERE note GROUP BY 1) n USING (id)""")


def log(t):
    kind, day = F.col("event_type"), F.to_date("ts")
    return t.read("events").filter(kind != "signup").select(
        F.col("user_id").alias("id"), (kind == "purchase").cast("int").alias("source"), F.col("event_id").alias("line"), day.alias("updated"),
        F.when((kind != "error") & (F.col("value") > 60), F.date_sub(day, 100)).alias("created"), F.when(kind == "error", day).alias("removed"),
        kind.isin("click", "error").alias("note"), "value")


@query("e1_folded_log", "SELECT * FROM fo", "fo")
def _(t):
    return K.newest_versions(log(t), width=500)


@query("w3_last_copies", "SELECT id, source, line, updated, value FROM lg WHERE NOT note QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated DESC, source DESC, line DESC) = 1", "lg")
def _(t):
    return K.last_copies(log(t).filter("not note")).select("id", "source", "line", "updated", "value")


@query("u1_union_of_sources", "SELECT source, count(*) AS copies, count(DISTINCT id) AS ids FROM lg WHERE NOT note GROUP BY source", "lg")
def _(t):
    one, two = (log(t).filter((F.col("source") == s) & ~F.col("note")) for s in (0, 1))
    return one.unionByName(two).groupBy("source").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("id").alias("ids"))


@query("e2_extended_numbers", """WITH k AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS number FROM (SELECT DISTINCT p_name AS item FROM part WHERE p_name < 'm')), n AS (SELECT p_name || '/' || p_size AS item, count(*) AS c FROM part GROUP BY 1)
    SELECT item, number FROM k UNION ALL SELECT item, row_number() OVER (ORDER BY c DESC, item) + (SELECT max(number) FROM k) FROM n""")
def _(t):
    """Names before m have numbers; names with sizes are new."""
    part = t.read("part")
    from wickerwork.operators.ranking import number_rows
    known = number_rows(part.filter("p_name < 'm'").select(F.col("p_name").alias("item")).distinct(), [F.asc("item")])
    counts = part.groupBy(F.concat_ws("/", "p_name", F.col("p_size").cast("string")).alias("item")).agg(F.count(F.lit(1)).alias("count"))
    return K.extend_numbers(known, counts)


@query("e3_moved_baskets", "SELECT o_orderkey AS basket, c_mktsegment AS old, CASE WHEN o_orderstatus = 'F' THEN 'FURNITURE' ELSE c_mktsegment END AS new FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment <> 'FURNITURE'")
def _(t):
    after = t.baskets.withColumn("leader", F.when(F.col("status") == "F", "FURNITURE").otherwise(F.col("leader")))
    return K.moved(t.baskets, after)


@query("e4_latest_dates", "SELECT user_id AS id, max(CAST(ts AS DATE)) AS updated FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1")
def _(t):
    rows = log(t).filter("not note")
    return K.merge_latest(rows.filter("source = 0"), rows.filter("source = 1"), "id", "updated")


# Two copies of the events: one knows the orders of each day by finished lines, the other by open ones.
CTES["ca"] = (["bk"], "SELECT made AS event, made AS date, count(*) AS entries, count(*) % 2 = 0 AS players_known, 'a' AS copy FROM bk WHERE status <> 'O' GROUP BY 1")
CTES["cb"] = (["bk"], "SELECT made AS event, made AS date, count(*) AS entries, count(*) % 3 = 0 AS players_known, 'b' AS copy FROM bk WHERE status <> 'F' GROUP BY 1")


def copies(t):
    def one(status, k, name):
        n = t.baskets.filter(F.col("status") != status).groupBy(F.col("made").alias("event")).agg(F.count(F.lit(1)).alias("entries"))
        return n.select("event", F.col("event").alias("date"), "entries", (F.col("entries") % k == 0).alias("players_known"), F.lit(name).alias("copy"))
    return one("O", 2, "a"), one("F", 3, "b")


MERGE = """SELECT coalesce(a.event, b.event) AS event, CASE WHEN {take} THEN b.entries ELSE a.entries END AS entries, CASE WHEN {take} THEN 'b' ELSE 'a' END AS copy FROM ca a FULL JOIN cb b ON a.event = b.event"""
MORE = "b.event IS NOT NULL AND (a.event IS NULL OR b.entries > a.entries OR (b.players_known AND NOT a.players_known))"


@query("u3_added_events", MERGE.format(take=MORE), "ca cb")
def _(t):
    return K.add_events(*copies(t)).select("event", "entries", "copy")


@query("e5_replaced_events", MERGE.format(take="b.event IS NOT NULL AND (a.event IS NULL OR b.entries >= a.entries)"), "ca cb")
def _(t):
    return K.replace_events(*copies(t)).select("event", "entries", "copy")


@query("e5_refetch_from", "SELECT max(CAST(o_orderdate AS DATE)) - 3 AS since FROM orders")
def _(t):
    return K.refetch_from(t.baskets.select(F.col("made").alias("date")))


@query("e6_numbered_players", """WITH k AS (SELECT DISTINCT player_name AS profile, player FROM en WHERE player < 100), f AS (SELECT player_name AS profile, min(date) AS d FROM en WHERE player >= 100 GROUP BY 1), g AS (SELECT profile, d, min(standing) AS s FROM f JOIN en ON player_name = profile AND date = d GROUP BY 1, 2)
    SELECT profile, player FROM k UNION ALL SELECT profile, row_number() OVER (ORDER BY d, s, profile) + (SELECT max(player) FROM k) FROM g""", "en")
def _(t):
    entries = t.entries.withColumn("profile", F.col("player_name"))
    known = entries.filter("player < 100").select("profile", "player").distinct()
    return K.number_players(known, entries)


@query("e7_fetch_queue", "SELECT variant, finish, now, scarce FROM (SELECT variant, finish, max(cents) AS now, variant < 30 AS scarce FROM ob GROUP BY ALL) WHERE now > 0 AND (scarce OR now >= 9000) AND NOT (finish = 'error')", "ob")
def _(t):
    prices = t.observed.groupBy("variant", "finish").agg(F.max("cents").alias("now")).withColumn("scarce", F.col("variant") < 30)
    done = prices.filter("finish = 'error'").select("variant", "finish")
    return K.fetch_queue(prices, done, 9000)


@query("e7_leader_queue", "SELECT c_nationkey::BIGINT AS leader, n, day FROM (SELECT DISTINCT c_nationkey FROM customer) LEFT JOIN (SELECT nation, count(*) AS n, CASE WHEN nation % 2 = 0 THEN max(made) END AS day FROM bk GROUP BY 1) ON nation = c_nationkey WHERE n < (SELECT count(*) FROM bk) / 25", "bk")
def _(t):
    nations = t.baskets.groupBy(F.col("nation").alias("leader")).agg(F.count(F.lit(1)).alias("n"), F.max("made").alias("day"))
    leaders = t.read("customer").select(F.col("c_nationkey").cast("long").alias("leader")).distinct()
    target = t.baskets.count() / 25
    return K.leader_queue(leaders, nations.select("leader", "n"), nations.filter("leader % 2 = 0").select("leader", "day"), target)


@query("u6_appended_rows", "SELECT variant, finish, day, cents FROM ob WHERE finish = 'view' OR variant < 50 UNION ALL SELECT variant, finish, day, cents + 1 FROM ob WHERE finish <> 'view' AND variant >= 50", "ob")
def _(t):
    mine = t.observed.filter("finish = 'view' or variant < 50")
    return K.append_missing(mine, t.observed.withColumn("cents", F.col("cents") + 1), ["variant", "finish"])
