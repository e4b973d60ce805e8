"""Registered streaming queries: the events table read as a stream, run until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickerwork.plans.corpus import log
from wickerwork.plans.registry import query
from wickerwork.session import scratch_path
from wickerwork.streaming import folds as S


def feed(t, df, order, run, parts=4):
    """Give ``run`` a stream of the table that grows part by part, in order of a column, and return what it last returns.

    Each part is appended to the source's folder and run to its end before the next one comes, so what the stream sees does not
    depend on the names or times of files."""
    path = scratch_path(t.spark, "source")
    place = F.unix_timestamp(F.col(order).cast("timestamp")) if dict(df.dtypes)[order] in ("date", "timestamp") else F.col(order)
    cuts = df.select(F.percentile_approx(place.cast("long"), [k / parts for k in range(1, parts)]).alias("c")).first()["c"] or []
    part = sum([(place > c).cast("int") for c in cuts], F.lit(0))
    out = None
    for k in range(parts):
        df.filter(part == k).write.mode("append").parquet(path)
        out = run(t.spark.readStream.schema(df.schema).parquet(path))
    return out


@query("r1_folded_stream", "SELECT id, updated, created, removed, source, line FROM fo", "fo")
def _(t):
    state, check = scratch_path(t.spark, "log"), scratch_path(t.spark, "check")
    return feed(t, log(t).drop("value"), "line", lambda stream: S.fold_stream(stream, state, check))


@query("r2_late_corrections", """SELECT coalesce(a.event, b.event) AS event, coalesce(a.event, b.event) AS date, CASE WHEN b.event IS NOT NULL AND (a.event IS NULL OR b.entries >= a.entries) THEN b.entries ELSE a.entries END AS entries,
      CASE WHEN b.event IS NOT NULL AND (a.event IS NULL OR b.entries >= a.entries) THEN b.players_known ELSE a.players_known END AS players_known,
      CASE WHEN b.event IS NOT NULL AND (a.event IS NULL OR b.entries >= a.entries) THEN 'b' ELSE 'a' END AS copy FROM ca a FULL JOIN cb b ON a.event = b.event
    WHERE coalesce(a.event, b.event) IS NOT NULL""", "ca cb")
def _(t):
    """Both copies of an event are seen on its day, and copies that would win four days on, too late."""
    from wickerwork.plans.corpus import copies
    a, b = copies(t)
    late = a.withColumns({"entries": F.col("entries") + 1_000_000, "copy": F.lit("late")})
    seen = lambda df, days: df.withColumn("seen", F.date_add("date", days).cast("timestamp"))
    rows = seen(a.unionByName(b), 0).unionByName(seen(late, 4))
    state, check = scratch_path(t.spark, "events"), scratch_path(t.spark, "check")
    return feed(t, rows, "seen", lambda stream: S.correct_stream(stream, state, check))


@query("r3_days_added_once", "SELECT variant, finish, day, cents FROM ob", "ob")
def _(t):
    """Every day comes in one part and again, changed, once all are in: the same state takes both streams."""
    state, check = scratch_path(t.spark, "days"), scratch_path(t.spark, "check")
    feed(t, t.observed, "day", lambda stream: S.add_days_stream(stream, state, check + "-a"))
    again = t.observed.withColumn("cents", F.col("cents") + 1)
    return feed(t, again, "day", lambda stream: S.add_days_stream(stream, state, check + "-b"), parts=1)


def counted_events(t, name, **window):
    """Counts of all events: a last row, a month later and of no type, lets the watermark pass every window before it."""
    rows = t.read("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    beat = rows.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select("ts", F.lit(None).cast("string").alias("event_type"))
    out, check = scratch_path(t.spark, name), scratch_path(t.spark, "check")
    return feed(t, rows.unionByName(beat), "ts", lambda stream: S.run_to_table(S.window_counts(stream, "ts", **window), out, check))


@query("r4_daily_counts", """SELECT date_trunc('day', CAST(ts AS TIMESTAMP))::TIMESTAMP AS start, date_trunc('day', CAST(ts AS TIMESTAMP))::TIMESTAMP + INTERVAL 1 DAY AS "end", event_type, count(*) AS rows
    FROM events GROUP BY ALL""")
def _(t):
    return counted_events(t, "daily", length="1 day", keys=("event_type",))


@query("r4_sliding_counts", """WITH d AS (SELECT date_trunc('day', CAST(ts AS TIMESTAMP))::TIMESTAMP AS day FROM events), w AS (SELECT day - to_days(CAST(unnest(range(7)) AS INT)) AS start FROM d)
    SELECT start, start + INTERVAL 7 DAY AS "end", count(*) AS rows FROM w GROUP BY start""")
def _(t):
    return counted_events(t, "sliding", length="7 days", slide="1 day")


@query("r5_change_stream", "SELECT variant, finish, day, cents FROM (SELECT *, lag(cents) OVER (PARTITION BY variant, finish ORDER BY day) AS p FROM ob) WHERE cents IS DISTINCT FROM p", "ob")
def _(t):
    """Days in order, a few a part; a series with no row on a day is left as it was."""
    out, check = scratch_path(t.spark, "points"), scratch_path(t.spark, "check")
    return feed(t, t.observed, "day", lambda stream: S.run_to_table(S.change_stream(stream), out, check))


@query("r6_resumed_fold", "SELECT id, updated, created, removed, source, line FROM fo", "fo")
def _(t):
    """Stopped after half the rows, then run on from its checkpoint over the rest: each part of a feed is such a stop."""
    state, check = scratch_path(t.spark, "log"), scratch_path(t.spark, "check")
    return feed(t, log(t).drop("value"), "line", lambda stream: S.fold_stream(stream, state, check), parts=2)
