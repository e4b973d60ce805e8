"""Append-only logs folded to their current state, stable numbers, and merges of copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickerwork.operators.ranking import number_rows


def newest_versions(log: DataFrame, width: int = 100_000) -> DataFrame:
    """(id, updated, created, removed, source, line): each id's newest copy, the later source or line on a tie.

    log(id, source, line, updated, created, removed, note). The creation date is the last one a copy that was the newest when
    it came gave, else the first any copy gave, else a note's. A note's removal holds unless the copy is newer. Which copies were
    newest when they came needs a running maximum; lines are blocked, so that an id with a very long log is many groups."""
    copies = log.filter(~F.col("note")).withColumn("_block", F.floor(F.col("line") / width))
    blocks = copies.groupBy("id", "source", "_block").agg(F.max("updated").alias("_m"))
    before = W.partitionBy("id").orderBy("source", "_block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select("id", "source", "_block", F.max("_m").over(before).alias("_before"))
    inner = W.partitionBy("id", "source", "_block").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = copies.join(carried, ["id", "source", "_block"]).withColumn("_top", F.greatest(F.max("updated").over(inner), F.coalesce("_before", F.col("updated"))))
    at, own = F.struct("source", "line"), F.col("created").isNotNull()
    best = rows.groupBy("id").agg(
        F.max_by(F.struct("updated", "removed", "source", "line"), F.struct("updated", "source", "line")).alias("_b"),
        F.max_by("created", F.when(own & (F.col("updated") >= F.col("_top")), at)).alias("_won"),
        F.min_by("created", F.when(own, at)).alias("_first"))
    notes = log.filter("note").groupBy("id").agg(F.min_by("created", F.when(own, at)).alias("_noted"), F.max("removed").alias("_gone"))
    joined = best.join(notes, "id", "left")
    gone = F.when(F.col("_gone") >= F.col("_b.updated"), F.col("_gone"))
    return joined.select("id", "_b.updated", F.coalesce("_won", "_first", "_noted").alias("created"),
                         F.greatest(F.col("_b.removed"), gone).alias("removed"), "_b.source", "_b.line")


def last_copies(log: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """The last copy of every key by (updated, source, line), as one aggregate."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("updated", "source", "line")).alias("_b")).select(*keys, "_b.*")


def extend_numbers(known: DataFrame, counts: DataFrame) -> DataFrame:
    """known(item, number) with new items numbered after the highest, most counted first; known numbers stay.
    counts(item, count)."""
    new = counts.join(known, "item", "left_anti")
    numbered = number_rows(new, [F.desc("count"), F.asc("item")], "_n")
    top = F.coalesce(known.agg(F.max("number")).scalar(), F.lit(-1))
    return known.select("item", "number").unionByName(numbered.select("item", (F.col("_n") + 1 + top).cast("long").alias("number")))


def number_players(known: DataFrame, entries: DataFrame) -> DataFrame:
    """(profile, player): new profiles numbered after the highest in the order first seen. entries(profile, date, standing)."""
    first = entries.filter("profile <> ''").groupBy("profile").agg(F.min(F.struct("date", "standing")).alias("_f")).join(known, "profile", "left_anti")
    order = [F.asc("_f.date"), F.asc("_f.standing"), F.asc("profile")]
    numbered = number_rows(first, order, "_n")
    top = F.coalesce(known.agg(F.max("player")).scalar(), F.lit(0))
    return known.select("profile", "player").unionByName(numbered.select("profile", (F.col("_n") + 1 + top).cast("long").alias("player")))


def merge_latest(mine: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """The later value of each key."""
    return mine.select(key, value).unionByName(theirs.select(key, value)).groupBy(key).agg(F.max(value).alias(value))


def _merge(mine: DataFrame, theirs: DataFrame, take: Column) -> DataFrame:
    m = mine.select("event", F.struct(*mine.columns).alias("_m"))
    t = theirs.select("event", F.struct(*mine.columns).alias("_t"))
    return m.join(t, "event", "full").select(F.when(take, F.col("_t")).otherwise(F.col("_m")).alias("_e")).select("_e.*")


def add_events(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Events of another copy that are new here, have more entries, or say who played where ours do not.
    Tables (event, entries count, players known boolean, ...)."""
    more = F.col("_m").isNull() | (F.col("_t.entries") > F.col("_m.entries")) | (F.col("_t.players_known") & ~F.col("_m.players_known"))
    return _merge(mine, theirs, F.coalesce(more & F.col("_t").isNotNull(), F.lit(False)))


def replace_events(mine: DataFrame, fetched: DataFrame) -> DataFrame:
    """Events fetched again replace those here when they have as many entries or more."""
    take = F.col("_m").isNull() | (F.col("_t.entries") >= F.col("_m.entries"))
    return _merge(mine, fetched, F.coalesce(take & F.col("_t").isNotNull(), F.lit(False)))


def refetch_from(events: DataFrame, days: int = 3) -> DataFrame:
    """One row: the day fetching starts again, some days before the newest event."""
    return events.agg(F.date_sub(F.max("date"), days).alias("since"))


def append_missing(mine: DataFrame, theirs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of another copy whose key is missing here, appended."""
    return mine.unionByName(theirs.join(mine.select(*keys).distinct(), list(keys), "left_anti"))


def fetch_queue(prices: DataFrame, done: DataFrame, least: int) -> DataFrame:
    """Variants worth fetching that are not done: the scarce first, then the priciest. prices(variant, finish, now, scarce)."""
    rows = prices.filter((F.col("now") > 0) & (F.col("scarce") | (F.col("now") >= least))).join(done, ["variant", "finish"], "left_anti")
    return rows.orderBy(F.desc("scarce"), F.desc("now"), F.asc("variant"), F.asc("finish"))


def leader_queue(leaders: DataFrame, n: DataFrame, crawled: DataFrame, target: int) -> DataFrame:
    """Leaders short of a number of baskets, never or least recently crawled first. leaders(leader), n(leader, n),
    crawled(leader, day)."""
    rows = leaders.join(n, "leader", "left").fillna({"n": 0}).filter(F.col("n") < target).join(crawled, "leader", "left")
    return rows.orderBy(F.asc_nulls_first("day"), F.asc("leader"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(basket, old, new): baskets whose leader, and so whose partition, changed."""
    return (before.select("basket", F.col("leader").alias("old")).join(after.select("basket", F.col("leader").alias("new")), "basket")
            .filter(~F.col("old").eqNullSafe(F.col("new"))))
