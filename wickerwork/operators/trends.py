"""What is played more lately: plays per look-back, rising leaders, items and recipes, and play against price."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerwork.operators.baskets import DIGITS
from wickerwork.operators.ranking import top_n
from wickerwork.operators.windows import RECENT_DAYS, cutoff, every_month, since_made, valid_windows

MIN_RISING = 3
#: Thresholds of spec buys, buyouts and outcome spikes.
SPEC = {"share": 0.003, "played": 1.5, "flat": 0.1}
BUYOUT = {"rise": 0.3, "played": 1.15}
SPIKE = {"baskets": 30, "played": 1.5}


def windowed(days: Sequence[int]) -> list[str]:
    return ["ever", *[f"w{d}" for d in days]]


def made_per_window(baskets: DataFrame, keys: Sequence[str], today: str, days: Sequence[int] = RECENT_DAYS,
                    known: DataFrame | None = None) -> DataFrame:
    """Baskets ever and per look-back; a look-back not filled in yet counts none. One conditional aggregate."""
    valid = valid_windows(known if known is not None else baskets, "made", today, days)
    flags = valid.agg(F.array_sort(F.collect_set("w"))).scalar()
    inside = lambda d: F.sum(F.when((F.col("made") >= cutoff(today, d)) & F.array_contains("_valid", d), 1).otherwise(0))
    rows = baskets.withColumn("_valid", flags)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("ever"), *[inside(d).alias(f"w{d}") for d in days])


def window_plays(basket_items: DataFrame, baskets: DataFrame, keys: Sequence[str], today: str,
                 days: Sequence[int] = RECENT_DAYS) -> DataFrame:
    """Plays of each item ever and per look-back, per key: (keys, item, ever, w90, ...)."""
    dated = basket_items.select("leader", "basket", "item").join(baskets.select("leader", "basket", "made"), ["leader", "basket"])
    return made_per_window(dated, [*keys, "item"], today, days, known=baskets)


def window_plays_with_total(basket_items: DataFrame, baskets: DataFrame, today: str, days: Sequence[int] = RECENT_DAYS) -> DataFrame:
    """The same per leader, and over all leaders (leader null), as grouping sets of one pass."""
    dated = basket_items.select("leader", "basket", "item").join(baskets.select("leader", "basket", "made"), ["leader", "basket"])
    flags = valid_windows(baskets, "made", today, days).agg(F.array_sort(F.collect_set("w"))).scalar()
    inside = lambda d: F.sum(F.when((F.col("made") >= cutoff(today, d)) & F.array_contains("_valid", d), 1).otherwise(0))
    sets = dated.withColumn("_valid", flags).groupingSets([["leader", "item"], ["item"]], "leader", "item")
    return sets.agg(F.count(F.lit(1)).alias("ever"), *[inside(d).alias(f"w{d}") for d in days])


def kept_items(plays: DataFrame, made: DataFrame, keys: Sequence[str], share: float = 0.15, least: int = 3,
               days: Sequence[int] = RECENT_DAYS) -> DataFrame:
    """Items at least ``share`` of the baskets and ``least`` of them play in some look-back (or ever)."""
    keys = list(keys)
    m = made.select(*keys, *[F.col(c).alias(f"made_{c}") for c in windowed(days)])
    some = F.lit(False)
    for c in windowed(days):
        some = some | (F.col(c) >= F.greatest(F.lit(float(least)), share * F.col(f"made_{c}")))
    joined = plays.join(m, keys) if keys else plays.withColumns({c: m.select(c).scalar() for c in m.columns})
    return joined.filter(some).select(*plays.columns)


def leaders_playing(kept: DataFrame, made: DataFrame) -> DataFrame:
    """(item, leader, baskets, share): the leaders playing each item often, by share of their baskets."""
    return (kept.filter("ever > 0").join(made.select("leader", F.col("ever").alias("_m")), "leader")
            .select("item", "leader", F.col("ever").alias("baskets"), (F.col("ever") / F.col("_m")).alias("share")))


def strategies(playing: DataFrame, themes: DataFrame, n: int = 12) -> DataFrame:
    """What the leaders playing an item are known for, weighed by their baskets with it. themes(leader, tag)."""
    rows = playing.join(themes, "leader").groupBy("item", "tag").agg(F.sum("baskets").alias("weight"))
    return top_n(rows, "item", [F.desc("weight"), F.asc("tag")], n)


def leader_filter(identity: int | None = None, max_price: int | None = None, themes: Sequence[str] | None = None,
                  brackets: Sequence[int] = (), kind: str = "", window: str = "ever", least: int = 0) -> Column:
    """Predicate over a leaders table (leader, identity, price null if unknown, themes array, bracket, parts, ever, w90, ...)."""
    ok = F.col(window) >= least
    if identity is not None:
        ok = ok & (F.col("identity") == identity)
    if max_price is not None:
        ok = ok & F.col("price").isNotNull() & (F.col("price") <= max_price)
    if themes is not None:
        ok = ok & F.arrays_overlap("themes", F.array(*[F.lit(t) for t in themes]))
    if brackets:
        ok = ok & F.col("bracket").isin(list(brackets))
    if kind:
        ok = ok & ((F.col("parts") > 1) == F.lit(kind == "partners"))
    return ok


def leaders_with(leader_items: DataFrame, n: DataFrame) -> DataFrame:
    """Each item's leader row: the leader it is alone, else the pair with it that has most baskets. (item, leader)"""
    parts = leader_items.groupBy("leader").agg(F.count(F.lit(1)).alias("parts"))
    rows = leader_items.join(parts, "leader").join(n, "leader")
    return top_n(rows, "item", [F.asc(F.col("parts") > 1), F.desc("n"), F.asc("leader")], 1).select("item", "leader")


def rise(share: Column, was: Column) -> Column:
    return F.round((share - was) / F.sqrt(was), DIGITS)


def trending_leaders(made: DataFrame, window: str, least: int = MIN_RISING) -> DataFrame:
    """Leaders by how far their new baskets exceed their usual part of all new baskets: (leader, now, score, ratio)."""
    sums = made.agg(F.sum("ever").alias("total"), F.sum(window).alias("recent"))
    expected = F.col("recent") * F.col("ever") / F.col("total")
    rows = made.withColumns({"total": sums.select("total").scalar(), "recent": sums.select("recent").scalar()})
    return (rows.filter("recent > 0").withColumn("score", F.round((F.col(window) - expected) / F.sqrt(expected), DIGITS))
            .withColumn("ratio", F.col(window) / expected).filter((F.col("score") > 0) & (F.col(window) >= least))
            .select("leader", F.col(window).alias("now"), "score", "ratio"))


def item_trends(plays: DataFrame, made: DataFrame, window: str) -> DataFrame:
    """(item, now, share, was, recent): share of a look-back's baskets playing each item, and of all. plays and made hold
    the leaders in scope."""
    sums = made.agg(F.sum("ever").alias("t"), F.sum(window).alias("r"))
    counts = plays.groupBy("item").agg(F.sum("ever").alias("ever"), F.sum(window).alias("now")).filter("now > 0")
    rows = counts.withColumns({"_t": sums.select("t").scalar(), "recent": sums.select("r").scalar()})
    return rows.select("item", "now", (F.col("now") / F.col("recent")).alias("share"), (F.col("ever") / F.col("_t")).alias("was"), "recent")


def rising_items(trends: DataFrame, floor: float = 0.01, ratio: float | None = None, least: int = MIN_RISING) -> DataFrame:
    """Of ``item_trends`` (or recipes'), those above their usual share, with the score they rank by."""
    up = F.col("share") > F.col("was") if ratio is None else F.col("share") >= ratio * F.col("was")
    return (trends.filter(up & (F.col("now") >= F.greatest(F.lit(float(least)), floor * F.col("recent"))))
            .withColumn("score", rise(F.col("share"), F.col("was"))))


def play_rate_by_month(basket_items: DataFrame, baskets: DataFrame) -> DataFrame:
    """(leader, item, month, made, playing), every month from the leader's first to last."""
    dated = baskets.filter("made is not null").withColumn("month", F.trunc("made", "MM"))
    made = every_month(dated.groupBy("leader", "month").agg(F.count(F.lit(1)).alias("made")), ["leader"], zero=["made"])
    playing = (basket_items.select("leader", "basket", "item").join(dated.select("leader", "basket", "month"), ["leader", "basket"])
               .groupBy("leader", "item", "month").agg(F.count(F.lit(1)).alias("playing")))
    calendar = playing.select("leader", "item").distinct().join(made, "leader")
    return calendar.join(playing, ["leader", "item", "month"], "left").fillna(0, ["playing"])


def new_items(trends: DataFrame, released: DataFrame, today: str, days: int = 120) -> DataFrame:
    """Items first released lately. released(item, released)."""
    return trends.join(released.filter(F.col("released") >= cutoff(today, days)), "item")


def spec_buys(trends: DataFrame, prices: DataFrame, share: float = SPEC["share"], played: float = SPEC["played"],
              flat: float = SPEC["flat"], floor: int = 0) -> DataFrame:
    """Items played far more than usual whose price has not moved. prices(item, now, then)."""
    rows = trends.join(prices.select("item", F.col("now").alias("price"), "then"), "item")
    ratio = F.try_divide("price", "then")
    return (rows.filter((F.col("share") >= share) & (F.col("share") >= played * F.col("was")) & (F.least("price", "then") >= floor)
                        & (F.abs(ratio - 1) < flat))
            .select("item", "share", "was", "price", "then", (F.col("share") / F.col("was")).alias("times")))


def buyouts(trends: DataFrame, prices: DataFrame, rise_: float = BUYOUT["rise"], played: float = BUYOUT["played"], floor: int = 0) -> DataFrame:
    """Items whose price rose though they are played no more than usual, or not at all."""
    rows = prices.select("item", F.col("now").alias("price"), "then").join(trends, "item", "left")
    quiet = F.col("share").isNull() | (F.col("share") < played * F.col("was"))
    return rows.filter((F.least("price", "then") >= floor) & (F.try_divide("price", "then") >= 1 + rise_) & quiet).select(
        "item", "price", "then", "share", "was", F.try_divide("price", "then").alias("ratio"))


def outcome_spikes(pooled_rows: DataFrame, field: DataFrame, prices: DataFrame, recent: int = 90, usual: int = 365,
                   baskets: int = SPIKE["baskets"], played: float = SPIKE["played"], floor: int = 0) -> DataFrame:
    """Items in far more of the recent entries than of the year's. pooled_rows(item, w, baskets), field(w, baskets),
    prices(item, now)."""
    part = lambda w, name: (pooled_rows.filter(F.col("w") == w).join(field.select("w", F.col("baskets").alias("all")), "w")
                            .select("item", F.col("baskets").alias(f"{name}_baskets"), (F.col("baskets") / F.col("all")).alias(name)))
    rows = part(recent, "share").join(part(usual, "was"), "item").join(prices.select("item", F.col("now").alias("price")), "item")
    return rows.filter((F.col("share_baskets") >= baskets) & (F.col("share") >= played * F.col("was")) & (F.col("price") >= floor)).select(
        "item", F.col("share_baskets").alias("baskets"), "share", "was", "price")


def membership(baskets: DataFrame, today: str, days: Sequence[int] = RECENT_DAYS) -> DataFrame:
    """(leader, basket, w): the filled-in look-backs each basket was made in."""
    return since_made(baskets.select("leader", "basket", "made"), "made", valid_windows(baskets, "made", today, days), today, days).select("leader", "basket", "w")
