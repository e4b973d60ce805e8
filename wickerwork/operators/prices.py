"""Price histories: change points, values as of a day, robust prices, movers, reprints, values of baskets.

Tables: observed(variant, finish, day, cents), points(variant, finish, day, cents) where a null stops a series,
on_days(variant, finish, day, cents) with one row per day that has a price. A series is bounded by its calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickerwork.operators.ranking import top_n

PRICE_DAYS = (7, 30, 90, 365)
#: Cents where each band of prices starts, and the smallest mover.
BANDS = (50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000)
MIN_MOVER, MIN_MOVE, TOP_MOVERS = 50, 25, 150
GAP_DAYS = 21
SERIES = ("variant", "finish")


def days_between(a: str, b: str) -> Column:
    return F.datediff(F.col(a), F.col(b))


def upper_of(values: Column) -> Column:
    """Upper median of a short array, nulls left out; null for an empty one."""
    kept = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.try_element_at(kept, (F.floor(F.size(kept) / 2) + 1).cast("int"))


def collected_days(observed: DataFrame) -> DataFrame:
    """(finish, day, di): the days a finish was collected at all, numbered. A day no variant has one is no day of it."""
    days = observed.filter("cents is not null").select("finish", "day").distinct()
    return days.withColumn("di", F.row_number().over(W.partitionBy("finish").orderBy("day")))


def change_points(observed: DataFrame) -> DataFrame:
    """Keep a price only where it differs from the one on the collected day before; a variant missing on a collected day
    gets a null point there. No day is filled in: a gap shows as two collected day numbers that are not neighbours."""
    days = collected_days(observed)
    seen = observed.filter("cents is not null").join(days, ["finish", "day"])
    order = W.partitionBy(*SERIES).orderBy("di")
    rows = seen.withColumns({"_pi": F.lag("di").over(order), "_pc": F.lag("cents").over(order), "_ni": F.lead("di").over(order)})
    changed = rows.filter(F.col("_pi").isNull() | (F.col("_pi") < F.col("di") - 1) | (F.col("_pc") != F.col("cents"))).select(*SERIES, "day", "cents")
    stops = (rows.filter(F.col("_ni").isNull() | (F.col("_ni") > F.col("di") + 1)).select(*SERIES, (F.col("di") + 1).alias("di"))
             .join(days, ["finish", "di"]).select(*SERIES, "day", F.lit(None).cast("long").alias("cents")))
    return changed.unionByName(stops)


def as_of(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Price on each target day: the last point at or before it, which may be a stop. targets(variant, finish, day)."""
    both = points.select(*SERIES, "day", F.struct("cents").alias("_at"), F.lit(0).alias("_t")).unionByName(
        targets.select(*SERIES, "day", F.lit(None).cast("struct<cents:bigint>").alias("_at"), F.lit(1).alias("_t")))
    run = W.partitionBy(*SERIES).orderBy("day", "_t").rowsBetween(W.unboundedPreceding, 0)
    return (both.withColumn("_last", F.last("_at", ignorenulls=True).over(run)).filter("_t = 1")
            .select(*SERIES, "day", F.col("_last.cents").alias("cents")))


def on_our_days(points: DataFrame, days: DataFrame) -> DataFrame:
    """Carry each price over the days we have until the next point: (variant, finish, day, cents), days with a price only.
    Points are turned into runs of day numbers and the numbers joined back to days, so no range join is needed."""
    numbered = days.select("day").distinct().withColumn("di", F.row_number().over(W.orderBy("day")))
    last = numbered.agg(F.max("di")).scalar()
    placed = points.join(numbered, "day")
    upto = F.coalesce(F.lead("di").over(W.partitionBy(*SERIES).orderBy("di")) - 1, F.col("_last"))
    runs = placed.withColumn("_last", last).withColumn("_upto", upto).filter("cents is not null")
    return (runs.select(*SERIES, "cents", F.explode(F.sequence("di", "_upto")).alias("di")).join(numbered, "di")
            .select(*SERIES, "day", "cents"))


def look_back_targets(last: Column, days: Sequence[int] = PRICE_DAYS) -> Column:
    """Array of (w, target, reach) for a price now (w = 0) and each look-back; reach 7 days, or a tenth of a long one."""
    return F.array(*[F.struct(F.lit(w).alias("w"), F.date_sub(last, w).alias("target"), F.lit(7 if w == 0 else max(7, w // 10)).alias("reach"))
                     for w in (0, *days)])


def smoothed(on_days: DataFrame, targets: DataFrame, keys: Sequence[str] = SERIES, spread: int = 7, most: int = 3) -> DataFrame:
    """Robust price at each target: from the first day back within ``reach`` that has a price, the upper median of the last
    three priced days within a week. targets(keys, ..., target, reach)."""
    keys = list(keys)
    extra = [c for c in targets.columns if c not in keys]
    near = targets.join(on_days.select(*keys, "day", "cents"), keys).filter(
        (F.col("day") <= F.col("target")) & (F.col("day") > F.date_sub(F.col("target"), F.col("reach") + spread)))
    group = W.partitionBy(*keys, *extra)
    first = F.max(F.when(F.col("day") >= F.date_sub(F.col("target"), F.col("reach")), F.col("day"))).over(group)
    rows = (near.withColumn("_first", first).filter((F.col("day") <= F.col("_first")) & (F.col("day") > F.date_sub(F.col("_first"), spread)))
            .withColumn("_k", F.row_number().over(group.orderBy(F.desc("day")))).filter(F.col("_k") <= most))
    return rows.groupBy(*keys, *extra).agg(upper_of(F.collect_list("cents")).alias("cents"))


def price_rows(on_days: DataFrame, last: Column, days: Sequence[int] = PRICE_DAYS, keys: Sequence[str] = SERIES) -> DataFrame:
    """(keys, now, w7, w30, ...): robust prices now and each look-back before, for series priced now."""
    keys = list(keys)
    targets = on_days.select(*keys).distinct().select(*keys, F.explode(look_back_targets(last, days)).alias("_t")).select(*keys, "_t.*")
    long = smoothed(on_days, targets, keys)
    at = lambda w: F.max(F.when(F.col("w") == w, F.col("cents")))
    return long.groupBy(*keys).agg(at(0).alias("now"), *[at(w).alias(f"w{w}") for w in days]).filter("now is not null")


def distinct_products(rows: DataFrame, same: Sequence[str], plain: Column, variant: str = "variant") -> DataFrame:
    """One of the variants of an item and set with the very same prices: the plainly numbered one."""
    order = W.partitionBy(*same).orderBy(plain.desc(), F.asc(variant))
    return rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def cheapest(rows: DataFrame, days: Sequence[int] = PRICE_DAYS) -> DataFrame:
    """Each item's cheapest variant now and in each look-back."""
    return rows.groupBy("item").agg(F.min("now").alias("now"), *[F.min(F.when(F.col(f"w{w}") > 0, F.col(f"w{w}"))).alias(f"w{w}") for w in days])


def band_of(cents: Column) -> Column:
    """Number of the price band, from 0; -1 below the first."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in BANDS]), lambda b: b <= cents)) - 1


def movers(rows: DataFrame, now: str, was: str, top: int = TOP_MOVERS) -> tuple[DataFrame, DataFrame]:
    """The biggest rises and falls of each finish class and price band, and the change each full list stops at.
    rows(variant, finish_class, now, was)."""
    moved = rows.filter((F.col(was) > 0) & (F.least(now, was) >= MIN_MOVER) & (F.abs(F.col(now) - F.col(was)) >= MIN_MOVE))
    moved = (moved.withColumn("band", band_of(F.least(now, was))).withColumn("rose", F.col(now) > F.col(was))
             .withColumn("change", F.round(F.abs(F.log(F.try_divide(now, was))), 9)))
    group = ["finish_class", "band", "rose"]
    ranked = top_n(moved, group, [F.desc("change"), F.asc("variant")], top + 1)
    cut = ranked.groupBy(*group).agg(F.max(F.when(F.col("rank") == top, F.col("change"))).alias("_c"), F.max("rank").alias("_m"))
    cutoffs = cut.select(*group, F.when(F.col("_m") > top, F.round("_c", 5)).otherwise(F.lit(0.0)).alias("cutoff"))
    return ranked.filter(F.col("rank") <= top), cutoffs


def complete_to(cutoffs: DataFrame, floors: DataFrame) -> DataFrame:
    """How small a change the lists at or above a price are complete down to. floors(query, cents, rose): the lookup joins
    the bands from a floor's own upward by exploding their numbers."""
    first = F.greatest(F.lit(0), band_of(F.col("cents")))
    wanted = floors.withColumn("band", F.explode(F.sequence(first, F.lit(len(BANDS) - 1))))
    return (wanted.join(cutoffs.groupBy("band", "rose").agg(F.max("cutoff").alias("cutoff")), ["band", "rose"], "left")
            .groupBy("query", "cents", "rose").agg(F.coalesce(F.max("cutoff"), F.lit(0.0)).alias("complete_to")))


def set_table(rows: DataFrame, days: Sequence[int] = PRICE_DAYS) -> DataFrame:
    """(set, number, variant, item, finish, prices): each variant's prices by set and number, now then look-backs."""
    return rows.groupBy("set", "number", "variant", "item").agg(F.map_from_entries(F.collect_list(F.struct(
        "finish", F.array("now", *[f"w{w}" for w in days])))).alias("prices"))


def reprints(variants: DataFrame, on_days: DataFrame, last: Column, new: int = 120, older: int = 180, before: int = 45,
             plain: str = "usd") -> DataFrame:
    """Items with a variant out lately and older ones: how the older one that was cheapest ``before`` days ahead moved.
    variants(variant, item, released), on_days(variant, finish, day, cents)."""
    out = variants.filter((F.col("released") >= F.date_sub(last, new)) & (F.col("released") <= last)).groupBy("item").agg(
        F.min(F.struct("released", "variant")).alias("_n")).select("item", F.col("_n.released").alias("out"), F.col("_n.variant").alias("newest"))
    old = variants.join(out, "item").filter(F.col("released") <= F.date_sub(F.col("out"), older))
    prices = on_days.filter(F.col("finish") == plain)
    targets = old.select("item", "variant", "out", "newest", F.date_sub(F.col("out"), before).alias("target"), F.lit(14).alias("reach"))
    was = smoothed(prices, targets, ["variant"])
    picked = was.groupBy("item", "out", "newest").agg(F.min(F.struct("cents", "variant")).alias("_o")).select(
        "item", "out", "newest", F.col("_o.variant").alias("variant"), F.col("_o.cents").alias("was"))
    now = lambda df, name: smoothed(df, picked.select("variant").distinct().select("variant", last.alias("target"), F.lit(7).alias("reach")),
                                    ["variant"]).select("variant", F.col("cents").alias(name))
    fresh_targets = picked.select(F.col("newest").alias("variant")).distinct().select("variant", last.alias("target"), F.lit(7).alias("reach"))
    finishes = on_days.select("variant", "finish").distinct()
    fresh = (smoothed(on_days, fresh_targets.join(finishes, "variant"), SERIES).groupBy(F.col("variant").alias("newest"))
             .agg(F.min("cents").alias("fresh")))
    rows = picked.join(now(prices, "now"), "variant").join(fresh, "newest", "left")
    return rows.filter(F.least("was", "now") >= MIN_MOVER).select("item", "variant", "newest", "out", "was", "now", "fresh")


def _named(items: DataFrame | None, named: DataFrame) -> DataFrame:
    return named if items is None else items.join(named, ["basket", "item"], "left")


def basket_value(items: DataFrame | None, named: DataFrame, variant_prices: DataFrame, cheapest_prices: DataFrame, now: str = "now",
                 then: str = "w30") -> DataFrame:
    """Each basket's worth now, and its change over the items priced both then and now, risers and fallers counted.
    items(basket, item), named(basket, item, set, number, finish), variant_prices(item, set, number, finish, now, then),
    cheapest_prices(item, now, then). A named variant counts only if it is that item. Without items, ``named`` has all of them."""
    own = variant_prices.select("item", "set", "number", "finish", F.col(now).alias("_n"), F.col(then).alias("_t"), F.lit(True).alias("_own"))
    low = cheapest_prices.select("item", F.col(now).alias("_cn"), F.col(then).alias("_ct"))
    rows = (_named(items, named).join(own, ["item", "set", "number", "finish"], "left").join(low, "item", "left")
            .withColumn("n", F.when(F.col("_own"), F.col("_n")).otherwise(F.col("_cn")))
            .withColumn("t", F.when(F.col("_own"), F.col("_t")).otherwise(F.col("_ct"))))
    both = F.col("n").isNotNull() & F.col("t").isNotNull()
    up = both & (F.col("t") > 0)
    return rows.groupBy("basket").agg(
        F.count(F.lit(1)).alias("items"), F.count("n").alias("priced"), F.count(F.when(F.col("_own") & F.col("n").isNotNull(), 1)).alias("named"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("worth"), F.sum(F.when(both, F.col("n"))).alias("total"), F.sum(F.when(both, F.col("t"))).alias("was"),
        F.count(F.when(up & (F.col("n") > F.col("t")), 1)).alias("risers"), F.count(F.when(up & (F.col("n") < F.col("t")), 1)).alias("fallers"))


def resolve_named(items: DataFrame | None, named: DataFrame, variant_prices: DataFrame, cheapest_prices: DataFrame) -> DataFrame:
    """(basket, item, cents, exact): the named variant's price where it is a variant of that item, else the cheapest. Without items,
    ``named`` has all of them."""
    own = variant_prices.select("item", "set", "number", "finish", F.col("now").alias("_n"))
    rows = _named(items, named).join(own, ["item", "set", "number", "finish"], "left").join(
        cheapest_prices.select("item", F.col("now").alias("_c")), "item", "left")
    return rows.select("basket", "item", F.coalesce("_n", "_c").alias("cents"), F.col("_n").isNotNull().alias("exact"))


def changes(points: DataFrame, days: Sequence[int] = (30, 365), long: int = 730) -> DataFrame:
    """Change from each look-back (found within max(7, w / 10) days before it) to the last priced day, and since the first
    point of a series of over two years: (variant, finish, span, was, now). points: priced days only."""
    ends = points.groupBy(*SERIES).agg(F.max(F.struct("day", "cents")).alias("_l"), F.min(F.struct("day", "cents")).alias("_f"))
    rows = points.join(ends, list(SERIES))
    spans = []
    for w in days:
        gap = F.datediff(F.col("_l.day"), F.col("day"))
        found = (rows.filter((gap >= w) & (gap - w <= max(7.0, w / 10))).groupBy(*SERIES)
                 .agg(F.max(F.struct("day", "cents", F.col("_l.cents").alias("now"))).alias("_p")))
        spans.append(found.select(*SERIES, F.lit(w).alias("span"), F.col("_p.cents").alias("was"), F.col("_p.now").alias("now")))
    whole = ends.filter(F.datediff(F.col("_l.day"), F.col("_f.day")) > long).select(
        *SERIES, F.lit(0).alias("span"), F.col("_f.cents").alias("was"), F.col("_l.cents").alias("now"))
    out = whole
    for s in spans:
        out = out.unionByName(s)
    return out.filter("was > 0")


def watchlist(points: DataFrame, watched: DataFrame, back: int = 30) -> DataFrame:
    """Each watched series' last price and the last at least ``back`` days before it. watched(variant, finish)."""
    rows = points.join(watched, list(SERIES), "left_semi")
    last = rows.groupBy(*SERIES).agg(F.max(F.struct("day", "cents")).alias("_l"))
    old = (rows.join(last, list(SERIES)).filter(F.datediff(F.col("_l.day"), F.col("day")) >= back).groupBy(*SERIES)
           .agg(F.max(F.struct("day", "cents")).alias("_o")))
    return last.join(old, list(SERIES), "left").select(*SERIES, F.col("_l.cents").alias("now"), F.col("_o.cents").alias("was"))


def order_rows(rows: DataFrame, order: str, was: str, floor: int = 0) -> DataFrame:
    """A price list by rising, falling or priciest."""
    if order == "priciest":
        return rows.orderBy(F.desc("now"), F.asc("variant"))
    ratio = F.round(F.try_divide("now", was), 9)
    kept = rows.filter(F.least("now", was) >= floor).withColumn("ratio", ratio)
    return kept.orderBy(F.desc("ratio") if order == "rising" else F.asc("ratio"), F.asc("variant"))


def rebuild(deltas: DataFrame) -> DataFrame:
    """Series from (variant, finish, pos, days since the point before, change or null): (day number, cents, stop, gap).
    Prices are level between points; a point right after a stop starts after a stretch with none."""
    run = W.partitionBy(*SERIES).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    order = W.partitionBy(*SERIES).orderBy("pos")
    rows = deltas.withColumns({"day": F.sum("days").over(run), "_c": F.sum(F.coalesce("change", F.lit(0))).over(run)})
    rows = rows.withColumn("stop", F.col("change").isNull()).withColumn("_before", F.lag("stop").over(order))
    return rows.select(*SERIES, "day", F.when(~F.col("stop"), F.col("_c")).alias("cents"), "stop",
                       F.coalesce("_before", F.lit(False)).alias("starts_after_none"))


def price_gaps(on_days: DataFrame, days: int = GAP_DAYS) -> DataFrame:
    """Neighbouring priced days of a series more than ``days`` apart."""
    nxt = F.lead("day").over(W.partitionBy(*SERIES).orderBy("day"))
    return on_days.withColumn("until", nxt).filter(F.datediff(F.col("until"), F.col("day")) > days).select(*SERIES, F.col("day").alias("since"), "until")


def merge_days(mine: DataFrame, theirs: DataFrame, my_days: DataFrame, their_days: DataFrame) -> DataFrame:
    """Observed prices with the days another history has and this one does not, its values as of those days.
    mine, theirs: points; days(day). A day already here is never replaced."""
    new = their_days.select("day").join(my_days.select("day"), "day", "left_anti")
    added = on_our_days(theirs, their_days).join(new, "day", "left_semi")
    kept = on_our_days(mine, my_days)
    return kept.unionByName(added.select(*kept.columns))


def index_total(on_days: DataFrame, item_of: DataFrame, part: float = 0.9) -> DataFrame:
    """Sum of each item's cheapest variant on every day: (day, cents, items), days with under ``part`` of the most items
    dropped. item_of(variant, item)."""
    low = on_days.join(item_of, "variant").groupBy("day", "item").agg(F.min("cents").alias("cents"))
    totals = low.groupBy("day").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("items"))
    return totals.filter(F.col("items") >= part * totals.agg(F.max("items")).scalar())
