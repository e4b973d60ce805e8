"""Prices between our days, estimated from a second guide scaled to meet ours.

theirs(variant, finish, day, cents): the guide's priced days; ours: our priced days. Frames are day ranges over a
series' own rows, so no day is filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickerwork.operators.prices import SERIES, upper_of
from wickerwork.session import cut_lineage

MOVE = 0.01


def _number(df: DataFrame) -> DataFrame:
    return df.withColumn("dn", F.unix_date("day"))


def _around(back: int, ahead: int):
    return W.partitionBy(*SERIES).orderBy("dn").rangeBetween(back, ahead)


def rolling_median(theirs: DataFrame, reach: int = 2) -> DataFrame:
    """Upper median of the days around each priced day."""
    return _number(theirs).withColumn("med", upper_of(F.collect_list("cents").over(_around(-reach, reach)))).filter("med > 0")


def drop_glitches(smooth: DataFrame, apart: int = 30, times: float = 5) -> DataFrame:
    """Drop days over five times the larger, or under a fifth of the smaller, of the values a month before and after."""
    rows = smooth.withColumns({"_b": F.first("med").over(_around(-apart, -apart)), "_a": F.first("med").over(_around(apart, apart))})
    odd = (F.col("med") > times * F.greatest("_b", "_a")) | (times * F.col("med") < F.least("_b", "_a"))
    return rows.filter(~(F.col("_b").isNotNull() & F.col("_a").isNotNull() & odd)).drop("_b", "_a")


def local_scale(ours: DataFrame, smooth: DataFrame, reach: int = 3) -> DataFrame:
    """(series, dn, scale): upper median of ln(ours / theirs) over the shared days within ``reach``. A price of nothing is a shared
    day too: its logarithm is minus infinity, the lowest of all."""
    both = smooth.join(_number(ours).select(*SERIES, "dn", F.col("cents").alias("own")), [*SERIES, "dn"])
    rows = both.withColumn("ratio", F.when(F.col("own") == 0, float("-inf")).otherwise(F.log(F.col("own") / F.col("med"))))
    return rows.select(*SERIES, "dn", upper_of(F.collect_list("ratio").over(_around(-reach, reach))).alias("scale"))


def interpolate(smooth: DataFrame, scales: DataFrame) -> DataFrame:
    """Estimates: theirs times e to the scale, a straight line between the shared days and level outside. No line leads to the scale
    of a price of nothing; between it and another the other holds."""
    rows = smooth.join(scales, [*SERIES, "dn"], "left")
    at = F.when(F.col("scale").isNotNull(), F.struct("dn", "scale"))
    run = W.partitionBy(*SERIES).orderBy("dn")
    rows = rows.withColumns({
        "_l": F.last(at, ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, 0)),
        "_r": F.first(at, ignorenulls=True).over(run.rowsBetween(0, W.unboundedFollowing))})
    span = F.col("_r.dn") - F.col("_l.dn")
    line = F.col("_l.scale") + (F.col("_r.scale") - F.col("_l.scale")) * (F.col("dn") - F.col("_l.dn")) / span
    nothing = lambda end: F.col(f"{end}.scale") == float("-inf")
    scale = (F.when(F.col("_l").isNull(), F.col("_r.scale")).when(F.col("_r").isNull(), F.col("_l.scale"))
             .when((span == 0) | nothing("_r"), F.col("_l.scale")).when(nothing("_l"), F.col("_r.scale")).otherwise(line))
    return (rows.withColumn("_s", scale).filter("_s is not null")
            .select(*SERIES, "day", F.rint(F.round(F.col("med") * F.exp("_s"), 6)).cast("long").alias("cents")))


def estimate(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Estimated price of every day the guide has one, for series with a day in common: (variant, finish, day, cents)."""
    smooth = drop_glitches(rolling_median(theirs))
    return interpolate(smooth, local_scale(ours, smooth))


def off_our_days(estimates: DataFrame, ours: DataFrame, reach: int = 3) -> DataFrame:
    """Estimates not within ``reach`` days of one of our priced days."""
    near = ours.select(*SERIES, F.explode(F.sequence(F.date_sub("day", reach), F.date_add("day", reach))).alias("day")).distinct()
    return estimates.join(near, [*SERIES, "day"], "left_anti")


def dead_band(estimates: DataFrame, move: float = MOVE) -> DataFrame:
    """(variant, finish, day, cents): a point where a series starts, stops (null), or moved 1% (a cent at least) since the
    last point kept. What is kept depends on what was kept before, but not across a gap: each stretch of days without one is
    folded by itself, inside one expression."""
    order = W.partitionBy(*SERIES).orderBy("day")
    opens = F.coalesce(F.datediff("day", F.lag("day").over(order)) > 1, F.lit(True)).cast("int")
    islands = estimates.select(*SERIES, "day", F.col("cents").cast("long").alias("cents"), opens.alias("_opens")).withColumn("_island", F.sum("_opens").over(order))
    point = F.struct("day", "cents")
    runs = islands.groupBy(*SERIES, "_island").agg(F.sort_array(F.collect_list(point)).alias("_run"))
    kept_type = "array<struct<day:date,cents:bigint>>"
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(kept_type).alias("kept"))

    def keep(done: Column, at: Column) -> Column:
        moved = done["last"].isNull() | (F.abs(at["cents"] - done["last"]) >= F.greatest(F.lit(1.0), move * done["last"]))
        return F.when(moved, F.struct(at["cents"].alias("last"), F.concat(done["kept"], F.array(at)).alias("kept"))).otherwise(done)

    stop = F.struct(F.date_add(F.element_at("_run", -1)["day"], 1).alias("day"), F.lit(None).cast("long").alias("cents"))
    points = F.concat(F.aggregate("_run", start, keep)["kept"], F.array(stop))
    return runs.select(*SERIES, F.inline(points))


def deltas(points: DataFrame) -> DataFrame:
    """Points as (pos, days since the point before, change since the price before or null for a stop); the first point's
    days count from day 0."""
    order = W.partitionBy(*SERIES).orderBy("day")
    rows = points.withColumns({"pos": F.row_number().over(order) - 1, "_d": F.lag("day").over(order),
                               "_c": F.last("cents", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))})
    days = F.coalesce(F.datediff(F.col("day"), F.col("_d")), F.unix_date("day"))
    return rows.select(*SERIES, "pos", days.alias("days"), (F.col("cents") - F.coalesce("_c", F.lit(0))).alias("change"))


def estimated_total(ours: DataFrame, estimates: DataFrame, total: DataFrame, last: Column, item_of: DataFrame, stale_days: int = 60,
                    stale_part: int = 50) -> DataFrame:
    """The index between our days, weekly: the summed prices of one estimated variant per item, scaled to meet ``total``.

    ours, estimates(variant, finish, day, cents) of the plain finish, item_of(variant, item). Each week takes every
    variant's last price; a week with a variant not yet priced, or with over 1 in 50 last priced 60 days ago, is left out."""
    # read four times below: written once, so that neither plan nor work is repeated
    known = cut_lineage(ours.unionByName(estimates.join(ours, [*SERIES, "day"], "left_anti")), "known-prices")
    latest = known.groupBy("variant").agg(F.max_by("cents", "day").alias("now"), F.max("day").alias("_d"))
    candidates = estimates.groupBy("variant").agg(F.min("day").alias("starts")).join(latest, "variant").join(item_of, "variant")
    picked = candidates.groupBy("item").agg(F.min(F.struct("now", "variant", "starts")).alias("_p")).select("item", "_p.variant", "_p.starts")
    picked = cut_lineage(picked, "picked-variants")
    span = picked.agg(F.max("starts").alias("first"), F.count(F.lit(1)).alias("n"))
    dated = picked.select("variant").withColumns({"n": span.select("n").scalar(), "_f": span.select("first").scalar()})
    targets = dated.select("variant", "n", F.explode(F.sequence(F.col("_f"), last, F.expr("interval 7 days"))).alias("day"))
    rows = known.join(picked.select("variant"), "variant", "left_semi").select("variant", "day", F.struct(F.col("day").alias("seen"), "cents").alias("_at"), F.lit(0).alias("_t"), F.lit(None).cast("long").alias("n"))
    rows = rows.unionByName(targets.select("variant", "day", F.lit(None).cast("struct<seen:date,cents:bigint>").alias("_at"), F.lit(1).alias("_t"), "n"))
    run = W.partitionBy("variant").orderBy("day", "_t").rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn("_s", F.last("_at", ignorenulls=True).over(run)).filter("_t = 1")
    weekly = seen.groupBy("day").agg(F.sum("_s.cents").alias("cents"), F.count("_s").alias("have"), F.max("n").alias("n"),
                                     F.count(F.when(F.datediff(F.col("day"), F.col("_s.seen")) > stale_days, 1)).alias("stale"))
    usable = weekly.filter((F.col("have") == F.col("n")) & (F.col("stale") <= F.floor(F.col("n") / stale_part)))
    daily = usable.select(F.lit(0).alias("variant"), F.lit("total").alias("finish"), F.explode(F.sequence(F.col("day"), F.date_add("day", 6))).alias("day"), "cents").filter(F.col("day") <= last)
    own = total.select(F.lit(0).alias("variant"), F.lit("total").alias("finish"), "day", "cents")
    guess = estimate(own, cut_lineage(daily, "weekly-totals"))
    near = own.select(F.explode(F.sequence(F.date_sub("day", 3), F.date_add("day", 3))).alias("day")).distinct()
    shown = guess.filter(F.datediff(last, F.col("day")) % 7 == 0).join(near, "day", "left_anti")
    return shown.select("day", "cents")
