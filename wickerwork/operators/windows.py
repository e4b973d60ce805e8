"""Nested look-back windows and dense month calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECENT_DAYS = (90, 30, 7)
RESULT_DAYS = (90, 180, 365, 730)


def cutoff(today: str, days: int) -> Column:
    return F.date_sub(F.lit(today).cast("date"), days)


def valid_windows(dated: DataFrame, at: str, today: str, days: Sequence[int] = RECENT_DAYS) -> DataFrame:
    """(w, since): the windows that are filled in, those whose first day lies after the first known date and not
    after the last. Others have no row, so nothing joins to them."""
    spans = F.array(*[F.struct(F.lit(w).alias("w"), cutoff(today, w).alias("since")) for w in days])
    known = dated.agg(F.min(at).alias("first"), F.max(at).alias("last")).withColumn("_s", F.explode(spans))
    return (known.filter((F.col("first") < F.col("_s.since")) & (F.col("_s.since") <= F.col("last")))
            .select("_s.w", "_s.since"))


def in_windows(df: DataFrame, at: str, today: str, days: Sequence[int]) -> DataFrame:
    """One row per look-back a row falls in (windows nest, so a recent row repeats). A null date is in none."""
    inside = F.filter(F.array(*[F.when(F.col(at) >= cutoff(today, w), F.lit(w)) for w in days]), lambda w: w.isNotNull())
    return df.withColumn("w", F.explode(inside))


def since_made(df: DataFrame, at: str, windows: DataFrame, today: str, days: Sequence[int] = RECENT_DAYS) -> DataFrame:
    """``in_windows`` kept to the windows that are filled in: an equi join on the window, not a range join. The windows are
    one row per look-back at most, so they are broadcast rather than the rows shuffled by a handful of keys."""
    return in_windows(df, at, today, days).join(F.broadcast(windows.select("w")), "w")


def every_month(rows: DataFrame, keys: Sequence[str], month: str = "month", zero: Sequence[str] = ()) -> DataFrame:
    """Fill the months between each group's first and last: ``zero`` columns become 0 there."""
    keys = list(keys)
    span = (rows.groupBy(*keys).agg(F.min(month).alias("_a"), F.max(month).alias("_b"))
            .select(*keys, F.explode(F.expr("sequence(_a, _b, interval 1 month)")).alias(month)))
    return span.join(rows, [*keys, month], "left").fillna(0, subset=list(zero))


def month_counts(df: DataFrame, keys: Sequence[str], at: str, out: str = "made") -> DataFrame:
    """Rows per month from each group's first to its last, unknown dates left out."""
    rows = (df.filter(F.col(at).isNotNull()).withColumn("month", F.trunc(at, "MM"))
            .groupBy(*keys, "month").agg(F.count(F.lit(1)).alias(out)))
    return every_month(rows, keys, zero=[out])
