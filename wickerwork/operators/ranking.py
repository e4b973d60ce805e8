"""Ranking building blocks that never put a whole group, however hot, into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickerwork.session import cut_lineage

#: Spark prunes ``row_number() <= n`` inside every map task up to this n by itself.
NATIVE_LIMIT = 1000
#: The most values in one row of a list.
LONGEST_LIST = 1000


def _names(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def top_n(df: DataFrame, keys: Sequence[str] | str, order: Sequence[Column], n: int, rank: str = "rank",
          salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1 in ``rank``.

    Up to NATIVE_LIMIT Spark itself cuts each map task's part of a group to n rows before the shuffle. For more,
    groups are split into ``salts`` parts, each cut to n, so the last step sees at most salts * n rows of a group."""
    keys = _names(keys)
    final = W.partitionBy(*keys).orderBy(*order)
    if n > NATIVE_LIMIT:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
        first = W.partitionBy(*keys, "_part").orderBy(*order)
        df = (df.withColumn("_part", part).withColumn("_cut", F.row_number().over(first))
              .filter(F.col("_cut") <= n).drop("_part", "_cut"))
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= n)


def in_ranges(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """``df`` sorted over all tasks and staged, with ``_part`` and ``_at``: the range a row fell in, and a number that grows
    with the order of keys and ``order``, without gaps inside a range.

    Spark samples the splitters from the sort columns themselves, so a value that many rows share is parted by the columns
    after it; ``order`` should end in columns that tell rows apart."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    ranged = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return cut_lineage(ranged.withColumn("_part", F.shiftright("_at", 33)), "ranges")


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "number", keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Dense row numbers from 0 over a total order within ``keys``. Rows are dealt into sampled ranges; only the counts of
    ranges, a row a range and key, carry running totals."""
    keys = list(keys)
    ranged = in_ranges(df, order, keys, parts)
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (ranged.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    joined = ranged.alias("a").join(starts.alias("b"), _same("a", "b", ["_part", *keys]))
    place = F.col("_start") + F.col("_at") - F.col("_first")
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], place.cast("long").alias(name))


def running_sum(df: DataFrame, order: Sequence[Column], value: str, name: str, keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """The sum of ``value`` over the rows before this one in a total order within ``keys``; of a hot key no task sees more than
    a range of it."""
    keys = list(keys)
    ranged = in_ranges(df, order, keys, parts)
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (ranged.groupBy("_part", *keys).agg(F.sum(value).alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    inside = F.sum(value).over(W.partitionBy("_part", *keys).orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    joined = ranged.withColumn("_inside", F.coalesce(inside, F.lit(0))).alias("a").join(starts.alias("b"), _same("a", "b", ["_part", *keys]))
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("_start") + F.col("_inside")).alias(name))


def upper_median(df: DataFrame, keys: Sequence[str] | str, value: str, out: str = "median",
                 width: int = 4096) -> DataFrame:
    """sorted(values)[n // 2] of whole-number values per group, exactly, from counts alone.

    Values are first counted in bands of ``width``; the band holding the wanted rank is then counted value by
    value. No task sees more than a group's bands, or the ``width`` values of one band."""
    keys = _names(keys)
    valued = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("_v"))
    seen = valued.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    seen = seen.withColumn("_band", F.floor(F.col("_v") / width))
    bands = seen.groupBy(*keys, "_band").agg(F.sum("_n").alias("_n"))
    group = W.partitionBy(*keys)
    bands = (bands
             .withColumn("_upto", F.sum("_n").over(group.orderBy("_band")))
             .withColumn("_wanted", F.floor(F.sum("_n").over(group) / 2) + 1)
             .filter((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted")))
             .select(*keys, "_band", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_wanted")))
    inside = seen.join(bands, [*keys, "_band"])
    upto = F.sum("_n").over(W.partitionBy(*keys, "_band").orderBy("_v"))
    return (inside.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_wanted"))
            .groupBy(*keys).agg(F.min("_v").alias(out)))


def carry_forward(df: DataFrame, keys: Sequence[str], at: str, value: str, out: str, width: int | None = None) -> DataFrame:
    """As-of join written as a scan: each row gets the last non-null ``value`` at or before its ``at``, within keys.

    With ``width`` the axis is cut into blocks of that many units: a window inside each block, and the last value of
    every block carried over the (few) blocks, so one long series is spread over many tasks. ``at`` is whole numbers."""
    keys = list(keys)
    if width is None:
        run = W.partitionBy(*keys).orderBy(at).rangeBetween(W.unboundedPreceding, 0)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(run))
    df = df.withColumn("_block", F.floor(F.col(at) / width))
    inner = W.partitionBy(*keys, "_block").orderBy(at).rangeBetween(W.unboundedPreceding, 0)
    ends = df.groupBy(*keys, "_block").agg(
        F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(at), F.col(value)))).alias("_end"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, "_block", F.last(F.col(f"_end.{value}"), ignorenulls=True).over(before).alias("_carried"))
    inside = df.withColumn("_inside", F.last(value, ignorenulls=True).over(inner))
    return (inside.join(ends, [*keys, "_block"], "left")
            .withColumn(out, F.coalesce("_inside", "_carried")).drop("_block", "_inside", "_carried"))


def salted_join(facts: DataFrame, dimension: DataFrame, on: Sequence[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Join many facts per key to one small row per key where a key may be hot: the dimension row is repeated once
    per salt, so no task gets more than 1/salts of a key's facts."""
    spread = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    copies = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def listed(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, listed): the values of each key in arrays of at most LONGEST_LIST, staged."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(value))
    cut = rows.withColumn("_part", F.floor((place - 1) / LONGEST_LIST))
    return cut_lineage(cut.groupBy(*keys, "_part").agg(F.collect_list(value).alias("listed")).drop("_part"), "listed")


def fifths(rank: Column, n: Column, parts: int = 5) -> Column:
    """Which fifth of a ranking a 1-based rank falls in, from 0."""
    return F.floor((rank - 1) * parts / n)
