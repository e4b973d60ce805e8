"""The ranking helpers against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from wickerwork.operators import ranking as R
from wickerwork.operators.textjoin import contains_join


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.randrange(-9000, 90000) // rng.choice([1, 1, 500]), i) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, v long, i long").repartition(5)


@pytest.mark.parametrize("width", [1, 100, 4096])
def test_upper_median(numbers, width):
    rows, df = numbers
    want = {}
    for k in {r[0] for r in rows}:
        values = sorted(r[1] for r in rows if r[0] == k)
        want[k] = values[len(values) // 2]
    assert {r["k"]: r["median"] for r in R.upper_median(df, "k", "v", width=width).collect()} == want


def test_row_numbers_are_dense_and_in_order(numbers):
    rows, df = numbers
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    got = R.number_rows(df, [F.asc("v"), F.asc("i")]).collect()
    assert {r["i"]: r["number"] for r in got} == {r[2]: n for n, r in enumerate(order)}


def test_row_numbers_within_keys(numbers):
    rows, df = numbers
    got = {r["i"]: r["number"] for r in R.number_rows(df, [F.desc("v"), F.asc("i")], keys=["k"]).collect()}
    for k in "ab":
        order = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in order] == list(range(len(order)))


def test_a_value_shared_by_a_million_rows_is_sorted_in_many_ranges(spark):
    df = spark.range(1_000_000).select(F.lit(7).alias("v"), F.col("id").alias("i"))
    largest = R.in_ranges(df, [F.asc("v"), F.desc("i")], parts=20).groupBy("_part").count().agg(F.max("count")).first()[0]
    assert largest < 150_000
    numbered = R.number_rows(df, [F.asc("v"), F.desc("i")], parts=20)
    assert numbered.filter(F.col("number") != 999_999 - F.col("i")).isEmpty() and numbered.count() == 1_000_000


def test_running_sums(numbers):
    rows, df = numbers
    got = {r["i"]: r["before"] for r in R.running_sum(df, [F.asc("v"), F.asc("i")], "v", "before", ["k"]).collect()}
    for k in "ab":
        total = 0
        for _, v, i in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            assert got[i] == total
            total += v


@pytest.mark.parametrize("n", [3, 1200])
def test_top_n(numbers, n):
    rows, df = numbers
    got = {(r["k"], r["rank"]): r["i"] for r in R.top_n(df, "k", [F.desc("v"), F.asc("i")], n).collect()}
    for k in "ab":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:n]
        assert [got[k, i + 1] for i in range(len(mine))] == [r[2] for r in mine]


@pytest.mark.parametrize("width", [None, 7, 1000])
def test_carry_forward(spark, width):
    rng = random.Random(5)
    rows = [(k, at, rng.choice([None, None, at * 10])) for k in "xy" for at in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    got = {(r["k"], r["at"]): r["o"] for r in R.carry_forward(df, ["k"], "at", "v", "o", width).collect()}
    for k, at, _ in rows:
        past = [(a, v) for kk, a, v in rows if kk == k and a <= at and v is not None]
        assert got[k, at] == (max(past)[1] if past else None)


def test_salted_join_is_the_join(numbers, spark):
    rows, df = numbers
    small = spark.createDataFrame([("a", 1), ("c", 2)], "k string, w int")
    assert R.salted_join(df, small, ["k"]).count() == sum(r[0] == "a" for r in rows)


def test_contains_join_against_every_pair(spark):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 12)))) for i in range(150)]
    asked = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    texts += [(1000 + i, "ab" * i + "c" + "ab" * 3) for i in range(9)] + [(2000, None)]
    asked += [(100 + i, ("ab" * 5)[:i]) for i in range(10)] + [(200, "bcab"), (201, "ababcababa"), (202, "zzz")]
    got = contains_join(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(asked, "query int, q string"), "text")
    assert {(r["id"], r["query"]) for r in got.collect()} == {(t, q) for t, s in texts for q, p in asked if s and p and p in s}
    assert got.count() == len({(t, q) for t, s in texts for q, p in asked if s and p and p in s})


def test_numbers_in_names_are_looked_up_by_long_groups(spark):
    from wickerwork.operators import textjoin

    asked = spark.createDataFrame([("#000012345",), ("abc",), ("x",)], "q string")
    got = {r["q"]: [(g["gram"], g["offset"]) for g in r["g"]] for r in asked.select("q", textjoin._covering(F.col("q")).alias("g")).collect()}
    assert got == {"#000012345": [("#0000123", 0), ("00012345", 2)], "abc": [("ab", 0), ("bc", 1)], "x": [("x", 0)]}
