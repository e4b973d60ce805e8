"""Hand-worked outcome numbers."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from wickerwork.functions.numeric import compare, phi
from wickerwork.operators import outcomes as O

DAY = datetime.date
TODAY = "2026-10-04"
WINDOWS = (90, 180, 365, 730)


def entries(spark, rows):
    """rows: (entry, leader, player, date, size, top_cut, standing, wins, losses, draws)"""
    out = [(e, le, p, f"P{p}", d, s, c, st, w + lo + dr, w, dr) for e, le, p, d, s, c, st, w, lo, dr in rows]
    return spark.createDataFrame(out, "entry int, leader string, player int, player_name string, date date, size int, top_cut int, standing int, games long, wins long, draws long")


def test_compare_is_shrunken_lift_and_raw_evidence(spark):
    lift, evidence = compare(F.lit(100), F.lit(300), F.lit(50), F.lit(300), F.lit(0.25))
    row = spark.range(1).select(lift.alias("l"), evidence.alias("e")).first()
    assert row["l"] == pytest.approx(0.125) and row["e"] == pytest.approx((1 / 6) / 0.05)


def test_phi_of_a_constant_is_zero(spark):
    row = spark.range(1).select(phi(F.lit(5), F.lit(10), F.lit(5), F.lit(10)).alias("flat"), phi(F.lit(5), F.lit(5), F.lit(5), F.lit(10)).alias("same")).first()
    assert row["flat"] == 0 and row["same"] == pytest.approx(1)


def test_totals_nest_and_cuts_need_a_standing(spark):
    rows = entries(spark, [(1, "0", 7, DAY(2026, 9, 30), 40, 4, 1, 4, 1, 1), (2, "0", 8, DAY(2026, 9, 30), 40, 4, 5, 1, 5, 0), (3, "0", 7, DAY(2026, 1, 1), 40, 0, 1, 5, 0, 0)])
    got = {r["w"]: [r[c] for c in O.COUNTS] for r in O.totals(rows, ["leader"], TODAY).collect()}
    assert got == {90: [2, 12, 5, 2, 1, 1], 180: [2, 12, 5, 2, 1, 1], 365: [3, 17, 10, 2, 1, 1], 730: [3, 17, 10, 2, 1, 1]}
    both = O.totals_with_field(rows, TODAY).filter("field and w = 730").first()
    assert both["games"] == 17 and both["leader"] is None


def test_pooled_effect(spark):
    cols = "leader string, w int, baskets long, games long, wins long"
    totals = spark.createDataFrame([("A", 90, 60, 600, 150), ("B", 90, 20, 200, 40)], cols)
    items = spark.createDataFrame([("A", 90, 30, 300, 90, 7), ("B", 90, 10, 100, 25, 7), ("B", 90, 2, 20, 10, 8)], cols + ", item int")
    field = spark.createDataFrame([(90, 80, 800, 190)], "w int, baskets long, games long, wins long")
    got = {r["item"]: r for r in O.pooled(items, totals, field).collect()}
    assert (got[7]["baskets"], got[7]["leaders"]) == (40, 2)
    assert got[7]["lift"] == pytest.approx(0.1 * 200 / 300)
    assert got[7]["evidence"] == pytest.approx(0.1 / math.sqrt(2 * 0.2375 * 0.7625 / 200))
    assert (got[8]["baskets"], got[8]["leaders"], got[8]["lift"], got[8]["evidence"]) == (2, 0, 0, 0)


def test_item_results(spark):
    cols = "leader string, w int, baskets long, games long, wins long, cut_baskets long, cuts long, draws long"
    totals = spark.createDataFrame([("A", 90, 60, 600, 150, 20, 5, 0)], cols)
    items = spark.createDataFrame([("A", 90, 30, 300, 100, 10, 4, 0, 7), ("A", 90, 5, 50, 20, 0, 0, 0, 8)], cols + ", item int")
    rows = O.item_results(items, totals).collect()
    assert [r["item"] for r in rows] == [7]
    r = rows[0]
    assert r["lift"] == pytest.approx(0.125) and r["evidence"] == pytest.approx((1 / 6) / 0.05)
    assert r["conversion"] == pytest.approx(0.4) and r["conversion_without"] == pytest.approx(0.1)


def test_bundle_results_count_some_apart(spark):
    rows = entries(spark, [(1, "0", 1, DAY(2026, 9, 30), 40, 4, 1, 4, 1, 1), (2, "0", 2, DAY(2026, 9, 30), 40, 4, 5, 1, 5, 0), (3, "0", 3, DAY(2026, 9, 29), 9, 0, 5, 1, 5, 0), (4, "0", 4, DAY(2026, 9, 29), 9, 2, 1, 1, 4, 1)])
    covered = spark.createDataFrame([("0", 1, "x", 2, 2), ("0", 2, "x", 2, 2), ("0", 4, "x", 1, 2)], "leader string, entry int, bundle string, held int, size int")
    bundles = spark.createDataFrame([("0", "x"), ("0", "y")], "leader string, bundle string")
    got = {r["bundle"]: r for r in O.bundle_results(rows, covered, bundles).collect()}
    side = lambda r, s: [r[f"{s}_{c}"] for c in O.COUNTS[:5]]
    assert side(got["x"], "all") == [2, 12, 5, 2, 1] and side(got["x"], "none") == [1, 6, 1, 0, 0] and side(got["x"], "some") == [1, 6, 1, 1, 1]
    assert got["x"]["lift"] is not None and got["y"]["lift"] is None and side(got["y"], "none")[0] == 4


def test_favourites_are_above_what_the_leader_explains(spark):
    rows = entries(spark, [(1, "0", 7, DAY(2026, 9, 30), 4, 0, 1, 3, 1, 0), (2, "0", 8, DAY(2026, 9, 30), 4, 0, 2, 2, 2, 0), (3, "0", 0, DAY(2026, 9, 30), 4, 0, 3, 1, 3, 0),
                           (4, "0", 7, DAY(2026, 9, 29), 4, 0, 1, 4, 0, 0), (5, "0", 8, DAY(2026, 9, 29), 4, 0, 2, 1, 3, 0)])
    items = spark.createDataFrame([(e, 3) for e in range(1, 6)] + [(1, 4), (4, 4)], "entry int, item int")
    played = O.played_items(rows, items)
    got = O.favourites(rows.filter("player > 0"), played.filter("player > 0"), O.item_totals(played, TODAY), O.totals(rows, ["leader"], TODAY)).collect()
    assert [(r["player"], r["item"], r["baskets"], r["games"], r["wins"], r["expected"]) for r in got] == [(7, 4, 2, 8, 7, 0.8)]


def test_highlights_are_three_different_leaders(spark):
    rows = entries(spark, [(1, "0", 1, DAY(2026, 9, 30), 4, 0, 1, 3, 1, 0), (2, "0", 2, DAY(2026, 9, 30), 4, 0, 1, 2, 2, 0), (3, "0-1", None, DAY(2026, 9, 30), 4, 0, 1, 0, 4, 0),
                           (4, "0", None, DAY(2026, 8, 1), 4, 0, 1, 1, 3, 0), (5, "0-1", None, DAY(2026, 8, 1), 4, 0, 1, 1, 2, 1), (6, "0-1", None, DAY(2026, 1, 1), 4, 0, 1, 9, 0, 0)])
    got = {r["kind"]: (r["leader"], r["baskets"], r["points"], r["players"], r["was"]) for r in O.highlights(rows, TODAY, best=1, breakout=1, rising=1).collect()}
    assert got == {"best": ("0", 2, 3.125, 2, None), "breakout": ("0-1", 1, 0.0, 0, 0.5)}


def test_list_versions_and_halves(spark):
    rows = entries(spark, [(i, "0", 7, DAY(2026, 9, i), 4, 0, 1, i, 0, 0) for i in (1, 2, 3)])
    items = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 2), (3, 3)], "entry int, item int")
    got = {(r["entry"], r["item"], r["change"]) for r in O.list_versions(rows, items).collect()}
    assert got == {(2, 3, "added"), (2, 1, "cut")}
    assert {(r["half"], r["baskets"], r["wins"]) for r in O.halves(rows).collect()} == {(1, 1, 1), (2, 2, 5)}


def test_lines_of_a_large_table_are_dealt_over_more_tasks_than_shuffles_have(spark, folder, monkeypatch):
    """A task has about LINES_A_TASK order lines, however large the table, and favourites, changes and lists stay the same."""
    from wickerwork.plans import load_all, tables
    from wickerwork.plans.registry import QUERIES
    load_all()
    names = ["a19_player_favourites", "t14_clearest_changes", "s18_parsed_lists"]
    want = [sorted(map(repr, QUERIES[n](spark, folder).collect())) for n in names]
    monkeypatch.setattr(tables, "LINES_A_TASK", 300)
    t = tables.Tables(spark, folder)
    tasks = -(-t.read("lineitem").count() // 300)
    sizes = [r["count"] for r in t.entry_items.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert tasks > 4 and len(sizes) > tasks * 0.9 and max(sizes) < 900
    for name, rows in zip(names, want):
        found = QUERIES[name](spark, folder)
        assert f", {tasks})" in found._jdf.queryExecution().executedPlan().toString(), name
        assert rows and sorted(map(repr, found.collect())) == rows, name
