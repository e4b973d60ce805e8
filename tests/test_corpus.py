"""Logs fold to the newest versions, and numbers never change."""

import datetime

from wickerwork.operators import corpus as K

D = lambda m, d: datetime.date(2026, m, d)
LOG = "id string, source int, line long, updated date, created date, removed date, note boolean"


def test_fold(spark):
    rows = [("a", 0, 0, D(1, 5), D(1, 1), None, False), ("a", 1, 0, D(2, 5), None, None, False),  # newer copy wins, the older one's date stays
            ("b", 0, 1, D(1, 5), None, None, False), ("b", 1, 1, D(1, 5), D(1, 2), None, False),  # the later source wins a tie
            ("c", 0, 2, D(3, 1), None, None, False), ("c", 1, 9, None, D(1, 3), D(2, 1), True),  # gone before this version: it is back
            ("d", 0, 3, D(3, 1), None, None, False), ("d", 1, 8, None, None, D(3, 1), True),
            ("x", 1, 7, None, D(1, 1), D(1, 1), True)]  # a note for nothing known
    for width in (1, 100_000):
        got = {r["id"]: (r["source"], r["created"], r["removed"]) for r in K.newest_versions(spark.createDataFrame(rows, LOG), width).collect()}
        assert got == {"a": (1, D(1, 1), None), "b": (1, D(1, 2), None), "c": (0, D(1, 3), None), "d": (0, None, D(3, 1))}


def test_numbers_are_only_added_to(spark):
    known = spark.createDataFrame([("p", 0), ("q", 1)], "item string, number long")
    counts = spark.createDataFrame([("p", 9), ("z", 1), ("y", 5), ("x", 5)], "item string, count long")
    assert {r["item"]: r["number"] for r in K.extend_numbers(known, counts).collect()} == {"p": 0, "q": 1, "x": 2, "y": 3, "z": 4}


def test_merge_rules_differ_by_a_tie(spark):
    cols = "event int, entries long, players_known boolean, copy string"
    mine = spark.createDataFrame([(1, 5, True, "m"), (2, 5, True, "m"), (3, 5, False, "m"), (4, 5, True, "m")], cols)
    theirs = spark.createDataFrame([(1, 5, True, "t"), (2, 6, False, "t"), (3, 4, True, "t"), (5, 1, False, "t")], cols)
    won = lambda df: {r["event"]: r["copy"] for r in df.collect()}
    assert won(K.add_events(mine, theirs)) == {1: "m", 2: "t", 3: "t", 4: "m", 5: "t"}
    assert won(K.replace_events(mine, theirs)) == {1: "t", 2: "t", 3: "m", 4: "m", 5: "t"}
