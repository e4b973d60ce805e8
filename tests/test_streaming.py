"""Folds of streams that come in parts, stop, go on, and get rows too late."""

import datetime
import random

from wickerwork.operators import corpus as K
from wickerwork.streaming import folds as S

LOG = "id bigint, source int, line bigint, updated date, created date, removed date, note boolean"


def day(n):
    return datetime.date(2024, 3, 1) + datetime.timedelta(days=n)


def random_log(n=400, ids=25):
    rng = random.Random(4)
    out = []
    for line in range(n):
        note = rng.random() < 0.3
        out.append((rng.randrange(ids), rng.randrange(3), line, day(rng.randrange(40)), day(-rng.randrange(90)) if rng.random() < 0.4 else None,
                    day(rng.randrange(60)) if rng.random() < 0.2 else None, note))
    return out


class Feed:
    """A folder that a stream reads, and where it keeps its place."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.schema = spark, schema
        self.source, self.out, self.check = (str(tmp_path / n) for n in ("source", "out", "check"))

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.source)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.source)


def as_set(df):
    return {tuple(r) for r in df.select("id", "updated", "created", "removed", "source", "line").collect()}


def test_folding_in_parts_equals_folding_at_once(spark, tmp_path):
    feed, rows = Feed(spark, tmp_path, LOG), random_log()
    at = 0
    for upto in (130, 131, 400):
        feed.add(rows[at:upto])
        got = as_set(S.fold_stream(feed.stream(), feed.out, feed.check))
        assert got == as_set(K.newest_versions(spark.createDataFrame(rows[:upto], LOG)))
        at = upto
    before = spark.read.parquet(feed.out).count()
    assert as_set(S.fold_stream(feed.stream(), feed.out, feed.check)) == got  # nothing new: nothing is written
    assert spark.read.parquet(feed.out).count() == before


def test_a_batch_touches_its_own_ids_and_leaves_out_repeats(spark, tmp_path):
    feed = Feed(spark, tmp_path, LOG)
    feed.add([(i, 0, i, day(i), None, None, False) for i in range(9)])
    S.fold_stream(feed.stream(), feed.out, feed.check)
    feed.add([(4, 0, 100, day(30), None, None, False), (5, 0, 5, day(90), None, None, False)])  # line 5 came before
    now = {r["id"]: r["updated"] for r in S.fold_stream(feed.stream(), feed.out, feed.check).collect()}
    assert now == {i: day(30 if i == 4 else i) for i in range(9)}
    assert sorted(r["id"] for r in spark.read.parquet(feed.out).collect()) == sorted([*range(9), 4])


COPIES = "event date, date date, entries bigint, players_known boolean, copy string, seen timestamp"


def copy(event, entries, name, seen):
    return day(event), day(event), entries, entries % 2 == 0, name, datetime.datetime.combine(day(seen), datetime.time(6))


def test_corrections_close_with_the_event(spark, tmp_path):
    feed = Feed(spark, tmp_path, COPIES)

    def run(*rows):
        feed.add(list(rows))
        return {(r["event"], r["copy"], r["entries"]) for r in S.correct_stream(feed.stream(), feed.out, feed.check).collect()}

    assert run(copy(0, 8, "first", 0), copy(1, 5, "short", 1)) == {(day(0), "first", 8), (day(1), "short", 5)}
    assert run(copy(0, 7, "fewer", 1), copy(1, 5, "equal", 2)) == {(day(0), "first", 8), (day(1), "equal", 5)}
    last = {(day(0), "first", 8), (day(1), "equal", 5), (day(20), "new", 3)}
    assert run(copy(20, 3, "new", 20)) == last  # the watermark passes both events, whose timers drop their state
    assert run(copy(0, 99, "old row", 1), copy(1, 99, "seen late", 19)) == last
    assert run(copy(20, 4, "more", 21)) == last - {(day(20), "new", 3)} | {(day(20), "more", 4)}


DAY = "variant bigint, finish string, day date, cents bigint"


def test_a_day_is_added_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, DAY)

    def run():
        return {tuple(r) for r in S.add_days_stream(feed.stream(), feed.out, feed.check).collect()}

    first = [(1, "matte", day(0), 10), (2, "matte", day(0), 20), (1, "matte", day(1), 11)]
    feed.add(first)
    assert run() == set(first)
    feed.add([(3, "matte", day(1), 99), (1, "gloss", day(2), 12)])
    assert run() == {*first, (1, "gloss", day(2), 12)}
    # a batch that was written but not marked as done is written again, in its own place
    for file in sorted((tmp_path / "check" / "commits").iterdir()):
        if file.name.strip(".crc").endswith("1"):
            file.unlink()
    assert run() == {*first, (1, "gloss", day(2), 12)}


def test_keyed_state_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(S._STORE[0], None)
    with S.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(S._STORE[0])
    assert spark.conf.get(S._STORE[0], None) == before


def test_change_points_of_many_series_take_few_states(spark, tmp_path):
    """Every series of a bucket is kept in one state: unknown prices, unknown types and large numbers as they are told."""
    rng = random.Random(7)
    rows = [(v, [None, "a", "b"][f], day(n), rng.choice([None, 5, 5, 0, 2**60 + 1, 2**60])) for n in range(12) for v in range(40) for f in range(3) if rng.random() < 0.7]
    feed = Feed(spark, tmp_path, "variant bigint, finish string, day date, cents bigint")
    points, check = str(tmp_path / "points"), str(tmp_path / "points-check")
    for k in range(0, 12, 4):
        feed.add([r for r in rows if day(k) <= r[2] < day(k + 4)])
        found = S.run_to_table(S.change_stream(feed.stream(), buckets=64), points, check)
    last, want = {}, set()
    for v, f, at, cents in rows:
        if cents != last.get((v, f)):
            want.add((v, f, at, cents))
            last[(v, f)] = cents
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
