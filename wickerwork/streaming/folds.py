"""Structured Streaming: logs folded to current state, corrections merged, days added once, counts per window, change points.

Folds are keyed state of the stream itself: a batch reads and writes the state of its own keys only, and what changed is appended
to a table. A stopped stream goes on from its checkpoint; the file sink takes no batch twice."""

from __future__ import annotations

import contextlib
import datetime
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Keyed state of several variables needs this store.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that ``transformWithState`` needs."""
    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:
        yield
    finally:
        spark.conf.unset(_STORE[0]) if before is None else spark.conf.set(_STORE[0], before)


def run_batches(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run all that is there, batch by batch, from where the checkpoint stopped."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()
    return query


def _day(value) -> int | None:
    return None if value is None or pd.isna(value) else value.toordinal()


def _date(day: int | None) -> datetime.date | None:
    return None if day is None else datetime.date.fromordinal(day)


#: What the rows of one source of an id say so far, days as numbers: the last line; the newest copy; the first creation date of a
#: copy, and the last one of a copy that was the newest of its source when it came; the first note's creation date; the last removal.
_SOURCE = ["line", "updated", "copy_line", "removed", "first_created", "won_created", "won_updated", "noted_created", "gone", "seen"]
FOLDED = "id bigint, updated date, created date, removed date, source int, line bigint, seen bigint"


class LogFold(StatefulProcessor):
    """The newest version of an id, as ``newest_versions`` has it, from a state of one row a source.

    A source's lines come in their order; one that is not after the last seen came before and is left out. Copies that are the
    newest of their source when they come have growing dates, so of those with a creation date only the last can win: if a
    source before it in the order has a newer copy, that beats all of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sources = handle.getMapState("sources", "source int", ", ".join(f"{c} bigint" for c in _SOURCE))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: dict(zip(_SOURCE, v)) for k, v in self.sources.iterator()}
        touched = set()
        for r in pd.concat(list(rows)).sort_values(["source", "line"]).itertuples(index=False):
            s = known.setdefault(int(r.source), dict.fromkeys(_SOURCE) | {"seen": 0})
            if s["line"] is not None and r.line <= s["line"]:
                continue
            touched.add(int(r.source))
            s["line"], s["seen"] = int(r.line), s["seen"] + 1
            updated, created, removed = _day(r.updated), _day(r.created), _day(r.removed)
            if r.note:
                if s["noted_created"] is None:
                    s["noted_created"] = created
                s["gone"] = max((x for x in (s["gone"], removed) if x is not None), default=None)
                continue
            if s["first_created"] is None:
                s["first_created"] = created
            if s["updated"] is None or updated >= s["updated"]:
                s |= {"updated": updated, "copy_line": s["line"], "removed": removed}
                if created is not None:
                    s |= {"won_created": created, "won_updated": updated}
        for source in touched:
            self.sources.updateValue((source,), tuple(known[source][c] for c in _SOURCE))
        if touched and (row := self._folded(known)):
            yield pd.DataFrame([(key[0], *row)], columns=[c.split()[0] for c in FOLDED.split(", ")]).astype({"line": "Int64", "seen": "Int64"})

    def close(self) -> None:
        pass

    @staticmethod
    def _folded(known: dict[int, dict]) -> tuple | None:
        copies = [(s, x) for s, x in sorted(known.items()) if x["updated"] is not None]
        if not copies:
            return None
        source, best = max(copies, key=lambda c: (c[1]["updated"], c[0]))
        won, top = None, -1
        for _, x in copies:
            if x["won_updated"] is not None and x["won_updated"] >= top:
                won = x["won_created"]
            top = max(top, x["updated"])
        first = next((x["first_created"] for _, x in copies if x["first_created"] is not None), None)
        noted = next((x["noted_created"] for _, x in sorted(known.items()) if x["noted_created"] is not None), None)
        created = next((c for c in (won, first, noted) if c is not None), None)
        gone = max((x["gone"] for x in known.values() if x["gone"] is not None and x["gone"] >= best["updated"]), default=None)
        removed = max((x for x in (best["removed"], gone) if x is not None), default=None)
        return _date(best["updated"]), _date(created), _date(removed), source, best["copy_line"], sum(x["seen"] for x in known.values())


def last_of(changes: DataFrame, key: str) -> DataFrame:
    """The last row of each key from a table of changes, ``seen`` growing with every change."""
    rest = [c for c in changes.columns if c not in (key, "seen")]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), "seen").alias("_c")).select(key, "_c.*")


def fold_stream(stream: DataFrame, changes: str, checkpoint: str) -> DataFrame:
    """Fold a log as it grows: each batch appends the new state of the ids it holds to the table ``changes``. Gives every id's
    current state, that of ``newest_versions`` over all rows so far. stream(id, source, line, updated, created, removed, note)."""
    rows = stream.select("id", "source", "line", "updated", "created", "removed", "note")
    with keyed_state(stream.sparkSession):
        folded = rows.groupBy("id").transformWithStateInPandas(LogFold(), FOLDED, "Append", "None")
        return last_of(run_to_table(folded, changes, checkpoint), "id")


CORRECTED = "event date, date date, entries bigint, players_known boolean, copy string, seen bigint"


class Corrections(StatefulProcessor):
    """The copy of an event with the most entries, the later one on a tie, until the event closes ``late_days`` after its date:
    then a timer drops its state."""

    def __init__(self, late_days: int) -> None:
        self.late_days = late_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "entries bigint, seen bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries, seen = self.best.get() if self.best.exists() else (-1, 0)
        if not seen:
            closing = datetime.datetime.combine(key[0] + datetime.timedelta(days=self.late_days), datetime.time(), datetime.timezone.utc)
            self.handle.registerTimer(int(closing.timestamp() * 1000))
        taken = None
        for r in pd.concat(list(rows)).sort_values(["seen", "entries", "copy"]).itertuples(index=False):
            seen += 1
            if r.entries >= entries:
                entries, taken = int(r.entries), r
        self.best.update((entries, seen))
        if taken is not None:
            yield pd.DataFrame([(key[0], taken.date, entries, taken.players_known, taken.copy, seen)], columns=[c.split()[0] for c in CORRECTED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.best.clear()
        yield from ()

    def close(self) -> None:
        pass


def correct_stream(stream: DataFrame, changes: str, checkpoint: str, late_days: int = 3) -> DataFrame:
    """Late corrections: an event fetched again replaces the copy here when it has as many entries. What is seen more than
    ``late_days`` after the event's date, or that much behind the newest row, comes too late. stream(event, date, entries,
    players_known, copy, seen); ``event`` is a date."""
    fresh = (stream.select("event", "date", "entries", "players_known", "copy", "seen").withWatermark("seen", f"{late_days} days")
             .filter(F.col("seen") <= F.date_add("event", late_days).cast("timestamp")))
    with keyed_state(stream.sparkSession):
        merged = fresh.groupBy("event").transformWithStateInPandas(Corrections(late_days), CORRECTED, "Append", "EventTime")
        return last_of(run_to_table(merged, changes, checkpoint), "event")


DAYS = "variant bigint, finish string, day date, cents bigint"


def add_days_stream(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """A day once in is never replaced, even by better data: rows of days that earlier batches brought are left out.

    A batch appends its rows, and the list of its days beside them, to folders named after its stream and number, so one that
    runs again after a stop writes the same folders again; no other is touched."""
    spark, name = stream.sparkSession, os.path.basename(checkpoint.rstrip("/"))
    days = spark.read.schema("day date, stream string, batch bigint")

    def step(batch: DataFrame, number: int) -> None:
        own = f"stream={name}/batch={number}"
        fresh = batch.select("variant", "finish", "day", "cents")
        try:
            have = days.parquet(f"{table}/days").filter((F.col("stream") != name) | (F.col("batch") != number)).select("day")
            fresh = fresh.join(have, "day", "left_anti")
        except AnalysisException:  # the first batch of all
            pass
        fresh.select("variant", "finish", "day", "cents").write.mode("overwrite").parquet(f"{table}/rows/{own}")
        spark.read.schema(DAYS).parquet(f"{table}/rows/{own}").select("day").distinct().write.mode("overwrite").parquet(f"{table}/days/{own}")

    run_batches(stream, checkpoint, step)
    return spark.read.schema(DAYS).parquet(f"{table}/rows").select("variant", "finish", "day", "cents")


def window_counts(stream: DataFrame, at: str, length: str, slide: str | None = None, late: str = "3 days", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows per tumbling or sliding window, given once its watermark has passed."""
    span = F.window(at, length, slide) if slide else F.window(at, length)
    counted = stream.withWatermark(at, late).groupBy(span, *keys).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "rows")


def run_to_table(result: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append a streaming result to a Parquet table until its source is used up, then read it."""
    query = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path)


def change_stream(stream: DataFrame, buckets: int = 512) -> DataFrame:
    """Change points as snapshots arrive in order of days: a row where a series' price differs from the one kept for it.
    stream(variant, finish, day, cents null for none).

    Series are kept in ``buckets`` by hash, a state each, so a batch costs by its rows and not by its series; a running stream keeps
    the number it was started with."""

    def changed(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        variants, finishes, values = state.get if state.exists else ([], [], [])
        kept = pd.DataFrame({"variant": pd.array(variants, "Int64"), "finish": pd.array(finishes, "object"), "at": np.full(len(values), -(2**62)),
                             "known": np.array([v is not None for v in values], bool), "cents": np.array([v or 0 for v in values], "int64")})
        rows = pd.concat([kept, *(f[list(kept.columns)].astype({"variant": "Int64"}) for f in frames)], ignore_index=True)
        series = rows.groupby(["variant", "finish"], sort=False, dropna=False).ngroup()
        order = np.lexsort((rows["at"].to_numpy("int64"), series.to_numpy()))
        rows, series = rows.iloc[order], series.to_numpy()[order]
        known, cents, at = rows["known"].to_numpy(bool), rows["cents"].to_numpy("int64"), rows["at"].to_numpy("int64")
        first = np.append(True, series[1:] != series[:-1])
        same = np.append(False, (known[1:] == known[:-1]) & (cents[1:] == cents[:-1]))
        last = rows[np.append(first[1:], True)]
        whole = lambda c: [None if pd.isna(v) else v for v in c.tolist()]
        state.update((whole(last["variant"]), whole(last["finish"]), [int(v) if k else None for v, k in zip(last["cents"], last["known"])]))
        yield rows[np.where(first, known, ~same) & (at > -(2**62))].reset_index(drop=True)

    told = stream.select("variant", "finish", F.coalesce(F.unix_date("day"), F.lit(2**62)).alias("at"), F.col("cents").isNotNull().alias("known"),
                         F.coalesce("cents", F.lit(0)).cast("bigint").alias("cents"), F.pmod(F.xxhash64("variant", "finish"), F.lit(buckets)).alias("_bucket"))
    found = told.groupBy("_bucket").applyInPandasWithState(changed, "variant bigint, finish string, at bigint, known boolean, cents bigint",
                                                           "variants array<bigint>, finishes array<string>, cents array<bigint>", "append", "NoTimeout")
    day = F.when(F.col("at") < 2**62, F.date_from_unix_date(F.col("at").cast("int")))
    return found.select("variant", "finish", day.alias("day"), F.when(F.col("known"), F.col("cents")).alias("cents"))
