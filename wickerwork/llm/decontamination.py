"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

Items are small beside the corpus but need not be tiny: their words are cut into pieces and dealt into blocks of at most
``block_words`` words; each block's automaton is built once and sent to the tasks, and the documents stream past the blocks one
after another. No document is ever shuffled."""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerwork.llm.common import FOLD_BYTES, SLICE_ROWS, folded_words, map_texts, unused
from wickerwork.session import cut_lineage

#: Consecutive item words that count as leaked; an item of fewer words counts as a whole.
WINDOW = 10
#: Words of the test items in one automaton; what is broadcast stays below about 300 bytes a word.
BLOCK_WORDS = 200_000
#: A document with more than this share of leaked words is dropped by ``decontaminate``.
MAX_COVERAGE = 0.5

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS),
                      T.StructField("hit_items", T.ArrayType(T.StringType()))])


class SuffixAutomaton:
    """All substrings of several word sequences, none of them across two sequences.

    A stream of words is followed with the longest suffix that occurs in some item. Where that suffix reaches the window
    length, the state of its last ``window`` words names the items they occur in; a shorter item is named by the state of the
    whole item."""

    def __init__(self, items: Sequence[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        self.whole: dict[int, set[str | None]] = defaultdict(set)
        ends = [self._insert(words) for _, words in coded]
        for (item, words), end in zip(coded, ends):
            if len(words) < window:
                self.whole[end].add(item)
        self.windows: dict[int, set[str | None]] = defaultdict(set)
        for item, words in coded:
            state = 0
            for i, word in enumerate(words):
                state = self.next[state][word]
                if i + 1 >= window:
                    self.windows[self._window_state(state)].add(item)
        # the nearest state up the suffix links, itself included, that is a whole short item
        self.short_at: list[int] | None = None
        if self.whole:
            self.short_at = [-1] * len(self.link)
            for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                self.short_at[state] = state if state in self.whole else self.short_at[self.link[state]]
        self.shortest = min((min(len(words), window) for _, words in coded), default=window)

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _split(self, before: int, word: int) -> int:
        """The state of ``before`` followed by ``word``, cut off from longer strings it shared a state with."""
        target = self.next[before][word]
        if self.length[target] == self.length[before] + 1:
            return target
        copy = len(self.link)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[before] + 1)
        self.link[target] = copy
        while before >= 0 and self.next[before].get(word) == target:
            self.next[before][word] = copy
            before = self.link[before]
        return copy

    def _insert(self, words: list[int]) -> int:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            fresh = len(self.link)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = fresh
                at = self.link[at]
            if at >= 0:
                self.link[fresh] = self._split(at, word)
            last = fresh
        return last

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged spans of leaked words, and the items whose windows occur. A word that no item has ends every match, so only
        stretches of known words that are long enough are followed."""
        spans: list[tuple[int, int]] = []
        found: set[str | None] = set()
        if not self.vocabulary or len(words) < self.shortest:
            return spans, found
        ids = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0]))))
        starts, stops = edges[::2], edges[1::2]
        for run in np.flatnonzero(stops - starts >= self.shortest):
            self._follow(ids[starts[run]:stops[run]].tolist(), int(starts[run]), spans, found)
        return spans, found

    def _follow(self, ids: list[int], base: int, spans: list[tuple[int, int]], found: set[str | None]) -> None:
        following, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for i, word in enumerate(ids, base + 1):
            target = following[state].get(word)
            while target is None and state:
                state = link[state]
                matched = length[state]
                target = following[state].get(word)
            if target is None:
                continue
            state = target
            matched += 1
            reach = 0
            if matched >= window:
                found |= self.windows[self._window_state(state)]
                reach = window
            if self.short_at is not None:
                # a state's strings are longer than its link's: where the match is shorter than the state, look up from the link
                short = self.short_at[state if length[state] <= matched else link[state]] if state else -1
                while short > 0:
                    found |= self.whole[short]
                    reach = max(reach, length[short])
                    short = self.short_at[link[short]] if link[short] > 0 else -1
            if reach:
                start = i - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))


def _item_blocks(items: DataFrame, window: int, block_words: int) -> Sequence[list[tuple[str | None, list[bytes]]]]:
    """The items' words in blocks of at most ``block_words`` words, each read by itself.

    A long item is cut into pieces that overlap by window - 1 words, so that every window lies in one piece."""
    most = max(block_words // 4, 2 * window)

    def cut():
        def work(texts):
            out = []
            for text in texts:
                words = folded_words(text)
                step = most - window + 1
                out.append([b" ".join(words[a:a + most]).decode("utf-8", "surrogateescape") for a in range(0, max(len(words) - window + 1, 1), step)]
                           if words else [])
            return [out]
        return work

    pieces = map_texts(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), "text", ["item_id"],
                       T.StructType([T.StructField("pieces", T.ArrayType(T.StringType()))]), cut)
    pieces = cut_lineage(pieces.select("item_id", F.explode("pieces").alias("words")).distinct()
                         .withColumn("n", F.size(F.split("words", " "))), "bench-pieces")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return []
    blocks = max(1, math.ceil(total / block_words))
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)))
        if dealt.groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= block_words:
            break
        blocks *= 2
    return _Blocks(dealt, blocks)


class _Blocks(Sequence):
    """The items' words block by block. A block, which is bounded, is read when it is asked for, so one is held at a time."""

    def __init__(self, dealt: DataFrame, n: int) -> None:
        self.dealt, self.n = dealt, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int) -> list[tuple[str | None, list[bytes]]]:
        if not 0 <= k < self.n:
            raise IndexError(k)
        rows = self.dealt.filter(F.col("block") == k).select("item_id", "words").collect()
        return [(r.item_id, [w.encode() for w in r.words.split(" ")]) for r in rows]


def leaked_spans(docs: DataFrame, items: DataFrame, keep: Sequence[str], window: int = WINDOW,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """``keep`` of every document with n_words, hit_spans (word positions, end exclusive, merged) and hit_items (distinct item
    ids as text, sorted).

    Null and empty texts have no words and no hits; null item texts have no windows; an item without an id is found and its
    spans count, but it is not listed. Repeated documents and items are each answered by themselves."""
    return _found_by(docs, _item_blocks(items, window, block_words), keep, window)


def _found_by(docs: DataFrame, blocks: Sequence[Sequence[tuple[str | None, list[bytes]]]], keep: Sequence[str], window: int) -> DataFrame:
    spark = docs.sparkSession
    text = docs.select(*keep, F.col("text").alias("_t"))
    found: DataFrame | None = None
    for k, block in enumerate(blocks or [[]]):
        sent = spark.sparkContext.broadcast(SuffixAutomaton(block, window))

        def make(sent=sent):
            automaton = sent.value

            def work(texts):
                counts, spans, hits = [], [], []
                for value in texts:
                    words = folded_words(value)
                    at, which = automaton.scan(words)
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in at])
                    hits.append(sorted(x for x in which if x is not None))
                return counts, spans, hits
            return work

        if found is None:
            found = map_texts(text, "_t", [*keep, *(["_t"] if len(blocks) > 1 else [])], FOUND, make)
        else:  # what earlier blocks found goes along; staged, so that a task holds one automaton
            before = cut_lineage(found.withColumnsRenamed({c: f"_{c}" for c in FOUND.names}), "leaks")
            last = k == len(blocks) - 1
            found = map_texts(before, "_t", [*keep, "_hit_spans", "_hit_items", *([] if last else ["_t"])], FOUND, make)
            found = _merged(found)
    return found


def _merged(found: DataFrame) -> DataFrame:
    """Spans and items of two blocks as one."""
    ordered = F.array_sort(F.concat("_hit_spans", "hit_spans"))

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        return F.when((F.size(done) > 0) & (last["end"] >= span["start"]), grown).otherwise(F.concat(done, F.array(span)))

    return (found.withColumn("hit_spans", F.aggregate(ordered, F.filter("hit_spans", lambda _: F.lit(False)), add))
            .withColumn("hit_items", F.array_sort(F.array_union("_hit_items", "hit_items"))).drop("_hit_spans", "_hit_items"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: how many words are leaked, and a digest of the items they come from."""
    spans = leaked_spans(docs, items, ["doc_id"], window, block_words)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return spans.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _cut_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from each span's first word to the end of its last."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with leaked spans taken out of their texts; one whose leaked share of words exceeds ``max_coverage`` is
    dropped whole. Others stay as they are, null texts too. Columns are those of ``docs``; n_chars, where there is one, is the
    new length of a text that changed. Removal is repeated on the joined rest until no window is left."""
    blocks = _item_blocks(items, window, block_words)
    if not blocks:
        return docs
    return _cut_by_one(docs, blocks[0], window, max_coverage) if len(blocks) == 1 else _cut_by_all(docs, blocks, window, max_coverage)


def _cut_by_one(docs: DataFrame, block: Sequence[tuple[str | None, list[bytes]]], window: int, max_coverage: float) -> DataFrame:
    names = docs.columns
    cut, kept = unused("_ww_cut", names), unused("_ww_kept", names)
    sent = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window))

    def make():
        automaton = sent.value

        def work(texts):
            out, stays = [], []
            for value in texts:
                words = folded_words(value)
                total, gone = len(words), 0
                while (spans := automaton.scan(words)[0]) and words:
                    gone += sum(b - a for a, b in spans)
                    value = _cut_text(value, spans)
                    words = folded_words(value)
                out.append(value.decode("utf-8", "replace") if gone else None)
                stays.append(gone <= max_coverage * total)
            return out, stays
        return work

    fields = T.StructType([T.StructField(cut, T.StringType()), T.StructField(kept, T.BooleanType())])
    done = map_texts(docs, "text", names, fields, make).filter(F.col(kept))
    text = {"text": F.coalesce(cut, "text")}
    if "n_chars" in names:
        text["n_chars"] = F.when(F.col(cut).isNotNull(), F.length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumns(text).select(*names)


def _cut_by_all(docs: DataFrame, blocks: Sequence[Sequence[tuple[str | None, list[bytes]]]], window: int, max_coverage: float) -> DataFrame:
    """As with one block of all items: spans of all blocks are found on one text before any is cut, and a text that was cut passes
    all blocks again. Only such texts do."""
    names, rest = docs.columns, [c for c in docs.columns if c != "text"]
    keep = ["_ww_row", "_ww_gone", "_ww_total", "text"]
    left = docs.select(F.struct(*rest, F.lit(0).alias("_ww_")).alias("_ww_row"), F.lit(0).cast("long").alias("_ww_gone"),
                       F.lit(None).cast("long").alias("_ww_total"), "text")
    schema = left.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = [_cut_text(t, [(s["start"], s["end"]) for s in spans]).decode("utf-8", "replace")
                         for spans, t in zip(part.column(3).to_pylist(), part.column(4).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(texts, pa.string())], names=keep)

    done: list[DataFrame] = []
    while not done or not left.isEmpty():
        found = cut_lineage(_found_by(left, blocks, keep, window), "leaks")
        done.append(found.filter(F.size("hit_spans") == 0).select(*keep))
        gone = F.col("_ww_gone") + F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
        total = F.coalesce("_ww_total", "n_words")
        hit = found.filter(F.size("hit_spans") > 0).filter(gone <= max_coverage * total)
        hit = hit.select("_ww_row", gone.alias("_ww_gone"), total.alias("_ww_total"), "hit_spans", F.col("text").cast("binary").alias("text"))
        left = cut_lineage(hit.mapInArrow(run, schema), "decontaminated")
    whole = functools.reduce(DataFrame.unionByName, done)
    columns = {c: F.col("_ww_row").getField(c) for c in rest} | {"text": F.col("text")}
    if "n_chars" in rest:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("_ww_gone") > 0, length).otherwise(columns["n_chars"])
    return whole.select(*[columns[c].alias(c) for c in names])


def items_digest(items: Sequence[str]) -> str:
    """The digest ``contamination`` gives, for tests and readers of its output."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
