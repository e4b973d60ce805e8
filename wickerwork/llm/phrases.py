"""Phrase collocations by direct-address tiling.

Texts are turned into blocks of word numbers with a word list of each block's own, so that no list of all words ever travels. Words
of a language are ranked by frequency over all blocks and each block's list is told the ranks. Every place of a text then gives a
window, the ranks of its word and the next few up to the first one too rare, and windows are dealt into parts by their first two
words, so that a part has all occurrences of the phrases that begin so: texts are shuffled once, whatever the number of frequent
phrases. In a part, neighbouring ranks are counted in tiles: a pair of ranks addresses a cell, tiles with many pairs are counted with
one dense ``bincount``, what is left over as sorted coordinates. Frequent pairs are ranked anew and are the first ranks of the next
pairs: a pair and the word after it are phrases of three, and so on. Where all words are so common that the phrase itself could fill
a part, windows are dealt by one more word, and the phrase's counts are summed over the parts.

Nulls and odd rows: a null text is empty, a null language is ``und``, rows that repeat count as often as they are there. An empty
table, or one without frequent phrases, gives no rows. Extra columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wickerwork.llm.common import bound_batches, small_batches
from wickerwork.operators.ranking import number_rows
from wickerwork.session import cut_lineage

#: Ranks of a tile's side, as bits; tiles of the first ranks that may be dense, to a side; pairs from which one is.
TILE_BITS, HEAD, DENSE = 10, 4, 1 << 16
#: Words of the blocks a task holds, but for the last text's, which is not split.
BLOCK_WORDS = 1 << 19
#: Windows of a part, on average; words that occur more often may begin phrases that are dealt over parts.
PART_WINDOWS = 1 << 20
#: Longest phrase.
WORDS = 5
MINIMUM, FIRST = 100, 2000

#: Stands for the end of a piece; no byte of UTF-8 text is that.
_END = b"\xff"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 0xFF if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


class _Numbers(dict):
    """Words of a block in the order first seen; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Block:
    def __init__(self) -> None:
        self.numbers, self.codes, self.size = _Numbers({_END: 0}), [], 0

    def add(self, text: bytes) -> None:
        # split() takes the same white space as the pieces' ends and blanks do; the ends are put back as a word of their own
        words = text.translate(_FOLD).replace(_END, b" \xff ").split()
        words.append(_END)
        self.codes.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def row(self, lang: str) -> tuple:
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes, minlength=len(self.numbers)).astype(np.int64)
        return lang, codes.tobytes(), [w.decode() for w in list(self.numbers)[1:]], counts[1:]


def text_blocks(docs: DataFrame, words: int = BLOCK_WORDS) -> DataFrame:
    """(block, lang, codes, words, counts): the texts of a task and language as numbers from 1 in the block's own word list, 0
    after each piece. A task holds ``words`` at most, and its last text."""
    schema = "lang string, codes binary, words array<string>, counts array<long>"
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, _Block] = {}
        held = 0

        def out(langs: list[str]) -> Iterator[pa.RecordBatch]:
            for lang in langs:
                row = blocks.pop(lang).row(lang)
                yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]]), pa.array([row[2]], pa.list_(pa.string())),
                                                  pa.array([row[3]], pa.list_(pa.int64()))], names=["lang", "codes", "words", "counts"])

        for batch in small_batches(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                block = blocks.setdefault(lang, _Block())
                before = block.size
                block.add(text)
                held += block.size - before
                if held >= words:
                    held = 0
                    yield from out(list(blocks))
        yield from out(list(blocks))

    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


def _keys(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int]:
    """One number for each pair, and what to divide by to get the pair back."""
    span = int(y.max()) + 1 if len(y) else 1
    if len(x) and int(x.max()) >= (1 << 62) // span:
        raise OverflowError("ranks too large for one key")
    return x * span + y, span


def tile_counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of (x, y) and their counts. Ranks are small for what is frequent: the tiles of the first ranks are counted
    by direct address where they are dense, the pairs of all other tiles as sorted coordinates."""
    side, mask = 1 << TILE_BITS, (1 << TILE_BITS) - 1
    parts = []
    left = np.ones(len(x), bool)
    head = (x < HEAD * side) & (y < HEAD * side)
    tile = (x[head] >> TILE_BITS) * HEAD + (y[head] >> TILE_BITS)
    at = np.flatnonzero(head)
    for t in np.flatnonzero(np.bincount(tile, minlength=1) >= DENSE):
        here = at[tile == t]
        counts = np.bincount(((x[here] & mask) << TILE_BITS) | (y[here] & mask))
        cell = np.flatnonzero(counts)
        parts.append(((t // HEAD) * side + (cell >> TILE_BITS), (t % HEAD) * side + (cell & mask), counts[cell]))
        left[here] = False
    keys, span = _keys(x[left], y[left])
    found, counts = np.unique(keys, return_counts=True)
    parts.append((found // span, found % span, counts))
    return tuple(np.concatenate(p).astype(np.int64) for p in zip(*parts))


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _windows(ids: np.ndarray, most: int) -> list[np.ndarray]:
    """The ranks of ``most`` words from each place on, by column, 0 from the first one without a rank; places without a pair left out."""
    columns = [ids]
    for k in range(1, most):
        after = np.r_[ids[k:], np.zeros(min(k, len(ids)), ids.dtype)]
        columns.append(np.where(columns[-1] > 0, after, 0))
    some = np.flatnonzero(columns[1])
    return [c[some] for c in columns]


def _part(columns: list[np.ndarray], parts: int, hot: int) -> np.ndarray:
    """Windows go by their first two words, and by one more as long as all so far are among the ``hot`` first ranks."""
    h = _mixed(_mixed(np.full(len(columns[0]), 0x5851F42D4C957F2D, np.uint64), columns[0]), columns[1])
    common = (columns[0] <= hot) & (columns[1] <= hot)
    for c in columns[2:]:
        common &= c > 0
        h[common] = _mixed(h[common], c[common])
        common &= c <= hot
    return ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def word_windows(blocks: DataFrame, ranks: DataFrame, most: int) -> DataFrame:
    """(lang, part, hot, width, windows): the windows of a block that go to one part, column by column, in whole numbers of
    ``width`` bytes. blocks(block, lang, codes, parts, hot), ranks(of, number, id), ``of`` a block and ``id`` from 1."""
    names = ["lang", "part", "hot", "width", "windows"]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), "part": pa.array([], pa.int64()), "hot": pa.array([], pa.int64()),
                             "width": pa.array([], pa.int32()), "windows": pa.array([], pa.binary())})
        codes = np.frombuffer(left["codes"][0].as_py(), np.int32)
        told = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int64)
        told[right["number"].to_numpy()] = right["id"].to_numpy()
        columns = _windows(told[codes], most)
        hot = left["hot"][0].as_py()
        part = _part(columns, left["parts"][0].as_py(), hot)
        order = np.argsort(part * (len(told) and int(told.max()) + 1) + columns[0], kind="stable")  # alike ones together are packed better
        part = part[order]
        kind = np.uint16 if int(told.max()) < 1 << 16 else np.uint32
        laid = np.stack([c[order].astype(kind) for c in columns])
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        rows = [laid[:, a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)])]
        n = len(rows)
        return pa.table({"lang": pa.array([left["lang"][0].as_py()] * n, pa.string()), "part": pa.array(part[cuts], pa.int64()),
                         "hot": pa.array([hot] * n, pa.int64()), "width": pa.array([np.dtype(kind).itemsize] * n, pa.int32()),
                         "windows": pa.array(rows, pa.binary())})

    return (blocks.groupBy("block").cogroup(ranks.groupBy("of")).applyInArrow(run, "lang string, part long, hot long, width int, windows binary")
            .select(*names))


def _packed(words: np.ndarray) -> pa.Array:
    """A row of four bytes a word, the first word first."""
    size = 4 * words.shape[1]
    offsets = np.arange(len(words) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words.astype(">u4").tobytes())])


def phrase_counts(windows: DataFrame, most: int, minimum: int) -> DataFrame:
    """(lang, key, f): the phrases of 2 to ``most`` words with ``minimum`` occurrences or more, ``key`` being their ranks packed."""
    schema = "lang string, key binary, f long"

    def run(key, rows):
        hot = rows["hot"][0].as_py()
        laid = [np.frombuffer(w.as_buffer(), np.uint16 if size == 2 else np.uint32).reshape(most, -1)
                for w, size in zip(rows["windows"], rows["width"].to_pylist())]
        columns = [np.concatenate([x[k] for x in laid]) for k in range(most)]
        ids = columns[0].astype(np.int64)
        words = np.arange(int(ids.max()) + 1)[:, None]  # of each rank
        keys, counts = [], []
        for size in range(2, most + 1):
            some = np.flatnonzero(columns[size - 1])
            ids, columns = ids[some], [c[some] for c in columns]
            y = columns[size - 1].astype(np.int64)
            a, b, c = tile_counts(ids, y)
            made = np.hstack([words[a], b[:, None]])
            # phrases of common words only are counted in several parts, but for the longest
            kept = np.flatnonzero((c >= minimum) | ((made <= hot).all(axis=1) & (size < most)))
            kept = kept[np.lexsort((b[kept], a[kept], -c[kept]))]
            a, b, c, words = a[kept], b[kept], c[kept], made[kept]
            keys.append(_packed(words))
            counts.append(c)
            if not len(kept):
                break
            both, _ = _keys(np.concatenate([ids, a]), np.concatenate([y, b]))
            mine, told = both[:len(ids)], both[len(ids):]
            order = np.argsort(told, kind="stable")
            place = np.minimum(np.searchsorted(told, mine, sorter=order), len(told) - 1)
            rank = order[place]
            hit = told[rank] == mine
            ids, columns = rank[hit], [x[hit] for x in columns]
        found = pa.chunked_array(keys, pa.binary())
        return pa.table({"lang": pa.repeat(key[0], len(found)), "key": found, "f": np.concatenate(counts).astype(np.int64)})

    parts = windows.groupBy("lang", "part").applyInArrow(run, schema)
    return parts.groupBy("lang", "key").agg(F.sum("f").alias("f")).filter(F.col("f") >= minimum)


def frequent_phrases(docs: DataFrame, most: int = WORDS, minimum: int = MINIMUM, block_words: int = BLOCK_WORDS,
                     part_windows: int = PART_WINDOWS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each length from 1 to ``most`` its frequent phrases: (lang, key, phrase, last, left, right,
    begins, ends). ``left`` and ``right`` are the keys without the last and first word; ``begins`` and ``ends`` have the counts
    of the first and last 1, 2, ... words, so that both end with the phrase's own count."""
    blocks = cut_lineage(text_blocks(docs, block_words), "phrase-blocks")
    listed = blocks.select("lang", "block", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "w")).select(
        "lang", "block", (F.col("i") + 1).alias("number"), F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    counted = listed.groupBy("lang", "word").agg(F.sum("c").alias("f"))
    totals = cut_lineage(listed.groupBy("lang").agg(F.sum("c").alias("n")), "phrase-totals")
    numbered = number_rows(counted.filter(F.col("f") >= minimum), [F.desc("f"), F.asc("word")], "place", ["lang"])
    ranked = cut_lineage(numbered.select("lang", "word", "f", (F.col("place") + 1).alias("id")), "phrase-words")
    hot = ranked.groupBy("lang").agg(F.count_if(F.col("f") > part_windows).alias("hot"))
    sizes = totals.join(hot, "lang").select("lang", F.ceil(F.col("n") / part_windows).alias("parts"), "hot")
    told = listed.join(ranked, ["lang", "word"]).select(F.col("block").alias("of"), "number", "id")
    windows = word_windows(blocks.select("block", "lang", "codes").join(sizes, "lang"), told, most)
    counts = cut_lineage(phrase_counts(windows, most, minimum), "phrase-counts")
    nothing = F.lit(None).cast("binary")
    levels = [ranked.select("lang", F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), F.col("word").alias("phrase"), F.col("word").alias("last"),
                            nothing.alias("left"), nothing.alias("right"), F.array("f").alias("begins"), F.array("f").alias("ends"))]
    for size in range(2, most + 1):
        part = 4 * (size - 1)
        these = counts.filter(F.octet_length("key") == 4 * size).select(
            "lang", "key", "f", F.substring("key", 1, part).alias("left"), F.substring("key", 5, part).alias("right"))
        parts = levels[-1].select("lang", "key", "phrase", "last", "begins", "ends")
        left, right = parts.alias("l"), parts.alias("r")
        joined = (these.alias("p").join(left, (F.col("p.lang") == F.col("l.lang")) & (F.col("p.left") == F.col("l.key")))
                  .join(right, (F.col("p.lang") == F.col("r.lang")) & (F.col("p.right") == F.col("r.key"))))
        levels.append(cut_lineage(joined.select(
            "p.lang", "p.key", F.concat_ws(" ", "l.phrase", "r.last").alias("phrase"), "r.last", "p.left", "p.right",
            F.concat("l.begins", F.array("f")).alias("begins"), F.concat("r.ends", F.array("f")).alias("ends")), "phrase-level"))
    return totals, levels


def lowest_cut(n: str = "n") -> str:
    """SQL of the lowest-scoring cut of a phrase, as a struct (score, k, l, r). Numbers of up to 38 digits: 1000 * a * n and l * r
    are exact as long as counts stay under 10^17."""
    a = "cast(element_at(begins, -1) as decimal(17, 0))"
    return f"""array_min(transform(sequence(1, size(begins) - 1), k -> named_struct(
        'score', (cast(1000 as decimal(4, 0)) * {a} * cast({n} as decimal(17, 0)))
                 div (cast(begins[k - 1] as decimal(17, 0)) * cast(ends[size(ends) - k - 1] as decimal(17, 0))),
        'k', k, 'l', begins[k - 1], 'r', ends[size(ends) - k - 1])))"""


def collocations(docs: DataFrame, most: int = WORDS, minimum: int = MINIMUM, first: int = FIRST, block_words: int = BLOCK_WORDS,
                 part_windows: int = PART_WINDOWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases of 2 to ``most`` words by score, count and phrase.

    A phrase inside a longer one of the same count is left out; a chain of such phrases leads through every length between, so
    looking one word further is enough."""
    totals, levels = frequent_phrases(docs, most, minimum, block_words, part_windows)
    found = None
    for size in range(2, most + 1):
        level = levels[size - 1].withColumn("a", F.element_at("begins", -1))
        if size < most:
            longer = levels[size].select("lang", F.element_at("begins", -1).alias("a"), F.explode(F.array("left", "right")).alias("key"))
            level = level.join(longer, ["lang", "key", "a"], "left_anti")
        level = level.select("lang", "phrase", "a", "begins", "ends")
        found = level if found is None else found.unionByName(level)
    scored = found.join(totals, "lang").withColumn("cut", F.expr(lowest_cut())).select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # each map task's part of a language is cut to ``first`` before it is shuffled
    part = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    short = part.withColumn("_k", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_k") <= first)
    ranked = short.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
