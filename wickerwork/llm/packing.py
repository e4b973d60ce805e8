"""Packing of tokenised documents into fixed windows by multiway differencing.

Documents are tokenised and cut in one pass over the texts; only the places, lengths and checksums of pieces go on. Full windows
stand alone. The rest is dealt into bounded groups, and in each the Karmarkar-Karp method merges the two partial partitions of
the largest imbalance, largest windows of one with smallest of the other, until one partition is left. Where a window
comes out over capacity, the group is parted anew into more windows."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerwork.llm.common import explode_texts
from wickerwork.llm.tokens import shared_encoder, tokenizer_path
from wickerwork.session import cut_lineage

CAPACITY = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: What a document has beyond its full windows is cut into pieces of at most this share of a window: with eight pieces or more to
#: a window, differencing leaves next to no imbalance, and so next to no padding.
PART_SHARE = 8
#: Pieces that are parted together, on average.
GROUP_PIECES = 4096

PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")])


def document_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id and the pieces of each document: its ids with the end id after them, cut into full windows of ``capacity`` ids, and
    the rest into pieces of at most ``capacity // PART_SHARE``.

    Null and empty texts are the end id alone."""
    path = tokenizer_path(tokenizer)
    end = np.array([end_id], dtype="<u4").tobytes()
    part = max(1, capacity // PART_SHARE)

    def make():
        encoder = shared_encoder(path, spaces=False)

        def work(texts):
            out = []
            for ids in encoder.encode(texts):
                ids += end
                total = len(ids) // 4
                whole = total - total % capacity
                cuts = [*range(0, whole, capacity), *range(whole, total, part), total]
                out.append([(a, b - a, zlib.crc32(ids[4 * a:4 * b]), total) for a, b in zip(cuts, cuts[1:])])
            return out
        return work

    return explode_texts(docs, "text", ["doc_id"], PIECE, make)


def difference(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window of each length by multiway Karmarkar-Karp differencing.

    A partial partition keeps its windows' sums in falling order, less the smallest; windows still empty are left out, so that
    young partitions stay short. Windows that meet are joined in a forest, which is read out at the end."""
    n = len(lengths)
    joined: list[tuple[int, int]] = []
    heap = [(-int(x), i, np.array([x], dtype=np.int64), np.array([i])) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, order, b, b_nodes = heapq.heappop(heap)
        over = len(a) + len(b) - windows  # so many windows of either side are not empty where they meet
        if over <= 0:
            sums, nodes = np.concatenate([a, b]), np.concatenate([a_nodes, b_nodes])
        else:
            # in falling order against rising order: a's smallest meet b's smallest, b's largest fall on windows a left empty
            head, rest = len(a) - over, len(b) - over
            met = np.arange(n + len(joined), n + len(joined) + over)
            joined.extend(zip(a_nodes[head:].tolist(), b_nodes[rest:][::-1].tolist()))
            sums = np.concatenate([a[:head], a[head:] + b[rest:][::-1], b[:rest]])
            nodes = np.concatenate([a_nodes[:head], met, b_nodes[:rest]])
        falling = np.argsort(-sums, kind="stable")
        sums, nodes = sums[falling], nodes[falling]
        if len(sums) == windows:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), order, sums, nodes))
    place = np.full(n + len(joined), -1)
    for window, node in enumerate(heap[0][3].tolist() if heap else []):
        place[node] = window
    for k in range(len(joined) - 1, -1, -1):
        for child in joined[k]:
            place[child] = place[n + k]
    return place[:n]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each length, no window over ``capacity``; each length is at most that. The number of windows starts at the
    least possible and rises as long as one is over."""
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        place = difference(lengths, windows)
        sums = np.bincount(place, weights=lengths, minlength=windows)
        if sums.max() <= capacity:
            return place
        windows += 1


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset. ``pieces`` is read twice and should be staged.

    A sequence takes pieces of one group; within it they follow each other by doc_id and start without gaps. Repeated pieces are
    placed one by one. An empty table stays empty."""
    columns = ["doc_id", *PIECE.names]
    # numbers that differ from row to row spread repeated rows too; a staged table is read alike when a task is run again
    numbered = pieces.select(*columns, F.monotonically_increasing_id().alias("row"))
    whole = numbered.filter(F.col("length") >= capacity)
    parts = numbered.filter(F.col("length") < capacity)
    groups = max(1, -(-parts.count() // group_pieces))
    schema = T.StructType([*pieces.select(*columns).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def parted(key, rows):
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        window = pack_lengths(rows["length"].to_numpy(), capacity).astype(np.int64)
        rows = rows.append_column("window", pa.array(window)).sort_by([("window", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        window, length = rows["window"].to_numpy(), rows["length"].to_numpy()
        before = np.cumsum(length) - length
        firsts = np.r_[True, window[1:] != window[:-1]]
        offset = before - before[np.flatnonzero(firsts)][np.cumsum(firsts) - 1]
        sequence = (np.int64(key[0].as_py()) << 24) + window
        return rows.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    group = F.pmod(F.xxhash64("row", "doc_id", "start"), F.lit(groups))
    placed = parts.withColumn("group", group).groupBy("group").applyInArrow(parted, schema)
    alone = whole.select(*columns, (F.col("row") + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def packed_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: where it lies in its document and in its sequence."""
    pieces = cut_lineage(document_pieces(docs.select("doc_id", "text"), tokenizer, end_id, capacity), "pieces")
    return pack(pieces, capacity)
