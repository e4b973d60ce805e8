"""Token ids as binary files: blocks coded by an adaptive context-mixing range coder, and a directory of documents.

Documents are range-partitioned by id, so shards and what lies in them ascend; each task tokenises its range and writes one shard.
A shard is a mark, its blocks, each reset and checksummed by itself, a directory (compressed, checksummed) of document ids,
token counts and block places, and a footer that tells where the directory lies."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wickerwork.llm.common import SLICE_ROWS, open_store, put_file
from wickerwork.llm.range_coder import BLOCK_TOKENS, HEADER, decode_block, encode_block
from wickerwork.llm.tokens import shared_encoder, tokenizer_path
from wickerwork.session import cut_lineage, scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of text that go to one shard, on average.
SHARD_BYTES = 16 << 20

_MARK = b"WWTOKEN1"
_FOOTER = struct.Struct("<QQQQI")  # place and size of the directory, documents, tokens, directory's checksum
_MANIFEST = "shard long, path string, documents long, tokens long"


class ShardWriter:
    """Takes documents in order and writes full blocks as they come together; holds one block at a time."""

    def __init__(self, out: pa.NativeFile, block_tokens: int = BLOCK_TOKENS) -> None:
        self.out, self.block_tokens = out, block_tokens
        self.waiting: list[bytes] = []
        self.held = 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.blocks: list[int] = []
        self.at = len(_MARK)
        out.write(_MARK)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids`` are little-endian unsigned 32-bit, the end id included."""
        self.ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.block_tokens:
            self._flush(whole=True)

    def _flush(self, whole: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        upto = len(ids) - len(ids) % self.block_tokens if whole else len(ids)
        for a in range(0, upto, self.block_tokens):
            block = encode_block(ids[a:min(a + self.block_tokens, upto)])
            self.blocks.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.waiting = [ids[upto:].tobytes()]
        self.held = len(ids) - upto

    def close(self) -> tuple[int, int]:
        self._flush(whole=False)
        known = np.array([d is not None for d in self.ids], np.uint8)
        directory = zlib.compress(b"".join([
            struct.pack("<QQ", len(self.ids), len(self.blocks)), known.tobytes(), np.array([d or 0 for d in self.ids], "<i8").tobytes(),
            np.array(self.sizes, "<i8").tobytes(), np.array(self.blocks, "<i8").tobytes()]))
        tokens = sum(self.sizes)
        self.out.write(directory)
        self.out.write(_FOOTER.pack(self.at, len(directory), len(self.ids), tokens, zlib.crc32(directory)))
        return len(self.ids), tokens


class ShardReader:
    """Opens a shard from its footer. Blocks are decoded one at a time; any of them can be read without the others."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source = source
        size = source.size()
        at, length, _, self.tokens, crc = _FOOTER.unpack(source.read_at(_FOOTER.size, size - _FOOTER.size))
        packed = source.read_at(length, at)
        if source.read_at(len(_MARK), 0) != _MARK or zlib.crc32(packed) != crc:
            raise ValueError("damaged shard")
        raw = zlib.decompress(packed)
        n, blocks = struct.unpack_from("<QQ", raw)
        known = np.frombuffer(raw, np.uint8, n, 16)
        self.ids = [d if k else None for d, k in zip(np.frombuffer(raw, "<i8", n, 16 + n).tolist(), known)]
        self.sizes = np.frombuffer(raw, "<i8", n, 16 + 9 * n)
        self.blocks = np.frombuffer(raw, "<i8", blocks, 16 + 17 * n)

    def block(self, k: int) -> np.ndarray:
        at = int(self.blocks[k])
        header = self.source.read_at(HEADER.size, at)
        return decode_block(header, self.source.read_at(HEADER.unpack(header)[5], at + HEADER.size))

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """Id, first token's place in the shard, token count and ids' crc32 of each document, in order."""
        data, k, place = b"", 0, 0
        for doc_id, size in zip(self.ids, self.sizes.tolist()):
            left, crc = 4 * size, 0
            while left:
                if not data:
                    data, k = memoryview(self.block(k).tobytes()), k + 1
                part = data[:left]
                crc = zlib.crc32(part, crc)
                data, left = data[len(part):], left - len(part)
            yield doc_id, place, size, crc
            place += size


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write every text's ids (null: empty), each with the end id after it, in ascending order of doc_id, null ids first, texts of
    one id in order of their hash. Returns the manifest: shard (ascending with doc_id), path, documents, tokens.

    The manifest is staged, which runs the writing once; a task that runs again replaces its own shard with the same bytes."""
    path = tokenizer_path(tokenizer)
    end = np.array([end_id], dtype="<u4").tobytes()
    narrow = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = narrow.repartitionByRange(max(1, -(-total // shard_bytes)), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name = f"shard-{shard:07d}.tok"
        encoder = shared_encoder(path, spaces=True)
        counts = []

        def write(out: pa.NativeFile) -> None:
            writer = ShardWriter(out)
            for batch in (b for some in ([first], batches) for b in some):
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                        writer.add(doc_id, ids + end)
            counts.extend(writer.close())

        put_file(store, f"{base}/{name}", write)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{name}"], "documents": [counts[0]], "tokens": [counts[1]]})

    return cut_lineage(ordered.mapInArrow(run, _MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens and ids_crc32 of every document, decoded from the shards."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row a shard
    placed = manifest.select("shard", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    spread = placed.repartitionByRange(max(1, manifest.count()), "shard").select("path", "first")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = open_store(path)
                with store.open_input_file(at) as source:
                    rows = [(d, first + place, n, crc) for d, place, n, crc in ShardReader(source).documents()]
                columns = zip(*rows) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all documents to a fresh folder beside the staged tables and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id, shard_bytes))
