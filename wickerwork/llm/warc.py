"""WARC archives: records written as one gzip stream a file, normalised to one gzip member a record with an offset index, and read
back through that index.

An archive that was compressed as a whole can only be read from its start. The normaliser inflates such a stream once, in pieces,
finds record after record by their lengths, deflates each into a member of its own and notes where the member lies."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerwork.llm.common import bound_batches, open_store, put_file
from wickerwork.session import cut_lineage, scratch_path

#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 100
#: Bytes of an archive's records from which the next one is begun; archives that a task rewrites where there are many.
ARCHIVE_BYTES, ARCHIVES_A_TASK = 16 << 20, 8
#: Bytes inflated at a time.
CHUNK = 1 << 20

# Fixed values of the format.
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # pages carry no time
_INDEX = "archive string, record_id string, record_type string, offset long, length long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build_record(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A whole record. A revisit has no block: its payload is that of the record it refers to."""
    block = payload if kind == "response" else b""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", _DATE), ("WARC-Page-ID", "" if page_id is None else str(page_id)),
             ("WARC-Target-URI", "".join(c for c in url or "" if c not in "\r\n")), ("WARC-Payload-Digest", f"sha256:{digest}"),
             ("WARC-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        lines += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    lines += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    head = _VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n"
    return head + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines if x)}


def inflate(source: pa.NativeFile, chunk: int = CHUNK) -> Iterator[bytes]:
    """The plain bytes of a gzip stream, of one member or many, a piece at a time. Raises ValueError where it breaks off."""
    engine = zlib.decompressobj(31)
    begun = False
    while data := source.read(chunk):
        while data:
            begun = True
            plain = engine.decompress(data, chunk)
            if plain:
                yield plain
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine, begun = engine.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("gzip stream breaks off")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Head fields and whole bytes of each record of a stream; holds one record at a time."""
    held = bytearray()

    def need(size: int) -> None:
        while len(held) < size:
            held.extend(next(pieces))

    while True:
        try:
            need(1)
        except StopIteration:
            return
        try:
            seen = 0
            while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
                seen = len(held)
                need(seen + 1)
            head = parse_head(bytes(held[:end]))
            size = end + 4 + int(head["content-length"]) + 4
            need(size)
        except StopIteration:
            raise ValueError("record breaks off") from None
        yield head, bytes(held[:size])
        del held[:size]


def normalise(source: pa.NativeFile, out: pa.NativeFile) -> list[tuple[str, str, int, int]]:
    """Rewrite a gzip stream with a member for each record. Returns record id, type, and place and length of its member."""
    index, at = [], 0
    for head, whole in records(inflate(source)):
        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = engine.compress(whole) + engine.flush()
        out.write(member)
        index.append((head["warc-record-id"], head["warc-type"], at, len(member)))
        at += len(member)
    return index


def with_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url and payload of each page with payload_bytes, payload_digest, record_type and refers_to.

    Null html is empty. Of equal payloads of ``revisit_bytes`` or more, the one with the smallest page_id is the response; rows
    that repeat that id and payload are responses as well. A null page_id counts as the largest. Groups are found on digests
    alone; the one join back may split a hot digest over tasks, as its other side has one row for it."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    firsts = (rows.filter(F.col("payload_bytes") >= revisit_bytes).groupBy(F.col("payload_digest").alias("_digest"))
              .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _first IS NOT NULL").select("_digest", "_first"))
    joined = rows.join(firsts, F.col("payload_digest") == F.col("_digest"), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``with_revisits`` as gzip streams of whole archives. A task begins a new one whenever the records of the last
    have ``archive_bytes``; a longer record is whole in its own. Returns the paths, staged."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)} for b in batches for i in range(b.num_rows))
        row = next(rows, None)
        if row is None:
            return
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        archives = []

        def write(out: pa.NativeFile) -> None:
            nonlocal row
            engine, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0
            while row is not None and size < archive_bytes:
                record = build_record(row["page_id"], row["url"], row["record_type"], row["payload"], row["payload_digest"], row["refers_to"])
                out.write(engine.compress(record))
                size += len(record)
                row = next(rows, None)
            out.write(engine.flush())

        while row is not None:
            name = f"part-{TaskContext.get().partitionId():07d}-{len(archives):05d}.warc.gz"
            put_file(store, f"{base}/{name}", write)
            archives.append(f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"archive": archives})

    return cut_lineage(pages.mapInArrow(run, "archive string"), "warc-archives")


def _parts(spark: SparkSession, archives: int) -> int:
    """Tasks for so many archives: one each, or several each where there are more archives than shuffle partitions."""
    return max(1, min(archives, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-archives // ARCHIVES_A_TASK))))


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive into ``folder``, with a sidecar of JSON lines beside it (``.idx``). Returns the index, staged.

    An archive is read from start to end by one task, as its format demands; archives are bounded by how they were written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, at = open_store(archive)
                target, base = open_store(folder)
                target.create_dir(base, recursive=True)
                name = archive.rsplit("/", 1)[-1]
                index: list[tuple[str, str, int, int]] = []

                def write(out: pa.NativeFile, store=store, at=at, index=index) -> None:
                    with store.open_input_stream(at, compression=None) as source:
                        index.extend(normalise(source, out))

                put_file(target, f"{base}/{name}", write)
                lines = "".join(json.dumps({"id": i, "type": t, "offset": a, "length": n}) + "\n" for i, t, a, n in index)
                put_file(target, f"{base}/{name}.idx", lambda out, lines=lines: out.write(lines.encode()))
                columns = list(zip(*index)) if index else [[]] * 4
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder}/{name}"] * len(index)), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                    names=["archive", "record_id", "record_type", "offset", "length"])

    spread = archives.repartitionByRange(_parts(archives.sparkSession, archives.count()), "archive")
    return cut_lineage(spread.mapInArrow(run, _INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Fetch every record's member by its place, inflate it, check lengths, digests and types, and return what its head says."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    archives = _parts(index.sparkSession, index.select("archive").distinct().count())
    narrow = (index.select("archive", "record_id", "record_type", "offset", "length").repartitionByRange(archives, "archive")
              .sortWithinPartitions("archive", "offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows = []
            for archive, rid, kind, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if archive != name:
                    if source is not None:
                        source.close()
                    store, at = open_store(archive)
                    name, source = archive, store.open_input_file(at)
                plain = zlib.decompress(source.read_at(length, offset), 31)
                end = plain.index(b"\r\n\r\n")
                head, block = parse_head(plain[:end]), plain[end + 4:-4]
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                if head["warc-record-id"] != rid or head["warc-type"] != kind or len(block) != int(head["content-length"]):
                    raise ValueError(f"index and record differ in {archive}")
                if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                    raise ValueError(f"damaged payload in {archive}")
                page, refers = head["warc-page-id"], head.get("warc-refers-to-page-id")
                rows.append((int(page) if page else None, int(head["warc-payload-length"]), digest, kind, int(refers) if refers else None))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return narrow.mapInArrow(run, schema)


def archived_pages(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages, normalise the archives and read every record back: one row per page."""
    spark = pages.sparkSession
    archives = write_archives(with_revisits(pages, revisit_bytes), scratch_path(spark, "warc-whole"), archive_bytes)
    return read_records(normalise_archives(archives, scratch_path(spark, "warc")))
