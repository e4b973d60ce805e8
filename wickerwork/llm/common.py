"""Helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of an Arrow batch, and bytes of their texts, that are worked on together, so that a task holds few texts at a time.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20
#: Bytes of the batches in which rows reach Python; a longer row is alone.
BATCH_BYTES = 2 << 20

#: ASCII letters in lower case and digits stay, other ASCII becomes a space, bytes of other characters stay.
FOLD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def fold(column: str, buckets: int) -> Column:
    """crc32 of an id written as text, modulo ``buckets``. Null ids fall in no fold (null)."""
    return F.crc32(F.col(column).cast("string")) % buckets


def folded_words(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, with A-Z in lower case. Null has none."""
    return text.translate(FOLD_BYTES).split() if text else []


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, made longer until none of ``columns`` is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _text_last(df: DataFrame, text: str, keep: Sequence[str]) -> tuple[DataFrame, Sequence[int]]:
    """A table that holds the text once, and last, for the way to Python; and where in it ``keep`` is found."""
    others = [c for c in keep if c != text]
    if text in keep:
        return df.select(*[F.col(c) for c in others], F.col(text)), [([*others, text]).index(c) for c in keep]
    return df.select(*[F.col(c) for c in others], F.col(text).cast("binary").alias(unused("_text_bytes", keep))), range(len(others))


def bound_batches(spark: SparkSession) -> None:
    """From now on this session's rows reach Python in batches of BATCH_BYTES. Spark's own bound is 64 MB, and a batch is
    held by the executor and by the Python worker of every running task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches in slices of so many rows and bytes of the last column, a text, at most; a longer text is alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            stop = min(at + rows, max(at + 1, full))
            yield batch.slice(at, stop - at)
            at = stop


@functools.lru_cache(maxsize=1)
def _trimmer() -> Callable[[int], int] | None:
    """What makes the C library give free memory back, where it can."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return memory that is free to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := _trimmer()) is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives back what it no longer needs: workers live on between tasks, beside stages without Python."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()


def map_texts(df: DataFrame, text: str, keep: Sequence[str], out: T.StructType,
              make: Callable[[], Callable[[list[bytes | None]], Sequence[Sequence]]]) -> DataFrame:
    """The columns ``keep`` and new ones from each whole text, with no shuffle.

    ``make()`` runs once in a task and gives a function from a list of UTF-8 texts (None for null) to one list a new
    column. Only ``keep`` and the text leave the JVM, each once."""
    bound_batches(df.sparkSession)
    narrow, kept = _text_last(df, text, keep)
    schema = T.StructType([narrow.schema.fields[i] for i in kept] + out.fields)
    new_types = [to_arrow_type(f.dataType) for f in out.fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in small_batches(batches):
            made = work(_texts(part))
            arrays = [pa.array(values, kind) for values, kind in zip(made, new_types)]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *arrays], names=names)

    return narrow.mapInArrow(tidy(run), schema)


def open_store(uri: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system and path of a folder named as Spark names it, for tasks that write files Spark has no writer for."""
    if uri.startswith("file:"):
        return pa_fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa_fs.FileSystem.from_uri(uri)


def put_file(store: pa_fs.FileSystem, path: str, write: Callable[[pa.NativeFile], None]) -> None:
    """Write a file under a name of its own and move it into place whole, so that a task which is lost or runs twice leaves either
    nothing or the whole file."""
    draft = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(draft, compression=None) as out:
        write(out)
    if store.type_name != "local" and store.get_file_info(path).type != pa_fs.FileType.NotFound:
        store.delete_file(path)  # a local move replaces by itself
    store.move(draft, path)


def explode_texts(df: DataFrame, text: str, keep: Sequence[str], out: T.StructType,
                  make: Callable[[], Callable[[list[bytes | None]], list[list[tuple]]]]) -> DataFrame:
    """Any number of rows from each whole text: ``keep`` repeated, then the tuples that ``make()(texts)`` lists for it."""
    bound_batches(df.sparkSession)
    narrow, kept = _text_last(df, text, keep)
    schema = T.StructType([narrow.schema.fields[i] for i in kept] + out.fields)
    new_types = [to_arrow_type(f.dataType) for f in out.fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in small_batches(batches):
            source, rows = [], []
            for i, made in enumerate(work(_texts(part))):
                source.extend([i] * len(made))
                rows.extend(made)
            taken = pa.array(source, pa.int32())
            columns = list(zip(*rows)) if rows else [[]] * len(new_types)
            arrays = [pa.array(values, kind) for values, kind in zip(columns, new_types)]
            yield pa.RecordBatch.from_arrays([*[part.column(i).take(taken) for i in kept], *arrays], names=names)

    return narrow.mapInArrow(tidy(run), schema)
