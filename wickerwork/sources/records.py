"""Text to typed records: JSON lines or arrays, compressed or not, with a cut-off tail tolerated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, gzip and bzip2 unpacked by their ending: (value)."""
    return spark.read.text(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, a row each. Only for JSON arrays, which no reader can split."""
    return spark.read.text(path, wholetext=True)


def parse_lines(lines: DataFrame, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One record per line; lines that are no whole record (cut off mid-write) are dropped."""
    parsed = T._parse_datatype_string(schema)
    bad = "_bad"
    full = T.StructType([*parsed.fields, T.StructField(bad, T.StringType())])
    record = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = lines.filter(F.trim("value") != "").withColumn("_r", record)
    return rows.filter(F.col("_r").isNotNull() & F.col(f"_r.{bad}").isNull()).select(*keep, "_r.*").drop(bad)


def parse_texts(texts: DataFrame, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of whole texts that are either a JSON array or a record a line."""
    array = F.ltrim("value").startswith("[")
    whole = texts.filter(array).select(*keep, F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("_r")).select(*keep, "_r.*")
    lines = texts.filter(~array).select(*keep, F.explode(F.split("value", "\n")).alias("value"))
    return whole.unionByName(parse_lines(lines, schema, keep))
