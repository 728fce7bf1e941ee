"""What the corpus operators share: staged tables, text buffers and string hashing in numpy.

Documents are rows with an id column and a text column. A null text is an empty text everywhere.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_A2Z = "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a fresh one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='girder-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/girder/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and unlike checkpoint() computes the plan once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def with_tag(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __tag: 0, or where an id has several texts, the number of the text among them.

    (id, tag) names a text, so that what is decided for one row of a repeated id is not applied to another. The texts themselves
    are not shuffled unless ids repeat.
    """
    marks = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__mark"))
    several = marks.groupBy("__id").agg(F.min("__mark").alias("lo"), F.max("__mark").alias("hi")).where("lo <> hi").select("__id")
    tags = marks.join(several, "__id", "left_semi").distinct().withColumn("__tag", F.row_number().over(Window.partitionBy("__id").orderBy("__mark")) - 1)
    tags = staged(tags, "tags")
    if tags.isEmpty():
        return docs.withColumn("__tag", F.lit(0))
    same = (F.col(id_col) == F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__mark"))
    return docs.join(tags, same, "left").drop("__id", "__mark").withColumn("__tag", F.coalesce("__tag", F.lit(0)))


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns called c0, c1, ... and these names by the old ones, so that no column can clash with an operator's own."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure-ASCII texts take the fast lower(); others a per-character map."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _A2Z.upper(), _A2Z))


# ---------------------------------------------------------------- text buffers


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about `limit` bytes of text each (one row at least)."""
    if batch.num_rows == 0:
        return
    _, off = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and offsets: text k is buf[off[k]:off[k + 1]]. Nulls are empty."""
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, kind, count=len(array) + 1, offset=array.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run never crosses a text's boundary."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = mask.copy()
    starts[1:] &= ~mask[:-1]
    edge = off[:-1][off[:-1] < n]
    starts[edge] = mask[edge]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    last = off[1:][off[1:] > 0] - 1
    ends[last] = mask[last]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


# ---------------------------------------------------------------- hashes of byte ranges

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, key: str) -> np.ndarray:
    if len(_powers.get(key, ())) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        _powers[key] = np.cumprod(step, dtype=np.uint64)
    return _powers[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply, xor-shift), wrapping."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class ByteHash:
    """64-bit hashes of ranges of a buffer, from one running polynomial over it."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n, "up"), out=self.total[1:])
        self.down = _power(_INVERSE, n + 1, "down")

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.total[ends] - self.total[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def range_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ByteHash(buf)(starts, ends)


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over each text (values has one entry for each byte)."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
