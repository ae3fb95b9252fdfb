"""What the operators share: tables, durable stages and a vectorised word hasher."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the word rule ``[^\x20\x09-\x0D]+``, as a Java and Python class.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"
_ROOT = Path(__file__).resolve().parents[2]
_own_dir: dict[str, str] = {}
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; they need no copy of it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted((_ROOT / "strandal").rglob("*.py")):
            z.write(f, str(f.relative_to(_ROOT)))
    path = Path(tempfile.mkdtemp(prefix="strandal-")) / "strandal-package.zip"
    path.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(path.resolve()))  # Spark serves it to executors from the driver
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="strandal-")
    return _own_dir[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def session_conf(spark: SparkSession, **values):
    """Session settings for the time of a block; in names, ``__`` stands for a dot."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _write(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back. Its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    with session_conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    return _write(df, new_path(df.sparkSession, tag))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``stage`` or ``new_path`` named, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Stages that are deleted together, once what was made of them is itself written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, tag: str) -> DataFrame:
        path = new_path(self.spark, tag)
        self.paths.append(path)
        return _write(df, path)

    def drop(self, tag: str = "") -> None:
        """Delete the stages of a tag, or all."""
        gone = [p for p in self.paths if not tag or f"/{tag}-" in p]
        for p in gone:
            drop_path(self.spark, p)
        self.paths = [p for p in self.paths if p not in gone]


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names contain."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def schema_with(fields: list[T.StructField], more: str) -> T.StructType:
    """Carried fields, whatever names they or fields inside them have, and those of the DDL string ``more``."""
    return T.StructType([*fields, *T.StructType.fromDDL(more)]).toNullable()


def release() -> None:
    """Return freed memory to the system: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


_caches: list[dict] = []


def task_cache() -> dict:
    """A dictionary that ``tidy`` empties at the end of each task."""
    _caches.append({})
    return _caches[-1]


def tidy(batches):
    """``batches``; at the end of the task all task caches are emptied and their memory is returned."""
    try:
        yield from batches
    finally:
        for c in _caches:
            c.clear()
        release()


def slices(column: pa.Array, most: int = 1 << 20):
    """(first, last) row ranges of a string column with about ``most`` bytes each; a longer text is alone."""
    column = column if not pa.types.is_large_string(column.type) else column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets in them; a null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of SplitMix64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = task_cache()


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 1 << 21:  # what an odd giant needs must not stay in memory
            _powers[name] = have
    return have[:n]


_IS_TERM = _IS_WORD.copy()
_IS_TERM[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = False  # words without ASCII punctuation


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; no word crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = inside[data]
    before = np.concatenate(([False], word[:-1]))
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before[heads] = False
    after = np.concatenate((word[1:], [False]))
    after[heads[heads > 0] - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


LONG_SPAN = 64  # bytes from which a span is hashed by itself


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one running polynomial sum.

    A polynomial modulo ``2**64`` can't tell long regular spans apart, whatever its base; spans of
    ``LONG_SPAN`` bytes or more are hashed one by one with xxhash.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power("up", _BASE, len(data)), out=total[1:])
    out = mix((total[ends] - total[starts]) * _power("down", _BASE_INV, len(data))[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts >= LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, terms: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased) and, for each row, the index of its first word (one more at the end)."""
    if lower:
        data = LOWER[data]
    starts, ends = word_spans(data, offsets, _IS_TERM if terms else _IS_WORD)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)
