"""What the operators of this folder share: input, checkpoints, Arrow batches, word hashes."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import islice
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Word pattern of the contracts: runs of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Where steps are written: the checkpoint folder, which all executors see.

    Only a local session without one (tests) gets a temporary folder.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each action inside as soon as the action ends."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there, so that a lost executor costs no rerun and no shuffle file outlives the step."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4()}"
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(*steps: DataFrame) -> None:
    """Deletes what ``stored`` has written for these, which nothing may read any more."""
    for df in steps:
        deleted(df.sparkSession, _paths.pop(df))


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``most`` bytes of text each (one row at least), so that memory stays bounded."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


class Cache(dict):
    """A dict that holds about ``most`` bytes beside what it begins with: the older half goes when it is full, and keys of over 100 characters don't enter."""

    def __init__(self, most: int, fixed: Iterable = ()):
        super().__init__(fixed)
        self.most, self.held, self.fixed = most, 0, len(self)

    def keep(self, key: str, value):
        """``value``, kept if there is room for such keys."""
        if len(key) <= 100:
            if self.held >= self.most:
                for old in list(islice(self, self.fixed, self.fixed + (len(self) - self.fixed + 1) // 2)):
                    self.held -= self._size(old, self.pop(old))
            if key not in self:
                self.held += self._size(key, value)
            self[key] = value
        return value

    @staticmethod
    def _size(key: str, value) -> int:
        return getsizeof(key) + getsizeof(value) + 60  # the last is about an entry's share of the table


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in column(batch, name)]


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: A random 64-bit value for each byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers (``n`` at least) of the multiplier and of its inverse, modulo 2**64."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(20, int(n).bit_length())
        made = []
        for base in (_MULTIPLIER, _INVERSE):
            x = np.empty(size, np.uint64)
            x[0], filled, step = 1, 1, base
            while filled < size:
                x[filled : 2 * filled] = x[:filled] * step
                filled, step = 2 * filled, step * step
            made.append(x)
        have = _powers[0] = (made[0], made[1])
    return have


class Hasher:
    """64-bit hashes of any substrings of a byte array, after one pass over it."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            up, self.down = powers(len(data) + 1)
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal strings wherever they stand; scrambled with the length."""
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of many texts: ``begin`` and ``end`` in ``data``, ``doc`` of each, ``first`` word of each text (one more at the end)."""

    def __init__(self, encoded: list[bytes]):
        joined = b"\n".join(encoded) + b"\n"
        self.data = np.frombuffer(joined, np.uint8)
        space = _SPACE[self.data]
        at = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.begin, self.end = at[0::2], at[1::2]
        self.offsets = np.zeros(len(encoded) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in encoded], out=self.offsets[1:])
        self.first = np.searchsorted(self.begin, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(encoded)), self.counts)

    def hashes(self) -> np.ndarray:
        return Hasher(self.data).hash(self.begin, self.end)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` successive word hashes; shorter than the input by ``n - 1``."""
    with np.errstate(over="ignore"):
        size = max(0, len(hashes) - n + 1)
        out = np.full(size, np.uint64(n))
        for i in range(n):
            out = (out ^ hashes[i : i + size]) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(29)
        return mixed(out)
