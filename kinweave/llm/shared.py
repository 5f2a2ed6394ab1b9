"""Helpers that the training-data operators share: shared storage, bounded batches, word hashing."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Rows of text that one step handles at a time are limited to about so many characters.
BATCH_CHARS = 2_500_000
#: Entries that a worker's word cache may hold; it starts anew beyond them.
CACHE_WORDS = 150_000

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir``. Only a local master without that setting gets a temporary folder, which the session
    then has for that setting; any other raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kinweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses. Inside ``scratch`` it goes when the block ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (held := _scratch.get()) is not None:
        held.append(path)
    return path


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the block's end, the folders that the operators inside wrote: write their result before."""
    held: list[str] = []
    token = _scratch.set(held)
    try:
        yield
    finally:
        _scratch.reset(token)
        remove(spark, held)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: its lineage ends there and its size is known."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, columns: list[str], function: Callable[..., Iterable[dict]], schema: str, limit: int = BATCH_CHARS, collect: bool = True) -> DataFrame:
    """Apply ``function(lists of the columns) -> dict of lists`` to bounded batches of ``columns``.

    Only the named columns travel to Python, so further columns of any name do no harm.
    Without ``collect``, a task only returns what is free already: for functions that fill no word cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if collect:
            give_back()
        for values in bounded(batches, limit):
            yield pa.RecordBatch.from_pydict(function(*values), schema=arrow)
        give_back() if collect else trim()

    arrow = arrow_schema(df.sparkSession, schema)
    return df.select(*columns).mapInArrow(run, schema)


def give_back() -> None:
    """Empty the word cache and return freed memory to the system: a worker lives on, beside those of later stages.

    A task calls it first, for what the task before it left, and last.
    """
    _hashes.clear()
    gc.collect()
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def slices(batches: Iterator[pa.RecordBatch], limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the bytes of a cut stay near ``limit``."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, min(rows, int(rows * limit / max(batch.nbytes, 1)))) if rows else 1
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def bounded(batches: Iterator[pa.RecordBatch], limit: int = BATCH_CHARS) -> Iterator[list[list]]:
    """The columns of each cut as lists."""
    for part in slices(batches, limit):
        yield [column.to_pylist() for column in part.columns]


#: Words are runs of other characters than space, tab, line feed, vertical tab, form feed and return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8. ``bytes.split`` divides at just the six characters named in WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, the same on every machine; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit permutation (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive entries."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    total = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        total *= MULTIPLIER
        total += hashes[i : len(hashes) - n + 1 + i]
    return mixed(total)
