"""Shared pieces of the language-model data operators: shared storage, Arrow batches, word hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text is worked on in slices of about so many bytes, which bounds what a Python worker holds.
SLICE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_BASE_INV = pow(_BASE, -1, 1 << 64)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a checkpoint folder set otherwise.

    Only a session on one machine may do without, as tests do: it gets a temporary folder. On a cluster
    that would be a folder of each machine's own, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpuscule-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Tables that one call writes to the shared folder, each dropped as soon as nothing reads it any more.

    What is left in the end belongs to the DataFrame that the call returns, which reads it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows and reads them back, so that no later job recomputes them, whatever executor is lost."""
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes these tables, where there are any."""
        context = self.spark.sparkContext
        for name in names:
            if name in self.paths:
                path = context._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """A single table in the shared folder, which stays."""
    return Scratch(df.sparkSession).cut(df, name)


def scan_parts(spark: SparkSession) -> int:
    """Partitions for an exchange, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tidy() -> None:
    """Gives freed memory back to the system; workers and the driver live on through many stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, tidied up after each."""
    for batch in batches:
        yield batch
        del batch
        tidy()


def strings(column: pa.Array) -> pa.Array:
    """Null texts count as empty."""
    if column.type != pa.string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a null-free string array, without copying."""
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; a longer text makes a range of its own."""
    if not len(column):
        return
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start, base = stop, int(ends[stop - 1])


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, SLICE_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(m, _BASE, np.uint64), dtype=np.uint64)
            down = np.cumprod(np.full(m, _BASE_INV, np.uint64), dtype=np.uint64)
        if m > 4 * SLICE_BYTES:  # for one very long text only; not kept
            return up, down
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ np.uint64(salt)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_WORD = np.zeros(256, np.uint8)
_WORD[ord("a") : ord("z") + 1] = 1
_WORD[ord("A") : ord("Z") + 1] = 1
_WORD[ord("0") : ord("9") + 1] = 1
_WORD[128:] = 1

#: Classes for token splitting: 0 space, 1 letters, 2 digits, 3 signs.
TOKEN_CLASS = np.full(256, 3, np.uint8)
TOKEN_CLASS[:33] = 0
TOKEN_CLASS[127] = 0
TOKEN_CLASS[_WORD == 1] = 1
TOKEN_CLASS[ord("0") : ord("9") + 1] = 2


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans, from one running sum over the slice."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=run[1:])
        h = (run[ends] - run[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _MULT)


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero class within each text: starts, ends, text numbers."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    kind = table[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers of the lower-cased words of a slice, in order.

    A word is a run of ASCII letters, ASCII digits and characters beyond ASCII.
    """
    data, offsets = buffer_of(pc.utf8_lower(column))
    starts, ends, doc = runs(data, offsets, _WORD)
    return span_hashes(data, starts, ends), doc


def word_hash(word: str) -> int:
    """The hash that ``words`` gives this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def words_of(text: str | None) -> list[str]:
    """The words of one text, as strings."""
    raw = pc.utf8_lower(pa.array([text or ""]))
    data, offsets = buffer_of(raw)
    starts, ends, _ = runs(data, offsets, _WORD)
    whole = data.tobytes()
    return [whole[s:e].decode("utf-8", "replace") for s, e in zip(starts, ends, strict=True)]


def renamed(df: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Only the needed columns, so that no extra column can clash with the operator's own names."""
    return df.select(*[df[k].cast(v).alias(k) for k, v in needed.items()])


class Vocabulary:
    """Word hashes by number, and a fast way to find them among many."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes.astype(np.uint64))
        self.sieve = np.zeros(1 << 17, bool)
        self.sieve[(self.hashes >> np.uint64(47)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that hold a known word, and those words' numbers."""
        if not len(self.hashes) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.sieve[(h >> np.uint64(47)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[number] == h[at]
        return at[same], number[same]
