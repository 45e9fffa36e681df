"""What the corpus operators share: the shared folder, row keys and vectorised word hashing.

The numpy half works on whole Arrow buffers: words are found and hashed for a slice of
documents at once, so no Python loop runs per word.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word and text rule here: space and 0x09 to 0x0D.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
SLICE_BYTES = 1 << 18
_GOLD = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a folder under the warehouse serves, if all executors see that: in local
    mode, or in a store. A cluster with a machine's own warehouse folder is refused.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not local and warehouse.split(":")[0] in ("file", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/_shared"


class Shelf:
    """Parquet tables in the shared folder that cut lineage.

    ``put`` writes a frame and reads it back, ``drop`` deletes tables no later plan reads.
    Tables that the returned frame still reads go when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def put(self, df: DataFrame, name: str = "t", collect_garbage: bool = True, group_rows: int | None = None) -> DataFrame:
        """``group_rows``: most rows of a row group. Parquet looks at a group's size only after 100 rows, and
        a reader takes up to 4,096 rows of a group at once, so tables of large rows need such a bound."""
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        # small row groups: a task holds one in memory while it writes
        write = df.write.option("parquet.block.size", 32 << 20)
        if group_rows:
            write = write.option("parquet.block.row.count.limit", group_rows)
        write.parquet(path)
        if collect_garbage:
            # shuffle files of the finished job go once their plan is unreachable
            self.spark._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelf_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._shelf_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session has ended
            pass


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows and 2 MB, so that a batch of long texts or index segments
    fits a Python worker, and the JVM's buffers, which are copied as they grow, stay small outside its
    heap. The session keeps the lower setting: plans read it when they run."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    # asked without a default: with one, Spark gives that and not its own for a setting that is not set
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


#: What stages keep in a worker between their tasks: a name and a key, with the table.
_kept: dict[tuple[str, str], object] = {}


def kept(name: str, key: str, make):
    """The worker's table of ``key``, made by ``make`` on first use. One table stays between tasks, and it
    goes when a task of a stage without tables begins (``tidy``)."""
    if (name, key) not in _kept:
        _kept.clear()
        _kept[name, key] = make()
    return _kept[name, key]


def give_back() -> None:
    """Free memory of this worker goes back to the system: Arrow's, and the C library's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def forget() -> None:
    if _kept:
        _kept.clear()
        give_back()


def tidy(run, tables: bool = False):
    """An Arrow stage that gives its memory back to the system when a task ends: workers live on, and
    the allocator would keep what the last stage's tables took while other stages run. Tables that
    another stage kept in the worker go first, unless this one has ``tables`` of its own."""

    def inner(batches):
        if not tables:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def fold_of(doc_id: str | Column, k: int = 5) -> Column:
    """crc32 of the document id as text, modulo ``k``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % F.lit(k)


def carry(docs: DataFrame, id_columns: tuple[str, ...]) -> tuple[tuple[str, ...], str, int, int, list[Column]]:
    """How an Arrow stage takes ``id_columns`` along: the names, their DDL, their number, the
    place of the text among the columns to select, and these. A text that is carried is not sent twice."""
    names = tuple(id_columns)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    columns = [F.col(f"`{c}`") for c in names]
    if "text" in names:
        return names, ddl, len(names), names.index("text"), columns
    return names, ddl, len(names), len(names), [*columns, F.col("text").alias("__text")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- numpy: hashing
def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser, in place on a fresh array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _odd(seed: int) -> int:
    return int(mix64(np.array([seed], np.uint64))[0]) | 1


class Poly:
    """Polynomial hashing modulo 2**64 of short runs of mixed word hashes, from prefix sums.

    Not for bytes: two long sequences of two symbols can share such a hash for every base.
    """

    def __init__(self, seed: int):
        self.base = _odd(seed)
        self.back = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.back)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
#: masks of the first 0 to 8 bytes of a little-endian number
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 256


def hash_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hashes of the words buf[start:end].

    Eight bytes at a time go through a bijective mixer, so words of up to eight bytes and of one
    length never share a hash; words over 256 bytes are hashed by BLAKE2b, one by one.
    """
    size = end - start
    h = mix64(size.astype(np.uint64) * np.uint64(_GOLD) + np.uint64(_SEEDS[second]))
    if not len(size):
        return h
    eight = np.lib.stride_tricks.as_strided(np.concatenate((buf, np.zeros(8, np.uint8))), (len(buf) + 1, 8), (1, 1))
    todo = np.flatnonzero((size > 0) & (size <= _LONG))
    at = 0
    while len(todo):
        chunk = eight[start[todo] + at].view("<u8").ravel().astype(np.uint64, copy=False)
        left = size[todo] - at
        h[todo] = mix64((h[todo] ^ (chunk & _FIRST[np.minimum(left, 8)])) * np.uint64(_GOLD | 1) + np.uint64(at))
        at += 8
        todo = todo[left > 8]
    for k in np.flatnonzero(size > _LONG).tolist():
        told = blake2b(buf[start[k] : end[k]].tobytes(), digest_size=8, key=b"2" if second else b"1")
        h[k] = int.from_bytes(told.digest(), "little")
    return h


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True


class Slice:
    """Some documents' texts as one byte array; words as (start, end) and per-document offsets."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, first: int, lower: bool, gaps: np.ndarray):
        self.buf = LOWER[buf] if lower else buf
        self.offsets = offsets
        self.first = first
        gap = gaps[self.buf]
        n = len(self.buf)
        begin = np.empty(n, bool)
        stop = np.empty(n, bool)
        if n:
            begin[0] = True
            begin[1:] = gap[:-1]
            stop[-1] = True
            stop[:-1] = gap[1:]
            edges = offsets[(offsets > 0) & (offsets < n)]
            begin[edges] = True
            stop[edges - 1] = True
            begin &= ~gap
            stop &= ~gap
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        #: word i of document d is at word_at[d] + i
        self.word_at = np.searchsorted(self.start, offsets)

    def hashes(self, second: bool = False) -> np.ndarray:
        return hash_words(self.buf, self.start, self.end, second)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without copying; nulls are empty."""
    import pyarrow as pa

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def slices(column, lower: bool = False, limit: int = SLICE_BYTES, gaps: np.ndarray | None = None) -> Iterator[Slice]:
    """Whole documents in slices of about ``limit`` bytes; a longer document is a slice of its own."""
    buf, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Slice(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, lower, _IS_SPACE if gaps is None else gaps)
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
