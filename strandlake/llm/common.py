"""Shared pieces: table loading, written intermediate tables, byte-level word kernels over Arrow text."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than space and tab..carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (driver and executors are
    one process, as in tests) gets a new temporary folder; any other master raises, since its executors would write to their own disks."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is unset: with master {master} it must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_WRITTEN: list[str] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, level: int = 3) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and lost executors cost no recomputation.
    level: of zstd, for tables that are mostly large binary values."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # once the table is there, nothing reads the shuffle files of its query again
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that written() made in this process, from the `since`-th on; for callers that are done with all results."""
    gone = _WRITTEN[since:]
    del _WRITTEN[since:]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    return len(gone)


def unused(columns: list[str], name: str) -> str:
    """A column name that none of `columns` has, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, key: str = "row") -> DataFrame:
    """A written table of (key, doc): a number for each row, and the row as a struct, so no column of it can clash with others.

    Numbers are fixed once they are written, so rows that are equal in every column can be told apart by any later job.
    """
    return written(docs.select(F.monotonically_increasing_id().alias(key), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))


def lean(run: Callable) -> Callable:
    """An Arrow function whose worker, kept for later tasks, gives back what it allocated when a partition ends."""

    @functools.wraps(run)
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return kept


def n_words(col) -> F.Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The first `limit` rows by a hash of the key, written. Far larger tables are thinned by that hash first, so the task that
    sorts the rest holds about one and a half times the limit."""
    n = df.count()
    order = F.xxhash64(key)
    if n > 2 * limit:
        df = df.where(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * 1.5 * limit / n))
    return written(df.withColumn("order", F.pmod(order, F.lit(1 << 30))).orderBy("order", key).limit(limit))


# ---- Arrow text as bytes -------------------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its offsets (one more than rows); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row that is longer: bounds working memory whatever the batch."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(raw: np.ndarray, offsets: np.ndarray, blanks: np.ndarray = _BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and the first word of each row (one more than rows)."""
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~blanks[raw]
    first = np.empty(len(raw), dtype=bool)
    first[0], first[1:] = True, ~solid[:-1]
    heads = offsets[:-1]
    heads = heads[heads < len(raw)]
    first[heads] = True
    starts = np.flatnonzero(solid & first)
    last = np.empty(len(raw), dtype=bool)
    last[-1], last[:-1] = True, ~solid[1:]
    last[heads[heads > 0] - 1] = True
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _random_u64(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, at least n of each."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        for k in [k for k in _POWERS if k < size]:
            del _POWERS[k]
        up, down = np.full(size, BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return next(_POWERS[k] for k in sorted(_POWERS) if k >= size)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (xor-shift, multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def byte_codes(seed: int, lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with `lower`, A-Z take those of a-z."""
    codes = _random_u64(seed, 256)
    if lower:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by prefix sums of code * BASE^position, moved back to position 0."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
