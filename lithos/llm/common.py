"""Helpers the operators of this subpackage share: staged tables, table access and small hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that go to a Python worker at once: whole texts are long, so that a batch stays at some megabytes.
BATCH_ROWS = 1000


_held: list = [None, None]


def hold(owner: str, free=None) -> None:
    """In a Python worker: tables of one operator at a time; those of the one before are dropped."""
    if _held[0] != owner:
        if _held[1] is not None:
            _held[1]()
        give_back()
    _held[:] = owner, free


def give_back() -> None:
    """In a Python worker: freed memory goes back to the system, as a worker that waits keeps what it has."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the folder ``sf_dir``, read by Spark (any file system it knows).

    Batches to Python workers are kept at ``BATCH_ROWS`` from then on in this session.
    """
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none (unit tests, one machine) a folder under the
    warehouse is set, once.
    """
    sc = spark.sparkContext
    if (found := sc.getCheckpointDir()) is None:
        root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
        sc.setCheckpointDir(root)
        found = sc.getCheckpointDir()
    return found


#: Folders of staged tables that this driver has written and not deleted.
_staged: list[str] = []


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    It cuts lineage, outlives a lost executor and keeps a costly result from
    being computed twice. The schema is given, so an empty table keeps it.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _staged.remove(path)


def drop_staged(*frames: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in frames:
        if (path := vars(df).get("staged_at")) in _staged:
            _delete(df.sparkSession, path)


@contextlib.contextmanager
def only_kept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables staged inside, but those put into the list: for steps whose result is staged as well."""
    before, kept = len(_staged), []
    try:
        yield kept
    finally:
        for path in _staged[before:]:
            if path not in {df.staged_at for df in kept}:
                _delete(spark, path)


def forget_shuffles(spark: SparkSession) -> None:
    """Shuffle files of ended jobs go once the driver's JVM has found that nothing refers to them."""
    spark._jvm.System.gc()


def sent_whole(df: DataFrame, most: int) -> DataFrame:
    """``df`` (cheap to count) marked for broadcast if it has at most ``most`` rows; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, rows) of runs of whole texts of about ``most`` bytes; a longer text is a run by itself."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    at = 0
    while at < n:
        upto = min(n, max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1))
        yield at, upto - at
        at = upto


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by their first ``keys`` columns (whole numbers), cut so that no group is parted, with each group's first row."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = b if held is None else pa.concat_batches([held, b])
        cols = [np.asarray(rows.column(k)) for k in range(keys)]
        first = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])))
        if first[-1]:
            yield rows.slice(0, int(first[-1])), first[:-1]
        held = rows.slice(int(first[-1]))
    if held is not None:
        yield held, np.zeros(1, np.int64)


def null_safe_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_fold(name: str, folds: int) -> Column:
    """crc32 of the id's decimal digits modulo ``folds``."""
    return (F.crc32(F.col(name).cast("string").cast("binary")) % folds).cast("int")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low and high bits are all usable."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def odd_powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while have < n:
            take = min(have, n - have)
            out[have : have + take] = out[:take] * step
            have, step = have + take, step * step
    return out
