"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_own_dirs: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, the warehouse, or a temporary folder if all runs in one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        master = spark.sparkContext.master
        root = tempfile.mkdtemp() if master.startswith("local[") or master == "local" else spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def materialize(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet (in folders by the columns ``by``) to the shared folder and read it again: cuts lineage, survives lost executors.

    The files go when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/contigbin-{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _own_dirs.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove tables written by ``materialize`` that nothing reads any more."""
    for path in df.inputFiles():
        for entry in [x for x in _own_dirs if x[1].split("://")[-1] in path]:
            _remove(*entry)
            _own_dirs.remove(entry)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _own_dirs:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone by now
            return


#: A key table of at most so many bytes may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: What a row of a broadcast table takes besides its fields (measured: about 130 bytes for four longs).
ROW_BYTES = 100


def columns(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table of proven small size, brought to the driver as Arrow."""
    got = df.toArrow()
    return {name: got[name].to_numpy() for name in got.column_names}


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted size is within BROADCAST_BYTES. ``row_bytes``: of a row's fields."""
    return F.broadcast(df) if rows * (row_bytes + ROW_BYTES) <= BROADCAST_BYTES else df


#: Arrow batches that go to Python hold about so many bytes, whatever the length of their rows.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session sends Python batches of BATCH_BYTES at most (a longer row goes alone).

    The plan reads the setting when it runs, after this returns, so it is not set back.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of an Arrow string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Cut a record batch into pieces whose ``column`` holds about ``limit`` bytes; a longer row stands alone."""
    lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
    offsets = np.append(0, np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (in and out: uint64 arrays)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def byte_codes(seed: int) -> np.ndarray:
    """A random 64-bit code for each byte value."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]))


_BASE = 0x9E3779B97F4A7C15
_POW = powers(_BASE, 1 << 16)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_CODES = byte_codes(11)
_CODES[~_IS_WORD] = 0


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch of texts, and each text's first word (rows + 1)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        data = _LOWER[data]
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    breaks = offsets[1:-1]
    breaks = breaks[(breaks < len(data)) & (breaks > 0)]
    first[breaks] = inside[breaks]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = np.cumsum(first) - 1
    place = np.maximum(np.arange(len(data)) - starts[np.maximum(word, 0)], 0)
    place[~inside] = 0  # white space counts for nothing
    most = int(place.max())
    codes = _CODES[data] * (_POW if most < len(_POW) else powers(_BASE, most + 1))[place]
    sums = np.add.reduceat(codes, starts)
    return mix(sums), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; run i starts at word i (runs may cross texts: mask those)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, p in enumerate(powers(0xC2B2AE3D27D4EB4F, size + 1)[1:]):
        out += words[k : k + n] * p
    return mix(out)
