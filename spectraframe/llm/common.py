"""What the operators of this subpackage share: a written intermediate table, and vectorised words.

Words are maximal runs of characters other than [\\x20\\x09-\\x0D]; all of those are ASCII, so a UTF-8
buffer is cut at the same places as its text.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Rows of an Arrow batch: bounds a worker's memory for texts of a few kB, and is small enough for long ones.
BATCH_ROWS = 1000
SEGMENT = 1 << 20  # bytes of text whose words are hashed at once
LONG_WORD = 32  # bytes from which on a word is hashed by itself

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: Our own folder of each application that names none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names; one of our own where none is set, if all runs on one machine."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        named = sc._jsc.sc().getCheckpointDir()
        if named.isEmpty() and not (sc.master.startswith("local") and "cluster" not in sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if named.isEmpty() and sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="spectraframe-")
        root = _own[sc.applicationId] if named.isEmpty() else named.get()
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The table, written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    for tables in _scopes:
        tables.append(path)
    return out


#: The paths that were written within each open `temporary`.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is written inside is deleted at the end, but for the tables that it has been told to keep."""
    made: list[str] = []
    kept: set[str | None] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(_paths.get(table))
        return table

    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.remove(made)
        discard(spark, *(path for path in made if path not in kept))


#: Where written tables are.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes written tables (or folders) that nothing reads any more."""
    for t in tables:
        if path := t if isinstance(t, str) else _paths.pop(t, None):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """For Python on the executors: the package there, and Arrow batches of so many rows at most, in this session, as plans read
    the setting when they run; a smaller one stays. Bytes of a batch have Spark's own bound (maxBytesPerBatch, 64 MB)."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


#: Rows of a few longs that a join may broadcast: some 50 MB.
MOST_BROADCAST = 1_000_000


def bounded(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A written table, to be broadcast if its rows have been counted and are few; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= most else df


#: A key is hot if it has more than a HOT_SHARE-th of the rows; there can be HOT_SHARE such keys at most.
HOT_SHARE = 1024


def join_sized(left: DataFrame, right: DataFrame, on: list[str], size: str, rows: int) -> DataFrame:
    """An inner join of left (of so many rows) with right, a written table with a row a key and the key's rows in left in column
    `size`. Hot keys' rows stay where they are and meet a broadcast of some HOT_SHARE rows; only the others are shuffled.
    Both sides are told apart by the hashes of hot keys, HOT_SHARE numbers at most."""
    key = F.xxhash64(*on)
    found = [r[0] for r in right.where(F.col(size) * HOT_SHARE > rows).select(key).distinct().collect()]
    if not found:
        return left.join(right, on)
    hot = key.isin(found)
    return left.where(hot).join(F.broadcast(right.where(hot)), on).unionByName(left.where(~hot).join(right.where(~hot), on))


def release(spark: SparkSession) -> None:
    """Lets the driver forget what is no longer used, so that the shuffle files of earlier steps go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[at[0] : at[-1]]
    return at - at[0], raw


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: spreads every bit of 64 over all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _P_INV)):
            x = np.full(n, p, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def _segments(at: np.ndarray, raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about SEGMENT bytes that end with a document or at a space."""
    lo, end = 0, int(at[-1])
    while lo < end:
        hi = min(lo + SEGMENT, end)
        if hi < end:
            k = int(np.searchsorted(at, hi, "right")) - 1
            if at[k] > lo:
                hi = int(at[k])
            else:
                stop = int(at[k + 1])
                while hi < stop and not (spaces := np.flatnonzero(_IS_SPACE[raw[hi : min(hi + SEGMENT, stop)]])).size:
                    hi = min(hi + SEGMENT, stop)
                hi = hi + int(spaces[0]) if hi < stop else stop
        yield lo, hi
        lo = hi


def word_hashes(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased, in order, and the number of words of each document. Short words share a polynomial
    over the segment's bytes, spread by `mix`; long ones have xxh3."""
    hashes, firsts = [], []
    for lo, hi in _segments(at, raw):
        data = _LOWER[raw[lo:hi]]
        word = ~_IS_SPACE[data]
        cut = np.zeros(hi - lo + 1, bool)
        inner = at[(at >= lo) & (at < hi)] - lo
        cut[inner] = True
        cut[0] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | cut[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | cut[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        power, inverse = _power(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: hi - lo], out=total[1:])
        h = (total[e + 1] - total[s]) * inverse[s]
        h = mix(h + (e - s + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for k in np.flatnonzero(e - s >= LONG_WORD):  # few; a polynomial over powers of two has collisions in long words, whatever its base
            h[k] = xxhash.xxh3_64_intdigest(data[s[k] : e[k] + 1].tobytes())
        hashes.append(h)
        firsts.append(s + lo)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    f = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return h, np.diff(np.searchsorted(f, at))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
