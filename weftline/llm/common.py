"""Shared helpers: sources, shared-folder materialisation, Arrow batches, word hashing."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.tables import cut, discard, table  # noqa: F401

#: Words of the whitespace contracts are runs of anything but these bytes.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that a Python worker handles at once, and rows and bytes that it is handed at once.
BATCH_BYTES = 2 << 20
BATCH_ROWS = 1000

_TO_SPACE = bytes(0x20 if b in SPACES else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame; from now on its session hands Python at most BATCH_ROWS rows or about BATCH_BYTES at once.

    Rows hold whole texts or packed entries here, and the JVM - outside its heap - and the worker each have copies of a batch.
    """
    spark = df.sparkSession
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back, in small batches."""
    return cut(small_batches(df), label)


#: Bytes of a side that may be broadcast; beyond it the join shuffles. Files hold a third of what rows take in memory at least.
BROADCAST_BYTES, IN_MEMORY = 64 << 20, 3


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a materialised frame, or columns and rows of one, if its files are small; sizes are known without reading."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if IN_MEMORY * size <= BROADCAST_BYTES else df


def unshuffled_join(texts: DataFrame, side: DataFrame, on, how: str, by, of: str) -> DataFrame:
    """Semi or anti join of rows with whole texts to a materialised side, without moving the texts whatever the side's size.

    A side too large for one broadcast goes in parts, each met by the rows of its part in a reading of their own; `by`
    and `of` are non-null longs of both sides that are equal wherever `on` holds.
    """
    size = int(side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(1, -(-IN_MEMORY * size // BROADCAST_BYTES))
    if parts == 1:
        return texts.join(F.broadcast(side), on, how)
    out = None
    for p in range(parts):
        mine = lambda x: F.pmod(x, F.lit(parts)) == p  # noqa: B023, E731
        some = texts.where(mine(F.col(by) if isinstance(by, str) else by)).join(F.broadcast(side.where(mine(F.col(of)))), on, how)
        out = some if out is None else out.unionByName(some)
    return out


#: Rows of one key that one task of a join takes.
SHARE = 1 << 14


def salted_join(many: DataFrame, key: str, few: DataFrame, of: str, spread: str, counted: DataFrame) -> DataFrame:
    """Inner join many.key = few.of, where a key of `many` may hold any share of its rows.

    Keys of more than SHARE rows in `counted` (a materialised frame with that column) are dealt out by `spread`, and
    their rows of `few`, of which there should be few a key, are copied to each part.
    """
    heavy = materialise(counted.groupBy(F.col(key).alias("__key")).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("__parts")).where("__parts > 1"), "heavy")
    if heavy.isEmpty():
        discard(heavy)
        return many.join(few, F.col(key) == F.col(of))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = many.join(maybe_broadcast(heavy), F.col(key) == F.col("__key"), "left").withColumn("__part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("__key", "__parts")
    copied = few.join(maybe_broadcast(heavy), F.col(of) == F.col("__key"), "left").withColumn("__copy", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__key", "__parts")
    return dealt.join(copied, (F.col(key) == F.col(of)) & (F.col("__part") == F.col("__copy"))).drop("__part", "__copy")


def text_blocks(batches, column: str = "text", limit: int = BATCH_BYTES):
    """Arrow batches cut so that each holds about `limit` bytes of `column` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
        block = (np.cumsum(lengths) - lengths) // limit
        edges = np.flatnonzero(np.diff(block)) + 1
        at = 0
        for end in [*edges.tolist(), n]:
            yield batch.slice(at, end - at)
            at = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU C library
        pass


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


#: Masks that keep the first 0..8 bytes of a little-endian word.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) whitespace words of all texts, and words per text.

    A null text has no words. Hashes are of the words' bytes alone, so they agree between processes.
    """
    flat = b"\x20".join([b"", *((t or b"") for t in texts), b"\x20" * 8]).translate(_TO_SPACE)
    buf = np.frombuffer(flat, np.uint8)
    is_word = buf != 0x20
    edges = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    view = np.ndarray((len(flat) - 7,), "<u8", flat, 0, (1,))
    sizes = ends - starts
    with np.errstate(over="ignore"):
        out = mix((view[starts] & _MASKS[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * _MULT)
        more, at = np.flatnonzero(sizes > 8), 8
        while len(more):
            out[more] = mix(out[more] * _MULT + (view[starts[more] + at] & _MASKS[np.minimum(sizes[more] - at, 8)]))
            at += 8
            more = more[sizes[more] > at]
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, np.cumsum(lengths + 1), "right")]))
    return out, counts


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column's values."""
    return column.cast(pa.binary()).to_pylist()
