"""Benchmark decontamination by Wu-Manber multi-pattern search over normalised text.

Documents and benchmark items are lower-cased (A-Z) and cut into words; words are joined by one space, so a
window of words is a byte string framed by spaces. Block shift tables tell how far a search position may jump,
the hash of a pattern's last block selects a bucket, and a direct comparison confirms each occurrence. Many
positions of the text advance at once (lanes), each by its own shift.

Benchmark items are read in blocks of bounded size; each block is one pass over the documents that adds its
hits to a state column, written before the next one begins, so neither the driver nor an executor ever holds more than
one block's tables.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, materialise, small_batches, text_blocks

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text whose windows make one block of patterns.
BLOCK_BYTES = 2 << 20
LANE = 1024

_KEEP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_KEEP).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, int]]:
    """(framed window, number of words); items of fewer words are one window, empty ones none."""
    if not words:
        return []
    k = min(size, len(words))
    return [(b" " + b" ".join(words[i : i + k]) + b" ", k) for i in range(len(words) - k + 1)]


class WuManber:
    """Search tables for byte patterns of similar length; all occurrences of all patterns are found."""

    def __init__(self, patterns: list[bytes]):
        self.m = min(map(len, patterns))
        self.block = 8 if self.m >= 16 else 4 if self.m >= 6 else 2
        self.kind = {8: "<u8", 4: "<u4", 2: "<u2"}[self.block]
        self.bits = min(22, max(12, math.ceil(math.log2(len(patterns) * self.m)) + 2))
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.int32)
        heads = sorted({p[: self.m] for p in patterns})
        flat = np.frombuffer(b"".join(heads), np.uint8).reshape(len(heads), self.m)
        for end in range(self.block, self.m + 1):
            blocks = np.ascontiguousarray(flat[:, end - self.block : end]).view(self.kind).ravel()
            np.minimum.at(self.shift, self._hash(blocks), self.m - end)
        self.buckets = defaultdict(list)
        for k, p in enumerate(patterns):
            self.buckets[p[: self.m]].append((p, k))

    def _hash(self, blocks: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((blocks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: bytes) -> list[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        n, m, b = len(text), self.m, self.block
        if n < m:
            return []
        view = np.ndarray((n - b + 1,), self.kind, text, 0, (1,))
        at = np.arange(m - b, n - b + 1, LANE, dtype=np.int64)  # the block that ends each lane's window
        stop = np.minimum(at + LANE, n - b + 1)
        found = []
        while len(at):
            step = self.shift[self._hash(view[at])]
            if len(zero := at[step == 0]):
                found.append(zero)
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        hits, buckets = [], self.buckets
        for end in np.concatenate(found).tolist() if found else ():
            start = end + b - m
            for p, k in buckets.get(text[start : start + m], ()):
                if text.startswith(p, start):
                    hits.append((start, k))
        return hits


class PatternSet:
    """Patterns in classes by length (a power of two each), so that one short item doesn't shorten all shifts."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], size: int = WINDOW):
        owners: dict[tuple[bytes, int], set] = defaultdict(set)
        for item, text in items:
            for window in windows_of(words_of(text), size):
                owners[window].add(item)
        classes = defaultdict(list)
        for (p, k), who in sorted(owners.items(), key=lambda x: x[0]):
            classes[min(len(p).bit_length(), 6)].append((p, k, frozenset(x for x in who if x is not None)))
        self.classes = [([(k, who) for _, k, who in found], WuManber([p for p, _, _ in found])) for found in classes.values()]

    def search(self, text: bytes):
        """(start, words, items) of every occurrence."""
        for meta, machine in self.classes:
            for start, k in machine.search(text):
                yield start, *meta[k]


def _scan(handle, first: bool, last: bool):
    def run(batches):
        patterns: PatternSet = handle.value
        for batch in text_blocks(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            docs = [b" ".join(words_of(t)) for t in texts]
            flat = b"\n".join(b" " + d + b" " if d else b"" for d in docs)
            starts = np.cumsum([0, *(len(d) + 3 if d else 1 for d in docs)])[:-1]
            buf = np.frombuffer(flat, np.uint8)
            spaces = np.flatnonzero(buf == 0x20)
            # the ordinal of the space before a word names the word; a document of n words owns n + 1 of them
            base = np.searchsorted(spaces, starts)
            n_words = np.diff(np.append(base, len(spaces))) - 1
            n_words = np.maximum(n_words, 0)
            edge = np.zeros(len(spaces) + 1, np.int64)
            old = [] if first else batch.column("hit").to_pylist()
            items: list[set] = [set() for _ in docs] if first else [set(x) for x in batch.column("items").to_pylist()]
            for i, bits in enumerate(old):
                if bits:
                    was = np.unpackbits(np.frombuffer(bits, np.uint8))[: n_words[i]]
                    on = np.flatnonzero(was) + base[i]
                    np.add.at(edge, on, 1)
                    np.add.at(edge, on + 1, -1)
            hits = list(patterns.search(flat))
            if hits:
                at = np.fromiter((h[0] for h in hits), np.int64, len(hits))
                k = np.fromiter((h[1] for h in hits), np.int64, len(hits))
                word = np.searchsorted(spaces, at)
                np.add.at(edge, word, 1)
                np.add.at(edge, word + k, -1)
                for doc, (_, _, who) in zip((np.searchsorted(starts, at, "right") - 1).tolist(), hits, strict=True):
                    items[doc] |= who
            hit = np.cumsum(edge[:-1]) > 0
            ids = batch.column("doc_id")
            if not last:
                packed = [np.packbits(hit[b : b + n]).tobytes() for b, n in zip(base.tolist(), n_words.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, batch.column("text"), pa.array(packed, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["doc_id", "text", "hit", "items"])
                continue
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[base + n_words] - total[base]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]),
                    pa.array(n_hit > 0, pa.bool_()),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def _handles(benchmark: DataFrame, window: int, block_bytes: int):
    """(number, number of blocks, broadcast pattern set) of each block of benchmark items, one at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        yield k, blocks, benchmark.sparkSession.sparkContext.broadcast(PatternSet([(r[0], r[1].encode()) for r in part.toLocalIterator()], window))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or wordless text has no words and is never contaminated. Benchmark rows without words search for
    nothing; a row whose item_id is null marks words but is not counted among the items. Repeated rows on
    either side change nothing but the number of result rows. An empty benchmark leaves every document clean.
    Very long texts are searched whole, in memory for one of them. Further columns of both inputs are ignored.
    """
    docs, before = small_batches(documents.select("doc_id", "text")), []
    id_type = documents.schema["doc_id"].dataType.simpleString()
    for k, blocks, handle in _handles(benchmark, window, block_bytes):
        last = k == blocks - 1
        schema = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if last else f"doc_id {id_type}, text string, hit binary, items array<string>"
        docs = docs.mapInArrow(_scan(handle, k == 0, last), schema)
        if not last:
            docs = _next(docs, handle, before)
    return docs


def _next(docs: DataFrame, handle, before: list[DataFrame]) -> DataFrame:
    """The state after a block, written; its tables and the state before it go."""
    docs = materialise(docs, "decontaminate")
    handle.destroy()
    discard(*before)
    before[:] = [docs]
    return docs


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The document rows without any occurrence of a benchmark window, all columns as they are.

    A null or wordless text stays; repeated rows stay or go alike, in their number; an empty benchmark drops nothing.
    """

    def clean(handle):
        def run(batches):
            patterns: PatternSet = handle.value
            for batch in text_blocks(batches):
                docs = [b" " + b" ".join(words_of(t)) + b" " for t in batch.column("text").cast(pa.binary()).to_pylist()]
                starts = np.cumsum([0, *(len(d) + 1 for d in docs)])[:-1]
                hit = np.zeros(len(docs), bool)
                at = np.array([h[0] for h in patterns.search(b"\n".join(docs))], np.int64)
                hit[np.searchsorted(starts, at, "right") - 1] = True
                yield batch.filter(pa.array(~hit))

        return run

    documents, before = small_batches(documents), []
    for k, blocks, handle in _handles(benchmark, window, block_bytes):
        documents = documents.mapInArrow(clean(handle), documents.schema)
        if k < blocks - 1:
            documents = _next(documents, handle, before)
    return documents
