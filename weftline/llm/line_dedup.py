"""Near-duplicate lines across a corpus: an exact set-similarity join over line tokens.

A line's tokens are its distinct lower-cased words, ordered by rarity: first those outside a bounded table of the
corpus' most frequent tokens (by hash), then the frequent ones, rarest first. Any order that all tasks share gives
right results; a better one only makes prefixes rarer. Two lines match when their Jaccard similarity is at least
NUM / DEN, and then share a token within both prefixes. Lines meet in the region of that token; in a region of a token
that the table calls hot they would be too many, so the key goes on to the next common token, which lies in the prefix
longer by one, and so on (the adaptive prefix). In a region the length, positional and bitmap filters leave few pairs.
Of each line the earliest FIRST partners of a region become candidates, which are verified by their tokens; a line
with more of them that none of the first matches is compared with all the lines of its regions in a second round, so
nothing is lost, and groups of thousands of near copies cost rows in proportion to their size.

A line is removed when an earlier line - by (doc_id, hash of the text, line number) - matches it, itself removed or
not. Of equal lines the first stays unless an earlier different line matches it. Sets of tokens are told by 128 bits
of fingerprint, tokens by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import as_bytes, discard, give_back, materialise, maybe_broadcast, mix, salted_join, small_batches, text_blocks, word_hashes

#: A match needs DEN * intersection >= NUM * union; lines of fewer words than LEAST_WORDS take no part unless the caller raises the bound.
NUM, DEN, LEAST_WORDS = 80, 100, 1
#: Entries of the frequency table (16 bytes each), and of each task's contribution to it.
TABLE, TASK_TABLE = 1 << 17, 1 << 16
#: Lines that a key is expected to bring together from which it takes in another token; the most tokens of a key; tokens of a line that has such keys.
HOT, DEPTH, EXTENDED = 1 << 12, 4, 20
#: Entries a bucket is planned for, and those that a task holds of one at once.
BUCKET, HELD = 1 << 18, 1 << 20
#: Candidates of a line in a region's first round, and partners that it is held against there.
FIRST, STEPS = 32, 1 << 13
#: Bytes of text whose lines a task sorts at once; their arrays take some thirty times that.
BLOCK = 1 << 20


class Ranks:
    """Ranks of the frequent tokens by count, in an open-addressed table of eight times their number."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.order = np.lexsort((words, counts))
        self.counts = counts[self.order]
        self.bits = max(4, (8 * len(words) - 1).bit_length()) if len(words) else 4
        self.slot_word, self.slot_rank = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
        self.probes = 1
        left, rank, at = words[self.order], np.arange(len(words)), None
        at = (left >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.slot_rank[at] < 0
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= free
            self.slot_word[at[take]], self.slot_rank[at[take]] = left[take], rank[take]
            left, rank, at = left[~take], rank[~take], (at[~take] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(left))

    def keys(self, words: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The keys, with those of frequent tokens replaced: above all others, by rank, then hash."""
        key = key.copy()
        todo = np.arange(len(words))
        at = (words >> np.uint64(64 - self.bits)).astype(np.int64)
        for _ in range(self.probes):
            rank = self.slot_rank[at]
            hit = (rank >= 0) & (self.slot_word[at] == words[todo])
            found = todo[hit]
            key[found] = np.uint64(1 << 63) | (rank[hit].astype(np.uint64) << np.uint64(45)) | (words[found] >> np.uint64(19))
            going = ~hit & (rank >= 0)
            todo, at = todo[going], (at[going] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return key

    def count(self, key: np.ndarray) -> np.ndarray:
        """Occurrences of tokens by their keys; 0 for those outside the table."""
        out = np.zeros(len(key))
        some = key >> np.uint64(63) != 0
        out[some] = self.counts[((key[some] >> np.uint64(45)) & np.uint64(0x3FFFF)).astype(np.int64)]
        return out


class Lines:
    """The lines of a block of texts that take part, with their ordered distinct tokens."""

    def __init__(self, texts: list[bytes | None], least: int, table: Ranks | None = None, wanted: list[list[int]] | None = None):
        lines, owner, number = [], [], []
        for i, t in enumerate(texts):
            if t:
                parts = t.split(b"\n")
                some = range(len(parts)) if wanted is None else wanted[i]
                lines += parts if wanted is None else [parts[k] for k in some]
                owner += [i] * len(some)
                number += some
        words, counts = word_hashes(lines)
        line = np.repeat(np.arange(len(lines)), counts)
        some = (counts >= least)[line]
        words, line = words[some], line[some]
        key = words >> np.uint64(1)  # tokens outside the table come first, by hash
        if table is not None:
            key = table.keys(words, key)
        # one sort by line and leading bits of the key; only if those bits tie unequal words, a full one
        bits = np.uint64(max(1, len(lines).bit_length()))
        joint = (line.astype(np.uint64) << (np.uint64(64) - bits)) | (key >> bits)
        order = np.argsort(joint)
        joint = joint[order]
        if np.any((joint[1:] == joint[:-1]) & (words[order[1:]] != words[order[:-1]])):
            order = np.lexsort((words, key, line))
        words, line, key = words[order], line[order], key[order]
        first = np.ones(len(words), bool)
        first[1:] = (line[1:] != line[:-1]) | (words[1:] != words[:-1])
        self.words, line, self.key = words[first], line[first], key[first]
        self.ids, self.at, self.sizes = np.unique(line, return_index=True, return_counts=True)
        self.owner, self.number = np.array(owner, np.int64)[self.ids] if len(self.ids) else np.zeros(0, np.int64), np.array(number, np.int64)[self.ids] if len(self.ids) else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(self.ids)), self.sizes)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.ids):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            seed = self.sizes.astype(np.uint64)
            return tuple(mix(np.add.reduceat(mix(self.words, k), self.at) + seed, k + 2) for k in (21, 22))

    def bitmaps(self) -> tuple[np.ndarray, np.ndarray]:
        """Parity of the tokens of each of 128 hash classes; lines of at most 48 tokens have 64 classes, in the first word."""
        if not len(self.ids):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        place = mix(self.words, 25) >> np.uint64(57)
        bit = np.uint64(1) << (place & np.uint64(63))
        second = (place >> np.uint64(6) != 0) & (self.sizes > 48)[self.row]
        return np.bitwise_xor.reduceat(np.where(second, np.uint64(0), bit), self.at), np.bitwise_xor.reduceat(np.where(second, bit, np.uint64(0)), self.at)

    def keys(self, ranks: Ranks | None, lines: int, num: int, den: int, hot: int, depth: int = DEPTH, extended: int = EXTENDED):
        """(line, key, reach) of the lines' keys: tokens of the prefix, hot ones with the tokens that may follow them as common ones.

        The reach bounds the tokens that two lines have in common if the key holds the first ones of them.
        """
        prefix = self.sizes - -(-num * self.sizes // den) + 1
        place = np.arange(len(self.words)) - self.at[self.row]
        lone = self.sizes * den < num * (self.sizes + 1)  # too few tokens to match any but an equal set, which the print finds
        at = np.flatnonzero((place < prefix[self.row]) & ~lone[self.row])
        counts = ranks.count(self.key) if ranks is not None else np.zeros(len(self.words))
        line, key, expected = self.row[at], mix(self.words[at], 30), counts[at]
        out = []
        for k in range(1, depth + 1):
            size = self.sizes[line]
            reach = size - place[at] - 1 + k
            more = (expected > hot) & (size >= extended) if k < depth else np.zeros(len(at), bool)
            # lines of a size that may match one too short for longer keys have the short key as well
            stay = ~more | (num * size <= den * extended)
            out.append((line[stay], key[stay], reach[stay]))
            if not more.any():
                break
            line, key, expected, at = line[more], key[more], expected[more], at[more]
            follow = np.minimum(prefix[line] + k, self.sizes[line]) - place[at] - 1
            of = np.repeat(np.arange(len(at)), follow)
            at = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(follow) - follow, follow) + 1
            with np.errstate(over="ignore"):
                line, key, expected = line[of], mix(key[of] * np.uint64(0x9E3779B97F4A7C15) + self.words[at], 30), expected[of] * counts[at] / max(lines, 1)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def frequent_tokens(docs: DataFrame, size: int = TABLE) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(sorted tokens, their counts) of the corpus' most frequent tokens - the table's size is its bound -, words and lines of the corpus."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = n_words = n_lines = 0

        def merged(keep: int):
            words = np.concatenate([w for w, _ in held])
            counts = np.concatenate([c for _, c in held])
            distinct, back = np.unique(words, return_inverse=True)
            sums = np.bincount(back, weights=counts).astype(np.int64)
            best = np.argsort(-sums, kind="stable")[:keep]
            return distinct[best], sums[best]

        for batch in text_blocks(batches, limit=BLOCK):
            texts = as_bytes(batch.column("text"))
            words, _ = word_hashes(texts)
            n_words += len(words)
            n_lines += sum(t.count(b"\n") + 1 for t in texts if t)
            held.append(np.unique(words, return_counts=True))
            total += len(held[-1][0])
            if total > 1 << 19:
                held = [merged(1 << 18)]
                total = len(held[0][0])
        if held:
            words, counts = merged(TASK_TABLE)
            some = counts > 1
            words, counts = words[some], counts[some]
            yield pa.RecordBatch.from_arrays([_signed(words), pa.array(counts), pa.array(np.zeros(len(words), np.int64))], ["token", "n", "lines"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([n_words]), pa.array([n_lines])], ["token", "n", "lines"])

    # the row without a token holds the sums, so it comes first
    found = docs.select("text").mapInArrow(run, "token long, n long, lines long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("lines").alias("lines"))
    found = found.orderBy(F.col("token").isNotNull(), F.desc("n"), "token").limit(size + 1).toArrow()
    if not found.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
    counts = found["n"].to_numpy()
    words = found["token"].slice(1).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], counts[1:][order], int(counts[0]), int(found["lines"][0].as_py())


#: Columns of the entries of a bucket, one after the other: key within the bucket, size, reach, set, place of the document, bitmap.
ENTRY = (("key", "<u4"), ("n", "<u4"), ("reach", "<u4"), ("one", "<u8"), ("when", "<i8"), ("left", "<u8"), ("right", "<u8"))
Entries = dict[str, np.ndarray]


def _pack(e: Entries) -> bytes:
    return b"".join(np.ascontiguousarray(e[c], t).tobytes() for c, t in ENTRY)


def _unpack(blob: bytes) -> Entries:
    n, out, at = len(blob) // sum(np.dtype(t).itemsize for _, t in ENTRY), {}, 0
    for c, t in ENTRY:
        out[c] = np.frombuffer(blob, t, n, at)
        at += out[c].nbytes
    return out


def _joined(parts: list[Entries]) -> Entries:
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, t) for c, t in ENTRY}


def _at(e: Entries, some: np.ndarray) -> Entries:
    return {c: x[some] for c, x in e.items()}


def _bucket_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


class Join:
    """The parameters of a join, and its two sides: entries by buckets, and pairs from a bucket's entries."""

    def __init__(self, least: int, num: int, den: int, hot: int, held: int, first: int, steps: int, bits: int, lines: int):
        self.least, self.num, self.den, self.hot, self.held, self.first, self.steps, self.bits, self.lines = least, num, den, hot, held, first, steps, bits, lines

    def entries(self, table: tuple[np.ndarray, np.ndarray], batches) -> Iterator[pa.RecordBatch]:
        """Packed entries of each bucket, and a row for each line. `when` of a document orders documents, roughly is enough."""
        ranks = Ranks(*table)
        for batch in text_blocks(batches, limit=BLOCK):
            found = Lines(as_bytes(batch.column("text")), self.least, ranks)
            if not len(found.ids):
                continue
            kind = batch.schema.field("doc_id").type
            one, two = found.prints()
            owner = pa.array(found.owner)
            n = len(one)
            th = np.asarray(batch.column("th").take(owner)).view(np.uint64)
            spread = (mix(one ^ mix(th, 31)) >> np.uint64(33)).astype(np.int32)  # a frequent line's rows go everywhere
            lines = [pa.array(spread), pa.nulls(n, pa.binary()), batch.column("doc_id").take(owner), batch.column("th").take(owner), pa.array(found.number.astype(np.int32)), _signed(one), _signed(two)]
            yield pa.RecordBatch.from_arrays(lines, ["bucket", "entries", "doc_id", "th", "line", "one", "two"])
            when = np.asarray(batch.column("when"))[found.owner]
            order = np.lexsort((when, one))
            once = np.zeros(n, bool)
            once[order[np.unique(one[order], return_index=True)[1]]] = True
            line, key, reach = found.keys(ranks, self.lines, self.num, self.den, self.hot)
            some = once[line]
            line, key, reach = line[some], key[some], reach[some]
            bucket = _bucket_of(key, self.bits)
            order = np.argsort((bucket << 32) | np.minimum(found.sizes[line], (1 << 32) - 1))
            line, bucket = line[order], bucket[order]
            left, right = found.bitmaps()
            e = {"key": key[order].astype(np.uint32), "n": found.sizes[line], "reach": reach[order], "one": one[line], "when": when[line], "left": left[line], "right": right[line]}
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist() if len(bucket) else [0]
            blobs = [_pack({c: x[a:b] for c, x in e.items()}) for a, b in zip(edges, edges[1:], strict=False)]
            m = len(blobs)
            rows = [pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, ["bucket", "entries", "doc_id", "th", "line", "one", "two"])

    def pairs(self, e: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(earlier, later, unsettled) rows of entries sorted by key and place: the first partners that pass the filters, and rows that may have more."""
        n = len(e["key"])
        head = np.ones(n, bool)
        head[1:] = e["key"][1:] != e["key"][:-1]
        start = np.flatnonzero(head)[np.cumsum(head) - 1] if n else np.zeros(0, np.int64)
        back = np.arange(n) - start
        size, reach = e["n"].astype(np.int64), e["reach"].astype(np.int64)
        whole = e["left"] ^ e["right"]
        partners = np.zeros(n, np.int64)
        a_out, b_out, unsettled = [], [], []
        active = np.flatnonzero(back > 0)
        for step in range(self.steps):
            if not len(active):
                break
            x, y = start[active] + step, active
            need = -(-self.num * (size[x] + size[y]) // (self.num + self.den))
            fine = np.minimum(reach[x], reach[y]) >= need
            x, y, slack = x[fine], y[fine], (size[x] + size[y] - 2 * need)[fine]
            # parities bound the difference from below; the halves of long lines are folded against a short one
            fine = np.bitwise_count(whole[x] ^ whole[y]) <= slack
            x, y, slack = x[fine], y[fine], slack[fine]
            both = np.minimum(size[x], size[y]) > 48
            fine = ~both | (np.bitwise_count(e["left"][x] ^ e["left"][y]).astype(np.int64) + np.bitwise_count(e["right"][x] ^ e["right"][y]) <= slack)
            x, y = x[fine], y[fine]
            a_out.append(x)
            b_out.append(y)
            partners[y] += 1
            active = active[back[active] > step + 1]
            if len(y):
                full = partners[active] >= self.first
                unsettled.append(active[full])
                active = active[~full]
        unsettled.append(active)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_out, b_out, unsettled))

    def regions(self, batches) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket: candidates (a, b), regions with unsettled sets (a, key, th: 1 if unsettled), and the lines as they came."""
        bucket, parts, count, split = None, [], 0, np.zeros(0, np.uint32)
        kind = pa.int64()

        def out(a, b=None, key=None, unsettled=None):
            n = len(a)
            columns = [_signed(a), *(pa.nulls(n, pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (b, key)), pa.nulls(n, kind), pa.nulls(n, pa.int64()) if unsettled is None else pa.array(unsettled), pa.nulls(n, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "key", "doc_id", "th", "line"])

        def distinct(e: Entries) -> Entries:
            order = np.lexsort((e["when"], e["one"], e["key"]))
            e = _at(e, order)
            new = np.ones(len(order), bool)
            new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["one"][1:] != e["one"][:-1])
            return _at(e, new)

        def join(e: Entries, last: bool):
            """Candidates of what is held; what to hold on to, and the regions that are cut, if the bucket goes on."""
            nonlocal split
            e = _at(e, np.lexsort((e["one"], e["when"], e["key"])))
            x, y, open_ = self.pairs(e)
            if len(open_):  # documents that `when` doesn't tell apart may come in either order, so they are open as well
                tie = np.flatnonzero((e["key"][1:] == e["key"][:-1]) & (e["when"][1:] == e["when"][:-1]))
                tie = np.union1d(tie, tie + 1)
                open_ = np.union1d(open_, tie[np.isin(e["key"][tie], e["key"][open_])])
            keep = None
            if not last:
                head = np.ones(len(e["key"]), bool)
                head[1:] = e["key"][1:] != e["key"][:-1]
                rank = np.arange(len(head)) - np.flatnonzero(head)[np.cumsum(head) - 1]
                split = np.union1d(split, e["key"][rank >= self.first])
                keep = _at(e, rank < self.first)
            if len(split):
                open_ = np.union1d(open_, np.flatnonzero(np.isin(e["key"], split)))
            found = [out(e["one"][x], e["one"][y])] if len(x) else []
            if len(open_):
                region = np.flatnonzero(np.isin(e["key"], e["key"][open_]))
                found.append(out(e["one"][region], key=(np.int64(bucket) << 32) | e["key"][region].astype(np.int64), unsettled=np.isin(region, open_).astype(np.int64)))
            return found, keep

        def finish():
            nonlocal parts, count, split
            if parts:
                found, _ = join(distinct(_joined(parts)), True)
                yield from found
            parts, count, split = [], 0, np.zeros(0, np.uint32)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            line = np.asarray(batch.column("line").is_valid())
            if line.any():
                own = batch.filter(pa.array(line))
                n = own.num_rows
                yield pa.RecordBatch.from_arrays([own.column("one"), own.column("two"), pa.nulls(n, pa.int64()), own.column("doc_id"), own.column("th"), own.column("line")], ["a", "b", "key", "doc_id", "th", "line"])
            for at in np.flatnonzero(~line).tolist():
                if (now := batch.column("bucket")[at].as_py()) != bucket:
                    yield from finish()
                    bucket = now
                parts.append(_unpack(batch.column("entries")[at].as_py()))
                count += len(parts[-1]["key"])
                if count > self.held:
                    e = distinct(_joined(parts))
                    if len(e["key"]) > self.held // 2:
                        found, e = join(e, False)
                        yield from found
                    parts, count = [e], 0  # what is held on to is counted no more, or a bucket of many regions would never go on
        yield from finish()
        give_back()


def _later(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """(one, two) of the later set of each pair (a, b) that the tokens confirm."""
    side = lambda k: points.select(*(F.col(c).alias(c + k) for c in ("one", "two", "place", "tokens")))
    met = salted_join(salted_join(pairs, "a", side("_a"), "one_a", "b", pairs), "b", side("_b"), "one_b", "a", pairs)
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    met = met.where(F.lit(den) * both >= F.lit(num) * (F.size("tokens_a") + F.size("tokens_b") - both))
    after = F.col("place_a") > F.col("place_b")
    return met.select(F.when(after, F.col("one_a")).otherwise(F.col("one_b")).alias("one"), F.when(after, F.col("two_a")).otherwise(F.col("two_b")).alias("two")).distinct()


def _order(documents: DataFrame) -> Column:
    """A number that grows with the doc_id where it is a whole number; elsewhere all are 0, which only costs a second round."""
    whole = documents.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)) if whole else F.lit(0).cast("long")


def dedup_lines(documents: DataFrame, num: int = NUM, den: int = DEN, least: int = LEAST_WORDS, hot: int = HOT, bucket: int = BUCKET, held: int = HELD, first: int = FIRST, steps: int = STEPS) -> DataFrame:
    """Per document row, all its columns with text less its removed lines, then n_lines, n_removed, removed (line numbers from 0).

    A null text stays null and has no lines; an empty one has one empty line, and lines of fewer than `least` words
    always stay, those without a word in any case. Very long texts and lines take part whole. Rows alike in doc_id and
    text are one document and get the same result. Of documents with one doc_id the text's hash decides which is
    earlier; a null doc_id comes after all others. Columns of the input named n_lines, n_removed or removed are
    replaced, any others kept. An empty table gives an empty result.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = small_batches(documents).select("doc_id", "text", F.xxhash64("text").alias("th"), _order(documents).alias("when")).where("text is not null")
    words, counts, n_words, n_lines = frequent_tokens(docs)
    # a prefix is some quarter of a line
    bits = max(0, (n_words // 4 // bucket).bit_length())
    handle = documents.sparkSession.sparkContext.broadcast((words, counts))
    join = Join(least, num, den, hot, held, first, steps, bits, n_lines)

    def to_entries(batches):
        yield from join.entries(handle.value, batches)

    # one pass over the texts and one exchange: buckets are joined on the other side, lines pass through
    entries = docs.mapInArrow(to_entries, f"bucket int, entries binary, doc_id {kind}, th long, line int, one long, two long")
    near = entries.repartition("bucket").sortWithinPartitions("bucket")
    found = materialise(near.mapInArrow(join.regions, f"a long, b long, key long, doc_id {kind}, th long, line int"), "line-regions")
    lines = found.where("line is not null").select("doc_id", "th", "line", F.col("a").alias("one"), F.col("b").alias("two"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "line")
    sets = materialise(lines.groupBy("one", "two").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "line-sets")
    pairs = materialise(found.where("line is null and b is not null").select("a", "b").distinct(), "line-pairs")
    regions = found.where("line is null and key is not null").select(F.col("a").alias("x"), "key", F.col("th").alias("unsettled"))

    def points_of(ones: DataFrame) -> DataFrame:
        """(one, two, place, tokens) of the sets, from their first occurrences."""
        company = materialise(sets.join(maybe_broadcast(ones), "one", "left_semi").select("one", "two", "first"), "line-company")
        picked = materialise(company.groupBy(F.col("first.doc_id").alias("d"), F.col("first.th").alias("t")).agg(F.collect_set("first.line").alias("wanted")), "line-picked")

        def to_tokens(batches):
            for batch in text_blocks(batches, limit=BLOCK):
                found = Lines(as_bytes(batch.column("text")), least, wanted=batch.column("wanted").to_pylist())
                one, two = found.prints()
                edges = pa.array(np.append(found.at, len(found.words)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([_signed(one), _signed(two), pa.ListArray.from_arrays(edges, _signed(found.words))], ["one", "two", "tokens"])

        chosen = docs.join(maybe_broadcast(picked), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("text", "wanted")
        tokens = chosen.mapInArrow(to_tokens, "one long, two long, tokens array<bigint>").dropDuplicates(["one", "two"])
        points = materialise(tokens.join(company, ["one", "two"]).select("one", "two", F.col("first").alias("place"), "tokens"), "line-points")
        discard(company, picked)
        return points

    ends = materialise(pairs.select(F.explode(F.array("a", "b")).alias("one")).distinct(), "line-ends")
    points = points_of(ends)
    matched = materialise(_later(pairs, points, num, den), "line-matched")
    discard(ends, points, pairs)
    # second round: sets that may have partners beyond the first ones, and matched none of those, against all sets of their regions
    unsettled = regions.where("unsettled = 1").select(F.col("x").alias("y"), "key").distinct()
    rest = materialise(unsettled.join(maybe_broadcast(matched.select(F.col("one").alias("y"))), "y", "left_anti"), "line-rest")
    if not rest.isEmpty():
        known = regions.join(maybe_broadcast(rest.select("key").distinct()), "key", "left_semi").select("key", "x").distinct()
        known = materialise(known, "line-known")
        more = salted_join(known, "key", rest.withColumnRenamed("key", "of"), "of", "x", known).where("x <> y")
        more = materialise(more.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "line-more")
        points = points_of(materialise(more.select(F.explode(F.array("a", "b")).alias("one")).distinct(), "line-ends"))
        matched = materialise(matched.union(_later(more, points, num, den)).distinct(), "line-matched")
        discard(known, points, more)

    matched = matched.withColumn("matched", F.lit(True))
    busy = materialise(sets.join(maybe_broadcast(matched), ["one", "two"], "left").where("n > 1 or matched").select("one", "two", "first", F.coalesce("matched", F.lit(False)).alias("matched")), "line-busy")
    removed = lines.join(maybe_broadcast(busy), ["one", "two"]).where(F.col("matched") | ~F.col("first").eqNullSafe(place))
    removed = materialise(removed.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line")).alias("removed")), "line-removed")
    discard(found, sets, matched, busy, rest)
    removed = maybe_broadcast(removed).withColumnsRenamed({"doc_id": "__d", "th": "__t", "removed": "__removed"})

    rest = [c for c in documents.columns if c not in ("n_lines", "n_removed", "removed")]
    joined = documents.select(*rest).join(removed, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t")), "left")
    lost = F.coalesce(F.col("__removed"), F.array().cast("array<int>"))
    less = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("__removed"), i)), "\n")
    return joined.select(
        *(F.when(F.col("__removed").isNull(), F.col("text")).otherwise(less).alias("text") if c == "text" else F.col(c) for c in rest),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.size(lost).cast("long").alias("n_removed"),
        lost.alias("removed"),
    )
