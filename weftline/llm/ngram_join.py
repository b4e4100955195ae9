"""Exact near-duplicate components under the Jaccard distance of word n-gram sets.

The space of shingle sets is almost discrete: unrelated documents all lie at distance 1, so document pivots drawn
from the whole corpus separate nothing. The join therefore goes from coarse to fine, exactly at each step:

1. Equal sets collapse to one point each. With long shingles, documents that cannot have a link drop out: a link leaves
   a bounded number of a document's shingles outside the other one, so of any sample of them (those whose hash lies
   below a border) all but that many must occur elsewhere. Samples are counted in packed buckets by hash. Short shingles
   recur by chance in a large corpus, so there the test would cost more than it saves, and all documents go on.
2. Coarse cells. A link allows at most t different shingles for its sizes. The shingle universe is cut into t + 1
   classes; two linked sets agree wholly on some class. Sets that agree on a class share a cell. Cells chain into
   islands; every link lies inside an island, and inside one distances are informative.
3. Metric join of each island. Pivots create Voronoi regions, and documents within a window of twice the
   radius of a region's border are replicated into it (triangle inequality); regions join recursively, down to small
   ones that compare directly. Islands too large for one task are split the same way as distributed steps; a
   region that does not shrink is joined block by block. Every comparison is exact, in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import as_bytes, discard, give_back, materialise, maybe_broadcast, mix, text_blocks, unshuffled_join, word_hashes
from weftline.llm.components import components

SHINGLE = 3
#: A link needs DEN * intersection >= NUM * union.
NUM, DEN = 90, 100
#: Documents and shingles of an island that one task joins.
ISLAND_ROWS, ISLAND_SHINGLES = 512, 1 << 19
BRUTE = 16
#: Share of the shingles that is sampled beyond those that a link may leave out; sets of up to so many shingles are sampled whole.
SAMPLE, WHOLE = 0.15, 64
#: Bytes of text whose cells a task makes at once; a long text has some eight bytes of cells a byte.
CELL_BYTES = 1 << 19
#: Words of a shingle from which documents are tested for shingles that occur elsewhere.
RARE = 5
#: Sampled shingles a bucket is planned for, and those a task holds of one at once.
BUCKET, HELD = 1 << 20, 1 << 21
#: Empty classes that a set of a game has on average from which it has a single prefix instead of one a class.
BARE = 8


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than `size` are one shingle, none no shingle."""
    words, counts = word_hashes(texts)
    rolled = words.copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            rolled[: len(words) - k] = mix(rolled[: len(words) - k] * np.uint64(0x9E3779B97F4A7C15) + words[k:], k) if len(words) > k else rolled[: len(words) - k]
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            short = words[at : at + n]
            with np.errstate(over="ignore"):
                out.append(mix(np.array([np.sum(mix(short, 40) * np.arange(1, 2 * n, 2, dtype=np.uint64)) + np.uint64(n)], np.uint64), 41))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


class Bands:
    """Size bands for a Jaccard threshold num / den: linked sets lie in the same band or in neighbours."""

    def __init__(self, num: int, den: int, most: int):
        self.num, self.den = num, den
        low, self.lows, self.highs = 1, [], []
        while not self.highs or self.highs[-1] < most or len(self.highs) < 2:
            self.lows.append(low)
            self.highs.append(low * den // num)
            low = self.highs[-1] + 1
        self.lows.append(low)
        self.highs.append(low * den // num)
        # classes of a band's join: one more than the differences that a link may have there
        self.classes = np.array([2 * h * (den - num) // (den + num) + 1 for h in self.highs], np.int64)
        self.lows, self.highs = np.array(self.lows, np.int64), np.array(self.highs, np.int64)
        self.wide = self.classes * np.exp(-self.lows / self.classes) > BARE

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two independent 64-bit fingerprints of sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            if len(s):
                one[i], two[i] = np.sum(mix(s, 1)), np.sum(mix(s, 2))
        seed = sizes.astype(np.uint64)
        return sizes, mix(one + seed, 3), mix(two + seed, 4)


def cells(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the cells of each set, for the join of its band and of the next one."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bands = Bands(num, den, int(sizes.max()))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    spread, content = mix(flat, 5) >> np.uint64(32), mix(flat, 6)
    own = bands.of(np.maximum(sizes, 1))
    rows, keys = [], []
    for ahead in (0, 1):
        game = own + ahead
        k = np.where(sizes > 0, bands.classes[game], 0)
        if ahead:  # the larger partner has at least the next band's least size
            k = np.where(sizes * den >= num * bands.lows[game], k, 0)
        k = np.where(k > 1, k, 0)  # one class: only equal sets, and those are one point already
        at = np.concatenate([[0], np.cumsum(k)])
        some = k[owner] > 0
        who = owner[some]
        slot = at[who] + ((spread[some] * k[who].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(at[-1], np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(total, slot, content[some])
            row = np.repeat(np.arange(len(sets)), k)
            number = np.arange(at[-1]) - at[row]
            key = mix(total + mix(number.astype(np.uint64) * np.uint64(1 << 32) + game[row].astype(np.uint64), 7), 8)
        empty = np.bincount(slot, minlength=at[-1]) == 0
        rows.append(row[~empty])
        keys.append(key[~empty])
        # two sets may agree on a class by both having nothing in it; such sets meet by a prefix of their shingles instead:
        # one prefix a class, which chains few others, but one a set in games where both numbers grow with the set
        bare = np.flatnonzero(empty)
        wide = bands.wide[game[row[bare]]]
        _, once = np.unique(row[bare], return_index=True)
        keep = ~wide
        keep[once] = True
        for j, whole in zip(bare[keep].tolist(), wide[keep].tolist(), strict=True):
            i = int(row[j])
            s = sets[i]
            first = np.sort(mix(s, 9))[: len(s) - -(-num * len(s) // den) + 1]
            with np.errstate(over="ignore"):
                keys.append(mix(first + mix(np.array([((0xFFFFFFFF if whole else int(number[j])) << 32) + int(game[i])], np.uint64), 10), 11))
            rows.append(np.full(len(first), i))
    return np.concatenate(rows), np.concatenate(keys)


#: The place of a sampled shingle that needs no answer.
NOBODY = 0xFFFFFFFF


def sampled(sets: list[np.ndarray], num: int, den: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, hash, place) of a block's sampled shingles, once each; sample sizes of the sets, and those met again within the block.

    `place` is the set's number, or NOBODY if no answer is needed: other sets of the block have the shingle too, or
    the set is so little larger than WHOLE that only its partners are sampled whole.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
    spread = mix(flat, 50)
    below = mix(flat, 51) < np.uint64(int(((den - num) / den + SAMPLE) * (1 << 64)))
    asks = below | (sizes <= WHOLE)[owner]
    some = asks | (num * sizes <= den * WHOLE)[owner]
    spread, owner, asks = spread[some], owner[some], asks[some]
    order = np.argsort(spread, kind="stable")
    spread, owner, asks = spread[order], owner[order], asks[order]
    head = np.ones(len(spread), bool)
    head[1:] = spread[1:] != spread[:-1]
    run = np.cumsum(head) - 1
    alone = (np.bincount(run, minlength=run[-1] + 1 if len(run) else 0) == 1)[run]
    here = np.bincount(owner[asks & ~alone], minlength=len(sets))
    place = np.where(alone & asks, owner, NOBODY)[head]
    bucket = (spread[head] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(int(head.sum()), np.int64)
    return bucket, spread[head].astype(np.uint32), place.astype(np.uint32), np.bincount(owner[asks], minlength=len(sets)), here


def _met(held: int):
    """Rows sorted by bucket: how many of its sampled shingles each set meets in other blocks, by bucket; profiles pass through."""

    def count(block, key, place, last: bool):
        """What is shared among the held entries, and what to go on with: one entry a shingle. Packed numbers, as several workers share an executor."""
        order = key.astype(np.uint64) << np.uint64(32)
        order |= np.arange(len(key), dtype=np.uint64)
        order.sort()
        head = np.ones(len(key), bool)
        head[1:] = (order[1:] >> np.uint64(32)) != (order[:-1] >> np.uint64(32))
        order = order.astype(np.uint32)
        shared = ~head
        shared[:-1] |= ~head[1:]
        place = place[order]
        some = np.flatnonzero(shared & (place != NOBODY))
        who, n = np.unique((block[order[some]].astype(np.uint64) << np.uint64(32)) | place[some], return_counts=True)
        rest = None if last else (block[order[head]], key[order[head]], np.where(shared[head], np.uint32(NOBODY), place[head]))
        return who, n, rest

    def run(batches):
        bucket, parts, total, kind, names = None, [], 0, pa.int64(), {}

        def out(who, n):
            """One row a block of documents: places and counts."""
            block, place = (who >> np.uint64(32)).astype(np.int64), who.astype(np.uint32)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(n)]]).tolist() if len(n) else [0]
            blobs = [place[a:b].astype("<u4").tobytes() + n[a:b].astype("<u4").tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            m = len(blobs)
            none = lambda t: pa.nulls(m, t)
            return pa.RecordBatch.from_arrays([pa.array(np.array(list(names), np.int64)[block[edges[:-1]]]), none(pa.int32()), none(pa.int32()), none(kind), *(none(pa.int64()) for _ in range(4)), none(pa.int32()), pa.array(blobs, pa.binary())], ["block", "place", "met", "doc_id", "th", "n", "one", "two", "sample", "counts"])

        def finish():
            nonlocal parts, total
            if parts:
                who, n, _ = count(*(np.concatenate(x) for x in zip(*parts, strict=True)), True)
                yield out(who, n)
            parts, total = [], 0
            names.clear()

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            profile = np.asarray(batch.column("n").is_valid())
            if profile.any():
                own = batch.filter(pa.array(profile))
                columns = ["block", "place", "met", "doc_id", "th", "n", "one", "two", "sample"]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in columns), pa.nulls(own.num_rows, pa.binary())], [*columns, "counts"])
            rest = batch.filter(pa.array(~profile))
            for b, block, blob in zip(rest.column("bucket").to_pylist(), rest.column("block").to_pylist(), rest.column("entries").to_pylist(), strict=True):
                if b != bucket:
                    yield from finish()
                    bucket = b
                m = len(blob) // 8
                parts.append((np.full(m, names.setdefault(block, len(names)), np.uint32), np.frombuffer(blob, "<u4", m), np.frombuffer(blob, "<u4", m, 4 * m)))
                total += m
                if total > held:  # a frequent shingle's entries become one
                    who, n, left = count(*(np.concatenate(x) for x in zip(*parts, strict=True)), False)
                    yield out(who, n)
                    parts, total = [left], 0
        yield from finish()
        give_back()

    return run


def _summed(batches):
    """Rows sorted by block: (block, place, met) with the counts of all buckets."""
    held, now = [], None

    def total(block):
        parts = [np.frombuffer(blob, "<u4").reshape(2, -1) for blob in held]
        sums = np.bincount(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])).astype(np.int64)
        places = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(places), block)), pa.array(places.astype(np.int32)), pa.array(sums[places])], ["block", "place", "more"])

    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            if held and block != now:
                yield total(now)
                held = []
            now = block
            held.append(blob)
    if held:
        yield total(now)


class Sets:
    """Sets as slices of small integers, for counting intersections with one of them at a time."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        distinct, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(distinct), np.int64)
        self.root = np.arange(len(sets))
        self.eps = 1 - num / den + 1e-9

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def tie(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def distances(self, p: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distances from p, and which of them are links (exactly)."""
        self.mark[self.flat[self.at[p] : self.at[p + 1]]] = 1
        sizes = self.sizes[others]
        where = np.repeat(self.at[others] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        both = np.add.reduceat(self.mark[self.flat[where]], np.concatenate([[0], np.cumsum(sizes)[:-1]])) if len(others) else np.zeros(0, np.int64)
        self.mark[self.flat[self.at[p] : self.at[p + 1]]] = 0
        union = sizes + self.sizes[p] - both
        return 1 - both / union, self.den * both >= self.num * union

    def tie_all(self, p: int, others: np.ndarray) -> np.ndarray:
        d, links = self.distances(p, others)
        for j in others[links].tolist():
            self.tie(p, j)
        return d

    def join(self, region: np.ndarray, depth: int = 0) -> None:
        """Tie all links within the region."""
        if len(region) <= BRUTE or depth > 20:
            for k, p in enumerate(region.tolist()):
                if len(rest := region[k + 1 :]):
                    mine = self.find(p)
                    rest = rest[[self.find(j) != mine for j in rest.tolist()]]
                    self.tie_all(p, rest)
            return
        pivots = region[np.linspace(0, len(region) - 1, 8).astype(int)]
        rest = np.setdiff1d(region, pivots)
        d = np.stack([self.tie_all(p, rest) for p in pivots.tolist()])
        for k, p in enumerate(pivots.tolist()):
            self.tie_all(p, pivots[k + 1 :])
        inside = d <= d.min(axis=0) + 2 * self.eps
        if inside.sum() <= 1.5 * len(rest):
            for k in range(len(pivots)):
                self.join(rest[inside[k]], depth + 1)
            return
        # regions that overlap too much: rings around the first pivot instead, each document against its window
        order = np.argsort(d[0], kind="stable")
        rest, ring = rest[order], d[0][order]
        end = np.searchsorted(ring, ring + self.eps, "right")
        for k, p in enumerate(rest.tolist()):
            later = rest[k + 1 : end[k]]
            if len(later):
                mine = self.find(p)
                self.tie_all(p, later[np.fromiter((self.find(j) != mine for j in later.tolist()), bool, len(later))])


def _groups(batches, key: str):
    """Consecutive rows of equal `key`, over batch borders, as lists of dicts of columns."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _solve(num: int, den: int):
    """Joins whole islands: (id, root) of every document; `loose` documents are compared with all, others only with loose ones."""

    def run(batches):
        for rows in _groups(batches, "region"):
            rows.sort(key=lambda r: r["id"])
            found = Sets([np.frombuffer(r["shingles"], np.uint64) for r in rows], num, den)
            found.join(np.arange(len(rows)))
            ids = [r["id"] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([ids[found.find(i)] for i in range(len(ids))], pa.string())], ["a", "b"])
        give_back()

    return run


def _split(num: int, den: int):
    """One block of a large region against the region's pivots: verified links, and the sub-regions each document enters."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, pivots = left.to_pylist(), right.to_pylist()
        pivots.sort(key=lambda r: r["id"])
        found = Sets([np.frombuffer(r["shingles"], np.uint64) for r in pivots + rows], num, den)
        k = len(pivots)
        others = np.arange(k, k + len(rows))
        d, links = zip(*(found.distances(p, others) for p in range(k)), strict=True)
        d, links = np.stack(d), np.stack(links)
        inside = d <= d.min(axis=0) + 2 * found.eps
        out = []
        for p in range(k):
            pivot = pivots[p]["id"]
            for i in np.flatnonzero(links[p]).tolist():
                out.append((rows[i]["id"], pivot, None, None, None))
            for i in np.flatnonzero(inside[p]).tolist():
                if not any(rows[i]["id"] == q["id"] for q in pivots):
                    out.append((rows[i]["id"], None, f"{rows[i]['region']}/{p}", rows[i]["shingles"], bool(links[p][i])))
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.Table.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.bool_())], ["id", "pivot", "region", "shingles", "core"])

    return run


def _cross(num: int, den: int):
    """Links between two blocks of a region: loose documents (left) against any (right); spanning links only."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, others = left.to_pylist(), right.to_pylist()
        a, b = [], []
        if rows and others:
            found = Sets([np.frombuffer(r["shingles"], np.uint64) for r in rows + others], num, den)
            against = np.arange(len(rows), len(rows) + len(others))
            ids = [r["id"] for r in rows + others]
            for i in range(len(rows)):
                found.tie_all(i, against)
            for i in range(len(ids)):
                if (r := found.find(i)) != i:
                    a.append(ids[i])
                    b.append(ids[r])
        return pa.Table.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    return run


def metric_links(points: DataFrame, num: int, den: int, rows: int = ISLAND_ROWS, shingles: int = ISLAND_SHINGLES, levels: int = 6) -> DataFrame:
    """Links (a, b) that connect what the exact links within each region connect. `points`: region, id, shingles (binary).

    Regions of at most `rows` documents and `shingles` shingles are joined in one task each; larger ones are
    split by pivots, up to `levels` times and as long as that makes them smaller, then joined block by block.
    """
    spark, links, now, was = points.sparkSession, [], points, None
    for level in range(levels + 1):
        sizes = now.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.sum(F.octet_length("shingles") / 8).alias("held"), F.min(F.length("region")).alias("x")).drop("x")
        sizes = materialise(sizes, "regions")
        small = (F.col("size") <= rows) & (F.col("held") <= shingles)
        fits = now.join(sizes.where(small).select("region"), "region", "left_semi") if level or not sizes.where(~small).isEmpty() else now
        links.append(fits.select("region", "id", "shingles").repartition("region").sortWithinPartitions("region").mapInArrow(_solve(num, den), "a string, b string").where("a <> b"))
        large = sizes.where(~small)
        if large.isEmpty():
            break
        # blocks by count and by bytes; pivots by the number of blocks
        large = large.withColumn("blocks", F.greatest(F.ceil(F.col("size") / rows), F.ceil(F.col("held") / shingles)).cast("int"))
        if was is not None:
            parent = F.regexp_replace("region", "/[0-9]+$", "")
            large = large.join(was.select(F.col("region").alias("r"), F.col("size").alias("before")), parent == F.col("r"), "left")
            stuck = large.where((F.col("size") > 0.7 * F.col("before")) | F.lit(level == levels))
            links.append(_by_blocks(now, stuck, num, den))
            large = large.where((F.col("size") <= 0.7 * F.col("before")) & F.lit(level < levels))
        large = materialise(large.select("region", "size", "blocks"), "regions")
        if large.isEmpty():
            break
        own = now.select("region", "id", "shingles").join(large, "region")
        pick = own.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(level)), F.least(F.lit(32), 2 * F.col("blocks"))))
        pivots = materialise(pick.groupBy("region", "bucket").agg(F.min_by(F.struct("id", "shingles"), F.xxhash64("id", F.lit(level + 100))).alias("p"), F.first("blocks").alias("blocks")).select("region", "blocks", "p.id", "p.shingles"), "pivots")
        # pivots against each other: every one is a row of the region too, so each meets all the others below
        left = own.withColumn("block", F.pmod(F.xxhash64("id", F.lit(level + 200)), F.col("blocks"))).select("region", "block", "id", "shingles")
        right = pivots.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).select("region", "block", "id", "shingles")
        split = materialise(left.groupBy("region", "block").cogroup(right.groupBy("region", "block")).applyInArrow(_split(num, den), "id string, pivot string, region string, shingles binary, core boolean"), "split")
        links.append(split.where("pivot is not null and pivot <> id").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        now, was = split.where("pivot is null").select("region", "id", "shingles", "core"), large
    out = spark.createDataFrame([], "a string, b string")
    for found in links:
        out = out.union(found)
    return out


def _by_blocks(now: DataFrame, stuck: DataFrame, num: int, den: int) -> DataFrame:
    """Regions that pivots don't make smaller: documents not linked to the pivot, block by block, against all blocks."""
    own = now.join(stuck.select("region", "blocks"), "region").withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = own.where("not core").select("region", F.col("block").alias("i"), every.alias("j"), "id", "shingles")
    right = own.toDF(*own.columns).select("region", every.alias("i"), F.col("block").alias("j"), "id", "shingles")
    return left.groupBy("region", "i", "j").cogroup(right.groupBy("region", "i", "j")).applyInArrow(_cross(num, den), "a string, b string")


def _tested(docs: DataFrame, size: int, num: int, den: int, bucket: int, held: int) -> tuple[DataFrame, DataFrame]:
    """Profiles (doc_id, th, n, one, two) of docs(doc_id, text, th); and of those with shingles also `can`: whether they can have a link."""
    # some seven bytes a word, and so a shingle
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (int(volume / 7 * ((den - num) / den + SAMPLE)) // bucket).bit_length()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["bucket", "entries", "block", "place", "met", "doc_id", "th", "n", "one", "two", "sample"]

    def profile(batches):
        for batch in text_blocks(batches):
            sets = shingle_sets(as_bytes(batch.column("text")), size)
            n, one, two = prints(sets)
            th = np.asarray(batch.column("th")).view(np.uint64)
            # the same block has the same number when a task runs again
            with np.errstate(over="ignore"):
                block = int(mix(np.array([np.sum(mix(th, 61) * np.arange(1, 2 * len(th), 2, dtype=np.uint64)) + np.uint64(len(th))], np.uint64), 62).view(np.int64)[0])
            at, key, place, sample, here = sampled(sets, num, den, bits)
            m = len(sets)
            ints = lambda x: pa.array(x.astype(np.int32))
            deal = ints(mix(one ^ mix(th, 63)) >> np.uint64(33))
            yield pa.RecordBatch.from_arrays([deal, pa.nulls(m, pa.binary()), pa.array(np.full(m, block)), ints(np.arange(m)), ints(here), batch.column("doc_id"), batch.column("th"), pa.array(n), _signed(one), _signed(two), ints(sample)], names)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]]).tolist() if len(at) else [0]
            blobs = [key[a:b].tobytes() + place[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            k = len(blobs)
            none = [pa.nulls(k, pa.int64()) for _ in range(4)]
            yield pa.RecordBatch.from_arrays([ints(at[edges[:-1]]), pa.array(blobs, pa.binary()), pa.array(np.full(k, block)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, batch.schema.field("doc_id").type), *none, pa.nulls(k, pa.int32())], names)

    rest = f"block long, place int, met int, doc_id {kind}, th long, n long, one long, two long, sample int, counts binary"
    dealt = docs.mapInArrow(profile, f"bucket int, entries binary, {rest.removesuffix(', counts binary')}").repartition("bucket").sortWithinPartitions("bucket")
    counted = materialise(dealt.mapInArrow(_met(held), rest), "profiles")
    known = counted.where("n is not null")
    met = counted.where("n is null").select("block", "counts").repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "block long, place int, more long")
    missing = F.floor(F.lit(den - num) * F.col("n") / F.lit(den))
    can = F.col("met") + F.coalesce("more", F.lit(0)) >= F.col("sample") - missing
    return known.drop("counts"), known.where("n > 0").join(met, ["block", "place"], "left").withColumn("can", can)


def _labelled(documents: DataFrame, size: int, num: int, den: int, rows: int, shingles: int, bucket: int = BUCKET, held: int = HELD) -> DataFrame:
    """Per document row: doc_id, th (hash of the text), n (shingles), own and first: the places of the row and of its component's first row.

    A place is struct(doc_id is null, doc_id, th); documents without shingles are their own component.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("th"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")

    def to_cells(batches):
        for batch in text_blocks(batches, limit=CELL_BYTES):
            sets = shingle_sets(as_bytes(batch.column("text")), size)
            row, cell = cells(sets, num, den)
            _, one, _ = prints(sets)
            for k in range(0, len(row), 1 << 18):
                yield pa.RecordBatch.from_arrays([_signed(cell[k : k + (1 << 18)]), _signed(one[row[k : k + (1 << 18)]])], ["cell", "one"])

    def to_points(batches):
        for batch in text_blocks(batches):
            sets = shingle_sets(as_bytes(batch.column("text")), size)
            _, one, two = prints(sets)
            yield pa.RecordBatch.from_arrays([_signed(one), _signed(two), pa.array([s.tobytes() for s in sets], pa.binary())], ["one", "two", "shingles"])

    def to_prints(batches):
        for batch in text_blocks(batches):
            n, one, two = prints(shingle_sets(as_bytes(batch.column("text")), size))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n), _signed(one), _signed(two)], ["doc_id", "th", "n", "one", "two"])

    of = (F.col("doc_id").eqNullSafe(F.col("d"))) & (F.col("th") == F.col("t"))
    if size >= RARE:
        known, tested = _tested(docs, size, num, den, bucket, held)
    else:
        known = materialise(docs.mapInArrow(to_prints, f"doc_id {kind}, th long, n long, one long, two long"), "profiles")
        tested = known.where("n > 0").withColumn("can", F.lit(True))
    sets = materialise(tested.groupBy("one", "two").agg(F.min(place).alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("can").alias("can")), "sets")

    able, some = docs, None
    if size >= RARE:
        some = materialise(sets.where("can").select(F.col("rep.doc_id").alias("d"), F.col("rep.th").alias("t")), "able")
        able = unshuffled_join(docs, some, of, "left_semi", "th", "t")
    placed = materialise(able.select("text").mapInArrow(to_cells, "cell long, one long"), "cells")
    discard(some)
    shared = placed.groupBy("cell").agg(F.min("one").alias("low"), F.max("one").alias("high")).where("low < high")
    chained = placed.join(shared, "cell").where("one <> low").select(F.col("one").alias("a"), F.col("low").alias("b")).distinct()
    chained = materialise(chained, "chained")
    discard(placed)
    islands = materialise(components(chained), "islands")
    discard(chained)

    # the shingles of one document for each set that has company
    wanted = sets.join(maybe_broadcast(islands), F.col("one") == F.col("node"))
    wanted = materialise(wanted.select("one", "two", F.col("rep.doc_id").alias("d"), F.col("rep.th").alias("t"), F.col("root").cast("string").alias("region")), "wanted")
    texts = unshuffled_join(docs, wanted.select("d", "t"), of, "left_semi", "th", "t").select("text")
    points = texts.mapInArrow(to_points, "one long, two long, shingles binary").join(maybe_broadcast(wanted.select("one", "two", "region")), ["one", "two"])
    points = points.select("region", F.format_string("%016x%016x", "one", "two").alias("id"), "shingles").dropDuplicates(["id"])
    points = materialise(points, "points")
    discard(islands, wanted)
    links = materialise(metric_links(points, num, den, rows, shingles), "links")
    discard(points)

    joined = materialise(components(links), "joined")
    named = sets.withColumn("id", F.format_string("%016x%016x", "one", "two")).join(maybe_broadcast(joined), F.col("id") == F.col("node"), "left")
    smallest = named.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("component"))
    smallest = maybe_broadcast(materialise(smallest, "smallest"))
    labels = named.where("root is not null or copies > 1").join(smallest, F.col("root") == F.col("r"), "left").select("one", "two", F.coalesce("component", "rep").alias("component"))
    labels = maybe_broadcast(materialise(labels, "labels"))
    found = known.join(labels, ["one", "two"], "left")
    return found.select("doc_id", "th", "n", place.alias("own"), F.when((F.col("n") > 0) & F.col("component").isNotNull(), F.col("component")).otherwise(place).alias("first"))


def jaccard_components(documents: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN, rows: int = ISLAND_ROWS, shingles: int = ISLAND_SHINGLES, bucket: int = BUCKET, held: int = HELD) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    A null or wordless text has an empty set and is linked with nothing. Very long texts take part whole. Repeated
    rows are copies of each other. A null doc_id takes part like any other, but is never the smallest; a component of
    nulls alone has a null id. A similarity just at the threshold is a link. Further columns are ignored, whatever
    their names; an empty table gives an empty result. Words and shingles are told by 64 bits of hash.
    """
    found = _labelled(documents, size, num, den, rows, shingles, bucket, held)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))


def keep_first(documents: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row of each component, all columns as they are: that of the least (doc_id, hash of the text), null ids last.

    Rows alike in doc_id and text are one document, of which any one row stays; documents without words stay all.
    """
    found = materialise(_labelled(documents, size, num, den, ISLAND_ROWS, ISLAND_SHINGLES), "labelled")
    gone = materialise(found.where("own <> first").select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct(), "gone")
    again = materialise(found.where("n > 0 and own = first").groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")), "again")
    discard(found)
    text = F.xxhash64("text")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (text == F.col("__t"))
    kept = unshuffled_join(documents, gone, same, "left_anti", text, "__t")
    if again.isEmpty():
        return kept
    once, repeated = (unshuffled_join(kept, again, same, how, text, "__t") for how in ("left_anti", "left_semi"))
    return once.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
