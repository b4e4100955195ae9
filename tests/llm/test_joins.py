"""Line dedup and the n-gram Jaccard join against brute force, with limits small enough to reach every path."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import common, line_dedup, ngram_join, queries
from weftline.llm.common import word_hashes
from weftline.llm.components import components


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", low(text or ""))


def brute_components(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    having = defaultdict(list)
    for i, x in enumerate(sets):
        for j, o in Counter(j for g in x for j in having[g]).items():
            if den * o >= num * (len(x) + len(sets[j]) - o):
                root[find(i)] = find(j)
        for g in x:
            having[g].append(i)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    smallest = lambda i: min((x for x in ids[find(i)] if x is not None), default=None)
    return sorted((str(d), len(sets[i]), str(smallest(i) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def brute_lines(rows, num=80, den=100, least=1):
    having, removed, lines = defaultdict(set), defaultdict(set), []
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for k, part in enumerate((t or "").split("\n")):
            w = words(part)
            if len(w) < least:
                continue
            x = frozenset(w)
            if any(den * o >= num * (len(x) + len(lines[j]) - o) for j, o in Counter(j for g in x for j in having[g]).items()):
                removed[d, t].add(k)
            for g in x:
                having[g].add(len(lines))
            lines.append(x)
    out = []
    for d, t in rows:
        gone = removed.get((d, t), set())
        out.append((str(d), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), 0 if t is None else t.count("\n") + 1, sorted(gone)))
    return sorted(out, key=str)


def documents(seed, sizes, n, edits):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(10**5)}" for _ in range(k)] for k in sizes]
    rows = []
    for k in range(n):
        lines = []
        for _ in range(rng.randrange(4)):
            w = list(rng.choice(base))
            for _ in range(rng.choice(edits) * max(1, len(w) // 30)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(300)}"
            lines.append(" ".join(w))
        rows.append((k if k % 31 else None, "\n".join(lines)))
    return [*rows, rows[7], (1000, None), (1001, ""), (1002, "a\n\nB  c\n"), (1003, "A\nb c")]


@pytest.mark.parametrize("limits", [{}, {"hot": 30, "bucket": 64}, {"first": 1, "steps": 2}, {"hot": 10, "held": 24, "first": 2, "bucket": 1 << 20}])
def test_lines(spark, limits):
    rows = documents(5, [4, 5, 6, 9, 15, 33, 60, 140, 300], 110, [0, 0, 1, 1, 2, 4])
    docs = spark.createDataFrame([(*r, "extra", 3) for r in rows], "doc_id long, text string, removed string, a int").repartition(4)
    found = line_dedup.dedup_lines(docs, **limits)
    assert found.columns == ["doc_id", "text", "a", "n_lines", "n_removed", "removed"]
    assert sorted(((str(r.doc_id), r.text, r.n_lines, r.removed) for r in found.collect()), key=str) == brute_lines(rows)


def test_short_lines(spark, tmp_path):
    """The query takes lines of any length: equal short ones, unspaced ones, and four words against five."""
    rows = documents(6, [1, 2, 3, 4, 5, 6, 9], 60, [0, 0, 1])
    rows += [(2000, "a b c d\n重复的一行文字没有空格\na"), (2001, "重复的一行文字没有空格\nb c d a e\nA"), (2002, "a\nx y\ny x\n\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op2_line_dedup(spark, str(tmp_path)).collect()
    want = brute_lines(rows, least=1)
    assert sorted(((str(r.doc_id), r.text, r.n_lines, [int(x) for x in r.removed.split(",") if x]) for r in found), key=str) == want
    assert want != brute_lines(rows, least=5)


def test_lines_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


@pytest.mark.parametrize(("size", "num", "limits"), [(3, 90, {}), (5, 80, {"rows": 12}), (5, 80, {"bucket": 64, "held": 128}), (5, 90, {"held": 20}), (3, 90, {"rows": 12})])
def test_components(spark, size, num, limits):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 12, 30, 60, 150]))] for _ in range(6)]
    rows = []
    for k in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((k if k % 37 else None, " ".join(w)))
    rows += [(7, rows[7][1]), (1000, None), (1001, ""), (1002, "a"), (1003, "A"), (1004, "a b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, one int").repartition(4)
    found = ngram_join.jaccard_components(docs, size, num, 100, **limits)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in found.collect()) == brute_components(rows, size, num, 100)


def test_keep_first(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(3, text), (1, text + " end"), (3, text), (None, text), (5, "else"), (5, "else"), (9, None), (9, None), (4, "")]
    docs = spark.createDataFrame([(*r, "src", 1) for r in rows], "doc_id long, text string, source string, one int")
    found = ngram_join.keep_first(docs, 5, 80, 100)
    assert found.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted([(1, text + " end"), (5, "else"), (9, None), (9, None), (4, "")], key=str)


def test_texts_stay_where_they_are(spark, monkeypatch):
    """A side too large for one broadcast goes in parts: same rows, and no text is shuffled."""
    rows = [(k if k % 9 else None, " ".join(f"w{k % 20 * 40 + j}" for j in range(40)) + f" e{k // 20}") for k in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, ngram_join.keep_first(docs, 5, 80, 100).collect()), key=str)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 2000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ngram_join.keep_first(docs, 5, 80, 100)
        plan = found._jdf.queryExecution().toString().rpartition("Physical Plan")[2]
        assert plan.count("BroadcastHashJoin") > 1 and "SortMergeJoin" not in plan
        assert sorted(map(tuple, found.collect()), key=str) == want and len(want) == 22
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_components_of_links(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 5: 5}


def test_sampled_shingles_of_linked_sets():
    """Of two linked sets, each meets all of its sample but what the link may leave out, also across the border of WHOLE."""
    rng = np.random.default_rng(8)
    for n in (3, 12, 50, 64, 70, 80, 90, 400):
        for num in (80, 90):
            for _ in range(30):
                x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                drop, add = int(rng.integers(0, n // 8 + 1)), int(rng.integers(0, n // 8 + 1))
                y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
                both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
                if 100 * both >= num * union:
                    (_, a, p, (m,), _), (_, b, q, (k,), _) = (ngram_join.sampled([s], num, 100, 0) for s in (x, y))
                    assert np.isin(a[p == 0], b).sum() >= m - (100 - num) * len(x) // 100
                    assert np.isin(b[q == 0], a).sum() >= k - (100 - num) * len(y) // 100


def test_cells_share(seed=2):
    rng = np.random.default_rng(seed)
    for n in (10, 11, 19, 40, 200, 900):
        for num in (80, 90):
            for _ in range(20):
                x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                drop, add = int(rng.integers(0, n // 8 + 1)), int(rng.integers(0, n // 8 + 1))
                y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
                both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
                if 100 * both >= num * union and both < union:
                    row, key = ngram_join.cells([x, y], num, 100)
                    assert set(key[row == 0]) & set(key[row == 1])


def test_cells_of_long_sets():
    """Rows in proportion to the set, and linked sets still meet."""
    rng = np.random.default_rng(4)
    x = np.unique(rng.integers(0, 1 << 63, 8000, dtype=np.uint64))
    y = np.unique(np.concatenate([x[800:], rng.integers(0, 1 << 63, 800, dtype=np.uint64)]))
    row, key = ngram_join.cells([x, y], 80, 100)
    assert len(row) < 2 * (len(x) + len(y)) and set(key[row == 0]) & set(key[row == 1])


def test_word_hashes():
    texts = [b"A bb  ccc\tlonger-than-eight a\x0bb", None, b"", b"bb a longer-than-eighu", "é É".encode()]
    found, counts = word_hashes(texts)
    assert counts.tolist() == [6, 0, 0, 3, 2]
    by = dict(zip(["a", "bb", "ccc", "long", "a2", "b", "bb2", "a3", "longu", "é", "É"], found.tolist(), strict=True))
    assert by["a"] == by["a2"] == by["a3"] and by["bb"] == by["bb2"] and len(set(by.values())) == 8


def test_lines_and_entries_are_handed_over_in_small_batches(spark, monkeypatch):
    most = 1 << 18

    class Checked(line_dedup.Join):
        def entries(self, table, batches):
            return line_dedup.Join.entries(self, table, bounded(batches))

        def regions(self, batches):
            return line_dedup.Join.regions(self, bounded(batches))

    def bounded(batches):
        for batch in batches:
            assert batch.slice(0, max(batch.num_rows - 1, 0)).nbytes <= 1.5 * most
            yield batch

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(150)) for _ in range(1200)]
    rows = [*enumerate(texts), (1200, texts[7])]
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    monkeypatch.setattr(common, "BATCH_BYTES", most)
    monkeypatch.setattr(line_dedup, "Join", Checked)
    try:
        found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
        assert [r["doc_id"] for r in found.where("n_removed > 0").collect()] == [1200]
        assert found.count() == len(rows)
    finally:
        spark.conf.set(name, before)
