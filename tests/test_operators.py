"""Operators on small literals: ties, empty inputs, quirks that are kept on purpose."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vectors as V
from weftline.operators import context as C
from weftline.operators import evaluation as E
from weftline.operators import fusion as R
from weftline.operators import graph as G
from weftline.operators import parsing as P
from weftline.operators import search as S
from weftline.operators import symbols as Y
from weftline.operators import traversal as W
from weftline.plans import catalog
from weftline.sources import datasets, files, store


def one(spark, **values):
    schema = ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema)


def test_vectors(spark):
    rows = [("alpha", [1.0, 0.0, 0.0]), ("beta", [0.0, 1.0, 0.0]), ("gamma", [0.0, 0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.9, 0.2, 0.1])], "query_id int, embedding array<float>")
    assert [r["id"] for r in S.cosine_top_k(vectors, asked, 2).orderBy("rank").collect()] == ["alpha", "beta"]
    assert S.cosine_top_k(vectors.limit(0), asked, 2).isEmpty()
    assert {r["id"] for r in S.upsert(vectors, vectors.where("id = 'beta'").withColumn("embedding", F.array(F.lit(2.0).cast("float")))).where("size(embedding) = 3").collect()} == {"alpha", "gamma"}
    with pytest.raises(Exception, match="vector of length 3"):
        S.checked_vectors(vectors, 2).collect()
    r = one(spark, a=[3.0, 4.0], b=[0.0, 0.0], c=[1.0]).select(V.cosine(F.col("a"), F.col("a")), V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("c")), V.unit(F.col("b"))).first()
    assert (r[0], r[1], r[2], r[3]) == (1.0, 0.0, 0.0, [0.0, 0.0])
    assert S.vector_stats(vectors).first() == (3, 3)


def test_text_search(spark):
    docs = spark.createDataFrame([(1, "connect to the database"), (2, "draw a button"), (3, "")], "id int, content string")
    asked = spark.createDataFrame([(1, "connect to database"), (2, "the of")], "query_id int, query string")
    found = S.text_search(docs, asked, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in found] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    assert found[1]["score"] == 0 and found[3]["score"] == 0.5


def test_repeated_terms_count_repeatedly(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue")], "id int, content string")
    asked = spark.createDataFrame([(1, "fox"), (2, "fox fox")], "query_id int, query string")
    found = {r["query_id"]: r["score"] for r in S.bm25(docs, asked).collect()}
    assert found[2] == pytest.approx(2 * found[1])


def test_lexical_search_shuffles_no_pairs(spark, monkeypatch):
    """Small blocks of queries, scores and texts give what brute force gives, ties and nulls included; pairs of queries and documents stay where they are scored."""
    for name, value in (("QUERIES", 3), ("MEETINGS", 20), ("SCORES", 12), ("TEXT_BYTES", 64)):
        monkeypatch.setattr(S, name, value)
    words = ["red", "fox", "a_b", "den", "\u212aelvin", "x1"]
    texts = [(i, None if i == 7 else " ".join(words[(i * j) % 6] for j in range(i % 5)) + "! Fox") for i in range(60)]
    asked = [(q, " ".join(words[: q % 4 + 1] * (q % 3 + 1))) for q in range(8)] + [(None, "fox den"), (9, ""), (10, None)]
    docs = spark.createDataFrame(texts, "id int, content string").repartition(5)
    found = S.bm25(docs, spark.createDataFrame(asked, "query_id int, query string"), 4, 6)
    cut = {i: [w for w in re.split("[^a-z0-9_]+", t.lower()) if w] for i, t in texts if t is not None}
    average, want = sum(map(len, cut.values())) / len(cut), []
    for q, text in asked:
        scored = []
        for i, tokens in cut.items():
            score = 0.0
            for w in re.split("[^a-z0-9_]+", (text or "").lower()):
                df, tf = sum(w in t for t in cut.values()), tokens.count(w)
                score += math.log(1 + (60 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / average)) if w else 0
            scored += [(-round(score, 6), i)] if round(score, 6) > 0 else []
        want += [(q, i, round(-s, 6), n + 1) for n, (s, i) in enumerate(sorted(scored)[:4])]
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted((tuple(r) for r in found.select("query_id", "id", "score", "rank").collect()), key=key) == sorted(want, key=key)
    assert S.bm25(docs, spark.createDataFrame([], "query_id int, query string"), 4).isEmpty()
    for k in (None, 4):
        plan = S.bm25(docs, spark.createDataFrame(asked, "query_id int, query string"), k)._jdf.queryExecution().toString()
        assert "hashpartitioning(query_id, id" not in re.sub(r"#\d+L?", "", plan)


def written_rows(monkeypatch):
    """Rows of what searches write, by label."""
    seen, cut = {}, S.cut

    def kept(df, label="step"):
        out = cut(df, label)
        seen.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(S, "cut", kept)
    return seen


def test_vector_search_makes_no_pairs(spark, monkeypatch):
    """What brute force gives, in order of score, then id, with copies, nulls, zeros, NaN and other lengths; pairs never become rows, and a task writes k rows a query at most."""
    monkeypatch.setattr(S, "SCORES", 24)
    rng = [((i * 7919 + 13) % 101) / 50 - 1 for i in range(4 * 90)]
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if 20 <= i < 60 else rng[4 * i : 4 * i + 4]) for i in range(90)]
    rows += [(90, None), (91, [1.0, None, 2.0, 3.0]), (92, [0.0] * 4), (93, [1.0, 2.0]), (94, []), (95, [float("nan"), 1.0, 1.0, 1.0]), (None, [-1.0, -2.0, -3.0, -4.0])]
    asked = [(100, rows[3][1]), (101, [1.0, 2.0, 3.0, 4.0]), (102, [0.0] * 4), (103, [2.0, 1.0]), (104, None), (105, [1.0, None, 1.0, 1.0]), (None, rows[5][1]), (107, [])]
    kind = "array<double>"
    vectors = spark.createDataFrame(rows, f"id int, embedding {kind}").repartition(3)
    queries = spark.createDataFrame(asked, f"query_id int, embedding {kind}")

    def score(a, b):
        if a is None or b is None:
            return None
        if len(a) != len(b):
            return 0.0
        if None in a or None in b:
            return None
        x, y = (math.sqrt(sum(v * v for v in z)) or 1.0 for z in (a, b))
        return sum(v * w for v, w in zip(a, b, strict=True)) / x / y

    def key(pair):  # NaN first, null last, then null ids first
        s, i = pair
        return (2 if s is None else 0 if math.isnan(s) else 1, 0 if s is None or math.isnan(s) else -round(s, 6), i is not None, i or 0)

    same = lambda r: (*r[:2], "nan" if r[2] is not None and math.isnan(r[2]) else None if r[2] is None else round(r[2], 6) + 0.0, r[3])
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    seen = written_rows(monkeypatch)
    for k, block in ((5, 4096), (95, 3)):
        want = [same((q, i, s, n + 1)) for q, e in asked for n, (s, i) in enumerate(sorted(((score(v, e), i) for i, v in rows), key=key)[:k])]
        found = S.cosine_top_k(vectors, queries, k, 6, block)
        assert found.columns == ["query_id", "id", "score", "rank"]
        assert sorted((same(r) for r in found.collect()), key=order) == sorted(want, key=order)
        assert not re.search("NestedLoopJoin|CartesianProduct", found._jdf.queryExecution().toString())
    assert seen["near"][0] <= 3 * 5 * len(asked) and len(seen["near"]) > 2
    assert S.cosine_top_k(vectors, queries.limit(0), 3).isEmpty()


def test_lexical_search_writes_k_a_task(spark, monkeypatch):
    """Copies of a text tie: a task writes the k first of them, by id, not all."""
    seen = written_rows(monkeypatch)
    monkeypatch.setattr(S, "SCORES", 16)
    docs = spark.createDataFrame([(i, "red fox") for i in range(200)], "id int, content string").repartition(2)
    found = S.bm25(docs, spark.createDataFrame([(q, "fox") for q in range(4)], "query_id int, query string"), 3, 6)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found.collect()) == [(q, n + 1, n) for q in range(4) for n in range(3)]
    assert seen["scores"] == [2 * 3 * 4]


@pytest.mark.parametrize("digits", [2, 6])
def test_rounding_is_sparks(spark, digits):
    values = [0.125, -0.125, 0.115, 2.675, 1.0000005, -1e-9, 0.1234565, 1 / 3, 123456.7890125]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(F.round("x", digits)).collect()]
    assert S._rounded(np.array(values), digits).tolist() == want


def test_fusion(spark):
    pool = spark.createDataFrame([(1, "a", 0.9, 1, "ANN"), (1, "b", 0.8, 2, "ANN"), (1, "b", 3.0, 1, "BM25"), (1, "c", 2.0, 2, "BM25")], "query_id int, id string, score double, rank int, source string")
    found = R.reciprocal_rank_fusion(pool, 3).orderBy("rank").collect()
    assert [r["id"] for r in found] == ["b", "a", "c"] and found[0]["fused"] == pytest.approx(1 / 62 + 1 / 61)
    flat = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0)], "query_id int, id string, x double")
    assert [r[0] for r in flat.select(R.min_max(F.col("x"))).collect()] == [1.0, 1.0]
    strict = spark.createDataFrame([(1, "p", 0.1), (2, "q", 0.1), (2, "r", 0.9)], "query_id int, path string, s double")
    assert sorted(r["path"] for r in R.strict_filter(strict, F.col("s") > 0.5).collect()) == ["p", "r"]
    cross = spark.createDataFrame([(1, "a", 0.2, None, 0.5, 0.0), (1, "b", 0.9, 1.0, 0.5, 1.0)], "query_id int, id string, semantic double, lexical double, structural double, cross double")
    assert [(r["id"], round(r["score"], 6)) for r in R.rerank(cross, 2, cross=True).orderBy("rank").collect()] == [("b", 1.0), ("a", round(0.2 / 1.2, 6))]


def test_intent_words_end_at_other_letters(spark):
    """Borders of words are those of ASCII, as in the SQL: a letter beyond it ends a word."""
    r = one(spark, a="\u00e4test", b="\u00fclogin\u00df", c="xlogin atest", p="src/auth/a.ts", t="tests/a.ts")
    boost = lambda q, p: R.intent_boost(F.col(q), F.col(p))
    assert tuple(r.select(boost("a", "t"), boost("b", "p"), boost("c", "p"), boost("c", "t")).first()) == (1.5, 2.0, 0.0, 0.0)


def test_intents_and_paths(spark):
    r = one(spark, q="fix the LOGIN test in src/ui/App.tsx", p="src/auth/a.ts", t="tests/a.ts", m="src\\x/../y//z.ts").select(R.intent_boost(F.col("q"), F.col("p")), R.intent_boost(F.col("q"), F.col("t")), T.mentioned_files(F.col("q")), T.normalized_path(F.col("m")), T.mentions_path(F.col("q"), F.lit("x/app.tsx"))).first()
    assert (r[0], r[1], r[2], r[3], r[4]) == (2.0, 1.5, ["src/ui/App.ts"], "src/y/z.ts", True)


def chain(spark):
    return spark.createDataFrame([("a", "b", "calls", 1), ("b", "c", "calls", 2), ("c", "a", "imports", 3), ("a", "d", "contains", 0)], "src string, dst string, type string, seq long")


def test_walks(spark):
    edges, start = chain(spark), spark.createDataFrame([("s", "a")], "source string, id string")
    assert {(r["id"], r["depth"]) for r in W.walk(start, edges).collect()} == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    assert [r["id"] for r in W.walk(start, edges, 1, ordered=True).orderBy("depth", "pos").collect()] == ["a", "d", "b"]
    assert {r["id"] for r in W.walk(start, edges, 1, ("imports",), backward=True).collect()} == {"a", "c"}
    assert W.walk(start.limit(0), edges, 2).isEmpty()
    pairs = spark.createDataFrame([("a", "c"), ("d", "a"), ("b", "b")], "source string, target string")
    assert {(r["source"], r["target"]): r["path"] for r in W.shortest_paths(pairs, edges).collect()} == {("a", "c"): ["a", "b", "c"], ("b", "b"): ["b"]}
    assert [r["id"] for r in W.depth_first(spark.createDataFrame([("a", "a")], "source string, id string"), edges, 2).orderBy("pos").collect()] == ["a", "d", "b", "c"]


def test_graph_changes(spark):
    nodes = spark.createDataFrame([("a", "file", "x", 1), ("b", "function", "x", 2), ("c", "function", "y", 3)], "id string, type string, path string, seq long")
    edges = spark.createDataFrame([("e1", "a", "b", "contains", 1), ("e2", "b", "c", "calls", 2), ("e3", "b", "c", "calls", 3)], "id string, src string, dst string, type string, seq long")
    g = G.Graph(nodes, edges)
    assert g.neighbors(["calls"]).count() == 2
    assert g.remove_path("x").edges.isEmpty() and g.reversed().outgoing("c").count() == 2
    with pytest.raises(ValueError, match="endpoint"):
        g.upsert_edges(spark.createDataFrame([("e9", "a", "zz", "calls", 9)], edges.schema))
    log = spark.createDataFrame([(1, "remove_node", "b", None, None, None, None), (2, "add_node", "b", None, None, "class", "x"), (3, "add_edge", "n1", "a", "b", "contains", None), (4, "modify_node", "c", None, None, "class", "z")], "op_seq long, op string, id string, src string, dst string, type string, path string")
    now = G.apply_overlay(g, log)
    assert {r["id"] for r in now.edges.collect()} == {"n1"} and {r["type"] for r in now.nodes.where("id <> 'a'").collect()} == {"class"}
    assert G.clear_overlay(log, "x").count() == 3


def test_packing(spark):
    rows = spark.createDataFrame([(1, "target", 1, "t", 70), (1, "backward", 1, "b1", 20), (1, "backward", 2, "b2", 5), (1, "forward", 1, "f", 18), (1, "related", 1, "r", 7)], "query_id int, category string, pos int, id string, tokens int")
    assert [r["id"] for r in C.skip_fit(rows, F.lit(100.0)).orderBy("place").collect()] == ["t", "b2", "f", "r"]
    turns = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 1)], "query_id int, pos int, tokens int")
    assert C.prefix_fit(turns, F.lit(10)).count() == 1
    r = one(spark, a="x").select(C.clamp_budget(F.lit(float("nan"))), C.clamp_budget(F.lit(4000.5)), C.clamp_budget(F.lit(99999.0)), C.clamp_budget(F.lit(7000.9))).first()
    assert tuple(r) == (6000, 6000, 12000, 7000)


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 1, "src/auth.ts"), (1, 2, "src/login.ts"), (1, 3, "x"), (2, 1, "y")], "query_id int, rank int, item string")
    truth = spark.createDataFrame([(1, " src/auth.ts "), (1, "src/login.ts"), (2, "z")], "query_id int, item string")
    found = {r["query_id"]: (r["precision"], r["recall"], r["f1"]) for r in E.at_k(ranked, truth, 2).collect()}
    assert found == {1: (1.0, 1.0, 1.0), 2: (0.0, 0.0, 0.0)}
    assert {r["query_id"]: r["recall"] for r in E.at_k(ranked, truth.limit(0), 2).collect()} == {1: 1.0, 2: 1.0}
    r = one(spark, a="x").select(E.actions(F.lit(1.0), F.lit(1.0), F.lit(0.1)), E.actions(F.lit(0.0), F.lit(0.0), F.lit(0.1))).first()
    assert r[0] == [] and r[1] == ["enable_cross_encoder", "increase_walk_depth", "expand_related", "increase_token_budget"]
    zero = E.macro_average(spark.createDataFrame([], "precision double, recall double"), ("precision", "recall")).first()
    assert tuple(zero) == (0.0, 0.0)
    two = spark.createDataFrame([(1.0, 0.6), (0.5, 1.0)], "precision double, recall double")
    assert tuple(E.macro_average(two, ("precision", "recall")).first()) == (0.75, 0.8)
    m = spark.createDataFrame([(["p"], ["q", "r"], ["p", "q", "r"])], "c array<string>, x array<string>, t array<string>").select(E.task_metrics(F.col("c"), F.col("x"), F.col("t"), F.lit(0.5), F.lit(1.0), F.lit(1.0)).alias("m")).select("m.*").first()
    assert m["precision"] == 3.0 and m["recall"] == 1.0 and m["exact"] == 1.0
    assert tuple(E.usage_stats(spark.createDataFrame([], "timestamp long, tokens_used long, tokens_saved long")).first()) == (0, 0, 0, 0.0)
    trace = E.Trace()
    with pytest.raises(RuntimeError), trace.step("a"):
        raise RuntimeError("x")
    assert trace.entries[0]["status"] == "error"


def test_texts(spark):
    long = "x" * 250
    r = one(spark, a=f" {long}\nb", b="Text\n- one\n * two\n```TS x\ncode \n```", c="maybe perhaps could be seems like " * 3, d="aabb").select(T.summary(F.col("a")), T.follow_ups(F.col("b")), T.code_blocks(F.col("b")), T.confidence(F.col("c"))["score"], T.confidence(F.lit("I'm not sure"))["reason"], T.char_entropy(F.col("d")), T.char_entropy(F.lit("")), T.utf16_length(F.lit("a😀"))).first()
    assert r[0] == "x" * 197 + "..." and r[1] == ["one", "two"] and [tuple(x) for x in r[2]] == [("ts", "code")]
    assert r[3] == 0.5 and r[4] == 'Contains uncertainty: "not sure"' and r[5] == pytest.approx(1.0) and r[6] == 0.0 and r[7] == 3
    s = one(spark, a="import { a, B as c } from './x'", b="const y = require('fs')", c="(a: number, b)", d="import * as ns from 'z'").select(T.import_path(F.col("a")), T.imported_names(F.col("a")), T.import_path(F.col("b")), T.parameter_names(F.col("c")), T.imported_names(F.col("d"))).first()
    assert tuple(s) == ("./x", ["a", "B as c"], "fs", ["a", "b"], ["ns"])


def test_parsing(spark):
    text = "FILE: a.ts\n```ts\nnew  \n```\n```diff\n--- a/a.ts\n+++ b/a.ts\n@@ x\n-o\n+n\n```\n```diff\nno path\n```\nFILE: b.ts\n```\nb\n```"
    found = {r["path"]: (r["type"], r["content"]) for r in P.edits(spark.createDataFrame([(1, text)], "response_id int, response string")).collect()}
    assert found["b.ts"] == ("replace", "b") and found["a.ts"][0] == "diff" and len(found) == 2
    lines = P.diff_lines(P.edits(spark.createDataFrame([(1, text)], "response_id int, response string"))).orderBy("line_no").collect()
    assert [r["kind"] for r in lines] == ["removed", "added", "hunk", "removed", "added"]
    rules = spark.createDataFrame([(1, "# Rules\nhello\n## Code Style\na\n## Safety\nb\n## Testing\nc"), (2, "## Code Style\nmy password"), (3, " "), (4, "# T\nx\n## Safety\ny")], "rules_id int, raw string")
    assert {r["rules_id"]: r["error"] for r in P.validated_rules(rules).collect()} == {1: None, 2: "forbidden pattern", 3: "empty", 4: "missing section: code style"}
    history = spark.createDataFrame([(1, 1, "system", "s"), (1, 2, "user", "u"), (1, 3, "assistant", "a")], "conv_id int, turn int, role string, text string")
    say = lambda x: spark.createDataFrame([(1, x)], "conv_id int, content string")
    assert [r["content"] for r in P.prompt_messages(say("sys"), say("ctx"), history, say("ask")).orderBy("pos").collect()] == ["sys", "ctx", "u", "a", "ask"]


TS = "/** Checks. */\nimport { x } from './b';\nexport class AuthService extends BaseService implements A, B {\n  authenticate(token: string): boolean {\n    return validateToken(token);\n  }\n}\nexport function validateToken(t: string): boolean { return x(t); }\nconst arrow = (a) => a;\n"


def test_symbols(spark):
    rows = [("a.ts", "typescript", TS), ("b.py", "python", "class G(Base):\n    def hi(self, n) -> int:\n        '''Doc.'''\n        return len(n)\n"), ("c.tsx", "tsx", TS), ("d.py", "python", "def ("), ("e.py", "python", None)]
    source = spark.createDataFrame(rows, "path string, language string, content string")
    found = {(r["path"], r["name"]): r for r in Y.extract_symbols(source).collect()}
    assert {k for k in found if found[k]["type"] != "import"} == {("a.ts", "AuthService"), ("a.ts", "authenticate"), ("a.ts", "validateToken"), ("a.ts", "arrow"), ("b.py", "G"), ("b.py", "hi")}
    assert found["a.ts", "authenticate"]["parent_name"] == "AuthService" and found["a.ts", "validateToken"]["exported"] and found["b.py", "hi"]["documentation"] == "Doc." and found["b.py", "hi"]["parameters"] == ["self", "n"]
    references = {(r["kind"], r["source_name"], r["name"]) for r in Y.extract_references(source).collect()}
    assert {("extends", "AuthService", "BaseService"), ("implements", "AuthService", "B"), ("call", "authenticate", "validateToken"), ("call", "hi", "len"), ("extends", "G", "Base")} <= references
    assert {r["path"]: r["valid"] for r in Y.check_syntax(source).collect()} == {"a.ts": True, "b.py": True, "c.tsx": True, "d.py": False, "e.py": True}
    card = Y.extract_symbols(source).where("name = 'authenticate'").select(Y.symbol_card(F.lit("typescript"), F.array(F.lit("./b")), F.array().cast("array<string>"))).first()[0]
    assert card.startswith("# symbol function:method\nname: authenticate\n") and "parent: class AuthService" in card and "references" not in card


def test_edge_resolution(spark):
    source = spark.createDataFrame([("f1", "src/a.ts"), ("f2", "src/lib/b.ts"), ("f3", "src/c/index.ts")], "id string, path string")
    imports = spark.createDataFrame([("src/a.ts", "./lib/b"), ("src/a.ts", "./c"), ("src/a.ts", "react")], "path string, module string")
    found = {r["module"]: r["target"] for r in G.resolve_import_paths(imports, source).collect()}
    assert found == {"./lib/b": "src/lib/b.ts", "./c": "src/c/index.ts", "react": None}
    symbols = spark.createDataFrame([("s1", "p", "n", False, 1), ("s2", "p", "n", True, 2), ("s3", "p", "n", True, 3), ("s4", "p", "m", False, 4), ("s5", "p", "m", False, 5)], "id string, path string, name string, exported boolean, seq long")
    index = G.exported_index(symbols)
    assert {r["name"]: r["id"] for r in index.collect()} == {"n": "s3", "m": "s4"}
    nodes = spark.createDataFrame([("s1",), ("s3",)], "id string")
    edges = spark.createDataFrame([("s1", "hole", "calls", "p", "n"), ("s1", "hole2", "calls", "p", "zz"), ("gone", "s1", "calls", None, None)], "src string, dst string, type string, target_path string, symbol string")
    assert [(r["src"], r["dst"]) for r in G.resolve_edges(nodes, edges, index).collect()] == [("s1", "s3")]
    parents = spark.createDataFrame([("c", "x", "K", "class", 1, None, None), ("m", "x", "go", "function", 2, "K", "class")], "id string, path string, name string, type string, seq long, parent_name string, parent_type string")
    assert [(r["src"], r["dst"]) for r in G.parent_edges(parents).collect()] == [("c", "m")]
    wanted = spark.createDataFrame([("s1", "p", "n", "calls"), ("s4", "p", "m", "calls")], "src string, path string, name string, type string")
    assert {(r["src"], r["dst"]) for r in G.reference_targets(wanted, symbols).collect()} == {("s1", "s2"), ("s4", "s5")}
    calls = G.import_edges(source, spark.createDataFrame([("fn", "src/a.ts", "return go (1)")], "id string, path string, content string"), spark.createDataFrame([("src/a.ts", "src/lib/b.ts", ["go"])], "path string, target string, names array<string>"))
    assert sorted(r["type"] for r in calls.collect()) == ["calls", "imports", "references"]


def test_sources(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in {"src/a.ts": "import x\nexport y\nz", "src/b.txt": "no", "node_modules/c.ts": "no", ".hid/d.py": "no", "e.py": "pass"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    found = files.scan(spark, str(root))
    assert {(r["path"], r["language"], r["n_lines"]) for r in found.collect()} == {("src/a.ts", "typescript", 3), ("e.py", "python", 1)}
    nodes = files.file_nodes(found).where("name = 'a.ts'").first()
    assert nodes["embedding_text"] == "# file src/a.ts\n## imports\nimport x\n## exports\nexport y\n## header\nimport x\nexport y\nz"
    (tmp_path / "d.json").write_text('﻿{"name": "n", "family": "f", "variant": "v", "tasks": [{"id": "1", "query": "q", "groundTruth": ["a"]}]}', encoding="utf-8")
    assert datasets.read_dataset(spark, str(tmp_path / "d.json")).count() == 1
    (tmp_path / "e.json").write_text('{"name": "n", "tasks": []}')
    with pytest.raises(ValueError, match="tasks"):
        datasets.read_dataset(spark, str(tmp_path / "e.json"))
    items = spark.createDataFrame([(0, None, "q", ["a", "a"], ["b"]), (1, "id", "q", [], ["b", "b", "c"]), (60, "late", "q", ["a"], [])], "pos int, id string, query string, answers array<string>, files array<string>")
    assert {r["id"]: (r["target"], r["candidates"], r["truth"]) for r in datasets.convert_tasks(items).collect()} == {"rb-0": ("a", ["a", "b"], ["a"]), "id": ("b", ["b", "c"], ["b"])}
    assert datasets.read_usage(spark, str(tmp_path / "none")).isEmpty()
    datasets.track(spark, str(tmp_path / "log"), [(1, 10, 30, "m", "hybrid"), (5, 10, 10, "m", None)])
    log = datasets.read_usage(spark, str(tmp_path / "log"))
    assert E.usage_stats(log).first()["savings_percent"] == pytest.approx(100 * 40 / 60) and E.usage_stats(log, 2).first()["n_events"] == 1
    events = spark.createDataFrame([(1, ': hi\n\ndata: {"choices":[{"delta":{"content":"a"}}]}\ndata: oops\ndata: {"usage":{"prompt_tokens":3}}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"z"}}]}')], "response_id int, raw string")
    assert [(r["content"], r["usage"] and r["usage"]["prompt_tokens"]) for r in datasets.server_events(events).orderBy("pos").collect()] == [("a", None), (None, 3)]
    assert datasets.read_rules(spark, [str(tmp_path / "no.md")], "default") == "default"
    meta = one(spark, a="", b="oops", c='{"k": "v"}').select(store.parsed_metadata(F.col("a")), store.parsed_metadata(F.col("b")), store.parsed_metadata(F.col("c"))).first()
    assert tuple(meta) == ({}, {"value": "oops"}, {"k": "v"})
    cache = store.read_cache(spark, str(tmp_path / "cache"))
    nodes = spark.createDataFrame([(1, "text a", None), (2, "text b", [1.0])], "id int, content string, embedding array<double>")
    full, new = S.embed_missing(nodes, cache, lambda c: V.hashed_embedding(T.index_tokens(c), 8))
    assert {r["id"]: len(r["embedding"]) for r in full.collect()} == {1: 8, 2: 1}
    store.flush_cache(new, str(tmp_path / "cache"))
    assert store.read_cache(spark, str(tmp_path / "cache")).count() == 1
    summary = {"dataset": {"name": "n", "family": "f", "variant": "v"}, "tasks": [{"id": "1", "query": "q", "truth": ["a"], "iterations": 1, "pass": True, "metrics": {"precision": 0.5}}], "durationMs": 3, "aggregate": {"precision": 0.5}}
    assert "| precision | 0.5000 |" in datasets.report(summary)
    datasets.write_summary(str(tmp_path / "s.json"), summary)


def test_entropy_agrees(spark):
    text = "hello wörld, hello"
    want = -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))
    assert one(spark, a=text).select(T.char_entropy(F.col("a"))).first()[0] == pytest.approx(want)


@pytest.fixture(scope="module")
def pooled(spark):
    """The pools of the smallest tables, searched once."""
    search, found = catalog._pools, catalog._pools(spark, "/root/testdata/sf0.001")
    catalog._pools = lambda spark, d: found
    yield
    catalog._pools = search


@pytest.mark.parametrize("name", ["minmax_rerank", "recent_boost", "rrf_fusion", "search_mode", "seed_injection", "source_totals", "strict_filter"])
def test_pooled_queries_sort_no_pairs(spark, pooled, name):
    """Nothing in the query's plan pairs queries with all vectors; what is left to rank are the searches' first rows."""
    found = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not re.search("NestedLoopJoin|CartesianProduct", found._jdf.queryExecution().toString())
    assert found.count() > 0


@pytest.fixture
def bounded(monkeypatch):
    """Searches fail if a worker is handed rows of more than S.HANDED bytes, its last row aside."""
    most = 16 << 10

    def checked(make):
        def made(*args):
            run = make(*args)

            def seen(batches):
                for batch in batches:
                    assert batch.slice(0, max(batch.num_rows - 1, 0)).nbytes <= 1.5 * most
                    yield batch

            return lambda batches: run(seen(batches))

        return made

    monkeypatch.setattr(S, "HANDED", most, raising=False)
    for name in ("_to_entries", "_score_entries", "_nearest"):
        monkeypatch.setattr(S, name, checked(getattr(S, name)))


@pytest.mark.parametrize("name", ["recent_boost", "rrf_fusion", "search_mode", "seed_injection", "source_totals", "strict_filter"])
def test_pooled_queries_hand_small_batches(spark, bounded, name):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
