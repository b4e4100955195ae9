"""The overlay manager, context by meaning, benchmark runs, and small helpers of the rich graph build."""

import pytest
from pyspark.sql import functions as F

from tests.test_retrieval import EDGES, NODES, login  # noqa: F401
from weftline.functions import text as T
from weftline.operators import fusion as R
from weftline.operators import graph as G
from weftline.operators.manager import FileSnapshot, GraphManager, Hooks
from weftline.operators.retrieval import benchmark_run, build_context, semantic_context
from weftline.sources.store import MemoryStore


class Builder:
    """Builds the login graph; src/auth.ts has got a new symbol, src/ui.ts is gone."""

    def __init__(self, spark, graph):
        self.spark, self.graph, self.built = spark, graph, 0

    def build(self):
        self.built += 1
        return self.graph

    def snapshot(self, path):
        if path == "src/ui.ts":
            return None
        nodes = lambda rows: self.spark.createDataFrame(rows, NODES)
        edges = self.spark.createDataFrame([("f_auth", "authUser", "contains", None, None), ("f_auth", "added", "contains", None, None), ("added", "?", "calls", "src/login.ts", "handleLogin"), ("added", "??", "calls", "src/none.ts", "x")], "src string, dst string, type string, target_path string, symbol string")
        return FileSnapshot(nodes([("f_auth", "file", "auth.ts", path, "", 1, 30, None, 0)]), nodes([("authUser", "function", "authenticateUser", path, "now", 5, 15, True, 1), ("added", "function", "added", path, "handleLogin()", 20, 25, True, 2)]), edges)


def links(graph):
    return {(r["src"], r["dst"], r["type"]) for r in graph.edges.collect()}


def test_manager(spark, login):  # noqa: F811
    said = []
    hooks = Hooks(lambda i: said.append("created"), lambda i: said.append("updated"), lambda i, log, g: said.append(("committed", len(log))), lambda i: said.append("discarded"))
    builder, store = Builder(spark, login), MemoryStore()
    manager = GraphManager(store, builder, hooks)
    with pytest.raises(RuntimeError):
        manager.current()
    assert manager.initialize()[1] == "build" and manager.initialize()[1] == "store" and manager.initialize(force=True)[1] == "build"
    assert manager.pending is None and manager.current() is manager.base
    view = manager.record("src/auth.ts")
    assert {r["id"] for r in view.nodes.collect()} == {"f_auth", "authUser", "added", "f_login", "login", "f_ui", "render"}
    # edges of other files to the recorded one are lost until the next rebuild
    assert links(view) == {("f_auth", "authUser", "contains"), ("f_auth", "added", "contains"), ("added", "login", "calls"), ("f_login", "login", "contains"), ("f_ui", "render", "contains"), ("f_ui", "f_login", "imports"), ("render", "login", "calls")}
    assert manager.current() is view and manager.pending is not None
    view = manager.record("src/ui.ts")
    assert "render" not in {r["id"] for r in view.nodes.collect()} and len(links(view)) == 4
    assert manager.record("src/auth.ts").nodes.count() == 5
    built = builder.built
    assert manager.merge() is login and builder.built == built + 1 and manager.pending is None
    assert manager.merge() is login and builder.built == built + 1
    manager.record("src/ui.ts")
    assert manager.discard() is login and manager.current() is login
    manager.clear()
    assert store.load() is None
    # 3 + 3 rows gone, 3 nodes and 3 edges new, and the overlay's own line
    assert said == ["created", "updated", "updated", "updated", ("committed", 12), "created", "updated", "discarded"]


def test_semantic_context(spark, login):  # noqa: F811
    queries = spark.createDataFrame([(1, "refine authenticateUser flow"), (2, "render"), (3, "logoutUser")], "query_id int, query string")
    exclude = spark.createDataFrame([(1, "authUser")], "query_id int, id string")
    vectors = spark.createDataFrame([("logout", [1.0, 0.0]), ("login", [0.6, 0.8]), ("render", [0.0, 1.0]), ("f_ui", [1.0, 1.0])], "id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.1])], "query_id int, embedding array<float>")
    found = {}
    for r in semantic_context(queries, login.nodes, login.edges, (vectors, asked), exclude, 2, 6).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    assert found[1] == ["logout", "login"]  # near enough: by embedding alone
    assert found[2][0] == "render"  # far: the text search has its say
    assert found[3][0] == "logout"  # no embedding at all
    assert all(not x.startswith("f_") for x in found[1] + found[2][:1] + found[3][:1])
    alone = semantic_context(queries, login.nodes, login.edges, None, exclude, 3)
    assert alone.groupBy("query_id").count().where("count > 3").isEmpty()
    targets = spark.createDataFrame([(1, "authUser")], "query_id int, id string")
    row = build_context(targets, login.nodes, login.edges, semantic=spark.createDataFrame([(1, "logout", 1)], "query_id int, id string, rank int")).first()
    assert "logoutUser" in row["context"] and row["n_related"] == 2


def test_benchmark_run(spark, login):  # noqa: F811
    tasks = spark.createDataFrame([(1, "refine authenticateUser flow", ["src/auth.ts", "src/login.ts"]), (2, "renderLogin view", ["src/none.ts", "src/auth.ts"])], "query_id int, query string, truth array<string>")
    rows, means = benchmark_run(tasks, login.nodes, login.edges)
    by = {r["query_id"]: r for r in rows.collect()}
    assert by[1]["pass"] and by[1]["iterations"] == 1 and by[1]["recall"] == 1.0 and by[1]["exact"] == 1.0
    assert not by[2]["pass"] and by[2]["iterations"] == 2
    assert means.first()["recall"] == pytest.approx((by[1]["recall"] + by[2]["recall"]) / 2)


def test_strict_match(spark):
    rows = [(1, "fix src/a.ts", "src/a.ts", 0.0, None, None), (1, "fix src/a.ts", "src/b.ts", 0.1, None, None), (2, "x", "src/c.ts", 0.3, None, None), (2, "x", "src/d.ts", 0.0, 1.0, None), (2, "x", "src/e.ts", 0.0, None, 0.5), (2, "x", "src/f.ts", 0.0, None, 0.4), (3, "x", "src/g.ts", 0.0, None, None)]
    found = spark.createDataFrame(rows, "query_id int, query string, path string, max_lexical double, seed double, max_cross double")
    kept = R.strict_filter(found, R.strict_match(found, 0.25, 0.45))
    assert {r["path"] for r in kept.collect()} == {"src/a.ts", "src/c.ts", "src/d.ts", "src/e.ts", "src/g.ts"}


def test_summaries(spark):
    row = spark.createDataFrame([(["import { a, b } from './x'", "import './y'", "import c from \"z\"", "import { a, b } from './x'"],)], "s array<string>").select(T.import_summary(F.col("s"))).first()
    assert row[0] == ["./x: a, b", "unknown", "z: c"]
    refs = spark.createDataFrame([("p", 1, 5, "calls", "f", None, 0), ("p", 1, 5, "calls", "f", "./m", 1), ("p", 1, 5, "extends", "B", "", 2), ("p", 6, 7, "calls", "g", None, 3)], "path string, start int, end int, kind string, name string, module string, seq int")
    assert {(r["start"], tuple(r["tags"])) for r in G.references_by_range(refs).collect()} == {(1, ("calls:f", "module:./m", "extends:B")), (6, ("calls:g",))}
