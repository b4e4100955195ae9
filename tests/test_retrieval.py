"""The login graph: seven nodes, eight edges, and what is known of its retrieval."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import search as S
from weftline.operators.retrieval import build_context, resolve_targets, target_nodes
from weftline.sources.files import from_json, to_json
from weftline.sources.store import MemoryStore, SnapshotStore, open_store
from weftline.operators.graph import Graph

NODES = "id string, type string, name string, path string, content string, start_line int, end_line int, exported boolean, seq long"
EDGES = "id string, src string, dst string, type string, seq long"


@pytest.fixture(scope="module")
def login(spark):
    nodes = [
        ("f_auth", "file", "auth.ts", "src/auth.ts", "", 1, 20, None), ("authUser", "function", "authenticateUser", "src/auth.ts", "export function authenticateUser(email, password) { ... }", 5, 15, True),
        ("logout", "function", "logoutUser", "src/auth.ts", "export function logoutUser() { /* ... */ }", 16, 22, True), ("f_login", "file", "login.ts", "src/login.ts", "", 1, 30, None),
        ("login", "function", "handleLogin", "src/login.ts", "function handleLogin() { authenticateUser(...) }", 10, 20, None), ("f_ui", "file", "ui.ts", "src/ui.ts", "", 1, 25, None),
        ("render", "function", "renderLogin", "src/ui.ts", "export function renderLogin() { return handleLogin(); }", 4, 12, True),
    ]
    edges = [("f_auth", "authUser", "contains"), ("f_auth", "logout", "contains"), ("f_login", "login", "contains"), ("f_ui", "render", "contains"), ("f_login", "f_auth", "imports"), ("f_ui", "f_login", "imports"), ("login", "authUser", "calls"), ("render", "login", "calls")]
    return Graph(spark.createDataFrame([(*n, k) for k, n in enumerate(nodes)], NODES), spark.createDataFrame([(f"e{k}", *e, k) for k, e in enumerate(edges)], EDGES))


def asked(spark, text="refine authenticateUser flow"):
    return spark.createDataFrame([(1, text)], "query_id int, query string")


def test_golden_bm25(spark, login):
    docs = login.nodes.where("content <> ''").select("id", "content")
    found = {r["id"]: r["score"] for r in S.bm25(docs, asked(spark)).collect()}
    assert found["authUser"] == pytest.approx(0.6230536454471418, abs=1e-12)
    assert sum(found.values()) == pytest.approx(1.4040645531203197, abs=1e-12)


def test_golden_targets(spark, login):
    recent = spark.createDataFrame([(1, "src/auth.ts")], "query_id int, path string")
    found = resolve_targets(asked(spark), login.nodes, recent=recent).orderBy("rank").collect()
    assert [r["path"] for r in found] == ["src/auth.ts", "src/login.ts"]
    assert found[0]["bm25"] == pytest.approx(0.6230536454471418)
    assert len(found[0]["reasons"]) == len(set(found[0]["reasons"])) <= 6


def test_golden_context(spark, login):
    targets = spark.createDataFrame([(1, "authUser")], "query_id int, id string")
    row = build_context(targets, login.nodes, login.edges).first()
    assert (row["used"], row["n_target"], row["n_backward"], row["n_forward"], row["n_related"]) == (173, 1, 2, 0, 2)
    assert row["context"].index("# TARGET CODE") < row["context"].index("# DEPENDENTS") < row["context"].index("# RELATED CONTEXT")


def test_target_nodes(spark, login):
    queries = asked(spark).withColumn("path", F.lit("src/auth.ts"))
    assert {r["id"] for r in target_nodes(queries, login.nodes).collect()} == {"authUser"}
    vague = asked(spark, "zzz").withColumn("path", F.lit("src/auth.ts"))
    assert {r["id"] for r in target_nodes(vague, login.nodes).collect()} == {"authUser", "logout"}


def test_json_and_stores(spark, login, tmp_path):
    again = from_json(to_json(login), NODES, EDGES)
    assert sorted(again.nodes.collect()) == sorted(login.nodes.collect()) and again.edges.count() == 8
    memory = open_store()
    assert isinstance(memory, MemoryStore) and memory.load() is None
    memory.save(login)
    assert memory.load().nodes.count() == 7
    store = SnapshotStore(spark, str(tmp_path), "a")
    assert store.load() is None
    store.save(login)
    store.save(login.remove_path("src/ui.ts"))
    assert store.load().nodes.count() == 5 and store.load().edges.count() == 5
    assert [r["valid_to"] is None for r in store.versions().orderBy("valid_from").collect()] == [False, True]
    assert SnapshotStore(spark, str(tmp_path), "b").load() is None
    store.clear()
    assert store.load() is None


def test_no_answer_no_seeds(spark, login):
    seeds = spark.createDataFrame([(1, "src/ui.ts")], "query_id int, path string")
    assert resolve_targets(asked(spark, "qqq"), login.nodes, seeds=seeds).isEmpty()
    found = resolve_targets(asked(spark), login.nodes, seeds=seeds).collect()
    assert {r["path"]: r["score"] for r in found}["src/ui.ts"] == 5.0
