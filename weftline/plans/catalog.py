"""Queries over the supplied tables, one or more per operator, each with the SQL that checks it where SQL can.

Documents are nodes of text (path: their source), benchmark items are queries, embeddings are vectors, and the trade
tables are a property graph: region and nation contain, customers call orders, orders reference parts and import suppliers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vectors as V
from weftline.operators import context as C
from weftline.operators import evaluation as E
from weftline.operators import fusion as R
from weftline.operators import graph as G
from weftline.operators import parsing as P
from weftline.operators import search as S
from weftline.operators import traversal as W
from weftline.sources.tables import cut, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("path"))


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


# --- lexical search -------------------------------------------------------------------------------------------------

#: Length in UTF-16 units: code points, and one more for each beyond the basic plane.
UTF16 = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
TOKENS_A = "list_filter(string_split_regex(lower({0}), '[^a-z0-9_]+'), lambda x: x <> '')"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
TOKENS_B = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND NOT list_contains(" + STOP + ", x))"


def _bm25_sql(queries: str) -> str:
    """scored(query_id, id, score): rounded scores above 0 for `queries` (query_id, query)."""
    return f"""
asked AS ({queries}),
d AS (SELECT doc_id, {TOKENS_A.format('text')} AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS_A.format('query')}) AS term FROM asked) GROUP BY ALL),
scored AS (SELECT query_id, doc_id AS id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL HAVING score > 0)"""


ASKED_SQL = "SELECT item_id AS query_id, text AS query FROM benchmark"


@query(f"WITH {_bm25_sql(ASKED_SQL)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 5")
def bm25_topk(spark, d):
    return S.bm25(_docs(spark, d), _asked(spark, d), 5, 6).select("query_id", "id", "score", "rank")


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_A.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_df(spark, d):
    return S.postings(_docs(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


@query(f"SELECT lang, count(*) AS n_docs, sum(len({TOKENS_A.format('text')}))::BIGINT AS n_index, sum(len({TOKENS_B.format('text')}))::BIGINT AS n_search, sum(ceil({UTF16.format('text')} / 4.0))::BIGINT AS n_tokens FROM documents GROUP BY lang")
def tokenize_stats(spark, d):
    docs = table(spark, d, "documents")
    size = lambda x: F.sum(F.size(x).cast("long"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), size(T.index_tokens(F.col("text"))).alias("n_index"), size(T.search_tokens(F.col("text"))).alias("n_search"), F.sum(T.token_count(F.col("text"))).alias("n_tokens"))


@query(f"""
WITH d AS (SELECT doc_id AS id, {TOKENS_B.format('text')} AS w FROM documents), asked AS (SELECT item_id AS query_id, {TOKENS_B.format('text')} AS qw FROM benchmark),
n AS (SELECT count(*) AS n FROM d), tf AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(w) AS l, unnest(w) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query_id, nq, term, count(*) AS times FROM (SELECT query_id, len(qw) AS nq, unnest(qw) AS term FROM asked) GROUP BY ALL),
s AS (SELECT query_id, id, round(least(1.0::DOUBLE, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * l / 100.0))) / (5.0 * nq)), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY query_id, id, nq),
e AS (SELECT query_id, id, CASE WHEN len(qw) = 0 THEN 0.5::DOUBLE ELSE coalesce(score, 0) END AS score FROM asked CROSS JOIN d LEFT JOIN s USING (query_id, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM e)
SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def text_search_topk(spark, d):
    return S.text_search(_docs(spark, d), _asked(spark, d), 5, 6).select("query_id", "id", "score", "rank")


@query("""WITH w AS (SELECT DISTINCT lower(p_brand) AS word FROM part), t AS (SELECT DISTINCT lower(p_brand) AS target FROM part)
SELECT word, target, levenshtein(word, target)::INT AS distance FROM w, t WHERE abs(length(word) - length(target)) <= 2 AND levenshtein(word, target) <= 2""")
def fuzzy_brands(spark, d):
    words = table(spark, d, "part").select(F.lower("p_brand").alias("word")).distinct()
    return S.fuzzy(words, words.toDF("target")).select("word", "target", F.levenshtein("word", "target").alias("distance"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'apache license')")
def phrase_filter(spark, d):
    return table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("apache license"))).select("doc_id")


# --- vectors --------------------------------------------------------------------------------------------------------

_COSINE = """
v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), vq AS (SELECT id AS query_id, label AS query_label, e AS f FROM v WHERE id % 100 = 0),
scored AS (SELECT query_id, query_label, id, label, round(list_cosine_similarity(e, f), 6) AS score FROM v CROSS JOIN vq),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)"""


def _near(spark, d, k):
    v = _vectors(spark, d)
    return S.cosine_top_k(v, v.where("id % 100 = 0").withColumnRenamed("id", "query_id"), k, 6)


@query(f"WITH {_COSINE} SELECT query_id, id, score, rank::INT AS rank FROM near WHERE rank <= 10")
def cosine_topk(spark, d):
    return _near(spark, d, 10)


@query("SELECT label, count(*) AS n, max(len(embedding))::INT AS dimensions, round(avg(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 6) AS mean_norm FROM embeddings GROUP BY label")
def vector_norm_stats(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dimensions"), F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("mean_norm"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))))), 6) AS unit_sum FROM embeddings")
def unit_vectors(spark, d):
    unit = V.unit(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("unit_sum"))


_AT_K = f"""{_COSINE}, truth AS (SELECT query_id, count(*) AS n_true FROM vq JOIN v ON v.label = vq.query_label GROUP BY query_id),
m AS (SELECT query_id, sum((label = query_label)::INT) / 10.0::DOUBLE AS p, sum((label = query_label)::INT) / any_value(n_true)::DOUBLE AS r FROM near JOIN truth USING (query_id) WHERE rank <= 10 GROUP BY query_id),
metrics AS (SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM m)"""


def _metrics(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    truth = asked.join(e.select("label", F.col("vec_id").alias("item")), "label").select("query_id", "item")
    found = E.at_k(_near(spark, d, 10).withColumnRenamed("id", "item"), truth, 10)
    return found.select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {_AT_K} SELECT query_id, precision, recall, f1 FROM metrics")
def label_precision_at_k(spark, d):
    return _metrics(spark, d)


@query(f"WITH {_AT_K} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM metrics")
def macro_avg(spark, d):
    out = E.macro_average(_metrics(spark, d), ("precision", "recall", "f1"))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"""WITH {_AT_K}, a AS (SELECT query_id, CASE WHEN precision < 0.6 THEN ['enable_cross_encoder', 'increase_walk_depth', 'expand_related'] ELSE [] END AS x, CASE WHEN precision < 0.4 THEN ['increase_token_budget'] ELSE [] END AS y,
CASE WHEN recall < 0.6 AND precision >= 0.6 THEN ['increase_walk_depth', 'expand_related'] ELSE [] END AS z, precision >= 0.6 AND recall >= 0.6 AS pass FROM metrics)
SELECT query_id, array_to_string(x || y || z, ',') AS actions, pass FROM a""")
def eval_actions(spark, d):
    found = E.actions(F.col("precision"), F.col("recall"), F.lit(0.5))
    return _metrics(spark, d).select("query_id", F.array_join(found, ",").alias("actions"), ((F.col("precision") >= 0.6) & (F.col("recall") >= 0.6)).alias("pass"))


# --- fusion, reranking, paths ---------------------------------------------------------------------------------------

_POOLS = f"""{_COSINE}, {_bm25_sql('SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)').replace('scored AS', 'lexical_scores AS')},
ann AS (SELECT query_id, id, score, rank FROM near WHERE rank <= 20),
lexical AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lexical_scores) WHERE rank <= 20)"""
_FUSED = f"""{_POOLS}, pool AS (SELECT *, 'ANN' AS source FROM ann UNION ALL SELECT *, 'BM25' FROM lexical),
summed AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS fused, max(rank) FILTER (source = 'ANN') AS ann_rank, max(rank) FILTER (source = 'BM25') AS bm25_rank, max(score) FILTER (source = 'ANN') AS ann, max(score) FILTER (source = 'BM25') AS bm25 FROM pool GROUP BY query_id, id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, ann_rank NULLS LAST, bm25_rank) AS rank FROM summed) WHERE rank <= 15)"""


def _pools(spark, d):
    ann = _near(spark, d, 20)
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    asked = _docs(spark, d).where("id % 100 = 0").join(ids, "id", "left_semi").select(F.col("id").alias("query_id"), F.col("content").alias("query"))
    return ann, S.bm25(_docs(spark, d), asked, 20, 6)


def _fused(spark, d):
    return R.reciprocal_rank_fusion(R.candidate_pool(*_pools(spark, d)), 15)


@query(f"WITH {_FUSED} SELECT query_id, id, round(fused, 9) AS fused, rank::INT AS rank FROM fused")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("query_id", "id", F.round("fused", 9).alias("fused"), "rank")


_RERANK = f"""{_FUSED}, signals AS (SELECT query_id, f.id, source AS path, coalesce(ann, 0) AS semantic, coalesce(bm25, 0) AS lexical, 0.7 * (lang = 'en')::INT + 0.3 / ln(len(string_split(text, chr(10))) + 1.0::DOUBLE) AS structural, fused, ann, bm25 FROM fused AS f JOIN documents ON doc_id = f.id),
bounds AS (SELECT query_id, min(semantic) AS a0, max(semantic) AS a1, min(lexical) AS b0, max(lexical) AS b1, min(structural) AS c0, max(structural) AS c1 FROM signals GROUP BY query_id),
normal AS (SELECT query_id, id, path, fused, ann, bm25, CASE WHEN a0 = a1 THEN 1.0::DOUBLE ELSE (semantic - a0) / (a1 - a0) END AS semantic, CASE WHEN b0 = b1 THEN 1.0::DOUBLE ELSE (lexical - b0) / (b1 - b0) END AS lexical, CASE WHEN c0 = c1 THEN 1.0::DOUBLE ELSE (structural - c0) / (c1 - c0) END AS structural FROM signals JOIN bounds USING (query_id)),
blended AS (SELECT *, round(0.5 * semantic + 0.3 * lexical + 0.2 * structural, 6) AS score FROM normal),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM blended) WHERE rank <= 10)"""


def _reranked(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), R.structural_signal(F.col("lang") == "en", F.size(F.split("text", "\n", -1))).alias("structural"))
    signals = _fused(spark, d).drop("rank").join(docs, "id").select("query_id", "id", "path", F.col("ann").alias("semantic"), F.col("bm25").alias("lexical"), "structural", "fused", "ann", "bm25")
    out = R.rerank(signals, 15).drop("rank").withColumn("score", F.round("score", 6))
    return S.top_k(out, ["query_id"], [F.desc("score"), F.asc("id")], 10)


@query(f"WITH {_RERANK} SELECT query_id, id, score, rank::INT AS rank FROM reranked")
def minmax_rerank(spark, d):
    return _reranked(spark, d).select("query_id", "id", "score", "rank")


_PATHS = f"""{_RERANK}, paths AS (SELECT query_id, path, count(*) AS n_nodes, sum(score) AS score, max(lexical) AS max_lexical, sum(ann) AS ann, sum(bm25) AS bm25 FROM reranked GROUP BY query_id, path)"""


@query(f"WITH {_PATHS} SELECT query_id, path, n_nodes, round(score, 6) AS score, round(max_lexical, 6) AS max_lexical, round(ann, 6) AS ann, round(bm25, 6) AS bm25 FROM paths")
def path_grouping(spark, d):
    found = R.group_by_path(_reranked(spark, d))
    return found.select("query_id", "path", "n_nodes", *(F.round(c, 6).alias(c) for c in ("score", "max_lexical", "ann", "bm25")))


@query(f"WITH {_PATHS}, recent AS (SELECT doc_id AS query_id, source AS path FROM documents WHERE doc_id % 100 = 0) SELECT p.query_id, p.path, round(score + (r.path IS NOT NULL)::INT, 6) AS score FROM paths AS p LEFT JOIN recent AS r ON p.query_id = r.query_id AND p.path = r.path")
def recent_boost(spark, d):
    recent = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("source").alias("path"))
    return R.recent_boost(R.group_by_path(_reranked(spark, d)), recent).select("query_id", "path", F.round("score", 6).alias("score"))


@query(f"""WITH {_PATHS}, seeds AS (SELECT doc_id AS query_id, source AS path FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)), known AS (SELECT source AS path, least(count(*), 3) AS n FROM documents GROUP BY source)
SELECT query_id, path, n_nodes::BIGINT AS n_nodes, round(score, 6) AS score FROM paths UNION ALL
SELECT query_id, path, n::BIGINT, 5.0::DOUBLE FROM seeds JOIN known USING (path) WHERE (query_id, path) NOT IN (SELECT (query_id, path) FROM paths)""")
def seed_injection(spark, d):
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    seeds = table(spark, d, "documents").where("doc_id % 100 = 0").join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), F.col("source").alias("path"))
    out = R.inject_seeds(R.group_by_path(_reranked(spark, d)), seeds, _docs(spark, d))
    return out.select("query_id", "path", F.col("n_nodes").cast("long").alias("n_nodes"), F.round("score", 6).alias("score"))


@query(f"WITH {_PATHS} SELECT query_id, 'ANN' AS source, round(sum(ann), 6) AS total FROM paths WHERE ann IS NOT NULL GROUP BY query_id UNION ALL SELECT query_id, 'BM25', round(sum(bm25), 6) FROM paths WHERE bm25 IS NOT NULL GROUP BY query_id")
def source_totals(spark, d):
    return R.source_totals(R.group_by_path(_reranked(spark, d))).withColumn("total", F.round("total", 6))


@query(f"""WITH {_PATHS}, j AS (SELECT *, max_lexical >= 0.25 OR bm25 IS NULL AS ok FROM paths), k AS (SELECT *, max(ok::INT) OVER (PARTITION BY query_id) AS any_ok FROM j) SELECT query_id, path FROM k WHERE ok OR any_ok = 0""")
def strict_filter(spark, d):
    return R.strict_filter(R.group_by_path(_reranked(spark, d)), (F.col("max_lexical") >= 0.25) | F.col("bm25").isNull()).select("query_id", "path")


@query(f"WITH {_POOLS} SELECT query_id, id, round(sum(part), 6) AS score FROM (SELECT query_id, id, 0.6::DOUBLE * score AS part FROM ann UNION ALL SELECT query_id, id, 0.4::DOUBLE * score FROM lexical) GROUP BY query_id, id")
def weighted_merge(spark, d):
    return R.weighted_merge(*_pools(spark, d)).withColumn("score", F.round("score", 6))


@query(f"""WITH {_POOLS}, a AS (SELECT query_id, max(score) AS e FROM ann GROUP BY query_id), b AS (SELECT query_id, max(score) / 100 AS t FROM lexical GROUP BY query_id)
SELECT query_id, CASE WHEN e >= 0.6 THEN 'embedding' WHEN t > 0.8 * e THEN 'hybrid' ELSE 'embedding' END AS mode FROM a JOIN b USING (query_id)""")
def search_mode(spark, d):
    ann, lexical = _pools(spark, d)
    a, b = ann.groupBy("query_id").agg(F.max("score").alias("e")), lexical.groupBy("query_id").agg((F.max("score") / 100).alias("t"))
    return a.join(b, "query_id").select("query_id", R.search_mode(F.col("e"), F.col("t")).alias("mode"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(auth|token|device|login|oauth)\\b') THEN 2.0::DOUBLE ELSE 0 END AS auth, CASE WHEN regexp_matches(lower(text), '\\btest|spec|jest|vitest\\b') THEN 1.5::DOUBLE ELSE 0 END AS tests FROM conversations""")
def intent_boost(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", R.intent_boost(F.col("text"), F.lit("src/auth/login.ts")).alias("auth"), R.intent_boost(F.col("text"), F.lit("tests/unit.ts")).alias("tests"))


# --- graph ----------------------------------------------------------------------------------------------------------

_NODES = """nodes AS (
SELECT 'r:' || r_regionkey AS id, 'region' AS type, r_name AS name, 'region' AS path FROM region UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name, 'nation/' || n_regionkey FROM nation
UNION ALL SELECT 'c:' || c_custkey, 'customer', c_name, 'customer/' || c_nationkey FROM customer UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name, 'supplier/' || s_nationkey FROM supplier
UNION ALL SELECT 'o:' || o_orderkey, 'order', o_orderstatus, 'order/' || o_orderpriority FROM orders UNION ALL SELECT 'p:' || p_partkey, 'part', p_name, 'part/' || p_brand FROM part)"""
_EDGES = """edges AS (
SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'contains' AS type FROM nation UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'contains' FROM customer
UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'contains' FROM supplier UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'calls' FROM orders
UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'references' FROM lineitem UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 's:' || l_suppkey, 'imports' FROM lineitem)"""


def trade_graph(spark: SparkSession, d: str) -> G.Graph:
    t = lambda name: table(spark, d, name)
    node = lambda df, mark, key, kind, name, path: df.select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), path.alias("path"))
    under = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c).cast("string"))
    nodes = node(t("region"), "r:", "r_regionkey", "region", "r_name", F.lit("region"))
    for args in (("nation", "n:", "n_nationkey", "nation", "n_name", "n_regionkey"), ("customer", "c:", "c_custkey", "customer", "c_name", "c_nationkey"), ("supplier", "s:", "s_suppkey", "supplier", "s_name", "s_nationkey"), ("orders", "o:", "o_orderkey", "order", "o_orderstatus", "o_orderpriority"), ("part", "p:", "p_partkey", "part", "p_name", "p_brand")):
        nodes = nodes.union(node(t(args[0]), *args[1:5], under(args[3], args[5])))
    edge = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(kind).alias("type"))
    edges = edge(t("nation"), "r:", "n_regionkey", "n:", "n_nationkey", "contains").union(edge(t("customer"), "n:", "c_nationkey", "c:", "c_custkey", "contains"))
    edges = edges.union(edge(t("supplier"), "n:", "s_nationkey", "s:", "s_suppkey", "contains")).union(edge(t("orders"), "c:", "o_custkey", "o:", "o_orderkey", "calls"))
    lines = t("lineitem")
    edges = edges.union(edge(lines.select("l_orderkey", "l_partkey").distinct(), "o:", "l_orderkey", "p:", "l_partkey", "references")).union(edge(lines.select("l_orderkey", "l_suppkey").distinct(), "o:", "l_orderkey", "s:", "l_suppkey", "imports"))
    return G.Graph(nodes, edges.withColumn("id", G.edge_id(F.col("src"), F.col("dst"), F.col("type"))).withColumn("seq", F.xxhash64("id")))


@query(f"WITH {_NODES}, {_EDGES} SELECT e.type AS edge_type, n.type AS node_type, count(*) AS n FROM edges AS e JOIN nodes AS n ON e.dst = n.id GROUP BY ALL")
def neighbors(spark, d):
    return trade_graph(spark, d).neighbors().groupBy("edge_type", F.col("type").alias("node_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EDGES} SELECT src, type, count(*) AS n, sha1(min('edge:' || src || ':' || dst || ':' || type)) AS first_edge FROM edges WHERE type <> 'references' AND type <> 'imports' GROUP BY ALL")
def outgoing_edges(spark, d):
    edges = trade_graph(spark, d).edges.where(F.col("type").isin("contains", "calls"))
    return edges.groupBy("src", "type").agg(F.count(F.lit(1)).alias("n"), F.sha1(F.min(F.concat_ws(":", F.lit("edge"), "src", "dst", "type"))).alias("first_edge"))


def _walk_sql(sources: str, depth: int, types: str = "true", a: str = "src", b: str = "dst") -> str:
    return f"""WITH RECURSIVE {_NODES}, {_EDGES}, links AS (SELECT DISTINCT {a} AS a, {b} AS b FROM edges WHERE {types}),
w AS (SELECT id AS source, id, 0 AS depth FROM nodes WHERE {sources} UNION SELECT source, b, depth + 1 FROM w JOIN links ON w.id = links.a WHERE depth < {depth})
SELECT source, id, min(depth)::INT AS depth FROM w GROUP BY source, id"""


@query(_walk_sql("type = 'customer' AND substr(id, 3)::BIGINT % 100 = 0", 3))
def khop_forward(spark, d):
    g = trade_graph(spark, d)
    starts = table(spark, d, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"))
    return W.walk(starts.select(F.col("id").alias("source"), "id"), g.edges, 3)


@query(_walk_sql("type = 'part' AND substr(id, 3)::BIGINT % 100 = 0", 2, "type IN ('imports', 'calls', 'references')", "dst", "src"))
def khop_backward(spark, d):
    g = trade_graph(spark, d)
    starts = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"))
    return W.walk(starts.select(F.col("id").alias("source"), "id"), g.edges, 2, W.DEPENDENCIES, backward=True)


@query(f"SELECT source, count(*) AS n, max(depth)::INT AS deepest FROM ({_walk_sql(chr(116) + 'ype = ' + chr(39) + 'region' + chr(39), 9)}) GROUP BY source")
def reachability(spark, d):
    g = trade_graph(spark, d)
    starts = g.nodes.where("type = 'region'").select(F.col("id").alias("source"), "id")
    return W.walk(starts, g.edges).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"))


@query(f"SELECT source, id AS target, depth + 1 AS n_nodes FROM ({_walk_sql('type = ' + chr(39) + 'nation' + chr(39), 4)}) WHERE id LIKE 'p:%' AND substr(id, 3)::BIGINT % 100 = 0")
def shortest_path_len(spark, d):
    g = trade_graph(spark, d)
    ends = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("target"))
    pairs = g.nodes.where("type = 'nation'").select(F.col("id").alias("source")).crossJoin(S.small_side(ends))
    return W.shortest_paths(pairs, g.edges).select("source", "target", F.size("path").alias("n_nodes"))


@query()
def dfs_khop(spark, d):
    g = trade_graph(spark, d)
    starts = table(spark, d, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"))
    return W.depth_first(starts.select(F.col("id").alias("source"), "id"), g.edges, 2)


@query(f"WITH {_NODES} SELECT id, CASE WHEN type = 'nation' THEN lower(name) ELSE name END AS name FROM nodes")
def upsert_nodes(spark, d):
    g = trade_graph(spark, d)
    old = G.Graph(g.nodes.withColumn("seq", F.lit(0)), g.edges)
    return old.upsert_nodes(old.nodes.where("type = 'nation'").withColumns({"name": F.lower("name"), "seq": F.lit(1)})).nodes.select("id", "name")


@query(f"WITH {_NODES}, {_EDGES}, gone AS (SELECT id FROM nodes WHERE path LIKE 'nation/%') SELECT type, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY type")
def cascade_delete(spark, d):
    g = trade_graph(spark, d)
    return g.remove_nodes(g.nodes.where("path like 'nation/%'")).edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_NODES}, {_EDGES}, kept AS (SELECT id FROM nodes WHERE type <> 'supplier') SELECT type, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM kept) OR dst NOT IN (SELECT id FROM kept) GROUP BY type")
def dangling_edges(spark, d):
    g = trade_graph(spark, d)
    return G.Graph(g.nodes.where("type <> 'supplier'"), g.edges).dangling(g.edges).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_NODES}, {_EDGES}, gone AS (SELECT id FROM nodes WHERE type = 'supplier' AND substr(id, 3)::BIGINT % 10 = 0), kept AS (SELECT id FROM nodes WHERE type <> 'supplier' UNION ALL SELECT id FROM nodes WHERE type = 'supplier')
SELECT type, count(*) AS n FROM (SELECT src, dst, type FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) UNION ALL SELECT 'r:0', id, 'contains' FROM gone) GROUP BY type""")
def overlay_apply(spark, d):
    """Every tenth supplier is removed, which takes its edges, then added again, with one new edge."""
    g = trade_graph(spark, d)
    some = g.nodes.where("type = 'supplier' and cast(substr(id, 3) as bigint) % 10 = 0")
    none = F.lit(None).cast("string")
    op = lambda k, name: some.select(F.lit(k).cast("long").alias("op_seq"), F.lit(name).alias("op"), "id", none.alias("src"), none.alias("dst"), "type", "name", "path")
    link = some.select(F.lit(3).cast("long").alias("op_seq"), F.lit("add_edge").alias("op"), F.concat(F.lit("new:"), "id").alias("id"), F.lit("r:0").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("type"), none.alias("name"), none.alias("path"))
    return G.apply_overlay(g, op(1, "remove_node").union(op(2, "add_node")).union(link)).edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT 'n:' || n_nationkey AS id, n_regionkey, n_name, n_nationkey, n_name LIKE '%A%' AS exported FROM nation), f AS (SELECT n_regionkey, n_name AS name, min(n_nationkey) AS k FROM t GROUP BY ALL)
SELECT 'nation/' || n_regionkey AS path, name, 'n:' || k AS id FROM f""")
def exported_index(spark, d):
    rows = table(spark, d, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("nation/"), F.col("n_regionkey").cast("string")).alias("path"), F.col("n_name").alias("name"), F.col("n_name").contains("A").alias("exported"), F.col("n_nationkey").alias("seq"))
    return G.exported_index(rows)


# --- context --------------------------------------------------------------------------------------------------------

_LINES = "SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS pos, l_partkey AS id, l_quantity, l_returnflag, CASE l_returnflag WHEN 'A' THEN 'target' WHEN 'R' THEN 'forward' ELSE CASE l_linestatus WHEN 'O' THEN 'backward' ELSE 'related' END END AS category FROM lineitem"


def _lines(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # line numbers repeat
    flag = F.col("l_returnflag")
    category = F.when(flag == "A", "target").when(flag == "R", "forward").when(F.col("l_linestatus") == "O", "backward").otherwise("related")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.row_number().over(order).alias("pos"), F.col("l_partkey").alias("id"), "l_quantity", "l_returnflag", category.alias("category"))


@query(f"""WITH l AS ({_LINES}), s AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, 2 * (l_returnflag = 'A')::INT + 1 / ln(l_quantity + 1) AS score FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 3 THEN score ELSE 0 END DESC, pos) AS k FROM s) SELECT query_id, id, k::INT AS pos FROM r WHERE n <= 3 OR k <= 3""")
def breadth_limit(spark, d):
    rows = _lines(spark, d).withColumnRenamed("pos", "seq")
    score = C.priority(F.col("l_returnflag") == "A", F.lit(1.0), F.col("l_quantity"))
    return C.breadth_limit(rows, ["query_id"], 3, score).select("query_id", "id", "pos")


@query(f"""WITH l AS ({_LINES}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY list_position(['target', 'forward', 'backward', 'related'], category), pos) AS k FROM l) SELECT query_id, id, category FROM r WHERE k = 1""")
def categorize(spark, d):
    return C.categorize(_lines(spark, d)).select("query_id", "id", "category")


_TURNS = f"SELECT conv_id AS query_id, turn AS pos, ceil({UTF16.format('text')} / 4.0)::BIGINT AS tokens FROM conversations"


@query(f"WITH t AS ({_TURNS}), s AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY pos)::BIGINT AS used FROM t) SELECT query_id, pos, tokens, used FROM s WHERE used <= 200")
def prefix_pack(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), T.token_count(F.col("text")).alias("tokens"))
    return C.prefix_fit(rows, F.lit(200)).select("query_id", "pos", "tokens", "used")


@query(f"""WITH RECURSIVE l AS ({_LINES}), o AS (SELECT query_id, id, category, l_quantity::BIGINT AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY list_position(['target', 'backward', 'forward', 'related'], category), pos) AS k FROM l),
f AS (SELECT query_id, 0::BIGINT AS k, 0::BIGINT AS used, NULL::BIGINT AS id, false AS kept, NULL::VARCHAR AS category FROM (SELECT DISTINCT query_id FROM o) UNION ALL
SELECT o.query_id, o.k, CASE WHEN fits THEN used + tokens ELSE used END, o.id, fits, o.category FROM (SELECT o.*, f.used, o.category = 'target' OR f.used + o.tokens <= 100 * CASE o.category WHEN 'backward' THEN 0.8::DOUBLE WHEN 'forward' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS fits FROM f JOIN o ON o.query_id = f.query_id AND o.k = f.k + 1) AS o),
total AS (SELECT query_id, max(used) AS used FROM f GROUP BY query_id)
SELECT query_id, id, category, total.used AS used, (row_number() OVER (PARTITION BY query_id ORDER BY k) - 1)::INT AS place FROM f JOIN total USING (query_id) WHERE kept""")
def skipfit_pack(spark, d):
    rows = _lines(spark, d).withColumn("tokens", F.col("l_quantity").cast("long"))
    return C.skip_fit(rows, F.lit(100.0)).select("query_id", "id", "category", "used", "place")


@query(f"""WITH t AS (SELECT conv_id, sum(ceil({UTF16.format('text')} / 4.0))::BIGINT AS full_tokens, sum(CASE WHEN role = 'assistant' THEN ceil({UTF16.format('text')} / 4.0) ELSE 0 END)::BIGINT AS used FROM conversations GROUP BY conv_id)
SELECT conv_id, greatest(3 * full_tokens - used, 0) AS saved, round(CASE WHEN full_tokens > 0 THEN 100.0::DOUBLE * greatest(3 * full_tokens - used, 0) / (3 * full_tokens) ELSE 0 END, 6) AS percent, least(12000, greatest(6000, full_tokens))::BIGINT AS budget FROM t""")
def savings(spark, d):
    tokens = T.token_count(F.col("text"))
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(tokens).alias("full_tokens"), F.sum(F.when(F.col("role") == "assistant", tokens).otherwise(0)).alias("used"))
    saved, percent = C.savings(3 * F.col("full_tokens"), F.col("used"))
    return t.select("conv_id", saved.alias("saved"), F.round(percent, 6).alias("percent"), C.clamp_budget(F.col("full_tokens")).alias("budget"))


@query("""WITH q AS (SELECT item_id AS query_id, lower(text) AS q FROM benchmark), n AS (SELECT n_nationkey AS id, lower(n_name) AS n FROM nation),
s AS (SELECT query_id, id, 10 * list_contains(regexp_extract_all(q, '[a-z_][a-z0-9_]*'), n)::INT + 5 * (contains(q, n) OR contains(n, q))::INT + 2 * contains(q, 'nation')::INT + (contains(q, 'fix') OR contains(q, 'refactor') OR contains(q, 'change') OR contains(q, 'update') OR contains(q, 'modify') OR contains(q, 'add'))::INT AS score FROM q CROSS JOIN n)
SELECT query_id, id, score::INT AS score FROM s""")
def relevance(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return _asked(spark, d).crossJoin(S.small_side(nodes)).select("query_id", "id", C.relevance(F.col("query"), F.lit("nation"), F.col("name")).alias("score"))


@query("SELECT doc_id, length(regexp_replace(s, '\\s+$', ''))::INT AS n_chars, sha1(regexp_replace(s, '\\s+$', '')) AS digest FROM (SELECT doc_id, CASE WHEN length(t) > 1200 THEN substr(t, 1, 1200) || chr(10) || '...' ELSE t END AS s FROM (SELECT doc_id, array_to_string(list_slice(string_split_regex(text, '\\r?\\n'), 1, 80), chr(10)) AS t FROM documents))")
def snippets(spark, d):
    s = T.snippet(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.length("s").alias("n_chars"), F.sha1("s").alias("digest"))


@query("""WITH s AS (SELECT conv_id, CASE role WHEN 'system' THEN 'target' WHEN 'user' THEN 'forward' ELSE 'backward' END AS category, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY ALL),
h AS (SELECT conv_id, CASE category WHEN 'target' THEN 0 WHEN 'backward' THEN 1 ELSE 2 END AS o, CASE category WHEN 'target' THEN '# TARGET CODE (being modified)' WHEN 'backward' THEN chr(10) || '# DEPENDENTS (code that calls/imports the target - MUST update if signature changes)' ELSE chr(10) || '# DEPENDENCIES (code that target calls/imports)' END || chr(10) || chr(10) || body AS s FROM s)
SELECT conv_id AS query_id, sha1(string_agg(s, chr(10) ORDER BY o)) AS digest FROM h GROUP BY conv_id""")
def format_sections(spark, d):
    category = F.when(F.col("role") == "system", "target").when(F.col("role") == "user", "forward").otherwise("backward")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), category.alias("category"), F.col("turn").alias("place"), "text")
    return C.format_context(rows).select("query_id", F.sha1("context").alias("digest"))


@query("SELECT * FROM (VALUES (0::INT, 'lean', 1::INT, 3::INT, 1500::INT), (1, 'expanded', 2, 5, 3000), (2, 'deep', 3, 10, 6000), (3, 'full', 99, 50, 15000)) AS t(tier, name, depth, top_k, tokens)")
def retrieval_tiers(spark, d):
    return C.tiers(spark)


# --- evaluation, usage ----------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL), t AS (SELECT doc_id, """ + UTF16.format('text') + """ AS total FROM documents)
SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM n JOIN t USING (doc_id) GROUP BY doc_id""")
def char_entropy(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.char_entropy(F.col("text")), 6).alias("entropy"))


_USAGE = "SELECT epoch_ms(ts) AS timestamp, floor(value)::BIGINT AS tokens_used, coalesce((props->>'$.k')::BIGINT, 0) AS tokens_saved, event_type AS model FROM events"


def _usage(spark, d):
    saved = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))
    return table(spark, d, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.floor("value").cast("long").alias("tokens_used"), saved.alias("tokens_saved"), F.col("event_type").alias("model"))


_SUMS = "count(*) AS n_events, sum(tokens_used)::BIGINT AS tokens_used, sum(tokens_saved)::BIGINT AS tokens_saved, round(CASE WHEN sum(tokens_used) > 0 THEN 100.0::DOUBLE * sum(tokens_saved) / (sum(tokens_used) + sum(tokens_saved)) ELSE 0 END, 6) AS savings_percent"


@query(f"WITH u AS ({_USAGE}) SELECT {_SUMS} FROM u")
def usage_stats(spark, d):
    return E.usage_stats(_usage(spark, d)).withColumn("savings_percent", F.round("savings_percent", 6))


@query(f"WITH u AS ({_USAGE}) SELECT model, {_SUMS} FROM u GROUP BY model")
def usage_by_model(spark, d):
    from weftline.streaming.usage import running_usage

    return running_usage(_usage(spark, d)).withColumn("savings_percent", F.round("savings_percent", 6))


@query("""WITH l AS (SELECT user_id, event_type, max(epoch_ms(ts)) AS seen_at FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen_at DESC, event_type) AS rank FROM l) SELECT user_id AS session, event_type AS path, rank::INT AS rank FROM r WHERE rank <= 5""")
def recent_files(spark, d):
    visits = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return E.recent(visits).select("session", "path", "rank")


@query()
def adaptive_loop(spark, d):
    """Vector queries whose k follows the loop's settings until they pass or two rounds are over."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    truth = asked.join(e.select("label", F.col("vec_id").alias("item")), "label").select("query_id", "item")
    near = cut(_near(spark, d, 40).withColumnRenamed("id", "item"))
    state = asked.select("query_id", F.lit(8000).alias("budget"), F.lit(2).alias("depth"), F.lit(6).alias("related"), F.lit(3).alias("breadth"), F.lit(False).alias("cross"))

    def evaluate(todo):
        found = near.join(todo.select("query_id", "related"), "query_id").where("rank <= related + 4").drop("related")
        metrics = E.at_k(found, truth.join(todo.select("query_id"), "query_id", "left_semi"), 40).drop("f1")
        return todo.join(metrics, "query_id").withColumn("coverage", E.coverage(F.col("related") * 100.0, F.col("budget")))

    return E.adaptive_loop(state, evaluate, 2, cut)


# --- texts ----------------------------------------------------------------------------------------------------------

_UNSURE = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in T.UNCERTAIN) + "]"
_HEDGES = "[" + ", ".join(f"'{p}'" for p in T.HEDGES) + "]"


@query(f"""WITH t AS (SELECT conv_id, turn, text, lower(text) AS l FROM conversations), u AS (SELECT *, list_filter({_UNSURE}, lambda p: contains(l, p)) AS un, len(list_filter({_HEDGES}, lambda p: contains(l, p))) AS h FROM t)
SELECT conv_id, turn, CASE WHEN len(un) > 0 THEN 0.3::DOUBLE WHEN length(text) < 50 THEN 0.4 WHEN h > 2 THEN 0.5 WHEN (contains(l, 'function') OR contains(l, 'class') OR contains(l, 'const')) AND NOT contains(text, '```') THEN 0.6 ELSE 0.9 END AS score,
CASE WHEN len(un) > 0 THEN 'Contains uncertainty: "' || un[1] || '"' WHEN length(text) < 50 THEN 'Response too short' WHEN h > 2 THEN 'Too many hedging words' WHEN (contains(l, 'function') OR contains(l, 'class') OR contains(l, 'const')) AND NOT contains(text, '```') THEN 'Missing expected code blocks' ELSE 'Confident response' END AS reason FROM u""")
def confidence(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.confidence(F.col("text")).alias("c")).select("conv_id", "turn", "c.score", "c.reason")


@query("""WITH f AS (SELECT conv_id, turn, string_split(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), chr(10))[1] AS l, string_split(text, chr(10)) AS ls FROM conversations)
SELECT conv_id, turn, CASE WHEN length(l) > 200 THEN substr(l, 1, 197) || '...' ELSE l END AS summary, len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*]\\s')))::INT AS n_follow_ups FROM f""")
def response_summary(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.summary(F.col("text")).alias("summary"), F.size(T.follow_ups(F.col("text"))).alias("n_follow_ups"))


@query("SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY ALL")
def page_links(spark, d):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    return table(spark, d, "pages").select("page_id", links.alias("link")).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, len(string_split_regex(text, '\\r?\\n'))::INT AS n_lines FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), F.size(F.split("text", "\r?\n", -1)).alias("n_lines"))


@query("""WITH l AS (SELECT doc_id, source, string_split_regex(text, '\\r?\\n') AS ls FROM documents) SELECT doc_id, sha1('# file ' || source || chr(10) || '## imports' || chr(10) || coalesce(array_to_string(list_slice(list_filter(ls, lambda x: regexp_matches(x, '(^|[^A-Za-z0-9_])import([^A-Za-z0-9_]|$)|require\\(')), 1, 20), chr(10)), '')
|| chr(10) || '## exports' || chr(10) || coalesce(array_to_string(list_slice(list_filter(ls, lambda x: regexp_matches(x, '(^|[^A-Za-z0-9_])export([^A-Za-z0-9_]|$)')), 1, 20), chr(10)), '') || chr(10) || '## header' || chr(10) || array_to_string(list_slice(ls, 1, 50), chr(10))) AS digest FROM l""")
def file_card(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1(T.file_card(F.col("source"), F.col("text"))).alias("digest"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def conversation_fold(spark, d):
    return P.fold_turns(table(spark, d, "conversations"))


@query("""WITH p AS (SELECT DISTINCT conv_id, 0 AS part, 0::BIGINT AS turn, 'system' AS role, 'Be brief.' AS content FROM conversations UNION ALL SELECT conv_id, 2, turn, role, text FROM conversations WHERE role <> 'system' UNION ALL SELECT DISTINCT conv_id, 3, 0, 'user', 'Go on.' FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) AS pos, role, content FROM p""")
def prompt_messages(spark, d):
    turns = table(spark, d, "conversations")
    say = lambda x: turns.select("conv_id").distinct().withColumn("content", F.lit(x))
    return P.prompt_messages(say(P.system_prompt("Be brief.")), say(""), turns, say("Go on."))


@query("SELECT page_id, CASE WHEN p LIKE '%/' AND length(p) > 1 THEN 'folder' WHEN p = '' THEN 'none' ELSE 'file' END AS kind, CASE WHEN e = '' THEN NULL ELSE e END AS extension FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(\\.[^./]*)$', 1)) AS e FROM pages)")
def path_kinds(spark, d):
    p = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    rows = table(spark, d, "pages").select("page_id", T.normalized_path(p).alias("p"))
    kind = F.when(F.col("p").endswith("/") & (F.length("p") > 1), "folder").when(F.col("p") == "", "none").otherwise("file")
    return rows.select("page_id", kind.alias("kind"), F.nullif(F.lower(F.regexp_extract("p", r"(\.[^./]*)$", 1)), F.lit("")).alias("extension"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)api\\s*key|password|secret')")
def forbidden_texts(spark, d):
    return table(spark, d, "documents").where(T.has_forbidden(F.col("text"))).select("doc_id")


@query("SELECT d.doc_id FROM documents AS d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def shared_embedding_keys(spark, d):
    keys = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    return keys.where("n > 1")


@query(f"SELECT conv_id, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / greatest(1, sum(ceil({UTF16.format('text')} / 4.0)))::DOUBLE, 6) AS signal FROM conversations GROUP BY conv_id")
def signal_to_noise(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.sum(T.token_count(F.col("text"))).alias("saved"))
    return t.select("conv_id", "chars", F.round(F.col("chars") / F.greatest(F.lit(1), F.col("saved")), 6).alias("signal"))
