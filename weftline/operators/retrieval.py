"""From queries to targets to a packed context: the operators put together, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vectors as V
from weftline.operators import context as C
from weftline.operators import fusion as R
from weftline.operators import search as S
from weftline.operators import traversal as W
from weftline.sources.tables import cut


def resolve_targets(queries: DataFrame, nodes: DataFrame, limit: int = 3, recent: DataFrame | None = None, seeds: DataFrame | None = None, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, path, score, n_nodes, bm25, ann, rank) of the best `limit` paths for queries(query_id, query).

    nodes: id, type, name, path, content, start_line, end_line, exported, and embedding_text if there is one. `vectors`:
    (vectors(id, embedding), queries(query_id, embedding)). Queries that neither search answers get no candidates, seeds or not.
    """
    text = F.coalesce(F.nullif(T.trimmed(F.col("embedding_text")), F.lit("")), T.trimmed(F.col("content"))) if "embedding_text" in nodes.columns else T.trimmed(F.col("content"))
    docs = nodes.select("id", text.alias("content")).where("content <> ''")
    count = 3 * limit
    lexical = S.bm25(docs, queries, count)
    ann = S.cosine_top_k(*vectors, count) if vectors else lexical.limit(0)
    fused = R.reciprocal_rank_fusion(R.candidate_pool(ann, lexical), count).drop("rank")
    lines = F.col("end_line") - F.col("start_line") + 1
    signals = fused.join(nodes.select("id", "path", "name", "type", R.structural_signal(F.col("exported"), lines).alias("structural")), "id")
    signals = signals.select("query_id", "id", "name", "type", T.normalized_path(F.col("path")).alias("path"), F.col("ann").alias("semantic"), F.col("bm25").alias("lexical"), "structural", "fused", "ann", "bm25")
    ranked = R.rerank(signals, count)
    ranked = ranked.withColumn("reasons", R.reasons(F.col("type"), F.col("name"), F.col("ann"), F.col("bm25"), F.col("fused"), F.col("semantic"), F.col("lexical"), F.col("structural")))
    found = cut(R.group_by_path(ranked))
    answered = found.select("query_id").distinct()
    wanted = queries.select("query_id", F.explode(T.mentioned_files(F.col("query"))).alias("path"))
    names = nodes.where("name is not null").select(F.lower("name").alias("token"), T.normalized_path(F.col("path")).alias("path")).distinct()
    tokens = queries.select("query_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("query", F.lit("([A-Za-z][A-Za-z0-9]{3,})"), 1), F.lower))).alias("token"))
    wanted = wanted.union(tokens.join(names, "token").select("query_id", "path"))
    if recent is not None:
        found = R.recent_boost(found, recent)
        wanted = wanted.union(recent.select("query_id", "path"))
    if seeds is not None:
        wanted = wanted.union(seeds.select("query_id", "path"))
    found = R.inject_seeds(found, wanted.distinct().join(answered, "query_id", "left_semi"), nodes.select(T.normalized_path(F.col("path")).alias("path")))
    found = found.join(queries, "query_id").withColumn("score", F.col("score") + R.intent_boost(F.col("query"), F.col("path"))).drop("query")
    return S.top_k(found, ["query_id"], [F.desc("score"), F.asc_nulls_last("first_rank"), F.asc("path")], limit)


def target_nodes(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id) of the nodes of queries(query_id, query, path) that the query is about."""
    own = queries.join(nodes.where("type <> 'file'"), "path")
    scored = own.withColumn("score", C.relevance(F.col("query"), F.col("type"), F.col("name")))
    return C.relevant_targets(scored).select("query_id", "id")


def semantic_context(queries: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: tuple[DataFrame, DataFrame] | None, exclude: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(query_id, id, rank): up to k further nodes per query by meaning, files and exclude(query_id, id) left out.

    The nearest by embedding; where the best is below 0.6, merged with the text search by weight; where there is none,
    the text search alone. The first 0.6 k of them lead, and what the graph has around them fills up.
    """
    plain = nodes.where("type <> 'file'")
    # k more than asked for, as so many may be excluded; exclusions beyond are counted in
    spare = exclude.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    left = lambda df: S.top_k(df.drop("rank").join(exclude.select("query_id", "id"), ["query_id", "id"], "left_anti"), ["query_id"], [F.desc("score"), F.asc("id")], k)
    lexical = cut(left(S.text_search(plain.select("id", "content"), queries, k + spare, digits)), "lexical")
    if vectors is None:
        chosen = lexical.select("query_id", "id", "score")
    else:
        near = cut(left(S.cosine_top_k(vectors[0].join(plain.select("id"), "id", "left_semi"), vectors[1], k + spare, digits)), "near")
        best = near.groupBy("query_id").agg(F.max("score").alias("best"))
        weak = near.join(best.where("best < 0.6"), "query_id", "left_semi")
        answered = lexical.join(best.where("best < 0.6"), "query_id", "left_semi")
        merged = R.weighted_merge(weak, answered)
        strong = near.join(best.where("best >= 0.6"), "query_id", "left_semi").select("query_id", "id", "score")
        alone = lexical.join(best, "query_id", "left_anti").select("query_id", "id", "score")
        chosen = merged.unionByName(strong).unionByName(alone)
    lead = max(1, -(-6 * k // 10))
    primary = cut(S.top_k(chosen, ["query_id"], [F.desc("score"), F.asc("id")], lead), "primary").select("query_id", "id", F.col("rank").alias("pos"))
    around = W.expand(primary, nodes, edges, k).select("query_id", "id", (F.lit(lead) + F.col("rank")).alias("pos"))
    return S.top_k(primary.unionByName(around), ["query_id"], [F.asc("pos")], k).select("query_id", "id", "rank")


def build_context(targets: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, breadth: int = 3, related: int = 6, budget: int = 9000, semantic: DataFrame | None = None) -> DataFrame:
    """(query_id, context, used, n_target, n_backward, n_forward, n_related) around targets(query_id, id).

    What depends on a target and what it depends on is walked, related nodes are added around it, after those of
    semantic(query_id, id, rank) if there are any, each group is limited in breadth, and all is packed under the clamped
    budget.
    """
    base = targets.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    starts = targets.select(F.col("query_id").alias("source"), "id")

    def walked(backward: bool, name: str) -> DataFrame:
        found = W.dependencies(starts, nodes, edges, depth, backward)
        return found.select(F.col("source").alias("query_id"), "id", F.lit(name).alias("category"), F.col("depth").alias("pos"))

    near = W.expand(base, nodes, edges, related).select("query_id", "id", F.lit("related").alias("category"), F.col("rank").alias("pos"))
    if semantic is not None:
        near = near.withColumn("pos", F.col("pos") + F.lit(1 << 10)).unionByName(semantic.select("query_id", "id", F.lit("related").alias("category"), F.col("rank").alias("pos")))
    beside = C.siblings(targets, nodes).withColumn("pos", F.lit(1 << 20))
    every = base.select("query_id", "id", F.lit("target").alias("category"), "pos").unionByName(walked(False, "forward")).unionByName(walked(True, "backward")).unionByName(near).unionByName(beside)
    chosen = C.categorize(every).join(nodes, "id")
    order = F.row_number().over(Window.partitionBy("query_id", "category").orderBy("pos", *(["seq"] if "seq" in nodes.columns else []), "id"))
    chosen = chosen.withColumn("order", order)
    limited = C.breadth_limit(chosen.where("category <> 'target'").drop("pos"), ["query_id", "category"], max(1, breadth), C.priority(F.col("exported"), F.col("start_line"), F.col("end_line")), "order")
    card = T.node_text(F.col("type"), F.col("name"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content"))
    rows = chosen.where("category = 'target'").withColumn("pos", F.col("order")).unionByName(limited).withColumn("text", card).withColumn("tokens", T.token_count(F.col("text")))
    rows = cut(rows.select("query_id", "id", "category", "pos", "text", "tokens"))
    limit = C.clamp_budget(F.lit(float(budget)))
    packed = C.skip_fit(rows, limit).select("query_id", "id", "place").join(rows.select("query_id", "id", "category", "text"), ["query_id", "id"])
    counts = packed.groupBy("query_id").agg(*(F.sum(F.when(F.col("category") == c, 1).otherwise(0)).alias(f"n_{c}") for c in C.HEADINGS))
    return C.format_context(packed).withColumn("used", T.token_count(F.col("context"))).join(counts, "query_id")


def tiered_context(queries: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, tier: str = "lean") -> DataFrame:
    """(query_id, id, pos, tokens, used) for queries(query_id, id, embedding): the nodes within a tier's depth of the start node, the nearest by embedding first, up to its number and tokens."""
    depth, top, tokens = C.TIERS[tier]
    near = W.walk(queries.select(F.col("query_id").alias("source"), "id"), edges, depth, (*W.DEPENDENCIES, "contains")).select(F.col("source").alias("query_id"), "id")


    scored = near.join(vectors.select("id", "embedding"), "id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id").select("query_id", "id", V.cosine(F.col("embedding"), F.col("q")).alias("score"))
    best = S.top_k(scored, ["query_id"], [F.desc("score"), F.asc("id")], top).withColumnRenamed("rank", "pos")
    return C.prefix_fit(best.join(nodes.select("id", T.token_count(F.col("content")).alias("tokens")), "id"), F.lit(tokens)).select("query_id", "id", "pos", "tokens", "used")


def benchmark_run(tasks: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 3, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(per task, means) of tasks(query_id, query, truth): targets resolved, their context built, scored, and run again with wider settings until it passes.

    All tasks of a round run together. Per task: query_id, the metrics, actions, pass, iterations.
    """
    from weftline.operators import evaluation as E

    wanted = tasks.select("query_id", F.explode("truth").alias("item"))

    def evaluate(state: DataFrame) -> DataFrame:
        out = None
        # queries of equal settings go together; there are no more settings than rounds allow
        for depth, breadth, related, budget, cross in [tuple(r) for r in state.select("depth", "breadth", "related", "budget", "cross").distinct().collect()]:
            some = state.select("query_id", "query", "truth", "budget", "depth", "related", "breadth", "cross").where((F.col("depth") == depth) & (F.col("breadth") == breadth) & (F.col("related") == related) & (F.col("budget") == budget) & (F.col("cross") == cross))
            asked = some.select("query_id", "query")
            paths = cut(resolve_targets(asked, nodes, limit), "paths")
            starts = target_nodes(asked.join(paths.where("rank = 1").select("query_id", "path"), "query_id"), nodes)
            context = build_context(starts, nodes, edges, depth, breadth, related, budget)
            scores = E.at_k(paths.select("query_id", "rank", F.col("path").alias("item")), wanted.join(asked.select("query_id"), "query_id", "left_semi"), limit).select("query_id", "precision", "recall")
            found = paths.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("c"))
            rows = some.join(scores, "query_id", "left").join(context.select("query_id", "context", "used"), "query_id", "left").join(found, "query_id", "left")
            rows = rows.withColumns({
                "precision": F.coalesce("precision", F.lit(0.0)), "recall": F.coalesce("recall", F.lit(0.0)), "coverage": E.coverage(F.coalesce(F.col("used"), F.lit(0)).cast("double"), C.clamp_budget(F.lit(float(budget)))),
                "candidates": F.coalesce(F.transform("c", lambda x: x["path"]), F.array().cast("array<string>")), "context": F.coalesce("context", F.lit("")),
            }).drop("c", "used")
            out = rows if out is None else out.unionByName(rows)
        return out

    state = tasks.select("query_id", "query", "truth", *(F.lit(v).alias(c) for c, v in (("budget", 9000), ("depth", 2), ("related", 6), ("breadth", 3), ("cross", False))))
    done = E.adaptive_loop(state, evaluate, rounds, cut)
    entropy, chars = T.char_entropy(F.col("context")), T.utf16_length(F.col("context"))
    noise = chars / F.greatest(F.lit(1), T.token_count(F.col("context")))
    per_task = done.withColumn("m", E.task_metrics(F.col("candidates"), F.slice("candidates", 1, 1), F.col("truth"), F.col("coverage"), entropy, noise)).select("query_id", "m.*", "actions", "pass", "iterations")
    return per_task, E.macro_average(per_task)
