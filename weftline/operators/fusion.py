"""Candidate fusion, reranking and grouping by path, over batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

from weftline.operators.search import top_k

#: Rank constant of the fusion; weights of the blend; score of an injected path.
RRF = 60
WEIGHTS = {"semantic": 0.5, "lexical": 0.3, "structural": 0.2}
CROSS_WEIGHT = 0.2
SEED_SCORE = 5.0
#: Word borders by A-Z, a-z, 0-9 and underscore alone: Java's own follow Unicode or not, by its version.
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Words of a query and paths that they favour.
INTENTS = ((START + "(auth|token|device|login|oauth)" + END, r"src/auth/", 2.0, "Auth intent boost"), (START + "(ui|component|tsx|react|form|input|button|validation)" + END, r"src/ui/", 2.0, "UI intent boost"), (START + "test|spec|jest|vitest" + END, r"tests?/", 1.5, "Test intent boost"))


def candidate_pool(ann: DataFrame, lexical: DataFrame) -> DataFrame:
    """(query_id, id, score, rank, source) of both searches."""
    mark = lambda df, name: df.select("query_id", "id", "score", "rank", F.lit(name).alias("source"))
    return mark(ann, "ANN").unionByName(mark(lexical, "BM25"))


def reciprocal_rank_fusion(pool: DataFrame, k: int) -> DataFrame:
    """Top k per query by the sum of 1 / (60 + rank); ties go to vector candidates, then by rank. Raw scores are kept per source."""
    of = lambda source, c: F.max(F.when(F.col("source") == source, F.col(c)))
    fused = pool.groupBy("query_id", "id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("fused"), of("ANN", "rank").alias("ann_rank"), of("BM25", "rank").alias("bm25_rank"), of("ANN", "score").alias("ann"), of("BM25", "score").alias("bm25"))
    return top_k(fused, ["query_id"], [F.desc("fused"), F.asc_nulls_last("ann_rank"), F.asc("bm25_rank")], k)


def min_max(value: Column, by: str = "query_id") -> Column:
    """0..1 within a query; all equal gives all 1."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 1.0).otherwise((value - low) / (high - low))


def structural_signal(exported: Column, lines: Column) -> Column:
    return 0.7 * F.when(exported, 1.0).otherwise(0.0) + 0.3 / F.log(F.greatest(lines, F.lit(1)) + 1.0)


def rerank(candidates: DataFrame, k: int, cross: bool = False) -> DataFrame:
    """Top k per query of candidates(query_id, id, semantic, lexical, structural[, cross]) by the weighted sum of normalised signals; a missing one counts 0."""
    filled = candidates
    for c in (*WEIGHTS, *(["cross"] if cross else [])):
        filled = filled.withColumn(c, min_max(F.coalesce(F.col(c), F.lit(0.0))))
    score = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    if cross:
        score = (score + CROSS_WEIGHT * F.col("cross")) / (1 + CROSS_WEIGHT)
    return top_k(filled.withColumn("score", score), ["query_id"], [F.desc("score"), F.asc("id")], k)


def overlap_score(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the query's distinct words that the text has."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9_]+"), lambda w: w != ""))
    q = words(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, words(text))) / F.size(q))


def weighted_merge(embedding: DataFrame, lexical: DataFrame, weight: float = 0.6) -> DataFrame:
    """Full outer merge of scores: weight * embedding + (1 - weight) * text."""
    both = embedding.select("query_id", "id", (weight * F.col("score")).alias("part")).unionAll(lexical.select("query_id", "id", ((1 - weight) * F.col("score")).alias("part")))
    return both.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def search_mode(top_embedding: Column, top_text: Column) -> Column:
    return F.when(top_embedding >= 0.6, "embedding").when(top_text > 0.8 * top_embedding, "hybrid").otherwise("embedding")


def reasons(row_type: Column, name: Column, ann: Column, bm25: Column, fused: Column, semantic: Column, lexical: Column, structural: Column) -> Column:
    """What speaks for a node, in words; absent signals are left out."""
    say = lambda label, x: F.when(x.isNotNull(), F.concat(F.lit(label + " "), F.format_string("%.2f", x)))
    every = F.array(say("Semantic seed", ann), say("Lexical seed", bm25), say("Fused seed", fused), say("Semantic rerank", semantic), say("Lexical rerank", lexical), say("Structural signal", structural), F.concat(F.lit("Candidate "), row_type, F.lit(" "), name))
    return F.filter(every, lambda x: x.isNotNull())


def group_by_path(reranked: DataFrame) -> DataFrame:
    """Sums and maxima of reranked(query_id, path, rank, score, fused, semantic, lexical, structural, ann, bm25[, reasons]) per query and path."""
    sums = [F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("score", "fused", "semantic", "lexical", "structural")]
    out = reranked.groupBy("query_id", "path").agg(F.count(F.lit(1)).alias("n_nodes"), *sums, F.max("lexical").alias("max_lexical"), F.sum("ann").alias("ann"), F.sum("bm25").alias("bm25"), F.min("rank").alias("first_rank"), *([F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "reasons"))), lambda x: x["reasons"])).alias("reasons")] if "reasons" in reranked.columns else []))
    return out.withColumn("reasons", F.slice(F.array_distinct("reasons"), 1, 6)) if "reasons" in out.columns else out


def recent_boost(candidates: DataFrame, recent: DataFrame) -> DataFrame:
    """+1 for paths that recent(query_id, path) holds."""
    mark = recent.select("query_id", "path").distinct().withColumn("recent", F.lit(True))
    return candidates.join(mark, ["query_id", "path"], "left").withColumn("score", F.col("score") + F.when(F.col("recent"), 1.0).otherwise(0.0)).drop("recent")


def inject_seeds(candidates: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds seeds(query_id, path) that are no candidates yet but have nodes(path), with score 5 and up to three nodes; others get nothing."""
    known = nodes.groupBy("path").agg(F.least(F.count(F.lit(1)), F.lit(3)).alias("n_nodes"))
    new = seeds.select("query_id", "path").distinct().join(candidates.select("query_id", "path"), ["query_id", "path"], "left_anti").join(known, "path")
    return candidates.unionByName(new.select("query_id", "path", "n_nodes", F.lit(SEED_SCORE).alias("score"), F.lit(1.0).alias("seed")), allowMissingColumns=True)


def intent_boost(query: Column, path: Column) -> Column:
    """The sum of boosts that a query's words give a path."""
    return sum((F.when(F.lower(query).rlike(words) & path.rlike(where), score).otherwise(0.0) for words, where, score, _ in INTENTS), F.lit(0.0))


def strict_match(candidates: DataFrame, lexical_at: float, cross_at: float) -> Column:
    """Whether a row of (query, path, max_lexical[, seed, max_cross]) is a strict match: seeded, named by the query, or of a high score."""
    passes = T.mentions_path(F.col("query"), F.col("path")) | F.array_contains(T.mentioned_files(F.col("query")), T.normalized_path(F.col("path"))) | (F.col("max_lexical") >= lexical_at)
    for c, bound in (("seed", 0.0), ("max_cross", cross_at)):
        if c in candidates.columns:
            passes = passes | (F.col(c) > bound if c == "seed" else F.col(c) >= bound)
    return F.coalesce(passes, F.lit(False))


def strict_filter(candidates: DataFrame, passes: Column) -> DataFrame:
    """Rows that pass; a query of which none passes keeps all."""
    any_ = F.max(F.when(passes, 1).otherwise(0)).over(Window.partitionBy("query_id"))
    return candidates.withColumn("__any", any_).where(passes | (F.col("__any") == 0)).drop("__any")


def source_totals(candidates: DataFrame) -> DataFrame:
    """Sum of the raw scores per query and source."""
    return candidates.select("query_id", F.explode(F.create_map(F.lit("ANN"), "ann", F.lit("BM25"), "bm25")).alias("source", "value")).where("value is not null").groupBy("query_id", "source").agg(F.sum("value").alias("total"))
