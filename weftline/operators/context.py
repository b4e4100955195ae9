"""Choice of context nodes, packing under a token budget, and the context's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

CATEGORIES = ("target", "forward", "backward", "related")
#: Order and shares of the budget in packing.
PACKING = {"target": (0, 1e18), "backward": (1, 0.8), "forward": (2, 0.95), "related": (3, 1.0)}
# Headings of a context's sections, in order; depth, number and tokens of the retrieval tiers.
HEADINGS = {
    "target": "# TARGET CODE (being modified)\n",
    "backward": "\n# DEPENDENTS (code that calls/imports the target - MUST update if signature changes)\n",
    "forward": "\n# DEPENDENCIES (code that target calls/imports)\n",
    "related": "\n# RELATED CONTEXT (similar or relevant code)\n",
}
TIERS = {"lean": (1, 3, 1500), "expanded": (2, 5, 3000), "deep": (3, 10, 6000), "full": (99, 50, 15000)}


def relevance(query: Column, kind: Column, name: Column) -> Column:
    """Points for a node by a query: its exact name, part of it, its type, and a verb of action."""
    q, n = F.lower(query), F.lower(name)
    verb = F.exists(F.array(*map(F.lit, T.ACTIONS)), lambda a: F.contains(q, a))
    return F.when(F.array_contains(T.identifiers(query), n), 10).otherwise(0) + F.when(F.contains(q, n) | F.contains(n, q), 5).otherwise(0) + F.when(F.contains(q, kind), 2).otherwise(0) + F.when(verb, 1).otherwise(0)


def relevant_targets(scored: DataFrame, top: int = 3) -> DataFrame:
    """Of scored(query_id, id, type, score, seq): the best `top` above 1; where none is, all functions and classes."""
    w = Window.partitionBy("query_id")
    marked = scored.withColumn("__some", F.max("score").over(w) > 1)
    ranked = marked.withColumn("__k", F.row_number().over(w.orderBy(F.desc("score"), "seq")))
    keep = F.when(F.col("__some"), (F.col("score") > 1) & (F.col("__k") <= top)).otherwise(F.col("type").isin("function", "class"))
    return ranked.where(keep).drop("__some", "__k")


def priority(exported: Column, start: Column, end: Column) -> Column:
    return F.when(exported, 2.0).otherwise(0.0) + 1.0 / F.log(F.greatest(end - start + 1, F.lit(1)) + 1.0)


def breadth_limit(rows: DataFrame, by: list[str], limit: int, score: Column, order: str = "seq") -> DataFrame:
    """Groups of more than `limit` rows keep the best; smaller ones keep all. `pos` is the resulting order."""
    w = Window.partitionBy(*by)
    sized = rows.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__s", F.when(F.col("__n") > limit, score).otherwise(0.0))
    return sized.withColumn("pos", F.row_number().over(w.orderBy(F.desc("__s"), order))).where((F.col("__n") <= limit) | (F.col("pos") <= limit)).drop("__n", "__s")


def categorize(found: DataFrame) -> DataFrame:
    """One row per query and id of found(query_id, id, category, ...): the first category of target, forward, backward, related holds."""
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return found.withColumn("__p", place).withColumn("__k", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("__p", *(["pos"] if "pos" in found.columns else [])))).where("__k = 1").drop("__p", "__k")


def siblings(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Non-file nodes of the targets' paths, as related ones."""
    paths = targets.join(nodes.select("id", "path"), "id").select("query_id", "path").distinct()
    return paths.join(nodes.where("type <> 'file'").select("path", "id"), "path").select("query_id", "id", F.lit("related").alias("category"))


def skip_fit(rows: DataFrame, budget: Column) -> DataFrame:
    """Packing of rows(query_id, category, pos, id, tokens): targets always; then, in order, what fits its category's share. What doesn't fit is skipped.

    The fold is inherently sequential per query; breadth limits bound the number of rows that meet in it.
    """
    order = F.create_map(*(F.lit(x) for c, (k, _) in PACKING.items() for x in (c, k)))
    share = F.create_map(*(F.lit(x) for c, (_, s) in PACKING.items() for x in (c, float(s))))
    items = rows.withColumn("budget", budget).groupBy("query_id", "budget").agg(
        F.array_sort(F.collect_list(F.struct(order[F.col("category")].alias("o"), "pos", "id", "category", F.col("tokens").cast("long").alias("tokens")))).alias("items")
    )
    kept = F.array().cast("array<struct<id:%s,category:string,tokens:bigint>>" % rows.schema["id"].dataType.simpleString())
    start = F.struct(F.lit(0).cast("long").alias("used"), kept.alias("kept"))

    def step(a: Column, x: Column) -> Column:
        fits = (x["category"] == "target") | (a["used"] + x["tokens"] <= F.col("budget") * share[x["category"]])
        one = F.array(F.struct(x["id"].alias("id"), x["category"].alias("category"), x["tokens"].alias("tokens")))
        return F.struct(F.when(fits, a["used"] + x["tokens"]).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["kept"], one)).otherwise(a["kept"]).alias("kept"))

    return items.select("query_id", F.aggregate("items", start, step).alias("p")).select("query_id", F.col("p.used").alias("used"), F.posexplode("p.kept").alias("place", "item")).select("query_id", "used", "place", "item.*")


def prefix_fit(rows: DataFrame, budget: Column) -> DataFrame:
    """Rows of each query, in order of pos, up to the first that overflows the budget; every item costs at least 1, so a running sum decides."""
    w = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def clamp_budget(tokens: Column) -> Column:
    """Floored into 6000..12000; NaN and null are 6000."""
    return F.when(tokens.isNull() | F.isnan(tokens.cast("double")), 6000).otherwise(F.least(F.lit(12000), F.greatest(F.lit(6000), F.floor(tokens)))).cast("long")


def savings(full: Column, used: Column) -> tuple[Column, Column]:
    """(tokens saved, percent of the full context); never negative."""
    saved = F.greatest(full - used, F.lit(0))
    return saved, F.when(full > 0, 100.0 * saved / full).otherwise(0.0)


def format_context(rows: DataFrame) -> DataFrame:
    """(query_id, context) of rows(query_id, category, place, text): sections under their headings, nodes apart by an empty line."""
    order = F.create_map(*(F.lit(x) for k, c in enumerate(HEADINGS) for x in (c, k)))
    heading = F.create_map(*(F.lit(x) for c, h in HEADINGS.items() for x in (c, h)))
    sections = rows.groupBy("query_id", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    whole = F.array_sort(F.collect_list(F.struct(order[F.col("category")].alias("o"), F.concat(heading[F.col("category")], F.lit("\n"), F.col("body")).alias("s"))))
    return sections.groupBy("query_id").agg(F.array_join(F.transform(whole, lambda x: x["s"]), "\n").alias("context"))


def tiers(spark) -> DataFrame:
    return spark.createDataFrame([(k, name, *v) for k, (name, v) in enumerate(TIERS.items())], "tier int, name string, depth int, top_k int, tokens int")
