"""Scores of retrieved candidates, corrective actions, and the adaptive loop over unfinished queries."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "f1", "coverage", "candidates", "entropy", "signal_to_noise", "relevance", "accuracy", "exact", "perplexity", "faithfulness", "first_token_ms")


def at_k(ranked: DataFrame, truth: DataFrame, max_k: int) -> DataFrame:
    """precision, recall and f1 per query_id of ranked(query_id, rank, item) against truth(query_id, item).

    k is the number of candidates, at least 1 and at most max_k; recall of an empty truth is 1.
    """
    items = ranked.where(F.col("rank") <= max_k).groupBy("query_id").agg(F.collect_set("item").alias("found"), F.count(F.lit(1)).alias("n"))
    wanted = truth.groupBy("query_id").agg(F.collect_set(F.trim(F.col("item").cast("string"))).alias("wanted"))
    both = items.join(wanted, "query_id", "full")
    found = F.coalesce(F.transform("found", lambda x: x.cast("string")), F.array().cast("array<string>"))
    want = F.coalesce("wanted", F.array().cast("array<string>"))
    hits = F.size(F.array_intersect(found, want)).cast("double")
    p = hits / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    r = F.when(F.size(want) == 0, 1.0).otherwise(hits / F.greatest(F.size(want), F.lit(1)))
    return both.select("query_id", p.alias("precision"), r.alias("recall")).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def coverage(used: Column, budget: Column) -> Column:
    return F.when(budget == 0, 0.0).otherwise(used / budget)


def task_metrics(candidates: Column, context: Column, truth: Column, coverage_: Column, entropy: Column, noise: Column) -> Column:
    """The metrics of one task. Hits count in candidates or context, but are divided by the candidates alone, so precision may pass 1.

    Perplexity and time to the first token are placeholders that are always 0, and some others repeat precision or recall.
    """
    hits = F.size(F.array_intersect(truth, F.array_union(candidates, context))).cast("double")
    n = F.size(F.array_distinct(candidates))
    p = hits / F.when(n > 0, n).otherwise(F.greatest(F.size(truth), F.lit(1)))
    r = F.when(F.size(truth) == 0, 1.0).otherwise(hits / F.greatest(F.size(truth), F.lit(1)))
    values = (p, r, f1(p, r), coverage_, F.size(candidates).cast("double"), entropy, noise, p, p, (hits == F.size(truth)).cast("double"), F.lit(0.0), r, F.lit(0.0))
    return F.struct(*(v.alias(name) for name, v in zip(METRICS, values, strict=True)))


def macro_average(metrics: DataFrame, columns: tuple[str, ...] = METRICS) -> DataFrame:
    """The mean of each metric; zeros for no rows."""
    return metrics.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns))


def actions(precision: Column, recall: Column, coverage_: Column, precision_at: float = 0.6, recall_at: float = 0.6, coverage_at: float = 0.85) -> Column:
    """Distinct corrective actions in order of their rules."""
    low, none = precision < precision_at, F.array().cast("array<string>")
    of = lambda when, *names: F.when(when, F.array(*map(F.lit, names))).otherwise(none)
    return F.array_distinct(F.concat(
        of(low, "enable_cross_encoder", "increase_walk_depth", "expand_related"), of(precision < min(0.4, precision_at), "increase_token_budget"),
        of(recall < recall_at, "increase_walk_depth", "expand_related"), of(coverage_ > coverage_at, "increase_token_budget"),
    ))


def apply_actions(state: DataFrame) -> DataFrame:
    """New settings of state(actions, budget, depth, related, breadth, cross), within their caps."""
    has = lambda a: F.array_contains("actions", a)
    grown = lambda c, a, by, cap: F.when(has(a), F.least(F.lit(cap), F.col(c) + by)).otherwise(F.col(c))
    return state.withColumns({
        "budget": grown("budget", "increase_token_budget", 2000, 12000), "depth": grown("depth", "increase_walk_depth", 1, 5),
        "breadth": grown("breadth", "expand_related", 1, 6), "related": F.when(has("expand_related"), F.col("related") + 2).otherwise(F.col("related")),
        "cross": F.col("cross") | has("enable_cross_encoder"),
    })


def adaptive_loop(state: DataFrame, evaluate: Callable[[DataFrame], DataFrame], rounds: int = 2, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Runs all unfinished queries together, up to `rounds` times. `evaluate` returns the state with precision, recall, coverage; a query ends when it passes or has no action.

    `keep` materialises a round's result. Columns added: actions, pass, iterations.
    """
    todo, done = state, None
    for k in range(1, rounds + 1):
        now = evaluate(todo)
        now = now.withColumn("actions", actions(F.col("precision"), F.col("recall"), F.col("coverage"))).withColumn("pass", (F.col("precision") >= 0.6) & (F.col("recall") >= 0.6)).withColumn("iterations", F.lit(k))
        now = keep(now)
        ended = F.col("pass") | (F.size("actions") == 0) | F.lit(k == rounds)
        done = now.where(ended) if done is None else done.unionByName(now.where(ended))
        todo = apply_actions(now.where(~ended)).drop("actions", "pass", "iterations", "precision", "recall", "coverage")
        if k < rounds and todo.isEmpty():
            break
    return done


class Trace:
    """Start, duration and outcome of named steps; errors are noted and raised again."""

    def __init__(self):
        self.entries: list[dict] = []

    @contextmanager
    def step(self, name: str, **metadata):
        entry = {"node": name, "startedAt": datetime.now(UTC).isoformat(), "status": "success", "metadata": metadata, "error": None}
        began = time.perf_counter()
        try:
            yield entry
        except Exception as e:
            entry |= {"status": "error", "error": str(e)}
            raise
        finally:
            entry["durationMs"] = (time.perf_counter() - began) * 1000
            self.entries.append(entry)


def usage_stats(events: DataFrame, since: int | None = None) -> DataFrame:
    """Totals of events(timestamp, tokens_used, tokens_saved); `since` (milliseconds) bounds from below unless it is 0 or None."""
    rows = events.where(F.col("timestamp") >= since) if since else events
    used, saved = F.coalesce(F.sum("tokens_used"), F.lit(0)), F.coalesce(F.sum("tokens_saved"), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("n_events"), used.alias("tokens_used"), saved.alias("tokens_saved")).withColumn("savings_percent", saving_percent(F.col("tokens_used"), F.col("tokens_saved")))


def saving_percent(used: Column, saved: Column) -> Column:
    return F.when(used > 0, 100.0 * saved / (used + saved)).otherwise(0.0)


def recent(visits: DataFrame, k: int = 5) -> DataFrame:
    """The k last-seen distinct paths of each session of visits(session, path, at)."""
    from weftline.operators.search import top_k

    return top_k(visits.groupBy("session", "path").agg(F.max("at").alias("at")), ["session"], [F.desc("at"), F.asc("path")], k)
