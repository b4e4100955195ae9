"""Benchmark datasets, usage logs, event streams of models, rules files and reports."""

from __future__ import annotations

import json
import os
import time

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TASK = "struct<id:string,query:string,targetFilePath:string,candidateFilePaths:array<string>,groundTruth:array<string>,tags:array<string>>"
DATASET = f"name string, family string, variant string, description string, tasks array<{TASK}>"
USAGE = "timestamp long, tokensUsed long, tokensSaved long, model string, searchType string"


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """One row per task of a JSON dataset; no tasks, or one without id, query or truth, is an error."""
    text = F.regexp_replace("value", "^\\uFEFF", "")
    rows = spark.read.text(path, wholetext=True).select(F.from_json(text, DATASET).alias("d")).select("d.*", F.posexplode_outer("d.tasks").alias("pos", "task"))
    bad = rows.where("task is null or coalesce(task.id, '') = '' or coalesce(task.query, '') = '' or coalesce(size(task.groundTruth), 0) < 1")
    if not bad.isEmpty():
        raise ValueError(f"{path}: every dataset needs tasks, and every task an id, a query and a ground truth")
    return rows.select("name", "family", "variant", "pos", "task.*")


def convert_tasks(items: DataFrame) -> DataFrame:
    """Up to 50 tasks of items(pos, id, query, answers, files): the target is the first answer, else the first file; up to 12 distinct candidates; the truth falls back to the target."""
    target = F.coalesce(F.get("answers", 0), F.get("files", 0))
    none = F.array().cast("array<string>")
    files, answers = F.coalesce("files", none), F.array_distinct(F.coalesce("answers", none))
    candidates = F.slice(F.array_distinct(F.filter(F.concat(F.array(target), files), lambda x: x.isNotNull())), 1, 12)
    truth = F.when(F.size(answers) > 0, answers).otherwise(F.filter(F.array(target), lambda x: x.isNotNull()))
    return items.where("pos < 50").select("pos", F.coalesce("id", F.concat(F.lit("rb-"), F.col("pos").cast("string"))).alias("id"), "query", target.alias("target"), candidates.alias("candidates"), truth.alias("truth"))


def track(spark: SparkSession, folder: str, events: list[tuple]) -> None:
    """Appends usage events (timestamp, used, saved, model, search type) as JSON lines."""
    spark.createDataFrame(events, USAGE).write.mode("append").json(folder)


def read_usage(spark: SparkSession, folder: str) -> DataFrame:
    """The usage log; no rows where it can't be read."""
    try:
        rows = spark.read.schema(USAGE).json(folder)
    except (AnalysisException, PySparkException):
        rows = spark.createDataFrame([], USAGE)
    return rows.select("timestamp", F.col("tokensUsed").alias("tokens_used"), F.col("tokensSaved").alias("tokens_saved"), "model", F.col("searchType").alias("search_type"))


def read_rules(spark: SparkSession, paths: list[str], default: str) -> str:
    """The first of the files that can be read and is valid, else the default."""
    from weftline.operators.parsing import validated_rules

    for path in paths:
        try:
            rows = spark.read.text(path, wholetext=True).select(F.lit(1).alias("rules_id"), F.col("value").alias("raw"))
            if validated_rules(rows).where("error is null").count() == 1:
                return rows.first()["raw"].strip()
        except AnalysisException:
            continue
    return default


def server_events(responses: DataFrame) -> DataFrame:
    """(response_id, pos, content, usage) of responses(response_id, raw): data lines up to [DONE]; comments, blank lines and bad JSON are passed over."""
    lines = responses.select("response_id", F.posexplode(F.split("raw", "\r?\n", -1)).alias("pos", "line")).where(F.col("line").startswith("data: "))
    lines = lines.withColumn("body", F.substr("line", F.lit(7)))
    ends = lines.where("body = '[DONE]'").groupBy("response_id").agg(F.min("pos").alias("end"))
    chunk = "struct<choices:array<struct<delta:struct<content:string>>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>"
    parsed = lines.join(ends, "response_id", "left").where("end is null or pos < end").withColumn("chunk", F.from_json("body", chunk))
    return parsed.where("chunk is not null and (chunk.choices is not null or chunk.usage is not null)").select("response_id", "pos", F.get("chunk.choices", 0)["delta"]["content"].alias("content"), "chunk.usage")


def write_summary(path: str, summary: dict) -> None:
    """One JSON file, put in place by a rename."""
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(summary, f, indent=2)
    os.replace(path + ".tmp", path)


def metrics_table(metrics: dict[str, float]) -> str:
    return "\n".join(["| Metric | Value |", "| --- | --- |", *(f"| {k} | {v:.4f} |" for k, v in metrics.items())])


def report(summary: dict) -> str:
    """A benchmark summary as Markdown."""
    d = summary["dataset"]
    out = [f"# Benchmark Report — {d['name']}", "", f"- Family: **{d['family']}**", f"- Variant: **{d['variant']}**", f"- Tasks: **{len(summary['tasks'])}**", f"- Duration: **{summary['durationMs']:.0f} ms**", f"- Timestamp: {summary.get('timestamp', time.strftime('%Y-%m-%dT%H:%M:%SZ', time.gmtime()))}", "", "## Aggregate Metrics", "", metrics_table(summary["aggregate"]), "", "## Task Results", ""]
    for r in summary["tasks"]:
        out += [f"### {r['id']}", "", f"Query: {r['query']}", "", f"Target: {r.get('target') or 'auto-detected'}", f"Ground truth: {', '.join(r['truth'])}", f"Iterations: {r['iterations']}", f"Pass: {'yes' if r['pass'] else 'no'}", "", metrics_table(r["metrics"]), ""]
        if r.get("actions"):
            out += [f"Actions: {', '.join(r['actions'])}", ""]
    return "\n".join(out)


def metric_cell(value: Column) -> Column:
    return F.format_string("%.4f", value)
