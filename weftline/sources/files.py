"""Source trees as DataFrames, and graphs as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.graph import Graph, file_id

# Folders that a scan passes over, beside all whose names begin with a dot.
IGNORED = ("node_modules", "dist", "build", "coverage", "benchmarks", "docs")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """files(path, language, content, digest, n_lines) below root: known extensions, no hidden names, no ignored folders."""
    raw = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("content"))
    start = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.url_decode(F.regexp_replace("uri", r"\+", "%2B")), r"^.*?" + "\\Q" + start + "\\E/", "")
    rows = raw.select(path.alias("path"), "content").withColumn("language", T.language_of(F.col("path")))
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda x: x.startswith(".") | x.isin(list(IGNORED)))
    return snapshots(rows.where(~hidden & F.col("language").isNotNull()), every=True)


def snapshots(files: DataFrame, every: bool = False) -> DataFrame:
    """files(path, content) with language, sha1 digest and number of lines; only parsed languages unless `every`."""
    known = files.withColumn("language", T.language_of(F.col("path"))).where("content is not null and language is not null")
    if not every:
        known = known.where(~F.col("language").isin("json", "markdown"))
    return known.select("path", "language", "content", F.sha1("content").alias("digest"), F.size(F.split("content", "\r?\n", -1)).alias("n_lines"))


def file_nodes(files: DataFrame) -> DataFrame:
    """Graph nodes of snapshots: one per file, with the card as the text to embed."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(file_id(F.col("path")).alias("id"), F.lit("file").alias("type"), name.alias("name"), "path", "content", F.lit(1).alias("start_line"), F.col("n_lines").alias("end_line"), F.lit(None).cast("boolean").alias("exported"), T.file_card(F.col("path"), F.col("content")).alias("embedding_text"))


def to_json(graph: Graph) -> DataFrame:
    """(kind, json) rows of a graph."""
    row = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json"))
    return row(graph.nodes, "node").union(row(graph.edges, "edge"))


def from_json(rows: DataFrame, nodes_schema: str, edges_schema: str) -> Graph:
    """The graph of to_json rows; ends of edges aren't checked."""
    of = lambda kind, schema: rows.where(F.col("kind") == kind).select(F.from_json("json", schema).alias("r")).select("r.*")
    return Graph(of("node", nodes_schema), of("edge", edges_schema))
