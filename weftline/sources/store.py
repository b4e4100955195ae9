"""Graph stores: views of the session, and snapshots as Parquet with a manifest of validity.

A snapshot's files never change. Saving writes nodes and edges first and the manifest row last, so readers see either the
old snapshot or the new one. The manifest is an append-only log; the latest open row of a namespace is its snapshot.
"""

from __future__ import annotations

import time
import uuid
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.graph import Graph


class GraphStore(Protocol):
    def load(self) -> Graph | None: ...
    def save(self, graph: Graph) -> None: ...
    def clear(self) -> None: ...


class MemoryStore:
    """Holds the DataFrames themselves, which nothing can change."""

    def __init__(self):
        self._graph: Graph | None = None

    def load(self) -> Graph | None:
        return self._graph

    def save(self, graph: Graph) -> None:
        self._graph = graph

    def clear(self) -> None:
        self._graph = None


class SnapshotStore:
    """Versioned snapshots of one namespace below a shared folder."""

    MANIFEST = "namespace string, snapshot_id string, at long, event string"

    def __init__(self, spark: SparkSession, folder: str, namespace: str = "default"):
        self.spark, self.folder, self.namespace = spark, folder.rstrip("/"), namespace

    def _log(self, snapshot: str, event: str) -> None:
        self.spark.createDataFrame([(self.namespace, snapshot, time.time_ns(), event)], self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def versions(self) -> DataFrame:
        """(snapshot_id, valid_from, valid_to) of the namespace; a snapshot is valid until the next event."""
        from pyspark.sql import Window

        rows = self.spark.read.schema(self.MANIFEST).parquet(f"{self.folder}/manifest").where(F.col("namespace") == self.namespace)
        return rows.withColumn("valid_to", F.lead("at").over(Window.orderBy("at"))).where("event = 'save'").select("snapshot_id", F.col("at").alias("valid_from"), "valid_to")

    def active(self) -> str | None:
        try:
            found = self.versions().where("valid_to is null").orderBy(F.desc("valid_from")).limit(1).collect()
        except AnalysisException:  # no manifest yet
            return None
        return found[0][0] if found else None

    def save(self, graph: Graph) -> None:
        snapshot = uuid.uuid4().hex
        graph.nodes.write.parquet(f"{self.folder}/nodes/namespace={self.namespace}/snapshot_id={snapshot}")
        graph.edges.write.partitionBy("type").parquet(f"{self.folder}/edges/namespace={self.namespace}/snapshot_id={snapshot}")
        self._log(snapshot, "save")

    def load(self, snapshot: str | None = None) -> Graph | None:
        if (snapshot := snapshot or self.active()) is None:
            return None
        read = lambda kind: self.spark.read.parquet(f"{self.folder}/{kind}/namespace={self.namespace}/snapshot_id={snapshot}")
        return Graph(read("nodes"), read("edges"))

    def clear(self) -> None:
        """The namespace has no snapshot from now on; its files stay for whoever still reads them."""
        self._log("", "clear")


def open_store(kind: str = "memory", spark: SparkSession | None = None, folder: str | None = None, namespace: str = "default") -> GraphStore:
    return SnapshotStore(spark, folder, namespace) if kind == "snapshot" else MemoryStore()


def metadata_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def parsed_metadata(raw: Column) -> Column:
    """A map of strings: {} for null, {value: raw} for what is no JSON object."""
    empty = F.create_map().cast("map<string,string>")
    return F.when(raw.isNull() | (raw == ""), empty).otherwise(F.coalesce(F.from_json(F.when(F.trim(raw).startswith("{"), raw), "map<string,string>"), F.create_map(F.lit("value"), raw)))


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The embedding cache: (hash, embedding, updated_at); empty where none is yet."""
    schema = "hash string, embedding array<double>, updated_at long"
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def flush_cache(new: DataFrame, folder: str) -> None:
    """Appends new rows(hash, embedding); nothing is rewritten."""
    new.select("hash", F.col("embedding").cast("array<double>").alias("embedding"), F.unix_millis(F.current_timestamp()).alias("updated_at")).write.mode("append").parquet(folder)
