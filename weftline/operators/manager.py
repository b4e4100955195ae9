"""A base graph with a pending overlay of file changes: opened, recorded, viewed, merged or discarded.

The overlay is a change log (op_seq, op, id, src, dst, ...) as DataFrames of one recorded file each, so recording a file
again replaces its rows without touching the others'. Views are lazy: the log is replayed over the base when read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import Graph, apply_overlay, exported_index, resolve_edges


@dataclass(frozen=True)
class FileSnapshot:
    """One file's node, its symbols' nodes, and their edges with target_path and symbol, as a parser leaves them."""

    file: DataFrame
    symbols: DataFrame
    edges: DataFrame


class GraphBuilderLike(Protocol):
    """What builds graphs: all of it, or one file of it (None where the file is gone)."""

    def build(self) -> Graph: ...
    def snapshot(self, path: str) -> FileSnapshot | None: ...


@dataclass
class Hooks:
    """What to call when an overlay is begun, changed, merged (with the log as JSON lines and the new graph) or dropped."""

    created: Callable[[str], None] | None = None
    updated: Callable[[str], None] | None = None
    committed: Callable[[str, list[str], Graph], None] | None = None
    discarded: Callable[[str], None] | None = None


@dataclass
class Overlay:
    """Change rows by path, in order of their recording."""

    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    begun: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    by_path: dict[str, DataFrame] = field(default_factory=dict)

    def append(self, path: str, rows: DataFrame) -> None:
        """Adds rows(op, rank, ...) of a path after those that it has."""
        known = self.by_path.pop(path, None)
        self.by_path[path] = rows if known is None else known.unionByName(rows.withColumn("rank", F.col("rank") + F.lit(1 << 40)), allowMissingColumns=True)

    def clear(self, path: str) -> None:
        self.by_path.pop(path, None)

    def log(self) -> DataFrame | None:
        """All rows with op_seq: paths in order of their recording, within one by rank. None if nothing is pending."""
        out = None
        for k, (path, rows) in enumerate(self.by_path.items()):
            one = rows.withColumn("op_seq", F.lit(k).cast("long") * F.lit(1 << 44) + F.col("rank")).withColumn("recorded_path", F.lit(path)).drop("rank")
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out


class GraphManager:
    """A store's graph and the changes recorded since it was built."""

    def __init__(self, store, builder: GraphBuilderLike, hooks: Hooks | None = None):
        self.store, self.builder, self.hooks = store, builder, hooks or Hooks()
        self._base: Graph | None = None
        self._overlay: Overlay | None = None
        self._view: Graph | None = None

    def initialize(self, force: bool = False) -> tuple[Graph, str]:
        """The stored graph, or a built one where none is stored or a rebuild is forced; and which of both ('store', 'build')."""
        found = None if force else self.store.load()
        if found is None:
            return self.rebuild(), "build"
        self._base = found
        self._reset()
        return found, "store"

    def rebuild(self) -> Graph:
        built = self.builder.build()
        self.store.save(built)
        self._base = built
        self._reset()
        return built

    @property
    def base(self) -> Graph:
        if self._base is None:
            raise RuntimeError("the graph manager has not been initialized")
        return self._base

    @property
    def pending(self) -> Overlay | None:
        return self._overlay if self._overlay is not None and self._overlay.by_path else None

    def current(self) -> Graph:
        """The base with the pending changes, made once until the next change."""
        if self.pending is None:
            return self.base
        if self._view is None:
            self._view = apply_overlay(self.base, self.pending.log())
        return self._view

    def record(self, path: str) -> Graph:
        """Replaces what the overlay knows of a file by its state now.

        The file's nodes of the base go, with all edges at them; its new nodes and edges are added, targets looked up
        among the exported symbols. Edges of other files to it come back with the next rebuild only.
        """
        base = self.base
        snapshot = self.builder.snapshot(path)
        if self._overlay is None:
            self._overlay = Overlay()
            if self.hooks.created:
                self.hooks.created(self._overlay.id)
        overlay = self._overlay
        overlay.clear(path)
        gone = base.by_path(path).select(F.lit("remove_node").alias("op"), "id", F.lit(0).cast("long").alias("rank"))
        overlay.append(path, gone)
        if snapshot is not None:
            fresh = snapshot.file.unionByName(snapshot.symbols, allowMissingColumns=True)
            working = base.remove_path(path).upsert_nodes(fresh)
            edges = resolve_edges(working.nodes, snapshot.edges, exported_index(working.nodes.where("type <> 'file'")))
            nodes = fresh.withColumns({"op": F.lit("add_node"), "rank": F.lit(1).cast("long")})
            overlay.by_path[path] = gone.unionByName(nodes, allowMissingColumns=True).unionByName(edges.withColumns({"op": F.lit("add_edge"), "rank": F.lit(2).cast("long")}), allowMissingColumns=True)
        self._view = None
        if self.hooks.updated:
            self.hooks.updated(overlay.id)
        return self.current()

    def merge(self) -> Graph:
        """The base rebuilt from the files as they are, and the overlay gone; without changes the base as it is."""
        base = self.base
        if self.pending is None:
            return base
        overlay = self._overlay
        # the log goes to whoever asked for it; it holds the changed files' rows only
        said = overlay.log().toJSON().collect() if self.hooks.committed else []
        built = self.builder.build()
        self.store.save(built)
        self._base = built
        if self.hooks.committed:
            self.hooks.committed(overlay.id, [json.dumps({"id": overlay.id, "begun": overlay.begun}), *said], built)
        self._reset()
        return built

    def discard(self) -> Graph:
        if self._overlay is not None and self.hooks.discarded:
            self.hooks.discarded(self._overlay.id)
        self._reset()
        return self.base

    def clear(self) -> None:
        """Neither store nor manager has a graph from now on."""
        self.store.clear()
        self._base = None
        if self._overlay is not None and self.hooks.discarded:
            self.hooks.discarded(self._overlay.id)
        self._reset()

    def _reset(self) -> None:
        self._overlay = self._view = None
