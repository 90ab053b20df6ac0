"""An index object over immutable tables, for the calls that users of vector indexes know.

Each mutation makes a new table; nothing runs until a result is asked for.
``save`` and ``load`` keep it as Parquet with a manifest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codebook as C
from ..functions import markers as M
from ..functions.predicates import conjunction, disjunction, flattened, is_disjunction
from ..operators import ann, graph, knn, mutate
from ..schema import FORMAT_VERSION, IndexConfig, SearchConfig, checked
from ..sources import io
from . import planner


class VectorIndex:
    """Points with attributes under one metric: search, mutation, maintenance and snapshots."""

    def __init__(self, spark: SparkSession, cfg: IndexConfig, points: DataFrame | None = None):
        self.spark, self.cfg, self.search_config = spark, cfg, SearchConfig()
        kinds = ", ".join(f"a{i} {'int' if t == 0 else 'array<int>'}" for i, t in enumerate(cfg.attr_types))
        self.schema = f"label long, vector array<float>, {kinds}, deleted boolean"
        self.points = points if points is not None else spark.createDataFrame([], self.schema)
        self.clusters: ann.ClusterIndex | None = None
        self.layers: graph.Layers | None = None
        self.books: list | None = None  # the last codebook, which outlives the clusters
        self.new_deletes = 0
        self.cleaned = False
        self._passed: DataFrame | None = None  # repair candidates that were taken or put aside

    @property
    def edges(self) -> DataFrame | None:
        """The base layer of the graph, if there is one."""
        return self.layers.base if self.layers is not None else None

    def _set_edges(self, edges: DataFrame) -> None:
        self.layers.base = graph.cut(edges)

    def __repr__(self) -> str:
        return f"VectorIndex(space={self.cfg.space!r}, dim={self.cfg.dim})"

    # -- content

    def add_items(self, rows: DataFrame, replace_deleted: bool = False) -> VectorIndex:
        """Insert or overwrite records; with ``replace_deleted`` new labels take the room of deleted ones."""
        rows = checked(rows, self.cfg)
        points = mutate.replaced(self.points, rows) if replace_deleted else mutate.upsert(self.points, rows)
        if points.count() > self.cfg.max_elements:
            raise ValueError("the number of records exceeds the specified limit")
        self.points = points
        self._changed()
        if self.layers is not None:
            self._reconnect(rows.select("label"))
        return self

    def _reconnect(self, labels: DataFrame) -> None:
        """Edges of new or moved records, and of those that were connected to them, searched anew; new ones take their level."""
        cfg = self.cfg
        self._set_edges(mutate.reconnected(self.layers.base, self.points, labels, 2 * cfg.M, cfg.space))
        old = self.layers.upper.select("src").distinct().join(self.points.select("label"), F.col("src") == F.col("label"), "left_semi").withColumnRenamed("src", "label")
        new = graph.levels(self.points.join(labels.select("label").distinct(), "label", "left_semi"), cfg.M, cfg.seed).where("level > 0").select("label")
        if not new.isEmpty():
            top = graph.cut(self.points.join(old.union(new).distinct(), "label", "left_semi"))
            self.layers.upper = graph.cut(mutate.reconnected(self.layers.upper, top, new, cfg.M, cfg.space))
            self.layers.entry = graph.cut(graph.spread_entries(top))

    def _changed(self) -> None:
        self.points = graph.cut(self.points)
        self.clusters = None

    def live(self) -> DataFrame:
        return self.points.where(~F.col("deleted"))

    def get_items(self, labels: DataFrame) -> DataFrame:
        """(label, vector); fails on unknown or deleted labels."""
        got = labels.select("label").join(self.live().select("label", "vector"), "label", "left")
        return got.where(F.assert_true(F.col("vector").isNotNull(), F.concat(F.lit("label not found: "), F.col("label").cast("string"))).isNull())

    def get_ids_list(self) -> DataFrame:
        """All labels, those of deleted records too."""
        return self.points.select("label")

    def get_current_count(self) -> int:
        return self.points.count()

    def get_max_elements(self) -> int:
        return self.cfg.max_elements

    def live_count(self) -> int:
        return self.live().count()

    def resize_index(self, n: int) -> None:
        if n < self.get_current_count():
            raise ValueError("can't shrink below the number of records")
        self.cfg = self.cfg.with_(max_elements=n)

    # -- search

    def _filter(self, predicate: Sequence | None, modes: Sequence | None) -> Column | None:
        if predicate is None:
            return None
        if is_disjunction([predicate]):
            return disjunction(predicate, modes, self.cfg.attr_types, self.cfg.max_cate_size)
        return conjunction(predicate, self.cfg.attr_types, self.cfg.max_cate_size)

    def knn_query(self, queries: DataFrame, k: int = 1, strict: bool = False) -> DataFrame:
        out = knn.knn(self.live(), queries, k, self.cfg.space)
        return knn.strict(out, queries, k) if strict else out

    def knn_query_with_stats(self, queries: DataFrame, k: int = 1) -> DataFrame:
        return knn.with_stats(self.live(), queries, k, self.cfg.space)

    def hybrid_knn_query(self, queries: DataFrame, predicate: Sequence, k: int = 1, pad: bool = False, exact: bool = True) -> DataFrame:
        """One conjunction or disjunction for all queries."""
        if exact or self.clusters is None:
            out = knn.knn(self.live(), queries, k, self.cfg.space, self._filter(predicate, None))
        else:
            out = planner.hybrid(self.clusters, queries, predicate, k, self.search_config)
        return knn.padded(out, queries, k) if pad else out

    def hybrid_knn_query_dnf(self, queries: DataFrame, terms: Sequence | str, modes: Sequence | None = None, k: int = 1) -> DataFrame:
        """One disjunction for all queries, or the name of a column with each query's own."""
        if isinstance(terms, str):
            return knn.knn(self.live(), queries, k, self.cfg.space, terms=terms)
        return knn.knn(self.live(), queries, k, self.cfg.space, disjunction(terms, modes, self.cfg.attr_types, self.cfg.max_cate_size))

    def graph_query(self, queries: DataFrame, k: int = 1, predicate: Sequence | None = None, modes: Sequence | None = None, ef: int = 64, stats: bool = False) -> DataFrame:
        """Search of the layered graph: edges are walked that the predicate's Markers let through, with the routing floor; admission is exact."""
        if self.layers is None:
            raise ValueError("build the graph first")
        knobs = self.search_config
        terms = None if predicate is None else (list(predicate) if is_disjunction([predicate]) else [list(predicate)])
        gate = None
        if terms is not None and knobs.use_markers:
            gate = M.gate(terms, self.codebook(), self.cfg.ft_bits, modes)
        layers = self.layers if gate is None else replace(self.layers, base=self.marker_edges())
        floor = knobs.min_degree if knobs.routing else 0
        return graph.layered_search(layers, self.points, queries, k, max(ef, k) if predicate is None else ef, self.cfg.space, self._filter(predicate, modes), gate, floor, knobs.ef_top, stats)

    def codebook(self) -> list:
        """Slot starts or label slots of each attribute, made of the live records once."""
        if self.books is None:
            self.books = ann.codebooks(self.points, self.cfg)
        return self.books

    def marker_edges(self) -> DataFrame:
        """The base layer's edges with the Markers of what lies behind them."""
        return graph.marker_edges(self.layers.base, ann.marked(self.live(), self.codebook(), self.cfg.ft_bits), self.cfg.ft_bits)

    def epsilon_query(self, queries: DataFrame, limit: float, max_candidates: int | None = None) -> DataFrame:
        return knn.epsilon(self.live(), queries, limit, max_candidates, self.cfg.space)

    def predicate_translate(self, predicates: Sequence) -> list[list[int]]:
        return [flattened(p, self.cfg.attr_types, self.cfg.max_cate_size) for p in predicates]

    # -- index structures

    def build_clusters(self, n_clusters: int | None = None) -> ann.ClusterIndex:
        self.clusters = ann.build(self.points, self.cfg, n_clusters, self.books)
        self.books = self.clusters.books
        return self.clusters

    def register_attr_values(self, rows: DataFrame) -> int:
        """Give unseen labels of every label attribute a slot; the number of labels assigned."""
        if self.books is None:
            raise ValueError("build the clusters or the codebook first")
        added = 0
        for i, book in enumerate(self.books):
            if isinstance(book, dict) and f"a{i}" in rows.columns:
                table = self.spark.createDataFrame(list(book.items()) or [], "label int, slot int")
                more = C.map_of(C.registered(table, rows, f"a{i}", self.cfg.ft_bits))
                added += len(more) - len(book)
                self.books[i] = more
        if self.clusters is not None:
            self.clusters.books = self.books
        return added

    def build_graph(self, m: int | None = None, planned_levels: DataFrame | None = None) -> DataFrame:
        """Both layers of the graph, from candidates of near clusters; the base layer's edges."""
        cfg = self.cfg
        self.layers = graph.build_layers(self.points, m or cfg.M, cfg.ef_construction, cfg.space, cfg.seed, planned=planned_levels)
        self._passed = None
        return self.layers.base

    # -- mutations

    def mark_deleted(self, labels: DataFrame) -> None:
        n = labels.count()
        self.points = mutate.soft_delete(self.points, labels)
        self.new_deletes += n
        self._changed()

    batch_mark_deleted = mark_deleted

    def unmark_deleted(self, labels: DataFrame) -> None:
        self.points = mutate.undelete(self.points, labels, self.cleaned)
        self._changed()

    def delete_items(self, labels: DataFrame, per_dead: int = 3) -> dict[str, int]:
        """Delete and mend the graph in place; counters of what happened.

        Each end of a lost edge gets at most ``per_dead`` replacements out of the
        lost neighbour's own neighbours, in both directions; dead edges go,
        entries that died are replaced.  Markers are made of live records whenever edges get them.
        """
        self.mark_deleted(labels)
        out = {"deleted": labels.count()}
        if self.layers is not None:
            edges, counts = mutate.deleted_in_place(self.layers.base, self.points, labels, 2 * self.cfg.M, self.cfg.space, per_dead)
            self._set_edges(edges)
            self.layers.upper = graph.cut(mutate.scrubbed(self.layers.upper, self.points))
            entry = self.layers.entry.join(self.live().select("label"), "label", "left_semi")
            self.layers.entry = graph.cut(entry if not entry.isEmpty() else graph.spread_entries(self.live()))
            out |= counts | {"edges_after": self.layers.base.count()}
        return out

    def update_point(self, rows: DataFrame) -> None:
        self.points = mutate.updated(self.points, rows, ["vector"])
        self._changed()
        if self.layers is not None:
            self._reconnect(rows.select("label"))

    def update_attr(self, rows: DataFrame) -> None:
        self.points = mutate.updated(self.points, rows, [f"a{i}" for i in range(len(self.cfg.attr_types))])
        self._changed()

    batch_update_attr = update_attr

    def update_point_attr(self, rows: DataFrame) -> None:
        self.points = mutate.updated(self.points, rows, ["vector", *[f"a{i}" for i in range(len(self.cfg.attr_types))]])
        self._changed()
        if self.layers is not None:
            self._reconnect(rows.select("label"))

    batch_update_point_attr = update_point_attr

    # -- maintenance

    def get_deleted_ratio(self) -> float:
        return self.points.agg(F.coalesce(F.avg(F.col("deleted").cast("double")), F.lit(0.0))).first()[0]

    def get_dirty_count(self) -> int:
        return 0 if self.edges is None else mutate.dirty(self.edges, self.points).count()

    def get_repair_candidates(self) -> DataFrame:
        if self.edges is None:
            raise ValueError("build the graph first")
        found = mutate.repair_candidates(self.edges, self.points, self.cfg.repair_ratio)
        return found if self._passed is None else found.join(self._passed, "label", "left_anti")

    def pop_repair_candidates(self, n: int) -> list[int]:
        """Take up to ``n`` candidates, those with the largest dead share first."""
        taken = [r["label"] for r in self.get_repair_candidates().orderBy(F.desc("dead_ratio"), "label").limit(n).collect()]
        self._pass(self.spark.createDataFrame([(x,) for x in taken], "label long"))
        return taken

    def clear_repair_candidates(self) -> None:
        self._pass(self.get_repair_candidates().select("label"))

    def get_repair_candidates_size(self) -> int:
        return self.get_repair_candidates().count()

    def _pass(self, labels: DataFrame) -> None:
        self._passed = graph.cut(labels if self._passed is None else self._passed.union(labels).distinct())

    def repair_candidate_nodes(self) -> int:
        """Search the candidates and points without edges anew; their number."""
        if self.edges is None:
            raise ValueError("build the graph first")
        return self._repair(mutate.repair_nodes(self.edges, self.points, self.cfg.repair_ratio))

    def repair_node(self, label: int) -> bool:
        """Search one live point anew; False if there is none of that label."""
        if self.edges is None:
            raise ValueError("build the graph first")
        return self._repair(self.points.where(F.col("label") == label).select("label")) > 0

    def _repair(self, nodes: DataFrame) -> int:
        live = graph.cut(nodes.join(self.points.where(~F.col("deleted")).select("label"), "label", "left_semi"))
        n = live.count()
        if n:
            self._set_edges(mutate.repaired(self.edges, self.points, live, 2 * self.cfg.M, self.cfg.space))
        return n

    def batched_patch_deletes(self) -> None:
        if self.edges is None:
            raise ValueError("build the graph first")
        self._set_edges(mutate.patched(self.edges, self.points, 2 * self.cfg.M, self.cfg.space))
        self.layers.upper = graph.cut(mutate.scrubbed(self.layers.upper, self.points))
        self.new_deletes, self._passed = 0, None

    def maintain_deletes(self) -> str:
        ratio = self.get_deleted_ratio()
        action = "none"
        if ratio >= self.cfg.rebuild_ratio:
            action = "rebuild"
            self.rebuild_graph()
        elif ratio >= self.cfg.patch_ratio and self.new_deletes >= self.cfg.min_new_deletes:
            action = "patch"
            self.batched_patch_deletes()
        return action

    def rebuild_graph(self) -> int:
        """Drop deleted records and build the graph anew; the number of live records."""
        self.points = graph.cut(mutate.rebuilt(self.points))
        self.clusters, self.new_deletes, self._passed = None, 0, None
        if self.layers is not None:
            self.build_graph()
        return self.points.count()

    def cleanup_deleted_marker_bits(self) -> DataFrame:
        """Edge Markers of live records only; afterwards deleted records can't come back."""
        if self.edges is None:
            raise ValueError("build the graph first")
        self.cleaned = True
        return mutate.cleaned_markers(self.edges, ann.marked(self.points, self.codebook(), self.cfg.ft_bits), self.cfg.ft_bits)

    # -- snapshots

    def save_index(self, path: str, mode: str = "errorifexists") -> None:
        """All there is: records, layers, clusters, codebook, and what maintenance has to remember."""
        tables = {"points": self.points}
        if self.layers is not None:
            tables |= {"edges": self.layers.base, "upper": self.layers.upper, "entry": self.layers.entry}
        if self.clusters is not None:
            tables["clustered"] = self.clusters.points.select("label", "cluster_id", "cluster_dist")
        if self._passed is not None:
            tables["passed"] = self._passed
        state = {"new_deletes": self.new_deletes, "cleaned": self.cleaned, "books": None if self.books is None else ann.books_out(self.books)}
        io.save(path, self.cfg, mode, state=state, **tables)

    @classmethod
    def load_index(cls, spark: SparkSession, path: str, max_elements: int = 0) -> VectorIndex:
        cfg, tables = io.load(spark, path)
        state = io.manifest(spark, path).get("state") or {}
        if max_elements > cfg.max_elements:
            cfg = cfg.with_(max_elements=max_elements)
        out = cls(spark, cfg, tables["points"])
        out.new_deletes, out.cleaned = state.get("new_deletes", 0), state.get("cleaned", False)
        out.books = None if state.get("books") is None else ann.books_in(state["books"])
        out._passed = tables.get("passed")
        if "edges" in tables:
            out.layers = graph.Layers(tables["edges"], tables["upper"], tables["entry"])
        if "clustered" in tables:
            rows = ann.marked(out.points.join(tables["clustered"], "label"), out.books, cfg.ft_bits)
            out.clusters = ann.summarise(rows, out.books, cfg, cfg.ft_bits)
        return out

    def state(self, path: str) -> dict:
        """A dictionary that ``from_state`` makes the index from again, its tables kept under ``path``."""
        self.save_index(path)
        return self.cfg.manifest() | {"path": path}

    @classmethod
    def from_state(cls, spark: SparkSession, state: dict) -> VectorIndex:
        if state.get("format_version") != FORMAT_VERSION:
            raise ValueError(f"state has format {state.get('format_version')}, this code reads {FORMAT_VERSION}")
        return cls.load_index(spark, state["path"])

    def index_file_size(self, path: str) -> int:
        return io.snapshot_bytes(self.spark, path)

    @property
    def format_version(self) -> int:
        return FORMAT_VERSION
