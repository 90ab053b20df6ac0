"""Exact nearest neighbours: joins of queries with points, with or without predicates.

Results are long: (qid, rk, label, dist), nearest first, ties by label.  The
queries are broadcast while they are few (their number is checked) and dealt
to blocks otherwise; the points stream past each block of queries, which keeps
at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions.predicates import ANY, SKIP, kinds_of, matches
from ..schema import NUMERIC

#: Queries that are sent to every task; beyond that they meet the points in blocks.
MAX_BROADCAST_QUERIES = 20_000
BLOCK_QUERIES = 4096
#: Blocks of queries that the points stream past; more only where a block would hold over 8 * BLOCK_QUERIES.
STREAMS = 24
#: Queries and rows of one matrix product.
CHUNK_QUERIES, CHUNK_ROWS = 256, 4096
#: Pairs of queries and points that are ranked by expressions alone.
PAIRS_BY_EXPRESSION = 20_000_000
OUT = "qid long, label long, dist double"


def _by_label(rare: list) -> dict[int, np.ndarray]:
    """Rows of each label that has no bit."""
    out: dict[int, np.ndarray] = {}
    for i, own in enumerate(rare):
        for x in own if own is not None else ():
            out.setdefault(int(x), np.zeros(len(rare), bool))[i] = True
    return out


def _masks(terms: list, own: dict[str, tuple]) -> np.ndarray:
    """Rows that match a disjunction.

    ``own`` has each attribute's rows: (values,) of a number, (masks, rare) of
    labels, of which 0 to 62 come as bits of a long and others as their rows.
    """
    n = len(next(iter(own.values()))[0]) if own else 0
    out, none = np.zeros(n, bool), np.zeros(n, bool)
    for t in terms:
        ok = np.ones(n, bool)
        for name, cols in own.items():
            asked = t[name] if t[name] is not None else []
            if not len(asked):
                continue
            if len(cols) == 1:
                ok &= np.logical_or.reduce([(cols[0] >= r["lo"]) & (cols[0] <= r["hi"]) for r in asked])
            elif t[f"{name}_mode"] != SKIP:
                masks, rare = cols
                labels = {int(x) for x in asked}
                m = np.int64(sum(1 << x for x in labels if 0 <= x < 63))
                others = [rare.get(x, none) for x in labels if not 0 <= x < 63]
                if t[f"{name}_mode"] == ANY:
                    ok &= np.logical_or.reduce([(masks & m) != 0, *others])
                else:
                    ok &= np.logical_and.reduce([(masks & m) == m, *others])
        out |= ok
    return out


def _best(qids: np.ndarray, q: np.ndarray, terms: list | None, labels: np.ndarray, x: np.ndarray, own: dict[str, tuple] | None, metric: str, k: int | None, self_excluded: bool, limit: float | None) -> list[tuple]:
    """The k best rows of a block for each query, or with a limit and no k all within it: candidates by a matrix product, then exact distances in order."""
    out = []
    for a in range(0, len(qids), CHUNK_QUERIES):
        block = D.rough(metric, q[a : a + CHUNK_QUERIES], x)
        slack = 1e-9 * (1.0 + np.abs(block).max(initial=0.0)) + D.rounding(metric, q[a : a + CHUNK_QUERIES], x)
        for i, d in enumerate(block):
            qid = qids[a + i]
            if terms is not None:
                d = np.where(_masks(terms[a + i], own), d, np.inf)
            if self_excluded:
                d = np.where(labels == qid, np.inf, d)
            if limit is not None:
                near = np.flatnonzero(d <= limit + slack)
            elif len(d) > k:
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1] + slack)
            else:
                near = np.arange(len(d))
            near = near[np.isfinite(d[near])]
            if not len(near):
                continue
            exact = D.exact_pairs(metric, np.broadcast_to(q[a + i], (len(near), q.shape[1])), x[near])
            if limit is not None:
                near, exact = near[exact <= limit], exact[exact <= limit]
            order = np.lexsort((labels[near], exact))[:k]
            out += zip([int(qid)] * len(order), labels[near][order].tolist(), exact[order].tolist())
    return out


class Nearest:
    """The ``k`` best rows of each query among the rows put in so far, bit for bit those of all exact distances.

    A product of matrices finds the rows that can be among the k best: it is
    made in single precision where its error lets few others through, and in double precision otherwise.
    """

    def __init__(self, qids: np.ndarray, q: np.ndarray, metric: str, k: int, self_excluded: bool = False, limit: float | None = None):
        self.metric, self.k, self.self_excluded, self.limit = metric, k, self_excluded, limit
        self.parts = []
        for a in range(0, len(qids), CHUNK_QUERIES):
            own = np.ascontiguousarray(q[a : a + CHUNK_QUERIES], np.float64)
            none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            # queries, their vectors, both forms of the product's left side, held rows (query, label, dist), those not yet merged, bounds, double precision
            self.parts.append({"ids": qids[a : a + CHUNK_QUERIES], "q": own, "left": D.left(metric, own), "best": none, "more": [], "bound": np.full(len(own), np.inf if limit is None else limit), "double": False})

    def add(self, labels: np.ndarray, x: np.ndarray) -> None:
        for a in range(0, len(labels), CHUNK_ROWS):
            own, exact = labels[a : a + CHUNK_ROWS], np.asarray(x[a : a + CHUNK_ROWS], np.float64)
            right = D.right(self.metric, exact)
            for part in self.parts:
                self._meet(part, own, exact, right)

    def _meet(self, part: dict, labels: np.ndarray, x: np.ndarray, right: D.Side) -> None:
        q, first = part["q"], not np.isfinite(part["bound"]).all()
        single = not (first or part["double"]) and D.fits_single(part["left"], right)
        while True:
            d, slack = D.product(self.metric, part["left"], right, single)
            bound = part["bound"]
            if first:
                # a bound from this chunk alone; of a tie or of rows without a finite distance it lets all through
                if self.self_excluded:
                    d[part["ids"][:, None] == labels[None, :]] = np.inf
                if len(labels) > self.k:
                    bound = np.minimum(bound, np.partition(d, self.k - 1, axis=1)[:, self.k - 1] + slack)
            hit = D.places(d <= (np.nextafter((bound + slack).astype(d.dtype), np.array(np.inf, d.dtype)))[:, None])
            if not single or len(hit) <= 1000 + d.size // 50:
                break
            single, part["double"] = False, True
        i, j = np.divmod(hit, len(labels))
        fine = np.isfinite(d[i, j])
        if self.self_excluded:
            fine &= part["ids"][i] != labels[j]
        i, j = i[fine], j[fine]
        for a in range(0, len(i), 1 << 16):
            ia, ja = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            exact = D.exact_pairs(self.metric, q[ia], x[ja])
            near = exact <= bound[ia] + slack if self.limit is None else exact <= self.limit
            part["more"].append((ia[near], labels[ja][near], exact[near]))
        if sum(len(m[0]) for m in part["more"]) > (0 if first else len(q) * self.k // 4):
            self._merge(part)

    def _merge(self, part: dict) -> None:
        if not part["more"]:
            return
        i, label, dist = (np.concatenate(c) for c in zip(part["best"], *part["more"]))
        order = np.lexsort((label, dist, i))
        i, label, dist = i[order], label[order], dist[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        kept = nth < self.k
        last = nth == self.k - 1
        part["bound"][i[last]] = np.minimum(part["bound"][i[last]], dist[last])
        part["best"], part["more"] = (i[kept], label[kept], dist[kept]), []

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(qid, label, dist) of all queries."""
        for part in self.parts:
            self._merge(part)
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*[(p["ids"][p["best"][0]], *p["best"][1:]) for p in self.parts]))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow column of vectors, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = len(column)
    if column.null_count or (n and len(set(np.diff(column.offsets.to_numpy()))) > 1):
        raise ValueError("vectors are null or differ in length")
    return flat.reshape(n, -1)


def _streamed(points: DataFrame, queries: DataFrame, k: int, metric: str, self_excluded: bool, limit: float | None) -> DataFrame:
    """(qid, label, dist): each block of queries is one task, past which all points stream; it sends on ``k`` rows a query."""
    n = queries.count()
    blocks = max(min(-(-n // BLOCK_QUERIES), STREAMS), -(-n // (8 * BLOCK_QUERIES)))
    qs = queries.select(F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("qb"), F.lit(0).alias("side"), F.col("qid").alias("id"), "vector")
    ps = points.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"), F.lit(1).alias("side"), F.col("label").alias("id"), "vector")
    both = qs.unionByName(ps).repartitionById(blocks, F.col("qb")).sortWithinPartitions("qb", "side")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(best: Nearest | None) -> Iterator[pa.RecordBatch]:
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], ["qid", "label", "dist"])

        at, asked, best = None, [], None
        for batch in it:
            qb, side = batch.column("qb").to_numpy(), batch.column("side").to_numpy()
            ends = np.flatnonzero(np.diff(qb) | np.diff(side)) + 1
            for a, b in zip([0, *ends], [*ends, len(qb)]):
                if a == b:
                    continue
                if qb[a] != at:
                    yield from done(best)
                    at, asked, best = qb[a], [], None
                ids, x = batch.column("id").slice(a, b - a).to_numpy(), matrix(batch.column("vector").slice(a, b - a))
                if side[a] == 0:
                    asked.append((ids, x))
                    continue
                if best is None and asked:
                    best = Nearest(np.concatenate([i for i, _ in asked]), np.concatenate([v for _, v in asked]), metric, k, self_excluded, limit)
                    asked = []
                if best is not None:
                    best.add(ids, x)
        yield from done(best)

    return both.mapInArrow(run, OUT)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["qid", "label", "dist"]).astype({"qid": "int64", "label": "int64", "dist": "float64"})


def _dealt(points: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with blocks (qb, pb) of bounded numbers of rows, so that every query meets every point in one pair of them."""
    q_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    p_blocks = max(1, -(-points.count() // (4 * CHUNK_ROWS)))
    qs = queries.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(q_blocks)).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(p_blocks - 1))))
    ps = points.withColumn("pb", F.pmod(F.xxhash64("label"), F.lit(p_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    return ps, qs


def few(queries: DataFrame) -> bool:
    """Whether the queries may be sent to every task."""
    return queries.select("qid").limit(MAX_BROADCAST_QUERIES + 1).count() <= MAX_BROADCAST_QUERIES


def knn(points: DataFrame, queries: DataFrame, k: int | None = 10, metric: str = "l2", predicate: Column | None = None, terms: str | None = None, self_excluded: bool = False, limit: float | None = None) -> DataFrame:
    """(qid, rk, label, dist) of the ``k`` nearest points of each query (qid, vector).

    ``predicate`` is one filter for all queries, which Catalyst pushes to the
    scan; ``terms`` names a column of ``queries`` with each query's own
    disjunction.  Fewer than ``k`` points give fewer rows.  With ``limit`` only
    distances up to it count, and ``k`` may be None for all of them.
    """
    if k is None and limit is None:
        raise ValueError("k or limit is needed")
    if predicate is not None:
        points = points.where(predicate)
    kinds = kinds_of(queries.schema[terms].dataType.elementType) if terms else {}
    cols = [F.col("label").cast("long").alias("label"), "vector"]
    for name, kind in kinds.items():
        if kind == NUMERIC:
            cols.append(F.col(name))
        else:
            cols.append(F.expr(f"aggregate(filter({name}, x -> x >= 0 and x < 63), 0L, (m, x) -> m | shiftleft(1L, x))").alias(f"{name}_mask"))
            cols.append(F.filter(name, lambda x: (x < 0) | (x >= 63)).alias(f"{name}_rare"))
    points = points.select(*cols)
    queries = queries.select(F.col("qid").cast("long").alias("qid"), "vector", *([F.col(terms).alias("terms")] if terms else []))

    def run(qpdf: pd.DataFrame, pdf: pd.DataFrame) -> list[tuple]:
        if not len(qpdf) or not len(pdf):
            return []
        q = np.stack(qpdf["vector"]).astype(np.float64)
        asked = list(qpdf["terms"]) if terms else None
        rows: list[tuple] = []
        for a in range(0, len(pdf), CHUNK_ROWS):
            part = pdf.iloc[a : a + CHUNK_ROWS]
            x = np.stack(part["vector"]).astype(np.float64)
            own = {n: (part[n].to_numpy(),) if kind == NUMERIC else (part[f"{n}_mask"].to_numpy(), _by_label(list(part[f"{n}_rare"]))) for n, kind in kinds.items()}
            rows += _best(qpdf["qid"].to_numpy(), q, asked, part["label"].to_numpy(), x, own, metric, k, self_excluded, limit)
        return rows

    if few(queries):
        sample = queries.toPandas()
        if terms:
            sample["terms"] = [[t.asDict(recursive=True) for t in ts] if ts is not None else [] for ts in sample["terms"]]
        sent = queries.sparkSession.sparkContext.broadcast(sample)

        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if terms is None and k is not None:
                best = None
                for pdf in it:
                    if best is None and len(pdf) and len(sent.value):
                        best = Nearest(sent.value["qid"].to_numpy(), np.stack(sent.value["vector"]).astype(np.float64), metric, k, self_excluded, limit)
                    if best is not None and len(pdf):
                        best.add(pdf["label"].to_numpy(), np.stack(pdf["vector"]))
                if best is not None:
                    yield pd.DataFrame(dict(zip(("qid", "label", "dist"), best.rows())))
                return
            held: list[tuple] = []
            for pdf in it:
                if k is None:  # nothing to choose from, so nothing is held
                    for a in range(0, len(pdf), CHUNK_ROWS):
                        yield _frame(run(sent.value, pdf.iloc[a : a + CHUNK_ROWS]))
                    continue
                held += run(sent.value, pdf)
                if len(held) > 4 * k * max(1, len(sent.value)):
                    held = _frame(held).sort_values(["qid", "dist", "label"]).groupby("qid").head(k).itertuples(index=False, name=None)
                    held = list(held)
            yield _frame(held)

        found = points.mapInPandas(batches, OUT)
    elif terms is None and k is not None:
        found = _streamed(points, queries, k, metric, self_excluded, limit)
    else:
        ps, qs = _dealt(points, queries)  # without k a pair of blocks sends on all it finds

        def pair(key: tuple, qpdf: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
            return _frame(run(qpdf, pdf))

        found = qs.groupBy("qb", "pb").cogroup(ps.groupBy("qb", "pb")).applyInPandas(pair, OUT)
    return ranked(found, k)


def ranked(found: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, rk, label, dist) from (qid, label, dist), nearest first; Spark prunes to ``k`` before the shuffle."""
    rk = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "label"))
    out = found.withColumn("rk", rk.cast("long"))
    if k is not None:
        out = out.where(F.col("rk") <= k)
    return out.select("qid", "rk", "label", "dist")


def knn_expression(points: DataFrame, queries: DataFrame, k: int, metric="l2", predicate: Column | None = None, terms: str | None = None) -> DataFrame:
    """The same by expressions, for custom spaces and as a second opinion; many queries meet the points in blocks.

    Where the pairs are more than PAIRS_BY_EXPRESSION they are not all ranked.
    A metric with a kernel in NumPy (``D.with_kernel``) has that find the
    pairs, whose distances are computed by expression; for others the k-th
    distance among some of the points tells which pairs can't be among the k best.
    """
    if predicate is not None:
        points = points.where(predicate)
    many = terms is None and (n := points.count()) * queries.count() > PAIRS_BY_EXPRESSION
    if many and (kernel := D.kernel_of(metric, points, queries)) is not None:
        near = knn(points, queries, k, kernel).select("qid", "label")
        pairs = near.join(queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").alias("qv")), "qid").join(points.select(F.col("label").cast("long").alias("label"), "vector"), "label")
        return ranked(pairs.select("qid", "label", D.distance(metric, F.col("qv"), F.col("vector")).alias("dist")), k)
    if many:
        share = max(2, int((n / k) ** 0.5))
        some = ranked(_distances(points.where(F.pmod(F.xxhash64("label"), F.lit(share)) == 0), queries, metric), k)
        bound = some.where(F.col("rk") == k).select("qid", F.col("dist").alias("bound"))
        found = _distances(points, queries.select("qid", "vector").join(bound, "qid", "left"), metric, bound=True)
        return ranked(found, k)
    return ranked(_distances(points, queries, metric, terms), k)


def _distances(points: DataFrame, queries: DataFrame, metric, terms: str | None = None, bound: bool = False) -> DataFrame:
    """(qid, label, dist) of all pairs; with ``bound``, a column of the queries, of those up to it, and of all where it is null."""
    more = ["bound"] if bound else []
    q = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").alias("qv"), *([F.col(terms).alias("terms")] if terms else []), *more)
    kinds = kinds_of(queries.schema[terms].dataType.elementType) if terms else {}
    points = points.select("label", "vector", *kinds)
    hit = matches(F.col("terms"), attrs={n: (kind, F.col(n)) for n, kind in kinds.items()}) if terms else F.lit(True)
    if few(q):
        pairs = points.join(F.broadcast(q), hit)
    else:
        ps, qs = _dealt(points, q)
        pairs = ps.join(qs, ["qb", "pb"]).where(hit)
    out = pairs.select("qid", F.col("label").cast("long").alias("label"), D.distance(metric, F.col("qv"), F.col("vector")).alias("dist"), *more)
    if bound:
        out = out.where(F.col("bound").isNull() | F.col("dist").isNull() | (F.col("dist") <= F.col("bound")))
    return out.select("qid", "label", "dist")


def padded(result: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``result`` with exactly k rows for each query: label -1 at infinite distance where points ran out."""
    grid = queries.select(F.col("qid").cast("long").alias("qid")).withColumn("rk", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))))
    out = grid.join(result, ["qid", "rk"], "left")
    return out.select("qid", "rk", F.coalesce("label", F.lit(-1).cast("long")).alias("label"), F.coalesce("dist", F.lit(float("inf"))).alias("dist"))


def strict(result: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``result``; its action fails if a query has fewer than k rows."""
    per = queries.select(F.col("qid").cast("long").alias("qid")).join(result.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left")
    ok = per.agg(F.coalesce(F.min(F.coalesce("n", F.lit(0))), F.lit(k)).alias("least"))
    ok = ok.where(F.assert_true(F.col("least") >= k, F.lit(f"fewer than {k} results for a query")).isNull())
    return result.join(F.broadcast(ok)).drop("least")


def epsilon(points: DataFrame, queries: DataFrame, limit: float, max_candidates: int | None = None, metric: str = "l2", predicate: Column | None = None) -> DataFrame:
    """All points within ``limit`` (for l2: squared), or the nearest ``max_candidates`` of them if that is given."""
    return knn(points, queries, max_candidates, metric, predicate, limit=limit)


def by_document(points: DataFrame, queries: DataFrame, n_docs: int, ef: int = 10, metric: str = "l2", doc: str = "doc_id") -> DataFrame:
    """Nearest vectors until ``n_docs`` documents are met: (qid, rk, label, doc_id, dist).

    All vectors of those documents up to the cut are kept; the cut is where the
    last of the documents is first met.  A search of growing depth avoids
    ranking everything: it stops when every query has met enough documents or all points.
    """
    total = points.count()
    n_q = queries.count()
    k = max(ef, n_docs)
    docs = points.select(F.col("label").cast("long").alias("label"), doc)
    while True:
        near = knn(points, queries, k, metric).join(docs, "label")
        first = near.groupBy("qid", doc).agg(F.min("rk").alias("first"))
        order = first.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("first")))
        cut = order.where(F.col("nth") <= n_docs).groupBy("qid").agg(F.max("first").alias("cut"), F.max("nth").alias("met"))
        if k >= total or cut.where(F.col("met") >= n_docs).count() >= n_q:
            break
        k = min(total, 4 * k)
    return near.join(cut, "qid").where(F.col("rk") <= F.col("cut")).select("qid", "rk", "label", doc, "dist")


def with_stats(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2", predicate: Column | None = None) -> DataFrame:
    """``knn`` with the number of distances computed for each query."""
    live = points if predicate is None else points.where(predicate)
    n = live.agg(F.count(F.lit(1)).alias("n_distances"))
    return knn(points, queries, k, metric, predicate).join(F.broadcast(n))
