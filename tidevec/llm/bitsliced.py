"""Exact top-k search with a bit-sliced index.

Vectors are quantised to integers and dealt to blocks of ``block_rows`` rows.
A block's index holds, per attribute, one bitmap over its rows for each binary
digit of the attribute.  A query's scores of a whole block are added up in
bitmap arithmetic: the slices that its weight's digits select are summed with
carry-save adders, giving the score itself as bit slices.  The top rows are
read from the most significant slice downward; rows that tie at the cut agree
in every slice, so the smaller ids win there exactly.

The index is a table with one row for each block, made once.  Queries are a
stated set, dealt to blocks as well; every query block meets every row block
once, and only ``k`` rows per query leave a block.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows without an id; a quantised component
of ``LIMIT`` or more, or a result's score that 64 bits don't hold, is an error; a
vector counts as ended by zeros when lengths differ, so an empty one scores 0; very long
vectors make wide blocks, nothing is cut; a query never meets rows of its own id; repeated
rows count as often as they occur; ties go to the smaller id; fewer than ``k``
candidates give fewer rows; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import written

#: Quantised components stay below it, so that differences of two fit 64 bits.
LIMIT = 1 << 62


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit slices of an (attributes, rows) matrix: (attributes, digits, words) and each attribute's least value."""
    low = values.min(axis=1)
    off = (values - low[:, None]).astype(np.uint64)
    digits = max(1, int(off.max()).bit_length())
    n = values.shape[1]
    pad = -n % 64
    out = np.empty((values.shape[0], digits, (n + pad) // 64), np.uint64)
    for i in range(digits):
        bits = ((off >> np.uint64(i)) & np.uint64(1)).astype(np.uint8)
        out[:, i] = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little").view(np.uint64)
    return out, low


def score_slices(slices: np.ndarray, low: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The scores of all rows as bit slices, least significant first, and the amount to add to each.

    An attribute with a negative weight enters with its digits inverted:
    ``-w * x = w * (2**digits - 1 - x) - w * (2**digits - 1)``.
    """
    digits = slices.shape[1]
    full = (1 << digits) - 1
    plus = int(sum(int(w) * int(m) for w, m in zip(query, low)))
    plus += sum(int(w) * full for w in query if w < 0)
    weights = np.abs(query)
    levels: list[list[np.ndarray]] = []
    for j in range(int(weights.max()).bit_length() if len(weights) else 0):
        on = (weights >> j) & 1 == 1
        up, down = slices[on & (query > 0)], ~slices[on & (query < 0)]
        for i in range(digits):
            while len(levels) <= i + j:
                levels.append([])
            levels[i + j] += [x for x in (up[:, i], down[:, i]) if len(x)]
    out = []
    at = 0
    while at < len(levels):
        rows = np.concatenate(levels[at]) if levels[at] else np.zeros((1, slices.shape[2]), np.uint64)
        while len(rows) > 1:
            if len(rows) == 2:
                a, b = rows
                total, carry = (a ^ b)[None], (a & b)[None]
                rest = rows[:0]
            else:
                third = len(rows) // 3
                a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
                ab = a ^ b
                total, carry = ab ^ c, (a & b) | (ab & c)
                rest = rows[3 * third :]
            if at + 1 == len(levels):
                levels.append([])
            levels[at + 1].append(carry)
            rows = np.concatenate([total, rest]) if len(rest) else total
        out.append(rows[0])
        at += 1
    return out, plus


def top_rows(score: list[np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the ``k`` highest scores among ``alive``, the first rows winning ties."""
    sure, maybe = np.zeros_like(alive), alive.copy()
    have = 0
    for bits in reversed(score):
        up = maybe & bits
        n = int(np.bitwise_count(up).sum())
        if have + n > k:
            maybe = up
        else:
            sure |= up
            have += n
            maybe &= ~bits
            if have == k:
                return rows_in(sure)
    return np.concatenate([rows_in(sure), rows_in(maybe)[: k - have]])


def rows_in(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def value_at(score: list[np.ndarray], row: int) -> int:
    return sum(int(s[row >> 6] >> np.uint64(row & 63) & np.uint64(1)) << i for i, s in enumerate(score))


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) as array<bigint>; null where the vector takes no part, an error beyond ``LIMIT``."""
    x = F.transform(vector, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    fine = F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))
    held = F.forall(vector, lambda v: F.abs(v.cast("double") * scale) < float(LIMIT))
    return F.when(fine, F.when(held, x).otherwise(F.raise_error(F.lit("a component is too large for 64 bits"))))


def _matrix(vectors: list) -> np.ndarray:
    wide = max(1, max(len(v) for v in vectors))
    if all(len(v) == wide for v in vectors):
        return np.stack(vectors).astype(np.int64)
    out = np.zeros((len(vectors), wide), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(
    queries: DataFrame, rows: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding",
    block_rows: int = 8192, block_queries: int = 512,
) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` best rows by integer inner product."""
    cand = rows.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col), scale).alias("v")).where("id is not null and v is not null")
    qs = queries.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col), scale).alias("v")).where("id is not null and v is not null")
    cand, qs = written(cand, "bsi-rows"), written(qs, "bsi-queries")
    n_cand, n_q = cand.count(), qs.count()
    row_blocks, query_blocks = max(1, -(-n_cand // block_rows)), max(1, -(-n_q // block_queries))
    deal = lambda df, n: df.withColumn("blk", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int"))

    def index(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        slices, low = slices_of(np.ascontiguousarray(_matrix(list(pdf["v"])).T))
        return pd.DataFrame({"row_blk": [key[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "low": [low.astype(np.int64).tobytes()], "wide": [slices.shape[0]], "digits": [slices.shape[1]], "slices": [slices.tobytes()]})

    made = deal(cand, row_blocks).groupBy(F.col("blk").alias("row_blk")).applyInPandas(index, "row_blk int, ids binary, low binary, wide int, digits int, slices binary")
    made = written(made, "bsi-index")
    # Every query block is sent to every row block: a stated query set against all rows, in blocks.
    sent = deal(qs, query_blocks).withColumn("row_blk", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    met = made.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def search(key: tuple, qpdf: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(block) and len(qpdf):
            b = block.iloc[0]
            ids, low, wide = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["low"], np.int64), int(b["wide"])
            slices = np.frombuffer(b["slices"], np.uint64).reshape(wide, int(b["digits"]), -1)
            everyone = np.packbits(np.pad(np.ones(len(ids), np.uint8), (0, -len(ids) % 64)), bitorder="little").view(np.uint64)
            for qid, qv in zip(qpdf["id"], qpdf["v"]):
                w = np.zeros(wide, np.int64)
                w[: min(wide, len(qv))] = qv[:wide]
                score, plus = score_slices(slices, low, w)
                alive = everyone
                lo, hi = np.searchsorted(ids, [qid, qid + 1])
                if hi > lo:
                    alive = everyone.copy()
                    for r in range(lo, hi):
                        alive[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
                out += [(int(qid), int(ids[r]), value_at(score, int(r)) + plus) for r in top_rows(score, alive, k)]
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype("int64")

    found = sent.groupBy("row_blk", "blk").cogroup(met.groupBy("row_blk", "blk")).applyInPandas(search, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "id", "score")
