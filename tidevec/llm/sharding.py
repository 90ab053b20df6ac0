"""Sharding: longest-processing-time scheduling of groups that stay together.

Equal texts form a group.  Groups go, largest first, to the shard with the
fewest bytes so far, which a heap yields.  Groups of one size are
interchangeable, so the schedule runs over the histogram of group sizes: one
task streams it from the largest size down with a heap of ``n_shards`` entries
and says how many groups of each size every shard takes.  The histogram has at
most ``sqrt(2 * total bytes)`` rows, as distinct positive sizes that add up to
the total can't be more.  Which groups of a size go where follows a
distributed ranking of their keys.

Defined results: a null text is a group of its own, apart from the empty text,
with no bytes and the CRC of no bytes (0); repeated rows are kept, each with a
slot of its own; a very long text is a group like others, so one shard can be
larger for it; groups of one size go by a hash of their text, shards of one load
by number; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import ranked, written

#: Bytes that every row takes besides its text.
ROW_BYTES = 8


def lpt_quotas(sizes: Iterator[tuple[int, int]], n_shards: int) -> Iterator[tuple[int, int, int]]:
    """(size, shard, groups): how many groups of each size a shard takes.

    ``sizes`` gives (size, number of groups) from the largest size down.  Whole
    rounds over all shards are dealt at once when they keep the heap's order,
    so a size costs about ``n_shards`` steps however many groups it has.
    """
    heap = [(0, k) for k in range(n_shards)]
    for size, n in sizes:
        got = [0] * n_shards
        left = n
        while left:
            low, high = heap[0][0], max(heap)[0]
            # Shards that stay a whole group below the fullest can take several groups before the order matters.
            if left >= n_shards and high - low <= size:
                rounds = left // n_shards
                heap = [(load + rounds * size, k) for load, k in heap]
                heapq.heapify(heap)
                got = [g + rounds for g in got]
                left -= rounds * n_shards
                if not left:
                    break
            load, k = heapq.heappop(heap)
            take = 1
            if heap and size:
                take = max(1, min(left, (heap[0][0] - load) // size))
            heapq.heappush(heap, (load + take * size, k))
            got[k] += take
            left -= take
        yield from ((size, k, g) for k, g in enumerate(got) if g)


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    ``law`` is ``bytes``: the shards' sizes come out near equal, as far as the
    largest group allows.  ``slot`` numbers the rows of a shard from 0 without
    gaps.  ``grown_shard`` is null, as this law says nothing about one more shard.
    """
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("crc"),
            F.coalesce(F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)), F.lit(b"")).alias("grp"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("members"))
    groups = written(groups, "shard-groups")
    n_groups, n_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("members"), F.lit(0))).first()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs():
            for pdf in batches:
                yield from zip(pdf["bytes"].tolist(), pdf["n"].tolist())

        out = []
        for row in lpt_quotas(pairs(), n_shards):
            out.append(row)
            if len(out) >= 50_000:
                yield pd.DataFrame(out, columns=["bytes", "shard", "n"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["bytes", "shard", "n"])

    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"))
    quotas = sizes.repartition(1).sortWithinPartitions(F.desc("bytes")).mapInPandas(deal, "bytes long, shard int, n long")
    upto = Window.partitionBy("bytes").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    quotas = quotas.select("bytes", "shard", F.sum("n").over(upto).alias("last"), "n")
    # A size's quotas as one row of at most n_shards entries, so that each group finds its shard by rank.
    table = quotas.groupBy("bytes").agg(F.sort_array(F.collect_list(F.struct("last", "shard"))).alias("quota"))
    placed = ranked(groups.select("grp", "bytes"), ["bytes"], ["grp"], n_groups, "place").join(table, "bytes")
    placed = placed.select("grp", F.filter("quota", lambda q: q["last"] > F.col("place"))[0]["shard"].alias("shard"))
    out = written(rows.join(placed, "grp"), "shard-placed")
    out = ranked(out.withColumn("ord", F.coalesce("id", F.lit(-1))), ["shard"], ["ord", "grp"], n_rows, "slot")
    return out.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
