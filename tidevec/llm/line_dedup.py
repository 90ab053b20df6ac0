"""Line deduplication by overlapping windows of three lines.

Every run of ``width`` consecutive lines is hashed (128 bits).  Of equal
windows in the corpus the first place stays, all later ones are marked, and a
document loses the lines that its marked windows cover together.

Defined results: lines are what stands between newlines; a null or empty text
has no lines; texts of fewer than ``width`` lines lose nothing; very long texts
are split whole; a document's place is its id (null last), then a 64-bit hash of
its text, so ties go to the smaller hash; repeated rows of one id
and text are one document and get the same result; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import written


def repeated_windows(texts: DataFrame, width: int = 3) -> DataFrame:
    """(none, id, h, starts): per document of ``texts`` (none, id, h, text) the first lines of windows that occurred before."""
    lines = texts.where(F.length("text") > 0).select("none", "id", "h", F.split("text", "\n", -1).alias("l")).where(F.size("l") >= width)

    def window(i):
        run = [F.get("l", i + j) for j in range(width)]
        return F.struct(i.alias("i"), F.xxhash64(*run).alias("w1"), F.xxhash64(F.lit(width), *reversed(run)).alias("w2"))

    wins = lines.select("none", "id", "h", F.inline(F.transform(F.sequence(F.lit(0), F.size("l") - width), window)))
    wins = written(wins, "line-windows")
    place = F.struct("none", "id", "h", "i")
    # Partial aggregation keeps one row of a common window for each task.
    lead = wins.groupBy("w1", "w2").agg(F.min(place).alias("lead"), F.max(place).alias("last")).where("lead <> last").drop("last")
    late = wins.join(lead, ["w1", "w2"]).where(place != F.col("lead"))
    return late.groupBy("none", "id", "h").agg(F.collect_set("i").alias("starts"))


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(id, text, starts) to (id, n_lines, spans, kept)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        n, spans, kept = [], [], []
        for text, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            lines = text.split("\n") if text else []
            merged: list[list[int]] = []
            for s in sorted(starts or ()):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = s + width
                else:
                    merged.append([s, s + width])
            at, keep = 0, []
            for s, e in merged:
                keep += lines[at:s]
                at = e
            keep += lines[at:]
            n.append(len(lines))
            spans.append([{"start": s, "end": e} for s, e in merged])
            kept.append("\n".join(keep))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], ["id", "n_lines", "spans", "kept"])


def dedup_lines(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_lines, spans (merged, in lines), kept (the remaining text)."""
    texts = docs.select(
        F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("text"),
    )
    rows = texts.join(repeated_windows(texts, width).hint("merge"), ["none", "id", "h"], "left")  # the same join at every size
    rows = rows.select(F.when(~F.col("none"), F.col("id")).alias("id"), "text", "starts")
    out = rows.mapInArrow(lambda it: _cut(it, width), "id long, n_lines long, spans array<struct<start: long, end: long>>, kept string")
    return out.withColumnRenamed("id", id_col)
