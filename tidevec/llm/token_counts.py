"""Token counts: an exact histogram of encoded lengths.

Documents are encoded by a public tokenizer and counted by their number of
tokens.  The histogram has at most ``sqrt(2 * total tokens)`` rows besides the
one for length 0.  Suffix sums over it answer, for every context limit at
once, how many documents reach it, how many tokens they hold, how many tokens
remain when each document is cut at the limit, and exact quantiles.

Defined results: a null or empty text has length 0; special tokens' strings
are ordinary text; very long texts are encoded whole; documents of one length
share a row, so ties need no order; repeated rows count as often as they occur;
an empty table gives an empty histogram; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import written

#: Default place of the vocabulary; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths of one block of the two-level suffix sums.
BLOCK = 1024


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, n_tokens) for each row.  The vocabulary (about 1 MB) is read by the driver and sent once to each executor."""
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(sent.value, pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "id long, n_tokens long").withColumnRenamed("id", id_col)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Per encoded length: docs, tokens, and the sums over it and all longer ones.

    (n_tokens, docs, tokens, docs_from, tokens_from, truncated): ``docs_from``
    and ``tokens_from`` count documents of at least this length; ``truncated``
    is what remains of all tokens when documents are cut at this length.
    Suffix sums run inside blocks of ``BLOCK`` lengths and over the blocks.
    """
    hist = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")).withColumn("tokens", F.col("docs") * F.col("n_tokens"))
    hist = written(hist.withColumn("blk", F.floor(F.col("n_tokens") / BLOCK)), "length-hist")
    later = Window.orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy("blk").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("blk", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"))
    inside = Window.partitionBy("blk").orderBy(F.desc("n_tokens"))
    out = hist.join(blocks, "blk").select(
        "n_tokens", "docs", "tokens",
        (F.col("d") + F.sum("docs").over(inside)).alias("docs_from"),
        (F.col("t") + F.sum("tokens").over(inside)).alias("tokens_from"),
    )
    total = hist.agg(F.sum("tokens").alias("all_tokens"))  # one row
    below = F.col("all_tokens") - F.col("tokens_from")
    return out.join(F.broadcast(total)).select("n_tokens", "docs", "tokens", "docs_from", "tokens_from", (below + F.col("n_tokens") * F.col("docs_from")).alias("truncated"))


def at_limits(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context, docs_over, tokens_over, truncated) for any context limits, from the histogram alone."""
    spark = hist.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context long")
    over = F.col("n_tokens") > F.col("context")
    got = hist.join(F.broadcast(asked)).groupBy("context").agg(
        F.coalesce(F.sum(F.when(over, F.col("docs"))), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.when(over, F.col("tokens"))), F.lit(0)).alias("tokens_over"),
        F.sum(F.col("docs") * F.least("n_tokens", "context")).alias("truncated"),
    )
    return got


def quantiles(hist: DataFrame, at: Sequence[float]) -> DataFrame:
    """(q, n_tokens): the least length that at least a share q of the documents do not exceed."""
    spark = hist.sparkSession
    asked = spark.createDataFrame([(float(x),) for x in at], "q double")
    n = hist.agg(F.sum("docs").alias("all_docs"))
    upto = F.col("all_docs") - F.col("docs_from") + F.col("docs")
    got = hist.join(F.broadcast(n)).join(F.broadcast(asked)).where(upto >= F.greatest(F.lit(1.0), F.ceil(F.col("q") * F.col("all_docs"))))
    return got.groupBy("q").agg(F.min("n_tokens").alias("n_tokens"))
