"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is ``span`` consecutive words of a benchmark item (the whole item, if
it has fewer).  Of each ``span`` words of a document the smallest hash of its
``gram``-word runs is kept; so every window that a document shares with an
item leaves at least one kept hash, and the item has that hash at the place it
belongs to.  Kept hashes are joined with the items' hashes and each hit is
extended to its whole window and compared word by word.

A bit table over the items' hashes, of at most ``2 ** MAX_BITS`` bits, is
tested before the join, so that hashes without a chance are neither sent nor
copied.  It only drops hashes that no item has.  Items of fewer than ``span``
words are looked up by runs of their own length.

Defined results: texts are matched by their words alone; a null or wordless
text is clean and has no words; wordless items are ignored; an item without an
id counts as one item with an empty id; repeated items or rows change nothing
but their own row; very long texts are matched whole; of several equal smallest
hashes in a window all are kept, so ties lose nothing; an empty table of documents
gives an empty result, one of items leaves all clean; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import text_key, unused, written

#: Words after lower-casing A-Z: runs without ASCII signs and spaces.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The bit table has 2 ** MAX_BITS bits at most (256 KB), whatever the benchmark's size.
MAX_BITS = 21
#: The items' hashes are broadcast only up to so many rows (about 32 MB); beyond that the join shuffles.
MAX_BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _grams(words: Column, k: int) -> Column:
    """Hash of each run of ``k`` words."""
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _kept(grams: Column, mins: Column, width: int) -> Column:
    """Places whose hash is the smallest of a window of ``width`` hashes."""
    return F.when(
        F.size(mins) > 0,
        F.filter(
            F.sequence(F.lit(0), F.size(grams) - 1),
            lambda j: F.get(grams, j) == F.greatest(*[F.get(mins, j - d) for d in range(width)]),
        ),
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, span: int = 10, gram: int = 5,
    text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(hits, items hit): per text key the spans of words hit, and the items.

    The first has (key, n_hit, spans: array of (start, end) in words), the
    second (key, items: the items' ids as sorted strings).  ``key`` is
    ``text_key`` of the text; texts without a hit are in neither.
    """
    spark = docs.sparkSession
    wide = span - gram + 1
    # -- the items' windows, each once, with the items that have them
    its = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(item_text)).alias("w"))
    its = its.withColumn("n", F.size("w")).where("n > 0").withColumn("len", F.least(F.col("n"), F.lit(span)))
    wins = its.select("item", "len", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("len")), lambda s: F.slice("w", s + 1, F.col("len")))).alias("win"))
    wins = written(wins.distinct().withColumn("wid", F.xxhash64("win")), "decon-windows")
    only = wins.select("len", "win", "wid").distinct()
    long_grams = only.where(F.col("len") == span).select("len", "win", "wid", F.posexplode(_grams(F.col("win"), gram)).alias("o", "h"))
    short_lens = sorted(r[0] for r in only.where(F.col("len") < span).select("len").distinct().collect())  # span - 1 values at most
    short = [only.where(F.col("len") == k).select("len", "win", "wid", F.lit(0).alias("o"), _grams(F.col("win"), k)[0].alias("h")) for k in short_lens]
    table = written(reduce(DataFrame.unionByName, short, long_grams), "decon-grams")
    n_grams = table.count()
    # -- bit table, fixed in size
    bits = max(10, min(MAX_BITS, (64 * n_grams).bit_length()))
    cell = F.shiftrightunsigned("h", 64 - bits)
    parts = table.groupBy(F.shiftright(cell, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("v")).collect()
    bitmap = [0] * (1 << (bits - 6))
    for r in parts:
        bitmap[r["at"]] = r["v"]
    known = F.expr(f"cast(split('{','.join(map(str, bitmap))}', ',') as array<bigint>)")  # folded to one literal

    def may(h: Column) -> Column:
        at = F.shiftrightunsigned(h, 64 - bits)
        return F.getbit(F.get(known, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

    # -- the documents' kept hashes that the bit table lets through, with the words around them
    d = docs.where(F.col(text_col).isNotNull()).select(text_key(F.col(text_col)).alias("key"), words_of(F.col(text_col)).alias("w"))
    g = d.withColumn("h", _grams(F.col("w"), gram))
    mins = F.when(
        F.size("w") >= span,
        F.transform(F.sequence(F.lit(0), F.size("w") - span), lambda s: F.least(*[F.get(F.col("h"), s + j) for j in range(wide)])),
    ).otherwise(F.array().cast("array<bigint>"))
    g = g.withColumn("m", mins).withColumn("at", _kept(F.col("h"), F.col("m"), wide))
    around = F.transform(
        F.filter("at", lambda j: may(F.get(F.col("h"), j))),
        lambda j: F.struct(
            F.get(F.col("h"), j).alias("h"),
            j.alias("p"),
            F.greatest(j - (span - gram), F.lit(0)).alias("from"),
            F.slice("w", F.greatest(j - (span - gram), F.lit(0)) + 1, F.lit(2 * span - gram)).alias("ctx"),
        ),
    )
    runs = [g.select("key", F.lit(span).alias("len"), F.inline(around))]
    for k in short_lens:
        s = d.withColumn("h", _grams(F.col("w"), k))
        hit = F.transform(
            F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda j: may(F.get(F.col("h"), j))),
            lambda j: F.struct(F.get(F.col("h"), j).alias("h"), j.alias("p"), j.alias("from"), F.slice("w", j + 1, F.lit(k)).alias("ctx")),
        )
        runs.append(s.where(F.size("h") > 0).select("key", F.lit(k).alias("len"), F.inline(hit)))
    grams = reduce(DataFrame.unionByName, runs)
    side = F.broadcast(table) if n_grams <= MAX_BROADCAST_ROWS else table
    start = F.col("p") - F.col("o")
    hits = grams.join(side, ["len", "h"]).where((start >= F.col("from")) & (F.slice("ctx", F.greatest(start - F.col("from"), F.lit(0)) + 1, F.col("len")) == F.col("win")))
    hits = written(hits.select("key", start.alias("s"), (start + F.col("len")).alias("e"), "wid").distinct(), "decon-hits")
    # -- words covered: runs of overlapping windows
    spans = hits.groupBy("key", "s").agg(F.max("e").alias("e"))
    w = Window.partitionBy("key").orderBy("s")
    spans = spans.withColumn("top", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("top").isNull() | (F.col("s") > F.col("top")), 1).otherwise(0)).over(w))
    spans = spans.groupBy("key", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    spans = spans.groupBy("key").agg(F.sum(F.col("e") - F.col("s")).cast("long").alias("n_hit"), F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    found = hits.select("key", "wid").distinct().join(wins.select("wid", "item").distinct(), "wid").select("key", "item").distinct()
    found = found.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return spans, found


def marked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, spans, items, contaminated."""
    spans, found = decontaminate(docs, items, text_col=text_col, **options)
    rows = docs.select(
        F.col(id_col).alias("id"),
        text_key(F.col(text_col)).alias("key"),
        F.coalesce(F.regexp_count(F.translate(F.col(text_col), UPPER, LOWER), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
    )
    out = rows.join(spans, "key", "left").join(found, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        "spans",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def without_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that share no window with an item, with all their columns."""
    spans, _ = decontaminate(docs, items, text_col=text_col, **options)
    (key,) = unused(docs, "text_key")
    bad = spans.select(F.col("key").alias(key)).hint("merge")  # hit texts grow with the corpus
    return docs.withColumn(key, text_key(F.col(text_col))).join(bad, key, "left_anti").select(*docs.columns)
