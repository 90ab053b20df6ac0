"""Suffix-array deduplication of byte runs.

Every byte that lies in a ``span``-byte string which also starts earlier is
removed.  Suffixes are dealt out by content: the ``span``-byte strings that
start in a text are named after their anchor, the place of the smallest hash of
``GRAM`` bytes in them.  Equal strings have equal anchors, so all
occurrences of a string meet wherever they come from.  Only hashes and places
travel until bytes are needed, and the plan is the same at every size:

1. Count the anchors' hashes over all texts and join the anchors with the
   repeated ones: strings of an anchor that occurs once can't repeat.
2. An anchor's surroundings are the bytes of all strings named after it, sent as
   a hash.  Where the same surroundings stand earlier, all of the later ones'
   strings are repeats, whatever their number.
3. What is left are first occurrences of different surroundings of the same
   anchor, as at both ends of a passage.  Only their bytes are fetched from the
   texts.  Their suffixes are sorted by the difference-cover algorithm: sampled
   triples are sorted and named, names are recursed on, the remaining suffixes
   are merged, and adjacent prefixes of ``span`` bytes are compared.

An anchor with more than ``HOT`` different surroundings (a short, very common
line) isn't sorted in one task: its strings are named by 128-bit hashes, which
Spark aggregates and joins.

Defined results: a null text is empty; texts shorter than ``span`` bytes lose
nothing; very long texts are looked at in overlapping segments and lose no
string; a document's place is its id (null last), then a 64-bit hash of its
text, so ties go to the smaller hash; repeated rows of one id and text are one
document and get the same result; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import BYTE_WORD, U, flat, mixed, pieces, powers, prefix_sums, run_hash
from ._util import discarded, shared_dir, written

#: Bytes of an anchor's hash.
GRAM = 24
#: Different surroundings of one anchor that one task sorts.
HOT = 4096
#: Bytes that one suffix array covers at least, if there are as many.
SORT_BYTES = 1 << 20
#: Bytes of a long text that are looked at in one go, and the place bits that this needs.
SEGMENT, PLACE_BITS = 1 << 23, 24


def anchors_of(buf: np.ndarray, off: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start, anchor's hash, running sums) of the texts of a piece."""
    none = np.zeros(0, np.int64)
    n = len(buf)
    if n < span:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    sums = prefix_sums(buf)
    _, inv = powers(n + 1)
    h = mixed((sums[GRAM:] - sums[:-GRAM]) * inv[: n - GRAM + 1])
    low = U((1 << PLACE_BITS) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, have = span - GRAM + 1, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: n - span + 1], m[width - have :])
    ok = np.zeros(n + 1, np.int32)
    lens = np.diff(off)
    fit = lens >= span
    np.add.at(ok, off[:-1][fit], 1)
    np.add.at(ok, (off[1:] - span + 1)[fit], -1)
    starts = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64), sums
    at = (m[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    first = starts[new]
    last = starts[np.concatenate([new[1:], [len(starts)]]) - 1]
    return at[new], first, last, h[at[new]], sums


def _segments(off: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, offsets) of pieces; long texts come in segments that overlap by span - 1 bytes."""
    for i, j in pieces(off):
        if off[j] - off[i] <= SEGMENT + span:
            yield np.arange(i, j), off[i : j + 1]
        else:
            for a in range(int(off[i]), int(off[j]) - span + 1, SEGMENT):
                yield np.arange(i, j), np.array([a, min(a + SEGMENT + span - 1, int(off[j]))])


def _counted(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """(id, h, text) to (g, n): anchors' hashes and their number, 2 standing for more."""
    for b in batches:
        buf, off = flat(b.column(2))
        held: list[np.ndarray] = []
        for _, o in _segments(off, span):
            held.append(anchors_of(buf[o[0] : o[-1]], o - o[0], span)[3])
        g, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        for a in range(0, len(g), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(g[a : a + (1 << 17)].view(np.int64)), pa.array(np.minimum(n[a : a + (1 << 17)], 2).astype(np.int32))], ["g", "n"])


ANCHORS = "g long, c long, id long, h long, first long, last long"


def _anchors(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """(id, h, text) to the anchors: their hash, their surroundings' hash, and the first and last string named after them."""
    for b in batches:
        buf, off = flat(b.column(2))
        for rows, o in _segments(off, span):
            base = int(o[0])
            at, first, last, g, sums = anchors_of(buf[base : int(o[-1])], o - base, span)
            if not len(at):
                continue
            c = mixed(run_hash(sums, first, last + span) + (at - first).astype(np.uint64) * U(0x9FB21C651E98DF25))
            doc = rows[np.searchsorted(o - base, first, side="right") - 1]
            begin = base + first - off[doc]
            cols = [pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array(begin), pa.array(begin + (last - first))]
            for a in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_arrays([x[a : a + (1 << 16)] for x in cols], ["g", "c", "id", "h", "first", "last"])


REST = "g long, id long, h long, first long, bytes binary, rivals long"


def _fetched(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """(id, h, text, asked: array of (g, first, wide, rivals)) to the asked surroundings with their bytes."""
    for b in batches:
        buf, off = flat(b.column(2))
        lists = b.column(3)
        asked = lists.flatten()
        row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
        g, first, wide, rivals = (asked.field(k) for k in range(4))
        start = off[row] + first.to_numpy()
        size = wide.to_numpy() + span
        for a in range(0, len(row), 8192):
            cut = slice(a, a + 8192)
            ends = np.concatenate([[0], np.cumsum(size[cut])])
            take = np.repeat(start[cut] - ends[:-1], size[cut]) + np.arange(ends[-1])
            data = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(buf[take].tobytes())])
            which = pa.array(row[cut])
            yield pa.RecordBatch.from_arrays([g[cut], b.column(0).take(which), b.column(1).take(which), first[cut], data, rivals[cut]], ["g", "id", "h", "first", "bytes", "rivals"])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a sequence of positive integers, by a difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = s.astype(np.int64)
    p = np.concatenate([s, np.zeros(3, np.int64)])
    k = int(p.max()) + 1
    pair = np.unique(p[: n + 2] * k + p[1 : n + 3], return_inverse=True)[1].astype(np.int64)
    # -- sort the sampled triples and name them (n itself is sampled when n % 3 == 1, to end the first half)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names = np.unique(pair[sample] * k + p[sample + 2], return_inverse=True)[1].astype(np.int64) + 1
    rank = np.zeros(n + 3, np.int64)
    if names.max() < len(names):
        order = sample[suffix_array(names)]  # -- recurse on names
    else:
        order = sample[np.argsort(names, kind="stable")]
    rank[order] = np.arange(1, len(order) + 1)
    order = order[order < n]
    # -- the remaining suffixes follow from one symbol and a sampled rank
    rest = np.arange(0, n, 3)
    wide = n + 4
    rest = rest[np.argsort(p[rest] * wide + rank[rest + 1], kind="stable")]
    # -- merge: how many sampled suffixes of either kind come before each
    in_one, in_two = order[order % 3 == 1], order[order % 3 == 2]
    before = np.searchsorted(p[in_one] * wide + rank[in_one + 1], p[rest] * wide + rank[rest + 1])
    before = before + np.searchsorted(pair[in_two] * wide + rank[in_two + 2], pair[rest] * wide + rank[rest + 2])
    out = np.empty(n, np.int64)
    place = before + np.arange(len(rest))
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = order
    return out


def later_starts(texts: list[bytes], span: int, places: list[tuple]) -> list[np.ndarray]:
    """For each run of bytes, the starts whose ``span`` bytes also start at an earlier place.

    ``places`` has the sortable place of each run's first byte, its last entry
    counting bytes.
    """
    lens = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(lens + 1)
    begin = ends - lens - 1
    whole = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 2
    whole[ends - 1] = 1  # a sign of its own between the runs
    order = suffix_array(whole)
    run = np.searchsorted(ends, order, side="right")
    fits = order + span <= ends[run] - 1
    order, run = order[fits], run[fits]
    if not len(order):
        return [np.zeros(0, np.int64) for _ in texts]
    raw = (whole - 2).astype(np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(raw, span)
    new = np.ones(len(order), bool)  # compare adjacent prefixes
    for a in range(1, len(order), 1 << 16):
        b = min(a + (1 << 16), len(order))
        new[a:b] = (view[order[a:b]] != view[order[a - 1 : b - 1]]).any(axis=1)
    group = np.cumsum(new)
    heads = sorted({p[:-1] for p in places})
    number = {p: i for i, p in enumerate(heads)}
    doc = np.array([number[p[:-1]] for p in places], np.int64)[run]
    start = np.array([p[-1] for p in places], np.int64)[run] + order - begin[run]
    by = np.lexsort((start, doc, group))
    lead = np.concatenate([[True], group[by][1:] != group[by][:-1]])
    g_doc, g_start = doc[by][lead], start[by][lead]
    which = np.cumsum(lead) - 1
    late = (doc[by] != g_doc[which]) | (start[by] != g_start[which])
    hit, hit_run = order[by][late], run[by][late]
    back = np.lexsort((hit, hit_run))
    hit, hit_run = hit[back], hit_run[back]
    cut = np.searchsorted(hit_run, np.arange(len(texts) + 1))
    return [hit[cut[i] : cut[i + 1]] - begin[i] for i in range(len(texts))]


def _sorted_groups(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Rows (g, id, h, first, bytes) in order of g, to (id, h, start, end) of repeats."""
    rows: list[tuple] = []
    size, last = 0, None

    def solve() -> pa.RecordBatch:
        places = [(i is None, i or 0, h, f) for _, i, h, f, _ in rows]
        late = later_starts([x for *_, x in rows], span, places)
        out = []
        for (_, i, h, f, _), starts in zip(rows, late):
            if len(starts):
                brk = np.flatnonzero(np.diff(starts) > span)
                for a, b in zip(np.concatenate([[0], brk + 1]), np.concatenate([brk, [len(starts) - 1]])):
                    out.append((i, h, f + int(starts[a]), f + int(starts[b]) + span))
        cols = list(zip(*out)) if out else [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "h", "start", "end"])

    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(5))):
            if size >= SORT_BYTES and row[0] != last:
                yield solve()
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
            last = row[0]
    if rows:
        yield solve()


_SECOND_WORD = mixed(BYTE_WORD * U(0xD6E8FEB86659FD93)) | U(1)


def _windows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Rows (g, id, h, first, bytes) to (w1, w2, id, h, start): each string by a 128-bit hash."""
    for b in batches:
        buf, off = flat(b.column(4))
        for i, j in pieces(off):
            o = off[i : j + 1] - off[i]
            size = np.diff(o) - span + 1
            row = np.repeat(np.arange(i, j), size)
            within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            start = o[row - i] + within
            piece = buf[off[i] : off[j]]
            w1, w2 = (run_hash(prefix_sums(piece, words), start, start + span).view(np.int64) for words in (BYTE_WORD, _SECOND_WORD))
            which = pa.array(row)
            at = b.column(3).to_numpy()[row] + within
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), b.column(1).take(which), b.column(2).take(which), pa.array(at)], ["w1", "w2", "id", "h", "start"])


def repeated_spans(texts: DataFrame, span: int = 100) -> DataFrame:
    """(none, idk, h, spans): per document of ``texts`` (id, h, text) the byte spans, possibly overlapping, that also stand earlier.

    ``none`` says that the id is null, ``idk`` is the id or 0.  A document has a few spans for each anchor at most.
    """
    spark = texts.sparkSession
    shared_dir(spark)
    doc = ["none", "idk", "h"]
    named = lambda df: df.withColumn("none", F.col("id").isNull()).withColumn("idk", F.coalesce("id", F.lit(0)))
    counted = texts.mapInArrow(lambda it: _counted(it, span), "g long, n int")
    twice = written(counted.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"), "suf-anchors")
    # Joins by sort and merge at every size: Spark can split a hot anchor's rows, and no side is ever sent whole.
    near = written(texts.mapInArrow(lambda it: _anchors(it, span), ANCHORS).join(twice.hint("merge"), "g"), "suf-near")
    discarded(twice)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "first")
    kinds = near.groupBy("g", "c").agg(F.min(place).alias("lead"), F.min(F.col("last") - F.col("first")).alias("wide"), F.count(F.lit(1)).alias("n"))
    kinds = written(kinds, "suf-kinds")
    whole = near.join(kinds.where("n > 1").select("g", "c", "lead").hint("merge"), ["g", "c"]).where(place != F.col("lead"))
    whole = written(whole.select("id", "h", F.col("first").alias("start"), (F.col("last") + span).alias("end")), "suf-whole")
    discarded(near)
    # -- first occurrences whose anchor has other surroundings too: only their bytes are fetched
    rivals = kinds.groupBy("g").agg(F.count(F.lit(1)).alias("rivals")).where("rivals > 1")
    contested = kinds.join(rivals.hint("merge"), "g").select("lead.none", F.coalesce("lead.id", F.lit(0)).alias("idk"), "lead.h", F.struct("g", "lead.first", "wide", "rivals").alias("x"))
    asked = contested.groupBy(*doc).agg(F.collect_list("x").alias("asked"))
    once = named(texts).select(*doc, "text").dropDuplicates(doc)
    rest = once.join(asked.hint("merge"), doc).select(F.when(~F.col("none"), F.col("idk")).alias("id"), "h", "text", "asked")
    rest = written(rest.mapInArrow(lambda it: _fetched(it, span), REST), "suf-rest")
    discarded(kinds)
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cols = ("g", "id", "h", "first", "bytes")
    few = rest.where(F.col("rivals") <= HOT).select(*cols).repartition(n_parts, "g").sortWithinPartitions("g")
    ends = few.mapInArrow(lambda it: _sorted_groups(it, span), "id long, h long, start long, end long")
    hot = rest.where(F.col("rivals") > HOT).select(*cols)
    wins = written(hot.mapInArrow(lambda it: _windows(it, span), "w1 long, w2 long, id long, h long, start long"), "suf-windows")
    here = F.struct(F.col("id").isNull().alias("none"), "id", "h", "start")
    lead = wins.groupBy("w1", "w2").agg(F.min(here).alias("lead"), F.max(here).alias("end")).where("lead <> end").select("w1", "w2", "lead")
    late = wins.join(lead.hint("merge"), ["w1", "w2"]).where(here != F.col("lead"))
    found = whole.unionByName(ends).unionByName(late.select("id", "h", "start", (F.col("start") + span).alias("end")))
    per = written(named(found).groupBy(*doc).agg(F.collect_set(F.struct("start", "end")).alias("spans")), "suf-spans")
    discarded(whole, rest, wins)
    return per


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans packed as start, end, ...) to (id, n_bytes, spans, kept)."""
    for b in batches:
        ids, texts, packed = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
        n, spans, kept = [], [], []
        for text, flat_spans in zip(texts, packed):
            raw = (text or "").encode()
            merged: list[list[int]] = []
            pairs = sorted((x["start"], x["end"]) for x in flat_spans or ())
            for s, e in pairs:
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            at, keep = 0, []
            for s, e in merged:
                keep.append(raw[at:s])
                at = e
            keep.append(raw[at:])
            n.append(len(raw))
            spans.append([{"start": s, "end": e} for s, e in merged])
            kept.append(b"".join(keep))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, span: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans (merged, in bytes), kept (the remaining bytes)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    per = repeated_spans(texts, span).hint("merge")  # the same join at every size
    rows = texts.withColumn("idk", F.coalesce("id", F.lit(0))).withColumn("none", F.col("id").isNull())
    rows = rows.join(per, ["none", "idk", "h"], "left").select("id", "text", "spans")
    out = rows.mapInArrow(_cut, "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
