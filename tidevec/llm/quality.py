"""Quality classifier: a weak-label model trains a hashed linear scorer.

Overlapping heuristic labellers vote on every document: clean, junk, or no
opinion.  Documents with the same votes are alike to the label model, so
expectation-maximisation runs over the counts of vote patterns of the whole
corpus (``3 ** len(LABELLERS)`` patterns at most) and estimates how often each
labeller is right on clean and on junk documents.  The posterior of its pattern
is a document's label.  A linear scorer over hashed features is then fitted to
the posteriors and scores every document.

The scorer is fitted on at most ``train_rows`` documents (a documented bound:
those with the least text hashes); votes, counts, label model and scores cover
all documents.

Defined results: a null or wordless text has score 0 and is rejected; equal
texts have equal scores; repeated rows are scored alike; very long texts are
measured whole; a score of exactly the threshold is kept; an empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import U, flat, mixed, pieces, prefix_sums, run_hash
from ._util import text_key

LABELLERS = ("signs", "capitals", "bars", "marked_words", "top_word", "distinct", "repeats", "word_length", "short_words", "sentences", "echo")
#: (junk below, clean from, clean to, junk above) a labeller's measure; in between it has no opinion.
LIMITS = {
    "signs": (-1.0, 0.0, 0.02, 0.06),  # share of bytes that are signs other than sentence marks
    "capitals": (-1.0, 0.0, 0.15, 0.40),  # share of letters that are capitals
    "bars": (-1.0, 0.0, 0.03, 0.20),  # share of words without a letter or digit
    "marked_words": (-1.0, 0.0, 0.05, 0.25),  # share of words that end in two signs
    "top_word": (-1.0, 0.0, 0.12, 0.30),  # share of the commonest word
    "distinct": (0.45, 0.70, 1.0, 2.0),  # distinct words to the square root rule, see ``measures``
    "repeats": (-1.0, 0.0, 0.10, 0.30),  # share of five-word runs that occurred before in the text
    "word_length": (1.8, 2.8, 9.0, 14.0),  # mean characters of a word
    "short_words": (0.02, 0.10, 0.95, 1.1),  # share of words of three letters or fewer
    "sentences": (0.004, 0.02, 0.45, 0.90),  # share of words that end in a sentence mark
    "echo": (-1.0, 0.0, 0.10, 0.25),  # share of words that equal one of the three before
}
#: Fewer words than this and a labeller that needs statistics has no opinion.
LEAST_WORDS = 8
WORD_BUCKETS, SHAPE_BUCKETS = 1024, 1024
N_FEATURES = WORD_BUCKETS + SHAPE_BUCKETS

# -- byte classes (fixed values)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
KIND = np.full(256, 10, np.uint8)  # other signs
KIND[[0x20, 9, 11, 12, 13]] = 0
KIND[10] = 1
KIND[97:123] = 2
KIND[65:91] = 3
KIND[48:58] = 4
KIND[[ord(c) for c in ".?"]] = 5
KIND[[ord(c) for c in ",;:'\"()-"]] = 6
KIND[[ord(c) for c in "!"]] = 7
KIND[[ord(c) for c in "|"]] = 8
KIND[[ord(c) for c in "#*$%&@"]] = 9
KIND[0x80:0xC0] = 11  # inside a character
KIND[0xC0:] = 12
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return (c[off[1:]] - c[off[:-1]]).astype(np.float64)


def measures(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, the labellers' measures, word starts' text numbers, word hashes) of a piece."""
    n_docs = len(off) - 1
    out = np.zeros((n_docs, len(LABELLERS)))
    if len(buf) == 0:
        return np.zeros(n_docs, np.int64), out, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kind = KIND[buf]
    word = ~SPACE[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, starts, side="right") - 1
    bound = np.searchsorted(starts, off)
    n = np.diff(bound)
    some = np.maximum(n, 1)
    h = run_hash(prefix_sums(LOWER[buf]), starts, ends)
    sign = (kind >= 7) & (kind <= 10)
    upper = (kind == 3).astype(np.int8)
    # Capitals of two-byte Latin letters: C3 followed by 80 to 9E.
    upper[:-1] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    letters = (kind == 2) | (kind == 3) | (kind == 12)
    chars = kind != 11
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=n_docs)
    out[:, 0] = _sums(sign, off) / np.maximum(_sums(word, off), 1)
    out[:, 1] = _sums(upper, off) / np.maximum(_sums(letters, off), 1)
    alnum = np.concatenate([[0], np.cumsum(letters | (kind == 4))])
    out[:, 2] = per_doc(alnum[ends] == alnum[starts]) / some
    tail = sign[ends - 1] & sign[np.maximum(ends - 2, 0)] & (ends - starts > 2)
    out[:, 3] = per_doc(tail) / some
    length = np.concatenate([[0], np.cumsum(chars)])
    width = length[ends] - length[starts]
    out[:, 7] = per_doc(width) / some
    plain = width - (np.concatenate([[0], np.cumsum((kind >= 5) & (kind <= 10))])[ends] - np.concatenate([[0], np.cumsum((kind >= 5) & (kind <= 10))])[starts])
    out[:, 8] = per_doc((plain <= 3) & (plain > 0)) / some
    out[:, 9] = per_doc((kind[ends - 1] == 5) | (kind[ends - 1] == 6)) / some
    back = np.zeros(len(h), bool)
    for d in (1, 2, 3):
        back[d:] |= (h[d:] == h[:-d]) & (doc[d:] == doc[:-d])
    out[:, 10] = per_doc(back) / some
    if len(h) >= 5:
        run = mixed((((h[:-4] * U(3) + h[1:-3]) * U(5) + h[2:-2]) * U(7) + h[3:-1]) * U(11) + h[4:])
    for i in range(n_docs):
        a, b = int(bound[i]), int(bound[i + 1])
        if b > a:
            counts = np.unique(h[a:b], return_counts=True)[1]
            out[i, 4] = counts.max() / (b - a)
            # Distinct words fall with length; a text of n words is measured against sqrt(n) * 6, or n if that is less.
            out[i, 5] = min(1.0, len(counts) / min(b - a, 6.0 * np.sqrt(b - a)))
            if b - a >= 10:
                out[i, 6] = 1 - len(np.unique(run[a : b - 4])) / (b - a - 4)
    return n, out, doc, h


def votes(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Votes (rows, labellers): 1 clean, 0 junk, -1 no opinion; no text has an opinion on nothing."""
    out = np.full(m.shape, -1, np.int8)
    for k, name in enumerate(LABELLERS):
        low, a, b, high = LIMITS[name]
        x = m[:, k]
        out[(x >= a) & (x <= b), k] = 1
        out[(x < low) | (x > high), k] = 0
    out[n < LEAST_WORDS, LABELLERS.index("top_word") :] = -1
    out[n == 0] = -1
    return out


def features(buf: np.ndarray, off: np.ndarray, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashed features (texts, N_FEATURES): shares of words and of runs of four byte classes, each kind with length 1."""
    n_docs = len(off) - 1
    words = np.bincount(doc * WORD_BUCKETS + ((h >> U(13)) % U(WORD_BUCKETS)).astype(np.int64), minlength=n_docs * WORD_BUCKETS).reshape(n_docs, -1)
    kind = KIND[buf].astype(np.int64)
    if len(kind) >= 4:
        code = ((kind[:-3] * 13 + kind[1:-2]) * 13 + kind[2:-1]) * 13 + kind[3:]
        bucket = (code * 0x9E3779B1 >> 12) % SHAPE_BUCKETS
        at = np.repeat(np.arange(n_docs), np.diff(off))
        inside = at[3:] == at[:-3]  # of one text
        shapes = np.bincount((at[:-3] * SHAPE_BUCKETS + bucket)[inside], minlength=n_docs * SHAPE_BUCKETS).reshape(n_docs, -1)
    else:
        shapes = np.zeros((n_docs, SHAPE_BUCKETS))
    parts = []
    for x in (words, shapes):
        x = np.sqrt(x.astype(np.float32))
        parts.append(x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-6))
    return np.concatenate(parts, axis=1)


def _pattern(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (n, pattern)."""
    for b in batches:
        buf, off = flat(b.column(0))
        for i, j in pieces(off):
            n, m, _, _ = measures(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(_pattern(votes(n, m)))], ["n", "pattern"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, pattern, at, value): sparse features of the sample."""
    for b in batches:
        buf, off = flat(b.column(1))
        for i, j in pieces(off, 1 << 18):
            o = off[i : j + 1] - off[i]
            n, m, doc, h = measures(buf[off[i] : off[j]], o)
            x = features(buf[off[i] : off[j]], o, doc, h)
            at = [np.flatnonzero(r).astype(np.int32).tobytes() for r in x]
            value = [r[r != 0].astype(np.float32).tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(_pattern(votes(n, m))), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["key", "pattern", "at", "value"])


def _judged(text: pa.Array, model) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, words, posterior, score) for pieces of a column of texts."""
    weights, bias, patterns, posterior = model.value
    buf, off = flat(text)
    for i, j in pieces(off, 1 << 18):
        o = off[i : j + 1] - off[i]
        n, m, doc, h = measures(buf[off[i] : off[j]], o)
        z = features(buf[off[i] : off[j]], o, doc, h).astype(np.float64) @ weights + bias
        score = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
        p = np.where(n > 0, posterior[np.searchsorted(patterns, _pattern(votes(n, m)))], 0.0)
        yield i, j, n, p, np.round(score, 6)


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n_words, p_weak, score)."""
    for b in batches:
        for i, j, n, p, score in _judged(b.column(1), model):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(p), pa.array(score)], ["id", "n_words", "p_weak", "score"])


def _kept(batches: Iterator[pa.RecordBatch], model, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Whole rows whose text, column ``at``, scores ``threshold`` or more."""
    for b in batches:
        score = [x[4] for x in _judged(b.column(at), model)]
        yield b.filter(pa.array(np.concatenate(score) >= threshold if score else np.zeros(0, bool)))


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of clean per pattern, chances (2, 2, labellers), share of clean documents) by EM.

    ``chances[c, v]`` are the labellers' chances to say v (0 junk, 1 clean), if
    they say anything, of a document that is junk (c = 0) or clean (c = 1).  A
    labeller knows one kind of junk and calls the others clean, so its accuracy
    on junk is free to be low.  No opinion counts for nothing.
    """
    k = len(LABELLERS)
    v = (patterns[:, None] // 3 ** np.arange(k)) % 3 - 1
    says = np.stack([v == 0, v == 1]).astype(np.float64)  # (2, patterns, labellers)
    weight = counts.astype(np.float64)
    chances = np.stack([np.repeat([[0.4], [0.6]], k, axis=1), np.repeat([[0.02], [0.98]], k, axis=1)])
    prior = 0.8
    p = np.full(len(patterns), prior)
    for _ in range(rounds):
        log = np.log(chances)
        clean = np.log(prior) + says[0] @ log[1, 0] + says[1] @ log[1, 1]
        junk = np.log(1 - prior) + says[0] @ log[0, 0] + says[1] @ log[0, 1]
        new = 1 / (1 + np.exp(np.clip(junk - clean, -500, 500)))
        done = np.abs(new - p).max(initial=0.0) < tol
        p = new
        if done:
            break
        total = max(weight.sum(), 1.0)
        prior = float(np.clip((weight * p).sum() / total, 1e-3, 1 - 1e-3))
        # A few imagined documents keep chances off the bounds and junk votes a sign of junk.
        for c, share in ((0, weight * (1 - p)), (1, weight * p)):
            told = np.stack([share @ says[x] for x in range(2)]) + np.array([[[2.0], [3.0]], [[0.02], [5.0]]])[c]
            chances[c] = told / told.sum(axis=0)
    return p, chances, prior


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 80, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; both classes weigh the same."""
    w, b = np.zeros(x.shape[1]), 0.0
    if not len(x):
        return w, b
    x, y = x.astype(np.float64), y.astype(np.float64)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    if y.max() < 0.5 or y.min() >= 0.5:  # one class only
        return w, float(np.round(np.log(share / (1 - share)), 6))
    weight = y * 0.5 / share + (1 - y) * 0.5 / (1 - share)
    step = 4.0 / 3.0 / weight.max()
    pw, pb, t = w, b, 1.0
    for _ in range(rounds):
        z = x @ pw + pb
        g = weight * (1 / (1 + np.exp(-z)) - y) / len(x) * 4
        nw = (1 - ridge) * pw - step * (x.T @ g) * 10
        nb = pb - step * float(g.sum()) * 10
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return np.round(w, 6), float(np.round(b, 6))  # so that reruns agree whatever the order of sums


def fit(docs: DataFrame, text_col: str = "text", train_rows: int = 2000):
    """The label model over all of ``docs`` and the scorer fitted to it, as a broadcast of fixed size."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").alias("text")
    counts = docs.select(text).mapInArrow(_voted, "n long, pattern long").where("n > 0").groupBy("pattern").agg(F.count(F.lit(1)).alias("docs")).orderBy("pattern").toArrow()
    patterns, n = counts.column("pattern").to_numpy(), counts.column("docs").to_numpy()
    posterior, _, _ = label_model(patterns, n)
    # -- a bounded sample: the least text hashes, found from a bound on the hash and cut to size
    total = int(n.sum()) if len(n) else 0
    worded = F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]")  # texts without words have no votes to learn from
    keyed = docs.where(worded).select(text_key(F.col(text_col)).alias("key"), text)
    least = lambda rows: rows.mapInArrow(_featured, "key binary, pattern long, at binary, value binary").dropDuplicates(["key"]).orderBy("key").limit(train_rows).toArrow()
    if total > 2 * train_rows:
        bound = 2.0 * train_rows / total * 2.0**32
        sample = least(keyed.where(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("double") < bound))
        if sample.num_rows < train_rows:  # copies count in the bound: take it from the distinct texts
            last = keyed.select("key").distinct().orderBy("key").limit(train_rows).agg(F.max("key")).first()[0]
            sample = least(keyed.where(F.col("key") <= F.lit(bytes(last))))
    else:
        sample = least(keyed)
    x = np.zeros((sample.num_rows, N_FEATURES), np.float32)
    for r, (at, value) in enumerate(zip(sample.column("at").to_pylist(), sample.column("value").to_pylist())):
        x[r, np.frombuffer(at, np.int32)] = np.frombuffer(value, np.float32)
    patterns, posterior = np.append(patterns, np.iinfo(np.int64).max), np.append(posterior, 0.5)
    labels = posterior[np.searchsorted(patterns, sample.column("pattern").to_numpy())] if sample.num_rows else np.zeros(0)
    weights, bias = fit_scorer(x, labels)
    return spark.sparkContext.broadcast((weights, bias, patterns, posterior))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 2000, threshold: float = 0.4) -> DataFrame:
    """One row per row of ``docs``: id, n_words, p_weak (the label model's posterior), score, keep."""
    model = fit(docs, text_col, train_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(partial(_scored, model=model), "id long, n_words long, p_weak double, score double")
    return out.withColumn("keep", F.col("score") >= threshold).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, text_col: str = "text", train_rows: int = 2000, threshold: float = 0.4) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    model = fit(docs, text_col, train_rows)
    return docs.mapInArrow(partial(_kept, model=model, at=docs.columns.index(text_col), threshold=threshold), docs.schema)
