"""Plain versions of the corpus operators for small fixtures."""

import hashlib
import random
import re
from collections import defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}


def words(t, pattern=r"[^\x20\x09-\x0D]+", lower=True):
    t = t or ""
    return re.findall(pattern, t.translate(LOWER) if lower else t)


BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def corpus(seed=7, n=160):
    """Rows (doc_id, text, lang, source, n_chars) with copies, near copies, shared passages, odd and missing texts."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(400)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, line = say(70), say(14)
    texts = []
    for i in range(n):
        kind = r.random()
        if kind < 0.15 and texts:
            t = r.choice(texts)
        elif kind < 0.35 and texts:
            w = (r.choice(texts) or "x").split(" ")
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        elif kind < 0.5:
            t = say(r.randint(5, 60)) + "\n" + passage + "\n" + say(r.randint(5, 60))
        elif kind < 0.6:
            t = "\n".join([say(4), line, say(3), line, say(5)] * r.randint(1, 3))
        else:
            t = "\n".join(say(r.randint(1, 40)).capitalize() + "." for _ in range(r.randint(1, 6)))
        texts.append(t)
    texts[3:3] = [None, "", " \n\t ", "one", "two words", "TWO words", "a b c", "x" * 3000, "ab" * 700 + "\n" + "ab" * 700, "é" * 130]
    rows = [(i, t, "en", None if i % 17 == 5 else f"src{i * i % 5}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[40], rows[40]]  # repeated rows
    rows.append((None, rows[41][1], None, None, None))
    rows.append((None, None, None, None, None))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:  # columns whose names an operator might use itself
        for c in ("id", "key", "h", "n", "size", "shard", "spans", "target", "score", "set", "g"):
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("clash"))
    return df


def place(doc_id):
    return (doc_id is None, doc_id or 0)


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, t100):
    """{row number: (n_shingles, component id)}."""
    sets = [shingles(t, k) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= t100 * len(a | b):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(len(s), min(least[find(i)], default=None) if s else rows[i][0]) for i, s in enumerate(sets)]


def suffix(rows, span=100):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, sha)}."""
    seen, out = set(), {}
    for doc_id, t in sorted({(r[0], r[1]) for r in rows}, key=lambda x: place(x[0])):
        b = (t or "").encode()
        cov = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if b[i : i + span] in seen:
                cov[i : i + span] = b"\1" * span
            seen.add(b[i : i + span])
        kept = bytes(x for x, c in zip(b, cov) if not c)
        out[doc_id, t] = (len(b), sum(cov), len(re.findall(b"\1+", bytes(cov))), hashlib.sha256(kept).hexdigest())
    return out


def lines(rows, width=3):
    seen, out = set(), {}
    for doc_id, t in sorted({(r[0], r[1]) for r in rows}, key=lambda x: place(x[0])):
        ls = t.split("\n") if t else []
        gone = [False] * len(ls)
        for i in range(len(ls) - width + 1):
            w = tuple(ls[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        out[doc_id, t] = (len(ls), sum(gone), "\n".join(x for x, g in zip(ls, gone) if not g))
    return out


def hits(text, items, span=10):
    win = defaultdict(set)
    for item, t in items:
        w = words(t, BENCH_WORD)
        k = min(span, len(w))
        for i in range(len(w) - k + 1) if k else ():
            win[tuple(w[i : i + k])].add("" if item is None else str(item))
    w = words(text, BENCH_WORD)
    hit, found = set(), set()
    for k in {len(x) for x in win}:
        for i in range(len(w) - k + 1):
            if (got := win.get(tuple(w[i : i + k]))) is not None:
                hit |= set(range(i, i + k))
                found |= got
    return len(w), len(hit), sorted(found)


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * level > most * sizes[s]]
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out
