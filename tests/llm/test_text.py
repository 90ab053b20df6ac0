import os
import random
import time

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidevec.llm.html_extraction import blocks_of, costs, extract, main_text, min_cut, smoothness
from tidevec.llm.quality import LABELLERS, classify, keep_clean, label_model

SF = "/root/testdata/sf0.01"


# -- HTML


def cut_cost(net, edges, label):
    return sum(abs(x) for x, k in zip(net, label) if (x > 0) != k and x) + sum(w for i, j, w in edges if label[i] != label[j])


@given(st.lists(st.integers(-6, 6), min_size=1, max_size=8), st.data())
@settings(max_examples=150, deadline=None)
def test_min_cut(net, data):
    n = len(net)
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(1, 4)), max_size=14))
    edges = [(i, j, float(w)) for i, j, w in edges if i != j]
    best = min(cut_cost(net, edges, [bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
    assert cut_cost(net, edges, min_cut([float(x) for x in net], edges)) == best


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:"</p>"}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News &gt; World</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies. Please accept them all, it is better for everyone.</p></div>
<div class="ad banner">Buy this now. It is really cheap, very cheap indeed and good.</div>
<!-- <p>hidden</p> --><article><h1>Head&nbsp;line</h1><p>First   <b>para</b>graph &lt;one&gt;
goes on.<p>Second &amp;amp; caf&#233;.<ul><li>point one</li><li>point two</ul><blockquote>Quoted words here.</blockquote>
<form><label>Mail</label><input></form><div class="comments"><p>I liked this article very much, thank you for it.</p></div></article>
<aside><p>Related stories that you may like to read as well, dear reader.</p></aside>
<div id="comments"><div class="comment"><p>A long reader comment that goes on and on about nothing at all.</p></div></div>
<footer>&copy; 2024 Somebody. All rights reserved.</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == "\n\n".join(["Head line", "First paragraph <one> goes on.", "Second &amp; café.", "point one", "point two", "Quoted words here."])


def test_page_without_article():
    body = "".join(f"<p>This is paragraph number {i}, which says quite a lot of things about the world.</p>" for i in range(4))
    page = f"<body><div class=menu><a href=x>One</a> <a href=y>Two</a></div><div><div>{body}</div></div><div class='footer'>bye</div></body>"
    assert main_text(page).count("This is paragraph") == 4 and "bye" not in main_text(page) and "One" not in main_text(page)


def cut_overrules(page):
    """(blocks that the cut keeps against their own costs, blocks that it drops against them)."""
    blocks, parents = blocks_of(page)
    net = costs(blocks)
    keep = min_cut(net, smoothness(blocks, parents))
    return [b.text for b, x, k in zip(blocks, net, keep) if k and x < 0], [b.text for b, x, k in zip(blocks, net, keep) if not k and x > 0]


LONG = "<p>Number {} of the paragraphs of this story goes on for quite a while, as stories do, and says what was to be said.</p>"


def test_the_cut_decides():
    body = LONG.format(1) + "<p>Yes</p>" + LONG.format(2) + "<p><a href=x>all of it a link here</a></p>" + LONG.format(3)
    page = f"<body><ul><li><a href=a>Home</a></li><li><a href=b>News.</a></li></ul><div>{body}</div><ul><li><a href=c>Up now.</a></li><li><a href=d>Down</a></li></ul></body>"
    kept, _ = cut_overrules(page)
    assert kept == ["Yes", "all of it a link here"]
    text = main_text(page)
    assert text.split("\n\n")[1::2] == kept and "Home" not in text and "Up now" not in text
    # a sentence among links goes with them
    links = "".join(f"<li><a href=x{i}>Link number {i}</a></li>" for i in range(4))
    page = f"<body><div>{LONG.format(1)}{LONG.format(2)}</div><ul>{links}<li>See more of it here, today.</li>{links}</ul></body>"
    assert "See more" not in main_text(page) and main_text(page).count("paragraphs of this story") == 2


def test_likely_words_are_no_veto():
    page = f"<body><article><h1>Title</h1>{LONG.format(1)}<div class='related'>{LONG.format(2)}</div><ul class=related><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></article></body>"
    assert main_text(page).count("paragraphs of this story") == 2 and "One" not in main_text(page)


def random_page(r):
    """A small page without ``article``, of at most 12 blocks."""
    words = "the of a day that town was old it said river good".split()

    def p():
        text = " ".join(r.choice(words) for _ in range(r.choice((1, 2, 5, 14, 40)))) + r.choice(["", ".", "!"])
        return f"<a href=x>{text}</a>" if r.random() < 0.3 else text

    def part(depth):
        kind = r.choice(("p", "p", "p", "li", "div", "section", "h2", "nav", "footer"))
        cls = r.choice(["", "", "", " class=menu", " class='post text'", " class=related", " id=comments"])
        inside = "".join(part(depth + 1) for _ in range(r.randint(1, 3))) if kind in ("div", "section", "nav") and depth < 3 else p()
        return f"<{kind}{cls}>{inside}</{kind}>"

    return "<body>" + "".join(part(0) for _ in range(r.randint(1, 5))) + "</body>"


def test_extraction_against_every_labelling():
    """The text is that of a labelling of least cost, among all there are."""
    r = random.Random(11)
    seen = overruled = 0
    while seen < 150:
        page = random_page(r)
        blocks, parents = blocks_of(page)
        if not 1 <= len(blocks) <= 12:
            continue
        seen += 1
        net, edges = costs(blocks), smoothness(blocks, parents)
        labels = [[bool(m >> i & 1) for i in range(len(blocks))] for m in range(1 << len(blocks))]
        price = [cut_cost(net, edges, x) for x in labels]
        best = {"\n\n".join(b.text for b, k in zip(blocks, x) if k) for x, c in zip(labels, price) if c < min(price) + 1e-6}
        assert main_text(page) in best
        overruled += any(map(len, cut_overrules(page)))
    assert overruled > 10


def test_long_odd_pages_take_little_time():
    for part in ('<a "', '<a ">"', "<a '\">", "<!--", "<script>", "<", "<div>", "</ul>", "<li>", "<p class='", "&", "<a "):
        page = "<div>" * 20_000 + part * (300_000 // len(part))
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 10  # a machine's worst; quadratic time would be hours


def test_odd_pages(spark):
    odd = [None, "", "plain", "<", "<p", "<p>a < b && c</p>", "<article><p>unclosed", "<script>x", "<!-- x", "<article><p title='>x'>ok.</p></article>", "<article>" + "<div>" * 3000 + "deep text here." + "</article>", "<article>" + "<p>x y.</p>" * 5000 + "</article>"]
    rows = [(i, f"u{i}", h) for i, h in enumerate(odd)] + [(0, None, PAGE), (None, None, PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract(df.selectExpr("*", "'x' as id", "1 as n_chars", "'t' as text")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, u, main_text(h), len(main_text(h))) for i, u, h in rows), key=repr)
    by = {r["page_id"]: r["text"] for r in got if r["url"]}
    assert by[0] == "" and by[1] == "" and by[6] == "unclosed" and by[9] == "ok." and by[10] == "deep text here." and by[11].count("x y.") == 5000
    assert extract(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_articles_of_the_tables(spark):
    import html
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body[1])]
        assert main_text(r["html"]) == "\n\n".join(x for x in parts if x)


# -- quality


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    k, n = len(LABELLERS), 30_000
    clean = rng.random(n) < 0.8
    kind = rng.integers(0, 4, n)  # each labeller knows one or two kinds of junk
    v = np.ones((n, k), int)
    for j in range(k):
        knows = ~clean & ((kind == j % 4) | (kind == (j * 3 + 1) % 4))
        v[:, j] = np.where(knows, rng.random(n) > 0.9, rng.random(n) < 0.97).astype(int)
        v[rng.random(n) < 0.1, j] = -1
    pattern = ((v + 1) * 3 ** np.arange(k)).sum(1)
    pats, inv, counts = np.unique(pattern, return_inverse=True, return_counts=True)
    p, chances, prior = label_model(pats, counts)
    assert abs(prior - 0.8) < 0.05 and ((p[inv] > 0.5) == clean).mean() > 0.95
    assert np.abs(chances[1, 1] - 0.97).max() < 0.03


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = classify(docs).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("keep", "quality").toPandas()
    good = got["keep"] == (got["quality"] == 1)
    assert good.mean() > 0.97
    assert got[got["quality"] == 1]["keep"].mean() > 0.98 and (~got[got["quality"] == 0]["keep"]).mean() > 0.9


def junk_rows():
    r = random.Random(8)
    rows = [(d, t, lang, s, n) for d, t, lang, s, n in brute.corpus(n=200)]
    base = "The people of the town said that it was a good day, and they went to the river to see the boats. "
    common, rare = "the of a and to in it was that for".split(), "river market garden captain winter letter morning village teacher mountain engine harbour supper journey window shadow island copper whistle orchard".split()
    say = lambda: " ".join(r.choice(common) + " " + r.choice(rare) for _ in range(r.randint(3, 7))).capitalize() + r.choice([". ", "? "])
    rows += [(1000 + i, "".join(say() for _ in range(r.randint(2, 9))), "en", "a", 0) for i in range(200)]
    rows += [(2000 + i, " ".join(w + r.choice(["###", "$$$"]) for w in (base * 3).split()), "en", "a", 0) for i in range(30)]
    rows += [(3000 + i, (base * 2).upper().replace(" ", "!! "), "en", "a", 0) for i in range(10)]
    return rows


def test_classify_small(spark):
    rows = junk_rows()
    df = brute.frame(spark, rows)
    got = classify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(by[2000 + i]["keep"] is False for i in range(30)) and sum(by[1000 + i]["keep"] for i in range(200)) >= 198
    assert not by[3]["keep"] and by[3]["score"] == 0 and by[3]["n_words"] == 0  # a null text
    kept = keep_clean(df)
    assert kept.columns == df.columns and kept.count() == sum(r["keep"] for r in got)
    assert {(r["doc_id"], r["score"]) for r in classify(df).collect()} == {(r["doc_id"], r["score"]) for r in got}


def test_classify_edges(spark):
    assert classify(spark.createDataFrame([], brute.SCHEMA)).count() == 0
    some = spark.createDataFrame([(1, None, "", "", 0), (2, "", "", "", 0)], brute.SCHEMA)
    assert [r["keep"] for r in classify(some).collect()] == [False, False]
    same = spark.createDataFrame([(i, "The people said that it was a good day for the town.", "", "", 0) for i in range(9)], brute.SCHEMA)
    assert all(r["keep"] for r in classify(same).collect())


def test_sample_is_filled_where_copies_dominate(spark, monkeypatch):
    from tidevec.llm import quality

    seen = []
    fit_scorer = quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda x, y: seen.append(len(x)) or fit_scorer(x, y))
    docs = spark.range(6000).select(F.concat(F.lit("one of a few texts with number "), (F.col("id") % 30).cast("string")).alias("text"))
    quality.fit(docs, train_rows=20)
    quality.fit(docs, train_rows=100)  # fewer distinct texts than that: all of them
    assert seen == [20, 30]


def em_brute(votes_of, rounds=200):
    """EM document by document: each one's chance of being clean."""
    k = len(LABELLERS)
    chance = {(0, 0): [0.4] * k, (0, 1): [0.6] * k, (1, 0): [0.02] * k, (1, 1): [0.98] * k}
    prior, p = 0.8, [0.8] * len(votes_of)
    imagined = {(0, 0): 2.0, (0, 1): 3.0, (1, 0): 0.02, (1, 1): 5.0}
    for _ in range(rounds):
        new = []
        for v in votes_of:
            clean, junk = prior, 1 - prior
            for j, x in enumerate(v):
                if x >= 0:
                    clean *= chance[1, x][j]
                    junk *= chance[0, x][j]
            new.append(clean / (clean + junk))
        done = max(abs(a - b) for a, b in zip(new, p)) < 1e-9
        p = new
        if done:
            break
        prior = min(max(sum(p) / len(p), 1e-3), 1 - 1e-3)
        for j in range(k):
            for c in (0, 1):
                told = [imagined[c, x] + sum((q if c else 1 - q) for q, v in zip(p, votes_of) if v[j] == x) for x in (0, 1)]
                for x in (0, 1):
                    chance[c, x][j] = told[x] / sum(told)
    return p


def test_classifier_against_brute_force(spark):
    """Votes, EM and scorer over all documents, one by one in this process, give the same scores."""
    import hashlib

    from tidevec.llm import quality

    rows = junk_rows()
    df = brute.frame(spark, rows)
    one = {}
    for r in rows:
        t = r[1] or ""
        buf, off = np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])
        n, m, doc, h = quality.measures(buf, off)
        x = quality.features(buf, off, doc, h)[0] if len(buf) else np.zeros(quality.N_FEATURES, np.float32)
        one[t] = (int(n[0]), quality.votes(n, m)[0].tolist(), x)
    worded = [r[1] for r in rows if r[1] and one[r[1]][0]]
    p = dict(zip(worded, em_brute([one[t][1] for t in worded])))
    sample = sorted(set(worded), key=lambda t: hashlib.md5(t.encode()).digest())[:2000]
    weights, bias = quality.fit_scorer(np.stack([one[t][2] for t in sample]), np.array([p[t] for t in sample]))
    for r in classify(df.select("doc_id", "text")).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        t = r["text"] or ""
        score = 1 / (1 + np.exp(-np.clip(one[t][2].astype(float) @ weights + bias, -30, 30))) if one[t][0] else 0.0
        assert r["n_words"] == one[t][0] and abs(r["p_weak"] - p.get(t, 0.0)) < 1e-4 and abs(r["score"] - score) < 1e-3
