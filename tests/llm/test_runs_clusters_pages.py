"""Periodic runs, exact k-means and main text against brute force, then awkward tables."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import centroids, extract, queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, exponent=4, least=6):
    """Every period, every maximal stretch; the smallest period of each stretch."""
    found = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, exponent * q) and i > s:
                found[s, i - s + q] = min(q, found.get((s, i - s + q), q))
            i = max(i, s + 1)
    return sorted((s, p, n) for (s, n), p in found.items())


def found_runs(words, exponent=4, least=6):
    n, (s, length, p) = runs.runs_of(np.frombuffer(" ".join(words).encode(), np.uint8), exponent, least)
    assert n == len(words)
    return list(zip(s.tolist(), p.tolist(), length.tolist()))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.sampled_from([(4, 6), (2, 2), (3, 4), (4, 9), (2, 6)]))
def test_runs_of_two_words(w, rule):
    assert found_runs(w, *rule) == brute_runs(w, *rule)


def test_runs_of_planted_texts():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(1, 200)
        w = [rng.choice("abcdefgh"[: rng.randrange(1, 8)]) for _ in range(n)]
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 11)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert found_runs(w) == brute_runs(w)


def test_long_runs_are_not_quadratic():
    assert found_runs(["a"] * 200_000) == [(0, 1, 200_000)]
    assert found_runs([f"w{i % 977}" for i in range(200_000)]) == [(0, 977, 200_000)]


def digest_of(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    drop = {i for s, p, length in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[2], r[0], r[1]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{length},{p}\n" for s, p, length in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_op11(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect())
    assert got == sorted(digest_of(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 5


def test_op11_awkward(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a a"), (4, "a a a a a a a"), (None, "x y x y x y x y z"), (6, "été x " * 50), (7, "lorem ipsum " * 30000), (24, "one two"), (-5, "b " * 5), (5, "w " * 6)]
    rows += [(i, "p q r s t") for i in range(100, 160)]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("key", "runs", "collapsed", "words", "n", "a", "p", "h", "best"):
        docs = docs.withColumn(c, F.lit("clash"))
    key = lambda r: (r[0] is None, r)
    long = digest_of(70, "")  # the brute force would take too long there: one period of two words
    got = sorted((tuple(r) for r in runs.runs_digest(docs).collect()), key=lambda r: str(key(r)))
    want = [digest_of(*r) for r in rows if r[0] != 7]
    assert [r for r in got if r[0] != 7] == sorted(want, key=lambda r: str(key(r)))
    seven = next(r for r in got if r[0] == 7)
    assert seven[1:6] == (1, 0, 60000, 2, 30_000_000) and seven[7] == hashlib.sha256(b"lorem ipsum").hexdigest()
    assert len(long) == len(seven)
    assert runs.runs_digest(docs.limit(0)).count() == 0
    out = {r.doc_id: r for r in runs.collapse_runs(docs, exponent=2, least=2).collect()}
    assert out[4].collapsed == "a" and [tuple(x) for x in out[4].runs] == [(0, 7, 1)] and out[1].n_words == 0


def brute_clusters(rows, k=40, rounds=5, width=64):
    from math import floor, isfinite

    kept = [(i, [floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centers = [list(v) for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(centers)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                centers[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [nearest(v) for _, v in kept]
    each = {j: sum(d for d, c in last if c == j) for j in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, each[j], sum(each.values()), sha[j]) for (i, _), (d, j) in zip(kept, last)), key=str)


def test_op12_awkward(spark):
    rng = np.random.default_rng(3)
    wide = lambda: [float(x) for x in rng.integers(-3, 4, 64) / 4]
    same = wide()
    rows = [(i, wide()) for i in range(60)] + [(i, same) for i in range(100, 160)] + [(5, wide()), (None, wide()), (None, same), (200, None), (201, []), (202, same[:63]), (203, [*same[:63], None]), (204, [*same[:63], float("nan")]), (205, [*same[:63], float("inf")]), (206, [1e5] * 64)]
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    for c in ("id", "v", "cluster", "distance", "n", "sums"):
        table = table.withColumn(c, F.lit("clash"))
    got = sorted((tuple(r) for r in centroids.cluster_digest(table).collect()), key=str)
    want = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in rows]
    assert got == brute_clusters(want)
    assert centroids.cluster_digest(table.limit(0)).count() == 0
    few = table.where("vec_id < 3")
    assert sorted((tuple(r) for r in centroids.cluster_digest(few).collect()), key=str) == brute_clusters([r for r in want if r[0] is not None and r[0] < 3])
    with pytest.raises(Exception, match="over 134217728"):
        centroids.cluster_digest(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_annulus_keeps_boundary_ties_and_saves_work():
    rng = np.random.default_rng(8)
    for size in (3, 1 << 24):
        centers = rng.integers(-size, size + 1, (30, 4))
        v = rng.integers(-size, size + 1, (500, 4))
        ring = centroids.Annulus(centers)
        square = ((v[:, None, :].astype(object) - centers[None].astype(object)) ** 2).sum(axis=2)
        for before in (None, rng.integers(0, 30, 500)):
            best, least, _ = ring.nearest(v, before)
            assert best.tolist() == [int(np.argmin(r)) for r in square] and least.tolist() == square.min(axis=1).tolist()
    spread = (np.arange(40)[:, None] * 100 + np.zeros(4, int)).astype(np.int64)
    v = spread[rng.integers(0, 40, 1000)] + rng.integers(-5, 6, (1000, 4))
    ring = centroids.Annulus(spread)
    best, _, done = ring.nearest(v, None)
    assert ring.nearest(v, best)[2] < 2 * len(v) and done < 4 * len(v)


def article_of(page):
    """The page template of the tables, cut out by pattern."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return " ".join(p for p in parts if p)


def test_op13(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = sorted(tuple(r) for r in queries.op13_main_text(spark, SF).collect())
    want = [(r.page_id, r.url, article_of(r.html)) for r in pages]
    assert got == sorted((i, u, t, len(t)) for i, u, t in want)


STORY = "<p>The first paragraph has sentences. It is long enough, and it has commas; also <a href=x>links</a> and <b>bold<i> words</b>.</i><p>Second one &amp; more&nbsp;text, <span>with</span>out a gap. Yes!<ul><li>First item<li>Second<br>item</ul><blockquote>Quoted words, they said.</blockquote><table><tr><td>Cell one<td>Cell two</table><p>Last."
TEXT = "The first paragraph has sentences. It is long enough, and it has commas; also links and bold words. Second one & more text, without a gap. Yes! First item Second item Quoted words, they said. Cell one Cell two Last."
MENU = "<ul class=x><li><a href=/>Home</a><li><a href=/b>News of the day</a></ul>"
LAYOUTS = {
    "plain divs": f"<body class='has-sidebar'><div class=top>{MENU}</div><div class=wrap><div class=c><h2>A title of the story</h2>{STORY}</div><div class=rail>{MENU}</div></div><div class=foot>(c) 2024 <a href=l>Legal</a></div>",
    "names": f"<div id=siteNav>{MENU}</div><div class='story page-1'><h2>A title of the story</h2>{STORY}</div><div id=comments><div class=comment><p>I think this is wrong, really. I have a long opinion, and more. {'More, and more. ' * 5}</div><article class=comment><p>Me too, I agree, fully.</article></div><div class=cookie-notice>We use cookies. Accept all, please.</div>",
    "semantic": f"<header><h1>Site</h1><p>News, and more.</header><nav>{MENU}</nav><main><article><header><h2>A title of the story</h2></header>{STORY}<div class=adSlot>Buy this, now.</div><footer>Filed under: things.</footer></article><aside>Side text, with a stop.</aside></main><form>Your name: <input><button>Send it</button></form><footer>End, of all.</footer>",
    "form around all": f"<form id=f><header>Site</header><nav>{MENU}</nav><main><h1>A title of the story</h1>{STORY}</main><footer>End.</footer></form>",
    "roles": f"<div role=banner>Site, it is.</div><div role=navigation>{MENU}</div><div role=main><h1>A title of the story</h1>{STORY}</div><div role=contentinfo>End, of all.</div><div hidden>Not seen, never.</div><div style='display: none'>Nor this, ever.</div>",
    "raw parts": f"<head><title>T</title><style>p{{}}</style></head><script>var t='</p><p>Not this, no.';</script><article><h1>A title of the story</h1><!-- no <p>not this --><noscript>Turn it on.</noscript>{STORY}</article>",
    "unclosed advert": f"<div class=ad><article><h1>A title of the story</h1>{STORY}</article>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert extract.main_text_of(LAYOUTS[name]) == f"A title of the story {TEXT}"


def test_reader_is_tolerant_and_linear():
    texts = {None: "", "": "", "  \n": "", "only text &lt;b&gt;": "only text <b>", "<p>a < b and c<!-- x > y --> d <script>if(a<b)</script>e": "a < b and c d e", "<p>x<?php y ?></ z>w</p": "xw", "<p>a<!-->b": "ab", "<p>a<!-- open": "a", "<a href='x>y": "", "<p>&#xD800;&#65;&notit;</p>": html.unescape("&#xD800;&#65;&notit;"), "<nav>only menu</nav>": ""}
    for page, text in texts.items():
        assert extract.main_text_of(page) == text, page
    for hard in ("<div>" * 30000 + "x", '<a "' * 50000, "<p><b>" * 30000, "<li>a" * 20000, "</p></x>" * 30000, "<!--" * 50000, "<div><p>" * 20000 + "</b>" * 20000):
        extract.main_text_of(hard)


def test_op13_awkward(spark):
    from pyspark.sql import functions as F

    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article>Null id, here.</article>"), (4, "u", "<p>" + "long words, " * 200_000), (4, "u", "<p>same</p>"), (4, "u", "<p>same</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("source", F.lit("clash"))
    got = sorted(((r.page_id or 0, r.url or "", len(r.text), r.n_chars) for r in extract.extract_digest(pages).collect()))
    assert got == [(0, "u", 14, 14), (1, "u", 0, 0), (2, "", 0, 0), (4, "u", 4, 4), (4, "u", 4, 4), (4, "u", 2_399_999, 2_399_999)]
    kept = extract.main_text(pages, keep=("page_id", "text", "html"))
    assert kept.columns == ["page_id", "text", "html", "text_"] and kept.count() == 6
    assert extract.extract_digest(pages.limit(0)).count() == 0
    ratios = extract.path_ratios(spark.createDataFrame([(1, LAYOUTS["plain divs"])], "page_id long, html string")).first()
    assert {p.path for p in ratios.paths if p.content} >= {"body.has-sidebar/div.wrap/div.c/p"}
