"""Top-k search, URL filters and HTML extraction against brute force and literal cases."""

import math
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import html, topk, urlfilter


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(0, 0.2, 6).astype(float).tolist()) for k in range(150)]
    rows += [(200 + k, [0.5] * 6) for k in range(45)]  # one vector many times: ties
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (320, []), (340, [0.3] * 3), (360, [0.0] * 6), (-20, [-0.4] * 6), (20, rows[20][1])]
    return rows


def topk_brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, [math.floor(64 * x) for x in v])
    out = []
    for q in sorted(good):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(good[q], w)), i) for i, w in good.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return Counter(out)


@pytest.mark.parametrize(("k", "block"), [(20, 8192), (7, 16), (500, 64)])
def test_topk(spark, vectors, monkeypatch, k, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, score int, rank int")
    out = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(topk.weights(df), k).collect())
    assert out == topk_brute(vectors, k)


def test_topk_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(topk.weights(spark.createDataFrame([], schema))).count() == 0
    assert topk.search(topk.weights(spark.createDataFrame([(0, [1.0])], schema))).count() == 0
    two = topk.search(topk.weights(spark.createDataFrame([(0, [1.0, 0.5]), (3, [0.25, 1.0])], schema))).collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in two] == [(0, 3, 64 * 16 + 32 * 64)]


def test_topk_of_sparse_and_huge_weights(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(80):
        v = np.zeros(40)
        v[rng.integers(0, 40, 3)] = rng.normal(0, 10.0 ** rng.integers(-1, 7), 3)
        rows.append((k, v.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(topk.weights(df), 5).collect())
    assert out == topk_brute(rows, 5)


URLS = [
    "http://a.example.net/en/1", "http://A.Example.NET/de/1?x=/en/", "https://example.net", "https://example.net/", "https://xexample.net/en/", "https://example.com/de/5", "https://m.example.com/de", "https://m.example.com/de/#x",
    "https://b.org/fr/1", "https://org/fr/", "https://b.org/en/1", None, "", "no scheme", "://", "a://b://c.net/x", "http://host.com?q=net/", "http://net/x", "http://host.com:80/a/b/c/d/e/f/g/h/i", "http://x.com//double//", "HTTP://UPPER.COM/Path",
]


def url_brute(u):
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = host.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    best = None
    for _, rule in urlfilter.RULES:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


def test_url_rules(spark):
    df = spark.createDataFrame([(k, u, "p", "h", 1) for k, u in enumerate([*URLS, *URLS[:3]])], "page_id long, url string, path string, HOST string, purity int")
    rows = urlfilter.judge(df).collect()
    assert len(rows) == len(URLS) + 3
    verdicts = dict((r, v) for v, r in urlfilter.RULES)
    for r in rows:
        host, path, rule = url_brute(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdicts[rule] if rule else r["verdict"]) and r["verdict"] in ("allow", "block")
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_url_templates_generalise_and_reject(spark):
    # On one host, half of /spam/ is labelled blocked, /news/ has no labels; ids and slugs vary.
    rows = [("h.com", f"/spam/{k}/{'x' * (k % 5)}s{k}", "block" if k % 2 else None) for k in range(200)]
    rows += [("h.com", f"/news/{k}", None) for k in range(200)] + [("h.com", f"/blog/post-{k}", None) for k in range(200)]
    out = urlfilter.templates(spark.createDataFrame(rows, "host string, path string, verdict string")).collect()
    purity = {r["template"]: r["purity"] for r in out}
    spam = [t for t in purity if t.startswith("h.com/spam")]
    assert spam and len(purity) <= 6, purity
    assert all(purity[t] >= urlfilter.REJECT for t in spam)
    assert all(p < urlfilter.REJECT for t, p in purity.items() if t not in spam)


def test_url_branches_that_differ_stay_apart_at_any_fan_out_and_depth(spark):
    # /de/ is blocked and holds under a tenth of a host with 26 branches; /a/../i/ parts at its ninth segment.
    rows = [(f"http://www.example.com/de/{k}", "block") for k in range(20)]
    rows += [(f"http://www.example.com/{a}{b}/{k}", "allow") for a in "efgij" for b in "nrsty" for k in range(20)]
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    assert {r["url"]: r["verdict"] for r in urlfilter.judge(df).collect()} == dict(rows)

    deep = "/".join(["", *"abcdefgh"])
    rows = [("h.com", f"{deep}/bad/{k}", "block") for k in range(50)] + [("h.com", f"{deep}/good/{k}", None) for k in range(50)]
    out = urlfilter.templates(spark.createDataFrame(rows, "host string, path string, verdict string")).collect()
    purity = {r["template"]: r["purity"] for r in out}
    assert len(purity) == 2 and all((p >= urlfilter.REJECT) == ("/bad/" in t) for t, p in purity.items())


def test_url_templates_fall_back_to_other_hosts_at_the_tables_density(spark):
    # As in the tables: three top-level names, a few pages a host, labels from the four rules alone.
    rng = np.random.default_rng(4)
    urls = []
    for top in ("com", "net", "org"):
        for h in range(20):
            n = 900 if (top, h) == ("net", 0) else 40  # one host with a third of the rows
            urls += [f"http://www.site{h}.example.{top}/{rng.choice(['en', 'en', 'de', 'fr', 'es'])}/{rng.integers(9999)}{rng.choice(['', '/', '.html', '?page=2'])}" for _ in range(n)]
    urls += [f"http://new.example.com/{x}/7" for x in ("en", "es", "de", "other")] + ["no scheme", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = urlfilter.judge(df).collect()
    told = defaultdict(set)
    for r in out:
        if r["rule"] is None and r["host"]:
            told[r["host"].rpartition(".")[2], r["path"].split("/")[1]].add(r["verdict"])
    # /es/ is blocked wherever it is labelled, /en/ nowhere, /fr/ on one of two names; all labels of .org allow.
    assert told[("com", "es")] == {"block"}
    assert all(told["com", x] == {"allow"} for x in ("en", "fr", "other")) and all(told["org", x] == {"allow"} for x in ("en", "es", "de"))
    assert {r["verdict"] for r in out if not r["host"]} == {"allow"}


def test_url_unlabelled_siblings_of_a_blocked_branch_are_blocked(spark):
    rows = [(f"www.shop{h}.com", f"/offers/{k}/{w}", "block" if k < 3 and h < 8 else None) for h in range(10) for k in range(6) for w in ("a", "b")]
    rows += [(f"www.shop{h}.com", f"/help/{k}", "allow" if k < 3 else None) for h in range(10) for k in range(6)]
    out = urlfilter.templates(spark.createDataFrame(rows, "host string, path string, verdict string")).collect()
    assert all((r["purity"] >= urlfilter.REJECT) == r["key"].startswith("offers") for r in out)


@pytest.fixture(scope="module")
def net():
    feats, labels = html.training_set([], made=300)
    model = html.BiLSTM()
    model.train(feats, labels)
    return model


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><div>Site name</div></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies here.</p></div><!-- <p>comment</p> -->
<article><h1>A title &amp; more</h1><p>First   paragraph
with <b>bold</b> text &#233;t &eacute; and so on, quite long enough.<br><p>Second&nbsp;one, unclosed
<div class="ad">Buy now!</div><p>Third one ends.</p></article>
<aside class="sidebar"><h3>Related</h3><p>Other story</p></aside>
<section id="comments"><div class="comment"><p>Nice read, thanks.</p></div></section>
<form><p>Subscribe</p><button>Go</button></form><footer>&copy; Site</footer></body></html>"""


def test_blocks_read_markup():
    texts = [b.text for b in html.blocks(PAGE)]
    assert "A title & more" in texts and "First paragraph with bold text ét é and so on, quite long enough." in texts and "Second one, unclosed" in texts
    assert not any("var a" in t or "comment" == t or "p{}" in t for t in texts)
    assert html.blocks("") == [] and html.blocks("<div><p></p>") == [] and [b.text for b in html.blocks("plain &lt;b&gt; text")] == ["plain <b> text"]
    assert [b.text for b in html.blocks("<p>cut off <a hre")] == ["cut off"]
    assert [b.text for b in html.blocks("<p>a < b and c > d</p>")] == ["a < b and c > d"]


def test_blocks_of_odd_markup():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts("<p>see <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here</p>") == ["see x=2 here"]
    assert texts("<p>a <svg width='1'/> b <svg><text>c</text></svg></p><p>d</p>") == ["a b c", "d"]
    assert texts("<noscript><p>one</p></noscript><canvas>two</canvas><object/><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>a<textarea>never closed<p>b") == ["a", "never closed", "b"]
    assert texts("<p>a</p><script>if (a < b) '</p>' <p>c") == ["a"] and texts("<style>x</style>y<SCRIPT>z</Script >w") == ["y", "w"]
    assert texts("<p title='a > b'>c</p><p title='d>e</p><p>f</p>") == ["c", "e", "f"]
    assert texts("<!-- a --> b <!-- c") == ["b"] and texts("<?php x ?>a<!DOCTYPE b>c") == ["ac"]


def test_broken_markup_takes_linear_time():
    for unit in ("<a ", '<a "', "<a '>\" ", "<!-", "<textarea>", "<b", "</", "<p>x<svg", "<a b='>\"'"):
        page = unit * (1_000_000 // len(unit))
        start = time.perf_counter()
        html.blocks(page)
        assert time.perf_counter() - start < 5, unit


def test_long_pages_take_bounded_memory(net):
    feats = html.features(html.blocks("<p>some words</p>" * 100_000))
    tracemalloc.start()
    p = net.probabilities([feats])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(p) == 100_000 and peak < 100e6


def test_main_text(net):
    assert html.extract_text([PAGE], net) == ["A title & more First paragraph with bold text ét é and so on, quite long enough. Second one, unclosed Third one ends."]


def test_held_out_layouts(net):
    rng = np.random.default_rng(77)
    right = total = 0
    for _ in range(150):
        page, y = html.made_page(html._invented(rng, 20), rng)
        own = html.blocks(page)
        if len(own) == len(y):
            p = net.probabilities([html.features(own)])[0]
            right += ((p >= 0.5) == np.array(y)).sum()
            total += len(y)
    assert right / total > 0.98


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = html.BiLSTM()
    pages = [html.features(html.blocks(html.made_page(html._invented(rng, 5), rng)[0])) for _ in range(3)]
    labels = [rng.integers(0, 2, len(p[0])).astype(float) for p in pages]

    def loss(model):
        z, mask, *_ = model._forward(pages, True)
        y = np.zeros(mask.shape)
        y[mask] = np.concatenate(labels)
        z = z.astype(float)
        return float(np.where(mask, np.logaddexp(0, z) - y * z, 0).sum() / mask.sum())

    before = loss(net)
    net.train(pages, labels, epochs=30)
    assert loss(net) < 0.5 * before


def test_extract_over_rows(spark, net):
    rows = [(1, "u", PAGE, "t", 1), (1, "u", PAGE, "t", 1), (2, None, None, "t", 1), (3, "u", "", "t", 1), (None, "u", "<article><p>" + "long text here. " * 30_000 + "</p></article>", "t", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string, n_chars int")
    out = html.extract(df, net).collect()
    assert len(out) == 5 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert [r["text"] for r in out if r["page_id"] in (2, 3)] == ["", ""]
    assert max(r["n_chars"] for r in out) == len("long text here. " * 30_000) - 1
    assert html.extract(df.limit(0), net).count() == 0
    assert html.fit(df.limit(0)) is not None


def test_very_long_paths_take_no_step_a_segment(spark):
    """Paths of 2,000 segments, mixed in label, alone and with a common beginning: a step goes to where they part."""
    import time

    from spanloom.llm import urlfilter

    long = "/".join(f"s{k}" for k in range(2000))
    urls = [f"https://a.net/{long}", f"https://b.org/{long}", f"https://c.com/{long}", f"https://c.com/{long}/x", f"https://d.net/{long}/y", f"https://d.org/fr/{long}"]
    start = time.time()
    out = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert time.time() - start < 90
    assert out[0]["verdict"] == out[4]["verdict"] == "block" and out[5]["verdict"] == "allow"
    assert out[1]["template"] == "b.org/" + "/".join(["*"] * 2000) or out[1]["template"].startswith("b.org")
    assert {out[k]["verdict"] for k in (1, 2, 3)} <= {"allow", "block"}
