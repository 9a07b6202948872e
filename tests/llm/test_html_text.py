import random

import numpy as np

from tidemark.llm import html_text as h


def test_blocks():
    page = "<html><head><title>T &amp; t</title><style>p{}</style><script>if(a<b){'</p>'}</script></head><body><nav><ul><li><a href=x>A</a><li>B</ul></nav><article><p><b>x<br>y&nbsp; z<p>two\n lines<!-- no --></article>tail"
    got = [b.text for b in h.blocks_of(page)]
    assert got == ["T & t", "A", "B", "x y z", "two lines", "tail"]
    for odd in ("", "<", "<p", "</p></div>", "<script>", "<p><p><p>", "a<b>c", "<!-- open", "<div class='a>b'>x", "\x00<p>é", "<p title='>'>t"):
        h.blocks_of(odd)


def test_odd_markup_loses_nothing():
    texts = lambda page: [b.text for b in h.blocks_of(page)]
    assert texts("<p>" + "İ" * 40 + "</p><SCRIPT>x</Script ><p>first</p><p>second</p>") == ["İ" * 40, "first", "second"]
    assert texts("<p>let <math><mi>x</mi></math> be <svg><text>drawn</text></svg> here</p>") == ["let x be drawn here"]
    for tag in ("svg", "object", "math", "video", "template", "select", "textarea", "iframe", "noscript"):
        assert " ".join(texts(f"<p>a</p><{tag}><p>b</p><p>c</p>")) == "a b c", tag
    assert texts("<p>a<template><p>no</p></template><select><option>no</select> b</p><script>no") == ["a b"]
    assert texts("<p title='open>a</p><p>b</p>") == ["a", "b"]


def test_time_grows_with_length():
    import time

    for piece in ("<div>x", "<a ", "<b>x", "<a \">\" ", "<a '", "<!", "<template>x", "<li>x", "<p><span>x", "</p>", "<svg><p>x", "&amp;<"):
        times = []
        for n in (10_000, 80_000):
            began = time.process_time()
            h.features(h.blocks_of(piece * n))
            times.append(time.process_time() - began)
        assert times[1] < 0.3 + 24 * times[0], (piece, times)
    assert len(h.labeller().main([h.blocks_of("<div>x" * 100_000)])[0]) == 100_000


def test_gradient():
    rng = np.random.default_rng(1)
    model = h.Labeller(rng)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x = rng.standard_normal((4, 3, h.INPUT))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], bool)
    y = rng.integers(0, 2, (4, 3)).astype(float)
    _, grad = model.gradient(x, mask, y)
    for k in model.w:
        at = tuple(rng.integers(0, n) for n in model.w[k].shape)
        old = model.w[k][at]
        losses = []
        for step in (1e-4, -1e-4):
            model.w[k][at] = old + step
            losses.append(model.gradient(x, mask, y)[0])
        model.w[k][at] = old
        assert abs((losses[0] - losses[1]) / 2e-4 - grad[k][at]) < 1e-3 * max(1, abs(grad[k][at])), k


def test_held_out_pages():
    rng, model = random.Random(4711), h.labeller()
    wrong = total = 0
    for _ in range(200):
        blocks, y = h.labelled(*h.generated_page(rng))
        wrong += (model.main([blocks])[0] != (y > 0)).sum()
        total += len(y)
    assert wrong <= 0.01 * total


def test_query(spark):
    article = "<article><h1>Head line</h1><p>One &lt;two&gt; three, and more words here.</p><p>" + "long words " * 9000 + "</p></article>"
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy it now.</div>{article}<section class='comments'><p>I disagree.</p></section><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as text")
    got = h.extract_main_text(df).collect()
    want = "Head line\nOne <two> three, and more words here.\n" + ("long words " * 9000).strip()
    assert sorted(map(str, ((r.page_id, r.url, r.text, r.n_chars) for r in got))) == sorted(map(str, [(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (3, "u", "", 0)]))
    assert h.extract_main_text(df.limit(0)).count() == 0
