"""HTML extraction on made-up pages that taught nothing, and on hand-written ones."""

import pytest
from quotegrain.llm import html_content as H


@pytest.fixture(scope="module")
def model():
    return H.TreeModel.count([H.spread_labels(H.parse(H.made_page(k))) for k in range(H.MADE)])


def test_held_out_pages(model):
    right = total = 0
    for k in range(10_000, 10_150):
        nodes = H.spread_labels(H.parse(H.made_page(k)))
        for node, p in zip(nodes, model.marginals(nodes), strict=True):
            if node.tag == "#":
                total += 1
                right += (p >= 0.5) == (node.label == 1)
    assert right / total > 0.98


def test_marginals_equal_the_sum_over_all_labels(model):
    from itertools import product

    nodes = H.parse('<nav><a href="x">Home</a></nav><div class="post"><p>Some text, with words.</p><p>More.</p></div>')
    own = [H.ROOT] + [model.own(n) for n in nodes[1:]]
    total, content = 0.0, [0.0] * len(nodes)
    for labels in product((0, 1), repeat=len(nodes)):
        p = 1.0
        for k, node in enumerate(nodes):
            p *= own[k][labels[k]]
            if k:
                p *= model.pair.get(H._kind(node), H.EITHER)[2 * labels[node.parent] + labels[k]]
        total += p
        for k, y in enumerate(labels):
            content[k] += p * y
    assert model.marginals(nodes) == pytest.approx([c / total for c in content])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<!-- ad --><div class="ad">Buy now, it is very cheap today.</div>
<article><h1>A &amp; B&nbsp;title</h1><p>First <b>bold</b>
 text, with a <a href="/x">link</a> in it.<p>Second&#33; one<br>goes on.<ul><li>Item one</li><li>Item two</li></ul></article>
<section class="comments"><p>I liked this a lot, thank you for it.</p></section>
<footer>&copy; someone</footer></body></html>"""


def test_a_page(model):
    assert H.main_text(PAGE, model) == "A & B title\nFirst bold text, with a link in it.\nSecond! one goes on.\nItem one\nItem two"


@pytest.mark.parametrize("html", ["", "<", "<p", "<!--", "<script>x", "</p></div>", "<div>" * 3000 + "x", "<table><tr><td>", "<article><p>Words that stay, and go on &am", "a<b>c</i>d<a href='x"])
def test_odd_pages_do_not_crash(model, html):
    H.main_text(html, model)


def test_a_page_that_is_cut_off(model):
    assert H.main_text("<article><p>Words that stay, and go on &amp; on</p><p class='x", model) == "Words that stay, and go on & on"


def test_table(spark, model):
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "w", "", 5), (1, "u", PAGE, 5), (None, "x", PAGE, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = H.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in got) == sorted((i or 0, u or "", len(H.main_text(h, model)) if h else 0) for i, u, h, _ in rows)
    assert all(len(r["text"]) == r["n_chars"] for r in got)
    assert H.extract(df.limit(0)).collect() == []
