import itertools
import time

import numpy as np
import pytest

from gleaner.llm import html as m

PAGE = """<!doctype html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav><div class="ad">Buy this now.</div>
<article><h1>Head &amp; line</h1><p>First   para,
with <i>inline</i>&nbsp;bits&#33;<br>and a break.<p>Second paragraph, which is long enough to be one of the article, really.
<form action=/x><p>Sign up</p><input name=q></form><!-- <p>gone</p> --></article>
<div class="comments"><div class="comment"><p>Nice one, says a reader.</p></div><div class="comment"><p>I disagree with that, says another.</p></div></div>
<footer>&copy; 2024 Somebody</footer></body></html>"""
TEXT = "Head & line\nFirst para, with inline bits! and a break.\nSecond paragraph, which is long enough to be one of the article, really."


def test_extracts_the_article(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (None, "u", "<"), (1, "u", PAGE), (4, None, "<p " + "x" * 100_000), (5, "v", "</div></p><b><i>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' as main_text")
    got = [(r.page_id, r.main_text) for r in m.extract(d).collect()]
    assert [x for x in got if x[0] == 1] == [(1, TEXT)] * 2
    assert dict(got)[2] == dict(got)[3] == ""
    assert len(got) == 7
    assert m.extract(d.where("false")).count() == 0


def test_labellings_never_contradict():
    rng = np.random.default_rng(2)
    for _ in range(200):
        nodes = [m.Node("body", -1, 0)]
        for i in range(1, 12):
            nodes.append(m.Node("div", int(rng.integers(0, i)), 1))
        odds = rng.normal(size=12).tolist()
        kept = m.decode(nodes, odds)
        for i in range(1, 12):
            path, k = [], i
            while k >= 0:
                path.append(kept[k])
                k = nodes[k].up
            path = path[::-1]
            assert sum(a != b for a, b in zip(path, path[1:], strict=False)) <= 1 + (path[0] is not True)


def test_decoding_equals_trying_all_labellings():
    """Of all labellings whose paths leave the main text at most once, none is likelier."""
    rng = np.random.default_rng(3)
    for n in [1, 2, 3] * 10 + [9] * 25:
        nodes = [m.Node("body", -1, 0)] + [m.Node("div", int(rng.integers(0, i)), 1) for i in range(1, n)]
        odds = (3 * rng.normal(size=n)).tolist()
        score = lambda x: sum(-np.log1p(np.exp(-o)) if y else -np.log1p(np.exp(o)) for o, y in zip(odds, x, strict=True))
        best = -np.inf
        for x in itertools.product([False, True], repeat=n):
            left = [False] * n  # whether the path to the node has left the main text
            fine = True
            for i in range(1, n):
                up = nodes[i].up
                left[i] = left[up] or (x[up] and not x[i])
                fine &= not (left[i] and x[i])
            best = max(best, score(x)) if fine else best
        assert abs(score(m.decode(nodes, odds)) - best) < 1e-9


BODY = "<h1>A headline of the article</h1>" + "".join(f"<p>Paragraph {k} of the article, which says a number of things, and says them at length.</p>" for k in range(4))
WANT = "\n".join(["A headline of the article"] + [f"Paragraph {k} of the article, which says a number of things, and says them at length." for k in range(4)])


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><meta charset=utf-8><body><article>{}</article></body></html>",
    "<title>T</title><link rel=x><article>{}</article>",
    "<html><head><title>T</title><article>{}</article></html>",
    "<html><head></head><body><article title=a\">{}</article></body></html>",
    "<html><body><article title=a'>{}</article></body></html>",
    "<html><body><article title = 'x>y' data-x=\"a'b>c\">{}</article></body></html>",
    "<html><body><article class='post' class=\"nav\"title=x>{}</article></body></html>",
    "<!--><html><body><article>{}</article><!-- x --!></body></html>",
    "<html><body></><article>{}</article></3 bogus></body></html>",
    "<html><body>\u0130\u0130\u0130<script>var a = '</scripty>';</SCRIPT ><article>{}</article></body></html>",
])
def test_sloppy_but_valid_markup_loses_nothing(page):
    assert WANT in m.main_texts([page.format(BODY)], m.trained())[0]


def test_table_cells_fence_stray_end_tags():
    _, blocks = m.parse("<div><table><tr><td>one</div> more<td>two<tr><td>three</table>after</div>")
    assert [t for _, t in blocks] == ["one more", "two", "three", "after"]


@pytest.mark.parametrize("page", ["<span>" * 20_000 + "</div>" * 20_000, "<div>" * 20_000 + "<li></li></b><p>" * 20_000, "<b><i>" * 10_000 + "</i></b></u>" * 20_000, "<x " + "a=\"b\" " * 100_000, "<div><b>" * 10_000 + "<tr><td></p>" * 10_000, "<!--" * 50_000, "<a title='" * 20_000, "<table>" * 9_000 + "<li>x</div>" * 9_000])
def test_time_grows_with_the_length(page):
    began = time.perf_counter()
    m.parse(page)
    assert time.perf_counter() - began < 5


def test_held_out_pages():
    model, made = m.trained(), m.Pages(99)
    hit = extra = missed = 0
    for _ in range(100):
        nodes, blocks = m.parse(made.page())
        kept = m.decode(nodes, model.predict(np.array(m.features(nodes), float)).tolist())
        for owner, text in blocks:
            hit += len(text) * (kept[owner] and nodes[owner].label)
            extra += len(text) * (kept[owner] and not nodes[owner].label)
            missed += len(text) * (not kept[owner] and nodes[owner].label)
    assert hit / (hit + extra) > 0.98 and hit / (hit + missed) > 0.98
