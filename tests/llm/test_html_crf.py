import html
import itertools
import re
import time
import tracemalloc

import numpy as np
import pytest

from tabula.llm import html_crf as crf
from tabula.llm.labelled_pages import labelled_pages
from tabula.llm.queries import QUERIES
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def extractor():
    return crf.Extractor(crf.train(labelled_pages(crf.TRAIN_PAGES, 1)))


def texts(page):
    return [b.text for b in crf.blocks_of(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>\n c<br>d<p>e &amp; &lt;f&gt;&nbsp;g</p>h") == ["a b c d", "e & <f> g", "h"]
    assert texts("<head><title>x</title><style>p{}</style></head><body><script>var a='</p>'</script><ul><li>1<li>2</ul><!-- c --> z <![CDATA[q]]>") == ["1", "2", "z"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table><textarea>no</textarea><select><option>no</select>x") == ["a", "b", "c", "x"]
    assert texts("<div title='a > b'>k</div><p class=\"open>t") == ["k", "t"]
    assert texts("") == texts("<p></p> \n") == [] and texts("plain < text") == ["plain < text"]
    assert texts("<script>never closed <p>x") == []
    nested = crf.blocks_of("<nav class='topMenu'><a href=x>one</a></nav><p>" + "x" * 9)
    assert {"in:nav", "name:top", "name:menu"} <= nested[0].element.around and nested[0].links == 3
    assert len(texts("<div>" * 5000 + "deep")) == 1 and len(texts("<p>w" * 20_000)) == 20_000


@pytest.mark.parametrize("tag", ["svg", "object", "video", "audio", "canvas", "select", "template", "math"])
def test_elements_left_open_keep_the_page(tag):
    assert texts(f"<div><{tag} class=x></div><p>One text.</p><{tag}><p>Two.</p>") == ["One text.", "Two."]


def test_math_and_object_text():
    page = "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><object data=a>Fallback text</object><svg><text>no</text></svg><p>End</p><script>all"
    assert texts(page) == ["So x=2 holds.", "Fallback text", "End"]


@pytest.mark.parametrize(
    "page",
    ["<b>" * 16_000 + "</i>" * 16_000 + "x", "<b>" * 16_000 + "<div></div>" * 16_000 + "x", "<div>" * 16_000 + "<li></li>" * 16_000 + "x", "<svg/>" * 16_000 + "</svg>x", "<a>" * 16_000 + "</a>" * 16_000 + "x"],
    ids=["unmatched", "inline", "items", "closed", "anchors"],
)
def test_thousands_of_tags_take_linear_time(page):
    start = time.process_time()
    assert texts(page) == ["x"]
    assert time.process_time() - start < 5  # quadratic code takes 20 and more


def test_deep_pages_of_different_classes_take_little_memory(extractor):
    page = "".join(f"<div class='k{''.join(chr(97 + int(d)) for d in str(n))} main'>" for n in range(8_000)) + "<p>" + "One long sentence of words, here. " * 9
    tracemalloc.start()
    extractor.blocks(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    lone = crf.Extractor(extractor.model)
    plain = "<div class=main><p>" + "One long sentence of words, here. " * 9
    assert lone.text(page) == lone.text(plain)


def test_features_no_model_knows_change_nothing(extractor):
    for page, _ in labelled_pages(20, 4):
        known = crf.blocks_of(page, crf.Ancestry(frozenset(extractor.model.weights)))
        for a, b in zip(crf.blocks_of(page), known, strict=True):
            assert a.text == b.text and b.element.around == a.element.around & extractor.model.weights.keys()


def test_held_out_layouts(extractor):
    right = total = 0
    for page, labels in labelled_pages(150, 2):
        for text, main in extractor.blocks(page):
            right += main == labels.get(text, False)
            total += 1
    assert right / total > 0.985


def test_viterbi_is_the_best_labelling(extractor):
    m = extractor.model
    for page, _ in labelled_pages(40, 3):
        blocks = crf.blocks_of(page)[:9]
        if len(blocks) < 2:
            continue
        got = extractor.blocks("")  # empty page
        assert got == []
        u = [m.bias + sum(m.weights.get(f, 0.0) for f in [*b.element.around, *crf.text_features(b, k, len(blocks))]) for k, b in enumerate(blocks)]
        score = lambda ys: sum(u[k] for k, y in enumerate(ys) if y) + m.start * ys[0] + sum(m.change[a][b] for a, b in itertools.pairwise(ys))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
        saved, crf.blocks_of = crf.blocks_of, lambda page, root=None: blocks  # noqa: B023
        try:
            assert tuple(int(x) for _, x in crf.Extractor(m).blocks("x")) == best
        finally:
            crf.blocks_of = saved


def test_query_returns_the_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_MID}/pages.parquet").collect()}
    got = QUERIES["op2_html_main_text"](spark, SF_MID).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = pages[r.page_id].split("<article>", 1)[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:h1|p)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_pages(spark, extractor):
    rows = [(1, None, "t"), (1, None, "t"), (2, "", "t"), (None, "<article><h1>Head of it</h1>" + "<p>Some words of an article, as they are written here.</p>" * 3000 + "</article>", "t"), (3, "<nav><a href=x>Home</a></nav>", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = crf.extract(pages, extractor.model).collect()
    assert sorted(r.n_chars for r in got)[:4] == [0, 0, 0, 0] and max(r.n_chars for r in got) > 150_000
    assert crf.extract(pages.limit(0), extractor.model).collect() == []


def test_training_gradient_raises_likelihood():
    pages = labelled_pages(20, 4)
    few, many = crf.train(pages, 5), crf.train(pages, 60)
    hits = lambda m: np.mean([x == l.get(t, False) for p, l in pages for t, x in crf.Extractor(m).blocks(p)])  # noqa: E731, E741
    assert hits(many) >= hits(few) and hits(many) > 0.98
    assert crf.train([]).weights == {}
