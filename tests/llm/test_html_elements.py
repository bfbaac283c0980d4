"""Elements that hold no plain text, and pages of any depth."""

import itertools

import numpy as np
import pytest

from terrashard.llm import html_text

STORY = "The first sentence of a story that is long enough to be read by people."
NEXT = "And a second paragraph, quite as long as the first one, follows it here."


@pytest.fixture(scope="module")
def field():
    return html_text.train(html_text.labelled_pages(250), rounds=80)


@pytest.mark.parametrize("icon", ["<svg class=i />", "<math/>", "<svg><path d='M0'/>", "<svg><title>icon</title><style/></svg>", "<select><option>Pick", "<object data=x>", "<canvas>", "<iframe src=x />", "<iframe src=x>", "<svg viewBox='0 0 1 1'/>", "<svg viewBox='0 0 1 1'>"])
def test_what_follows_an_icon_stays(field, icon):
    page = f"<nav><a href=/a>Menu</a></nav>{icon}<article><h1>Title</h1><p>{STORY}</p><p>{NEXT}</p></article><footer>&copy; Site</footer>"
    got = html_text.main_text(field, page)
    assert STORY in got and NEXT in got and "Menu" not in got and "Pick" not in got


@pytest.mark.parametrize(("tag", "text"), [("noscript", f"<p>{NEXT}</p>"), ("object", f"<p>{NEXT}</p>")])
def test_main_text_inside_elements(field, tag, text):
    page = f"<nav><a href=/a>Menu</a></nav><article><h1>Title</h1><p>{STORY}</p><{tag}>{text}</{tag}><p>{STORY}</p></article><footer>&copy; Site</footer>"
    assert html_text.main_text(field, page) == f"Title {STORY} {NEXT} {STORY}"


def test_formulas_stay_in_their_sentence(field):
    page = "<nav><a href=/a>Menu</a></nav><article><p>Whoever knows that <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds can go on with the proof.</p></article>"
    assert html_text.main_text(field, page) == "Whoever knows that x=1 holds can go on with the proof."


def test_choices_and_labels_are_no_main_text(field):
    page = f"<article><h1>Title</h1><p>{STORY}</p><select><option>Red</option><option>Blue</option></select><p>{NEXT}</p></article>"
    assert html_text.main_text(field, page) == f"Title {STORY} {NEXT}"


def test_raw_text_goes_on_to_the_end():
    assert html_text.blocks("<p>a</p><script>x <p>b</p>") == html_text.blocks("<p>a</p>")


@pytest.mark.parametrize("wrap", ["div", "span", "font", "b", "x-y"])
def test_depth_changes_nothing(field, wrap):
    inside = f"<article><h1>Title</h1><p>{STORY}</p><p>{NEXT}</p></article><nav><a href=/a>Menu</a></nav>"
    assert html_text.main_text(field, f"<{wrap}>" * 600 + inside + f"</{wrap}>" * 600) == f"Title {STORY} {NEXT}"
    assert html_text.main_text(field, f"<{wrap}>" * 600 + inside) == f"Title {STORY} {NEXT}"


def test_end_tags_close_what_is_deepest():
    got = html_text.blocks("<article>" + "<font>" * 600 + "<div>one</div><div>two</div></article><nav>menu</nav>")
    assert [b[0] for b in got] == ["one", "two", "menu"]
    assert "article" in got[1][1].within and got[2][1].within == {"nav"}
    got = html_text.blocks("<div id=page><aside>" + "<span>" * 600 + "<div>a</div>b</span>c</aside>d")
    assert [(b[0], "aside" in b[1].within) for b in got] == [("a", True), ("bc", True), ("d", False)]


def test_broken_pages_take_time_in_proportion():
    import time

    for piece in ("<x>", "<div></p>", "<p><span>", "<li><b>", "<iframe>", "</x>", "<svg><g>", "<a href='x", "<select><option>"):
        began = time.perf_counter()
        html_text.blocks(piece * 60_000 + "end")
        assert time.perf_counter() - began < 10, piece


def test_expectations_equal_all_labellings():
    rng = np.random.default_rng(3)
    sizes, turn = (1, 4, 3), rng.standard_normal((2, 2))
    emit, real = rng.standard_normal((4, 3, 2)), np.array([[t < n for n in sizes] for t in range(4)])
    emit *= real[..., None]
    node, edge, z = html_text.expected(emit, turn, real)
    for j, n in enumerate(sizes):
        every = list(itertools.product((0, 1), repeat=n))
        score = np.array([sum(emit[t, j, y[t]] for t in range(n)) + sum(turn[a, b] for a, b in itertools.pairwise(y)) for y in every])
        p = np.exp(score - np.logaddexp.reduce(score))
        assert z[j] == pytest.approx(np.logaddexp.reduce(score))
        for t in range(n):
            assert node[t, j, 1] == pytest.approx(sum(q for q, y in zip(p, every, strict=True) if y[t]))
        for t in range(n - 1):
            assert edge[t, j, 0, 1] == pytest.approx(sum(q for q, y in zip(p, every, strict=True) if (y[t], y[t + 1]) == (0, 1)))
    assert not node[~real].any() and not edge[~real[1:]].any()


@pytest.mark.parametrize("tag", ['<p data-tip="<b>tip</b> text">', "<p title='a > b'>", '<p onclick="if(a<b){x()}">', '<img alt="a < b" src=x><p>', '<p data-a = "1 > 0" class=text data-b=\'<i x="y">\'>', "<![CDATA[ x > y ]]><p>", '<p a=b"c>', '<p "x" y>'])
def test_quotes_run_to_their_twin(field, tag):
    text = "This is a long sentence of the article, with enough words that it surely is its main text."
    page = f"<html><body><article><h1>A heading of the article</h1>{tag}{text}</p><p>{text}</p></article></body></html>"
    assert html_text.main_text(field, page) == f"A heading of the article {text} {text}"


def test_tags_without_an_end_take_time_in_proportion():
    import time

    for page in ('<a x="' * 50_000, "<a x='>' " * 50_000, '<a x=">" <b y=' * 40_000, "<a " * 100_000, '<p title="never closed>text ' + "<b>x</b> " * 40_000):
        began = time.perf_counter()
        html_text.blocks(page)
        assert time.perf_counter() - began < 5
