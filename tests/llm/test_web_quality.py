import itertools
import math
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, clashing, frame, rows
from pyspark.sql import functions as F

from terrashard.llm import html_text, kneser_ney, warc
from terrashard.llm.common import settle


@pytest.fixture(scope="module")
def field():
    return html_text.train(html_text.labelled_pages(250), rounds=80)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    for n in range(1, 7):
        emit, turn = rng.standard_normal((n, 2)), rng.standard_normal((2, 2))
        score = lambda y: sum(emit[i, y[i]] for i in range(n)) + sum(turn[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        assert html_text.viterbi(emit, turn) == list(max(itertools.product((0, 1), repeat=n), key=score))


def test_held_out_pages(field):
    wrong = total = 0
    for page in html_text.labelled_pages(120, seed=99):
        raw = html_text.blocks(page)
        cut = [(t.replace(html_text.MAIN, "").replace(html_text.OTHER, "").strip(), p, n) for t, p, n in raw]
        labels = html_text.viterbi(html_text.scores(field, cut), field.turn)
        wrong += sum((html_text.MAIN in t) != bool(y) for (t, _, _), y in zip(raw, labels, strict=True))
        total += len(raw)
    assert wrong <= 0.02 * total


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href=/>Site</a></header>
<nav><ul><li><a href="/a">Menu a</a></li><li><a href="/b">Menu b</a></li></ul></nav><div class="cookie-notice">We use cookies to make this site better.</div>
<article><h1>A title &amp; more</h1><p><b>First words</b> of&nbsp;a   sentence that is long enough to read.<br>Next line.<p>Second paragraph, quite long too, and with <a href=x>a link</a> in it.</p>
<div class="ad">Buy this thing now!</div><ul><li>An item that belongs to the story.</li></ul></article><section id="comments"><h3>Comments</h3><p>I like this very much, thanks.</p></section>
<aside class="sidebar"><h3>Related</h3><a href=/c>Other story</a></aside><form><label>Mail</label><input></form><footer>&copy; Site</footer></body></html>"""


def test_page_by_hand(field):
    assert html_text.main_text(field, PAGE) == (
        "A title & more First words of a sentence that is long enough to read. Next line. Second paragraph, quite long too, and with a link in it. An item that belongs to the story."
    )


def test_extract_awkward_pages(spark, field):
    broken = ["", None, "just text & more &lt;b&gt;", "<p>unclosed <b>bold <p>next", "</div></div><p>a < b and c > d", "<script>never closed <p>x", "<!-- never closed <p>x", '<a title="x > y">link</a>', "<div>" * 3000 + "deep" + "</div>" * 3000, "<p>" + "long words " * 60_000 + "</p>", "<a href='x" * 2000]
    df = spark.createDataFrame([(i, "u", h, "old", "k") for i, h in enumerate([*broken, PAGE, PAGE])], "page_id long, url string, html string, text string, n_chars string")
    got = {r.page_id: r for r in html_text.extract(df, field).collect()}
    assert len(got) == len(broken) + 2 and all(len(r.text) == r.n_chars for r in got.values())
    assert got[0].text == got[1].text == "" and got[2].text == "just text & more <b>" and got[5].text == got[6].text == ""
    assert got[9].n_chars == 60_000 * 11 - 1 and got[len(broken)].text == got[len(broken) + 1].text
    assert html_text.extract(df.limit(0), field).count() == 0


CAPTURES = "record_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, payload string"


def test_revisits_by_hand(spark):
    data = [
        (1, "http://E.org/a?b=2&a=1", 10, 200, '"x"', None, {"Date": "d1", "Content-Type": "t"}, "one"),
        (2, "https://www.e.org:443/a?a=1&b=2#f", 20, 304, 'W/"x"', None, {"DATE": "d2", "Content-Type": "bad", "ETag": "e"}, None),
        (3, "http://e.org/a?a=1&b=2", 30, 200, '"y"', "lm", None, "two"), (4, "http://e.org/a?a=1&b=2", 31, 304, '"x"', None, None, None),
        (5, "http://e.org/a?a=1&b=2", 32, 304, None, "lm", None, None), (6, "http://e.org/a?a=1&b=2", 5, 304, '"x"', None, None, None), (7, None, 5, 304, '"x"', None, None, None),
        (8, "http://e.org/a?a=1&b=2", None, 304, '"x"', None, None, None), (9, "http://e.org", 1, 200, None, None, None, "home"), (10, "http://user@e.org/", 1, 304, None, None, None, None),
        (12, "http://e.org/a?a=1&b=2", 30, 304, '"y"', None, None, None), (2, "http://e.org/zz", 20, 304, '"x"', None, None, None), (13, "http://e.org/a?a=1&b=2", 40, 404, None, None, None, "no"),
    ]
    df = clashing(spark.createDataFrame(data, CAPTURES))
    got = {(r.record_id, r.canonical_url): r for r in warc.resolve(df).collect()}
    a = "e.org/a?a=1&b=2"
    assert len(got) == 9
    assert (got[2, a].base_id, got[2, a].outcome, got[2, a].payload) == (1, "resolved", "one")
    assert got[2, a].headers == {"content-type": "t", "date": "d2", "etag": "e"}
    assert (got[4, a].base_id, got[4, a].outcome, got[4, a].payload) == (3, "validators differ", None)
    assert got[5, a].outcome == got[12, a].outcome == "resolved" and got[5, a].headers == {}
    assert got[6, a].outcome == got[2, "e.org/zz"].outcome == "no earlier response"
    assert got[7, None].outcome == got[8, a].outcome == "no time or URL"
    assert (got[10, "e.org/"].base_id, got[10, "e.org/"].outcome) == (9, "validators differ")
    assert warc.resolve(df.limit(0)).count() == 0


def test_slices_of_time_change_nothing(spark, monkeypatch):
    import random

    rng = random.Random(2)
    data = [(i, f"http://h/{rng.choice('aaaaab')}", rng.randrange(300), rng.choice([200, 304]), '"x"', None, None, "p") for i in range(600)]
    df = spark.createDataFrame(data, CAPTURES)
    whole = sorted((r.record_id, r.base_id or -1) for r in warc.resolve(df).collect())
    monkeypatch.setattr(warc, "SLICE_ROWS", 20)
    assert sorted((r.record_id, r.base_id or -1) for r in warc.resolve(df).collect()) == whole
    brute = []
    for i, url, ts, status, *_ in data:
        if status == 304:
            past = [(t, j) for j, u, t, s, *_ in data if u == url and s == 200 and (t, j) < (ts, i)]
            brute.append((i, max(past)[1] if past else -1))
    assert whole == sorted(brute)


def test_headers_that_differ_in_case(spark):
    data = [(1, "http://e.org/", 1, 200, '"x"', None, {"Vary": "a", "vary": "b", "VARY": "c", "X": "1", "x": None}, "one"), (2, "http://e.org/", 2, 304, '"x"', None, {"Date": "d1", "date": "d2"}, None)]
    (r,) = warc.resolve(spark.createDataFrame(data, CAPTURES)).collect()
    assert r.headers == {"vary": "b", "x": None, "date": "d2"}


def test_responses_that_share_an_id(spark):
    """Each is a response of its own, however rows come; of those with the same time, one is the latest."""
    data = [(1, "http://e.org/", 1, 200, '"x"', None, None, "early"), (1, "http://e.org/", 5, 200, '"y"', None, None, "late"), (1, "http://e.org/", 5, 200, '"y"', None, None, "other"), (2, "http://e.org/", 3, 304, '"x"', None, None, None), (3, "http://e.org/", 6, 304, '"y"', None, None, None), (1, "http://e.org/", 5, 304, '"y"', None, None, None)]
    df = spark.createDataFrame(data, CAPTURES)
    seen = []
    for n in (1, 3, 6):
        got = {r.record_id: r for r in warc.resolve(df.repartition(n)).collect()}
        assert got[2].payload == "early" and got[3].payload in ("late", "other")
        assert (got[1].base_id, got[1].outcome) == (1, "validators differ")  # the responses of its own time and id aren't earlier
        seen.append(got[3].payload)
    assert len(set(seen)) == 1


def test_a_response_that_many_revisit(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLOT", 10)
    data = [(1, "http://e.org/", 1, 200, '"x"', None, {"A": "b"}, "hot"), (2, "http://e.org/b", 1, 200, '"y"', None, None, "cold")] + [(3 + i % 90, f"http://e.org/{'b' * (i % 97 == 0)}", 5, 304, '"x"' if i % 97 else '"y"', None, None, None) for i in range(900)]
    got = warc.resolve(spark.createDataFrame(data, CAPTURES)).collect()
    assert len(got) == 900 and all(r.outcome == "resolved" for r in got)
    assert sum(r.payload == "cold" for r in got) == len(range(0, 900, 97)) and sum(r.payload == "hot" and r.headers == {"a": "b"} for r in got) == 900 - len(range(0, 900, 97))


def test_an_outlier_in_time_leaves_slices_even(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLICE_ROWS", 100)
    data = [(i, "http://h/", i % 700, 200 if i % 3 else 304, '"x"', None, None, "p") for i in range(2000)] + [(9999, "http://h/", 1 << 50, 304, '"x"', None, None, None)]
    df = spark.createDataFrame(data, CAPTURES)
    sizes = {}
    real = warc.settle
    monkeypatch.setattr(warc, "settle", lambda d, name: sizes.setdefault(name, real(d, name)))
    got = {r.record_id: r.base_id for r in warc.resolve(df).collect()}
    per = [r["count"] for r in sizes["slices"].groupBy("slice").count().collect()]
    assert len(per) >= 15 and max(per) <= 400
    for i, _, ts, status, *_ in data:
        if status == 304:
            assert got[i] == max(((t, j) for j, _, t, s, *_ in data if s == 200 and (t, j) < (ts, i)), default=(0, None))[1]


def loss_by_hand(trusted, text):
    """Negative log probability of a text by the definition of an interpolated modified Kneser-Ney bigram model."""
    split = lambda t: (t or "").encode().lower().split()
    often = Counter(w for t in trusted for w in split(t))
    vocabulary = sorted((w for w, c in often.items() if c > 1), key=lambda w: (-often[w], w))
    fold = lambda t: ["^", *(w if w in vocabulary else "?" for w in split(t)), "^"]
    pairs = Counter(g for t in trusted if split(t) for g in itertools.pairwise(fold(t)))
    to = Counter(w for _, w in pairs)

    def cuts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5, 0.05), k) for k in (1, 2, 3)]
        return lambda v: d[min(v, 3) - 1]

    off, off1 = cuts(pairs.values()), cuts(to.values())
    bytes_ = np.ones((256, 256))
    for w in vocabulary:
        for a, b in itertools.pairwise(b"\0" + w + b"\0"):
            bytes_[a, b] += 1

    def p1(w):
        n = sum(to.values())
        return (max(to[w] - off1(to[w]), 0) if to[w] else 0) / n + sum(map(off1, to.values())) / n / (len(vocabulary) + 2)

    def p(h, w):
        row = {b: v for (a, b), v in pairs.items() if a == h}
        if not row:
            return p1(w)
        return ((row[w] - off(row[w]) if w in row else 0) + sum(map(off, row.values())) * p1(w)) / sum(row.values())

    assert sum(p("the", w) for w in ["^", "?", *vocabulary]) == pytest.approx(1)
    spelled = -sum(math.log(bytes_[a, b] / bytes_[a].sum()) for w in split(text) if w not in vocabulary for a, b in itertools.pairwise(b"\0" + w + b"\0"))
    return spelled - sum(math.log(p(*g)) for g in itertools.pairwise(fold(text)))


@pytest.mark.parametrize(("shards", "heavy", "hot"), [(1, 0, 0), (5, 0, 0), (5, 4, 0), (3, 1 << 18, 1 << 16)])
def test_kneser_ney_equals_its_definition(spark, monkeypatch, shards, heavy, hot):
    trusted = ["the cat sat on the mat .", "a cat and a dog sat .", "the the the", "The dog sat on a cat .", "", None, "élan 42\nend élan"]
    asked = ["the cat sat", "the zebra sat on the dog .", "a", "unseen words only", "élan the élan", "the cat sat"]
    given = spark.createDataFrame([(t, True) for t in trusted], "text string, counts boolean")
    words = kneser_ney.vocabulary(given)
    counts = settle(kneser_ney.counted(given, words, shards), "counts")
    model = kneser_ney.built(counts, words, heavy, hot)
    rows_ = spark.createDataFrame([(i << 60, t) for i, t in enumerate([*asked, "", None])], "key long, text string")
    got = {r.key >> 60: r for r in kneser_ney.scored(rows_, model, counts, shards).collect()}
    assert len(got) == len(asked) + 2 and all(r.rows == 1 for r in got.values())
    for i, t in enumerate(asked):
        assert got[i].words == len(t.split()) and got[i].loss == pytest.approx(loss_by_hand(trusted, t), rel=1e-9)
    assert got[6].words == got[7].words == 0
    assert (len(model.known) == 0) == (heavy == hot == 0) or heavy == 4


def test_bigrams_common_to_documents_are_hot(spark):
    given = spark.createDataFrame([("x y never trusted", False)] * 80 + [("a b a b", True)], "text string, counts boolean")
    words = [b"a", b"b", b"x", b"y"]
    counts = settle(kneser_ney.counted(given.coalesce(1), words, 2), "counts")
    model = kneser_ney.built(counts, words, heavy=0)
    code = 4 << 16 | 5
    assert code in model.known and model.values[model.known == code] == 0


def test_packed_numbers_come_back():
    for n in ([], [0], [5, 2**32 - 1, 7], list(range(1000))):
        x = np.array(n, np.int64)
        assert kneser_ney.unpacked(kneser_ney.packed(x)).tolist() == n and kneser_ney.unpacked(kneser_ney.packed(x, "<u8"), "<u8").tolist() == n
        assert kneser_ney.risen(kneser_ney.rising(np.sort(x))).tolist() == sorted(n)


def test_judge_rejects_noise_and_keeps_the_rest(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice(("ba", "ne", "ti", "ro", "shu")) for _ in range(rng.randint(1, 3)))
    data = [(i, " ".join(word() for _ in range(60)) + ".", "en", "s", 0) for i in range(200)] + [(300 + i, " ".join(word() + "%#|" for _ in range(60)), "en", "s", 0) for i in range(20)]
    data += [(i and 500 + i, *rest) for i, *rest in awkward()]
    trusted = spark.createDataFrame([(i,) for i in [*range(0, 200, 2), None, 0]], "doc_id long")
    got = kneser_ney.judge(clashing(frame(spark, data)), trusted).collect()
    assert len(got) == len(data)
    good = [r for r in got if r.doc_id is not None and r.doc_id < 200]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and not any(r.kept for r in got if r.doc_id and 300 <= r.doc_id < 500)
    assert all(r.perplexity is None and not r.kept for r in got if r.doc_id in (501, 502))
    none = kneser_ney.judge(frame(spark, data), trusted.where(F.lit(False))).collect()
    assert len(none) == len(data) and not any(r.kept for r in none)
    assert kneser_ney.judge(frame(spark, []), trusted).count() == 0
