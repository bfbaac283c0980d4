import random

from helpers import awkward, clashing, frame, rows

from terrashard.llm import minhash


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out + [word] if word else out


def shingles(text):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    """doc_id to (n_shingles, component)."""
    sets, root = {i: shingles(t) for i, t, *_ in docs}, {i: i for i, *_ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    """Copies, chains of near copies, a family around the threshold, and short texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(60)]
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(50)]
    base = [word() for _ in range(120)]
    for _ in range(80):  # edits that leave a similarity of about 0.6 to 0.95 to one another
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    w = [word() for _ in range(100)]
    for i in range(0, 60, 3):  # a chain, each linked with the next alone
        w = w[:i] + [word(), word()] + w[i + 2 :]
        texts.append(" ".join(w))
    texts += [texts[3].upper(), texts[70], texts[70] + " \n", "a b c", "A  b\tc", "", None]
    rng.shuffle(texts)
    return rows(*texts)


def test_equals_brute_force(spark):
    docs = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute(docs)
    assert len({c for _, c in got.values()}) < len(got) - 60


def test_kept_is_the_smallest_of_its_component(spark):
    out = minhash.near_duplicates(frame(spark, rows("a b c d e f", "a b c d e f", "x y z"))).collect()
    assert {(r.doc_id, r.kept) for r in out} == {(0, True), (1, False), (2, True)}


def test_awkward_rows(spark):
    out = minhash.near_duplicates(clashing(frame(spark, awkward()))).collect()
    assert len(out) == len(awkward())
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_shingles == by[2][0].n_shingles == by[3][0].n_shingles == 0
    assert by[1][0].component_id == 1 and by[2][0].component_id == 2
    assert len(by[5]) == 2 and all(r.kept for r in by[5])
    assert not by[None][0].kept


def test_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in minhash.components(edges).collect()} == {0}


def test_copies_that_only_one_member_is_near_to(spark):
    """Copies of a text, each changed at three other places, are under the threshold of each other; what they were made from has the largest id."""
    base = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(40):
        words = list(base)
        for k in range(3):
            words[(i * 4 + 60 * k) % 180 + 8] = f"other{i}x{k}"
        rows.append((i, " ".join(words)))
    rows.append((1000, " ".join(base)))
    assert minhash.linked(rows[0][1], rows[40][1], 75) and not minhash.linked(rows[0][1], rows[20][1], 75)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs).collect()
    assert {(r.component_id, r.kept) for r in got} == {(0, True), (0, False)} and sum(r.kept for r in got) == 1
    signed = minhash.signatures(docs).select("doc_id", "sig")
    post = minhash.prefixes(signed, minhash.K, minhash.M).select("doc_id", "weight").distinct().orderBy("weight", ascending=False)
    assert post.first().doc_id == 1000
