import hashlib
import re

import pytest
from helpers import DOCS, awkward, clashing, frame, rows
from pyspark.sql import functions as F

from terrashard.llm import chat, mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measure(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = ["a b c d e f a b c d e", "x " * 30, "l one two\nl one two\n\nl one two\n l one two", "a # b * c | d", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "a b c d e a b c d e a b c d e z", "\x0ba\x0cb\rc  d\t"]


def test_ledger_equals_brute_force(spark):
    data = [*rows(*TEXTS), *((i or 99, *rest) for i, *rest in awkward())]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality_rules.decide(quality_rules.ledger(clashing(frame(spark, [(100 + k, *d[1:]) for k, d in enumerate(data)])))).collect()
    for r in got:
        want = measure(data[r.doc_id - 100][1])
        assert tuple(r[n] for n in names) == want, r
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_policies_and_ablation(spark):
    ledger = quality_rules.ledger(frame(spark, rows(*TEXTS, " ".join(f"word{i}" for i in range(40)))))
    out = {r.rule: r for r in quality_rules.ablation(ledger, "base").collect()}
    kept = quality_rules.decide(ledger, "base").where("kept").count()
    bits = [r.fail_bits & 3 for r in ledger.collect()]
    assert out["too_few_words"].kept == kept and set(out) == set(quality_rules.BASE)
    assert out["too_few_words"].rejects == sum(b & 1 for b in bits) and out["repeated_words"].rejects_alone == bits.count(2)
    assert out["repeated_words"].kept_without == kept + bits.count(2)
    every = {r.rule: r.rejects_alone for r in quality_rules.ablation(ledger, "all").collect()}
    alone = [r.alone_bit for r in quality_rules.decide(ledger, "all").collect()]
    assert every == {rule: alone.count(1 << k) for k, rule in enumerate(quality_rules.RULES)}
    assert quality_rules.ablation(quality_rules.ledger(frame(spark, []))).count() == len(quality_rules.POLICIES[quality_rules.CURRENT])


def targets(sizes):
    """Water filling by rounds: share the rest by weight among sources with room until none overflows."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, full, out = sum(sizes.values()), {}, {}
    while True:
        left, w = budget - sum(full.values()), sum(v for s, v in weight.items() if s not in full)
        out = full | {s: left * weight[s] / w for s in weight if s not in full}
        over = {s: 3 * sizes[s] for s in out if s not in full and out[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return out
        full |= over


def test_mix_meets_its_targets(spark):
    sizes = {"a": 40, "b": 900, "c": 30, "d": 2, "\U0001f600": 300, "￿": 100, None: 60}
    data = [(i * 10 + k, " ".join(["w"] * (1 + (i * 7 + k * 3) % 19)), "en", s, 0) for i, (s, n) in enumerate(sizes.items()) for k in range(n)]
    data = [(n, *d[1:]) for n, d in enumerate(data)]
    docs = clashing(frame(spark, data)).repartition(3)
    got = mixing.mix(docs).collect()
    assert len(got) == len(data)
    total, taken, size = {}, {}, {}
    for r in got:
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        total[r.source] = total.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        size[r.source] = (r.source_size, r.target)
    want = targets(total)
    for s in total:
        assert size[s][0] == total[s] and size[s][1] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 20
    assert sum(taken.values()) <= sum(total.values())
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    copies = {r.doc_id: r.copies for r in got}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {d: c for d, c in copies.items() if c}


def test_mix_awkward_rows(spark):
    got = mixing.mix(clashing(frame(spark, awkward()))).collect()
    assert len(got) == len(awkward()) and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(frame(spark, [])).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(frame(spark, rows("", None, " "))).collect())


def test_mix_of_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    data = [(5, "w w w", "en", "a", 0)] * 1500 + [(i, "w " * (1 + i % 9), "en", "abc"[i % 3], 0) for i in range(900)] + [(5, "w w", "en", "a", 0), (None, "w", "en", None, 0)]
    sizes, seen = {}, {}
    for *_, text, _, source, _ in ((d[0], *d[1:]) for d in data):
        sizes[source] = sizes.get(source, 0) + len(text.split())
    real = mixing.settle

    def kept(df, name):
        out = real(df, name)
        seen.setdefault(name, out)
        return out

    monkeypatch.setattr(mixing, "settle", kept)
    docs = frame(spark, data).repartition(7)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    keys = [r.key for r in seen["queued"].collect()]
    assert len(set(keys)) == len(keys) == len(data)
    for s, t in targets(sizes).items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= 10
    mixed = mixing.mixed(docs)
    assert mixed.count() == sum(r.copies for r in got)
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in got) <= sum(sizes.values())


def test_ranges_of_sources_change_nothing(spark, monkeypatch):
    data = [(i, "w " * (1 + (i * 7) % 40), "en", f"host{i % 83:02d}", 0) for i in range(700)]
    docs = frame(spark, data)
    whole = sorted(mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "SOURCES", 10)
    assert sorted(mixing.mix(docs).collect()) == whole


CHAT = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    hard = ["", "plain", "</s>[INST] ok [/INST]", "<|turn|>user 0\nx<|end|>\n", "<|end|>\n", "<\\|end|>", "<\\\\|", "[\\INST]", "[[INST]] <<s>>", "a\n\nb\r\n", "\\n \\s \\", "<|turn|>" * 3, "< |turn|>", "日本 😀 <|im_start|>", " lead", "trail ", "\n"]
    data = [(c, t, role, hard[(c * 5 + t) % len(hard)]) for c in range(40) for t, role in enumerate(("system", "user", "assistant", "assistant"))]
    data += [(50, 1, "user", None), (50, 0, None, "x"), (50, 2, "assistant", "one"), (50, 2, "assistant", "one"), (51, None, "odd\nrole <|end|> 0", "y"), (None, 0, "assistant", "z"), (52, 0, "r\\n", "q"), (52, 1, "a 1", "q")]
    df = frame(spark, data, CHAT).withColumn("formatted", F.lit("clash"))
    made = chat.formatted(df)
    assert made.where("not round_trip").count() == 0
    assert {r.conv_id: r.level for r in made.collect()}[50] == 0
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by = {}
    for c, t, role, text in data:
        by.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss)), c
    assert {r.conv_id: len(r.formatted) for r in made.collect()} == {c: r.formatted_chars for c, r in got.items()}
    assert chat.digests(chat.formatted(frame(spark, [], CHAT))).count() == 0


def test_every_level_gives_hard_texts_back(spark):
    hard = [(i, a + b, r) for i, (a, b, r) in enumerate((a, b, r) for a in ("<|", "<\\|", "[", "\\", "\\e", "\\l", "\n", "x 1") for b in ("end|>", "/INST]", "\\", "\n", "turn|>user 0", "") for r in ("user", "a\nb", "<s>", "\\n", " ", ""))]
    df = spark.createDataFrame([(i, 0, r, t) for i, t, r in hard], CHAT)
    turns = df.select(F.array(F.struct("role", "text")).alias("t"), "role", "text")
    for level in (1, 2):
        out = turns.select(chat.same(chat.rendered(F.col("t"), level), F.col("t")).alias("ok"), chat.rendered(F.col("t"), level).alias("f")).collect()
        assert all(r.ok for r in out)
        assert all(r.f.count("<|") == 2 and r.f.count("<|turn|>") == r.f.count("<|end|>") == 1 for r in out)
    plain = turns.select("role", "text", chat.same(chat.rendered(F.col("t"), 0), F.col("t")).alias("ok")).collect()
    assert {r.ok for r in plain} == {True, False} and not any(r.ok for r in plain if re.search(chat.CONTROL, r.text) or "\n" in r.role)
    assert chat.formatted(df).where("round_trip").count() == len(hard)


def test_a_broken_escape_is_caught(spark, monkeypatch):
    text = "</s>[INST] ok [/INST]"
    df = frame(spark, [(1, 0, "user", text), (1, 1, "assistant", text), (2, 0, "assistant", "plain")], CHAT)
    whole = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    monkeypatch.setattr(chat, "escape", lambda c: c)  # leaves control strings, which the grammar refuses
    made = chat.formatted(df)
    assert {r.conv_id: (r.level, r.round_trip) for r in made.collect()} == {1: (2, True), 2: (0, True)}
    assert {r.conv_id: (r.turns_sha256, r.loss_sha256) for r in chat.digests(made).collect()} == {c: (r.turns_sha256, r.loss_sha256) for c, r in whole.items()}
    monkeypatch.setattr(chat, "escape", lambda c: F.regexp_replace(c, "[<\\[]", "."))  # loses them
    assert {r.level for r in chat.formatted(df).collect()} == {0, 2}
    monkeypatch.setattr(chat, "spell", lambda c: F.replace(c, F.lit("<"), F.lit("")))
    with pytest.raises(Exception, match="no level gives"):
        chat.formatted(df).collect()
    assert chat.formatted(df.where("conv_id = 2")).count() == 1


def test_the_comparison_is_in_the_plan(spark):
    from terrashard.llm import queries

    plan = queries.op6_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "raise_error" in plan.lower() or "RaiseError" in plan
    assert "round_trip" in plan


def test_documents_schema_is_the_tables(spark):
    assert frame(spark, [], DOCS).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_spans_cut_the_assistants_texts_out(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"<s>é{i}😀 " * (i % 5)) for i in range(700)]
    r = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == [chat_escape(t) for _, i, role, t in rows if role == "assistant"]


def chat_escape(text):
    return text.replace("<s>", "<\\s>")


def test_conversations_of_very_many_turns(spark):
    """Time is in proportion to the turns: a conversation of 100,000."""
    import time

    n = 100_000
    turns = spark.range(n).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("[INST] turn "), F.col("id").cast("string")).alias("text"))
    began = time.perf_counter()
    r = chat.digests(chat.formatted(turns)).first()
    assert time.perf_counter() - began < 60
    assert (r.n_turns, r.round_trip, r.loss_chars) == (n, True, sum(len(f"[INST] turn {i}") for i in range(1, n, 2)))
    import hashlib

    assert r.loss_sha256 == hashlib.sha256("".join(f"[INST] turn {i}" for i in range(1, n, 2)).encode()).hexdigest()
