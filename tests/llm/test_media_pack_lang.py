import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, clashing, frame, rows
from pyspark.sql import functions as F

from terrashard.llm import audio, language_id, packing
from terrashard.llm.queries import tokenizer_path


def test_audio_is_lossless_and_alike_for_equal_texts(spark):
    data = [*awkward(), (20, "same text " * 40, "en", "a", 0), (21, "same text " * 40, "en", "a", 0), (22, "x" * 64, "en", "a", 0), (23, "x" * 65, "en", "a", 0)]
    df = audio.features(audio.encode(clashing(frame(spark, data)))).withColumn("feature", audio.digest())
    got, feature = df.collect(), {}
    texts = {d[0]: d[1] for d in data}
    assert len(got) == len(data)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        pad = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert audio.samples_of(bytes(r.media)) == pad
        chunks = audio.tensors(bytes(r.tensors))
        assert sum(chunks["frames"].to_pylist()) == r.frames and chunks.schema == audio.STORED and chunks.num_rows == -(-r.frames // audio.CHUNK)
        times = [(s.t_start, s.t_end) for s in r.spans] + list(zip(chunks["t_start"].to_pylist(), chunks["t_end"].to_pylist(), strict=True))
        assert all(0 <= a < b <= r.payload_bytes / audio.RATE + 1e-9 for a, b in times)
        feature.setdefault(bytes(r.media), set()).add(r.feature)
    assert all(len(f) == 1 for f in feature.values())
    assert audio.features(audio.encode(frame(spark, []))).count() == 0


def features_by_hand(raw):
    """Log-mel frames of samples, from the definitions: each resampled value, frame, bin and band by itself."""
    x = [(b - 128) / 128 for b in raw]
    n = audio.UP * audio.TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(audio.UP, audio.DOWN)
    h = audio.UP * cut * np.sinc(cut * t) * np.hamming(n)
    y = [sum(h[m * audio.DOWN - k * audio.UP] * x[k] for k in range(max(0, (m * audio.DOWN - n) // audio.UP), len(x)) if 0 <= m * audio.DOWN - k * audio.UP < n) for m in range(-(-len(x) * audio.UP // audio.DOWN))]
    frames = max(1, 1 + -(-(len(y) - audio.WIN) // audio.HOP))
    y = np.array(y + [0.0] * (audio.WIN + (frames - 1) * audio.HOP - len(y)))
    rate = audio.RATE * audio.UP / audio.DOWN
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * k / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * i / (audio.WIN - 1)) for i in range(audio.WIN)]
    turns = np.exp(-2j * np.pi * np.outer(np.arange(audio.WIN // 2 + 1), np.arange(audio.WIN)) / audio.WIN)
    out = np.zeros((frames, audio.MELS))
    for f in range(frames):
        power = np.abs(turns @ (y[f * audio.HOP : f * audio.HOP + audio.WIN] * hann)) ** 2
        for k in range(audio.MELS):
            lo, mid, hi = edges[k : k + 3]
            weight = lambda v: max(0.0, min((v - lo) / (mid - lo), (hi - v) / (hi - mid)))  # noqa: B023, E731
            out[f, k] = math.log10(sum(p * weight(i * rate / audio.WIN) for i, p in enumerate(power)) + 10**audio.FLOOR)
    return out


@pytest.mark.parametrize("n", [64, 384, 1984])
def test_tensors_and_spans_equal_their_definition(n):
    raw = bytes((np.random.default_rng(n).integers(-90, 90, n) * (np.arange(n) % 700 < 250) + 128).astype(np.uint8))
    x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    mel = audio.log_mel(audio.resample(x, audio.low_pass()), audio.mel_bank(), np.hanning(audio.WIN).astype(np.float32))
    want = features_by_hand(raw)
    loud = want > audio.FLOOR + 4  # near silence, single precision is what differs
    assert mel.shape == want.shape and np.allclose(mel[loud], want[loud], atol=2e-3) and (mel[~loud] < audio.FLOOR + 5).all()
    chunks = audio.tensors(audio.stored(mel, n / audio.RATE))
    hop, width = audio.HOP / (audio.RATE * audio.UP / audio.DOWN), audio.WIN / (audio.RATE * audio.UP / audio.DOWN)
    for k, c in enumerate(chunks.to_pylist()):
        part = mel[k * audio.CHUNK : (k + 1) * audio.CHUNK]
        assert c["frames"] == len(part) and c["t_start"] == pytest.approx(k * audio.CHUNK * hop)
        assert c["t_end"] == pytest.approx(min(n / audio.RATE, (k * audio.CHUNK + len(part) - 1) * hop + width))
        whole = np.array(c["tensor"]).reshape(audio.CHUNK, audio.MELS)
        assert (whole[: len(part)] == part).all() and (whole[len(part) :] == audio.FLOOR).all()
    assert chunks.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), (audio.CHUNK, audio.MELS))
    assert (audio.mel_of(chunks) == mel).all()


def hysteresis_by_hand(energy):
    mid, half, on, out = np.mean(energy), np.std(energy) / 2, False, []
    for i, e in enumerate([*energy, -np.inf]):
        if not on and e >= mid + half:
            on, start = True, i
        elif on and e < mid - half:
            on = False
            out.append((start, i))
    return out


def test_segments_equal_their_definition():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 40, 300):
        for _ in range(20):
            energy = np.cumsum(rng.standard_normal(n))
            if energy.std():
                assert audio.active(energy) == hysteresis_by_hand(energy)


def test_resampling_equals_its_definition():
    x = np.random.default_rng(0).standard_normal(101).astype(np.float32)
    taps = audio.low_pass()
    h = np.zeros(audio.UP * audio.TAPS)
    for p in range(audio.UP):
        h[p :: audio.UP] = taps[p][::-1]
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    want = np.convolve(up, h)[: len(up)][:: audio.DOWN]
    assert np.allclose(audio.resample(x, taps), want, atol=1e-5)


def test_hysteresis():
    e = np.array([0, 0, 5, 3, 2, 3, 0, 0, 2, 0], float)  # opens at 5, stays open at 2, closes at 0; 2 alone opens nothing
    assert audio.active(e) == [(2, 6)]


def test_wav_of_another_kind_is_refused():
    with pytest.raises(ValueError):
        audio.samples_of(b"RIFFxxxxWAVEfmt ")


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    data = [(i or 0, *rest) for i, *rest in awkward() if i != 5] + [(30 + i, f"Document {i} says it's {i} times.  Twice\n\n new " * (i * 9), "en", "a", 0) for i in range(40)] + [(80, "a <|endoftext|> b<|endoftext|>", "en", "a", 0), (5, awkward()[4][1], "en", "b", 1)]
    got = packing.pack(clashing(frame(spark, data)).repartition(4), tokenizer_path()).collect()
    by, seq = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and r.length > 0
    for doc_id, text, *_ in data:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(by[doc_id], key=lambda r: r.start)
        assert [x for r in parts for x in np.frombuffer(bytes(r.ids), "<u4").tolist()] == ids
        assert all(r.doc_tokens == len(ids) for r in parts) and [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist()
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    total = sum(r.length for r in got)
    assert len(seq) == -(-total // packing.SEQUENCE)  # one shard: padding is less than one sequence
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_packing_takes_repeated_rows(spark):
    got = packing.pack(frame(spark, rows("a b c") * 3), tokenizer_path()).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3


def cheapest_with_room(lengths, sequence):
    """The same by looking at every sequence."""
    n = -(-sum(lengths) // sequence)
    used, costs, out = [0] * n, [0.0] * n, []
    wait = sorted(((x, -i, 0) for i, x in enumerate(lengths)), reverse=True)
    while wait:
        size, i, start = wait.pop(0)
        fits = [k for k in range(n) if used[k] + size <= sequence]
        to = min(fits, key=lambda k: (costs[k], k)) if fits else min(range(n), key=lambda k: (used[k], costs[k], k))
        put = min(size, sequence - used[to])
        out.append((-i, start, put, to, used[to]))
        used[to], costs[to] = used[to] + put, costs[to] + packing.cost(put)
        if put < size:
            wait = sorted([*wait, (size - put, i, start + put)], reverse=True)
    return out, costs


@pytest.mark.parametrize("sequence", [16, 2048])
def test_assignment_goes_to_the_cheapest_with_room(sequence):
    for seed in range(4):
        lengths = np.random.default_rng(seed).integers(1, sequence, 60 + 40 * seed).tolist()
        parts = packing.assign(lengths, sequence)
        want, costs = cheapest_with_room(lengths, sequence)
        assert parts == want
        assert max(costs) - min(costs) <= packing.cost(sequence)
        used = {}
        for _, _, n, to, at in parts:
            assert used.get(to, 0) == at
            used[to] = at + n
        assert sum(used.values()) == sum(lengths) and max(used.values()) <= sequence
        assert len(used) == -(-sum(lengths) // sequence)  # so padding is less than one sequence
    assert packing.assign([], sequence) == []


def test_ids_equal_the_librarys():
    import random

    from tokenizers import Tokenizer

    with open(tokenizer_path(), "rb") as f:
        content = f.read()
    words, tok, rng = packing.Words(content), Tokenizer.from_buffer(content), random.Random(1)
    signs = [*"ab'sltd  \n\t\r\x0b\x1c\x85\xa0\u3000éß日😀1٣.,<|", "'ll", "<|endoftext|>", " the", "  ", "\n\n", "word", " Æsir"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(words.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_rows_of_one_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 2000)
    monkeypatch.setattr(packing, "COPIES", 4)
    for text in (lambda i: "a b c", lambda i: f"a b {i}", lambda i: None):
        docs = frame(spark, [(None, text(i), "en", "s", 0) for i in range(3000)])
        got = packing.pack(docs, tokenizer_path(), 64).where("length < 64").groupBy(F.shiftright("sequence_id", 32).alias("shard")).count().collect()
        assert len(got) > 5 and max(r["count"] for r in got) < 1200


def gradient_by_differences(w, x, y, n, name, at, eps=1e-2):
    def loss(v):
        old = v[name][at]
        out = []
        for d in (eps, -eps):
            v[name][at] = old + d
            m = language_id.Model(["a", "b"], (v["ft"], v["fu"]), (v["bt"], v["bu"]), v["o"], v["c"])
            p = language_id.probabilities(m, x)
            out.append(-np.mean(np.log(p[:, y, np.arange(x.shape[1])])))
        v[name][at] = old
        return (out[0] - out[1]) / (2 * eps)

    return loss(w)


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(0)
    n = 3
    w = {k: rng.standard_normal(s).astype(np.float32) * 0.5 for k, s in (("ft", (256, 9)), ("fu", (3, 9)), ("bt", (256, 9)), ("bu", (3, 9)), ("o", (6, 2)), ("c", (2,)))}
    x, y = rng.integers(65, 70, (7, 5)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    g = language_id.gradient(w, x, y, n)
    for name, at in (("ft", (66, 1)), ("fu", (2, 4)), ("fu", (0, 8)), ("bt", (67, 7)), ("bu", (1, 0)), ("o", (4, 1)), ("c", (0,))):
        assert g[name][at] == pytest.approx(gradient_by_differences(w, x, y, n, name, at), abs=2e-3), name


def test_language_held_out(spark):
    import random

    rng = random.Random(4)
    vocab = {"aa": "the of and to in is that for with this".split(), "bb": "der die und das ist nicht ein für mit über".split(), "cc": "le la les des et que pour dans est être".split()}
    data = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(15, 120))), lang, "s", 0) for i, lang in enumerate(rng.choice(list(vocab)) for _ in range(400))]
    df = frame(spark, data)
    model = language_id.fit(df, steps=60)
    got = language_id.identify(clashing(df), model).collect()
    truth = {i: lang for i, _, lang, *_ in data}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    odd = language_id.identify(clashing(frame(spark, awkward())), model).collect()
    assert len(odd) == len(awkward())
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {1, 2, 3, 7} and all(r.score == 0 for r in odd if r.lang_pred == "und") and all(0 <= r.score <= 1 for r in odd)
    assert language_id.identify(frame(spark, []), model).count() == 0


def test_every_position_counts():
    model = language_id.train([b"abab" * 100, b"cdcd" * 100], [0, 1], ["ab", "cd"], steps=30)
    early, late = b"ab" * 300 + b"cd" * 20, b"ab" * 20 + b"cd" * 300
    p = language_id.pooled(model, [early, late])
    assert p[0].argmax() == 0 and p[1].argmax() == 1
    whole = language_id.pooled(model, [b"ab" * 480])[0]
    assert np.allclose(whole, language_id.pooled(model, [b"ab" * 480, b"c"])[0], atol=1e-5)


def read_by_hand(model, text):
    """Mean probabilities of a text, from the definition of the units, one window and one position at a time."""
    step, sums = language_id.WINDOW - 2 * language_id.CONTEXT, np.zeros(len(model.langs))
    n = max(1, -(-(len(text) - 2 * language_id.CONTEXT) // step))
    sig = lambda x: 1 / (1 + np.exp(-x))

    def run(bytes_, table, u):
        h, out, k = np.zeros(len(u)), [], len(u)
        for b in bytes_:
            x = table[b]
            z, r = sig(x[:k] + h @ u[:, :k]), sig(x[k : 2 * k] + h @ u[:, k : 2 * k])
            c = np.tanh(x[2 * k :] + (r * h) @ u[:, 2 * k :])
            h = (1 - z) * h + z * c
            out.append(h)
        return out

    pooled = 0
    for k in range(n):
        window = text[k * step : k * step + language_id.WINDOW].ljust(language_id.WINDOW, b"\0")
        forth, back = run(window, *model.forth), run(window[::-1], *model.back)[::-1]
        first, last = (0 if k == 0 else language_id.CONTEXT), (len(text) - k * step if k == n - 1 else language_id.WINDOW - language_id.CONTEXT)
        for t in range(first, last):
            e = np.exp(np.concatenate([forth[t], back[t]]) @ model.out + model.bias)
            sums += e / e.sum()
            pooled += 1
    assert pooled == len(text)
    return sums / len(text)


def test_pooling_equals_a_plain_forward_pass(monkeypatch):
    monkeypatch.setattr(language_id, "ROWS", 3)
    model = language_id.train([b"abab" * 100, b"cdcd" * 100, b"aabb" * 90], [0, 1, 2], ["ab", "cd", "abb"], steps=20)
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (1, 31, 33, 191, 192, 193, 352, 353, 900)]
    got = language_id.pooled(model, texts)
    for text, p in zip(texts, got, strict=True):
        assert np.allclose(p, read_by_hand(model, text), atol=1e-4), len(text)


def test_the_sample_is_bounded_whatever_the_ids(spark):
    one_id = frame(spark, [(7, f"some text number {i} " * 30, "en", "s", 0) for i in range(3000)])
    copies = frame(spark, [(7, "one text that is there again and again " * 9, "de", "s", 0)] * 3000)
    got = language_id.sample(one_id.union(copies), 50)
    counts = {lang: sum(x == lang for x, _ in got) for lang in ("en", "de")}
    assert 8 <= counts["en"] <= 50 * 8 and counts["de"] <= 8
    assert sorted(got) == sorted(language_id.sample(copies.union(one_id).repartition(5), 50))


def test_every_language_is_learned(spark):
    docs = frame(spark, [(i, f"word{i % 90} " * 20, f"l{i % 90}", "s", 0) for i in range(900)])
    model = language_id.fit(docs, steps=1)
    assert len(model.langs) == 90 and model.out.shape == (2 * 64, 90)


def test_thousands_of_labels_take_bounded_memory():
    """A step's memory is in proportion to the labels."""
    import tracemalloc

    texts = [f"label {i} has words of its own, {i * 7919} and {i * 31}".encode() for i in range(2000)]
    tracemalloc.start()
    model = language_id.train(texts, list(range(2000)), [f"l{i:04}" for i in range(2000)], steps=2)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 500e6 and len(model.langs) == 2000
