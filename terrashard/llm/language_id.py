"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read a text's UTF-8 bytes, one forwards and one backwards; at every position both states feed
a softmax over the languages. A document's probabilities are the mean of its positions' over the whole text, and the
largest is the prediction. The network is trained in numpy by backpropagation through time, with the loss at every
position, on windows of a bounded sample of labelled documents.

A text is read in windows of WINDOW bytes that overlap, so long and short texts form batches of one shape and memory is
bounded. Both units start each window from a zero state, CONTEXT bytes before the first and after the last position that
is pooled there (none at the text's ends), so that each pooled position has read what stands around it. Every
position is pooled once; the last window of a text is padded, and the padding isn't pooled.

The sample is bounded whatever the ids are: SAMPLE_DOCS distinct (doc_id, text) of each language at most, or
SAMPLE_TOTAL over all languages if that is less. Every non-null lang is learned, however rare; only of more than SAMPLE_TOTAL labels
the most frequent ones are.

Defined results: null text and text without a letter is `und` with score 0; repeated rows are predicted alike; an empty
table gives an empty one; training without labelled rows gives a model without languages, by which every text is `und`
with score 0. identify() reads only doc_id and text, and predicts from text alone; sample() reads doc_id, text and lang.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, settle

WINDOW, CONTEXT = 192, 16
#: Hidden units of each direction: two for each language, within these bounds.
HIDDEN, MOST_HIDDEN = 8, 64
#: The bounded sample that training sees, in the order of a hash.
SAMPLE_DOCS, SAMPLE_TOTAL = 400, 40_000
#: Windows of a training document at most; spread evenly over its text.
SAMPLE_WINDOWS = 8
#: Bytes of a training window.
TRAINED = 96
STEPS, BATCH, RATE, SEED = 300, 192, 0.02, 5
#: Windows that are read at once.
ROWS = 1024
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """Weights of one direction are (table: 256 x 3H input, u: H x 3H recurrent); gates in the order update, reset, candidate."""

    langs: list[str]
    forth: tuple[np.ndarray, np.ndarray]
    back: tuple[np.ndarray, np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def states(x: np.ndarray, table: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Hidden states, positions x H x windows, of x: positions x windows, bytes in reading order."""
    n, width = len(u), x.shape[1]
    half = np.where(np.arange(3 * n) < 2 * n, 0.5, 1).astype(np.float32)  # sigmoid(a) = (tanh(a / 2) + 1) / 2
    columns, weights = np.ascontiguousarray((table * half).T), np.ascontiguousarray((u * half).T)
    out, h = np.empty((len(x), n, width), np.float32), np.zeros((n, width), np.float32)
    a, g, c = (np.empty((k * n, width), np.float32) for k in (3, 2, 1))
    for t in range(len(x)):
        np.take(columns, x[t], axis=1, out=a, mode="clip")
        np.matmul(weights[: 2 * n], h, out=g)
        g += a[: 2 * n]
        np.tanh(g, out=g)
        g += np.float32(1)
        np.multiply(g[n:], h, out=out[t])
        np.matmul(weights[2 * n :], out[t], out=c)
        c *= np.float32(0.5)
        c += a[2 * n :]
        np.tanh(c, out=c)
        c -= h
        c *= g[:n]
        c *= np.float32(0.5)
        h = np.add(h, c, out=out[t])
    return out


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """Positions x languages x windows."""
    x = x.astype(np.intp)
    forth, back = states(x, *model.forth), states(x[::-1], *model.back)[::-1]
    n = forth.shape[1]
    logits = np.matmul(model.out[:n].T, forth)
    logits += np.matmul(model.out[n:].T, back)
    logits += model.bias[:, None]
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def windows(text: bytes) -> np.ndarray:
    """Rows of WINDOW bytes, each CONTEXT * 2 bytes into the one before; the last is padded with 0."""
    step = WINDOW - 2 * CONTEXT
    raw = np.frombuffer(text, np.uint8)
    n = max(1, -(-(len(raw) - 2 * CONTEXT) // step))
    raw = np.pad(raw, (0, (n - 1) * step + WINDOW - len(raw)))
    return np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[::step]


def pooled(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean probability of each language for each text (none may be empty). Texts are read in blocks of ROWS windows, or fewer if there are many languages."""
    cut = [windows(t) for t in texts]
    counts, length = np.array([len(c) for c in cut]), np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    rows = np.concatenate(cut)
    low = np.where(nth == 0, 0, CONTEXT)  # positions low to high of a window are pooled
    high = np.where(nth == counts[owner] - 1, length[owner] - nth * (WINDOW - 2 * CONTEXT), WINDOW - CONTEXT)
    place, total = np.arange(WINDOW)[:, None], np.zeros((len(texts), len(model.langs)))
    block = max(16, ROWS * HIDDEN // max(HIDDEN, len(model.langs)))
    for at in range(0, len(rows), block):
        part = slice(at, at + block)
        p = probabilities(model, np.ascontiguousarray(rows[part].T))
        p *= ((place >= low[part]) & (place < high[part]))[:, None]
        sums = p.sum(0)
        for k in range(len(model.langs)):
            total[:, k] += np.bincount(owner[part], sums[k], len(texts))
    return total / length[:, None]


def train(texts: list[bytes], labels: list[int], langs: list[str], hidden: int | None = None, steps: int = STEPS, seed: int = SEED) -> Model:
    """Backpropagation through time with Adam, over windows of the texts, each language drawn equally often."""
    rng = np.random.default_rng(seed)
    hidden = hidden or min(MOST_HIDDEN, max(HIDDEN, 2 * len(langs)))
    rows, target = [], []
    for text, label in zip(texts, labels, strict=True):
        n = max(1, min(SAMPLE_WINDOWS, len(text) // TRAINED))
        starts = np.linspace(0, max(0, len(text) - TRAINED), n).astype(int)
        rows += [np.frombuffer(text[s : s + TRAINED].ljust(TRAINED, b"\0"), np.uint8) for s in starts]
        target += [label] * n
    rows, target = np.array(rows), np.array(target)
    of = [np.flatnonzero(target == k) for k in range(len(langs))]
    n, k = hidden, len(langs)
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    w = {f"{d}{x}": draw(*s, scale=c) for d in "fb" for x, s, c in (("t", (256, 3 * n), 0.3), ("u", (n, 3 * n), n**-0.5))}
    w |= {"o": draw(2 * n, k, scale=(2 * n) ** -0.5), "c": np.zeros(k, np.float32)}
    m, v = ({x: np.zeros_like(a) for x, a in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        # With more languages than a batch holds, each step draws as many of them: its memory is in proportion to their number, not to its square.
        some = of if k <= BATCH else [of[i] for i in rng.choice(k, BATCH, replace=False)]
        pick = np.concatenate([rng.choice(i, -(-BATCH // len(some))) for i in some])
        x, y = rows[pick].T, target[pick]
        g = gradient(w, x, y, n)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        for name, a in g.items():
            a *= min(1.0, 1.0 / (norm + 1e-8))
            m[name] += np.float32(0.1) * (a - m[name])
            v[name] += np.float32(0.001) * (a * a - v[name])
            w[name] -= np.float32(rate) * (m[name] / np.float32(1 - 0.9**step)) / (np.sqrt(v[name] / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return Model(langs, (w["ft"], w["fu"]), (w["bt"], w["bu"]), w["o"], w["c"])


def gradient(w: dict, x: np.ndarray, y: np.ndarray, n: int) -> dict:
    """Gradient of the mean loss over positions and windows. x: positions x windows."""
    t_max, b = x.shape
    k = w["o"].shape[1]
    run = {"f": unroll(x, w["ft"], w["fu"]), "b": unroll(x[::-1], w["bt"], w["bu"])}
    h = np.concatenate([run["f"][0][1:], run["b"][0][1:][::-1]], 2)  # positions x windows x 2H
    logits = h @ w["o"] + w["c"]
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits, out=logits)
    p /= p.sum(2, keepdims=True)
    p[:, np.arange(b), y] -= 1
    p /= np.float32(t_max * b)
    g = {"o": h.reshape(-1, 2 * n).T @ p.reshape(-1, k), "c": p.sum((0, 1))}
    dh = p @ w["o"].T
    g["ft"], g["fu"] = through_time(x, w["fu"], run["f"], dh[:, :, :n])
    g["bt"], g["bu"] = through_time(x[::-1], w["bu"], run["b"], dh[::-1, :, n:])
    return g


def unroll(x: np.ndarray, table: np.ndarray, u: np.ndarray) -> tuple:
    t_max, b = x.shape
    n = len(u)
    h, z, r, c = (np.zeros((t_max + i, b, n), np.float32) for i in (1, 0, 0, 0))
    for t in range(t_max):
        a = table[x[t]]
        g = sigmoid(a[:, : 2 * n] + h[t] @ u[:, : 2 * n])
        z[t], r[t] = g[:, :n], g[:, n:]
        c[t] = np.tanh(a[:, 2 * n :] + (r[t] * h[t]) @ u[:, 2 * n :])
        h[t + 1] = h[t] + z[t] * (c[t] - h[t])
    return h, z, r, c


def through_time(x: np.ndarray, u: np.ndarray, run: tuple, dh_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, z, r, c = run
    n = len(u)
    da = np.empty((*x.shape, 3 * n), np.float32)
    du, back = np.zeros_like(u), np.zeros_like(h[0])
    for t in range(len(x) - 1, -1, -1):
        d = back + dh_out[t]
        dc = d * z[t] * (1 - c[t] ** 2)
        drh = dc @ u[:, 2 * n :].T
        dz = d * (c[t] - h[t]) * z[t] * (1 - z[t])
        dr = drh * h[t] * r[t] * (1 - r[t])
        da[t] = np.concatenate([dz, dr, dc], 1)
        du[:, : 2 * n] += h[t].T @ da[t][:, : 2 * n]
        du[:, 2 * n :] += (r[t] * h[t]).T @ dc
        back = d * (1 - z[t]) + drh * r[t] + da[t][:, : 2 * n] @ u[:, : 2 * n].T
    dt = np.zeros((256, 3 * n), np.float32)
    np.add.at(dt, x.reshape(-1), da.reshape(-1, 3 * n))
    return dt, du


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS) -> list:
    """(lang, window) of documents of each language that aren't held out, those of the smallest hashes of (doc_id, text).

    SAMPLE_WINDOWS windows at most, spread evenly over the whole text, reach the driver from each of at most per_lang
    documents of a language, so the sample is bounded for each language, however large the corpus and whatever its ids.
    """
    ok = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ok = ok.where(F.rlike("text", F.lit(r"\p{L}"))).withColumn("share", F.xxhash64("doc_id", "text", F.lit(SEED)) / F.lit(2.0**64) + 0.5)
    # Hashes of distinct rows are even, so those below twice the share that is wanted hold enough of each language.
    counts = settle(ok.groupBy("lang").agg(F.approx_count_distinct("share").alias("n")), "languages")
    n_langs = counts.count()
    per_lang = min(per_lang, max(1, SAMPLE_TOTAL // max(1, n_langs)))
    if n_langs > SAMPLE_TOTAL:
        counts = settle(counts.orderBy(F.desc("n"), "lang").limit(SAMPLE_TOTAL), "languages")
    limits = counts.select(F.col("lang").alias("of"), (2.0 * per_lang / F.col("n") + 40.0 / F.col("n")).alias("limit"))
    limits = F.broadcast(limits) if n_langs <= BROADCAST_ROWS else limits.hint("merge")
    length = F.length("text")
    n = F.greatest(F.lit(1), F.least(F.lit(SAMPLE_WINDOWS), F.floor(length / TRAINED))).cast("int")
    step = F.when(n > 1, (length - TRAINED) / (n - 1)).otherwise(F.lit(0.0))
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr("text", (F.floor(i * step) + 1).cast("int"), F.lit(TRAINED)))
    near = ok.join(limits, F.col("lang") == F.col("of")).where(F.col("share") <= F.col("limit")).select("lang", "share", spread.alias("windows"))
    near = near.groupBy("lang", "share").agg(F.max("windows").alias("windows"))  # copies of a row count once
    first = near.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("share"))).where(F.col("nth") <= per_lang)
    rows = sorted(first.collect(), key=lambda r: (r.lang, r.share))
    return [(r.lang, w.encode("utf-8", "surrogatepass")) for r in rows for w in r.windows]


def fit(docs: DataFrame, **how) -> Model:
    """A model of the labelled languages; without any if no row is labelled and not held out."""
    rows = sample(docs)
    if not rows:
        none = np.zeros((0, 0), np.float32)
        return Model([], (none, none), (none, none), none, np.zeros(0, np.float32))
    langs = sorted({r[0] for r in rows})
    return train([t for _, t in rows], [langs.index(lang) for lang, _ in rows], langs, **how)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            todo, size = [], 0
            for i, t in enumerate([*texts, None]):
                if model.langs and t is not None and LETTER.search(t):
                    todo.append(i)
                    size += len(t)
                if todo and (size > 2_000_000 or i == len(texts)):
                    p = pooled(model, [texts[j].encode("utf-8", "surrogatepass") for j in todo])
                    for j, row in zip(todo, p, strict=True):
                        lang[j], score[j] = model.langs[int(row.argmax())], round(float(min(1.0, row.max())), 6)
                    todo, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
