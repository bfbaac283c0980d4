"""Media columns: audio stored losslessly, and features of what is read back.

encode() stores bytes as 8-bit samples of a mono WAV file. features() reads stored files back and computes, for each:

* a polyphase resampling from RATE to RATE * UP / DOWN with a windowed-sinc filter;
* log-mel energies of overlapped Hann frames (WIN samples, HOP apart), in chunks of CHUNK frames, each a tensor of the
  fixed shape (CHUNK, MELS) with the time span that it covers; a last chunk is padded with FLOOR and says how many
  of its frames are valid;
* segments by hysteresis on frame energy: one opens at half a deviation above the mean and lasts until energy falls
  below half a deviation under it; stored as time spans.

A file's chunks are stored as an Arrow IPC stream in a binary column: rows of t_start, t_end, frames and tensor, of Arrow's
fixed-shape tensor type (Spark's own columns have no such type). tensors() reads it, and the summary columns are computed from
what it reads. Each file is processed alone, so equal files have equal features on any executor.

Defined results: null and empty text is 64 bytes of silence; every file has at least one frame; repeated rows give
equal rows; an empty table gives an empty one. Only doc_id and text (encode) and media (features) are read; features()
keeps the columns it is given, and raises ValueError for bytes that are no 8-bit mono WAV file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD = 64
#: Files that are handed on together.
ROWS = 256
RATE, UP, DOWN = 8000, 3, 4
TAPS = 8
WIN, HOP, MELS, CHUNK = 256, 128, 32, 32
FLOOR = -10.0
ENCODED = "doc_id long, n_bytes long, media binary"
SPANS = "array<struct<t_start:double,t_end:double>>"
FEATURES = f"payload_bytes long, payload_sha256 string, tail_crc32 long, frames long, mel_mean array<float>, tensors binary, spans {SPANS}"
TENSOR = pa.fixed_shape_tensor(pa.float32(), (CHUNK, MELS))
STORED = pa.schema([("t_start", pa.float64()), ("t_end", pa.float64()), ("frames", pa.int32()), ("tensor", TENSOR)])


def wav(samples: bytes) -> bytes:
    data = b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return b"RIFF" + struct.pack("<I", 4 + len(fmt) + len(data)) + b"WAVE" + fmt + data


def samples_of(media: bytes) -> bytes:
    """The data chunk of a WAV file of 8-bit mono samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, good = 12, False
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, channels, _, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            good = (tag, channels, bits) == (1, 1, 8)
        elif kind == b"data":
            if not good or at + 8 + size > len(media):
                break
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("not an 8-bit mono WAV file")


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and those with zeros up to a positive multiple of PAD."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b"\0")


def low_pass() -> np.ndarray:
    """Taps by phase: phases x TAPS, reversed for a dot product with a window that ends at the sample."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = UP * cut * np.sinc(cut * t) * np.hamming(n)
    return np.array([h[p::UP][::-1] for p in range(UP)], np.float32)


def mel_bank() -> np.ndarray:
    """Triangles of even width in mel: bins x MELS."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(WIN // 2 + 1)[:, None] * rate / WIN
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def resample(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Output m lies at m * DOWN / UP samples: its phase picks the taps. Each phase is one strided product."""
    n = -(-len(x) * UP // DOWN)
    seen = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)]), TAPS)
    out = np.zeros(-(-n // UP) * UP, np.float32)
    for r in range(UP):
        part = seen[r * DOWN // UP :: DOWN][: len(out) // UP] @ taps[r * DOWN % UP]
        out[r::UP][: len(part)] = part
    return out[:n]


def log_mel(x: np.ndarray, bank: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Frames x MELS, in blocks, so that long files need bounded memory."""
    x = np.pad(x, (0, max(0, WIN - len(x)) + -max(0, len(x) - WIN) % HOP))
    frames = np.lib.stride_tricks.sliding_window_view(x, WIN)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    for at in range(0, len(frames), 1024):
        spectrum = np.fft.rfft(frames[at : at + 1024] * window)
        out[at : at + 1024] = np.log10((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank + np.float32(10**FLOOR))
    return out


def active(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs [from, to) of frames between opening at the high threshold and falling below the low one."""
    mid, half = energy.mean(), energy.std() / 2
    turn = np.where(energy >= mid + half, 1, np.where(energy < mid - half, -1, 0))
    last = np.maximum.accumulate(np.where(turn != 0, np.arange(len(turn)), -1))
    on = np.concatenate([[False], (last >= 0) & (turn[last] == 1), [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def stored(mel: np.ndarray, seconds: float) -> bytes:
    """The chunks of a file's frames as an Arrow IPC stream of STORED."""
    n, hop, width = len(mel), HOP * DOWN / UP / RATE, WIN * DOWN / UP / RATE
    starts = np.arange(0, n, CHUNK)
    frames = np.minimum(CHUNK, n - starts)
    whole = np.concatenate([mel, np.full((-n % CHUNK, MELS), FLOOR, np.float32)]).reshape(-1, CHUNK, MELS)
    columns = [pa.array(starts * hop), pa.array(np.minimum(seconds, (starts + frames - 1) * hop + width)), pa.array(frames, pa.int32()), pa.FixedShapeTensorArray.from_numpy_ndarray(whole)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STORED) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=STORED))
    return sink.getvalue().to_pybytes()


def tensors(ipc: bytes) -> pa.Table:
    """What stored() wrote: t_start, t_end, frames, tensor."""
    return pa.ipc.open_stream(ipc).read_all()


def mel_of(table: pa.Table) -> np.ndarray:
    """Frames x MELS of a file's chunks, without padding."""
    whole = table["tensor"].combine_chunks().to_numpy_ndarray().reshape(-1, MELS)
    return whole[: sum(table["frames"].to_pylist())]


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media; one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            got = [payload(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([wav(p) for _, p in got], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def features(files: DataFrame) -> DataFrame:
    """The columns of files, and those of FEATURES, of its column media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taps, bank, window = low_pass(), mel_bank(), np.hanning(WIN).astype(np.float32)
        hop, width = HOP * DOWN / UP / RATE, WIN * DOWN / UP / RATE
        kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "frames": pa.int64(), "mel_mean": pa.list_(pa.float32()), "tensors": pa.binary()}
        span = pa.list_(pa.struct([("t_start", pa.float64()), ("t_end", pa.float64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                made, spans = [], []
                for media in batch.column("media"):
                    raw = samples_of(media.as_py())
                    x = (np.frombuffer(raw, np.uint8).astype(np.float32) - np.float32(128)) / np.float32(128)
                    seconds = len(raw) / RATE
                    ipc = stored(log_mel(resample(x, taps), bank, window), seconds)
                    m = mel_of(tensors(ipc))
                    made.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-PAD:]), len(m), m.mean(0), ipc))
                    spans.append([{"t_start": a * hop, "t_end": min(seconds, (b - 1) * hop + width)} for a, b in active(m.mean(1))])
                if made:
                    new = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *new, pa.array(spans, span)], [*batch.schema.names, *kinds, "spans"])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{given}, {FEATURES}")


def digest() -> Column:
    """A string of the features: frames, segments, active time, and each band's mean in hundredths."""
    active_ms = F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["t_end"] - s["t_start"]) * 1000
    mel = F.array_join(F.transform("mel_mean", lambda x: F.round(x * 100).cast("int").cast("string")), ",")
    return F.concat(F.lit("frames="), "frames", F.lit(";segments="), F.size("spans"), F.lit(";active_ms="), F.round(active_ms).cast("long"), F.lit(";mel="), mel)
