"""Audio columns: lossless media rows and log-mel features as fixed-shape tensors.

A payload of 8-bit samples is stored as a mono WAV row. From the stored bytes the
features are: polyphase resampling by a ratio (a windowed-sinc low pass split into phases),
overlapped Hann frames, log-mel filterbank energies, and hysteresis segmentation of the
frame energy into spans with start and end times. Each span carries its mel frames
pooled into a tensor of fixed shape (POOLED, MELS), stored as an Arrow stream of that
tensor type with the times, and read back from there.

Shape at scale. Every row is its own work: no shuffle but the write of the media table.
Samples are resampled and framed in stretches, so a long one is never expanded as a whole.

Edge cases. A null or empty text is 64 zero bytes. The bytes are padded with zeros to a
positive multiple of 64. A constant signal has one span or none. Repeated rows give equal
values; a null doc_id is kept; extra columns are ignored; an empty table is empty.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import batches_of, lean, materialize

RATE, TAPS = 16_000, 32
FRAME, HOP, MELS, POOLED = 256, 128, 32, 8
#: Hysteresis in standard deviations about the mean energy, and frames a span needs.
RISE, FALL, LEAST = 0.5, -0.25, 3
STRETCH = 1 << 15


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM file of the samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def wav_samples(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of such a file, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            rate = int.from_bytes(media[at + 12 : at + 16], "little")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


@functools.lru_cache(maxsize=8)
def low_pass(up: int, down: int) -> np.ndarray:
    """A windowed sinc below the lower of the two Nyquist rates, at `up` times the rate."""
    wide = max(up, down)
    t = np.arange(TAPS * wide) - (TAPS * wide - 1) / 2
    taps = np.sinc(t / wide) * np.hamming(TAPS * wide)
    return taps * up / taps.sum()


def resample(samples: np.ndarray, up: int = 1, down: int = 2) -> np.ndarray:
    """up / down times the rate, by a polyphase filter.

    An output of phase r is a sum over `down` phases of the input, each a convolution
    with every (up * down)-th tap; nothing is computed that is thrown away.
    """
    taps = low_pass(up, down)
    size = -(-len(samples) * up // down)
    pad = len(taps) // up + down + 1
    late = len(taps) // 2 // up
    x = np.concatenate([np.zeros(pad), samples, np.zeros(pad + late + down)])
    out = np.zeros(size)
    for r in range(min(up, size)):
        own = taps[r * down % up :: up]
        count = -(-(size - r) // up)
        for s in range(down):
            part = own[s::down]
            begin = pad + r * down // up + late - s - down * (len(part) - 1)
            if len(part):
                out[r::up] += np.convolve(x[begin::down][: count + len(part) - 1], part, "valid")
    return out


@functools.lru_cache(maxsize=8)
def mel_bank(rate: float) -> np.ndarray:
    """Triangular mel filters over the spectrum of a frame at `rate`."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, FRAME // 2 + 1)
    up = (bins[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T


def log_mel(payload: bytes, rate: int = RATE, up: int = 1, down: int = 2) -> np.ndarray:
    """(frames, MELS) log-mel energies of 8-bit samples; the last frame is filled with zeros.

    A long signal is resampled and framed by stretches, so memory holds one of them and
    the energies. All is done in double precision: equal signals give equal values.
    """
    samples = np.frombuffer(payload, np.uint8)
    total = -(-len(samples) * up // down)
    n = 1 + max(0, -(-(total - FRAME) // HOP))
    window, bank, out = np.hanning(FRAME), mel_bank(rate * up / down), []
    step = STRETCH // HOP
    for a in range(0, n, step):
        # Outputs [low, high) of the whole signal, from the inputs that they depend on.
        low, high = a * HOP, min(total, (min(n, a + step) - 1) * HOP + FRAME)
        first = max(0, low * down // up - 2 * TAPS * down) // (down * up) * (down * up)
        last = min(len(samples), high * down // up + 2 * TAPS * down)
        x = resample((samples[first:last] - 128.0) / 128, up, down)[low - first * up // down :][: high - low]
        x = np.pad(x, (0, (min(n, a + step) - 1) * HOP + FRAME - low - len(x)))
        spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * window)
        out.append(np.log((spectrum.real**2 + spectrum.imag**2) @ bank + 1e-6))
    return np.concatenate(out)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Spans that open above the upper and close below the lower threshold."""
    spread = float(energy.std())
    if spread < 1e-6:
        return []
    z = (energy - energy.mean()) / spread
    state = np.where(z > RISE, 1, np.where(z < FALL, -1, 0))
    marks = np.flatnonzero(state)
    if not len(marks):
        return []
    held = state[marks[np.maximum(0, np.searchsorted(marks, np.arange(len(z)), "right") - 1)]]
    held[: marks[0]] = -1
    edge = np.diff(np.concatenate([[-1], held, [-1]]))
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)) if b - a >= LEAST]


def pool(mel: np.ndarray) -> np.ndarray:
    """Any number of frames as (POOLED, MELS): means of equal stretches."""
    cuts = np.linspace(0, len(mel), POOLED + 1).astype(int)
    return np.stack([mel[min(a, len(mel) - 1) : max(b, min(a, len(mel) - 1) + 1)].mean(axis=0) for a, b in zip(cuts, cuts[1:])])


TENSOR = pa.fixed_shape_tensor(pa.float16(), [POOLED, MELS])
SPANS = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("mel", TENSOR)])


def pack_spans(times: np.ndarray, mels: np.ndarray) -> bytes:
    """An Arrow stream of spans: (n, 2) seconds and (n, POOLED, MELS) energies."""
    flat = pa.array(mels.astype(np.float16).ravel(), pa.float16())
    tensors = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat, POOLED * MELS))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, SPANS) as out:
        out.write_batch(pa.record_batch([pa.array(times[:, 0]), pa.array(times[:, 1]), tensors], schema=SPANS))
    return sink.getvalue().to_pybytes()


def unpack_spans(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The times and tensors of such a stream."""
    table = pa.ipc.open_stream(stored).read_all()
    if table.schema.field("mel").type != TENSOR:
        raise ValueError("the stored spans are not tensors of the fixed shape")
    times = np.stack([table["start_s"].to_numpy(), table["end_s"].to_numpy()], axis=1)
    return times, table["mel"].combine_chunks().to_numpy_ndarray()


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the whole texts' bytes as WAV rows in the shared folder."""

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows, "text", 4 << 20):
            raw = batch.column("text").fill_null("").cast(pa.binary()).to_pylist()
            media = [wav(b + bytes(-len(b) % 64 or (64 if not b else 0))) for b in raw]
            yield pa.record_batch([batch.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(text.mapInArrow(lean(write), "doc_id long, n_bytes long, media binary"), "media")


KEPT = [
    ("doc_id", pa.int64(), "long"), ("n_bytes", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"),
    ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("frames", pa.int64(), "long"), ("spans", pa.binary(), "binary"),
]


def features(media: DataFrame, up: int = 1, down: int = 2) -> DataFrame:
    """Features of stored media, as a table in the shared folder.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    frames, spans binary): spans is an Arrow stream of start_s, end_s and a fixed-shape
    tensor of POOLED x MELS. A signal without a span has one over its whole length.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, kind) for name, kind, _ in KEPT])
        for batch in batches_of(rows, "media", 1 << 20):
            out = []
            for doc, n, m in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                payload, rate = wav_samples(m)
                mel = log_mel(payload, rate, up, down)
                found = np.array(segments(mel.mean(axis=1)) or [(0, len(mel))])
                packed = pack_spans(found * (HOP * down / up / rate), np.stack([pool(mel[a:b]) for a, b in found.tolist()]))
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), len(mel), packed))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema)], schema=schema)

    return materialize(media.mapInArrow(lean(run), ", ".join(f"{name} {kind}" for name, _, kind in KEPT)), "features")


def read_features(stored: DataFrame) -> DataFrame:
    """Add `n_spans` and `feature`, a digest of the times and tensors that the bytes hold."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            count, digest = [], []
            for frames, raw in zip(batch.column("frames").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                times, mels = unpack_spans(raw)
                count.append(len(times))
                digest.append(f"{frames}:{len(times)}:{hashlib.sha256(times.tobytes() + mels.tobytes()).hexdigest()}")
            yield pa.record_batch([*batch.columns, pa.array(count, pa.int64()), pa.array(digest, pa.string())], names=[*batch.schema.names, "n_spans", "feature"])

    return stored.mapInArrow(lean(run), ", ".join(f"{name} {kind}" for name, _, kind in KEPT) + ", n_spans long, feature string")
