"""Audio columns: WAV storage and features.

A payload is stored as 8-bit mono WAV samples. Features are read from the stored bytes: polyphase resampling by L/M with
integer taps (exact sums, so the same bytes give the same samples everywhere), overlapped frames under a Hann window, log
energies of a mel filterbank, and segments of loud frames found with two thresholds (hysteresis): on above the upper one,
off below the lower. Log-mel frames are stored in Arrow files as fixed-shape tensors with their time spans.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import open_new, open_old
from .scratch import Scratch, small_batches

RATE, UP, DOWN, TAPS = 8000, 5, 8, 16  # 8000 to 5000 samples a second, 16 taps a phase
FRAME, HOP, BANDS, SHAPE = 256, 128, 16, (16, 16)  # frames half overlapped; a tensor has 16 frames of 16 bands
ABOVE, BELOW = 1.5, -1.5  # dB from the median frame energy
UNIT, BLOCK_FRAMES, FLOOR = 64, 4096, 1e-10


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM in a RIFF container; an odd length gets RIFF's pad byte."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def wav_samples(data: bytes) -> tuple[int, memoryview]:
    """Rate and samples of what wav() wrote, found by walking the chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            return rate, memoryview(data)[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


def phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Taps of the low-pass filter by phase, as whole numbers that sum to about 2**14 in each phase."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hanning(n + 2)[1:-1]
    h = h / h.sum() * up
    return np.rint(h.reshape(taps, up).T * (1 << 14))


_PHASES = phases()


def resample(x: np.ndarray, first: int, n: int, up: int = UP, down: int = DOWN, table: np.ndarray = _PHASES) -> np.ndarray:
    """Output samples first to first+n-1 of the whole signal x (whole numbers, zeros outside), as float64.

    Output m is the sum over k of tap[m*down mod up][k] * x[m*down // up - k].
    """
    taps = table.shape[1]
    out = np.zeros(n)
    for r in range(min(up, n)):
        m = first + r
        phase, at = (m * down) % up, (m * down) // up
        count = len(range(r, n, up))
        lo, hi = at - taps + 1, at + (count - 1) * down + 1
        part = x[max(lo, 0) : max(0, min(hi, len(x)))].astype(np.float64)
        part = np.concatenate([np.zeros(max(0, -lo)), part, np.zeros(max(0, hi - max(lo, 0) - len(part)))])
        windows = np.lib.stride_tricks.as_strided(part, (count, taps), (part.strides[0] * down, part.strides[0]))
        out[r::up] = windows @ table[phase][::-1]
    return out


def mel_bank(rate: float, size: int = FRAME, bands: int = BANDS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, from the second bin to half the rate."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    low, high = mel(rate / size), mel(rate / 2)
    edges = [700 * (10 ** ((low + (high - low) * k / (bands + 1)) / 2595) - 1) for k in range(bands + 2)]
    f = np.arange(size // 2 + 1) * rate / size
    bank = np.zeros((size // 2 + 1, bands))
    for k in range(bands):
        a, b, c = edges[k : k + 3]
        bank[:, k] = np.maximum(0, np.minimum((f - a) / (b - a), (c - f) / (c - b)))
    return bank.astype(np.float32)


_BANK, _WINDOW = mel_bank(RATE * UP / DOWN), np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and frame energies in dB of unsigned 8-bit samples, block after block of frames."""
    x = samples.astype(np.int16) - 128
    n = -(-len(x) * UP // DOWN)
    frames = max(1, -(-(n - FRAME) // HOP) + 1) if n > FRAME else 1
    mels, energies = [], []
    for a in range(0, frames, BLOCK_FRAMES):
        b = min(frames, a + BLOCK_FRAMES)
        y = (resample(x, a * HOP, (b - a - 1) * HOP + FRAME) / (1 << 21)).astype(np.float32)
        rows = np.lib.stride_tricks.as_strided(y, (b - a, FRAME), (y.strides[0] * HOP, y.strides[0]))
        spectrum = np.fft.rfft(rows * _WINDOW)
        power = spectrum.real**2 + spectrum.imag**2
        mel = power.astype(np.float32) @ _BANK
        mels.append(10 * np.log10(mel + FLOOR))
        energies.append(10 * np.log10(mel.sum(1) + FLOOR))
    return np.concatenate(mels).astype(np.float32), np.concatenate(energies)


def segments(energy: np.ndarray, above: float = ABOVE, below: float = BELOW) -> list[tuple[int, int]]:
    """Frame ranges that are on: from a frame above median+above to the next one below median+below."""
    mid = np.median(energy)
    mark = np.where(energy > mid + above, 1, np.where(energy < mid + below, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[last] > 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _ms(frame: int) -> int:
    return frame * HOP * 1000 * DOWN // (UP * RATE)


TENSOR = pa.fixed_shape_tensor(pa.float16(), SHAPE)
TENSOR_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_ms", pa.int64()), ("stop_ms", pa.int64()), ("loud", pa.float32()), ("log_mel", TENSOR)])


class TensorFile:
    """One Arrow file of log-mel tensors. add() returns the place of a document's first tensor."""

    def __init__(self, folder: str):
        self.uri, self.sink = open_new(folder, ".arrow")
        self.out = pa.ipc.new_file(self.sink, TENSOR_SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.rows, self.held = 0, []

    def add(self, doc_id, mel: np.ndarray, on: list[tuple[int, int]]) -> tuple[int, int, np.ndarray]:
        n = SHAPE[0]
        parts = -(-len(mel) // n)
        data = np.full((parts * n, SHAPE[1]), 10 * math.log10(FLOOR), np.float16)
        data[: len(mel)] = mel
        loud = np.zeros(parts * n, np.float32)
        for a, b in on:
            loud[a:b] = 1
        spans = [(_ms(k * n), _ms(min(len(mel), (k + 1) * n) - 1) + FRAME * 1000 * DOWN // (UP * RATE)) for k in range(parts)]
        first = self.rows
        self.rows += parts
        self.held.append((doc_id, spans, loud.reshape(parts, n).mean(1), data))
        if sum(len(x[1]) for x in self.held) >= 2048:
            self._flush()
        return first, parts, data

    def _flush(self) -> None:
        if self.held:
            data = np.concatenate([x[3] for x in self.held]).reshape(-1)
            sizes = [len(x[1]) for x in self.held]
            storage = pa.FixedSizeListArray.from_arrays(pa.array(data, pa.float16()), SHAPE[0] * SHAPE[1])
            columns = [
                pa.array([x[0] for x in self.held for _ in x[1]], pa.int64()), pa.array([k for n in sizes for k in range(n)], pa.int32()),
                *(pa.array([s[i] for x in self.held for s in x[1]], pa.int64()) for i in (0, 1)),
                pa.array(np.concatenate([x[2] for x in self.held])), pa.ExtensionArray.from_storage(TENSOR, storage),
            ]
            self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=TENSOR_SCHEMA))
            self.held = []

    def close(self) -> None:
        self._flush()
        self.out.close()
        self.sink.close()


def read_tensors(uri: str) -> pa.Table:
    """doc_id, part, start_ms, stop_ms, loud and log_mel (fixed-shape tensors) of one file."""
    with open_old(uri) as f:
        return pa.ipc.open_file(f).read_all()


def _store(unit: int):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [x or b"" for x in part.column(1).to_pylist()]
                media = [wav(t + b"\0" * (max(unit, -(-len(t) // unit) * unit) - len(t))) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return run


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """Write every text's UTF-8 bytes, padded with zeros to a positive multiple of unit, as WAV; returns the stored table.

    Columns doc_id, n_bytes (before padding), media. Null text: empty, that is one unit of zeros. Every row is stored,
    repeated rows as often as they occur; extra columns are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    s = Scratch(docs.sparkSession, "media")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("bytes"))
    return s.cut(d.mapInArrow(_store(unit), "doc_id long, n_bytes long, media binary"), "audio", "zstd")


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, loud array<struct<start_ms:long,stop_ms:long>>, tensors string, first_tensor long, n_tensors int"


def _features(folder: str):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("start_ms", pa.int64()), ("stop_ms", pa.int64())])), pa.string(), pa.int64(), pa.int32()]
    names = [x.split()[0] for x in _OUT.replace("array<struct<start_ms:long,stop_ms:long>>", "x").split(", ")]

    def run(batches):
        out = None
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                doc_id, n_bytes, media = (batch.column(k)[i].as_py() for k in range(3))
                _, payload = wav_samples(media)
                mel, energy = log_mel(np.frombuffer(payload, np.uint8))
                on = segments(energy)
                out = out or TensorFile(folder)
                first, parts, data = out.add(doc_id, mel, on)
                bands = np.rint(10 * mel.astype(np.float64).mean(0)).astype(np.int64).tolist()
                feature = f"{len(mel)}:{len(on)}:{sum(b - a for a, b in on)}:{zlib.crc32(data.tobytes()):08x}:{','.join(map(str, bands))}"
                spans = [{"start_ms": _ms(a), "stop_ms": _ms(b)} for a, b in on]
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(mel), spans, out.uri, first, parts))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if out:
            out.close()

    return run


def audio_features(stored: DataFrame) -> DataFrame:
    """One row per row of store_audio's table, from the bytes read back: lengths and digests, feature (frames, loud
    segments, loud frames, checksum of the tensors, mean tenths of dB by band), loud spans, and where its tensors are.

    The rows are written once and read back: a tensor file counts only if a committed row names it. Null ids stay null;
    repeated rows are repeated; an empty table gives no rows."""
    s = Scratch(stored.sparkSession, "tensors")
    return s.cut(stored.select("doc_id", "n_bytes", "media").mapInArrow(_features(s.at("files")), _OUT), "features", "zstd")
