"""Telephone audio as media columns: mu-law, A-law and IMA ADPCM in WAVE files, and resampled PCM.

mu-law and A-law samples are expanded by tables of 256 entries.  ADPCM blocks
are independent, so a step of the decoder is taken in all blocks of a batch at
once with numpy.  PCM is resampled by a windowed sinc whose taps are integers of
Q bits: sums are exact in float64, so equal audio gives equal samples wherever
it is in a batch.  Long audio is decoded and resampled piece by piece.

``decoded`` reads a column of WAVE files of any writer (PCM of 8 or 16 bits,
A-law, mu-law, with channels averaged; IMA ADPCM of one channel) and gives 16-bit
little-endian PCM at the rate asked for.  ``documents_as_audio`` stores texts as
such files beside their resampled PCM: the bytes are mu-law or A-law samples or,
in blocks with a header of their own, 4-bit ADPCM codes; which of the three
depends on the bytes alone.  ``digest`` reads the stored bytes back.

Cases: a null or empty text is one unit of padding.  A null file, and one that
isn't such a WAVE file (``error`` says why), has null PCM; one without samples
has empty PCM.  A last block that is cut off is decoded as far as it goes.
Equal bytes have equal results, ids may be null or repeated, and other columns
stay (``decoded``) or are ignored.  A text is held whole with its file, so it
may have at most 2 GB less the file's head, the most that a value in Spark can.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.memory import tidy
from lexstrata.llm.shared import stored

RATE = 8000
UNIT = 576  # bytes: texts are padded to a multiple
PAD = 255
#: The stored PCM has the band in which a voice's pitch lies.
PITCH_RATE = 1000
BATCH_BYTES = 4 << 20  # of files decoded together
PIECE = 1 << 20  # samples of long audio at a time
ZEROS = 8  # of the sinc, on each side
Q = 15
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", IMA: "ima"}
#: Fixed values of IMA ADPCM: quantiser steps and index changes.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411,
    1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
CHANGES = [-1, -1, -1, -1, 2, 4, 6, 8]


class AudioError(ValueError):
    pass


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment == 0, low + 8, (low + 264) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """By index * 16 + code: the difference, and the next index * 16."""
    step, code = np.array(STEPS)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + (code >> 2 & 1) * step + (code >> 1 & 1) * (step >> 1) + (code & 1) * (step >> 2)
    after = np.clip(np.arange(len(STEPS))[:, None] + np.array(CHANGES * 2)[None, :], 0, len(STEPS) - 1) * 16
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), after.astype(np.int32).ravel()


TABLES = {MULAW: _mulaw_table(), ALAW: _alaw_table()}
IMA_DIFFERENCE, IMA_AFTER = _ima_tables()


def ima_samples(blocks: np.ndarray) -> np.ndarray:
    """Samples of ADPCM blocks of one size (a row each, uint8): all blocks take a step at once."""
    n, width = blocks.shape
    out = np.empty((width * 2 - 7, n), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    at = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    out[0] = value
    for k, column in enumerate(np.ascontiguousarray(blocks[:, 4:].T)):
        for half, code in enumerate((column & 15, column >> 4)):
            at += code
            value += IMA_DIFFERENCE[at]
            np.clip(value, -32768, 32767, out=value)
            at = IMA_AFTER[at]
            out[1 + 2 * k + half] = value
    return np.ascontiguousarray(out.T)


@dataclass(frozen=True)
class Wave:
    codec: int
    rate: int
    channels: int
    align: int
    bits: int
    data: memoryview


def wave(codec: int, data: bytes, align: int = 1, bits: int = 8, rate: int = RATE) -> bytes:
    """A WAVE file of one channel."""
    per_block = (align - 4) * 2 + 1
    extra = struct.pack("<HH", 2, per_block) if codec == IMA else b"" if codec == PCM else struct.pack("<H", 0)
    samples = -(-len(data) // align) * per_block if codec == IMA else len(data) // align
    speed = rate * align // per_block if codec == IMA else rate * align
    form = struct.pack("<HHIIHH", codec, 1, rate, speed, align, bits) + extra
    chunks = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(chunks)) + chunks


def parsed(media: bytes) -> Wave:
    """The format and data of a WAVE file, or AudioError."""
    view, at, form = memoryview(media), 12, None
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise AudioError("no WAVE file")
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        body = view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
        if name == b"fmt ":
            if len(body) < 16:
                raise AudioError("short format")
            codec, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", body)
            form = (codec, rate, channels, align, bits)
            whole = channels * bits // 8
            if codec not in NAMES or not rate or not channels or (align <= 4 or channels != 1 or bits != 4 if codec == IMA else bits not in ((8, 16) if codec == PCM else (8,)) or align != whole):
                raise AudioError(f"format {codec} of {channels} channels, {bits} bits isn't read")
        elif name == b"data":
            if form is None:
                raise AudioError("data before its format")
            if len(body) < size:
                raise AudioError("data is cut off")
            return Wave(*form, body)
    raise AudioError("no data")


def _ima_blocks(w: Wave) -> tuple[np.ndarray, np.ndarray]:
    """The whole blocks, and the last one if it is cut off."""
    raw = np.frombuffer(w.data, np.uint8)
    whole = len(raw) // w.align * w.align
    return raw[:whole].reshape(-1, w.align), raw[whole:]


def pieces(w: Wave) -> Iterator[np.ndarray]:
    """The samples in order, channels averaged, as int16 arrays of bounded size."""
    if w.codec == IMA:
        blocks, rest = _ima_blocks(w)
        step = max(1, PIECE // (2 * w.align))
        for i in range(0, len(blocks), step):
            yield ima_samples(blocks[i : i + step]).ravel()
        if len(rest) >= 4:
            yield ima_samples(rest[None, :]).ravel()
        return
    usable = len(w.data) // w.align * w.align
    for i in range(0, usable, PIECE * w.align):
        raw = w.data[i : min(i + PIECE * w.align, usable)]
        if w.codec != PCM:
            x = TABLES[w.codec][np.frombuffer(raw, np.uint8)]
        elif w.bits == 16:
            x = np.frombuffer(raw, "<i2")
        else:
            x = (np.frombuffer(raw, np.uint8).astype(np.int16) - 128) << 8
        yield x if w.channels == 1 else (x.reshape(-1, w.channels).astype(np.int64).sum(axis=1) // w.channels).astype(np.int16)


@lru_cache(maxsize=64)
def taps(up: int, down: int) -> np.ndarray:
    """For each phase, integer weights of 2 * half samples that add up to 2 ** Q."""
    cut = min(1.0, up / down)
    half = math.ceil(ZEROS / cut)
    offsets = np.arange(1 - half, half + 1)[None, :] - np.arange(up)[:, None] / up
    weights = np.sinc(offsets * cut) * np.cos(np.pi * np.clip(offsets / half, -1, 1) / 2) ** 2
    out = np.rint(weights / weights.sum(axis=1, keepdims=True) * (1 << Q))
    out[np.arange(up), half - 1] += (1 << Q) - out.sum(axis=1)
    return out


class Resampler:
    """From one rate to another, fed piece by piece."""

    def __init__(self, rate: int, to: int):
        g = math.gcd(rate, to)
        self.up, self.down = to // g, rate // g
        self.taps = taps(self.up, self.down)
        self.half = self.taps.shape[1] // 2
        self.buffer, self.origin = np.zeros(self.half - 1), 1 - self.half
        self.fed, self.next = 0, 0

    def feed(self, samples: np.ndarray) -> np.ndarray:
        self.buffer = np.concatenate([self.buffer, samples])
        self.fed += len(samples)
        return self._out(((self.origin + len(self.buffer) - self.half) * self.up - 1) // self.down + 1)

    def finish(self) -> np.ndarray:
        self.buffer = np.concatenate([self.buffer, np.zeros(self.half + 1)])
        return self._out(-(-self.fed * self.up // self.down))

    def _out(self, end: int) -> np.ndarray:
        count = max(0, end - self.next)
        out = np.empty(count)
        for r in range(min(self.up, count)):
            first = self.next + r
            start, phase = divmod(first * self.down, self.up)
            windows = np.lib.stride_tricks.sliding_window_view(self.buffer, 2 * self.half)[start - self.half + 1 - self.origin :: self.down]
            share = -(-(count - r) // self.up)
            out[r :: self.up] = windows[:share] @ self.taps[phase]
        self.next += count
        drop = self.next * self.down // self.up - self.half + 1 - self.origin
        if drop > 0:
            self.buffer, self.origin = self.buffer[drop:], self.origin + drop
        return np.clip(np.floor((out + (1 << (Q - 1))) / (1 << Q)), -32768, 32767).astype("<i2")


def resampled(parts: Iterator[np.ndarray], rate: int, to: int) -> bytes:
    """16-bit little-endian PCM at another rate."""
    if rate == to:
        return b"".join(p.astype("<i2").tobytes() for p in parts)
    r = Resampler(rate, to)
    return b"".join([*(r.feed(p).tobytes() for p in parts), r.finish().tobytes()])


def pcm_of(files: list[bytes | None], rate: int) -> tuple[list[bytes | None], list[str | None], list[str | None]]:
    """PCM, codec and error of each file; ADPCM blocks of one size are decoded together over files."""
    waves: list[Wave | None] = []
    errors: list[str | None] = []
    for f in files:
        try:
            waves.append(None if f is None else parsed(f))
            errors.append(None)
        except AudioError as e:
            waves.append(None)
            errors.append(str(e))
    alike: dict[int, list[int]] = {}
    for i, w in enumerate(waves):
        if w is not None and w.codec == IMA and len(w.data) % w.align == 0 and 0 < len(w.data) <= BATCH_BYTES:
            alike.setdefault(w.align, []).append(i)
    together: dict[int, np.ndarray] = {}
    for members in alike.values():
        blocks = [_ima_blocks(waves[i])[0] for i in members]
        samples, at = ima_samples(np.concatenate(blocks)), 0
        for i, b in zip(members, blocks, strict=True):
            together[i] = samples[at : at + len(b)].ravel()
            at += len(b)
    pcm = [None if w is None else resampled(iter([together[i]]) if i in together else pieces(w), w.rate, rate) for i, w in enumerate(waves)]
    return pcm, [None if w is None else NAMES[w.codec] for w in waves], errors


def slices(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one row."""
    start, size = 0, 0
    for i, value in enumerate(column):
        n = value.as_buffer().size if value.is_valid else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(column):
        yield start, len(column)


def decoded(rows: DataFrame, media: str, rate: int = 16000) -> DataFrame:
    """All columns, and ``pcm`` of the WAVE files of a binary column at this rate, their ``codec`` and ``error``.

    Write the result to store the PCM.  Columns named pcm, codec or error are replaced.
    """
    if rate < 1:
        raise ValueError("the rate must be positive")
    kept = [c for c in rows.columns if c.lower() not in ("pcm", "codec", "error")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(media)):
                part = batch.slice(a, b - a)
                pcm, codec, error = pcm_of(part.column(media).to_pylist(), rate)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pcm, pa.binary()), pa.array(codec, pa.string()), pa.array(error, pa.string())], [*part.schema.names, "pcm", "codec", "error"])

    return rows.select(*kept).mapInArrow(tidy(run), f"{kinds}, pcm binary, codec string, error string")


def payload_file(payload: bytes) -> bytes:
    """A WAVE file whose samples or codes are these bytes, a multiple of UNIT."""
    codec = (MULAW, ALAW, IMA)[zlib.crc32(payload) % 3]
    if codec != IMA:
        return wave(codec, payload)
    rows = np.zeros((len(payload) // UNIT, UNIT + 4), np.uint8)
    rows[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    return wave(IMA, rows.tobytes(), UNIT + 4, 4)


def file_payload(media: bytes) -> bytes:
    """The bytes that payload_file has stored."""
    w = parsed(media)
    return bytes(w.data) if w.codec != IMA else np.frombuffer(w.data, np.uint8).reshape(-1, UNIT + 4)[:, 4:].tobytes()


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % UNIT if text else UNIT)


def documents_as_audio(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rate: int = PITCH_RATE) -> DataFrame:
    """The stored table of id, n_bytes, media (a WAVE file) and its resampled pcm, codec and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                texts = [(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in part.column("text")]
                files = [payload_file(padded(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    files = source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, media binary")
    return stored(decoded(files, "media", rate), "audio").withColumnRenamed("id", id_column)


def feature(codec: str, pcm: bytes) -> str:
    """Whole numbers of the stored PCM: samples, peak, root mean square, sign changes and CRC-32."""
    x = np.frombuffer(pcm, "<i2").astype(np.int64)
    n = len(x)
    level = math.isqrt(int((x * x).sum()) // n) if n else 0
    changes = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"{codec};samples={n};peak={int(np.abs(x).max(initial=0))};rms={level};changes={changes};pcm={zlib.crc32(pcm):08x}"


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest_of(n_bytes: int, media: bytes, codec: str, pcm: bytes) -> tuple:
    payload = file_payload(media)
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(codec, pcm)


def digest(audio: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The digest of what ``documents_as_audio`` has stored, read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("media")):
                part = batch.slice(a, b - a)
                rows = [_digest_of(*r) for r in zip(*(part.column(c).to_pylist() for c in ("n_bytes", "media", "codec", "pcm")), strict=True)]
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(id_column), *columns], [id_column, *(c.split()[0] for c in DIGEST.split(", "))])

    kind = audio.schema[id_column].dataType.simpleString()
    make: Callable = tidy(run)
    return audio.select(id_column, "n_bytes", "media", "codec", "pcm").mapInArrow(make, f"`{id_column}` {kind}, {DIGEST}")
