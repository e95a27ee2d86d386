"""Telephone codecs, the resampler and the stored columns against plain versions."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexstrata.llm import telephony as tel


def plain_ima(block):
    value, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step, size = tel.STEPS[index], 0
            size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - size if code & 8 else value + size))
            index = max(0, min(88, index + tel.CHANGES[code & 7]))
            out.append(value)
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=12, max_size=12), min_size=1, max_size=6))
def test_blocks_decode_together(blocks):
    raw = np.frombuffer(b"".join(blocks), np.uint8).reshape(len(blocks), 12)
    assert tel.ima_samples(raw).tolist() == [plain_ima(b) for b in blocks]


def test_expansion_tables():
    mu, a = tel.TABLES[tel.MULAW], tel.TABLES[tel.ALAW]
    # the ends and the least steps that the telephone standard gives, at 16 bits
    assert [mu[i] for i in (0x00, 0x80, 0x7F, 0xFF, 0x7E, 0xFE)] == [-32124, 32124, 0, 0, -8, 8]
    assert [a[i] for i in (0xD5, 0x55, 0xAA, 0x2A, 0xD4)] == [8, -8, 32256, -32256, 24]
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def plain_resampled(x, rate, to):
    r = tel.Resampler(rate, to)
    n, half = -(-len(x) * r.up // r.down), r.half
    out = []
    for m in range(n):
        base, phase = divmod(m * r.down, r.up)
        total = sum(int(w) * int(x[i]) for w, i in zip(r.taps[phase], range(base - half + 1, base + half + 1), strict=True) if 0 <= i < len(x))
        out.append(max(-32768, min(32767, (total + (1 << 14)) >> 15)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-32768, 32767), max_size=120), st.sampled_from([(8000, 1000), (8000, 16000), (8000, 11025), (44100, 8000), (3, 2)]), st.integers(1, 50))
def test_resampled_in_pieces(samples, rates, cut):
    x = np.array(samples, np.int16)
    want = plain_resampled(samples, *rates)
    assert np.frombuffer(tel.resampled(iter([x]), *rates), "<i2").tolist() == want
    parts = [x[i : i + cut] for i in range(0, len(x), cut)]
    assert np.frombuffer(tel.resampled(iter(parts), *rates), "<i2").tolist() == want


def test_a_tone_keeps_its_pitch():
    t = np.arange(8000) / 8000
    tone = (10000 * np.sin(2 * np.pi * 200 * t) + 8000 * np.sin(2 * np.pi * 3000 * t)).astype(np.int16)
    y = np.frombuffer(tel.resampled(iter([tone]), 8000, 1000), "<i2").astype(float)
    spectrum = np.abs(np.fft.rfft(y))
    assert len(y) == 1000 and spectrum.argmax() == 200
    assert np.delete(spectrum, range(195, 206)).max() < 0.02 * spectrum[200]


def test_long_audio_goes_in_pieces(monkeypatch):
    body = np.random.default_rng(0).integers(0, 256, 580 * 40, dtype=np.uint8).tobytes()
    for codec, align, bits in ((tel.MULAW, 1, 8), (tel.ALAW, 1, 8), (tel.IMA, 580, 4)):
        media = tel.wave(codec, body, align, bits)
        whole = tel.pcm_of([media], 1000)
        with monkeypatch.context() as m:
            m.setattr(tel, "PIECE", 1000)
            m.setattr(tel, "BATCH_BYTES", 500)
            assert tel.pcm_of([media], 1000) == whole


def test_wave_files_of_others(spark):
    pcm = np.array([0, 1000, -1000, 32767], "<i2")
    stereo = struct.pack("<HHIIHH", 1, 2, 16000, 64000, 4, 16)
    two = b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + stereo + b"data" + struct.pack("<I", 8) + struct.pack("<4h", 100, 300, -5, -6)
    two = b"RIFF" + struct.pack("<I", len(two)) + two
    cut = tel.wave(tel.MULAW, b"abcd")[:-2]
    rows = [
        (1, tel.wave(tel.PCM, pcm.tobytes(), 2, 16, 16000)), (2, two), (3, None), (4, b""), (5, cut), (6, tel.wave(tel.MULAW, b"", rate=16000)),
        (7, two.replace(struct.pack("<HH", 1, 2), struct.pack("<HH", 3, 2), 1)), (8, tel.wave(tel.IMA, bytes(9), 12, 4, 16000)),
    ]
    frame = spark.createDataFrame(rows, "id long, media binary").withColumns({"pcm": F.lit("clash"), "x": F.lit(1)})
    out = {r.id: r for r in tel.decoded(frame, "media").collect()}
    assert np.frombuffer(out[1].pcm, "<i2").tolist() == pcm.tolist() and out[1].codec == "pcm" and out[1].x == 1
    assert np.frombuffer(out[2].pcm, "<i2").tolist() == [200, -6]
    assert (out[3].pcm, out[3].error) == (None, None)
    assert [out[i].pcm for i in (4, 5, 7)] == [None] * 3 and all(out[i].error for i in (4, 5, 7))
    assert out[6].pcm == b"" and len(out[8].pcm) == 2 * 11
    with pytest.raises(ValueError):
        tel.decoded(frame, "media", 0)


def plain_row(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    codec = zlib.crc32(payload) % 3
    if codec < 2:
        samples, kept = [int((tel.TABLES[tel.MULAW] if codec == 0 else tel.TABLES[tel.ALAW])[b]) for b in payload], payload
    else:
        kept = b"".join(bytes(4) + payload[i : i + 576] for i in range(0, len(payload), 576))
        samples = [v for i in range(0, len(kept), 580) for v in plain_ima(kept[i : i + 580])]
    x = plain_resampled(samples, 8000, 1000)
    level = int((sum(v * v for v in x) // len(x)) ** 0.5)
    while level * level > sum(v * v for v in x) // len(x):
        level -= 1
    feature = (f"{('mulaw', 'alaw', 'ima')[codec]};samples={len(x)};peak={max(map(abs, x))};rms={level}"
               f";changes={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))};pcm={zlib.crc32(struct.pack(f'<{len(x)}h', *x)):08x}")  # fmt: skip
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), kept, feature


def test_documents_round_trip(spark):
    texts = [None, "", "short", "é" * 288, "x" * 576, "word " * 700, "中" * 1000, "short", "\x00\x01"] + [f"text {i}" for i in range(9)]
    frame = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string").repartition(3)
    out = sorted(tel.digest(tel.documents_as_audio(frame)).collect(), key=lambda r: r.doc_id or 0)
    assert len({r.feature.split(";")[0] for r in out}) == 3
    for r, text in zip(out, texts, strict=True):
        n, size, sha, tail, kept, feature = plain_row(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (n, size, sha, tail, feature)
        assert r.media_bytes in (len(kept) + 58, len(kept) + 60) and len(r.media_sha256) == 64
    assert out[2][1:] == out[7][1:]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tel.digest(tel.documents_as_audio(none)).collect() == []
