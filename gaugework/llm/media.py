"""Telephony audio columns: mu-law, A-law and IMA ADPCM payloads expanded with numpy and stored as resampled PCM.

Every function works on one Arrow batch at a time: payloads of a batch are laid end to end, expanded by one table lookup
(mu-law, A-law) or one pass of ``samples per block`` vector steps across all its blocks (ADPCM). Null payloads decode
as empty; an unknown or null codec raises.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import split_batches

UNIT = 64
RATE, TARGET_RATE, STORED_RATE = 8000, 16000, 4000
#: WAVE format tags.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 0x11}


def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law code."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) * 8 + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law code."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    step, low = (code >> 4) & 7, (code & 15) * 16
    size = np.where(step == 0, low + 8, (low + 264) << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


# Fixed values of IMA ADPCM: quantiser steps by index, and the change of the index by the code's size bits.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], dtype=np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)

MULAW, ALAW = mulaw_table(), alaw_table()
#: Signed difference for each (index, code), and the index that follows, so that a step is two lookups.
_CODE = np.arange(16, dtype=np.int32)
_SIZE = (STEPS[:, None] >> 3) + np.where(_CODE & 4, STEPS[:, None], 0) + np.where(_CODE & 2, STEPS[:, None] >> 1, 0) + np.where(_CODE & 1, STEPS[:, None] >> 2, 0)
CHANGE = np.where(_CODE & 8, -_SIZE, _SIZE).astype(np.int32).ravel()
FOLLOWS = np.clip(np.arange(len(STEPS))[:, None] + INDEX_CHANGE[_CODE & 7], 0, len(STEPS) - 1).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM blocks (one a row, each with its 4-byte header) to samples, one row a block."""
    if not len(blocks):
        return np.empty((0, 1 + 2 * max(0, blocks.shape[1] - 4)), dtype=np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(data), len(blocks)), dtype=np.int16)
    out[0] = value
    for k, column in enumerate(data):
        for half, code in enumerate((column & 15, column >> 4)):
            at = index * 16 + code
            value = np.clip(value + CHANGE[at], -32768, 32767)
            index = FOLLOWS[at]
            out[1 + 2 * k + half] = value
    return out.T


def low_pass_weights(up: int, down: int) -> np.ndarray:
    """Whole-number weights of a low-pass filter for ``up`` samples in place of ``down`` > ``up``, one row a phase: a Hann-windowed sinc over three of its
    zeros on either side; each row sums to 2 ** 14."""
    half = -(-3 * down // up)
    phase = (np.arange(up) * down % up / up)[:, None]
    at = (np.arange(-half, half + 1) - phase) * up / down
    shape = np.sinc(at) * np.where(np.abs(at) < 3, np.cos(np.pi * at / 6) ** 2, 0)
    weights = np.round(shape / shape.sum(1, keepdims=True) * (1 << 14)).astype(np.int64)
    weights[:, half] += (1 << 14) - weights.sum(1)
    return weights


def resample(samples: np.ndarray, rate: int, target: int, filtered: bool = True) -> np.ndarray:
    """Samples at another rate, in whole numbers; the first and last sample are held. Same rate: the samples themselves.

    A higher rate interpolates linearly. A lower one passes a low-pass filter, in which every sample weighs; without ``filtered`` it interpolates too, and so picks
    samples and leaves out others.
    """
    if rate == target or not len(samples):
        return samples.astype(np.int16)
    if filtered and target < rate:
        common = math.gcd(rate, target)
        up, down = target // common, rate // common
        weights = low_pass_weights(up, down)
        half = weights.shape[1] // 2
        held = np.pad(samples.astype(np.int64), half, mode="edge")
        out = np.empty(len(samples) * target // rate, dtype=np.int64)
        for phase, row in enumerate(weights):
            first = phase * down // up
            count = len(out[phase::up])
            total = np.full(count, 1 << 13, dtype=np.int64)
            for k in np.flatnonzero(row).tolist():
                total += held[first + k :: down][:count] * row[k]
            out[phase::up] = total >> 14
        return np.clip(out, -32768, 32767).astype(np.int16)
    at = np.arange(len(samples) * target // rate, dtype=np.int64) * rate
    low, part = at // target, at % target
    left = samples.astype(np.int64)
    right = left[np.minimum(low + 1, len(left) - 1)]
    return (left[low] + (right - left[low]) * part // target).astype(np.int16)


def wave_file(payload: bytes, codec: str = "mulaw", rate: int = RATE, block: int = UNIT) -> bytes:
    """A WAVE file with the payload as its samples, byte for byte."""
    if codec == "ima_adpcm":
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * block // (2 * block - 7), block, 4, 2, 2 * block - 7)
    else:
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
    size = len(payload) if codec != "ima_adpcm" else len(payload) // block * (2 * block - 7)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, size) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(stored: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and payload of a WAVE file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        body = stored[at + 8 : at + 8 + size]
        if len(body) != size:
            raise ValueError("a chunk ends early")
        form, data = (body if name == b"fmt " else form), (body if name == b"data" else data)
        at += 8 + size + (size & 1)
    if form is None or data is None:
        raise ValueError("no fmt or data chunk")
    tag, _, rate, _, block = struct.unpack_from("<HHIIH", form)
    return {v: k for k, v in TAGS.items()}[tag], rate, block, data


def expand(payload: bytes, codec: str, block: int = UNIT) -> np.ndarray:
    """Samples of a payload; ADPCM payloads count up to their last whole block."""
    raw = np.frombuffer(payload, dtype=np.uint8)
    if codec == "ima_adpcm":
        return decode_adpcm(raw[: len(raw) // block * block].reshape(-1, block)).ravel()
    return {"mulaw": MULAW, "alaw": ALAW}[codec][raw]


def decode_audio(df: DataFrame, key: str = "doc_id", stored: str = "media", target_rate: int = TARGET_RATE) -> DataFrame:
    """(key, codec, rate, n_samples, pcm): WAVE files of any of the three codecs as little-endian 16-bit PCM at ``target_rate``.

    A null file gives null codec, rate and pcm and 0 samples; a broken file raises. Keys may repeat; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in split_batches([b], stored)):
            rows = []
            for x in batch.column(stored).to_pylist():
                if x is None:
                    rows.append((None, None, 0, None))
                    continue
                codec, rate, block, payload = read_wave(x)
                pcm = resample(expand(payload, codec, block), rate, target_rate)
                rows.append((codec, target_rate, len(pcm), pcm.astype("<i2").tobytes()))
            codec, rate, n, pcm = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(codec, pa.string()), pa.array(rate, pa.int32()), pa.array(n, pa.int64()), pa.array(pcm, pa.binary())], names=[key, "codec", "rate", "n_samples", "pcm"])

    return df.select(key, stored).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, codec string, rate int, n_samples long, pcm binary")


def _per_text(total: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(total, starts) if len(starts) else np.zeros(0, dtype=total.dtype)


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text", unit: int = UNIT) -> DataFrame:
    """(key, n_bytes, media): every text's UTF-8 bytes, filled with 0 to a positive multiple of ``unit``, as the mu-law samples of an 8 kHz WAVE file.

    A null text counts as empty. Keys may be null or repeat; other columns are dropped; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in split_batches([b], text)):
            texts = [(x or "").encode("utf-8") for x in batch.column(text).to_pylist()]
            files = [wave_file(x + b"\0" * (-len(x) % unit if x else unit)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(x) for x in texts], pa.int64()), pa.array(files, pa.binary())], names=[key, "n_bytes", "media"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def _energy_and_turns(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean energy and number of sign changes of each array of samples, none of them empty."""
    length = np.array([len(x) for x in parts], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    sound = np.concatenate(parts).astype(np.int64)
    change = np.append((sound[1:] < 0) != (sound[:-1] < 0), False)
    change[begin + length - 1] = False
    return _per_text(sound**2, begin) / length, _per_text(change.astype(np.int64), begin)


def features(stored: DataFrame, key: str = "doc_id", unit: int = UNIT, target_rate: int = STORED_RATE, filtered: bool = False) -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm) of ``store_texts`` rows, from the files' bytes.

    ``pcm``: the file expanded by its codec's table and resampled to ``target_rate``, little-endian 16-bit. ``feature``: mean energy and sign
    changes of that, mean energy of the payload's A-law expansion, and the sum of absolute samples of the payload decoded as ADPCM blocks. Equal
    files have equal values. With ``filtered`` a lower rate passes the low-pass filter of ``resample``, and ``feature`` has energy and sign changes of all samples at the
    file's own rate, A-law and ADPCM as above, then energy and sign changes of ``pcm``, so that every sample counts in it; without, both know the picked samples only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in split_batches([b], "media")):
            files = batch.column("media").to_pylist()
            read = [read_wave(x) for x in files]
            payloads = [r[3] for r in read]
            sizes = np.array([len(x) for x in payloads], dtype=np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            sound = [expand(payload, codec, block) for codec, _, block, payload in read]
            pcm = [resample(x, r[1], target_rate, filtered) for x, r in zip(sound, read)]
            raw = np.frombuffer(b"".join(payloads), dtype=np.uint8)
            other = _per_text(ALAW[raw].astype(np.int64) ** 2, starts) / sizes
            steps = _per_text(np.abs(decode_adpcm(raw.reshape(-1, unit)).astype(np.int64)).sum(1), starts // unit)
            found = [f"mulaw={e:.3f};turns={t};alaw={o:.3f};adpcm={s}" for e, t, o, s in zip(*_energy_and_turns(sound if filtered else pcm), other, steps)]
            if filtered:
                found = [f"{x};pcm={e:.3f};pcm_turns={t}" for x, e, t in zip(found, *_energy_and_turns(pcm))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    batch.column("n_bytes"),
                    pa.array(sizes, pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in payloads]),
                    pa.array([zlib.crc32(x[-unit:]) for x in payloads], pa.int64()),
                    pa.array([len(x) for x in files], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in files]),
                    pa.array(found),
                    pa.array([x.astype("<i2").tobytes() for x in pcm], pa.binary()),
                ],
                names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"],
            )

    kind = stored.schema[key].dataType.simpleString()
    return stored.select(key, "n_bytes", "media").mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary")
