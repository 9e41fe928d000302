"""Telephony audio in binary columns: companded and ADPCM recordings expanded to resampled PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import texts

#: Format tags of WAV files.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
CODINGS = {"mulaw": MULAW, "alaw": ALAW, "adpcm": IMA_ADPCM}
#: Changes of the step index by code magnitude, and the number of steps of IMA ADPCM.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
N_STEPS = 89

TELEPHONE_RATE, RATE = 8000, 16000
#: Bytes of an ADPCM block; payloads are padded to a multiple of it.
BLOCK = 192


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    high, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(high == 0, low + 8, low + 0x108 << np.maximum(high - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw(), _alaw()
#: Step sizes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, block bytes) to (n, samples): one step in time at once for all blocks."""
    blocks = blocks.astype(np.int64)
    value = blocks[:, 0] | blocks[:, 1] << 8
    value = np.where(value >= 32768, value - 65536, value)
    index = np.minimum(blocks[:, 2], N_STEPS - 1)
    out = np.empty((len(blocks), 1 + 2 * (blocks.shape[1] - 4)), np.int16)
    out[:, 0] = value
    for k in range(out.shape[1] - 1):
        code = blocks[:, 4 + k // 2] >> 4 * (k % 2) & 15
        step, size = STEPS[index], code & 7
        change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[size], 0, N_STEPS - 1)
        out[:, k + 1] = value
    return out


def encode_adpcm(samples: np.ndarray, block: int = BLOCK) -> bytes:
    """Blocks of IMA ADPCM, the last one padded with its last sample; all blocks advance together."""
    width = 1 + 2 * (block - 4)
    n = max(1, -(-len(samples) // width))
    wide = np.pad(samples.astype(np.int64), (0, n * width - len(samples)), mode="edge" if len(samples) else "constant").reshape(n, width)
    value, index = wide[:, 0].copy(), np.zeros(n, np.int64)
    out = np.zeros((n, block), np.uint8)
    out[:, 0], out[:, 1] = value & 255, value >> 8 & 255
    for k in range(width - 1):
        step = STEPS[index]
        gap = wide[:, k + 1] - value
        size = np.minimum(np.abs(gap) * 4 // step, 7)
        change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(value + np.where(gap < 0, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[size], 0, N_STEPS - 1)
        out[:, 4 + k // 2] |= (size + np.where(gap < 0, 8, 0) << 4 * (k % 2)).astype(np.uint8)
    return out.tobytes()


def wav(payload: bytes, tag: int, rate: int = TELEPHONE_RATE, block: int = BLOCK) -> bytes:
    """A one-channel WAV file around samples that are in the tag's coding already."""
    if tag == IMA_ADPCM:
        width = 1 + 2 * (block - 4)
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * block // width, block, 4, 2, width)
    else:
        each = 2 if tag == PCM else 1
        form = struct.pack("<HHIIHH", tag, 1, rate, rate * each, each, 8 * each)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes] | None:
    """(tag, rate, block bytes, samples as stored) of a one-channel WAV file, or None if it isn't one."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt " and size >= 16:
            tag, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            form = (tag, rate, block) if channels == 1 and rate > 0 else None
        elif name == b"data" and form:
            return (*form, media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return None


def expand(tag: int, block: int, payload: bytes) -> np.ndarray | None:
    """Stored samples to 16-bit PCM; None for another coding."""
    raw = np.frombuffer(payload, np.uint8)
    if tag == MULAW:
        return MULAW_TABLE[raw]
    if tag == ALAW:
        return ALAW_TABLE[raw]
    if tag == IMA_ADPCM and block > 4:
        return decode_adpcm(raw[: len(raw) // block * block].reshape(-1, block)).ravel()
    if tag == PCM and block == 2:
        return np.frombuffer(payload[: len(payload) // 2 * 2], "<i2")
    return None


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Cubic interpolation between the four nearest samples, at another rate."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    n = len(pcm) * to // rate
    if to % rate == 0:  # the same few fractions recur: a filter for each
        fractions, whole = np.arange(to // rate) / (to // rate), None
    else:
        place = np.arange(n) * (rate / to)
        whole = place.astype(np.int64)
        fractions = place - whole
    x = np.pad(pcm.astype(np.float32), (1, 2), mode="edge")
    f = fractions.astype(np.float32)
    taps = (((2 - f) * f - 1) * f / 2, ((3 * f - 5) * f * f + 2) / 2, ((4 - 3 * f) * f + 1) * f / 2, (f - 1) * f * f / 2)
    if whole is None:
        out = sum(x[k : k + len(pcm), None] * t[None, :] for k, t in enumerate(taps)).ravel()
    else:
        out = sum(x[whole + k] * t for k, t in enumerate(taps))
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append ``n_bytes`` and ``media``: the UTF-8 text, filled up with spaces to a positive multiple of BLOCK bytes,
    as the samples of a telephone recording.

    The bytes become mu-law codes, A-law codes or ADPCM blocks unchanged; which of the three depends on their crc32, so
    equal texts give equal files. A null text is stored like an empty one: one block of spaces.
    """
    tags = sorted(CODINGS.values())

    def made(rows: list[bytes]) -> list[pa.Array]:
        padded = [t.ljust(max(1, -(-len(t) // BLOCK)) * BLOCK) for t in rows]
        return [pa.array([len(t) for t in rows], pa.int64()), pa.array([wav(p, tags[zlib.crc32(p) % 3]) for p in padded], pa.binary())]

    return texts.with_columns(docs, lambda: made, "n_bytes long, media binary", text, drop_text=True)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, coding string, n_samples long, rms double, peak int, crossings long, pcm_crc32 long"


def listen(df: DataFrame, media: str = "media", rate: int = RATE, keep_pcm: bool = True) -> DataFrame:
    """Read stored recordings back, expand and resample them; append FEATURES and, if asked for, ``pcm`` (a WAV file).

    Null, empty or malformed files, other codings and files of several channels give nulls. All ADPCM blocks of a
    batch are decoded together. ``rms``, ``peak`` and ``crossings`` are of the expanded samples, ``n_samples`` and
    ``pcm_crc32`` of the resampled ones.
    """
    names = {v: k for k, v in CODINGS.items()} | {PCM: "pcm"}

    def made(rows: list[bytes]) -> list[pa.Array]:
        read = [read_wav(m) for m in rows]
        whole = [r is not None and r[0] == IMA_ADPCM and r[2] > 4 and len(r[3]) >= r[2] for r in read]
        decoded: dict[int, np.ndarray] = {}
        for size in {r[2] for r, w in zip(read, whole, strict=True) if w}:
            own = [(i, r[3][: len(r[3]) // size * size]) for i, (r, w) in enumerate(zip(read, whole, strict=True)) if w and r[2] == size]
            all_blocks = decode_adpcm(np.frombuffer(b"".join(p for _, p in own), np.uint8).reshape(-1, size))
            ends = np.cumsum([len(p) // size for _, p in own])[:-1]
            decoded |= {i: part.ravel() for (i, _), part in zip(own, np.split(all_blocks, ends), strict=True)}
        out = []
        for i, r in enumerate(read):
            samples = None if r is None else decoded[i] if i in decoded else expand(r[0], r[2], r[3])
            if samples is None:
                out.append((None,) * 10)
                continue
            tag, own_rate, _, payload = r
            again = resample(samples, own_rate, rate).astype("<i2").tobytes()
            wide = samples.astype(np.float64)
            sign = samples < 0
            out.append((
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), names[tag], len(again) // 2, float(np.sqrt(wide @ wide / max(1, len(wide)))),
                int(np.abs(wide).max(initial=0)), int((sign[1:] != sign[:-1]).sum()), zlib.crc32(again), wav(again, PCM, rate) if keep_pcm else None,
            ))
        columns = list(zip(*out, strict=True)) or [()] * 10
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 10 if keep_pcm else 9]

    return texts.with_columns(df.withColumn("__media", df[media]), lambda: made, FEATURES + ", pcm binary" * keep_pcm, "__media", drop_text=True)
