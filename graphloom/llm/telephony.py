"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM by numpy across blocks, resampled PCM.

A sound is kept as a RIFF/WAVE file in a binary column. All work is a narrow map: no shuffle, and rows are decoded in
slices of bounded size, however large a batch is.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import kept_columns, map_texts

MULAW, ALAW, ADPCM, PCM = 7, 6, 0x11, 1
BLOCK = 192  # bytes of an ADPCM block: a header of 4, then two samples a byte
SLICE = 1 << 22  # payload bytes decoded at a time

# The step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """The 256 samples of G.711 mu-law, from its rule."""
    code = ~np.arange(256, dtype=np.int32) & 255
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 256 samples of G.711 A-law, from its rule."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    chord, size = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(chord > 0, (size + 256) << np.maximum(chord - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def _nibble_tables() -> tuple[np.ndarray, np.ndarray]:
    """By (step index, nibble): the signed change of the sample and the next step index, from the decoder's rule."""
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    after = np.clip(np.arange(len(STEPS))[:, None] + INDEX_CHANGES[nibble & 7], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -change, change).astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


CHANGE, AFTER = _nibble_tables()


def decode_adpcm(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """int16 samples (blocks, 1 + 2 * (block - 4)) of mono IMA ADPCM; all blocks advance together, sample by sample.

    The step index of a header is clipped to the table. A last short block is left out.
    """
    blocks = data[: len(data) // block * block].reshape(-1, block)
    value = blocks[:, :2].copy().view("<i2").astype(np.int32).ravel()
    row = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(columns), len(blocks)), dtype=np.int16)
    out[0] = value
    for k, pair in enumerate(columns):
        for j, nibble in enumerate((pair & 15, pair >> 4)):
            at = row + nibble
            value = np.clip(value + CHANGE[at], -32768, 32767)
            row = AFTER[at]
            out[2 * k + j + 1] = value
    return np.ascontiguousarray(out.T)


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice as many samples: between each two their mean, rounded down; the last is held. Works along the last axis."""
    out = np.empty((*pcm.shape[:-1], 2 * pcm.shape[-1]), dtype=np.int16)
    wide = pcm.astype(np.int32)
    out[..., ::2] = pcm
    out[..., 1:-1:2] = (wide[..., :-1] + wide[..., 1:]) >> 1
    if pcm.shape[-1]:
        out[..., -1] = pcm[..., -1]
    return out


def wave(data: bytes, kind: int, rate: int = 8000) -> bytes:
    """A mono RIFF/WAVE file: mu-law and A-law with 8 bits a sample, ADPCM in blocks, PCM with 16 bits."""
    bits, align = {ADPCM: (4, BLOCK), PCM: (16, 2)}.get(kind, (8, 1))
    per_block = 1 + 2 * (BLOCK - 4)
    speed = rate * align // per_block if kind == ADPCM else rate * align
    extra = struct.pack("<HH", 2, per_block) if kind == ADPCM else b"" if kind == PCM else struct.pack("<H", 0)
    head = struct.pack("<HHIIHH", kind, 1, rate, speed, align, bits) + extra
    samples = len(data) // BLOCK * per_block if kind == ADPCM else len(data) // align
    fact = b"" if kind == PCM else struct.pack("<4sII", b"fact", 4, samples)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(head)) + head + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, bytes]:
    """Kind, rate and data of a file made by wave() or like it; ValueError if it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, kind, rate = 12, None, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data" and kind is not None:
            return kind, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a RIFF/WAVE file without fmt or data")


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes; a larger row is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def store_telephony(df: DataFrame, text: str = "text", kind: int = MULAW, keep: list[str] | None = None) -> DataFrame:
    """The kept columns with _n_bytes (of the UTF-8 text) and _media: its bytes, padded by blanks, as a sound file.

    Null and empty texts give one block of blanks. Equal texts give equal files.
    """
    kept = kept_columns(df, keep if keep is not None else [c for c in df.columns if c != text], "_n_bytes", "_media")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, texts = batch.columns
            for lo, hi in _groups(pc.binary_length(texts.fill_null("")).to_pylist()):
                made = [padded(x) for x in texts.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in rest), pa.array([n for n, _ in made], pa.int64()), pa.array([wave(x, kind) for _, x in made], pa.binary())], names=[*batch.schema.names[:-1], "_n_bytes", "_media"])

    return map_texts(df, text, kept, store, "_n_bytes long, _media binary")


def _features(kind: int, parts: list[bytes]) -> Iterator[tuple[bytes, str]]:
    """For each payload the resampled PCM file and a line of features."""
    whole = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    adpcm = decode_adpcm(whole)
    per_block = np.abs(adpcm.astype(np.int64)).sum(axis=1)
    law = {k: t[whole] for k, t in TABLES.items()}
    for end, part in zip(ends, parts, strict=True):
        own, blocks = slice(end - len(part), end), slice((end - len(part)) // BLOCK, end // BLOCK)
        main = adpcm[blocks].ravel() if kind == ADPCM else law[kind][own]
        doubled = resample_double(main)
        power = {k: float(np.sqrt(np.mean(np.square(v[own], dtype=np.float64)))) for k, v in law.items()}
        signs = np.signbit(main)
        crossings = int(np.count_nonzero(signs[1:] != signs[:-1]))
        level = per_block[blocks].sum() / max(1, adpcm[blocks].size)
        yield wave(doubled.astype("<i2").tobytes(), PCM, 16000), f"mulaw_rms={power[MULAW]:.3f};alaw_rms={power[ALAW]:.3f};adpcm_mean={level:.3f};crossings={crossings};pcm16k={len(doubled)};pcm_crc32={zlib.crc32(doubled.astype('<i2').tobytes())}"


def read_telephony(df: DataFrame, media: str = "_media", with_pcm: bool = True) -> DataFrame:
    """df with _payload (the sound's data, read back), _feature and, if asked for, _pcm: 16-bit PCM at 16 kHz.

    Features: loudness of the data as mu-law and as A-law, mean level as ADPCM, zero crossings, and length and CRC-32
    of the PCM. A null sound gives nulls; one that cannot be read raises ValueError.
    """
    df = df.drop("_payload", "_feature", "_pcm")
    at = df.columns.index(media)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _groups(pc.binary_length(batch.column(at)).fill_null(0).to_pylist()):
                part = batch.slice(lo, hi - lo)
                files = [x and read_wave(x) for x in part.column(at).to_pylist()]
                payload, pcm, feature = ([None] * len(files) for _ in range(3))
                for kind in {f[0] for f in files if f}:
                    rows = [i for i, f in enumerate(files) if f and f[0] == kind]
                    for i, (sound, said) in zip(rows, _features(kind, [files[i][2] for i in rows]), strict=True):
                        payload[i], pcm[i], feature[i] = files[i][2], sound if with_pcm else None, said
                made = [pa.array(payload, pa.binary()), pa.array(feature, pa.string())] + [pa.array(pcm, pa.binary())] * with_pcm
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "_payload", "_feature", *["_pcm"] * with_pcm])

    added = T.StructType.fromDDL("_payload binary, _feature string" + ", _pcm binary" * with_pcm)
    return df.mapInArrow(read, T.StructType([*df.schema.fields, *added.fields]))
