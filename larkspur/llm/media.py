"""Telephony audio columns: G.711 and ADPCM in WAV containers, and resampled PCM.

mu-law and A-law codes are expanded by lookup tables built from their rule; IMA ADPCM is decoded with
numpy across all blocks at once, one step for each sample position of a block.  A media column is a
binary column of whole WAV files; it is written as a table and read back before anything is decoded, and
so is the resampled PCM, packed without loss, before its digests are taken.

Defined results: a null text is an empty one; every payload has at least one 64-byte unit; equal texts
give equal files; rows with equal or null doc_id stay rows of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, rows_with_id, ship

UNIT = 64
RATE, TARGET_RATE = 8000, 16000
#: Level of zstd in the two written tables.
LEVEL = 6
#: Format tags of the WAV container.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17

# The step sizes and index moves of IMA ADPCM.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)
    return np.where(code & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, exponent = (code & 0x0F) << 4, (code >> 4) & 7
    size = np.where(exponent == 0, part + 8, (part + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


EXPAND = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def decode_adpcm(data: bytes, block: int = UNIT) -> np.ndarray:
    """PCM of mono IMA ADPCM: blocks of a 4-byte header (sample, step index) and two samples a byte, low half first."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, block)
    value = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(rows[:, 2].astype(np.int32), 0, len(STEPS) - 1)
    nibbles = np.stack([rows[:, 4:] & 15, rows[:, 4:] >> 4], 2).reshape(len(rows), -1).astype(np.int32)
    out = np.empty((len(rows), 1 + nibbles.shape[1]), np.int16)
    out[:, 0] = value
    for k in range(nibbles.shape[1]):
        code, step = nibbles[:, k], STEPS[index]
        move = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, len(STEPS) - 1)
        out[:, k + 1] = value
    return out.reshape(-1)


def encode_adpcm(pcm: np.ndarray, block: int = UNIT) -> bytes:
    """IMA ADPCM of mono PCM, across blocks; the last block is filled up with its last sample."""
    per = 1 + 2 * (block - 4)
    padded = np.pad(pcm.astype(np.int32), (0, -len(pcm) % per), mode="edge" if len(pcm) else "constant").reshape(-1, per)
    value, index = padded[:, 0].copy(), np.zeros(len(padded), np.int32)
    out = np.zeros((len(padded), block), np.uint8)
    out[:, :2] = value.astype("<i2").view(np.uint8).reshape(-1, 2)
    for k in range(1, per):
        step, gap = STEPS[index], padded[:, k] - value
        rest, code, move = np.abs(gap), np.where(gap < 0, 8, 0), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = rest >= part
            code, rest, move = code + bit * hit, rest - part * hit, move + part * hit
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, len(STEPS) - 1)
        out[:, 4 + (k - 1) // 2] |= (code << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out.tobytes()


def wav(tag: int, rate: int, data: bytes, block: int = UNIT) -> bytes:
    """A mono WAV file."""
    align, bits = {PCM: (2, 16), ADPCM: (block, 4)}.get(tag, (1, 8))
    per_second = rate * align if tag != ADPCM else rate * block // (1 + 2 * (block - 4))
    extra = b"" if tag == PCM else struct.pack("<HH", 2, 1 + 2 * (block - 4)) if tag == ADPCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + extra
    body = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def parse_wav(blob: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, data) of a mono WAV file."""
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate, align = 12, 0, 0, 0
    while at < len(blob):
        name, size = blob[at : at + 4], int.from_bytes(blob[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, channels, rate, _, align, _ = struct.unpack("<HHIIHH", blob[at + 8 : at + 24])
            if channels != 1:
                raise ValueError("mono only")
        elif name == b"data":
            return tag, rate, align, blob[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def to_pcm(blob: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of a mu-law, A-law, ADPCM or PCM file."""
    tag, rate, align, data = parse_wav(blob)
    if tag in EXPAND:
        return rate, EXPAND[tag][np.frombuffer(data, np.uint8)]
    return rate, decode_adpcm(data, align) if tag == ADPCM else np.frombuffer(data, "<i2")


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation in whole numbers (rounded half up), held at the last sample."""
    n = -(-len(pcm) * target // rate)
    at = np.arange(n, dtype=np.int64) * rate
    i, part = at // target, at % target
    wide = np.append(pcm, pcm[-1:]).astype(np.int64)
    return ((wide[i] * (target - part) + wide[i + 1] * part + target // 2) // target).astype(np.int16)


def feature(pcm: np.ndarray) -> str:
    """Whole-number features: samples, peak, rounded-down RMS, zero crossings, mean absolute step."""
    if not len(pcm):
        return "n=0"
    wide = pcm.astype(np.int64)
    steps = np.abs(np.diff(wide))
    return f"n={len(wide)} peak={np.abs(wide).max()} rms={int((wide * wide).sum() // len(wide)) ** 0.5:.0f} zc={np.count_nonzero(np.diff(wide >= 0))} step={int(steps.sum()) // max(1, len(steps))}"


def store_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tag: int = MULAW, rate: int = RATE) -> DataFrame:
    """Written table (doc_id, n_bytes, media): every text's UTF-8 bytes, padded with 0 to whole units, as 8-bit codes of a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [v or b"" for v in b.column(1).cast(pa.binary()).to_pylist()]
            files = [wav(tag, rate, r + b"\0" * (-len(r) % UNIT or UNIT * (not r))) for r in raw]
            yield pa.record_batch([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    ship(docs.sparkSession)
    return cut(rows_with_id(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media", level=LEVEL)


def decode_media(media: DataFrame, target: int = TARGET_RATE) -> DataFrame:
    """Adds to a media table: samples (the stored codes), pcm (a resampled 16-bit WAV file) and feature (of the decoded audio)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            samples, pcm, said = [], [], []
            for blob in b.column(2).to_pylist():
                rate, audio = to_pcm(blob)
                samples.append(parse_wav(blob)[3])
                pcm.append(wav(PCM, target, resample(audio, rate, target).astype("<i2").tobytes()))
                said.append(feature(audio))
            yield pa.record_batch([*b.columns, pa.array(samples, pa.binary()), pa.array(pcm, pa.binary()), pa.array(said)], names=["doc_id", "n_bytes", "media", "samples", "pcm", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, samples binary, pcm binary, feature string")


def _plane(x: np.ndarray) -> tuple[bytes, bytes]:
    """(levels, codes): the values that occur in ascending order and each sample's place among them; over 256 of them, the samples as they are."""
    u = x.view(np.uint16)
    seen = np.zeros(1 << 16, bool)
    seen[u] = True
    levels = np.flatnonzero(seen).astype(np.uint16)
    if len(levels) > 256:
        return b"", x.astype("<i2").tobytes()
    place = np.zeros(1 << 16, np.uint8)
    place[levels] = np.arange(len(levels), dtype=np.uint8)
    return levels.astype("<u2").tobytes(), place[u].tobytes() if len(levels) > 1 else b""


def _of_plane(levels: bytes, codes: bytes, n: int) -> np.ndarray:
    table = np.frombuffer(levels, "<i2")
    return np.frombuffer(codes, "<i2") if not levels else table[np.frombuffer(codes, np.uint8)] if codes else np.repeat(table, n)


def pack_pcm(pcm: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Any 16-bit samples without loss: every second one, and how far the others are from the line between their neighbours."""
    even = np.ascontiguousarray(pcm[::2], np.int16)
    odd = pcm[1::2] - resample(even, 1, 2)[1::2][: len(pcm) // 2] if len(pcm) > 1 else pcm[:0]
    return *_plane(even), *_plane(np.ascontiguousarray(odd, np.int16))


def unpack_pcm(n: int, *packed: bytes) -> np.ndarray:
    """The n samples of pack_pcm."""
    out = np.empty(n, np.int16)
    out[::2] = even = _of_plane(*packed[:2], n - n // 2)
    if n > 1:
        out[1::2] = resample(even, 1, 2)[1::2][: n // 2] + _of_plane(*packed[2:], n // 2)
    return out


PACKED = ("even_levels", "even_codes", "odd_levels", "odd_codes")


def store_pcm(decoded: DataFrame) -> DataFrame:
    """Written table of a decoded media table: what the samples and the media file are known by, and the resampled PCM file by pack_pcm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [parse_wav(blob) for blob in b.column("pcm").to_pylist()]
            audio = [np.frombuffer(f[3], "<i2") for f in files]
            planes = [pa.array(c, pa.binary()) for c in zip(*map(pack_pcm, audio), strict=True)] or [pa.array([], pa.binary())] * len(PACKED)
            yield pa.record_batch([*b.columns[:-1], pa.array([f[1] for f in files], pa.int32()), pa.array([len(x) for x in audio], pa.int64()), *planes], names=[*b.schema.names[:-1], "rate", "n_samples", *PACKED])

    rows = decoded.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "pcm",
    )
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "pcm"] + ["rate int", "n_samples long"] + [f"{c} binary" for c in PACKED]
    return cut(rows.mapInArrow(run, ", ".join(kinds)), "media-pcm", level=LEVEL)


def read_pcm(stored: DataFrame) -> DataFrame:
    """A table by store_pcm with its PCM as whole WAV files again (pcm), rebuilt from the stored bytes."""
    own = [f for f in stored.schema if f.name not in ("rate", "n_samples", *PACKED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = zip(*[b.column(c).to_pylist() for c in ("rate", "n_samples", *PACKED)], strict=True)
            files = [wav(PCM, rate, unpack_pcm(n, *planes).astype("<i2").tobytes()) for rate, n, *planes in packed]
            yield pa.record_batch([*b.columns[: len(own)], pa.array(files, pa.binary())], names=[*b.schema.names[: len(own)], "pcm"])

    return stored.select(*[f.name for f in own], "rate", "n_samples", *PACKED).mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in own), "pcm binary"]))


def digests(stored: DataFrame) -> DataFrame:
    """The digest columns of a table by store_pcm, those of the PCM from its stored bytes."""
    files = read_pcm(stored)
    return files.select(*[c for c in files.columns if c != "pcm"], F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"))
