"""Media columns for telephony audio: mu-law, A-law and IMA ADPCM in WAV containers, decoded to resampled 16-bit PCM.

Companded samples are expanded by lookup tables; ADPCM blocks of a whole slice of rows are decoded together, one step of numpy
for each nibble position; PCM is resampled by Catmull-Rom interpolation to the target rate and stored as a column.

The stored form of PCM is lossless (`pack_pcm`, `unpack_pcm`): samples that interpolation gives back exactly are left out, and where
256 values or fewer occur, samples are bytes that point into a sorted list of them: the levels of a companding law if they hold
all values, so that like rows stay alike and compress together, else the row's own.

Defined results: null or empty payloads are stored padded like any other; bytes that are no such WAV give null PCM and a feature
that starts with "error"; repeated rows are separate; an empty table gives an empty result; other columns pass through unless
they carry a result's name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, table, text_bytes, written

RATE, TARGET_RATE = 8000, 16000
#: Payloads are padded with PAD to a positive multiple of UNIT bytes: whole samples, and whole ADPCM blocks of BLOCK bytes.
UNIT, PAD, BLOCK = 576, 255, 72
SLICE = 1 << 20
#: zstd level of the tables of media and PCM, which are bytes and little else.
LEVEL = 9
MULAW, ALAW, ADPCM = 7, 6, 0x11  # WAV format tags
FORMATS = (MULAW, ALAW, ADPCM)

# IMA ADPCM step sizes and index changes by nibble.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
        209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272,
        2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500,
        20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    low, segment = (a & 0x0F) << 4, (a & 0x70) >> 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


EXPANDED = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def _adpcm_moves() -> np.ndarray:
    """Signed change of the predictor by step index and nibble."""
    n = np.arange(16)
    s = STEPS[:, None]
    size = (s >> 3) + np.where(n & 4, s, 0) + np.where(n & 2, s >> 1, 0) + np.where(n & 1, s >> 2, 0)
    return np.where(n & 8, -size, size).astype(np.int32)


MOVES = _adpcm_moves()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """uint8 [blocks, bytes] -> int16 [blocks, 1 + 2 * (bytes - 4)]: all blocks go through a nibble position together."""
    n, size = blocks.shape
    data = np.ascontiguousarray(blocks.T)
    value = (data[0].astype(np.int32) | (data[1].astype(np.int32) << 8)).astype(np.uint16).astype(np.int16).astype(np.int32)
    index = np.minimum(data[2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = value
    moves = MOVES.ravel()
    for i in range(4, size):
        for k, nibble in enumerate((data[i] & 15, data[i] >> 4)):
            value = np.clip(value + moves[index * 16 + nibble], -32768, 32767)
            index = np.clip(index + INDEX_CHANGE[nibble], 0, len(STEPS) - 1)
            out[1 + 2 * (i - 4) + k] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Catmull-Rom interpolation at the target rate's instants; edges repeat the first and last sample."""
    if rate == target or len(pcm) == 0:
        return pcm
    x = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    if target == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[0::2] = pcm
        out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
        return out
    at = np.arange(len(pcm) * target // rate, dtype=np.int64) * rate
    i, t = at // target, (at % target) / target
    a, b, c, d = (x[i + k].astype(float) for k in range(4))
    y = b + 0.5 * t * (c - a + t * (2 * a - 5 * b + 4 * c - d + t * (3 * (b - c) + d - a)))
    return np.clip(np.rint(y), -32768, 32767).astype(np.int16)


def wav(payload: bytes, tag: int, rate: int = RATE) -> bytes:
    """A mono WAV file whose data chunk is the payload."""
    if tag == ADPCM:
        per_block = 1 + 2 * (BLOCK - 4)
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
        samples = len(payload) // BLOCK * per_block
    else:
        form = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
        samples = len(payload)
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes | None) -> tuple[int, int, int, bytes] | None:
    """Format tag, rate, block size and data of a mono WAV file; None for anything else."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None or form[1] != 1 or form[0] not in FORMATS or at + 8 + size > len(media) or form[0] == ADPCM and (form[4] <= 4 or size % form[4]):
                return None
            return form[0], form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return None


def decoded(parsed: list[tuple[int, int, int, bytes] | None], target: int) -> list[np.ndarray | None]:
    """Resampled PCM of each file; ADPCM blocks of one size are decoded together."""
    pcm: list[np.ndarray | None] = [None] * len(parsed)
    together: dict[int, list[int]] = {}
    for i, p in enumerate(parsed):
        if p is None:
            continue
        if p[0] == ADPCM:
            together.setdefault(p[2], []).append(i)
        else:
            pcm[i] = EXPANDED[p[0]][np.frombuffer(p[3], np.uint8)]
    for size, rows in together.items():
        blocks = np.frombuffer(b"".join(parsed[i][3] for i in rows), np.uint8).reshape(-1, size)
        samples, at = decode_adpcm(blocks), 0
        for i in rows:
            n = len(parsed[i][3]) // size
            pcm[i] = samples[at : at + n].ravel()
            at += n
    return [None if x is None else resample(x, parsed[i][1], target) for i, x in enumerate(pcm)]


def padded(payload: bytes) -> bytes:
    return payload + bytes([PAD]) * (-len(payload) % UNIT or (0 if payload else UNIT))


def store_payloads(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """All columns but the text, n_bytes, and the text's padded UTF-8 as a WAV file; its format follows from its CRC."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            form = [zlib.crc32(padded(raw[a:b].tobytes())) % len(FORMATS) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            # rows of one format lie together, so what they are decoded to compresses better where it is stored
            batch = batch.take(pa.array(np.argsort(form, kind="stable")))
            raw, offsets = text_bytes(batch.column(0))
            for i, j in slices(offsets, SLICE):
                media = []
                for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True):
                    payload = padded(raw[a:b].tobytes())
                    media.append(wav(payload, FORMATS[zlib.crc32(payload) % len(FORMATS)]))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[1:]], pa.array(np.diff(offsets[i : j + 1]), pa.int64()), pa.array(media, pa.binary())], names)

    rest = [c for c in docs.columns if c not in (text_col, "n_bytes", media_col)]
    names = [*rest, "n_bytes", media_col]
    given = docs.select(F.col(text_col), *rest)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[1:])
    return given.mapInArrow(run, f"{schema}n_bytes bigint, `{media_col}` binary")


#: Sorted levels of each companding law, by the flag that says samples point into them.
LEVELS = {4: np.unique(EXPANDED[MULAW]), 8: np.unique(EXPANDED[ALAW])}


def pack_pcm(pcm: np.ndarray) -> bytes:
    """16-bit samples without loss: flags (1: every second sample is left out; 2: bytes that point into listed values; 4, 8: into a
    law's levels), number of listed values, those values, samples."""
    flags, kept = 0, pcm
    if len(pcm) >= 2 and len(pcm) % 2 == 0 and np.array_equal(resample(pcm[0::2], 1, 2), pcm):
        flags, kept = 1, pcm[0::2]
    kept = np.ascontiguousarray(kept, np.int16)
    seen = np.zeros(1 << 16, bool)
    seen[kept.view(np.uint16)] = True
    values = np.sort(np.flatnonzero(seen).astype(np.uint16).view(np.int16))
    if len(values) > 256:
        return struct.pack("<BH", flags, 0) + kept.astype("<i2").tobytes()
    for law, levels in LEVELS.items():
        if np.isin(values, levels).all():
            return struct.pack("<BH", flags | law, 0) + np.searchsorted(levels, kept).astype(np.uint8).tobytes()
    return struct.pack("<BH", flags | 2, len(values)) + values.astype("<i2").tobytes() + np.searchsorted(values, kept).astype(np.uint8).tobytes()


def unpack_pcm(stored: bytes) -> np.ndarray:
    flags, n = struct.unpack_from("<BH", stored)
    if flags & 14:
        values = LEVELS[flags & 12] if flags & 12 else np.frombuffer(stored, "<i2", n, 3).astype(np.int16)
        at = np.frombuffer(stored, np.uint8, offset=3 + 2 * n)
        kept = values[at] if len(at) else np.zeros(0, np.int16)
    else:
        kept = np.frombuffer(stored, "<i2", offset=3).astype(np.int16)
    return resample(kept, 1, 2) if flags & 1 else kept


def feature(tag: int, pcm: np.ndarray) -> str:
    """Format, samples, peak, energy, zero crossings and CRC of the PCM, in whole numbers."""
    x = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"tag={tag};n={len(x)};peak={int(np.abs(x).max(initial=0))};energy={int(np.dot(x, x))};zc={crossings};pcm={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def _over(df: DataFrame, column: str, made: dict[str, tuple[str, pa.DataType]], given: Callable[[list], list[list]]) -> DataFrame:
    """All columns but `column`, replaced by those that `given` makes of its values, in slices of SLICE bytes or one longer value."""
    rest = [c for c in df.columns if c not in (column, *made)]
    names = [*rest, *made]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array(pc.fill_null(pc.binary_length(batch.column(0)), 0), np.int64)
            for i, j in slices(np.concatenate([[0], np.cumsum(lengths)]), SLICE):
                values = given(batch.column(0).slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), *(pa.array(v, kind) for v, (_, kind) in zip(values, made.values(), strict=True))], names)

    source = df.select(F.col(column), *rest)
    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]), *(f"`{k}` {sql}" for k, (sql, _) in made.items())]
    return source.mapInArrow(run, ", ".join(schema))


def read_media(stored: DataFrame, media_col: str = "media", target: int = TARGET_RATE, pcm_col: str = "pcm") -> DataFrame:
    """All columns but the media, with what the stored bytes give: format (WAV tag), pcm (packed 16-bit samples at the target rate),
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256."""

    def given(media: list) -> list[list]:
        parsed = [parse_wav(m) for m in media]
        data = [p[3] if p else None for p in parsed]
        return [
            [p[0] if p else None for p in parsed],
            [None if x is None else pack_pcm(x) for x in decoded(parsed, target)],
            [None if x is None else len(x) for x in data],
            [None if x is None else hashlib.sha256(x).hexdigest() for x in data],
            [None if x is None else zlib.crc32(x[-32:]) for x in data],
            [None if m is None else len(m) for m in media],
            [None if m is None else hashlib.sha256(m).hexdigest() for m in media],
        ]

    long, text = ("bigint", pa.int64()), ("string", pa.string())
    made = {"format": ("int", pa.int32()), pcm_col: ("binary", pa.binary()), "payload_bytes": long, "payload_sha256": text, "tail_crc32": long, "media_bytes": long, "media_sha256": text}
    return _over(stored, media_col, made, given)


def pcm_features(sounds: DataFrame, pcm_col: str = "pcm") -> DataFrame:
    """All columns but the PCM, and the feature that the stored samples give; null PCM gives an error."""
    tagged = sounds.withColumn(pcm_col, F.concat(F.encode(F.lpad(F.col("format").cast("string"), 4, "0"), "utf-8"), F.col(pcm_col)))

    def given(rows: list) -> list[list]:
        return [["error: not a telephony WAV file" if x is None else feature(int(x[:4]), unpack_pcm(x[4:])) for x in rows]]

    return _over(tagged, pcm_col, {"feature": ("string", pa.string())}, given)


def samples(sounds: DataFrame, pcm_col: str = "pcm") -> DataFrame:
    """All columns, the packed PCM replaced by plain 16-bit little-endian samples."""
    return _over(sounds, pcm_col, {pcm_col: ("binary", pa.binary())}, lambda rows: [[None if x is None else unpack_pcm(x).astype("<i2").tobytes() for x in rows]])


def op2_audio(spark, sf_dir: str) -> DataFrame:
    stored = written(store_payloads(table(spark, sf_dir, "documents").select("doc_id", "text")), LEVEL)
    sounds = written(read_media(stored), LEVEL)
    return pcm_features(sounds).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
