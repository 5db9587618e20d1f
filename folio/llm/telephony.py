"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV, expanded and resampled to PCM.

mu-law and A-law samples expand by tables of 256 entries made from their rules. ADPCM blocks carry
their own predictor and step index, so numpy decodes all blocks of a batch in step, one nibble of
every block at a time. Resampling is a low-pass and cubic interpolation with integer weights, hence
exact. The PCM is stored beside the media; what is made on the way is bounded by chunks.

Cases: null text is an empty text. A payload is padded to a positive multiple of UNIT bytes, so
there is always at least one block. Equal texts give equal media and features, also in repeated rows
and rows without a doc_id. A very long text takes about ten times its size in a worker, its PCM
included. Other columns of any name are not read. An empty table gives an empty result.
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
from pyspark.sql import functions as F

from .common import id_and_text, materialize
from .tokens import release, small

UNIT = 576
#: Rates of the stored files and of the PCM: wideband and narrowband telephony.
RATE, TO_RATE = 16000, 8000
#: Samples and ADPCM blocks worked on at a time.
CHUNK, BLOCKS = 1 << 20, 2048
#: WAV format tags (fixed values of the container format).
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
CODECS = ("mulaw", "alaw", "ima_adpcm")
#: Fixed values of IMA ADPCM: quantiser steps and moves of the step index by a nibble's low three bits.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, size = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, size + 8, size + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """(change of the predictor, next step index) by step index * 16 + nibble."""
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    index = np.clip(np.arange(len(STEPS))[:, None] + MOVES[nibble & 7], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -change, change).astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono blocks (rows of bytes): one row of 1 + 2 * (width - 4) samples for each."""
    change, follow = adpcm_tables()
    data = np.ascontiguousarray(blocks[:, 4:].T)
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    out = np.empty((1 + 2 * len(data), len(blocks)), np.int16)
    out[0] = sample
    for k, column in enumerate(data):
        for half in (0, 1):
            at = index + (column >> 4 if half else column & 15)
            sample = np.clip(sample + change[at], -32768, 32767)
            index = follow[at]
            out[1 + 2 * k + half] = sample
    return out.T


def smooth(pcm: np.ndarray) -> np.ndarray:
    """Low-pass by the weights 1, 2, 1 over 4; ends are held."""
    out = np.empty_like(pcm)
    for k in range(0, len(pcm), CHUNK):
        end = min(len(pcm), k + CHUNK)
        near = pcm[np.clip(np.arange(k - 1, end + 1), 0, len(pcm) - 1)].astype(np.int32)
        out[k:end] = near[:-2] + 2 * near[1:-1] + near[2:] + 2 >> 2
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """PCM at another rate by cubic (four-point Lagrange) interpolation with weights of 14 bits; ends are
    held. A lower rate is made of the smoothed samples."""
    if rate == to or not len(pcm):
        return pcm
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    n = -(-len(pcm) * up // down)
    own = smooth(pcm) if down > up else pcm
    padded = np.concatenate([own[:1], own, np.repeat(own[-1:], 3)])
    out = np.empty(n, np.int16)
    for phase in range(min(up, n)):
        first, fraction = divmod(phase * down, up)
        t = fraction / up
        weights = [-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6]
        whole = [round(w * 16384) for w in weights]
        whole[1] += 16384 - sum(whole)
        count = len(range(phase, n, up))
        for k in range(0, count, CHUNK):
            end = min(count, k + CHUNK)
            total = sum(w * padded[first + j + down * k : first + j + down * (end - 1) + 1 : down].astype(np.int32) for j, w in enumerate(whole) if w)
            out[phase + up * k : phase + up * (end - 1) + 1 : up] = np.clip(total + 8192 >> 14, -32768, 32767)
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, these bytes padded with 255 to a positive multiple of UNIT)."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def wav(codec: str, payload: bytes) -> bytes:
    """A mono WAV file whose data chunk is the payload."""
    adpcm = codec == "ima_adpcm"
    block, bits = (UNIT, 4) if adpcm else (1, 8)
    per_block = 1 + 2 * (UNIT - 4) if adpcm else 1
    form = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE * block // per_block, block, bits, 2 * adpcm) + (struct.pack("<H", per_block) if adpcm else b"")
    chunks = b"".join(struct.pack("<4sI", k, len(v)) + v for k, v in ((b"fmt ", form), (b"fact", struct.pack("<I", len(payload) // block * per_block)), (b"data", payload)))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(chunks), b"WAVE") + chunks


def read_wav(media: bytes) -> tuple[str, int, int, bytes]:
    """(codec, rate, block size, data) of a mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        found[kind] = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    tag, channels, rate, _, block = struct.unpack_from("<HHIIH", found[b"fmt "])
    if channels != 1:
        raise ValueError("only mono is supported")
    return {v: k for k, v in TAGS.items()}[tag], rate, block, found[b"data"]


def expand(files: list[bytes], to: int = TO_RATE) -> Iterator[np.ndarray]:
    """Resampled PCM of each WAV file in turn; ADPCM blocks of all files are decoded together, BLOCKS at a time."""
    tables = {"mulaw": mulaw_table(), "alaw": alaw_table()}
    read = [read_wav(f) for f in files]
    decoded: dict[int, np.ndarray] = {}
    for width in {block for codec, _, block, _ in read if codec == "ima_adpcm"}:
        own = [k for k, (codec, _, block, _) in enumerate(read) if codec == "ima_adpcm" and block == width]
        counts = [len(read[k][3]) // width for k in own]
        blocks = np.frombuffer(b"".join(read[k][3][: n * width] for k, n in zip(own, counts, strict=True)), np.uint8).reshape(-1, width)
        pcm = np.empty((len(blocks), 1 + 2 * (width - 4)), np.int16)
        for k in range(0, len(blocks), BLOCKS):
            pcm[k : k + BLOCKS] = decode_adpcm(blocks[k : k + BLOCKS])
        ends = np.cumsum(counts)
        decoded |= {k: pcm[end - n : end].ravel() for k, end, n in zip(own, ends.tolist(), counts, strict=True)}
    for k, (codec, rate, _, data) in enumerate(read):
        yield resample(decoded[k] if codec == "ima_adpcm" else tables[codec][np.frombuffer(data, np.uint8)], rate, to)


def feature(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, root mean square, peak, zero crossings and checksum of resampled PCM."""
    squares = peak = crossings = crc = 0
    for k in range(0, len(pcm), CHUNK):
        wide = pcm[k : k + CHUNK].astype(np.int64)
        squares += int((wide * wide).sum())
        peak = max(peak, int(np.abs(wide).max()))
        negative = pcm[max(0, k - 1) : k + CHUNK] < 0
        crossings += int(np.count_nonzero(negative[1:] != negative[:-1]))
        crc = zlib.crc32(pcm[k : k + CHUNK].astype("<i2").tobytes(), crc)
    return f"{codec}:{len(pcm)}:{math.isqrt(squares // max(1, len(pcm)))}:{peak}:{crossings}:{crc:08x}"


def to_audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, rate, pcm: each text's payload as a WAV file, whose codec its checksum picks, and
    that file's resampled PCM (16-bit little-endian)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for batch in small(whole, limit=8_000_000):
                both = [payload_of(x) for x in batch.column("text").to_pylist()]
                codecs = [zlib.crc32(p) % len(CODECS) for _, p in both]
                # files of one codec stand together: they compress better
                order = sorted(range(len(both)), key=codecs.__getitem__)
                batch, both = batch.take(pa.array(order, pa.int64())), [both[k] for k in order]
                media = [wav(CODECS[codecs[k]], p) for k, (_, p) in zip(order, both, strict=True)]
                pcm = pa.array((x.astype("<i2").tobytes() for x in expand(media)), pa.binary())
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": pa.array([n for n, _ in both], pa.int64()), "media": pa.array(media, pa.binary()), "rate": pa.array([TO_RATE] * len(media), pa.int32()), "pcm": pcm})

    return id_and_text(docs).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, rate int, pcm binary")


def digests(audio: DataFrame) -> DataFrame:
    """Checks and features of stored rows (doc_id, n_bytes, media, pcm), from the stored bytes alone."""
    kind = audio.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole, "media", 2_000_000):
                files = batch.column("media").to_pylist()
                read = [read_wav(f) for f in files]
                columns = [
                    pa.array([len(p) for *_, p in read], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for *_, p in read], pa.string()),
                    pa.array([zlib.crc32(p[-32:]) for *_, p in read], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() for f in files], pa.string()),
                    pa.array([feature(codec, np.frombuffer(pcm.as_buffer(), "<i2")) for (codec, *_), pcm in zip(read, batch.column("pcm"), strict=True)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names)

    return audio.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8(docs: DataFrame) -> DataFrame:
    """Store every text's payload as media with its resampled PCM in the shared folder, read both back, and digest what was read."""
    return digests(materialize(to_audio(docs), "audio", **{"parquet.compression.codec.zstd.level": 12, "parquet.page.size": 4 << 20, "parquet.block.size": 32 << 20, "parquet.enable.dictionary": False}))
