"""Telephony audio columns: G.711 mu-law and A-law by tables, IMA ADPCM by blocks, resampled PCM."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.runtime import read_table

from .text import slices

RATE, BLOCK = 8000, 64
#: WAVE format tags.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
CODECS = ("mulaw", "alaw", "adpcm")
#: Fixed values of IMA ADPCM: step sizes, and the change of the step's index by the low three bits.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit value of each mu-law code: inverted bits, sign, 3 bits of exponent, 4 of mantissa, bias 33 (times 4)."""
    code = ~np.arange(256) & 0xFF
    value = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit value of each A-law code: even bits inverted, sign, exponent and mantissa; the lowest segment is linear."""
    code = np.arange(256) ^ 0x55
    exponent, value = (code >> 4) & 7, ((code & 15) << 4) + 8
    value = np.where(exponent > 0, (value + 256) << np.maximum(exponent - 1, 0), value)
    return np.where(code & 128, value, -value).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) bytes to (n, 121) samples: all blocks advance together, one nibble at a time.

    A block: first sample (int16), step index (clamped to 88), a spare byte, then two samples a byte, low nibble first.
    """
    value = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int8).astype(np.int32) << 8)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((len(blocks), 1 + 2 * (blocks.shape[1] - 4)), np.int16)
    out[:, 0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(out.shape[1] - 1):
        nibble = (data[k >> 1] >> (4 * (k & 1))) & 15
        step = STEPS[index]
        change = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + CHANGES[nibble & 7], 0, 88)
        out[:, k + 1] = value
    return out


def write_wave(data: bytes, codec: str) -> bytes:
    """A WAVE file of one channel at 8 kHz whose data chunk is `data` as it is."""
    per, extra = (1, b"\0\0") if codec != "adpcm" else (BLOCK, struct.pack("<HH", 2, 1 + 2 * (BLOCK - 4)))
    bits = 4 if codec == "adpcm" else 8
    rate = RATE if codec != "adpcm" else RATE * BLOCK // (1 + 2 * (BLOCK - 4))
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, rate, per, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, bytes]:
    """Codec and data chunk of a WAVE file; other chunks are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            codec = {v: k for k, v in TAGS.items()}[int.from_bytes(media[at + 8 : at + 10], "little")]
        elif name == b"data":
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def resampled(x: np.ndarray) -> np.ndarray:
    """8 kHz to 16 kHz: each sample, then the mean with its successor (the last repeats)."""
    out = np.empty(2 * len(x), np.int16)
    out[::2] = x
    out[1::2] = (x.astype(np.int32) + np.append(x[1:], x[-1:])) >> 1
    return out


def decoded(waves: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """Samples at 8 kHz of each; the ADPCM blocks of all of them are decoded at once."""
    blocks = [np.frombuffer(d, np.uint8).reshape(-1, BLOCK) for c, d in waves if c == "adpcm"]
    flat = iter(np.split(decode_adpcm(np.concatenate(blocks)), np.cumsum([len(b) for b in blocks])[:-1])) if blocks else iter(())
    return [next(flat).ravel() if c == "adpcm" else TABLES[c][np.frombuffer(d, np.uint8)] for c, d in waves]


def feature(codec: str, x: np.ndarray, pcm: np.ndarray) -> str:
    y = x.astype(np.int64)
    crossings = int(np.count_nonzero((y[1:] < 0) != (y[:-1] < 0)))
    return f"{codec};samples={len(y)};peak={int(np.abs(y).max(initial=0))};square={int((y * y).sum())};crossings={crossings};pcm16k={zlib.crc32(pcm.tobytes())}"


def audio_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str | None = None, with_pcm: bool = True) -> DataFrame:
    """Store each text's bytes as telephone audio, read it back, decode and resample it.

    One row per input row: id, n_bytes, media (a WAVE file), payload (its data
    chunk as read back), feature, and pcm (16-bit samples at 16 kHz) unless
    with_pcm is off. The payload is the UTF-8 text with bytes 0 up to a
    positive multiple of 64, so null and empty texts give 64 zeros. codec:
    mulaw, alaw, adpcm, or None for one by the payload's checksum, so equal
    texts have equal audio. Rows are independent: repeated rows repeat, no
    shuffle, and memory is bounded by slices of 2 MB or one text. Other
    columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).to_pylist()
                payloads = [t + b"\0" * (-len(t) % BLOCK if t else BLOCK) for t in texts]
                media = [write_wave(p, codec or CODECS[zlib.crc32(p) % 3]) for p in payloads]
                waves = list(map(read_wave, media))
                samples = decoded(waves)
                pcm = list(map(resampled, samples))
                columns = {"id": part.column(0), "n_bytes": pa.array(map(len, texts), pa.int64()), "media": pa.array(media, pa.binary()), "payload": pa.array([d for _, d in waves], pa.binary()), "feature": [feature(c, x, p) for (c, _), x, p in zip(waves, samples, pcm)]}
                if with_pcm:
                    columns["pcm"] = pa.array([p.tobytes() for p in pcm], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "id long, n_bytes long, media binary, payload binary, feature string" + ", pcm binary" * with_pcm
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = audio_columns(read_table(spark, sf_dir, "documents"), with_pcm=False)
    size = F.octet_length("payload")
    return x.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring(F.col("payload"), -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
