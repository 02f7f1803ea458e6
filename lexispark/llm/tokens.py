"""Words of whole Arrow columns at once, their hashes, and bitmaps of hashes that keep a fixed size."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import mix

#: Bits of a bitmap, as a power of two: 8 MB whatever the data hold.
BITS = 26
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _CODES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def byte_class(inside: str = "", between: str = "", breaks: str = "") -> np.ndarray:
    """For each byte 0 (part of a word), 1 (between words) or 2 (between pieces); either `inside` or the other two are given."""
    kinds = np.zeros(256, np.uint8)
    if inside:
        kinds[:128] = 1
        kinds[[ord(c) for c in inside]] = 0
    kinds[[ord(c) for c in between]] = 1
    kinds[[ord(c) for c in breaks]] = 2
    return kinds


#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of texts whose A-Z are lowered: digits, small letters, all that isn't ASCII.
ALNUM = byte_class(inside="0123456789abcdefghijklmnopqrstuvwxyz")
#: Words `[^\x20\x09]+` of pieces between `[.,;:!?\x0A-\x0D]`.
PHRASE = byte_class(between=" \t", breaks=".,;:!?\n\x0b\x0c\r")


@dataclass
class Words:
    """The words of several texts, in order: `code` into `vocabulary`, `text` (row number), and whether each begins a piece."""

    vocabulary: pa.Array
    code: np.ndarray
    text: np.ndarray
    begins: np.ndarray

    def counts(self, rows: int) -> np.ndarray:
        return np.bincount(self.text, minlength=rows)

    def hashes(self) -> np.ndarray:
        """64 bits for each entry of the vocabulary, alike on every machine: sums of its bytes' codes times powers of an odd number."""
        n = len(self.vocabulary)
        if not n:
            return np.zeros(0, np.uint64)
        ends = np.frombuffer(self.vocabulary.buffers()[1], np.int64)[: n + 1]
        data = np.frombuffer(self.vocabulary.buffers()[2], np.uint8)[: ends[-1]]
        size = np.diff(ends)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.append(np.uint64(1), np.full(int(size.max()), _ODD)))
            place = np.arange(len(data)) - np.repeat(ends[:-1], size)
            return mix(np.add.reduceat(_CODES[data] * power[place], ends[:-1]) + size.astype(np.uint64))


def split_words(texts: pa.Array, kinds: np.ndarray) -> Words:
    """Words of a string column with A-Z lowered; null texts have none. All work is on bytes: what separates words is ASCII."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _LOWER[np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]]] if raw is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = kinds[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    first[edges] = inside[edges]  # a text's first byte, whatever stands before it
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start = np.flatnonzero(first)
    text = np.searchsorted(ends, start, "right") - 1
    offsets = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - start))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    pieces = np.searchsorted(np.flatnonzero(kind == 2), start)
    begins = np.ones(len(start), bool)
    begins[1:] = (text[1:] != text[:-1]) | (pieces[1:] != pieces[:-1])
    return Words(words.dictionary, words.indices.to_numpy(zero_copy_only=False), text, begins)


def runs_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words, by the hashes of the words; entry i is that of the words from i on."""
    n = max(0, len(hashes) - size + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size))
        for k in range(size):
            out = mix(out * _ODD + hashes[k : k + n])
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def bitmap(df: DataFrame, hash_column: str, bits: int = BITS) -> np.ndarray:
    """Bits that the hashes of `df` set, packed; a lossless filter, as it may only hold too much.

    Spark gathers 4 KB pieces, so what reaches the driver is 2^bits / 8 bytes at most, however many rows there are.
    """
    slot: Column = F.col(hash_column).bitwiseAND(F.lit((1 << bits) - 1))
    pieces = df.select(F.shiftright(slot, 15).alias("piece"), slot.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
    got = pieces.groupBy("piece").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in got:
        out[r["piece"] * 4096 : (r["piece"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(packed) * 8 - 1)
    return (packed[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
