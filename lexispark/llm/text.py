"""Column expressions and word splitting that several operators share."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.runtime import drop_shuffles  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged; `lower` is the faster one and equal on ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` in UTF-8 with A-Z lowered (bytes methods do exactly this)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """64-bit hashes, alike on every machine."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (shift, multiply, twice)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slices(batch, column: str, limit: int = 2 << 20):
    """Slices of an Arrow batch whose texts hold about `limit` bytes at most, one row at least."""
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


_HELD: dict = {}


def held(key, make):
    """The one large thing that a Python worker keeps from task to task; another takes its place, so that stages don't add up."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go(keep=None) -> None:
    """Give back what earlier tasks left in this worker, but for one thing that is held: objects, Arrow's pool, free pages of the C library."""
    import ctypes

    import pyarrow as pa

    for key in [k for k in _HELD if k != keep]:
        del _HELD[key]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
