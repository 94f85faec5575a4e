"""Shared pieces: Arrow helpers and a vectorised tokeniser.

Texts travel to Python in Arrow batches and are never turned into Python
strings on the hot path: words are byte ranges of the Arrow buffer and their
64-bit hashes come from a prefix polynomial, so a batch costs a handful of
NumPy passes whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.runtime import release
from srcgraph.runtime import settle as materialise

__all__ = ["CHUNK_BYTES", "U64", "chunks", "fresh", "lowered", "materialise", "mix", "powers", "raw_text", "release", "rolling", "table", "text_of", "words"]

U64 = np.uint64
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


# ---------------------------------------------------------------- Arrow helpers
def raw_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string array; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offs, width)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least; rows are never cut."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + rows)
        yield lo, hi
        lo = hi


# ---------------------------------------------------------------- hashing
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for base in (_BASE, _INVERSE):
            p = np.empty(size, U64)
            p[0] = 1
            done, step = 1, base
            while done < size:
                p[done : 2 * done] = p[:done] * U64(step & (2**64 - 1))
                done *= 2
                step = step * step % (1 << 64)
            out.append(p)
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` successive values of ``h`` (len - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, U64)
    p, inv = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    m = len(h) - n + 1
    return mix((total[n:] - total[:m]) * inv[:m])


# ---------------------------------------------------------------- words
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, byte for byte."""
    out = _LOWER[buf]
    if len(buf) > 1:
        at = np.flatnonzero(buf[:-1] == 0xC3) + 1
        at = at[(buf[at] >= 0x80) & (buf[at] <= 0x9E) & (buf[at] != 0x97)]
        out[at] += 32
    return out


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = True, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of each word: a maximal run of letters, digits and non-ASCII bytes within a row, or of the bytes ``inside``.

    Sentence marks and symbols only separate.
    """
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64)
    is_word = _WORD[buf] if inside is None else inside
    start, end = is_word.copy(), np.empty(n, bool)
    start[1:] &= ~is_word[:-1]
    end[:-1] = is_word[:-1] & ~is_word[1:]
    end[-1] = is_word[-1]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    start[cut] = is_word[cut]
    end[cut - 1] = is_word[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    p, inv = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((lowered(buf) if lower else buf).astype(U64) * p[:n], out=total[1:])
    h = mix((total[e] - total[s]) * inv[s] + (e - s).astype(U64))
    return s, e, np.searchsorted(offs, s, side="right") - 1, h
