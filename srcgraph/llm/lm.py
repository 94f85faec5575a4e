"""Operator 9: bits per byte by online logistic mixing of context predictors.

A byte is coded as a path through a fixed binary tree (short paths for common
bytes), and each step of a path is predicted by several predictors that see
different contexts. Three know the corpus: the last two bytes, the last three, and
the word so far, hashed to rows of a table, hold how often each step went either
way. A fourth knows the document alone: its log odds, by hashed context, start at
nothing and follow the gradient of coding cost. A logistic mixer weighs the four:
the weight set is gated by the depth in the tree, starts from ``START`` in each
document and is refined online by the same gradient. Weights and log odds move
after each block of ``BLOCK`` bytes of a document. The total cost of all steps over
the bytes is the score.

The counts come from the whole corpus: each task counts its documents and registers
how many rows each predictor can meet, which sizes the tables, and a shuffle adds the
counts up block by block. The tables grow with the corpus, so they go neither through the
driver nor into the memory of the tasks: each block is written to its place in a
file in the shared folder, and scoring maps the files, page by page. A row holds
three levels of the tree, so a byte costs about two reads a predictor; scoring makes
them for some MB of documents at once, each distinct case of context and byte once,
so that they don't grow dear with the tables. So that no
document predicts itself, the corpus is halved by hash and each half is scored
with the counts of the other.

Defined cases
-------------
* Null and empty texts have 0 bytes, 0 bits and a null bits_per_byte.
* Null ids are scored and carried. Repeated rows fall into the same half and are scored alike.
* Long texts are scored whole. An empty table gives an empty result. Extra columns are ignored.
* While the other half is empty, predictors know nothing and a step costs 1 bit at first.
"""

from __future__ import annotations

import heapq
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import _WORD, CHUNK_BYTES, U64, chunks, lowered, materialise, mix, powers, raw_text, release
from srcgraph.runtime import shared_dir

#: A row of a table holds the slots of LEVELS levels of the tree below a node.
LEVELS = 3
ROW_SLOTS = 1 << LEVELS
#: A table has 2^ROW_BITS rows at least and is counted, added up and written in blocks of as many.
ROW_BITS = 15
ROWS = 1 << ROW_BITS
SLOTS = ROWS * ROW_SLOTS
#: The rows of a context lie within so many of each other, a page of memory.
NEAR = 1 << 9
#: Contexts and bytes are packed into 64 bits.
MAX_BITS = 55
#: Bytes of context of the predictors that see bytes; one more sees the word so far.
ORDERS = (2, 3)
PREDICTORS = len(ORDERS) + 1
INPUTS = PREDICTORS + 1
#: Bits of the rows of predictors whose contexts are few whatever the corpus: all contexts, four rows each.
_BOUNDED = {i: 8 * k + 2 for i, k in enumerate(ORDERS) if k <= 2}
#: Rows for each (context, node) that needs one, at least.
SPARE = 2
#: Log odds up to BOUND in files, in 127 steps either way.
STORED = np.int8
BOUND = 8.0
SCALE = np.float32(BOUND / 127)
#: Registers of the estimate of distinct rows (standard error 1.04 / sqrt(REGISTERS)).
REGISTERS = 1 << 12
#: Of all contexts those whose hash begins with so many zeros are counted, for all of them.
THIN = 4
#: Distinct (context, byte) pairs that a task holds before it sends them on.
HELD = 1 << 21
#: Pairs that it sends in a row.
SENT = 1 << 18
#: Bytes of a document after which weights and the document's own log odds are refined.
BLOCK = 64
RATE = 0.6
#: The context of the document's own predictor, among those of the others, and the bits that are left of it.
OWN = 1
OWN_BITS = 12
OWN_RATE = 0.35
PRIOR = 0.4
#: Weights of the inputs at the start of each document.
START = np.array([0.15, 0.5, 0.4, 1.0])
#: Documents of like length are scored side by side: so many, or of so many bytes.
LANES = 64
LANE_BYTES = 1 << 22
#: The tables are read for so many bytes of documents at once, each distinct case once; so many cases in a pass.
READ_BYTES = 1 << 22
READ = 1 << 16
#: Bits of a word context that fit beside a window.
WORD_BITS = 32

#: Rough shares of bytes in European text. They only shape the tree, not the predictions.
_SHARES = dict(zip(" etaoinsrhldcumfpgwybvkqjxz", (180, 120, 90, 75, 72, 70, 70, 64, 62, 55, 40, 38, 28, 28, 24, 20, 19, 18, 18, 16, 14, 10, 8, 2, 2, 2, 2), strict=True))


def _tree() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path length of each byte, node at each depth, bit at each depth)."""
    share = np.full(256, 0.05)
    for c, w in _SHARES.items():
        share[ord(c)] = w
    share[[*range(65, 91)]] = 1.5
    share[[*range(48, 58)]] = 1.0
    share[[ord(c) for c in ",.\n"]] = 10.0
    share[0xC3] = 12.0
    share[0xA0:0xC0] = 0.5
    heap = [(float(w), i, i) for i, w in enumerate(share)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    nxt = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[2]], parent[b[2]] = (nxt, 0), (nxt, 1)
        heapq.heappush(heap, (a[0] + b[0], nxt, nxt))
        nxt += 1
    paths = []
    for b in range(256):
        path, at = [], b
        while at in parent:
            at, bit = parent[at]
            path.append((at - 256, bit))
        paths.append(path[::-1])
    length = np.array([len(p) for p in paths])
    node, bit = np.zeros((length.max(), 256), np.int64), np.zeros((length.max(), 256), np.int8)
    for b, p in enumerate(paths):
        for d, (n, k) in enumerate(p):
            node[d, b], bit[d, b] = n, k
    return length, node, bit


LENGTH, NODE, BIT = _tree()
DEPTH = len(NODE)
#: The sign of a predictor that speaks against the step taken.
_SIGN = (1 - 2 * BIT).astype(np.float32)
_rng = np.random.default_rng(8)
#: Where the row of a node (by its depth / LEVELS) lies, seen from its context, and the slot of a step in its row.
_ROW_HASH = _rng.integers(0, NEAR, 256)[NODE[::LEVELS]]
_OWN_HASH = _rng.integers(0, 1 << OWN_BITS, 256)[NODE]
_LOCAL = np.zeros((DEPTH, 256), np.int64)
for _d in range(DEPTH):
    for _k in range(_d % LEVELS):
        _LOCAL[_d] = 2 * _LOCAL[_d] + 1 + BIT[_d - _d % LEVELS + _k]
_ROWS_OF = -(-LENGTH // LEVELS)
_LENGTH8 = LENGTH.astype(np.uint8)
#: The same by depth and byte in one number; slots as seen from the first row of the byte.
_ROW_HASH_AT, _OWN_HASH_AT, _SIGN_AT = _ROW_HASH.ravel(), _OWN_HASH.ravel(), _SIGN.ravel()
_SLOT_AT = (_LOCAL + np.arange(DEPTH)[:, None] // LEVELS * ROW_SLOTS).ravel()
#: What a unit of each input is worth.
_UNIT = np.array([SCALE] * PREDICTORS + [1.0])


def _hashed(c: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The last ``order`` bytes in ``bits`` bits."""
    h = c + U64(order)
    h *= U64(0x9E3779B97F4A7C15)
    h >>= U64(64 - bits)
    return h.view(np.int64)


def _word_so_far(buf: np.ndarray, offs: np.ndarray, bits: int) -> np.ndarray:
    """The word before each byte in ``bits`` bits."""
    # the word so far: from the start of the text or behind the last other byte; a byte's own kind isn't known before it is coded
    n = len(buf)
    fresh = np.append(True, ~_WORD[buf[:-1]]) if n else np.zeros(0, bool)
    fresh[offs[:-1][np.diff(offs) > 0]] = True
    first = np.flatnonzero(fresh)
    first = np.repeat(first, np.diff(np.append(first, n)))
    p, inv = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((lowered(buf).astype(U64) + U64(1)) * p[:n], out=total[1:])
    h = (total[:-1] - total[first]) * inv[first]
    h ^= h >> U64(31)
    h *= U64(0xBF58476D1CE4E5B9)
    h >>= U64(64 - bits)
    return h.view(np.int64)


def contexts(buf: np.ndarray, offs: np.ndarray, bits: list[int] | None = None) -> list[np.ndarray]:
    """Context of each byte for each predictor, hashed to as many bits, blind to other documents."""
    bits = bits or [ROW_BITS] * PREDICTORS
    n = len(buf)
    heads = offs[:-1][np.diff(offs) > 0]
    c, wide = np.zeros(n, U64), buf.astype(U64)
    out = []
    for k in range(max(ORDERS)):
        step = np.zeros(n, U64)
        step[k + 1 :] = wide[: n - k - 1] << U64(8 * k)
        for j in range(k + 1):
            # what lies before the text; in a shorter one this falls on the same place of the next
            step[heads[heads < n - j] + j] = 0
        c |= step
        if k + 1 in ORDERS:
            out.append(_hashed(c, k + 1, bits[len(out)]))
    out.append(_word_so_far(buf, offs, bits[-1]))
    return out


def _distinct(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys with the sums of their ``n``."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n, first)


def pairs(c: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | byte, times): equal bytes in equal contexts take equal steps, so they are counted once."""
    key, n = np.unique((c.astype(U64) << U64(8)) | buf, return_counts=True)
    return key, n.astype(np.int64)


def steps(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts of the steps of ``pairs`` in one block (SLOTS * 2). A node moves a row within its block only."""
    row, b = (key >> U64(8)).astype(np.int64) & (ROWS - 1), (key & U64(255)).astype(np.int64)
    at, times = [], []
    for d in range(DEPTH):
        at.append((((row ^ _ROW_HASH[d // LEVELS][b]) * ROW_SLOTS + _LOCAL[d][b]) << 1) | BIT[d][b])
        times.append(n)
        keep = LENGTH[b] > d + 1
        row, b, n = row[keep], b[keep], n[keep]
    # sums of whole numbers, exact in doubles
    return np.bincount(np.concatenate(at), weights=np.concatenate(times), minlength=2 * SLOTS).astype(np.int64)


def count(buf: np.ndarray, offs: np.ndarray, into: np.ndarray) -> None:
    """Add the steps of these texts to ``into`` (PREDICTORS x SLOTS * 2), tables of one block."""
    for i, c in enumerate(contexts(buf, offs)):
        into[i] += steps(*pairs(c, buf))


def odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of each slot from its two counts, as they are stored."""
    n = counts.reshape(-1, 2)
    return np.round(np.log((n[:, 1] + PRIOR) / (n[:, 0] + PRIOR)).clip(-BOUND, BOUND) / SCALE).astype(STORED)


def stretch(counts: np.ndarray) -> list[np.ndarray]:
    """Log odds of tables of one block (PREDICTORS x SLOTS * 2), row by row."""
    return [odds(c).view(np.int64) for c in counts.reshape(PREDICTORS, -1)]


def _side_by_side(offs: np.ndarray, rows: np.ndarray, limit: int = LANE_BYTES, most: int = LANES) -> Iterator[np.ndarray]:
    """``rows`` in groups of like length, of about ``limit`` bytes and at most ``most`` rows."""
    size = offs[rows + 1] - offs[rows]
    rows = rows[np.argsort(size, kind="stable")]
    yield from (rows[lo:hi] for lo, hi in chunks(np.append(0, np.cumsum(np.sort(size))), limit, most))


def _take(buf: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = offs[rows + 1] - offs[rows]
    o = np.append(0, np.cumsum(n))
    return buf[np.arange(int(o[-1])) + np.repeat(offs[rows] - o[:-1], n)], o


def _windows(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each byte with those before it that the longest of ORDERS sees, in 32 bits; the byte itself is the low one."""
    heads, n = offs[:-1][np.diff(offs) > 0], len(buf)
    out = buf.astype(np.uint32)
    for k in range(1, max(ORDERS) + 1):
        step = np.zeros(n, np.uint32)
        step[k:] = buf[: n - k]
        step <<= np.uint32(8 * k)
        for j in range(k):
            # what lies before the text; in a shorter one this falls on the same place of the next
            step[heads[heads < n - j] + j] = 0
        out |= step
    return out


def read(key: np.ndarray, table: list[np.ndarray], word: np.ndarray) -> np.ndarray:
    """Log odds as stored and the sign, four to a step, of all steps of these windows behind these word contexts."""
    bits = [len(t).bit_length() - 1 for t in table]
    c = [_hashed(key >> U64(8) & U64((1 << 8 * k) - 1), k, b) for k, b in zip(ORDERS, bits, strict=False)]
    c.append(word.view(np.int64))
    b = (key & U64(255)).view(np.int64)
    n_rows, n_steps = _ROWS_OF.take(b), LENGTH.take(b)
    row_at = np.cumsum(n_rows) - n_rows
    of, by = np.repeat(np.arange(len(b)), n_rows), np.repeat(np.arange(len(b)), n_steps)
    move = _ROW_HASH_AT.take(((np.arange(len(of)) - row_at.take(of)) << 8) | b.take(of))
    step = ((np.arange(len(by)) - np.repeat(np.cumsum(n_steps) - n_steps, n_steps)) << 8) | b.take(by)
    slot = _SLOT_AT.take(step)
    slot += (row_at * ROW_SLOTS).take(by)
    out = np.empty((len(by), PREDICTORS + 1), STORED)
    for i, t in enumerate(table):
        out[:, i] = t.take(c[i].take(of) ^ move).view(STORED).take(slot)
    out[:, PREDICTORS] = _SIGN_AT.take(step)
    return out


def cost(buf: np.ndarray, offs: np.ndarray, table: list[np.ndarray], start: np.ndarray = START, rate: float = RATE, own_rate: float = OWN_RATE) -> np.ndarray:
    """Bits of each text; ``start`` (INPUTS, or DEPTH x INPUTS) are the weights at the start of each, ``table`` the rows of each predictor."""
    bits = np.zeros(len(offs) - 1)
    if not len(buf):
        return bits
    # equal bytes behind equal ones and in equal words take equal steps, so the tables are read once for each distinct case
    window, word = _windows(buf, offs), _word_so_far(buf, offs, len(table[-1]).bit_length() - 1).view(U64)
    wide = len(table[-1]) > 1 << WORD_BITS
    if wide:
        # the number of the word context among those here, where it has too many bits
        words = pa.array(word).dictionary_encode()
        word, names = words.indices.to_numpy().astype(U64), words.dictionary.to_numpy()
    each = pa.array(word << U64(32) | window).dictionary_encode()
    key, at = each.dictionary.to_numpy(), each.indices.to_numpy()
    n_steps = LENGTH.take((key & U64(255)).view(np.int64))
    ends = np.cumsum(n_steps)
    odds_of = np.empty((int(ends[-1]), PREDICTORS + 1), STORED)
    for lo in range(0, len(key), READ):
        hi = min(lo + READ, len(key))
        part = key[lo:hi]
        odds_of[ends[lo] - n_steps[lo] : ends[hi - 1]] = read(part, table, names[part >> U64(32)] if wide else part >> U64(32))
    place = (ends - n_steps).take(at)
    own = _hashed(window.astype(U64) >> U64(8) & U64((1 << 8 * ORDERS[OWN]) - 1), ORDERS[OWN], len(table[OWN]).bit_length() - 1) & ((1 << OWN_BITS) - 1)
    for rows in _side_by_side(offs, np.arange(len(bits))):
        bits[rows] = _code(buf, offs[rows], np.diff(offs)[rows], place, own, odds_of.view(np.uint32).ravel(), start, rate, own_rate)
    return bits


def _code(
    buf: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, own_at: np.ndarray, odds_of: np.ndarray, start: np.ndarray, rate: float, own_rate: float
) -> np.ndarray:
    """``cost`` of the texts that begin there and have these sizes, side by side; ``place`` is that of the first step of each byte in ``odds_of``."""
    docs = len(size)
    bits = np.zeros(docs)
    # the longest first, so that those that still go on are the first ones
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    # weights take log odds as they are stored
    w = np.repeat((np.broadcast_to(start, (DEPTH, INPUTS)) * _UNIT).T.astype(np.float32), docs, axis=1)
    own = np.zeros(docs << OWN_BITS, np.float32)
    for lo in range(0, int(size[0]), BLOCK):
        n = np.minimum(size[: np.searchsorted(-size, -lo)] - lo, BLOCK)
        ends = np.cumsum(n)
        lane = np.repeat(np.arange(len(n)), n)
        at = np.repeat(begin[: len(n)] + lo - (ends - n), n) + np.arange(len(lane))
        b = buf.take(at).astype(np.int64)
        # steps by depth, then by lane: each weight set has its steps in one stretch
        n_steps = _LENGTH8.take(b)
        each = [(n_steps > d).nonzero()[0] for d in range(int(n_steps.max()))]
        by, depth = np.concatenate(each), np.arange(len(each)).repeat([len(x) for x in each])
        who = lane.take(by)
        reps = np.bincount(depth * docs + who)
        gate = np.flatnonzero(reps)
        reps = reps[gate]
        first = np.cumsum(reps) - reps
        key = (depth << 8) | b.take(by)
        x = place.take(at).take(by)
        x += depth
        x = odds_of.take(x).view(STORED).reshape(-1, PREDICTORS + 1)
        s = [x[:, i].astype(np.float32) for i in range(PREDICTORS)]
        sign = x[:, PREDICTORS].astype(np.float32)
        mine = (own_at.take(at) | lane << OWN_BITS).take(by)
        mine ^= _OWN_HASH_AT.take(key)
        s.append(own.take(mine))
        now = w.take(gate, axis=1)
        z = now[-1].repeat(reps)
        z *= s[-1]
        for i in range(PREDICTORS):
            part = now[i].repeat(reps)
            part *= s[i]
            z += part
        # with the sign of the step that wasn't taken, the cost is log(1 + e^z) and the error its slope
        z *= sign
        np.minimum(np.maximum(z, np.float32(-14), out=z), np.float32(14), out=z)
        e = np.exp(z, out=z)
        e1 = e + np.float32(1)
        err = np.divide(e, e1, out=e)
        err *= sign
        bits[order] += np.bincount(gate % docs, weights=np.add.reduceat(np.log(e1, out=e1), first), minlength=docs)
        step = np.float32(rate) / (reps + 16).astype(np.float32)
        for i in range(INPUTS):
            s[i] *= err
            now[i] -= step * np.add.reduceat(s[i], first) * np.float32(_UNIT[i] * _UNIT[i])
        w[:, gate] = now
        err *= np.float32(own_rate)
        np.subtract.at(own, mine, err)
    return bits / np.log(2)


def _halves(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(half, bytes, offsets) of runs of about ``limit`` bytes of (half, text)."""
    for batch in batches:
        buf, offs = raw_text(batch.column(1))
        half = batch.column(0).to_numpy(zero_copy_only=False)
        for k in (0, 1):
            mine = np.flatnonzero(half == k)
            size = np.append(0, np.cumsum(offs[mine + 1] - offs[mine]))
            for lo, hi in chunks(size, limit):
                yield k, *_take(buf, offs, mine[lo:hi])


def _register(c: np.ndarray, buf: np.ndarray, into: np.ndarray) -> None:
    """Add the (context, node that has a row) of these bytes to the registers of a HyperLogLog."""
    at = np.flatnonzero(c < 1 << (MAX_BITS - THIN))
    key, b = c[at].astype(U64) << U64(8), buf[at]
    for d in range(0, DEPTH, LEVELS):
        h = mix(key | NODE[d].take(b).astype(U64))
        # the place of the first one among the bits that name no register, from below
        low = h >> U64(12)
        rank = np.bitwise_count((low & (~low + U64(1))) - U64(1)).astype(np.uint8) + np.uint8(1)
        np.maximum.at(into, (h & U64(REGISTERS - 1)).astype(np.int64), rank)
        keep = np.flatnonzero((LENGTH > d + LEVELS).take(b))
        if not len(keep):
            break
        key, b = key[keep], b[keep]


def table_bits(top: np.ndarray) -> list[int]:
    """Bits of the rows of each predictor, by the distinct rows that the larger half needs; ``top`` are all registers."""
    n = 0.7213 / (1 + 1.079 / REGISTERS) * REGISTERS**2 / np.exp2(-top.astype(float)).sum(axis=-1)
    # few are counted by the registers that none has met
    empty = (top == 0).sum(axis=-1)
    n = 2**THIN * np.where((n < 2.5 * REGISTERS) & (empty > 0), REGISTERS * np.log(REGISTERS / np.maximum(empty, 1)), n)
    return [_BOUNDED.get(i) or min(MAX_BITS, max(ROW_BITS, int(np.ceil(np.log2(max(SPARE * x, 1)))))) for i, x in enumerate(n.max(axis=0))]


_COUNTED = "half int, predictor int, pairs binary, times binary"


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (context, byte) pairs of each half and predictor, with their numbers; at last a row (-1, -1) with the registers."""
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    top = np.zeros((2, PREDICTORS, REGISTERS), np.uint8)

    def rows(k: int, i: int, blobs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        n = len(blobs)
        return pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array([i] * n, pa.int32()), *[pa.array(x, pa.binary()) for x in zip(*blobs, strict=True)]], ["half", "predictor", "pairs", "times"])

    def flush() -> Iterator[pa.RecordBatch]:
        for (k, i), parts in held.items():
            key, n = _distinct(*map(np.concatenate, zip(*parts, strict=True)))
            n = n.astype(np.uint32)
            for lo in range(0, len(key), SENT):
                yield rows(k, i, [(key[lo : lo + SENT].tobytes(), n[lo : lo + SENT].tobytes())])
        held.clear()

    for k, buf, offs in _halves(batches, CHUNK_BYTES):
        for i, c in enumerate(contexts(buf, offs, [MAX_BITS] * PREDICTORS)):
            if i not in _BOUNDED:
                _register(c, buf, top[k, i])
            held.setdefault((k, i), []).append(pairs(c, buf))
        if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
            for at, parts in held.items():
                held[at] = [_distinct(*map(np.concatenate, zip(*parts, strict=True)))]
            if sum(len(parts[0][0]) for parts in held.values()) > HELD // 2:
                yield from flush()
    yield from flush()
    yield rows(-1, -1, [(top.tobytes(), b"")])


def _split_batches(bits: list[int]):
    """Counted pairs by the blocks of tables of these sizes."""
    starts = np.cumsum([0, *[1 << (b - ROW_BITS) for b in bits]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, i, key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                key, n = np.frombuffer(key.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64)
                row = key >> U64(8 + MAX_BITS - bits[i])
                block = (row >> U64(ROW_BITS)).astype(np.int64)
                low = (((row & U64(ROWS - 1)) << U64(8)) | (key & U64(255))).astype(np.uint32)
                cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                ends = np.append(cut[1:], len(key))
                both = [pa.array([x[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()) for x in (low, n)]
                yield pa.RecordBatch.from_arrays([pa.array(k * starts[-1] + starts[i] + block[cut], pa.int64()), *both], ["block", "pairs", "times"])

    return run


def _write_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, so one block is held at a time; a block written twice is written alike."""
        file = os.open(path, os.O_WRONLY)

        def write(block: int, total: np.ndarray) -> None:
            data = memoryview(odds(total).view(np.uint8))
            at = block * SLOTS * STORED().itemsize
            while data:
                done = os.pwrite(file, data, at)
                data, at = data[done:], at + done

        try:
            now, total, blocks, held, size = -1, np.zeros(2 * SLOTS, np.int64), 0, [], 0

            def add() -> None:
                nonlocal held, size
                if held:
                    np.add(total, steps(*map(np.concatenate, zip(*held, strict=True))), out=total)
                held, size = [], 0

            for batch in batches:
                for block, key, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    if block != now:
                        if now >= 0:
                            add()
                            write(now, total)
                        now, blocks = block, blocks + 1
                        total[:] = 0
                    held.append((np.frombuffer(key.as_buffer(), np.uint32).astype(U64), np.frombuffer(n.as_buffer(), np.int64)))
                    size += len(held[-1][0])
                    if size > HELD // 4:
                        add()
            if now >= 0:
                add()
                write(now, total)
            os.fsync(file)
        finally:
            os.close(file)
        yield pa.RecordBatch.from_arrays([pa.array([blocks], pa.int64())], ["blocks"])

    return run


def _tables(path: str, bits: list[int]) -> list[list[np.ndarray]]:
    """Rows of log odds by half and predictor, mapped from the file."""
    whole, at, out = np.memmap(path, np.int64, "r"), 0, []
    for _ in (0, 1):
        out.append([])
        for b in bits:
            out[-1].append(np.asarray(whole[at : at + (1 << b)]))
            at += 1 << b
    return out


def gather(halved: DataFrame) -> tuple[str, list[int]]:
    """(file, bits of each predictor): log odds from both halves of (half, text), in the shared folder."""
    url = urlsplit(shared_dir(halved.sparkSession))
    if url.scheme not in ("", "file"):
        raise RuntimeError("op9_context_mixing maps its tables: spark.checkpoint.dir must be a mounted folder")
    counted, top = materialise(halved.mapInArrow(_count_batches, _COUNTED)), np.zeros((2, PREDICTORS, REGISTERS), np.uint8)
    for r in counted.where("half < 0").select("pairs").collect():
        np.maximum(top, np.frombuffer(bytes(r.pairs), np.uint8).reshape(top.shape), out=top)
    bits = table_bits(top)
    folder = unquote(url.path)
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/srcgraph-{uuid.uuid4().hex}.odds"
    with open(path, "wb") as f:
        # what no block is written to stays a hole and reads as 0, the log odds of an unseen step
        f.truncate(2 * ROW_SLOTS * STORED().itemsize * sum(1 << b for b in bits))
    each = counted.where("half >= 0").mapInArrow(_split_batches(bits), "block bigint, pairs binary, times binary")
    each.repartition("block").sortWithinPartitions("block").mapInArrow(_write_batches(path), "blocks bigint").agg(F.sum("blocks")).collect()
    release(counted)
    return path, bits


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, total_bits, bits_per_byte) of every document."""
    text = docs["text"].cast("string")
    half = F.pmod(F.xxhash64(F.lit("half"), text), F.lit(2)).cast("int")
    halved = docs.select(half.alias("half"), text.alias("text"), "doc_id")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if halved.rdd.getNumPartitions() < cores:
        # a table of few files is spread over all cores: coding costs far more than moving so small a text
        halved = halved.repartition(cores)
    full = halved.where("text <> ''").select("half", "text")
    path, bits = gather(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(path, bits)
        for batch in batches:
            buf, offs = raw_text(batch.column(1))
            half = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            spent = np.zeros(batch.num_rows)
            for k in (0, 1):
                for rows in _side_by_side(offs, np.flatnonzero(half == k), READ_BYTES, len(offs)):
                    # each half is scored with the counts of the other
                    spent[rows] = cost(*_take(buf, offs, rows), tables[1 - k])
            n = np.diff(offs)
            each = np.divide(spent, n, out=np.zeros(len(n)), where=n > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(n), pa.array(np.round(spent, 2)), pa.array(np.round(each, 4), mask=n == 0)], ["doc_id", "n_bytes", "total_bits", "bits_per_byte"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return halved.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, total_bits double, bits_per_byte double")
