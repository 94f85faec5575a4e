import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from srcgraph.llm import lm
from srcgraph.llm.common import raw_text

TEXTS = ["the cat sat on the mat, été THE end. " * 9, "a", "zebra 12 %%% the cat" * 30, "naïve\nlines the the the cat"]


def _slot(x, k):
    return ((x + 1 + k) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - lm.ROW_BITS)


def _brute_contexts(data):
    """The byte contexts of one text, byte after byte."""
    out = []
    for i in range(len(data)):
        c, ctx = 0, []
        for k in range(3):
            c |= (data[i - k - 1] if i > k else 0) << (8 * k)
            if k:
                ctx.append(_slot(c, k))
        out.append(ctx)
    return out


def _steps(b):
    """(node, bit, row of the node seen from its context, slot in the row) of each step of a byte."""
    out, heads = [], {}
    for d in range(lm.LENGTH[b]):
        if d % lm.LEVELS == 0:
            head, slot = int(lm.NODE[d, b]), 0
            move = heads.setdefault(head, int(lm._ROW_HASH[d // lm.LEVELS, b]))
        bit = int(lm.BIT[d, b])
        out.append((int(lm.NODE[d, b]), bit, move, slot))
        slot = 2 * slot + 1 + bit
    return out


def test_contexts_and_counts_match_brute_force():
    buf, offs = raw_text(pa.array(TEXTS))
    ctx = lm.contexts(buf, offs)
    want = [c for t in TEXTS for c in _brute_contexts(t.encode())]
    for k in range(2):
        assert ctx[k].tolist() == [w[k] for w in want]
    # the word context of a byte depends on the word so far alone, whatever the document
    words = {}
    for j, t in enumerate(TEXTS):
        data, so_far = t.encode(), b""
        for i, b in enumerate(data):
            assert words.setdefault(so_far, int(ctx[2][offs[j] + i])) == ctx[2][offs[j] + i]
            so_far = so_far + bytes([b]).lower() if lm._WORD[b] else b""
    into = np.zeros((lm.PREDICTORS, 2 * lm.SLOTS), np.int64)
    lm.count(buf, offs, into)
    brute = np.zeros_like(into)
    for i, b in enumerate(buf):
        for _, bit, h, slot in _steps(int(b)):
            for k in range(lm.PREDICTORS):
                brute[k, (((int(ctx[k][i]) ^ h) * 8 + slot) << 1) | bit] += 1
    assert (into == brute).all()


def test_mixing_matches_brute_force_step_by_step():
    buf, offs = raw_text(pa.array(TEXTS))
    counts = np.zeros((lm.PREDICTORS, 2 * lm.SLOTS), np.int64)
    lm.count(buf, offs, counts)
    table = lm.stretch(counts)
    start = np.array([[0.2, 0.4, 0.3, 1.0]] * lm.DEPTH) * np.linspace(0.5, 1.5, lm.DEPTH)[:, None]
    got = lm.cost(buf, offs, table, start)
    ctx = lm.contexts(buf, offs)
    for j in range(len(TEXTS)):
        w, own, total = start.astype(float), {}, 0.0
        n = int(offs[j + 1] - offs[j])
        for lo in range(0, n, lm.BLOCK):
            grad, seen, moved = np.zeros_like(w), np.zeros(lm.DEPTH), []
            for i in range(offs[j] + lo, offs[j] + min(lo + lm.BLOCK, n)):
                for d, (_, bit, h, slot) in enumerate(_steps(int(buf[i]))):
                    mine = (int(ctx[lm.OWN][i]) % 2**lm.OWN_BITS) ^ int(lm._OWN_HASH[d, buf[i]])
                    s = [float(table[k][int(ctx[k][i]) ^ h : (int(ctx[k][i]) ^ h) + 1].view(np.int8)[slot]) * lm.BOUND / 127 for k in range(lm.PREDICTORS)]
                    s = np.array([*s, own.get(mine, 0.0)])
                    p = 1 / (1 + math.exp(-min(max(float(w[d] @ s), -14), 14)))
                    total -= math.log2(p if bit else 1 - p)
                    grad[d] += (bit - p) * s
                    seen[d] += 1
                    moved.append((mine, bit - p))
            w += lm.RATE * grad / (seen[:, None] + 16)
            for mine, err in moved:
                own[mine] = own.get(mine, 0.0) + lm.OWN_RATE * err
        assert abs(got[j] - total) < 1e-3 * max(1, total)
    # what a document has held before costs less the second time, without any corpus
    none = [np.zeros(lm.ROWS, np.int64)] * lm.PREDICTORS
    twice = lm.cost(*raw_text(pa.array(["qzx jvw kpy " * 6, "qzx jvw kpy " * 12])), none)
    assert twice[1] < 1.5 * twice[0]


class _Read(np.ndarray):
    """Rows that count how often they are read."""

    times = 0

    def take(self, at, *args, **kwargs):
        _Read.times += len(at)
        return np.asarray(self).take(at, *args, **kwargs)


def test_tables_are_read_once_a_distinct_case():
    """Reads follow the distinct cases of a run of documents, not its bytes; a document costs the same alone and beside others."""
    rng = np.random.default_rng(5)
    table = [rng.integers(-(2**62), 2**62, lm.ROWS).view(_Read) for _ in range(lm.PREDICTORS)]
    texts = [*TEXTS, "", *(TEXTS[0][i:] for i in range(40)), "e" * 70]
    _Read.times = 0
    got = lm.cost(*raw_text(pa.array(texts)), table)
    cases = {(re.split(rb"[^0-9A-Za-z\x80-\xff]", t.encode()[:i])[-1].lower(), t.encode()[max(i - 3, 0) : i].rjust(3, b"\0"), b) for t in texts for i, b in enumerate(t.encode())}
    assert _Read.times <= lm.PREDICTORS * sum(-(-lm.LENGTH[b] // lm.LEVELS) for *_, b in cases) < sum(len(t) for t in texts)
    alone = [lm.cost(*raw_text(pa.array([t])), table)[0] for t in texts]
    assert np.allclose(got, alone, rtol=1e-5) and got[len(TEXTS)] == 0


def test_word_contexts_beyond_those_that_fit(monkeypatch):
    rng = np.random.default_rng(6)
    table = [rng.integers(-(2**62), 2**62, lm.ROWS) for _ in range(lm.PREDICTORS)]
    args = *raw_text(pa.array(TEXTS)), table
    want = lm.cost(*args)
    monkeypatch.setattr(lm, "WORD_BITS", 9)
    monkeypatch.setattr(lm, "READ", 7)
    assert (lm.cost(*args) == want).all()


def test_every_byte_has_a_path():
    assert len({tuple((n, b) for n, b, *_ in _steps(i)) for i in range(256)}) == 256
    assert abs(sum(2.0 ** -lm.LENGTH) - 1) < 1e-12


def test_score(make_docs):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80)), "en", "a") for i in range(60)]
    noise = "".join(rng.choice("qwxzjkvby0123456789#") for _ in range(500))
    rows += [(100, noise, "en", "a"), (101, None, None, None), (102, "", "en", "a"), (None, rows[0][1], "en", "a"), (103, rows[1][1] * 500, "en", "a"), (0, rows[0][1], "en", "a")]
    docs = make_docs([(*r, 1.0) for r in rows], ", total_bits double")
    got = {}
    for r in lm.score(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert got[101][0].bits_per_byte is None and got[102][0].n_bytes == 0 and got[102][0].total_bits == 0
    plain = [got[i][0].bits_per_byte for i in range(60)]
    assert max(plain) < 1.5 < got[100][0].bits_per_byte
    assert got[0][0] == got[0][1] and got[None][0].total_bits == got[0][0].total_bits
    assert got[103][0].n_bytes == len(rows[1][1]) * 500 and got[103][0].bits_per_byte < plain[1] + 0.1
    again = {r.doc_id: r.bits_per_byte for r in lm.score(docs.repartition(3)).collect()}
    assert all(abs((again[i] or 0) - (got[i][0].bits_per_byte or 0)) <= 2e-4 for i in got)
    assert lm.score(docs.where(F.lit(False))).count() == 0


def test_tables_grow_with_the_distinct_contexts(make_docs):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(400)), "en", "a") for i in range(60)]
    halved = make_docs(rows).select(F.pmod("doc_id", F.lit(2)).cast("int").alias("half"), "text")
    path, bits = lm.gather(halved)
    tables = lm._tables(path, bits)
    for k in (0, 1):
        buf, offs = raw_text(pa.array([t for i, t, *_ in rows if i % 2 == k]))
        # slots of (context, node) as the sizes say, and exact counts of them with contexts that don't collide
        wide, hashed = lm.contexts(buf, offs, [lm.MAX_BITS] * lm.PREDICTORS), lm.contexts(buf, offs, bits)
        for i in range(lm.PREDICTORS):
            exact, slots = {}, {}
            for c, s, b in zip(wide[i].tolist(), hashed[i].tolist(), buf.tolist()):
                for node, bit, h, slot in _steps(b):
                    exact.setdefault((c, node), [0, 0])[bit] += 1
                    slots[c, node] = s ^ h, slot
            assert len(set(slots.values())) <= 2 ** bits[i] * lm.ROW_SLOTS / lm.SPARE
            same = sum(tables[k][i][slots[x][0] : slots[x][0] + 1].view(np.int8)[slots[x][1]] == lm.odds(np.array(n))[0] for x, n in exact.items())
            assert same >= 0.75 * len(exact)
    assert bits[-1] > lm.ROW_BITS and bits[0] == 18


def test_score_matches_brute_force_of_halves_tables_and_mixing(make_docs):
    """The whole query against tables counted step by step from the other half."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "été"]) + str(rng.randrange(9)) for _ in range(rng.randint(1, 60))), "en", "a") for i in range(40)]
    docs = make_docs(rows)
    got = {r.doc_id: (r.total_bits, r.n_bytes, r.bits_per_byte) for r in lm.score(docs).collect()}
    halved = docs.select("doc_id", F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2)).cast("int").alias("half"), "text").collect()
    _, bits = lm.gather(docs.select(F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2)).cast("int").alias("half"), "text"))
    tables = []
    for k in (0, 1):
        buf, offs = raw_text(pa.array([r.text for r in halved if r.half == k]))
        each = []
        for i, c in enumerate(lm.contexts(buf, offs, bits)):
            n = {}
            for x, b in zip(c.tolist(), buf.tolist()):
                for _, bit, h, slot in _steps(b):
                    n.setdefault((x ^ h) * lm.ROW_SLOTS + slot, [0, 0])[bit] += 1
            t = np.zeros(lm.ROW_SLOTS << bits[i], np.int8)
            for at, pair in n.items():
                t[at] = lm.odds(np.array(pair))[0]
            each.append(t.view(np.int64))
        tables.append(each)
    for r in halved:
        want = float(lm.cost(*raw_text(pa.array([r.text])), tables[1 - r.half])[0])
        n = len(r.text.encode())
        assert abs(got[r.doc_id][0] - want) < 0.02 and got[r.doc_id][1] == n and abs(got[r.doc_id][2] - want / n) < 1e-3
