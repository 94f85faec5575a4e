import random

import numpy as np
from pyspark.sql import functions as F

from srcgraph.llm import bwt
from srcgraph.llm.common import materialise


def _windows_of(rng, n, alphabet):
    return [[rng.randint(1, alphabet) for _ in range(rng.randint(1, 7))] for _ in range(n)]


def _transform(wins):
    text = np.array([s for w in wins for s in [*w, 0]], np.uint64)
    win = np.repeat(np.arange(len(wins)), [len(w) + 1 for w in wins])
    suf = bwt.suffix_order(text, win)
    first = np.append(True, win[1:] != win[:-1])
    before = np.append(np.uint64(0), text[:-1])
    before[first] = 0
    tails = [[int(x) for x in text[i:][: int(np.flatnonzero(text[i:] == 0)[0]) + 1]] for i in suf]
    return before[suf], tails


def test_merge_matches_sorting_all_suffixes():
    rng = random.Random(7)
    for alphabet in (1, 2, 5, 400):
        shards = [_transform(_windows_of(rng, rng.randint(1, 25), alphabet)) for _ in range(rng.randint(1, 5))]
        assert all(t == sorted(t) for _, t in shards)
        order, lcp = bwt.merge([b for b, _ in shards])
        tails = [t for _, ts in shards for t in ts]
        got = [tails[i] for i in order]
        assert got == sorted(tails)
        for i in range(1, len(got)):
            a, b = got[i - 1], got[i]
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
            if a != b:
                assert lcp[i] == same
            else:
                assert lcp[i] >= same - 1


def _brute(texts, n):
    import re

    grams = {}
    words = [re.findall(r"[0-9a-z\u0080-￿]+", (t or "").lower()) for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - n + 1):
            grams.setdefault(tuple(w[i : i + n]), set()).add(d)
    out = set()
    for d, w in enumerate(words):
        on = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if len(grams[tuple(w[i : i + n])]) > 1:
                on[i : i + n] = True
        edge = np.flatnonzero(np.diff(np.append(np.append(0, on), 0)))
        # touching stretches are one
        out |= {(d, int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])}
    return out


def test_repeats_match_brute_force(make_docs):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [draw(n) for n in (49, 50, 51, 55, 60, 70, 90, 200, 400)]
    docs = []
    for i in range(90):
        w = draw(rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            s = list(rng.choice(shared))
            if rng.random() < 0.4 and len(s) > 60:
                s[rng.randrange(len(s))] = "edit"
            k = rng.randint(0, len(w))
            w[k:k] = s
        docs.append(" ".join(w))
    docs += ["orre " * 300, "orre " * 120 + "x", " ".join(draw(60) * 3)]
    rows = [(i, t, "en", "a") for i, t in enumerate(docs)]
    got = {(r.doc_id, r.start_word, r.n_words) for r in bwt.repeats(materialise(make_docs(rows).repartition(5))).collect()}
    assert got == _brute(docs, 50)


def test_repeats_on_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    number = {r.doc_id: i for i, r in enumerate(rows)}
    got = {(number[r.doc_id], r.start_word, r.n_words) for r in bwt.repeats(docs).collect()}
    want = _brute([r.text for r in rows], 50)
    assert want and got == want


def test_edge_cases(make_docs):
    w = " ".join(f"v{i}" for i in range(60))
    long = " ".join(f"z{i}" for i in range(40000))
    rows = [(1, w, "en", "a"), (None, "Before, " + w.upper() + "!", None, None), (3, None, "en", "a"), (4, "", "en", "a"), (5, "v1 v2", "en", "a"), (6, w + " " + w + " tail", "en", "a"), (7, long, "en", "a"), (7, long, "en", "a"), (8, "q " + " ".join(f"y{i}" for i in range(50)) * 1, "en", "a")]
    docs = make_docs([(*r, 1) for r in rows], ", rid int")
    got = sorted(((r.doc_id or -1, r.start_word, r.n_words, r.peer_doc_id or -1) for r in bwt.repeats(docs).collect()))
    assert [g[:3] for g in got] == [(-1, 1, 60), (1, 0, 60), (6, 0, 120), (7, 0, 40000), (7, 0, 40000)]
    assert all(g[3] in (-1, 1, 6) for g in got[:3]) and got[-1][3] == 7
    assert bwt.repeats(docs.where(F.lit(False))).count() == 0


def test_overlapping_parts_of_many_passages(make_docs):
    """Parts of passages cut anywhere, so that each pair of documents shares another stretch."""
    rng = random.Random(23)
    vocab = [f"u{i}" for i in range(400)]
    pool = [[rng.choice(vocab) for _ in range(160)] for _ in range(4)]
    docs = []
    for _ in range(160):
        w = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(110)
            w += p[a : a + rng.randint(30, 75)]
            w += [rng.choice(vocab) for _ in range(rng.choice((0, 0, 1, 3, 20)))]
        docs.append(" ".join(w))
    docs += docs[:12]
    rows = [(i, t, "en", "a") for i, t in enumerate(docs)]
    got = {(r.doc_id, r.start_word, r.n_words) for r in bwt.repeats(materialise(make_docs(rows).repartition(6))).collect()}
    assert got == _brute(docs, 50)


def test_shared_keys_are_judged_across_batches():
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted((rng.choice((1, 2, 3, 4, 5, 900)), rng.choice((7, 7, 7, 8, 9)), i) for i in range(300))
    rows = [r for r in rows if r[0] != 3 or r[1] == 7]
    for size in (1, 3, 50, 400):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), (pa.int64(), pa.int64(), pa.int32()))], ["key", "rid", "place"]) for i in range(0, len(rows), size)]
        got = {p: (r, peer) for b in bwt._shared(iter(batches)) for r, p, peer in zip(*(c.to_pylist() for c in b.columns))}
        rids = {}
        for k, r, _ in rows:
            rids.setdefault(k, set()).add(r)
        assert set(got) == {p for k, _, p in rows if len(rids[k]) > 1}
        assert all(peer != r and peer in rids[k] for k, r, p in rows if p in got for r, peer in [got[p]])
