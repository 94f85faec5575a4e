import random

import numpy as np
from pyspark.sql import functions as F

from srcgraph.llm import simhash

WORDS = [a + b for a in "ka lo mi ne pu ra so ti vu xe".split() for b in "ban cor dil fen gam hul".split()]


def _corpus(seed=5, n=60):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.randint(60, 200))] for _ in range(n)]
    rows = []
    for i, w in enumerate(base):
        rows.append((2 * i, " ".join(w), "en", "a"))
        if i % 3 == 0:
            v = list(w)
            for _ in range(2):
                v[rng.randrange(len(v))] = "edited"
            rows.append((2 * i + 1, " ".join(v).capitalize() + ".", "en", "b"))
    return rows


def _brute(texts):
    import pyarrow as pa

    from srcgraph.llm.common import raw_text

    row, sig = simhash.sign(*raw_text(pa.array([t.lower() for t in texts])))
    near = np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]).sum(axis=2) <= simhash.MAX_DISTANCE
    return row, near


def test_groups_match_brute_force(make_docs):
    rows = _corpus()
    got = {(r.doc_id, r.group_id) for r in simhash.groups(make_docs(rows)).collect()}
    row, near = _brute([r[1] for r in rows])
    lab = np.arange(len(row))
    for _ in range(len(row)):
        lab = np.where(near, lab[None, :], len(row)).min(axis=1)
    size = np.bincount(lab, minlength=len(row))
    want = {(rows[row[i]][0], rows[row[lab[i]]][0]) for i in range(len(row)) if size[lab[i]] > 1}
    assert want and got == want


def test_recall_of_pairs_on_a_dense_forest():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (4000, 2)).astype(np.uint64)
    flip = np.zeros((4000, 128), np.uint8)
    for i in range(4000):
        flip[i, rng.choice(128, 16, replace=False)] = 1
    sig = np.concatenate([base, base ^ np.packbits(flip, axis=1, bitorder="little").view(np.uint64)])
    depth, tries = simhash.shape(len(sig), simhash.RECALL)
    top = max(0, depth - simhash.CLIMB)
    found = set()
    for k in range(tries):
        key = simhash._keys(sig, k)
        place = key >> (simhash.KEY_BITS - top)
        for p in np.unique(place):
            at = np.flatnonzero(place == p)
            a, b = simhash.near_pairs(key[at], sig[at], top, depth, simhash.MAX_DISTANCE, keep_all=True)
            found |= {(min(x, y), max(x, y)) for x, y in zip(at[a].tolist(), at[b].tolist())}
    assert sum((i, i + 4000) in found for i in range(4000)) / 4000 >= 0.9


def test_recall_at_the_largest_distance_on_a_deep_forest(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE", 2)
    monkeypatch.setattr(simhash, "SMALL_NODE", 2)
    rng = np.random.default_rng(4)
    n = 4000
    base = rng.integers(0, 2**63, (n, 2)).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, 2)).astype(np.uint64)
    flip = np.zeros((n, 128), np.uint8)
    for i in range(n):
        flip[i, rng.choice(128, simhash.MAX_DISTANCE, replace=False)] = 1
    sig = np.concatenate([base, base ^ np.packbits(flip, axis=1, bitorder="little").view(np.uint64)])
    asked = []
    shape = simhash.shape
    monkeypatch.setattr(simhash, "shape", lambda *a: asked.append(shape(*a)) or asked[-1])
    rows = [(i, *s) for i, s in enumerate(sig.view(np.int64).tolist())]
    simhash.links(spark.createDataFrame(rows, "node long, s0 long, s1 long"))
    depth, tries = asked[0]
    assert depth >= 12
    top = max(0, depth - simhash.CLIMB)
    found = np.zeros(n, bool)
    for k in range(tries):
        key = simhash._keys(sig, k)
        order = np.argsort(key >> (simhash.KEY_BITS - top), kind="stable")
        place = (key >> (simhash.KEY_BITS - top))[order]
        cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        for lo, hi in zip(cut, np.append(cut[1:], len(place)), strict=True):
            at = order[lo:hi]
            a, b = simhash.near_pairs(key[at], sig[at], top, depth, simhash.MAX_DISTANCE, keep_all=True)
            x, y = at[a], at[b]
            found[np.minimum(x, y)[np.abs(x - y) == n]] = True
    assert found.mean() >= 0.93


def test_edge_cases(make_docs):
    long = " ".join(WORDS * 3000)
    rows = [(1, None, "en", "a", 7), (2, "", None, None, 7), (3, "%%% !!", "en", "a", 7), (None, long, "en", "a", 7), (5, long, "en", "a", None), (5, long, "en", "a", None), (6, "word", "en", "a", 1), (7, "Word!", "en", "a", 1), (8, "other", None, "a", 1)]
    docs = make_docs(rows, ", _rid int")
    got = sorted((r.doc_id or 0, r.group_id, r.n_docs, r.keep) for r in simhash.groups(docs).collect())
    assert got == [(0, 5, 3, False), (5, 5, 3, False), (5, 5, 3, True), (6, 6, 2, True), (7, 6, 2, False)]
    kept = simhash.keep_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6, 8]
    assert simhash.groups(docs.where(F.lit(False))).count() == 0
    assert simhash.keep_documents(docs.where(F.lit(False))).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100), (102, 100)], "u long, v long")
    got = {(r.u, r.v) for r in simhash.components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(101, 100), (102, 100)}
