from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa

import corpus_pipeline
from srcgraph.llm import decontam, divergence, mixing, pii, simhash
from srcgraph.llm.common import raw_text


def _leaks(text, items):
    """Whether a text holds an item, by comparing all windows one by one."""
    tok = decontam.Tokens(*raw_text(pa.array([text])))
    shape = tok.shape.tolist()
    for item in items:
        it = decontam.Tokens(*raw_text(pa.array([item])))
        mine = it.shape.tolist()
        n = decontam.WINDOW if len(mine) >= decontam.WINDOW else len(mine)
        if n < decontam.MIN_ITEM:
            continue
        spots = [i for i in range(len(mine) - n + 1) if 2 * sum(k == 0 for k in it.kind[i : i + n]) >= n]
        pairs, found = set(), set()
        for i in spots:
            for j in range(len(shape) - n + 1):
                if shape[j : j + n] == mine[i : i + n]:
                    found.add(i)
                    pairs |= {(i + k, j + k) for k in range(n) if it.kind[i + k]}
        if not found or len(found) < decontam.MIN_COVER * len(spots):
            continue
        fills = [(int(it.value[a]), int(tok.value[b])) for a, b in pairs]
        best = []
        for side in (0, 1):
            of = {}
            for f in fills:
                of.setdefault(f[side], Counter())[f[1 - side]] += 1
            best.append(sum(c.most_common(1)[0][1] for c in of.values()))
        if not fills or min(best) / len(fills) >= decontam.MIN_AGREE:
            return True
    return False


def _brute(docs, items):
    db = duckdb.connect()
    db.register("documents", docs)
    keep = {r[0] for r in db.sql(f"SELECT doc_id FROM ({divergence.oracle_sql()}) WHERE keep").fetchall()}
    docs = docs[docs.doc_id.isin(keep)].reset_index(drop=True)
    row, sig = simhash.sign(*raw_text(pa.array([t.lower() for t in docs.text])))
    near = np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]).sum(axis=2) <= simhash.MAX_DISTANCE
    group = np.arange(len(row))
    for _ in range(len(row)):
        new = np.where(near, group[None, :], len(row)).min(axis=1)
        if (new == group).all():
            break
        group = new
    ids = docs.doc_id.to_numpy()[row]
    gone = {int(i) for i, g in zip(ids, group) if i != ids[group == g].min()}
    docs = docs[~docs.doc_id.isin(gone)]
    docs = docs[[not _leaks(t, items) for t in docs.text]].copy()
    model = pii.train()
    docs["text"] = [pii.redacted(t, pii.entities(t, model)) for t in docs.text]
    docs["n_chars"] = docs.text.str.len()
    db.register("left_over", docs)
    level = dict(db.sql(f"SELECT doc_id, level FROM ({mixing.oracle_sql('left_over')})").fetchall())
    docs = docs[docs.doc_id.isin(level)]
    return sorted((int(r.doc_id), r.text, r.lang, r.source, int(r.n_chars), level[r.doc_id]) for r in docs.itertuples())


def test_pipeline_matches_brute_force(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_level"]
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    items = pd.read_parquet(f"{sf}/benchmark.parquet").text.tolist()
    assert sorted(map(tuple, got.collect())) == _brute(docs, items)


def test_stages_keep_the_columns(spark, sf, make_docs):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = make_docs([(1, "some words that stay", "en", "a", 1, "x"), (None, None, None, None, None, None)], ", _rid int, mix_level string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert stage(spark, docs.where("false"), sf).count() == 0
    assert "mix_level_" in out.columns


def test_a_task_holds_one_python_worker(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    kept = divergence.keep_documents(docs)
    # a second kernel in the same task would take a second worker, as large as the first
    assert plan(kept).count("ArrowEvalPython") == 1
    want = [r.doc_id for r in divergence.quality(docs).collect() if r.keep]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    # rows made of Python values would take another daemon with workers of its own
    found = decontam._found(docs, items, decontam.WINDOW, decontam.MIN_COVER, decontam.MIN_AGREE, decontam.MIN_ITEM, decontam.BROADCAST_WINDOWS)
    assert "ExistingRDD" not in plan(found)
    assert {r.item_id for r in found.collect()} == {r.item_id for r in decontam.leaks(docs, items, limit=0).collect()} != set()
