import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from srcgraph.llm import divergence, mixing

EN = "the cat of the house and the dog in a garden that was by the river with all of it to be seen from here, is it not. "


def _duck(rows, sql):
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    return db.sql(sql).fetchall()


CASES = [(i, EN * (4 + i % 3), "en", "a" if i % 2 else "b") for i in range(30)]
CASES += [
    (100, "%%% $$$ " * 200 + EN * 3, "en", "a"),
    (101, "THE CAT!! OF THE!! HOUSE!! " * 30, "en", "a"),
    (102, "orre " * 200, "en", None),
    (103, None, "en", "a"),
    (104, "", None, "a"),
    (105, "short one", "en", "b"),
    (106, "  \t\n", "en", "b"),
    (None, EN * 4, "en", "b"),
    (None, EN * 5, None, "b"),
    (107, EN * 9000, "en", "a"),
    (1, CASES[1][1], "en", "a"),
    (1, CASES[1][1], "en", "a"),
    (108, "слово и дело " * 40, "ru", "c"),
    (109, "Été ÉTÉ l’été «à» 3×4 ÷ ½ ª µ ﬁ 中文 한글 😀 𝒳y Ǆ " * 12, "fr", "c"),
    (110, "12 34 | %% " * 200, "en", "c"),
    (111, "word " * 39 + "%%%% " * 200, "en", "c"),
]


def _norm(rows):
    return sorted(tuple("" if v is None or v != v else str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)


def test_divergence_cases(make_docs):
    docs = make_docs([(*r, "k") for r in CASES], ", keep string")
    got = divergence.quality(docs)
    cols = ["doc_id", "lang", "n_chars", "n_words", "char_distance", "word_distance", "reason", "keep"]
    assert got.columns == cols
    assert _norm(got.collect()) == _norm(_duck(CASES, f"SELECT {', '.join(cols)} FROM ({divergence.oracle_sql()})"))
    why = {r.doc_id: r.reason for r in got.collect()}
    assert [why[i] for i in (100, 101, 102, 103, 104, 105, 106, 107, 0)] == ["characters", "characters", "words", "empty", "empty", "short", "empty", None, None]
    kept = divergence.keep_documents(docs)
    assert kept.columns == docs.columns
    want = sorted(str(r.doc_id) for r in got.collect() if r.keep)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert divergence.quality(docs.where(F.lit(False))).count() == 0 and divergence.keep_documents(docs.where(F.lit(False))).count() == 0


def test_mixing_cases(make_docs):
    docs = make_docs([(*r, 1, 2) for r in CASES], ", level int, _hash int")
    sql = mixing.oracle_sql()
    got = mixing.mix(docs)
    assert _norm(got.select("doc_id", "source", "tokens", "level").collect()) == _norm(_duck(CASES, f"SELECT doc_id, source, tokens, level FROM ({sql})"))
    out = mixing.apply_mix(docs, mixing.thresholds(docs), "mix_level")
    assert out.columns == [*docs.columns, "mix_level"] and out.count() == got.count()
    none = docs.where(F.lit(False))
    assert mixing.mix(none).count() == 0 and mixing.mix(none, {"a": 1.0}).count() == 0
    for weights, rest in (({"a": 3.0, "b": 0.5}, 1.0), ({"a": 1.0}, 0.0), ({"zzz": 1.0}, 0.0)):
        sql = mixing.oracle_sql(weights=weights, default_weight=rest)
        got = mixing.mix(docs, weights, default_weight=rest)
        assert _norm(got.select("doc_id", "source", "tokens", "level").collect()) == _norm(_duck(CASES, f"SELECT doc_id, source, tokens, level FROM ({sql})"))


def test_mixing_many_sources_and_shuffled_boundaries(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    rows = [(i, "w " * (1 + i * 5 % 17), "en", f"d{i % 60}") for i in range(900)]
    got = mixing.mix(make_docs(rows))
    assert _norm(got.collect()) == _norm(_duck(rows, f"SELECT doc_id, source, tokens, level FROM ({mixing.oracle_sql()})"))


@pytest.mark.parametrize("total", [None, 3000])
def test_mixing_weights_against_brute_force(make_docs, total):
    rows = [(i, "w " * (1 + i * 7 % 23), "en", "abc"[i * i % 3]) for i in range(400)]
    docs = make_docs(rows)
    weights, budgets = {"a": 2.0, "b": 1.0}, (0.3, 1.0)
    got = {r.doc_id: r.level for r in mixing.mix(docs, weights, total, budgets).collect()}
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", mixing.doc_hash(F.col("doc_id")).alias("h")).collect()}
    tokens = {i: len(t.split()) for i, t, _, _ in rows}
    source = {i: s for i, _, _, s in rows}
    have = {s: sum(tokens[i] for i in tokens if source[i] == s) for s in "ab"}
    size = total or min(have["a"] / (2 / 3), have["b"] / (1 / 3))
    want = {}
    for s, share in (("a", 2 / 3), ("b", 1 / 3)):
        at = 0
        for i in sorted((i for i in tokens if source[i] == s), key=hashes.get):
            at += tokens[i]
            for k, f in enumerate(budgets, 1):
                if at <= int(size * share * f + 1e-6):
                    want[i] = k
                    break
    assert got == want
