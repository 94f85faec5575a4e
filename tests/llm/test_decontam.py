import random

import pytest
from pyspark.sql import functions as F

from srcgraph.llm import decontam

ITEM = "Anna buys 3 kg of apples for Ben and pays 12 dollars while Ben keeps 3 of them in the large cellar until winter comes again."


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, ITEM), (2, "the old mill near the river grinds very little wheat in a dry summer"), (3, "too short"), (4, None), (5, "only five literal words here")]
    return spark.createDataFrame(rows, "item_id long, text string")


def _ids(df):
    return sorted((r.doc_id or -1, r.item_id) for r in df.collect())


DOCS = [
    (1, "Some text before. " + ITEM + " And some after.", "en", "a"),
    (2, "Before it. Carl buys 7 lb of apples for Dora and pays 40 euros while Dora keeps 7 of them in the large cellar until winter comes again.", "en", "a"),
    (3, "x Carl buys 7 lb of apples for Dora and pays 40 euros while Emil keeps 9 of them in the large cellar until winter comes again.", "en", "a"),
    (4, "The old mill near the river grinds very little wheat in a dry summer", "en", "a"),
    (5, "an old mill is near this river and grinds its wheat in summer", "en", "a"),
    (6, None, "en", "a"),
    (7, "", None, None),
    (8, "Only five literal words here!", "en", "a"),
    (None, ITEM, "en", "a"),
    (9, "pad " * 20000 + ITEM, "en", "a"),
    (9, "pad " * 20000 + ITEM, "en", "a"),
    (10, "too short", "en", "a"),
]
WANT = [(-1, 1), (1, 1), (2, 1), (4, 2), (8, 5), (9, 1), (9, 1)]


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["broadcast", "shuffled"])
def test_templates(make_docs, bench, limit):
    docs = make_docs([(*r, 1) for r in DOCS], ", rid int")
    assert _ids(decontam.leaks(docs, bench, min_agree=0.9, limit=limit)) == WANT
    kept = decontam.keep_documents(docs, bench, min_agree=0.9, limit=limit)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 10]


def test_both_ways_agree_and_empty_tables(spark, make_docs, sf, bench):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    real = spark.read.parquet(f"{sf}/benchmark.parquet")
    a, b = decontam.leaks(docs, real), decontam.leaks(docs, real, limit=0)
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, b.collect()))
    # brute force: the words of an item in a row
    items = [(r.item_id, " ".join(r.text.lower().split())) for r in real.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items if t in " ".join(d.text.lower().split())}
    assert want <= {(r[0], r[1]) for r in rows}
    assert decontam.leaks(docs.where(F.lit(False)), real).count() == 0
    assert decontam.leaks(make_docs(DOCS), bench.where(F.lit(False))).count() == 0
    assert decontam.leaks(make_docs(DOCS), bench.where(F.lit(False)), limit=-1).count() == 0


def test_texts_without_a_match(make_docs, bench):
    rows = [(i, "nothing of it is in here at all, only other words of no use to anyone", "en", "a") for i in range(5)]
    assert decontam.leaks(make_docs(rows), bench).collect() == []
    assert decontam.keep_documents(make_docs(rows), bench).count() == 5


def test_canonical_kinds():
    import pyarrow as pa

    from srcgraph.llm.common import raw_text

    tok = decontam.Tokens(*raw_text(pa.array(["We saw Max. He ran 5 km and Éva 12.", None, "Miles away"])))
    assert tok.kind.tolist() == [0, 0, 3, 0, 0, 1, 2, 0, 3, 1, 0, 0]


def test_random_edits_are_caught(make_docs, bench):
    rng = random.Random(1)
    rows = []
    for i in range(20):
        w = ITEM.split()
        w[rng.randrange(len(w))] = "zzz"
        rows.append((i, "intro words first. " + " ".join(w), "en", "a"))
    assert len({r.doc_id for r in decontam.leaks(make_docs(rows), bench).collect()}) >= 18


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["broadcast", "shuffled"])
def test_variants_beside_each_other(make_docs, bench, limit):
    other = "Carl buys 7 lb of apples for Dora and pays 40 euros while Dora keeps 7 of them in the large cellar until winter comes again."
    third = "Emil buys 9 oz of apples for Fred and pays 55 cents while Fred keeps 9 of them in the large cellar until winter comes again."
    wrong = "Carl buys 7 lb of apples for Dora and pays 40 euros while Emil keeps 9 of them in the large cellar until winter comes again."
    docs = make_docs([(1, f"{ITEM} {other}", "en", "a"), (2, f"{other} And so. {third} {ITEM}", "en", "a"), (3, f"{wrong} {wrong}", "en", "a"), (4, f"{other} {third}", "en", "a")])
    got = decontam.leaks(docs, bench, min_agree=0.9, limit=limit)
    assert _ids(got) == [(1, 1), (2, 1), (4, 1)]
    assert all(r.agreement >= 0.9 and r.cover >= 0.5 for r in got.collect())


def test_items_of_many_numbers_are_found_in_both_ways(spark, make_docs):
    rows = [(1, "is 3 more than 4 5 6 7"), (2, "add 1 2 3 to 4 now"), (3, "11 12 13 14 15 16 17 18 19 20"), (4, "the number 4 is more than the number 3 here")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    docs = make_docs([(i, f"Some words before. {t} and some after", "en", "a") for i, t in rows] + [(9, "is 3 more than 4 5 6 8 add 1 2 3 to 5 now", "en", "a")])
    got = [sorted(map(tuple, decontam.leaks(docs, bench, limit=limit).collect())) for limit in (1 << 20, 0)]
    assert got[0] == got[1]
    assert [r[:2] for r in got[0]] == [(i, i) for i, _ in rows]


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["broadcast", "shuffled"])
def test_names_that_open_sentences(spark, make_docs, limit):
    item = "Tom has 12 marbles and gives 5 of them to Ann. Ann then buys 7 more marbles at the market near her house."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    swapped = item.replace("Tom", "Kim").replace("Ann", "Sue")
    mixed = "Kim has 12 marbles and gives 12 of them to Sue. Eva then buys 12 more marbles at the market near her house."
    docs = make_docs([(1, f"A start. {swapped} An end.", "en", "a"), (2, item, "en", "a"), (3, f"so {item}", "en", "a"), (4, mixed, "en", "a")])
    got = {r.doc_id: r for r in decontam.leaks(docs, bench, limit=limit).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1].cover == got[2].cover == 1 and got[1].agreement == 1


def _forms(tok, n):
    """Windows of one text by form: (place, what it looks like), word by word."""
    m, rows = len(tok.kind), {0: [], 1: [], 2: []}
    for i in range(m - n + 1):
        kind, mark, value = tok.kind[i : i + n].tolist(), tok.mark[i : i + n].tolist(), tok.value[i : i + n].tolist()
        if 2 * kind.count(0) >= n:
            rows[decontam.TEMPLATE].append((i, tuple((k, 0 if k else v) for k, v in zip(kind, value))))
        if 4 in mark and 2 * mark.count(0) >= n:
            rows[decontam.OPEN].append((i, tuple((k, 0 if k else v) for k, v in zip(mark, value))))
        rows[decontam.EXACT].append((i, tuple(value)))
    return rows


def test_all_rows_match_brute_force(spark, sf):
    """Every column of every row, from windows compared as tuples instead of hashes."""
    import numpy as np
    import pyarrow as pa

    from srcgraph.llm.common import raw_text

    docs, real = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = sorted(map(tuple, decontam.leaks(docs, real).collect()))
    known, items = {}, {}
    for r in real.collect():
        tok = decontam.Tokens(*raw_text(pa.array([r.text])))
        n = decontam.WINDOW if len(tok.kind) >= decontam.WINDOW else len(tok.kind)
        if n < decontam.MIN_ITEM:
            continue
        by = _forms(tok, n)
        forms = [f for f in (decontam.TEMPLATE, decontam.OPEN) if by[f]] or [decontam.EXACT]
        items[r.item_id] = (tok, n, len({i for f in forms for i, _ in by[f]}))
        for f in forms:
            for i, w in by[f]:
                known.setdefault((n, f, w), []).append((r.item_id, i))
    want = []
    for d in docs.collect():
        tok, met = decontam.Tokens(*raw_text(pa.array([d.text]))), {}
        for n in {n for _, n, _ in items.values()}:
            for f, rows in _forms(tok, n).items():
                for j, w in rows:
                    for item, i in known.get((n, f, w), ()):
                        met.setdefault(item, []).append((i, j))
        for item, pairs in met.items():
            mine, n, total = items[item]
            pos, at = (np.array(x) for x in zip(*pairs))
            span = np.arange(n)
            r = decontam.judge(total, pos, at, mine.mark[pos[:, None] + span], mine.value[pos[:, None] + span], tok.value[at[:, None] + span], decontam.MIN_COVER, decontam.MIN_AGREE)
            if r:
                want.append((d.doc_id, item, r[0], round(r[0] / total, 6), round(r[1], 6)))
    assert got == sorted(want) and len(got) >= 3


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["broadcast", "shuffled"])
def test_ids_of_any_type_and_windows_without_literals(spark, make_docs, limit):
    bench = spark.createDataFrame([("x-1", "alpha beta gamma 1 2 3 4 5"), (None, ITEM)], "item_id string, text string")
    docs = make_docs([(1, "say alpha beta gamma 7 8 9 10 11 and done", "en", "a"), (2, "say alpha beta gamma 1 2 3 4 5 and done", "en", "a"), (3, ITEM, "en", "a")])
    got = [(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, limit=limit).collect()]
    # three literals of eight: searched by its exact words in both ways
    assert sorted(got, key=str) == [(2, "x-1"), (3, None)]
