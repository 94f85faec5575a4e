import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from srcgraph.llm import rules, toxicity, url_lm
from srcgraph.llm.common import raw_text


# ---------------------------------------------------------------- URLs
def _brute_log_prob(train, url, order):
    grams, follow = Counter(), defaultdict(set)
    pad = "\x02" * order
    for u in train:
        t = pad + u + "\x03"
        for i in range(order, len(t)):
            for n in range(order + 1):
                grams[t[i - n : i + 1]] += 1
                follow[t[i - n : i]].add(t[i])
    total = 0.0
    t = pad + url + "\x03"
    for i in range(order, len(t)):
        p = 1 / 256
        for n in range(order + 1):
            c = t[i - n : i]
            if follow.get(c):
                k = len(follow[c])
                size = sum(grams[c + x] for x in follow[c])
                p = (grams[c + t[i]] + k * p) / (size + k)
        total += math.log(p)
    return total / (len(url) + 1)


def test_markov_matches_brute_force():
    a = ["http://a.com/en/1", "http://ab.com/de/22", "http://a.com/x?q=1"]
    b = ["http://spam.com/win", "http://spam-win.com/1"]
    urls = a + b + ["", "http://zzz.org/é".replace("é", "e")]
    got = url_lm.score(pa.array(urls), url_lm.Markov(a, 3), url_lm.Markov(b, 3))
    want = [_brute_log_prob(b, u, 3) - _brute_log_prob(a, u, 3) for u in urls]
    assert np.allclose(got, want)


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, score string")


def test_url_filter(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("lo mi ren sta ver kon del".split()) for _ in range(3))
    good = [f"https://{word()}.example.com/en/{rng.randrange(9999)}" for _ in range(400)]
    bad = [f"http://{rng.choice(['spam-farm', 'casino-win', 'free-bets'])}.example.net/en/{rng.randrange(9999)}" for _ in range(100)]
    rows = [(i, u, None, "x") for i, u in enumerate(good + bad)]
    extra = [(1000, None, "h", None), (1001, "", None, None), (None, bad[0], None, None), (1003, "http://a.com/" + "x" * 200000, None, None), (0, good[0], None, "x")]
    got = url_lm.classify(_pages(spark, rows + extra)).collect()
    flag = defaultdict(list)
    for r in got:
        flag[r.page_id].append(r)
    assert len(got) == len(rows) + len(extra) and len({(r.score, r.rejected) for r in flag[0]}) == 1
    assert all(r.score is None and not r.rejected for k in (1000, 1001) for r in flag[k])
    assert flag[None][0].rejected
    assert sum(flag[i][0].rejected for i in range(400)) <= 8 and all(flag[i][0].rejected for i in range(400, 500))
    only_good = url_lm.classify(_pages(spark, rows[:50])).collect()
    assert len(only_good) == 50 and not any(r.rejected for r in only_good)
    assert url_lm.classify(_pages(spark, [])).count() == 0


def test_url_query_matches_brute_force(spark):
    """Seeds, halves, threshold and decisions of the whole query, with a tie at the threshold."""
    rng = random.Random(12)
    hosts = ["news.example.com", "shop-a.org", "spam.example.com", "my-casino.net", "ads.x.org", "adsl.org", "b.casinos.com"]
    rows = [(i, f"http://{rng.choice(hosts)}/{'abc'[i % 3]}/{rng.randrange(40)}", None, None) for i in range(160)]
    rows += [(1000 + i, r[1], None, None) for i, r in enumerate(rows[:40])]
    pages = _pages(spark, rows)
    order = [r.url for r in pages.orderBy(F.xxhash64("url"), "url").collect()]
    part = lambda u: [x for x in u.split("/")[2].replace("-", ".").split(".")]
    bad = [u for u in order if set(part(u)) & set(url_lm.SEEDS)]
    good = [u for u in order if not set(part(u)) & set(url_lm.SEEDS)]
    train = [u for i, u in enumerate(good) if i % 5]
    score = {u: _brute_log_prob(bad, u, url_lm.ORDER) - _brute_log_prob(train, u, url_lm.ORDER) for u in set(order)}
    held = sorted(score[u] for u in good[::5])
    cut = max(0.0, held[math.ceil((len(held) - 1) * (1 - url_lm.MAX_FALSE))])
    got = {r.page_id: r for r in url_lm.classify(pages).collect()}
    assert len(got) == len(rows) and any(score[u] == cut for u in good) or cut == 0
    for i, u, *_ in rows:
        assert abs(got[i].score - score[u]) < 2e-6
        if abs(score[u] - cut) > 1e-9:
            assert got[i].rejected == (score[u] > cut)
        else:
            assert not got[i].rejected
    assert any(r.rejected for r in got.values()) and not all(r.rejected for r in got.values())


def test_url_models_count_every_url(spark):
    """More URLs of a class than any sample took: one is most of the table, and each of its rows counts."""
    some = ["http://a.com/x", "http://b.org/y/1", "http://casino.b.org/y", "http://spam.a.com/1"]
    rows = [(i, some[0] if i < 70_000 else some[i % 4], None, None) for i in range(70_040)]
    pages = _pages(spark, rows)
    order = [r.url for r in pages.orderBy(F.xxhash64("url"), "url").select("url").collect()]
    good = [u for u in order if u in some[:2]]
    train = [u for i, u in enumerate(good) if i % 5]
    bad = [u for u in order if u in some[2:]]
    accepted, rejected = url_lm.Markov(train), url_lm.Markov(bad)
    want = dict(zip(some, url_lm.score(pa.array(some), accepted, rejected)))
    got = {r.url: r.score for r in url_lm.classify(pages).select("url", "score").distinct().collect()}
    assert len(got) == 4 and all(abs(got[u] - want[u]) < 1e-6 for u in some)


def test_url_ranks_over_many_buckets(spark, monkeypatch):
    """Held-out numbers of each URL and the threshold, with ranks that cross buckets and equal URLs."""
    monkeypatch.setattr(url_lm, "BUCKET", 16)
    rng = random.Random(7)
    rows = [(i, f"http://{rng.choice(['a', 'b', 'spam', 'pills'])}.com/{rng.randrange(300)}", None, None) for i in range(2000)]
    pages = _pages(spark, rows)
    order = [r.url for r in pages.orderBy(F.xxhash64("url"), "url").collect()]
    good = [u for u in order if u.split("/")[2] in ("a.com", "b.com")]
    held, every = Counter(good[::5]), Counter(order)
    got = {r.url: (r.good, r.bad, r.held) for r in url_lm.labelled(pages, url_lm.SEEDS).collect()}
    assert got == {u: ((n - held[u], 0, held[u]) if u in set(good) else (0, n, 0)) for u, n in every.items()}
    accepted = url_lm.Markov([u for i, u in enumerate(good) if i % 5])
    rejected = url_lm.Markov([u for u in order if u not in set(good)])
    for f in (0.002, 0.1, 0.5):
        _, threshold = url_lm.fit(pages, max_false=f)
        s = url_lm.score(pa.array(good[::5]), accepted, rejected)
        assert abs(threshold - max(0.0, np.quantile(s, 1 - f, method="higher"))) < 1e-12


def test_value_at_a_rank(spark):
    x = np.array([-2.5, -1e-300, 0.0, 1e-9, 1e-9, 0.3, 0.3000000001, 7.0])
    n = [1, 2, 1, 3, 1, 1, 2, 1]
    each = np.repeat(x, n)
    values = spark.createDataFrame(list(zip(url_lm._place(x).tolist(), n)), "place long, n long")
    assert [url_lm._at_rank(values, k) for k in range(len(each))] == each.tolist()


def test_url_grams_are_settled_in_parts(tmp_path, monkeypatch):
    """Files written from batches that cut pairs anywhere, and whatever is held, give the scores of the two models."""
    rng = random.Random(4)
    urls = sorted({f"http://{rng.choice('ab')}{rng.randrange(30)}.com/{rng.randrange(50)}" for _ in range(300)})
    good, bad = [rng.randrange(3) for _ in urls], [rng.randrange(2) for _ in urls]
    models = [url_lm.Markov([u for u, k in zip(urls, n) for _ in range(k)]) for n in (good, bad)]
    want = url_lm.score(pa.array([*urls, "", None]), *models)[: len(urls)]
    for held in (10, 100, 1 << 18):
        monkeypatch.setattr(url_lm, "HELD", held)
        batches = [pa.RecordBatch.from_arrays([pa.array(urls[i : i + 7]), pa.array(good[i : i + 7]), pa.array(bad[i : i + 7])], ["url", "good", "bad"]) for i in range(0, len(urls), 7)]
        total = Counter(), Counter()
        for b in url_lm._count_batches(url_lm.ORDER)(iter(batches)):
            for g, *n in zip(*(c.to_pylist() for c in b.columns)):
                for t, k in zip(total, n):
                    t[g] += k
        rows = sorted((g >> 8 & 0xFFFF, g, total[0][g], total[1][g]) for g in total[0])
        low = tuple(url_lm.Markov.of(np.array([*t], np.uint64), np.array([*t.values()]), 1) for t in ({k: sum(n for g, n in t.items() if g & 0xFFFF == k) for k in {g & 0xFFFF for g in t}} for t in total))
        places = {}
        for i, r in enumerate(rows):
            places.setdefault(r[0], i)
        path = tmp_path / f"{held}"
        path.write_bytes(b"\0" * 16 * len(rows))
        parts = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 13])], ["pair", "gram", "good", "bad"]) for i in range(0, len(rows), 13)]
        assert [b.column(0).to_pylist() for b in url_lm._write_batches(str(path), places, len(rows), url_lm.ORDER, low)(iter(parts))] == [[len(rows)]]
        ratio = url_lm.Ratio(str(path), len(rows), url_lm.ORDER)
        assert np.allclose(ratio.score(pa.array([*urls, "", None]))[: len(urls)], want, atol=1e-12)


# ---------------------------------------------------------------- toxicity
def test_toxicity_query_matches_brute_force(spark, sf):
    """Every row of the query from the model, word by word; equal grades go to the lowest."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    for r in docs.collect():
        n = Counter(re.findall(r"[0-9a-z\u0080-\uffff]+", r.text.lower()))
        dims = Counter()
        for word, times in n.items():
            _, dim, _ = toxicity.counts(*raw_text(pa.array([word])))
            dims[int(dim[0])] += times
        s = sum(float(model.weights[d]) * math.log1p(k) for d, k in dims.items())
        over = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        share = [a - b for a, b in zip([1.0, *over], [*over, 0.0])]
        assert abs(got[r.doc_id].expected_severity - sum(over)) < 1e-4
        assert share[got[r.doc_id].grade] > max(share) - 1e-5 and got[r.doc_id].toxic == (over[0] >= 0.5)


def test_equal_ids_do_not_widen_the_sample(spark, make_docs):
    rows = [(i, f"fine words {i}" if i % 2 else f"scoundrel {i}", "en", "a") for i in range(40)]
    labels = _labelled(spark, [(i, i % 2, 1 - i % 2, None) for i in range(40)])
    one, many = make_docs(rows), make_docs(rows + rows[:20] * 30)
    a, b = toxicity.train(one, labels), toxicity.train(many, labels)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.thresholds, b.thresholds)
    assert rules.train(one, labels) == rules.train(many, labels)


def test_ordinal_fit_reaches_the_optimum_of_a_plain_descent():
    rng = np.random.default_rng(1)
    n, m = 600, 4
    x = (rng.random((n, m)) < 0.4).astype(float)
    s = x @ np.array([2.0, 1.0, 0.0, -1.0]) + rng.logistic(size=n)
    y = np.digitize(s, [0.5, 1.5, 2.5])
    row, col = np.nonzero(x)
    w, t = toxicity.fit_ordinal(row, col, np.ones(len(row)), y, m, lasso=1e-3, steps=3000)

    def loss(w, t):
        e = np.concatenate([[-np.inf], t, [np.inf]])
        f = lambda z: 1 / (1 + np.exp(-z))
        z = x @ w
        return -np.log(f(e[y + 1] - z) - f(e[y] - z)).mean() + 1e-3 * np.abs(w).sum()

    assert (np.diff(t) > 0).all() and abs(w[2]) < 0.3
    base = loss(w, t)
    for _ in range(300):
        dw, dt = rng.normal(size=m) * 0.05, rng.normal(size=3) * 0.05
        assert loss(w + dw, np.sort(t + dt)) > base - 1e-4


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.score(docs, labels.where("doc_id % 5 <> 1"))
    held = [(r.toxic, r.real) for r in model.join(labels.where("doc_id % 5 = 1").select("doc_id", F.col("toxic").alias("real")), "doc_id").collect()]
    assert sum(a == (b == 1) for a, b in held) / len(held) > 0.97
    again = toxicity.score(docs.repartition(7), labels.where("doc_id % 5 <> 1"))
    assert sorted(map(tuple, model.collect())) == sorted(map(tuple, again.collect()))


def _labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, keep int")


def test_classifier_edge_cases(spark, make_docs):
    rows, marks = [], []
    rng = random.Random(4)
    for i in range(120):
        w = [rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(30)]
        bad = i % 3 == 0
        if bad:
            w[3:3] = ["scoundrel"] * (1 + i % 4)
        rows.append((i, " ".join(f"{x}%%%" if bad else x for x in w), "en", "a"))
        marks.append((i, 0 if bad else 1, 1 if bad else 0, 5))
    rows += [(200, None, None, None), (201, "", "en", "a"), (None, "alpha scoundrel%%%", "en", "a"), (203, "alpha beta " * 60000 + "scoundrel", "en", "a"), (0, rows[0][1], "en", "a")]
    marks += [(None, 1, 1, None), (5, None, None, None), (0, 0, 1, None), (0, 1, 0, None)]
    docs, labels = make_docs([(*r, True) for r in rows], ", keep boolean"), _labelled(spark, marks)
    got = defaultdict(list)
    for r in toxicity.score(docs, labels).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i][0].toxic == (i % 3 == 0) for i in range(120)) and got[0][0] == got[0][1]
    assert not got[200][0].toxic and got[200][0].expected_severity == got[201][0].expected_severity
    assert got[None][0].toxic and got[203][0].toxic
    kept = defaultdict(list)
    for r in rules.classify(docs, labels).collect():
        kept[r.doc_id].append(r)
    assert sum(map(len, kept.values())) == len(rows) and all(kept[i][0].keep == (i % 3 != 0) for i in range(120))
    for f, args in ((toxicity.score, (False, 0.0)), (rules.classify, (True, 1.0))):
        plain = f(docs, labels.where("false")).collect()
        assert len(plain) == len(rows) and {tuple(r)[-1] for r in plain} == {args[0]}
        assert f(docs.where("false"), labels).count() == 0


# ---------------------------------------------------------------- rules
def test_compiled_rules_match_the_model(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = rules.train(docs, labels.where("doc_id % 2 = 0"))
    rows = rules.statistics(docs).select("doc_id", model.column().alias("p"), *[f"_s_{s}" for s in rules.STATS]).toPandas()
    x = rows[[f"_s_{s}" for s in rules.STATS]].to_numpy()
    assert np.allclose(rows["p"], 1 / (1 + np.exp(-model.margin(x))), atol=1e-6)
    held = rows.merge(labels.where("doc_id % 2 = 1").toPandas(), on="doc_id")
    assert ((held["p"] >= 0.5) == (held["quality"] == 1)).mean() > 0.95


def test_query_matches_the_rules_row_by_row(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = rules.train(docs, labels)
    got = {r.doc_id: r for r in rules.classify(docs, labels).collect()}
    stats = rules.statistics(docs.select("doc_id", "text")).collect()
    for r in stats:
        x = {i: r[f"_s_{s}"] for i, s in enumerate(rules.STATS)}
        z = model.intercept + sum(w for q, w in model.rules if all((x[f] > t) == above for f, t, above in q.terms))
        p = 1 / (1 + math.exp(-z))
        assert abs(got[r.doc_id].quality_score - p) < 1e-6 and got[r.doc_id].keep == (got[r.doc_id].quality_score >= 0.5)
    assert len(got) == len(stats)
    # a score of exactly the bar is kept
    even = rules.Ensemble(0.0, [])
    row = docs.limit(1).select(even.column().alias("s")).withColumn("keep", F.col("s") >= rules.KEEP).first()
    assert row.s == 0.5 and row.keep


def test_statistics_match_brute_force(make_docs):
    text = "Ab cd ab.\nAb cd ab.\nXy 12 %% Été"
    r = rules.statistics(make_docs([(1, text, "en", "a")])).first()
    words = ["ab", "cd", "ab", "ab", "cd", "ab", "xy", "12", "été"]
    n = len(text)
    want = [n, 9, sum(map(len, words)) / 9, 3 / n, 2 / n, 2 / n, 2 / n, 5 / 9, 2 / 3, 3]
    assert np.allclose([r[f"_s_{s}"] for s in rules.STATS], np.round(want, 4))


def test_lasso_is_optimal():
    rng = np.random.default_rng(5)
    z = (rng.random((500, 6)) < 0.5).astype(float)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * z[:, 0] - 2 * z[:, 1])))).astype(float)
    b, w = rules.lasso_logistic(z, y, 0.01, 4000)
    g = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / len(y)
    assert np.all(np.abs(g[w == 0]) <= 0.0101) and np.allclose(g[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-4)
