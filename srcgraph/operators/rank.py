"""Ranked and hybrid symbol search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from srcgraph.functions import scalar as S
from srcgraph.operators import fts
from srcgraph.operators.lookup import distinct_symbols

LIMIT = 50
LEAST_SEMANTIC = 0.08


def _limit(n: int) -> int:
    return n if n > 0 else LIMIT


def score_topk(symbols: DataFrame, query: str, kind: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Symbols whose name matches, best first."""
    rows = symbols if kind is None else symbols.where(F.col("kind") == kind)
    rows = rows.withColumn("score", S.match_score(F.col("name"), query)).where("score > 0")
    return rows.orderBy(F.desc("score"), "path", "ord").limit(_limit(limit))


def ranked(symbols: DataFrame, post: DataFrame, query: str, kind: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Full-text hits, topped up by name matches while there are fewer than ``limit``; by score, then arrival.

    Adds ``score`` and ``rank``. Hits of the index alone keep their place at the bottom.
    """
    limit, q = _limit(limit), query.strip()
    base = distinct_symbols(fts.search(symbols, post, q, kind, limit)).withColumn("src", F.lit(0))
    rows = symbols if kind is None else symbols.where(F.col("kind") == kind)
    score = S.match_score(F.col("name"), q)
    # at most ``limit`` of the best are in the base already
    more = distinct_symbols(rows.where(score > 0)).withColumn("src", F.lit(1)).orderBy(F.desc(score), "path", "ord").limit(2 * limit)
    rest = [c for c in symbols.columns if c not in ("path", "name", "kind", "line")]
    one = base.unionByName(more).groupBy("path", "name", "kind", "line").agg(F.min(F.struct("src", *rest)).alias("_f")).select("path", "name", "kind", "line", "_f.*")
    # a few times ``limit`` rows are left, so one task ranks them; a full base needs no top-up
    whole = W.partitionBy(F.lit(0))
    one = one.withColumns({"score": score, "_n": F.count_if(F.col("src") == 0).over(whole)}).where((F.col("src") == 0) | (F.col("_n") < limit))
    rank = F.row_number().over(whole.orderBy(F.desc("score"), "src", "path", "ord"))
    return one.withColumn("rank", rank).where(F.col("rank") <= limit).select(*symbols.columns, "score", "rank")


def _counted(symbols: DataFrame) -> DataFrame:
    """``symbols`` plus _toks, the tokens of the semantic text of each."""
    return symbols.withColumn("_toks", S.semantic_tokens(S.semantic_text("name", "signature", "parent", "path")))


def _exploded(counted: DataFrame) -> DataFrame:
    """(path, ord, token, tf), counted within each row."""
    one = counted.select("path", "ord", "_toks", F.explode(F.array_distinct("_toks")).alias("token"))
    return one.select("path", "ord", "token", F.size(F.filter("_toks", lambda x: x == F.col("token"))).cast("bigint").alias("tf"))


def corpus_tokens(symbols: DataFrame) -> DataFrame:
    """(path, ord, token, tf) of the semantic text of each symbol; (path, ord) is a key of ``symbols``."""
    return _exploded(_counted(symbols))


def document_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def norms(tokens: DataFrame, df: DataFrame, n: DataFrame) -> DataFrame:
    """(path, ord, norm): lengths of tf-idf vectors of (path, ord, token, tf), with (token, df) and one row (_n) of the whole corpus."""
    w = tokens.join(df, "token").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * idf(F.col("_n"), F.col("df")))
    return w.groupBy("path", "ord").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


@dataclass
class Weights:
    """What a store keeps of all distinct symbols: ``tokens`` (token, path, ord, tf, df) by token, ``norms`` (path, ord, norm), ``total`` (_n)."""

    tokens: DataFrame
    norms: DataFrame
    total: DataFrame


def weights(symbols: DataFrame) -> Weights:
    rows = distinct_symbols(symbols)
    tokens, n = corpus_tokens(rows), rows.agg(F.count("*").alias("_n"))
    df = document_frequency(tokens)
    return Weights(tokens.join(df, "token").select("token", "path", "ord", "tf", "df"), norms(tokens, df, n), n)


def hybrid(symbols: DataFrame, post: DataFrame, query: str, kind: str | None = None, limit: int = LIMIT, weights: Weights | None = None) -> DataFrame:
    """0.6 keyword + 0.4 tf-idf cosine, best first; adds hybrid, semantic, keyword and rank.

    Frequencies are those of the distinct symbols of ``kind``; ``weights`` are those
    of all kinds, where they are kept. An empty query is a ranked search.
    """
    limit, q = _limit(limit), query.strip()
    if not q:
        return ranked(symbols, post, query, kind, limit)
    spark = symbols.sparkSession
    rows = distinct_symbols(symbols if kind is None else symbols.where(F.col("kind") == kind))
    hits = fts.search(symbols, post, q, kind, limit).select("path", "name", "kind", "line").distinct().withColumn("hit", F.lit(True))
    # a query is a handful of tokens
    words = spark.range(1).select(S.semantic_tokens(F.lit(q)).alias("t")).first().t or []
    asked = spark.createDataFrame([(t, words.count(t)) for t in dict.fromkeys(words)], "token string, qtf bigint")
    among = F.col("token").isin(list(dict.fromkeys(words)))
    # only symbols that hold one of them have a cosine above 0
    if kind is None and weights is not None:
        n, mine = weights.total, weights.tokens.where(among)
        df, length = mine.select("token", "df").distinct(), weights.norms
    else:
        n, counted = rows.agg(F.count("*").alias("_n")), _counted(rows)
        all_df = document_frequency(_exploded(counted))
        near = _exploded(counted.where(F.arrays_overlap("_toks", F.array(*map(F.lit, words)).cast("array<string>"))))
        mine, df, length = near.where(among), all_df.where(among), norms(near, all_df, n)
        mine = mine.join(F.broadcast(df), "token")
    # a query token that no symbol has still lengthens the query, at df 0
    qw = F.col("qtf") * idf(F.col("_n"), F.coalesce("df", F.lit(0)))
    query_length = asked.join(df, "token", "left").crossJoin(n).agg(F.sqrt(F.sum(qw * qw)).alias("qnorm"))
    each = mine.join(F.broadcast(asked), "token").crossJoin(F.broadcast(n)).withColumn("idf", idf(F.col("_n"), F.col("df")))
    dot = each.groupBy("path", "ord").agg(F.sum(F.col("tf") * F.col("idf") * F.col("qtf") * F.col("idf")).alias("dot"))
    out = rows.join(dot.join(length, ["path", "ord"]), ["path", "ord"], "left").join(hits, ["path", "name", "kind", "line"], "left").crossJoin(F.broadcast(query_length))
    semantic = F.when((F.col("norm") > 0) & (F.col("qnorm") > 0), F.col("dot") / (F.col("norm") * F.col("qnorm"))).otherwise(0.0)
    out = out.withColumns({"semantic": F.round(semantic, 6), "keyword": F.when(F.col("hit"), 1.0).otherwise(S.match_score(F.col("name"), q) / 3)})
    out = out.where((F.col("keyword") > 0) | (F.col("semantic") >= LEAST_SEMANTIC)).withColumn("hybrid", F.round(0.6 * F.col("keyword") + 0.4 * F.col("semantic"), 6))
    order = [F.desc("hybrid"), F.desc("semantic"), F.desc("keyword"), F.col("path"), F.col("ord")]
    best = out.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))).select(*symbols.columns, "hybrid", "semantic", F.round("keyword", 6).alias("keyword"), "rank")
