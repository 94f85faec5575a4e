"""Operator 4: mix sources to target weights with hash-threshold histograms.

Every document gets a 52-bit hash of its id. Tokens are summed by source and
leading hash bits, in partial sums where the documents lie; the running sum finds,
for each source and each nested budget, the one bucket in which the budget runs
out. Only that boundary bucket is split by its next bits, until a bucket holds a
single hash value. What remains is one threshold a source and budget, and selection
is a filter ``hash <= threshold``: no document is ever sorted and the smaller
budgets are subsets of the larger ones. Boundaries and thresholds stay tables, so
there may be as many sources as there are domains.

Defined cases
-------------
* A null source is the source ``''``; a null id hashes like the empty string.
* Null, empty and blank texts hold 0 tokens; they are kept when their hash is
  within the threshold and count nothing.
* Documents with equal ids (repeated rows, ties) share their hash and so stand
  or fall together, never overrunning the budget.
* An empty table gives an empty result. Extra columns are carried through
  unread by ``apply_mix`` and ignored by ``mix``.
* If all weights are 0 nothing is kept.
* A source without tokens keeps everything; a source of weight 0 keeps nothing. A
  source that ``weights`` doesn't name has ``default_weight``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from srcgraph.llm.common import fresh, materialise

HASH_BITS = 52
STEP_BITS = 12
BUDGETS = (0.25, 0.5, 1.0)
#: Weights of the registered query: the sources that it takes more or less of than of the others.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
DEFAULT_WEIGHT = 1.0
BROADCAST_ROWS = 100_000


def doc_hash(doc_id: Column) -> Column:
    key = F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"].cast("string"), F.lit(""))


def tokens_of(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("bigint")


def targets(totals: DataFrame, weights: Mapping[str, float] | None, total_tokens: int | None, budgets: Sequence[float], default_weight: float = 0.0) -> DataFrame:
    """(source, level, budget): tokens that each source may give at each nested level.

    Without ``total_tokens`` the mixture is as large as the sources allow
    without repeating any of them: the least of tokens / weight.
    """
    if weights is None:
        weighted = totals.withColumn("weight", F.lit(1.0))
    else:
        pairs = [(str(k), float(v)) for k, v in weights.items()]
        given = totals.sparkSession.createDataFrame(pairs, "source string, weight double")
        weighted = totals.join(given, "source", "left").fillna(float(default_weight), ["weight"])
    # two sums of one row each, so no source has to meet all others
    shared = weighted.crossJoin(F.broadcast(weighted.agg(F.sum("weight").alias("all")))).withColumn("share", F.coalesce(F.try_divide("weight", "all"), F.lit(0.0))).drop("all")
    if total_tokens is not None:
        sized = shared.withColumn("size", F.lit(float(total_tokens)))
    else:
        sized = shared.crossJoin(F.broadcast(shared.agg(F.min(F.when((F.col("share") > 0) & (F.col("tokens") > 0), F.try_divide("tokens", "share"))).alias("size"))))
    level = F.posexplode(F.array(*[F.lit(float(b)) for b in sorted(budgets)])).alias("level", "fraction")
    return sized.select("source", "tokens", "share", "size", level).select(
        "source",
        (F.col("level") + 1).alias("level"),
        # one millionth of a token absorbs the rounding of the division
        F.when(F.col("share") <= 0, -1).when(F.col("tokens") <= 0, 0).otherwise(F.floor(F.col("size") * F.col("share") * F.col("fraction") + 1e-6)).cast("bigint").alias("budget"),
    )


def _small(df: DataFrame) -> DataFrame:
    """``df`` (written out) to be sent around, if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _cells(rows: DataFrame, bits: int, step: int) -> DataFrame:
    """Tokens of ``rows`` (source, prefix, h, tokens) by source, prefix and the next ``step`` bits."""
    cell = F.shiftright("h", HASH_BITS - bits - step).alias("cell")
    return rows.groupBy("source", "prefix", cell).agg(F.sum("tokens").alias("tokens"), F.min("h").alias("lo"), F.max("h").alias("hi"))


def thresholds(docs: DataFrame, weights: Mapping[str, float] | None = None, total_tokens: int | None = None, budgets: Sequence[float] = BUDGETS, default_weight: float = 0.0) -> DataFrame:
    """(source, level, cut): the largest hash kept; -1 where nothing is kept."""
    # each text is read once; the few numbers a document stay where they are
    rows = materialise(docs.select(source_of(docs).alias("source"), doc_hash(docs["doc_id"]).alias("h"), tokens_of(docs).alias("tokens"), F.lit(0).cast("bigint").alias("prefix")))
    cells = materialise(_cells(rows, 0, STEP_BITS))
    wanted = materialise(targets(cells.groupBy("source").agg(F.sum("tokens").alias("tokens")), weights, total_tokens, budgets, default_weight).withColumn("prefix", F.lit(0).cast("bigint")))
    none = wanted.select("source", "level", F.lit(-1).cast("bigint").alias("cut"))
    wanted, out, bits = wanted.where("budget >= 0"), [none], 0
    while True:
        step = min(STEP_BITS, HASH_BITS - bits)
        if bits:
            at = _small(wanted.select("source", "prefix").distinct())
            inside = rows.withColumn("prefix", F.shiftright("h", HASH_BITS - bits)).join(at, ["source", "prefix"], "left_semi")
            cells = _cells(inside, bits, step)
        upto = F.sum("tokens").over(W.partitionBy("source", "prefix").orderBy("cell"))
        # the first cell beyond the budget, else all of the prefix is kept
        over = F.col("upto") > F.col("budget")
        found = materialise(
            cells.withColumn("upto", upto)
            .join(wanted, ["source", "prefix"])
            .groupBy("source", "level", "budget")
            .agg(F.min(F.when(over, F.struct("cell", "tokens", "upto", "lo", "hi"))).alias("first"), F.max(F.when(~over, F.col("hi"))).alias("cut"))
        )
        out.append(found.where("cut is not null").select("source", "level", "cut"))
        bits += step
        wanted = found.where("first.lo < first.hi").select("source", "level", F.col("first.cell").alias("prefix"), (F.col("budget") - F.col("first.upto") + F.col("first.tokens")).alias("budget"))
        if bits == HASH_BITS or wanted.isEmpty():
            break
    return materialise(reduce(DataFrame.unionByName, out).groupBy("source", "level").agg(F.max("cut").alias("cut")))


def apply_mix(docs: DataFrame, cuts: DataFrame, level_column: str) -> DataFrame:
    """``docs`` within the widest budget, with the smallest level that holds them."""
    src, h = fresh(docs, "_src"), fresh(docs, "_hash")
    out = docs.withColumns({src: source_of(docs), h: doc_hash(docs["doc_id"])})
    names = (fresh(out, "_mix_src"), fresh(out, "_mix_cuts"))
    each = cuts.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("level", "cut")))["cut"].alias(names[1])).withColumnRenamed("source", names[0])
    if cuts.count() <= BROADCAST_ROWS:
        each = F.broadcast(each)
    out = out.join(each, out[src] == each[names[0]])
    level = F.array_position(F.transform(F.col(names[1]), lambda c: F.col(h) <= c), True).cast("int")
    return out.withColumn(level_column, level).where(F.col(level_column) > 0).drop(src, h, *names)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, total_tokens: int | None = None, budgets: Sequence[float] = BUDGETS, default_weight: float = 0.0) -> DataFrame:
    """(doc_id, source, tokens, level) of the documents that the mixture takes."""
    cuts = thresholds(docs, weights, total_tokens, budgets, default_weight)
    lean = docs.select("doc_id", source_of(docs).alias("source"), "text")
    out = apply_mix(lean, cuts, "level")
    return out.select("doc_id", "source", tokens_of(out).alias("tokens"), "level")


_MIX_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) AS BIGINT) AS tokens
  FROM {docs}
), t AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY source
), g AS (SELECT source, tokens, {weight} AS weight FROM t
), w AS (SELECT source, tokens, coalesce(weight / nullif(sum(weight) OVER (), 0), 0) AS share FROM g
), s AS (SELECT source, tokens, share, min(CASE WHEN tokens > 0 AND share > 0 THEN tokens / share END) OVER () AS size FROM w
), b AS (SELECT source, l.level,
                CASE WHEN share <= 0 THEN -1 WHEN tokens <= 0 THEN 0 ELSE CAST(floor(size * share * l.fraction + 1e-6) AS BIGINT) END AS budget
         FROM s, (VALUES (1, 0.25::DOUBLE), (2, 0.5::DOUBLE), (3, 1.0::DOUBLE)) l(level, fraction)
), c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM d)
SELECT c.doc_id, c.source, c.tokens, CAST(min(b.level) AS INTEGER) AS level
FROM (SELECT *, row_number() OVER () AS rid FROM c) c JOIN b ON b.source = c.source AND c.upto <= b.budget
GROUP BY c.rid, c.doc_id, c.source, c.tokens
"""


def oracle_sql(docs: str = "documents", weights: Mapping[str, float] | None = None, default_weight: float = 0.0) -> str:
    """The rows of ``mix`` in DuckDB SQL."""
    cases = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in (weights or {}).items())
    weight = f"CASE source {cases} ELSE {default_weight}::DOUBLE END" if cases else "1.0::DOUBLE"
    return _MIX_SQL.format(docs=docs, weight=weight)
