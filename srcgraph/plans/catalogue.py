"""The named queries over the driver tables and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from srcgraph.functions import scalar as S
from srcgraph.operators import context, diff, fts, graph, grep, lookup, rank
from srcgraph.plans import views as V
from srcgraph.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_SYM = "path, name, kind, line, end_line, signature, parent"
_SYMS = [c.strip() for c in _SYM.split(",")]
_TRANSLATE = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DEFINING = "kind IN ('function', 'method', 'class', 'type', 'interface')"


def query(sql: str | None = None, *names: str, recursive: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = V.with_views(sql, *names, recursive=recursive) if names else sql
        return f

    return add


def _post(spark: SparkSession, d: str) -> DataFrame:
    return fts.postings(V.symbols(spark, d))


# ---------------------------------------------------------------- lookups
@query("SELECT language, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM v_files GROUP BY language", "files")
def files_by_language(spark, d):
    return V.files(spark, d).groupBy("language").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("SELECT path, content_hash, size FROM v_files WHERE language = 'de'", "files")
def list_files(spark, d):
    t = V.tables(spark, d)
    t.files = V.files(spark, d)
    return lookup.list_files(t, "de").select("path", "content_hash", "size")


@query("SELECT path, language, content_hash, size FROM v_files WHERE path = 'docs/en/src1/1'", "files")
def file_lookup(spark, d):
    t = V.tables(spark, d)
    t.files = V.files(spark, d)
    return lookup.get_file(t, "docs/en/src1/1")


@query("SELECT CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) WHEN '.go' THEN 'go' END AS language, path FROM symfiles UNION ALL SELECT CASE regexp_extract(lower(split_part(url, '/', 3) || '.PY'), '(\\.[^./]*)$', 1) WHEN '.py' THEN 'python' END, url || '.PY' FROM pages", "symfiles")
def language_detection(spark, d):
    paths = V.symbol_files(spark, d).unionByName(V.read(spark, d, "pages").select(F.concat("url", F.lit(".PY")).alias("path")))
    return paths.select(S.language_of(F.col("path")).alias("language"), "path")


@query(f"SELECT {_SYM} FROM sym WHERE name = 'RedPlate' AND {_DEFINING}", "sym")
def find_definitions(spark, d):
    return lookup.definitions(V.tables(spark, d), "RedPlate").select(*_SYMS)


@query(f"SELECT {_SYM} FROM sym WHERE name = 'RedPlate'", "sym")
def find_declarations(spark, d):
    return lookup.by_name(V.tables(spark, d), "RedPlate").select(*_SYMS)


@query(f"SELECT {', '.join('s.' + c for c in _SYMS)} FROM sym s, (SELECT path AS p, line AS l FROM sym WHERE name = 'RedPlate' AND {_DEFINING} ORDER BY kind, path, ord LIMIT 1) WHERE name = 'RedPlate' AND NOT (path = p AND line = l)", "sym")
def find_references(spark, d):
    return lookup.references(V.tables(spark, d), "RedPlate").select(*_SYMS)


@query(f"SELECT {_SYM} FROM sym WHERE path = 'src/Brand_17/size28.go'", "sym")
def file_symbols(spark, d):
    return lookup.file_symbols(V.tables(spark, d), "src/Brand_17/size28.go").select(*_SYMS)


@query("SELECT path, ord, source, line FROM imp WHERE path = 'page7'", "imp")
def imports_of(spark, d):
    return lookup.imports_of(V.tables(spark, d), "page7")


@query(f"SELECT path, ord, source, line FROM imp WHERE {_TRANSLATE.format('source')} LIKE '%th_n%'", "imp")
def importers_of(spark, d):
    return lookup.importers_of(V.tables(spark, d), "TH_n")


@query(f"SELECT b.path AS of, b.ord AS of_ord, a.path, a.ord, a.source, a.line FROM imp a JOIN imp b ON b.path IN ('page3', 'page8') AND {_TRANSLATE.format('a.source')} LIKE '%' || {_TRANSLATE.format('b.source')} || '%'", "imp")
def importers_theta(spark, d):
    out = lookup.importers_of_imports(V.tables(spark, d), F.col("path").isin("page3", "page8"))
    return out.select("of", "of_ord", "path", "ord", "source", "line")


@query("SELECT (SELECT count(*) FROM v_files) AS files, (SELECT count(*) FROM sym) AS symbols, (SELECT count(*) FROM imp) AS imports", "files", "sym", "imp")
def stats(spark, d):
    t = V.tables(spark, d)
    t.files = V.files(spark, d)
    return lookup.stats(t)


@query("SELECT kind, count(*) AS n, count(DISTINCT name) AS names FROM sym GROUP BY kind", "sym")
def kind_counts(spark, d):
    return V.symbols(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


_MAP = """, c AS (SELECT path, count(*) AS symbols, count(*) FILTER (kind IN ('function', 'variable', 'constant')) AS functions, count(*) FILTER (kind IN ('type', 'interface')) AS types, count(*) FILTER (kind = 'method') AS methods FROM sym GROUP BY path),
 f AS (SELECT CASE WHEN instr(path, '/') = 0 THEN '.' ELSE regexp_replace(path, '/[^/]*$', '') END AS dir, path, symbols, functions, types, methods FROM symfiles LEFT JOIN c USING (path))
"""
_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("symbols", "functions", "types", "methods"))


@query(None)
def dir_map_rollup(spark, d):
    return context.directory_map(V.tables(spark, d))


ORACLE["dir_map_rollup"] = V.with_views("", "symfiles").rstrip() + _MAP + f"SELECT coalesce(dir, '.') AS path, grouping(dir) = 1 AS is_root, count(path) AS files, {_SUMS} FROM f GROUP BY ROLLUP (dir)"


@query(None)
def dir_tree(spark, d):
    return context.directory_tree(V.tables(spark, d))


ORACLE["dir_tree"] = (
    V.with_views("", "symfiles").rstrip()
    + _MAP
    + f", u AS (SELECT *, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM f) SELECT array_to_string(string_split(dir, '/')[1:k], '/') AS path, count(*) AS files, {_SUMS} FROM u GROUP BY 1"
)

# ---------------------------------------------------------------- search
_SCORE = "CASE WHEN lower(name) = '{0}' THEN 3 WHEN starts_with(lower(name), '{0}') THEN 2 WHEN contains(lower(name), '{0}') THEN 1 ELSE 0 END"


@query(f"SELECT {_SYM}, {_SCORE.format('red')} AS score FROM sym WHERE {_SCORE.format('red')} > 0 ORDER BY score DESC, path, ord LIMIT 50", "sym")
def match_score_topk(spark, d):
    return rank.score_topk(V.symbols(spark, d), "ReD").select(*_SYMS, "score")


def _ranked_sql(token_match: str, q: str, limit: int) -> str:
    return f"""
, base AS (SELECT s.*, 0 AS src FROM sym s SEMI JOIN (SELECT DISTINCT path, ord FROM ({token_match}) ORDER BY path, ord LIMIT {limit}) h ON s.path = h.path AND s.ord = h.ord),
 more AS (SELECT *, 1 AS src FROM sym WHERE {_SCORE.format(q)} > 0 AND (SELECT count(*) FROM base) < {limit}),
 one AS (SELECT *, row_number() OVER (PARTITION BY path, name, kind, line ORDER BY src, ord) AS k FROM (SELECT * FROM base UNION ALL SELECT * FROM more)),
 best AS (SELECT {_SYM}, {_SCORE.format(q)} AS score, CAST(row_number() OVER (ORDER BY {_SCORE.format(q)} DESC, src, path, ord) AS INTEGER) AS rank FROM one WHERE k = 1)
SELECT * FROM best WHERE rank <= {limit}"""


@query(None)
def ranked_search(spark, d):
    s = V.symbols(spark, d)
    return rank.ranked(s, _post(spark, d), "redplate", None, 50).select(*_SYMS, "score", "rank")


ORACLE["ranked_search"] = V.with_views("", "post").rstrip() + _ranked_sql("SELECT path, ord FROM post WHERE token = 'redplate'", "redplate", 50)


@query(None)
def ranked_search_full_base(spark, d):
    s = V.symbols(spark, d)
    return rank.ranked(s, _post(spark, d), "ring", None, 10).select(*_SYMS, "score", "rank")


ORACLE["ranked_search_full_base"] = V.with_views("", "post").rstrip() + _ranked_sql("SELECT path, ord FROM post WHERE token = 'ring'", "ring", 10)


def _fts(name: str, q: str, sql: str, kind: str | None = None) -> None:
    def run(spark, d):
        return fts.matched(_post(spark, d), q, kind).select("path", "ord")

    run.__name__ = name
    query(sql, "post")(run)


def _with(token: str, more: str = "") -> str:
    return f"SELECT DISTINCT path, ord FROM post WHERE token = '{token}'{more}"


_fts("fts_and", "small ring", f"({_with('small')}) INTERSECT ({_with('ring')})")
_fts("fts_or_not", "(small OR red) NOT ring", f"(({_with('small')}) UNION ({_with('red')})) EXCEPT ({_with('ring')})")
_fts("fts_prefix", "red* AND make", f"(SELECT DISTINCT path, ord FROM post WHERE starts_with(token, 'red')) INTERSECT ({_with('make')})")
_fts("fts_phrase", '"make small"', "SELECT DISTINCT a.path, a.ord FROM post a JOIN post b ON a.path = b.path AND a.ord = b.ord AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.token = 'make' AND b.token = 'small'")
_fts("fts_column_initial", "signature: ^make AND name: hotgear", f"({_with('make', ' AND field = ' + chr(39) + 'signature' + chr(39) + ' AND pos = 0')}) INTERSECT ({_with('hotgear', ' AND field = ' + chr(39) + 'name' + chr(39))})")
_fts("fts_near", "NEAR(make ring, 2)", "SELECT DISTINCT a.path, a.ord FROM post a JOIN post b ON a.path = b.path AND a.ord = b.ord AND a.field = b.field AND abs(b.pos - a.pos) <= 3 WHERE a.token = 'make' AND b.token = 'ring'")
_fts("fts_kind", "ring", _with("ring", " AND kind = 'class'"), "class")


@query("SELECT token, count(*) AS df FROM tok GROUP BY token", "tok")
def token_df(spark, d):
    return rank.document_frequency(rank.corpus_tokens(V.symbols(spark, d)))


_IDF = "ln((1 + n)::DOUBLE / (1 + df)) + 1"


@query(f", n AS (SELECT count(*) AS n FROM sym), df AS (SELECT token, count(*) AS df FROM tok GROUP BY token) SELECT path, ord, round(sqrt(sum((tf * ({_IDF})) ** 2)), 6) AS norm FROM tok JOIN df USING (token), n GROUP BY path, ord", "tok")
def tfidf_norms(spark, d):
    return rank.weights(V.symbols(spark, d)).norms.select("path", "ord", F.round("norm", 6).alias("norm"))


ORACLE["tfidf_norms"] = ORACLE["tfidf_norms"].replace("GROUP BY ALL)\n,", "GROUP BY ALL),")


def _hybrid_sql(tokens: tuple[str, ...], hits: str, q: str, kind: str | None, limit: int) -> str:
    only = f"WHERE kind = '{kind}'" if kind else ""
    asked = " UNION ALL ".join(f"SELECT '{t}' AS token" for t in tokens)
    return f""", sy AS (SELECT * FROM sym {only}), n AS (SELECT count(*) AS n FROM sy), t AS (SELECT tok.* FROM tok SEMI JOIN sy ON tok.path = sy.path AND tok.ord = sy.ord),
 df AS (SELECT token, count(*) AS df FROM t GROUP BY token), q AS (SELECT token, count(*) AS qtf FROM ({asked}) GROUP BY token),
 ql AS (SELECT sqrt(sum((qtf * (ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1)) ** 2)) AS qn FROM q LEFT JOIN df USING (token), n),
 w AS (SELECT t.path, t.ord, tf * ({_IDF}) AS w, coalesce(qtf, 0) * ({_IDF}) AS qw FROM t JOIN df USING (token) LEFT JOIN q USING (token), n),
 v AS (SELECT path, ord, sqrt(sum(w * w)) AS norm, sum(w * qw) AS dot FROM w GROUP BY path, ord),
 h AS (SELECT path, ord FROM ({hits}) ORDER BY path, ord LIMIT {limit}),
 k AS (SELECT sy.*, round(CASE WHEN norm > 0 THEN dot / (norm * qn) ELSE 0 END, 6) AS semantic, CASE WHEN h.path IS NOT NULL THEN 1.0 ELSE ({_SCORE.format(q)})::DOUBLE / 3 END AS keyword FROM sy LEFT JOIN v ON sy.path = v.path AND sy.ord = v.ord LEFT JOIN h ON sy.path = h.path AND sy.ord = h.ord, ql),
 y AS (SELECT *, round(0.6 * keyword + 0.4 * semantic, 6) AS hybrid FROM k WHERE keyword > 0 OR semantic >= 0.08),
 z AS (SELECT {_SYM}, hybrid, semantic, round(keyword, 6) AS keyword, CAST(row_number() OVER (ORDER BY hybrid DESC, semantic DESC, keyword DESC, path, ord) AS INTEGER) AS rank FROM y)
SELECT * FROM z WHERE rank <= {limit}"""


@query(None)
def hybrid_topk(spark, d):
    return rank.hybrid(V.symbols(spark, d), _post(spark, d), "red plate", None, 50).select(*_SYMS, "hybrid", "semantic", "keyword", "rank")


ORACLE["hybrid_topk"] = V.with_views("", "tok", "post").rstrip() + _hybrid_sql(("red", "plate"), f"({_with('red')}) INTERSECT ({_with('plate')})", "red plate", None, 50)


@query(None)
def hybrid_topk_kind(spark, d):
    return rank.hybrid(V.symbols(spark, d), _post(spark, d), "ring", "class", 20).select(*_SYMS, "hybrid", "semantic", "keyword", "rank")


ORACLE["hybrid_topk_kind"] = V.with_views("", "tok", "post").rstrip() + _hybrid_sql(("ring",), _with("ring", " AND kind = 'class'"), "ring", "class", 20)

_LINES = "SELECT path, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM v_files"


@query(f"SELECT path, CAST(line AS INTEGER) AS line, trim(raw, ' ' || chr(9) || chr(13)) AS content FROM ({_LINES}) WHERE contains(raw, 'License') ORDER BY path, line LIMIT 50", "files")
def grep_text(spark, d):
    return grep.search(V.content(spark, d), "License")


@query(f"SELECT path, CAST(line AS INTEGER) AS line, trim(raw, ' ' || chr(9) || chr(13)) AS content FROM ({_LINES}) WHERE contains(raw, 'er') AND contains(path, 'src3') ORDER BY path, line LIMIT 200", "files")
def grep_text_path_filter(spark, d):
    return grep.search(V.content(spark, d), "er", "src3", 200)


# ---------------------------------------------------------------- graph
@query("SELECT DISTINCT source FROM edges WHERE path = '17'", "edges")
def direct_imports(spark, d):
    return graph.direct_imports(V.edges(spark, d), "17")


@query("SELECT DISTINCT path FROM edges WHERE source = '5'", "edges")
def direct_importers(spark, d):
    return graph.direct_importers(V.edges(spark, d), "5")


@query("r AS (SELECT '17' AS node, 0 AS depth UNION SELECT source, depth + 1 FROM r JOIN edges ON path = node WHERE depth < 3) SELECT '17' AS start, node, min(depth) AS depth FROM r WHERE node <> '17' GROUP BY node", "edges", recursive=True)
def dependencies_bfs(spark, d):
    return graph.dependencies(V.edges(spark, d), ["17"], 3)


_CO = "co AS (SELECT DISTINCT a.path AS a, b.path AS b FROM edges a JOIN edges b ON a.source = b.source WHERE a.path <> b.path)"


@query(
    "f AS (SELECT DISTINCT path FROM edges), l1 AS (SELECT DISTINCT b.path AS node FROM edges a JOIN edges b ON a.source = b.source WHERE a.path = '17' AND b.path <> '17') SELECT '17' AS start, node, 1 AS depth FROM l1",
    "edges",
    recursive=True,
)
def dependents_level(spark, d):
    return graph.dependents(V.edges(spark, d), ["17"], 1)


@query("r AS (SELECT '1500' AS node, 0 AS depth UNION SELECT e.path, depth + 1 FROM r JOIN edges a ON a.path = r.node JOIN edges e ON e.source = a.source WHERE depth < 2) SELECT '1500' AS start, node, min(depth) AS depth FROM r WHERE node <> '1500' GROUP BY node", "edges", recursive=True)
def dependents_bfs(spark, d):
    return graph.dependents(V.edges(spark, d), ["1500"], 2)


@query("SELECT path, count(*) AS shared FROM edges WHERE path <> '17' AND source IN (SELECT source FROM edges WHERE path = '17') GROUP BY path ORDER BY shared DESC, path LIMIT 10", "edges")
def related_topn(spark, d):
    return graph.related(V.edges(spark, d), "17")


@query(
    """a AS (SELECT DISTINCT e.path FROM edges e JOIN edges s ON e.source = s.source WHERE s.path = '17'),
 hit AS (SELECT 1 AS one FROM a WHERE path = '150'),
 mid AS (SELECT min(m.path) AS path FROM a JOIN edges m ON m.path = a.path JOIN edges t ON t.source = m.source WHERE t.path = '150' AND m.path <> '17')
SELECT 0 AS pos, '17' AS path UNION ALL SELECT 1, CASE WHEN (SELECT count(*) FROM hit) > 0 THEN '150' ELSE (SELECT path FROM mid) END UNION ALL SELECT 2, '150' WHERE (SELECT count(*) FROM hit) = 0""",
    "edges",
    recursive=True,
)
def trace_path(spark, d):
    return graph.trace(V.edges(spark, d), "17", "150")


# ---------------------------------------------------------------- composites
@query(None)
def explain_file(spark, d):
    t = V.tables(spark, d)
    t.files = t.imports.select("path").distinct().withColumn("language", F.lit("html"))
    t.symbols = V.symbols(spark, d).withColumn("path", F.concat(F.lit("page"), F.pmod("line", F.lit(50)).cast("string")))
    one = context.explain(t, t.files.where("path IN ('page3', 'page9')"))
    return one.select("path", "language", F.size("symbols").cast("bigint").alias("symbols"), F.size("imports").cast("bigint").alias("imports"), F.size("importers").cast("bigint").alias("importers"), F.col("symbols")[0]["name"].alias("first_symbol"), F.col("imports")[0]["source"].alias("first_import"))


ORACLE["explain_file"] = V.with_views(
    f"""SELECT p.path, 'html' AS language, (SELECT count(*) FROM sym WHERE 'page' || (line % 50) = p.path) AS symbols, (SELECT count(*) FROM imp WHERE imp.path = p.path) AS imports,
 (SELECT count(*) FROM imp a JOIN imp b ON b.path = p.path AND {_TRANSLATE.format('a.source')} LIKE '%' || {_TRANSLATE.format('b.source')} || '%') AS importers,
 (SELECT name FROM sym WHERE 'page' || (line % 50) = p.path ORDER BY line LIMIT 1) AS first_symbol, (SELECT source FROM imp WHERE imp.path = p.path AND ord = 0) AS first_import
FROM (SELECT DISTINCT path FROM imp WHERE path IN ('page3', 'page9')) p""",
    "sym",
    "imp",
)


@query(None)
def symbol_context(spark, d):
    return context.symbol_context(V.tables(spark, d), _post(spark, d), "RedPlate").select("section", "pos", *_SYMS)


ORACLE["symbol_context"] = (
    V.with_views("", "post").rstrip()
    + _ranked_sql("SELECT path, ord FROM post WHERE token = 'redplate'", "redplate", 20).replace("SELECT * FROM best WHERE rank <= 20", f", def AS (SELECT * FROM sym WHERE name = 'RedPlate' AND {_DEFINING} ORDER BY kind, path, ord LIMIT 1)")
    + f"""SELECT 'definition' AS section, 1 AS pos, {_SYM} FROM def UNION ALL SELECT 'method', CAST(row_number() OVER (ORDER BY kind, path, ord) AS INTEGER), {_SYM} FROM sym WHERE name = 'RedPlate' AND kind = 'method'
UNION ALL SELECT 'related', rank, {', '.join('best.' + c for c in _SYMS)} FROM best, def WHERE rank <= 20 AND NOT (best.path = def.path AND best.line = def.line)"""
)


@query(None)
def snapshot_files(spark, d):
    t = V.tables(spark, d)
    t.files = t.files.select("path").unionByName(t.content.select("path"))
    t.content = V.content(spark, d).withColumn("text", F.replace("text", F.lit("License"), F.lit("RedPlate")))
    return context.snapshot_files(t, _post(spark, d), "RedPlate", 3)


ORACLE["snapshot_files"] = (
    V.with_views("", "post", "files").rstrip()
    + _ranked_sql("SELECT path, ord FROM post WHERE token = 'redplate'", "redplate", 20).replace("SELECT * FROM best WHERE rank <= 20", ", r AS (SELECT path, min(rank) AS r FROM best WHERE rank <= 20 GROUP BY path)")
    + f""", k AS (SELECT CAST(row_number() OVER (ORDER BY r) AS INTEGER) AS pos, path FROM r), a AS (SELECT * FROM k WHERE pos <= 3),
 g AS (SELECT path, line FROM ({_LINES}) WHERE contains(raw, 'License') ORDER BY path, line LIMIT 10),
 b AS (SELECT CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS k, path FROM (SELECT DISTINCT path FROM g) WHERE path NOT IN (SELECT path FROM r))
SELECT pos, path, 'symbol' AS why FROM a UNION ALL SELECT CAST((SELECT count(*) FROM a) + k AS INTEGER), path, 'text' FROM b WHERE k <= greatest(1, 3 - (SELECT count(*) FROM a))"""
)


@query(None)
def diff_impact(spark, d):
    t = V.tables(spark, d)
    t.imports = V.edges(spark, d)
    return context.diff_impact(t, ["17", "1500"], 1)


ORACLE["diff_impact"] = V.with_views(
    """SELECT path AS file, 'direct_deps' AS section, source AS value FROM edges WHERE path IN ('17', '1500')
UNION ALL SELECT DISTINCT path, 'all_deps', source FROM edges WHERE path IN ('17', '1500') AND source <> path
UNION ALL SELECT DISTINCT a.path, 'dependents', b.path FROM edges a JOIN edges b ON a.source = b.source WHERE a.path IN ('17', '1500') AND a.path <> b.path
UNION ALL SELECT DISTINCT a.path, 'recommends', b.path FROM edges a JOIN edges b ON a.source = b.source WHERE a.path IN ('17', '1500') AND a.path <> b.path""",
    "edges",
)


@query("SELECT path AS start, CASE WHEN ends_with(path, '_test.go') THEN path ELSE regexp_replace(path, '^(.*?)\\.go', '\\1_test.go') END AS value FROM symfiles", "symfiles")
def test_recommendations(spark, d):
    return context.recommended_tests(V.symbol_files(spark, d).select(F.col("path").alias("start"), F.col("path").alias("node")))


# ---------------------------------------------------------------- index maintenance
_SNAP = "SELECT CAST(o_orderkey AS VARCHAR) AS path, md5(CAST(o_orderkey AS VARCHAR) || CASE WHEN {0} AND o_orderkey % 7 = 3 THEN 'x' ELSE '' END) AS content_hash FROM orders WHERE o_orderkey % 10 <> {1}"


def _snap(spark: SparkSession, d: str, new: bool) -> DataFrame:
    o = V.read(spark, d, "orders").where(F.pmod("o_orderkey", F.lit(10)) != (1 if new else 2))
    key = F.col("o_orderkey").cast("string")
    mark = F.when(F.lit(new) & (F.pmod("o_orderkey", F.lit(7)) == 3), "x").otherwise("")
    return o.select(key.alias("path"), F.md5(F.concat(key, mark)).alias("content_hash"))


_OLD, _NEW = _SNAP.format("false", 2), _SNAP.format("true", 1)


@query(f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS state FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.path = n.path")
def incremental_diff(spark, d):
    return store.classify(_snap(spark, d, False), _snap(spark, d, True))


@query(f"SELECT path, content_hash FROM ({_OLD}) WHERE path NOT IN (SELECT path FROM ({_NEW})) UNION ALL SELECT path, content_hash FROM ({_NEW})")
def upsert_files(spark, d):
    return store.upsert(_snap(spark, d, False), _snap(spark, d, True))


@query("SELECT path, ord, name FROM sym WHERE path NOT LIKE 'src/Brand_1/%'", "sym")
def delete_cascade(spark, d):
    s = V.symbols(spark, d)
    return store.without(s, V.symbol_files(spark, d).where(F.startswith("path", F.lit("src/Brand_1/")))).select("path", "ord", "name")


@query("SELECT path, content_hash, size FROM v_files", "files")
def content_hash(spark, d):
    return V.content(spark, d).select("path", S.sha256(F.col("text")).alias("content_hash"), F.octet_length("text").cast("bigint").alias("size"))


# ---------------------------------------------------------------- diffs
@query("SELECT o_orderkey AS id, CAST(o_orderkey % 90 + 1 AS INTEGER) AS old_start, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE CAST(o_custkey % 9 AS INTEGER) END AS old_lines, CAST(o_custkey % 80 + 2 AS INTEGER) AS new_start, CAST(o_orderkey % 5 AS INTEGER) AS new_lines FROM orders")
def diff_hunk_headers(spark, d):
    o = V.read(spark, d, "orders")
    old = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "").otherwise(F.concat(F.lit(","), F.pmod("o_custkey", F.lit(9)).cast("string")))
    line = F.concat(F.lit("@@ -"), (F.pmod("o_orderkey", F.lit(90)) + 1).cast("string"), old, F.lit(" +"), (F.pmod("o_custkey", F.lit(80)) + 2).cast("string"), F.lit(","), F.pmod("o_orderkey", F.lit(5)).cast("string"), F.lit(" @@ func x"))
    return diff.hunk_headers(o.select(F.col("o_orderkey").alias("id"), line.alias("line"))).drop("line")


@query(
    f""", l AS (SELECT path, CAST(line - 1 AS INTEGER) AS pos, raw FROM ({_LINES})), e AS (SELECT path, max(pos) AS e FROM l GROUP BY path),
 s AS (SELECT path, greatest(pos - 1, 0) AS first, least(pos + 1, e) AS last FROM l JOIN e USING (path) WHERE contains(raw, 'tion')),
 m AS (SELECT *, max(last) OVER (PARTITION BY path ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
 i AS (SELECT *, sum(CASE WHEN far IS NULL OR first > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY first, last) AS island FROM m)
SELECT path, min(first) AS first, max(last) AS last FROM i GROUP BY path, island""",
    "files",
)
def snippet_windows(spark, d):
    lines = V.content(spark, d).select("path", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return diff.snippet_windows(lines, F.contains("raw", F.lit("tion")), 1, ["path"])


ORACLE["snippet_windows"] = ORACLE["snippet_windows"].replace("documents)\n,", "documents),")


@query("SELECT 'docs/' || doc_id AS path FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def changed_files_union(spark, d):
    docs = V.read(spark, d, "documents")
    name = F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path")
    return diff.changed_files(docs.where("doc_id % 3 = 0").select(name), docs.where("doc_id % 5 = 0").select(name))


@query("SELECT conv_id, CAST(count(*) AS INTEGER) AS hunks, CAST(sum(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS additions FROM conversations GROUP BY conv_id")
def diff_parse(spark, d):
    """Each conversation as a diff of one file with a hunk a turn: added lines for even turns, removed for odd ones."""
    rows = V.read(spark, d, "conversations").select("conv_id", "turn")
    mark = F.when(F.pmod("turn", F.lit(2)) == 0, "+").otherwise("-")
    hunk = F.concat(F.lit("@@ -"), (F.col("turn") + 1).cast("string"), F.lit(" +"), (F.col("turn") + 1).cast("string"), F.lit(" @@\n"), mark, F.lit("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", hunk.alias("h")))), lambda x: x["h"]), "\n")
    text = F.concat(F.lit("diff --git a/x b/c"), F.col("conv_id").cast("string"), F.lit("\n+++ b/c"), F.col("conv_id").cast("string"), F.lit("\n"), F.col("body"))
    diffs = rows.groupBy("conv_id").agg(body.alias("body")).select(F.col("conv_id").cast("int").alias("grp"), text.alias("diff"))
    parsed = diff.parse_diffs(diffs, 0)
    adds = F.aggregate("snippets", F.lit(0).cast("bigint"), lambda a, s: a + F.when(F.startswith(s, F.lit("+")), 1).otherwise(0))
    return parsed.select(F.col("grp").cast("bigint").alias("conv_id"), F.size("hunks").alias("hunks"), adds.alias("additions"))


@query(None)
def first_per_file(spark, d):
    """The best symbol of each file of a search."""
    s = V.symbols(spark, d).withColumn("score", S.match_score(F.col("name"), "red")).where("score > 0")
    best = W.partitionBy("path").orderBy(F.desc("score"), "ord")
    return s.withColumn("k", F.row_number().over(best)).where("k = 1").select("path", "name", "line", "score")


ORACLE["first_per_file"] = V.with_views(f"SELECT path, name, line, score FROM (SELECT *, {_SCORE.format('red')} AS score FROM sym) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, ord) = 1", "sym")
