"""The driver's tables seen as an index, and the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.schema import Tables

_KINDS = {"STANDARD": "function", "SMALL": "method", "LARGE": "class", "ECONOMY": "type", "MEDIUM": "interface", "PROMO": "variable"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    return p.select(
        F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/size"), F.col("p_size").cast("string"), F.lit(".go")).alias("path"),
        F.col("p_partkey").cast("int").alias("ord"),
        F.concat(F.initcap(words[0]), F.initcap(words[1])).alias("name"),
        F.coalesce(F.element_at(kinds, F.split("p_type", " ")[0]), F.lit("constant")).alias("kind"),
        F.col("p_partkey").cast("int").alias("line"),
        F.col("p_partkey").cast("int").alias("end_line"),
        F.concat(F.lit("make "), F.col("p_name")).alias("signature"),
        F.col("p_brand").alias("parent"),
    )


def symbol_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of ``symbols``, and some that declare nothing."""
    paths = symbols(spark, sf_dir).select("path").distinct()
    empty = read(spark, sf_dir, "nation").select(F.concat(F.lit("src/"), F.col("n_name"), F.lit("/empty.go")).alias("path"))
    return paths.unionByName(empty.distinct())


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.lit("docs"), "lang", "source", F.col("doc_id").cast("string"))
    return d.select(path.alias("path"), F.col("lang").alias("language"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("bigint").alias("size"))


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", F.lit("docs"), "lang", "source", F.col("doc_id").cast("string")).alias("path"), "text")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    p = read(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("path"), F.posexplode(hrefs).alias("ord", "source"))
    return p.select("path", "ord", "source", (F.col("ord") + 1).alias("line"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts import suppliers, of numbers that overlap, so paths have several hops."""
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("path"), F.col("l_suppkey").cast("string").alias("source")).distinct()
    return pairs.withColumns({"ord": F.lit(0), "line": F.lit(1)})


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Symbols with their files; imports are those of the pages."""
    s = symbols(spark, sf_dir)
    f = symbol_files(spark, sf_dir).select("path", F.lit("go").alias("language"), F.sha2("path", 256).alias("content_hash"), F.lit(0).cast("bigint").alias("size"))
    return Tables(f, s, imports(spark, sf_dir), content(spark, sf_dir))


SQL = {
    "sym": """SELECT 'src/' || replace(p_brand, '#', '_') || '/size' || p_size || '.go' AS path, CAST(p_partkey AS INTEGER) AS ord,
  upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS name,
  CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 'function' WHEN 'SMALL' THEN 'method' WHEN 'LARGE' THEN 'class' WHEN 'ECONOMY' THEN 'type' WHEN 'MEDIUM' THEN 'interface' WHEN 'PROMO' THEN 'variable' ELSE 'constant' END AS kind,
  CAST(p_partkey AS INTEGER) AS line, CAST(p_partkey AS INTEGER) AS end_line, 'make ' || p_name AS signature, p_brand AS parent FROM part""",
    "symfiles": "SELECT DISTINCT path FROM sym UNION SELECT DISTINCT 'src/' || n_name || '/empty.go' FROM nation",
    "files": "SELECT 'docs/' || lang || '/' || source || '/' || doc_id AS path, lang AS language, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size, text FROM documents",
    "imp": """SELECT path, CAST(i - 1 AS INTEGER) AS ord, hrefs[i] AS source, CAST(i AS INTEGER) AS line FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i
  FROM (SELECT 'page' || page_id AS path, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages))""",
    "edges": "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS path, CAST(l_suppkey AS VARCHAR) AS source FROM lineitem",
    "tok": """SELECT path, ord, token, count(*) AS tf FROM (SELECT path, ord, lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(name || ' ' || signature || ' ' || parent || ' ' || path,
  '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g'), '[\\p{L}\\p{Nd}]+'))) AS token FROM sym) GROUP BY ALL""",
    "post": """SELECT token, field, CAST(i - 1 AS INTEGER) AS pos, path, ord, kind FROM (SELECT field, path, ord, kind, toks, unnest(range(1, len(toks) + 1)) AS i, toks[i] AS token FROM (
  SELECT 'name' AS field, path, ord, kind, regexp_extract_all(strip_accents(lower(name)), '[\\p{L}\\p{N}]+') AS toks FROM sym UNION ALL
  SELECT 'signature', path, ord, kind, regexp_extract_all(strip_accents(lower(signature)), '[\\p{L}\\p{N}]+') FROM sym))""",
}
_NEEDS = {"symfiles": ("sym",), "tok": ("sym",), "post": ("sym",)}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` behind the views it names and those that they need."""
    order: list[str] = []
    for n in names:
        for m in (*_NEEDS.get(n, ()), n):
            if m not in order:
                order.append(m)
    ctes = ",\n".join(f"v_{n} AS ({SQL[n]})" if n == "files" else f"{n} AS ({SQL[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{',' if recursive else ''}\n{body}"
