"""Named queries over source trees and work trees written from the driver's tables: scan, extraction, index runs, git, trace and diff merging."""

from __future__ import annotations

import os
import subprocess
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.engine import Engine
from srcgraph.operators import context, diff
from srcgraph.plans import views as V
from srcgraph.plans.catalogue import ORACLE, query
from srcgraph.runtime import shared_dir
from srcgraph.sources import git, tree
from srcgraph.sources.store import Store

#: Extension, head and declaration of each language; N is the name, M the module.
_FORMS = (
    ("go", 'package p\nimport "M"', "func N() {}"),
    ("ts", 'import { x } from "M"', "function N() {}"),
    ("js", 'import x from "M"', "function N() {}"),
    ("py", "import M", "def N(): pass"),
    ("rs", "use M;", "fn N() {}"),
    ("java", "import m.M;", "class N {}"),
)
_HEAD = "CASE p_size % 6 WHEN 0 THEN 2 ELSE 1 END"
_EXT = "['go', 'ts', 'js', 'py', 'rs', 'java'][p_size % 6 + 1]"
#: Files by brand and size, a line a part, in SQL: (p_partkey, path, name, module, k).
_LINES = f"""SELECT *, row_number() OVER (PARTITION BY path ORDER BY p_partkey) AS k FROM (SELECT p_partkey, p_size, replace(lower(p_brand), '#', '_') AS module,
 'src/' || replace(lower(p_brand), '#', '_') || '/size' || p_size || '.' || {_EXT} AS path, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || p_partkey AS name FROM part WHERE {{where}})"""
_SYMBOLS = f"SELECT path, name, CASE WHEN p_size % 6 = 5 THEN 'class' ELSE 'function' END AS kind, CAST(k + {_HEAD} AS INTEGER) AS line FROM ({_LINES}) UNION ALL SELECT DISTINCT path, 'p', 'package', 1 FROM ({_LINES}) WHERE p_size % 6 = 0"
_IMPORTS = f"SELECT DISTINCT path, CASE WHEN p_size % 6 = 5 THEN 'm.' || module ELSE module END AS source, CAST({_HEAD} AS INTEGER) AS line FROM ({_LINES})"
_FIRST, _SECOND = "p_partkey % 10 <> 1", "p_partkey % 10 <> 2 AND p_size <> 7"


def _folder(spark: SparkSession) -> str:
    path = f"{unquote(urlsplit(shared_dir(spark)).path)}/tree-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _parts(spark: SparkSession, d: str, where: str) -> DataFrame:
    brand, kind = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.pmod("p_size", F.lit(6))
    path = F.concat(F.lit("src/"), brand, F.lit("/size"), F.col("p_size").cast("string"), F.lit("."), F.array(*[F.lit(f[0]) for f in _FORMS])[kind])
    name = F.concat(F.initcap(F.split("p_name", " ")[0]), F.col("p_partkey").cast("string"))
    return V.read(spark, d, "part").where(where).select(path.alias("path"), kind.alias("kind"), brand.alias("module"), "p_partkey", name.alias("name"))


def write_tree(spark: SparkSession, d: str, where: str, root: str) -> None:
    """The files of the parts that ``where`` picks, under ``root``, each written by the task that holds its lines."""

    def put(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("p_partkey")
        _, head, line = _FORMS[int(group["kind"].iloc[0])]
        text = "\n".join([head.replace("M", group["module"].iloc[0]), *(line.replace("N", n) for n in group["name"])]) + "\n"
        at = os.path.join(root, group["path"].iloc[0])
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w") as f:
            f.write(text)
        return pd.DataFrame({"n": [len(group)]})

    _parts(spark, d, where).groupBy("path").applyInPandas(put, "n int").agg(F.sum("n")).collect()


def _indexed(spark: SparkSession, d: str) -> tuple[Store, str]:
    root = _folder(spark)
    write_tree(spark, d, _FIRST, root)
    store = Store(spark, f"{_folder(spark)}/index")
    store.index(root, incremental=False)
    return store, root


# ---------------------------------------------------------------- scan and extraction
@query(f"SELECT DISTINCT path, CASE p_size % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' WHEN 3 THEN 'python' WHEN 4 THEN 'rust' ELSE 'java' END AS language FROM ({_LINES})".format(where=_FIRST))
def scan_tree(spark, d):
    """Files found by the walk (skipped folders and other extensions beside them), with their languages."""
    root = _folder(spark)
    write_tree(spark, d, _FIRST, root)
    for odd in ("node_modules/x.js", ".git/y.py", "src/notes.txt"):
        os.makedirs(os.path.dirname(f"{root}/{odd}"), exist_ok=True)
        with open(f"{root}/{odd}", "w") as f:
            f.write("function no() {}\n")
    seen = tree.scan(tree.paths(spark, root).withColumn("old_hash", F.lit(None).cast("string")), root)
    return seen.select("path", "language")


@query(_SYMBOLS.format(where=_FIRST))
def index_symbols(spark, d):
    """Symbols of six languages after a full index run."""
    return _indexed(spark, d)[0].tables().symbols.select("path", "name", "kind", "line")


@query(_IMPORTS.format(where=_FIRST))
def index_imports(spark, d):
    return _indexed(spark, d)[0].tables().imports.select("path", "source", "line")


def _rewritten(spark: SparkSession, d: str) -> tuple[Store, dict]:
    """The index after files were rewritten, added and removed, and what the incremental run says."""
    store, root = _indexed(spark, d)
    for p in tree.walk(root):
        os.remove(f"{root}/{p}")
    write_tree(spark, d, _SECOND, root)
    return store, vars(store.index(root, incremental=True))


@query(_SYMBOLS.format(where=_SECOND))
def incremental_symbols(spark, d):
    """Symbols after an incremental run over a tree whose files changed, came and went."""
    return _rewritten(spark, d)[0].tables().symbols.select("path", "name", "kind", "line")


_TEXTS = f"SELECT path, string_agg(name, ',' ORDER BY p_partkey) AS text FROM ({_LINES}) GROUP BY path"


@query(
    f"""SELECT (SELECT count(*) FROM n) AS files, (SELECT count(*) FROM (SELECT 1 FROM n LEFT JOIN o USING (path) WHERE o.text IS NULL OR o.text <> n.text)) AS indexed,
 (SELECT count(*) FROM n JOIN o USING (path, text)) + (SELECT count(*) FROM o WHERE path NOT IN (SELECT path FROM n)) AS skipped, CAST(0 AS BIGINT) AS failed
FROM (SELECT 1)"""
)
def incremental_stats(spark, d):
    """Counters of an incremental run; vanished files count as skipped."""
    r = _rewritten(spark, d)[1]
    return spark.createDataFrame([(r["files"], r["indexed"], r["skipped"], r["failed"])], "files bigint, indexed bigint, skipped bigint, failed bigint")


ORACLE["incremental_stats"] = f"WITH o AS ({_TEXTS.format(where=_FIRST)}), n AS ({_TEXTS.format(where=_SECOND)}) " + ORACLE["incremental_stats"]


# ---------------------------------------------------------------- git
_SOME, _DIRTY = "p_size <= 6", "p_size <= 6 AND p_partkey % 5 <> 4"


def _git(root: str, *args: str) -> None:
    subprocess.run(["git", "-C", root, "-c", "user.email=a@example.com", "-c", "user.name=a", *args], check=True, capture_output=True)


def _work_tree(spark: SparkSession, d: str) -> Engine:
    """A work tree with a commit and an index of it, then lines taken out of some files; those of size 1 are staged."""
    root = _folder(spark)
    write_tree(spark, d, _SOME, root)
    _git(root, "init", "-q")
    _git(root, "add", ".")
    _git(root, "commit", "-qm", "one")
    engine = Engine(spark, root, f"{_folder(spark)}/index")
    engine.index()
    write_tree(spark, d, _DIRTY, root)
    _git(root, "add", ":(glob)src/*/size1.ts")
    return engine


_TOUCHED = f"SELECT DISTINCT path, p_size FROM ({_LINES}) WHERE p_partkey % 5 = 4 AND path IN (SELECT path FROM ({_LINES}) WHERE p_partkey % 5 <> 4)".format(where=_SOME)


@query(f"SELECT path FROM ({_TOUCHED})")
def git_files_all(spark, d):
    return git.changed_files(spark, _work_tree(spark, d).root, "all")


@query(f"SELECT path FROM ({_TOUCHED}) WHERE p_size = 1")
def git_files_staged(spark, d):
    return git.changed_files(spark, _work_tree(spark, d).root, "staged")


@query(
    f"SELECT path, CAST(count(*) AS BIGINT) AS removed FROM ({_LINES}) WHERE p_partkey % 5 = 4 AND path IN (SELECT path FROM ({_TOUCHED}) WHERE p_size <> 1) GROUP BY path".format(where=_SOME)
)
def git_diff_unstaged(spark, d):
    """Lines taken out, by file, as the snippets show them."""
    parsed = git.diff_files(spark, _work_tree(spark, d).root, "unstaged")
    lines = parsed.select("path", F.explode("snippets").alias("s")).select("path", F.explode(F.split("s", "\n")).alias("line"))
    return lines.where(F.startswith("line", F.lit("-"))).groupBy("path").agg(F.count("*").alias("removed"))


@query(f"SELECT path, CAST(count(*) + max(CASE WHEN p_size % 6 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS symbols FROM ({_LINES}) WHERE path IN (SELECT path FROM ({_TOUCHED}) ORDER BY path LIMIT 4) GROUP BY path".format(where=_SOME))
def snapshot_git(spark, d):
    """The first changed files, with the number of symbols that the index has of each."""
    files = _work_tree(spark, d).snapshot_git("all", 4)["files"]
    return spark.createDataFrame([(f["path"], len(f["symbols"])) for f in files], "path string, symbols bigint")


_EDGES = f"SELECT DISTINCT path, CASE WHEN p_size % 6 = 5 THEN 'm.' || module ELSE module END AS source FROM ({_LINES})".format(where=_SOME)


@query(
    f"""SELECT t.path AS file, 'direct_deps' AS section, source AS value FROM ({_TOUCHED}) t JOIN ({_EDGES}) e ON e.path = t.path
UNION ALL SELECT DISTINCT t.path, 'dependents', b.path FROM ({_TOUCHED}) t JOIN ({_EDGES}) a ON a.path = t.path JOIN ({_EDGES}) b ON b.source = a.source WHERE b.path <> t.path"""
)
def diff_impact_git(spark, d):
    """What the changed files import, and who else imports it."""
    rows = [(i["file"], k, v) for i in _work_tree(spark, d).diff_impact_git("all", 1) for k in ("direct_deps", "dependents") for v in i[k]]
    return spark.createDataFrame(rows, "file string, section string, value string")


# ---------------------------------------------------------------- trace, merge, snippets
@query(None)
def trace_symbols(spark, d):
    """The way between two symbols through files that share an import."""
    t = V.tables(spark, d)
    t.imports = V.edges(spark, d)
    t.symbols = V.symbols(spark, d).withColumns({"path": F.col("ord").cast("string"), "name": F.concat(F.lit("S"), F.col("ord").cast("string")), "kind": F.lit("function")})
    r = context.trace_symbols(t, "S17", "S150")
    return spark.createDataFrame([(i, p, r["path"][0], r["metadata"]) for i, p in enumerate(r["files"])], "pos int, path string, first string, metadata string")


ORACLE["trace_symbols"] = ORACLE["trace_path"].replace("SELECT 0 AS pos", ", w AS (SELECT 0 AS pos", 1) + ") SELECT pos, path, '17:17' AS first, 'found path through ' || (SELECT count(*) FROM w) || ' files' AS metadata FROM w"


@query("SELECT 'c' || (conv_id % 7) AS path, CAST(count(*) AS INTEGER) AS hunks, CAST(sum(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS additions, min(conv_id * 1000 + turn) + 1 AS first_start FROM conversations GROUP BY 1")
def diff_merge(spark, d):
    """Diffs of several groups put together by path, hunks in their order."""
    rows = V.read(spark, d, "conversations").select("conv_id", "turn")
    at = (F.col("conv_id") * 1000 + F.col("turn") + 1).cast("string")
    mark = F.when(F.pmod("turn", F.lit(2)) == 0, "+").otherwise("-")
    hunk = F.concat(F.lit("@@ -"), at, F.lit(" +"), at, F.lit(" @@\n"), mark, F.lit("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", hunk.alias("h")))), lambda x: x["h"]), "\n")
    name = F.concat(F.lit("c"), F.pmod("conv_id", F.lit(7)).cast("string"))
    diffs = rows.groupBy("conv_id").agg(body.alias("body")).select(F.col("conv_id").cast("int").alias("grp"), F.concat(F.lit("diff --git a/x b/"), name, F.lit("\n+++ b/"), name, F.lit("\n"), F.col("body")).alias("diff"))
    merged = diff.merge_files(diff.parse_diffs(diffs, 0))
    adds = F.aggregate("snippets", F.lit(0).cast("bigint"), lambda a, s: a + F.when(F.startswith(s, F.lit("+")), 1).otherwise(0))
    return merged.select("path", F.size("hunks").alias("hunks"), adds.alias("additions"), F.col("hunks")[0]["new_start"].cast("bigint").alias("first_start"))


_BODY = "SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents"


@query(
    f"""WITH l AS (SELECT doc_id, pos, contains(raw, 'tion') AS hit, CASE WHEN contains(raw, 'tion') THEN '+' ELSE ' ' END || raw AS line FROM ({_BODY})), e AS (SELECT doc_id, max(pos) AS e FROM l GROUP BY 1),
 s AS (SELECT doc_id, greatest(pos - 1, 0) AS a, least(pos + 1, e) AS b FROM l JOIN e USING (doc_id) WHERE hit),
 m AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
 i AS (SELECT *, sum(CASE WHEN far IS NULL OR a > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b) AS island FROM m),
 w AS (SELECT doc_id, island, min(a) AS a, max(b) AS b FROM i GROUP BY ALL)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS snippet FROM w JOIN l USING (doc_id) WHERE pos BETWEEN a AND b GROUP BY doc_id, island"""
)
def diff_snippets(spark, d):
    """Snippets with a line of context, of each document as a diff of one hunk whose lines with a mark were added."""
    docs = V.read(spark, d, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.when(F.contains(x, F.lit("tion")), "+").otherwise(" "), x))
    text = F.concat(F.lit("diff --git a/x b/x\n+++ b/x\n@@ -1 +1 @@\n"), F.array_join(lines, "\n"))
    parsed = diff.parse_diffs(docs.where(F.contains("text", F.lit("tion"))).select(F.col("doc_id").cast("int").alias("grp"), text.alias("diff")), 1)
    return parsed.select(F.col("grp").cast("bigint").alias("doc_id"), F.explode("snippets").alias("s")).select("doc_id", F.md5("s").alias("snippet"))
