"""The engine behind the command line, HTTP and tool-call surfaces: operators over a stored index, results as plain values."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.operators import context, graph, grep, lookup, rank
from srcgraph.schema import SYMBOL_COLUMNS, Tables
from srcgraph.sources import git, tree
from srcgraph.sources.store import Store


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _symbol(r: dict) -> dict:
    """A symbol as the surfaces show it; empty signature and parent are left out."""
    out = {"name": r["name"], "kind": r["kind"], "file_path": r["path"], "line": r["line"], "end_line": r["end_line"]}
    return out | {k: r[k] for k in ("signature", "parent") if r.get(k)}


def _edge(r: dict) -> dict:
    return {"file_path": r["path"], "source": r["source"], "line": r["line"]}


def _totals(r: dict) -> dict:
    """Counts under the names of the surfaces, beside their own."""
    names = {"files": "total_files", "symbols": "total_symbols", "imports": "total_imports", "indexed": "indexed_files", "skipped": "skipped_files", "failed": "failed_files"}
    return r | {names[k]: v for k, v in r.items() if k in names}


class Engine:
    def __init__(self, spark: SparkSession, root: str, db: str):
        self.spark, self.root, self.store = spark, root, Store(spark, db)

    @property
    def tables(self) -> Tables:
        return self.store.tables()

    def _symbols(self, df: DataFrame) -> list[dict]:
        return [_symbol(r) for r in _rows(df.select(*SYMBOL_COLUMNS))]

    # ------------------------------------------------------------ index
    def index(self, incremental: bool = False) -> dict:
        return _totals(asdict(self.store.index(self.root, incremental)))

    def stats(self) -> dict:
        return _totals(_rows(lookup.stats(self.tables))[0])

    def files(self, language: str | None = None) -> list[dict]:
        return _rows(lookup.list_files(self.tables, language or None).select("path", "language", "content_hash", "size"))

    # ------------------------------------------------------------ search
    def search(self, q: str, kind: str | None = None, limit: int = 50, hybrid: bool = False) -> list[dict]:
        args = (self.tables.symbols, self.store.postings(), q, kind or None, limit)
        out = rank.hybrid(*args, weights=self.store.weights()) if hybrid else rank.ranked(*args)
        return self._symbols(out.orderBy("rank"))

    def definitions(self, name: str) -> list[dict]:
        return self._symbols(lookup.definitions(self.tables, name))

    def references(self, name: str) -> list[dict]:
        return self._symbols(lookup.references(self.tables, name))

    def file_symbols(self, path: str) -> list[dict]:
        return self._symbols(lookup.file_symbols(self.tables, path))

    def text(self, q: str, file: str = "", limit: int = 50) -> list[dict]:
        """Lines of the indexed files as they are on disk now."""
        wanted = self.tables.files.select("path")
        if file:
            wanted = wanted.where(F.contains("path", F.lit(file)))
        found = grep.search(tree.read_texts(wanted, self.root), q, "", limit)
        return [{"file_path": r["path"], "line": r["line"], "content": r["content"]} for r in _rows(found)]

    # ------------------------------------------------------------ imports
    def imports(self, file: str) -> list[dict]:
        return [_edge(r) for r in _rows(lookup.imports_of(self.tables, file))]

    def importers(self, source: str) -> list[dict]:
        return [_edge(r) for r in _rows(lookup.importers_of(self.tables, source))]

    def dependencies(self, file: str, depth: int = 10) -> list[str]:
        return sorted(r["node"] for r in _rows(graph.dependencies(self.tables.imports, [file], depth)))

    def related(self, file: str, top: int = 10) -> list[str]:
        return [r["path"] for r in _rows(graph.related(self.tables.imports, file, top))]

    # ------------------------------------------------------------ context
    def map(self) -> dict:
        """The root with all directories as its children, ``.`` among them, so that they add up to it."""
        rows = _rows(context.directory_map(self.tables))
        nodes = [{k: r[k] for k in ("path", "files", "symbols", "functions", "types", "methods")} for r in rows]
        root = next(n for n, r in zip(nodes, rows, strict=True) if r["is_root"])
        children = [n for n, r in zip(nodes, rows, strict=True) if not r["is_root"]]
        return root | ({"children": children} if children else {})

    @staticmethod
    def _summary(r: dict) -> dict:
        out = {
            "path": r["path"],
            "language": r["language"],
            "symbols": [_symbol(s | {"path": r["path"]}) for s in r["symbols"] or []],
            "imports": [{"file_path": r["path"], "source": i["source"], "line": i["line"]} for i in r["imports"] or []],
        }
        users = [{"file_path": i["importer"], "source": i["source"], "line": i["line"]} for i in r["importers"] or []]
        return out | ({"importers": users} if users else {})

    def _explained(self, paths: list[str]) -> list[dict]:
        t = self.tables
        asked = self.spark.createDataFrame([(p,) for p in paths], "path string")
        by = {r["path"]: self._summary(r) for r in _rows(context.explain(t, asked))}
        return [by[p] for p in paths if p in by]

    def explain(self, file: str) -> dict:
        return self._summary(_rows(context.explain_file(self.tables, file))[0])

    def context(self, name: str) -> dict:
        rows = _rows(context.symbol_context(self.tables, self.store.postings(), name).orderBy("section", "pos"))
        part = {k: [_symbol(r) for r in rows if r["section"] == k] for k in ("definition", "method", "related")}
        return {"definition": part["definition"][0]} | ({"methods": part["method"]} if part["method"] else {}) | {"related": part["related"]}

    def snapshot(self, q: str, limit: int = 5) -> dict:
        t, post = self.tables, self.store.postings()
        t.content = tree.read_texts(t.files, self.root)
        files = self._explained([r["path"] for r in _rows(context.snapshot_files(t, post, q, limit))])
        symbols = self._symbols(context.snapshot_symbols(t, post, q))
        summary = f"Found {len(files)} related files for query '{q}': " + ", ".join(f["path"] for f in files)
        return {"query": q, "files": files, "symbols": symbols, "summary": summary}

    def trace(self, from_name: str, to_name: str) -> dict:
        return context.trace_symbols(self.tables, from_name, to_name)

    def diff_impact(self, file: str, depth: int = 3) -> dict:
        return self._impacts([file], depth)[0]

    def _impacts(self, files: list[str], depth: int) -> list[dict]:
        rows = _rows(context.diff_impact(self.tables, files, depth)) if files else []
        keys = ("direct_deps", "all_deps", "dependents", "recommends")
        return [{"file": f} | {k: sorted(r["value"] for r in rows if r["file"] == f and r["section"] == k) for k in keys} for f in files]

    # ------------------------------------------------------------ git
    def git_files(self, state: str = "") -> list[str]:
        return [r["path"] for r in _rows(git.changed_files(self.spark, self.root, git.parse_state(state)))]

    def git_diff(self, state: str = "", lines: int = 0) -> list[dict]:
        return _rows(git.diff_files(self.spark, self.root, git.parse_state(state), lines))

    def snapshot_git(self, state: str = "", limit: int = 5) -> dict:
        state = git.parse_state(state)
        changed = self.git_files(state)
        limit = limit if limit > 0 else 5
        files = self._explained(changed)[:limit] if changed else []
        symbols = [s for f in files for s in f["symbols"]]
        summary = f"Found {len(files)} changed files ({state})" if changed else f"No changed files ({state})"
        return {"query": f"git:{state}", "files": files, "symbols": symbols, "summary": summary}

    def diff_impact_git(self, state: str = "", depth: int = 3) -> list[dict]:
        return self._impacts(self.git_files(state), depth)
