"""Composite operators: directory map, file and symbol context, snapshot, impact, trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from srcgraph.functions import scalar as S
from srcgraph.operators import fts, graph, grep, lookup, rank
from srcgraph.schema import SYMBOL_COLUMNS, NotFoundError, Tables

_GROUPS = {"functions": ("function", "variable", "constant"), "types": ("type", "interface"), "methods": ("method",)}


def directory_map(t: Tables) -> DataFrame:
    """(path, is_root, files, symbols, functions, types, methods) of every directory, and of all of them as the root ``.``.

    Symbols are counted by file before files are joined, so no file counts twice.
    """
    kinds = [F.count_if(F.col("kind").isin(*v)).alias(k) for k, v in _GROUPS.items()]
    per_file = t.symbols.groupBy("path").agg(F.count("*").alias("symbols"), *kinds)
    rows = t.files.select("path", S.dirname(F.col("path")).alias("dir")).join(per_file, "path", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("symbols", *_GROUPS)]
    out = rows.rollup("dir").agg(F.grouping("dir").alias("_all"), F.count("path").alias("files"), *sums)
    return out.select(F.coalesce("dir", F.lit(".")).alias("path"), (F.col("_all") == 1).alias("is_root"), "files", "symbols", *_GROUPS).orderBy(F.desc("is_root"), "path")


def directory_tree(t: Tables) -> DataFrame:
    """``directory_map`` with each directory added to all directories above it."""
    flat = directory_map(t).where(~F.col("is_root"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    cols = ("files", "symbols", *_GROUPS)
    return flat.select(F.explode(above).alias("path"), *cols).groupBy("path").agg(*[F.sum(c).alias(c) for c in cols]).orderBy("path")


def explain(t: Tables, paths: DataFrame) -> DataFrame:
    """One nested row for each known file of ``paths``: path, language, symbols, imports, importers."""
    known = t.files.join(paths.select("path").distinct(), "path", "left_semi").select("path", "language")
    picked = known.select("path")
    syms = t.symbols.join(picked, "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "ord", "name", "kind", "end_line", "signature", "parent"))).alias("symbols"))
    mine = t.imports.join(picked, "path", "left_semi")
    imps = mine.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "source", "line"))).alias("imports"))
    near = lookup.importers_of_imports(t, picked)
    users = near.groupBy(F.col("of").alias("path")).agg(F.array_sort(F.collect_list(F.struct("of_ord", F.col("path").alias("importer"), "ord", "source", "line"))).alias("importers"))
    return known.join(syms, "path", "left").join(imps, "path", "left").join(users, "path", "left")


def explain_file(t: Tables, path: str) -> DataFrame:
    out = explain(t, t.files.sparkSession.createDataFrame([(path,)], "path string"))
    if out.isEmpty():
        raise NotFoundError(f"file not found: {path}")
    return out


def symbol_context(t: Tables, post: DataFrame, name: str) -> DataFrame:
    """(section, pos, symbol columns): the definition, same-named methods, and what a search for the name finds besides."""
    first = lookup.first_definition(t, name)
    if first.isEmpty():
        raise NotFoundError(f"symbol not found: {name}")
    pos = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("kind", "path", "ord"))
    head = first.select(F.lit("definition").alias("section"), F.lit(1).alias("pos"), *SYMBOL_COLUMNS)
    methods = lookup.methods_named(t, name).select(F.lit("method").alias("section"), pos.alias("pos"), *SYMBOL_COLUMNS)
    at = first.select(F.col("path").alias("_p"), F.col("line").alias("_l"))
    near = rank.ranked(t.symbols, post, name, None, 20).crossJoin(F.broadcast(at)).where(~((F.col("path") == F.col("_p")) & (F.col("line") == F.col("_l"))))
    near = near.select(F.lit("related").alias("section"), F.col("rank").alias("pos"), *SYMBOL_COLUMNS)
    return head.unionByName(methods).unionByName(near)


def snapshot_files(t: Tables, post: DataFrame, query: str, max_files: int = 5) -> DataFrame:
    """(pos, path, why): files of the best symbols, then files whose text holds the query.

    One file found by text is added even where symbols fill ``max_files``.
    """
    n = max_files if max_files > 0 else 5
    found = rank.ranked(t.symbols, post, query, None, 20)
    by_symbol = found.groupBy("path").agg(F.min("rank").alias("r"))
    whole = W.partitionBy(F.lit(0))
    known = by_symbol.join(t.files.select("path"), "path", "left_semi").withColumn("pos", F.row_number().over(whole.orderBy("r"))).where(F.col("pos") <= n)
    first = known.select("pos", "path", F.lit("symbol").alias("why"))
    if t.content is None:
        return first.orderBy("pos")
    lines = grep.search(t.content, query, "", 10).groupBy("path").agg(F.min("line").alias("line"))
    new = lines.join(by_symbol, "path", "left_anti").join(t.files.select("path"), "path", "left_semi").withColumn("k", F.row_number().over(whole.orderBy("path")))
    room = first.agg(F.count("*").alias("_n"))
    new = new.crossJoin(F.broadcast(room)).where(F.col("k") <= F.greatest(F.lit(1), F.lit(n) - F.col("_n")))
    return first.unionByName(new.select((F.col("_n") + F.col("k")).cast("int").alias("pos"), "path", F.lit("text").alias("why"))).orderBy("pos")


def snapshot_symbols(t: Tables, post: DataFrame, query: str) -> DataFrame:
    """The best symbol of each file found, in rank order."""
    found = rank.ranked(t.symbols, post, query, None, 20)
    return found.withColumn("_k", F.row_number().over(W.partitionBy("path").orderBy("rank"))).where("_k = 1").drop("_k").orderBy("rank")


def recommended_tests(paths: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(start, value): test files of the given (start, node) rows; with ``files``, only those that exist."""
    out = paths.select("start", S.test_path(F.col("node")).alias("value")).distinct()
    return out if files is None else out.join(files.select(F.col("path").alias("value")), "value", "left_semi").select("start", "value")


def diff_impact(t: Tables, paths: list[str] | DataFrame, depth: int = 3, existing_only: bool = False) -> DataFrame:
    """(file, section, value) for each file: direct_deps, all_deps, dependents, recommends. All files advance together."""
    spark = t.imports.sparkSession
    depth = depth if depth > 0 else 3
    start = spark.createDataFrame([(p,) for p in paths], "node string") if isinstance(paths, list) else paths.select("node")
    direct = t.imports.join(start.select(F.col("node").alias("path")), "path", "left_semi").select(F.col("path").alias("start"), F.col("source").alias("value")).distinct()
    deps = graph.dependencies(t.imports, start, depth).select("start", F.col("node").alias("value"))
    users = graph.dependents(t.imports, start, depth)
    tests = recommended_tests(users, t.files if existing_only else None)
    parts = (("direct_deps", direct), ("all_deps", deps), ("dependents", users.select("start", F.col("node").alias("value"))), ("recommends", tests))
    out = [d.select(F.col("start").alias("file"), F.lit(k).alias("section"), "value") for k, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def trace_symbols(t: Tables, from_name: str, to_name: str) -> dict:
    """from, to, path, files and metadata of the way between the files that define two symbols."""
    ends = []
    for name in (from_name, to_name):
        row = lookup.first_definition(t, name).select("path", "line").first()
        if row is None:
            raise NotFoundError(f"symbol not found: {name}")
        ends.append(row)
    if ends[0].path == ends[1].path:
        return {"from": from_name, "to": to_name, "path": [f"{ends[0].path}:{ends[0].line}"], "files": [ends[0].path], "metadata": "same file"}
    chain = graph.trace(t.imports, ends[0].path, ends[1].path, 5)
    first = F.min(F.struct("line", "ord"))["line"]
    named = t.symbols.where(F.col("name").isin(from_name, to_name)).groupBy("path").agg(first.alias("line"))
    rows = chain.join(named, "path", "left").orderBy("pos").collect()
    return {"from": from_name, "to": to_name, "path": [f"{r.path}:{r.line}" for r in rows if r.line is not None], "files": [r.path for r in rows], "metadata": f"found path through {len(rows)} files"}


def postings_of(t: Tables) -> DataFrame:
    return fts.postings(t.symbols)
