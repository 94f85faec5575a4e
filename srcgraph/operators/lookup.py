"""Point lookups, scans and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions import scalar as S
from srcgraph.schema import DEFINING, METHOD, SYMBOL_COLUMNS, Tables


def list_files(t: Tables, language: str | None = None) -> DataFrame:
    out = t.files if language is None else t.files.where(F.col("language") == language)
    return out.orderBy("path")


def get_file(t: Tables, path: str) -> DataFrame:
    """One row, or none for an unknown path."""
    return t.files.where(F.col("path") == path)


def by_name(t: Tables, name: str) -> DataFrame:
    """Declarations of a name, by kind, then place."""
    return t.symbols.where(F.col("name") == name).orderBy("kind", "path", "ord")


def definitions(t: Tables, name: str) -> DataFrame:
    return t.symbols.where((F.col("name") == name) & F.col("kind").isin(*DEFINING)).orderBy("kind", "path", "ord")


def first_definition(t: Tables, name: str) -> DataFrame:
    return definitions(t, name).limit(1)


def references(t: Tables, name: str) -> DataFrame:
    """Declarations of a name but for those at the place of its first definition; none where it has no definition."""
    first = first_definition(t, name).select(F.col("path").alias("_p"), F.col("line").alias("_l"))
    # one row at most on the right, so the product is a filter
    out = t.symbols.where(F.col("name") == name).crossJoin(F.broadcast(first))
    return out.where(~((F.col("path") == F.col("_p")) & (F.col("line") == F.col("_l")))).drop("_p", "_l").orderBy("kind", "path", "ord")


def file_symbols(t: Tables, path: str) -> DataFrame:
    return t.symbols.where(F.col("path") == path).orderBy("line", "ord")


def imports_of(t: Tables, path: str) -> DataFrame:
    return t.imports.where(F.col("path") == path).orderBy("ord")


def importers_of(t: Tables, source: str) -> DataFrame:
    """Import rows whose source is like ``%source%``."""
    return t.imports.where(S.source_like(F.col("source"), source)).orderBy("path", "ord")


def importers_of_imports(t: Tables, paths: Column | DataFrame) -> DataFrame:
    """(of, of_ord, path, ord, source, line): for each import of the files picked by ``paths``, all import rows like it.

    Duplicates and the files themselves are kept. Only distinct sources meet
    distinct patterns in a nested loop; their pairs lead back to rows by equality.
    """
    mine = t.imports.join(paths.select("path"), "path", "left_semi") if isinstance(paths, DataFrame) else t.imports.where(paths)
    mine = mine.select(F.col("path").alias("of"), F.col("ord").alias("of_ord"), F.col("source").alias("_s"))
    pairs = t.imports.select("source").distinct().join(mine.select("_s").distinct(), S.source_like(F.col("source"), F.col("_s")))
    return t.imports.join(pairs, "source").join(mine, "_s").select("of", "of_ord", *t.imports.columns)


def stats(t: Tables) -> DataFrame:
    """One row: numbers of files, symbols and imports."""
    counts = [d.agg(F.count("*").alias(n)) for d, n in ((t.files, "files"), (t.symbols, "symbols"), (t.imports, "imports"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


def methods_named(t: Tables, name: str) -> DataFrame:
    return by_name(t, name).where(F.col("kind") == METHOD)


def symbol_view(df: DataFrame) -> DataFrame:
    return df.select(*SYMBOL_COLUMNS)


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """One row a key: the first of its file."""
    cols = [c for c in symbols.columns if c not in ("path", "name", "kind", "line")]
    first = symbols.groupBy("path", "name", "kind", "line").agg(F.min(F.struct("ord", *[c for c in cols if c != "ord"])).alias("_f"))
    return first.select("path", "name", "kind", "line", "_f.*").select(*symbols.columns)
