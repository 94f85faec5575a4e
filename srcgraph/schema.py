"""Tables of an index and the order that every operator keeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FUNCTION, METHOD, TYPE, VARIABLE, CONSTANT = "function", "method", "type", "variable", "constant"
PACKAGE, IMPORT, CLASS, INTERFACE, MODULE = "package", "import", "class", "interface", "module"
DEFINING = (FUNCTION, METHOD, CLASS, TYPE, INTERFACE)

#: extension -> language
LANGUAGES = {".go": "go", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".py": "python", ".rs": "rust", ".java": "java"}
SKIPPED_DIRS = frozenset("node_modules vendor __pycache__ .git .idea .vscode target build dist venv .venv".split())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


FILES = _struct(("path", T.StringType()), ("language", T.StringType()), ("content_hash", T.StringType()), ("size", T.LongType()), ("indexed_at", T.TimestampType()))
SYMBOL = _struct(("ord", T.IntegerType()), ("name", T.StringType()), ("kind", T.StringType()), ("line", T.IntegerType()), ("end_line", T.IntegerType()), ("signature", T.StringType()), ("parent", T.StringType()))
EDGE = _struct(("ord", T.IntegerType()), ("source", T.StringType()), ("line", T.IntegerType()))
SYMBOLS = T.StructType([T.StructField("path", T.StringType(), True), *SYMBOL.fields])
IMPORTS = T.StructType([T.StructField("path", T.StringType(), True), *EDGE.fields])
CONTENT = _struct(("path", T.StringType()), ("text", T.StringType()))

SYMBOL_COLUMNS = ("path", "name", "kind", "line", "end_line", "signature", "parent")
#: Identity of a symbol; ``ord`` is its place among those of its file.
KEY = ("path", "name", "kind", "line")


@dataclass
class Tables:
    """An index: ``files``, ``symbols``, ``imports`` and, for text search, ``content`` (path, text)."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    content: DataFrame | None = None


class NotFoundError(LookupError):
    """A file or symbol that the index doesn't hold."""


class QuerySyntaxError(ValueError):
    """A match expression that doesn't parse."""
