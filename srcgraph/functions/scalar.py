"""Scalar functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcgraph.schema import LANGUAGES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A LIKE escape that no path or pattern holds, so that ``\\`` and others mean themselves.
_NO_ESCAPE = "\x01"


def _fold_table() -> tuple[str, str]:
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            src.append(chr(cp))
            dst.append(base[0])
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _fold_table()


def language_of(path: Column) -> Column:
    """Language by the last extension, whatever its case; null where unknown."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), ext)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def match_score(name: Column, query: str) -> Column:
    """3 exact, 2 prefix, 1 contains, 0 otherwise; case doesn't count."""
    n, q = F.lower(name), F.lit(query.lower())
    return F.when(n == q, 3).when(F.startswith(n, q), 2).when(F.contains(n, q), 1).otherwise(0)


def source_like(source: Column, pattern: Column | str) -> Column:
    """``source LIKE %pattern%`` where ``%`` and ``_`` of the pattern are wildcards and only ASCII case folds."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    text = F.translate(source, _UPPER, _LOWER)
    wanted = F.concat(F.lit("%"), F.translate(p, _UPPER, _LOWER), F.lit("%"))
    return F.like(text, wanted, F.lit(_NO_ESCAPE))


def semantic_text(*cols: str) -> Column:
    return F.concat_ws(" ", *cols)


def identifier_parts(word: Column) -> Column:
    """Camel-case parts: a break before an upper-case letter that follows or precedes a lower-case one."""
    return F.split(word, r"(?<=\p{Ll})(?=\p{Lu})|(?<!^)(?=\p{Lu}\p{Ll})")


def semantic_tokens(text: Column) -> Column:
    """Runs of letters and digits, split at camel-case borders, lower-cased."""
    runs = F.filter(F.split(text, r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    return F.transform(F.flatten(F.transform(runs, identifier_parts)), F.lower)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def fold_text(text: str) -> str:
    """``fold`` for a query string."""
    return "".join(c for c in text.lower().translate(str.maketrans(_ACCENTED, _PLAIN)) if unicodedata.category(c) != "Mn")


def index_tokens(text: Column) -> Column:
    """Tokens of the full-text index: runs of letters, numbers and private-use characters, folded."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"']+|[\"']+$", "")


def test_path(path: Column) -> Column:
    """The test file of a path: the first ``.go`` becomes ``_test.go``; a test file is its own."""
    return F.when(F.endswith(path, F.lit("_test.go")), path).otherwise(F.regexp_replace(path, r"^(.*?)\.go", "$1_test.go"))


def symbol_key() -> Column:
    return F.concat_ws("|", "path", "name", "kind", F.col("line").cast("string"))


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def symbol_line() -> Column:
    """``name kind path:line`` in fixed columns."""
    return F.format_string("%-40s %-10s %s:%d", "name", "kind", "path", F.col("line").cast("bigint"))


def match_line() -> Column:
    return F.format_string("%s:%d %s", "path", F.col("line").cast("bigint"), "content")
