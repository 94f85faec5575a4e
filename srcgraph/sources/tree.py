"""Source trees: walking, language detection, hashing and extraction."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from srcgraph.schema import EDGE, SKIPPED_DIRS, SYMBOL
from srcgraph.sources.registry import DEFAULT, Registry

FILES_PER_TASK = 200

SCANNED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("symbols", T.ArrayType(SYMBOL)),
        T.StructField("imports", T.ArrayType(EDGE)),
    ]
)


def detect_language(path: str) -> str | None:
    return DEFAULT.detect(path)


def is_skipped(name: str) -> bool:
    return name in SKIPPED_DIRS


def walk(root: str, registry: Registry = DEFAULT) -> Iterator[str]:
    """Paths of source files under ``root``, relative to it, in lexical order; what can't be read is passed over.

    Spark's own file listing hides names that begin with ``_`` or ``.``, and so
    would lose ``__init__.py``.
    """
    try:
        entries = sorted(os.scandir(root), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        if e.is_dir(follow_symlinks=False):
            if not e.name.startswith(".") and not is_skipped(e.name):
                yield from (f"{e.name}/{p}" for p in walk(e.path, registry))
        elif registry.detect(e.name):
            yield e.name


def paths(spark: SparkSession, root: str, registry: Registry = DEFAULT) -> DataFrame:
    """(path) of the source files under ``root``, spread over tasks by their number."""
    found = [(p,) for p in walk(root, registry)]
    df = spark.createDataFrame(found, "path string")
    return df.repartition(max(1, len(found) // FILES_PER_TASK))


def _scan_one(root: str, path: str, old: str | None, registry: Registry) -> tuple:
    language = registry.detect(path)
    try:
        with open(os.path.join(root, path), "rb") as f:
            data = f.read()
    except OSError:
        return path, language, None, None, "unreadable", None, None, None
    digest = hashlib.sha256(data).hexdigest()
    if digest == old:
        return path, language, digest, len(data), "unchanged", None, None, None
    state = "new" if old is None else "changed"
    text = data.decode("utf-8", "replace")
    try:
        symbols, imports = registry.get(language).parse(text)
    except (ValueError, RecursionError, AttributeError):
        return path, language, digest, len(data), "failed", None, None, None
    return path, language, digest, len(data), state, text, symbols, imports


def scan(listed: DataFrame, root: str, registry: Registry = DEFAULT) -> DataFrame:
    """Read, hash and extract the files of (path, old_hash); files whose hash is the old one aren't extracted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo : lo + 64]
                rows = [_scan_one(root, p, o if isinstance(o, str) else None, registry) for p, o in zip(part["path"], part["old_hash"], strict=True)]
                yield pd.DataFrame(rows, columns=SCANNED.fieldNames()).astype({"size": "Int64"})

    return listed.select("path", "old_hash").mapInPandas(run, SCANNED)


def read_texts(listed: DataFrame, root: str) -> DataFrame:
    """(path, text) of the files as they are on disk now; unreadable ones are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        rows.append((p, f.read().decode("utf-8", "replace")))
                except OSError:
                    pass
            yield pd.DataFrame(rows, columns=["path", "text"])

    return listed.select("path").mapInPandas(run, "path string, text string")
