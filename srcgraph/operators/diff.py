"""Unified diffs: parsing, changed snippets, merging by path."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.operators.graph import merged_windows

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
_HUNK = re.compile(HUNK)
DIFF_SCHEMA = "grp int, file_no int, path string, hunks array<struct<old_start:int,old_lines:int,new_start:int,new_lines:int,content:string>>, snippets array<string>"
_PARSED = pa.schema(
    {
        "grp": pa.int32(),
        "file_no": pa.int32(),
        "path": pa.string(),
        "hunks": pa.list_(pa.struct({"old_start": pa.int32(), "old_lines": pa.int32(), "new_start": pa.int32(), "new_lines": pa.int32(), "content": pa.string()})),
        "snippets": pa.list_(pa.string()),
    }
)
#: Characters of diffs whose files are held as Python values before they go to the JVM.
PARSE_CHARS = 1 << 20


def hunk_header(line: str) -> tuple[int, int, int, int]:
    m = _HUNK.match(line)
    if not m:
        raise ValueError(f"invalid diff hunk header: {line!r}")
    old, old_n, new, new_n = m.groups()
    return int(old), int(old_n or 1), int(new), int(new_n or 1)


def hunk_headers(lines: DataFrame, column: str = "line") -> DataFrame:
    """``lines`` plus old_start, old_lines, new_start, new_lines where the line is a hunk header."""
    got = [F.regexp_extract(column, HUNK, i) for i in range(1, 5)]
    rows = lines.where(F.rlike(F.col(column), F.lit(HUNK)))
    names = ("old_start", "old_lines", "new_start", "new_lines")
    return rows.withColumns({n: F.coalesce(F.nullif(g, F.lit("")).cast("int"), F.lit(1)) for n, g in zip(names, got, strict=True)})


def snippets(content: str, context: int) -> list[str]:
    """Changed lines with ``context`` lines around them; overlapping or adjoining stretches are one."""
    if not content.strip():
        return []
    lines = content.split("\n")
    spans: list[list[int]] = []
    for i, line in enumerate(lines):
        if line[:1] not in ("+", "-") or not line:
            continue
        lo, hi = max(i - context, 0), min(i + context, len(lines) - 1)
        if spans and lo <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    return ["\n".join(lines[a : b + 1]) for a, b in spans] or [content]


def _path_field(line: str, at: int) -> str:
    fields = line.split()
    return fields[at].removeprefix("b/") if len(fields) > at and fields[at] != "/dev/null" else ""


def parse_diff(text: str, context: int = 0) -> list[dict]:
    """[{path, hunks, snippets}] of a diff; files without a hunk or a path are left out."""
    out: list[dict] = []
    file: dict | None = None
    body: list[str] | None = None

    def close_hunk() -> None:
        nonlocal body
        if file is not None and body is not None:
            # blank lines that lead a hunk leave no trace
            while body and body[0] == "":
                body.pop(0)
            file["hunks"][-1]["content"] = "\n".join(body)
            file["snippets"] += snippets(file["hunks"][-1]["content"], context)
        body = None

    def close_file() -> None:
        close_hunk()
        if file is not None and file["path"] and file["hunks"]:
            out.append(file)

    for line in text.split("\n"):
        if line.startswith("diff --git "):
            close_file()
            fields = line.split()
            file = {"path": fields[3].removeprefix("b/") if len(fields) > 3 else "", "hunks": [], "snippets": []}
        elif line.startswith("+++ "):
            if file is not None:
                file["path"] = _path_field(line, 1) or file["path"]
        elif line.startswith("@@ "):
            if file is not None:
                close_hunk()
                old, old_n, new, new_n = hunk_header(line)
                file["hunks"].append({"old_start": old, "old_lines": old_n, "new_start": new, "new_lines": new_n, "content": ""})
                body = []
        elif body is not None:
            body.append(line)
    close_file()
    return out


def _parsed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PARSED)], schema=_PARSED)


def _parse_batches(context: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for grp, text in zip(batch.column(0), batch.column(1), strict=True):
                got = text.as_py() or ""
                rows += [(grp.as_py(), i, f["path"], f["hunks"], f["snippets"]) for i, f in enumerate(parse_diff(got, context))]
                held += len(got)
                if held >= PARSE_CHARS:
                    yield _parsed(rows)
                    rows, held = [], 0
            yield _parsed(rows)
            batch = text = rows = None  # else they stay while the next batch is read

    return run


def parse_diffs(diffs: DataFrame, context: int = 0) -> DataFrame:
    """One row a file of each (grp, diff) row. Besides its input batch, a worker holds the files of ``PARSE_CHARS`` of diffs, or of one diff."""
    return diffs.select("grp", "diff").mapInArrow(_parse_batches(context), DIFF_SCHEMA)


def merge_files(parsed: DataFrame) -> DataFrame:
    """One row a path, hunks and snippets of all groups in their order."""
    parts = F.array_sort(F.collect_list(F.struct("grp", "file_no", "hunks", "snippets")))
    return parsed.groupBy("path").agg(parts.alias("_p")).select("path", F.flatten(F.col("_p.hunks")).alias("hunks"), F.flatten(F.col("_p.snippets")).alias("snippets")).orderBy("path")


def snippet_windows(lines: DataFrame, changed, context: int, by: list[str]) -> DataFrame:
    """(by, first, last): merged stretches around changed lines of (by, pos, ...) rows, all in joins and windows."""
    last = lines.groupBy(*by).agg(F.max("pos").alias("_end"))
    hit = lines.where(changed).join(last, by)
    spans = hit.select(*by, F.greatest(F.col("pos") - context, F.lit(0)).alias("first"), F.least(F.col("pos") + context, F.col("_end")).alias("last"))
    return merged_windows(spans, by)


def changed_files(*groups: DataFrame) -> DataFrame:
    """Union of (path) rows, each once, in order."""
    out = groups[0].select("path")
    for g in groups[1:]:
        out = out.unionByName(g.select("path"))
    return out.distinct().orderBy("path")
