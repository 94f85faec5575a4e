"""Git as a source: changed files and diffs of a working tree."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession

from srcgraph.operators import diff

STATES = ("unstaged", "staged", "all")


class GitError(RuntimeError):
    pass


def parse_state(value: str | None) -> str:
    state = (value or "").strip().lower() or "unstaged"
    if state not in STATES:
        raise ValueError(f"invalid git state {value!r}: use one of {', '.join(STATES)}")
    return state


def _git(root: str, *args: str) -> str:
    try:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    except OSError as e:
        raise GitError(str(e)) from e
    if run.returncode:
        raise GitError(run.stderr.strip() or f"git {args[0]} failed")
    return run.stdout


def _parts(state: str) -> list[tuple[str, ...]]:
    cached = ("--cached",)
    return {"unstaged": [()], "staged": [cached], "all": [(), cached]}[parse_state(state)]


def _ensure(root: str) -> None:
    if _git(root, "rev-parse", "--is-inside-work-tree").strip() != "true":
        raise GitError(f"not a git work tree: {root}")


def changed_files(spark: SparkSession, root: str, state: str = "unstaged") -> DataFrame:
    """(path) of added, copied, modified and renamed files, each once, in order."""
    _ensure(os.path.abspath(root))
    groups = []
    for flags in _parts(state):
        names = [s for x in _git(root, "diff", *flags, "--name-only", "--diff-filter=ACMR").split("\n") if (s := x.strip())]
        groups.append(spark.createDataFrame([(n,) for n in names], "path string"))
    return diff.changed_files(*groups)


def diff_files(spark: SparkSession, root: str, state: str = "unstaged", context: int = 0) -> DataFrame:
    """(path, hunks, snippets) of the working tree's changes."""
    _ensure(os.path.abspath(root))
    context = max(context, 0)
    texts = [(i, _git(root, "diff", *flags, "--no-color", f"--unified={context}")) for i, flags in enumerate(_parts(state))]
    parsed = diff.parse_diffs(spark.createDataFrame(texts, "grp int, diff string"), context)
    return diff.merge_files(parsed) if len(texts) > 1 else parsed.orderBy("file_no").select("path", "hunks", "snippets")
