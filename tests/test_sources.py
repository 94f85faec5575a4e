import json
import os
import subprocess
import threading
import urllib.error
import urllib.request

import pyarrow as pa
import pytest

from srcgraph import service
from srcgraph.engine import Engine
from srcgraph.operators import diff
from srcgraph.sources import config, extract, git, registry, tree
from srcgraph.sources.store import Store

GO = """package main

import (
	"fmt"
	// "commented"
	str "strings"
)

const Version = "1"
const (
	A, B = 1, 2
)

// func Hidden() {}
type Server struct {
	addr string
}

type Alias = Server

func (s *Server) Start(x int) error {
	var local int
	return nil
}

func main() {
	fmt.Println("func Fake() {")
}
"""
TS = """import React from 'react';
import "side";
interface Props { a: string }
type Id = string;
function Hello(p: Props): void { return; }
export const add = (a: number, b: number) => {
  return a + b;
};
class Greeter extends Base {
  private name = 'x';
  greet(who: string): string {
    if (who) { return who; }
    return `class Fake {`;
  }
}
"""
JS = "import x from 'y';\nconst f = (a) => a;\nlet n = 1, m = [1, 2];\nvar v = 3;\nfunction g() {\n}\n"
PY = '''import os
import a.b as c
from pathlib import Path
from . import sibling
from __future__ import annotations

X = 1
y: int = 2
a, b = 1, 2

def hello():
    """def fake(): pass"""
    z = dict(
        k=1,
    )
    return z


class Greeter:
    @property
    def greet(self):
        return "hi"
'''
RUST = "use std::io;\nuse a::{b, c};\npub fn run<T>(x: T) -> i32 { 0 }\nstruct P { x: i32 }\nenum E { A }\npub trait Tr { fn m(&self); }\nmod inner { fn deep() {} }\ntype Al = i32;\nimpl P { fn new() -> P { P { x: 'a' as i32 } } }\n"
JAVA = "package p;\nimport java.util.List;\nimport java.io.*;\npublic class A {\n  public A() {}\n  public int size(List<String> x) {\n    return 1;\n  }\n  interface B { void go(); }\n}\n"


def _pairs(text, language):
    return {(s["name"], s["kind"]) for s in extract.symbols(text, language)}


def _sources(text, language):
    return [i["source"] for i in extract.imports(text, language)]


def test_go():
    want = {("main", "package"), ("main", "function"), ("Version", "constant"), ("A", "constant"), ("B", "constant"), ("Server", "type"), ("Start", "method"), ("local", "variable")}
    assert _pairs(GO, "go") == want and _sources(GO, "go") == ["fmt", "strings"]
    lines = {s["name"]: (s["line"], s["end_line"]) for s in extract.symbols(GO, "go") if s["kind"] in ("method", "type")}
    assert lines == {"Server": (15, 17), "Start": (21, 24)}
    assert [s["kind"] for s in extract.symbols(GO, "go")] == ["function", "method", "type", "variable", "constant", "constant", "constant", "package"]


def test_single_imports():
    assert _sources('package a\nimport "fmt"\nimport x "y"\nimport `raw`\n', "go") == ["fmt", "y"]


def test_typescript():
    assert _pairs(TS, "typescript") == {("Hello", "function"), ("add", "function"), ("Greeter", "class"), ("greet", "method"), ("Props", "interface"), ("Id", "type")}
    assert _sources(TS, "typescript") == ["react", "side"]
    assert next((s["line"], s["end_line"]) for s in extract.symbols(TS, "typescript") if s["name"] == "Greeter") == (9, 15)


def test_javascript():
    assert [(s["name"], s["kind"]) for s in extract.symbols(JS, "javascript")] == [("g", "function"), ("f", "function"), ("f", "variable"), ("n", "variable"), ("m", "variable")]
    assert _sources(JS, "javascript") == ["y"]


def test_python():
    assert _pairs(PY, "python") == {("hello", "function"), ("Greeter", "class"), ("greet", "function"), ("X", "variable"), ("y", "variable"), ("z", "variable")}
    assert _sources(PY, "python") == ["os", "pathlib"]
    spans = {s["name"]: (s["line"], s["end_line"]) for s in extract.symbols(PY, "python")}
    assert spans["hello"] == (11, 16) and spans["Greeter"] == (19, 22) and spans["z"] == (13, 15)


def test_rust_and_java():
    assert _pairs(RUST, "rust") == {("run", "function"), ("m", "function"), ("deep", "function"), ("new", "function"), ("P", "type"), ("E", "type"), ("Tr", "interface"), ("inner", "module"), ("Al", "type")}
    assert _sources(RUST, "rust") == ["std::io", "a::{b, c}"]
    assert _pairs(JAVA, "java") == {("A", "class"), ("B", "interface"), ("size", "method"), ("go", "method")}
    assert _sources(JAVA, "java") == ["java.util.List", "java.io"]


def test_broken_and_empty_sources():
    for language in extract.SCANNERS:
        assert extract.parse("", language) == ([], [])
        for text in (GO, TS, PY, RUST, JAVA, '"""open', "func (", "{{{{", "import (", "class"):
            for cut in range(0, len(text), 7):
                extract.parse(text[:cut], language)
    with pytest.raises(ValueError):
        extract.parse("int x;", "c")


def test_languages_and_skips():
    assert [tree.detect_language(p) for p in ("a.go", "a.TSX", "b.mjs", "x/y.PY", "UP.GO", "a.rs", "A.java")] == ["go", "typescript", "javascript", "python", "go", "rust", "java"]
    assert [tree.detect_language(p) for p in ("a.c", "Makefile", "a.go.txt", "", "go", "x.jsonc")] == [None] * 6
    assert tree.is_skipped("node_modules") and not tree.is_skipped("src")


# ---------------------------------------------------------------- diffs
DIFF = """diff --git a/a.go b/a.go
index 1..2 100644
--- a/a.go
+++ b/a.go
@@ -1,3 +1,4 @@
 package main
-old
+new
+more
diff --git a/bin b/bin
Binary files differ
"""


def test_diff():
    (f,) = diff.parse_diff(DIFF, 0)
    assert f["path"] == "a.go" and f["hunks"] == [{"old_start": 1, "old_lines": 3, "new_start": 1, "new_lines": 4, "content": " package main\n-old\n+new\n+more"}]
    assert f["snippets"] == ["-old\n+new\n+more"]
    assert diff.hunk_header("@@ -10,2 +20,3 @@ f") == (10, 2, 20, 3) and diff.hunk_header("@@ -1 +2 @@") == (1, 1, 2, 1)
    with pytest.raises(ValueError):
        diff.hunk_header("@@ nonsense @@")
    with pytest.raises(ValueError):
        diff.parse_diff("diff --git a/x b/x\n@@ bad\n")


def test_snippets_cover_all_changes_without_overlap():
    body = "\n".join(("+" if i in (3, 4, 9, 20) else " ") + str(i) for i in range(24))
    for context in range(6):
        rows = [x for s in diff.snippets(body, context) for x in s.split("\n")]
        assert len(rows) == len(set(rows)) and {"+3", "+4", "+9", "+20"} <= set(rows)
    assert diff.snippets("  \n", 1) == [] and diff.snippets(" a\n b", 1) == [" a\n b"]


def test_parsed_diffs_leave_in_slices(spark, monkeypatch):
    monkeypatch.setattr(diff, "PARSE_CHARS", 1000)
    texts = [DIFF, None, "", DIFF * 30, "no diff", *[DIFF] * 300]
    empty, batch = (pa.record_batch({"grp": pa.array(range(len(x)), pa.int32()), "diff": pa.array(x, pa.string())}) for x in ([], texts))
    want = [(i, k, f["path"], f["hunks"], f["snippets"]) for i, t in enumerate(texts) for k, f in enumerate(diff.parse_diff(t or "", 1))]
    out = list(diff._parse_batches(1)(iter([empty, batch, empty])))
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want
    # a slice ends with the diff that fills it
    held = [sum(len(texts[g] or "") for g in set(b.column("grp").to_pylist())) for b in out]
    assert max(held) <= 1000 + len(DIFF * 30) and sorted(held)[-2] < 1000 + len(DIFF)
    got = diff.parse_diffs(spark.createDataFrame(list(enumerate(texts)), "grp int, diff string"), 1)
    assert sorted((r.grp, r.file_no, r.path, [h.asDict() for h in r.hunks], r.snippets) for r in got.collect()) == want


# ---------------------------------------------------------------- an indexed repository
def _run(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.email=t@example.com", "-c", "user.name=t", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "a.go").write_text('package main\n\nimport "fmt"\n\nfunc Foo() {\n\tfmt.Println("needle_1")\n}\n')
    (root / "b.go").write_text('package main\n\nimport "fmt"\n\nfunc Bar() {}\n')
    (root / "pkg").mkdir()
    (root / "pkg/__init__.py").write_text("import os\n\n\ndef foo_helper():\n    return 1\n")
    (root / "node_modules").mkdir()
    (root / "node_modules/x.js").write_text("function no() {}")
    _run(root, "init", "-q")
    _run(root, "add", ".")
    _run(root, "commit", "-qm", "one")
    e = Engine(spark, str(root), str(tmp_path_factory.mktemp("db") / "index"))
    assert {k: v for k, v in e.stats().items() if not k.startswith("total_")} == {"files": 0, "symbols": 0, "imports": 0}
    stats = e.index()
    assert (stats["files"], stats["indexed"], stats["failed"]) == (3, 3, 0)
    return e


def test_engine(engine):
    assert [s["name"] for s in engine.definitions("Foo")] == ["Foo"] and engine.files("python")[0]["path"] == "pkg/__init__.py"
    assert [s["name"] for s in engine.search("foo")] == ["Foo", "foo_helper"]
    assert engine.search("foo helper", hybrid=True)[0]["name"] == "foo_helper"
    assert engine.text("needle_") == [{"file_path": "a.go", "line": 6, "content": 'fmt.Println("needle_1")'}]
    assert [i["source"] for i in engine.imports("a.go")] == ["fmt"] and {i["file_path"] for i in engine.importers("FM_")} == {"a.go", "b.go"}
    one = engine.explain("a.go")
    assert [s["name"] for s in one["symbols"]] == ["main", "Foo"] and {i["file_path"] for i in one["importers"]} == {"a.go", "b.go"}
    assert engine.trace("Foo", "Bar")["files"] == ["a.go", "b.go"] and engine.trace("Foo", "Foo")["metadata"] == "same file"
    assert engine.diff_impact("a.go")["dependents"] == ["b.go"] and engine.related("a.go") == ["b.go"] and engine.dependencies("a.go") == ["fmt"]
    snap = engine.snapshot("foo")
    assert [f["path"] for f in snap["files"]][:2] == ["a.go", "pkg/__init__.py"]
    assert engine.map()["files"] == 3 and engine.context("Foo")["definition"]["file_path"] == "a.go"


def test_http(engine):
    server = service.serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}/api/"

    def get(path, method="GET"):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, method=method)) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert get("search?q=Foo")[1]["count"] == 2 and get("search")[0] == 400 and get("search?q=a-b")[0] == 500
    plain, mixed = get("search?q=foo%20helper&hybrid=false")[1], get("search?q=foo%20helper&hybrid=true")[1]
    assert mixed["results"][0]["name"] == "foo_helper" and mixed == get("semantic-search?q=foo%20helper")[1] != plain
    for path in ("semantic-search?q=foo", "symbols?file=a.go", "definitions?name=Foo", "references?name=Foo", "text?q=Foo", "imports?file=a.go", "importers?source=fmt"):
        status, body = get(path)
        assert status == 200 and body["count"] == len(body["results"]), path
    for path in ("semantic-search", "symbols", "definitions", "references", "text", "imports", "importers", "explain", "context", "snapshot", "trace?from=Foo", "diff-impact"):
        assert get(path)[0] == 400, path
    assert get("definitions?name=Bar")[1]["results"][0]["file_path"] == "b.go"
    stats = get("stats")[1]
    assert stats["files"] == stats["total_files"] == 3 and get("index")[0] == 405 and get("nothing")[0] == 404 and get("files")[0] == 404
    tree_ = get("map")[1]
    assert tree_["path"] == "." and {c["path"] for c in tree_["children"]} == {".", "pkg"} and sum(c["files"] for c in tree_["children"]) == tree_["files"]
    assert get("explain?file=a.go")[1]["path"] == "a.go" and get("context?name=Foo")[1]["definition"]["name"] == "Foo"
    assert get("snapshot?q=Foo")[1]["query"] == "Foo" and get("trace?from=Foo&to=Bar")[1]["files"] == ["a.go", "b.go"]
    assert get("diff-impact?file=a.go")[1]["dependents"] == ["b.go"]
    assert get("git/files?state=odd")[0] == 400 and get("git-files")[0] == 404 and get("explain?file=zz")[0] == 500
    assert get("git/files?state=unstaged")[1] == {"results": [], "count": 0} and get("git/diff?state=all&context=1")[1]["count"] == 0
    assert get("snapshot-git?state=all&limit=2")[1]["query"] == "git:all" and get("diff-impact-git?state=all&depth=2")[1]["count"] == 0
    assert get("index?incremental=true", "POST")[1]["indexed_files"] == 0
    server.shutdown()


def test_requests_leave_no_tables_behind(engine, spark):
    from srcgraph.runtime import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert service.invoke(engine, "diff-impact", {"file": "a.go"})["dependents"] == ["b.go"]
    assert service.invoke(engine, "trace", {"from": "Foo", "to": "Bar"})["files"] == ["a.go", "b.go"]
    assert set(os.listdir(folder)) <= before


def test_tool_calls(engine):
    names = {t["name"] for t in service.answer(engine, {"id": 1, "method": "tools/list"})["result"]["tools"]}
    assert {"index", "search", "find_def", "find_refs", "files", "git_files", "git_diff", "imports", "importers", "stats", "map", "explain", "context", "snapshot", "snapshot_git", "diff_impact", "diff_impact_git", "trace"} <= names
    call = {"id": 2, "method": "tools/call", "params": {"name": "find_def", "arguments": {"name": "Foo"}}}
    assert json.loads(service.answer(engine, call)["result"]["content"][0]["text"])["count"] == 1
    assert service.answer(engine, {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {}}})["result"]["isError"]
    assert service.answer(engine, {"method": "notifications/initialized"}) is None and "error" in service.answer(engine, {"id": 4, "method": "x"})


def test_cli(engine, spark, capsys):
    args = ["--root", engine.root, "--db", engine.store.location]
    assert service.main([*args, "find-def", "Foo"], spark) == 0
    assert service.main([*args, "context", "Missing"], spark) == 1


def test_registry(spark, tmp_path):
    reg = registry.built_in()
    assert reg.supported() == ["go", "java", "javascript", "python", "rust", "typescript"] and reg.get("cobol") is None
    assert reg.detect("A/B.GO") == "go" and reg.detect("x.cob") is None and reg.get("go").parse("package p\n")[0][0]["name"] == "p"

    def parse(text):
        return [{"ord": i, "name": x.split()[1], "kind": "function", "line": i + 1, "end_line": i + 1, "signature": "", "parent": ""} for i, x in enumerate(text.splitlines()) if x.startswith("SUB ")], []

    reg.register(registry.Language("basic", (".bas",), parse))
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.BAS").write_text("SUB one\nSUB two\n")
    store = Store(spark, str(tmp_path / "db"))
    assert store.index(str(tmp_path / "src")).files == 0
    assert store.index(str(tmp_path / "src"), registry=reg).symbols == 2
    assert {(r.path, r.name) for r in store.tables().symbols.collect()} == {("a.BAS", "one"), ("a.BAS", "two")}
    # readers may still hold the generation before; older ones are gone
    store.index(str(tmp_path / "src"), registry=reg)
    assert sorted(x for x in os.listdir(tmp_path / "db") if x.startswith("gen-") and not x.endswith(".claim")) == ["gen-2", "gen-3"]


def test_two_writers_never_share_a_generation(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def one(): pass\n")
    one, other = Store(spark, str(tmp_path / "db")), Store(spark, str(tmp_path / "db"))
    assert one._claim() == 1 and other._claim() == 2
    runs = [threading.Thread(target=s.index, args=(str(tmp_path / "src"),)) for s in (one, other)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert one.generation() == 4 and one.tables().symbols.count() == 1


def test_git_and_incremental(engine, tmp_path):
    root = engine.root
    with open(f"{root}/a.go", "a") as f:
        f.write("func Added() {}\n")
    with open(f"{root}/b.go", "a") as f:
        f.write("// staged\n")
    _run(root, "add", "b.go")
    assert engine.git_files("") == ["a.go"] and engine.git_files("staged") == ["b.go"] and engine.git_files(" ALL ") == ["a.go", "b.go"]
    assert engine.git_diff("unstaged")[0]["snippets"] == ["+func Added() {}"]
    assert [f["path"] for f in engine.snapshot_git("all")["files"]] == ["a.go", "b.go"]
    assert [i["file"] for i in engine.diff_impact_git("all")] == ["a.go", "b.go"]
    with pytest.raises(git.GitError):
        git.changed_files(engine.spark, str(tmp_path))
    os.remove(f"{root}/pkg/__init__.py")
    stats = engine.index(incremental=True)
    assert (stats["files"], stats["indexed"], stats["skipped"]) == (2, 2, 1)
    # incremental and full runs agree
    other = Store(engine.spark, str(tmp_path / "full"))
    other.index(root, incremental=False)
    for name in ("files", "symbols", "imports", "content"):
        a, b = getattr(engine.tables, name), getattr(other.tables(), name)
        keep = [c for c in a.columns if c != "indexed_at"]
        assert sorted(map(str, a.select(*keep).collect())) == sorted(map(str, b.select(*keep).collect()))
    assert [s["name"] for s in engine.definitions("Added")] == ["Added"] and engine.search("foo_helper") == []
    other.delete("a.go")
    assert {r.path for r in other.tables().symbols.select("path").distinct().collect()} == {"b.go"}


# ---------------------------------------------------------------- configuration
def test_config(tmp_path):
    deep = tmp_path / "x/y"
    deep.mkdir(parents=True)
    (tmp_path / ".srcgraph.yaml").write_text("root: src # here\ndb: ~/idx\nserver:\n  port: 8123\nwatch:\n  enabled: true\n  interval: 1m30s\n  debounce: '500ms'\n")
    c = config.load(str(deep))
    assert c.root == str(tmp_path / "src") and c.db.endswith("/idx") and not c.db.startswith("~") and c.port == 8123
    assert c.watch == config.Watch(True, 90.0, 0.5)
    (deep / ".srcgraph.json").write_text(json.dumps({"root": "/abs", "server": {"port": 1}}))
    assert config.load(str(deep)).root == "/abs"
    with pytest.raises(ValueError):
        config.duration("soon")
