import pytest
from pyspark.sql import functions as F

from srcgraph.functions import scalar as S
from srcgraph.operators import context, fts, graph, grep, lookup, rank
from srcgraph.schema import CONTENT, IMPORTS, SYMBOLS, NotFoundError, QuerySyntaxError, Tables


def _symbols(spark, rows):
    """rows: (path, name, kind, line)."""
    full = [(p, i, n, k, line, line, "", "") for i, (p, n, k, line) in enumerate(rows)]
    return spark.createDataFrame(full, SYMBOLS)


def _imports(spark, edges):
    return spark.createDataFrame([(p, i, s, i + 1) for i, (p, s) in enumerate(edges)], IMPORTS)


@pytest.fixture(scope="module")
def imports(spark):
    return _imports(spark, [("a.go", "fmt"), ("a.go", "os"), ("b.go", "fmt"), ("b.go", "net/http"), ("c.go", "os")])


def _col(df, c):
    return [r[c] for r in df.collect()]


# ---------------------------------------------------------------- graph
def test_graph_fixture(imports):
    assert _col(graph.direct_imports(imports, "a.go"), "source") == ["fmt", "os"]
    assert _col(graph.direct_importers(imports, "fmt"), "path") == ["a.go", "b.go"]
    assert sorted(_col(graph.dependencies(imports, ["a.go"]), "node")) == ["fmt", "os"]
    assert sorted(_col(graph.dependents(imports, ["fmt"]), "node")) == ["a.go", "b.go", "c.go"]
    assert _col(graph.related(imports, "a.go"), "path") == ["b.go", "c.go"]
    assert _col(graph.trace(imports, "b.go", "c.go"), "path") == ["b.go", "a.go", "c.go"]
    assert _col(graph.trace(imports, "b.go", "c.go", 2), "path") == []
    assert _col(graph.trace(imports, "a.go", "a.go"), "path") == ["a.go"]
    assert _col(graph.trace(imports, "a.go", "nowhere"), "path") == []


def _python_dependents(edges, start, depth):
    forward, reverse = {}, {}
    for p, s in edges:
        forward.setdefault(p, []).append(s)
        reverse.setdefault(s, []).append(p)
    seen, front, out = {start}, [start], set()
    for _ in range(depth):
        nxt = []
        for f in front:
            users = [u for s in forward[f] for u in reverse.get(s, [])] if f in forward else reverse.get(f, [])
            for u in users:
                if u not in seen:
                    seen.add(u)
                    out.add(u)
                    nxt.append(u)
        front = nxt
    return out


def test_dependents_match_a_plain_search(spark):
    edges = [(f"n{i}", f"n{(i * 7 + 3) % 23}") for i in range(15)] + [(f"n{i}", f"s{i % 4}") for i in range(0, 15, 3)]
    df = _imports(spark, edges)
    before = set()
    for depth in (1, 2, 3):
        got = set(_col(graph.dependents(df, ["n3"], depth), "node"))
        assert got == _python_dependents(edges, "n3", depth) and before <= got
        before = got


def test_impact(spark, imports):
    t = Tables(spark.createDataFrame([("c_test.go",)], "path string"), None, imports)
    rows = {(r.section, r.value) for r in context.diff_impact(t, ["a.go"]).collect()}
    assert rows == {("direct_deps", "fmt"), ("direct_deps", "os"), ("all_deps", "fmt"), ("all_deps", "os"), ("dependents", "b.go"), ("dependents", "c.go"), ("recommends", "b_test.go"), ("recommends", "c_test.go")}
    assert ("recommends", "b_test.go") not in {(r.section, r.value) for r in context.diff_impact(t, ["a.go"], 3, True).collect()}
    assert context.diff_impact(t, ["unknown.go"]).count() == 0


# ---------------------------------------------------------------- search
def test_ranked(spark):
    s = _symbols(spark, [("a.go", "MyComputeTool", "function", 1), ("a.go", "ComputeFast", "function", 2), ("a.go", "compute", "function", 3)])
    assert _col(rank.ranked(s, fts.postings(s), "CoMpUtE").orderBy("rank"), "name") == ["compute", "ComputeFast", "MyComputeTool"]
    assert _col(rank.ranked(s, fts.postings(s), "compute", None, 1), "name") == ["compute"]
    assert _col(rank.ranked(s, fts.postings(s), "compute", "type"), "name") == []


def test_full_text_hit_without_a_name_match_stays(spark):
    s = _symbols(spark, [("a.go", "LegacyResult", "function", 1)]).withColumn("signature", F.lit("old compute thing"))
    assert _col(rank.ranked(s, fts.postings(s), "compute"), "name") == ["LegacyResult"]


def test_hybrid(spark):
    s = _symbols(spark, [("a.go", "AuthSessionManager", "type", 1), ("b.go", "RenderButton", "function", 1)])
    assert _col(rank.hybrid(s, fts.postings(s), "auth session").orderBy("rank"), "name")[0] == "AuthSessionManager"
    s = _symbols(spark, [("a.go", "FindToken", "function", 1), ("b.go", "TokenResolverService", "type", 1)])
    assert set(_col(rank.hybrid(s, fts.postings(s), "token resolver"), "name")) == {"FindToken", "TokenResolverService"}


NAMES = ["ComputeFoo", "compute", "foo_bar", "FooBar", "Café", "handleRequest", "handle_request", "parse", "Parse", "日本語", "foo"]
MATCHES = {
    "compute": {"compute"},
    "foo": {"foo_bar", "foo"},
    "foo bar": {"foo_bar"},
    "foo_bar": {"foo_bar"},
    '"foo bar"': {"foo_bar"},
    "foo + bar": {"foo_bar"},
    "foobar": {"FooBar"},
    "CAFÉ": {"Café"},
    "cafe": {"Café"},
    "handle*": {"handleRequest", "handle_request"},
    "comp*": {"ComputeFoo", "compute"},
    "日本": set(),
    "日本語": {"日本語"},
    "foo NOT bar": {"foo"},
    "foo OR parse": {"foo_bar", "parse", "Parse", "foo"},
    "name:foo": {"foo_bar", "foo"},
    "signature:foo": set(),
    "not": set(),
    "{name signature}: foo": {"foo_bar", "foo"},
    "^bar": set(),
    "NEAR(foo bar, 0)": {"foo_bar"},
    "(foo OR parse) NOT bar": {"foo", "parse", "Parse"},
    "- name : foo": set(),
}


@pytest.fixture(scope="module")
def names(spark):
    s = _symbols(spark, [("a.go", n, "function", i) for i, n in enumerate(NAMES)])
    return s, fts.postings(s)


@pytest.mark.parametrize("query", MATCHES)
def test_match_language(names, query):
    s, post = names
    assert set(_col(fts.search(s, post, query), "name")) == MATCHES[query]


@pytest.mark.parametrize("query", ["foo.bar", "a/b", "func()", "AND", "", "  ", "a-b", "fmt:x", "*", '"open', "a OR", "(a"])
def test_match_errors(query):
    with pytest.raises(QuerySyntaxError):
        fts.compile_match(query)


def test_definitions_and_references(spark):
    rows = [("b.go", "Foo", "type", 3), ("a.go", "Foo", "function", 9), ("c.go", "Foo", "variable", 1), ("d.go", "Foo", "method", 2)]
    t = Tables(spark.createDataFrame([(p,) for p in "a.go b.go c.go d.go".split()], "path string"), _symbols(spark, rows), _imports(spark, [("x", "y")]))
    assert _col(lookup.definitions(t, "Foo"), "path") == ["a.go", "d.go", "b.go"]
    assert _col(lookup.references(t, "Foo"), "path") == ["d.go", "b.go", "c.go"]
    assert lookup.references(t, "None").count() == 0
    got = context.symbol_context(t, fts.postings(t.symbols), "Foo").collect()
    assert [r.path for r in got if r.section == "definition"] == ["a.go"] and [r.path for r in got if r.section == "method"] == ["d.go"]
    assert len([r for r in got if r.section == "related"]) == 3
    with pytest.raises(NotFoundError):
        context.symbol_context(t, fts.postings(t.symbols), "Missing")


def test_grep(spark):
    c = spark.createDataFrame([("f1.go", "package a\n\tx TARGET_ONE  \r\n"), ("f2.go", "\nTARGET_TWO")], CONTENT)
    assert [tuple(r) for r in grep.search(c, "TARGET_").collect()] == [("f1.go", 2, "x TARGET_ONE"), ("f2.go", 2, "TARGET_TWO")]
    assert _col(grep.search(c, "TARGET_", "f1.go"), "path") == ["f1.go"]
    assert grep.search(c, "target_").count() == 0 and grep.search(c, "TARGET_", "", 1).count() == 1


# ---------------------------------------------------------------- scalars
def test_scalars(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(S.semantic_tokens(F.lit("HTTPServer2Go a_b fooBar-x"))) == ["http", "server2", "go", "a", "b", "foo", "bar", "x"]
    assert [one(S.source_like(F.lit(a), b)) for a, b in (("FMT", "fmt"), ("É", "é"), ("axb", "a_b"), ("a\\b", "\\"), ("xyz", "%z"), ("abc", "d"))] == [True, False, True, True, True, False]
    assert [one(S.dirname(F.lit(p))) for p in ("a.go", "x/a.go", "x/y/a.go")] == [".", "x", "x/y"]
    assert [one(S.test_path(F.lit(p))) for p in ("a.go", "a_test.go", "a.gopher/b.go", "x.py")] == ["a_test.go", "a_test.go", "a_test.gopher/b.go", "x.py"]
    assert one(S.trimmed(F.lit("\t a b\r "))) == "a b" and one(S.unquoted(F.lit("\"'x'\""))) == "x"
    assert [one(S.match_score(F.lit(n), "Foo")) for n in ("FOO", "foobar", "xfoo", "bar")] == [3, 2, 1, 0]


def test_map_root_is_the_sum(spark):
    files = spark.createDataFrame([(p,) for p in ("a.go", "x/b.go", "x/c.go", "x/y/d.go")], "path string")
    s = _symbols(spark, [("x/b.go", "F", "function", 1), ("x/b.go", "T", "type", 2), ("x/y/d.go", "M", "method", 1), ("a.go", "K", "class", 1)])
    rows = {(r.path, r.is_root): r for r in context.directory_map(Tables(files, s, None)).collect()}
    root = rows[(".", True)]
    assert (root.files, root.symbols, root.functions, root.types, root.methods) == (4, 4, 1, 1, 1)
    for c in ("files", "symbols", "functions", "types", "methods"):
        assert root[c] == sum(r[c] for (_, is_root), r in rows.items() if not is_root)
    assert rows[("x", False)].files == 2
    tree = {r.path: r.files for r in context.directory_tree(Tables(files, s, None)).collect()}
    assert tree == {".": 1, "x": 3, "x/y": 1}
