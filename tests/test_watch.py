from srcgraph.sources.store import Store
from srcgraph.streaming.watch import watch


def test_arrivals_are_indexed(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    pass\n")
    store = Store(spark, str(tmp_path / "index"))
    watch(store, str(root), str(tmp_path / "check"), once=True).awaitTermination(120)
    assert [r.name for r in store.tables().symbols.collect()] == ["one"]
    (root / "b.py").write_text("def two():\n    pass\n")
    watch(store, str(root), str(tmp_path / "check"), once=True).awaitTermination(120)
    assert {r.name for r in store.tables().symbols.collect()} == {"one", "two"}
    # names that file streams hide, rewritten files and deletions
    (root / "__init__.py").write_text("def three():\n    pass\n")
    (root / "a.py").write_text("def uno():\n    pass\n")
    (root / "b.py").unlink()
    watch(store, str(root), str(tmp_path / "check"), once=True).awaitTermination(120)
    assert {r.name for r in store.tables().symbols.collect()} == {"uno", "three"}
    before = store.generation()
    watch(store, str(root), str(tmp_path / "check"), once=True).awaitTermination(120)
    assert store.generation() == before
