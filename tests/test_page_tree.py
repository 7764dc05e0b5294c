"""Page files on disk: read from two roots, written version by version, the old tree left by jobs that fail."""

import os

import pytest
from pyspark.sql import functions as F

from loomdoc.sources import readers
from loomdoc.sources.page_tree import PageWriter, read_pages, write_pages


def tree(root):
    found = {}
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            found[os.path.relpath(path, root)] = open(path, encoding="utf-8").read()
    return found


def put(root, files):
    for path, text in files.items():
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_bytes(text if isinstance(text, bytes) else text.encode())


def pages(spark, rows):
    return spark.createDataFrame(rows, "version string, path string, text string").repartition(3)


def test_local_tree_before_remote(spark, tmp_path):
    near, far = tmp_path / "near", tmp_path / "far"
    put(near, {"3-4/a.md": "near a", "3-4/sub/b.md": "near b", "3-4/skip.txt": "x", "3-4/bad.md": b"\xff\xfe\xfa"})
    put(far, {"3-4/a.md": "far a", "3-4/only-far.md": "x", "3-5/c.md": "far c", "top.md": "top", "other/deep.md": "deep"})
    roots = [str(near), f"file://{far}"]
    asked = [{"version": v, "roots": roots} for v in ("3-4", "3-5", "3-6")] + [{"version": "", "roots": [str(far)]}]
    got = {(r["version"], r["path"]): r for r in read_pages(spark, asked).collect()}
    texts = {k: r["text"] for k, r in got.items() if r["error"] is None}
    assert texts == {("3-4", "a.md"): "near a", ("3-4", "sub/b.md"): "near b", ("3-5", "c.md"): "far c", ("", "top.md"): "top"}
    assert got["3-4", "bad.md"]["error"].startswith("UnicodeDecodeError") and got["3-4", "bad.md"]["text"] is None
    assert got["3-5", "c.md"]["root"] == roots[1]


def test_a_required_version_without_pages_ends_the_job(spark, tmp_path):
    put(tmp_path / "r", {"1/a.md": "x"})
    asked = [{"version": "1", "roots": [str(tmp_path / "r")]}, {"version": "2", "roots": [str(tmp_path / "r"), str(tmp_path / "no")], "required": True}]
    with pytest.raises(Exception, match="no root has a page of 2"):
        read_pages(spark, asked).collect()
    assert read_pages(spark, asked[:1]).count() == 1
    assert read_pages(spark, [{"version": "2", "roots": [str(tmp_path / "no")]}]).count() == 0


def test_a_root_that_fails_is_a_row(spark, tmp_path):
    put(tmp_path, {"file": "not a folder", "good/1/a.md": "a"})
    asked = [{"version": "1", "roots": [str(tmp_path / "file"), str(tmp_path / "good")], "required": True}]
    got = sorted((r["path"] or "", r["text"], r["error"] is None) for r in read_pages(spark, asked).collect())
    assert [g for g in got if g[0]] == [("a.md", "a", True)]


def test_versions_are_replaced_whole(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, {"1/old.md": "old", "1/index.json": "{}", "2/kept.md": "kept"})
    write_pages(pages(spark, [("1", "a.md", "A é"), ("1", "sub/b.md", ""), ("1", "index.json", None), ("3", "c.md", "C")]), str(root))
    assert tree(root) == {"1/a.md": "A é", "1/sub/b.md": "", "2/kept.md": "kept", "3/c.md": "C"}
    assert os.listdir(tmp_path) == ["tree"]
    write_pages(pages(spark, [("2", "kept.md", None)]), str(root))
    assert "2/kept.md" not in tree(root) and "1/a.md" in tree(root)


def test_a_job_that_fails_leaves_the_old_tree(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, {"1/old.md": "old"})
    bad = pages(spark, [("1", f"{i}.md", "x") for i in range(30)]).withColumn("text", F.when(F.col("path") == "29.md", F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    for rows, said in ((bad, "stop"), (pages(spark, [("1", "a.md", "x"), ("1", "a.md", "y")]), "two rows of one page"), (pages(spark, [("1", "../a.md", "x")]), "no page file")):
        with pytest.raises(Exception, match=said):
            write_pages(rows, str(root))
        assert tree(root) == {"1/old.md": "old"} and os.listdir(tmp_path) == ["tree"]


def test_flat_pages_leave_versions_alone(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, {"a.md": "old", "b.md": "b", "gone.md": "x", "1/v.md": "v"})
    rows = spark.createDataFrame([("a.md", "new"), ("gone.md", None), ("c.md", "c")], "path string, text string")
    write_pages(rows, str(root), flat=True)
    assert tree(root) == {"a.md": "new", "b.md": "b", "c.md": "c", "1/v.md": "v"}


def test_only_files_of_their_kind_are_opened(spark, tmp_path):
    """Modules and declarations are read without opening all tables; what is named alike in a folder is a table."""
    (tmp_path / "v" / "tables").mkdir(parents=True)
    for name in ("loom-a.xml", "entities.xml", "tables/t1.xml", "tables/t2.xml", "tables/loom-b.xml", "tables/entities.xml"):
        (tmp_path / "v" / name).write_text(f'<!ENTITY e "{name}">')
    modules, tables, entities = readers.schema_tree(spark, str(tmp_path), "loom")
    assert [r["module_file"] for r in modules.collect()] == ["loom-a.xml"] and [r["value"] for r in entities.collect()] == ["entities.xml"]
    assert {r["table_file"] for r in tables.collect()} == {"tables/t1.xml", "tables/t2.xml", "tables/loom-b.xml", "tables/entities.xml"}
    assert (len(modules.inputFiles()), len(entities.inputFiles())) == (2, 2)


def test_messages_of_a_task_are_small():
    """What a task tells the driver of its files is packed, and comes back whole, with odd names and files that go."""
    import pickle

    from loomdoc.sources import page_tree

    names = [f"Group{i % 10}.Page{i}" for i in range(5000)]
    sent = page_tree.Written("task", page_tree.packed(names), page_tree.packed(["v/a\nb \u00e9.md"]))
    assert list(sent.files()) == [*((f"task/{n}", n, True) for n in names), ("task/v/a\nb \u00e9.md", "v/a\nb \u00e9.md", False)]
    assert list(page_tree.Written("task", page_tree.packed([]), page_tree.packed([])).files()) == []
    assert len(pickle.dumps(sent)) < 6 * len(names)


def test_a_version_is_read_by_several_tasks(spark, tmp_path):
    """Slices share a version's files out: every file once, from the root that has it; a required version without pages ends the job."""
    near, far = str(tmp_path / "near"), str(tmp_path / "far")
    write_pages(spark.createDataFrame([("v", f"p{i}.md", str(i)) for i in range(40)], "version string, path string, text string"), near)
    write_pages(spark.createDataFrame([("v", "p1.md", "far"), ("w", "q.md", "q")], "version string, path string, text string"), far)
    asked = [{"version": v, "roots": [near, far], "required": True} for v in ("v", "w")]
    found = read_pages(spark, asked, slices=3)
    assert found.rdd.getNumPartitions() == 6
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in rows if r["version"] == "v"}) == 3
    assert sorted((r["version"], r["path"], r["text"], r["error"]) for r in rows) == sorted([("v", f"p{i}.md", str(i), None) for i in range(40)] + [("w", "q.md", "q", None)])
    with pytest.raises(Exception, match="no root has a page of x"):
        read_pages(spark, [{"version": "x", "roots": [near], "required": True}], slices=3).collect()


def test_a_task_behind_abort_leaves_nothing(tmp_path):
    """Rows that a task still has when the job has been given up make no folder anew."""
    writer = PageWriter({"root": str(tmp_path / "tree")})

    def rows():
        yield {"version": "1", "path": "a.md", "text": "x"}
        writer.abort([])
        yield {"version": "1", "path": "sub/b.md", "text": "x"}

    with pytest.raises(OSError):
        writer.write(rows())
    assert os.listdir(tmp_path) == []


def test_tables_of_a_schema_tree_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver lists no tables; what is read is what Spark's readers read, with odd names, hidden files and texts that are no UTF-8."""
    names = ["loom-a.xml", "entities.xml", "tables/t 1%.xml", "tables/\u00e9[1].xml", "deep/er/loom-b.xml", "_no/a.xml", ".no.xml", "tables/_no.xml", "tables/no.txt", "bad.xml", "empty.xml"]
    put(tmp_path / "r", {f"{v}/{n}": b"\xff<x/>" if n == "bad.xml" else "" if n == "empty.xml" else f"{v} {n}" for v in ("1", "{2,3}", "_4") for n in names} | {"top.xml": "x"})
    listed_here, listed = [], readers.page_tree.listed
    monkeypatch.setattr(readers.page_tree, "listed", lambda *args: listed_here.append(args) or listed(*args))
    root = str(tmp_path / "r")
    got = [sorted(map(tuple, df.collect())) for df in readers.schema_tree(spark, root, "loom")[:2]]
    monkeypatch.setattr(readers.page_tree, "reachable", lambda root: False)
    want = [sorted(tuple(r) for r in df.collect() if r["slug"]) for df in readers.schema_tree(spark, root, "loom")[:2]]
    assert [set(a) ^ set(b) for a, b in zip(got, want, strict=True)] == [set(), set()] and got == want
    assert (len(got[0]), len(got[1]), listed_here) == (2, 8, [])
    monkeypatch.undo()
    tables = readers.schema_tree(spark, f"file://{root}", "loom")[1]
    assert not tables.inputFiles() and tables.count() == 8


def test_names_that_come_twice():
    from loomdoc.sources.page_tree import repeated

    names = [f"v/{i}" for i in range(1000)]
    assert repeated(lambda: iter(names)) is None and repeated(lambda: iter([])) is None
    assert repeated(lambda: iter([*names, "v/7", "v/3"])) == "v/3"
