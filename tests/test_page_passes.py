"""Heads, languages, safe prose, headings and menus on odd input."""

import pytest
from pyspark.sql import functions as F

from loomdoc.functions.code import language_of
from loomdoc.functions.head import HeadError, read_head, split_page
from loomdoc.functions.mdx import safe_prose
from loomdoc.functions.wiki import Inline, LinkMarks, closings, green_code, labels_to_alerts
from loomdoc.operators import links, menus, page_heads, page_passes
from loomdoc.operators.lines import heading_parts
from loomdoc.plans import page_passes as plans


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", {}),
        ("# only a comment\n\n", {}),
        ("a: 1\nb: -2.5\nc: 1e3\nd: 'x: # y'\ne: \"\\u00e9\\n\"", {"a": 1, "b": -2.5, "c": "1e3", "d": "x: # y", "e": "é\n"}),
        ("a:\n- x\n- y: 1\n  z: [2, 'b, c']\n-\n  k: v", {"a": ["x", {"y": 1, "z": [2, "b, c"]}, {"k": "v"}]}),
        ("a: |\n  b\n\n   c\n\nd: >-\n  e\n  f", {"a": "b\n\n c\n", "d": "e f"}),
        ("a: ~\nb:\nc: False\n'd e': url#x", {"a": None, "b": None, "c": False, "d e": "url#x"}),
    ],
)
def test_heads(text, want):
    assert read_head(text) == want


@pytest.mark.parametrize("text", ["a", "a: 1\n  b: 2", "a: 1\na: 2", 'a: "b', "a: [1", "a: {x: 1}", "- a", "\ta: 1", "a: &x 1"])
def test_unreadable_heads(text):
    with pytest.raises(HeadError, match="^line 1|^line 2"):
        read_head(text)


def test_pages_are_split():
    assert split_page("---\na: b\n---\nc") == ("a: b", "c") and split_page("---\n---") == ("", "") and split_page("x\n---\n") == (None, "x\n---\n")
    assert split_page("---\na: ---\n--- \nb") == ("a: ---", "b") and split_page("---\nnever closed") == (None, "---\nnever closed")


def test_languages():
    cases = {
        "bash": ["#!/bin/sh", "$ ls"], "python": ["", "#!/usr/bin/env python"], "sql": ["  SELECT *", "x"], "php": ["a <?php"], "perl": ["my $x = 1;"],
        "c": ["loadmodule \"tm.so\""], "text": ["plain words", "selecting nothing"],
    }
    assert {k: language_of(v) for k, v in cases.items()} == {k: k for k in cases} and language_of([]) == "text"
    assert language_of(["insert into t", "make all"]) == "sql" and language_of(["route[x] {"]) == "c" and language_of(["for x in y"]) == "bash"


def test_safe_prose():
    assert safe_prose("{a} {} { `x{y}` \\{z\\}") == "`{a}` \\{\\} `{` `x{y}` \\{z\\}"
    assert safe_prose("<b> <span> </a> <x y='1'> <Card a={1}> <> 1 < 2 <") == "`<b>` <span> </a> `<x y='1'>` <Card a={1}> `<>` 1 < 2 <"
    assert safe_prose("a <-> b <- c [<- back](x) @@red|{z}@@ <http://x.y> <mailto:a@b>") == "a ↔ b ← c  @@red|{z}@@ [http://x.y](http://x.y) [a@b](mailto:a@b)"


def test_labels_and_green():
    assert labels_to_alerts("NOTE: x\n```\nNOTE: y\n```\nnot a NOTE: z\nNOTE:\n") == "> [!NOTE]\n> x\n```\nNOTE: y\n```\nnot a NOTE: z\nNOTE:\n"
    assert green_code("`a @@green|b@@ c` `@@green|d@@` `e") == "`a `*`b`*` c` `d` `e" and green_code("@@green|x@@") == "@@green|x@@"


def test_marks_stand_for_addresses():
    marks = LinkMarks()
    made = Inline(marks).convert("[[A.B|x]] [[#p|here]] [[http://x.y/z]] [[never closed")
    assert marks.targets == ["A.B", "http://x.y/z"] and made.count(marks.OPEN) == 2 and "[here](#p)" in made
    assert closings("(a[b)]\n(c") == {2: 5} and closings("((a))") == {0: 4, 1: 3}


def test_headings(spark):
    rows = ["## a", "###   b c {#x}", "# one", "####### seven", "##no", "## {#y}", "## a {#x} b", "## a {b}", "##", None, "## t\t{#i-1.2}  "]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, line string").select("i", heading_parts(F.col("line")).alias("h"))
    got = {r["i"]: tuple(r["h"]) if r["h"] else None for r in df.collect()}
    assert [got[i] for i in range(len(rows))] == [
        (2, "a", None), (3, "b c", "x"), None, None, None, (2, "", "y"), (2, "a {#x} b", None), (2, "a {b}", None), None, None, (2, "t", "i-1.2"),
    ]


def test_pages_without_text(spark):
    df = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, "> [!NOTE]", "p")], "id int, body string, page string")
    assert {r["id"]: r["body"] for r in page_passes.asides(df, "id", "body").collect()} == {2: "", 3: ":::note\n:::"}
    assert {r["id"]: r["body"] for r in page_passes.module_heading_ids(df, "id", "body").collect()} == {2: "", 3: "> [!NOTE]"}
    assert page_passes.asides(df.limit(0), "id", "body").count() == 0
    heads = {r["id"]: r for r in page_heads.with_heads(df, "body").collect()}
    assert heads[1]["faults"] is None and heads[2]["faults"] == ["title"] and heads[1]["body"] is None


def test_menus_of_nothing(spark):
    entries = spark.createDataFrame([("m", [1], "g", None), ("m", [1, 2], "h", None), ("n", [3], "q'\"", "s\\")], "menu string, path array<long>, label string, slug string")
    got = menus.menu_texts(menus.without_empty(entries)).collect()
    assert [(r["menu"], r["json"]) for r in got] == [("n", '[{"label":"q\'\\"","slug":"s\\\\"}]')] and "label: 'q\\'\"'" in got[0]["script"]
    none = spark.createDataFrame([], "menu string, text string")
    modules = menus.module_entries(spark.createDataFrame([], "menu string, stem string, title string, hidden boolean"))
    assert menus.module_menu(none, modules).count() == 0 and menus.manual_menu(none, menus.module_menu(none, modules)).count() == 0


def test_routes_in_place(spark):
    o, c = LinkMarks.OPEN, LinkMarks.CLOSE
    rows = [("v", "f", f"[a]({o}0{c}) [b]({o}1{c}) [c]({o}0{c})", ["A", "B"]), ("v", "g", "none", []), ("v", "h", None, None)]
    pages = spark.createDataFrame(rows, "version string, file string, body string, targets array<string>")
    routes = spark.createDataFrame([("v", "A", "/a"), ("w", "B", "/b")], "version string, target string, route string")
    got = {r["file"]: r["body"] for r in links.with_routes(pages, ["version", "file"], "body", routes).collect()}
    assert got == {"f": "[a](/a) [b](B) [c](/a)", "g": "none", "h": None}


@pytest.mark.parametrize("name", ["page_asides", "module_page_ids", "manual_page_ids"])
def test_passes_join_nothing(spark, name):
    """Pages are one pass: a side of a join whose size is judged by the bytes of the table it is made of goes to the driver."""
    plan = getattr(plans, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_headings_without_text_and_other_lines_keep_their_context(spark):
    body = "## Admin Guide\ntext\n### Exported Parameters\n##\n#### `a` (int)\n### \n#### `b` (int)\n## X\n#### c"
    got = page_passes.module_heading_ids(spark.createDataFrame([("p", body), ("q", None)], "page string, body string"), "page", "body").collect()
    assert [r["page"] for r in got] == ["p"] and got[0]["ids"] == ["admin_guide", "exported_parameters", "param_a", "param_b", "x", "c"]
