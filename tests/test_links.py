"""Links, manuals and predicates on nulls, empty texts and empty tables."""

from pyspark.sql import functions as F

from loomdoc.functions import predicates
from loomdoc.operators import lines, links, manual
from loomdoc.sources import readers, sinks

INDEX = "section string, slug string, page string, ref string, id string"


def test_texts_without_links(spark):
    rows = [(1, None, "devel"), (2, "", "devel"), (3, "no link", "devel"), (4, "[a](b) and [c](", "devel"), (5, "[a](/docs/manual/3-6/p#old)[b](#x)", None)]
    pages = spark.createDataFrame(rows, "id int, body string, slug string")
    index = spark.createDataFrame([("manual", "3-6", "p", "old", "new")], INDEX)
    got = {r["id"]: r["body"] for r in links.rewritten_anchors(pages, "id", "body", "slug", index).collect()}
    assert got == {1: None, 2: "", 3: "no link", 4: "[a](b) and [c](", 5: "[a](/docs/manual/3-6/p#new)[b](#x)"}
    assert links.rewritten_anchors(pages, "id", "body", "slug", index.limit(0)).filter("id = 5").first()["body"] == rows[4][1]
    assert links.rewritten_anchors(pages.limit(0), "id", "body", "slug", index).count() == 0
    empty = spark.createDataFrame([], "route string, n bigint, id string")
    routes = pages.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("route"), "body")
    assert links.rewritten_positions(routes, "route", "body", empty).count() == 5
    assert links.rewritten_ids(pages, "id", "body", index).filter("id = 5").first()["body"].startswith("[a](/docs/manual/3-6/p#new)")


def test_links_are_put_back_in_order(spark):
    body = "x " + " ".join(f"[l{i}](/docs/modules/devel/m#o{i})" for i in range(20)) + " y"
    ids = spark.createDataFrame([("modules", "devel", "m", f"o{i}", f"n{i}") for i in range(0, 20, 2)], INDEX)
    pages = spark.createDataFrame([(1, body)], "id int, body string")
    want = "x " + " ".join(f"[l{i}](/docs/modules/devel/m#{'n' if i % 2 == 0 else 'o'}{i})" for i in range(20)) + " y"
    assert links.rewritten_ids(pages, "id", "body", ids).first()["body"] == want


def test_pages_are_converted_once_for_their_links(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def converted(text):
        seen.add(1)
        return text

    rows = [(i, f"[a](https://x.example/Documentation/Page-{i}-3-6) [b](https://y.example/)") for i in range(50)]
    pages = spark.createDataFrame(rows, "id int, text string").select("id", converted("text").alias("body"))
    names = spark.createDataFrame([("page-7",)], "page string")
    flat = spark.createDataFrame([], "slug string")
    got = {r["id"]: r["body"] for r in links.rewritten_legacy(pages, "id", "body", names, flat, r"x\.example", "https://w.example").collect()}
    assert got == dict(rows) | {7: got[7]} and seen.value == 50


def test_manual_pages_without_headings(spark):
    rows = [("a", "other", ""), ("b", "script-tran", "text [x](#toc1)\n"), ("c", "other", "## \n## X {#X}\n## X"), ("d", "other", None)]
    got = {r["key"]: (r["body"], r["ids"]) for r in manual.generated_ids(spark.createDataFrame(rows, "key string, page string, body string"), "key").collect()}
    assert got["a"] == ("", {}) and got["b"] == (rows[1][2], {})
    assert got["c"] == ("## \n## X\n## X", {"toc1": "x", "toc2": "x-1", "X": "x"}) and "d" not in got


def test_numbers_over_buckets(spark):
    n = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 1000).alias("k"))
    got = lines.numbered(n, "g", "k", F.floor(F.col("k") / 10), "n").collect()
    for group in ("hot", "cold"):
        ks = sorted(r["k"] for r in got if r["g"] == group)
        assert {r["k"]: r["n"] for r in got if r["g"] == group} == {k: i for i, k in enumerate(ks, 1)}


def test_predicates_of_nulls(spark):
    null = F.lit(None).cast("string")
    row = spark.range(1).select(
        predicates.page_class(null).alias("c"), predicates.in_menu(F.lit("about"), null).alias("m"), predicates.is_active(F.lit("/a"), [F.lit("/b"), F.lit("/a")]).alias("a"),
        predicates.head_faults(F.create_map(F.lit("title"), F.lit("x"))).alias("f"), sinks.script_items(F.array().cast("array<struct<label: string, slug: string, collapsed: boolean>>")).alias("s"),
    ).first()
    assert row["c"] in (None, "other") and row["a"] and row["f"] == [] and row["s"] == "[]"


def test_empty_readers(spark):
    none = spark.createDataFrame([], "scope string, text string")
    assert readers.resolved_entities(readers.entity_rows(none)).count() == 0
    deep = spark.createDataFrame([("s", "".join(f"<!ENTITY e{i} '&e{i + 1};'>" for i in range(40)) + "<!ENTITY e40 'end'>")], "scope string, text string")
    got = {r["name"]: (r["value"], r["open"]) for r in readers.resolved_entities(readers.entity_rows(deep)).collect()}
    assert got["e35"] == ("end", False) and got["e0"][1] and not got["e40"][1]
