"""Names, heading keys, inferred anchors, samples and candidates on literal cases."""

from pyspark.sql import functions as F

from loomdoc.functions import names
from loomdoc.operators import headings


def test_names(spark):
    row = spark.createDataFrame([("Documentation.Script-CoreVar-3-6", "Café — Ünïcode!", "3.4.x")], "a string, b string, c string").select(
        names.converted_name(F.col("a")).alias("n"),
        names.category(F.col("a")).alias("g"),
        names.cms_slug(F.col("b")).alias("s"),
        names.module_version_slug(F.col("c")).alias("v"),
        names.manual_ref(F.lit("Script-CoreVar-4-1")).alias("m"),
        names.manual_ref(F.lit("Plain")).alias("none"),
        names.label_of(F.lit("param_db_url")).alias("l"),
    ).first()
    assert (row["n"], row["g"], row["s"], row["v"], row["l"]) == ("script-corevar-3-6", "documentation", "cafe-unicode", "3-4", "db url")
    assert tuple(row["m"]) == ("script-corevar", "devel") and row["none"] is None


def test_routes(spark):
    urls = ["http://x.org/html/docs/modules/3.4.x/tm.html#f", "http://x.org/Documentation/Script-CoreVar-3-6#toc2", "http://x.org/a"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r["r"] for r in df.select(names.legacy_route(F.col("u")).alias("r")).collect()]
    assert got == ["/docs/modules/3-4/tm#f", "/docs/manual/3-6/script-corevar#toc2", None]
    text = spark.range(1).select(names.module_links(F.lit("see http://x.org/html/docs/modules/3.4.x/tm.html now")).alias("t")).first()["t"]
    assert text == "see [tm](../modules/tm) now"
    pairs = spark.createDataFrame([("https://a.org/x/", "../l.png"), ("https://a.org", "mailto:x"), (None, None)], "b string, l string")
    assert [r["r"] for r in pairs.select(names.resolved_url(F.col("b"), F.col("l")).alias("r")).collect()] == ["https://a.org/l.png", None, None]


def test_title_heading(spark):
    body = F.lit("# The **Title**\n\ntext")
    got = spark.range(1).select(names.without_title_heading(body, F.lit("the title")).alias("a"), names.without_title_heading(body, F.lit("x")).alias("b")).first()
    assert got["a"] == "text" and got["b"].startswith("# The")


def test_inferred_anchors(spark):
    heads = spark.createDataFrame([("p", 1, "A `b`", None), ("p", 2, "C", "own"), ("p", 3, "D", None)], "page string, pos int, text string, id string")
    links = spark.createDataFrame([("p", "a B", "x"), ("p", "C", "y"), ("p", "D", "u"), ("p", "d", "v"), ("q", "D", "w")], "page string, label string, id string")
    assert {r["pos"]: r["id"] for r in headings.inferred_anchors(heads, links).collect()} == {1: "x", 2: "own", 3: None}


def test_samples(spark):
    rows = [("m", 2, None, "b.cfg"), ("m", 1, "First", "a.cfg")]
    body = headings.samples_page(spark.createDataFrame(rows, "module string, ord int, title string, file string")).first()["body"]
    assert body.index("## First") < body.index("## b.cfg") and '[a.cfg](./samples/a.cfg "include")' in body


def test_candidates(spark):
    html = '<img src="/logo.svg" alt="x logo" width="400"><link rel="icon" href="/favicon.png"><meta property="og:image" content="/banner.png">'
    rows = headings.best_candidates(spark.createDataFrame([(1, "https://x.example/a/", html)], "id int, url string, html string"), "id").collect()
    assert [(r["address"], r["score"]) for r in rows] == [("https://x.example/logo.svg", 80.0), ("https://x.example/banner.png", 25.0), ("https://x.example/favicon.png", -10.0)]
    nothing = spark.createDataFrame([(1, None, "<img src='logo.png'>"), (2, "https://x.example", None), (3, "https://x.example", "")], "id int, url string, html string")
    assert headings.best_candidates(nothing, "id").count() == 0
    tries = spark.createDataFrame([(1, 1, "a", "404"), (1, 2, "b", None), (1, 3, "c", None)], "id int, rn int, address string, error string")
    assert headings.first_success(tries, "id").first()["address"] == "b"
