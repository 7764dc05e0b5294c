"""Rules of titles, links and ids on literal cases."""

from pyspark.sql import functions as F

from loomdoc.functions import rules, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_titles(spark):
    case = lambda t, n, g=None: one(spark, rules.canonical_title(F.lit(t), F.lit(n), F.lit(g).cast("string")))
    assert case("developer's  guide", 2) == "Developer Guide" and case("MI Commands", 3) == "Exported MI Functions" and case("Own", 3) == "Own"
    assert case("Parameters", 3, "Admin Guide") == "Exported Parameters" and case("Parameters", 3, "Developer Guide") == "Parameters" == case("Parameters", 3)
    assert one(spark, rules.module_title(F.lit('"acc" Module'))) == "ACC module" and one(spark, rules.module_title(F.lit("tm"))) == "TM module"
    assert one(spark, rules.aside_of(F.lit("WARNING"))) == "danger"


def test_links(spark):
    body = "[a](x-y.md#z) [b](../modules/tm/README.md) [c](https://site.org/docs/z) [d](https://o.org/q.md)"
    got = one(spark, rules.site_links(F.lit(body), F.lit("3-4"), "https://site.org"))
    assert got == "[a](/docs/manual/3-4/x-y#z) [b](/docs/modules/3-4/tm) [c](/docs/z) [d](https://o.org/q.md)"


def test_samples_and_hidden(spark):
    pages = spark.createDataFrame([("a", 'x\n[s](./samples.md "include")\ny'), ("b", 'x\n[s](./samples.md "include")\ny')], "module string, body string")
    got = {r["module"]: r["body"] for r in rules.with_samples(pages, spark.createDataFrame([("a",)], "module string")).collect()}
    assert "samples.md" in got["a"] and got["b"] == "x\ny"
    once = one(spark, rules.hidden(F.lit("---\ntitle: t\n---\nb")))
    assert once == "---\ntitle: t\nsidebar:\n  hidden: true\n---\nb" == one(spark, rules.hidden(F.lit(once)))


CASES = [
    ("script-corefunctions", "", "", None),
    ("script-tran", "{}", "", None),
    ("script-corevar", "$$", "", None),
    ("interface-coreevents", "?", None, None),
    ("interface-coreevents", "A b", None, "a_b"),
    ("other", "...", "", None),
    (None, "A b", "", "a-b"),
    ("script-routes", None, "", None),
]


def test_manual_ids(spark):
    df = spark.createDataFrame(CASES, "page string, text string, ahead string, want string")
    for r in df.withColumn("got", rules.manual_id(F.col("page"), F.col("text"), F.col("ahead"))).collect():
        assert r["got"] == r["want"], r


def test_values(spark):
    assert one(spark, values.years_between(F.lit("2000-01-01").cast("timestamp"), F.lit("2024-06-01").cast("timestamp"))) == 24
    assert one(spark, values.feed_date(F.lit("bad"))) is None and one(spark, values.iso_date(F.lit("2020-13-01"))) is None
    assert one(spark, values.json_or_empty(F.lit("{bad"), "map<string, string>")) == {}
