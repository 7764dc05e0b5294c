"""Readers, writers, manuals, schema pages, anchors and includes on small tables."""

from datetime import datetime

from pyspark.sql import functions as F

from loomdoc.functions import anchors, docbook
from loomdoc.operators import contributors, lines, pages, schema_tables, versions
from loomdoc.plans import cases
from loomdoc.sources import readers, sinks
from loomdoc.streaming import index_stream

MANUAL = """<?xml version="1.0"?>
<!DOCTYPE book [ <!ENTITY who "the &what;"> <!ENTITY what 'server'> ]>
<book><bookinfo><title>Demo module</title></bookinfo>
<chapter><title>Admin Guide</title>
<section id="sec1"><title>Overview</title><para>About &who; &amp; &unknown;.</para><para>Copyright X</para></section>
<section id="contributors"><title>People</title><para>gone</para></section>
<section><title>OpenX</title><section><title>MI Commands</title></section></section>
<section id="p"><title>exported parameters</title>
 <section id="par"><title><varname>db_url</varname> (string)</title>
  <para>Text <emphasis role="bold">b</emphasis> <ulink url="other.html">o</ulink> before
   <itemizedlist><listitem><para>one</para><itemizedlist><listitem><para>sub</para></listitem></itemizedlist></listitem></itemizedlist> after</para>
  <example><title>Set it</title><programlisting>
modparam("a")
</programlisting></example>
  <para>See <xref linkend="par"/>.</para></section>
 <section><title>db_url (string)</title><note><para>Mind.</para></note>
 <table><title>T</title><tgroup><thead><row><entry>A</entry><entry>B</entry></row></thead><tbody><row><entry>x|y</entry></row></tbody></tgroup></table>
 <variablelist><varlistentry><term>t1</term><listitem><para>d1</para></listitem></varlistentry></variablelist>
 <qandaset><qandaentry><question><para>Why?</para></question><answer><para>So.</para></answer></qandaentry></qandaset></section>
</section></chapter></book>"""


def test_manual(spark):
    rows = [("demo", MANUAL), ("bad", "<book><a></book>"), ("none", None)]
    got = {r["module"]: r for r in pages.xml_modules(spark.createDataFrame(rows, "module string, xml string"), {}).collect()}
    demo = got["demo"]
    assert demo["title"] == "Demo module" and demo["description"] == "About the server & &unknown;."
    for part in (
        "## Admin Guide", "### Exported Parameters", "#### db_url (string)", "**b**", "[o](../other.html)", "- one\n\n  - sub", "after",
        '```c title="Set it"\nmodparam("a")\n```', "[par](#param_db_url)", "> [!NOTE]\n> Mind.", "**T**", "| x\\|y |  |", "**t1**", "d1", "**Q: Why?**", "So.",
    ):
        assert part in demo["body"], part
    assert "gone" not in demo["body"] and "Copyright" not in demo["body"]
    assert demo["ids"]["par"] == "param_db_url" and "param_db_url_2" in demo["ids"].values()
    assert got["bad"]["body"] is None and got["none"]["body"] is None


def test_heading_ids_agree(spark):
    cases = [
        (2, "Admin Guide", None, None, "admin_guide"),
        (3, "How it works", None, "Admin Guide", "how_it_works"),
        (4, "db_url (string)", "Exported Parameters", "Admin Guide", "param_db_url"),
        (4, "avp_print()", "Exported Functions", "Admin Guide", "func_avp_print"),
        (4, "rate:addClient", "Exported MI Functions", "Admin Guide", "mi_addClient"),
        (4, "$(acc_leg(tag)[i])", "Exported Pseudo-Variables", "Admin Guide", "pv_acc_leg"),
        (4, "E_DM_REQUEST", "Exported Events", "Admin Guide", "event_e_dm_request"),
        (4, "bind_pua(api)", "Available Functions", "Developer Guide", "dev_bind_pua"),
        (4, "bind_pua(api)", "Available Functions", "Admin Guide", "bind_pua_api"),
    ]
    df = spark.createDataFrame(cases, "level int, text string, section string, guide string, want string")
    for r in df.withColumn("got", anchors.item_id(F.col("level"), F.col("text"), F.col("section"), F.col("guide"))).collect():
        assert r["got"] == r["want"] == docbook.heading_id(r["level"], r["text"], r["section"], r["guide"])


def test_id_folds(spark):
    row = spark.createDataFrame([(["x", "x", "x_2", "y"], [None, "e", None, None])], "ids array<string>, own array<string>").select(
        anchors.free_underscore(F.col("ids")).alias("a"),
        anchors.counted_hyphen(F.col("ids")).alias("b"),
        anchors.fallback_hyphen(F.col("ids"), F.col("own")).alias("c"),
        lines.clamped_levels(F.array(*map(F.lit, [3, 5, 3, 4]))).alias("d"),
    ).first()
    assert row["a"] == ["x", "x_2", "x_2_2", "y"] and row["b"] == ["x", "x-1", "x_2", "y"]
    assert row["c"] == ["x", "e", "x_2", "y"] and row["d"] == [2, 3, 2, 3]


TABLE = """<?xml version="1.0"?><!DOCTYPE table [<!ENTITY x "y">]>
<db:table xmlns:db="http://x.org/db"><name>acc</name><db:description><db:para>All  calls</db:para></db:description>
<column id="c1"><name>id</name><type>int</type><size>10</size><primary/><autoincrement/><description><db:para>Key | id</db:para></description></column>
<column id="c2"><name>user</name><type>string</type><default>5</default><null/></column>
<column id="c3"><name>note</name><type>string</type><default><null/></default></column>
<index><name>i1</name><colref linkend="c2"/><colref linkend="zz"/><unique/></index></db:table>"""


def test_schema_pages(spark):
    modules = [("devel", "b.xml", '<m><name>B db</name><xi:include href="acc.xml"/><xi:include href="gone.xml"/></m>'), ("devel", "a.xml", '<m><name>A db</name><xi:include href="bad.xml"/></m>')]
    tables = [("devel", "acc.xml", TABLE), ("devel", "bad.xml", "<table><name>x</table>")]
    got = schema_tables.schema_pages(
        spark.createDataFrame(modules, "slug string, module_file string, xml string"), spark.createDataFrame(tables, "slug string, table_file string, xml string")
    ).first()
    assert got["body"].index("## A db") < got["body"].index("## B db") and got["n_tables"] >= 1 and got["n_missing"] >= 1
    for line in (
        '### Table "acc"\n\nAll calls\n', "| `id` | `int` | 10 | default | no | Key \\| id | primary | autoincrement |",
        "| `user` | `string` | not specified | 5 | yes |  |  |  |", "| `note` | `string` | not specified | NULL | no |  |  |  |", "| `i1` | unique | user, zz |  |",
    ):
        assert line in got["body"], line


def test_schema_tables_are_parsed_once(spark):
    """Rows whose table is of no use go by what one parse found; texts that are null or no table go too."""
    rows = [("v", "a.xml", TABLE), ("v", "b.xml", "<table><name>x</name>"), ("v", "c.xml", None), ("v", "d.xml", "no table")]
    found = schema_tables.parsed_tables(spark.createDataFrame(rows, "slug string, table_file string, xml string"))
    shown = found.select("table_file", F.col("t.name").alias("name"), schema_tables.rendered(F.col("t")).alias("part"))
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
    assert [(r["table_file"], r["name"]) for r in shown.collect()] == [("a.xml", "acc")]


def test_wiki_pages(spark):
    rows = [("Documentation.Intro", b"version=1\ntext=!!!!Documentation -> Intro%0a!! One%0a* item\ntext=late\n"), ("Empty.Page", b"")]
    got = {r["name"]: r for r in pages.stored_pages(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got["Documentation.Intro"]["title"] == "Intro" and got["Documentation.Intro"]["body"] == "## One\n* item"
    assert got["Empty.Page"]["body"] == "" and got["Documentation.Intro"]["fields"]["version"] == "1"
    blocks = pages.parse_wiki(spark.createDataFrame([(1, "!! A\n* b"), (2, None)], "id int, text string"), "id", "text").collect()
    assert [(r["id"], r["kind"], r["text"]) for r in blocks] == [(1, "heading", "### A"), (1, "list", "* b")]


def test_includes(spark):
    line = '[x]({} "include")'
    many = "\n\n".join(line.format(f"n{i}.md") for i in range(12))
    deep = [(f"d{i}.md", line.format(f"d{i + 1}.md")) for i in range(12)] + [("d12.md", "bottom")]
    rows = [("many.md", many), *((f"n{i}.md", f"{i}") for i in range(12)), *deep, ("e/a.md", line.format("../b.md")), ("b.md", None), ("empty.md", "")]
    rows += [("loop.md", f"{line.format('back.md')}\n\n{line.format('n1.md')}"), ("back.md", line.format("loop.md")), ("prose.md", f"see\n{line.format('n1.md')}")]
    got = {r["path"]: (r["body"], r["state"]) for r in pages.expanded_includes(spark.createDataFrame(rows, "path string, body string")).collect()}
    assert got["many.md"] == ("\n\n".join(map(str, range(12))), "ok") and got["d0.md"] == ("bottom", "ok") and got["empty.md"] == ("", "ok")
    assert got["loop.md"] == (f"{line.format('loop.md')}\n\n1", "cycle") and got["prose.md"] == (rows[-1][1], "ok")
    assert got["e/a.md"] == (line.format("../b.md"), "missing") and "b.md" not in got


def test_page_files(spark, tmp_path):
    path = str(tmp_path / "out")
    make = lambda rows: spark.createDataFrame(rows, "slug string, page string, text string")
    sinks.write_pages(make([("a", "p", "# P\n\ntext\n"), ("a", "q", "Q\n")]), path)
    sinks.write_pages(make([("a", "q", "new\n")]), path)
    got = {r["page"]: r["body"] for r in readers.texts(spark, path, "*.txt").select(F.regexp_extract("path", "page=([^/]+)", 1).alias("page"), "body").collect()}
    assert {k: v.rstrip("\n") for k, v in got.items()} == {"p": "# P\n\ntext", "q": "new"}
    sinks.write_flat(spark.createDataFrame([("x", "1"), ("y", "1")], "page string, body string"), path + "f")
    sinks.write_flat(spark.createDataFrame([("y", "2")], "page string, body string"), path + "f")
    assert sorted((r["page"], r["body"]) for r in spark.read.parquet(path + "f").collect()) == [("x", "1"), ("y", "2")]


def test_readers_of_files(spark, tmp_path):
    (tmp_path / "Main.Page").write_bytes(b"text=x")
    (tmp_path / "a.py").write_text("x")
    (tmp_path / "c.json").write_text('[{"name": "A", "hide": true}, {"name": "B"}]')
    assert [r["name"] for r in readers.wiki_files(spark, str(tmp_path)).collect() if r["name"] != "c.json"] == ["Main.Page"]
    assert [tuple(r) for r in readers.json_rows(spark, str(tmp_path / "c.json"), "name string, hide boolean").orderBy("name").collect()] == [("A", True), ("B", None)]
    assert [tuple(r) for r in readers.ordered_rows(spark, [("z",), ("a",)], "label string").orderBy("ord").collect()] == [(0, "z"), (1, "a")]


def test_menus(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.write_menus(spark.createDataFrame([("a", "[]")], "slug string, items string"), path)
    assert spark.read.json(path).first()["slug"] == "a"


def test_readers(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "intro.md").write_text('---\ntitle: "Hi"\nsidebar:\n  hidden: true\n---\nBody')
    got = readers.front_matter(readers.texts(spark, str(tmp_path), "*.md")).first()
    assert (got["stem"], got["title"], got["hidden"], got["body"]) == ("intro", "Hi", True, "Body")
    assert readers.files(spark, str(tmp_path)).first()["name"] == "intro.md"
    log = ["abcdef1\tJo <j@x>\t2020-01-02T03:04:05+02:00", "3\t-\tmodules/a", "1\t2\tmodules/b", "abcdef2\tAl\tbad", "4\t4\tc"]
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(log)], "module string, pos int, line string")
    rows = readers.commit_log(df).collect()
    assert [(r["sha"], r["added"], r["deleted"]) for r in rows] == [("abcdef1", 3, None), ("abcdef1", 1, 2), ("abcdef2", 4, 4)]
    assert rows[0]["date"] is not None and rows[2]["date"] is None
    commits = contributors.commits_from_numstat(readers.commit_log(df).withColumnRenamed("author_raw", "author"))
    assert {(r["sha"], r["added"], r["deleted"]) for r in commits.collect()} == {("abcdef1", 4, 2), ("abcdef2", 4, 4)}
    feed = "<rss><item><title>A &amp;lt; B</title><link>l</link><pubDate>Wed, 01 Jan 2020 10:00:00 +0000</pubDate><description><![CDATA[<p>x</p>]]></description></item><item><title>C</title></item></rss>"
    item = readers.feed_items(spark.createDataFrame([("f", feed)], "source string, xml string"), 1).collect()
    assert len(item) == 1 and item[0]["title"] == "A < B" and item[0]["pub_date"] == datetime(2020, 1, 1, 10) and item[0]["description"] == "x…"
    entities = readers.entity_rows(spark.createDataFrame([("s", "<!ENTITY a \"1\"><!ENTITY a '2'><!ENTITY b \"&a;&b;&c;\">")], "scope string, text string"))
    assert {r["name"]: r["value"] for r in readers.resolved_entities(entities).collect()} == {"a": "2", "b": "2&b;&c;"}
    assert readers.redirects(spark.createDataFrame([("My_Page", "(:redirect Other.Page:)"), ("X", "no")], "name string, body string")).collect()[0]["key"] == "mypage"


def test_index_round_trip_and_stream(spark, tmp_path):
    index = [("modules", "devel", "a", "toc1", "x"), ("modules", "devel", "a", "old", "y"), ("modules", "3-4", "b/c", "toc1", "z")]
    df = spark.createDataFrame(index, index_stream.SCHEMA)
    assert sorted(map(tuple, readers.anchor_index(sinks.index_json(df)).collect())) == sorted(index)
    bad = spark.createDataFrame([("modules", "not json")], "section string, json string")
    assert readers.anchor_index(bad).count() == 0
    arrivals = str(tmp_path / "in")
    df.write.mode("append").parquet(arrivals)
    for _ in range(2):
        index_stream.keep_index(index_stream.stream_pages(spark, arrivals), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
        spark.createDataFrame([("modules", "devel", "a", "new", "n")], index_stream.SCHEMA).write.mode("append").parquet(arrivals)
    got = spark.read.parquet(str(tmp_path / "out")).select("slug", "page", "ref").collect()
    assert sorted(map(tuple, got)) == [("3-4", "b/c", "toc1"), ("devel", "a", "new")]


def test_trees(spark, tmp_path):
    path = str(tmp_path / "tree")
    make = lambda rows: spark.createDataFrame(rows, "slug string, page string, body string")
    sinks.write_tree(make([("a", "p", "1"), ("b", "p", "1")]), path)
    sinks.write_versions(make([("b", "q", "2")]), path)
    assert sorted(map(tuple, spark.read.parquet(path).select("slug", "page").collect())) == [("a", "p"), ("b", "q")]


def test_nearest_is_nearest_and_exists(spark):
    rows = [(1, "a"), (5, "a"), (3, "b")]
    pages_ = spark.createDataFrame(rows, "ord long, page string")
    vers = spark.createDataFrame([(i,) for i in range(1, 6)], "ord long")
    got = {(r["ord"], r["page"]): r["nearest"] for r in versions.nearest_version(pages_, vers).collect()}
    assert got[(3, "a")] == 1 and got[(4, "a")] == 5 and got[(5, "b")] == 3 and len(got) == 7
    assert all((n, p) in rows for (_, p), n in got.items())


def test_large_counts_are_no_header(spark):
    """Counts of seven digits and more; an abbreviated sha of digits alone, by an author of digits, has its date."""
    log = ["abcdef1\tJo\t2020-01-02T03:04:05+02:00", "1000000\t5\tmodules/a", "7\t12345678\tb", "1234567\t-\tc", "1234567\t89\t2020-01-02T03:04:05Z", "2\t2\td", "7654321\tAl\tbad", "3\t3\te"]
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(log)], "module string, pos int, line string")
    rows = [(r["sha"], r["author_raw"], r["file"], r["added"], r["deleted"]) for r in readers.commit_log(df).collect()]
    jo = [("abcdef1", "Jo", "modules/a", 1000000, 5), ("abcdef1", "Jo", "b", 7, 12345678), ("abcdef1", "Jo", "c", 1234567, None)]
    assert rows == [*jo, ("1234567", "89", "d", 2, 2), ("7654321", "Al", "e", 3, 3)]


def test_made_rows_are_spread(spark):
    """A small file is one task of a scan; the markup that is made of its rows is dealt over all cores, every row once."""
    rows = cases.inputs(spark, "/root/testdata/sf0.001", {"a": ("«key»", ""), "b": ("«name»", "")})
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert rows.select("p_partkey", "rule").distinct().count() == rows.count() == 2 * spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_entities_are_gathered_once(spark):
    """Entities of a scope are not joined back to its table; rows without a scope have none."""
    from loomdoc.sources import readers

    rows = spark.createDataFrame([("s", "a", "x &b;"), ("s", "b", "y"), ("t", "b", "z"), (None, "b", "n")], "scope string, name string, value string")
    found = readers.resolved_entities(rows)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("s", "a", "x y", False), ("s", "b", "y", False), ("t", "b", "z", False)]


def test_index_of_many_pages(spark):
    """A section's text is made without a look at all its pages for each one; brackets and quotes in names and ids are kept."""
    index = [("s", "v", f"p{i}", "toc1", f"i{i}") for i in range(300)] + [("s", "v", 'a]:"b', "[x]:y", "[z]:\\"), ("t", "v", "]", "]:", '"]:')]
    text = sinks.index_json(spark.createDataFrame(index, index_stream.SCHEMA))
    assert sorted(map(tuple, readers.anchor_index(text).collect())) == sorted(index)
    assert "element_at" not in text._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_tables_stay_on_executors(spark):
    """However small Spark takes them to be, rendered tables are not sent through the driver; declarations of versions are."""
    modules = spark.createDataFrame([("v", f"m{i}.xml", f'<m><name>M{i}</name><xi:include href="t{i}.xml"/></m>') for i in range(2)], "slug string, module_file string, xml string")
    about = "<description>https://x.example/docs/modules/devel/a.html &e;</description>"
    tables = spark.createDataFrame([("v", f"t{i}.xml", f"<table><name>t{i}</name>{about}<column><name>c</name></column></table>") for i in range(2)], "slug string, table_file string, xml string")
    entities = spark.createDataFrame([("v", "e", "one")], "scope string, name string, value string")
    found = schema_tables.schema_pages(modules, tables, entities, r"x\.example")
    joins = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
    assert sorted(("SortMerge" in j, "table_file" in j) for j in joins) == [(False, False), (True, True)]
    row = found.collect()[0]
    assert (row["n_tables"], row["n_missing"]) == (2, 0) and row["body"].count("[a](/docs/modules/v/a) one") == 2 and row["body"].index("## M0") < row["body"].index("## M1")
