"""Stored pages, XML manuals, schema pages, includes, links and ids over generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import anchors
from loomdoc.operators import headings, links, manual, pages, schema_tables
from loomdoc.operators.contributors import fill_placeholder
from loomdoc.plans.cases import WORDS_SQL, filled, filled_sql, words
from loomdoc.plans.registry import query
from loomdoc.sources import readers, sinks
from loomdoc.tables import load


@query(
    "stored_pages",
    f"""WITH {WORDS_SQL}
SELECT 'Docs.Page' || key AS name, name AS title, '## ' || kind || chr(10) || '* café & ' || first || ' ts' AS body,
  'v' || key AS version FROM p WHERE p_partkey % 3 <> 0
UNION ALL SELECT 'Docs.Page' || key, 'Docs.Page' || key, '', NULL FROM p WHERE p_partkey % 3 = 0""",
)
def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cp1252 and percent codes, entities, letters with marks, the first of a key, pages without text."""
    text = filled("version=v«key»\ntext=!!!!!Docs -> Guide -> «name»%0a----%0a! «kind»%0a* caf%e9 &amp; «first» &#539;&#537;\ntext=late\nversion=w\n")
    content = F.when(F.col("p_partkey") % 3 == 0, F.lit("author=«x»\n")).otherwise(text).cast("binary")
    files = words(spark, sf_dir).select(filled("Docs.Page«key»").alias("name"), content.alias("content"))
    found = pages.stored_pages(files)
    return found.select("name", "title", "body", F.try_element_at("fields", F.lit("version")).alias("version"))


MANUAL = """<?xml version="1.0"?>
<!DOCTYPE book [ <!ENTITY who "the &what;"> <!ENTITY what '«first»'> ]>
<book><bookinfo><title>«kind» module</title></bookinfo><!-- gone -->
<chapter><title>Admin guide</title>
<section id="s1"><title>Overview</title><para>About &who; &amp; &lost;.</para><para>Copyright «key»</para></section>
<section id="contributors"><title>People</title><para>gone</para></section>
<section id="s2"><title>parameters</title>
<section id="p1"><title><varname>«first»_x</varname> (string)</title>
<para>Uses <emphasis role="bold">«name»</emphasis>, <emphasis>«kind»</emphasis>, <quote>«key»</quote>, H<subscript>2</subscript>O;
see <ulink url="other.html">«second»</ulink>, <ulink url="http://x.example/html/docs/modules/3.4.x/«first».html#a">it</ulink> and <xref linkend="p1"/>;
<ulink url="https://www.x.example/Documentation/Script-CoreVar-3-6#«first»">a</ulink> <ulink url="https://x.example/html/Documentation/Script-CoreVar-4-1">b</ulink>
<ulink url="https://x.example/Documentation/No-Page-3-6">c</ulink> <ulink url="http://x.example/Documentation/Tutorials-«second»/#x">d</ulink>
<ulink url="http://x.example/Documentation/Tutorials-No">e</ulink> <ulink url="http://y.example/html/docs/modules/3.4.x/«first».html">f</ulink> <xref linkend="some-«first»_id"/></para>
<example><title>Set «first»</title><programlisting>
set("«name»")
</programlisting></example></section>
<section><title>«first»_x (string)</title>
<para>before <itemizedlist><listitem><para>one</para><orderedlist><listitem><para>«key»</para></listitem></orderedlist></listitem></itemizedlist> after</para>
<warning><para>Mind «second».</para></warning></section></section>
<section><title>More</title>
<simplelist type="inline"><member>«first»</member><member>«second»</member></simplelist>
<variablelist><varlistentry><term>«first»</term><listitem><para>is «kind»</para></listitem></varlistentry></variablelist>
<table><title>Sizes</title><tgroup><thead><row><entry>A</entry><entry>B</entry></row></thead><tbody><row><entry>«key»|x</entry></row></tbody></tgroup></table>
<qandaset><qandaentry><question><para>Why «name»?</para></question><answer><para>So.</para></answer></qandaentry></qandaset>
<bridgehead>«name»</bridgehead>
</section></chapter></book>"""
MANUAL_BODY = """## Admin Guide

### Overview

About the «first» & &lost;.

### Exported Parameters

#### «first»_x (string)

Uses **«name»**, *«kind»*, "«key»", H<sub>2</sub>O;
see [«second»](../other.html), [it](../«first»#a) and [p1](#param_«first»_x);
[a](https://web.example/docs/manual/3-6/script-corevar#«first») [b](https://web.example/docs/manual/devel/script-corevar)
[c](https://x.example/Documentation/No-Page-3-6) [d](https://web.example/docs/tutorials-«second»#x)
[e](http://x.example/Documentation/Tutorials-No) [f](http://y.example/html/docs/modules/3.4.x/«first».html) [some «first» id](#some-«first»_id)

```c title="Set «first»"
set("«name»")
```

#### «first»_x (string)

before

- one

  - «key»

after

> [!WARNING]
> Mind «second».

### More

«first», «second»

**«first»**

is «kind»

**Sizes**

| A | B |
| --- | --- |
| «key»\\|x |  |

**Q: Why «name»?**

So.

#### «name»"""


@query(
    "xml_manuals",
    f"""WITH {WORDS_SQL}
SELECT 'm' || key AS module, kind || ' module' AS title, 'About the ' || first || ' & &lost;.' AS description, {filled_sql(MANUAL_BODY)} AS body,
  'param_' || first || '_x param_' || first || '_x_2' AS ids FROM p WHERE p_partkey % 4 <> 0
UNION ALL SELECT 'm' || key, NULL, NULL, NULL, NULL FROM p WHERE p_partkey % 4 = 0""",
)
def xml_manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element of the XML grammar in each manual; every fourth one is not well-formed."""
    xml = F.when(F.col("p_partkey") % 4 == 0, F.lit("<book><a></book>")).otherwise(filled(MANUAL))
    rows = words(spark, sf_dir)
    found = pages.xml_modules(rows.select(filled("m«key»").alias("module"), xml.alias("xml")), {})
    manual_pages = spark.createDataFrame([("script-corevar",)], "page string")
    flat_pages = rows.select(filled("tutorials-«second»").alias("slug"))
    found = links.rewritten_legacy(found, "module", "body", manual_pages, flat_pages, r"(?:www\.)?x\.example", "https://web.example")
    ids = F.concat_ws(" ", F.try_element_at("ids", F.lit("p1")), F.try_element_at("ids", F.lit("toc5")))
    return found.select("module", "title", "description", "body", F.when(F.col("ids").isNotNull(), ids).alias("ids"))


#: Blocks of the manual: kind, level, id, id in the XML, text.
BLOCKS = [
    ("heading", 2, "admin_guide", "", "## Admin Guide"),
    ("heading", 3, "overview", "s1", "### Overview"),
    ("para", 0, "", "", "About the «first» & &lost;."),
    ("heading", 3, "exported_parameters", "s2", "### Exported Parameters"),
    ("heading", 4, "param_«first»_x", "p1", "#### «first»_x (string)"),
    ("para", 0, "", "", "Uses **«name»**, *«kind»*, "),
    ("code", 0, "", "", '```c title="Set «first»"\nset("«name»")\n```'),
    ("heading", 4, "param_«first»_x_2", "", "#### «first»_x (string)"),
    ("para", 0, "", "", "before"),
    ("list", 0, "", "", "- one\n\n  - «key»"),
    ("para", 0, "", "", "after"),
    ("alert", 0, "", "", "> [!WARNING]\n> Mind «second»."),
    ("heading", 3, "more", "", "### More"),
    ("list", 0, "", "", "«first», «second»"),
    ("term", 0, "", "", "**«first»**"),
    ("para", 0, "", "", "is «kind»"),
    ("para", 0, "", "", "**Sizes**"),
    ("table", 2, "", "", "| A | B |\n| --- | --- |\n| «key»\\|x |  |"),
    ("qa", 0, "", "", "**Q: Why «name»?**"),
    ("qa", 0, "", "", "So."),
]


def _blocks_sql() -> str:
    text = lambda t: filled_sql(t) if t else "NULL"
    rows = [
        f"SELECT 'm' || key AS module, {pos} AS pos, '{kind}' AS kind, {level} AS level, {text(id_)} AS id, {text(legacy)} AS legacy, {text(shown)} AS shown FROM p WHERE p_partkey % 4 <> 0"
        for pos, (kind, level, id_, legacy, shown) in enumerate(BLOCKS)
    ]
    return f"WITH {WORDS_SQL}\n" + "\nUNION ALL\n".join(rows)


@query("xml_rows", _blocks_sql())
def xml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of every manual as a row; long paragraphs by what they begin with. The last heading, whose id is made of a
    word of the row, is left to the query of whole bodies."""
    xml = F.when(F.col("p_partkey") % 4 == 0, F.lit("<book><a></book>")).otherwise(filled(MANUAL))
    found = pages.xml_rows(words(spark, sf_dir).select(filled("m«key»").alias("module"), xml.alias("xml")), {})
    shown = F.when(F.startswith("text", F.lit("Uses ")), F.regexp_extract("text", r'^[^"]*', 0)).otherwise(F.col("text"))
    return found.filter(F.col("pos") < len(BLOCKS)).select("module", "pos", "kind", "level", "id", "legacy", shown.alias("shown"))


@query(
    "xml_folders",
    f"""WITH {WORDS_SQL}
SELECT 'm' || key AS module, 'm' || key AS title, '## Guide' || chr(10) || chr(10) || 'From ' || first || ' by the ' || kind || ' team.' || chr(10) || chr(10)
  || '[samples](./samples.md "include")' AS body, 'x.cfg' AS samples FROM p WHERE p_partkey % 3 = 0
UNION ALL SELECT 'm' || key, 'm' || key, 'Other ' || name, '' FROM p WHERE p_partkey % 3 = 1""",
)
def xml_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A main text with parts and a sample; a folder whose main text has another name; one with parts only."""
    k = F.col("p_partkey") % 3
    file = lambda name, text: F.struct(name.alias("file"), text.alias("text"))
    main = """<!DOCTYPE book [<!ENTITY part SYSTEM "m«key»_admin.xml"><!ENTITY s SYSTEM "../etc/x.cfg"><!ENTITY no SYSTEM "no.xml"><!ENTITY team "the «kind» team">]>
<book>&part;&no;</book>"""
    part = "<!-- head -->\n<chapter><title>Guide</title><para>From «first» by &team;.</para><example><programlisting>&s;</programlisting></example></chapter>"
    full = F.array(file(filled("m«key».xml"), filled(main)), file(filled("m«key»_admin.xml"), filled(part)), file(F.lit("x.cfg"), F.lit("x")))
    other = F.array(file(F.lit("zz.xml"), F.lit("<book>gone</book>")), file(F.lit("a.xml"), filled("<book><para>Other «name»</para></book>")))
    only = F.array(file(F.lit("a_faq.xml"), F.lit("<book/>")))
    folders = F.when(k == 0, full).when(k == 1, other).otherwise(only)
    files = words(spark, sf_dir).select(filled("m«key»").alias("module"), F.explode(folders).alias("f")).select("module", "f.*")
    found = pages.xml_folders(files, {"team": "nobody"})
    return found.select("module", "title", "body", F.array_join("samples", ",").alias("samples"))


@query(
    "module_readmes",
    f"""WITH {WORDS_SQL}
SELECT p_partkey, '---' || chr(10) || 'title: "' || kind || ' \\"' || first || '\\""' || chr(10)
  || CASE WHEN p_partkey % 2 = 0 THEN 'description: "' || name || '"' || chr(10) ELSE '' END || '---' || chr(10) || chr(10) || 'Body' || chr(10)
  || CASE WHEN p_partkey % 3 = 0 THEN '## Contributors of ' || key ELSE '<!-- CONTRIBUTORS -->' END || chr(10) || chr(10)
  || '### License' || chr(10) || chr(10) || 'All documentation files (i.e. .md extension) are licensed under the Creative Common License 4.0' || chr(10) AS text FROM p""",
)
def module_readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts with their heads; contributors are filled in where there are some."""
    rows = words(spark, sf_dir)
    about = F.when(F.col("p_partkey") % 2 == 0, F.col("name")).otherwise("")
    text = pages.module_readme(filled('«kind» "«first»"'), about, F.lit("Body"))
    section = F.when(F.col("p_partkey") % 3 == 0, filled("## Contributors of «key»")).otherwise("")
    sections = rows.filter("p_partkey % 5 <> 1 OR p_partkey % 3 = 0").select("p_partkey", section.alias("section"))
    filled_in = fill_placeholder(rows.select("p_partkey", text.alias("body")), sections, "p_partkey", pages.CONTRIBUTORS_MARK)
    return filled_in.select("p_partkey", F.col("body").alias("text"))


TABLE = """<?xml version="1.0"?><!DOCTYPE table [<!ENTITY lng "not this one">]>
<db:table xmlns:db="http://x.example/db"><name>t&key;</name><db:description><db:para>All  «name» of &who;</db:para></db:description>
<column id="c1"><name>id</name><type>&int;</type><size>&lng;</size><primary/><autoincrement/><description><db:para>Key | «first» &lost; &amp; &who;</db:para></description></column>
<column id="c2"><name>&second;</name><type>string</type><default>&key;</default><null/><description>See <ulink url="&DOC;/«first».html">the module</ulink>,
<emphasis role="bold">&who;</emphasis> &lt; <function>f()</function></description></column>
<column id="c3"><name>note</name><type>string</type><default><null/></default><description>At &DOC;/«second».html</description></column>
<column id="c4"><name>kind</name><type>string</type><size>5</size><default>&kind;</default><description>&loop;</description></column>
<index><name>i1</name><colref linkend="c2"/><colref linkend="z&key;"/><unique/></index><index><name>i2</name><colref linkend="c1"/></index></db:table>"""
DECLARED = """<!ENTITY who "the &team; of &kind;"> <!ENTITY team 'many'> <!ENTITY team "few"> <!ENTITY int "int">
<!ENTITY lng "«size»"> <!ENTITY kind "«kind»"> <!ENTITY DOC "https://x.example/docs/modules/devel"> <!ENTITY loop "&loop;"> <!ENTITY amp "no">"""
TABLE_TEXT = """### Table "t&key;"

All «name» of the many of «kind»

| name | type | size | default | null | description | key | extra attributes |
| --- | --- | --- | --- | --- | --- | --- | --- |
| `id` | `int` | «size» | default | no | Key \\| «first» &lost; & the many of «kind» | primary | autoincrement |
| `&second;` | `string` | not specified | '&key;' | yes | See [the module]([«first»](/docs/modules/«kind»/«first»)), **the many of «kind»** < `f()` |  |  |
| `note` | `string` | not specified | NULL | no | At [«second»](/docs/modules/«kind»/«second») |  |  |
| `kind` | `string` | 5 | '«kind»' | no | &loop; |  |  |

**Indexes**

| name | type | links | description |
| --- | --- | --- | --- |
| `i1` | unique | &second;, z&key; |  |
| `i2` | default | id |  |
"""


@query(
    "schema_pages",
    f"""WITH {WORDS_SQL},
t AS (SELECT *, CAST(len(kind) AS VARCHAR) AS size, p_partkey % 4 <> 1 AND p_partkey % 8 <> 2 AS whole FROM p),
parts AS (SELECT *, {filled_sql(TABLE_TEXT)} AS part FROM t),
m AS (SELECT kind, p_partkey // 4 AS g, '## ' || kind || ' ' || CAST(p_partkey // 4 AS VARCHAR) || chr(10) || chr(10)
    || coalesce(string_agg(part, chr(10) ORDER BY p_partkey DESC) FILTER (WHERE whole), '') AS section,
    count(*) FILTER (WHERE whole) AS n, count(*) FILTER (WHERE NOT whole) AS missing FROM parts GROUP BY kind, g)
SELECT kind AS slug, string_agg(section, chr(10) ORDER BY lpad(CAST(g AS VARCHAR), 9, '0')) AS body,
  CAST(sum(n) AS BIGINT) AS n_tables, CAST(sum(missing) AS BIGINT) AS n_missing FROM m GROUP BY kind""",
)
def schema_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version for each kind of part, with entities of its own; a module for four keys, a table for each key. Entities stand
    in types, sizes, names, defaults, addresses and descriptions, in each other and in themselves; some are not declared. A
    fourth of the tables has no end, an eighth has a column without one."""
    rows = words(spark, sf_dir).withColumn("g", F.floor(F.col("p_partkey") / 4).cast("string"))
    k = F.col("p_partkey")
    open_column = F.lit("<table><name>x</name><column><name>a</name></table>")
    xml = F.when(k % 4 == 1, F.lit("<table><name>x</name>")).when(k % 8 == 2, open_column).otherwise(filled(TABLE))
    tables = rows.select(F.col("kind").alias("slug"), filled("t«key».xml").alias("table_file"), xml.alias("xml"))
    declared = rows.select("kind", F.length("kind").cast("string").alias("size")).distinct().select(F.col("kind").alias("scope"), filled(DECLARED).alias("text"))
    one = F.concat(F.lit('<xi:include href="t'), "key", F.lit('.xml"/>'))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("x")))))
    modules = rows.groupBy("kind", "g").agg(F.array_join(F.transform(ordered, lambda x: x["x"]), "").alias("refs"))
    text = F.concat(F.lit("<m><name>"), "kind", F.lit(" "), "g", F.lit("</name>"), "refs", F.lit("</m>"))
    modules = modules.select(F.col("kind").alias("slug"), F.concat(F.lpad("g", 9, "0"), F.lit(".xml")).alias("module_file"), text.alias("xml"))
    return schema_tables.schema_pages(modules, tables, readers.entity_rows(declared), r"(?:www\.)?x\.example")


@query(
    "include_expansion",
    f"""WITH {WORDS_SQL},
pages AS (SELECT key, 'docs/p' || key || '.md' AS path, kind || chr(10) || chr(10)
    || 'In ' || name || chr(10) || chr(10) || 'deep' || chr(10) || chr(10) || '```c' || chr(10) || 'x = ' || key || chr(10) || '```' || chr(10) || chr(10)
    || 'In ' || name || chr(10) || chr(10) || 'deep' || chr(10) || chr(10) || '```c' || chr(10) || 'x = ' || key || chr(10) || '```'
    || chr(10) || chr(10) || 'see [x](inc/i' || key || '.md "include")' || chr(10) || chr(10) AS body FROM p)
SELECT path, body || CASE CAST(key AS INT) % 5 WHEN 1 THEN '[n](none.md "include")' WHEN 2 THEN '[n](./../docs/p' || key || '.md "include")' ELSE 'end' END AS body,
  CASE CAST(key AS INT) % 5 WHEN 1 THEN 'missing' WHEN 2 THEN 'cycle' ELSE 'ok' END AS state FROM pages""",
)
def include_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two includes of one file side by side, includes in included files, files that are no pages, one in a line of prose."""
    k = F.col("p_partkey") % 5
    last = F.when(k == 1, filled('[n](none.md "include")')).when(k == 2, filled('[n](./../docs/p«key».md "include")')).otherwise("end")
    inner = '[x](inc/i«key».md "include")'
    body = F.concat(filled(f"«kind»\n\n{inner}\n\n{inner}\n\nsee {inner}\n\n"), last)
    file = lambda path, text: F.struct(filled(path).alias("path"), text.alias("body"))
    files = F.array(
        file("docs/p«key».md", body),
        file("docs/inc/i«key».md", filled('In «name»\n\n[s](../shared.md "include")\n\n[c](../../etc/c«key».cfg "include")\n')),
        file("etc/c«key».cfg", filled("x = «key»\n")),
    )
    rows = words(spark, sf_dir).select(F.explode(files).alias("f")).select("f.*")
    shared = spark.createDataFrame([("docs/shared.md", "deep\n")], "path string, body string")
    return pages.expanded_includes(rows.unionByName(shared)).filter(F.col("path").startswith("docs/p"))


@query(
    "linked_anchors",
    f"""WITH {WORDS_SQL}
SELECT p_partkey, '[a](/docs/modules/3-4/' || first || CASE WHEN p_partkey % 2 = 0 THEN '#new_' || second ELSE '#old_' || second END || ') [b](Page-3-6.md#pid) [c](Page.md'
  || ') [d](../modules/' || first || '/README.md#same) [e](https://x.example/#toc1) [f](#toc1) [g](No.md#toc9)' AS body FROM p""",
)
def linked_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ids for old ones; positions beyond a known page's end go; equal ids, unknown pages and outside links stay."""
    rows = words(spark, sf_dir).select(
        "p_partkey",
        F.lit("devel").alias("slug"),
        filled(
            "[a](/docs/modules/3-4/«first»#old_«second») [b](Page-3-6.md#toc2) [c](Page.md#toc99) [d](../modules/«first»/README.md#same)"
            " [e](https://x.example/#toc1) [f](#toc1) [g](No.md#toc9)"
        ).alias("body"),
    )
    part = words(spark, sf_dir)
    seconds = part.filter("p_partkey % 2 = 0").select("first", "second", "p_partkey")
    # An index of the even keys only would give equal words to odd ones too, so the page has the key's parity.
    parity = F.when(F.col("p_partkey") % 2 == 0, F.lit("/docs/modules/3-4/")).otherwise(F.lit("/docs/modules/3-5/"))
    rows = rows.withColumn("body", F.replace("body", F.lit("/docs/modules/3-4/"), parity))
    index = seconds.select(F.lit("modules").alias("section"), F.lit("3-4").alias("slug"), F.col("first").alias("page"), filled("old_«second»").alias("ref"), filled("new_«second»").alias("id")).distinct()
    same = part.select(F.lit("modules").alias("section"), F.lit("devel").alias("slug"), F.col("first").alias("page"), F.lit("same").alias("ref"), F.lit("same").alias("id")).distinct()
    fixed = spark.createDataFrame([("manual", "3-6", "page", "toc2", "pid"), ("manual", "devel", "page", "toc1", "x")], "section string, slug string, page string, ref string, id string")
    found = links.rewritten_anchors(rows, "p_partkey", "body", "slug", index.unionByName(same).unionByName(fixed))
    return found.select("p_partkey", F.replace("body", F.lit("/docs/modules/3-5/"), F.lit("/docs/modules/3-4/")).alias("body"))


@query(
    "linked_positions",
    f"""WITH {WORDS_SQL}
SELECT 'r' || key AS route, '[a](#h1_' || first || ') [b](/docs/r' || key || '#h2) [c](/docs/r' || key || ') [d](/docs/none#toc1) [e](https://x.example#toc1) [f](o.md#toc1)' AS body FROM p""",
)
def linked_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = words(spark, sf_dir)
    body = filled("[a](#toc1) [b](/docs/r«key»#toc2) [c](/docs/r«key»#toc3) [d](/docs/none#toc1) [e](https://x.example#toc1) [f](o.md#toc1)")
    heads = F.array(F.struct(F.lit(1).cast("long").alias("n"), filled("h1_«first»").alias("id")), F.struct(F.lit(2).cast("long").alias("n"), F.lit("h2").alias("id")))
    index = rows.select(filled("r«key»").alias("route"), F.explode(heads).alias("h")).select("route", "h.*")
    return links.rewritten_positions(rows.select(filled("r«key»").alias("route"), body.alias("body")), "route", "body", index)


@query(
    "linked_ids",
    f"""WITH {WORDS_SQL}
SELECT p_partkey, '[a](/docs/modules/1-4/m' || key || '#' || CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END || ') [b](m#old) ' || name AS body FROM p""",
)
def linked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = words(spark, sf_dir)
    ids = rows.filter("p_partkey % 2 = 0").select(
        F.lit("modules").alias("section"), F.lit("1-4").alias("slug"), filled("m«key»").alias("page"), F.lit("old").alias("ref"), F.lit("new").alias("id")
    )
    return links.rewritten_ids(rows.select("p_partkey", filled("[a](/docs/modules/1-4/m«key»#old) [b](m#old) «name»").alias("body")), "p_partkey", "body", ids)


@query(
    "manual_subpages",
    """WITH p AS (SELECT DISTINCT p_type AS kind FROM part)
SELECT kind AS version, CAST(0 AS BIGINT) AS pos, 'Documentation.Page-' || kind AS name, 'Page.md' AS file FROM p
UNION ALL SELECT kind, 1, 'Documentation.Intro-' || kind, 'Intro.md' FROM p""",
)
def manual_subpages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manual for each kind of part; its pages are those of its index that exist, once each."""
    kinds = words(spark, sf_dir).select("kind").distinct()
    index = filled("[[Documentation/Page-«kind»|x]] [[Intro-«kind» | Intro]] [[Manual-«kind»]] [[Documentation.Manuals]] [[Documentation.Gone]] [[Intro-«kind»]]")
    indexes = kinds.select(F.col("kind").alias("version"), filled("Documentation.Manual-«kind»").alias("name"), index.alias("text"))
    wiki = kinds.select(F.explode(F.array(*[filled(f"Documentation.{n}-«kind»") for n in ("Page", "Intro", "Manual", "Other")])).alias("name"))
    found = manual.subpages(indexes, wiki)
    return found.select("version", F.col("pos").cast("long").alias("pos"), "name", manual.page_file(F.col("name"), F.col("version")).alias("file"))


ROUTES = {
    "file": ("Documentation.Sub«first»-4-1#toc2", "Sub.md#toc2"),
    "file, no version": ("Sub«first»", "Sub.md"),
    "redirect to the landing page": ("Old_«first»", "/docs/manual/devel"),
    "landing page": ("Documentation.Index#toc3", "/docs/manual/devel"),
    "another version": ("Documentation.Known-3-6#a«key»", "/docs/manual/3-6/known#a«key»"),
    "newest version": ("Documentation/Known#toc2", "/docs/manual/devel/known"),
    "page of the site": ("About.My-Page", "/about/my-page"),
    "documentation": ("Documentation.Else«key»", "/docs/else«key»"),
    "the old site": ("Resources.«first».x«key»", "https://old.example/Resources/«first»/x«key»"),
}


@query(
    "wiki_routes",
    f"WITH {WORDS_SQL}\n" + "\nUNION ALL\n".join(f"SELECT p_partkey, '{r}' AS rule, {filled_sql(want)} AS route FROM p" for r, (_, want) in ROUTES.items()),
)
def wiki_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the way from a page's name to its route."""
    rows = words(spark, sf_dir)
    cases = F.array(*[F.struct(F.lit(rule).alias("rule"), filled(given).alias("target")) for rule, (given, _) in ROUTES.items()])
    asked = rows.select("p_partkey", F.lit("4-1").alias("version"), F.explode(cases).alias("c")).select("p_partkey", "version", "c.*")
    firsts = rows.select("first").distinct()
    keys = F.array(filled("sub«first»41"), filled("sub«first»"))
    files = firsts.select(F.lit("4-1").alias("version"), F.explode(keys).alias("key"), F.lit("Sub.md").alias("file"))
    redirects = readers.redirects(firsts.select(filled("Old_«first»").alias("name"), F.lit("(:redirect Documentation.HomePage:)").alias("body")))
    known = spark.createDataFrame([("known",)], "page string")
    slugs = spark.createDataFrame([("mypage", "/about/my-page")], "key string, slug string")
    return manual.page_routes(asked, files, redirects, known, slugs, "https://old.example").select("p_partkey", "rule", "route")


MANUAL_PAGE = """## Escape Sequences {#varavps}
### The $«first» {#old_«key»}
```
## code
```
### The $«first»
#### «kind» «key»
[a](#old_«key») [b](#toc3) [c](#toc9) [d](#other)"""


@query(
    "generated_ids",
    f"""WITH {WORDS_SQL}
SELECT key, CASE WHEN p_partkey % 2 = 0 THEN 'script-corevar' ELSE 'other' END AS page,
  '## Escape Sequences' || chr(10) || '### The $' || first || chr(10) || '```' || chr(10) || '## code' || chr(10) || '```' || chr(10) || '### The $' || first || chr(10)
  || '#### ' || kind || ' ' || key || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '[a](#' || first || ') [b](#' || first || '_2' ELSE '[a](#the-' || first || ') [b](#the-' || first || '-1' END
  || ') [c](#toc9) [d](#other)' AS body,
  CASE WHEN p_partkey % 2 = 0 THEN 'escape_sequences ' || low || '_' || key ELSE 'escape-sequences ' || low || '-' || key END AS ids FROM p""",
)
def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.when(F.col("p_partkey") % 2 == 0, "script-corevar").otherwise("other")
    rows = words(spark, sf_dir).select("key", page.alias("page"), filled(MANUAL_PAGE).alias("body"))
    rows = rows.withColumn("body", manual.corrected_ids(F.col("page"), F.col("body")))
    found = manual.generated_ids(rows, "key").join(rows.select("key", "page"), "key")
    ids = F.concat_ws(" ", F.try_element_at("ids", F.lit("toc1")), F.try_element_at("ids", F.lit("toc4")))
    return found.select("key", "page", "body", ids.alias("ids"))


#: A manual's index and one of its pages, in the wiki's markup, and what becomes of the page.
MANUAL_INDEX = "! All%0a* [[Script-CoreVar-«kind» | vars]]%0a* [[Documentation/Intro-«kind»]]%0a* [[Documentation.Gone-«kind»]]"
MANUAL_TEXT = (
    "[[#v]]%0a!! $«low»%0a"
    "See [[#v|here]], [[Script-CoreVar-«kind»#v|itself]], [[Intro|the '''intro''']], [[Documentation.Intro-«kind»#toc1]],%0a"
    "[[Documentation.Script-CoreVar-3-6#toc2|an older one]], [[Documentation/Intro#toc4|intro of the newest]],%0a"
    "[[Old.Name|moved]], [[Documentation.Index#toc1|landing]], [[Site.My-Page|of the site]],%0a"
    "[[Documentation.Unknown|none]], [[About.Team_A|elsewhere]],%0a"
    "[[https://www.x.example/Documentation/Script-CoreVar-4-1#toc3|url of the manual]], [[http://x.example/Documentation/Intro?action=edit#toc9|url, no version]],%0a"
    "[[http://x.example/Documentation/My-Page#p|url of the site]], [[http://x.example/Documentation/Nothing|url of nothing]],%0a"
    "[[http://x.example/html/docs/modules/3.4.x/tm.html#a«low»|module]], [[https://y.example/Documentation/Intro|another host]], [[http://z.example/a_b]]"
)
MANUAL_MADE = """## $«low»
See [here](#«low»), [itself](Script-CoreVar.md#v), [the **intro**](Intro.md), [Documentation.Intro-«kind»#toc1](Intro.md#toc1),
[an older one](https://web.example/docs/manual/3-6/script-corevar#toc2), [intro of the newest](Intro.md#toc4),
[moved](https://web.example/docs/manual/devel/intro), [landing](https://web.example/docs/manual/devel), [of the site](https://web.example/docs/my-page),
[none](https://web.example/docs/unknown), [elsewhere](https://old.example/About/Team_A),
[url of the manual](https://web.example/docs/manual/devel/script-corevar#toc3), [url, no version](https://web.example/docs/manual/devel/intro),
[url of the site](https://web.example/docs/my-page#p), [url of nothing](http://x.example/Documentation/Nothing),
[module](../modules/tm/README.md#a«low»), [another host](https://y.example/Documentation/Intro), [http://z.example/a_b](http://z.example/a_b)"""


@query(
    "converted_manuals",
    f"""WITH p AS (SELECT DISTINCT p_type AS kind, lower(p_type) AS low FROM part)
SELECT kind AS version, 'README.md' AS file, 'Manual ' || kind || CASE WHEN kind < 'M' THEN ' / devel' ELSE '' END AS title,
  '## All' || chr(10) || '* [vars](Script-CoreVar.md)' || chr(10) || '* [Documentation/Intro-' || kind || '](Intro.md)' || chr(10)
  || '* [Documentation.Gone-' || kind || '](https://web.example/docs/gone-' || low || ')' AS body, 'toc1=all' AS ids FROM p
UNION ALL SELECT kind, 'Script-CoreVar.md', 'Vars ' || kind, {filled_sql(MANUAL_MADE)}, 'toc1=' || low || ',v=' || low FROM p
UNION ALL SELECT kind, 'Intro.md', 'Intro ' || kind, 'No links.', '' FROM p""",
)
def converted_manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From stored pages to a manual's files, with titles, ids and links: to the page itself and its siblings, by redirect, to
    other versions, to the site, to nothing known, to the old site, and outside."""
    kinds = words(spark, sf_dir).select("kind", "low").distinct()
    page = lambda name, title, text: F.struct(filled(name).alias("name"), filled(f"text=!!!!!Docs -> {title}%0a{text}\n").cast("binary").alias("content"))
    rows = F.array(
        page("Documentation.Manual-«kind»", "Manual «kind»", MANUAL_INDEX),
        page("Documentation.Script-CoreVar-«kind»", "Vars «kind»", MANUAL_TEXT),
        page("Documentation.Intro-«kind»", "Intro «kind»", "No links."),
    )
    wiki = pages.marked_pages(kinds.select(F.explode(rows).alias("r")).select("r.*"))
    versions = kinds.select(F.col("kind").alias("version"), (F.col("kind") < "M").alias("devel"))
    redirects = spark.createDataFrame([("old.name", "Documentation.Intro")], "key string, target string")
    slugs = spark.createDataFrame([("mypage", "/docs/my-page")], "key string, slug string")
    found = manual.converted_manuals(wiki, versions, redirects, slugs, "https://old.example", "https://web.example", r"(?:www\.)?x\.example")
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("ids"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return found.select("version", "file", "title", "body", shown.alias("ids"))


@query(
    "id_folds",
    f"""WITH {WORDS_SQL}
SELECT p_partkey, concat_ws(' ', first, first || '_2', first || '_2_2', second) AS free, concat_ws(' ', first, first || '-1', first || '-2', second) AS counted,
  concat_ws(' ', first, key, first || '-1', second) AS fallback FROM p""",
)
def id_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids told apart within a page, literal collisions included: three ways."""
    ids = lambda *parts: F.array(*map(filled, parts))
    rows = words(spark, sf_dir)
    own = F.array(F.lit(None).cast("string"), F.col("key"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return rows.select(
        "p_partkey",
        F.array_join(anchors.free_underscore(ids("«first»", "«first»", "«first»_2", "«second»")), " ").alias("free"),
        F.array_join(anchors.counted_hyphen(ids("«first»", "«first»-1", "«first»", "«second»")), " ").alias("counted"),
        F.array_join(anchors.fallback_hyphen(ids("«first»", "«first»", "«first»", "«second»"), own), " ").alias("fallback"),
    )


@query(
    "inferred_anchors",
    f"""WITH {WORDS_SQL}
SELECT p_partkey AS page, 1 AS pos, 'id_' || first AS id FROM p UNION ALL SELECT p_partkey, 2, 'own' FROM p UNION ALL SELECT p_partkey, 3, NULL FROM p""",
)
def inferred_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings take the ids of links that have their text; own ids stay; of two ids none is taken."""
    rows = words(spark, sf_dir)
    head = lambda n, text, id_: F.struct(F.lit(n).alias("pos"), filled(text).alias("text"), id_.cast("string").alias("id"))
    heads = F.array(head(1, "The `«first»`", F.lit(None)), head(2, "«second»", F.lit("own")), head(3, "«kind» x", F.lit(None)))
    link = lambda label, id_: F.struct(filled(label).alias("label"), filled(id_).alias("id"))
    made = F.array(link("the «first»", "id_«first»"), link("«second»", "y"), link("«kind» X", "u"), link("**«low»** x", "v"))
    headings_ = rows.select(F.col("p_partkey").alias("page"), F.explode(heads).alias("h")).select("page", "h.*")
    links_ = rows.select(F.col("p_partkey").alias("page"), F.explode(made).alias("l")).select("page", "l.*")
    return headings.inferred_anchors(headings_, links_).select("page", "pos", "id")


@query(
    "anchor_side_cars",
    """WITH t AS (SELECT p_brand AS section, p_type AS slug, CAST(p_partkey AS VARCHAR) AS page, 'toc1' AS ref, p_name AS id FROM part)
SELECT section, slug, 'b/' || page AS page, ref, id FROM t UNION ALL SELECT section, slug, 'b/' || page, 'old', id || '"' FROM t""",
)
def anchor_side_cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as sorted JSON and back, quotes and slashes included."""
    refs = F.array(F.struct(F.lit("toc1").alias("ref"), F.col("p_name").alias("id")), F.struct(F.lit("old").alias("ref"), F.concat("p_name", F.lit('"')).alias("id")))
    part = load(spark, sf_dir, "part")
    index = part.select(F.col("p_brand").alias("section"), F.col("p_type").alias("slug"), F.concat(F.lit("b/"), F.col("p_partkey").cast("string")).alias("page"), F.explode(refs).alias("r"))
    return readers.anchor_index(sinks.index_json(index.select("section", "slug", "page", "r.*")))
