"""Readers, heads, menus, entities, logs, feeds and predicates over generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import names, predicates, rules, values
from loomdoc.operators import contributors, headings, pages
from loomdoc.plans.cases import WORDS_SQL, Cases, filled, inputs, wanted, words
from loomdoc.plans.registry import query
from loomdoc.sources import readers, sinks
from loomdoc.tables import load


HEAD = ["title", "subtitle", "subtitleHref", "author", "description"]


@query(
    "site_pages",
    f"""WITH {WORDS_SQL},
h AS (SELECT p_partkey % 4 AS k, *, repeat(name || ' ', 40) AS long FROM p)
SELECT p_partkey, CASE k
  WHEN 0 THEN '---' || chr(10) || 'title: "' || name || '"' || chr(10) || 'subtitle: "How to ' || first || '"' || chr(10) || 'author: "by Jo ' || second || '"'
    || chr(10) || 'description: ""' || chr(10) || '---' || chr(10) || '## ' || kind || chr(10) || 'All of it.'
  WHEN 1 THEN '---' || chr(10) || 'title: "' || name || '"' || chr(10) || 'subtitle: "' || name || '"' || chr(10) || 'subtitleHref: "/docs/modules/1-4/' || first || '"'
    || chr(10) || 'description: "Text of ' || kind || '."' || chr(10) || '---' || chr(10) || '## One' || chr(10) || chr(10) || 'Text of **' || kind || '**.'
  WHEN 2 THEN '---' || chr(10) || 'title: "' || name || '"' || chr(10) || 'description: ""' || chr(10) || '---' || chr(10) || '## ' || kind
  ELSE '---' || chr(10) || 'title: "page' || key || '"' || chr(10) || 'description: "' || rtrim(left(long, 157)) || '..."' || chr(10) || '---' || chr(10) || rtrim(long)
  END AS text FROM h""",
)
def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an author's line, with a link in the breadcrumb, with a heading that repeats the title, and plain ones."""
    k = F.col("p_partkey") % 4
    text = (
        F.when(k == 0, filled("!!!!!Docs -> «name»%0a! How to «first»%0a %25block%25 '''by Jo «second» <jo@x.example>'''%0a----%0a! «kind»%0aAll of it."))
        .when(k == 1, filled("!!!!!Docs -> [[http://x.example/html/docs/modules/1.4.x/«first».html|{+«name»+}]]%0a! One%0a%0aText of '''«kind»'''."))
        .when(k == 2, filled("!!!!!Docs -> «name»%0a! Own «name»%0a!! «kind»"))
        .otherwise(F.trim(F.repeat(filled("«name» "), 40)))
    )
    rows = words(spark, sf_dir).select(F.concat(F.lit("page"), "key").alias("name"), F.concat(F.lit("text="), text).cast("binary").alias("content"))
    found = pages.site_pages(rows, "own")
    head = pages.page_head({k: F.col(c) for k, c in zip(HEAD, ["title", "subtitle", "subtitle_href", "author", "description"], strict=True)})
    return found.select(F.substring("name", 5, 20).cast("long").alias("p_partkey"), F.concat(head, "body").alias("text"))


@query(
    "front_matter",
    f"""WITH {WORDS_SQL}
SELECT 'docs/' || low || '/p' || key AS route, name AS title, p_partkey % 2 = 0 AS hidden, 'Body ' || key AS body FROM p WHERE p_partkey % 3 <> 0
UNION ALL SELECT 'docs/' || low || '/p' || key || '/sub', NULL, false, 'No head' FROM p WHERE p_partkey % 3 = 0""",
)
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree's pages with and without a head; an index page has its folder's route."""
    head = F.when(F.col("p_partkey") % 2 == 0, F.lit("sidebar:\n  hidden: true\n")).otherwise("")
    page = F.concat(filled('---\ntitle: "«name»"\n'), head, filled("---\nBody «key»"))
    path = F.when(F.col("p_partkey") % 3 == 0, filled("file:/x/content/docs/«low»/p«key»/Sub/index.mdx")).otherwise(filled("file:/x/content/docs/«low»/P«key».md"))
    rows = words(spark, sf_dir).select(path.alias("path"), F.when(F.col("p_partkey") % 3 == 0, F.lit("No head")).otherwise(page).alias("body"))
    other = spark.createDataFrame([("file:/x/content/docs/a.png", "")], "path string, body string")
    return readers.page_collection(rows.unionByName(other), "/x/content")


@query(
    "link_stems",
    f"""WITH {WORDS_SQL}
SELECT first || low AS key, '/docs/' || max(key) || '/' || first || '-' || low AS slug FROM p GROUP BY first, low""",
)
def link_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that links use; modules and manuals are left out."""
    routes = F.array(filled("docs/«key»/«first»-«low»"), filled("docs/modules/«key»/m«key»"), filled("docs/manual/3-4/«first»"))
    return readers.by_stem(words(spark, sf_dir).select(F.explode(routes).alias("route")))


@query(
    "entity_fixpoint",
    f"""WITH {WORDS_SQL}
SELECT key AS scope, 'a' AS name, 'the ' || first || ' of ' || kind AS value, false AS open FROM p
UNION ALL SELECT key, 'b', first || ' of ' || kind, false FROM p UNION ALL SELECT key, 'c', kind, false FROM p
UNION ALL SELECT key, 'self', '&self; &gone;', false FROM p UNION ALL SELECT key, 'x', '&x;', false FROM p UNION ALL SELECT key, 'y', '&y;', false FROM p""",
)
def entity_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations in both kinds of quotes, references of references, to themselves, to nothing, and in a circle, which ends at itself."""
    text = filled("""<!ENTITY a "the &b;"><!ENTITY c "lost"><!ENTITY c '«kind»'><!ENTITY b "«first» of &c;"><!ENTITY self "&self; &gone;"><!ENTITY x "&y;"><!ENTITY y "&x;">""")
    return readers.resolved_entities(readers.entity_rows(words(spark, sf_dir).select(F.col("key").alias("scope"), text.alias("text"))))


@query(
    "commit_log",
    f"""WITH {WORDS_SQL}
SELECT key AS module, 'abcdef' || key || '0' AS sha, 'Jo ' || first AS author, CAST(p_partkey + 3 AS BIGINT) AS added, CAST(5 AS BIGINT) AS deleted, '2020-01-02 01:04' AS date FROM p
UNION ALL SELECT key, 'abcdef' || key || '1', 'Al', 0, 2, NULL FROM p""",
)
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with offsets, unreadable dates, binary files, and lines of other folders."""
    lines = F.split(
        filled("abcdef«key»0\tJo «first»\t2020-01-02T03:04:05+02:00\n3\t-\tmodules/«key»/a\n«key»\t5\tmodules/«key»/b\n9\t9\tdoc/«key»\n\nabcdef«key»1\tAl\tbad\n-\t2\tmodules/«key»/c"), "\n"
    )
    rows = words(spark, sf_dir).select(F.col("key").alias("module"), F.posexplode(lines).alias("pos", "line"))
    files = readers.commit_log(rows).filter(predicates.under(F.col("file"), "modules"))
    found = contributors.commits_from_numstat(files.withColumnRenamed("author_raw", "author"))
    return found.select("module", "sha", "author", "added", "deleted", F.date_format("date", "yyyy-MM-dd HH:mm").alias("date"))


@query(
    "feed_items",
    f"""WITH {WORDS_SQL}
SELECT key AS source, CAST(0 AS BIGINT) AS pos, kind || ' < ' || name AS title, 'https://x.example/' || key AS link, '2020-01-02 01:04' AS date,
  left(repeat(name || ' ', 60), 200) || '…' AS description, 'Jo ' || second AS author FROM p
UNION ALL SELECT key, 1, name, NULL, NULL, '…', NULL FROM p""",
)
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two items of each feed; the second lacks most, the third is beyond."""
    first = """<rss><item><title>«kind» &amp;lt; «name»</title><link>https://x.example/«key»</link><pubDate>Thu, 02 Jan 2020 03:04:05 +0200</pubDate>
<description><![CDATA[<p>"""
    rest = "</p>]]></description><dc:creator><![CDATA[Jo «second»]]></dc:creator></item><item><title>«name»</title><pubDate>bad</pubDate></item><item><title>x</title></item></rss>"
    xml = F.concat(filled(first), F.trim(F.repeat(F.concat("name", F.lit(" ")), 60)), filled(rest))
    found = readers.feed_items(words(spark, sf_dir).select(F.col("key").alias("source"), xml.alias("xml")), 2)
    return found.select("source", F.col("pos").cast("long").alias("pos"), "title", "link", F.date_format("pub_date", "yyyy-MM-dd HH:mm").alias("date"), "description", "author")


#: Inputs are ``what|argument|argument``.
PREDICATES: Cases = {
    "below a folder": ("under|modules/«first»/x.c", "true"),
    "a folder that begins alike": ("under|modules-«first»/x.c", "false"),
    "module page": ("class|docs/modules/3-4/«first»", "module"),
    "module list": ("class|docs/modules/3-4", "other"),
    "manual page": ("class|docs/manual/3-4/«first»/«second»", "manual"),
    "manual index": ("class|docs/manual/3-4", "manual"),
    "flat page": ("class|docs/«first»", "flat"),
    "no page of the documents": ("class|blog/modules/3-4/«first»", "other"),
    "news": ("menu|about|news«key»", "false"),
    "recent changes": ("menu|community|recentchanges", "false"),
    "recent changes elsewhere": ("menu|about|recentchanges", "true"),
    "a page": ("menu|about|news-«first»", "true"),
    "active, equal": ("active|/«first»/|/«first»", "true"),
    "active, below": ("active|/«first»/«second»|/«first»/", "true"),
    "not active, begins alike": ("active|/«first»x|/«first»", "false"),
    "the root is itself only": ("active|/«first»|/", "false"),
    "the root": ("active|/|/", "true"),
    "contents": ("level|3", "true"),
    "too deep for contents": ("level|5", "false"),
    "too high for contents": ("level|1", "false"),
}


@query("page_predicates", wanted(PREDICATES))
def page_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs(spark, sf_dir, PREDICATES).withColumn("a", F.split("input", r"\|"))
    a = lambda i: F.coalesce(F.get("a", F.lit(i)), F.lit(""))
    found = {
        "under": predicates.under(a(1), "modules").cast("string"),
        "class": predicates.page_class(a(1)),
        "menu": predicates.in_menu(a(1), a(2)).cast("string"),
        "active": predicates.is_active(a(1), [a(2)]).cast("string"),
        "level": predicates.in_contents(a(1).try_cast("int")).cast("string"),
    }
    output = F.lit(None).cast("string")
    for name, c in found.items():
        output = F.when(a(0) == name, c).otherwise(output)
    return rows.select("p_partkey", "rule", output.alias("output"))


@query(
    "head_faults",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'title' WHEN 1 THEN '' WHEN 2 THEN 'author subtitleHref' ELSE 'title subtitleHref' END AS faults FROM part""",
)
def head_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads that lack a title, are right, have an empty author or a wrong address."""
    k = F.col("p_partkey") % 4
    known = lambda **fields: F.create_map(*[x for name, c in fields.items() for x in (F.lit(name), c.cast("string"))])
    head = (
        F.when(k == 0, known(subtitle=F.col("name")))
        .when(k == 1, known(title=F.col("name"), subtitleHref=F.lit("/docs/x")))
        .when(k == 2, known(title=F.col("name"), author=F.lit(None), subtitleHref=F.lit("not an address")))
        .otherwise(known(title=F.lit("  "), subtitleHref=F.lit("javascript:x")))
    )
    return words(spark, sf_dir).select("p_partkey", F.array_join(predicates.head_faults(head), " ").alias("faults"))


LOGO_PAGE = """<html><head><title>«name»</title>
<link href='/touch.jpg' rel='apple-touch-icon'><link rel="icon" href="/favicon.ico" sizes="16x16">
<link sizes="«key»x«key»" rel="shortcut icon" href="img/«first».svg"><LINK REL="icon" HREF="//cdn.x.example/brand.png?v=1">
<meta content="https://x.example/banner&amp;«first».png" property="og:image"><meta name=twitter:image content=/thumb/«second».svg>
<link rel="stylesheet" href="/logo.css"></head>
<body><img src='/a/«second»-logo.svg' alt=x><img alt="The LOGO" src="../l.png"><img class="plain" src="/x.svg"><img alt="logo"><img alt="logo" src="data:image/png,x"></body></html>"""


@query(
    "logo_candidates",
    f"""WITH {WORDS_SQL},
found AS (
  SELECT p_partkey, unnest([
    ('img-src', 'https://x.example/a/' || second || '-logo.svg', 50 + 15 + 15.0, 6), ('icon', 'https://x.example/en/img/' || first || '.svg', 50 + least(p_partkey / 10.0, 20.0), 3),
    ('apple-touch-icon', 'https://x.example/touch.jpg', 10.0, 1), ('icon', 'https://x.example/favicon.ico', -30 + 1.6, 2), ('icon', 'https://cdn.x.example/brand.png?v=1', 15.0, 4),
    ('og:image', 'https://x.example/banner&' || first || '.png', 20 + 5.0, 5), ('twitter:image', 'https://x.example/thumb/' || second || '.svg', 50 - 30.0, 5.5),
    ('img-src', 'https://x.example/l.png', 20 + 15.0, 7)]) AS c FROM p),
ranked AS (SELECT p_partkey, c[1] AS source, c[2] AS address, CAST(c[3] AS DOUBLE) AS score, row_number() OVER (PARTITION BY p_partkey ORDER BY c[3] DESC, c[4]) AS rn FROM found)
SELECT p_partkey, CAST(rn AS INT) AS rn, source, address, score FROM ranked WHERE rn <= 5""",
)
def logo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of each page's candidates: any quotes and order of attributes, references, addresses above, beside and on
    other hosts; sizes count for icons, a touch icon is one candidate, a query hides the end of an address."""
    rows = words(spark, sf_dir).select("p_partkey", F.lit("https://x.example/en/index.html").alias("url"), filled(LOGO_PAGE).alias("html"))
    found = headings.best_candidates(rows, "p_partkey", 5)
    return found.select("p_partkey", F.col("rn").cast("int").alias("rn"), "source", "address", F.col("score").cast("double").alias("score"))


URLS: Cases = {
    "absolute": ("https://a.example/x/|https://b.example/«key».png", "https://b.example/«key».png"),
    "beside": ("https://a.example/x/y|«first».png", "https://a.example/x/«first».png"),
    "above": ("https://a.example/x/y/|../«first».png", "https://a.example/x/«first».png"),
    "from the root": ("https://a.example/x/y/|/«first».png?v=«key»", "https://a.example/«first».png?v=«key»"),
    "of the same scheme": ("https://a.example/x|//b.example/«first»", "https://b.example/«first»"),
}


@query("resolved_urls", wanted(URLS))
def resolved_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.split("input", r"\|")
    return inputs(spark, sf_dir, URLS).select("p_partkey", "rule", names.resolved_url(part[0], part[1]).alias("output"))


@query(
    "menu_script",
    f"""WITH {WORDS_SQL}
SELECT p_partkey, '[' || chr(10) || '  {{' || chr(10) || '    label: ''' || name || '\\''s'',' || chr(10) || '    slug: ''docs/' || key || ''',' || chr(10) || '  }},' || chr(10)
  || '  {{' || chr(10) || '    label: ''' || kind || ''',' || chr(10) || '    collapsed: true,' || chr(10) || '  }},' || chr(10) || ']' AS script FROM p""",
)
def menu_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menus as the site's script has them: quotes escaped, fields that lack left out."""
    item = lambda label, slug, collapsed: F.struct(label.alias("label"), slug.cast("string").alias("slug"), collapsed.cast("boolean").alias("collapsed"))
    items = F.array(item(filled("«name»'s"), filled("docs/«key»"), F.lit(None)), item(F.col("kind"), F.lit(None), F.lit(True)))
    return words(spark, sf_dir).select("p_partkey", sinks.script_items(items).alias("script"))


@query(
    "logo_manifest",
    """SELECT '[' || string_agg('{"name":"' || n_name || '"' || CASE WHEN n_nationkey % 2 = 0 THEN ',"logo":"/' || n_nationkey || '.png"' ELSE '' END || '}', ',' ORDER BY n_name) || ']' AS json FROM nation""",
)
def logo_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    logo = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("/"), F.col("n_nationkey").cast("string"), F.lit(".png")))
    return sinks.manifest(load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), logo.alias("logo")), "name")


@query(
    "sample_pages",
    f"""WITH {WORDS_SQL}
SELECT 'm' || key AS module, '## First' || chr(10) || chr(10) || '[a.cfg](./samples/a.cfg "include")' || chr(10) || chr(10) || '## ' || first || '.cfg' || chr(10) || chr(10)
  || '[' || first || '.cfg](./samples/' || first || '.cfg "include")' || chr(10) AS samples, 'x' || chr(10) || '[s](./samples.md "include")' AS body FROM p WHERE p_partkey % 2 = 0
UNION ALL SELECT 'm' || key, NULL, 'x' || chr(10) FROM p WHERE p_partkey % 2 = 1""",
)
def sample_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of samples, and the lines that include them where there are some."""
    rows = words(spark, sf_dir)
    sample = lambda ord_, title, file: F.struct(F.lit(ord_).alias("ord"), title.cast("string").alias("title"), filled(file).alias("file"))
    samples = rows.filter("p_partkey % 2 = 0").select(
        filled("m«key»").alias("module"), F.explode(F.array(sample(2, F.lit(None), "«first».cfg"), sample(1, F.lit("First"), "a.cfg"))).alias("s")
    )
    samples = samples.select("module", "s.*")
    made = headings.samples_page(samples).select("module", F.col("body").alias("samples"))
    found = rules.with_samples(rows.select(filled("m«key»").alias("module"), F.lit('x\n[s](./samples.md "include")').alias("body")), samples)
    return found.join(made, "module", "left").select("module", "samples", "body")


@query(
    "first_available",
    """SELECT p_partkey AS id, 'local ' || p_name AS text FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'remote ' || p_name FROM part WHERE p_partkey % 3 = 1""",
)
def first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local rows, and remote ones for keys that lack."""
    part = load(spark, sf_dir, "part")
    text = lambda where: F.concat(F.lit(f"{where} "), "p_name").alias("text")
    local = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), text("local"))
    remote = part.filter("p_partkey % 3 < 2").select(F.col("p_partkey").alias("id"), text("remote"))
    return readers.first_available(local, remote, ["id"])


@query(
    "run_counts",
    f"""WITH {WORDS_SQL}
SELECT kind, CAST(count(*) FILTER (WHERE p_partkey % 3 = 0) AS BIGINT) AS ok, CAST(count(*) FILTER (WHERE p_partkey % 3 = 1) AS BIGINT) AS failed,
  CAST(count(*) FILTER (WHERE p_partkey % 3 = 2) AS BIGINT) AS skipped FROM p GROUP BY kind""",
)
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of a run were converted, could not be parsed, or were not there."""
    k = F.col("p_partkey") % 3
    xml = F.when(k == 0, F.lit("<book/>")).when(k == 1, F.lit("<book>"))
    files = words(spark, sf_dir).select(F.concat_ws(" ", "key", "kind").alias("module"), xml.alias("xml"))
    done = pages.xml_modules(files, {}).select("module", F.col("body").isNotNull().alias("ok"))
    rows = files.select("module", F.col("xml").isNotNull().alias("there")).join(done, "module").withColumn("kind", F.split("module", " ")[1])
    return values.run_counts(rows, "kind")


@query(
    "locale_order",
    """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_type FROM part)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY lower(name), name DESC, p_partkey) AS BIGINT) AS rn FROM n""",
)
def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as people sort them: case counts last, small letters first."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return values.in_locale_order(load(spark, sf_dir, "part").withColumn("name", name), "p_type", "name", "p_partkey").select("p_partkey", "rn")


@query(
    "aside_types",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'note' WHEN 1 THEN 'tip' WHEN 2 THEN 'caution' WHEN 3 THEN 'danger' WHEN 4 THEN 'danger' END AS aside,
  replace(CAST(p_partkey AS VARCHAR) || '-' || p_size, '-', '.') AS version FROM part""",
)
def aside_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["NOTE", "Tip", "IMPORTANT", "WARNING", "caution", "OTHER"]))
    slug = F.concat(F.col("p_partkey").cast("string"), F.lit("-"), F.col("p_size").cast("string"))
    kind = F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", rules.aside_of(kind).alias("aside"), values.version_label(slug).alias("version"))


@query(
    "editors_with_handles",
    """WITH s AS (SELECT c_mktsegment AS grp, 'N' || c_nationkey AS author, max(c_custkey) AS last FROM customer GROUP BY ALL)
SELECT grp, string_agg(CASE WHEN CAST(substr(author, 2) AS INT) % 2 = 0 THEN author || ' (@h' || substr(author, 2) || ')' ELSE author END, ', ' ORDER BY last DESC, author) AS editors FROM s GROUP BY grp""",
)
def editors_with_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editors by their latest change, with the handles that are known."""
    author = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    stats = load(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("grp"), author.alias("author")).agg(F.timestamp_seconds(F.max("c_custkey")).alias("last_date"))
    handles = load(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    handles = handles.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"), F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("handle"))
    return contributors.editors_line(stats, "grp", handles)
