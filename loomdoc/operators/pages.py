"""Whole-page conversion as Spark operators: page-local, so a map over rows and never a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions import code, docbook, mdx, wiki
from loomdoc.operators.lines import fenced, in_order, lines_of
from loomdoc.scratch import checkpointed

BLOCK = T.StructType().add("pos", T.IntegerType()).add("kind", T.StringType()).add("level", T.IntegerType()).add("text", T.StringType())


@F.pandas_udf(T.ArrayType(BLOCK))
def wiki_blocks(texts: pd.Series) -> pd.Series:
    """The blocks of a wiki text, in order; none of a null one."""
    return texts.map(lambda t: [(i, b.kind, b.level, b.text) for i, b in enumerate(wiki.Page(t).blocks())] if t else [])


@F.pandas_udf(T.StringType())
def wiki_markdown(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: wiki.to_markdown(t) if t is not None else None)


@F.pandas_udf(T.StringType())
def safe_markdown(texts: pd.Series) -> pd.Series:
    """Markdown in which braces and angle brackets of prose are code."""
    return texts.map(lambda t: mdx.safe_markdown(t) if t is not None else None)


@F.pandas_udf(T.StringType())
def code_language(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: code.language_of(t.split("\n")) if t is not None else None)


@F.pandas_udf(T.StringType())
def wiki_inline(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: wiki.Inline().convert(t) if t is not None else None)


def parse_wiki(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, level, text): one row per block."""
    return pages.select(key, F.explode(wiki_blocks(F.col(text))).alias("b")).select(key, "b.pos", "b.kind", "b.level", "b.text")


def stored_pages(files: DataFrame) -> DataFrame:
    """(name, fields, title, body) of stored wiki pages (name, content: binary); ``fields`` is a map, first of a key wins."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                fields = wiki.page_fields(bytes(content or b""))
                text = wiki.decode_text(fields.get("text", ""))
                rows.append((name, fields, wiki.title_of(text, name), wiki.to_markdown(text)))
            yield pd.DataFrame(rows, columns=["name", "fields", "title", "body"])

    return files.select("name", "content").mapInPandas(read, "name string, fields map<string, string>, title string, body string")


def marked_pages(files: DataFrame) -> DataFrame:
    """(name, title, text, body, targets) of stored pages (name, content: binary): the source text, and a body whose links to
    pages and outside addresses are marks, the n-th standing for ``targets[n]``. ``links.with_routes`` puts addresses there."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                text, marks = wiki.decode_text(wiki.page_fields(bytes(content or b"")).get("text", "")), wiki.LinkMarks()
                body = wiki.to_markdown(text.replace(marks.OPEN, "").replace(marks.CLOSE, ""), marks)
                rows.append((name, wiki.title_of(text, name), text, body, marks.targets))
            yield pd.DataFrame(rows, columns=["name", "title", "text", "body", "targets"])

    return files.select("name", "content").mapInPandas(read, "name string, title string, text string, body string, targets array<string>")


def site_pages(files: DataFrame, product: str = "") -> DataFrame:
    """(name, title, subtitle, subtitle_href, author, description, body) of stored wiki pages (name, content: binary)."""
    names = ["title", "subtitle", "subtitle_href", "author", "description", "body"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [wiki.decode_text(wiki.page_fields(bytes(c or b"")).get("text", "")) for c in batch["content"]]
            rows = [wiki.site_page(t, n, product) for n, t in zip(batch["name"], texts, strict=True)]
            yield pd.DataFrame({"name": batch["name"], **{k: [r[k] for r in rows] for k in names}})

    return files.select("name", "content").mapInPandas(read, "name string, " + ", ".join(f"{k} string" for k in names))


def page_head(fields: dict[str, Column]) -> Column:
    """The YAML head of a page: fields in order, those that are null left out; one line each."""
    quoted = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f'{name}: "'), quoted(c), F.lit('"\n'))) for name, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("", *lines), F.lit("---\n"))


def xml_modules(files: DataFrame, entities: dict[str, str]) -> DataFrame:
    """(module, title, description, body, ids, samples) of XML manuals (module, xml); unparsable ones have null columns.

    ``entities`` is the table of one branch's global entities, which is small by its nature.
    """
    known = dict(entities)
    known.setdefault("nbsp", " ")

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for module, xml in zip(batch["module"], batch["xml"], strict=True):
                found = docbook.document(module, xml, known) if xml else None
                rows.append((module, *(found.values() if found else [None] * 5)))
            yield pd.DataFrame(rows, columns=["module", "title", "description", "body", "ids", "samples"])

    schema = "module string, title string, description string, body string, ids map<string, string>, samples array<string>"
    return files.select("module", "xml").mapInPandas(convert, schema)


def xml_rows(files: DataFrame, entities: dict[str, str]) -> DataFrame:
    """(module, pos, kind, level, text, id, legacy) of XML manuals (module, xml): a row for each block of each manual, in order.

    Documents pass in batches and their blocks come out as rows, so no manual is one value. ``legacy`` is the id that the XML
    gives a heading. A manual that cannot be parsed has no rows, a null one neither.
    """
    known = {"nbsp": " "} | entities

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for module, xml in zip(batch["module"], batch["xml"], strict=True):
                root = docbook.parsed(xml, known) if xml else None
                if root is None:
                    continue
                walk = docbook.Walk(root)
                found = list(walk.rows())
                old = {new: name for name, new in walk.ids.items() if not name.startswith("toc")}
                rows += [(module, pos, kind, level, text, id_, old.get(id_) if kind == "heading" else None) for pos, (kind, level, text, id_) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["module", "pos", "kind", "level", "text", "id", "legacy"])

    return files.select("module", "xml").mapInPandas(blocks, "module string, pos int, kind string, level int, text string, id string, legacy string")


def xml_folders(files: DataFrame, entities: dict[str, str]) -> DataFrame:
    """As ``xml_modules``, of modules' folders with one row for each file (module, file, text). A folder is small: it is one
    map. Modules without a main text are left out."""
    known = {"nbsp": " "} | dict(entities)
    folders = files.groupBy("module").agg(F.map_from_entries(F.collect_list(F.struct("file", F.coalesce("text", F.lit("")).alias("text")))).alias("files"))

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for module, texts in zip(batch["module"], batch["files"], strict=True):
                main = docbook.combined(module, dict(texts), known)
                found = docbook.document(module, *main) if main else None
                if main:
                    rows.append((module, *(found.values() if found else [None] * 5)))
            yield pd.DataFrame(rows, columns=["module", "title", "description", "body", "ids", "samples"])

    schema = "module string, title string, description string, body string, ids map<string, string>, samples array<string>"
    return folders.mapInPandas(convert, schema)


# What a module's page ends with.
CONTRIBUTORS_MARK = "<!-- CONTRIBUTORS -->"
LICENSE_SECTION = "\n### License\n\nAll documentation files (i.e. .md extension) are licensed under the Creative Common License 4.0\n"


def module_readme(title: Column, description: Column, body: Column) -> Column:
    """The text of a module's page file, with a place for its contributors."""
    end = F.lit(f"\n{CONTRIBUTORS_MARK}\n{LICENSE_SECTION}")
    return F.concat(front_matter(title, description), F.lit("\n"), body, end)


def front_matter(title: Column, description: Column) -> Column:
    """The YAML head of a page; quotes and backslashes of values are escaped."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    about = F.when(F.length(description) > 0, F.concat(F.lit("description: "), quoted(description), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("---\ntitle: "), quoted(title), F.lit("\n"), about, F.lit("---\n"))


# Files that are spliced in as Markdown, and fence languages of others.
PAGE_FILES = ("md", "mdx", "markdown")
FENCE_LANGUAGES = {"cfg": "c", "sql": "sql", "sh": "bash", "bash": "bash", "json": "json", "yaml": "yaml", "yml": "yaml", "py": "python", "c": "c", "h": "c"}
INCLUDE = r'^\[[^\]]*\]\(([^)\s]+) "include"\)$'


def resolved_path(base: Column, link: Column) -> Column:
    """``link`` as seen from the folder of the file ``base``; ``.`` and ``..`` are followed."""
    folder = F.regexp_extract(base, r"^(.*/)?[^/]*$", 1)
    parts = F.split(F.when(link.startswith("/"), link).otherwise(F.concat(folder, link)), "/")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0)
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def include_lines(files: DataFrame) -> DataFrame:
    """(path, pos, line, target) of files (path, body): ``target`` is the file that the line includes, else null. An include
    is a paragraph by itself, outside fences. Files that are no pages are one fence."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in FENCE_LANGUAGES.items() for x in p]), ending), F.lit(""))
    fence = F.concat(F.lit("```"), language, F.lit("\n"), F.regexp_replace("body", r"\r?\n\z", ""), F.lit("\n```"))
    is_page = ending.isin(*PAGE_FILES)
    rows = files.select("path", F.when(is_page, F.regexp_replace("body", r"\n\z", "")).otherwise(fence).alias("body"))
    rows = fenced(lines_of(rows, "path", "body"), "path", F.col("line").rlike(r"^\s*```"))
    near = lambda f: F.trim(F.coalesce(f("line").over(in_order("path")), F.lit("")))
    alone = (near(F.lag) == "") & (near(F.lead) == "") & ~F.col("in_fence")
    link = F.regexp_extract("line", INCLUDE, 1)
    rows = rows.withColumn("alone", alone).withColumn("link", link)
    target = F.when(F.col("alone") & (F.col("link") != ""), resolved_path(F.col("path"), F.col("link")))
    return rows.select("path", "pos", "line", target.alias("target"))


def expanded_includes(files: DataFrame) -> DataFrame:
    """Files (path, body) with each include replaced by the file it names, and so on until none is left.

    ``state`` is ``ok``, ``missing`` (some include names no file) or ``cycle`` (some file includes itself, directly or not);
    such includes stay as they are. A level is one join of all open includes, written once; a chain holds no file twice, so levels end. A
    file may be included any number of times, side by side.
    """
    lines = checkpointed(include_lines(files))
    inner = lines.select(F.col("path").alias("__path"), F.col("pos").alias("__pos"), F.col("line").alias("__line"), F.col("target").alias("__target"))
    rows = lines.select(
        F.col("path").alias("root"), F.array("pos").alias("place"), F.array("path").alias("chain"), "line", "target", F.lit("ok").alias("state")
    )
    done, names = None, ["root", "place", "line", "state"]
    while True:
        closed = rows.filter(F.col("target").isNull()).select(*names)
        done = closed if done is None else done.unionByName(closed)
        open_ = rows.filter(F.col("target").isNotNull())
        if open_.isEmpty():
            break
        cycle = F.array_contains("chain", F.col("target"))
        done = done.unionByName(open_.filter(cycle).select("root", "place", "line", F.lit("cycle").alias("state")))
        joined = open_.filter(~cycle).join(inner, F.col("target") == F.col("__path"), "left")
        missing = F.col("__path").isNull()
        level = joined.select(
            "root",
            F.when(missing, F.col("place")).otherwise(F.concat("place", F.array("__pos"))).alias("place"),
            F.concat("chain", F.array("target")).alias("chain"),
            F.coalesce("__line", "line").alias("line"),
            F.col("__target").alias("target"),
            F.when(missing, "missing").otherwise("ok").alias("state"),
        )
        rows = checkpointed(level)
    ordered = F.array_sort(F.collect_list(F.struct("place", "line")))
    has = lambda state: F.max(F.col("state") == state)
    return done.groupBy(F.col("root").alias("path")).agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"),
        F.when(has("cycle"), "cycle").when(has("missing"), "missing").otherwise("ok").alias("state"),
    )
