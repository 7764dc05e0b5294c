"""Database descriptions (XML) to pages: columns, indexes, rendered tables, in Spark expressions.

``from_xml`` is permissive: malformed XML gives null fields, which are left out. Empty elements read as ``""`` and absent
ones as null, so presence is ``IS NOT NULL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.sources.readers import resolved_entities

_DESCRIPTION = "description: string"
SCHEMA = (
    "name string, description string, "
    "column array<struct<_id: string, name: string, type: string, size: string, "
    "default: struct<_VALUE: string, null: string>, null: string, primary: string, autoincrement: string, "
    + _DESCRIPTION
    + ">>, index array<struct<name: string, unique: string, primary: string, colref: array<struct<_linkend: string, _VALUE: string>>, "
    + _DESCRIPTION
    + ">>"
)
COLUMN_HEAD = ["name", "type", "size", "default", "null", "description", "key", "extra attributes"]
INDEX_HEAD = ["name", "type", "links", "description"]


# Inline elements of descriptions that are code (and ``type``, which columns have too); references that XML itself has.
CODE = "varname|function|literal|command|code|option|constant|classname|envar|parameter|computeroutput|filename|userinput"
XML_NAMES = ("lt", "gt", "amp", "quot", "apos")


def without_prolog(xml: Column) -> Column:
    """XML without declaration, DOCTYPE and comments."""
    return F.trim(F.regexp_replace(xml, r"(?s)<\?xml[^?]*\?>|<!--.*?-->|<!DOCTYPE[^\[>]*(\[[^\]]*\])?\s*>", ""))


def with_values(text: Column, values: Column) -> Column:
    """``text`` with the values of a map in place of references. XML's own references stay, others are escaped, so they read
    as they are written; so are those that a value has left, as values that refer to each other do."""
    names = F.regexp_extract_all(text, F.lit(r"&([\w.-]+);"), F.lit(1))
    known = lambda n: F.when(~n.isin(*XML_NAMES), F.try_element_at(values, n))
    put = F.transform(names, lambda n: F.coalesce(known(n), F.concat(F.lit("&"), n, F.lit(";"))))
    pieces = F.zip_with(F.split(text, r"&[\w.-]+;", -1), put, lambda piece, value: F.concat(piece, F.coalesce(value, F.lit(""))))
    return F.regexp_replace(F.array_join(pieces, ""), rf"&(?!(?:{'|'.join(XML_NAMES)});)([\w.-]+);", "&amp;$1;")


def substituted(texts: DataFrame, entities: DataFrame, scope: str, text: str) -> DataFrame:
    """``texts`` with the references in ``text`` replaced by the declarations (scope, name, value) of their scope, which may
    refer to each other. A scope's declarations are one file's, so they are one map, and the scopes are the versions: their
    maps go to all tasks, and texts stay where they are."""
    whole = resolved_entities(entities).groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("__values"))
    whole = whole.withColumnRenamed("scope", "__scope")
    values = F.coalesce("__values", F.create_map().cast("map<string,string>"))
    rows = texts.join(F.broadcast(whole), F.col(scope) == F.col("__scope"), "left")
    return rows.withColumn(text, with_values(F.col(text), values)).drop("__scope", "__values")


def inlined(xml: Column) -> Column:
    """Inline elements of descriptions as Markdown in the XML text; namespaces go."""
    put = [
        (r'\s+xmlns(:\w+)?="[^"]*"', ""),
        (r"(</?)\w+:", "$1"),
        (r"</?(?:sim)?para>", ""),
        (rf"</?(?:{CODE})>", "`"),
        (r"</?quote>", "&quot;"),
        (r"(</?)su(per|b)script>", "$1su$2>"),
        (r"<(/?)su(per|b)>", "&lt;$1su$2&gt;"),
        ("&lt;(/?)super&gt;", "&lt;$1sup&gt;"),
        (r'(?s)<emphasis[^>]*\brole="[^"]*[Bb]old[^"]*"[^>]*>\s*(.*?)\s*</emphasis>', "**$1**"),
        (r"(?s)<emphasis[^>]*>\s*(.*?)\s*</emphasis>", "*$1*"),
        (r'<ulink([^>]*)\burl="([^"/#][^"/]*)"', '<ulink$1url="../$2"'),
        (r'(?s)<ulink[^>]*\burl="([^"]*)"[^>]*?(?:/>|>\s*</ulink>)', "[$1]($1)"),
        (r'(?s)<ulink[^>]*\burl="([^"]*)"[^>]*>\s*(.*?)\s*</ulink>', "[$2]($1)"),
    ]
    for pattern, new in put:
        xml = F.regexp_replace(xml, pattern, new)
    return F.trim(xml)


def parsed_tables(files: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Columns of ``files`` (slug, xml) and ``t``, the table; files that are no table are left out. References are replaced
    by the declarations (scope, name, value) of a file's slug before the text is parsed."""
    rows = files.withColumn("xml", without_prolog(F.col("xml")))
    if entities is not None:
        rows = substituted(rows, entities, "slug", "xml")
    else:
        rows = rows.withColumn("xml", with_values(F.col("xml"), F.create_map().cast("map<string,string>")))
    options = {"rowTag": "table", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    # A row for the one table of a text: a filter on a parsed column would parse the text again for each part that it reads.
    table = F.explode(F.array(F.from_xml(inlined(F.col("xml")), f"{SCHEMA}, broken string", options)))
    rows = rows.select(*[c for c in rows.columns if c != "xml"], table.alias("t"))
    return rows.filter(F.col("t.name").isNotNull() & F.col("t.broken").isNull())


def described(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "</?type>", "`"), r"\s+", " "))


def one_line(c: Column) -> Column:
    return F.replace(described(c), F.lit("|"), F.lit("\\|"))


def shown_default(d: Column) -> Column:
    """``default`` if there is none, NULL, a bare number, or a quoted string."""
    value = F.trim(F.coalesce(d["_VALUE"], F.lit("")))
    number = value.try_cast("double")
    return (
        F.when(d.isNull(), "default").when(d["null"].isNotNull(), "NULL").when(number.isNotNull(), value).otherwise(F.concat(F.lit("'"), value, F.lit("'")))
    )


def _row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _head(names: list[str]) -> Column:
    return F.lit("| " + " | ".join(names) + " |\n| " + " | ".join(["---"] * len(names)) + " |")


def column_lines(t: Column) -> Column:
    code = lambda c: F.concat(F.lit("`"), F.coalesce(F.trim(c), F.lit("")), F.lit("`"))
    there = lambda c, word, no="": F.when(c.isNotNull(), word).otherwise(no)
    size = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("not specified"))
    return F.transform(
        t["column"],
        lambda c: _row(
            [
                code(c["name"]),
                code(c["type"]),
                size(c["size"]),
                shown_default(c["default"]),
                there(c["null"], "yes", "no"),
                one_line(c["description"]),
                there(c["primary"], "primary"),
                there(c["autoincrement"], "autoincrement"),
            ]
        ),
    )


def index_lines(t: Column) -> Column:
    """One line per index; its columns by id, an unknown id as it is; unique before primary before default."""
    names = F.map_from_entries(F.transform(F.filter(t["column"], lambda c: c["_id"].isNotNull()), lambda c: F.struct(c["_id"], c["name"])))
    linked = lambda r: F.coalesce(F.try_element_at(names, r["_linkend"]), r["_linkend"], F.lit(""))
    kind = lambda i: F.when(i["unique"].isNotNull(), "unique").when(i["primary"].isNotNull(), "primary").otherwise("default")
    return F.transform(
        t["index"],
        lambda i: _row(
            [F.concat(F.lit("`"), i["name"], F.lit("`")), kind(i), F.array_join(F.transform(i["colref"], linked), ", "), one_line(i["description"])]
        ),
    )


def rendered(t: Column) -> Column:
    """A table's section: heading, description, columns, indexes."""
    about = described(t["description"])
    indexes = F.when(
        F.size(F.coalesce(t["index"], F.array())) > 0,
        F.concat(F.lit("\n\n**Indexes**\n\n"), _head(INDEX_HEAD), F.lit("\n"), F.array_join(index_lines(t), "\n")),
    ).otherwise("")
    return F.concat(
        F.lit('### Table "'), t["name"], F.lit('"\n\n'), F.when(about != "", F.concat(about, F.lit("\n\n"))).otherwise(""),
        _head(COLUMN_HEAD), F.lit("\n"), F.array_join(column_lines(t), "\n"), indexes, F.lit("\n"),
    )


def includes_of(modules: DataFrame) -> DataFrame:
    """(slug, module_file, db_name, ord, table_file): the tables that a module file includes, in order."""
    name = F.trim(F.regexp_extract("xml", r"(?s)<name>(.*?)</name>", 1))
    refs = F.regexp_extract_all("xml", F.lit(r'<xi:include\s+href="([^"]+)"'), F.lit(1))
    return modules.select("slug", "module_file", name.alias("db_name"), F.posexplode(refs).alias("ord", "table_file"))


def schema_pages(modules: DataFrame, tables: DataFrame, entities: DataFrame | None = None, hosts: str = "") -> DataFrame:
    """(slug, body, n_tables, n_missing): a page per version; modules in name order, tables in include order; includes of a
    missing or unreadable table are counted and left out. ``entities`` has each version's declarations. Addresses of module
    pages on the old site, whose hosts the pattern ``hosts`` matches, become links to the version's own module pages."""
    parts = parsed_tables(tables, entities).select("slug", "table_file", rendered(F.col("t")).alias("part"))
    # Spark takes a text for 20 bytes, and would send all of them through the driver to all tasks.
    parts = parts.hint("merge")
    rows = includes_of(modules).join(parts, ["slug", "table_file"], "left")
    per_module = rows.groupBy("slug", "module_file", "db_name").agg(
        F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("ord", "part")))).alias("parts"),
        F.count_if(F.col("part").isNull()).alias("missing"),
    )
    section = F.concat(F.lit("## "), "db_name", F.lit("\n\n"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n"))
    if hosts:  # no address has a line's end in it, so sections are searched and not the whole body
        section = F.regexp_replace(section, F.lit(rf"https?://(?:{hosts})/docs/modules/[\w.+-]+/([\w-]+)\.html"), F.concat(F.lit("[$1](/docs/modules/"), "slug", F.lit("/$1)")))
    per_module = per_module.select("slug", "module_file", section.alias("section"), F.size("parts").alias("n"), "missing")
    ordered = F.array_sort(F.collect_list(F.struct("module_file", "section")))
    return per_module.groupBy("slug").agg(
        F.array_join(ordered["section"], "\n").alias("body"),
        F.sum("n").alias("n_tables"),
        F.sum("missing").alias("n_missing"),
    )
