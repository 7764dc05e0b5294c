"""Typed page heads: read from page texts, checked against the site's schema, unknown fields kept."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions.head import HeadError, read_head, split_page

#: The fields that the site knows, by name; all others stay in the variant.
HEAD = (
    "title string, description string, subtitle string, subtitleHref string, author string, sidebar struct<hidden boolean>, "
    "head array<struct<tag string, content string, attrs map<string, string>>>"
)
TEXTS = ("description", "subtitle", "subtitleHref", "author")
PARTS = T.StructType().add("json", T.StringType()).add("error", T.StringType()).add("body", T.StringType())


@F.pandas_udf(PARTS)
def head_parts(texts: pd.Series) -> pd.DataFrame:
    """The head of a page as JSON (``{}`` without one), why it cannot be read, and the page's body; all null of a null text."""

    def one(text: str | None) -> tuple[str | None, str | None, str | None]:
        if text is None:
            return None, None, None
        head, body = split_page(text)
        try:
            return json.dumps(read_head(head or ""), ensure_ascii=False), None, body
        except HeadError as e:
            return None, str(e), body

    return pd.DataFrame([one(t) for t in texts], columns=["json", "error", "body"])


def type_at(head: Column, path: str) -> Column:
    """The type of what a head has at a path: STRING, BOOLEAN, VOID for an empty value, ...; null if there is nothing."""
    return F.schema_of_variant(F.try_variant_get(head, path, "variant"))


def faults_of(whole: Column, typed: Column, error: Column) -> Column:
    """Names of the fields that break the schema: a title with text is required; texts are texts, the menu's flag is a boolean,
    and elements for the page's head have a tag. A head that cannot be read is one fault, with its line."""
    no_text = lambda name: type_at(whole, f"$.{name}") != "STRING"
    title = F.coalesce(type_at(whole, "$.title"), F.lit("")) != "STRING"
    sidebar, hidden, elements = type_at(whole, "$.sidebar"), type_at(whole, "$.sidebar.hidden"), type_at(whole, "$.head")
    no_tag = F.exists(F.coalesce(typed["head"], F.array().cast("array<struct<tag string, content string, attrs map<string, string>>>")), lambda h: h["tag"].isNull())
    found = F.array(
        F.when(title | (F.trim(F.coalesce(typed["title"], F.lit(""))) == ""), "title"),
        *[F.when(no_text(name), name) for name in TEXTS],
        F.when(~F.startswith(sidebar, F.lit("OBJECT")) | (hidden != "BOOLEAN"), "sidebar"),
        F.when(~F.startswith(elements, F.lit("ARRAY")) | no_tag, "head"),
    )
    return F.when(error.isNotNull(), F.array(F.concat(F.lit("unreadable, "), error))).otherwise(F.filter(found, lambda f: f.isNotNull()))


def with_heads(pages: DataFrame, text: str) -> DataFrame:
    """``pages`` with ``head`` (the fields that the site knows, typed), ``whole`` (all fields, a variant), ``faults`` and, in
    place of ``text``, the page without its head. Types that do not fit are null in ``head`` and faults."""
    rows = pages.withColumn("__parts", head_parts(F.col(text)))
    rows = rows.withColumn("whole", F.parse_json("__parts.json")).withColumn("head", F.from_json("__parts.json", HEAD))
    rows = rows.withColumn("faults", F.when(F.col("__parts").isNotNull() & F.col(text).isNotNull(), faults_of(F.col("whole"), F.col("head"), F.col("__parts.error"))))
    return rows.withColumn(text, F.col("__parts.body")).drop("__parts")


def visible(pages: DataFrame) -> DataFrame:
    """Rows of :func:`with_heads` that menus show."""
    return pages.filter(~F.coalesce(F.col("head.sidebar.hidden"), F.lit(False)))
