"""Headings, samples and logo candidates of pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions.html import candidate_score
from loomdoc.functions.names import absolute_url, heading_key
from loomdoc.operators.index import unambiguous


def inferred_anchors(headings: DataFrame, links: DataFrame) -> DataFrame:
    """Headings (page, pos, text, id) with ids that same-page links (page, label, id) give them: equal text once marks are
    dropped, one id only for the label in its page; an id that a heading has stays."""
    keyed = links.select("page", heading_key(F.col("label")).alias("__key"), F.col("id").alias("__id"))
    found = unambiguous(keyed, ["page", "__key"], "__id")
    joined = headings.withColumn("__key", heading_key(F.col("text"))).join(found, ["page", "__key"], "left")
    return joined.withColumn("id", F.coalesce("id", "__id")).select(*headings.columns)


def samples_page(samples: DataFrame) -> DataFrame:
    """(module, body): one page per module that includes its samples (module, ord, title, file), each under its title."""
    part = F.concat(F.lit("## "), F.coalesce("title", "file"), F.lit("\n\n["), "file", F.lit("](./samples/"), "file", F.lit(' "include")\n'))
    ordered = F.array_sort(F.collect_list(F.struct("ord", part.alias("part"))))
    return samples.groupBy("module").agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "\n").alias("body"))


#: Sources of logo candidates in their order; candidates of equal score keep it.
SOURCES = ("apple-touch-icon", "icon", "og:image", "twitter:image", "img-src")
CANDIDATE = T.StructType().add("source", T.StringType()).add("address", T.StringType()).add("sizes", T.StringType())


class Elements(HTMLParser):
    """(tag, attributes) of a page's pictures, links and metadata: any quotes, any order, references decoded."""

    def __init__(self, html: str):
        super().__init__()
        self.found: list[tuple[str, dict[str, str]]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("img", "link", "meta"):
            self.found.append((tag, {name: value or "" for name, value in reversed(attrs)}))  # the first of a name counts


def candidate_of(tag: str, attrs: dict[str, str]) -> tuple[str, str] | None:
    """(source, address) of an element that may show a logo."""
    if tag == "link":
        rel = attrs.get("rel", "")
        source = "apple-touch-icon" if "apple-touch-icon" in rel else "icon" if rel in ("icon", "shortcut icon") else None
        return source and (source, attrs.get("href", ""))
    if tag == "meta":
        source = "og:image" if attrs.get("property") == "og:image" else "twitter:image" if attrs.get("name") == "twitter:image" else None
        return source and (source, attrs.get("content", ""))
    told = (attrs.get(a, "").lower() for a in ("alt", "class", "id", "src"))
    return ("img-src", attrs["src"]) if attrs.get("src") and any("logo" in t for t in told) else None


@F.pandas_udf(T.ArrayType(CANDIDATE))
def logo_elements(html: pd.Series, base: pd.Series) -> pd.Series:
    """The candidates of pages in order of source and place, with absolute addresses on the page ``base``; those that have
    none, or one that is no web address, are left out."""

    def one(text: str | None, page: str | None) -> list[tuple[str, str, str]]:
        found = []
        for tag, attrs in Elements(text or "").found:
            made = candidate_of(tag, attrs)
            url = made and absolute_url(page, made[1])
            if url:
                found.append((made[0], url, attrs.get("sizes", "")))
        return sorted(found, key=lambda c: SOURCES.index(c[0]))

    return pd.Series([one(*row) for row in zip(html, base, strict=True)], dtype=object)


def logo_candidates(html: Column, base: Column) -> Column:
    """(address, source, score) structs of a page's candidates."""
    of = lambda c: F.struct(c["address"].alias("address"), c["source"].alias("source"), candidate_score(c["address"], c["sizes"], c["source"]).alias("score"))
    return F.transform(logo_elements(html, base), of)


def best_candidates(pages: DataFrame, key: str, most: int = 3) -> DataFrame:
    """The candidates of each page (key, url, html) with the highest scores, best first; of equal ones the first."""
    rows = pages.select(key, logo_candidates(F.col("html"), F.col("url")).alias("found"))
    ranked = F.array_sort(F.transform("found", lambda c, i: F.struct((-c["score"]).alias("k"), i.alias("i"), c["address"].alias("address"), c["source"].alias("source"))))
    rows = rows.select(key, F.posexplode(F.slice(ranked, 1, most)).alias("pos", "c"))
    return rows.select(key, (F.col("pos") + 1).alias("rn"), "c.address", "c.source", (-F.col("c.k")).alias("score"))


def first_success(results: DataFrame, key: str) -> DataFrame:
    """Of a page's tries (key, rn, address, error) the first without an error."""
    return results.filter(F.col("error").isNull()).groupBy(key).agg(F.min_by("address", "rn").alias("address"))
