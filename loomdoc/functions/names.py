"""Names of files, pages and links, as Spark expressions."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions.docbook import LABELLED_KINDS

# Letters with marks and what they become.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝșțăȘȚĂ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYstaSTA"


# Forms of the old site's addresses behind the host, a document's and a module's page, with their places.
OLD_DOCUMENT = r"Documentation/([^#?\s]+)(#\S*)?$"
OLD_MODULE = r"docs/modules/([^/]+)/([\w.-]+?)(?:\.html)?(#\S*)?$"


def old_address(hosts: str, form: str) -> str:
    """A pattern of addresses of a form on hosts that match the pattern ``hosts``; without hosts it matches nothing."""
    return rf"(?i)^https?://(?:{hosts or '$.'})/(?:html/)?{form}"


def transliterated(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def cms_slug(title: Column) -> Column:
    """ASCII letters and digits in lower case; accents go; other runs become one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(transliterated(title)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def converted_name(stored: Column) -> Column:
    """The page file of a stored ``Group.Name`` page: the part behind the first dot, in lower case."""
    return F.lower(F.regexp_extract(stored, r"^[^.]*\.(.*)$", 1))


def category(stored: Column) -> Column:
    return F.lower(F.substring_index(stored, ".", 1))


def manual_ref(segment: Column) -> Column:
    """struct(page, slug) of ``Page-Name-3-6`` (version suffix), null without one; ``devel`` is 4-1."""
    page = F.lower(F.regexp_extract(segment, r"^(.+)-([0-9]+-[0-9]+)$", 1))
    slug = F.regexp_extract(segment, r"^(.+)-([0-9]+-[0-9]+)$", 2)
    return F.when(page != "", F.struct(page.alias("page"), F.when(slug == "4-1", "devel").otherwise(slug).alias("slug")))


def module_version_slug(directory: Column) -> Column:
    """``3.4.x`` is ``3-4``; ``devel`` stays."""
    return F.when(directory == "devel", directory).otherwise(F.replace(F.regexp_replace(directory, r"\.x$", ""), F.lit("."), F.lit("-")))


def legacy_route(url: Column) -> Column:
    """The site route of a legacy module or manual URL, null for any other."""
    module = r"/html/docs/modules/([^/]+)/([\w-]+)(?:\.html)?(#.*)?$"
    part = lambda i: F.regexp_extract(url, module, i)
    of_module = F.concat(F.lit("/docs/modules/"), module_version_slug(part(1)), F.lit("/"), part(2), part(3))
    manual = manual_ref(F.regexp_extract(url, r"/Documentation/([\w-]+)", 1))
    of_manual = F.concat(F.lit("/docs/manual/"), manual["slug"], F.lit("/"), manual["page"], F.regexp_extract(url, r"(#.*)$", 1))
    return F.when(url.rlike(module), of_module).when(url.contains("/Documentation/"), of_manual)


def module_links(body: Column) -> Column:
    """Bare legacy module URLs in a text as Markdown links named after the module."""
    return F.regexp_replace(body, r"(?<!\()https?://\S+/html/docs/modules/[^/\s]+/([\w-]+)\.html", "[$1](../modules/$1)")


def heading_key(text: Column) -> Column:
    """What two headings are compared by: markup and marks dropped, one space, lower case."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[`*_]|<[^>]*>|\{#[^}]*\}", "")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))


def label_of(linkend: Column) -> Column:
    """What a link says that has no text (as ``docbook.label_of``)."""
    name = F.regexp_extract(linkend, rf"^(?:{'|'.join(sorted(LABELLED_KINDS))})_(.+)$", 1)
    return F.when(name != "", F.translate(name, "_", " ")).otherwise(F.translate(linkend, "_-", "  "))


def without_title_heading(body: Column, title: Column) -> Column:
    """A body without its first heading, if that says what the title says."""
    first = F.regexp_extract(body, r"\A\s*#{1,6} ([^\n]*)\n?", 1)
    return F.when(heading_key(first) == heading_key(title), F.regexp_replace(body, r"\A\s*#{1,6} [^\n]*\n*", "")).otherwise(body)


def absolute_url(base: str | None, link: str | None) -> str | None:
    try:
        out = urljoin(base or "", link) if link else ""
        return out if urlsplit(out).scheme in ("http", "https") and urlsplit(out).netloc else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def resolved_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """``link`` as an absolute URL on the page ``base``; null if there is none or it is not http."""
    return pd.Series([absolute_url(b, x) for b, x in zip(base, link, strict=True)], dtype=object)
