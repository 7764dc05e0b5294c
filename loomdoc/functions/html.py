"""HTML and URL functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities in the order in which they are decoded; ``&amp;`` comes first, so ``&amp;lt;`` ends as ``<``.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]
# Points of logo candidates by the end of the address, by words in it, and by where it was found; the file types
# that an address can have.
TYPE_POINTS = {".svg": 50, ".png": 20}
GOOD_WORDS, GOOD_POINTS = ["logo", "brand", "mark", "symbol", "identity"], 15
BAD_WORDS, BAD_POINTS = ["favicon", "icon-", "sprite", "badge", "thumb", "avatar", "placeholder"], -30
SOURCE_POINTS = {"apple-touch-icon": 10, "og:image": 5, "img-src": 15}
FILE_TYPES = (".svg", ".png", ".jpg", ".jpeg", ".webp")


def decode_entities(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_tags(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags become a space; entities are decoded; white space is one space."""
    out = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    out = decode_entities(F.regexp_replace(out, "<[^>]*>", " "))
    return F.trim(F.regexp_replace(out, "[ \\t\\r\\n]+", " "))


def page_title(html: Column) -> Column:
    return F.nullif(decode_entities(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)), F.lit(""))


def links(html: Column) -> Column:
    """(href, label) structs of the page's links, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<a href=\"[^\"]*\"[^>]*>.*?</a>"), F.lit(0))
    return F.transform(
        found,
        lambda a: F.struct(F.regexp_extract(a, r'href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_replace(a, "<[^>]*>", "")).alias("label")),
    )


def teaser(text: Column, most: int = 200) -> Column:
    """The first characters and an ellipsis, always."""
    return F.concat(F.left(text, F.lit(most)), F.lit("…"))


def route(url: Column) -> Column:
    """Path of a URL without query, fragment, ``.html`` and slash at the end."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r"(\.html)?/?$", "")


def extension(url: Column, content_type: Column | None = None) -> Column:
    """The picture type in a URL's path, else that of the content type, else ``.png``."""
    path = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    found = F.lower(F.regexp_extract(path, r"[^/](\.[A-Za-z0-9]+)$", 1))
    told = F.coalesce(content_type, F.lit("")) if content_type is not None else F.lit("")
    by_content = F.lit(".png")
    for sign in ("jpg", "jpeg", "webp", "png", "svg"):
        by_content = F.when(told.contains(sign), "." + sign.replace("jpeg", "jpg")).otherwise(by_content)
    return F.when(found.isin(*FILE_TYPES), found).otherwise(by_content)


def candidate_score(address: Column, sizes: Column, source: Column) -> Column:
    """Points of a logo candidate: how its address ends, good and bad words in it, where it was found; for an icon at most 20
    more by its declared size (``32x32``)."""
    low = F.lower(address)
    score = F.lit(0.0)
    for end, points in TYPE_POINTS.items():
        score = score + F.when(F.endswith(low, F.lit(end)), points).otherwise(0)
    for words, points in ((GOOD_WORDS, GOOD_POINTS), (BAD_WORDS, BAD_POINTS)):
        for word in words:
            score = score + F.when(low.contains(word), points).otherwise(0)
    for name, points in SOURCE_POINTS.items():
        score = score + F.when(source == name, points).otherwise(0)
    side = F.regexp_extract(F.coalesce(sizes, F.lit("")), r"(\d+)x\d+", 1).try_cast("double")
    return score + F.when(source == "icon", F.least(F.coalesce(side, F.lit(0.0)) / 10.0, F.lit(20.0))).otherwise(0)


def url_class(url: Column) -> Column:
    """What a legacy documentation URL points to: a module, a manual page, or something else."""
    return (
        F.when(url.rlike(r"/html/docs/modules/[^/]+/[^/]+\.html"), "module")
        .when(url.rlike(r"/Documentation/[A-Za-z-]+"), "manual")
        .otherwise("other")
    )
