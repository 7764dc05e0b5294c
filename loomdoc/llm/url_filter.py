"""URL filter: host and path rules first, then a weighted vocabulary matched by Aho-Corasick.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no rule, and is judged on its
vocabulary hits alone (a null URL has none and is allowed). Repeated rows are judged one by one; an empty table gives
an empty result; other columns of the input are not carried, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.tables import load

QUERY = "op1_url_filter"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the contract, (host with path, verdict).
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]

#: One of these rejects a URL.
STRICT_TERMS = [
    "bdsm", "camgirl", "camgirls", "casino", "casinos", "cheap-pills", "cialis", "escort", "escorts", "fake-id", "hentai", "keygen", "milf", "nsfw",
    "online-casino", "payday-loan", "payday-loans", "phentermine", "porn", "porno", "pornhub", "sexcam", "sexcams", "slot-machine", "spam-farm",
    "sportsbook", "upskirt", "viagra", "warez", "xanax", "xvideos", "xxx",
]
#: Terms that reject only together, with their weights.
SOFT_TERMS = {
    "adult": 1.0,
    "bet": 1.0,
    "bets": 1.0,
    "betting": 1.5,
    "blackjack": 1.5,
    "bonus": 1.0,
    "cheap": 1.0,
    "coupon": 1.0,
    "crack": 1.0,
    "cracked": 1.5,
    "dating": 1.0,
    "deals": 1.0,
    "discount": 1.0,
    "erotic": 1.5,
    "farm": 1.0,
    "free": 1.0,
    "gamble": 1.5,
    "gambling": 1.5,
    "hookup": 1.5,
    "hot": 1.0,
    "jackpot": 1.5,
    "loan": 1.0,
    "loans": 1.0,
    "mature": 1.0,
    "naked": 1.5,
    "nude": 1.5,
    "nudes": 1.5,
    "pharmacy": 1.0,
    "pills": 1.5,
    "poker": 1.5,
    "replica": 1.5,
    "roulette": 1.5,
    "serial": 1.0,
    "sex": 1.5,
    "sexy": 1.5,
    "slots": 1.5,
    "spam": 1.5,
    "teen": 1.0,
    "torrent": 1.5,
    "webcam": 1.0,
    "win": 1.0,
}
#: Sum of the weights of distinct soft terms from which a URL is rejected; no single weight reaches it.
SOFT_LIMIT = 2.0


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    after = F.expr("substr(url, locate('://', url) + 3)")
    return F.when(url.contains("://"), ascii_lower(F.regexp_extract(after, r"^([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    after = F.expr("substr(url, locate('://', url) + 3)")
    return F.when(url.contains("://"), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule whose host and path fit, else null. Rules are a fixed, short list."""
    found = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        row = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, row) if found is None else found.when(fits, row)
    return found


class Vocabulary:
    """Strict and soft terms in one automaton; a hit needs a boundary (no ASCII letter or digit) on both sides."""

    def __init__(self, strict: list[str], soft: dict[str, float]):
        self.soft = dict(soft)
        self.automaton = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.automaton.add_word(term, (term, term in strict))
        self.automaton.make_automaton()

    def hits(self, url: str | None) -> tuple[int, int, float]:
        """Distinct strict terms, distinct soft terms, and the weight of the soft ones; percent codes count as what they
        stand for."""
        if not url:
            return 0, 0, 0.0
        text = (unquote(url) if "%" in url else url).translate(_FOLD)
        strict, soft = set(), set()
        for end, (term, is_strict) in self.automaton.iter(text):
            start = end + 1 - len(term)
            if not (start and text[start - 1] in _WORD or end + 1 < len(text) and text[end + 1] in _WORD):
                (strict if is_strict else soft).add(term)
        return len(strict), len(soft), sum(self.soft[t] for t in soft)


_FOLD = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}
_WORD = frozenset(LOWER + "0123456789")


def judge_urls(
    df: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    rules: list[tuple[str, str]] = RULES,
    strict: list[str] = STRICT_TERMS,
    soft: dict[str, float] = SOFT_TERMS,
    soft_limit: float = SOFT_LIMIT,
) -> DataFrame:
    """A row per URL: id, host, path, rule, verdict, and the vocabulary hits behind it.

    Map-only: one scan of two columns, no shuffle.
    """
    if any(w >= soft_limit for w in soft.values()):
        raise ValueError("a single soft term may not reject")
    terms, weights = list(strict), dict(soft)

    @F.pandas_udf("n_strict bigint, n_soft bigint, soft_weight double")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(terms, weights)
        for urls in batches:
            yield pd.DataFrame([vocabulary.hits(u) for u in urls], columns=["n_strict", "n_soft", "soft_weight"])

    url = F.col("url")
    rows = df.select(F.col(id_column).alias(id_column), F.col(url_column).alias("url"))
    rows = rows.select(id_column, host_of(url).alias("host"), path_of(url).alias("path"), scan(url).alias("hits"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when((F.col("hits.n_strict") > 0) | (F.col("hits.soft_weight") >= soft_limit), "block").otherwise("allow")
    return rows.select(
        id_column,
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), by_method).alias("verdict"),
        F.col("hits.n_strict").alias("n_strict"),
        F.col("hits.n_soft").alias("n_soft"),
        F.col("hits.soft_weight").alias("soft_weight"),
    )


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"))


def _sql() -> str:
    url = f"translate(url_decode(coalesce(url, '')), '{UPPER}', '{LOWER}')"

    def hit(t: str) -> str:
        return f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN 1 ELSE 0 END"

    n_strict = " + ".join(hit(t) for t in STRICT_TERMS)
    n_soft = " + ".join(hit(t) for t in SOFT_TERMS)
    weight = " + ".join(f"{w} * {hit(t)}" for t, w in SOFT_TERMS.items())
    ordered = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))

    def fits(rule: str) -> str:
        at, _, rest = rule.partition("/")
        return f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{rest}')"

    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for r, v in ordered)
    return f"""
WITH parts AS (
  SELECT page_id, {url} AS u,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
hits AS (
  SELECT *, CAST({n_strict} AS BIGINT) AS n_strict, CAST({n_soft} AS BIGINT) AS n_soft,
    CAST({weight} AS DOUBLE) AS soft_weight
  FROM parts)
SELECT page_id, host, path, {rule} AS rule,
  {verdict} WHEN n_strict > 0 OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
  n_strict, n_soft, soft_weight
FROM hits
"""


SQL = _sql()
