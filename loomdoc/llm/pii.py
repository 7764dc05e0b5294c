"""Format-preserving pseudonyms for personal data, in Spark expressions.

One pattern finds candidates; each is validated (Luhn, mod 97, number ranges, calendar) and replaced by a keyed Feistel
permutation within its format, so equal values have equal pseudonyms in all documents and other values others:

- card numbers: all digits but the last are permuted; the last is the Luhn digit again; groups stay.
- IBANs: country, letters and groups stay, digits are permuted, the check digits are computed again.
- social security numbers (ddd-dd-dddd in range): permuted among the numbers in range.
- phone numbers (+ and a country code, 7 to 15 digits): digits after the code are permuted, marks stay, and a number is the
  same with any marks.
- IPv4 addresses: the 32 bits are permuted.
- dates (yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy): the day is permuted within 1920-01-01 to 2060-03-07, or within its own year
  if it is outside.
- mail addresses: letters and digits of the local part are permuted within their kinds, the domain stays, and so does the
  case of letters, which makes no other address. A local part with other than ASCII characters becomes a keyed token of 16 hex digits.

Candidates that fail validation stay. The text is put together from the pieces between the matches, so nothing else
changes. Permutations of few characters can keep a value as it is; a pseudonym is a permutation, not a deletion.

Edge cases: a null text stays null and has no entities; empty texts stay empty; texts of any length are searched whole;
rows are treated one by one, so repeats and ties do not matter; an empty table gives an empty result; all columns of the
input are kept by ``pseudonymise``, whose own column gets underscores behind its name until no column has that.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.tables import load

QUERY = "op2_pii"
SQL = None

#: For tests and these queries. A deployment sets a secret of its own as ``KEY_SETTING``: who has the key can undo pseudonyms.
KEY, KEY_SETTING = "loomdoc test key", "spark.loomdoc.pii.key"
ROUNDS = 6

_LEFT, _RIGHT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
MAIL = r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}"
DATE = rf"{_LEFT}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}){_RIGHT}"
IP = rf"(?<![0-9A-Za-z.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?![0-9A-Za-z]|\.[0-9])"
SSN = rf"{_LEFT}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_RIGHT}"
CARD = (
    rf"{_LEFT}(?:[0-9]{{4}}([ -])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{1,7}}|[0-9]{{4}}([ -])[0-9]{{6}}\2[0-9]{{5}}|[0-9]{{13,19}}){_RIGHT}"
)
#: Other formats, which a phone number does not run into behind a space. A card with another group behind it may start with
#: the phone number's last group.
OTHERS = "|".join((CARD.replace(r"\1", r"\k<a>").replace(r"\2", r"\k<b>").replace("([ -])", "(?<a>[ -])", 1).replace("([ -])", "(?<b>[ -])", 1) + "(?![ -][0-9])", DATE, IP, SSN, MAIL))
#: 7 to 15 digits, counted from the plus sign; Java looks behind for written-out repeats only.
COUNTED = "(?<=" + "|".join(r"\+[0-9]" + "[^0-9+]{0,2}[0-9]" * n for n in range(6, 15)) + ")"
_AREA = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\)|[ .-][0-9](?=[ .-][0-9]))?"
#: The second form is for numbers that would be too short without what looks like another format.
PHONE = rf"{_AREA}(?:(?! (?:{OTHERS}))[ .-]?[0-9]{{2,12}}){{1,5}}{COUNTED}{_RIGHT}|{_AREA}(?:[ .-]?[0-9]{{2,12}}){{1,5}}{COUNTED}{_RIGHT}"
# Lengths of the countries' IBANs, as the registry has them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account(n: int) -> str:
    return rf"(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")


_OF_COUNTRY = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}{_account(n - 4)}" for n, c in IBAN_LENGTHS.items())
#: By the country's length, or else as long as it goes.
IBAN = rf"{_LEFT}(?=[A-Z]{{2}}[0-9]{{2}})(?:{_OF_COUNTRY}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?){_RIGHT}"
KINDS = {"card": CARD, "date": DATE, "ip": IP, "ssn": SSN, "phone": PHONE, "iban": IBAN, "mail": MAIL}
#: Order matters where two could start at one place.
PATTERN = "|".join(f"(?:{p})" for p in (CARD, DATE, IP, SSN, PHONE, IBAN, MAIL))

#: Days of the window of dates, as a product of two numbers for the halves of the permutation.
WINDOW_START, WINDOW_SIZES = "1920-01-01", (200, 256)


def keyed(key: str, tweak: str, i: int, c: Column) -> Column:
    """Hex digits that depend on the key, what is permuted, the round and ``c``."""
    return F.sha2(F.concat(F.lit(f"{key}|{tweak}|{i}|"), c), 256)


def keyed_number(key: str, tweak: str, i: int, c: Column) -> Column:
    return F.conv(F.substring(keyed(key, tweak, i, c.cast("string")), 1, 12), 16, 10).cast("long")


def permuted_pair(key: str, tweak: str, number: Column, sizes: tuple[int, int]) -> Column:
    """A Feistel permutation of 0 .. sizes[0] * sizes[1] - 1: halves are moved in turn by a keyed number of the other."""
    start = F.struct(F.floor(number / sizes[1]).cast("long").alias("a"), (number % sizes[1]).cast("long").alias("b"))

    # Rounds are nested lets (a transform over one element), so an expression is never doubled.
    def turn(pair: Column, i: int) -> Column:
        a, b = pair["a"], pair["b"]
        if i % 2 == 0:
            a = (a + keyed_number(key, tweak, i, b)) % sizes[0]
        else:
            b = (b + keyed_number(key, tweak, i, a)) % sizes[1]
        return F.struct(a.alias("a"), b.alias("b"))

    done = let(start, lambda p: _rounds(p, turn))
    return let(done, lambda p: p["a"] * sizes[1] + p["b"])


def let(c: Column, body) -> Column:
    """``body`` of the value of ``c``, which is computed once."""
    return F.element_at(F.transform(F.array(c), body), 1)


def _rounds(state: Column, turn, i: int = 0) -> Column:
    if i == ROUNDS:
        return state
    return let(turn(state, i), lambda s: _rounds(s, turn, i + 1))


def permuted_characters(key: str, tweak: str, text: Column) -> Column:
    """A Feistel permutation of strings: digits, small and capital letters move within their kind by keyed numbers that the
    other half gives; other characters stay. For strings of up to 128 characters."""

    def moved(half: Column, other: Column, i: int) -> Column:
        def one(c: Column, k: Column, hex_: Column) -> Column:
            by = F.conv(F.substring(hex_, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)
            put = lambda first, n: F.char((code - first + by) % n + first)
            return (
                F.when(code.between(48, 57), put(48, 10)).when(code.between(97, 122), put(97, 26)).when(code.between(65, 90), put(65, 26)).otherwise(c)
            )

        hex_ = F.concat(keyed(key, tweak, 2 * i, other), keyed(key, tweak, 2 * i + 1, other))
        return F.array_join(let(hex_, lambda h: F.transform(F.split(half, ""), lambda c, k: one(c, k, h))), "")

    def turn(pair: Column, i: int) -> Column:
        a, b = pair["a"], pair["b"]
        if i % 2 == 0:
            a = moved(a, b, i)
        else:
            b = moved(b, a, i)
        return F.struct(a.alias("a"), b.alias("b"))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    done = let(start, lambda p: _rounds(p, turn))
    return let(done, lambda p: F.concat(p["a"], p["b"]))


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def with_digits(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    nth = lambda k: F.length(digits_of(F.substring(shape, F.lit(1), k + 1)))
    return F.array_join(F.transform(F.split(shape, ""), lambda c, k: F.when(c.rlike("[0-9]"), F.substring(digits, nth(k), F.lit(1))).otherwise(c)), "")


def luhn_digit(payload: Column) -> Column:
    """The digit that makes ``payload`` and itself pass the Luhn check."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    figures = F.transform(F.split(F.reverse(payload), ""), lambda c, k: F.when(k % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return ((10 - F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def mod97(c: Column) -> Column:
    """The remainder of an IBAN's digits, letters as 10 to 35."""
    value = lambda x: F.when(x.rlike("[A-Z]"), F.ascii(x) - 55).otherwise(F.ascii(x) - 48)
    return F.aggregate(
        F.split(c, ""), F.lit(0), lambda a, x: let(value(x), lambda v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97))
    )


def _card(key: str, found: Column) -> Column:
    digits = digits_of(found)
    payload = lambda d: F.substring(d, F.lit(1), F.length(d) - 1)

    def put(d: Column) -> Column:
        new = let(permuted_characters(key, "card", payload(d)), lambda p: with_digits(found, F.concat(p, luhn_digit(p))))
        return F.when(F.length(d).between(13, 19) & (luhn_digit(payload(d)) == F.right(d, F.lit(1))), new)

    return let(digits, put)


def _iban(key: str, found: Column) -> Column:
    bare = F.replace(found, F.lit(" "), F.lit(""))

    def put(b: Column) -> Column:
        country, rest = F.substring(b, 1, 2), F.substring(b, F.lit(5), F.length(b))
        digits = digits_of(rest)

        def checked(account: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
            return with_digits(found, F.concat(check, digits_of(account)))

        new = let(let(permuted_characters(key, "iban", digits), lambda d: with_digits(rest, d)), checked)
        valid = F.length(b).between(15, 34) & (mod97(F.concat(rest, F.substring(b, 1, 4))) == 1)
        return F.when(valid, new)

    return let(bare, put)


#: Social security numbers in range: areas but for one, and groups with serials.
SSN_AREAS, SSN_MISSING, SSN_REST = 898, 666, (99, 9999)


def _ssn(key: str, found: Column) -> Column:
    """A permutation of the numbers in range, so a pseudonym is in range too."""
    valid = ~found.rlike("^(000|666|9..)|-00-|0000$")
    part = lambda i: F.split_part(found, F.lit("-"), F.lit(i)).cast("long")
    size = SSN_REST[0] * SSN_REST[1]
    area = part(1) - F.when(part(1) > SSN_MISSING, 2).otherwise(1)
    number = area * size + (part(2) - 1) * SSN_REST[1] + part(3) - 1

    def shown(n: Column) -> Column:
        at, rest = F.floor(n / size), n % size
        digits = lambda x, width: F.lpad(x.cast("long").cast("string"), width, "0")
        new_area = at + F.when(at >= SSN_MISSING - 1, 2).otherwise(1)
        return F.concat_ws("-", digits(new_area, 3), digits(F.floor(rest / SSN_REST[1]) + 1, 2), digits(rest % SSN_REST[1] + 1, 4))

    return F.when(valid, let(permuted_pair(key, "ssn", number, (SSN_AREAS, size)), shown))


#: Country calling codes: those of one and two digits, as the plan of numbers has them; all others have three.
CALLING_CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _phone(key: str, found: Column) -> Column:
    """The country code is read from the table, never from marks, so a number is the same in every spelling."""
    digits = digits_of(found)
    code = F.regexp_extract(digits, rf"^(?:{CALLING_CODES}|[0-9]{{3}})", 0)
    rest = F.substring(digits, F.length(code) + 1, F.lit(20))
    new = with_digits(found, F.concat(code, permuted_characters(key, "phone", rest)))
    return F.when(F.length(digits).between(7, 15), new)


def _ip(key: str, found: Column) -> Column:
    parts = F.transform(F.split(found, r"\."), lambda p: p.cast("long"))
    number = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    octets = lambda n: F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    # Only the usual spelling, without leading zeros, so that the permutation is one of spellings too.
    valid = ~F.exists(parts, lambda x: x > 255) & ~found.rlike(r"(^|\.)0[0-9]")
    return F.when(valid, let(permuted_pair(key, "ip", number(parts), (1 << 16, 1 << 16)), octets))


def _date(key: str, found: Column) -> Column:
    def moved(d: Column) -> Column:
        start = F.lit(WINDOW_START).cast("date")
        day = F.datediff(d, start).cast("long")
        in_window = permuted_pair(key, "date", day, WINDOW_SIZES)
        first = F.make_date(F.year(d), F.lit(1), F.lit(1))
        nth = (F.dayofyear(d) - 1).cast("long")
        leap = F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31))) == 366
        in_year = F.when(leap, permuted_pair(key, "leap", nth, (6, 61))).otherwise(permuted_pair(key, "year", nth, (5, 73)))
        n = WINDOW_SIZES[0] * WINDOW_SIZES[1]
        return F.when(day.between(0, n - 1), F.date_add(start, in_window.cast("int"))).otherwise(F.date_add(first, in_year.cast("int")))

    def by(layout: str) -> Column:
        day = F.try_to_timestamp(found, F.lit(layout)).cast("date")
        return let(day, lambda d: F.when(d.isNotNull() & (F.year(d) > 0), F.date_format(moved(d), layout)))

    dashed, dotted = found.rlike("[0-9]-"), found.rlike(r"[0-9]\.")
    return F.when(dashed, by("yyyy-MM-dd")).when(dotted, by("dd.MM.yyyy")).otherwise(by("MM/dd/yyyy"))


def _mail(key: str, found: Column) -> Column:
    """Addresses that differ in case alone are one: their letters are permuted in lower case, and each keeps its case."""
    local = F.substring_index(found, "@", 1)
    low = F.lower(local)
    token = F.substring(F.sha2(F.concat(F.lit(f"{key}|mail|"), low), 256), 1, 16)
    cased = lambda new: F.array_join(F.zip_with(F.split(local, ""), F.split(new, ""), lambda a, b: F.when(a != F.lower(a), F.upper(b)).otherwise(b)), "")
    put = F.when(local.rlike(r"[^\x00-\x7f]"), token).otherwise(let(permuted_characters(key, "mail", low), cased))
    return F.concat(put, F.lit("@"), F.substring_index(found, "@", -1))


_PSEUDONYM = {"card": _card, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "iban": _iban, "mail": _mail}


def kind_of(found: Column) -> Column:
    """Which pattern a match came from, by its shape: the shapes exclude each other."""
    shape = (
        F.when(found.contains("@"), "mail")
        .when(found.startswith("+"), "phone")
        .when(found.rlike("^[A-Z]"), "iban")
        .when(found.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(found.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(found.rlike(r"^([0-9]{4}-[0-9]{2}-|[0-9]{2}[./])"), "date")
    )
    return shape.otherwise("card")


def entity(found: Column, key: str) -> Column:
    """struct(kind, pseudonym): both null if the match is not valid."""

    def of(kind: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pseudonym in _PSEUDONYM.items():
            out = F.when(kind == name, pseudonym(key, found)).otherwise(out)
        return let(out, lambda p: F.struct(F.when(p.isNotNull(), kind).alias("kind"), p.alias("pseudonym"), found.alias("found")))

    return let(kind_of(found), of)


def key_of(spark: SparkSession) -> str:
    """The key that the session is set to use; without one it is that of the tests, and a warning says so."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        logging.getLogger(__name__).warning("%s is unset: pseudonyms are made with the public key of the tests and can be undone", KEY_SETTING)
    return key or KEY


def free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pseudonymise(df: DataFrame, key: str | None = None, counts: str | None = "entities") -> DataFrame:
    """``df`` with the pseudonyms in ``text`` and, as column ``counts``, how many entities of each kind it has (a map).

    Map-only, in the JVM. ``key``: that of the session, if none is given.
    """
    text, found = F.col("text"), free_name(df, "__found")
    key, counts = key or key_of(df.sparkSession), counts and free_name(df, counts)
    may = text.rlike("[0-9@]")  # every pattern needs one of these
    matches = F.when(may, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = df.withColumn(found, F.transform(F.coalesce(matches, F.array().cast("array<string>")), lambda m: entity(m, key)))
    pieces = F.split(text, PATTERN, -1)
    put = F.zip_with(pieces, F.col(found), lambda piece, e: F.concat(piece, F.coalesce(e["pseudonym"], e["found"], F.lit(""))))
    kinds = F.transform(F.col(found), lambda e: e["kind"])
    n_of = lambda k: F.struct(F.lit(k).alias("kind"), F.size(F.filter(kinds, lambda x: x == k)).alias("n"))
    count = F.map_from_entries(F.filter(F.array(*map(n_of, KINDS)), lambda e: e["n"] > 0))
    out = out.withColumn("text", F.when(F.size(found) > 0, F.array_join(put, "")).otherwise(text))
    return (out.withColumn(counts, count) if counts else out).drop(found)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pseudonymise(load(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda k: F.coalesce(F.try_element_at("entities", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", "text", *map(number, KINDS))
