"""Pseudonyms against a plain Feistel network, kind by kind."""

import datetime
import hashlib

from pyspark.sql import functions as F

from loomdoc.llm import pii

K = "k1"


def hexes(tweak, i, text):
    return hashlib.sha256(f"{K}|{tweak}|{i}|{text}".encode()).hexdigest()


def pair(tweak, number, sizes):
    a, b = divmod(number, sizes[1])
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = (a + int(hexes(tweak, i, b)[:12], 16)) % sizes[0]
        else:
            b = (b + int(hexes(tweak, i, a)[:12], 16)) % sizes[1]
    return a * sizes[1] + b


def characters(tweak, text):
    half = [text[: len(text) // 2], text[len(text) // 2 :]]
    for i in range(pii.ROUNDS):
        other = half[1 - i % 2]
        h = hexes(tweak, 2 * i, other) + hexes(tweak, 2 * i + 1, other)
        out = ""
        for k, c in enumerate(half[i % 2]):
            by = int(h[2 * k : 2 * k + 2], 16)
            first, n = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26) if c.isupper() else (0, 0)
            out += chr((ord(c) - first + by) % n + first) if n else c
        half[i % 2] = out
    return "".join(half)


def put(shape, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in shape)


def luhn(payload):
    total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(payload)))
    return str(-total % 10)


def card(s):
    new = characters("card", "".join(c for c in s if c.isdigit())[:-1])
    return put(s, new + luhn(new))


def ip(s):
    n = pair("ip", sum(int(p) << 8 * k for k, p in enumerate(reversed(s.split(".")))), (1 << 16, 1 << 16))
    return ".".join(str(n >> k & 255) for k in (24, 16, 8, 0))


def date(s):
    day = datetime.date.fromisoformat(s)
    start = datetime.date(1920, 1, 1)
    n = (day - start).days
    if 0 <= n < 200 * 256:
        return (start + datetime.timedelta(pair("date", n, (200, 256)))).isoformat()
    first = datetime.date(day.year, 1, 1)
    leap = (datetime.date(day.year, 12, 31) - first).days == 365
    return (first + datetime.timedelta(pair(*("leap" if leap else "year", (day - first).days), (6, 61) if leap else (5, 73)))).isoformat()


def ssn(s):
    a, g, n = map(int, s.split("-"))
    areas = [x for x in range(1, 900) if x != 666]
    at = pair("ssn", areas.index(a) * 99 * 9999 + (g - 1) * 9999 + n - 1, (898, 99 * 9999))
    area, rest = divmod(at, 99 * 9999)
    return f"{areas[area]:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"


def phone(s):
    code = s[1 : next(i for i, c in enumerate(s) if i and not c.isdigit())]
    return put(s, code + characters("phone", "".join(c for c in s if c.isdigit())[len(code) :]))


def iban(s):
    bare = s.replace(" ", "")
    account = put(bare[4:], characters("iban", "".join(c for c in bare[4:] if c.isdigit())))
    check = 98 - int("".join(str(int(c, 36)) for c in account + bare[:2] + "00")) % 97
    return put(s, f"{check:02d}" + "".join(c for c in account if c.isdigit()))


def mail(s):
    local, domain = s.split("@")
    new = characters("mail", local.lower())
    return "".join(b.upper() if a.isupper() else b for a, b in zip(local, new, strict=True)) + "@" + domain


CASES = [
    (card, ["4111111111111111", "5500 0000 0000 0004", "3782-822463-10005"]),
    (ip, ["10.0.0.1", "255.255.255.255", "0.0.0.0"]),
    (date, ["2020-02-29", "1920-01-01", "1900-12-31", "1896-02-29", "2100-06-15"]),
    (ssn, ["123-45-6789", "001-01-0001", "899-99-9999", "665-10-2000", "667-10-2000"]),
    (phone, ["+1 (202) 555-0143", "+49 30 1234567"]),
    (iban, ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]),
    (mail, ["Jo.Doe-42@mail.example.com", "a@b.example"]),
]


def test_every_kind(spark):
    rows = [(f"x {s} y", f"x {of(s)} y") for of, values in CASES for s in values]
    got = pii.pseudonymise(spark.createDataFrame(rows, "text string, want string"), K).collect()
    assert [(r["text"], r["want"]) for r in got if r["text"] != r["want"]] == []


def test_numbers_in_range_stay_in_range(spark):
    n = spark.range(3000).select(F.format_string("%03d-%02d-%04d", F.col("id") % 665 + 1, F.col("id") % 99 + 1, F.col("id") * 3 % 9999 + 1).alias("text"))
    got = [r["text"] for r in pii.pseudonymise(n, K, counts=None).collect()]
    assert len(set(got)) == n.distinct().count()
    assert all(0 < int(x[:3]) < 900 and x[:3] != "666" and x[4:6] != "00" and x[7:] != "0000" for x in got)


def test_clashing_names_and_the_key(spark):
    df = spark.createDataFrame([("4111111111111111", "mine", "too")], "text string, __found string, Entities string")
    out = pii.pseudonymise(df)
    assert out.columns == ["text", "__found", "Entities", "entities_"]
    row = out.first()
    assert row["__found"] == "mine" and row["Entities"] == "too" and row["entities_"] == {"card": 1}
    spark.conf.set(pii.KEY_SETTING, "another")
    try:
        assert pii.pseudonymise(df).first()["text"] != row["text"]
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_a_phone_is_one_in_every_spelling(spark):
    """The country code is what the plan of numbers says, with marks behind it or not; so is the case of mail."""
    import re

    spellings = {
        "49": ["+49 30 1234567", "+49-30-1234567", "+49301234567", "+49 (30) 1234567", "+4930 1234567"],
        "1": ["+1 202 555 0143", "+12025550143", "+1 (202) 555-0143", "+1202-555-0143"],
        "353": ["+353 1 6712345", "+35316712345", "+353-1-6712345"],
        "7": ["+7 495 1234567", "+74951234567"],
    }
    rows = [(code, s) for code, spelled in spellings.items() for s in spelled]
    df = spark.createDataFrame([(i, f"call {s} now") for i, (_, s) in enumerate(rows)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df).collect()}
    shapes = lambda t: re.sub("[0-9]", "0", t)
    seen = {}
    for i, (code, s) in enumerate(rows):
        digits = re.sub("[^0-9]", "", got[i])
        assert digits.startswith(code) and shapes(got[i]) == shapes(f"call {s} now") and digits != re.sub("[^0-9]", "", s)
        seen.setdefault(code, set()).add(digits)
    assert all(len(x) == 1 for x in seen.values()), seen
    mails = ["Jo.Doe7@x.example", "jo.doe7@x.example", "JO.DOE7@x.example", "jo.doe8@x.example"]
    df = spark.createDataFrame(list(enumerate(mails)), "doc_id bigint, text string")
    new = [r["text"] for r in sorted(pii.pseudonymise(df).collect())]
    assert len({m.lower() for m in new[:3]}) == 1 and new[3].lower() != new[0].lower() and new[1].lower() == new[1] and new[0][0].isupper() and new[0][1].islower()
