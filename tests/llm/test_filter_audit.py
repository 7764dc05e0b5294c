"""The audit against applying each order of filters to each document in turn."""

import re
from itertools import permutations

from loomdoc.llm import filter_audit as fa
from tests.llm import brute

LONG = " ".join(f"w{i}" for i in range(250))
TEXTS = [None, "", "A# b", "short one", LONG, LONG, LONG + " $", "X" * 400, ("a b " * 200), ("Ab b " * 200), "\t\n ", brute.LONG, LONG]


def fails(docs):
    out = []
    for doc_id, text, *_ in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        caps = len(re.findall("[A-Z]", text))
        same = [d[0] for d in docs if (d[1] or "") == text and d[0] is not None]
        found = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * caps > 3 * len(text))
        found += "D" * bool(re.search("[#$%&*|]", text)) + "E" * (doc_id is not None and any(x < doc_id for x in same))
        out.append(found)
    return out


def plain(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    marks, out = fails(docs), {}
    for part in {d[2] or "" for d in docs}:
        mine = [(d, m) for d, m in zip(docs, marks, strict=True) if (d[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                removed = [d for d, m in left if f in m]
                stay = [(d, m) for d, m in left if f not in m]
                gone = [d for d, m in mine if f in m and (d, m) not in left]
                out[part, "".join(order), step] = [
                    len(stay), len(removed), len(gone), sum(m == f for _, m in mine),
                    sum(d[0] in good for d in removed), sum(d[0] in toxic for d in removed), f,
                ]
                shapley[f] += len(removed)
                left = stay
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, docs, labels):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, part string, mask string, n string")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = fa.audit(fa.cells(fa.with_repeats(fa.document_rows(docs, labels)))).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in FIGURES) for r in rows}
    assert len(got) == len(rows)
    return got


def test_against_plain_version(spark):
    docs = [(i, t, ["en", "de", None, ""][i % 4], "p", "m", "n") for i, t in enumerate(TEXTS)]
    docs += [docs[4], docs[12], (None, LONG, "en", "p", "m", "n"), (None, "no id", "en", "p", "m", "n")]
    docs = [(*d[:5], str(i)) for i, d in enumerate(docs)]  # rows of the plain version are told apart
    labels = [(0, 1, 0), (4, 1, 1), (4, 0, 0), (5, 0, 1), (6, None, 1), (12, 1, None), (999, 1, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_many_copies_in_many_parts(spark):
    docs = [(i, "one text" if i % 3 else LONG, f"l{i % 5}", "", "", str(i)) for i in range(90)]
    assert audited(spark, docs, [(1, 1, 1)]) == plain(docs, [(1, 1, 1)])


def test_no_documents(spark):
    assert audited(spark, [], []) == {}
