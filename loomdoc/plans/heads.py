"""Heads of pages: what they hold, what is wrong with them, and what is kept of fields that nobody knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.operators import page_heads
from loomdoc.plans.cases import Cases, inputs, wanted
from loomdoc.plans.registry import query

#: Page texts, and "faults / title, hidden, tags / fields nobody knows / body".
HEADS: Cases = {
    "all fields": (
        '---\ntitle: "The «name»: \\"x\\""\ndescription: \'it\'\'s «kind»\'\nauthor: by «first»  # who\nsidebar:\n  hidden: true\nhead:\n  - tag: meta\n    attrs:\n      http-equiv: refresh\n'
        "      content: \"0; url=/«key»\"\n  - tag: style\n    content: |\n      a { b: c; }\n\n      d\n---\nBody «key»\n",
        ' / The «name»: "x"|true|meta:refresh,style: /  / Body «key»\n',
    ),
    "plain text, list at its key's place": ("---\ntitle: «name» - «kind»\ntags:\n- «first»\n- [a, 'b, c', 3]\nhead: []\n---\n", ' / «name» - «kind»|| / ["«first»",["a","b, c",3]] / '),
    "no head": ("# «name»\n---\nx", "title / || /  / # «name»\n---\nx"),
    "empty head": ("---\n---\n«name»", "title / || /  / «name»"),
    "wrong types": ("---\ntitle: «key»\nauthor:\nsubtitle: true\nsidebar:\n  hidden: yes it is\nhead:\n  - content: x\n---\n", "title subtitle author sidebar head / «key»|| /  / "),
    "blank title, number kept": ('---\ntitle: " "\nweight: «key»\n---\n', "title /  || /  / "),
    "folded text": ("---\ntitle: x\ndescription: >-\n  «first»\n  «second»\n\n  «kind»\ntags: {}\n---\n", " / x|| / {} / "),
    "unreadable": ("---\ntitle: x\n  «first»: y\n---\n«name»", "unreadable, line 2: indentation / || /  / «name»"),
    "twice": ("---\ntitle: x\ntitle: «name»\n---\n", "unreadable, line 2: title again / || /  / "),
    "open quotes": ('---\ntitle: x\nauthor: "«name»\n---\n', "unreadable, line 2: quotes / || /  / "),
}


@query("typed_heads", wanted(HEADS))
def typed_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_heads.with_heads(inputs(spark, sf_dir, HEADS).select("p_partkey", "rule", F.col("input").alias("text")), "text")
    tags = F.transform("head.head", lambda h: F.concat(h["tag"], F.lit(":"), F.coalesce(F.try_element_at(h["attrs"], F.lit("http-equiv")), F.lit(""))))
    known = F.concat(F.coalesce("head.title", F.lit("")), F.lit("|"), F.coalesce(F.col("head.sidebar.hidden").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.array_join(tags, ","), F.lit("")))
    other = F.coalesce(F.to_json(F.try_variant_get("whole", "$.tags", "variant")), F.lit(""))
    return rows.select("p_partkey", "rule", F.concat_ws(" / ", F.array_join("faults", " "), known, other, "text").alias("output"))
