"""Licence files as they are published: titles, copyright lines, numbers or bullets, any wrapping."""

import textwrap

import pytest

from loomdoc.llm import licenses
from loomdoc.llm.licenses import KNOWN


def scanned(spark, texts, **known):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(rows, **known).collect()}
    return [found[i] for i in range(len(texts))]


MIT = "\n\n".join(KNOWN["MIT"].split("\n\n"))
OWNERS = ["Copyright (c) 2020 Jo Example", "Copyright 2011-2019, Example Inc. and others. All rights reserved.", "Copyright (c) <year>, <owner>\nAll rights reserved.", "(c) A\n(c) B\nAll rights reserved."]


def test_published_forms(spark):
    texts, want = [], []
    titles = {
        "MIT": ["MIT License", "The MIT License (MIT)", "The MIT License", ""],
        "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "The BSD 3-Clause Licence", ""],
        "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", ""],
        "ISC": ["ISC License", "The ISC License (ISC)", ""],
        "Zlib": ["zlib License", ""],
        "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", ""],
        "Unlicense": ["The Unlicense", ""],
    }
    for name, heads in titles.items():
        for head in heads:
            for owner in OWNERS:
                texts.append(f"{head}\n\n{owner}\n\n{KNOWN[name]}\n")
                want.append(name)
    got = scanned(spark, texts)
    assert [(w, t[:60]) for t, w, g in zip(texts, want, got, strict=True) if w != g] == []


def test_numbers_and_bullets(spark):
    texts = []
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        for put in ("* ", "  - ", "({}) ", "{}) ", "   {}. "):
            text = KNOWN[name]
            for n in (1, 2, 3):
                text = text.replace(f"{n}. ", put.format(n)) if f"{n}. " in text else text
            texts.append((name, text))
    assert scanned(spark, [t for _, t in texts]) == [n for n, _ in texts]


@pytest.mark.parametrize("width", [30, 46, 79, 100_000])
def test_any_wrapping(spark, width):
    names = sorted(KNOWN)
    assert scanned(spark, ["\n".join(textwrap.wrap(KNOWN[n], width, break_long_words=False, break_on_hyphens=False)) for n in names]) == names


def test_what_is_no_licence(spark):
    texts = [None, "", "MIT License", "The MIT License (MIT)\n\nCopyright (c) 2020 A", "All rights reserved.", "Copyright 2020 A\nAll rights reserved.", "x\n" + MIT, MIT + "\nx"]
    assert scanned(spark, texts) == [None, None, None, None, "all-rights-reserved", None, None, None]


def test_a_folder_of_texts(spark, tmp_path):
    long = "\n\n".join(f"{i}. Clause {i} of the programme: " + "the licensee shall not " * 40 for i in range(1, 60))
    (tmp_path / "sub").mkdir()
    (tmp_path / "Long-1.0.txt").write_text(f"LONG PUBLIC LICENCE\n\nCopyright (C) 2001 Some Foundation, Inc.\n{long}")
    (tmp_path / "sub" / "MIT.md").write_text(MIT)
    known = licenses.read_known(spark, str(tmp_path))
    assert sorted(known) == ["Long-1.0", "MIT"]
    asked = [f"long public license\n(c) 2020 another\n{long.replace('programme', 'program')}", MIT, KNOWN["ISC"], long]
    assert scanned(spark, asked, known=known) == ["Long-1.0", "MIT", None, None]
