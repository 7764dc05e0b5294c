"""Every operator on nulls, empty and long texts, ties, repeats, clashing columns and empty tables."""

import hashlib
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomdoc.llm import chat, decontaminate, licenses, packing, pii, quality, simhash, similar, token_files, toxicity, url_filter
from loomdoc.llm.packing import tokenizer_path
from tests.llm import brute


def test_urls(spark):
    urls = [None, "", "no scheme porn", "HTTP://A.Example.ORG/es/1", "http://example.org/en/12?x#y", "http://b.com/de/", "x://pills-cheap.net", "x://spam.net", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id bigint, url string, host string, path string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "block"),
        ("a.example.org", "/es/1", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"),
        ("b.com", "/de/", "com/de/", "block"),
        ("pills-cheap.net", "", None, "block"),
        ("spam.net", "", None, "allow"),
        ("b:", "//c/d", None, "allow"),
    ]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_vocabulary_boundaries():
    v = url_filter.Vocabulary(["porn"], {"win": 1.0, "bet": 1.0})
    assert v.hits("http://popcornporn.net") == (0, 0, 0.0)
    assert v.hits("http://x/porn-win.WIN/bet") == (1, 2, 2.0)
    assert v.hits("http://x/%70or%6E?a=%57in&b=100%") == (1, 1, 1.0)


LUHN = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark):
    texts = [
        "4111111111111111 4111 1111 1111 1111 4111111111111112",
        "10.1.2.3 10.1.2.300 1.2.3.4.5",
        "2020-02-29 2021-02-29 31.12.1999 12/31/2001",
        "DE89370400440532013000 DE89370400440532013001",
        "123-45-6789 000-12-3456 +1 (202) 555-0143",
        "jo.42@mail.example.com",
        "4111111111111111",
        None,
        "",
        brute.LONG,
    ]
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id bigint, text string, n_card string")
    got = {r["doc_id"]: (r["text"], r["entities"]) for r in pii.pseudonymise(df).collect()}
    card, grouped, wrong = got[0][0].split(" ")[0], "".join(got[0][0].split(" ")[1:5]), got[0][0].split(" ")[5]
    assert card == grouped == got[6][0] != "4111111111111111" and LUHN(card) and wrong == "4111111111111112"
    assert got[1][0].split(" ")[1:] == ["10.1.2.300", "1.2.3.4.5"] and got[1][0].split(" ")[0] != "10.1.2.3"
    days = got[2][0].split(" ")
    assert days[1] == "2021-02-29" and got[2][1] == {"date": 3} and [len(d) for d in days] == [10] * 4
    iban = got[3][0].split(" ")[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != texts[3].split(" ")[0] and texts[3].split(" ")[1] in got[3][0]
    assert got[4][1] == {"ssn": 1, "phone": 1} and "000-12-3456" in got[4][0] and "+1 (" in got[4][0]
    assert got[5][0].endswith("@mail.example.com") and not got[5][0].startswith("jo.42")
    assert got[7] == (None, {}) and got[8] == ("", {}) and got[9][0] == brute.LONG
    assert pii.pseudonymise(df.limit(0)).count() == 0


def test_pseudonyms_before_other_values(spark):
    """A phone number or IBAN takes nothing of what follows it."""
    iban, phone = "ES9121000418450200051332", "+1 (017) 555-7713"
    texts = [
        (f"{phone} 97.51.17.173", {"phone": 1, "ip": 1}),
        (f"{phone} 4111 1111 1111 1111", {"phone": 1, "card": 1}),
        (f"{phone} 4111111111111111", {"phone": 1, "card": 1}),
        ("+1 017 555 7713 4111 1111 1111 1111", {"phone": 1, "card": 1}),
        (f"{phone} 2020-02-29", {"phone": 1, "date": 1}),
        (f"{phone} 123-45-6789 x", {"phone": 1, "ssn": 1}),
        (f"{phone} 42@mail.example.com", {"phone": 1, "mail": 1}),
        (f"{phone} 12 34 56 78 90 12", {"phone": 1}),
        ("+1 912-34-5678 +12025550143 +49 30 123456", {"phone": 3}),
        (f"{iban} EUR", {"iban": 1}),
        ("DE89 3704 0044 0532 0130 00 AB GB82 WEST 1234 5698 7654 32 1234", {"iban": 2}),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(rows).collect()}
    wrong = [(t, got[i]["text"], got[i]["entities"]) for i, (t, kinds) in enumerate(texts) if got[i]["entities"] != kinds]
    assert not wrong, wrong
    assert phone not in got[0]["text"] and "97.51.17.173" not in got[0]["text"] and iban not in got[9]["text"] and got[9]["text"].endswith(" EUR")


def test_mail_of_any_letters(spark):
    """No letter of a local part is left in the clear, and equal ones have equal pseudonyms."""
    locals_ = ["\u0438\u0432\u0430\u043d", "\u0438\u0432\u0430\u043d", "j\u00f6rg.m", "\u5f20\u4f1f", "\u0663\u0664"]
    rows = spark.createDataFrame([(i, f"to {x}@mail.example.com") for i, x in enumerate(locals_)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(rows).collect()}
    new = [got[i]["text"].removeprefix("to ").removesuffix("@mail.example.com") for i in range(5)]
    assert all(x.isascii() and x.isalnum() for x in new) and new[0] == new[1] and len(set(new)) == 4
    assert all(got[i]["entities"] == {"mail": 1} for i in got)


def test_permutations_are_permutations(spark):
    from pyspark.sql import functions as F

    n = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("s"), "id")
    out = n.select(pii.permuted_characters("k", "t", F.col("s")).alias("a"), pii.permuted_pair("k", "t", F.col("id"), (80, 125)).alias("b"))
    row = out.agg(F.count_distinct("a"), F.count_distinct("b"), F.min("b"), F.max("b")).first()
    assert tuple(row) == (10_000, 10_000, 0, 9_999)


def test_simhash(spark):
    df = brute.frame(spark)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(brute.rows())
    ids = [i for i in range(len(brute.TEXTS))]
    fps = [brute.fingerprint(t) for t in brute.TEXTS]
    part = list(ids)
    for a in ids:
        for b in ids[a + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                part = [min(part[a], part[b]) if p in (part[a], part[b]) else p for p in part]
    for r in got:
        if r["doc_id"] is not None:
            assert r["fp"] & (1 << 64) - 1 == fps[r["doc_id"]]
            assert r["component_id"] == part[r["doc_id"]]
    assert simhash.near_duplicates(brute.empty(spark)).count() == 0


def test_similar_documents(spark):
    """Near copies at 0.8 and more of five-word shingles: most are found; others stay."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts, near = [], {}
    for k in range(60):
        words = rng.choice(vocabulary, 400).tolist()
        texts.append(" ".join(words))
        for edits in (1, 2, 4):  # of 400 words: similarities of some 0.97, 0.95 and 0.9
            other = list(words)
            for i in rng.choice(400, edits, replace=False):
                other[i] = "new"
            near[len(texts)] = 4 * k
            texts.append(" ".join(other))
    found = {r["doc_id"]: r["component_id"] for r in similar.classes(brute.frame(spark, texts)).collect()}
    assert sum(found[i] == k for i, k in near.items()) >= 0.9 * len(near)
    assert all(found[i] // 4 == i // 4 for i in range(len(texts)))
    kept = similar.without_duplicates(brute.frame(spark))
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    # Without words: 0, 1, 2. Equal but for case and white space: 4, 5, 13 and the repeated 4. A word more: 7, 8.
    assert ids == [0, 3, 4, 6, 7, 9, 10, 11, 12] and kept.columns == brute.frame(spark).columns
    assert similar.without_duplicates(brute.empty(spark)).count() == 0


def test_simhash_chain_is_one_component(spark):
    """Fingerprints a bit apart each: a long chain, linked end to end without all pairs."""
    chain, fp = [], 0
    for i in range(60):
        fp ^= 1 << i
        chain.append((fp - (1 << 64) if fp >> 63 else fp, 1000 - i))
    found = simhash.components(simhash.links(spark.createDataFrame(chain, "fp bigint, rep bigint"))).collect()
    assert {r["component"] for r in found} == {941} and len(found) == 59


ITEM = "one two three four five six seven eight nine ten eleven twelve"


def test_decontamination(spark):
    texts = [None, "", "clean text here", f"Before {ITEM.upper()}, after", "x one two three y", "short item", brute.LONG + " " + ITEM, f"{ITEM} {ITEM}", "..."]
    items = [(7, ITEM), (10, "short item"), (8, None), (9, "..."), (None, "clean text"), (7, "x one two three")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = brute.frame(spark, texts)
    windows: dict = {}
    for item, text in items:
        for w in brute.windows(text)[1] if item is not None else []:
            windows.setdefault(w, set()).add(str(item))
    for block in (10, 8_000_000):  # one item a block, and all in one
        got = {r["doc_id"]: r for r in decontaminate.judge(df, bench, shard_words=50, block_bytes=block).collect() if r["doc_id"] is not None}
        for i, text in enumerate(texts):
            words, hit, of = brute.windows(text)[0], set(), set()
            for w, owners in windows.items():
                for k in range(len(words) - len(w) + 1):
                    if tuple(words[k : k + len(w)]) == w:
                        hit |= set(range(k, k + len(w)))
                        of |= owners
            digest = hashlib.sha256(",".join(sorted(of)).encode()).hexdigest()
            assert tuple(got[i])[1:] == (len(words), len(hit), len(of), digest, bool(hit))
    kept = {r["doc_id"]: r for r in decontaminate.without_hits(df, bench).collect()}
    assert kept[3]["text"] == "Before , after" and kept[0]["text"] is None and kept[2] == df.filter("doc_id = 2").first() and kept[5]["text"] == ""
    assert decontaminate.without_hits(df, bench).columns == df.columns
    assert decontaminate.judge(brute.empty(spark), bench).count() == 0
    assert decontaminate.judge(df, bench.limit(0)).filter("contaminated").count() == 0


def test_quality(spark):
    df = brute.frame(spark)
    got = {r["doc_id"]: r for r in quality.judge(df, None).collect() if r["doc_id"] is not None}
    for i, text in enumerate(brute.TEXTS):
        words = (text or "").encode().split()
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), brute.repeated(text))
        assert tuple(got[i][c] for c in quality.BASE) == want, text
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and got[i]["kept"] == (not got[i]["base_failed"])
    assert quality.judge(brute.empty(spark), None).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.fit(df, none) is None


def walked(trees, row):
    """The score of a row, node by node."""
    total = trees.base
    for feature, cut, leaf in zip(trees.feature.tolist(), trees.cut.tolist(), trees.leaf.tolist(), strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_trees_walked_one_by_one(spark):
    """Scores of flat arrays against a walk from node to node, and the verdicts that come of them."""
    from loomdoc.llm import gbt

    rng = np.random.default_rng(4)
    n = len(quality.FEATURES)
    x = rng.normal(size=(800, n))
    trees = gbt.fit(x, (x[:, 0] - x[:, 2] + rng.normal(size=800) / 2 > 0).astype(float), list(quality.FEATURES.values()))
    assert np.allclose(trees.score(x[:200]), [walked(trees, row) for row in x[:200]])
    texts = [f"Some words of text number {i}, {'which are repeated ' * (i % 4)}and an end of it." for i in range(40)] + [None, ""]
    got = {r["doc_id"]: r for r in quality.judge(brute.frame(spark, texts), trees).collect() if r["doc_id"] is not None}
    for i, text in enumerate(texts):
        score = walked(trees, np.array(quality.statistics(text)[len(quality.BASE) :], float))
        assert abs(got[i]["score"] - score) < 1e-9
        assert got[i]["kept"] == (not got[i]["base_failed"] and score >= quality.LEAST_SCORE)


def test_packs_are_those_of_piece_by_piece_packing():
    """Counts of patterns against packing single pieces: longest first, each into the pack with the most room."""
    rng = np.random.default_rng(2)
    for size in (7, 64, 1000):
        lengths = rng.integers(1, size + 1, 400).tolist()
        packs: list[list[int]] = []
        for length in sorted(lengths, reverse=True):
            roomy = max(packs, key=lambda p: size - sum(p), default=None)
            if roomy is None or size - sum(roomy) < length:
                packs.append([length])
            else:
                roomy.append(length)
        got = packing.plan_packs(dict(Counter(lengths)), size)
        assert sum(n for _, n in got) == len(packs)
        assert Counter(x for p, n in got for x in p for _ in range(n)) == Counter(lengths)
        assert sorted(sum(p) for p, n in got for _ in range(n)) == sorted(map(sum, packs))


def test_trees_keep_their_constraints():
    from loomdoc.llm import gbt

    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + 0.5 * np.sin(3 * x[:, 0]) - x[:, 1] + rng.normal(size=3000) > 0).astype(float)
    trees = gbt.fit(x, y, [1, -1, 0])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.8
    for f, sign in ((0, 1), (1, -1)):
        grid = np.repeat(x[:40], 60, axis=0)
        grid[:, f] = np.tile(np.linspace(-3, 3, 60), 40)
        assert (sign * np.diff(trees.score(grid).reshape(40, 60), axis=1) >= -1e-12).all()


def test_licenses(spark):
    mit = "Copyright (c) 2020 Jo\n\n" + licenses.KNOWN["MIT"].replace("the", "THE").replace("\n", "  \n")
    texts = [None, "", "!!!", mit, licenses.KNOWN["BSD-2-Clause"].replace("COPYRIGHT HOLDER", "copyright owner"), "Some Licence", mit + " more"]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(brute.frame(spark, texts)).collect()}
    assert [got[i] for i in range(7)] == [None, None, None, "MIT", "BSD-2-Clause", None, None]
    assert licenses.scan_licenses(brute.empty(spark)).count() == 0


def test_licenses_at_any_wrapping(spark):
    """Known texts on one line and at several widths; copyright lines with a year, a sign or an owner still go."""
    wrapped = [(name, t) for name, text in licenses.KNOWN.items() for t in (text, " ".join(text.split()), *(textwrap.fill(text, w, break_long_words=False) for w in range(20, 121)))]
    wrapped += [("MIT", f"{line}\n\n{licenses.KNOWN['MIT']}") for line in ("Copyright 2020 Jo", "copyright (c) Jo", "Copyright: © Jo", "Copyright The Jo Authors", "(c) Jo", "© 2020", "Copyright holder: Jo")]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(wrapped)], "doc_id bigint, text string")).collect()}
    lost = [name for i, (name, _) in enumerate(wrapped) if got[i] != name]
    assert not lost, (len(lost), len(wrapped))


def test_known_licenses_of_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Copyright 2020 Jo\nDo as you like, but keep this licence.\n")
    known = licenses.read_known(spark, str(tmp_path))
    texts = ["do as you like; but keep this LICENSE", "do as you like"]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(brute.frame(spark, texts + texts + ["x"]), known).collect()}
    assert list(known) == ["Own-1.0"] and [got[i] for i in range(4)] == ["Own-1.0", None, "Own-1.0", None]


def test_toxicity_of_no_evidence(spark):
    """A bounded sample with as many toxic texts as others, and no term to learn: nothing is taken for toxic."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"{a}{b}{c}" for a in "bcd" for b in "aeiou" for c in "lmn"], 12).tolist()) for _ in range(200)]
    df = brute.frame(spark, texts)
    table = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id bigint, quality int, toxic int")
    lexicon = toxicity.learn(df, table)
    assert toxicity.without_toxic(df, toxicity.Lexicon({}, base=lexicon.base, slope=lexicon.slope)).count() == df.count()
    assert lexicon.probability(np.zeros(1))[0] < toxicity.THRESHOLD / 2


def test_toxicity_counts_as_plain_matching_does():
    """Hits against a plain search for every term at every place."""
    lexicon = toxicity.Lexicon({"scum$": 1.0, "idio": 2.0, "rat$": 1.5}, {"idiom", ("white", "rat"), ("rat", "race")})
    rng = np.random.default_rng(9)
    words = ["scum", "scums", "idiot", "idiom", "rat", "rats", "white", "race", "x" * 150, "!!!", "42", "plain"]
    automaton = lexicon.automaton()
    for _ in range(300):
        text = " ".join(rng.choice(words, int(rng.integers(0, 12))).tolist())
        tokens, want = [w for w in text.split() if w.isalpha()], []
        for i, w in enumerate(tokens):
            pairs = {w, (tokens[i - 1] if i else "", w), (w, tokens[i + 1] if i + 1 < len(tokens) else "")}
            if not pairs & lexicon.exceptions:
                want += [t for t in lexicon.weights if (w == t[:-1] if t[-1] == "$" else w.startswith(t))]
        assert sorted(h[0] for h in lexicon.hits(toxicity.fold(text), automaton)) == sorted(want)
        every = toxicity.Lexicon(lexicon.weights, lexicon.exceptions, repeats=None)
        total = sum(lexicon.weights[t] for t in want) / np.log2(16 + len(text) / 64)
        assert abs(every.evidence(text, automaton) - total) < 1e-9


def test_toxicity(spark):
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append(f"some plain words {i} " + ("you 1diot, such v\u0435rmin" if bad else "about idiotism in fiction") + " and the rest of it " * (i % 5))
        labels.append((i, 1, int(bad)))
    df, table = brute.frame(spark, texts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    lexicon = toxicity.learn(df, table)
    got = {r["doc_id"]: r for r in toxicity.score(df, lexicon).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(400))
    assert all(got[i]["predicted"] == labels[i][2] for i in held)
    kept = toxicity.without_toxic(df, lexicon)
    assert kept.columns == df.columns and kept.filter("doc_id IS NOT NULL").select("doc_id").distinct().count() == 300
    edges = toxicity.score(brute.frame(spark), lexicon).collect()
    assert len(edges) == len(brute.rows()) and all(0 <= r["score"] <= 1 for r in edges)
    assert toxicity.score(brute.empty(spark), lexicon).count() == 0
    assert toxicity.learn(df, table.limit(0)).weights == {}


def test_fold():
    assert toxicity.fold("W0rthless cl\u043ewn h@te 2024 a$b! $5") == "worthless clown hate 2024 asb! $5"


def test_chat_of_many_turns(spark):
    """Spans of a conversation of some thousand turns, over many chunks of the sums."""
    from pyspark.sql import functions as F

    n = 2 * chat.CHUNK + 77
    rows = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 > 0, "assistant").otherwise("user").alias("role"), F.format_string("t%d<", F.col("id")).alias("text"))
    row = chat.format_conversations(rows).first()
    told = [row["formatted"][s["start"] - 1 :][: s["length"]] for s in row["loss_spans"]]
    assert told == [f"t{i}<\\" for i in range(n) if i % 3]
    for k in (0, 1, chat.CHUNK, chat.CHUNK + 1):
        got = spark.range(1).select(chat.starts_of(F.array(*[F.lit(2)] * k).cast("array<int>"), 4).alias("x")).first()["x"]
        assert got == [4 + 2 * i for i in range(k)]


@pytest.mark.parametrize("texts", [["a", "b"], ["[/END]", "<s>\\[", "\\", "[ROLE]x[/ROLE]", "", None, "[TURN]", "<\\["]])
def test_chat_round_trip(spark, texts):
    from pyspark.sql import functions as F

    roles = ["user", "assistant", "assistant", None, "user", "assistant", "assistant", "[END]"]
    rows = [(1, i, roles[i], t, "x") for i, t in enumerate(texts)] + [(None, 1, "user", "n", "x"), (None, 1, "user", "n", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(roles[i] or "", t or "") for i, t in enumerate(texts)]
    assert len(got[None]["turns"]) == 2
    learned = [got[1]["formatted"][s["start"] - 1 :][: s["length"]] for s in got[1]["loss_spans"]]
    back = lambda x: x.replace("<\\", "<").replace("[\\", "[").replace("\\\\", "\\")
    assert list(map(back, learned)) == [t or "" for i, t in enumerate(texts) if roles[i] == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def ids_of(name, texts, end):
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


ODD = ["a  b", "  x y ", "a \n b\n\n c", "<|endoftext|> a <|endoftext|>", "e\u0301 I'm don't x \x1c y", "\uff11\uff12 3.4 ... a\u3000b", "\n", "\n \n x", "tab\t x", "a\u200bc,d", "Hi,there!! ok.", "x" * 300]


def test_packing(spark):
    texts = [*brute.TEXTS, *ODD]
    for size in (64, 4096):
        rows = packing.pack_documents(brute.frame(spark, texts), size=size).collect()
        want = dict(enumerate(ids_of(packing.TOKENIZER, texts, packing.END_ID)))
        total = sum(map(len, want.values())) + len(want[4]) + len(ids_of(packing.TOKENIZER, ["no id"], 2)[0])
        assert sum(r["length"] for r in rows) == total
        sequences: dict = {}
        for r in rows:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            if r["doc_id"] is not None:
                ids = want[r["doc_id"]]
                assert r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
    assert packing.pack_documents(brute.empty(spark)).count() == 0


def test_plan_holds_every_piece():
    rng = np.random.default_rng(3)
    for size in (8, 100, 4096):
        lengths = Counter(rng.integers(1, size + 1, 500).tolist())
        packs = packing.plan_packs(dict(lengths), size)
        placed = Counter()
        for pattern, n in packs:
            assert sum(pattern) <= size
            for length in pattern:
                placed[length] += n
        assert placed == lengths


def test_token_files(spark, tmp_path):
    texts = [*brute.TEXTS, *ODD]
    folder = f"file://{tmp_path}/files"
    token_files.write_files(brute.frame(spark, texts), folder, tokenizer_path(token_files.TOKENIZER), 0, token_files.VOCABULARY, shard_ids=30_000, block_ids=500)
    got = token_files.read_files(spark, folder, token_files.VOCABULARY).collect()
    want = ids_of(token_files.TOKENIZER, texts, 0)
    order = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in order:
        assert r["start"] == at
        at += r["n_ids"]
        if r["doc_id"] is not None:
            assert r["ids"] == want[r["doc_id"]].tobytes()
    ids = [r["doc_id"] for r in order]
    assert ids[0] is None and ids[1:] == sorted([*range(len(texts)), 4])
    folder = f"file://{tmp_path}/none"
    token_files.write_files(brute.empty(spark), folder, tokenizer_path(token_files.TOKENIZER), 0, token_files.VOCABULARY)
    assert token_files.read_files(spark, folder, token_files.VOCABULARY).count() == 0


def test_huffman():
    from loomdoc.llm import huffman

    rng = np.random.default_rng(5)
    for n, skew in ((1, 1.0), (2, 1.0), (300, 1.5), (60_000, 1.2)):
        counts = np.zeros(65_536, np.int64)
        counts[rng.permutation(65_536)[:n]] = (1e6 / np.arange(1, n + 1) ** skew + 1).astype(np.int64)
        lengths = huffman.code_lengths(counts)
        assert lengths.max() <= huffman.LIMIT and (lengths > 0).sum() == n
        assert sum(2.0 ** -int(x) for x in lengths[lengths > 0]) <= 1
        n_ids = rng.integers(1, 400, 50)
        ids = rng.choice(np.flatnonzero(counts), int(n_ids.sum()))
        coded, at, marks, _ = huffman.encode(ids, n_ids, lengths, huffman.canonical_codes(lengths))
        assert (huffman.Decoder(lengths).decode(coded, at[:-1], n_ids, marks) == ids).all()


def classes_of(spark, texts):
    """doc_ids of ``texts`` by their class, as found and as all pairs give them."""
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    first = list(range(len(texts)))

    def top(i):
        while first[i] != i:
            i = first[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                first[b] = a
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in similar.classes(rows).collect()}
    return [found[i] for i in range(len(texts))], [top(i) for i in range(len(texts))]


def test_copies_meet_an_original_of_any_doc_id(spark):
    """Copies that are similar to their original only, which is not the least of them."""
    rng = np.random.default_rng(21)
    vocabulary, texts = [f"w{i}" for i in range(5000)], []
    for _ in range(12):
        words = rng.choice(vocabulary, 300).tolist()
        for _ in range(20):
            other = list(words)
            for i in rng.choice(300, 5, replace=False):
                other[i] = f"new{rng.integers(1 << 30)}"
            texts.append(" ".join(other))
        texts.append(" ".join(words))
    found, true = classes_of(spark, [texts[i] for i in rng.permutation(len(texts))])
    assert found == true and len(set(true)) < 20


def test_copies_meet_among_texts_with_a_common_passage(spark):
    """Pairs of near copies in texts that all have one passage of three quarters of their words."""
    rng = np.random.default_rng(22)
    vocabulary, texts = [f"w{i}" for i in range(5000)], []
    passage = rng.choice(vocabulary, 200).tolist()
    for _ in range(150):
        words = rng.choice(vocabulary, 60).tolist()
        other = words[:-22] + rng.choice(vocabulary, 22).tolist()
        texts += [" ".join(words + passage), " ".join(other + passage)]
    found, true = classes_of(spark, [texts[i] for i in rng.permutation(len(texts))])
    assert found == true and len(set(true)) == 150


def test_pairs_at_the_similarity_are_found(spark):
    """Pairs from just under 0.8 to 0.9: all at 0.8 and more are found, and no other."""
    rng = np.random.default_rng(23)
    vocabulary, texts = [f"w{i}" for i in range(5000)], []
    for k in range(200):
        words = rng.choice(vocabulary, 200).tolist()
        edits = 10 + k % 16  # words at the end
        texts += [" ".join(words), " ".join(words[:-edits] + rng.choice(vocabulary, edits).tolist())]
    found, true = classes_of(spark, texts)
    assert found == true and 200 < len(set(true)) < 300
