"""Near-duplicate classes at a similarity of word shingles, by an exact join of shingle sets.

Two sets are similar if they have ``similarity`` of their union in common. With all shingles in one order, similar sets
then share one of the first n - ceil(similarity * n) + 1 of each (prefix filtering), so these are the keys of a text. Any
order gives all pairs; shingles that many texts of a sample have come last, so that a common passage is no key. A
candidate is held against sketches of 256 bits, which would drop a pair at 0.8 in fewer than one of 10^7 cases if their
hashes were independent (``classes`` goes without them if ``deviations`` is None), and what they leave is decided by the
shingles themselves.

Classes are components of similar pairs, so pairs within a class need not be met. Two rounds link the members of a key to
one of them: any one first, then the one with the most links yet, which for copies of one original is the original, unless
they are in its component by then. Then every two members of a key that are in different components are compared, whatever they are to others, and no partner is left out.

Members of a key that more than ``CROWD`` texts have would make rows by the square of their number here: texts that are
near to one original, but not to each other. Such keys whose member of the least hash is the same are one crowd: keys of
the same texts are together, and those that a text or two have in common (a passage and another) are not, as they would be
if crowds were what keys connect. A crowd that is more than a block is parted by sizes, as a text has no partner of far more or
fewer shingles, and a part is dealt into blocks of a bounded size. Every two blocks are one task: sizes and sketches tell first whose shingles it needs, then
these are compared, and only links that connect what is in different components leave it.

Classes that another method has found (``known``: SimHash's in the pipeline) are links as well: what it links is one component
before copies of the original are looked for.

A node is a distinct set of shingles. Texts without words are one node, as are texts that differ in case and white space
alone. Rows without a doc_id stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.components import components
from loomdoc.llm.shared import written
from loomdoc.llm.simhash import shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: Of so many texts one is searched for frequent shingles; so many of these must have it; so many are listed at most. Only
#: the order of shingles depends on it.
SAMPLE, SEEN, LISTED = 16, 4, 1 << 18
#: Members of a key whose pairs are rows; those of larger ones are compared in blocks of so many texts, or so many shingles.
CROWD, BLOCK, BLOCK_SHINGLES = 32, 1024, 1 << 20
#: Columns of the table of shingles that two blocks are compared by, at once.
COLUMNS = 1 << 12
SKETCH = 256
LONGS = [f"s{k}" for k in range(SKETCH // 64)]
#: Standard deviations under what the similarity gives, from which a sketch drops a pair.
DEVIATIONS = 6.5
_RANDOM = np.random.default_rng(SKETCH)
_XOR = _RANDOM.integers(0, 1 << 32, SKETCH, np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 31, SKETCH, np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit of the least value under each of SKETCH hash functions."""
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(least, ((low[i : i + 1024, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return np.packbits((mixed >> np.uint32(31)).astype(np.uint8)).view(np.int64)


def prefix(shingles: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles, frequent ones last: similar sets have one of them in common."""
    n = len(shingles)
    if not n:
        return shingles
    at = np.minimum(np.searchsorted(frequent, shingles), max(len(frequent) - 1, 0))
    known = frequent[at] == shingles if len(frequent) else np.zeros(n, bool)
    return np.concatenate([shingles[~known], shingles[known]])[: n - math.ceil(similarity * n - 1e-9) + 1]


def frequent_shingles(df: DataFrame, words: int) -> np.ndarray:
    """Sorted shingles that several texts of a sample have, exact copies aside."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"]]
            yield pd.DataFrame({"node": [node_of(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    sample = df.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    rows = sample.mapInPandas(of, "node bigint, shingles array<bigint>").select("node", F.explode("shingles").alias("token"))
    counts = written(rows.distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN), "frequent")
    least, listed = SEEN, 0
    for n, k in sorted((tuple(r) for r in counts.groupBy("n").count().collect()), reverse=True):
        listed += k
        if listed > LISTED:
            least = n + 1
            break
    found = [r[0] for r in counts.filter(F.col("n") >= least).select("token").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def signatures(df: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, text_hash, node, n, s0.., tokens): n is the size of the set, tokens are its keys."""
    frequent = df.sparkSession.sparkContext.broadcast(frequent_shingles(df, words))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"].to_pylist()]
            sketches = np.array([sketch(s) for s in sets], np.int64).reshape(-1, len(LONGS))
            out = {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "node": pa.array([node_of(s) for s in sets], pa.int64())}
            out |= {"n": pa.array([len(s) for s in sets], pa.int32())} | {name: pa.array(sketches[:, k]) for k, name in enumerate(LONGS)}
            out["tokens"] = pa.array([prefix(s, frequent.value, similarity).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    longs = ", ".join(f"{name} bigint" for name in LONGS)
    rows = df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(of, f"doc_id bigint, text_hash bigint, node bigint, n int, {longs}, tokens array<bigint>")


def shingle_sets(df: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the texts of ``asked`` (doc_id, node)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                s = shingle_set(text, words)
                yield pd.DataFrame({"node": [node_of(s)], "shingles": [s.view(np.int64)]})

    texts = df.select("doc_id", "text").join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = texts.select("text").mapInPandas(of, "node bigint, shingles array<bigint>")
    return sets.join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"])


def alike_enough(a, b, similarity: float, deviations: float | None) -> tuple[Column, Column]:
    """Whether sizes and sketches of rows ``a`` and ``b`` leave a pair, and how far apart the sketches are. Without
    ``deviations`` sizes alone decide, which drops no similar pair whatever the hashes are."""
    apart = sum((F.bit_count(a(s).bitwiseXOR(b(s))) for s in LONGS), F.lit(0))
    sizes = F.least(a("n"), b("n")) >= similarity * F.greatest(a("n"), b("n")) - 1e-9
    if deviations is None:
        return sizes, apart
    p = (1 - similarity) / 2
    return sizes & (apart <= SKETCH * p + deviations * math.sqrt(SKETCH * p * (1 - p))), apart


def likely(pairs: DataFrame, nodes: DataFrame, similarity: float, deviations: float | None) -> DataFrame:
    """(u, v, apart) of distinct pairs that sizes and sketches leave."""
    of = lambda side: nodes.select(F.col("node").alias(side), F.struct("n", *LONGS).alias(f"{side}_is"))
    joined = pairs.distinct().join(of("u"), "u").join(of("v"), "v")
    left, apart = alike_enough(lambda c: F.col(f"u_is.{c}"), lambda c: F.col(f"v_is.{c}"), similarity, deviations)
    return joined.filter(left).select("u", "v", apart.alias("apart"))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingles are alike."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").withColumn("common", F.size(F.array_intersect("u_set", "v_set")))
    alike = F.col("common") >= similarity * (F.size("u_set") + F.size("v_set") - F.col("common")) - 1e-9
    return both.filter(alike).select("u", "v")


def _to_one(keys: DataFrame, links: DataFrame | None, placed: DataFrame | None) -> DataFrame:
    """Pairs (u, v): each member of a key and one of them, the one that most ``links`` have. Members whose component
    (``placed``) is that one's already are linked to it."""
    hash_ = F.xxhash64("token")
    if links is None:
        hubs = keys.groupBy("token").agg(F.min(F.col("node").bitwiseXOR(hash_)).alias("hub"))
        return keys.join(hubs.select("token", F.col("hub").bitwiseXOR(hash_).alias("v")), "token").select(F.col("node").alias("u"), "v")
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    ranked = placed.join(degree, "node")
    best = F.struct("links", F.col("node").bitwiseXOR(hash_).alias("hub"), "component")
    hubs = ranked.groupBy("token").agg(F.max(best).alias("best"))
    hubs = hubs.select("token", F.col("best.hub").bitwiseXOR(hash_).alias("v"), F.col("best.component").alias("of_hub"))
    return placed.join(hubs, "token").filter(F.col("component") != F.col("of_hub")).select(F.col("node").alias("u"), "v")


def _mixed(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` whose token's members are in different components, with the number of these members."""
    tokens = keys.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"))
    return keys.join(tokens.filter("lo < hi").select("token", "members"), "token")


def _across(open_: DataFrame, nodes: DataFrame, similarity: float, deviations: float | None) -> DataFrame:
    """Pairs (u, v): all members of a key that are in different components, if sizes, sketches and places leave them.

    A key that is the first one of a pair leaves the pair 1 and what is behind it in common at most. Similar pairs have
    enough behind their first key, so those that have not can be left to other keys.
    """
    open_ = open_.join(nodes.select("node", "n", *LONGS), "node")
    of = lambda side: open_.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "component", "place", "n", *LONGS)])
    u, v = (lambda c: F.col(f"u_{c}")), (lambda c: F.col(f"v_{c}"))
    left, _ = alike_enough(u, v, similarity, deviations)
    behind = F.least(u("n") - u("place"), v("n") - v("place")) >= similarity / (1 + similarity) * (u("n") + v("n")) - 1e-6
    pairs = of("u").join(of("v"), "token").filter((u("node") > v("node")) & (u("component") != v("component")) & behind & left)
    return pairs.select(u("node").alias("u"), v("node").alias("v")).distinct()


def crowds(open_: DataFrame) -> DataFrame:
    """(crowd, node, component) of keys (token, node, component): a crowd is the members of all tokens that have their least
    hash of a member in common. The members of a token are in one crowd; a node is in one for each such hash of its tokens."""
    least = open_.groupBy("token").agg(F.min(F.xxhash64("node")).alias("crowd"))
    return open_.join(least, "token").select("crowd", "node", "component").distinct()


def in_common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets of ``a`` and ``b`` have in common."""
    flat = [np.concatenate(sets) for sets in (a, b)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(a), len(b)), np.int64)
    if not len(both):
        return out
    spots = []
    for sets, values in zip((a, b), flat, strict=True):
        rows, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.minimum(np.searchsorted(both, values), len(both) - 1)
        found = both[at] == values
        order = np.argsort(at[found], kind="stable")
        spots.append((rows[found][order], at[found][order]))
    for low in range(0, len(both), COLUMNS):
        tables = []
        for sets, (rows, at) in zip((a, b), spots, strict=True):
            i, j = np.searchsorted(at, [low, low + COLUMNS])
            table = np.zeros((len(sets), min(COLUMNS, len(both) - low)), np.float32)
            table[rows[i:j], at[i:j] - low] = 1
            tables.append(table)
        out += (tables[0] @ tables[1].T).astype(np.int64)
    return out


def _links_of_blocks(a: pd.DataFrame, b: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Similar pairs of a member of ``a`` and one of ``b``, as many as connect all components that such pairs connect."""
    sets = [[np.asarray(s, np.int64) for s in rows["shingles"]] for rows in (a, b)]
    sizes = [np.array([len(s) for s in of], np.int64) for of in sets]
    common = in_common(*sets)
    apart = a["component"].to_numpy()[:, None] != b["component"].to_numpy()[None]
    alike = common >= similarity * (sizes[0][:, None] + sizes[1][None] - common) - 1e-9
    above: dict[int, int] = {}

    def top(c: int) -> int:
        while c in above:
            above[c] = c = above.get(above[c], above[c])
        return c

    out, of_a, of_b = [], a["component"].tolist(), b["component"].tolist()
    nodes_a, nodes_b = a["node"].tolist(), b["node"].tolist()
    for i, j in np.argwhere(apart & alike).tolist():
        x, y = top(of_a[i]), top(of_b[j])
        if x != y:
            above[x] = y
            out.append((max(nodes_a[i], nodes_b[j]), min(nodes_a[i], nodes_b[j])))
    return out


def dealt_crowds(members: DataFrame, nodes: DataFrame, similarity: float, deviations: float | None, block: int = BLOCK) -> DataFrame:
    """(crowd, part, i, j, block, node, component) of members (crowd, node, component): the rows of each two blocks i and j of a
    part of a crowd, of those members only that sizes and sketches leave a partner in another component.

    Sizes fall into classes so wide that partners are of one class or of two next to each other. A part is a class and the one
    above it; pairs within the upper one are left to the part that has it as its own. A crowd of one block is one part.
    """
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    rows = members.join(nodes.select("node", "n", *LONGS), "node")
    rows = rows.join(rows.groupBy("crowd").agg(blocks).select("crowd", (F.col("blocks") > 1).alias("parted")), "crowd")
    size = F.when(F.col("parted"), F.floor(F.log(F.greatest("n", F.lit(1))) / math.log((1 + 1e-6) / similarity)).cast("int")).otherwise(0)
    rows = rows.withColumn("part", F.explode(F.when(F.col("parted"), F.array(size, size - 1)).otherwise(F.array(size)))).withColumn("own", F.col("part") == size)
    of_part = rows.groupBy("crowd", "part").agg(blocks, F.count(F.lit(1)).alias("members"), F.max("own").alias("owns"))
    rows = rows.join(of_part.filter("owns AND members > 1").select("crowd", "part", "blocks"), ["crowd", "part"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("crowd", "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "own", "n", *LONGS)
    names = ["crowd", "part", "i", "j", "block", "node", "component"]
    p = (1 - similarity) / 2
    most = SKETCH if deviations is None else SKETCH * p + deviations * math.sqrt(SKETCH * p * (1 - p))

    def choose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a, b = (group["block"] == key[2]).to_numpy(), (group["block"] == key[3]).to_numpy()
        of = lambda c: (group[c].to_numpy()[a][:, None], group[c].to_numpy()[b][None])
        (n, m), (c, d), (own, its) = of("n"), of("component"), of("own")
        left = (c != d) & (own | its) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)
        left &= sum(np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int16) for x, y in map(of, LONGS)) <= most
        has = np.zeros(len(group), bool)
        has[np.flatnonzero(a)[left.any(axis=1)]] = True
        has[np.flatnonzero(b)[left.any(axis=0)]] = True
        return group.loc[has, names]

    return rows.groupBy("crowd", "part", "i", "j").applyInPandas(choose, "crowd bigint, part int, i int, j int, block int, node bigint, component bigint")


def crowd_links(dealt: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links by which similar members of one crowd are one component. All of two blocks are compared in a task."""

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["block"] == key[2]], group[group["block"] == key[3]]
        found = _links_of_blocks(a, b, similarity) if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return dealt.join(sets, "node").groupBy("crowd", "part", "i", "j").applyInPandas(compare, "u bigint, v bigint").distinct()


def _with_component(keys: DataFrame, links: DataFrame) -> DataFrame:
    joined = keys.join(components(links).withColumnRenamed("component", "c"), "node", "left")
    return written(joined.select("token", "node", "place", F.coalesce("c", "node").alias("component")), "placed")


def _told(known: DataFrame, found: DataFrame) -> DataFrame:
    """Links (u, v) between each node of a class of ``known`` (doc_id, text_hash, class_id) and the least one."""
    nodes = known.join(found.select("doc_id", "text_hash", "node"), ["doc_id", "text_hash"]).select("class_id", "node").distinct()
    least = nodes.groupBy("class_id").agg(F.min("node").alias("v"))
    return nodes.join(least, "class_id").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()


def classes(
    df: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    deviations: float | None = DEVIATIONS,
    known: DataFrame | None = None,
    crowd: int = CROWD,
) -> DataFrame:
    """(doc_id, text_hash, class_id, component_id): component_id is the least doc_id of the class; text_hash tells rows of one
    doc_id apart, and class_id tells their classes apart. ``deviations`` None leaves sketches out. Rows that are of one class in
    ``known`` (doc_id, text_hash, class_id) are of one class here."""
    found = written(signatures(df, words, similarity), "signatures").filter("doc_id IS NOT NULL")
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *[F.first(s).alias(s) for s in LONGS])
    nodes = written(nodes, "nodes")
    rows = found.select("node", F.posexplode("tokens").alias("place", "token"))
    shared = rows.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("token")
    keys = written(rows.join(shared, "token", "left_semi").distinct(), "keys")

    links, sets, placed = None, None, None
    for turn in ("any", "most", "all"):
        if links is not None:
            placed = _with_component(keys, links)
        if turn == "all":
            open_ = written(_mixed(placed), "open")
            pairs = _across(open_.filter(F.col("members") <= crowd), nodes, similarity, deviations)
            dealt = written(dealt_crowds(crowds(open_.filter(F.col("members") > crowd)), nodes, similarity, deviations), "crowds")
        else:
            pairs = _to_one(keys, links, placed).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            pairs = likely(pairs, nodes, similarity, deviations)
        if turn == "any":  # the nearest of them will do
            pairs = pairs.groupBy("u").agg(F.min(F.struct("apart", "v")).alias("best")).select("u", F.col("best.v").alias("v"))
        if links is not None:
            pairs = pairs.join(links, ["u", "v"], "left_anti")
        pairs = written(pairs.select("u", "v"), "pairs")
        asked = pairs.select(F.explode(F.array("u", "v")).alias("node"))
        asked = (asked.unionByName(dealt.select("node")) if turn == "all" else asked).distinct()
        asked = asked if sets is None else asked.join(sets.select("node"), "node", "left_anti")
        new = written(shingle_sets(df, nodes.select("doc_id", "node").join(asked, "node", "left_semi"), words), "shingles")
        sets = new if sets is None else sets.unionByName(new)
        new = similar(pairs, sets, similarity)
        if turn == "all":
            new = new.unionByName(crowd_links(dealt, sets, similarity)).distinct()
        if links is None and known is not None:
            new = new.unionByName(_told(known, found)).distinct()
        links = written(new if links is None else links.unionByName(new), "links")

    in_class = nodes.select("node", "doc_id").join(components(links), "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("c"))
    least = in_class.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of_node = in_class.join(least, "c").select("node", F.col("c").alias("class_id"), "component_id")
    return found.select("doc_id", "text_hash", "node").join(of_node, "node").select("doc_id", "text_hash", "class_id", "component_id")


def without_duplicates(df: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, known: DataFrame | None = None) -> DataFrame:
    """One row of each class, with all columns of ``df``: that of the least doc_id. Rows without a doc_id stay.

    Rows of one doc_id with different texts are rows of their own. Only doc_ids and hashes are joined to the texts.
    """
    return one_of_each(df, classes(df, words, similarity, known=known))


def one_of_each(df: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``df`` that are the first of their class in ``judged`` (doc_id, text_hash, class_id)."""
    judged = judged.groupBy("doc_id", "text_hash").agg(F.first("class_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    judged = written(judged, "judged")
    first = judged.groupBy("class_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    dropped = judged.join(first, ["doc_id", "text_hash"], "left_anti")
    dropped = dropped.select(F.col("doc_id").alias("__judged_id"), F.col("text_hash").alias("__judged_hash"))
    same = (F.col("doc_id") == F.col("__judged_id")) & (F.xxhash64("text") == F.col("__judged_hash"))
    kept = df.join(dropped, same, "left_anti")
    repeated = judged.filter("n > 1").select(F.col("doc_id").alias("__judged_id"), F.col("text_hash").alias("__judged_hash"))
    if repeated.isEmpty():
        return kept
    first = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, same, "left_anti").unionByName(first)
