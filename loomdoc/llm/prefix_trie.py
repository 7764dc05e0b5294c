"""Tries of conversations by their turns: what prefixes they share, and what a cache of prefixes would save.

A turn is a token of 20 bytes: 16 of a SHA-256 of its role and text, and the text's code points as 4. A conversation is its
*path*, the tokens of its turns one after another, so texts are read once and never shuffled, and a prefix of d turns is the
first 20 * d bytes. Equal paths are one row with their number, their least conv_id and a digest of all their ids.

The distinct paths are dealt by their first turn. Each task builds the tries of its share in dictionaries of pointers and
sums them up from the leaves without recursion (:func:`grow`). A subtrie with more turns than one task should hold is not
given to a task: its paths go on to the next round, dealt by the turn behind the longest prefix they share, so a round always
parts them. The shared prefix itself is a *chain* of nodes, whose figures are sums over the subtries below, by joins from
the last round to the first. So no group is ever larger than ``most_turns``, but for what one hash bucket happens to gather.

Ids of equal paths are gathered in blocks of 65,536 neighbouring ids, and a digest reads its blocks in order as a stream:
however many conversations are the same, no row or task holds them all.

Edge cases: a null role or text is empty; turns are in order of turn, nulls first, and those that tie by role, then by their
token, so repeated rows are turns each; rows without a conv_id belong to no conversation and are left out; an empty table has no
conversations, hence no root, and gives no rows; a long text is a token as any other; other columns are not read. A
conversation is one row of 20 bytes a turn: it isn't split over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.llm.shared import written
from loomdoc.tables import load

QUERY = "op11_prefix_trie"

#: Bytes of a token, and of its digest.
WIDTH, DIGEST = 20, 16
#: Turns of a subtrie that one task may hold, and turns that are never worth dealing out again.
MOST_TURNS, LEAST_TURNS = 50_000, 256
#: conv_ids of a block are those that differ in these low bits alone.
BLOCK_BITS = 16
NO_IDS = hashlib.sha256(b"").hexdigest()
#: Conversations that share a donor, and turns that may come from it.
FAMILY, HEADS = 100, 6

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: ``top`` is the chain that a node hangs from; null for nodes with a parent in their own trie.
GROWN = f"{NODES}, top binary"


def token(role: Column, text: Column) -> Column:
    """A turn's 20 bytes."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return F.concat(F.substring(digest, 1, DIGEST), F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))


def paths(conversations: DataFrame, family: Column) -> DataFrame:
    """(family, conv_id, path) of each conversation. ``family`` is a function of conv_id; rows are dealt by it."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), token(F.col("role"), F.col("text")).alias("token"))
    rows = conversations.filter("conv_id IS NOT NULL").select(family.alias("family"), F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    sorted_turns = F.sort_array(F.collect_list("turn"))
    told = F.unhex(F.array_join(F.transform(sorted_turns, lambda t: F.hex(t["token"])), ""))
    return rows.repartition("family").groupBy("family", "conv_id").agg(told.alias("path"))


def own_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of conversations as they are."""
    return paths(conversations, F.col("conv_id").cast("long")).select("conv_id", "path")


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of conversations whose first turns are their donor's: those of conv_id - conv_id % 100."""
    donor = F.col("conv_id") - F.col("conv_id") % FAMILY
    rows = paths(conversations, donor)
    first = F.max(F.when(F.col("conv_id") == F.col("family"), F.substring("path", 1, WIDTH * (HEADS - 1)))).over(Window.partitionBy("family"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % HEADS * WIDTH).cast("int")
    rest = F.substring("path", taken + 1, F.octet_length("path"))
    return rows.select("conv_id", F.concat(F.coalesce(F.substring(first, F.lit(1), taken), F.lit(b"")), rest).alias("path"))


def prefix(depth: Column) -> Column:
    return F.substring("path", F.lit(1), (depth * WIDTH).cast("int"))


def name(path: Column) -> Column:
    """What a prefix is called in joins."""
    return F.substring(F.unhex(F.sha2(path, 256)), 1, DIGEST)


def distinct_paths(convs: DataFrame) -> DataFrame:
    """(path, n, least, ends): equal paths once. A task combines the ids it has of a block before they are shuffled."""
    blocks = convs.groupBy("path", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, least, digest = None, 0, 0, None
        for batch in batches:
            done = []
            for p, ids in zip(batch["path"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                text = ",".join(map(str, ids)).encode()
                if p == path:
                    digest.update(b"," + text)
                    n += len(ids)
                    continue
                if path is not None:
                    done.append((path, n, least, digest.hexdigest()))
                path, n, least, digest = p, len(ids), ids[0], hashlib.sha256(text)
            yield _rows(done)
        if path is not None:
            yield _rows([(path, n, least, digest.hexdigest())])

    return blocks.repartition("path").sortWithinPartitions("path", "block").mapInArrow(told, "path binary, n long, least long, ends string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "n", "least", "ends"])


def grow(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the subtries of ``rows`` (chain, up, depth, path, n, least, ends), by dictionaries of pointers.

    A row's subtrie starts at its ``depth``, below the chain of that name, whose nodes have the conv_id ``up``.
    """
    child: list[dict[bytes, int]] = []
    above, at, chars, n, least, ends = [], [], [], [], [], []
    tops: dict[bytes, int] = {}
    hung: list[tuple[int, bytes, int]] = []  # tops with their chain and its conv_id

    def node(parent: int, depth: int, mark: bytes) -> int:
        child.append({})
        for column, value in ((above, parent), (at, depth), (chars, int.from_bytes(mark[DIGEST:], "big")), (n, 0), (least, None), (ends, NO_IDS)):
            column.append(value)
        return len(child) - 1

    columns = (rows[c].tolist() for c in ("chain", "up", "depth", "path", "n", "least", "ends"))
    for chain, up, depth, path, times, conv, told in zip(*columns, strict=True):
        first = bytes(path[: WIDTH * depth])
        here = tops.get(first)
        if here is None:
            here = tops[first] = node(-1, depth, first[-WIDTH:])
            hung.append((here, chain, up))
        for i in range(WIDTH * depth, len(path), WIDTH):
            mark = bytes(path[i : i + WIDTH])
            below = child[here].get(mark)
            if below is None:
                below = child[here][mark] = node(here, i // WIDTH + 1, mark)
            here = below
        n[here] += times
        least[here] = conv if least[here] is None else min(conv, least[here])
        ends[here] = told
    leaves, saved = [0] * len(child), [0] * len(child)
    for here in range(len(child) - 1, -1, -1):  # a node is made after its parent: this is a postorder of the pointers
        leaves[here] = leaves[here] or 1
        saved[here] += (n[here] - 1) * chars[here]
        parent = above[here]
        if parent >= 0:
            n[parent] += n[here]
            leaves[parent] += leaves[here]
            saved[parent] += saved[here]
            least[parent] = least[here] if least[parent] is None else min(least[parent], least[here])
    parents, top = [None if p < 0 else least[p] for p in above], [None] * len(child)
    for here, chain, up in hung:
        parents[here], top[here] = up, bytes(chain)
    out = pd.DataFrame({"conv_id": least, "depth": at, "parent_conv_id": pd.array(parents, "Int64"), "n_convs": n, "n_children": [len(c) for c in child]})
    return out.assign(n_leaves=leaves, saved_tokens=saved, ends_sha256=ends, top=top)


def shared_length(low: bytes, high: bytes) -> int:
    """Tokens that two paths begin with."""
    a, b = (np.frombuffer(x[: min(len(low), len(high)) // WIDTH * WIDTH], np.uint8) for x in (low, high))
    wrong = np.flatnonzero(a != b)
    return int(wrong[0] if len(wrong) else len(a)) // WIDTH


def chains_of(groups: DataFrame) -> DataFrame:
    """Large subtries as chains (name, top, up, depth, last, conv_id, n_convs, path, ends): nodes from ``depth`` to ``last``.

    The least path and the greatest share what all share, and a path that ends there is the least itself.
    """

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            last = [shared_length(a, b) for a, b in zip(f["low"], f["high"], strict=True)]
            ends = [e if len(a) == WIDTH * k else None for a, e, k in zip(f["low"], f["ends"], last, strict=True)]
            path = [a[: WIDTH * k] for a, k in zip(f["low"], last, strict=True)]
            yield f.assign(last=last, ends=ends, path=path)[["group", "top", "up", "depth", "last", "conv_id", "n_convs", "path", "ends"]]

    bounds = groups.groupBy("group").agg(
        F.min(F.struct("path", "ends")).alias("first"), F.max("path").alias("high"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"),
        F.first("chain").alias("top"), F.first("up").alias("up"), F.first("depth").alias("depth"),
    )
    bounds = bounds.select("group", "top", "up", "depth", "conv_id", "n_convs", "high", F.col("first.path").alias("low"), F.col("first.ends").alias("ends"))
    found = bounds.mapInPandas(measured, "group binary, top binary, up long, depth long, last long, conv_id long, n_convs long, path binary, ends string")
    return found.withColumn("name", name(F.col("path")))


def deal(spark: SparkSession, distinct: DataFrame, most_turns: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows for :func:`grow`, and chains, both by round. ``distinct`` is read twice a round."""
    root = distinct.agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(F.octet_length("path") == 0, F.col("ends"))).alias("ends"))
    empty = F.lit(b"")
    root = root.filter("conv_id IS NOT NULL").select(
        name(empty).alias("group"), F.lit(None).cast("binary").alias("top"), F.lit(None).cast("long").alias("up"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("last"), "conv_id", "n_convs", empty.alias("path"), "ends", name(empty).alias("name"),
    )
    chains = [written(root, "trie-chains")]
    rows = distinct.withColumn("group", name(empty))
    small = []
    while True:
        on = chains[-1].select("group", F.col("name").alias("chain"), F.col("conv_id").alias("up"), (F.col("last") + 1).alias("depth"))
        below = rows.select("group", "path", "n", "least", "ends").join(on, "group").filter(F.octet_length("path") >= F.col("depth") * WIDTH)
        below = written(below.withColumn("group", name(prefix(F.col("depth")))), "trie-rows")
        turns = F.sum(F.octet_length("path") / WIDTH - F.col("depth") + 1)
        large = written(below.groupBy("group").agg(turns.alias("turns")).filter(F.col("turns") > most_turns).select("group"), "trie-large")
        if large.isEmpty():
            return [*small, below], chains
        small.append(below.join(large, "group", "left_anti"))
        rows = written(below.join(large, "group", "left_semi"), "trie-large-rows")
        chains.append(written(chains_of(rows), "trie-chains"))


def chain_nodes(chains: DataFrame) -> DataFrame:
    """The nodes of chains with their figures (n_children, n_leaves, saved_tokens of their last one's subtries)."""

    def nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c in f.itertuples(index=False):
                k = c.last - c.depth + 1
                marks = np.frombuffer(b"\0" * WIDTH + bytes(c.path), np.uint8).reshape(-1, WIDTH)[c.depth :, DIGEST:]
                chars = marks.copy().view(">u4").ravel().astype(np.int64)
                yield pd.DataFrame({
                    "conv_id": c.conv_id,
                    "depth": np.arange(c.depth, c.last + 1),
                    "parent_conv_id": pd.array([None if pd.isna(c.up) else int(c.up)] + [c.conv_id] * (k - 1), "Int64"),
                    "n_convs": c.n_convs,
                    "n_children": [1] * (k - 1) + [c.n_children],
                    "n_leaves": c.n_leaves,
                    "saved_tokens": c.below + (c.n_convs - 1) * np.cumsum(chars[::-1])[::-1],
                    "ends_sha256": [NO_IDS] * (k - 1) + [c.ends or NO_IDS],
                    "top": pd.array([None if c.top is None else bytes(c.top)] + [None] * (k - 1), object),
                })

    return chains.mapInPandas(nodes, GROWN)


def trie(convs: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """A row for each node of the trie of ``convs`` (conv_id, path): see ``NODES``."""
    spark = convs.sparkSession
    distinct = written(distinct_paths(convs), "trie-paths")
    total = distinct.agg(F.sum(F.octet_length("path"))).first()[0] or 0
    turns, tasks = total // WIDTH, int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = min(most_turns, max(LEAST_TURNS, turns // tasks))
    small, chains = deal(spark, distinct, most)
    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    buckets = max(tasks, turns // most_turns)
    grown = written(rows.withColumn("bucket", F.pmod(F.hash("group"), F.lit(buckets))).groupBy("bucket").applyInPandas(grow, GROWN), "trie-nodes")
    parts = [grown]
    for chain in reversed(chains):
        tops = parts[0].filter("top IS NOT NULL") if len(parts) == 1 else parts[0].filter("top IS NOT NULL").unionByName(parts[-1].filter("top IS NOT NULL"))
        sums = tops.groupBy(F.col("top").alias("name")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        told = chain.join(sums, "name", "left").fillna(0, ["n_children", "below"]).fillna(1, ["n_leaves"])
        parts.append(written(chain_nodes(told), "trie-chain-nodes"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("top")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt_paths(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


#: The crc32 of a decimal number, byte by byte, by the table of its 256 remainders.
SQL = f"""
WITH bytes AS (
  SELECT list(CAST(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS BIGINT) ORDER BY n) AS rest
  FROM range(256) r(n)),
ids AS (
  SELECT DISTINCT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, rest[1 + (xor(c, b) & 255)])), 4294967295) % {HEADS} AS h
  FROM conversations, bytes WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS d,
    length(coalesce(text, '')) AS chars, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT i.conv_id, t.d, t.chars, t.t FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % {FAMILY} AND t.d <= i.h
  UNION ALL SELECT i.conv_id, t.d, t.chars, t.t FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.d > i.h),
placed AS (SELECT conv_id, chars, t, row_number() OVER (PARTITION BY conv_id ORDER BY d) AS d FROM rebuilt),
members AS (
  SELECT conv_id, d, chars, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
lasts AS (SELECT conv_id, max(d) AS d FROM members GROUP BY conv_id),
nodes AS (
  SELECT m.path, any_value(m.d) AS depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(m.chars) AS chars,
    sha256(coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (m.d = l.d), '')) AS ends_sha256
  FROM members m JOIN lasts l USING (conv_id) GROUP BY m.path),
kids AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
told AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
sums AS (
  SELECT left(path, 64 * up) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM told) GROUP BY 1)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, CAST(t.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, t.ends_sha256
FROM told t JOIN sums s USING (path) LEFT JOIN nodes p ON t.depth > 0 AND p.path = left(t.path, length(t.path) - 64)
"""
