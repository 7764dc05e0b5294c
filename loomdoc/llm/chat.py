"""Chat formatting in Spark expressions: sort the turns, merge same-role neighbours, concatenate.

A conversation's output is ``<s>`` + blocks + ``</s>``; a block is ``[ROLE]role[/ROLE]`` + its texts joined by
``[TURN]`` + ``[/END]``. In roles and texts every ``\\`` is doubled, and then every ``[`` and ``<`` gets a ``\\`` behind
it. All control strings start with ``[`` or ``<`` and have no ``\\`` there, so no text can hold one, and reading back is
exact. The loss mask is a list of spans (first character from 1, length) over the output: the assistant's texts.

Edge cases: a null text is empty, a null role is the role ``""``, rows of null conv_id are one conversation. Rows that
tie on turn are ordered by role, then text; repeated rows are all kept. An empty table gives an empty result. Extra
columns are not carried. A conversation's output is one value, so its turns meet in one row: that is what the result
demands, as the digest of all turns needs them in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.tables import load

QUERY = "op8_chat"

BEGIN, END = "<s>", "</s>"
ROLE, ROLE_END, NEXT, BLOCK_END = "[ROLE]", "[/ROLE]", "[TURN]", "[/END]"
#: The text of both turns of conversation -1, which the contract adds.
EXTRA_TEXT = "</s>[INST] ok [/INST]"
LEARNED_ROLE = "assistant"


def escape(c: Column) -> Column:
    for mark, held in (("\\", "\\\\"), ("[", "[\\"), ("<", "<\\")):
        c = F.replace(c, F.lit(mark), F.lit(held))
    return c


def unescape(c: Column) -> Column:
    for held, mark in (("<\\", "<"), ("[\\", "["), ("\\\\", "\\")):
        c = F.replace(c, F.lit(held), F.lit(mark))
    return c


def blocks_of(turns: Column) -> Column:
    """Sorted (turn, role, text) structs as (role, texts) structs, one for each run of turns of the same role."""
    n = F.size(turns)
    opens = lambda i: (i == 0) | (turns[i]["role"] != F.get(turns, i - 1)["role"])
    firsts = F.filter(F.sequence(F.lit(0), n - 1), opens)
    until = F.concat(F.slice(firsts, F.lit(2), F.greatest(F.size(firsts) - 1, F.lit(0))), F.array(n))
    run = lambda first, end: F.struct(
        turns[first]["role"].alias("role"),
        F.transform(F.slice(turns, first + 1, end - first), lambda t: t["text"]).alias("texts"),
    )
    return F.zip_with(firsts, until, run)


def pieces_of(blocks: Column) -> Column:
    """A (head, body, tail, learned) struct for each turn; they concatenate to the blocks' output."""

    def of_block(block: Column) -> Column:
        opening = F.concat(F.lit(ROLE), escape(block["role"]), F.lit(ROLE_END))
        return F.transform(
            block["texts"],
            lambda text, i: F.struct(
                F.when(i == 0, opening).otherwise(F.lit(NEXT)).alias("head"),
                escape(text).alias("body"),
                F.when(i == F.size(block["texts"]) - 1, F.lit(BLOCK_END)).otherwise(F.lit("")).alias("tail"),
                (block["role"] == LEARNED_ROLE).alias("learned"),
            ),
        )

    return F.flatten(F.transform(blocks, of_block))


#: Numbers summed one by one; their sums are summed before.
CHUNK = 256


def starts_of(lengths: Column, first: int) -> Column:
    """Where pieces of these lengths start, the first one at ``first``. A fold over an array copies what it has at each step,
    so it goes over chunks, and over their sums: work grows with n * CHUNK, not n * n."""

    def running(numbers: Column, start: Column) -> Column:
        ends = F.aggregate(numbers, F.array(start), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
        return F.slice(ends, F.lit(1), F.size(numbers))

    at = F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(CHUNK))
    chunks = F.transform(at, lambda i: F.slice(lengths, i, F.lit(CHUNK)))
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(chunks, running(sums, F.lit(first)), running))


def format_conversations(df: DataFrame) -> DataFrame:
    """conv_id, formatted text and loss_spans for rows of (conv_id, turn, role, text). One shuffle, on conv_id."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = df.select(F.col("conv_id"), turn.alias("turn"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    rows = rows.select("conv_id", pieces_of(blocks_of(F.col("turns"))).alias("pieces"))
    join = lambda p: F.concat(p["head"], p["body"], p["tail"])
    lengths = F.transform("pieces", lambda p: F.length(join(p)))
    rows = rows.select("conv_id", "pieces", starts_of(lengths, len(BEGIN) + 1).alias("starts"))
    spans = F.zip_with(
        F.col("pieces"),
        F.col("starts"),
        lambda p, start: F.when(
            p["learned"], F.struct((start + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))
        ),
    )
    return rows.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join(F.transform("pieces", join), ""), F.lit(END)).alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs of an output, unescaped."""
    inner = F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted) - len(BEGIN) - len(END))
    blocks = F.filter(F.split(inner, r"\[/END\]", -1), lambda b: b != "")

    def of_block(block: Column) -> Column:
        role = unescape(F.substring(F.split_part(block, F.lit(ROLE_END), F.lit(1)), F.lit(len(ROLE) + 1), F.length(block)))
        texts = F.split(F.split_part(block, F.lit(ROLE_END), F.lit(2)), r"\[TURN\]", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of_block))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", EXTRA_TEXT), (-1, 1, LEARNED_ROLE, EXTRA_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    out = format_conversations(rows.unionByName(extra))
    learned = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"])))
    out = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(learned, "").alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_length(c: str) -> str:
    return f"(2 * length({c}) - length(replace(replace(replace({c}, '\\', ''), '[', ''), '<', '')))"


SQL = f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT -1, 1, '{LEARNED_ROLE}', '{EXTRA_TEXT}'),
marked AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens FROM every)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNED_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
  CAST({len(BEGIN + END)} + sum({_escaped_length("text")}
    + CASE WHEN opens THEN {len(ROLE + ROLE_END + BLOCK_END)} + {_escaped_length("role")} ELSE {len(NEXT)} END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
