"""Chat formatting with Spark expressions only.

Turn structs are collected and sorted for each conversation, neighbours of one
role are merged by an array aggregation, and blocks are concatenated:

    <s>[ROLE] user [/ROLE]text<+>text</s>

``<+>`` parts the turns merged into one block, so nothing is lost. Texts and
roles are escaped: ``&``, ``<`` and ``[`` become ``&amp;``, ``&lt;`` and
``&lb;``. No control string can then occur inside a text, and unescaping gives
the text back. The loss mask covers the texts of the assistant.

Defined results: null text and null role count as empty; a null turn sorts
first; ties of turn sort by role, then text; rows that repeat are turns of their
own; an empty table gives no rows (the query adds conversation -1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, ROLE_END, END, MORE = "<s>[ROLE] ", " [/ROLE]", "</s>", "<+>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lb;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lb;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id and ``formatted``, one row per conversation."""
    text = escape(F.coalesce("text", F.lit("")))
    role = escape(F.coalesce("role", F.lit("")))
    turns = conversations.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    kind = "array<struct<role:string,texts:array<string>>>"

    def add(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        new = F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts")))
        joined = F.array(F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts")))
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), joined)).otherwise(F.concat(blocks, new))

    merged = chats.select("conv_id", F.aggregate("turns", F.array().cast(kind), add).alias("blocks"))
    block = lambda b: F.concat(F.lit(START), b["role"], F.lit(ROLE_END), F.array_join(b["texts"], MORE), F.lit(END))
    return merged.select("conv_id", F.array_join(F.transform("blocks", block), "").alias("formatted"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Back to ``turns``, an array of (role, text), read from the formatted string alone."""
    blocks = F.slice(F.split("formatted", r"<s>\[ROLE\] "), 2, 1 << 30)
    part = lambda b: F.split(b, r" \[/ROLE\]")
    body = lambda b: F.regexp_replace(F.element_at(part(b), 2), "</s>$", "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(body(b), r"<\+>"),
                lambda x: F.struct(unescape(F.element_at(part(b), 1)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )
    return formatted.withColumn("turns", turns)


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: each text of ``role`` once, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def digests(formatted: DataFrame) -> DataFrame:
    read = read_chats(formatted)
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("turns"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;') AS et,
    replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;') AS er,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS same
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length(et) + CASE WHEN same THEN 3 ELSE length(er) + 22 END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
