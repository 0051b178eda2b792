"""Chat formatting by relational operations, all in Spark expressions.

A conversation's turn structs are collected and sorted, adjacent turns of one role are merged by an
array aggregation, and the formatted text is a concatenation. The template is

    <s>[INST] question [/INST] <s>answer</s>[INST] ...      system turns: [SYS] text [/SYS]
    other roles: [ROLE name in hex] text [/ROLE]            turns merged into one block: text[+]text

Every ``[`` of a text becomes ``[[]``, every ``<s>`` ``<[s]s>`` and every ``</s>`` ``<[s]/s>``, so no control
string can occur inside a text and the escape is undone exactly. ``parse`` reads turns, roles and the
loss mask (answers, without the marks between merged ones) back from the formatted text alone.

Defined results: null text counts as empty, a null role as the empty role; rows of a null conversation
id form one conversation; rows of equal turn are ordered by role and text, rows without turn come
first; repeated rows are repeated turns; an empty table has no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

BEGIN, END, JOIN = "<s>", "</s>", "[+]"
#: Role -> what stands before and after a block's text.
MARKS = {"user": ("[INST] ", " [/INST] "), "assistant": (BEGIN, END), "system": ("[SYS] ", " [/SYS] ")}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("["), F.lit("[[]"))
    return F.replace(F.replace(out, F.lit(END), F.lit("<[s]/s>")), F.lit(BEGIN), F.lit("<[s]s>"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("<[s]s>"), F.lit(BEGIN)), F.lit("<[s]/s>"), F.lit(END))
    return F.replace(out, F.lit("[[]"), F.lit("["))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted) of rows (conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    role_at = lambda i: F.get("turns", i)["role"]
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))

    def merged(first: Column, k: Column) -> Column:
        beyond = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        texts = F.transform(F.slice("turns", first + 1, beyond - first), lambda t: escape(t["text"]))
        return F.struct(role_at(first).alias("role"), F.array_join(texts, JOIN).alias("text"))

    def block(b: Column) -> Column:
        text = b["text"]
        made = F.concat(F.lit("[ROLE "), F.hex(b["role"]), F.lit("] "), text, F.lit(" [/ROLE]"))
        for role, (before, after) in MARKS.items():
            made = F.when(b["role"] == role, F.concat(F.lit(before), text, F.lit(after))).otherwise(made)
        return made

    blocks = F.transform("starts", merged)
    return turns.withColumn("starts", starts).select("conv_id", F.concat(F.lit(BEGIN), F.array_join(F.transform(blocks, block), "")).alias("formatted"))


def parse(formatted: DataFrame, column: str = "formatted") -> DataFrame:
    """Adds turns array<struct<role, text>>, read back from the formatted text, and loss, the text under its loss mask."""
    begun = F.substring(F.col(column), len(BEGIN) + 1, 2_000_000_000)
    pieces = F.split(begun, r"(?=<s>)|(?<=</s>)|(?=\[INST\] )|(?<= \[/INST\] )|(?=\[SYS\] )|(?<= \[/SYS\] )|(?=\[ROLE )|(?<= \[/ROLE\])")

    def inner(x: Column, before: str, after: str) -> Column:
        return F.substring(x, F.lit(len(before) + 1), F.length(x) - len(before) - len(after))

    def block(x: Column) -> Column:
        head = F.substring_index(F.substring(x, F.lit(7), F.length(x)), "] ", 1)
        role, text = F.decode(F.unhex(head), "UTF-8"), F.substring(x, F.length(head) + 9, F.length(x) - F.length(head) - 8 - len(" [/ROLE]"))
        for name, (before, after) in MARKS.items():
            role = F.when(x.startswith(before), F.lit(name)).otherwise(role)
            text = F.when(x.startswith(before), inner(x, before, after)).otherwise(text)
        return F.transform(F.split(text, r"\[\+\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    turns = F.flatten(F.transform(F.filter(pieces, lambda x: x != ""), block))
    out = formatted.withColumn("turns", turns)
    return out.withColumn("loss", F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), ""))


TRICKY = f"{END}[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    read = parse(format_conversations(rows.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{TRICKY}'), (-7, 1, 'assistant', '{TRICKY}')
), e AS (
  SELECT *, length(replace(replace(replace(text, '[', '[[]'), '</s>', '<[s]/s>'), '<s>', '<[s]s>')) AS n,
    role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS merged
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + CASE WHEN merged THEN 3 WHEN role = 'user' THEN 16 WHEN role = 'assistant' THEN 7
    WHEN role = 'system' THEN 14 ELSE 16 + 2 * strlen(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
