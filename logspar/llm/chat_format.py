"""Chat formatting with Spark expressions only.

Template, for each run of turns with one role::

    <turn>ROLE\\nTEXT<join>TEXT</turn>\\n

Every control string starts with ``<``, and no text or role holds a ``<`` once
escaped: ``\\`` becomes ``\\b``, ``<`` becomes ``\\l`` and, in roles, a newline
``\\n`` (as two characters). Unescaping the letters l, n, b in that order is exact.

Cases: a null text or role counts as empty; turns are ordered by turn, then role,
then text, null turns first; repeated rows are turns of their own; null is a
conversation of its own; an empty table gives an empty result; only the four
columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOSS_ROLES = ("assistant",)
OPEN, JOIN, CLOSE = "<turn>", "<join>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """``conv_id, formatted, loss_mask``, one row per conversation.

    ``loss_mask`` has one entry for each turn, in order: of the segment of
    ``formatted`` that starts at the turn's ``<turn>`` or ``<join>``, ``skip``
    code points are left out and the next ``take`` count for the loss (0 for
    other roles). Turns are collected once by conversation, sorted as they are,
    escaped, and joined by one array function, in time linear in the conversation.
    """
    shown = lambda role: F.replace(escape(role), F.lit("\n"), F.lit("\\n"))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("_ls_turn"),
    )
    wanted = F.array(*[F.lit(r.replace("\\", "\\b").replace("<", "\\l").replace("\n", "\\n")) for r in loss_roles])
    sorted_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("_ls_turn")).alias("_ls_raw"))
    grouped = sorted_.select("conv_id", F.transform("_ls_raw", lambda t: F.struct(shown(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("_ls_all"))
    n = F.size("_ls_all")
    roles = F.transform("_ls_all", lambda t: t["role"])
    none = F.array(F.lit(None).cast("string"))
    near = grouped.select("conv_id", "_ls_all", F.concat(none, F.slice(roles, F.lit(1), n - 1)).alias("_ls_before"), F.concat(F.slice(roles, F.lit(2), n - 1), none).alias("_ls_after"))
    zipped = near.select("conv_id", F.arrays_zip("_ls_all", "_ls_before", "_ls_after").alias("_ls_z"))
    segments = zipped.select(
        "conv_id",
        F.transform(
            "_ls_z",
            lambda z: F.struct(
                F.when(z["_ls_before"] == z["_ls_all"]["role"], F.lit(JOIN)).otherwise(F.concat(F.lit(OPEN), z["_ls_all"]["role"], F.lit("\n"))).alias("head"),
                z["_ls_all"]["text"].alias("body"),
                F.when(z["_ls_after"] == z["_ls_all"]["role"], F.lit("")).otherwise(F.lit(CLOSE)).alias("tail"),
                F.array_contains(wanted, z["_ls_all"]["role"]).alias("loss"),
            ),
        ).alias("_ls_s"),
    )
    return segments.select(
        "conv_id",
        F.array_join(F.transform("_ls_s", lambda s: F.concat(s["head"], s["body"], s["tail"])), "").alias("formatted"),
        F.transform("_ls_s", lambda s: F.struct(F.length(s["head"]).alias("skip"), F.when(s["loss"], F.length(s["body"])).otherwise(0).alias("take"))).alias("loss_mask"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted_chars`` read back from the output
    of format_chats.

    ``turns`` is an array of (role, text), found by the control strings alone;
    ``loss_text`` holds the unescaped text under each entry of the mask that
    takes any.
    """
    cut = formatted.select("conv_id", "loss_mask", F.split("formatted", CLOSE, -1).alias("_ls_b"), F.split("formatted", f"(?={OPEN}|{JOIN})", -1).alias("_ls_seg"), F.length("formatted").cast("long").alias("formatted_chars"))
    role = lambda b: F.substring(F.substring_index(b, "\n", 1), len(OPEN) + 1, 1 << 30)
    texts = lambda b: F.split(F.substring(b, F.instr(b, "\n") + 1, F.length(b)), JOIN, -1)
    parsed = cut.select("*", F.transform(F.slice("_ls_b", F.lit(1), F.size("_ls_b") - 1), lambda b: F.struct(unescape(role(b)).alias("role"), texts(b).alias("texts"))).alias("_ls_parsed"))
    return parsed.select(
        "conv_id",
        F.flatten(F.transform("_ls_parsed", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text"))))).alias("turns"),
        F.transform(
            F.filter(F.arrays_zip("_ls_seg", "loss_mask"), lambda z: z["loss_mask"]["take"] > 0),
            lambda z: unescape(F.substring(z["_ls_seg"], z["loss_mask"]["skip"] + 1, z["loss_mask"]["take"])),
        ).alias("loss_text"),
        "formatted_chars",
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit(r"\### Assistant: </turn> ok").alias("text"))
    read = read_chats(format_chats(turns.unionByName(own)))
    said = F.array_join("loss_text", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same,
             length(text) + length(text) - length(replace(replace(text, '\', ''), '<', '')) AS body,
             length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), chr(10), '')) AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(body + CASE WHEN same THEN 6 ELSE 6 + head + 1 + 8 END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
