"""Relational chat formatting, in Spark expressions only.

A conversation's turn structs are collected and sorted, adjacent turns of one role are merged into a
block, and blocks are concatenated:

    ### user: text</turn>            a block of one turn
    ### assistant: text<and>text</turn>   a block of two merged turns

Inside roles and texts the escape character and whatever could begin a control string are escaped (FIXED below),
so the control strings occur only where the template puts them and the original turns can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, AND, END = "### ", ": ", "<and>", "</turn>\n"
#: What stands for a character that could begin a control string. No code begins inside another, so they can be undone one after the other.
ESCAPES = {"\\": "\\b", "<": "\\l", "#": "\\h"}
ROLE_ESCAPES = ESCAPES | {":": "\\c"}


def escape(c: Column, codes: dict[str, str] = ESCAPES) -> Column:
    for raw, code in codes.items():
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column, codes: dict[str, str] = ESCAPES) -> Column:
    for raw, code in reversed(codes.items()):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def _concat(parts: Column) -> Column:
    return F.array_join(parts, "")


def format_chats(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", train_role: str = "assistant") -> DataFrame:
    """For each conversation: key, formatted, and loss, the mask: the spans of formatted (start, length, in code points) to learn from, in order, which are
    the escaped texts of train_role.

    A null text or role counts as empty. Turns of equal (or null: first) number are ordered by role and text, and repeated rows are
    turns of their own. A null key is a conversation; an empty table gives none. Other columns are not read. A
    conversation is one row of the result, so it has to fit in a task.
    """
    rows = df.select(F.col(key).alias(key), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    block = F.transform("begins", lambda b, j: F.slice("turns", b + 1, F.coalesce(F.get("begins", j + 1), F.size("turns")) - b))

    def segments(b: Column) -> Column:
        own = F.get(b, F.lit(0))["role"]
        learn = own == train_role
        head = F.struct(F.concat(F.lit(HEAD), escape(own, ROLE_ESCAPES), F.lit(COLON)).alias("text"), F.lit(False).alias("loss"))
        body = F.flatten(F.transform(b, lambda t, i: F.concat(F.when(i > 0, F.array(F.struct(F.lit(AND).alias("text"), F.lit(False).alias("loss")))).otherwise(F.array().cast("array<struct<text:string,loss:boolean>>")), F.array(F.struct(escape(t["text"]).alias("text"), learn.alias("loss"))))))
        return F.concat(F.array(head), body, F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))))

    made = turns.withColumn("begins", begins).withColumn("blocks", block).withColumn("segments", F.flatten(F.transform("blocks", segments)))
    # Where each segment begins is summed up over lengths alone: an array that grew with the sum would be copied for each turn.
    sizes = F.transform("segments", lambda s: F.struct(F.length(s["text"]).cast("long").alias("length"), s["loss"].alias("loss")))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    runs = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        span = F.struct(acc["at"].alias("start"), s["length"].alias("length"))
        return F.struct((acc["at"] + s["length"]).alias("at"), F.when(s["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    loss = F.aggregate(sizes, runs, step, lambda acc: acc["spans"])
    return made.select(key, _concat(F.transform("segments", lambda s: s["text"])).alias("formatted"), loss.alias("loss"))


def read_chats(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """What format_chats made, read back from formatted: key, turns (role and text of each, unescaped) and loss_text (unescaped, cut out by the spans of the mask)."""
    blocks = F.transform(F.filter(F.split("formatted", F.lit(END)), lambda b: b != ""), lambda b: F.struct(F.substring_index(F.substr(b, F.lit(len(HEAD) + 1)), COLON, 1).alias("role"), b.alias("raw")))
    texts = lambda b: F.split(F.substr(b["raw"], F.length(b["role"]) + F.lit(len(HEAD) + len(COLON) + 1)), F.lit(AND))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(unescape(b["role"], ROLE_ESCAPES).alias("role"), unescape(t).alias("text")))))
    loss = _concat(F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    return df.select(key, "formatted", turns.alias("turns"), loss.alias("loss_text"))


def chat_digests(df: DataFrame, key: str = "conv_id", **columns: str) -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: figures of the formatted conversations, read back."""
    back = read_chats(format_chats(df, key, **columns), key)
    listed = _concat(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    size = lambda c: F.length(c).cast("long")
    return back.select(key, F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), size("loss_text").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), size("formatted").alias("formatted_chars"))


#: DuckDB: a block's head, its texts and its end are counted and joined without building segments.
DIGESTS_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
    SELECT *, lag(role) OVER w IS DISTINCT FROM role AS fresh FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(regexp_replace(text, '[\\<#]', 'xx', 'g')) + CASE WHEN fresh THEN 14 + length(regexp_replace(role, '[\\<#:]', 'xx', 'g')) ELSE 5 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
