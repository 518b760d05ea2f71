"""Chat formatting of typed content parts. DataFrame expressions only.

A conversation becomes one text::

    <|turn|>role<|body|>content<|end|><|turn|>...

A visitor flattens the parts of a turn in order: texts are escaped, images,
audio and documents become placeholders, and what they refer to is recorded with
the number of tokens that the placeholder will expand to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|attachment|>"
#: Tokens that a unit of each kind expands to: a tile, a second, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
LEARNED_ROLE = "assistant"
#: Strings that a model's tokenizer may take for control: any <|name|>, and the marks of older templates.
_CONTROL = r"\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>"
#: An escape is one backslash more after the opening bracket, so that it can be taken away again whatever the text has there.
ESCAPE = (rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")
UNESCAPE = (rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def text_part(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    null = F.lit(None).cast("string")
    return F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text"), null.alias("ref"), F.lit(None).cast("bigint").alias("units"))
    ).cast(PARTS)


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _placeholder(kind: Column) -> Column:
    out = F.lit(OTHER)
    for name, mark in PLACEHOLDERS.items():
        out = F.when(kind == name, F.lit(mark)).otherwise(out)
    return out


def _tokens(part: Column) -> Column:
    rate = F.lit(0)
    for name, n in TOKENS_PER_UNIT.items():
        rate = F.when(part["type"] == name, F.lit(n)).otherwise(rate)
    return (rate * F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1))).cast("long")


def visit(parts: Column) -> Column:
    """Struct of ``body`` and ``attachments`` (type, ref, at, tokens) of a turn.

    Texts that stand next to each other are joined before they are escaped: a
    control string may come about only where they meet.
    """
    none = F.array().cast("array<struct<type:string,ref:string,at:bigint,tokens:bigint>>")
    start = F.struct(F.lit("").alias("body"), F.lit("").alias("open"), none.alias("attachments"))

    def step(acc: Column, part: Column) -> Column:
        closed = F.concat(acc["body"], escape(acc["open"]))
        mark = F.struct(
            part["type"].alias("type"), part["ref"].alias("ref"), F.length(closed).cast("long").alias("at"), _tokens(part).alias("tokens")
        )
        return F.when(
            _is_text(part),
            F.struct(
                acc["body"].alias("body"),
                F.concat(acc["open"], F.coalesce(part["text"], F.lit(""))).alias("open"),
                acc["attachments"].alias("attachments"),
            ),
        ).otherwise(
            F.struct(
                F.concat(closed, _placeholder(part["type"])).alias("body"),
                F.lit("").alias("open"),
                F.concat(acc["attachments"], F.array(mark)).alias("attachments"),
            )
        )

    return F.aggregate(
        F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull()),
        start,
        step,
        lambda acc: F.struct(F.concat(acc["body"], escape(acc["open"])).alias("body"), acc["attachments"].alias("attachments")),
    )


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str | None = "text",
    parts_col: str | None = None,
) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans, attachments, attachment_tokens.

    ``loss_spans`` has (start, end) in code points of each assistant body in
    ``formatted``; attachments keep their place and turn. Content is plain text
    in ``text_col`` or typed parts in ``parts_col``. Turns of equal number go by
    role and content, and rows that repeat are turns that repeat; null role,
    text, parts and single null parts count as empty; a null turn number comes
    first; rows with a null conversation form one conversation. An attachment of
    unknown type keeps its reference and expands to nothing. No rows give none.
    """
    parts = F.col(parts_col).cast(PARTS) if parts_col else text_part(F.col(text_col))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        visit(parts).alias("v"),
    ).select("conv_id", "turn", "role", F.col("v.body").alias("body"), F.col("v.attachments").alias("attachments"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    rows = rows.withColumn("head", head).withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", "attachments")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("pos", F.row_number().over(order).cast("long")).withColumn(
        "base", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0).cast("long"))
    )
    start = F.col("base") + F.length("head")
    rows = rows.select(
        "conv_id",
        F.struct(
            "pos",
            "piece",
            F.when(F.col("role") == LEARNED_ROLE, F.struct(start.alias("start"), (start + F.length("body")).alias("end"))).alias("span"),
            F.transform(
                "attachments",
                lambda a: F.struct(
                    (F.col("pos") - 1).alias("turn"),
                    a["type"].alias("type"),
                    a["ref"].alias("ref"),
                    (start + a["at"]).alias("at"),
                    a["tokens"].alias("tokens"),
                ),
            ).alias("attachments"),
        ).alias("t"),
    )
    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("ts"))
        .select(
            "conv_id",
            F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"),
            F.filter(F.transform("ts", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
            F.flatten(F.transform("ts", lambda t: t["attachments"])).alias("attachments"),
        )
        .withColumn(
            "attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"])
        )
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, body) that a formatted text holds; bodies still have their placeholders."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda t, i: i > 0)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(t, BODY, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(t, BODY, -1), END, 1)).alias("body"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(r, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS er,
    regexp_replace(t, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS et FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, et)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, et) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(er) + 8 + length(et) + 7) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
