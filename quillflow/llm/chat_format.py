"""Chat formatting: conversations become one string with a loss mask, and can be read back.

A turn is written as its text and ``</turn>``; a run of turns of one role stands under one header
``### role: ``, and a newline ends the run::

    ### user: first</turn>second</turn>
    ### assistant: answer</turn>

Inside roles and texts ``\\`` becomes ``\\s``, ``#`` becomes ``\\h``, ``<`` becomes ``\\l`` and, in roles, ``:``
becomes ``\\c``. So no header and no end mark can come from a text, and the replacements can be undone.

Rows with a null conv_id form one conversation of their own. Turns are ordered by (turn, role, text), nulls
first, so ties and repeated rows give one defined string and no row is lost. Null roles and texts
count as empty. Extra columns are ignored. An empty table gives an empty table. A conversation is one output
row by definition, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.llm.shared import only

HEADER, SEP, END, BREAK = "### ", ": ", "</turn>", "\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\s"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("<", "\\l"), ("#", "\\h"), ("\\", "\\s")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def merge_turns(turns: Column) -> Column:
    """Runs of adjacent turns of one role: array of (role, texts)."""
    starts = F.filter(
        F.sequence(F.lit(0), F.size(turns) - 1),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    return F.transform(
        starts,
        lambda start, k: F.struct(
            F.get(turns, start)["role"].alias("role"),
            F.transform(
                F.slice(turns, start + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - start),
                lambda t: t["text"],
            ).alias("texts"),
        ),
    )


def format_chats(conversations: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_spans): loss_spans are the [start, end) code points of each text of loss_role."""
    rows = only(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    runs = grouped.select("conv_id", merge_turns(F.col("turns")).alias("runs"))
    # Each run as (head, bodies): the head is header text, the bodies are escaped turns with their end marks.
    parts = runs.select(
        "conv_id",
        F.flatten(
            F.transform(
                "runs",
                lambda r, k: F.transform(
                    r["texts"],
                    lambda x, i: F.struct(
                        F.when(i > 0, "")
                        .otherwise(F.concat(F.when(k > 0, BREAK).otherwise(""), F.lit(HEADER), escape_role(r["role"]), F.lit(SEP)))
                        .alias("before"),
                        escape(x).alias("body"),
                        (r["role"] == loss_role).alias("loss"),
                    ),
                ),
            )
        ).alias("parts"),
    )
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["before"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(
                p["loss"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(p["before"])).alias("start"),
                            (acc["at"] + F.length(p["before"]) + F.length(p["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["body"], F.lit(END))), "")
    return parts.select("conv_id", F.concat(text, F.lit(BREAK)).alias("formatted"), spans["spans"].alias("loss_spans"))


def texts_of(block: Column) -> Column:
    pieces = F.split(F.substring(block, F.instr(block, SEP) + len(SEP), F.length(block)), END)
    return F.slice(pieces, 1, F.size(pieces) - 1)  # the last piece is the line break that ends the run


def parse_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted): the turns (role, text) as read from the string alone, and the texts that
    the loss spans cut from it."""
    blocks = F.filter(F.split("formatted", HEADER), lambda b, i: i > 0)
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                texts_of(b),
                lambda x: F.struct(unescape_role(F.substring_index(b, SEP, 1)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )
    losses = F.transform(
        "loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
    return formatted.select("conv_id", turns.alias("turns"), losses.alias("loss_texts"), "formatted")


def digests(parsed: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
