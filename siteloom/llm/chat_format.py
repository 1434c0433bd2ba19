"""Operator 8: chat formatting, in DataFrame operations only.

The template writes a block per run of turns of one role:

    <|start|>ROLE\\n TEXT (<|next|> TEXT)* <|end|>\\n

Texts and roles are escaped so that no control string of this or a common template is left in them: each of ESCAPES becomes the
marker U+241B and a letter, the marker itself U+241B and 'z'. The marker is escaped first and restored last, so the mapping is
one to one. `parse` reads the turns back from the formatted string alone; `loss_text` reads what lies under the mask.

Defined results: null text or role counts as empty; turns are sorted by turn, null first, ties by role and text; repeated rows
are turns of their own; rows with a null conversation id form one conversation; other columns are never read and may have any
names; a text of any length is one turn. A conversation is
one output row, so it must fit one task's memory as a value; nothing else is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|start|>", "<|next|>", "<|end|>\n"
MARK = "␛"
#: Control strings that may not stand in a text, with the letter that stands for each.
ESCAPES = [("<|", "a"), ("<s>", "b"), ("</s>", "c"), ("[INST]", "d"), ("[/INST]", "e"), ("<<SYS>>", "f"), ("<</SYS>>", "g")]
RUN = 256
ROLE_ESCAPES = [*ESCAPES, ("\n", "n")]


def _escape(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(MARK + p[1])), pairs, F.replace(c, F.lit(MARK), F.lit(MARK + "z")))


def _unescape(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return F.replace(reduce(lambda x, p: F.replace(x, F.lit(MARK + p[1]), F.lit(p[0])), pairs, c), F.lit(MARK + "z"), F.lit(MARK))


def format_conversations(df: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: array of (start, length) in code points of formatted, from 0."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    convs = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    # A turn opens a block unless the turn before has its role.
    parts = F.transform(
        "t",
        lambda x, i: F.struct(
            F.when(
                (i == 0) | (F.get(F.col("t"), i - 1)["role"] != x["role"]),
                F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit(END)), F.lit(START), _escape(x["role"], ROLE_ESCAPES), F.lit("\n")),
            )
            .otherwise(F.lit(NEXT))
            .alias("head"),
            _escape(x["text"], ESCAPES).alias("body"),
            (x["role"] == loss_role).alias("loss"),
        ),
    )
    span = "struct<start:bigint,length:bigint>"
    state = [F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("run"), F.array().cast(f"array<array<{span}>>").alias("runs")]

    def step(s: Column, x: Column) -> Column:
        # Spans are kept in runs of RUN, so that adding one doesn't copy all.
        one = F.struct((s["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).cast("long").alias("length"))
        full = F.size(s["run"]) >= RUN
        run = F.when(full, F.array(one)).otherwise(F.array_append(s["run"], one))
        return F.struct(
            (s["at"] + F.length(x["head"]) + F.length(x["body"])).alias("at"),
            F.when(x["loss"], run).otherwise(s["run"]).alias("run"),
            F.when(x["loss"] & full, F.array_append(s["runs"], s["run"])).otherwise(s["runs"]).alias("runs"),
        )

    spans = F.aggregate("p", F.struct(*state), step, lambda s: F.flatten(F.array_append(s["runs"], s["run"])))
    text = F.concat(F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"])), ""), F.lit(END))
    return convs.select("conv_id", parts.alias("p")).select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>>: the turns, from the formatted string alone."""
    blocks = F.filter(F.split(formatted, f"\\Q{END}\\E"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.substring_index(F.replace(b, F.lit(START), F.lit("")), "\n", 1)
        bodies = F.split(F.substring(b, F.length(role) + len(START) + 2, F.length(b)), f"\\Q{NEXT}\\E")
        return F.transform(bodies, lambda x: F.struct(_unescape(role, ROLE_ESCAPES).alias("role"), _unescape(x, ESCAPES).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: _unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")), ESCAPES)), "")


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted and loss_spans."""
    back = formatted.select("conv_id", parse(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").alias("n"))
    joined = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
    )
