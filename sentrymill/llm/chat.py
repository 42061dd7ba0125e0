"""Chat formatting: one training text per conversation, with a loss mask, by Spark expressions only.

Template: `<turn ROLE>TEXT</turn>` and a line feed per merged turn; texts of
adjacent turns of one role stand in one turn with `<next>` between them.  Inside
roles and texts `\\`, `<` and `>` become `\\s`, `\\l` and `\\g`, so that a control
string never occurs there and reading back is exact.

The output has the text in segments with a loss flag; the mask covers exactly
the assistant texts.

A conversation is one output row, so its turns meet in one row by nature; they
are escaped before the shuffle and nothing quadratic is done with them.

Defined results: null text and null role count as empty; turns with equal
numbers are ordered by role, then text, null numbers first; repeated rows are
turns of their own; rows without a conversation id form one conversation; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import bind, body

LOSS_ROLE = "assistant"
OPEN, OPEN_END, NEXT, CLOSE = "<turn ", ">", "<next>", "</turn>\n"


def escape(text: Column) -> Column:
    for plain, safe in (("\\", "\\s"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in ((">", "\\g"), ("<", "\\l"), ("\\", "\\s")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _runs(turns: Column) -> Column:
    """Merged turns (role, texts): slices of the sorted turns between changes of the role."""
    def merged(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (
            F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        return bind(starts, lambda s: F.transform(s, lambda start, k: F.struct(
            F.get(t, start)["role"].alias("role"),
            F.transform(F.slice(t, start + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - start),
                        lambda x: x["text"]).alias("texts"))))
    return bind(turns, merged)


def _segments(runs: Column) -> Column:
    """Pieces (text, loss) whose texts in a row are the formatted conversation."""
    def mark(text: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def of(run: Column) -> Column:
        texts = F.flatten(F.transform(run["texts"], lambda x, i: F.array(
            mark(F.when(i == 0, F.concat(F.lit(OPEN), run["role"], F.lit(OPEN_END))).otherwise(NEXT)),
            F.struct(x.alias("text"), (run["role"] == LOSS_ROLE).alias("loss")))))
        return F.concat(texts, F.array(mark(F.lit(CLOSE))))
    return F.flatten(F.transform(runs, of))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """One row per conversation: id, formatted text, segments (text, loss)."""
    rows = turns.select(F.col(conv_col).alias("_conv"), F.struct(
        F.col(turn_col).alias("turn"), escape(body(role_col)).alias("role"), escape(body(text_col)).alias("text")).alias("_turn"))
    sorted_turns = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    segments = sorted_turns.select("_conv", _segments(_runs(F.col("_turns"))).alias("segments"))
    return segments.select(F.col("_conv").alias(conv_col), F.array_join(
        F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds the original turns (role, text), read from the formatted text, and the text under the loss mask."""
    blocks = F.filter(F.split("formatted", CLOSE), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, len(OPEN) + 1, F.length(block)), OPEN_END, 1))
        texts = F.split(F.substring(block, F.instr(block, OPEN_END) + 1, F.length(block)), NEXT)
        return bind(role, lambda r: F.transform(texts, lambda x: F.struct(r.alias("role"), unescape(x).alias("text"))))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, turns)), "loss_text": loss})


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        conv_col, F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
