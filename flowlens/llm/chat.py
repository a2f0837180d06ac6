r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar: a conversation is a row of turns ``<|im_start|>role\ntext<|im_end|>\n``. A turn is first rendered as it is and
reparsed. If the parser does not give the turn back, its role and text are escaped: ``%`` becomes ``%25``, ``<|`` becomes
``%3C|``, in roles also a line end ``%0A``; the header then ends in ``<|esc|>``, so the parser knows. Escaped turns hold
no control string, so they always come back. The conversation as a whole is reparsed and compared once more.

Nulls and odd rows: a null role or text is empty; a null turn number comes first; turns of one number are ordered by
their rendered form, repeated rows stay repeated; rows with a null conversation id form one conversation. No rows give no
conversations. Only the four named columns are read. One conversation is one output row, so it must fit a cell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END, MARK = "<|im_start|>", "<|im_end|>", "<|esc|>"
CLOSE = END + "\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(CLOSE))


def render_escaped(role: Column, text: Column) -> Column:
    header = F.concat(F.replace(escape(role), F.lit("\n"), F.lit("%0A")), F.lit(MARK))
    return render(header, escape(text))


def parse_turn(block: Column) -> Column:
    """What stands between two turn starts as (role, text); (null, null) if it is no turn."""
    body = F.left(block, F.length(block) - len(CLOSE))
    header = F.substring_index(body, "\n", 1)
    content = F.substr(body, F.length(header) + 2)
    named = F.left(header, F.length(header) - len(MARK))
    escaped = F.endswith(header, F.lit(MARK))
    turn = F.endswith(block, F.lit(CLOSE)) & ~F.contains(body, F.lit(END)) & F.contains(body, F.lit("\n"))
    role = F.when(escaped, unescape(F.replace(named, F.lit("%0A"), F.lit("\n")))).otherwise(header)
    return F.struct(
        F.when(turn, role).alias("role"), F.when(turn, F.when(escaped, unescape(content)).otherwise(content)).alias("text")
    )


def parse(rendered: Column) -> Column:
    """The turns of a rendered conversation, in order."""
    blocks = F.split(rendered, r"<\|im_start\|>", -1)
    return F.transform(F.slice(blocks, F.lit(2), F.size(blocks) - 1), parse_turn)


def format_conversations(rows, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
    """One row for each conversation: its id, ``formatted``, and ``round_trip`` (the parsed turns are the source's)."""
    turns = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    plain = render(F.col("role"), F.col("text"))
    back = parse(plain)
    same = (F.size(back) == 1) & F.coalesce(
        (F.get(back, F.lit(0))["role"] == F.col("role")) & (F.get(back, F.lit(0))["text"] == F.col("text")), F.lit(False)
    )
    shown = F.when(same, plain).otherwise(render_escaped(F.col("role"), F.col("text")))
    pieces = turns.select("conv_id", F.struct("turn", shown.alias("piece"), F.xxhash64("role", "text").alias("source")).alias("t"))
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    out = whole.select("conv_id", F.array_join(F.col("ts.piece"), "").alias("formatted"), F.col("ts.source").alias("source"))
    seen = F.transform(parse(F.col("formatted")), lambda t: F.xxhash64(t["role"], t["text"]))
    return out.select("conv_id", "formatted", (seen == F.col("source")).alias("round_trip"))


def read_back(formatted):
    """Turns, and the text under the loss mask (what assistants say), parsed from ``formatted``."""
    read = formatted.select("conv_id", "formatted", "round_trip", parse(F.col("formatted")).alias("turns"))
    spoken = F.filter(F.col("turns"), lambda t: t["role"] == "assistant")
    return read.select(
        "conv_id", "formatted", "round_trip", "turns", F.array_join(F.transform(spoken, lambda t: t["text"]), "").alias("loss_text")
    )
