"""Chat formatting in Spark expressions only.

The turns of a conversation are collected, sorted, merged where neighbours share a role, and
concatenated under a template. Control strings inside texts are escaped, so that the output can
be read back exactly; the loss mask is a list of spans of the output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template: start and end of a block of one role, and between its merged turns.
START, END, JOINT = "<|im_start|>", "<|im_end|>\n", "<|turn|>"
#: Signs that open a control string, of this template and of others, and what stands for them.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
#: A role stands on a line of its own.
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))


def _replaced(x: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, x)


def escape(x: Column, pairs=ESCAPES) -> Column:
    return _replaced(x, pairs)


def unescape(x: Column, pairs=ESCAPES) -> Column:
    return _replaced(x, [(b, a) for a, b in reversed(pairs)])


def format_chat(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss) of each conversation (conv_id, turn, role, text).

    Turns stand by turn, then role, then text; null turns come first. A null role or text is
    empty; a null conv_id is a conversation of its own. Neighbours of one role are merged into
    one block, joined by a mark that keeps the turns apart. loss lists the spans (start, end) of
    ``formatted``, in code points from 0, end exclusive, that hold the texts of ``loss_role``.
    Repeated rows are turns of their own. Other columns are ignored; an empty table gives an
    empty result. A conversation is one row of output, so it is gathered in one task."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), role.alias("role"), text.alias("text")))).alias("turns"))
    block = lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
    blocks = F.aggregate(
        "turns", F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)"),
        lambda acc, t: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["role"] == t["role"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
                t["role"].alias("role"), F.concat(F.element_at(acc, -1)["texts"], F.array(t["text"])).alias("texts")))))
        .otherwise(F.concat(acc, F.array(block(t)))))
    escaped = F.transform("blocks", lambda b: F.struct(
        escape(b["role"], ROLE_ESCAPES).alias("name"), (b["role"] == loss_role).alias("learned"),
        F.transform(b["texts"], lambda t: escape(t)).alias("texts")))
    formatted = F.array_join(F.transform("escaped", lambda b: F.concat(
        F.lit(START), b["name"], F.lit("\n"), F.array_join(b["texts"], JOINT), F.lit(END))), "")
    pieces = F.flatten(F.transform("escaped", lambda b: F.transform(b["texts"], lambda t, i: F.struct(
        F.when(i == 0, F.length(b["name"]) + len(START) + 1).otherwise(len(JOINT)).alias("before"), F.length(t).alias("size"),
        F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("after"), b["learned"].alias("learned")))))
    spans = F.aggregate(
        "pieces", F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>))"),
        lambda acc, p: F.struct(
            (acc["at"] + p["before"] + p["size"] + p["after"]).alias("at"),
            F.when(p["learned"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + p["before"]).alias("start"), (acc["at"] + p["before"] + p["size"]).alias("end")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return (turns.select("conv_id", blocks.alias("blocks")).select("conv_id", escaped.alias("escaped"))
            .select("conv_id", formatted.alias("formatted"), pieces.alias("pieces"))
            .select("conv_id", "formatted", spans.alias("loss")))


def read_turns(formatted: Column) -> Column:
    """The (role, text) of every turn, read back from the formatted text alone."""
    quoted = lambda x: x.replace("|", r"\|")
    blocks = F.split(formatted, quoted(END), -1)
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: F.transform(
        F.split(F.substring(b, F.instr(b, "\n") + 1, F.length(b)), F.lit(quoted(JOINT)), F.lit(-1)),
        lambda t: F.struct(unescape(F.substring_index(F.substring(b, F.lit(len(START) + 1), F.length(b)), "\n", 1), ROLE_ESCAPES).alias("role"),
                           unescape(t).alias("text")))))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
