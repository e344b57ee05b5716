"""Chat formatting with Spark expressions: turns to one training text and its loss mask, and back.

A conversation's turns are numbered by one window; adjacent turns of one role
are merged into a block by array aggregation (sorted collected structs), and
blocks are concatenated the same way. A block is
``start role sep text (more text)* end``: the ``more`` mark between merged
texts lets the reader tell the turns apart again.

Control strings inside roles and texts are escaped reversibly: a backslash is
put behind the opening character of every control string, and one more where
there are backslashes already, so no text holds a control string and texts
without one stay as they are. The list of control strings holds the template's
own marks and those of other common templates.

The loss mask is a list of (start, length) in bytes of the UTF-8 text, one for
each text of a role that is learnt, without marks.

Everything is built-in expressions: windows, ``collect_list``, ``sort_array``,
``array_join``, ``split``. One shuffle, by conversation; the window and the
sorts spill. A formatted conversation is one value, so a single conversation is
limited to the 2 GB of a string; nothing else is held whole.

Defined cases: null role or text is empty; turns are ordered by turn, null
first, ties by role, then text, so repeated rows are turns of their own; rows
without conversation id are one conversation; empty texts give empty spans; an
empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import text_or_empty

# Marks of other common templates, escaped as well.
FOREIGN_MARKS = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
)


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn's block, further control strings, and the roles that are learnt."""

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    more: str = "<|im_more|>"
    end: str = "<|im_end|>"
    foreign: tuple[str, ...] = FOREIGN_MARKS
    loss_roles: tuple[str, ...] = ("assistant",)

    def control_strings(self) -> tuple[str, ...]:
        return (self.start, self.sep, self.more, self.end, *self.foreign)

    def pattern(self) -> str:
        """(opening character)(backslashes)(rest) of every control string, for Java and RE2 alike.

        The rest starts behind the last opening character of a control string
        and holds none, so matches never overlap.
        """
        openers = sorted({c[0] for c in self.control_strings()})
        rests = []
        for c in self.control_strings():
            rest = c[max(c.rfind(o) for o in openers) + 1:]
            if not rest or "\\" in c or any(ch.isspace() for ch in c):
                raise ValueError(f"control string {c!r} needs an opening character, a rest, no backslash or space")
            rests.append(rest)
        return "([" + "".join(map(re.escape, openers)) + r"])(\\*)(" + "|".join(map(re.escape, rests)) + ")"

    def escape(self, col: Column) -> Column:
        return F.regexp_replace(col, F.lit(self.pattern()), F.lit(r"$1\\$2$3"))

    def unescape(self, col: Column) -> Column:
        pattern = self.pattern().replace(r"(\\*)", r"\\(\\*)", 1)
        return F.regexp_replace(col, F.lit(pattern), F.lit("$1$2$3"))


def number_turns(turns: DataFrame, template: ChatTemplate, conv_col: str, turn_col: str, role_col: str,
                 text_col: str) -> DataFrame:
    """Escaped turns with their position, block and the byte at which their text will start."""
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own_role, own_text = template.escape(F.col("role")), template.escape(F.col("text"))
    t = t.withColumns({"position": F.row_number().over(w), "before": F.lag("role").over(w)})
    t = t.withColumn("head", F.col("before").isNull() | (F.col("before") != F.col("role")))
    t = t.select("conv_id", "position", "head", own_role.alias("escaped_role"), own_text.alias("escaped"),
                 F.col("role").isin(list(template.loss_roles)).alias("learnt"))
    size = {k: len(getattr(template, k).encode()) for k in ("start", "sep", "more", "end")}
    opening = F.lit(size["start"] + size["sep"]) + F.octet_length("escaped_role")
    lead = (F.when(F.col("position") == 1, opening)
            .when(F.col("head"), opening + size["end"]).otherwise(F.lit(size["more"]))).cast("long")
    order = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.octet_length("escaped").cast("long")
    return (t.withColumn("lead", lead)
            .select("conv_id", "position", F.col("escaped_role").alias("role"), F.col("escaped").alias("text"), "learnt",
                    F.sum(F.col("head").cast("int")).over(order).alias("block"),
                    (F.sum(F.col("lead") + length).over(order) - length).alias("start"), length.alias("length")))


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, text, loss (array of start and length in bytes of the text)."""
    turn = F.struct("position", "text", "start", "length", "learnt")
    blocks = (number_turns(turns, template, conv_col, turn_col, role_col, text_col)
              .groupBy("conv_id", "block", "role").agg(F.sort_array(F.collect_list(turn)).alias("turns")))
    spans = F.transform(F.filter("turns", lambda t: t["learnt"]),
                        lambda t: F.struct(t["start"].cast("int").alias("start"), t["length"].cast("int").alias("length")))
    text = F.concat(F.lit(template.start), "role", F.lit(template.sep),
                    F.array_join(F.col("turns.text"), template.more), F.lit(template.end))
    block = F.struct("block", text.alias("text"), spans.alias("spans"))
    return (blocks.select("conv_id", block.alias("b")).groupBy("conv_id")
            .agg(F.sort_array(F.collect_list("b")).alias("blocks"))
            .select("conv_id", F.array_join(F.col("blocks.text"), "").alias("text"),
                    F.flatten(F.col("blocks.spans")).alias("loss")))


def _quoted(mark: str) -> str:
    return re.escape(mark)


def read_turns(text: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped, merged turns told apart again."""
    def turns_of(block: Column) -> Column:
        parts = F.split(block, _quoted(template.sep), 2)
        role = template.unescape(F.substr(parts[0], F.lit(len(template.start) + 1)))
        return F.transform(F.split(parts[1], _quoted(template.more), -1),
                           lambda t: F.struct(role.alias("role"), template.unescape(t).alias("text")))

    blocks = F.filter(F.split(text, _quoted(template.end), -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, turns_of))


def read_loss(text: Column, loss: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The texts under the loss mask, unescaped, in order.

    The text's bytes are bound once to a lambda's variable, so that every span
    costs its own length only.
    """
    def spans(data: Column) -> Column:
        return F.transform(loss, lambda s: template.unescape(F.substring(data, s["start"] + 1, s["length"]).cast("string")))

    return F.transform(F.array(text.cast("binary")), spans)[0]
