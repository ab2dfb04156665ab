"""Chat formatting: a state machine over roles and a declarative template, in DataFrame operations only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written and which order of roles is valid.

    ``transitions`` maps a state to the roles that may follow and the state each leads to; ``accepting``
    are the states in which a conversation may end. The loss covers the texts of ``loss_roles`` alone.
    Each control string that occurs inside a role or text gets ``escape`` after its first character, and
    ``escape`` itself is doubled, so no text can open or close a turn and reading back is exact.
    """

    bos: str = "<s>"
    eos: str = "</s>"
    open: str = "<|turn|>"
    text: str = "<|text|>"
    close: str = "<|end|>"
    foreign: tuple[str, ...] = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
    escape: str = "␛"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "instructed", "user": "asked"},
            "instructed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )

    def controls(self) -> list[str]:
        """All control strings, longest first."""
        return sorted({self.bos, self.eos, self.open, self.text, self.close, *self.foreign}, key=lambda s: (-len(s), s))


DEFAULT_TEMPLATE = Template()


def escaped(value: Column, template: Template) -> Column:
    tails = "|".join(f"(?<={re.escape(s[0])}){re.escape(s[1:])}" for s in template.controls())
    doubled = F.replace(value, F.lit(template.escape), F.lit(template.escape * 2))
    return F.regexp_replace(doubled, f"(?={tails})", template.escape)


def unescaped(value: Column, template: Template) -> Column:
    return F.regexp_replace(value, f"{re.escape(template.escape)}({re.escape(template.escape)}?)", "$1")


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template = DEFAULT_TEMPLATE,
) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, valid, first_bad, segments, formatted``.

    ``segments`` are (text, loss) in order, and ``formatted`` is their texts joined. ``valid`` says whether
    the state machine accepts the order of roles; ``first_bad`` is the number (from 1) of the turn it
    refused, or one past the last if the conversation ended too early. Invalid ones are formatted too.

    Rows are taken by turn, then role, then text; null turns come first and repeated rows are
    turns of their own. Null roles and texts are empty; a null conversation id is one conversation. Turns of one
    conversation meet in one task, as its output is one value; sorting is inside that value only, and texts of any length
    are formatted whole. An empty table gives no rows; further columns of any name are ignored.
    """
    t = template
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            role.alias("role"),
            text.alias("raw"),
            F.concat(F.lit(t.open), escaped(role, t), F.lit(t.text)).alias("head"),
            escaped(text, t).alias("body"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    moves = [F.lit(x) for s, to in t.transitions.items() for r, into in to.items() for x in (f"{s}>{r}", into)]
    table = F.create_map(*moves)
    begin = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("seen"))
    last = F.aggregate(
        "turns",
        begin,
        lambda a, x: F.struct(
            F.coalesce(F.element_at(table, F.concat(a["state"], F.lit(">"), x["role"])), F.lit("refused")).alias("state"),
            (a["seen"] + F.when(a["state"] == "refused", 0).otherwise(1)).alias("seen"),
        ),
    )
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    plain = lambda s: segment(F.lit(s), F.lit(False))
    inner = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                segment(x["head"], F.lit(False)),
                segment(x["body"], x["role"].isin(*t.loss_roles)),
                plain(t.close),
            ),
        )
    )
    return (
        chats.withColumns(
            {"last": last, "segments": F.concat(F.array(plain(t.bos)), inner, F.array(plain(t.eos)))}
        )
        .withColumn("valid", F.col("last.state").isin(*t.accepting))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            "valid",
            F.when(F.col("last.state") == "refused", F.col("last.seen"))
            .when(~F.col("valid"), F.col("last.seen") + 1)
            .alias("first_bad"),
            "segments",
            F.array_join("segments.text", "").alias("formatted"),
        )
    )


def read_chats(chats: DataFrame, template: Template = DEFAULT_TEMPLATE) -> DataFrame:
    """Adds ``turns`` (role, text) parsed from ``formatted``, and ``loss_text``, the texts of those under the mask.

    All columns of ``chats`` come back; existing ones of these two names are replaced. The inverse of ``format_chats``
    for texts of any length and content, empty ones too: nothing but the formatted text is read. Null formatted texts
    give null; an empty table gives no rows.
    """
    t = template
    pattern = "(?s)" + re.escape(t.open) + "(.*?)" + re.escape(t.text) + "(.*?)" + re.escape(t.close)
    part = lambda n: F.transform(
        F.regexp_extract_all("formatted", F.lit(pattern), F.lit(n)), lambda x: unescaped(x, t)
    )
    read = chats.withColumn("turns", F.arrays_zip(part(1).alias("role"), part(2).alias("text")))
    masked = F.filter("turns", lambda x: x["role"].isin(*t.loss_roles))
    return read.withColumn("loss_text", F.array_join(F.transform(masked, lambda x: x["text"]), ""))
