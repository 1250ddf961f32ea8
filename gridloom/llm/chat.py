"""Chat formatting: roles checked by a finite-state machine, texts set in a template,
and a loss flag for each emitted segment.  DataFrame functions only.

Reading back is exact: inside texts and roles every ``<``, any backslashes and ``|``
gains one backslash after the ``<``, so that no control string of the template, all of
which hold ``<|``, can appear there; taking one backslash away restores the original.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ESCAPE, _UNESCAPE = r"<(\\*)\|", r"<\\(\\*)\|"


@dataclass(frozen=True)
class ChatTemplate:
    """Declares the format and the machine.

    ``start`` + role + ``after_role`` + text + ``end`` is one turn.  ``start`` and ``end``
    must hold ``<|`` and ``after_role`` must be a line feed.  ``moves`` maps (state, role)
    to the next state, anything else is refused; a conversation is valid if no turn is
    refused and it stops in one of ``accept``.  Texts of ``loss_roles`` count for the loss,
    with ``end`` too if ``loss_on_end``.
    """

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    first: str = "begin"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "primed",
            ("begin", "user"): "asked",
            ("primed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accept: tuple[str, ...] = ("answered",)
    loss_roles: tuple[str, ...] = ("assistant",)
    loss_on_end: bool = False

    def __post_init__(self):
        if "<|" not in self.start or "<|" not in self.end or self.after_role != "\n":
            raise ValueError("start and end must hold '<|' and after_role must be a line feed")


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "<$1|")


def escape_role(role: Column) -> Column:
    """As texts, and without line feeds, which end a role."""
    return escape_text(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape_text(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation:

    * ``segments``: array of (text, loss), whose texts joined are ``formatted``;
    * ``loss_spans``: array of (start, length) of ``formatted`` in code points, start from 1;
    * ``valid`` and ``bad_turn`` (0-based place of the first refused turn, else null).

    Turns are ordered by ``turn_col``, then role and text, so ties give one result; a null
    turn comes first.  Null roles and texts are empty, repeated rows are repeated turns, and
    rows with a null conversation id form one conversation.  Invalid conversations are
    formatted all the same and only flagged.  A conversation is one text by definition and
    is gathered in one row; nothing larger is.
    """
    t = template
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    gathered = turns.groupBy(F.col(conv_col).alias(conv_col)).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")))).alias("turns")
    )

    def pieces(x: Column) -> Column:
        counts = x["role"].isin(list(t.loss_roles))
        head = F.concat(F.lit(t.start), escape_role(x["role"]), F.lit(t.after_role))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape_text(x["text"]).alias("text"), counts.alias("loss")),
            F.struct(F.lit(t.end).alias("text"), (counts & F.lit(t.loss_on_end)).alias("loss")),
        )

    moves = F.create_map(*[F.lit(x) for (state, r), to in t.moves.items() for x in (f"{state}\n{r}", to)])

    def step(state: Column, x: Column) -> Column:
        to = F.try_element_at(moves, F.concat(state["at"], F.lit("\n"), x["role"]))
        refused = state["bad"].isNull() & to.isNull()
        return F.struct(
            F.coalesce(to, F.lit("refused")).alias("at"),
            F.when(refused, state["seen"]).otherwise(state["bad"]).alias("bad"),
            (state["seen"] + 1).alias("seen"),
        )

    begin = F.struct(F.lit(t.first).alias("at"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("seen"))

    def place(acc: Column, s: Column) -> Column:
        length = F.length(s["text"])
        span = F.array(F.struct(acc["at"].alias("start"), length.alias("length")))
        return F.struct((acc["at"] + length).alias("at"), F.when(s["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    no_spans = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return (
        gathered.withColumn("segments", F.flatten(F.transform("turns", pieces)))
        .withColumn("end_state", F.aggregate("turns", begin, step))
        .select(
            conv_col,
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            F.aggregate("segments", no_spans, place, lambda acc: acc["spans"]).alias("loss_spans"),
            (F.col("end_state.bad").isNull() & F.col("end_state.at").isin(list(t.accept))).alias("valid"),
            F.col("end_state.bad").alias("bad_turn"),
        )
    )


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns, array of (role, text), read from a formatted text."""
    body = F.slice(F.split(formatted, _quoted(template.start)), 2, 2_000_000_000)

    def turn(x: Column) -> Column:
        at = F.instr(x, "\n")
        text = F.substring(x, at + 1, F.length(x) - at - len(template.end))
        return F.struct(unescape_role(F.substring(x, F.lit(1), at - 1)).alias("role"), unescape_text(text).alias("text"))

    return F.transform(body, turn)


def read_loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape_text(F.substring(formatted, s["start"], s["length"]))), "")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
