"""Chat formatting: a finite-state machine over roles, and a declarative template.

``Template`` says what each turn becomes: segments that are literal, the role, or
the text, each with the roles for which it is under the loss mask. ``Machine``
says which role may follow which. Both are data; the work is DataFrame
expressions only.

Inside roles and texts the escape character and the first character of each of the
template's literals are escaped (by default ``\\`` as ``\\b``, ``<`` as ``\\l``, ``>`` as
``\\g``), so no text can hold a control string and ``read_back`` recovers every turn from
the formatted string alone. A template of which that could not be said is refused.

Turns are ordered by turn, role, text. Null role or text counts as empty; very long
texts are formatted whole. Conversations of an order that the machine rejects are
formatted too, with valid false and the place of the first bad turn. A row with a null
conv_id is a conversation of its own. Repeated rows are turns of their own. Other
columns are ignored. A conversation is one training example, so it is gathered whole;
copies of a conversation under other ids are others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
#: What follows the escape character, in this order: for itself, then for the characters escaped.
CODES = "blgcdefh"


@dataclass(frozen=True)
class Template:
    """Segments of a turn: (kind, value, roles under loss); kind is literal, role or text.

    A turn is a literal, the role, a literal, the text and a literal. Raises ValueError
    where texts could imitate a literal in spite of the escapes.
    """

    segments: tuple = (("literal", "<turn:", ()), ("role", "", ()), ("literal", ">", ()), ("text", "", ("assistant",)), ("literal", "</turn>\n", ()))

    def __post_init__(self):
        if [s[0] for s in self.segments] != ["literal", "role", "literal", "text", "literal"]:
            raise ValueError("a turn is a literal, the role, a literal, the text and a literal")
        for name, value in (("first", self.open), ("second", self.after_role), ("last", self.close)):
            if not value or ESCAPE in value:
                raise ValueError(f"the {name} literal is empty or holds {ESCAPE}")
        # the last literal may not begin where another ends: a role or text could supply the rest
        for other in (self.open, self.after_role):
            if self.close in other or any(self.close.startswith(other[k:]) for k in range(len(other))):
                raise ValueError(f"{other!r} ends as {self.close!r} begins")

    @property
    def literals(self) -> list[str]:
        return [value for kind, value, _ in self.segments if kind == "literal"]

    @property
    def codes(self) -> list[tuple[str, str]]:
        """What is escaped in roles and texts, and by what; the escape character first."""
        first = sorted({value[0] for value in self.literals})
        free = (c for c in CODES if c not in first)
        return [(c, ESCAPE + next(free)) for c in (ESCAPE, *first)]

    @property
    def open(self) -> str:
        return self.segments[0][1]

    @property
    def after_role(self) -> str:
        return self.segments[2][1]

    @property
    def close(self) -> str:
        return self.segments[-1][1]


@dataclass(frozen=True)
class Machine:
    """States are the roles seen last."""

    moves: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple = ("assistant",)


def escape(c: Column, template: Template) -> Column:
    for plain, code in template.codes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, template: Template) -> Column:
    for plain, code in reversed(template.codes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_conversations(conversations: DataFrame, template: Template | None = None, machine: Machine | None = None) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, valid, first_bad (its turn number, from 0)."""
    template, machine = template or Template(), machine or Machine()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # rows without an id are apart: no task gathers them
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    named = conversations.select("conv_id", "turn", "role", "text", own.alias("own"))
    turns = named.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def render(t: Column) -> Column:
        parts = []
        for kind, value, roles in template.segments:
            text = F.lit(value) if kind == "literal" else escape(t[kind], template)
            parts.append(F.struct(text.alias("text"), (t["role"].isin(*roles) if roles else F.lit(False)).alias("loss")))
        return F.array(*parts)

    allowed = F.array(*(F.lit(f"{a}>{b}") for a, to in machine.moves.items() for b in to))
    walk = F.aggregate(
        F.col("turns"),
        F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")),
        lambda s, t: F.struct(t["role"].alias("state"), (s["at"] + 1).alias("at"), F.coalesce(s["bad"], F.when(~F.array_contains(allowed, F.concat(s["state"], F.lit(">"), t["role"])), s["at"])).alias("bad")),
    )
    made = turns.select("conv_id", F.flatten(F.transform("turns", render)).alias("segments"), walk.alias("walk"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return made.select("conv_id", "segments", formatted.alias("formatted"), (F.col("walk.bad").isNull() & F.col("walk.state").isin(*machine.ends)).alias("valid"), F.col("walk.bad").alias("first_bad"))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Adds turns array<struct<role, text>>, recovered from the formatted string, and loss_text, from the segments."""
    template = template or Template()
    parts = F.split("formatted", f"\\Q{template.close}\\E", -1)
    marked = F.slice(parts, 1, F.size(parts) - 1)

    def parse(p: Column) -> Column:
        body = F.substr(p, F.lit(len(template.open) + 1))
        at = F.instr(body, template.after_role)
        return F.struct(unescape(F.substr(body, F.lit(1), at - 1), template).alias("role"), unescape(F.substr(body, at + len(template.after_role)), template).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    return formatted.withColumns({"turns": F.transform(marked, parse), "loss_text": loss})


def digests(conversations: DataFrame, template: Template | None = None, machine: Machine | None = None) -> DataFrame:
    """What the formatted output says of itself, one row a conversation."""
    back = read_back(format_conversations(conversations, template, machine), template)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("first_bad").cast("long").alias("first_bad"),
    )
