"""Chat formatting: a state machine over roles checks turn order, and a declarative template emits text segments.

Everything is DataFrame expressions. Each segment carries a loss flag; control strings inside texts are escaped
so that the formatted text can be read back turn by turn.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import let


@dataclass(frozen=True)
class Template:
    """A turn is ``open`` + role name + ``colon`` + text + ``close``; roles without a name are marked @role."""

    open: str = "### "
    colon: str = ": "
    close: str = "</turn>\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    loss: frozenset[str] = frozenset({"assistant"})
    #: Control strings and what stands for them in a text, once its backslashes are doubled.
    escapes: tuple[tuple[str, str], ...] = (("</turn>", "<\\/turn>"), ("### ", "#\\## "))


#: State machine: (state, role) -> state. A role that isn't listed for a state is an error, which lasts.
MOVES = {
    ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
    ("user", "assistant"): "assistant", ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant",
}
ACCEPTED = ("assistant", "user")


def escape(text: Column, t: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, safe in t.escapes:
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescape(text: Column, t: Template) -> Column:
    out = text
    for plain, safe in reversed(t.escapes):
        out = F.replace(out, F.lit(safe), F.lit(plain))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _name(role: Column, t: Template) -> Column:
    out = F.concat(F.lit("@"), F.replace(F.replace(escape(role, t), F.lit("~"), F.lit("~~")), F.lit(":"), F.lit("~.")))
    for r, n in t.names.items():
        out = F.when(role == r, F.lit(n)).otherwise(out)
    return out


def _role(name: Column, t: Template) -> Column:
    # ~~ and ~. are told apart by hiding the first behind a character that names can't hold once escaped.
    held = F.replace(F.replace(F.replace(F.substr(name, F.lit(2)), F.lit("~~"), F.lit("~:")), F.lit("~."), F.lit(":")), F.lit("~:"), F.lit("~"))
    out = unescape(held, t)
    for r, n in t.names.items():
        out = F.when(name == n, F.lit(r)).otherwise(out)
    return out


def order_state(roles: Column) -> Column:
    """struct(state, at): the machine's last state, and the turn at which it failed (null if it didn't)."""
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("at"))

    def step(acc: Column, role: Column) -> Column:
        to = F.lit("error")
        for (state, r), then in MOVES.items():
            to = F.when((acc["state"] == state) & (role == r), F.lit(then)).otherwise(to)
        return let(to, lambda s: F.struct(s.alias("state"), (acc["n"] + 1).alias("n"), F.when(acc["at"].isNotNull(), acc["at"]).when(s == "error", acc["n"]).alias("at")))

    return F.aggregate(roles, start, step, lambda acc: F.struct(acc["state"].alias("state"), acc["at"].alias("at")))


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation: conv_id, segments (array of text, loss), formatted, valid, failed_at.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Null texts and roles are empty. Turns are in order of
    turn, then role, then text, nulls first; repeated rows are turns of their own. Conversations in an order
    that the machine rejects are formatted too, with valid false and the place of the first wrong turn.
    A formatted conversation is one value, so all its turns meet in one row; texts of any length are whole. Rows with a null conv_id are one
    conversation of that id. An empty table gives an empty result.
    """
    t = template or Template()
    plain = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = plain.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def emitted(x: Column) -> Column:
        flagged = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(t.open), _name(x["role"], t), F.lit(t.colon))
        return F.array(flagged(head, F.lit(False)), flagged(escape(x["text"], t), x["role"].isin(sorted(t.loss))), flagged(F.lit(t.close), F.lit(False)))

    out = grouped.withColumn("segments", F.flatten(F.transform("turns", emitted))).withColumn("order", order_state(F.transform("turns", lambda x: x["role"])))
    return out.select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("order.state").isin(*ACCEPTED).alias("valid"), F.col("order.at").alias("failed_at"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: array of struct(role, text)."""
    t = template or Template()
    blocks = F.split(formatted, f"\\Q{t.close}\\E")

    def turn(block: Column) -> Column:
        return let(
            F.instr(block, t.colon),
            lambda at: F.struct(
                _role(F.substr(block, F.lit(len(t.open) + 1), at - (len(t.open) + 1)), t).alias("role"),
                unescape(F.substr(block, at + len(t.colon)), t).alias("text"),
            ),
        )

    return let(blocks, lambda b: F.transform(F.slice(b, 1, F.size(b) - 1), turn))


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
