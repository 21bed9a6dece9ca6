"""Chat formatting with DataFrame functions only.

A template declares the marks, the roles that may follow each state, and the roles whose
text is trained on.  A finite-state machine (a fold over the turns) checks the order of
roles; another fold emits the conversation as segments of text, each with its loss flag.
Every conversation is formatted whether its order is valid or not; ``valid`` tells.

Marks begin with ``<|``.  In texts and roles each backslash is doubled and ``<|`` becomes
``<\\|``; in roles a newline becomes ``<\\n`` too.  A doubled run of backslashes is even,
the one put in is alone, so the escapes undo without ambiguity and no mark can come from a
text.

Results: null roles and texts count as empty; turns go by number, then role, then text,
missing numbers first; rows without a conv_id form one conversation; repeated rows count.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    after_role: str = "\n"
    trained: tuple[str, ...] = ("assistant",)
    #: Of each state, the roles that may come; a role's state has its name.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<\\n"), F.lit("\n")))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_conversations(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, valid, segments (array of text, loss) and formatted, of each conversation."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    machine = F.create_map(*[x for state, roles in template.follows.items() for r in roles for x in (F.lit(f"{state}>{r}"), F.lit(r))])
    state = F.aggregate("turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(machine, F.concat(s, F.lit(">"), t["role"])), F.lit("invalid")))
    parts = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                _segment(F.concat(F.lit(template.begin), escape_role(t["role"]), F.lit(template.after_role)), F.lit(False)),
                _segment(escape(t["text"]), t["role"].isin(*template.trained)),
                _segment(F.lit(template.end), F.lit(False)),
            ),
        )
    )
    out = convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*template.final).alias("valid"), parts.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Adds to ``formatted`` the turns (array of role, text) read from its text, and the trained text read from its segments."""
    blocks = F.filter(F.split("formatted", "\\Q" + template.begin + "\\E"), lambda x, i: i > 0)

    def turn(b: Column) -> Column:
        body = F.substring(b, F.lit(1), F.length(b) - len(template.end))
        at = F.position(F.lit(template.after_role), body)
        return F.struct(unescape_role(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(F.substring(body, at + len(template.after_role), F.length(body))).alias("text"))

    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.withColumn("turns", F.transform(blocks, turn)).withColumn("trained_text", trained)
