"""Chat formatting with a grammar round trip. DataFrame operations only.

    conversation := turn ("\\n" turn)*
    turn         := "[INST] " body " [/INST]"              role user
                  | "<s> " body " </s>"                     role assistant
                  | "<<ROLE " name ">> " body " <</ROLE>>"  any other role
    body         := text without a control string

A turn is rendered plainly first, parsed again and compared with its source; where the parse fails or
differs its text is escaped further until both are identical: level 1 escapes the first letter of control
strings (and what looks like an escape), level 2 every letter that could begin one. The parser always
undoes escapes: ``&#91;`` ``&#60;`` ``&#62;`` stand for ``[ < >`` and ``&amp;`` for ``&``.

Nulls: a null text or role is the empty string; rows of a null conversation form one conversation.
Turns with equal numbers are ordered by role and text; null turn numbers come first. Repeated rows are
repeated turns. Every conversation becomes one string, as its consumer needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import absent

#: The template's control strings.
CONTROL = r"\[/?INST\]|</?s>|<<ROLE|<</ROLE>>"
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|<<ROLE [^<>\[]*>> .*? <</ROLE>>"


def escape(text: Column, level: int) -> Column:
    if level == 0:
        return text
    if level == 1:
        text = F.regexp_replace(text, r"&(?=amp;|#91;|#60;|#62;)", "&amp;")
        text = F.regexp_replace(text, r"\[(?=/?INST\])", "&#91;")
        return F.regexp_replace(text, r"<(?=/?s>|<ROLE|</ROLE>>)", "&#60;")
    for letter, code in (("&", "&amp;"), ("[", "&#91;"), ("<", "&#60;"), (">", "&#62;")):
        text = F.replace(text, F.lit(letter), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for code, letter in (("&#91;", "["), ("&#60;", "<"), ("&#62;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(letter))
    return text


def opening(role: Column) -> Column:
    return F.when(role == "user", "[INST] ").when(role == "assistant", "<s> ").otherwise(F.concat(F.lit("<<ROLE "), escape(role, 2), F.lit(">> ")))


def closing(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "assistant", " </s>").otherwise(" <</ROLE>>")


def _parsed(turn: Column) -> Column:
    """(role, body, begin): a turn's role, its escaped body, and where the body begins in it."""
    named = F.regexp_extract(turn, r"^<<ROLE ([^<>\[]*)>> ", 1)
    begin = F.when(turn.startswith("[INST] "), 7).when(turn.startswith("<s> "), 4).otherwise(F.length(named) + 10)
    end = F.when(turn.startswith("[INST] "), 8).when(turn.startswith("<s> "), 5).otherwise(10)
    role = F.when(turn.startswith("[INST] "), "user").when(turn.startswith("<s> "), "assistant").otherwise(unescape(named))
    return F.struct(role.alias("role"), F.substring(turn, begin + 1, F.length(turn) - begin - end).alias("body"), begin.cast("long").alias("begin"))


def parse_turns(formatted: Column) -> Column:
    """array<(turn, role, body, begin, at)>: all turns; ``at`` is where the turn begins."""
    turns = F.regexp_extract_all(formatted, F.lit(TURN), 0)
    parsed = F.transform(turns, lambda t: F.struct(t.alias("turn"), _parsed(t).alias("p")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
    places = F.aggregate(
        turns, zero, lambda s, t: F.struct((s["at"] + F.length(t) + 1).cast("long").alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))
    )["all"]
    return F.zip_with(
        parsed, places, lambda x, at: F.struct(x["turn"].alias("turn"), x["p"]["role"].alias("role"), x["p"]["body"].alias("body"), x["p"]["begin"].alias("begin"), at.alias("at"))
    )


def render_turns(rows: DataFrame, *, role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` with ``rendered``: the least escaped form whose parse is identical to its source."""
    out = rows.withColumns({"__role": F.coalesce(F.col(role), F.lit("")), "__text": F.coalesce(F.col(text), F.lit(""))})
    role_, text_ = F.col("__role"), F.col("__text")

    def rendered(level: int) -> Column:
        return F.concat(opening(role_), escape(text_, level), closing(role_))

    def identical(level: int) -> Column:
        whole = rendered(level)
        found = F.regexp_extract_all(whole, F.lit(TURN), 0)
        first = _parsed(F.try_element_at(found, F.lit(1)))
        fine = (F.size(found) == 1) & (F.try_element_at(found, F.lit(1)) == whole) & (first["role"] == role_) & (unescape(first["body"]) == text_)
        return fine & ~first["body"].rlike(CONTROL)

    level = F.when(identical(0), 0).when(identical(1), 1).otherwise(2)
    out = out.withColumn("escape_level", level)
    best = F.when(F.col("escape_level") == 0, rendered(0)).when(F.col("escape_level") == 1, rendered(1)).otherwise(rendered(2))
    return out.withColumn("rendered", best)


def format_conversations(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, n_escaped): one string for each conversation."""
    base = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    turns = render_turns(base).select("conv_id", F.struct("turn", F.col("__role").alias("role"), F.col("__text").alias("text"), "rendered").alias("t"), (F.col("escape_level") > 0).cast("long").alias("escaped"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("all"), F.sum("escaped").alias("n_escaped"))
    return grouped.select("conv_id", F.array_join(F.transform("all", lambda t: t["rendered"]), "\n").alias("formatted"), "n_escaped")


def loss_spans(turns: Column) -> Column:
    """array<(begin, length)>: the letters of ``formatted`` that a model is trained on."""
    theirs = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.transform(theirs, lambda t: F.struct((t["at"] + t["begin"]).alias("begin"), F.length(t["body"]).cast("long").alias("length")))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with its parsed ``turns`` (role, text) and the ``mask`` of trained letters; columns of those names are replaced."""
    own = absent(formatted.columns, "parsed")
    parsed = formatted.withColumn(own, parse_turns(F.col("formatted")))
    return parsed.select(
        *(F.col(f"`{c}`") for c in formatted.columns if c.lower() not in ("turns", "mask")),
        F.transform(own, lambda t: F.struct(t["role"].alias("role"), unescape(t["body"]).alias("text"))).alias("turns"),
        loss_spans(F.col(own)).alias("mask"),
    )
