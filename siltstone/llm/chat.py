"""Chat formatting by DataFrame functions only: each assistant turn becomes an example of its own.

An example's text is the whole conversation up to and with its target turn, in the template

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

and only the target's text is trainable; its place is the example's loss span (in code points, from 0). Turns after the last
assistant turn are kept in one more example with no loss. Control strings inside texts and roles are broken up by a tilde
after their first character (and a tilde is doubled), so that no text can open or close a turn; unescape() takes that back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: First two characters of the control strings of common templates: <|...|>, </s>, <s>, <S..., <<SYS>>, [INST], [/INST].
OPENERS = ("<|", "</", "<s", "<S", "[I", "[/")


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("~"), F.lit("~~"))
    for x in OPENERS:
        c = F.replace(c, F.lit(x), F.lit(f"{x[0]}~{x[1]}"))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)~(.)", "$1")


def escape_role(c: Column) -> Column:
    """A role is one line: a line feed in it becomes <~n, which no escaped text contains."""
    return F.replace(escape(c), F.lit("\n"), F.lit("<~n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<~n"), F.lit("\n")))


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, example long, is_last boolean, text, loss_start long, loss_chars long) for turns of (conv_id, turn, role, text).

    Turns are taken by turn, then role, then text (nulls first), so that ties and repeated rows have one order. Null texts and
    roles are empty; rows with a null conv_id are one conversation. A conversation is one value of at most 2 GB, as a document
    is. Conversations without an assistant turn have one example with no loss. Other columns are not read.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    whole = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    made = whole.select(
        "conv_id",
        F.transform("ts", lambda t: F.struct((t["role"] == "assistant").alias("target"), F.length(head(t)).alias("head"), F.concat(head(t), escape(t["text"]), F.lit(END)).alias("text"))).alias("ts"),
    )
    grown = F.aggregate(  # the end of each turn in the transcript, by one pass
        "ts",
        F.array().cast("array<long>"),
        lambda ends, t: F.concat(ends, F.array(F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0).cast("long")) + F.length(t["text"]))),
    )
    laid = made.select("conv_id", "ts", F.array_join(F.transform("ts", lambda t: t["text"]), "").alias("all"), F.size("ts").alias("n"), grown.alias("ends"))
    span = F.explode(F.filter(F.arrays_zip(F.sequence(F.lit(1), F.col("n")).alias("k"), F.transform("ts", lambda t: t["target"]).alias("target"), F.transform("ts", lambda t: t["head"]).alias("head"), F.col("ends").alias("end")), lambda x: x["target"] | (x["k"] == F.col("n"))))
    rows = laid.select("conv_id", "all", "ends", span.alias("x"))
    begin = F.when(F.col("x.k") == 1, F.lit(0).cast("long")).otherwise(F.element_at("ends", F.greatest(F.col("x.k") - 1, F.lit(1))))
    start = begin + F.col("x.head")
    return rows.select(
        "conv_id",
        F.col("x.k").cast("long").alias("example"),
        (F.col("x.k") == F.size("ends")).alias("is_last"),
        F.substring("all", F.lit(1), F.col("x.end").cast("int")).alias("text"),
        F.when(F.col("x.target"), start).otherwise(F.col("x.end")).cast("long").alias("loss_start"),
        F.when(F.col("x.target"), F.col("x.end") - len(END) - start).otherwise(F.lit(0)).cast("long").alias("loss_chars"),
    )


def read_turns(text: Column) -> Column:
    """The (role, text) of each turn in an example's text."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda x: x != "")

    def one(x: Column) -> Column:
        at = F.instr(x, "\n")
        return F.struct(unescape_role(F.substring(x, F.lit(len(START) + 1), at - 1 - len(START))).alias("role"), unescape(F.substring(x, at + 1, F.length(x))).alias("text"))

    return F.transform(parts, one)


def read_loss(text: Column, start: Column, chars: Column) -> Column:
    return unescape(F.substring(text, (start + 1).cast("int"), chars.cast("int")))
