"""Chat formatting by prefix-target expansion (native).

Every assistant turn becomes one training example: all preceding turns as context, then that reply,
which alone is trainable (a span of code points).  Turns after the last reply, or a conversation
without any reply, form one more example without a trainable span, so that no turn is lost.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts ``%`` is
written ``%25`` and ``<|`` is written ``%3C|`` (and a line break of a role ``%0A``), so a text can
never forge a mark; :func:`unescape` reverses it.

Defined results: null text and null role are empty; rows of equal turn number are ordered by role,
then formatted text; repeated rows are separate turns; null turns come first; a null conversation id is one
conversation; an empty table gives no example.  Only columns named by the caller are read, so extra
columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesmith.llm.common import bind

START, END = "<|im_start|>", "<|im_end|>\n"
END_PATTERN = r"<\|im_end\|>\n"


def escape(text: Column, line_breaks: bool = False) -> Column:
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))
    return F.replace(t, F.lit("\n"), F.lit("%0A")) if line_breaks else t


def unescape(text: Column, line_breaks: bool = False) -> Column:
    t = F.replace(text, F.lit("%0A"), F.lit("\n")) if line_breaks else text
    return F.replace(F.replace(t, F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def expand_prefixes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """``(conv_id, example_no, is_last, text, loss_start, loss_length)``: one row per example.

    ``loss_start`` counts code points from 0; ``loss_length`` is null in an example without a
    trainable reply.  A conversation is gathered once (its longest example holds all of it anyway).
    """
    role = escape(F.col(role_col), line_breaks=True)
    body = escape(F.col(text_col))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                 F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END)).alias("piece"),
                 F.coalesce(F.col(role_col) == target_role, F.lit(False)).alias("target"),
                 F.length(body).alias("body_chars")).alias("t"))
    convs = (rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
             .select("conv_id", F.transform("ts", lambda t: F.struct(t["piece"].alias("piece"), t["target"].alias("target"),
                                                                    t["body_chars"].alias("body_chars"))).alias("ts")))
    n = F.size("ts")
    ends = F.filter(F.sequence(F.lit(1), n),
                    lambda i: F.element_at(F.col("ts"), i)["target"] | (i == F.size("ts")))
    ex = convs.select("conv_id", "ts", F.posexplode(ends).alias("example_no", "upto"))
    last = F.element_at("ts", F.col("upto"))
    text = F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("upto")), lambda t: t["piece"]), "")
    ex = ex.select("conv_id", "example_no", (F.col("upto") == n).alias("is_last"), text.alias("text"),
                   F.when(last["target"], last["body_chars"]).alias("loss_length"))
    return ex.select("conv_id", "example_no", "is_last", "text",
                     F.when(F.col("loss_length").isNotNull(),
                            F.length("text") - F.col("loss_length") - len(END)).alias("loss_start"), "loss_length")


def loss_text(text: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example, unescaped (empty without a span)."""
    return F.when(length.isNotNull(), unescape(F.substring(text, start + 1, length))).otherwise(F.lit(""))


def parse_turns(text: Column) -> Column:
    """The turns of a formatted text as an array of ``(role, text)``, unescaped."""
    pieces = F.split(text, END_PATTERN)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        inner = F.substring(p, len(START) + 1, 1 << 30)
        cut = F.instr(inner, "\n")
        return F.struct(unescape(F.left(inner, cut - 1), line_breaks=True).alias("role"),
                        unescape(F.substring(inner, cut + 1, F.length(inner))).alias("text"))
    return F.transform(pieces, turn)


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: number and digest of its turns, characters
    and digest of its trainable text in order, and characters of all its examples."""
    turns = F.when(F.col("is_last"), parse_turns(F.col("text")))
    listed = bind(turns, lambda ts: F.struct(
        F.size(ts).cast("long").alias("n"),
        F.sha2(F.encode(F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
                        "utf-8"), 256).alias("h")))
    per = examples.select(
        "conv_id", "example_no", F.length("text").cast("long").alias("chars"), F.when(F.col("is_last"), listed).alias("all"),
        loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("reply"))
    got = per.groupBy("conv_id").agg(
        F.max("all").alias("all"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example_no", "reply"))).alias("replies"))
    said = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    return got.select(
        "conv_id", F.col("all")["n"].alias("n_turns"), F.col("all")["h"].alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"), F.sha2(F.encode(said, "utf-8"), 256).alias("loss_sha256"),
        "formatted_chars")
