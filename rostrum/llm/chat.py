"""Chat formatting by prefix-target expansion.  DataFrame functions only.

A turn is written ``<|turn|>role<|text|>text<|end|>`` and a line end.  In roles and texts, control strings (of this template
and of other common ones) get a backslash after their first character, and backslashes are doubled, so that unescape()
gives the text back and no control string of a text reaches the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END = "<|end|>\n"
CONTROL = r"(\\)|(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put into each control string."""
    return F.regexp_replace(text, CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\)?", "$1")


def turns(conversations: DataFrame) -> DataFrame:
    """A row per turn: conv_id, role, n (its place from 1), its segment and the lengths of what stands before and of its text.

    Null roles and texts are empty.  Turns are put in order by turn (null first), role, text.  A null conv_id is one conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("<|turn|>"), escape(F.col("role")), F.lit("<|text|>"))
    return (
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("_t"))
        .withColumns({"_head": head, "_body": escape(F.col("_t"))})
        .select(
            "conv_id", "role", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "_t")).alias("n"),
            F.concat("_head", "_body", F.lit(END)).alias("segment"), F.length("_body").alias("body_chars"),
        )
    )


def examples(conversations: DataFrame, whole: bool = False) -> DataFrame:
    """Each assistant turn as its own example: conv_id, target (the turn's place), text (all turns before and the reply, written out),
    and loss_start and loss_chars, the characters (from 0) that are trained on: only that reply.

    With ``whole``, a conversation that doesn't end with a reply has one more row, of all its turns, with no target and nothing trained
    on, so the output holds every turn.  Conversations are dealt by conv_id and their prefixes are written row by row, so a
    task holds one conversation and one prefix at a time; what is written grows with the square of a conversation's turns.
    """
    turn = F.struct("n", "segment", "body_chars", (F.col("role") == "assistant").alias("reply"))
    each = turns(conversations).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_s"))
    targets = F.filter("_s", lambda s: s["reply"] | (s["n"] == F.size("_s")) if whole else s["reply"])
    rows = each.select("conv_id", "_s", F.explode(F.transform(targets, lambda s: F.struct(s["n"].alias("n"), s["reply"].alias("reply"), s["body_chars"].alias("body")))).alias("t"))
    rows = rows.select("conv_id", F.when(F.col("t.reply"), F.col("t.n")).alias("target"), F.array_join(F.slice("_s.segment", F.lit(1), F.col("t.n")), "").alias("text"), F.col("t.body").alias("body"))
    return rows.select("conv_id", "target", "text", (F.length("text") - F.col("body") - len(END)).alias("loss_start"), F.when(F.col("target").isNotNull(), F.col("body")).otherwise(0).alias("loss_chars"))


def read_back(output: DataFrame) -> DataFrame:
    """What the rows of ``examples(whole=True)`` say of each conversation: its turns, from the longest example, and all text under the
    loss masks, in order of the targets."""
    reply = F.when(F.col("target").isNotNull(), F.struct("target", unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_chars"))).alias("said")))
    each = output.withColumns({"_n": F.length("text"), "_reply": reply}).groupBy("conv_id").agg(
        F.max_by("text", "_n").alias("_whole"), F.array_sort(F.collect_list("_reply")).alias("_replies"), F.count("target").alias("n_examples"), F.sum("_n").alias("examples_chars"),
    )
    found = lambda pattern: F.transform(F.regexp_extract_all("_whole", F.lit(pattern), F.lit(1)), unescape)
    df = each.withColumns({"_roles": found(r"(?s)<\|turn\|>(.*?)<\|text\|>"), "_texts": found(r"(?s)<\|text\|>(.*?)<\|end\|>"), "_loss": F.array_join("_replies.said", "")})
    said = F.array_join(F.zip_with("_roles", "_texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return df.select(
        "conv_id", F.size("_roles").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"), F.length("_whole").cast("long").alias("formatted_chars"),
        "n_examples", F.col("examples_chars").cast("long").alias("examples_chars"),
    )
