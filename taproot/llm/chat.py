"""Chat formatting, by Spark expressions only.

A conversation is its turns in order.  Adjacent turns of one role make one
message; a separator keeps them apart inside it.  The template:

    <s> then for each message
    [INST]text[TURN]text[/INST]            a user's
    [OUT]text[TURN]text</s>                an assistant's
    [ROLE]role[/ROLE]text[TURN]text[/MSG]  anyone else's

Escaping doubles every backslash and puts one after the first character of each
control string, so no control string is left inside a text or a role, and
removing them again gives the text back whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[TURN]", "[/MSG]")
_FIND = "([<\\[])(s>|/s>|INST\\]|/INST\\]|OUT\\]|ROLE\\]|/ROLE\\]|TURN\\]|/MSG\\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_FIND), F.lit("$1\\\\$2"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("\\\\(\\\\?)"), F.lit("$1"))


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: formatted, and loss, the [start, end) ranges of assistant texts in it.

    Null texts and roles count as empty.  Turns are taken by turn, null first;
    ties go by role, then text; repeated rows are turns of their own.  Rows
    without conv_id make one conversation.  A conversation is one output row, so
    its turns meet in one task; no step holds more than one conversation.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # The first turn of each message, and its texts with their separators.
    n = F.size("turns")
    heads = F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or turns[i].role <> turns[i - 1].role)")
    rows = rows.withColumn("heads", heads)
    ends = F.expr("transform(heads, (h, j) -> named_struct('role', turns[h].role, 'texts', transform(slice(turns, h + 1, coalesce(get(heads, j + 1), size(turns)) - h), t -> t.text)))")
    rows = rows.withColumn("messages", ends).select("conv_id", n.alias("n_turns"), "messages")

    def piece(m: Column) -> Column:
        user, answer = m["role"] == "user", m["role"] == "assistant"
        opening = F.when(user, "[INST]").when(answer, "[OUT]").otherwise(F.concat(F.lit("[ROLE]"), escaped(m["role"]), F.lit("[/ROLE]")))
        closing = F.when(user, "[/INST]").when(answer, "</s>").otherwise("[/MSG]")
        texts = F.transform(m["texts"], escaped)
        return F.struct(opening.alias("opening"), texts.alias("texts"), closing.alias("closing"), answer.alias("answer"))

    rows = rows.withColumn("pieces", F.transform("messages", piece))
    whole = F.concat(F.lit("<s>"), F.array_join(F.transform("pieces", lambda p: F.concat(p["opening"], F.array_join(p["texts"], "[TURN]"), p["closing"])), ""))
    # Every text with the length of what stands before it since the last text.
    parts = F.flatten(
        F.transform(
            "pieces",
            lambda p: F.transform(
                p["texts"],
                lambda t, i: F.struct(
                    F.when(i == 0, F.length(p["opening"])).otherwise(len("[TURN]")).alias("skip"),
                    F.length(t).alias("n"),
                    F.when(i == F.size(p["texts"]) - 1, F.length(p["closing"])).otherwise(0).alias("after"),
                    p["answer"].alias("answer"),
                ),
            ),
        )
    )
    zero = F.struct(F.lit(3).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    loss = F.aggregate(
        parts,
        zero,
        lambda a, p: F.struct(
            (a["at"] + p["skip"] + p["n"] + p["after"]).alias("at"),
            F.when(p["answer"], F.concat(a["spans"], F.array(F.struct((a["at"] + p["skip"]).alias("start"), (a["at"] + p["skip"] + p["n"]).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return rows.select("conv_id", F.size("messages").cast("long").alias("n_messages"), whole.alias("formatted"), loss.alias("loss"))


def read_back(rows: DataFrame) -> DataFrame:
    """``rows`` with turns, an array of (role, text) parsed from formatted alone, and loss_text."""
    found = F.regexp_extract_all("formatted", F.lit("(?s)(?:\\[INST\\]|\\[OUT\\]|\\[ROLE\\]).*?(?:\\[/INST\\]|</s>|\\[/MSG\\])"), F.lit(0))

    def turns(m: Column) -> Column:
        user, answer = F.startswith(m, F.lit("[INST]")), F.startswith(m, F.lit("[OUT]"))
        role = F.when(user, "user").when(answer, "assistant").otherwise(unescaped(F.regexp_extract(m, "(?s)^\\[ROLE\\](.*?)\\[/ROLE\\]", 1)))
        body = F.regexp_replace(m, "(?s)^(?:\\[INST\\]|\\[OUT\\]|\\[ROLE\\].*?\\[/ROLE\\])|(?:\\[/INST\\]|</s>|\\[/MSG\\])$", "")
        return F.transform(F.split(body, "\\[TURN\\]", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    spans = F.transform("loss", lambda s: unescaped(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"])))
    return rows.withColumn("turns", F.flatten(F.transform(found, turns))).withColumn("loss_text", F.array_join(spans, ""))


def digests(rows: DataFrame) -> DataFrame:
    """What the formatted output holds when it is read back."""
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(rows).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_messages",
    )
