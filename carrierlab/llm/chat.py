"""Chat formatting in budgeted windows of whole turns.

DataFrame functions only. A conversation's turns are measured and summed up in
order; blocks of turns are summed first and then inside each block, so that one
long conversation is not summed in one task. The sums choose the windows:

* a turn of more than half the room is a window by itself;
* other turns fall in cells of half the room by the sum before them, so that a
  window (a cell between long turns) never exceeds the room;
* the system turn, if the conversation begins with one, opens every window;
* the last turns of the window before, as many as fit ``history``, are repeated
  in front of the window's own turns.

Repeated turns are never trained on. ``loss`` lists the spans (start, length in
code points of ``formatted``) of the window's own assistant texts.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles a
backslash is doubled and ``<|`` becomes ``<\\|``; in roles a line feed becomes
``<\\n|``. ``unescape`` turns this back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"

BUDGET, HISTORY, MARKS, BLOCK = 2048, 256, 4, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def turn_tokens(text: Column) -> Column:
    """Words of the text and the marks around it."""
    return (F.regexp_count(text, F.lit("\\S+")) + MARKS).cast("long")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_turns, n_repeated, loss.

    ``turns`` has conv_id, turn, role, text. Rows are taken in order of turn,
    then role, then text, nulls first; repeated rows are separate turns; null
    roles and texts count as empty; a null conv_id is a conversation of its
    own. Extra columns are ignored; an empty table gives an empty result. A
    window has at most ``budget`` tokens (words, and four for each turn) unless
    its system turn and one own turn have more. Windows are numbered in order,
    with gaps.
    """
    rows = turns.select(
        F.struct("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", turn_tokens(F.col("text")))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    # What opens a conversation, found by aggregation: its least turn.
    opening = rows.groupBy("conv").agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("first"))
    opening = opening.select("conv", F.when(F.col("first.role") == "system", F.col("first.text")).alias("system"),
                             F.when(F.col("first.role") == "system", F.col("first.tokens")).otherwise(0).alias("lead"))
    room = F.greatest(F.lit(budget) - F.col("lead") - history, F.lit(2))
    rows = rows.join(opening, "conv").withColumn("half", F.floor(room / 2)).withColumn(
        "alone", (F.col("tokens") > F.col("half")).cast("long"))
    blocks = rows.groupBy("conv", "block").agg(
        F.sum("tokens").alias("t"), F.sum("alone").alias("a"), F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("t", "a", "c")])
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = (rows.join(blocks, ["conv", "block"])
            .withColumn("before", F.col("t") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
            .withColumn("number", F.col("c") + F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)))
            .withColumn("longs", F.col("a") + F.coalesce(F.sum("alone").over(inside), F.lit(0))))
    # Long turns before this one separate cells; a long turn follows them.
    rows = rows.withColumn("key", F.struct(
        (F.col("longs") + F.col("alone")).alias("longs"), (1 - F.col("alone")).alias("kind"),
        F.when(F.col("alone") == 0, F.floor(F.col("before") / F.col("half"))).otherwise(0).alias("cell")))
    rows = rows.select("conv", "key", "number", "role", "text", "tokens", "before", "system")
    spans = rows.groupBy("conv", "key").agg(
        F.min("number").alias("from"), (F.max("number") + 1).alias("to"),
        F.min("before").alias("begin"), F.max(F.col("before") + F.col("tokens")).alias("end"))
    after = spans.select("conv", F.col("from").alias("to"), F.col("from").alias("window"))
    # Where the turns of each window repeat: in the window that begins where it ends.
    spans = spans.join(after, ["conv", "to"], "left")
    rows = rows.join(spans.select("conv", "key", "from", "end", F.col("window").alias("following")), ["conv", "key"])
    again = (F.col("end") - F.col("before") <= history) & F.col("following").isNotNull() & ~(
        (F.col("number") == 0) & F.col("system").isNotNull())
    rows = rows.select("conv", "number", "role", "text", "system", F.explode(F.when(again, F.array(
        F.struct(F.col("from").alias("window"), F.lit(False).alias("repeated")),
        F.struct(F.col("following").alias("window"), F.lit(True).alias("repeated")),
    )).otherwise(F.array(F.struct(F.col("from").alias("window"), F.lit(False).alias("repeated"))))).alias("at"))
    grouped = rows.groupBy("conv", F.col("at.window").alias("window")).agg(
        F.max("system").alias("system"),
        F.array_sort(F.collect_list(F.struct(
            "number", F.col("at.repeated").alias("repeated"), "role", "text"))).alias("turns"))
    own = F.transform("turns", lambda t: F.struct(t["repeated"].alias("repeated"), t["role"].alias("role"),
                                                  t["text"].alias("text")))
    shown = F.when(F.col("system").isNotNull() & (F.col("window") > 0), F.concat(F.array(F.struct(
        F.lit(True).alias("repeated"), F.lit("system").alias("role"), F.col("system").alias("text"))), own)
    ).otherwise(own)
    parts = F.transform(shown, lambda t: F.struct(
        t["repeated"].alias("repeated"), (t["role"] == "assistant").alias("target"),
        F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    tail = F.lit(END + "\n")
    grouped = grouped.select("conv.conv_id", "window", parts.alias("parts"))
    offsets = F.aggregate(
        "parts", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("loss")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END) + 1).alias("at"),
            F.when(t["target"] & ~t["repeated"], F.concat(acc["loss"], F.array(F.struct(
                (acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length")))))
            .otherwise(acc["loss"]).alias("loss")))
    return grouped.select(
        "conv_id", "window",
        F.array_join(F.transform("parts", lambda t: F.concat(t["head"], t["body"], tail)), "").alias("formatted"),
        F.size("parts").alias("n_turns"),
        F.size(F.filter("parts", lambda t: t["repeated"])).alias("n_repeated"),
        offsets["loss"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation out of ``windows`` alone.

    Takes the turns that are not repeats out of each formatted window and
    returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars. A digest runs over a conversation's text in order, so a
    conversation is gathered in one row here, and only here.
    """
    pieces = F.slice(F.split("formatted", "<\\|im_start\\|>"), F.col("n_repeated") + 2, F.greatest(
        F.col("n_turns") - F.col("n_repeated"), F.lit(0)))
    said = F.transform(pieces, lambda p: F.concat(
        unescape_role(F.substring_index(p, "\n", 1)), F.lit("\n"),
        unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2,
                             F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 2 - len(END))),
        F.lit("\n")))
    loss = F.transform("loss", lambda s: unescape(F.substring(
        "formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    per = formatted.select(
        F.struct("conv_id").alias("conv"), "window", F.size(pieces).alias("n"), F.array_join(said, "").alias("said"),
        F.array_join(loss, "").alias("loss"), F.length("formatted").cast("long").alias("chars"))
    whole = per.groupBy("conv").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        "conv.conv_id", "n_turns",
        F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars")
