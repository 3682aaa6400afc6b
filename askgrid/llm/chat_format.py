"""Conversations as training text, by Spark expressions alone.

Turn structs of a conversation are collected and sorted, adjacent turns of one role merged,
and everything joined into one string:

    <s>[INST] role [/INST]text<sep>text of the next turn of this role</s><s>[INST] ...

Control strings inside a text or a role get a backslash after their first character, one more
than they had, so no text can end a turn and every text can be read back. The loss mask is a
list of spans of code points, one for each assistant text, without markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, CLOSE, SEP = "<s>[INST] ", " [/INST]", "</s>", "<sep>"
CONTROL = r"([<\[])(\\*)(s>|/s>|sep>|INST\]|/INST\])"
ESCAPED = r"([<\[])\\(\\*)(s>|/s>|sep>|INST\]|/INST\])"
LOSS_ROLES = ("assistant",)
RUN = 256


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2$3")


def running_total(lengths: Column) -> Column:
    """Sum of all elements before each one. Runs of 256 are summed first, so the copies that
    growing an array makes stay short."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")),
                       lambda b: F.slice(lengths, b * RUN + 1, RUN))
    grow = lambda xs, start: F.aggregate(
        xs, F.struct(F.array().cast("array<bigint>").alias("a"), start.alias("s")),
        lambda acc, x: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"), (acc["s"] + x).alias("s")))["a"]
    sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("bigint"), lambda acc, x: acc + x))
    starts = grow(sums, F.lit(0).cast("bigint"))
    return F.flatten(F.zip_with(runs, starts, grow))


def sorted_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, role, text) in order. Turns are gathered in runs first,
    so a conversation of very many turns arrives in few rows."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    runs = rows.select("conv_id", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / RUN).alias("run"), turn.alias("t")).groupBy("conv_id", "run").agg(
        F.sort_array(F.collect_list("t")).alias("ts"))
    return runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "ts"))).alias("runs")).select(
        "conv_id", F.sort_array(F.flatten(F.transform("runs", lambda r: r["ts"]))).alias("turns"))


def format_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text; more columns are ignored).

    Returns conv_id, formatted, loss_spans (array of start, length in code points), n_blocks
    (turns after merging). Order: turn (null first), then role, then text; repeated rows stay
    repeated turns. Null role and text count as empty. Rows of null conv_id are one conversation.
    An empty table gives no rows. A conversation is one row, so it has to fit into a task.
    """
    t = F.col("turns")
    shown = F.transform(t, lambda x: F.struct(x["role"].alias("role"), escape(x["role"]).alias("r"), escape(x["text"]).alias("x")))
    s = F.col("shown")
    n = F.size(s)
    other = lambda x, i: (i == n - 1) | (F.get(s, F.least(i + 1, n - 1))["role"] != x["role"])
    first = lambda x, i: (i == 0) | (F.get(s, F.greatest(i - 1, F.lit(0)))["role"] != x["role"])
    pieces = F.transform(s, lambda x, i: F.struct(
        F.when(first(x, i), F.concat(F.lit(OPEN), x["r"], F.lit(HEAD))).otherwise(F.lit("")).alias("before"),
        x["x"].alias("x"), x["role"].isin(*loss_roles).alias("loss"),
        F.when(other(x, i), F.lit(CLOSE)).otherwise(F.lit(SEP)).alias("after")))
    p = F.col("pieces")
    lengths = F.transform(p, lambda x: (F.length(x["before"]) + F.length(x["x"]) + F.length(x["after"])).cast("bigint"))
    spans = F.zip_with(p, F.col("starts"), lambda x, at: F.struct(
        (at + F.length(x["before"])).alias("start"), F.length(x["x"]).cast("bigint").alias("length"), x["loss"].alias("loss")))
    return (
        sorted_turns(rows).withColumn("shown", shown).withColumn("pieces", pieces).withColumn("lengths", lengths).withColumn("starts", running_total(F.col("lengths")))
        .select(
            "conv_id",
            F.array_join(F.transform(p, lambda x: F.concat(x["before"], x["x"], x["after"])), "").alias("formatted"),
            F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(
                x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
            F.size(F.filter(p, lambda x: x["after"] == CLOSE)).cast("long").alias("n_blocks")))


def read_turns(text: Column) -> Column:
    """Array of (role, text): the turns a formatted text says."""
    blocks = F.filter(F.split(text, F.lit(CLOSE), -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(_after(b, HEAD), F.lit(SEP), -1), lambda x: F.struct(unescape(_role(b)).alias("role"), unescape(x).alias("text")))))


def loss_texts(text: Column, spans: Column) -> Column:
    """The texts under the loss mask, as they were before escaping."""
    return F.transform(spans, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def _role(block: Column) -> Column:
    return F.substring(F.substring_index(block, HEAD, 1), F.lit(len(OPEN) + 1), F.length(block))


def _after(block: Column, mark: str) -> Column:
    at = F.length(F.substring_index(block, mark, 1)) + len(mark)
    return F.substring(block, at + 1, F.length(block))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks: all but the last
    two from the text read back."""
    text = F.col("formatted")
    read = formatted.select("conv_id", "formatted", "n_blocks", read_turns(text).alias("turns"), loss_texts(text, F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length(text).cast("long").alias("formatted_chars"), "n_blocks")
