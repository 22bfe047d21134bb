"""Chat formatting with Spark expressions only (operator 10).

Template: <|im_start|>role\\ntext<|im_end|>\\n for each run of turns of one role; further texts of a run follow
<|im_turn|>. In texts and roles a backslash goes in between "<" and "|" (and after any backslashes there already), so no
control string can come from a text; in roles "%" and line ends are percent-escaped too. All of it is undone on reading.

A conversation is formatted in segments of up to segment_turns turns: these are grouped, sorted and merged by
array aggregation first, and only the formatted segments of a conversation meet, so a long conversation is dealt
out. Loss spans are byte ranges of the formatted text, one for each assistant turn.

Defined results: turns stand by turn number (nulls first), then role, then text; null text is empty, null role is an
empty role; rows with a null conv_id are one conversation; repeated rows are turns of their own. An empty table gives
an empty result. Extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, TURN, END = "<|im_start|>", "<|im_turn|>", "<|im_end|>\n"
RUN = "struct<out:string,role:string,bytes:long,spans:array<struct<at:long,bytes:long,loss:boolean>>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(escape(c), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("\r"), F.lit("%0D"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(F.replace(F.replace(c, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def _bytes(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def format_chats(turns: DataFrame, segment_turns: int = 64, loss_role: str = "assistant") -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, formatted, loss_spans array<struct<at, bytes>>)."""
    row = turns.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("none", F.col("conv").isNull()).withColumn("conv", F.coalesce("conv", F.lit(0)))
    # Segments follow the turn numbers, of which a conversation has each once or a few times.
    segment = F.floor(F.col("turn") / F.lit(float(segment_turns)))
    got = row.groupBy("none", "conv", segment.alias("segment")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    order = Window.partitionBy("none", "conv").orderBy(F.col("segment").asc_nulls_first())
    got = got.withColumns({"last": F.element_at("turns", -1)["role"], "first": F.element_at("turns", 1)["role"]})
    got = got.withColumns({"before": F.lag("last").over(order), "after": F.lead("first").over(order)})

    def add(acc: Column, t: Column) -> Column:
        role, text = t["role"], escape(t["text"])
        opening = F.when(acc["role"] == role, F.lit(TURN)).otherwise(F.concat(F.when(acc["role"].isNull(), F.lit("")).otherwise(F.lit(END)), F.lit(START), escape_role(role), F.lit("\n")))
        at = acc["bytes"] + _bytes(opening)
        return F.struct(
            F.concat(acc["out"], opening, text).alias("out"), role.alias("role"), (at + _bytes(text)).alias("bytes"),
            F.concat(acc["spans"], F.array(F.struct(at.alias("at"), _bytes(text).alias("bytes"), (role == F.lit(loss_role)).alias("loss")))).alias("spans"),
        )

    empty = F.struct(F.lit("").alias("out"), F.col("before").alias("role"), F.lit(0).cast("long").alias("bytes"), F.array().cast("array<struct<at:long,bytes:long,loss:boolean>>").alias("spans"))
    got = got.withColumn("run", F.aggregate("turns", empty.cast(RUN), lambda acc, t: add(acc, t).cast(RUN)))
    # A segment that ends its run, or the conversation, closes it; one whose run goes on leaves that to the next.
    got = got.withColumn("out", F.when(F.col("after").isNull(), F.concat(F.col("run")["out"], F.lit(END))).otherwise(F.col("run")["out"]))
    offset = F.coalesce(F.sum(F.col("run")["bytes"]).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    got = got.withColumn("offset", offset).select("none", "conv", "segment", "out", "offset", F.col("run")["spans"].alias("spans"))
    loss = F.transform(F.filter("spans", lambda s: s["loss"]), lambda s: F.struct((s["at"] + F.col("offset")).alias("at"), s["bytes"].alias("bytes")))
    got = got.select("none", "conv", F.struct(F.col("offset"), F.col("out"), loss.alias("spans")).alias("part"))
    whole = got.groupBy("none", "conv").agg(F.array_sort(F.collect_list("part")).alias("parts"))  # segments, not turns
    return whole.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"),
        F.array_join(F.col("parts")["out"], "").alias("formatted"), F.flatten(F.col("parts")["spans"]).alias("loss_spans"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """What format_chats wrote: conv_id, turns array<struct<role, text>>, loss_text."""
    body = F.expr(f"filter(split(formatted, '{END[:-1].replace('|', '[|]')}\n'), x -> x <> '')")
    got = chats.withColumn("runs", body).withColumn("raw", F.encode("formatted", "UTF-8"))
    head = lambda r: F.substring_index(r, "\n", 1)
    turns = F.flatten(F.transform("runs", lambda r: F.transform(
        F.split(F.substr(r, F.char_length(head(r)) + F.lit(2)), TURN.replace("|", "[|]"), -1),
        lambda t: F.struct(unescape_role(F.substr(head(r), F.lit(len(START) + 1))).alias("role"), unescape(t).alias("text")))))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.decode(F.substr(F.col("raw"), (s["at"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8"))), "")
    return got.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def digests(chats: DataFrame) -> DataFrame:
    got = read_back(chats)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )
