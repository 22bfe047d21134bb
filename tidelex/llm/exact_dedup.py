"""Exact deduplication by skew-safe combining (operator 5), Spark expressions only.

Texts are equal when identical after each run of whitespace becomes one space; null counts as empty. Three stages,
each comparing full contents: rows of one task combine first (partial aggregation by digest, salt and content), the
partial groups of one salt merge, and the winners of the salts merge by digest and content. So no task gets more of a
group than one row for each task before it, however many copies there are; and two contents of one digest stay two.

The row ids then join to the salted winners by digest, salt and a second digest, and the winners, which have been told apart by content,
show whether that is the same as joining by content: it is unless two contents share all three. Rows of such digests, if there
are any, join by content. keep_first joins by these digests.

Defined results: the smallest doc_id of a group stays; a null doc_id counts as larger than any other. Of rows with the
same doc_id and equal texts exactly one is kept, the first by raw text, then by the other columns, maps and variants last and by their hash, in whatever order the rows come.
Empty tables give empty results. Other columns pass through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, row_hash, written

LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(body: Column) -> tuple[Column, Column]:
    """What contents are told apart by in joins."""
    return F.unhex(F.sha2(body, 256)), F.xxhash64(body)


def keyed(rows: DataFrame, salts: int) -> DataFrame:
    """rows(id, text) -> (id, salt, digest, mark, body)."""
    body = normalised(F.col("text"))
    digest, mark = digests(F.col("body"))
    return rows.select(F.coalesce(F.col("id"), F.lit(LAST)).alias("id"), body.alias("body")).select(
        "id", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), digest.alias("digest"), mark.alias("mark"), "body"
    )


def winners(rows: DataFrame) -> DataFrame:
    """keyed rows -> (digest, salt, mark, keep_id, group_size): a row for each content and salt that has it."""
    salted = rows.groupBy("digest", "salt", "body").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "body").agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))  # each salt once at most
    return merged.select("digest", F.explode("salts").alias("salt"), digests(F.col("body"))[1].alias("mark"), "keep_id", "group_size")


def annotate(rows: DataFrame, salts: int = 16) -> DataFrame:
    """rows(id, text) -> (digest, salt, mark, id, copies, keep_id, group_size): a row for each id and content, with how many rows it stands for."""
    base = keyed(rows, salts)
    won = written(winners(base), "winners")
    key = ["digest", "salt", "mark"]
    ids = base.groupBy(*key, "id").agg(F.count(F.lit(1)).alias("copies"))
    clash = won.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    if clash.isEmpty():
        return ids.join(won, key)
    # Two contents share all digests: their rows go by content.
    apart = written(clash.distinct(), "clash")
    own = base.join(apart, "digest", "left_semi")
    again = own.groupBy("digest", "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rest = own.groupBy(*key, "body", "id").agg(F.count(F.lit(1)).alias("copies")).join(again, ["digest", "body"]).select(*key, "id", "copies", "keep_id", "group_size")
    return ids.join(apart, "digest", "left_anti").join(won, key).select(rest.columns).unionByName(rest)


def copies_of(rows: DataFrame, step: int = 10_000) -> DataFrame:
    """rows(copies, ...) each as often as it says, with i from 1, by arrays of bounded length."""
    first = rows.withColumn("low", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(step).cast("long"))))
    return first.withColumn("i", F.explode(F.sequence("low", F.least(F.col("low") + F.lit(step - 1), F.col("copies"))))).drop("low")


def groups(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    each = copies_of(annotate(rows, salts))
    back = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return each.select(
        back("id").alias("doc_id"), back("keep_id").alias("keep_id"), "group_size",
        ((F.col("id") == F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The documents that stay, with their own columns."""
    own = docs.columns
    base = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.col("text").cast("string").alias("text")
    )
    each = annotate(base.select("id", "text"), salts)
    stay = each.where(F.col("id") == F.col("keep_id")).select("id", "digest", "mark")
    tagged = base.withColumns(dict(zip(("digest", "mark"), digests(normalised(F.col("text"))), strict=True))).drop("text")
    out = tagged.join(stay, ["id", "digest", "mark"])
    order = [own.index("text"), *(i for i, (c, k) in enumerate(docs.dtypes) if c != "text" and "map<" not in k and "variant" not in k)]
    one = Window.partitionBy("id", "digest", "mark").orderBy(*[f"c{i}" for i in order], row_hash([(f"c{i}", k) for i, (_, k) in enumerate(docs.dtypes)]))
    return out.withColumn("i", F.row_number().over(one)).where("i = 1").select([F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
