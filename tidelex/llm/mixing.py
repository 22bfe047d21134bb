"""Mixing sources to target weights by systematic sampling (operator 3), Spark expressions only.

A document's expected copies are its source's rate, target over size. Within a source the documents stand in a fixed
order; their expected copies are summed up from a random offset of the source, and a document is taken once for each
whole number that its own part of the sum crosses. As the order goes by bands of size and by size within a band, the
words taken differ from the target by about one document in a band and cell.

The sum over a source is taken in three steps, so no task gets a whole source: over its bands, over the salts of a
band, and over the rows of a (band, salt) cell.

Defined results: null texts and texts without words have size 0; a null source is one source, after all others;
repeated rows are documents of their own. Without any words all targets are 0 and nothing is taken. Reruns agree: the
order is by size, a hash of the id, the id, and for equal ids a hash of the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, row_hash, written


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes(source, source_size) -> with rank, weight and target. The sources share all words by weight; a target stops
    at most times its source's size, and what is over goes to the others by weight, until none is above: the level
    above which sources are capped is found in order of cap over weight."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.withColumn("rank", rank.cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight").cast("double"), "rank")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumns({
        "total": F.sum("source_size").over(everything),
        "all_weight": F.sum("weight").over(everything),
        "cap_below": F.coalesce(F.sum("cap").over(below), F.lit(0).cast("long")),
        "weight_below": F.coalesce(F.sum("weight").over(below), F.lit(0).cast("long")),
    })
    # The level if just the sources before this one were capped; this one is capped too if it lies above its cap.
    s = s.withColumn("level", (F.col("total") - F.col("cap_below")).cast("double") / (F.col("all_weight") - F.col("weight_below")).cast("double"))
    s = s.withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.min(F.when(~F.col("capped"), F.struct("cap_below", "level"))).over(everything)["level"]
    return s.withColumn("free", level).select(
        "source", "source_size", "rank", "weight",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("free") * F.col("weight")).alias("target"),
    )


def hash60(c: Column, seed: str) -> Column:
    """A number below 2**60 from a hash of the value as text."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(c.cast("string"), F.lit(""))), 256), 1, 15), 16, 10).cast("long")


def copies(docs: DataFrame, id_col: str, size: Column, source: Column, tie: Column, *, seed: str = "mix", salts: int = 256, bands_per_octave: int = 4, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """docs with size, source_size, target and copies (columns of these names must be free: callers rename)."""
    h = hash60(F.col(id_col), seed)
    rows = docs.withColumns({"size": size, "source": source, "h": h}).withColumns({
        "band": F.floor(F.log2(F.col("size") + F.lit(1.0)) * bands_per_octave).cast("int"),
        "salt": F.pmod(F.col("h"), F.lit(salts)).cast("int"),
        "key": F.coalesce(F.col("source"), F.lit("")),
        "none": F.col("source").isNull(),
        "tie": tie,
    }).drop("source")
    # The cells are written, as four relations stand on them: else the texts' words were counted for each.
    cell = written(rows.groupBy("none", "key", "band", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")), "cells")
    band = cell.groupBy("none", "key", "band").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    source_sizes = band.groupBy("none", "key").agg(F.sum("s").alias("source_size")).select(F.when(~F.col("none"), F.col("key")).alias("source"), "source_size")
    goal = targets(source_sizes, weights, most).select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("key"), "source_size", "target")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    bands = band.select("none", "key", "band", before(Window.partitionBy("none", "key").orderBy("band")).alias("n1")).join(goal, ["none", "key"])
    cells = cell.select("none", "key", "band", "salt", before(Window.partitionBy("none", "key", "band").orderBy("salt")).alias("n2")).join(bands, ["none", "key", "band"])
    in_cell = Window.partitionBy("none", "key", "band", "salt").orderBy("size", "h", id_col, "tie")
    out = rows.withColumn("n3", F.row_number().over(in_cell)).join(cells, ["none", "key", "band", "salt"])
    offset = hash60(F.concat(F.when(F.col("none"), F.lit("-")).otherwise(F.lit("+")), F.col("key")), seed + "/offset").cast("double") / F.lit(float(1 << 60))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    place = F.col("n1") + F.col("n2") + F.col("n3")
    crossed = F.floor(rate * place.cast("double") + offset) - F.floor(rate * (place - 1).cast("double") + offset)
    return out.withColumn("copies", crossed).drop("none", "key", "band", "salt", "h", "tie", "n1", "n2", "n3")


def plan(docs: DataFrame, **params) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken and copies."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("src"), words(F.col("text")).alias("w"), F.xxhash64("text").alias("t"))
    out = copies(rows, "doc_id", F.col("w"), F.col("src"), F.col("t"), **params)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixture: each document as often as it is taken, with its own columns."""
    own = docs.columns
    rows = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    at = {c: f"c{own.index(c)}" for c in ("doc_id", "text", "source")}
    out = copies(rows, at["doc_id"], words(F.col(at["text"])), F.col(at["source"]).cast("string"), row_hash([(f"c{i}", k) for i, (_, k) in enumerate(docs.dtypes)]), **params)
    many = out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return many.select([F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
