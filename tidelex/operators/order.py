"""Numbers and running sums over a whole table in an order, without a task that sees all rows: rows are dealt by ranges of the order and sorted in
each, and what comes before a range is the sum of the ranges below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

_SHIFT = 33  # of Spark's ids: partition above, place in it below


def _ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows by ranges, with part and place (from 0 in each part), kept so that both passes see the same."""
    at = F.monotonically_increasing_id()
    held = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_place", at))
    return held.withColumns({"part": F.shiftright("part_place", _SHIFT), "place": F.col("part_place").bitwiseAND((1 << _SHIFT) - 1)}).drop("part_place")


def _before(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(part, each sum over the parts before it, its total): a row for each range, of which there are as many as shuffle partitions."""
    per = rows.groupBy("part").agg(*[s.alias(c) for c, s in sums.items()]).orderBy("part").collect()
    run, out = dict.fromkeys(sums, 0), []
    for r in per:
        out.append((r["part"], *run.values()))
        run = {c: run[c] + r[c] for c in sums}
    spark, total = rows.sparkSession, [run[c] for c in sums]
    schema = ", ".join(["part long", *(f"{c}_before long, {c}_total long" for c in sums)])
    return spark.createDataFrame([(p, *(x for pair in zip(v, total, strict=True) for x in pair)) for p, *v in out], schema)


def numbered(rows: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """rows with their place in the order, from 1. The order has to tell all rows apart."""
    held = _ranged(rows, order)
    before = _before(held, {"k": F.count(F.lit(1))})
    return held.join(F.broadcast(before), "part").withColumn(name, F.col("k_before") + F.col("place") + 1).select(*rows.columns, name)


def running(rows: DataFrame, order: list[Column], value: str) -> DataFrame:
    """rows with n (the place in the order), cum (the sum of value up to and with the row) and total (of all rows). value holds whole numbers."""
    held = _ranged(rows, order)
    before = _before(held, {"k": F.count(F.lit(1)), "v": F.sum(value)})
    own = F.sum(value).over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    out = held.withColumn("own", own).join(F.broadcast(before), "part")
    return out.select(*rows.columns, (F.col("k_before") + F.col("place") + 1).alias("n"), (F.col("v_before") + F.col("own")).alias("cum"), F.col("v_total").alias("total"))
