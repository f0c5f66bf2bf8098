"""A rank for every row of a total order, without sorting the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

#: A partition's rows are numbered below this.
_ROWS = 1 << 33


def with_rank(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``rows`` with ``name``, the rank from 1 in the order; the order must be total for the ranks to be defined.

    Rows are dealt by ranges of the order and sorted within them, one shuffle; a row's rank is its place in its range
    plus the sizes of the ranges before. The dealt rows are staged, so that both are taken from the same ranges. A
    column called like the rank is an error, in any case of letters.
    """
    taken = {c.lower() for c in rows.columns}
    if name.lower() in taken:
        raise ValueError(f"the table has a column {name}")
    at, part, before = ("_" * (1 + max(map(len, taken), default=0)) + x for x in ("at", "range", "before"))  # longer than any other
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = stage(sorted_.withColumn(at, F.monotonically_increasing_id()), "ranked").withColumn(part, F.floor(F.col(at) / _ROWS))
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))  # one row for each range
    above = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(part, F.coalesce(F.sum("n").over(above), F.lit(0)).alias(before))
    return dealt.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + F.col(at) % _ROWS + 1).drop(part, at, before)
