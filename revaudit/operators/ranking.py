"""A row's place in a global order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from .shared import kept

_SHIFT = 33  # monotonically_increasing_id has the partition above these bits and the place in it below


def ranked(df: DataFrame, order: list[str | Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``, from 1 in the given order, nulls first; ties in an order of their own.

    The rows are dealt into ranges of the order and sorted there; each takes its place in its range, to which the numbers
    of rows of the ranges before it are added. Only those numbers, one a range, meet in one place. Rows with equal keys
    are dealt further by a hash of the row and their place in the input, so that a frequent key isn't one range.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_o{i}": col(c) for i, c in enumerate(order)}
    hashed = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    keys |= {"_tie": F.xxhash64(*hashed), "_row": F.monotonically_increasing_id()}
    dealt = df.withColumns(keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = kept(dealt.drop(*keys))  # the places must not change between the two reads
    part = F.shiftright("_at", _SHIFT)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))  # ``n`` rows at most
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _SHIFT) - 1)) + 1
    out = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, place.cast("long")).drop("_part", "_at", "_before")
