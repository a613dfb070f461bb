"""Identity of two ordered tables by a tree of hashes, and the place where they first differ.

Lines get ordinals; the digests of ``FAN`` neighbours make the digest of their range, and so on up to one root. Equal
roots are equal tables, line for line and in order. Where roots differ, the tree is descended along the first range whose
digests differ: each step reads the ``FAN`` digests below one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked
from .shared import kept

#: Digests that a node has below it.
FAN = 1024


def leaves(df: DataFrame, line: str | Column, order: list[str | Column]) -> DataFrame:
    """(at, digest): the SHA-256 of each line by its place from 0; a null line has the digest of none, ``null``."""
    digest = F.coalesce(F.sha2(line if isinstance(line, Column) else F.col(line), 256), F.lit("null"))
    columns = [c if isinstance(c, Column) else F.col(c) for c in order]
    rows = df.select(*(c.alias(f"o{i}") for i, c in enumerate(columns)), digest.alias("digest"))
    return ranked(rows, [f"o{i}" for i in range(len(columns))] + ["digest"], "at").select((F.col("at") - 1).alias("at"), "digest")


def tree(found: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """The levels (at, digest) of the tree, leaves first; the last one has at most one row."""
    levels = [kept(found)]
    while levels[-1].limit(2).count() > 1:
        below = F.array_sort(F.collect_list(F.struct("at", "digest")))  # ``fan`` entries at most
        up = levels[-1].groupBy(F.expr(f"at div {fan}").alias("up")).agg(F.sha2(F.array_join(below["digest"], "|"), 256).alias("digest"))
        levels.append(kept(up.withColumnRenamed("up", "at")))
    return levels


def _root(levels: list[DataFrame]) -> str | None:
    row = levels[-1].first()
    return row.digest if row else None


def ordered_difference(a: DataFrame, b: DataFrame, fan: int = FAN) -> DataFrame:
    """One row (identical, rows_a, rows_b, root_a, root_b, first_difference) for two tables of ``leaves``: the first place, from 1, at which
    one has another line or none, null without a difference. Roots are null for empty tables."""
    left, right = tree(a, fan), tree(b, fan)
    roots = _root(left), _root(right)
    counts = left[0].count(), right[0].count()
    place = None
    if counts[0] != counts[1] or roots[0] != roots[1]:
        low = 0
        for depth in range(max(len(left), len(right)) - 1, -1, -1):
            # Below one node. Where a tree has no such level its root stands there, as another node than any.
            sides = []
            for levels, name in ((left, "x"), (right, "y")):
                level = levels[min(depth, len(levels) - 1)]
                if depth >= len(levels):
                    level = level.select("at", F.concat(F.lit(f"{depth}|"), "digest").alias("digest"))
                own = level.filter((F.col("at") >= low) & (F.col("at") < low + fan))
                sides.append(own.select("at", F.col("digest").alias(name)))
            both = sides[0].join(sides[1], "at", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y")))
            place = both.agg(F.min("at")).first()[0]
            low = place * fan
        place += 1
    schema = "identical boolean, rows_a long, rows_b long, root_a string, root_b string, first_difference long"
    return a.sparkSession.createDataFrame([(place is None, *counts, *roots, place)], schema)
