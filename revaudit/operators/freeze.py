"""Whether a frozen result may be used again, by the digests of what it was made from and of what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In order of what decides.
REASONS = ("output changed", "output missing", "unknown output", "input changed", "input missing", "new input")


def freeze_decisions(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(freeze, decision, reason, problems) of each freeze of the tables (freeze, role, path, sha256), ``role`` being ``input`` or ``output``:
    what a manifest states and what is there.

    ``build`` where no manifest has the freeze. ``refuse`` where an output was changed, lost or added after the freeze: what
    is there is nobody's result. ``rebuild`` where outputs are whole but inputs are not those of the manifest. Else
    ``reuse``. ``problems`` counts the files that differ, and ``reason`` names the gravest kind. A file stated twice with
    different digests is changed. Both tables are grouped by file and then by freeze, so no join is needed and a freeze
    of many files meets in partial sums.
    """
    side = lambda df, s: df.select("freeze", "role", "path", F.col("sha256").alias("h"), F.lit(s).alias("stated"))
    each = side(manifest, True).unionByName(side(found, False)).groupBy("freeze", "role", "path").agg(
        F.bool_or("stated").alias("stated"), F.bool_or(~F.col("stated")).alias("there"), F.count_distinct(F.coalesce("h", F.lit("null"))).alias("digests")
    )
    new = F.when(F.col("role") == "output", "unknown output").otherwise("new input")
    each = each.withColumn("problem", F.when(~F.col("there"), F.concat("role", F.lit(" missing"))).when(~F.col("stated"), new).when(F.col("digests") > 1, F.concat("role", F.lit(" changed"))))
    counts = each.groupBy("freeze").agg(F.bool_or("stated").alias("known"), F.count("problem").alias("problems"), *(F.count_if(F.col("problem") == r).alias(r) for r in REASONS))
    reason = F.coalesce(*(F.when(F.col(f"`{r}`") > 0, r) for r in REASONS))
    decision = F.when(~F.col("known"), "build").when(reason.isNull(), "reuse").when(reason.contains("output"), "refuse").otherwise("rebuild")
    return counts.select("freeze", decision.alias("decision"), F.when(F.col("known"), reason).alias("reason"), F.when(F.col("known"), F.col("problems")).otherwise(0).cast("long").alias("problems"))
