"""Agreement between annotators, disagreements, and adjudication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, a: str, b: str, labels: list) -> DataFrame:
    """(a, b, n) for all pairs of labels, zeros included: the labels are a short list, not data."""
    grid = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in labels for y in labels))
    cells = df.sparkSession.range(1).select(F.inline(grid))
    counts = df.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["x", "y"], "left").select(F.col("x").alias(a), F.col("y").alias(b), F.coalesce("n", F.lit(0)).alias("n"))


def kappa(df: DataFrame, fields: dict[str, tuple[str, str]], groups: tuple[str, ...] = ()) -> DataFrame:
    """For each field (and group) Cohen's kappa with its counts. Chance agreement of one gives 1; no rows give null.

    ``fields`` names pairs of columns. One pass counts the cells of all fields; kappa needs only these.
    """
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for f, (a, b) in fields.items()))
    cells = df.select(*groups, F.inline(pairs)).groupBy(*groups, "field", "a", "b").agg(F.count("*").alias("n"))
    key = [*groups, "field"]
    total = cells.groupBy(*key).agg(F.sum("n").alias("items"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(0)).alias("agreements"))
    ma, mb = cells.groupBy(*key, "a").agg(F.sum("n").alias("na")), cells.groupBy(*key, F.col("b").alias("a")).agg(F.sum("n").alias("nb"))
    chance = ma.join(mb, [*key, "a"]).groupBy(*key).agg(F.sum(F.col("na") * F.col("nb")).alias("products"))
    out = total.join(chance, key, "left").withColumn("products", F.coalesce("products", F.lit(0)))
    n = F.col("items").cast("double")
    observed, expected = F.col("agreements") / n, F.col("products") / (n * n)
    return out.select(*key, "items", "agreements", observed.alias("observed"), expected.alias("expected"), F.when(expected == 1, 1.0).otherwise((observed - expected) / (1 - expected)).alias("kappa"))


def differing(fields: dict[str, tuple[str, str]]):
    """The names of the fields that differ; two nulls agree."""
    return F.array_compact(F.array(*(F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(f)) for f, (a, b) in fields.items())))


def disagreements(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows with a difference, and ``fields_differing`` joined by ``|``."""
    return df.withColumn("_d", differing(fields)).filter(F.size("_d") > 0).withColumn("fields_differing", F.array_join("_d", "|")).drop("_d")


def joint_agreement(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    return df.agg(F.count("*").alias("items"), F.coalesce(F.sum((F.size(differing(fields)) == 0).cast("long")), F.lit(0)).alias("all_agree"))


def overlay(base: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """``base`` with whole rows replaced by those of ``decided`` with the same key, never column by column."""
    cols = [c for c in base.columns if c != key]
    new = decided.select(F.col(key), F.struct(*cols).alias("_new"))
    out = base.select(F.col(key), F.struct(*cols).alias("_old")).join(new, key, "left")
    return out.withColumn("_row", F.when(F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("_old"))).select(key, "_row.*", F.col("_new").isNotNull().alias("adjudicated"))
