"""Named checks as rows, and gates over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, expected, actual: Column) -> DataFrame:
    """(check, expected, actual, passed): an aggregate of ``df`` against an expected value, as texts."""
    return df.agg(actual.alias("_a")).select(F.lit(name).alias("check"), F.lit(str(expected)).alias("expected"), F.col("_a").cast("string").alias("actual"), F.coalesce(F.col("_a").cast("string") == F.lit(str(expected)), F.lit(False)).alias("passed"))


def checks(df: DataFrame, wanted: list[tuple[str, object, Column]]) -> DataFrame:
    """Several checks of one table in one pass."""
    row = df.agg(*(a.alias(n) for n, _, a in wanted))
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.lit(str(e)).alias("expected"), F.col(n).cast("string").alias("actual"), F.coalesce(F.col(n).cast("string") == F.lit(str(e)), F.lit(False)).alias("passed")) for n, e, _ in wanted))
    return row.select(F.inline(rows))


def gate(*tables: DataFrame) -> DataFrame:
    """PASS if all checks passed, else FAIL, with the number of failures."""
    rows = reduce(DataFrame.unionByName, [t.select("check", "passed") for t in tables])
    return rows.agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed")).withColumn("gate", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL"))


def size_gate(df: DataFrame, group: str, least_rows: int = 100, least_groups: int = 10) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.countDistinct(group).alias("groups")).withColumn("gate", F.when((F.col("rows") >= least_rows) & (F.col("groups") >= least_groups), "PASS").otherwise("REVIEW"))


def require(df: DataFrame) -> DataFrame:
    """The checks again; reading a failed one is an error."""
    return df.withColumn("_ok", F.assert_true("passed", F.concat(F.lit("check failed: "), F.col("check")))).filter("_ok is null").drop("_ok")


def validation(
    submissions: DataFrame,
    problems: DataFrame,
    pairs: DataFrame,
    crossing_problems: DataFrame,
    crossing_code: DataFrame,
    submission_columns: list[str],
    problem_columns: list[str],
    problem_key: str,
    everyone: DataFrame | None = None,
) -> DataFrame:
    """(check, expected, actual, passed) of the thirteen named checks of a dataset. ``pairs`` are the strict ones, with ``part``, the
    split by problem, and ``everyone`` all eligible ones with ``second``, the split by participant; ``crossing_problems`` are near
    pairs in different parts. Of no pairs at all nothing is broken but that there are three parts. Fixed values: the
    names of the checks are outputs."""
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    alone = lambda key, c, df=pairs: df.groupBy(key).agg(F.count_distinct(c).alias("n")).agg(F.coalesce(F.max("n") == 1, F.lit(True)).alias("n"))
    have = lambda df, names: F.lit(all(c in df.columns for c in names))
    unique = lambda c: F.count("*") == F.count_distinct(c)
    whole = [
        (submissions, [("all_required_submission_columns_present", have(submissions, submission_columns)), ("submission_ids_unique", unique("submission_id"))]),
        (problems, [("all_required_problem_columns_present", have(problems, problem_columns)), ("problem_ids_unique_in_problem_data", unique(problem_key))]),
        (pairs, [
            ("all_primary_pairs_are_consecutive", every("is_consecutive")), ("all_primary_pairs_are_same_language", every("same_language")),
            ("all_primary_pairs_have_evidence", every("evidence_ready")), ("all_three_primary_splits_nonempty", F.count_distinct("part") == 3),
        ]),
        (alone("problem_id", "part"), [("one_primary_split_per_problem", F.max("n"))]),
        (alone("trajectory_id", "part"), [("one_primary_split_per_trajectory", F.max("n"))]),
        (alone("participant_id_hash", "second", everyone if everyone is not None else pairs), [("one_secondary_split_per_participant", F.max("n"))]),
        (crossing_problems, [("no_near_duplicate_problem_pair_crosses_primary_splits", F.count("*") == 0)]),
        (crossing_code, [("no_exact_or_whitespace_code_hash_crosses_strict_splits", F.count("*") == 0)]),
    ]
    return reduce(DataFrame.unionByName, (checks(df, [(name, "true", value) for name, value in named]) for df, named in whole))
