"""Quality flags, ledgers and missingness of submission-like tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from .ranking import ranked


def require_columns(df: DataFrame, required: list[str], label: str) -> DataFrame:
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{label} is missing required columns: {missing}")
    return df


def any_missing(columns: list[str]) -> Column:
    return reduce(or_, (F.col(c).isNull() for c in columns))


def attempt_number(x: str | Column) -> Column:
    """The number, null where the text is none."""
    return F.expr(f"try_cast({x} as double)") if isinstance(x, str) else x.cast("double")


def invalid_attempt(number: str | Column) -> Column:
    """Missing, not positive, or not a whole number."""
    n = col(number)
    return n.isNull() | (n <= 0) | (n % 1 != 0)


def repeated(*keys: str) -> Column:
    """Whether several rows share the keys; nulls count as equal."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1


def flag_member(df: DataFrame, key: str, members: DataFrame, member_key: str, flag: str) -> DataFrame:
    """Adds whether ``key`` is among the members. A null key is not."""
    known = members.select(F.col(member_key).alias("_k")).filter("_k is not null").distinct().withColumn("_hit", F.lit(True))
    return df.join(known, F.col(key) == F.col("_k"), "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


def extra_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra_rows"))


def flag_submissions(subs: DataFrame, problems: DataFrame, required: list[str]) -> DataFrame:
    """All validity flags of submissions, and ``row_valid_for_ordering``, which needs all of them to be good."""
    out = subs.withColumn("attempt", attempt_number("attempt_number")).withColumn("required_missing", any_missing(required))
    out = out.withColumn("attempt_valid", ~invalid_attempt("attempt"))
    out = flag_member(out, "problem_id", problems, "problem_id", "problem_linked")
    out = out.withColumns({
        "duplicate_submission_id": repeated("submission_id"),
        "duplicate_attempt_key": repeated("user_id", "problem_id", "attempt_number"),
        "_row": F.sha2(F.to_json(F.struct(*subs.columns), {"ignoreNullFields": "false"}), 256),
    }).withColumn("exact_duplicate_row", repeated("_row")).drop("_row")
    ok = ~F.col("required_missing") & F.col("attempt_valid") & F.col("problem_linked") & ~F.col("duplicate_submission_id") & ~F.col("duplicate_attempt_key")
    return out.withColumn("row_valid_for_ordering", ok)


def submission_rules(trace_valid: Column) -> list[tuple[str, str, str, str, Column]]:
    """The rules of ``ledger`` over flagged submissions. Ids, statuses and reasons are outputs."""
    return [
        ("submission", "S01", "exclude", "Missing one or more required submission fields", F.col("required_missing")),
        ("submission", "S02", "exclude", "Attempt number is missing, non-integer or non-positive", ~F.col("attempt_valid")),
        ("submission", "S03", "exclude", "Problem ID does not link to Problem Data", ~F.col("problem_linked")),
        ("submission", "S04", "exclude", "Duplicate submission identifier", F.col("duplicate_submission_id")),
        ("submission", "S05", "exclude", "Duplicate user-problem-attempt key", F.col("duplicate_attempt_key")),
        ("submission", "S06", "exclude from evidence-grounded set", "Verdict sequence trace missing or malformed", ~trace_valid),
    ]


def strict_pool(df: DataFrame, languages: list[tuple[str, str]], parts: list[str], ready: str, crossing: str, split: str = "split") -> DataFrame:
    """Rows of the named parts of a split whose (column, language) pairs all hold, whose evidence is ready, and whose
    code is in no other part. A null anywhere keeps a row out."""
    out = df.filter(F.col(split).isin(*parts) & F.coalesce(F.col(ready), F.lit(False)) & ~F.coalesce(F.col(crossing), F.lit(True)))
    return reduce(lambda d, x: d.filter(F.col(x[0]) == x[1]), languages, out)


def ledger(df: DataFrame, rules: list[tuple[str, str, str, str, Column]]) -> DataFrame:
    """One pass over ``df``: a row for each rule (scope, rule_id, status, reason, condition) with its count."""
    counts = df.agg(*(F.coalesce(F.sum(F.when(rule[4], 1).otherwise(0)), F.lit(0)).cast("long").alias(rule[1]) for rule in rules))
    entries = F.array(*(F.struct(F.lit(s).alias("scope"), F.lit(r).alias("rule_id"), F.col(r).alias("count"), F.lit(t).alias("status"), F.lit(w).alias("reason")) for s, r, t, w, _ in rules))
    return counts.select(F.inline(entries))


def missingness(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Missing values of each field: number and share."""
    parts = []
    for name, (df, columns) in tables.items():
        counts = df.agg(F.count("*").alias("_n"), *(F.count(F.col(c)).alias(c) for c in columns))
        rows = F.array(*(F.struct(F.lit(c).alias("field"), (F.col("_n") - F.col(c)).alias("missing_count")) for c in columns))
        part = counts.select("_n", F.inline(rows))
        parts.append(part.select(F.lit(name).alias("file"), "field", "missing_count", F.try_divide(F.col("missing_count").cast("double"), F.col("_n").cast("double")).alias("missing_share")))
    return reduce(DataFrame.unionByName, parts)


def distribution(df: DataFrame, field: str, missing: str = "<MISSING>") -> DataFrame:
    """Rows and share of each value."""
    counts = df.groupBy(F.coalesce(F.col(field), F.lit(missing)).alias(field)).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select(field, "n", (F.col("n").cast("double") / F.col("total")).alias("share"))


def screening_stage(has_claim: Column, language_ok: Column, stage_ok: Column) -> Column:
    """The first reason that applies: no focal claim, excluded language, stage failure; else success."""
    return F.when(~has_claim, "NO_FOCAL_CLAIM").when(~language_ok, "EXCLUDED_LANGUAGE").when(~stage_ok, "STAGE_A_FAILURE").otherwise("SUCCESSFUL_C_CLAIM_BEARING")


def select_ordered(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of a short explicit list, with their place in it (``position``)."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids)), f"position int, `{key}` {df.schema[key].dataType.simpleString()}")
    return wanted.join(df, key).orderBy("position")


def select_window(df: DataFrame, order: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """The rows from ``offset`` on in an order, ``limit`` at most, with their ``position`` in it from 0."""
    placed = ranked(df, order, "position").withColumn("position", F.col("position") - 1)
    last = F.lit(True) if limit is None else F.col("position") < offset + limit
    return placed.filter((F.col("position") >= offset) & last)


def profile_row(subs: DataFrame, trajectories: DataFrame, pairs: DataFrame, primary: DataFrame) -> DataFrame:
    """One row that profiles flagged submissions (``trace_valid``, ``trace_last_matches_final`` and both code hashes with
    them), their trajectories, the pairs of neighbours (with ``evidence_ready``), and the best language, null without one.
    Copies are counted by two aggregations, so that a code with many copies meets in partial sums only."""

    def yes(c: str) -> Column:
        return F.count_if(F.coalesce(F.col(c), F.lit(False)))

    def no(c: str) -> Column:
        return F.count_if(~F.coalesce(F.col(c), F.lit(False)))

    def total(n: Column) -> Column:
        return F.coalesce(F.sum(n), F.lit(0))

    out = subs.agg(
        F.count("*").alias("submissions_rows"), F.countDistinct("submission_id").alias("unique_submission_ids"), F.countDistinct("user_id").alias("unique_participants"),
        F.countDistinct("problem_id").alias("unique_problems_in_submissions"), F.array_join(F.array_sort(F.collect_set("language")), ";").alias("languages"),
        yes("required_missing").alias("missing_required_submission_rows"), no("attempt_valid").alias("invalid_attempt_rows"), no("problem_linked").alias("unlinked_problem_rows"),
        yes("duplicate_submission_id").alias("duplicate_submission_id_rows"), yes("duplicate_attempt_key").alias("duplicate_attempt_key_rows"),
        no("trace_valid").alias("malformed_trace_rows"), yes("trace_last_matches_final").alias("trace_last_matches_final_rows"),
    )
    parts = [
        trajectories.agg(
            F.count("*").alias("valid_trajectories"), *(F.count_if(F.col("submission_count") >= n).alias(f"trajectories_at_least_{n}") for n in (2, 3, 4)),
            no("attempt_numbers_contiguous").alias("trajectories_with_attempt_gaps"), no("starts_at_one").alias("trajectories_not_starting_at_one"), yes("mixed_language").alias("mixed_language_trajectories"),
        ),
        pairs.agg(F.count("*").alias("adjacent_pairs_all"), yes("is_consecutive").alias("consecutive_transitions_all"), yes("evidence_ready").alias("evidence_ready_consecutive_transitions"), yes("code_exact_same").alias("unchanged_pairs")),
        primary.agg(F.max("language").alias("primary_language")),
    ]
    for code, name in (("code_sha256", "exact"), ("code_whitespace_sha256", "whitespace_normalized")):
        copies = subs.groupBy(code).agg(F.count("*").alias("n"), (F.min("problem_id") != F.max("problem_id")).alias("crossing"))
        parts.append(copies.agg(total(F.when(F.col("n") > 1, F.col("n"))).alias(f"{name}_code_duplicate_rows"), total(F.when(F.col("crossing"), F.col("n"))).alias(f"{name}_code_cross_problem_rows")))
    for part in parts:
        out = out.join(F.broadcast(part))  # single rows
    return out


def crosstab(df: DataFrame, by: str, status: str, statuses: list[str]) -> DataFrame:
    """Rows of each ``by`` with each status, 0 without any: one aggregation, as the statuses are known."""
    return df.groupBy(by).agg(*(F.count_if(F.coalesce(F.col(status) == x, F.lit(False))).alias(x) for x in statuses))
