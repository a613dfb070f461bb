"""Ordered trajectories and the transitions between their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import composite_key, normalize_code, pseudonym, sha256_text
from .ranking import ranked


#: Missing attempts in a row that are listed one by one.
LISTED = 1000


def summarise(rows: DataFrame, user: str = "user_id", problem: str = "problem_id", attempt: str = "attempt", language: str = "language", verdict: str = "verdict", accepted: str = "Accepted") -> DataFrame:
    """One row a trajectory: length, range, gaps, languages, and the verdict of the last attempt. Null keys are out.

    ``missing_attempt_numbers`` lists the numbers between the first and the last that are not there; more than ``LISTED``
    in a row are given as ``first..last``. Of equal attempts the last verdict is the greatest one.
    """
    rows = rows.filter(F.col(user).isNotNull() & F.col(problem).isNotNull())
    a = F.col(attempt).cast("int")
    out = rows.groupBy(user, problem).agg(
        F.count("*").alias("submission_count"),
        F.min(a).alias("min_attempt"),
        F.max(a).alias("max_attempt"),
        F.array_sort(F.collect_set(a.cast("long"))).alias("_seen"),
        F.array_sort(F.collect_set(F.coalesce(language, F.lit("nan")))).alias("_languages"),
        F.coalesce(F.bool_or(F.col(verdict) == accepted), F.lit(False)).alias("accepted_ever"),
        F.max_by(verdict, F.struct(a, F.col(verdict))).alias("final_attempt_verdict"),
    )
    # From each attempt to the next: nothing between, a few numbers, or a range.
    between = lambda low, high: F.when(high < low, F.array().cast("array<string>")).when(high - low < LISTED, F.transform(F.sequence(low, F.greatest(low, F.least(high, low + LISTED))), lambda x: x.cast("string"))).otherwise(F.array(F.concat(low.cast("string"), F.lit(".."), high.cast("string"))))
    gaps = F.flatten(F.transform(F.slice("_seen", 1, F.size("_seen") - 1), lambda x, i: between(x + 1, F.get("_seen", i + 1) - 1)))
    return out.select(
        user, problem, "submission_count", "min_attempt", "max_attempt",
        (F.col("min_attempt") == 1).alias("starts_at_one"),
        (F.col("max_attempt").cast("long") - F.col("min_attempt") + 1 == F.size("_seen")).alias("attempt_numbers_contiguous"),
        F.array_join(gaps, ";").alias("missing_attempt_numbers"),
        F.size("_languages").alias("language_count"),
        F.array_join("_languages", ";").alias("languages"),
        (F.size("_languages") > 1).alias("mixed_language"),
        "accepted_ever", "final_attempt_verdict",
    )


def transitions(rows: DataFrame, user: str = "user_id", problem: str = "problem_id", attempt: str = "attempt", submission: str = "submission_id", language: str = "language", code: str = "code", verdict: str = "verdict", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each pair of neighbours in a trajectory: both sides, what changed, and stable keys.

    ``carry`` columns come along for both sides as ``x_t`` and ``x_t1``. The longest columns are hashed before the
    window, so that the shuffle moves the code once.
    """
    rows = rows.filter(F.col(user).isNotNull() & F.col(problem).isNotNull())
    side = {"submission_id": submission, "attempt": attempt, "language": language, "verdict": verdict, **{c: c for c in carry}}
    bare = rows.select(
        F.col(user).alias("user_id"), F.col(problem).alias("problem_id"), F.col(code).alias("code"),
        *(F.col(v).alias(k) for k, v in side.items()),
        sha256_text(code).alias("code_sha256"), sha256_text(normalize_code(F.coalesce(F.col(code), F.lit("nan")))).alias("code_whitespace_sha256"),
    )
    own = [*side, "code", "code_sha256", "code_whitespace_sha256"]
    nxt = F.lead(F.struct(*own)).over(Window.partitionBy("user_id", "problem_id").orderBy("attempt", "submission_id"))
    pair = bare.withColumn("_n", nxt).filter("_n is not null")
    trajectory = F.substring(sha256_text(F.concat(pseudonym("user_id"), F.lit("|"), F.col("problem_id").cast("string"))), 1, 20)
    out = pair.select(
        trajectory.alias("trajectory_id"), pseudonym("user_id").alias("participant_id_hash"), "user_id", "problem_id",
        *(F.col(c).alias(f"{c}_t") for c in own), *(F.col(f"_n.{c}").alias(f"{c}_t1") for c in own),
    )
    return out.withColumns({
        "transition_id": composite_key("trajectory_id", "submission_id_t", "submission_id_t1", length=24),
        "is_consecutive": F.col("attempt_t1") == F.col("attempt_t") + 1,
        "same_language": F.coalesce(F.col("language_t") == F.col("language_t1"), F.lit(False)),
        "code_exact_same": F.col("code_sha256_t") == F.col("code_sha256_t1"),
        "code_whitespace_normalized_same": F.col("code_whitespace_sha256_t") == F.col("code_whitespace_sha256_t1"),
        "verdict_changed": ~F.coalesce(F.col("verdict_t") == F.col("verdict_t1"), F.lit(False)),
        "pair_sha256": composite_key("trajectory_id", "submission_id_t", "submission_id_t1", "code_sha256_t", "code_sha256_t1"),
    })


def evidence_ready(consecutive, *valid):
    """Consecutive, with all evidence valid; lengths of traces and tests need not agree."""
    out = F.coalesce(consecutive, F.lit(False))
    for v in valid:
        out = out & F.coalesce(v, F.lit(False))
    return out


def language_profile(pairs: DataFrame, language: str = "language_t") -> DataFrame:
    """Transitions, problems and participants of each language and the score ``n * sqrt(problems * participants)``."""
    out = pairs.groupBy(F.col(language).alias("language")).agg(F.count("*").alias("transitions"), F.countDistinct("problem_id").alias("problems"), F.countDistinct("participant_id_hash").alias("participants"))
    return out.withColumn("selection_score", F.col("transitions") * F.sqrt((F.col("problems") * F.col("participants")).cast("double")))


def best_language(profile: DataFrame) -> DataFrame:
    return profile.orderBy(F.desc("selection_score"), F.desc("transitions"), "language").limit(1)


def length_histogram(trajectories: DataFrame, top: int | None = None) -> DataFrame:
    """Trajectories by length; with ``top`` all longer ones are one bucket, ``top+1`` and over."""
    n = F.col("submission_count")
    bucket = n.cast("string") if top is None else F.when(n <= top, n.cast("string")).otherwise(f"{top + 1}+")
    return trajectories.groupBy(bucket.alias("attempts")).agg(F.count("*").alias("trajectories"))


def thresholds(trajectories: DataFrame, least: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Trajectories, participants and problems with at least so many attempts, in one aggregation."""
    each = trajectories.withColumn("minimum_attempts", F.explode(F.filter(F.array(*map(F.lit, least)), lambda x: F.col("submission_count") >= x)))
    return each.groupBy("minimum_attempts").agg(F.count("*").alias("trajectories"), F.countDistinct("user_id").alias("participants"), F.countDistinct("problem_id").alias("problems"))


def ordinals(df: DataFrame, order: list[str], name: str, prefix: str, width: int = 3, partition: list[str] | None = None) -> DataFrame:
    """Ids ``prefix001``, ``prefix002`` ... in an order, over the whole table or within each ``partition``."""
    if partition:
        numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    else:
        numbered = ranked(df, order, name)
    return numbered.withColumn(name, F.concat(F.lit(prefix), F.lpad(F.col(name).cast("string"), F.greatest(F.lit(width), F.length(F.col(name).cast("string"))), F.lit("0"))))
