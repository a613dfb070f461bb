"""A dataset profiled as a whole: from submissions and problems to eligible pairs, their split, and the audits of it.

Only rows that pass every validity flag are ordered, so trajectories, pairs and all that follows are of valid rows; counts
of submissions are of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import checks, quality, similarity, split, trajectory
from .shared import kept

REQUIRED = ["submission_id", "user_id", "problem_id", "attempt_number", "language", "code", "verdict", "trace"]
PROBLEM_COLUMNS = ["problem_id", "description", "test_cases"]
CASE_KEYS = ["test_case_no", "input", "output"]
PARTS = ("development", "validation", "test")
HASHES = ("code_sha256_t", "code_sha256_t1", "code_whitespace_sha256_t", "code_whitespace_sha256_t1")


@dataclass
class Profile:
    flagged: DataFrame  # submissions with their flags
    problems: DataFrame  # with test_cases_valid and test_case_count
    trajectories: DataFrame
    pairs: DataFrame  # neighbours, with evidence_ready
    languages: DataFrame  # (language, transitions, problems, participants, selection_score) of eligible pairs
    near: DataFrame  # (a, b) of problems with near-equal descriptions
    groups: DataFrame  # (problem_id, leakage_group_id, leakage_group_size)
    assigned: DataFrame  # (problem_id, split_primary) of problems with eligible pairs
    primary: DataFrame  # eligible pairs of the primary language, with both splits and cross_split_duplicate
    strict: DataFrame  # those without code in several splits


def language_scores(submissions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each language of the submissions, its eligible pairs (consecutive, of one language, with evidence, edited), their
    problems and participants, and ``transitions * sqrt(problems * participants)``; 0 for a language without any."""
    eligible = pairs.filter("is_consecutive and same_language and evidence_ready and not code_exact_same")
    scored = trajectory.language_profile(eligible)
    every = submissions.filter("language is not null").select("language").distinct()
    return every.join(scored, "language", "left").fillna(0)


def primary_language(scores: DataFrame) -> DataFrame:
    """(language): the highest score, then most problems, then most participants, then the first by name."""
    return scores.orderBy(F.desc("selection_score"), F.desc("problems"), F.desc("participants"), "language").limit(1).select("language")


def crossing(primary: DataFrame, split_column: str) -> DataFrame:
    """(hash): codes that pairs of several parts have, told apart exactly or but for white space, on either side."""
    found = [split.crossing_hashes(primary, list(HASHES[i : i + 2]), split_column).select("hash") for i in (0, 2)]
    return found[0].union(found[1]).distinct()


def marked(primary: DataFrame, bad: DataFrame) -> DataFrame:
    """``primary`` with ``cross_split_duplicate``: any of the four hashes is among the bad ones, of whichever kind."""
    sides = primary.select("transition_id", F.explode(F.array_distinct(F.array(*HASHES))).alias("hash"))
    hit = sides.join(bad, "hash", "left_semi").select("transition_id").distinct().withColumn("cross_split_duplicate", F.lit(True))
    return primary.join(hit, "transition_id", "left").withColumn("cross_split_duplicate", F.coalesce("cross_split_duplicate", F.lit(False)))


def build(submissions: DataFrame, problems: DataFrame, percent: int = 90) -> Profile:
    """The profile of submissions (``REQUIRED``, further columns stay) and problems (``PROBLEM_COLUMNS``), one row each."""
    quality.require_columns(submissions, REQUIRED, "submissions")
    quality.require_columns(problems, PROBLEM_COLUMNS, "problems")
    fine = text.json_list_reason("test_cases").isNull()
    problems = problems.withColumns({
        "test_cases_valid": fine & F.coalesce(text.items_have_keys("test_cases", CASE_KEYS), F.lit(False)),
        "test_case_count": F.when(fine, F.expr("variant_get(try_parse_json(test_cases), '$', 'array<variant>')")),
    }).withColumn("test_case_count", F.when(F.col("test_case_count").isNotNull(), F.size("test_case_count")))
    problems = kept(problems.select(*(c for c in problems.columns)))

    flagged = quality.flag_submissions(submissions, problems, REQUIRED)
    traced = text.json_list_reason("trace").isNull()
    items = F.when(traced, text.json_list("trace"))
    flagged = flagged.withColumns({
        "trace_valid": traced, "trace_length": F.when(traced, text.array_length(items)), "trace_last_matches_final": F.coalesce(text.array_last(items) == F.col("verdict"), F.lit(False)),
        "code_sha256": text.sha256_text("code"), "code_whitespace_sha256": F.sha2(text.normalize_code(F.coalesce("code", F.lit("nan"))), 256),
    })
    tests = problems.select(F.col("problem_id").alias("_p"), "test_cases_valid", "test_case_count")
    flagged = kept(flagged.join(tests, F.col("problem_id") == F.col("_p"), "left").drop("_p").withColumn("trace_length_matches", F.coalesce(F.col("trace_length") == F.col("test_case_count"), F.lit(False))))

    valid = flagged.filter("row_valid_for_ordering").withColumn("attempt", F.col("attempt").cast("int"))
    trajectories = kept(trajectory.summarise(valid))
    pairs = trajectory.transitions(valid, carry=("trace_valid", "test_cases_valid"))
    ready = trajectory.evidence_ready(F.col("is_consecutive"), F.col("trace_valid_t"), F.col("trace_valid_t1"), F.col("test_cases_valid_t"))
    pairs = kept(pairs.drop("code_t", "code_t1").withColumn("evidence_ready", ready))

    scores = kept(language_scores(flagged, pairs))
    best = F.broadcast(primary_language(scores))  # a row
    eligible = pairs.filter("is_consecutive and same_language and evidence_ready and not code_exact_same")
    primary = kept(eligible.join(best, F.col("language_t") == F.col("language"), "left_semi"))

    described = problems.select("problem_id", F.split(text.normalize_problem_text("description"), " ").alias("tokens"))
    described = described.withColumn("tokens", F.filter("tokens", lambda x: x != ""))
    near = kept(similarity.near_pairs(described, "problem_id", "tokens", percent).select("a", "b"))
    groups = kept(similarity.leakage_groups(problems.select("problem_id"), "problem_id", near))
    weights = primary.join(groups, "problem_id").groupBy("leakage_group_id").agg(F.count("*").alias("n"))
    parts = split.weighted_split(weights, "leakage_group_id", "n").select("leakage_group_id", F.col("split").alias("split_primary"))
    assigned = kept(primary.select("problem_id").distinct().join(groups, "problem_id").join(parts, "leakage_group_id").select("problem_id", "split_primary"))
    second = split.stable_split(primary, "participant_id_hash").withColumnRenamed("split", "split_participant_secondary")
    primary = kept(primary.join(assigned, "problem_id").join(second, "participant_id_hash"))
    primary = kept(marked(primary, crossing(primary, "split_primary")))
    return Profile(flagged, problems, trajectories, pairs, scores, near, groups, assigned, primary, primary.filter("not cross_split_duplicate"))


def transition_ledger(p: Profile) -> DataFrame:
    """The rules T01 to T06 over the pairs of a profile. Ids, statuses and reasons are outputs."""
    c = F.col("is_consecutive")
    rules = [
        ("transition", "T01", "exclude", "Adjacent stored rows skip an attempt number", ~c),
        ("transition", "T02", "exclude from single-language primary set", "Programming language changes between consecutive attempts", c & ~F.col("same_language")),
        ("transition", "T03", "exclude from evidence-grounded set", "One or both traces/tests are not parseable", c & ~F.col("evidence_ready")),
        ("transition", "T04", "flag; exclude from edited primary set", "Source code is exactly unchanged across attempts", c & F.col("code_exact_same")),
        ("transition", "T05", "flag", "Only whitespace changed under a simple normalization", c & ~F.col("code_exact_same") & F.col("code_whitespace_normalized_same")),
    ]
    last = ("transition", "T06", "exclude from strict evaluation partitions", "Exact or whitespace-normalized code occurs across problem-disjoint splits", F.col("cross_split_duplicate"))
    return quality.ledger(p.pairs, rules).unionByName(quality.ledger(p.primary, [last]))


def near_violations(p: Profile) -> DataFrame:
    """(a, b): near pairs of problems in different parts; problems without eligible pairs are in none."""
    side = lambda x: p.assigned.select(F.col("problem_id").alias(x), F.col("split_primary").alias(f"s{x}"))
    return p.near.join(side("a"), "a").join(side("b"), "b").filter("sa <> sb").select("a", "b")


def validation(p: Profile) -> DataFrame:
    """(check, expected, actual, passed) of the thirteen named checks."""
    strict = p.strict.withColumns({"part": F.col("split_primary"), "second": F.col("split_participant_secondary")})
    return checks.validation(p.flagged, p.problems, strict, near_violations(p), crossing(p.strict, "split_primary"), REQUIRED, PROBLEM_COLUMNS, "problem_id", everyone=p.primary.withColumn("second", F.col("split_participant_secondary")))


def summary(p: Profile) -> DataFrame:
    """One row of all the numbers of the profile. Counts by part are texts, ``part=n`` joined by ``;`` in order of the parts."""
    best = primary_language(p.languages)
    base = quality.profile_row(p.flagged, p.trajectories, p.pairs.filter("is_consecutive or not is_consecutive"), best)
    one = lambda name, df, value: df.agg(value.alias(name))
    listed = lambda df, name: df.groupBy("split_primary").agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s=%d", "split_primary", "n"))), ";").alias(name))
    extra = [
        one("problem_rows", p.problems, F.count("*")),
        one("all_trajectories", p.flagged.filter("user_id is not null and problem_id is not null"), F.count_distinct("user_id", "problem_id")),
        p.primary.agg(F.count("*").alias("primary_eligible_transitions_before_cross_split_dedup"), F.count_if("cross_split_duplicate").alias("primary_cross_split_code_duplicate_transitions_removed")),
        p.strict.agg(
            F.count("*").alias("primary_eligible_transitions"), F.count_distinct("trajectory_id").alias("primary_eligible_trajectories"), F.count_distinct("participant_id_hash").alias("primary_eligible_participants"),
            F.count_distinct("problem_id").alias("primary_eligible_problems"), F.when((F.count("*") >= 100) & (F.count_distinct("problem_id") >= 10), "PASS").otherwise("REVIEW").alias("gate_stage4"),
        ),
        listed(p.strict, "split_counts"), listed(p.assigned, "split_problem_counts"),
        quality.extra_rows(p.flagged, REQUIRED).withColumnRenamed("extra_rows", "exact_duplicate_submission_rows"),
        p.problems.agg(F.count_if(~F.col("test_cases_valid")).alias("malformed_problem_test_rows"), F.coalesce(F.bool_and("test_cases_valid"), F.lit(True)).alias("official_tests_available")),
        one("trace_length_matches_test_count_rows", p.flagged, F.count_if("trace_length_matches")),
        one("near_duplicate_problem_pairs_review", p.near, F.count("*")), one("near_duplicate_problem_split_violations", near_violations(p), F.count("*")),
        checks.gate(validation(p)).select(F.col("gate").alias("gate_stage5")),
    ]
    for part in extra:
        base = base.join(F.broadcast(part))  # single rows
    return base
