"""The profile over small tables, and trajectories with large gaps."""

from dataclasses import replace

from revaudit.operators import profile, trajectory

ROW = "submission_id string, user_id string, problem_id string, attempt_number string, language string, code string, verdict string, trace string"


def submissions(spark):
    rows = []
    for p in range(4):
        for u in range(5):
            for a in range(1, 5):
                rows.append((f"s{p}{u}{a}", f"u{u}", f"p{p}", str(a), "C", f"code {p} {u} {a}", "OK", '["OK"]'))
    rows += [("x1", "u0", "p0", "9", "C", None, "OK", '["OK"]'), ("x2", "u0", "p0", "0", "C", "c", "OK", '["OK"]'), ("x3", "u0", "p9", "1", "C", "c", "OK", '["OK"]'), ("x4", "u1", "p1", "7", "C", "c", "OK", "no list")]
    return spark.createDataFrame(rows, ROW)


def problems(spark, last="a b c d e f g h i j"):
    texts = ["a b c d e f g h i j k", "l m n o p q r s t u", "v w x y z one two three four five", last]
    return spark.createDataFrame([(f"p{i}", t, '[{"test_case_no":1,"input":"a","output":"b"}]') for i, t in enumerate(texts)], "problem_id string, description string, test_cases string")


def test_only_valid_rows_are_ordered(spark):
    p = profile.build(submissions(spark), problems(spark))
    row = profile.summary(p).first()
    assert (row.submissions_rows, row.missing_required_submission_rows, row.invalid_attempt_rows, row.unlinked_problem_rows) == (84, 1, 1, 1)
    assert (row.valid_trajectories, row.all_trajectories, row.adjacent_pairs_all, row.consecutive_transitions_all) == (20, 21, 61, 60)
    assert (row.evidence_ready_consecutive_transitions, row.primary_eligible_transitions, row.primary_language) == (60, 60, "C")
    assert (row.near_duplicate_problem_pairs_review, row.near_duplicate_problem_split_violations) == (1, 0)
    assert row.gate_stage5 == "PASS"
    groups = {r.problem_id: r.leakage_group_size for r in p.groups.collect()}
    assert groups == {"p0": 2, "p1": 1, "p2": 1, "p3": 2}


def test_near_pair_across_parts_fails_the_check(spark):
    p = profile.build(submissions(spark), problems(spark))
    passed = lambda x: {r.check: r.passed for r in profile.validation(x).collect()}
    assert all(passed(p).values()) and len(passed(p)) == 13
    name = "no_near_duplicate_problem_pair_crosses_primary_splits"
    torn = replace(p, assigned=spark.createDataFrame([("p0", "test"), ("p1", "validation"), ("p2", "development"), ("p3", "development")], "problem_id string, split_primary string"))
    assert [k for k, v in passed(torn).items() if not v] == [name]


def test_code_across_parts_is_excluded(spark):
    from pyspark.sql import functions as F

    subs = submissions(spark).withColumn("code", F.when(F.col("submission_id").isin("s002", "s102", "s202"), "int  main ( ) { }").when(F.col("submission_id").isin("s113"), "int main(){}").otherwise(F.col("code")))
    p = profile.build(subs, problems(spark))
    row = profile.summary(p).first()
    crossing = {r.transition_id for r in p.primary.filter("cross_split_duplicate").collect()}
    assert len(crossing) == row.primary_cross_split_code_duplicate_transitions_removed == 8  # each of four rows stands in two pairs
    assert row.primary_eligible_transitions == 52 and row.gate_stage5 == "PASS"
    assert [r["count"] for r in profile.transition_ledger(p).orderBy("rule_id").collect()] == [1, 0, 0, 0, 0, 8]


def test_empty_tables(spark):
    p = profile.build(submissions(spark).limit(0), problems(spark).limit(0))
    row = profile.summary(p).first()
    assert (row.submissions_rows, row.valid_trajectories, row.primary_language, row.split_counts) == (0, 0, None, "")


def test_large_gaps_are_ranges(spark):
    rows = [("u", "p", a, "C", "OK") for a in (3, 5, 2_000_000_000, 5)] + [("v", "p", a, "C", v) for a, v in ((1, "x"), (1, "y"), (2, None))]
    df = spark.createDataFrame(rows, "user_id string, problem_id string, attempt int, language string, verdict string")
    got = {r.user_id: r for r in trajectory.summarise(df).collect()}
    assert (got["u"].missing_attempt_numbers, got["u"].attempt_numbers_contiguous, got["u"].max_attempt) == ("4;6..1999999999", False, 2_000_000_000)
    assert (got["v"].missing_attempt_numbers, got["v"].attempt_numbers_contiguous, got["v"].final_attempt_verdict) == ("", True, None)
