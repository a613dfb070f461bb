"""Guards of joins and sinks: what repeats, disagrees or is too large is named or refused."""

import pytest

from revaudit.functions.text import pseudonym
from revaudit.operators import joins, ledger, quality
from revaudit.sources import sinks


def test_usage_rows_must_agree(spark):
    rows = spark.createDataFrame([("a", None, "m"), ("b", 5, None), (None, None, "x")], "item string, tokens int, model string")
    usage = spark.createDataFrame([("a", 3, None), ("a", 3, "n"), ("b", 9, "o"), ("c", 1, "p"), (None, 7, "q")], "item string, tokens int, model string")
    got = {r.item: (r.tokens, r.model) for r in ledger.enrich(rows, usage, "item", ["tokens", "model"]).collect()}
    assert got == {"a": (3, "m"), "b": (5, "o"), None: (None, "x")}
    other = usage.union(spark.createDataFrame([("a", 4, None)], usage.schema))
    with pytest.raises(Exception, match="usage rows disagree: a"):
        ledger.enrich(rows, other, "item", ["tokens", "model"]).collect()


def test_second_attempts_are_single(spark):
    first = spark.createDataFrame([("a", 429), ("b", 200), ("c", 429)], "item string, http_status int")
    second = spark.createDataFrame([("a", 200, "accepted")], "item string, http_status int, outcome string")
    assert {(r.item, r.outcome, r.http_status) for r in ledger.recovery(first, second, "item").collect()} == {("a", "accepted", 200), ("c", "missing", None)}
    with pytest.raises(Exception, match="several second attempts: a"):
        ledger.recovery(first, second.union(second), "item").collect()


def test_manifest_problems(spark):
    subs = [("s1", "u", "p", 1, "C"), ("s2", "u", "p", 2, " c "), ("s3", "u", "p", 3, "Java"), ("s3", "u", "p", 3, "Java"), ("s5", "v", "q", 1, "C"), ("s6", "v", "q", 2, None)]
    subs = spark.createDataFrame(subs, "submission_id string, user_id string, problem_id string, attempt int, language string")
    manifest = spark.createDataFrame([(1, "s1", 1, "p", "u"), (2, "s2", 2, "p", "u"), (3, "s3", 3, "p", "u"), (4, "none", 1, "p", "u"), (5, "s5", 2, "p", "u"), (6, None, None, None, None)], "item int, submission_id string, attempt int, problem_id string, u string")
    manifest = manifest.withColumn("participant_id_hash", pseudonym("u")).drop("u")
    got = sorted(tuple(r) for r in joins.manifest_problems(manifest, subs, spark.createDataFrame([("p",), ("p",), (None,)], "problem_id string"), ["c"]).collect())
    assert got == [
        (2, "language not selected"), (2, "repeated next attempt"), (3, "language not selected"), (3, "no next attempt"), (3, "repeated submission"), (4, "missing selected submission"),
        (5, "attempt differs from its source"), (5, "language not selected"), (5, "participant differs from its source"), (5, "problem differs from its source"), (5, "unknown problem"), (6, "missing selected submission"),
    ]


def test_nested_statuses(spark):
    state = "struct<status: string>"
    rows = [((("OK",), (None,)), [(("PASS",), ("FAIL",)), ((None,), ("FAIL",))]), ((("OK",), ("OK",)), None), ((("BAD",), ("OK",)), [])]
    df = spark.createDataFrame(rows, f"compiler struct<earlier: {state}, later: {state}>, tests array<struct<earlier: {state}, later: {state}>>")
    got = {(r.evidence, r.state, r.status): r.n for r in ledger.status_counts(df).collect()}
    assert got == {
        ("compiler", "earlier", "OK"): 2, ("compiler", "earlier", "BAD"): 1, ("compiler", "later", "OK"): 2, ("compiler", "later", "<MISSING>"): 1,
        ("test", "earlier", "PASS"): 1, ("test", "earlier", "<MISSING>"): 1, ("test", "later", "FAIL"): 2,
    }


def test_offset_and_limit(spark):
    df = spark.createDataFrame([(i * 7 % 20, i) for i in range(20)], "a int, b int").repartition(4)
    got = lambda *x: sorted((r.position, r.a) for r in quality.select_window(df, ["a"], *x).collect())
    assert got(3, 4) == [(3, 3), (4, 4), (5, 5), (6, 6)] and got(18) == [(18, 18), (19, 19)] and got(20, 5) == [] and len(got()) == 20


def test_large_sheets_are_refused(spark, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 3)
    assert sinks.workbook({"x": spark.range(3)}).first().payload == '{"columns":["id"],"rows":[["0"],["1"],["2"]]}'
    with pytest.raises(ValueError, match="more than 3 rows"):
        sinks.workbook({"x": spark.range(4)})
