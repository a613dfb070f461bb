import random

import pytest
from pyspark.sql import functions as F

from revaudit.operators import agreement, bootstrap, checks, decisions, joins, ledger, metrics, packets, quality, similarity, split, trajectory
from revaudit.sources import readers, sinks


def test_flags(spark):
    rows = [("s1", "u", "p", "1", "x"), ("s1", "u", "p", "1", "x"), ("s2", "u", "p", "1.5", "x"), ("s3", "u", "q", "0", None), ("s4", "u", "p", "abc", "y"), ("s5", "u", "p", "3", "z")]
    subs = spark.createDataFrame(rows, "submission_id string, user_id string, problem_id string, attempt_number string, code string")
    probs = spark.createDataFrame([("p",)], "problem_id string")
    out = {(r.submission_id, r.row_valid_for_ordering) for r in quality.flag_submissions(subs, probs, ["submission_id", "code"]).collect()}
    assert out == {("s1", False), ("s2", False), ("s3", False), ("s4", False), ("s5", True)}
    with pytest.raises(ValueError, match="missing required"):
        quality.require_columns(subs, ["nope"], "subs")


def test_trajectory_gaps(spark):
    rows = [("u", "p", a, f"s{a}", "C", f"code {a}", v) for a, v in ((1, None), (2, "Wrong"), (5, "Accepted"))] + [(None, "p", 1, "x", "C", "c", None)]
    df = spark.createDataFrame(rows, "user_id string, problem_id string, attempt int, submission_id string, language string, code string, verdict string")
    r = trajectory.summarise(df).collect()
    assert len(r) == 1 and r[0].missing_attempt_numbers == "3;4" and r[0].accepted_ever and r[0].final_attempt_verdict == "Accepted"
    t = {x.attempt_t: (x.is_consecutive, x.verdict_changed) for x in trajectory.transitions(df).collect()}
    assert t == {1: (True, True), 2: (False, True)}
    shuffled = {x.pair_sha256 for x in trajectory.transitions(df.orderBy(F.rand(3))).collect()}
    assert shuffled == {x.pair_sha256 for x in trajectory.transitions(df).collect()}


def test_near_pairs_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 12))] for _ in range(40)]
    items = [(i, x) for i, x in enumerate(base + [b[:-1] if b else b for b in base[:20]] + base[:5])]
    want = {}
    for i, a in items:
        for j, b in items:
            if i < j:
                sa, sb = set(a), set(b)
                jac = 1.0 if not sa | sb else len(sa & sb) / len(sa | sb)
                if jac >= 0.8:
                    want[i, j] = round(jac, 9)
    got = similarity.near_pairs(spark.createDataFrame(items, "k long, s array<string>"), "k", "s", 80).collect()
    assert {(r.a, r.b): round(r.similarity, 9) for r in got} == want and len(got) == len(want)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (20, 21)]
    df = similarity.components(spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 7, 8, 9, 20, 21)], "k long"), "k", spark.createDataFrame(edges, "a long, b long"))
    assert {r.k: r.root for r in df.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 6, 7: 6, 8: 6, 9: 6, 20: 20, 21: 20}


# A published assignment of weighted groups: fixed values.
def test_weighted_split_covers(spark):
    g = [(f"g{i}", i % 7 + 1) for i in range(24)]
    out = split.weighted_split(spark.createDataFrame(g, "k string, n long"), "k", "n").collect()
    assert sorted(r.k for r in out) == sorted(k for k, _ in g)
    load = {s: sum(r.n for r in out if r.split == s) for s in ("development", "validation", "test")}
    total = sum(n for _, n in g)
    assert abs(load["development"] / total - 0.6) < 0.1 and min(load.values()) > 0


@pytest.mark.parametrize("n,test,val", [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 1, 1), (10, 2, 2)])
def test_stable_split(spark, n, test, val):
    out = [r.split for r in split.stable_split(spark.createDataFrame([(f"k{i}",) for i in range(n)], "k string"), "k").collect()]
    assert (out.count("test"), out.count("validation"), len(out)) == (test, val, n)


def test_kappa(spark):
    rows = [("KEEP", "KEEP")] * 20 + [("RETIRE", "RETIRE")] * 15 + [("KEEP", "RETIRE")] * 5 + [("RETIRE", "KEEP")] * 10
    df = spark.createDataFrame(rows, "a string, b string")
    r = agreement.kappa(df, {"x": ("a", "b")}).first()
    po, pe = 35 / 50, (25 * 30 + 25 * 20) / 2500
    assert abs(r.kappa - (po - pe) / (1 - pe)) < 1e-12
    assert agreement.kappa(df, {"x": ("b", "a")}).first().kappa == pytest.approx(r.kappa)
    assert agreement.kappa(df.filter("a = 'KEEP' and b = 'KEEP'"), {"x": ("a", "b")}).first().kappa == 1.0
    assert agreement.kappa(df.limit(0), {"x": ("a", "b")}).count() == 0


def test_scores(spark):
    rows = [("c1", "B", "RETIRE", "KEEP", False, 0.9, "success", None, None), ("c2", "B", "KEEP", "KEEP", False, None, "success", 2.0, 1.0), ("c3", "B", "UNSURE", "KEEP", True, 0.8, "error", 4.0, None)]
    df = spark.createDataFrame(rows, "claim_id string, method string, gold_label string, predicted_label string, abstain boolean, confidence double, status string, latency_ms double, estimated_cost_usd double")
    r = metrics.score(df, "method").first()
    assert (r.false_keep, r.unsafe, r.false_keep_rate, r.decision_coverage, r.selective_risk) == (1, 1, 1.0, 1.0, 0.5)
    assert r.retraction_recall is None and r.mean_latency_ms == 3.0 and r.invalid_or_failed == 1 and r.unsure_withheld == 1
    none = metrics.score(df.withColumn("abstain", F.lit(True)), "method").first()
    assert none.decision_coverage == 0.0 and none.selective_risk is None


@pytest.mark.parametrize("o,t,label", [("REFUTED", "NOT_APPLICABLE", "RETRACT"), ("SUPPORTED", "PRESENT", "KEEP"), ("SUPPORTED", "RESOLVED", "RETIRE"), ("INDETERMINATE", "INDETERMINATE", "UNSURE")])
def test_decisions(spark, o, t, label):
    df = spark.createDataFrame([("i", o, t, label, False, "")], "item_id string, original_validity string, target_state_t1 string, lifecycle_label string, abstain boolean, abstention_reason string")
    r = decisions.validate(df).first()
    assert r.decision_validation == "PASS" and r.lifecycle_label == label
    wrong = decisions.validate(df.withColumn("lifecycle_label", F.lit("KEEP" if label != "KEEP" else "RETIRE"))).first()
    assert wrong.decision_rule_violation and wrong.lifecycle_label == "UNSURE" and wrong.abstain


def test_bootstrap(spark):
    sums = spark.createDataFrame([(i, *x) for i, x in enumerate([(1, 2), (2, 2), (0, 2), (2, 3)])], "i long, num long, den long")
    ends = [(r.low, r.high) for r in (bootstrap.intervals(spark, {"x": sums}, 500, 1).first() for _ in range(2))]
    assert 0 <= ends[0][0] <= ends[0][1] <= 100 and ends[0] == ends[1]
    df = spark.createDataFrame([(c, i % 2) for c in "abcd" for i in range(4)], "c string, x int")
    r = bootstrap.bootstrap_ratio(df, "c", F.col("x"), F.lit(1), 20).first()
    assert (r.clusters, r.percent, r.low, r.high) == (4, 50.0, 50.0, 50.0)


def test_ledger(spark):
    keys = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    assert ledger.coverage(keys(1, 2, 3), keys(1), keys(2, 3), "k").first().passed
    bad = ledger.coverage(keys(1, 2, 3), keys(1, 2), keys(2, 4), "k").first()
    assert (bad.missing, bad.unexpected, bad.in_both, bad.passed) == (1, 1, 1, False)
    u = ledger.usage_summary(spark.createDataFrame([("a", 1, 4.0), ("a", None, 1.0)], "g string, total_tokens long, latency_ms double"), "g").first()
    assert u.tokens is None and u.median_latency == 4.0


def test_packets(spark):
    df = spark.createDataFrame([("i1", "p", "s", "a", "b", "claim", [("2", "x", "y"), ("10", "u", "v")])], "item string, p string, s string, e string, l string, c string, cases array<struct<test_case_no:string,input:string,output:string>>")
    p = packets.build(df.withColumn("t", packets.official_tests("cases", "p")), "item", "p", "s", "e", "l", "c", "t")
    r = p.first()
    assert [t.test_case_id for t in r.tests] == ["p_T2", "p_T10"] and len(r.all_evidence_ids) == 13
    sealed = packets.sealed(p)
    assert sealed.select(packets.seal_intact(sealed).alias("x")).first().x
    assert packets.issues(p).first().issues == []
    broken = p.withColumn("tests", F.array().cast(p.schema["tests"].dataType)).withColumn("problem_statement", F.lit(" "))
    assert packets.issues(broken).first().issues == ["problem statement is missing", "official tests are missing or empty"]


def test_readers_and_sinks(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    (tmp_path / "x.csv").write_bytes('﻿id,code,n\n007,"a ""b""\nc",1\nNA,None,2\n'.encode())
    schema = StructType([StructField("id", StringType()), StructField("code", StringType()), StructField("n", IntegerType())])
    rows = readers.read_csv(spark, str(tmp_path / "x.csv"), schema).collect()
    assert [(r.id, r.code, r.n) for r in rows] == [("007", 'a "b"\nc', 1), (None, None, 2)]
    df = spark.createDataFrame([("b", None), ("a", 2)], "z string, a int")
    sinks.write_canonical(df, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":2,"z":"a"}', '{"a":null,"z":"b"}']
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_canonical(df, str(tmp_path / "out"))
    back = readers.read_jsonl(spark, str(tmp_path / "out"), StructType([StructField("a", IntegerType()), StructField("z", StringType())]))
    assert sinks.rebuild_check(back, df.select("a", "z")).first().identical
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n\n[1]\nnope\n')
    assert [r.line_number for r in readers.bad_lines(spark, str(tmp_path / "bad.jsonl")).orderBy("line_number").collect()] == [3, 4]
    with pytest.raises(Exception, match="duplicate key"):
        readers.union_sources([df, df], "z").collect()


def test_checksums(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "a.txt").write_text("one")
    (d / "b.txt").write_text("two")
    found = readers.file_hashes(spark, str(d))
    lines = [r.value for r in sinks.checksum_lines(found).collect()]
    (tmp_path / "SUMS").write_text("\n".join([*lines, "0" * 64 + "  c.txt"]))
    (d / "b.txt").write_text("three")
    out = readers.verify_checksums(readers.read_checksums(spark, str(tmp_path / "SUMS")), readers.file_hashes(spark, str(d)))
    assert {r.path: r.status for r in out.collect()} == {"a.txt": "ok", "b.txt": "mismatch", "c.txt": "missing"}
    (tmp_path / "EVIL").write_text("0" * 64 + "  ../x")
    with pytest.raises(Exception, match="bad checksum line"):
        readers.read_checksums(spark, str(tmp_path / "EVIL")).collect()


def test_checks(spark):
    df = spark.range(3)
    c = checks.check(df, "n", 3, F.count("*"))
    assert checks.require(c).count() == 1 and checks.gate(c, checks.check(df, "m", 4, F.count("*"))).first().gate == "FAIL"
    with pytest.raises(Exception, match="check failed"):
        checks.require(checks.check(df, "m", 4, F.count("*"))).collect()


def test_joins(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, h string"), spark.createDataFrame([(1, "x"), (3, "z")], "k long, h string")
    assert {r.k: r.status for r in joins.evidence_match(a, b, "k", "h").collect()} == {1: "MATCHED", 2: "MISMATCH", 3: "MISMATCH"}
    assert joins.set_compare(a, b, "k").first().asDict() == {"only_left": 1, "only_right": 1, "both": 1}


def test_walk_any_depth(spark):
    deep = '{"a":[' * 10_000 + '{"expected_answer":{"x":[1.50,"é"]},"k":true,"k":null}' + "]}" * 10_000
    rows = spark.createDataFrame([(1, deep), (2, None), (3, "no json"), (4, ""), (5, '["a",{"b":2}]'), (6, deep[:-1]), (7, '{"\\ud800":"\\udc00"}')], "k int, j string")
    found = packets.walk(rows, "k", "j").collect()
    assert sum(r.name == "a" for r in found) == 10_000 and {r.k for r in found} == {1, 5, 7}
    assert [(r.name, r.text) for r in found if r.k == 1 and r.name != "a"] == [("expected_answer", None), ("x", None), ("k", "true"), ("k", None)]
    assert [(r.name, r.text) for r in found if r.k in (5, 7)] == [("b", "2"), ("?", "?")]
    assert packets.forbidden(packets.walk(rows, "k", "j"), "k").collect()[0].forbidden == ["expected_answer"]
    assert sum(len(r.name or "") + len(r.text or "") for r in found if r.k == 1) < len(deep)


def test_members_equal_those_of_the_parser():
    import json
    import random

    class Named(list):
        pass

    def want(text):
        try:
            v = json.loads(text, object_pairs_hook=Named, parse_int=lambda x: ("n", x), parse_float=lambda x: ("n", x), parse_constant=lambda x: ("n", x))
        except ValueError:
            return []
        out = []

        def go(x):
            for y in x if isinstance(x, list) else ():
                if isinstance(x, Named):
                    k, y = y
                    out.append((k, None if y is None or isinstance(y, list) else y[1] if isinstance(y, tuple) else str(y).lower() if isinstance(y, bool) else y))
                go(y)

        go(v)
        return out

    rng = random.Random(6)

    def value(depth):
        kind = rng.randrange(9 if depth else 6)
        if kind < 6:
            return rng.choice(['"a"', '"\\u00e9\\n\\""', '""', "-0", "1.50", "1e9", "12", "true", "false", "null", "NaN", "-Infinity", '"é😀"'])
        items = [value(depth - 1) for _ in range(rng.randrange(4))]
        return "[" + " , ".join(items) + "]" if kind == 6 else "{" + ",\n".join(f'"{rng.choice("abc")}" : {x}' for x in items) + "}"

    for _ in range(1500):
        text = value(4)
        if rng.random() < 0.5:  # broken in some way, or not
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(["", ",", "]", "}", "0", '"', " ", "x", ".5", ":"]) + text[i + rng.randrange(2) :]
        assert packets.members(text) == want(text), text
    assert packets.members("[" * 100_000) == [] == packets.members("")


def test_near_pairs_of_representatives(spark):
    items = [(i, ["a", "b", "c"]) for i in range(50)] + [(60, ["a", "b", "c", "d"]), (61, ["a", "b", "c", "d"]), (70, []), (71, [])]
    got = similarity.near_pairs(spark.createDataFrame(items, "k long, s array<string>"), "k", "s", 75, expand=False).collect()
    assert sorted((r.a, r.b) for r in got) == sorted([(0, i) for i in range(1, 50)] + [(0, 60), (60, 61), (70, 71)])


def test_components_of_a_long_path(spark):
    n = 300
    order = [(i * 37) % n for i in range(n)]
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    df = similarity.components(spark.range(n).withColumnRenamed("id", "k"), "k", edges)
    assert {r.root for r in df.collect()} == {0}


def test_usage_middle(spark):
    rows = [("a", float(i % 5), 1) for i in range(100)] + [("b", 3.0, None), ("b", 9.0, 2), (None, None, 1), ("c", None, 1)]
    out = {r.g: r for r in ledger.usage_summary(spark.createDataFrame(rows, "g string, latency_ms double, total_tokens int"), "g").collect()}
    assert (out["a"].median_latency, out["b"].median_latency, out[None].median_latency) == (2.0, 9.0, None)
    assert (out["a"].tokens, out["b"].tokens, out["c"].tokens) == (100, None, 1)


def test_whole_row_duplicates(spark):
    rows = [("s1", "u", "p", "1", "x"), ("s1", "u", "p", "1", "y"), ("s2", "u", "p", "2", None), ("s2", "u", "p", "2", None)]
    df = spark.createDataFrame(rows, "submission_id string, user_id string, problem_id string, attempt_number string, extra string")
    out = quality.flag_submissions(df, spark.createDataFrame([("p",)], "problem_id string"), ["user_id"])
    assert sorted((r.submission_id, r.exact_duplicate_row) for r in out.collect()) == [("s1", False), ("s1", False), ("s2", True), ("s2", True)]


def test_json_array_without_a_list(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "x.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="no list"):
        readers.read_json_array(spark, str(tmp_path), StructType.fromDDL("a int")).collect()


def test_reconstructed_refuses_logged_attempts(spark):
    a = spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], "item_id int, sequence int, request_sha256 string")
    empty = a.limit(0)
    rows = ledger.reconstructed(a, empty, empty, empty, "item_id")
    assert {k: d.count() for k, d in rows.items()} == {"raw": 2, "errors": 2, "metadata": 2}
    with pytest.raises(Exception, match="refusing to duplicate"):
        ledger.reconstructed(a, empty, a.filter("item_id = 2"), empty, "item_id")["raw"].collect()


def test_covered_recovery(spark):
    m = spark.createDataFrame([("a", 200, None), ("b", 500, "E"), ("c", 200, None), ("c", 200, None), ("d", 200, None), ("x", 200, None)], "item_id string, http_status int, error_type string")
    ids = spark.createDataFrame([(x,) for x in "abcdef"], "item_id string")
    out = ledger.covered_recovery(ids, m, m.filter("item_id in ('a', 'c', 'd')"), m.filter("item_id in ('b', 'd')"), "item_id")
    assert {r.item_id: (r.outcome, r.problem) for r in out.collect()} == {
        "a": ("accepted", None), "b": ("error", None), "c": ("accepted", "several attempts"), "d": ("accepted", "prediction and error"), "e": ("error", "no attempt"), "f": ("error", "no attempt"), "x": ("error", "not selected"),
    }


def test_members_by_the_reader():
    """The fast reader gives what the stack gives, in any order, and deeper texts go to the stack."""
    from collections import Counter

    texts = ['{"a":[0,{"b":"x","a":null}],"c":1.50,"d":true,"e":{}}', '{"a":NaN}', '{"a":-Infinity}', '{"a":01}', '{"a":1}x', ' [1, {"x":"\\ud800"}] ', "7", "", '{"a":"\t"}',
             '{"a":1,}', '\ufeff{"a":1}', '{"a":1e5,"a":-0,"b":false}', '{"a":' * 50_000 + "1" + "}" * 50_000, "[" * 100_000, '{"n":' + "9" * 6000 + "}", '{"a":1}\u00a0', "{'a':1}"]
    for text in texts:
        assert Counter(packets.members_of(text)) == Counter(packets.members(text)), text[:40]
    assert packets.members_of(texts[0])
