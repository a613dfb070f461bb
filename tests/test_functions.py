import difflib
import hashlib
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revaudit.functions import responses, signatures, text, udfs


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize("value,out", [(" GNU C++ ", "C++"), ("c", "C"), ("Rust", "Rust"), ("JAVA", "Java")])
def test_language(spark, value, out):
    assert one(spark, value, text.normalize_language("x")) == out


def test_hashes(spark):
    assert one(spark, None, text.sha256_text("x")) == hashlib.sha256(b"nan").hexdigest()
    assert one(spark, "a b c\x1cd\x85 e\n", text.normalize_code("x")) == "abcde"
    assert one(spark, "u1", text.composite_key("x", F.lit(3), length=20)) == hashlib.sha256(b"u1|3").hexdigest()[:20]


CLAIMS = [
    ("The loop starts at 1. Fix it.", "The loop starts at 1.", "diagnostic"),
    ("Check the bound. The loop is off by one, and no test covers it.", "The loop is off by one, and no test covers it.", "composite"),
    ("Check this: x is unset. More.", "Check this: x is unset.", "diagnostic"),
    ("  No end here", "No end here", "diagnostic"),
    ("", None, "none"),
    ("Value 3.5 is wrong! Really?", "Value 3.5 is wrong!", "diagnostic"),
    ("😀 is odd; and so on. x", "😀 is odd; and so on.", "composite"),
]


@pytest.mark.parametrize("hint,claim,kind", CLAIMS)
def test_focal_claim(spark, hint, claim, kind):
    c = one(spark, hint, text.focal_claim("x"))
    assert (c.text, c.kind) == (claim, kind)
    if claim:
        assert hint[c.start : c.end] == claim


@pytest.mark.parametrize("k,n", [(0, 0), (0, 5), (5, 5), (3, 10)])
def test_wilson(spark, k, n):
    low, high = text.wilson(F.lit(k), F.lit(n))
    r = spark.range(1).select(low.alias("low"), high.alias("high")).first()
    if n == 0:
        assert r.low is None and r.high is None
        return
    z, p = 1.959963984540054, k / n
    c, h = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    assert math.isclose(r.low, max(0, c - h), abs_tol=1e-12) and math.isclose(r.high, min(1, c + h), abs_tol=1e-12)


def test_as_bool_rejects(spark):
    assert one(spark, " TRUE", text.as_bool("x")) is True
    with pytest.raises(Exception, match="invalid boolean"):
        one(spark, "y", text.as_bool("x"))


SNIPPETS = [
    ("int main(){ printf(\"%d\", 1); }", "CONFIRMED_C"), ("#include <iostream>\nint x;", "NON_C_CPP"), ("public class A { }", "NON_C_JAVA"), ("import java.util.Scanner; std::x", "AMBIGUOUS"),
    ("// printf(\n/* std:: */ x", "AMBIGUOUS"), ('s = "std::cout"; malloc(3)', "CONFIRMED_C"), ("struct node { int x; };", "CONFIRMED_C"),
]


@pytest.mark.parametrize("code,status", SNIPPETS)
def test_signatures(spark, code, status):
    assert one(spark, code, signatures.classify_source("x", F.lit(""))).status == status


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("ab\n", max_size=12), st.text("ab\n", max_size=12)), min_size=1, max_size=6))
def test_line_diff(spark, rows):
    out = spark.createDataFrame(rows, "a string, b string").select(udfs.line_diff_counts("a", "b").alias("d")).collect()
    for (a, b), r in zip(rows, out):
        ops = difflib.SequenceMatcher(None, a.splitlines(), b.splitlines(), autojunk=False).get_opcodes()
        assert r.d.added - r.d.deleted == len(b.splitlines()) - len(a.splitlines())
        assert (r.d.added + r.d.deleted == 0) == all(o[0] == "equal" for o in ops)


@pytest.mark.parametrize("value,reason", [('["a"]', None), ('["a"] x', "malformed: JSONDecodeError"), ("{}", "expected list, found dict"), (None, "missing")])
def test_strict_json(spark, value, reason):
    assert one(spark, value, udfs.strict_json_list("x")).reason == reason


def test_packet_hash(spark):
    body = {"b": 1, "a": {"z": "é", "y": None}}
    sealed = dict(body, packet_sha256=hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest())
    r = one(spark, json.dumps(sealed), udfs.packet_hash("x"))
    assert r.stated == r.computed


def test_telemetry(spark):
    t = one(spark, '{"usage":{"prompt_tokens":1.5,"total_tokens":-1,"completion_tokens":7},"choices":[]}', responses.telemetry("x"))
    assert (t.prompt_tokens, t.total_tokens, t.completion_tokens, t.finish_reason) == (None, None, 7, None)
    assert one(spark, "oops", responses.telemetry("x")).total_tokens is None


def test_fence(spark):
    assert one(spark, "```json\n{}\n```", responses.strip_fence("x")) == "{}"
    assert one(spark, " {} ", responses.strip_fence("x")) == "{}"


def test_unified_diff(spark):
    rows = [("a\nb\nc\n", "a\nx\nc\n"), ("same\n", "same\n"), (None, "new"), ("a\nb", "a\nb\n")]
    got = [r.d for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(udfs.unified_diff("a", "b").alias("d")).collect()]
    assert got == ["--- S_t\n+++ S_t+1\n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c\n", "", "--- S_t\n+++ S_t+1\n@@ -0,0 +1 @@\n+new", "--- S_t\n+++ S_t+1\n@@ -1,2 +1,2 @@\n a\n-b+b\n"]
