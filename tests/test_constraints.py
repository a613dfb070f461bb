"""Constraint suites, numbered lines and digests by pieces."""

import hashlib
import json

import pytest

from revaudit.operators import constraints
from revaudit.operators.constraints import Constraint
from revaudit.plans.registry import QUERIES
from revaudit.sources import readers

from .conftest import SF


def run(tables, *wanted, keys=None):
    out = constraints.check(tables, list(wanted), keys or {t: ["id"] for t in tables}).collect()
    assert [r.constraint for r in out] and len(out) == len(wanted)
    return {r.constraint: (r.passed, r.actual, r.sample) for r in out}


def test_each_kind_holds_and_fails(spark):
    a = spark.createDataFrame([(1, "x", ["u", "v"], 3), (2, "y", ["v"], None), (2, None, [], 5), (None, "x", None, 7), (None, "z", ["w", None], 9)], "id int, k string, m array<string>, n int")
    b = spark.createDataFrame([(1,), (2,), (2,), (8,)], "id int")
    got = run(
        {"a": a, "b": b},
        Constraint("u1", "a", "unique", ("id",)), Constraint("u2", "a", "unique", ("id", "k")), Constraint("u3", "b", "unique", ("id",)),
        Constraint("h", "a", "holds", condition="n > 3"), Constraint("h2", "a", "holds", condition="coalesce(n, 9) > 2"),
        Constraint("d", "a", "domain", ("k",), values=("x", "y")), Constraint("d2", "a", "domain", ("m",), values=("u", "v", "w")),
        Constraint("e", "a", "excludes", ("m",), values=("u", "w")), Constraint("e2", "a", "excludes", ("k",), values=("q",)),
        Constraint("r", "a", "rows", condition="k = 'x'", count=2), Constraint("r2", "a", "rows", count=4),
        Constraint("f", "a", "references", ("id",), other="b"), Constraint("f2", "b", "references", ("id",), other="a"), Constraint("c", "a", "covers", ("id",), other="b"),
        Constraint("l", "a", "lacks", ("k", "q")), Constraint("l2", "a", "lacks", ("q",)),
    )
    assert got == {
        "u1": (False, 2, ['["2"]', "[null]"]), "u2": (True, 0, []), "u3": (False, 1, ['["2"]']),
        "h": (False, 2, ['["1"]', '["2"]']), "h2": (True, 0, []),
        "d": (False, 2, ['["2"]', "[null]"]), "d2": (False, 2, ["[null]"]),
        "e": (False, 2, ['["1"]', "[null]"]), "e2": (True, 0, []),
        "r": (True, 2, []), "r2": (False, 5, []),
        "f": (True, 0, []), "f2": (False, 1, ['["8"]']), "c": (False, 1, ['["8"]']),
        "l": (False, 1, ["k"]), "l2": (True, 0, []),
    }


def test_many_violations_of_one_key_and_empty_table(spark):
    a = spark.range(1000).selectExpr("cast(7 as int) id", "id v").repartition(8)
    got = run({"a": a}, Constraint("u", "a", "unique", ("id",)), Constraint("h", "a", "holds", condition="v < 0"), keys={"a": ["v"]})
    assert got == {"u": (False, 999, ['["7"]']), "h": (False, 1000, ['["0"]', '["1"]', '["10"]'])}
    empty = spark.createDataFrame([], "id int")
    assert run({"a": empty}, Constraint("u", "a", "unique", ("id",)), Constraint("r", "a", "rows", count=0), Constraint("c", "a", "covers", ("id",), other="a")) == {x: (True, 0, []) for x in "urc"}


def test_packages(spark):
    got = {r.constraint: (r.passed, r.sample) for r in QUERIES["package_integrity"](spark, SF).collect()}
    assert got == {
        "A01 is A02": (True, []), "A01 is A03": (False, ["A01/packets", "A03/packets"]), "A01 is A04": (False, ["A01/packets", "A04/packets"]),
        "files of A01": (True, []), "files of A02": (False, ["rubric"]),
    }


def test_line_numbers_over_many_ranges(spark, tmp_path):
    """Files of lines of all lengths, read in ranges of 64 bytes."""
    want = set()
    for f in range(3):
        lines = ["" if i % 7 == 0 else json.dumps({"i": i}) if i % 5 else f"bad {'x' * (i % 130)} {i}" for i in range(400 + f)]
        (tmp_path / f"{f}.jsonl").write_text("\n".join(lines) + ("\n" if f else ""))
        want |= {(f"{f}.jsonl", i + 1, x) for i, x in enumerate(lines)}
    (tmp_path / "empty.jsonl").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        lines = readers.numbered_lines(spark, str(tmp_path))
        got = {(r.file.rpartition("/")[2], r.line_number, r.line) for r in lines.collect()}
        bad = {(r.file.rpartition("/")[2], r.line_number, r.line) for r in readers.bad_lines(spark, str(tmp_path)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    whole = {x for x in want if x[0] != "0.jsonl" or x[1] < 401}
    assert {x for x in got if x[2]} == {x for x in whole if x[2]} and got <= want
    assert bad == {x for x in want if x[2].startswith("bad")}


@pytest.mark.parametrize("size", [0, 1, (1 << 20) - 1, (1 << 20) + 1])
def test_digest_by_pieces(spark, tmp_path, size):
    folder = tmp_path / "a folder"
    (folder / "b").mkdir(parents=True)
    data = bytes(i * 7 % 251 for i in range(size))
    (folder / "b" / "x.bin").write_bytes(data)
    got = readers.file_hashes(spark, str(tmp_path)).collect()
    assert [(r.path, r.sha256, r.bytes) for r in got] == [("a folder/b/x.bin", hashlib.sha256(data).hexdigest(), size)]


def test_digest_of_a_file_larger_than_a_row(spark, tmp_path):
    """A row of Spark holds 2 GB at most."""
    size = (1 << 31) + 5
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)  # takes no disk
    digest, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        digest.update(zeros)
    digest.update(bytes(size & (1 << 20) - 1))
    [got] = readers.file_hashes(spark, str(tmp_path)).collect()
    assert (got.sha256, got.bytes) == (digest.hexdigest(), size)
