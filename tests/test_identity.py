"""Ordered identity by a tree of hashes, batches appended once, and reuse of freezes."""

import random

import pytest
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from revaudit.operators import freeze, identity
from revaudit.sources import readers, sinks

SCHEMA = StructType([StructField("i", IntegerType()), StructField("t", StringType())])


def difference(spark, a, b, fan=4):
    made = [identity.leaves(spark.createDataFrame(list(enumerate(x)), "i int, line string").repartition(3), "line", ["i"]) for x in (a, b)]
    return identity.ordered_difference(*made, fan).first()


def test_first_difference_is_found(spark):
    rng = random.Random(3)
    base = [rng.choice(["a", "b", None, f"line {i}"]) for i in range(83)]
    for what in range(7):
        other = list(base)
        i = rng.randrange(80)
        if what == 0:
            other[i] = "changed"
        elif what == 1:
            other[i], other[i + 2] = "x", "y"
        elif what == 2:
            j = next(j for j in range(i, 82) if base[j] != base[j + 1])
            other[j], other[j + 1] = other[j + 1], other[j]
        elif what == 3:
            other = other[:60]
        elif what == 4:
            other += ["more"] * 300
        elif what == 5:
            other = []
        r = difference(spark, base, other)
        want = next((k + 1 for k, (x, y) in enumerate(zip(base, other)) if x != y), None if len(base) == len(other) else min(len(base), len(other)) + 1)
        assert (r.identical, r.rows_a, r.rows_b, r.first_difference) == (want is None, 83, len(other), want), what
        assert (r.root_a == r.root_b) == (want is None)


def test_root_knows_the_length_and_empty_tables(spark):
    assert difference(spark, [], []).identical and difference(spark, [], []).root_a is None
    assert difference(spark, ["a"], ["a"]).identical
    r = difference(spark, ["a"], ["a", "a", "a", "a", "a"])
    assert (r.identical, r.first_difference) == (False, 2)


def test_batch_twice_and_dead_before_its_marker(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *x: spark.createDataFrame(x, SCHEMA)
    read = lambda: sorted((r.i, r.t, r.batch) for r in readers.read_batches(spark, path, SCHEMA).collect())
    assert read() == []
    assert sinks.append_batch(rows((1, "a"), (2, None)), path, "b1")
    assert not sinks.append_batch(rows((9, "again")), path, "b1")
    sinks.write_canonical(rows((5, "died")), f"{path}/b2-first-try")  # before its marker
    assert read() == [(1, "a", "b1"), (2, None, "b1")]
    assert sinks.append_batch(rows((3, "c")), path, "b2")
    assert not sinks.commit_batch(spark, path, "b2", "b2-first-try")  # the slower of two tries
    assert sinks.append_batch(rows(), path, "b3")
    assert read() == [(1, "a", "b1"), (2, None, "b1"), (3, "c", "b2")]
    with pytest.raises(ValueError):
        sinks.append_batch(rows(), path, "../b")


def test_stream_replays_a_batch_once(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "log")
    source.mkdir()
    (source / "1.json").write_text('{"i":1,"t":"a"}\n{"i":2,"t":"b"}\n')
    write = sinks.batch_writer(path, "q")

    def dies(df, number):
        write(df, number)
        raise RuntimeError("after the marker, before the checkpoint")

    stream = lambda fn: spark.readStream.schema(SCHEMA).json(str(source)).writeStream.foreachBatch(fn).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="after the marker"):
        stream(dies).awaitTermination()
    stream(write).awaitTermination()
    (source / "2.json").write_text('{"i":3,"t":"c"}\n')
    stream(write).awaitTermination()
    assert sorted((r.i, r.batch) for r in readers.read_batches(spark, path, SCHEMA).collect()) == [(1, "q-0"), (2, "q-0"), (3, "q-1")]


def test_freeze_outcomes(spark):
    stated = [("a", "input", "x", "1"), ("a", "output", "y", "2"), ("b", "input", "x", "1"), ("b", "output", "y", "2"), ("c", "input", "x", "1"), ("c", "output", "y", "2"), ("d", "output", "y", "2"), ("e", "output", "y", None), ("g", "input", "x", "1"), ("g", "output", "y", "2")]
    there = [("a", "input", "x", "1"), ("a", "output", "y", "2"), ("b", "input", "x", "9"), ("b", "output", "y", "2"), ("c", "input", "x", "9"), ("c", "output", "y", "9"), ("d", "output", "y", "2"), ("d", "output", "z", "3"), ("e", "output", "y", None), ("f", "input", "x", "1"), ("g", "output", "y", "2")]
    schema = "freeze string, role string, path string, sha256 string"
    got = {r.freeze: (r.decision, r.reason, r.problems) for r in freeze.freeze_decisions(spark.createDataFrame(stated, schema), spark.createDataFrame(there, schema)).collect()}
    assert got == {
        "a": ("reuse", None, 0), "b": ("rebuild", "input changed", 1), "c": ("refuse", "output changed", 2), "d": ("refuse", "unknown output", 1),
        "e": ("reuse", None, 0), "f": ("build", None, 0), "g": ("rebuild", "input missing", 1),
    }
