"""Hidden values in prompts, recovery in its order, and unresolved intents as a stream."""

import random


from revaudit.operators import containment, ledger
from revaudit.streaming import append_log


def test_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ab é😀\n.*") for _ in range(rng.randint(1, 30)))
    texts = [word() + word() * rng.randint(0, 3) for _ in range(120)] + [None, "", "a", "secret of mine"] * 2
    values = [word() for _ in range(80)] + [t[2 : 2 + rng.randint(1, 25)] for t in texts if t and len(t) > 3] + [None, "", "secret of mine", "secret of mine", "never there at all"]
    prompts = spark.createDataFrame(list(enumerate(texts)), "p long, text string").repartition(3)
    hidden = spark.createDataFrame(list(enumerate(values)), "h long, value string").repartition(3)
    got = sorted(tuple(r) for r in containment.contained(prompts, "p", "text", hidden, "h", "value").collect())
    assert got == sorted((p, h) for p, t in enumerate(texts) for h, v in enumerate(values) if t is not None and v and v in t)
    assert containment.contained(prompts, "p", "text", hidden.filter("value is null"), "h", "value").count() == 0


def test_no_nested_loop(spark):
    prompts, hidden = spark.createDataFrame([(1, "abc def ghi jkl")], "p int, text string"), spark.createDataFrame([(1, "def ghi jkl")], "h int, value string")
    plan = containment.contained(prompts, "p", "text", hidden, "h", "value")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_recovery_keeps_positions_and_names_differences(spark):
    first = spark.createDataFrame([("d", 4, 429, "p", "m"), ("a", 9, 429, "p", "m"), ("b", 7, 429, None, "m"), ("c", 1, 200, "p", "m"), ("e", 11, 429, "p", "m")], "item string, at long, http_status int, evidence string, model string")
    rerun = spark.createDataFrame([("d", 1, "p", "accepted", 200, "m"), ("b", 3, None, "accepted", 200, "m"), ("a", 2, "q", "error", 500, "n"), ("a", 5, "q", "accepted", 200, "n"), ("c", 4, "p", "accepted", 200, "m")], "item string, sequence long, evidence string, outcome string, http_status int, model string")
    book, wrong = ledger.recovery_differences(first, rerun, "item", "at", "sequence", ["evidence"], {"model": "m"})
    assert [tuple(r) for r in book.collect()] == [(4, "d", 1, 1, "accepted", 200), (7, "b", 2, 1, "accepted", 200), (9, "a", 3, 2, "error", 500), (11, "e", 4, 0, "missing", None)]
    assert sorted(tuple(r) for r in wrong.collect() if r.at is not None) == [
        ("a", 9, "attempts", "1", "2"), ("a", 9, "evidence", "p", "q"), ("a", 9, "model", "m", "n"), ("a", 9, "sequence", "3", "2"),
        ("b", 7, "sequence", "2", "3"), ("e", 11, "attempts", "1", "0"),
    ]
    assert [tuple(r) for r in wrong.filter("at is null").collect()] == [("c", None, "selected", "false", "true")]


def test_intents_over_micro_batches_with_restarts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out: list[tuple] = []

    def run(number, *events):
        rows = "".join(f'{{"item":{"null" if k is None else chr(34) + k + chr(34)},"at":"2026-01-01T{t}:00Z","done":{str(end).lower()}}}\n' for k, t, end in events)
        (source / f"{number}.json").write_text(rows)
        stream = spark.readStream.schema("item string, at timestamp, done boolean").json(str(source))
        found = append_log.unresolved_intents(stream, "item", "at", "done", "1 hour")
        keep = lambda df, _: out.extend((r.item, r.status, r.attempted_at and f"{r.attempted_at:%H:%M}", r.resolved_at and f"{r.resolved_at:%H:%M}") for r in df.collect())
        found.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = sorted(out)
        out.clear()
        return got

    assert run(1, ("a", "00:00", False), ("a", "00:10", True), ("b", "00:05", False), ("c", "00:20", True), (None, "00:01", False)) == [("a", "resolved", "00:00", "00:10")]
    assert run(2, ("c", "00:15", False), ("d", "02:30", False)) == [("b", "unresolved", "00:05", None), ("c", "resolved", "00:15", "00:20")]
    assert run(3, ("b", "02:00", True)) == [("b", "late", "00:05", "02:00")]
    assert run(4, ("e", "09:00", False)) == [("d", "unresolved", "02:30", None)]
