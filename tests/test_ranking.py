"""Global ranks, and the intervals of ``random.choices``."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revaudit.operators import bootstrap, split, trajectory
from revaudit.operators.ranking import ranked


@pytest.mark.parametrize("partitions", [1, 50])
def test_rank_is_the_place_in_the_order(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "bb", "b", "c"]), rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, n int, i int").repartition(7)
    got = sorted(ranked(df, ["k", "n"], "place", partitions).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(1, 501))
    assert [(r.k, r.n) for r in got] == sorted([(k, n) for k, n, _ in rows], key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert sorted(r.i for r in got) == list(range(500)) and got[0].asDict().keys() == {"k", "n", "i", "place"}


def test_frequent_key_is_not_one_range(spark):
    df = spark.createDataFrame([("same", 1)] * 2000, "k string, v int").repartition(4)
    out = ranked(df, ["k"], "place", 8)
    assert sorted(r.place for r in out.collect()) == list(range(1, 2001))
    written = next(f for f in out.inputFiles() if "part-" in f).rpartition("/")[0]
    sizes = spark.read.parquet(written).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) < 1000


def test_empty(spark):
    assert ranked(spark.createDataFrame([], "k string"), ["k"]).count() == 0


def test_no_window_over_keys(spark):
    """The one window without partitions runs over the numbers of rows of the ranges."""
    df = spark.createDataFrame([(f"s{i}",) for i in range(30)], "source string")
    for out in (split.stable_split(df, "source"), trajectory.ordinals(df, ["source"], "id", "D_"), bootstrap.cluster_sums(df, "source", F.lit(1), F.lit(1))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in plan and plan.count("Window [") == 1 and "sum(_n" in plan


def brute(clusters: list[list[tuple[int, int]]], resamples: int, seed: int) -> tuple[float, float]:
    rng, values = random.Random(seed), []
    for _ in range(resamples):
        sample = [x for c in rng.choices(clusters, k=len(clusters)) for x in c]
        if den := sum(d for _, d in sample):
            values.append(100 * sum(n for n, _ in sample) / den)
    values.sort()

    def percentile(q):
        at = (len(values) - 1) * q
        low = int(at)
        return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)

    return percentile(0.025), percentile(0.975)


def test_draws_of_random_choices_to_the_last_bit(spark):
    rng = random.Random(5)
    data = {name: [[(rng.randint(-1, 1) if name == "c" else rng.randint(0, 1), 1) for _ in range(rng.randint(1, 4))] for _ in range(k)] for name, k in (("a", 37), ("b", 37), ("c", 52), ("d", 1))}
    sums = {}
    for name, clusters in data.items():
        rows = [(f"k{i:03d}", n, d) for i, c in enumerate(clusters) for n, d in c]
        rng.shuffle(rows)
        sums[name] = bootstrap.cluster_sums(spark.createDataFrame(rows, "k string, n int, d int").repartition(3), "k", F.col("n"), F.col("d"))
    got = {r.statistic: r for r in bootstrap.intervals(spark, sums, 430).collect()}
    for name, clusters in data.items():
        flat = [x for c in clusters for x in c]
        assert (got[name].low, got[name].high) == brute(clusters, 430, bootstrap.SEED)
        assert (got[name].clusters, got[name].percent) == (len(clusters), 100 * sum(n for n, _ in flat) / len(flat))


def test_states_of_blocks(spark):
    rng = random.Random(9)
    want = [rng.choices(range(13), k=13) for _ in range(23)]
    got = [d.tolist() for _, count, key, at in bootstrap.twister_states(9, 13, 23, 5) for d in bootstrap.twister_draws(13, count, key, at)]
    assert got == want


def test_no_clusters_and_no_denominator(spark):
    empty = spark.createDataFrame([], "k string, n int, d int")
    zero = spark.createDataFrame([("a", 1, 0), ("b", 2, 0), (None, 5, 5)], "k string, n int, d int")
    some = spark.createDataFrame([("a", 1, 0), ("b", 1, 2)], "k string, n int, d int")
    sums = {name: bootstrap.cluster_sums(df, "k", F.col("n"), F.col("d")) for name, df in (("empty", empty), ("zero", zero), ("some", some))}
    got = {r.statistic: r for r in bootstrap.intervals(spark, sums, 60).collect()}
    assert (got["empty"].clusters, got["empty"].percent, got["empty"].low) == (0, None, None)
    assert (got["zero"].clusters, got["zero"].percent, got["zero"].high) == (2, None, None)
    assert (got["some"].low, got["some"].high) == brute([[(1, 0)], [(1, 2)]], 60, bootstrap.SEED)


def test_too_many_clusters_are_refused(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "MAX_CLUSTERS", 1)
    df = spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int")
    with pytest.raises(ValueError, match="2 clusters"):
        bootstrap.intervals(spark, {"x": bootstrap.cluster_sums(df, "k", F.col("n"), F.col("n"))}, 10)


def test_hashed_draws_are_those_of_the_sql(spark):
    import hashlib

    want = [int(hashlib.sha256(f"7|3|{j}".encode()).hexdigest()[:8], 16) % 11 for j in range(11)]
    assert next(bootstrap.hashed_draws(7, 11, 3, 1)).tolist() == want
    assert np.array_equal(next(bootstrap.hashed_draws(7, 11, 3, 1)), want)
