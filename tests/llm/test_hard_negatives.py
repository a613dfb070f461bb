import numpy as np
import pytest

from revaudit.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<double>, label int, a string, id int, grp int"


def rows(n=700, seed=4, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    out = []
    for i in range(n):
        c = int(rng.integers(6)) if i % 3 else 0  # a third of the rows in one crowd
        x = centres[c] + 0.6 * rng.standard_normal(dim)
        out.append((i, (x / np.linalg.norm(x)).tolist(), c if rng.random() < 0.7 else int(rng.integers(10))))
    out += [out[50], out[50], out[51], (100, out[7][1], 3), (None, out[9][1], 2), (None, out[9][1], 2), (None, None, 1)]
    out += [(7000, None, 1), (7050, [0.1] * dim, None), (7100, [0.1] * (dim - 1) + [None], 2), (7150, [float("nan")] * dim, 2), (7200, [float("-inf")] * dim, 2)]
    out += [(8000 + 10 * k, [0.5, 0.1 * k], k % 2) for k in range(20)] + [(9000, [], 1), (9050, [], 2), (9100, [0.0] * dim, 4), (9101, [0.0] * dim, 4), (9150, [0.3, 0.2, 0.1], 5)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, x, n, "a", 1, 2) for i, x, n in data], SCHEMA).repartition(4)


def result(df):
    got = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(set(got)) == len(got)
    return set(got)


@pytest.mark.parametrize("options", [{}, {"groups": 4, "blocks": (3, 60)}, {"sample": 20, "groups": 3}])
def test_equals_all_pairs(spark, options):
    assert result(h.hard_negatives(frame(spark, rows()), **options)) == h.brute_force(rows())


def test_tied_scores(spark):
    data = [(i, [1.0, 0.0], i % 2) for i in range(120)] + [(200 + i, [0.6, 0.0], i % 3) for i in range(90)]
    assert result(h.hard_negatives(frame(spark, data), blocks=(2, 25))) == h.brute_force(data)


def test_empty_and_no_anchor(spark):
    assert h.hard_negatives(frame(spark, [])).count() == 0
    assert h.hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0


def test_large_components_are_exact_or_refused(spark):
    data = [(50 * i, [float(2**17 + i), 1.0], i % 2) for i in range(8)] + [(3 + i, [float(2**17) * 0.8 + i / 8, 1.0], i % 2) for i in range(8)]
    assert result(h.hard_negatives(frame(spark, data), scale=2**12)) == h.brute_force(data, scale=2**12)
    with pytest.raises(Exception, match="64 bits"):
        h.hard_negatives(frame(spark, [(50, [1e30], 1)])).count()


def test_candidates_go_only_where_they_may_serve(spark):
    """Distant clusters: candidates reach the groups that need them, not all groups, and nothing is lost."""
    rng = np.random.default_rng(1)
    data = [(i, (40 * np.eye(8)[i % 8] + 0.2 * rng.standard_normal(8)).tolist(), i % 16 % 3) for i in range(800)]
    seen = []
    join = h.knn_join

    def spy(anchors, candidates, space, best, blocks):
        need = h.needs(anchors, space)
        inside = candidates.withColumnRenamed("far", "f").join(need, [c for c in ("grp", "dim", "cell") if c in candidates.columns]).filter("f >= near and f <= far")
        seen.append((inside.count(), candidates.count()))
        return join(anchors, candidates, space, best, blocks)

    h.knn_join = spy
    try:
        got = result(h.hard_negatives(frame(spark, data), groups=8))
    finally:
        h.knn_join = join
    assert got == h.brute_force(data)
    assert seen[1][0] < 3 * seen[1][1], "of 8 groups a candidate serves a few"
