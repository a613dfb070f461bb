import math
from collections import Counter

import numpy as np
import pytest

from revaudit.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<float>, label int, c string, x int, t int"


def near(rng, x, cosine):
    """A vector at that cosine from x."""
    y = rng.standard_normal(len(x))
    u = x / np.linalg.norm(x)
    y -= (y @ u) * u
    return cosine * u + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(16) for _ in range(60)]
    for k in range(12):  # chains and groups of copies about the threshold
        x = out[k]
        for c in (0.999, 0.97, 0.9502, 0.9498, 0.94):
            out.append(near(rng, x, c))
            x = out[-1] if k % 2 else x
    out += [out[0]] * 5 + [out[0] * 3, out[1] * 1e-30, out[2] * 1e30, -out[3], out[4][:8], out[4][:8] * 2]
    return [x.tolist() for x in out]


def rows():
    out = [(i, np.float32(x).tolist()) for i, x in enumerate(vectors())]
    out += [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [None]), (904, [1.0] * 15 + [float("nan")]), (905, [float("inf")] + [1.0] * 15)]
    out += [out[5], out[5], (None, out[6][1]), (None, [5.0] * 16), (None, None), (3, out[7][1]), (902, [0.0] * 16)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(k, x, None, "c", 1, 2) for k, x in data], SCHEMA).repartition(3)


def result(df):
    return Counter(tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


def test_equals_all_pairs(spark):
    data = rows()
    got, want = result(e.near_vectors(frame(spark, data))), Counter(e.brute_force(data))
    assert got == want, (list((got - want).items())[:5], list((want - got).items())[:5])


def test_buckets_in_blocks(spark, monkeypatch):
    """One bucket of many classes, dealt into blocks: every link is found and counted once."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal(16)
    data = [(i, near(rng, x, 0.96 + 0.04 * (i % 5) / 5).tolist()) for i in range(150)] + [(1000 + i, rng.standard_normal(16).tolist()) for i in range(50)]
    data = [(k, np.float32(v).tolist()) for k, v in data]
    monkeypatch.setattr(e, "BLOCK", 7)
    monkeypatch.setattr(e, "HELD", 5)
    assert result(e.near_vectors(frame(spark, data))) == Counter(e.brute_force(data))


def test_no_link_and_empty(spark):
    assert e.near_vectors(frame(spark, [])).count() == 0
    data = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)]
    assert result(e.near_vectors(frame(spark, data))) == Counter(e.brute_force(data)) == Counter({(1, 0, 1, True): 1, (2, 0, 2, True): 1, (3, 0, 3, True): 1})


@pytest.mark.parametrize("n", [500, 10_000, 1_000_000, 10**9])
def test_chance_of_a_miss(n):
    t = e.Tables(n, 0.95, 1)
    assert (1 - (1 - math.acos(0.95) / math.pi) ** t.bits) ** t.tables <= e.MISSED
    assert t.bits >= math.log2(n) - 1e-9


def test_recall_at_the_threshold():
    """Pairs right above it: the share of those that share a code in some table."""
    rng = np.random.default_rng(9)
    t = e.Tables(2_000, 0.95, 7)
    a = rng.standard_normal((2_000, 64))
    b = np.stack([near(rng, x, 0.951) for x in a])
    assert (t.codes(e.unit(a)) == t.codes(e.unit(b))).any(axis=1).mean() > 0.99
