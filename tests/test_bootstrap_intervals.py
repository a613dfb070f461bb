"""The intervals of 10,000 resamples, against brute force on a few orders."""

import hashlib
import random

import numpy as np
import pytest

from revaudit.plans import roles
from revaudit.plans.registry import QUERIES


def interval(items: list[tuple[str, int]]) -> tuple:
    """Of (cluster, value): clusters, mean in percent, and its percentile interval, resample by resample."""
    names = sorted({c for c, _ in items})
    values = [[v for c, v in items if c == name] for name in names]
    means = []
    for rep in range(10_000):
        pick = [int(hashlib.sha256(f"20260929|{rep}|{i}".encode()).hexdigest()[:8], 16) % len(names) for i in range(len(names))]
        sample = [v for i in pick for v in values[i]]
        means.append(100 * sum(sample) / len(sample))
    return len(names), 100 * sum(v for _, v in items) / len(items), *np.percentile(means, [2.5, 97.5])


def test_intervals(spark, tmp_path):
    rng = random.Random(2)
    orders = [(i, rng.choice([1, 101, 2, 102, 3, 203, 304]), rng.choice("FOP"), rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])) for i in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    rows = roles.claims(spark, str(tmp_path)).collect()
    act = {(r.claim_id, r.method): r for r in rows if r.status == "success" and not r.abstain}
    right = lambda r: int(r.predicted_label == r.gold_label)
    pairs = [(act[k, "B"], act[k, "C"]) for k in range(60) if (k, "B") in act and (k, "C") in act]
    got = {(r.statistic, r.cluster): r for r in QUERIES["cluster_bootstrap_intervals"](spark, str(tmp_path)).collect()}
    assert len(got) == 4
    for cluster in ("trajectory_id", "participant_id_hash"):
        want = {"right": [(r[cluster], right(r) * (not r.abstain)) for r in rows], "c_minus_b": [(b[cluster], right(c) - right(b)) for b, c in pairs]}
        for name, items in want.items():
            r = got[name, cluster]
            assert (r.clusters, r.percent, r.low, r.high) == pytest.approx(interval(items))
    forty = QUERIES["cluster_bootstrap"](spark, str(tmp_path)).first()
    r = got["right", "trajectory_id"]
    assert (forty.low, forty.high) != (r.low, r.high)


def test_hashes_of_many_messages_at_once():
    """The words are those of hashlib, and one resample's are made once for all sizes."""
    from revaudit.operators import bootstrap

    for r, k in ((0, 1), (7, 10), (9999, 12_345), (42, 10_000), (3, 20_001)):
        got = np.concatenate(list(bootstrap.hashed_words(20260929, r, k)))
        assert got.tolist() == [int.from_bytes(hashlib.sha256(f"20260929|{r}|{j}".encode()).digest()[:4], "big") for j in range(k)]


def test_hashes_take_long_pieces_and_blocks_are_dealt_evenly(spark, monkeypatch):
    """A step of the hash is one over up to 100,000 messages, and no task gets more than its share of the blocks."""
    from revaudit.operators import bootstrap

    pieces = [len(w) for w in bootstrap.hashed_words(20260929, 42, 250_000)]
    assert len(pieces) <= 7 and sum(pieces) == 250_000
    got = np.concatenate(list(bootstrap.hashed_words(20260929, 42, 250_000)))
    for j in (0, 9, 99_999, 100_000, 123_456, 249_999):
        assert got[j] == int.from_bytes(hashlib.sha256(f"20260929|42|{j}".encode()).digest()[:4], "big")
    seen, real = [], type(spark).createDataFrame

    def watched(self, data, schema=None, **more):
        out = real(self, data, schema, **more)
        if schema and "position" in schema:
            seen.extend(len(part) for part in data.glom().collect())
        return out

    monkeypatch.setattr(type(spark), "createDataFrame", watched)
    sums = spark.createDataFrame([(i, i % 2, 1) for i in range(9)], "i long, num long, den long")
    bootstrap.intervals(spark, {"x": sums}, 3200, hashed=True).collect()
    assert sum(seen) == 64 and max(seen) <= 2


def test_draws_are_shared(spark, monkeypatch):
    """The generator steps once over the draws of all sizes, and sums told by codes are those told by clusters."""
    from revaudit.operators import bootstrap

    sizes = [7, 40_000, 33_000]
    states = bootstrap.shared_states(5, sizes, 4, 2)
    assert len(states) == 6
    for k, first, count, key, position in states:
        rng = random.Random(5)
        rng.choices(range(k), k=k * first)
        for pieces in bootstrap.twister_pieces(k, count, key, position):
            assert np.concatenate(list(pieces)).tolist() == rng.choices(range(k), k=k)
    table = np.array([[i % 5 - 1, i % 3 + 1] for i in range(1000)], float)
    codes, values = bootstrap.coded(table)
    assert codes.dtype == np.uint16 and (values[codes] == table).all()
    assert bootstrap.coded(table + 0.5)[0] is None and bootstrap.coded(table * 1e6)[0] is None
    sums = {n: spark.createDataFrame([(i, i % 4, 1 + i % 2) for i in range(k)], "i long, num long, den long") for n, k in (("x", 30), ("y", 50), ("z", 0))}
    for hashed in (False, True):
        monkeypatch.setattr(bootstrap, "MAX_CODES", 1 << 16)
        a = sorted(map(tuple, bootstrap.intervals(spark, sums, 60, hashed=hashed).collect()))
        monkeypatch.setattr(bootstrap, "MAX_CODES", 0)
        assert sorted(map(tuple, bootstrap.intervals(spark, sums, 60, hashed=hashed).collect())) == a
        assert [r[:2] for r in a] == [("x", 30), ("y", 50), ("z", 0)] and None not in a[0]
