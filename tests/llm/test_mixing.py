from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from revaudit.llm import mixing
from revaudit.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SF, same
from .fixtures import empty, frame, rows


def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


def test_oracle(spark, duck):
    same(QUERIES["op7_mix"](spark, SF), duck.sql(ORACLE_SQL["op7_mix"]))


def fill(budget: int, nodes: list[tuple[int, int]]) -> list[int]:
    """Water filling, one short node after the other: the shares of (supply, weight)."""
    got, left, rest = [0] * len(nodes), budget, list(range(len(nodes)))
    while rest:
        total = sum(nodes[i][1] for i in rest)
        short = [i for i in rest if nodes[i][0] * total <= left * nodes[i][1]]
        if not short:
            for i in rest:
                got[i] = left * nodes[i][1] // total
            break
        for i in short:
            got[i], left = nodes[i][0], left - nodes[i][0]
        rest = [i for i in rest if i not in short]
    return got


@pytest.mark.parametrize("budget", [0, 10, 55, 100, 1000])
def test_share(spark, budget):
    nodes = [(40, 1), (5, 3), (30, 2), (7, 1), (0, 1)]
    df = spark.createDataFrame([("p", str(i), s, w, budget) for i, (s, w) in enumerate(nodes)], "p string, name string, supply long, weight long, budget long")
    assert [r.got for r in mixing.share(df, ["p"], "name", "budget").orderBy("name").collect()] == fill(budget, nodes)


@pytest.mark.parametrize("percent,epochs", [(100, 2), (60, 1), (150, 3), (0, 1)])
def test_budgets_hold(spark, percent, epochs):
    out = mixing.mix(frame(spark), levels(), {"lang": {"en": 3}, "source": {"src0": 2}}, percent, epochs).collect()
    total = sum(len((r[1] or "").encode().split()) for r in rows())
    assert sum(r.mix_tokens for r in out) <= total * percent // 100
    taken = defaultdict(set)
    for r in out:
        taken[r.doc_id, r.text].add(r.mix_epoch)
    assert all(sorted(e) == list(range(len(e))) and len(e) <= epochs for e in taken.values())
    if percent >= 100 * epochs:
        assert len(out) == epochs * len(rows())


def test_empty(spark):
    assert mixing.mix(empty(spark), levels(), {}).count() == 0


def test_zero_weights(spark):
    """A source of weight 0 gives nothing, and what it has does not count as supply."""
    rows = [(i, "a b c d e", "src0" if i % 2 else "src1", 7) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_tokens int")
    out = mixing.mix(df, {"source": F.col("source")}, {"source": {"src0": 0}}, budget_percent=50, epochs=1)
    assert out.columns == ["doc_id", "text", "source", "mix_source", "mix_tokens", "mix_epoch"]
    got = out.collect()
    assert {r.source for r in got} == {"src1"} and sum(r.mix_tokens for r in got) == 500
