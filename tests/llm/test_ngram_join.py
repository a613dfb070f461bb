import random

import numpy as np
import pytest

from revaudit.llm import ngram_join

from .fixtures import empty, frame, rows


def cluster(n: int, seed: int):
    """A chain of near copies, each some edits from one before it, besides unrelated texts and shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = [rng.choices(words, k=120)]
    for _ in range(n):
        t = list(rng.choice(texts[-8:] if rng.random() < 0.5 else texts))
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(t)
    passage = rng.choices(words, k=14)
    texts += [passage + rng.choices(words, k=rng.randint(0, 30)) for _ in range(n)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [24, 2])
@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_chain_of_near_copies(spark, monkeypatch, small, n, percent):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", small)
    data = cluster(70, n)
    out = ngram_join.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(3), n=n, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == ngram_join.brute_force(data, n, percent)


def test_awkward_rows(spark):
    out = ngram_join.near_duplicates(frame(spark)).collect()
    assert len(out) == len(rows())
    keyed = {r[0]: r[1] for r in rows() if r[0] is not None and r[0] != 5}
    want = ngram_join.brute_force(list(keyed.items()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id in want}
    assert got == want
    lone = [r for r in out if r.doc_id is None]
    assert len(lone) == 2 and {r.n_shingles for r in lone} == {0, want[13][0]}
    assert next(r for r in lone if r.n_shingles).component_id == want[13][1]
    assert ngram_join.near_duplicates(empty(spark)).count() == 0


def test_signatures_of_similar_sets_meet():
    rng, g = np.random.default_rng(1), ngram_join.Groups(85)
    for size in [6, 7, 10, 13, 14, 40, 200, 1000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            drop = rng.integers(0, int(0.15 * size) + 1)
            b = a[: len(a) - drop]
            if 100 * len(b) >= 85 * len(a) and len(b) < len(a):
                assert set(np.concatenate(g.signatures(a)[0])) & set(np.concatenate(g.signatures(b)[0]))


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = {r.v: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


@pytest.mark.parametrize("small", [10**6, 24, 3])
@pytest.mark.parametrize("percent", [80, 85])
def test_short_texts(spark, monkeypatch, small, percent):
    """Pairs of sets of 5 to 20 shingles, whose empty parts differ in number."""
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", small)
    rng, data = random.Random(percent), []
    for i in range(900):
        a = [f"w{i}x{j}" for j in range(rng.randint(5, 20))]
        b = list(a)
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.5:
                b[rng.randrange(len(b))] = f"v{rng.randint(0, 10**9)}"
            else:
                b.pop()
        data += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    data += [(5000 + i, " ".join(["p q r s t u v x y z"[: 2 * k - 1], f"o{i}"])) for i, k in enumerate(rng.choices(range(4, 11), k=120))]
    out = ngram_join.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(2), n=1, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == ngram_join.brute_force(data, 1, percent)


def test_same_address(spark):
    """Different classes with the same address get names of their own, all others keep theirs."""
    rows = [(1, 5, 7), (2, 5, 8), (3, 6, 7), (4, None, None), (5, 5, 7)]
    clashes = spark.createDataFrame([(5, 7, True), (5, 8, True)], "c long, c2 long, clash boolean")
    out = {r.d: r.c for r in ngram_join.renamed(spark.createDataFrame(rows, "d int, c long, c2 long"), clashes).collect()}
    assert out[3] == 6 and out[4] is None and out[1] == out[5] != out[2] and 5 not in (out[1], out[2])


def test_similar_sets_share_parts():
    """Sets that differ in up to k elements share signatures of more parts than m, if none is passed over."""
    import numpy as np

    rng, groups = np.random.default_rng(2), ngram_join.Groups(85)
    for n in (20, 60, 200, 700):
        k = groups.k[groups.of(n)[0]] * n // groups.high[groups.of(n)[0]]  # elements that sets of this size may differ in
        x = np.unique(rng.integers(0, 1 << 63, n + k // 2, dtype=np.uint64))
        a, b = x[k // 2 :], x[: len(x) - (k - k // 2)]
        g = max(set(groups.of(len(a))) & set(groups.of(len(b))))
        own = [{int(s) for sig in groups.signatures(y)[0] for s in sig if int(s) & 63 == g} for y in (a, b)]
        shared = {s >> 6 & 0xFFFF for s in own[0] & own[1]}
        rooms = [spare[spare[::3].index(g) * 3 + 1] for spare in (groups.signatures(y)[1] for y in (a, b))]
        assert k < 2 or len(set(a) ^ set(b)) in (k - 1, k)
        assert len(shared) > min(rooms), (n, len(shared), rooms)


def test_shingles_of_many_texts_at_once():
    """Words of a batch are hashed as one array; no n-gram crosses from a text into the next one."""
    texts = [b"a b c d e", None, b"", b"A b", b"a b c d", b" \t ", b"b", b"a b c d a b c d a b c d", b"x y z w"]
    alone = [ngram_join.shingles([t], 4)[0] for t in texts]
    together = ngram_join.shingles(texts, 4)
    assert [x.tolist() for x in alone] == [x.tolist() for x in together]
    assert list(map(len, together)) == [2, 0, 0, 1, 1, 0, 1, 4, 1] and set(together[4]) < set(together[0])
    groups = ngram_join.Groups(85)
    x = ngram_join.shingles([b" ".join(b"w%d" % i for i in range(300))], 4)[0]
    assert groups.signatures(x, False) == ([], groups.signatures(x)[1])
