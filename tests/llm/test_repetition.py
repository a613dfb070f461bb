import random

from revaudit.llm import repetition
from revaudit.llm.repetition import Limits, measure

from .fixtures import empty, frame, rows


def brute(words, limits):
    n = len(words)
    m = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            m[i] = max(m[i], k)
    cover = lambda least, width=None: len({x for i in range(n) if m[i] >= least for x in range(i, i + (width or m[i]))})
    return n, cover(limits.window, limits.window), cover(limits.min_repeat), max(m, default=0)


def test_brute_force():
    rng, limits = random.Random(4), Limits()
    for _ in range(120):
        docs = [b" ".join(b"w%d" % rng.randint(0, v) for _ in range(rng.randint(0, 40))) for v in rng.choices([0, 1, 2, 9, 40], k=rng.randint(1, 6))]
        assert [tuple(map(int, x)) for x in measure(docs, limits)] == [brute(d.split(), limits) for d in docs]


def test_table(spark):
    out = {(str(r.doc_id), r.n_words): r for r in repetition.quality_rules(frame(spark)).collect()}
    for r in rows():
        words = (r[1] or "").encode().split()
        got = out[str(r[0]), len(words)]
        assert got.word_chars == sum(len(w.decode()) for w in words)
        if len(words) < 200:
            n, rep, cov, longest = brute(words, Limits())
            assert (got.n_repeat_words, got.n_covered_words, got.longest_repeat) == (rep, cov, longest)
            assert got.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (got.base_failed and got.kept)
    kept = repetition.quality_filter(frame(spark))
    assert kept.columns == frame(spark).columns and kept.count() == sum(r.kept for r in repetition.quality_rules(frame(spark)).collect()) > 10
    assert repetition.quality_rules(empty(spark)).count() == repetition.quality_filter(empty(spark)).count() == 0
