"""The stages of the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from revaudit.llm import ngram_join
from revaudit.llm.queries import WEIGHTS
from revaudit.llm.repetition import Limits

from . import fixtures
from .test_mixing import fill
from .test_repetition import brute as repeats

BLANK = " \t\n\r\x0b\x0c"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(6)
    line = lambda: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(60))
    return [line() for _ in range(8)]


def near(text: str, n: int = 1) -> str:
    return " ".join(text.split(" ")[n:])


def th(t: str) -> int:
    h = xxh64_intdigest(t.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def keep(rows: list[tuple]) -> Counter:
    """One row a component, by the number of the row in its stead of a key."""
    parts: dict = {}
    for i, (_, component) in ngram_join.brute_force([(i, r[1]) for i, r in enumerate(rows)], 5, 80).items():
        parts.setdefault(component, []).append(rows[i])
    return Counter(min(p, key=lambda r: (r[0] is None, r[0] or 0, th(r[1] or ""), str(r[2:]))) for p in parts.values())


def test_near_duplicates_by_row(spark):
    a, b, c, d, e, f, g, h = texts()
    rows = [(1, a), (7, near(a)), (7, b)]  # a near copy and a clean text under one key
    rows += [(None, c), (None, near(c)), (None, c), (None, d), (3, near(d)), (None, h)]  # null keys
    rows += [(4, e), (4, e), (5, near(e)), (6, f), (6, f), (6, near(f))]  # repeated rows
    rows += [(8, g), (8, near(g)), (9, ""), (9, ""), (10, None), (None, None)]
    rows = [(k, t, "en", "src0", 1) for k, t in rows]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(tuple(r) for r in out.collect()) == keep(rows)


def quality(rows: list[tuple]) -> Counter:
    def passes(words, limits=Limits()):
        n, three = len(words), Counter(zip(words, words[1:], words[2:]))
        if n < limits.min_words or 100 * len({x for i in range(n - 2) if three[tuple(words[i : i + 3])] > 1 for x in range(i, i + 3)}) > limits.max_repeat_percent * n:
            return False
        _, _, covered, longest = repeats(words, limits)
        return covered <= limits.max_covered * n and longest <= max(limits.max_longest, limits.max_longest_share * n)

    return Counter(r for r in rows if passes((r[1] or "").encode().split()))


def lines(rows: list[tuple]) -> Counter:
    seen, new, out = [], {}, Counter()
    for _, _, _, d, t in sorted({(r[0] is None, r[0] or 0, th(r[1]), r[0], r[1]) for r in rows}):
        kept = []
        for line in t.split("\n"):
            s = frozenset(line.lower().split(" "))
            if not line.strip(BLANK) or not any(100 * len(s & x) >= 80 * len(s | x) for x in seen):
                kept.append(line)
            if line.strip(BLANK):
                seen.append(s)
        new[d, t] = "\n".join(kept)
    for r in rows:
        t = new[r[0], r[1]]
        if t == r[1] or t.strip(BLANK):
            out[r if t == r[1] else (r[0], t, *r[2:4], len(t), *r[5:])] += 1
    return out


def mix(rows: list[tuple]) -> Counter:
    web, books = {f"src{i}" for i in range(7)}, {f"src{i}" for i in range(7, 14)}
    path = lambda r: ("web" if r[3] in web else "books" if r[3] in books else "reference", r[2], r[3])
    size = lambda r: len(r[1].encode().split())
    total = Counter()
    for r in rows:
        for k in range(4):
            total[path(r)[:k]] += size(r)
    budget = {(): total[()] * 90 // 100}
    for k, level in enumerate(("domain", "lang", "source")):
        for parent in [p for p in total if len(p) == k]:
            nodes = [p for p in total if len(p) == k + 1 and p[:k] == parent]
            budget |= dict(zip(nodes, fill(budget[parent], [(total[p], WEIGHTS[level].get(p[-1], 1)) for p in nodes])))
    order = lambda r: hashlib.md5(f"7:0:{'none' if r[0] is None else r[0]}".encode()).hexdigest()
    out = Counter()
    for leaf in {path(r) for r in rows}:
        own = [r for r in rows if path(r) == leaf]
        out.update(r for r in own if budget[leaf] >= total[leaf] or sum(size(x) for x in own if order(x) <= order(r)) <= budget[leaf])
    return out


def test_stages_and_run(spark, tmp_path):
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    peer = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = fixtures.rows()
    fixtures.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), brute in zip(corpus_pipeline.STAGES, [quality, lines, keep, mix]):
        want = brute(rows)
        got = Counter(tuple(r) for r in stage(spark, spark.createDataFrame(rows, fixtures.SCHEMA).repartition(3), "").collect())
        assert got == want, name
        rows = list(want.elements())
    assert len(rows) > 5
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter((r[0], tuple(peer.encode_ordinary(r[1]))) for r in rows)
