"""Leakage by near copies, against brute force on a small table of documents."""

import hashlib
import random
import re

from revaudit.functions.text import SPLIT_SEED
from revaudit.plans.registry import QUERIES


def documents(seed: int = 9) -> list[tuple]:
    rng = random.Random(seed)
    texts: list = ["", "?!", None]
    for _ in range(15):
        w = [f"w{rng.randint(0, 400)}" for _ in range(30)]
        texts += [" ".join(w), " ".join(w).upper(), ", ".join(w) + ".", " ".join(w)]  # case, punctuation, exact copy
        for n in (1, 3):
            x = list(w)
            for _ in range(n):
                x[rng.randrange(30)] = f"v{rng.randint(0, 9999)}"
            texts.append(" ".join(x))
    return [(i, t, rng.choice(["en", "de"]), f"src{rng.randint(0, 9)}") for i, t in enumerate(texts)]


def near(docs):
    sets = {d: frozenset(re.findall("[a-z0-9]+", (t or "").lower())) for d, t, *_ in docs}
    alike = lambda a, b: not a | b or 10 * len(a & b) >= 9 * len(a | b)
    return [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]


def test_near_copies(spark, tmp_path):
    docs = documents()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    group = {d: {d} for d, *_ in docs}
    for a, b in near(docs):
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    name = lambda g: "lg_" + hashlib.sha256("|".join(sorted(map(str, g))).encode()).hexdigest()[:12]
    got = {r.doc_id: (r.leakage_group_id, r.leakage_group_size) for r in QUERIES["near_leakage_groups"](spark, str(tmp_path)).collect()}
    assert got == {d: (name(g), len(g)) for d, g in group.items()}
    exact = {r.doc_id: r.leakage_group_id for r in QUERIES["leakage_groups"](spark, str(tmp_path)).collect()}
    assert len({g for g, _ in got.values()}) < len(set(exact.values()))  # exact copies alone do not do

    order = sorted({s for *_, s in docs}, key=lambda s: hashlib.sha256(f"{SPLIT_SEED}|{s}".encode()).hexdigest())
    n = max(1, round(0.2 * len(order)))
    part = {s: 0 if i < n else 1 if i < 2 * n else 2 for i, s in enumerate(order)}
    split = {d: part[s] for d, _, _, s in docs}
    want = sum(split[a] != split[b] for a, b in near(docs))
    assert QUERIES["crossing_near_copies"](spark, str(tmp_path)).first().violations == want > 0


def test_frequent_prefix_tokens_are_split(spark, monkeypatch):
    """All sets share tokens; nothing is lost, and they are not all paired."""
    from revaudit.operators import similarity

    rng = random.Random(4)
    base = [[f"w{rng.randrange(60)}" for _ in range(30)] for _ in range(60)]
    sets = [sorted(set(b)) for b in base]
    for b in list(sets[:30]):
        for _ in range(3):
            c = list(b)
            c[rng.randrange(len(c))] = f"w{rng.randrange(60)}"
            sets.append(sorted(set(c)))
    sets += [["w1"], ["w1", "w2"], []]
    items = spark.createDataFrame(list(enumerate(sets)), "k int, s array<string>").repartition(3)
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and (a or b) and jaccard(a, b) >= 0.8}
    monkeypatch.setattr(similarity, "HOT", 5)
    assert {(r.a, r.b) for r in similarity.near_pairs(items, "k", "s", 80).collect()} == want
    shared = spark.createDataFrame([(i, ["all", *(f"u{i}_{j}" for j in range(5))]) for i in range(400)], "k int, s array<string>")
    monkeypatch.setattr(similarity, "HOT", 100)
    assert similarity.near_pairs(shared, "k", "s", 90).count() == 0


def test_classes_and_first_tokens(spark, monkeypatch):
    """Only first tokens are keys, frequent ones with the next ones; a class is its smallest key."""
    from pyspark.sql import functions as F

    from revaudit.operators import similarity

    monkeypatch.setattr(similarity, "HOT", 3)
    rows = [(i, [f"x{j}" for j in range(10)] + [f"u{i % 40}_{j}" for j in range(20)]) for i in range(60)] + [(90, [f"x{j}" for j in range(10)] + [f"u0_{j}" for j in range(19)])]
    items = spark.createDataFrame(rows, "k int, s array<string>").repartition(3)
    members, pairs = similarity.near_classes(items, "k", "s", 90)
    assert {r.k: r.first for r in members.select("k", F.col("first")).collect()} == {i: i % 40 if i < 60 else i for i, _ in rows}
    assert [(r.a, r.b, r.similarity) for r in pairs.collect()] == [(0, 90, 29 / 30)]
    sets = items.filter("k < 40 or k = 90").select(F.col("k").cast("long").alias("c"), F.transform("s", lambda x: F.xxhash64(x)).alias("h"))
    assert [tuple(r) for r in similarity._by_hashes(sets, 90).collect()] == [(0, 90)]


def test_sets_are_not_kept(spark, monkeypatch):
    """Sets are read again where they are needed, neither written nor all shuffled; any token is told from any other."""
    from revaudit.operators import similarity

    kept, types = similarity.kept, []
    monkeypatch.setattr(similarity, "kept", lambda df: types.append([t for _, t in df.dtypes]) or kept(df))
    odd = ["", "\0", "\1", "\1\2", "\1\3", "\1\4", None, "\0\0"]
    base = [f"t{i}" for i in range(60)]
    sets = [base + odd[:i] for i in range(9)] + [base + [x] for x in odd] + [base + odd]
    rows = list(enumerate(sets)) + [(3, ["z"]), (9, ["z"])]  # two sets of one key
    pairs = set()
    for i, a in rows:
        for j, b in rows:
            a_, b_ = set(a), set(b)
            if a_ != b_ and i < j and 100 * len(a_ & b_) >= 90 * len(a_ | b_):
                first = lambda s: min(k for k, x in rows if set(x) == s)
                x, y = sorted((first(a_), first(b_)))
                pairs.add((x, y, len(a_ & b_) / len(a_ | b_)))
    items = spark.createDataFrame(rows, "k int, s array<string>").repartition(3)
    for limit in (similarity.WANTED, 0):  # broadcast, and by a shuffle
        monkeypatch.setattr(similarity, "WANTED", limit)
        members, found = similarity.near_classes(items, "k", "s", 90)
        assert sorted(map(tuple, found.collect())) == sorted(pairs)
        assert members.count() == len(rows)
    assert types and not any("array<string>" in t for row in types for t in row)


def test_steps_run_over_linked_classes(spark, monkeypatch):
    """Copies and what has no near copy take no part in the steps of the components."""
    from revaudit.operators import similarity

    kept, rows = similarity.kept, []
    monkeypatch.setattr(similarity, "kept", lambda df: (out := kept(df), rows.append(out.count()))[0])
    first = {**{i: i % 3 for i in range(30)}, **{i: i for i in range(40, 80)}}  # three classes of ten, forty of one
    members = spark.createDataFrame(list(first.items()), "k long, first long")
    pairs = spark.createDataFrame([(0, 2), (41, 42)], "a long, b long")
    got = {r.k: (r.leakage_group_id, r.leakage_group_size) for r in similarity.class_leakage_groups(members, "k", "first", pairs).collect()}
    root = {k: {2: 0, 42: 41}.get(f, f) for k, f in first.items()}
    groups = {g: [k for k in root if root[k] == g] for g in root.values()}
    assert got == {k: ("lg_" + hashlib.sha256("|".join(sorted(map(str, groups[g]))).encode()).hexdigest()[:12], len(groups[g])) for k, g in root.items()}
    assert max(rows) <= 4


def test_crossing_copies_keep_no_sets(spark, tmp_path, monkeypatch):
    """The pairs across splits are counted without a document's set in any table in between."""
    from revaudit.operators import similarity

    spark.createDataFrame(documents(3), "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    kept, types = similarity.kept, []
    monkeypatch.setattr(similarity, "kept", lambda df: types.append([t for _, t in df.dtypes]) or kept(df))
    assert QUERIES["crossing_near_copies"](spark, str(tmp_path)).first().violations > 0
    assert types and not any("array<string>" in t for row in types for t in row)
