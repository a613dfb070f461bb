import random

import numpy as np

from revaudit.llm import toxicity
from revaudit.llm.toxicity import Settings

from .fixtures import empty, frame, rows


def sentences(n: int, seed: int):
    """Toxic ones insult; a group's name comes with them more often than not, though it isn't what makes them toxic."""
    rng = random.Random(seed)
    plain = ["the", "garden", "report", "water", "street", "music", "summer", "letter", "bridge", "paper", "window", "river"]
    out = []
    for _ in range(n):
        toxic = rng.random() < 0.4
        words = rng.choices(plain, k=rng.randint(4, 9))
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["scum", "vermin", "filth"] if rng.random() < 0.7 else ["sunny"]))
        if rng.random() < (0.8 if toxic else 0.05):
            words.insert(rng.randrange(len(words)), "muslims")
        out.append((" ".join(words), int(toxic)))
    return out


def test_counterfactuals_make_group_names_neutral(spark):
    df = spark.createDataFrame(sentences(500, 1), "text string, toxic int")
    # The same features for both: only the penalty differs.
    free, held = (toxicity.fit(df, Settings(penalty=p, chi=6.0)) for p in (0.0, 4.0))
    neutral = ["the garden of the muslims by the river", "music and letter paper for muslims in summer"]
    for t in neutral:
        assert held.score(t) < free.score(t)
    gap = lambda m: np.mean([abs(m.score(t) - m.score(t.replace("muslims", "christians"))) for t in neutral])
    assert gap(held) < 0.5 * gap(free)
    test = sentences(300, 2)
    insult = [x for x in test if any(w in x[0] for w in ("scum", "vermin", "filth"))]
    assert np.mean([held.score(t) >= 0.5 for t, _ in insult]) > 0.9
    plain = [t for t, y in test if y == 0]
    assert np.mean([held.score(t) >= 0.5 for t in plain]) <= np.mean([free.score(t) >= 0.5 for t in plain])


def test_swaps():
    s = Settings()
    assert toxicity.counterfactuals("No group here", s) == []
    assert toxicity.counterfactuals("Women and men", s)[0] == "men and girls"
    assert toxicity.mentioning("Women and men", s) == "Women and men" and toxicity.mentioning(" ?! ", s) == " ?! "
    named = toxicity.mentioning("No group here", s).split()
    assert len(named) == 4 and len(toxicity.counterfactuals(" ".join(named), s)) >= 1 and [w for w in named if w in ("No", "group", "here")] == ["No", "group", "here"]


def auc(rows):
    """Share of pairs of a toxic and another row that the score orders rightly."""
    yes, no = ([r.score for r in rows if bool(r.toxic) == y] for y in (True, False))
    return np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(toxicity.is_held_out(r.doc_id) for r in out) and all(0 <= r.score <= 1 for r in out)
    yes, no = ([r.predicted for r in out if bool(r.toxic) == y] for y in (True, False))
    assert len(yes) >= 50 and np.mean(yes) > 0.8 and np.mean(no) < 0.01  # to call none toxic has a recall of 0
    assert auc(out) > 0.95


def test_mentions_on_real_rows(spark):
    """The corpus names no groups: names are put into its neutral held-out rows. Whatever weight hangs on a name without the
    penalty, less of it is left with it, and no row is called toxic for a mention. (One of 728 rows is called toxic with the
    penalty, whether it has a mention or not, and none without the penalty.)"""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.sample(docs, labels, Settings())
    free, held = (toxicity.fit(rows, Settings(penalty=p)) for p in (0.0, 4.0))
    assert held.n_counterfactuals > 1000
    neutral = docs.join(labels.filter("toxic = 0"), "doc_id", "left_semi").filter(toxicity.held_out("doc_id"))
    texts = [r.text for r in neutral.select("text").collect() if r.text]
    alarm = lambda m, ts: np.mean([m.score(t) >= 0.5 for t in ts])
    named = [toxicity.mentioning(t, Settings()) for t in texts]
    assert sum(a != b for a, b in zip(texts, named)) > 0.9 * len(texts)
    shift = lambda m: np.mean([abs(m.score(a) - m.score(b)) for a, b in zip(texts, named)])
    assert shift(held) < shift(free)
    assert alarm(held, named) <= alarm(held, texts) < 0.005


def test_mentions_in_a_corpus_that_slurs_a_group(spark):
    """Toxic rows name a group, neutral ones hardly: neutral rows with a name put in raise fewer alarms with the penalty."""
    rng = random.Random(6)
    rows = []
    for t, y in sentences(600, 3):  # half of the toxic ones have no insult but the name alone
        w = [x for x in t.split() if x != "muslims" and (x not in ("scum", "vermin", "filth") or rng.random() < 0.5)]
        if rng.random() < (0.95 if y else 0.01):
            w.insert(rng.randrange(len(w) + 1), "muslims")
        rows.append((" ".join(w), y))
    df = spark.createDataFrame(rows, "text string, toxic int")
    free, held = (toxicity.fit(df, Settings(penalty=p, chi=6.0)) for p in (0.0, 4.0))
    neutral = [t for t, y in sentences(400, 5) if not y and "muslims" not in t]
    named = [" ".join(w[:i] + ["muslims"] + w[i:]) for w in map(str.split, neutral) for i in [rng.randrange(len(w))]]
    alarm = lambda m: np.mean([m.score(t) >= 0.5 for t in named])
    assert alarm(held) < alarm(free)


def test_sample_is_bounded_by_rows(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, f"text {k}" if i < 500 else f"text {k} {i}") for k in range(40) for i in range(520)], "doc_id long, text string").repartition(4)
    keys = [k for k in range(40) if not toxicity.is_held_out(k)]
    assert toxicity.sample(docs, labels, Settings()).count() == 21 * len(keys)  # 500 repeats are one
    assert toxicity.sample(docs, labels, Settings(sample=5)).count() == 5


def features_one_by_one(text, s):
    """Buckets of words and n-grams, with whole numbers of any size."""
    words = [w for w in toxicity.re.findall(r"\w+", (text or "").lower())]
    if not words:
        return set()
    cut, base = (1 << 64) - 1, 0x9E3779B97F4A7C15
    line = " " + " ".join(words) + " "
    mixed = [(y := (ord(c) + 1) * base & cut) ^ y >> 29 for c in line]
    out = set()
    for n in s.grams:
        for i in range(len(line) - n + 1):
            h = 0
            for x in mixed[i : i + n]:
                h = (h * 0x100000001B3 + x) & cut
            out.add(((h ^ n) * base & cut) >> 64 - s.bits)
    at = 1
    for w in words:
        total = sum(mixed[at + j] * pow(0x5851F42D4C957F2D, j + 2, 1 << 64) for j in range(len(w)))
        out.add((total & cut) * base % (1 << 64) >> 64 - s.bits)
        at += len(w) + 1
    return out


def test_scores_against_brute_force(spark):
    """Features counted one by one, selected by chi-square, weights by Newton steps on the loss: the scores of the query."""
    s = Settings(steps=20_000, chi=12.0, swaps=2)
    texts = sentences(160, 8) + [("", 0), ("the women and men of the river", 0)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(500, None), (501, "vermin and muslims")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    seen = [(t, y) for i, (t, y) in enumerate(texts) if not toxicity.is_held_out(i)]
    own = [features_one_by_one(t, s) for t, _ in seen]
    n, pos = len(seen), sum(y for _, y in seen)

    def chi(f):
        a = sum(y for (_, y), x in zip(seen, own) if f in x)
        b = sum(f in x for x in own) - a
        c, d = pos - a, n - pos - b
        return n * (a * d - b * c) ** 2 / max((a + b) * (c + d) * (a + c) * (b + d), 1e-9) if a + b >= s.least else 0

    chosen = sorted(f for f in set().union(*own) if chi(f) > s.chi)
    row = lambda t: np.array([1.0, *(f in x for x in [features_one_by_one(t, s)] for f in chosen)])
    x, y = np.stack([row(t) for t, _ in seen]), np.array([y for _, y in seen], float)
    d = []
    for t, _ in seen:
        named = toxicity.mentioning(t, s)
        d += [row(named) - row(u) for u in toxicity.counterfactuals(named, s)]
    d, w = np.stack(d), np.zeros(len(chosen) + 1)
    ridge = s.ridge * np.r_[0, np.ones(len(chosen))]
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 2 * s.penalty * d.T @ d + np.diag(ridge), x.T @ (p - y) + 2 * s.penalty * d.T @ (d @ w) + ridge * w)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, s).collect()}
    assert len(got) == len(texts) + 2
    for i, t in [*((i, t) for i, (t, _) in enumerate(texts)), (500, ""), (501, "vermin and muslims")]:
        want = 1 / (1 + np.exp(-row(t) @ w))
        assert abs(got[i].score - want) < 2e-3 and got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == toxicity.is_held_out(i)


def logistic_loss(w, x, y, d, s):
    z = x @ w
    return np.sum(np.logaddexp(0, z) - y * z) + s.penalty * np.sum((d @ w) ** 2) + s.ridge / 2 * np.sum(w[1:] ** 2)


def test_fit_against_newton():
    """The weights are those that Newton steps on the same loss find."""
    rng, s, n, width = np.random.default_rng(4), Settings(steps=5000), 60, 8
    rows = [np.flatnonzero(rng.random(width - 1) < 0.4) + 1 for _ in range(n)]
    y = (rng.random(n) < 0.4).astype(float)
    swapped = [(np.array([1 + i % 3]), np.array([4 + i % 4])) for i in range(12)]
    x, d = np.zeros((n, width)), np.zeros((len(swapped), width))
    x[:, 0] = 1
    for i, r in enumerate(rows):
        x[i, r] = 1
    for i, (lost, won) in enumerate(swapped):
        d[i, lost], d[i, won] = 1, -1
    w = np.zeros(width)
    ridge = s.ridge * np.r_[0, np.ones(width - 1)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) + 2 * s.penalty * d.T @ (d @ w) + ridge * w
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 2 * s.penalty * d.T @ d + np.diag(ridge), grad)
    got = toxicity.fit_weights(rows, y, swapped, width, s)
    assert np.allclose(got, w, atol=1e-3) and logistic_loss(got, x, y, d, s) <= logistic_loss(w, x, y, d, s) + 1e-6


def test_ties_of_chi_square(spark):
    """Of features that tell the labels apart equally well those of the smallest buckets are taken, every time."""
    df = spark.createDataFrame([("aa bb cc dd", 1)] * 30 + [("ee ff gg hh", 0)] * 30, "text string, toxic int").repartition(3)
    a, b = (toxicity.fit(df, Settings(features=3)) for _ in range(2))
    assert (a.column == b.column).all() and (a.weights == b.weights).all() and (a.column > 0).sum() == 3
    every = np.flatnonzero(toxicity.fit(df, Settings()).column)
    assert (np.flatnonzero(a.column) == every[:3]).all()


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(i % 30, i % 2, (i // 3) % 2) for i in range(80)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(frame(spark), labels, Settings(chi=0.0)).collect()
    assert len(out) == len(rows()) and all(r.score is not None for r in out)
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.toxicity(frame(spark), none).collect()} <= {0, 1}
    assert toxicity.toxicity(empty(spark), labels).count() == 0
