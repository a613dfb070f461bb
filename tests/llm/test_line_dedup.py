import random
from collections import Counter, defaultdict

import pytest

from revaudit.llm import line_dedup

from .fixtures import SCHEMA, empty, frame, rows


def brute(docs, percent=80, least=5):
    """{(key, text): text without repeated lines}: each line against all lines before it."""
    import xxhash

    def th(t):  # the order of rows that share a key is that of a hash, the same as Spark's
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return h - (1 << 64) if h >= 1 << 63 else h

    order = sorted({(d is None, d if d is not None else 0, th(t), d, t) for d, t in docs if t is not None})
    seen: dict[str, frozenset] = {}
    where = defaultdict(list)
    out = {}
    for *_, d, t in order:
        keep = []
        for line in t.split("\n"):
            low = line.lower()
            s = frozenset(low.split(" "))
            if low.count(" ") < least - 1:
                keep.append(line)
                continue
            if low in seen:
                continue
            c = Counter(x for w in s for x in where[w])
            if not any(n * 100 >= percent * (len(s) + len(seen[x]) - n) for x, n in c.items()):
                keep.append(line)
            seen[low] = s
            for w in s:
                where[w].append(low)
        out[d, t] = "\n".join(keep)
    return out


@pytest.mark.parametrize("small, common", [(512, 4096), (1, 4096), (4, 12), (1, 2)])
def test_table(spark, monkeypatch, small, common):
    monkeypatch.setattr(line_dedup, "SMALL_GROUP", small)
    monkeypatch.setattr(line_dedup, "COMMON_WORD", common)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows())], SCHEMA + ", row int").repartition(3)
    before = {i: (r[0], r[1]) for i, r in enumerate(rows())}
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns + ["dropped_lines"]
    got = {r.row: r for r in out.collect()}
    want = brute([(r[0], r[1]) for r in rows()])
    assert len(got) == len(rows())
    for k, (d, t) in before.items():
        assert got[k].text == (None if t is None else want[d, t])


def test_shuffled_paths(spark, monkeypatch):
    a = sorted((str(r.doc_id), r.text or "") for r in line_dedup.dedup_lines(frame(spark)).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    assert sorted((str(r.doc_id), r.text or "") for r in line_dedup.dedup_lines(frame(spark)).collect()) == a


def test_empty(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def brute_all(docs, percent=80):
    """{key: text without repeated lines} by all pairs of lines; only lines of white space are passed over."""
    seen, out = [], {}
    for d, t in sorted(docs):
        keep = []
        for line in t.split("\n"):
            s = frozenset(line.lower().split(" "))
            if line.strip(" \t\r\x0b\x0c"):
                if not any(100 * len(s & x) >= percent * len(s | x) for x in seen):
                    keep.append(line)
                seen.append(s)
            else:
                keep.append(line)
        out[d] = "\n".join(keep)
    return out


@pytest.mark.parametrize("small, common", [(512, 4096), (1, 4096), (4, 12), (1, 2)])
def test_lines_of_few_words(spark, monkeypatch, small, common):
    monkeypatch.setattr(line_dedup, "SMALL_GROUP", small)
    monkeypatch.setattr(line_dedup, "COMMON_WORD", common)
    rng = random.Random(3)
    pool = [" ".join(rng.choices("a b c d e f g h".split(), k=n)) for n in range(1, 8) for _ in range(12)]
    pool += ["name\tage\tcity\tzip\tcountry\tphone", "這是一行沒有空格的中文文字", "Read More", "read more", "", " ", "\t\t", "x", "x x"]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_all(docs)
    assert sum(t.lower().count("read more") for t in got.values()) == 1


def test_clashing_names(spark):
    rows = [(1, "a b c\nd e f", 9, "x", "y"), (2, "A b c\ng h i", 9, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, dropped_lines int, _out string, lines string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_out", "lines", "dropped_lines"]
    assert sorted((r.doc_id, r.text, r.dropped_lines) for r in out.collect()) == [(1, "a b c\nd e f", 0), (2, "g h i", 1)]


def test_many_lines_of_one_text(spark):
    """Lines beyond the first 64 of a text, and blank stretches of more than that."""
    lines = [f"line number {i} of this text {i * 7}" for i in range(300)]
    text = "\n".join([*lines, *[""] * 200, lines[130], "the last one here", lines[0].upper()])
    out = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert out.text == "\n".join([*lines, *[""] * 200, "the last one here"]) and out.dropped_lines == 2


def test_percent(spark):
    with pytest.raises(ValueError, match="70 to 100"):
        line_dedup.dedup_lines(frame(spark), percent=50)


def test_frequent_words_are_keys_with_the_next_ones(spark, monkeypatch):
    """Where every line has frequent words among its first ones, none enters all its twos for it, and nothing is lost."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, "\n".join(" ".join(rng.sample(words, rng.randint(1, 14))) for _ in range(8))) for i in range(40)]
    docs += [(100 + i, t.replace("w7", "v7").upper()) for i, t in docs[:20]]
    entered, by_twos = [], line_dedup.by_twos

    def counted(lines, *rest):
        entered.append(lines.count())
        return by_twos(lines, *rest)

    monkeypatch.setattr(line_dedup, "by_twos", counted)
    monkeypatch.setattr(line_dedup, "COMMON_WORD", 16)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_all(docs) and entered == [0]


def test_counters_grow_with_the_table():
    assert line_dedup.counter_bits(1000) == 18 and line_dedup.counter_bits(2_570_000) == 21 and line_dedup.counter_bits(10**9) == 22


def near_copies(count):
    """Documents of one line each: 6 clusters of lines that differ in one word of 30, with words that clusters share."""
    rng = random.Random(11)
    shared = [f"s{i}" for i in range(12)]
    bases = [[f"c{k}w{i}" for i in range(24)] + rng.sample(shared, 6) for k in range(6)]
    lines = [[w if i != j % 30 else f"new{k}n{j}" for i, w in enumerate(base)] for k, base in enumerate(bases) for j in range(count)]
    rng.shuffle(lines)
    return [(i, " ".join(x)) for i, x in enumerate(lines)]


def test_near_copies_are_not_all_paired(spark, monkeypatch):
    """Candidates of clusters of near copies grow with the number of lines, not with its square."""
    paired, matches, found = [], line_dedup.matches, {}

    def counted(lines, classes, pairs, *rest):
        paired.append(pairs.count())
        return matches(lines, classes, pairs, *rest)

    monkeypatch.setattr(line_dedup, "matches", counted)
    for count in (15, 60):
        docs, paired[:] = near_copies(count), []
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
        assert got == brute_all(docs)
        found[count] = sum(paired)
    assert found[60] < 6 * found[15] and found[60] < 6 * 60 * 59 // 2 // 2


@pytest.mark.parametrize("limit", [-1, 1_000_000])
def test_marked_lines_still_match_others(spark, monkeypatch, limit):
    """A line that goes still takes later ones with it that only it matches; lists of marks by broadcast and by shuffle."""
    monkeypatch.setattr(line_dedup, "BROADCAST_LONGS", limit)
    words = [f"w{i}" for i in range(30)]
    chain = [" ".join(words[i:] + [f"x{j}" for j in range(i)]) for i in range(0, 12, 2)]
    docs = [(i, x) for i, x in enumerate(chain)] + [(50 + i, t) for i, t in near_copies(5)] + [(100 + i, t.replace("s1", "z")) for i, t in near_copies(5)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_all(docs) and got[0] == chain[0] and not any(got[i] for i in range(1, 6))


def test_tables_in_between_are_deleted(spark, monkeypatch, tmp_path):
    from revaudit.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda s: f"{tmp_path}/{random.random()}")
    out = line_dedup.dedup_lines(frame(spark))
    left = sorted(p.name for p in tmp_path.glob("*/*"))
    assert left == ["change"] and out.count() == len(rows())


def test_only_likely_pairs_are_verified(spark, monkeypatch):
    """Lines of equal ends that have little else in common are told by parity bits: their words are not brought together."""
    import xxhash

    def h(w):
        x = xxhash.xxh64_intdigest(w.encode(), 42)
        return x - (1 << 64) if x >= 1 << 63 else x

    words = sorted({f"w{i}" for i in range(3000)}, key=h)
    low, rest = words[:3], words[3:]
    rng = random.Random(4)
    docs = [(i, " ".join(low + rng.sample(rest, 30))) for i in range(40)]
    docs += [(100 + i, t.rsplit(" ", 1)[0] + " other") for i, t in docs[:10]]
    verified, write = [], line_dedup.written

    def counted(df, name="t", *rest):
        out = write(df, name, *rest)
        if name == "next":
            verified.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_all(docs) and not any(got[100 + i] for i in range(10))
    assert 0 < sum(verified) <= 25  # 49 lines share their first hashes with the earliest one


@pytest.mark.parametrize("common, small", [(512, 512), (12, 512), (12, 4)])
def test_bands_of_sizes(spark, monkeypatch, common, small):
    """Sets enter in bands of sizes: no band has most of the entries, pairs across bounds are found, results are the same."""
    monkeypatch.setattr(line_dedup, "BAND_ROWS", 10)
    monkeypatch.setattr(line_dedup, "COMMON_WORD", common)
    monkeypatch.setattr(line_dedup, "SMALL_GROUP", small)
    rng = random.Random(5)
    bases = [rng.sample([f"w{i}" for i in range(400)], n) for n in range(1, 61)]
    docs = [(i, " ".join(x)) for i, x in enumerate(bases)]
    for n, x in enumerate(bases):  # longer and shorter ones, some just too different
        docs += [(1000 + n, " ".join(x + [f"x{n}y{j}" for j in range(n // 4)])), (2000 + n, " ".join(x + [f"x{n}z{j}" for j in range(n // 4 + 1)]))]
        docs += [(3000 + n, " ".join(x[: len(x) - len(x) // 6])), (4000 + n, " ".join(rng.sample(x, len(x))[n // 5 :]))]
    bounds, by_words = [], line_dedup.by_words

    def counted(*args):
        bounds.append(args[-2:])
        return by_words(*args)

    monkeypatch.setattr(line_dedup, "by_words", counted)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_all(docs)
    assert len(bounds) == 3 and bounds[0][0] == 0 and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))


def test_bands_share_the_first_words(spark):
    """About a third of the first words each, also where most sets are of one size: then one band has them."""
    sizes = spark.range(90_000).selectExpr("cast(10 + id % 90 as int) as n")
    found = line_dedup.bands(sizes, 80)
    share = [sizes.filter(f"n > {a} and n <= {b}").selectExpr("sum(n - (80 * n + 99) div 100 + 1)").first()[0] for a, b in found]
    assert len(found) == 3 and max(share) < 0.5 * sum(share)
    assert line_dedup.bands(spark.range(90_000).selectExpr("7 as n"), 80) == [(0, 1 << 30)]
    assert line_dedup.bands(spark.range(9).selectExpr("cast(id + 1 as int) as n"), 80) == [(0, 1 << 30)]


def test_parity_bits(spark):
    """Two sets differ in at least as many words as in parity bits."""
    rng = random.Random(6)
    sets = [sorted(rng.randrange(-(1 << 62), 1 << 62) for _ in range(n)) for n in (1, 2, 9, 70)] + [[-5], [0], [0, 5], [-64, 64]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sets)], "l long, h array<long>")
    for r in line_dedup.parity(df, "l", "h").collect():
        want = [0, 0]
        for x in sets[r.l]:
            want[x >= 0] ^= 1 << (x & 63)
        assert (r.n, r.b0 & (1 << 64) - 1, r.b1 & (1 << 64) - 1) == (len(sets[r.l]), *want)
