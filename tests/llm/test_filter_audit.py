import re
from collections import Counter, defaultdict
from itertools import permutations

from revaudit.llm import filter_audit

from .fixtures import empty, frame, rows

LABELS = [(3, 1, 0), (3, 0, 0), (12, 1, 1), (5, 0, 1), (None, 1, 1), (20, None, None), (9999, 1, 1), (30, 1, 0)]


def failures(data, labels):
    """(part, letters failed, good, toxic) of every row, one after the other."""
    least = {}
    for d, t, *_ in data:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    for d, t, part, *_ in data:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
        fails += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (t in least and (d is None or d > least[t]))
        of = [x for x in labels if d is not None and x[0] == d]
        yield part or "", fails, any(x[1] == 1 for x in of), any(x[2] == 1 for x in of)


def brute(data, labels):
    out, parts = {}, defaultdict(list)
    for part, *rest in failures(data, labels):
        parts[part].append(rest)
    for part, docs in parts.items():
        got, shapley = {}, Counter()
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                fail = sum(f in x[0] for x in docs)
                shapley[f] += len(gone)
                got["".join(order), k + 1] = [len(left), len(gone), fail - len(gone), sum(x[0] == f for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (order, step), x in got.items():
            out[part, order, step] = (*x, shapley[order[step - 1]])
    return out


def labelled(spark, data=LABELS):
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


def result(df):
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}
    assert df.count() == len(got)
    return got


def test_equals_removal_one_filter_after_the_other(spark):
    more = [(200 + k, "AB $ " * k, "en", None, 1, None, None, None, None, None) for k in (0, 20, 99, 100, 101)] * 2
    got = result(filter_audit.filter_audit(spark.createDataFrame(rows() + more, frame(spark).schema).repartition(5), labelled(spark)))
    assert got == brute(rows() + more, LABELS)
    assert {k[0] for k in got} == {"", "de", "en"} and len(got) == 1800


def test_bounds_of_conditions(spark):
    words = lambda n, kinds: " ".join(f"w{i % kinds}" for i in range(n))
    texts = [words(99, 99), words(100, 100), words(100, 80), words(100, 79), "Aaaaaaaaaa", "Aaaaaaaaa", "Aaaaaaaaaé", "a|b", "a\x0bb\x1cc", "a b"]
    data = [(i, t, "x") for i, t in enumerate(texts + texts[:3])] + [(None, texts[1], None), (None, "alone", "x"), (None, "alone", "x"), (4, texts[0], "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert result(filter_audit.filter_audit(docs, labelled(spark))) == brute(data, LABELS)


def test_one_text_and_key_on_most_rows(spark):
    data = [(7, "Same # text", "x")] * 300 + [(i, "Same # text", "y") for i in range(300)] + [(1, "other", "y")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    assert result(filter_audit.filter_audit(docs, labelled(spark))) == brute(data, LABELS)


def test_empty_tables(spark):
    assert filter_audit.filter_audit(empty(spark), labelled(spark)).count() == 0
    assert result(filter_audit.filter_audit(frame(spark), labelled(spark, []))) == brute(rows(), [])
