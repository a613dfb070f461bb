"""How five document filters interact: what each removes, alone, after the others, and over all orders of the five.

The relational word pipeline: words are exploded, aggregated by (document, word) and then by document to totals and
distincts. Texts are dealt by document once, before their words come out, and both aggregations keep to that dealing, so
a text is shuffled and not its words, which take three times as much. Repeated rows meet in partial sums before. The
flags of the other filters are outer-joined, and every part of the corpus becomes 32 conditional counts, one for each set of filters that a document can fail. All
120 orders follow from these: a filter removes here the documents that fail it and none before it.

Filters: A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * capitals A-Z > 10 * code points; D: holds a
symbol of ``#$%&*|``; E: identical to the text of a smaller doc_id, removed or not.

Equal texts are told apart by SHA-256. Of each text only the smallest doc_id matters for E, so copies are counted and
never brought together: a text that a third of the corpus repeats is a row of each map task.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


def orders() -> list[dict]:
    """A row for each step of each order: the filter's bit and the bits of those before it."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    return [
        {"filter_order": "".join(order), "step": k + 1, "bit": bit[f], "before": sum(bit[g] for g in order[:k])}
        for order in permutations(FILTERS)
        for k, f in enumerate(order)
    ]


def word_totals(docs: DataFrame, *keys: str) -> DataFrame:
    """(``keys``, words, distincts) from ``docs`` (``keys``, t): of each key that has words, those of one row. Rows of a key must
    have equal texts."""
    once = docs.groupBy(*keys).agg(F.first("t").alias("t"))
    # The array is a column of its own below the generator: an expression of the text beside it would be made for each word.
    words = once.select(*keys, F.split("t", SPACE).alias("ws")).select(*keys, F.explode("ws").alias("w")).filter("w != ''")
    words = words.groupBy(*keys, "w").agg(F.count("*").alias("n"))
    return words.groupBy(*keys).agg(F.sum("n").alias("words"), F.count("*").alias("distincts"))


def failure_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """For each part the arrays (part, n, good, toxic) of 32 counts: of documents by the set of filters that they fail
    (A is bit 1, E bit 16), all of them, those of quality 1, and those that are toxic."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("d"), F.xxhash64(body).alias("h"), F.sha2(body, 256).alias("sha"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("t"))

    bits = F.when(100 * F.regexp_count("t", F.lit("[A-Z]")) > 10 * F.length("t"), 4).otherwise(0) + F.when(F.col("t").rlike(r"[#$%&*|]"), 8).otherwise(0)
    flags = rows.select("d", "h", "sha", "part", bits.alias("bits")).groupBy("d", "h", "sha", "part").agg(F.count("*").alias("n"), F.max("bits").alias("bits"))
    totals = word_totals(rows.select("d", "h", "t"), "d", "h").withColumnsRenamed({"d": "td", "h": "th"})
    both = flags.join(totals, F.col("d").eqNullSafe(F.col("td")) & (F.col("h") == F.col("th")), "full_outer")
    bits = F.col("bits") + F.when(F.coalesce("words", F.lit(0)) < 100, 1).otherwise(0) + F.when(100 * F.col("distincts") < 80 * F.col("words"), 2).otherwise(0)
    both = both.select("d", "sha", "part", "n", bits.alias("bits"))

    known = labels.groupBy(F.col("doc_id").alias("ld")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    both = both.join(known, F.col("d") == F.col("ld"), "left").withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    # Of each text and kind of document: how many there are, the smallest key (null last), and how many rows have it.
    first = F.min(F.struct(F.col("d").isNull().alias("none"), F.col("d").alias("d"), F.col("n").alias("n")))
    kinds = both.groupBy("sha", "part", "good", "toxic", "bits").agg(F.sum("n").alias("n"), first.alias("f"))
    texts = kinds.groupBy("sha", "bits").agg(F.min(F.struct("f.none", "f.d")).alias("least"), F.collect_list(F.struct("part", "good", "toxic", "n", "f")).alias("kinds"))
    kinds = texts.select("bits", "least", F.inline("kinds"))
    originals = F.when(F.struct("f.none", "f.d") == F.col("least"), F.col("f.n")).otherwise(0)
    counted = kinds.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("bits").alias("bits"), originals.alias("n")), F.struct((F.col("bits") + 16).alias("bits"), (F.col("n") - originals).alias("n")))))

    def counts(extra: Column | None, name: str) -> list[Column]:
        when = lambda m: F.col("bits") == m if extra is None else (F.col("bits") == m) & extra
        return [F.sum(F.when(when(m), F.col("n")).otherwise(F.lit(0).cast("long"))).alias(f"{name}{m}") for m in range(1 << len(FILTERS))]

    sets = {"n": None, "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    out = counted.groupBy("part").agg(*(c for name, extra in sets.items() for c in counts(extra, name)))
    return out.select("part", *(F.array(*(f"{name}{m}" for m in range(1 << len(FILTERS)))).alias(name) for name in sets))


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 for
    each value of ``part``.

    A null text is empty: it fails A, and E beside another empty one. A null part is the empty string. Rows of one key
    and text are as many documents, of which none is E for the others' sake; under one key different texts are
    documents of their own. A null key comes after all others, so it fails E where any key has its text, and no label
    is its. A document is good (toxic) if any row of ``labels`` with its key says so. Other columns of either table
    aren't read; an empty table has no parts and gives no rows.
    """
    found = failure_counts(docs, labels, key, text, part)
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order string, step int, bit int, before int>>")
    rows = found.select("*", F.inline(steps))

    def total(counts: str, holds: str, worth: str = "x") -> Column:
        """The sum of the counts of the sets ``m`` of failed filters for which the condition holds."""
        return F.expr(f"aggregate(transform({counts}, (x, m) -> if({holds}, {worth}, 0L)), 0L, (a, x) -> a + x)")

    here = "m & bit != 0 and m & before = 0"
    return rows.select(
        "part", "filter_order", "step",
        total("n", "m & (before | bit) = 0").alias("kept"),
        total("n", here).alias("removed"),
        total("n", "m & bit != 0 and m & before != 0").alias("redundant"),
        total("n", "m = bit").alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        # Of the filters that a document fails each one is the first in as many of the 120 orders.
        total("n", "m & bit != 0", "x * (120 div bit_count(m))").alias("shapley"),
    )
