"""Deterministic leakage-safe splits and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPLIT_SEED, sha256_text
from .ranking import ranked


def split_order(key: str, seed: str = SPLIT_SEED):
    return sha256_text(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def stable_split(items: DataFrame, key: str, validation: float = 0.2, test: float = 0.2, seed: str = SPLIT_SEED) -> DataFrame:
    """(key, split): distinct keys in hash order, first test, then validation, the rest development. Shares are rounded
    half to even, with at least one each from three keys on."""
    keys = items.select(key).filter(F.col(key).isNotNull()).distinct()
    n = keys.agg(F.count("*").alias("n")).select(
        "n",
        F.when(F.col("n") >= 3, F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(test)).cast("int"))).otherwise(0).alias("t"),
        F.when(F.col("n") >= 3, F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(validation)).cast("int"))).otherwise(0).alias("v"),
    )
    full = F.col("t") + F.col("v") >= F.col("n")
    n = n.select(F.when(full, (F.col("n") >= 2).cast("int")).otherwise(F.col("t")).alias("t"), F.when(full, (F.col("n") >= 3).cast("int")).otherwise(F.col("v")).alias("v"))
    return ranked(keys, [split_order(key, seed), key], "r").join(F.broadcast(n)).select(key, F.when(F.col("r") <= F.col("t"), "test").when(F.col("r") <= F.col("t") + F.col("v"), "validation").otherwise("development").alias("split"))


def weighted_split(groups: DataFrame, key: str, weight: str, shares: tuple[float, float, float] = (0.6, 0.2, 0.2), seed: str = SPLIT_SEED) -> DataFrame:
    """(key, weight, split): groups by falling weight, then hash, each into the split that is emptiest for its target.

    The greedy fold runs over one array of groups, so it is for groups, not rows.
    """
    names = ("development", "validation", "test")
    item = F.struct((-F.col(weight)).alias("w"), split_order(key, seed).alias("h"), F.col(key).alias("k"))
    folded = groups.agg(F.array_sort(F.collect_list(item)).alias("g"), F.sum(weight).cast("double").alias("total"))
    start = F.struct(*(F.lit(0).cast("double").alias(n) for n in names), F.array().cast("array<string>").alias("out"))

    def put(state, g):
        load = [F.when(F.col("total") * s > 0, state[n] / (F.col("total") * F.lit(s))).otherwise(F.lit(float("inf"))) for n, s in zip(names, shares)]
        pick = F.when((load[0] <= load[1]) & (load[0] <= load[2]), names[0]).when(load[1] <= load[2], names[1]).otherwise(names[2])
        grown = [(state[n] + F.when(pick == n, -g["w"].cast("double")).otherwise(F.lit(0.0))).alias(n) for n in names]
        return F.struct(*grown, F.concat(state["out"], F.array(pick)).alias("out"))

    done = folded.select("g", F.aggregate("g", start, put).alias("s"))
    return done.select(F.inline(F.arrays_zip(F.col("g").alias("g"), F.col("s.out").alias("split")))).select(F.col("g.k").alias(key), (-F.col("g.w")).alias(weight), "split")


def crossing_pairs(pairs: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """One row: how many pairs (a, b) have their sides in different splits."""
    s = splits.select(F.col(key).alias("k"), "split")
    both = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b")
    return both.agg(F.coalesce(F.sum((F.col("sa") != F.col("sb")).cast("long")), F.lit(0)).alias("violations"))


def crossing_classes(pairs: DataFrame, members: DataFrame, first: str, splits: DataFrame, key: str) -> DataFrame:
    """One row: what ``crossing_pairs`` counts over all pairs of members (``key``, ``first``) of one class or of two that
    ``pairs`` (a, b) of their first ones link, from the classes' members a split, without listing the pairs."""
    s = members.join(splits.select(key, "split"), key).groupBy(first, "split").agg(F.count("*").alias("n"))
    both = pairs.select("a", "b").union(members.select(F.col(first).alias("a"), F.col(first).alias("b")).distinct())
    both = both.join(s.toDF("a", "sa", "na"), "a").join(s.toDF("b", "sb", "nb"), "b").filter("sa != sb and (a != b or sa < sb)")
    return both.agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("violations"))


def one_split_each(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """One row: whether every key lies in one split."""
    per = df.groupBy(key).agg(F.countDistinct(split).alias("n"))
    return per.agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("passed"))


def crossing_hashes(df: DataFrame, hashes: list[str], split: str = "split") -> DataFrame:
    """(hash, splits): hashes of any of the columns that lie in several splits, with the sorted splits."""
    long = df.select(split, F.explode(F.array(*map(F.col, hashes))).alias("hash")).filter("hash is not null").distinct()
    out = long.groupBy("hash").agg(F.array_sort(F.collect_set(split)).alias("_s"))
    return out.filter(F.size("_s") > 1).select("hash", F.array_join("_s", "|").alias("splits"))


def exclude_crossing(df: DataFrame, hashes: list[str], split: str = "split") -> DataFrame:
    """Adds ``cross_split_duplicate``: one of the row's hashes lies in several splits."""
    bad = crossing_hashes(df, hashes, split).select("hash")
    out = df.withColumn("cross_split_duplicate", F.lit(False))
    for h in hashes:
        mark = bad.select(F.col("hash").alias("_h"), F.lit(True).alias("_hit"))
        out = out.join(mark, F.col(h) == F.col("_h"), "left").withColumn("cross_split_duplicate", F.col("cross_split_duplicate") | F.coalesce("_hit", F.lit(False))).drop("_h", "_hit")
    return out


def audit(df: DataFrame, counted: dict[str, str], split: str = "split") -> DataFrame:
    """Rows of each split, and distinct values of the columns by their new names."""
    return df.groupBy(split).agg(F.count("*").alias("rows"), *(F.countDistinct(c).alias(n) for n, c in counted.items()))


def sample_keep_order(df: DataFrame, key: str, order: str, n: int, seed: str) -> DataFrame:
    """``n`` rows drawn without replacement by a seeded hash, in their source order."""
    return df.orderBy(sha256_text(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n).orderBy(order)
