"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A token budget flows down a tree, by default domain, language, source. Among the children of a node it is shared by
weight; a child whose supply is short keeps its supply, and what it leaves goes to its siblings by their weights. A
node's supply is that of all its leaves, so a shortage reaches the node's own siblings only when the whole subtree is
used up. Each leaf then gets whole epochs of its documents and, of one more epoch in an order seeded by the epoch's
number, the prefix that fits its tokens.

The prefix is found without sorting a leaf: sums over 4,096 ranges of the order's hash find the range in which the
prefix ends, and only that range is looked at in detail. Documents are never shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Tables of leaves up to this size are broadcast; larger ones are joined by a shuffle.
BROADCAST_LEAVES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def share(nodes: DataFrame, parent: list[str], name: str, budget: str) -> DataFrame:
    """Adds ``got``: the part of the parent's ``budget`` that each node gets, from its ``supply`` and ``weight``.

    In rising order of supply for a unit of weight, a node is short if its supply is below its share of what the nodes
    before it have left; the nodes from the first one that isn't short share the rest by weight.
    """
    whole = Window.partitionBy(*parent)
    order = whole.orderBy(F.col("supply") / F.col("weight"), F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.col(budget) - F.coalesce(F.sum("supply").over(before), F.lit(0)), F.lit(0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = nodes.withColumns({"_left": left, "_weight": weight, "_at": F.row_number().over(order)})
    out = out.withColumn("_enough", F.col("supply") * F.col("_weight") > F.col("_left") * F.col("weight"))
    first = F.min(F.when(F.col("_enough"), F.struct("_at", "_left", "_weight"))).over(whole)
    out = out.withColumn("_first", first)
    exact = F.expr("_first._left * weight div _first._weight")
    short = F.col("_first").isNull() | (F.col("_at") < F.col("_first._at"))
    return out.withColumn("got", F.when(short, F.col("supply")).otherwise(exact)).drop("_left", "_weight", "_at", "_enough", "_first")


def plan(leaves: DataFrame, levels: list[str], weights: dict[str, dict], other: int, budget: Column, epochs: int) -> DataFrame:
    """Leaves (levels, tokens) with ``target``: the tokens that each is to give. Weights are whole numbers; a value
    that has none, null included, has the weight ``other``. Leaves below a weight of 0 give nothing and are left out:
    nothing is budgeted for them, so that others can make up for it."""

    def weight_of(level: str) -> Column:
        weight = F.lit(other).cast("long")
        for value, w in weights.get(level, {}).items():
            weight = F.when(F.col(level) == value, F.lit(w).cast("long")).otherwise(weight)
        return weight

    table = leaves.withColumn("supply", F.col("tokens") * epochs).filter(reduce(and_, (weight_of(x) > 0 for x in levels)))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(budget.cast("long").alias("got"))
    above = table.join(F.broadcast(total))  # a single row
    for k, level in enumerate(levels):
        parent = levels[:k]
        nodes = above.groupBy(*levels[: k + 1]).agg(F.sum("supply").alias("supply"), F.first("got").alias("budget"))
        nodes = share(nodes.withColumn("weight", weight_of(level)), parent, level, "budget").select(*levels[: k + 1], "got")
        nodes = nodes.withColumnsRenamed({c: f"_{c}" for c in levels[: k + 1]})
        on = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in levels[: k + 1]))
        above = above.drop("got").join(nodes, on).select(*table.columns, "got")
    return above.withColumnRenamed("got", "target")


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("none"))).cast("binary"))


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict],
    budget_percent: int = 100,
    epochs: int = 2,
    seed: int = 7,
    other: int = 1,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Rows of ``docs``, all columns, with ``mix_epoch``: once for each epoch that takes them, plus the ``mix_`` levels
    and ``mix_tokens``. ``levels`` are the tree's levels from the top as expressions; ``budget_percent`` is that share
    of all tokens.

    A null text has no tokens and comes with the whole epochs and with a prefix that its hash lies in. Rows that share
    a key are taken together. A leaf's last prefix ends before the first row that would not fit. An empty table gives
    an empty one. Columns of the input that are named as those that are added give way to them.
    """
    names = [f"mix_{x}" for x in levels]
    docs = docs.select(*(c for c in docs.columns if c not in names and c not in ("mix_tokens", "mix_epoch", "mix_whole", "mix_cut", "mix_copies")))
    tagged = docs.select("*", *(c.alias(n) for n, c in zip(names, levels.values())))
    narrow = written(tagged.select(F.col(key).alias("k"), *names, tokens(text).alias("tokens")), "tokens")
    leaves = narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    by_name = {f"mix_{k}": v for k, v in weights.items()}
    targets = plan(written(leaves, "leaves"), names, by_name, other, F.expr(f"tokens * {budget_percent} div 100"), epochs)
    targets = targets.withColumns({
        "whole": F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(F.lit(epochs)),
        "rest": F.when(F.col("tokens") > 0, F.col("target") % F.col("tokens")).otherwise(F.lit(0)),
    })
    targets = written(targets.select(*names, "whole", "rest"), "targets")
    few = targets.count() <= BROADCAST_LEAVES

    def with_leaf(rows: DataFrame, leaf: DataFrame) -> DataFrame:
        leaf = leaf.withColumnsRenamed({n: f"_{n}" for n in names})
        on = reduce(and_, (F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names))
        return rows.join(F.broadcast(leaf) if few else leaf, on).drop(*(f"_{n}" for n in names))

    keyed = with_leaf(narrow, targets).filter("rest > 0").withColumn("o", order_key(seed, F.col("whole"), F.col("k")))
    ranges = keyed.groupBy(*names, "rest", F.substring("o", 1, 3).alias("b")).agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*names).orderBy("b"))
    ends = ranges.withColumn("upto", upto).filter("upto > rest").groupBy(*names).agg(F.min(F.struct("b", (F.col("rest") - (F.col("upto") - F.col("tokens"))).alias("room"))).alias("e"))
    ends = written(ends.select(*names, "e.b", "e.room"), "ends")
    last = with_leaf(keyed, ends).filter(F.substring("o", 1, 3) == F.col("b"))
    last = last.groupBy(*names, "b", "room", "o").agg(F.sum("tokens").alias("tokens"))
    fits = last.withColumn("upto", F.sum("tokens").over(Window.partitionBy(*names).orderBy("o")))
    cuts = fits.groupBy(*names, "b").agg(F.max(F.when(F.col("upto") <= F.col("room"), F.col("o"))).alias("o"))
    cuts = cuts.select(*names, F.coalesce("o", "b").alias("cut"))
    cuts = cuts.withColumnsRenamed({n: f"_{n}" for n in names})
    on = reduce(and_, (F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names))
    final = targets.join(cuts, on, "left").select(*names, F.col("whole").alias("mix_whole"), F.col("cut").alias("mix_cut"))
    final = written(final, "cuts")
    own = with_leaf(tagged, final)
    extra = (order_key(seed, F.col("mix_whole"), F.col(key)) <= F.col("mix_cut")).cast("int")
    copies = (F.col("mix_whole") + F.coalesce(extra, F.lit(0))).cast("int")
    own = own.withColumn("mix_copies", copies).filter("mix_copies > 0").withColumn("mix_tokens", tokens(text))
    return own.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1))).drop("mix_whole", "mix_cut", "mix_copies")
