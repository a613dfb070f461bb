"""Integrity suites as data: constraints over named tables, checked in a pass a table.

A constraint names its table and says what must hold; ``check`` compiles all of a table's into one aggregation. Keys that
must be unique and rows that break a condition are exploded to (constraint, key) and counted together, so copies of a key
meet in partial sums; references are counted over the union of both sides' keys, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that a violated constraint shows.
SAMPLES = 3
_RESULT = ["constraint", "table", "kind", "expected", "actual", "passed", "sample"]


@dataclass(frozen=True)
class Constraint:
    """``kind`` is one of

    * ``unique``: no two rows share ``columns``; nulls count as equal
    * ``holds``: ``condition`` is true for each row; null is not
    * ``domain``: the values of the one column, or all members of it if it is an array, are among ``values``; null is not
    * ``excludes``: none of them is; null is no member
    * ``rows``: as many rows as ``count`` fulfil ``condition``, all rows without one
    * ``references``: the keys ``columns`` are among the keys ``other_columns`` of table ``other``; keys with a null are not looked for
    * ``covers``: both tables have the same keys
    * ``lacks``: the table has none of ``columns``
    """

    name: str
    table: str
    kind: str
    columns: tuple[str, ...] = ()
    condition: str | None = None
    values: tuple = ()
    count: int | None = None
    other: str | None = None
    other_columns: tuple[str, ...] = ()


def _key(columns: tuple[str, ...] | list[str]) -> Column:
    return F.to_json(F.array(*(F.expr(c).cast("string") for c in columns)), {"ignoreNullFields": "false"})


def _broken(c: Constraint, df: DataFrame) -> Column:
    """Whether a row breaks the constraint."""
    if c.kind == "holds":
        return ~F.coalesce(F.expr(c.condition), F.lit(False))
    value = F.expr(c.columns[0])
    members = value if df.select(value.alias("v")).dtypes[0][1].startswith("array") else F.array(value)
    inside = lambda x: x.isin(*c.values)
    if c.kind == "domain":
        return ~F.coalesce(F.forall(members, lambda x: F.coalesce(inside(x), F.lit(False))), F.lit(False))
    return F.coalesce(F.exists(members, lambda x: F.coalesce(inside(x), F.lit(False))), F.lit(False))


def _result(name: Column, c_table: Column, kind: Column, expected: Column, actual: Column, sample: Column) -> list[Column]:
    return [name.alias("constraint"), c_table.alias("table"), kind.alias("kind"), expected.cast("long").alias("expected"), actual.cast("long").alias("actual"), (expected.cast("long") == actual.cast("long")).alias("passed"), sample.alias("sample")]


def _sampled(broken: DataFrame) -> DataFrame:
    """(constraint, actual, sample) of (constraint, key, n): all that is broken, and the first few keys."""
    first = Window.partitionBy("constraint").orderBy("key")
    some = broken.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= SAMPLES).groupBy("constraint").agg(F.array_sort(F.collect_list("key")).alias("sample"))
    return broken.groupBy("constraint").agg(F.sum("n").alias("actual")).join(some, "constraint")


def _named(found: DataFrame, wanted: list[Constraint]) -> DataFrame:
    """A row for each of ``wanted``, with 0 where ``found`` has none."""
    names = found.sparkSession.createDataFrame([(c.name, c.table, c.kind) for c in wanted], "constraint string, table string, kind string")
    rows = F.broadcast(names).join(found, "constraint", "left")  # a row a constraint
    return rows.select(*_result(F.col("constraint"), F.col("table"), F.col("kind"), F.lit(0), F.coalesce("actual", F.lit(0)), F.coalesce("sample", F.array().cast("array<string>"))))


def check(tables: dict[str, DataFrame], constraints: list[Constraint], keys: dict[str, list[str]]) -> DataFrame:
    """(constraint, table, kind, expected, actual, passed, sample) of each constraint. ``actual`` are rows beyond the first
    of a key for ``unique``, rows for ``holds``, ``domain``, ``excludes`` and ``rows``, keys for ``references`` and ``covers``, columns for
    ``lacks``; ``sample`` has the first offending keys, by ``keys`` of the table for constraints on rows."""
    parts: list[DataFrame] = []
    for name in dict.fromkeys(c.table for c in constraints):
        df, own = tables[name], [c for c in constraints if c.table == name]
        by_row = [c for c in own if c.kind in ("unique", "holds", "domain", "excludes")]
        if by_row:
            entry = lambda c, k: F.struct(F.lit(c.name).alias("constraint"), F.lit(c.kind == "unique").alias("unique"), k.alias("key"))
            entries = [entry(c, _key(c.columns)) if c.kind == "unique" else F.when(_broken(c, df), entry(c, _key(keys[name]))) for c in by_row]
            entries = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.constraint", "e.unique", "e.key").agg(F.count("*").alias("n"))
            broken = entries.select("constraint", "key", F.when(F.col("unique"), F.col("n") - 1).otherwise(F.col("n")).alias("n")).filter("n > 0")
            parts.append(_named(_sampled(broken), by_row))
        counted = [c for c in own if c.kind == "rows"]
        if counted:
            row = df.agg(*(F.count_if(F.coalesce(F.expr(c.condition or "true"), F.lit(False))).alias(f"_{i}") for i, c in enumerate(counted)))
            some = F.array().cast("array<string>")
            rows = F.array(*(F.struct(*_result(F.lit(c.name), F.lit(c.table), F.lit(c.kind), F.lit(c.count), F.col(f"_{i}"), some)) for i, c in enumerate(counted)))
            parts.append(row.select(F.inline(rows)))
    linked = [c for c in constraints if c.kind in ("references", "covers")]
    if linked:
        sides = []
        for c in linked:
            for table, columns, here in ((c.table, c.columns, True), (c.other, c.other_columns or c.columns, False)):
                whole = reduce(lambda a, b: a & b, (F.expr(x).isNotNull() for x in columns))
                sides.append(tables[table].filter(whole).select(F.lit(c.name).alias("constraint"), F.lit(c.kind == "covers").alias("both"), _key(columns).alias("key"), F.lit(here).alias("here")))
        seen = reduce(DataFrame.union, sides).groupBy("constraint", "both", "key").agg(F.bool_or("here").alias("l"), F.bool_or(~F.col("here")).alias("r"))
        broken = seen.filter(~F.col("r") | (F.col("both") & ~F.col("l"))).select("constraint", "key", F.lit(1).alias("n"))
        parts.append(_named(_sampled(broken), linked))
    if lacking := [c for c in constraints if c.kind == "lacks"]:
        spark = tables[lacking[0].table].sparkSession
        found = [(c.name, c.table, c.kind, 0, len(got), not got, got) for c in lacking for got in [[x for x in c.columns if x in tables[c.table].columns]]]
        parts.append(spark.createDataFrame(found, "constraint string, table string, kind string, expected long, actual long, passed boolean, sample array<string>"))
    return reduce(DataFrame.unionByName, [p.select(*_RESULT) for p in parts])


def same_files(digests: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """The same rows for ``pairs`` (name, path, other path) that must be equal byte for byte, from (path, sha256); a file that
    is missing is equal to none."""
    spark = digests.sparkSession
    wanted = F.broadcast(spark.createDataFrame(pairs, "constraint string, a string, b string"))
    sides = wanted.join(digests.select(F.col("path").alias("a"), F.col("sha256").alias("ha")), "a", "left").join(digests.select(F.col("path").alias("b"), F.col("sha256").alias("hb")), "b", "left")
    bad = F.when(F.coalesce(F.col("ha") == F.col("hb"), F.lit(False)), 0).otherwise(1)
    return sides.select(*_result(F.col("constraint"), F.lit("files"), F.lit("same bytes"), F.lit(0), bad, F.when(bad == 1, F.array("a", "b")).otherwise(F.array().cast("array<string>"))))


def same_names(digests: DataFrame, name: str, folder: str, expected: list[str]) -> DataFrame:
    """The same row for a folder that must hold the files ``expected`` and no others."""
    got = digests.filter(F.startswith(F.col("path"), F.lit(f"{folder}/"))).select(F.substring("path", len(folder) + 2, 10_000).alias("f"), F.lit(True).alias("here"))
    want = digests.sparkSession.createDataFrame([(x,) for x in expected], "f string").withColumn("wanted", F.lit(True))
    wrong = got.join(want, "f", "full_outer").filter("here is null or wanted is null")
    row = wrong.agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("f")), 1, SAMPLES).alias("s"))
    return row.select(*_result(F.lit(name), F.lit(folder), F.lit("file names"), F.lit(0), F.col("n"), F.col("s")))
