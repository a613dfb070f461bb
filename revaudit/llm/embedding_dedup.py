"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

A vector's code in a table is the signs of its products with ``bits`` random hyperplanes. Two vectors at the angle ``a``
share a bit with probability ``1 - a / pi``. The number of bits follows the number of vectors, so that a bucket of
unrelated vectors stays small at any size; the number of tables follows from the bits, so that a pair right at the
threshold is missed by all tables with a probability of ``MISSED`` at most, and closer pairs far less often.

Equal vectors are one class, told apart by 128 bits of hash, so copies never meet. Only ids and codes are shuffled to
count the buckets; classes alone in all their buckets go no further, and the others fetch their vector. A bucket of more
than ``BLOCK`` classes is dealt into blocks, and each pair of blocks is a group of its own: no group has more than two
blocks, and every pair of the bucket meets. A pair that shares several tables counts in the first of them, so links are
counted without being listed: a group returns a number a class and the edges of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ship, struct_of, written
from .ngram_join import components

#: The chance that all tables miss a pair right at the threshold.
MISSED = 0.002
MAX_BITS = 48
#: Classes of a bucket that are compared as one block, expected.
BLOCK = 1_000
#: Rows that a task reads before it compares them: vectors of that many entries are held, beside one group.
HELD = 8_192
#: Classes of more rows than 1 / SHARE of all are broadcast: fewer than SHARE.
SHARE = 50_000
#: Cosines this close to the threshold are summed again without rounding.
CLOSE = 1e-12


def unpack(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray | None]:
    """The vectors of a column of lists as doubles; None for those that are null, empty, zero or not finite throughout."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist()):
        x = values[end - size : end]
        out.append(x if size and np.isfinite(x).all() and x.any() else None)
    return out


def class_of(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest((x + 0.0).tobytes())  # -0.0 and 0.0 are one value


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


class Tables:
    """Bits and tables for ``n`` vectors at a threshold, and the hyperplanes of each dimension."""

    def __init__(self, n: int, threshold: float, seed: int):
        self.bits = min(MAX_BITS, max(6, math.ceil(math.log2(max(n, 2)))))
        same = 1 - math.acos(threshold) / math.pi
        self.tables = math.ceil(math.log(MISSED) / math.log1p(-(same**self.bits)))
        self.seed, self.planes = seed, {}

    def codes(self, u: np.ndarray) -> np.ndarray:
        """A row of codes for each row of ``u``, a column a table."""
        dim = u.shape[1]
        if dim not in self.planes:
            self.planes[dim] = np.random.default_rng([self.seed, dim]).standard_normal((dim, self.tables * self.bits))
        signs = (u @ self.planes[dim] > 0).reshape(len(u), self.tables, self.bits)
        return signs @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))


def links_of(u: np.ndarray, raw: np.ndarray, split: np.ndarray | None, table: int, tables: Tables, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i < j) of a group that link and share no earlier table. With ``split`` (which rows are of the first of two
    blocks) only pairs across count."""
    left, right = (np.arange(len(u)), np.arange(len(u))) if split is None else (np.flatnonzero(split), np.flatnonzero(~split))
    cosine = u[left] @ u[right].T
    ok = cosine >= threshold
    if split is None:
        ok &= np.arange(len(u))[:, None] < np.arange(len(u))
    for i, j in np.argwhere(np.abs(cosine - threshold) < CLOSE).tolist():
        ok[i, j] = exact_cosine(raw[left[i]], raw[right[j]]) >= threshold and (split is not None or i < j)
    if table and ok.any():
        a, b = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
        ca, cb = tables.codes(u[left[a]])[:, :table], tables.codes(u[right[b]])[:, :table]
        again = np.zeros((len(a), len(b)), bool)
        for t in range(table):
            again |= ca[:, t][:, None] == cb[:, t]
        ok[np.ix_(a, b)] &= ~again
    i, j = np.nonzero(ok)
    return left[i], right[j]


def spanning(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Of the pairs those that join two components of what came before."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out = []
    for x, y in zip(a, b):
        if (p := find(x)) != (q := find(y)):
            parent[p] = q
            out.append((x, y))
    return out


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, seed: int = 20_240) -> DataFrame:
    """Rows (``key``, n_links, component_id, kept) of every row of ``df``: how many other rows are linked with it directly,
    the smallest key that links reach, itself included, and whether it is that one.

    Vectors link when their cosine, in doubles, is ``threshold`` or more; those of different dimensions never. A vector
    that is null, empty or zero, or has a null, NaN or infinite component, links with nothing and is kept. Repeated rows
    are rows of their own, linked with each other. A null key takes part, but names its component only where that has
    no other; rows under the least key of their component are all kept. An empty table gives no rows; other columns
    aren't read.
    """
    spark = df.sparkSession
    ship(spark)
    arrow = to_arrow_schema(struct_of(described := "k long, c binary, x array<double>"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = unpack(batch.column(1))
            columns = [batch.column(0), [None if x is None else class_of(x) for x in found], found]
            yield pa.RecordBatch.from_arrays([y.cast(f.type) if isinstance(y, pa.Array) else pa.array(y, f.type) for y, f in zip(columns, arrow)], schema=arrow)

    rows = df.select(F.col(key).cast("long"), F.col(vector)).mapInArrow(describe, described)
    rows = written(rows, "vectors")
    base = rows.select("k", "c")
    classes = written(rows.filter("c is not null").groupBy("c").agg(F.min("k").alias("rep"), F.count("*").alias("rows"), F.first("x").alias("x")), "classes")
    n = classes.count()
    tables = Tables(n, threshold, seed)

    arrow_codes = to_arrow_schema(struct_of(coded := "c binary, t int, code long"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                names = np.array(batch.column(0).slice(start, 512).to_pylist(), object)
                x = unpack(batch.column(1).slice(start, 512))
                for dim in {len(y) for y in x}:
                    at = [i for i, y in enumerate(x) if len(y) == dim]
                    codes = tables.codes(unit(np.stack([x[i] for i in at])))
                    columns = [names[at].repeat(tables.tables), np.tile(np.arange(tables.tables, dtype=np.int32), len(at)), codes.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(y, f.type) for y, f in zip(columns, arrow_codes)], schema=arrow_codes)

    entries = written(classes.select("c", "x").mapInArrow(code, coded), "codes")
    company = entries.groupBy("t", "code").agg(F.count("*").alias("size")).filter("size > 1")
    entries = entries.join(company, ["t", "code"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("c"), "blocks").cast("int")
    # A block meets each block, itself included: as the first one of the pair or the second.
    entries = entries.withColumn("own", own).select("c", "t", "code", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    entries = entries.select("c", "t", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    met = entries.join(classes.select("c", "rows", "x"), "c")

    arrow_found = to_arrow_schema(struct_of(found_schema := "a binary, links long, b binary"))
    group = ["t", "code", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by their group; one that isn't over yet waits for the next ones."""
        rest: list[pa.RecordBatch] = []

        def result(held: pa.Table) -> pa.RecordBatch:
            at = np.stack([held.column(c).to_numpy() for c in group], axis=1)
            starts = np.r_[0, np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, len(at)]
            names, weights = held.column("c").to_pylist(), held.column("rows").to_numpy()
            raw, first = unpack(held.column("x")), held.column("own").to_numpy() == at[:, 2]
            out: list[tuple] = []
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
                table, _, i, j = at[low].tolist()
                for dim in {len(x) for x in raw[low:high]}:
                    which = np.array([k for k in range(low, high) if len(raw[k]) == dim])
                    if len(which) < 2:
                        continue
                    x = np.stack([raw[k] for k in which])
                    a, b = links_of(unit(x), x, None if i == j else first[which], table, tables, threshold)
                    if len(a):
                        a, b = which[a], which[b]
                        total = np.zeros(high - low, np.int64)
                        np.add.at(total, a - low, weights[b])
                        np.add.at(total, b - low, weights[a])
                        out += [(names[low + k], int(total[k]), None) for k in np.flatnonzero(total).tolist()]
                        out += [(names[k], 0, names[m]) for k, m in spanning(a.tolist(), b.tolist())]
            columns = list(zip(*out)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(y, f.type) for y, f in zip(columns, arrow_found)], schema=arrow_found)

        for batch in batches:
            rest.append(batch)
            if sum(b.num_rows for b in rest) >= HELD:
                held = pa.Table.from_batches(rest)
                at = np.stack([held.column(c).to_numpy() for c in group], axis=1)
                end = len(at) - int(np.argmax((at[::-1] != at[-1]).any(axis=1))) if (at[0] != at[-1]).any() else 0
                if end:
                    yield result(held.slice(0, end))
                    rest = held.slice(end).to_batches()
        if rest:
            yield result(pa.Table.from_batches(rest))

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = written(met.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(compare, found_schema), "found")
    direct = found.groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    reached = components(found.filter("b is not null").select("a", "b")).select(F.col("v").alias("c"), "root")
    named = classes.select("c", "rep", "rows").join(direct, "c", "left").join(reached, "c", "left").withColumn("root", F.coalesce("root", "c"))
    names = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = named.join(names, "root").select("c", "component", "rows", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links"))
    named = written(named, "named")

    # Classes of many rows are broadcast, so that no task gets all copies of a vector; their rows join by another hash.
    many = named.filter(F.col("rows") >= max(16, base.count() // SHARE)).select(F.col("c").alias("mc"), F.col("component").alias("many"), F.col("links").alias("many_links"))
    out = base.join(F.broadcast(many), F.col("c") == F.col("mc"), "left")
    out = out.withColumn("jc", F.when(F.col("c").isNull() | F.col("mc").isNotNull(), F.unhex(F.hex(F.xxhash64("k")))).otherwise(F.col("c")))
    out = out.join(named.select(F.col("c").alias("jc"), "component", "links"), "jc", "left")
    component = F.when(F.col("c").isNull(), F.col("k")).when(F.col("mc").isNotNull(), F.col("many")).otherwise(F.col("component"))
    out = out.select(F.col("k").alias(key), F.coalesce("many_links", "links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def brute_force(rows: list[tuple], threshold: float = 0.95) -> list[tuple]:
    """(key, n_links, component_id, kept) in the order of the rows (key, vector), from all pairs; for tests."""

    def good(x):
        return x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x) and any(x)

    found = [np.array(x, float) if good(x) else None for _, x in rows]
    links = {i: [j for j, y in enumerate(found) if j != i and x is not None and y is not None and len(x) == len(y) and exact_cosine(x, y) >= threshold] for i, x in enumerate(found)}
    out, seen = [], {}
    for i, (k, _) in enumerate(rows):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            name = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(group, name)
        out.append((k, len(links[i]), seen[i], k == seen[i]))
    return out
