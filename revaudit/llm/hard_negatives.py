"""Hard negatives by a Voronoi-partitioned kNN join in norm-augmented space.

Inner products become distances: a candidate ``x`` gets the coordinate ``sqrt(M**2 - |x|**2)``, ``M`` being the largest
norm, an anchor ``q`` gets 0, and then ``|q - x|**2 = |q|**2 + M**2 - 2 * q.x``. Candidates are assigned to the nearest of
some pivots and anchors to groups of neighbouring pivots. What an anchor looks for is a band of scores, so a band of
distances; by the triangle inequality only candidates whose distance from their pivot lies between two bounds can be in
it. The bounds of a group's anchors, cell by cell, are a table of groups x pivots, and candidates are replicated only to
the groups they might serve. There anchors and candidates are joined exactly, in whole numbers.

Two joins: first each anchor's positives, the best of its label, bounded from below by the best of a sample of the rows;
groups then hold whole labels, so a candidate goes to one group at most. Then the negatives of each positive, in the band
of scores that it sets. Groups of many anchors are dealt into blocks, and what they get of candidates into chunks; each
block meets each chunk in a task of its own, which returns no more than the first few for an anchor, so neither a frequent
label nor a crowded cell gathers in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ship, struct_of, written

#: Rows of smallest hash of which pivots are the first, and which bound an anchor's positives from below: a bounded sample.
SAMPLE, PIVOTS = 2_048, 512
#: Expected anchors of a block and candidates of a chunk.
BLOCK, CHUNK = 2_048, 20_000
#: Scores held at once.
SCORES = 4_000_000
#: Of a distance, so much that rounding cannot take it over a bound.
SLACK = 1e-6
#: Stands for a null id, which comes after all others.
NO_ID = (1 << 63) - 1
#: Products and sums below this are whole in doubles.
WHOLE = 1 << 53


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width that holds them, the width in the first byte."""
    most = int(np.abs(x).max()) if len(x) else 0
    kind = next(k for k, limit in (("i2", 1 << 15), ("i4", 1 << 31), ("i8", 1 << 63)) if most < limit)
    return kind[1].encode() + x.astype(f"<{kind}").tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[:1].decode()}", offset=1).astype(np.int64)


def whole_vectors(column: pa.Array, scale: int) -> list[np.ndarray | None]:
    """floor(scale * x) of each component of a column of lists; None for vectors that are null or hold a null or non-finite one."""
    sizes = column.value_lengths()
    known = sizes.is_valid().to_numpy(zero_copy_only=False)
    sizes = sizes.fill_null(0).to_numpy(zero_copy_only=False)
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    out, end = [], 0
    for ok, size in zip(known.tolist(), sizes.tolist()):
        x = values[end : end + size]
        end += size
        if ok and np.isfinite(x).all():
            x = np.floor(scale * x)
            if size and np.abs(x).max() >= 2**63:
                raise ValueError("a component is too large: scores are whole numbers of 64 bits")
            out.append(x.astype(np.int64))
        else:
            out.append(None)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows as whole numbers; exact, by way of doubles where those are."""
    most = (int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if most < WHOLE:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return np.array((a.astype(object) @ b.astype(object).T).tolist(), np.int64).reshape(len(a), len(b))  # raises beyond 64 bits


class Space:
    """Pivots among the vectors of a sample, in the space of all vectors of a dimension, norms augmented to ``top``."""

    def __init__(self, sample: list[tuple[int, int, np.ndarray]], top: float, pivots: int, groups: int):
        self.sample, self.top = sample, top
        self.pivots: dict[int, np.ndarray] = {}
        self.group: dict[int, np.ndarray] = {}
        for dim in {len(x) for _, _, x in sample}:
            x = np.unique(np.stack([y for _, _, y in sample if len(y) == dim][:pivots]), axis=0).astype(np.float64)
            self.pivots[dim] = self.raised(x)
            self.group[dim] = self.distances(self.pivots[dim], self.pivots[dim][:: max(1, len(x) // groups)][:groups]).argmin(axis=1)

    def raised(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0.0, self.top**2 - np.einsum("ij,ij->i", x, x)))]

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * a @ b.T
        return np.sqrt(np.maximum(0.0, square))

    def cells(self, x: np.ndarray, candidate: bool) -> np.ndarray:
        """Distances of rows of one dimension from its pivots; a dimension that the sample lacks has the origin as its pivot."""
        y = self.raised(x.astype(np.float64)) if candidate else np.c_[x.astype(np.float64), np.zeros(len(x))]
        return self.distances(y, self.pivots.get(x.shape[1], np.zeros((1, x.shape[1] + 1))))

    def group_of(self, x: np.ndarray) -> np.ndarray:
        """The groups of anchors of one dimension: neighbouring pivots share one."""
        cell = self.cells(x, False).argmin(axis=1)
        return self.group[x.shape[1]][cell] if x.shape[1] in self.group else np.zeros(len(x), np.int64)

    def radius(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a candidate has that score with the anchor, a row of ``x``."""
        x = x.astype(np.float64)
        return np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", x, x) + self.top**2 - 2 * score))


def by_dim(x: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sizes = np.array([len(y) for y in x], np.int64)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, np.stack([x[k] for k in at])


def first_of(scores: np.ndarray, ids: np.ndarray, ok: np.ndarray, k: int) -> list[int]:
    """The places of the first ``k`` that are ok: higher scores first, then smaller ids; rows alike in both are one."""
    at, most = np.flatnonzero(ok), 4 * k
    while True:
        some = at if len(at) <= most else at[scores[at] >= np.partition(scores[at], len(at) - most)[len(at) - most]]
        some = some[np.lexsort((ids[some], -scores[some]))]
        if len(some) > 1:
            some = some[np.r_[True, (np.diff(scores[some]) != 0) | (np.diff(ids[some]) != 0)]]
        if len(some) >= k or len(at) <= most:
            return some[:k].tolist()
        most *= 4


#: An anchor: its name among all, its id, label and vector, its group, the bands of scores that it looks for, and their outer bounds.
ANCHOR = "a binary, id long, label long, x binary, grp int, bands array<struct<p: long, ps: long, lo: long, hi: long>>, lo double, hi double"
FOUND = "a binary, anchor_id long, p long, ps long, id long, score long"


def _map_anchors(anchors: DataFrame, fn) -> DataFrame:
    """``anchors`` with the columns that ``fn(columns, positions, vectors of one dimension)`` returns instead of its own."""
    arrow = to_arrow_schema(struct_of(ANCHOR))

    def run(batches):
        for batch in batches:
            for _, at, x in by_dim([unpack(b) for b in batch.column("x").to_pylist()]):
                part = batch.take(pa.array(at))
                new = fn(part, x)
                yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else part.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return anchors.select(*(f.name for f in arrow)).mapInArrow(run, ANCHOR)


def needs(anchors: DataFrame, space: Space) -> DataFrame:
    """(grp, dim, cell, near, far): how far from its pivot a candidate of a cell must be to serve any anchor of a group."""
    arrow = to_arrow_schema(struct_of(schema := "grp int, dim int, cell int, near double, far double"))

    def bounds(batches):
        for batch in batches:
            grp, lo, hi = (batch.column(c).to_numpy() for c in ("grp", "lo", "hi"))
            for dim, at, x in by_dim([unpack(b) for b in batch.column("x").to_pylist()]):
                d, most, least = space.cells(x, False), space.radius(x, lo[at])[:, None], space.radius(x, hi[at])[:, None]
                slack = SLACK * (1 + space.top)
                near, far = np.maximum(d - most, least - d) - slack, d + most + slack
                for g in np.unique(grp[at]).tolist():
                    of = grp[at] == g
                    columns = [np.full(d.shape[1], g), np.full(d.shape[1], dim), np.arange(d.shape[1]), near[of].min(axis=0), far[of].max(axis=0)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return anchors.mapInArrow(bounds, schema).groupBy("grp", "dim", "cell").agg(F.min("near").alias("near"), F.max("far").alias("far"))


def knn_join(anchors: DataFrame, candidates: DataFrame, space: Space, best, blocks: tuple[int, int]) -> DataFrame:
    """FOUND: for each anchor what ``best(id, label, bands, scores, ids, labels)`` picks of each chunk of candidates that
    its group needs, as (p, ps, place). Candidates with a column ``grp`` go to that group alone."""
    need = written(needs(anchors, space), "needs")  # groups x pivots rows at most, both bounded
    own = ["grp"] if "grp" in candidates.columns else []
    inside = (F.col("far_") >= F.col("near")) & (F.col("far_") <= F.col("far"))
    routed = candidates.withColumnRenamed("far", "far_").join(F.broadcast(need), [*own, "dim", "cell"]).filter(inside).select("grp", "id", "label", "x")
    # A row a group: how many blocks of anchors and chunks of candidates it has.
    size = lambda df, n, name: df.groupBy("grp").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    sizes = written(size(anchors, blocks[0], "blocks").join(size(routed, blocks[1], "chunks"), "grp"), "sizes")
    left = anchors.join(F.broadcast(sizes), "grp").withColumn("b", F.pmod(F.xxhash64("a"), "blocks").cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = routed.join(F.broadcast(sizes), "grp").withColumn("c", F.pmod(F.xxhash64("id", "label", "x"), "chunks").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    arrow = to_arrow_schema(struct_of(FOUND))

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ids, labels = (right.column(c).to_numpy() for c in ("id", "label"))
        sides = [[unpack(b) for b in t.column("x").to_pylist()] for t in (left, right)]
        others = {dim: (at, x) for dim, at, x in by_dim(sides[1])}
        names, anchor_ids, anchor_labels, bands = (left.column(c).to_pylist() for c in ("a", "id", "label", "bands"))
        for dim, at, x in by_dim(sides[0]):
            if dim not in others:
                continue
            where, y = others[dim]
            step = max(1, SCORES // len(where))
            for start in range(0, len(at), step):
                scores = products(x[start : start + step], y)
                for k, row in zip(at[start : start + step].tolist(), scores):
                    for p, ps, j in best(anchor_ids[k], anchor_labels[k], bands[k], row, ids[where], labels[where]):
                        out.append((names[k], anchor_ids[k], p, ps, int(ids[where[j]]), int(row[j])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 6, arrow)], schema=arrow)

    keys = ["grp", "b", "c"]
    left, right = left.select(*keys, "a", "id", "label", "x", "bands"), right.select(*keys, "id", "label", "x")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(local, FOUND).distinct()


def hard_negatives(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", relabel: tuple[int, int] = (7, 10), every: int = 50,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, sample: int = SAMPLE, blocks: tuple[int, int] = (BLOCK, CHUNK), groups: int | None = None,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are floor(scale * x), scores their inner products. Anchors are the rows with a key divisible by ``every``.
    An anchor's positives are its first ``positives`` other rows of its label, its hard negatives for one of them the
    first ``negatives`` rows of other labels with ``low * positive_score <= 100 * negative_score <= high *
    positive_score``; higher scores come first, then smaller keys. Before that, rows with a key divisible by
    ``relabel[0]`` get the label ``(label + 1) % relabel[1]``.

    Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors meet only those of
    their dimension. Rows alike in key, label and vector are one; candidates with the same key and score are one for an
    anchor, and a row with the anchor's own key is never another one. A null key is no anchor, is not relabelled, comes
    after all others among equal scores and is returned as null. Scores must fit 64 bits, else the job ends with an
    error. An empty table gives no rows; other columns aren't read.
    """
    spark = df.sparkSession
    ship(spark)
    arrow = to_arrow_schema(struct_of(described := "id long, label long, x binary, square double"))

    def describe(batches):
        for batch in batches:
            found = whole_vectors(batch.column(2), scale)
            rows = [(i, n, pack(x), float((y := x.astype(np.float64)) @ y)) for i, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), found) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(list(zip(*rows)) or [[]] * 4, arrow)], schema=arrow)

    k, n = F.col(key).cast("long"), F.col(label).cast("long")
    rows = df.filter(F.col(label).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.coalesce(k, F.lit(NO_ID)).alias("id"), F.when(k % relabel[0] == 0, (n + 1) % relabel[1]).otherwise(n).alias("label"), vector)
    rows = written(rows.mapInArrow(describe, described).distinct(), "rows")
    is_anchor = (F.col("id") % every == 0) & (F.col("id") != NO_ID)
    most, count, anchor_count = rows.agg(F.max("square"), F.count("*"), F.count_if(is_anchor)).first()
    if not anchor_count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    taken = rows.orderBy(F.xxhash64("id", "x"), "id", "label", "x").limit(sample).select("id", "label", "x").collect()
    groups = groups or math.ceil(math.sqrt(anchor_count) / 8)
    space = Space([(r.id, r.label, unpack(bytes(r.x))) for r in taken], math.sqrt(most), min(PIVOTS, max(8, math.ceil(math.sqrt(count) / 4))), groups)

    # A candidate's cell and its distance from the pivot.
    arrow_placed = to_arrow_schema(struct_of(placed := "id long, label long, x binary, dim int, cell int, far double"))

    def place(batches):
        for batch in batches:
            for dim, at, x in by_dim([unpack(b) for b in batch.column(2).to_pylist()]):
                d = space.cells(x, True)
                cell, part = d.argmin(axis=1), batch.take(pa.array(at))
                columns = [*part.columns, np.full(len(at), dim), cell, d[np.arange(len(at)), cell]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow_placed)], schema=arrow_placed)

    candidates = written(rows.select("id", "label", "x").mapInArrow(place, placed), "cells")

    # The positives: the best of an anchor's label in the sample bound them from below. Groups hold whole labels.
    known: dict[tuple[int, int], tuple[list, list]] = {}
    for i, l, x in space.sample:  # noqa: E741
        ids, xs = known.setdefault((l, len(x)), ([], []))
        ids.append(i)
        xs.append(x)
    known = {at: (np.array(ids, np.int64), np.stack(xs)) for at, (ids, xs) in known.items()}

    def bounded(part: pa.RecordBatch, x: np.ndarray) -> dict:
        lo = np.full(len(x), -math.inf)
        for j, (i, l) in enumerate(zip(part.column("id").to_pylist(), part.column("label").to_pylist())):  # noqa: E741
            if (l, x.shape[1]) in known:
                ids, others = known[l, x.shape[1]]
                scores = products(x[j : j + 1], others)[0]
                if len(at := first_of(scores, ids, ids != i, positives)) == positives:
                    lo[j] = scores[at[-1]]
        return {"lo": lo}

    of_label = F.pmod(F.xxhash64("label"), F.lit(groups)).cast("int")
    name = F.unhex(F.md5(F.concat(F.concat_ws("|", "id", "label").cast("binary"), "x")))
    anchors = rows.filter(is_anchor).select(name.alias("a"), "id", "label", "x", of_label.alias("grp"), F.array().cast("array<struct<p: long, ps: long, lo: long, hi: long>>").alias("bands"), F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"))
    anchors = written(_map_anchors(anchors, bounded), "anchors")

    def positives_of(i, l, bands, scores, ids, labels):  # noqa: E741
        yield from ((None, None, j) for j in first_of(scores, ids, (labels == l) & (ids != i), positives))

    best = knn_join(anchors, candidates.withColumn("grp", of_label), space, positives_of, blocks)
    at = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "id"))
    best = written(best.withColumn("at", at).filter(F.col("at") <= positives), "positives")

    # The negatives: each positive sets a band of scores; a negative one sets an empty band.
    share = lambda x: F.col("score").cast("decimal(20,0)") * x / 100
    band = F.struct(F.col("id").alias("p"), F.col("score").alias("ps"), F.ceil(share(low)).cast("long").alias("lo"), F.floor(share(high)).cast("long").alias("hi"))
    bands = best.filter("score >= 0").groupBy("a").agg(F.collect_list(band).alias("bands"))  # no more than ``positives``
    anchors = anchors.drop("bands").join(bands, "a").withColumns({"lo": F.array_min("bands.lo").cast("double"), "hi": F.array_max("bands.hi").cast("double")})
    anchors = written(_map_anchors(anchors, lambda part, x: {"grp": space.group_of(x)}), "sought")

    def negatives_of(i, l, bands, scores, ids, labels):  # noqa: E741
        other = (labels != l) & (ids != i)
        for b in bands:
            yield from ((b["p"], b["ps"], j) for j in first_of(scores, ids, other & (scores >= b["lo"]) & (scores <= b["hi"]), negatives))

    out = knn_join(anchors, candidates, space, negatives_of, blocks)
    rank = F.row_number().over(Window.partitionBy("a", "p", "ps").orderBy(F.desc("score"), "id"))
    out = out.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select("anchor_id", null("p").alias("positive_id"), "rank", null("id").alias("negative_id"), F.col("ps").alias("positive_score"), F.col("score").alias("negative_score"))


def brute_force(rows: list[tuple], relabel=(7, 10), every=50, positives=5, negatives=3, low=50, high=95, scale=256) -> set[tuple]:
    """The result for rows (key, vector, label), from all pairs; for tests."""
    good = set()
    for i, x, l in rows:  # noqa: E741
        if l is not None and x is not None and all(y is not None and math.isfinite(y) for y in x):
            good.add((i, tuple(math.floor(scale * y) for y in x), (l + 1) % relabel[1] if i is not None and i % relabel[0] == 0 else l))
    out = set()
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for i, x, l in good:  # noqa: E741
        if i is None or i % every:
            continue
        score = lambda y: sum(a * b for a, b in zip(x, y))  # noqa: B023, E731
        others = [(score(y), j, m) for j, y, m in good if j != i and len(y) == len(x)]
        for ps, p in sorted({s[:2] for s in others if s[2] == l}, key=order)[:positives]:
            found = sorted({s[:2] for s in others if s[2] != l and low * ps <= 100 * s[0] <= high * ps}, key=order)[:negatives]
            out |= {(i, p, r + 1, j, ps, ns) for r, (ns, j) in enumerate(found)}
    return out
