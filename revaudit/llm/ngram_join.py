"""N-gram Jaccard join by PartEnum signatures, and its connected components.

Texts are sets of hashed word n-grams; equal sets are one class, told apart by 128 bits of hash. Sets are put into bands
of similar sizes; a band's group also takes the sets just below it that can still be similar to one of its own. In a
group, similar sets differ in at most ``k`` elements. The domain of elements is dealt into parts, and each part into
three. Of ``k // 2 + 1 + m`` parts of the first level, at least ``m + 1`` are such that the two sets differ in no more
than one element there; so in each of them two of the three parts of the second level are the same in both. The
subsets of two are enumerated: a signature is the hash of a set's elements in one of them, three for a part. So similar
sets share signatures of ``m + 1`` parts, and up to ``m`` parts of a set can be passed over: those with a subset in
which it has nothing, and those with a signature that many sets have.

Sets that share a signature of a small group are paired, and pairs with enough common signatures are verified. What
is left are sets with common signatures in more than ``m`` parts: large clusters of near copies. They are first verified
against the leaders of their groups; then those outside the largest component of a group are compared with all such sets
of similar sizes, in blocks, by an inverted index. So all links between components are found, though pairs within a
cluster are not listed.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import parquet
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_rows, shared_dir, ship, struct_of, written
from .warc import _place

#: Groups of a signature up to this size are paired.
SMALL_GROUP = 24
BROADCAST_ROWS = 200_000
#: Elements of the sets that a block of the last comparison holds.
BLOCK_ELEMENTS = 1_000_000
NO_KEY = -(1 << 63)
#: Bits of a signature that tell its part, up to which parts are counted; of more parts signatures are counted instead.
PART_BITS = 16

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def shingles(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of the n-grams of words, ASCII letters in lower case; a text with fewer
    words is one n-gram, one without words has none. The words of all texts are one array."""
    words = [(t or b"").lower().split() for t in texts]
    sizes = list(map(len, words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, sum(sizes))
    out, at = [], 0
    with np.errstate(over="ignore"):
        total = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for k in range(n):
            total = total * _A + h[k : k + len(total)]
        total = mixed(total)
        for size in sizes:
            if size >= n:
                x = np.sort(total[at : at + size - n + 1])
                new = np.empty(len(x), bool)
                new[0] = True
                np.not_equal(x[1:], x[:-1], out=new[1:])
                x = x[new]
            else:
                x = np.full(min(size, 1), size, np.uint64)
                for w in h[at : at + size]:
                    x = x * _A + w
                x = mixed(x)
            out.append(x)
            at += size
    return out


class Groups:
    """The size bands and, for each, ``k``, ``m`` and the number of parts of the first level."""

    def __init__(self, percent: int, bands: int = 64):
        self.percent, self.low, self.high = percent, [], []
        low = 1
        for _ in range(bands):
            self.low.append(low)
            self.high.append(max(low, low * 10_000 // percent**2))
            low = self.high[-1] + 1
        self.k = [(100 - percent) * 2 * h // (100 + percent) for h in self.high]
        self.m = [k // 5 + 2 for k in self.k]
        self.parts = [k // 2 + 1 + m for k, m in zip(self.k, self.m)]

    def of(self, size: int) -> list[int]:
        own = int(np.searchsorted(self.low, size, side="right")) - 1
        after = [own + 1] if own + 1 < len(self.low) and 100 * size >= self.percent * self.low[own + 1] else []
        return [g for g in [own, *after] if self.k[g] > 0]  # with k = 0 only equal sets are similar

    def signatures(self, x: np.ndarray, sums: bool = True) -> tuple[list[np.ndarray], list[int]]:
        """The signatures, the group in their last six bits and the part in the PART_BITS before, and (group, parts that
        may be passed over, whether empty subsets are entered too) in turn, alone without ``sums``."""
        out, spare = [], []
        with np.errstate(over="ignore"):
            hashed = mixed(x * _B + _A)
            third, high = hashed % np.uint64(3), x >> np.uint64(11)
            for g in self.of(len(x)):
                parts = self.parts[g]
                cell = (high % np.uint64(parts) * np.uint64(3) + third).astype(np.int64)
                some = np.bincount(cell, minlength=3 * parts).reshape(parts, 3)
                some = some.sum(axis=1, keepdims=True) - some > 0  # all but one
                empty = parts - int(some.all(axis=1).sum())
                all_parts = empty > self.m[g]
                spare += [g, self.m[g] if all_parts else self.m[g] - empty, int(all_parts)]
                if not sums:
                    continue
                total = np.zeros(3 * parts, np.uint64)
                np.add.at(total, cell, hashed)
                total = total.reshape(parts, 3)
                total = total.sum(axis=1, keepdims=True) - total
                which = np.arange(3 * parts) if all_parts else np.flatnonzero(some)
                sig = mixed(total.ravel()[which] + which.astype(np.uint64) * _A + np.uint64(g) * _B)
                place = (which // 3).astype(np.uint64) & np.uint64((1 << PART_BITS) - 1)
                out.append((sig >> np.uint64(PART_BITS + 6) << np.uint64(PART_BITS + 6)) | (place << np.uint64(6)) | np.uint64(g))
        return out, spare


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest member of each vertex's component, from edges (a, b), by alternating large and small
    stars, each round written to the shared folder."""
    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    old = mark(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(least.select("u", F.col("m").alias("v")))
        now = written(small.distinct(), "edges")
        new = mark(now)
        if new == old:
            break
        old = new
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).union(now.select("v", F.col("v").alias("root")).distinct())


def class_of(x: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set: the first one is its address, both tell it apart."""
    h = xxhash.xxh3_128_intdigest(x.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def renamed(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """``rows`` (c, c2, ...) without c2; where different classes have the same address, it is made anew from both."""
    out = rows.join(F.broadcast(clashes), ["c", "c2"], "left")  # some 10 rows among 10**10 classes
    return out.withColumn("c", F.when(F.col("clash"), F.xxhash64("c", "c2")).otherwise(F.col("c"))).drop("c2", "clash")


def similar(a: str, b: str, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= percent * (F.size(a) + F.size(b) - both)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """Rows (``key``, n_shingles, class_id, component_id) of every whole text; keys are whole numbers. ``component_id`` is the smallest key that
    links of ``percent`` or more reach, itself included; ``class_id`` tells equal sets apart.

    A text without words, or null, has no set and is linked with nothing. Null keys take part but are never a
    component's name unless it has no other; repeated keys are one document if their texts' sets are equal, and take
    the component of their own row otherwise.
    """
    return linked(docs, key, text, n, percent).drop("text_hash", "root")


def linked(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """The rows of ``near_duplicates`` with the text's ``text_hash`` and the ``root`` of its component, which unlike
    ``component_id`` is never null, if the text has words, nor that of two components."""
    spark = docs.sparkSession
    groups = Groups(percent)
    ship(spark)
    described = "d long, h long, n long, c long, c2 long, spare array<int>"
    entered = "sig long, c long, c2 long"
    arrow, arrow_entered = to_arrow_schema(struct_of(described)), to_arrow_schema(struct_of(entered))

    def describe(batches):
        seen: set[tuple] = set()  # classes of this task: what they may pass over leaves it once
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows: list[tuple] = []
                d, h, t = (c.to_pylist() for c in batch.slice(start, 512).columns)
                for d, h, x in zip(d, h, shingles(t, n)):
                    c = class_of(x) if len(x) else (None, None)
                    rows.append((d, h, len(x), *c, [] if c[0] is None or c in seen else groups.signatures(x, False)[1]))
                    seen.add(c)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    def sign(batches):
        seen: set[tuple] = set()  # their signatures too
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                sigs, names = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
                for x in shingles(batch.column(0).slice(start, 256).to_pylist(), n):
                    if len(x) and (c := class_of(x)) not in seen:
                        seen.add(c)
                        sigs += groups.signatures(x)[0]
                        names.append(np.tile(np.array([c], np.int64), (sum(map(len, sigs[len(sigs) - len(groups.of(len(x))) :])), 1)))
                columns = [np.concatenate(sigs).view(np.int64), *np.concatenate(names).T.copy()]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow_entered)], schema=arrow_entered)

    body = F.col(text).cast("binary")
    base = written(docs.select(F.col(key).cast("long"), F.xxhash64(text), body).mapInArrow(describe, described), "base")
    clashes = base.filter("c is not null").groupBy("c").agg(F.min("c2").alias("a"), F.max("c2").alias("b")).filter("a != b").select("c")
    clashes = base.join(F.broadcast(clashes), "c", "left_semi").select("c", "c2", F.lit(True).alias("clash")).distinct()
    clashes = written(clashes, "clashes")
    base = renamed(base, clashes)
    classes = base.filter("c is not null").groupBy("c").agg(F.min("d").alias("rep"), F.count("*").alias("rows"), F.max(F.when(F.size("spare") > 0, F.col("spare"))).alias("spare"))
    classes = written(classes, "classes")

    # Who shares a signature: one row for a class and signature, the size of the group and its smallest class.
    # Most signatures are of one class alone. They go first, in the order of signatures, which are sorted as longs;
    # only what is left is ordered by class too.
    by = Window.partitionBy("sig").orderBy("c")
    whole = Window.partitionBy("sig")
    # Signatures are made from the texts again instead of being kept: they would be larger than the texts.
    entry = docs.select(body).mapInArrow(sign, entered)
    entry = entry.drop("c2") if clashes.isEmpty() else renamed(entry, clashes)
    entry = entry.select("sig", "c", F.min("c").over(whole).alias("lead"), F.max("c").over(whole).alias("last")).filter("lead != last")
    entry = entry.withColumn("again", F.lag("c").over(by) == F.col("c")).filter(~F.coalesce("again", F.lit(False)))
    entry = entry.select("sig", "c", F.count("*").over(whole).alias("size"), "lead")
    entry = written(entry.withColumn("g", F.col("sig").bitwiseAND(F.lit(63)).cast("int")), "entries")
    small, large = entry.filter(F.col("size") <= SMALL_GROUP), entry.filter(F.col("size") > SMALL_GROUP)

    # How many parts each class may pass over, and whether common signatures are more than that.
    spare = classes.select("c", F.expr("inline(transform(sequence(0, size(spare) div 3 - 1), i -> struct(spare[3 * i] as g, spare[3 * i + 1] as spare, spare[3 * i + 2] = 1 as full)))"))
    part = F.shiftrightunsigned("sig", 6).bitwiseAND(F.lit((1 << PART_BITS) - 1))
    few_parts = F.col("g") < next((g for g, n in enumerate(groups.parts) if n > 1 << PART_BITS), len(groups.parts))
    common = large.groupBy("c", "g", F.when(few_parts, part).otherwise(F.col("sig")).alias("part")).count().groupBy("c", "g").agg(F.count("*").alias("common"))
    own = spare.join(entry.select("c", "g").distinct(), ["c", "g"]).join(common, ["c", "g"], "left").select("c", "g", "full", (F.col("spare") - F.coalesce("common", F.lit(0))).alias("room"), F.col("common").isNotNull().alias("crowded"))
    own = written(own, "room")
    # A set that enters its empty parts has no such bound against one that does not: any common signature will do.
    hot = own.filter("room < 0 or full and crowded").select("c", "g")

    a, b = small.select("sig", "g", F.col("c").alias("a")), small.select("sig", F.col("c").alias("b"))
    pairs = a.join(b, "sig").filter("a < b").groupBy("a", "b", "g").agg(F.count("*").alias("shared"))
    # They have signatures of m + 1 parts in common, less those that either passes over: more than the larger room is missing.
    # The room of a set with all subsets does not tell of empty ones that only the other passes over, so there the other's
    # counts.
    room = lambda c: own.select(F.col("c").alias(c), "g", F.col("room").alias(f"r{c}"), F.col("full").alias(f"f{c}"))
    pairs = pairs.join(room("a"), ["a", "g"]).join(room("b"), ["b", "g"])
    least = F.when(F.col("fa") == F.col("fb"), F.greatest("ra", "rb")).otherwise(F.when(F.col("fa"), F.col("rb")).otherwise(F.col("ra")))
    pairs = pairs.filter(F.col("shared") > least).groupBy("a", "b").agg(F.max("shared").alias("shared"))
    hot_entry = written(large.join(hot, ["c", "g"]).select("sig", "c", "lead"), "hot")
    star = hot_entry.filter("c != lead").groupBy(F.col("lead").alias("a"), F.col("c").alias("b")).agg(F.count("*").alias("shared"))
    best = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    star = star.withColumn("at", F.row_number().over(best)).filter("at <= 3").drop("at")
    pairs = written(pairs.unionByName(star), "pairs")

    sets_path = f"{shared_dir(spark)}/sets"
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).union(hot_entry.select("c")).distinct()
    wanted = written(classes.join(wanted, "c").select("c", F.coalesce("rep", F.lit(NO_KEY)).alias("rep")), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    some = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("rep"), body.alias("t"))
    some = some.join(F.broadcast(wanted.select("rep").distinct()) if few else wanted.select("rep").distinct(), "rep", "left_semi")

    def again(texts: list) -> list[list]:
        found = shingles(texts, n)
        return [*map(list, zip(*map(class_of, found))), [x.view(np.int64) for x in found]] if found else [[], [], []]

    sets = renamed(map_rows(some, [F.col("t")], again, "c long, c2 long, x array<long>"), clashes).join(F.broadcast(wanted.select("c")) if few else wanted.select("c"), "c", "left_semi")
    sets.dropDuplicates(["c"]).write.parquet(sets_path)
    sets = spark.read.schema("c long, x array<long>").parquet(sets_path)

    def verified(p: DataFrame, *give: str) -> DataFrame:
        """Of the pairs (a, b) that are similar, the columns ``give``, each pair of values once."""
        p = p.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
        return written(p.filter(similar("xa", "xb", percent)).select(F.col(give[0]).alias("a"), F.col(give[1]).alias("b")).distinct(), "links")

    # The most similar partner of each class first; of the other pairs only those that would join components.
    ranked = written(pairs.withColumn("at", F.row_number().over(best)), "ranked")
    links = verified(ranked.filter("at = 1"), "a", "b")
    joined = components(links)

    def with_root(p: DataFrame, c: str, name: str) -> DataFrame:
        return p.join(joined.select(F.col("v").alias(c), F.col("root").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))

    rest = with_root(with_root(ranked.filter("at > 1").select("a", "b"), "a", "ra"), "b", "rb").filter("ra != rb")
    rest = written(rest.select("a", "b", "ra", "rb"), "rest")
    if rest.count():  # a link joins components, so it is their roots that it is kept by
        links = links.unionByName(verified(rest, "ra", "rb"))
        joined = components(links)
    if hot_entry.count():
        more = _outliers(spark, with_root(hot_entry, "c", "root"), sets, sets_path, percent)
        if more.count():
            joined = components(links.unionByName(more))

    named = with_root(classes.select("c", "rep", "rows"), "c", "root")
    names = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = written(named.join(names, "root").select("c", "root", "component", "rows"), "named")
    total = base.count()
    # Classes of many rows are few, as their rows add up to no more than all: they are broadcast, so that no task gets
    # all copies of one text. Their rows go into the other join by a hash of their own.
    many = named.filter(F.col("rows") >= max(16, total // 50_000)).select(F.col("c").alias("mc"), F.col("component").alias("many"), F.col("root").alias("many_root"))
    out = base.select("d", "h", "n", "c").join(F.broadcast(many), F.col("c") == F.col("mc"), "left")
    out = out.withColumn("jc", F.when(F.col("many_root").isNotNull() | F.col("c").isNull(), F.xxhash64("d", "n")).otherwise(F.col("c")))
    out = out.join(named.select(F.col("c").alias("jc"), "root", "component"), "jc", "left")
    component = F.when(F.col("c").isNull(), F.col("d")).otherwise(F.coalesce("many", "component", "d"))
    root = F.when(F.col("c").isNotNull(), F.coalesce("many_root", "root"))
    return out.select(F.col("d").alias(key), F.col("n").alias("n_shingles"), F.col("c").alias("class_id"), component.alias("component_id"), F.col("h").alias("text_hash"), root.alias("root"))


def _outliers(spark, entries: DataFrame, sets: DataFrame, sets_path: str, percent: int) -> DataFrame:
    """Pairs (a, b) of components, by their roots, that a link joins: every class of ``entries`` (sig, c, root) outside
    the largest component of one of its groups, against all classes of ``entries``."""
    counts = entries.groupBy("sig", "root").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("n"), "root"))
    minor = counts.withColumn("at", rank).filter("at > 1").select("sig", "root")
    minor = entries.join(minor, ["sig", "root"]).select("c").distinct()
    path = f"{shared_dir(spark)}/outliers"
    members = written(sets.join(entries.select("c", "root").distinct(), "c").select("c", "root", "x", F.size("x").alias("n")), "members")
    elements, rows = members.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tasks = max(8, spark.sparkContext.defaultParallelism * 2, elements // (4 * BLOCK_ELEMENTS), rows // 20_000)
    members.join(minor, "c", "left_semi").repartitionByRange(tasks, "n").write.parquet(path)
    sizes = spark.read.schema(members.schema).parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("n"), F.max("n"))
    files = [tuple(r) for r in sizes.collect()]  # a row a task
    schema = "a long, b long"
    arrow = to_arrow_schema(struct_of(schema))

    def blocks(low: int, high: int):
        store, _ = _place(path)
        held: list[tuple] = []
        size = 0
        for name, least, most in files:
            if 100 * most < percent * low or 100 * high < percent * least:
                continue  # no size in it is similar to one from low to high
            _, at = _place(name)
            with store.open_input_file(at) as f:
                for batch in parquet.ParquetFile(f).iter_batches(512, columns=["c", "root", "x"]):
                    for c, root, x in zip(*(y.to_pylist() for y in batch.columns)):
                        held.append((c, root, np.array(x, np.int64)))
                        size += len(x)
                        if size >= BLOCK_ELEMENTS:
                            yield held
                            held, size = [], 0
        if held:
            yield held

    def compare(batches):
        parent: dict[int, int] = {}  # of the links that this task has found those that join components

        def find(r: int) -> int:
            while (p := parent.get(r, r)) != r:
                parent[r] = r = parent.get(p, p)
            return r

        for batch in batches:
            rows = [(c, root, np.array(x, np.int64)) for c, root, x in zip(*(y.to_pylist() for y in batch.select(["c", "root", "x"]).columns))]
            found: list[tuple] = []
            for block in blocks(min(len(x) for *_, x in rows), max(len(x) for *_, x in rows)):
                # An inverted index of the block: its elements in order, and whose they are.
                element = np.concatenate([x for _, _, x in block])
                whose = np.repeat(np.arange(len(block)), [len(x) for _, _, x in block])
                by = np.argsort(element, kind="stable")
                element, whose = element[by], whose[by]
                sizes = np.array([len(x) for _, _, x in block])
                roots = np.array([r for _, r, _ in block])
                for _, root, x in rows:
                    low, high = np.searchsorted(element, x, "left"), np.searchsorted(element, x, "right")
                    n = high - low
                    at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
                    both = np.bincount(whose[at], minlength=len(block))
                    ok = (100 * both >= percent * (sizes + len(x) - both)) & (roots != root)
                    for r in set(roots[ok].tolist()):
                        if (p := find(root)) != (q := find(r)):
                            parent[max(p, q)] = min(p, q)
                            found.append((root, r))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(y, f.type) for y, f in zip(zip(*found), arrow)], schema=arrow)

    return written(members.repartitionByRange(tasks, "n").mapInArrow(compare, schema).distinct(), "more")


def brute_force(rows: list[tuple[int, str | None]], n: int = 4, percent: int = 85) -> dict[int, tuple[int, int]]:
    """{key: (n_shingles, component_id)} from real n-grams and all pairs that share one; for tests."""
    sets: dict[int, frozenset] = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(d: int) -> int:
        while parent[d] != d:
            parent[d] = d = parent[parent[d]]
        return d

    first: dict[frozenset, int] = {}
    where: dict[tuple, list[int]] = {}
    for d in sorted(sets):
        x = sets[d]
        if not x:
            continue
        if x in first:
            parent[find(d)] = find(first[x])
            continue
        first[x] = d
        counts: dict[int, int] = {}
        for s in x:
            for e in where.setdefault(s, []):
                counts[e] = counts.get(e, 0) + 1
            where[s].append(d)
        for e, both in counts.items():
            if 100 * both >= percent * (len(x) + len(sets[e]) - both) and find(d) != find(e):
                lo, hi = sorted((find(d), find(e)))
                parent[hi] = lo
    for d in sets:
        parent[d] = find(d)
    least: dict[int, int] = {}
    for d, r in parent.items():
        least[r] = min(least.get(r, d), d)
    return {d: (len(sets[d]), least[parent[d]]) for d in sets}
