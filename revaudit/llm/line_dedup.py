"""Near-duplicate lines by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words. Equal lines are one class, told apart by 128 bits of hash; its first line stands for it.
Each class's words are ordered by rarity, and two sets whose Jaccard similarity reaches the threshold share one of their
first words (prefix filter; the smaller set of a pair needs the shorter prefix). Sets that share one are a candidate if
their sizes allow the similarity (length filter), if what follows the shared word can make up the overlap (positional
filter), and if 128 parity bits of the words do not differ in more places than similar sets can. Candidates are verified
on the whole sets, the likeliest partner first; a line goes if an earlier line matches it.

Rarity is the number of occurrences in the whole corpus, counted in 2**18 to 2**22 hashed counters, so that the order is of
a bounded size whatever the vocabulary; any fixed order gives exact results. It reaches the plans as the value of a scalar
subquery. Words of many occurrences are too common to be a key: they are one with each of the next words, of which one is
the second word in common. A set with a key that many sets share all the same, as near copies and phrases do, enters
neighbours in its order as twos instead. Differing words can part only so many twos, so one of the first ones is common
to any two similar sets. Sets that share a two that is common as well are compared with the earliest one of them, which
settles clusters of near copies without pairing them all; only lines that no match has removed meet the others.

Near copies are many lines with many words in common, whose pairs grow with the square of their number. So lines with the
same smallest hashes, or the same largest ones, are first compared with the earliest such line, verified, and marked when
they go, if 128 parity bits of both allow it. Two marked lines are no candidate. Lines that these few hashes miss are found as all others are.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, release, scratch, written

MIN_BITS, MAX_BITS = 18, 22
#: Sets that share a key are paired at once up to this number.
SMALL_GROUP = 512
#: Words of more occurrences than this are a key only together with another word.
COMMON_WORD = 512
#: Sets of more classes than this are paired in so many bands of sizes, one after the other, so that the entries of a part
#: of them are on the disks at a time.
BAND_ROWS = 50_000
BANDS = 3
#: Lists of this many rows at most are broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The same for lists of one or two longs a row.
BROADCAST_LONGS = 1_000_000
#: As many smallest or largest hashes of a set are a key of the first comparison.
ENDS = 3


def row_of(key: str, text: str) -> list[Column]:
    """(d, th, tc): what a row is told by: its key and two hashes of its text."""
    return [F.col(key).alias("d"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit(1), text).alias("tc")]


def lines_of(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(d, th, tc, i, l, c, h, n, b0, b1): document and number of each line; two hashes that tell its text, in lower case,
    apart; the set of its words as hashes in order, their number, and their parity bits; all null for a line of less than
    ``least`` words. Texts are read but here: words repeat, so a table of them with dictionaries is smaller than the texts."""
    # Texts are hashed and split before lines come out, once a text and not once a line.
    cut = docs.filter(F.col(text).isNotNull()).select(*row_of(key, text), F.split(F.lower(text), "\n").alias("cut"))
    cut = cut.select("d", "th", "tc", F.posexplode("cut").alias("i", "line"))
    long = is_long(F.col("line"), least)
    words = F.sort_array(F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w))))
    out = cut.select("d", "th", "tc", "i", F.when(long, F.xxhash64("line")).alias("l"), F.when(long, F.xxhash64(F.lit(1), "line")).alias("c"), F.when(long, words).alias("h"))
    out = parity(out, "d", "th", "tc", "i", "l", "c", "h")
    return written(out, "lines", {"parquet.dictionary.page.size": 1 << 23})


def is_long(line: Column, least: int) -> Column:
    """Whether a line has ``least`` words or more, which its spaces tell, and something in them."""
    some = F.ltrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""
    return some if least <= 1 else some & (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= least - 1)


def earlier() -> Column:
    """Order of lines: by document key, nulls last, then by text and line number."""
    return F.struct(F.col("d").isNull().alias("n"), "d", "th", "tc", "i")


def counters(lines: DataFrame, bits: int) -> DataFrame:
    """One row: ``rarity``, for each of 2**bits hashed counters a number up to 127 that rises with the logarithm of its
    words' occurrences."""
    found = lines.select(F.explode("h").alias("w")).groupBy(F.expr(f"w & {(1 << bits) - 1}").alias("k")).agg(F.count("*").alias("n"))
    found = lines.sparkSession.range(1 << bits).join(found, F.col("id") == F.col("k"), "left")
    level = F.expr("cast(least(127, floor(4 * log2(1 + coalesce(n, 0)))) as tinyint)").alias("r")
    # Pieces of the table are put together in many tasks; they are 4,096 numbers each, 1,024 pieces at most.
    piece = F.transform(F.array_sort(F.collect_list(F.struct("id", level))), lambda x: x["r"]).alias("piece")
    found = found.groupBy(F.expr("id div 4096").alias("at")).agg(piece)
    table = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]))
    return written(found.agg(table.alias("rarity")), "rarity")


def counter_bits(lines: int) -> int:
    """Bits of the counters' numbers, for 64 words or fewer a counter where lines have 40 words: words that share a counter
    with many others would all look frequent."""
    return min(MAX_BITS, max(MIN_BITS, ceil(log2(1 + 40 * lines / 64))))


def sets_of(lines: DataFrame, wanted: DataFrame, *more: str) -> DataFrame:
    """(l, c, first, h, *more) of the classes ``wanted`` (l, c, first), each once."""
    rows = wanted.count()
    if BROADCAST_ROWS < rows <= BROADCAST_LONGS:  # the others' words need no shuffle
        lines = lines.join(F.broadcast(wanted.select("l").distinct()), "l", "left_semi")
    wanted = F.broadcast(wanted) if rows <= BROADCAST_ROWS else wanted
    found = lines.join(wanted, ["l", "c"]).filter(F.col("first") == earlier())
    return found.groupBy("l", "c", "first").agg(*(F.first(x).alias(x) for x in ("h", *more)))


def parity(sets: DataFrame, *keep: str) -> DataFrame:
    """(*keep, n, b0, b1): number of the longs ``h``, in order, and for each of 128 numbers whether an odd number of them
    have it: b0 of the negative ones, b1 of the others, so each is looked at but once."""
    sets = sets.select(*keep, F.size("h").alias("n"), F.expr("array_position(sort_array(array_append(h, 0L)), 0L)").cast("int").alias("_z"))
    odd = "aggregate(slice(h, {}), 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))"
    return sets.selectExpr(*keep, "n", f"{odd.format('1, _z - 1')} as b0", f"{odd.format('_z, n')} as b1")


def by_rarity(sets: DataFrame, rarity: DataFrame, bits: int, *keep: str) -> DataFrame:
    """(*keep, s): the words ``h`` as longs, rarest first: seven bits of rarity above 56 bits of hash."""
    # Spark sorts longs as such only where its types say that none is null.
    code = f"shiftleft(cast(coalesce(_table[cast(x & {(1 << bits) - 1} as int)], 0Y) as bigint), 56) | shiftrightunsigned(coalesce(x, 0L), 8)"
    out = sets.select(*keep, "h", rarity.select("rarity").scalar().alias("_table"))
    return out.select(*keep, F.expr(f"sort_array(transform(h, x -> {code}))").alias("s"))


def alike(percent: int, positions: bool = False) -> str:
    """Of two different entries ``a`` and ``b``, whether they pass the filters, and with ``positions`` also whether b is
    the smaller set, so that a pair is met but once. Sets of x and y words have ``percent * (x + y) / (100 + percent)`` or
    more in common if they are similar. Words that only one of them has are as many as differing parity bits, or more;
    with ``positions``, the words from the shared one on, ``n - p`` of each, must be as many as they have in common."""
    smaller = "(b.n < a.n or a.n = b.n and b.l < a.l)"
    if positions:  # 100 * n - (100 + percent) * p of one, at least percent * n of the other: the length filter too
        sizes = "a.u >= b.v and b.u >= a.v"
    else:
        sizes = f"least(a.n, b.n) * 100 >= {percent} * greatest(a.n, b.n)"
        smaller = "a.l != b.l"
    return f"{sizes} and {smaller} and {100 + percent} * (bit_count(a.b0 ^ b.b0) + bit_count(a.b1 ^ b.b1)) <= {100 - percent} * (a.n + b.n)"


def candidate(a: str = "a", b: str = "b") -> list[Column]:
    """(la, lb, apart) of two structs: their addresses in order and the number of parity bits that differ."""
    apart = f"cast(bit_count({a}.b0 ^ {b}.b0) + bit_count({a}.b1 ^ {b}.b1) as int) as apart"
    return [F.expr(f"least({a}.l, {b}.l) as la"), F.expr(f"greatest({a}.l, {b}.l) as lb"), F.expr(apart)]


def bands(classes: DataFrame, percent: int) -> list[tuple[int, int]]:
    """Bounds (over, up to) of sizes of sets, with about equal numbers of first words between them; one pair of bounds for
    a small table. There are no more than some hundred different sizes in the logarithm that they are counted by."""
    top = 1 << 30
    found = classes.groupBy(F.expr("cast(floor(8 * log2(n)) as int)").alias("at")).agg(F.count("*").alias("rows"), F.sum(F.expr(f"n - ({percent} * n + 99) div 100 + 1")).alias("words"), F.max("n").alias("n"))
    found = sorted((r.n, r.words, r.rows) for r in found.collect())
    if sum(r for *_, r in found) <= BAND_ROWS:
        return [(0, top)]
    total, before, cuts = sum(w for _, w, _ in found), 0, []
    for n, w, _ in found[:-1]:
        before += w
        if before * BANDS >= total * (len(cuts) + 1):
            cuts.append(n)
    cuts = cuts[: BANDS - 1]
    return list(zip([0, *cuts], [*cuts, top]))


def by_words(once: DataFrame, rarity: DataFrame, bits: int, common: int, percent: int, over: int, upto: int) -> DataFrame:
    """(l, pair): candidates by their first words, each a ``pair`` (la, lb, apart), and without one the lines that have
    keys that are too common for it. The larger set of a pair has more than ``over`` words and ``upto`` at most.

    The first word in common is among the first ``k`` of each set, ``k = n - percent * n / 100 + 1``, and the second one,
    which all similar sets of two words and more have, is among the first ``k + 1``. The smaller set of a pair has fewer
    that it alone has, so those that can only be the smaller one here enter fewer. A word of more than ``COMMON_WORD``
    occurrences is a key with each word after it up to there, so groups don't grow with the table. Of a pair, one line at
    least is not ``marked``.
    """
    once = once.filter(f"n <= {upto} and 100 * n >= {percent} * {over + 1}")
    sets = by_rarity(once, rarity, bits, "l", "marked", "n", "b0", "b1")
    shorter = f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent}"
    sets = sets.select("l", "marked", "n", "b0", "b1", "s", F.expr(f"if(n > {over}, n - ({percent} * n + 99) div 100, {shorter}) + 1 as k"))
    usable = f"shiftrightunsigned(x, 56) < {common}"
    alone = "transform(slice(s, 1, k), (x, i) -> struct(i as p, x as t))"
    # The words after a common one; a line of one word has none and is told by it.
    after = "if(n = 1, array(struct(i as p, xxhash64(x) as t)), transform(slice(s, i + 2, k - i), y -> struct(i as p, xxhash64(x, y) as t)))"
    twos = f"flatten(transform(slice(s, 1, k), (x, i) -> if({usable}, array(struct(i as p, x as t)), {after})))"
    # The most frequent word of the first ones is the last.
    keys = f"if(shiftrightunsigned(get(s, k - 1), 56) < {common}, {alone}, {twos})"
    entry = sets.select("l", "marked", "n", "b0", "b1", F.inline(F.expr(keys))).filter("t is not null")
    entry = entry.selectExpr("t", "l", "shiftleft(cast(n as bigint), 21) | shiftleft(cast(marked as bigint), 20) | least(p, 1048575) as np", "b0", "b1")  # repeated lines too
    entry = entry.withColumn("size", F.count("*").over(Window.partitionBy("t")))
    entry = entry.selectExpr("*", "cast(shiftrightunsigned(np, 21) as int) as n", "np & 1048576 as m", "cast(np & 1048575 as int) as p").drop("np").filter("size > 1")
    # The first word in common passes the positional filter.
    entry = entry.selectExpr("t", "l", "m", "n", "p", f"100 * n - {100 + percent} * p as u", f"{percent} * n as v", "b0", "b1", "size")
    # The smaller set of a pair needs a shorter prefix than the larger one.
    few = entry.filter(f"size <= {SMALL_GROUP} and p <= {shorter}")
    large = entry.filter(f"n > {over} or size > {SMALL_GROUP}")
    pairs = large.alias("a").join(few.alias("b"), F.expr(f"a.t = b.t and a.m & b.m = 0 and {alike(percent, True)}"), "left")
    pairs = pairs.filter(f"b.l is not null or a.size > {SMALL_GROUP}")
    return written(pairs.select(F.col("a.l").alias("l"), F.when(F.col("b.l").isNotNull(), F.struct(*candidate())).alias("pair")), "candidates")


def by_ends(classes: DataFrame, percent: int) -> DataFrame:
    """(la, lb, apart): of the lines with the same first or last hashes, each with the earliest one, if their sizes and
    parity bits allow it."""
    found = []
    for end in ("k0", "k1"):  # one after the other, so that the keys of one are on the disks at a time
        keys = classes.select("l", "n", "b0", "b1", "first", F.col(end).alias("t"))
        lead = keys.groupBy("t").agg(F.min(F.struct("first", "l", "n", "b0", "b1")).alias("b"), F.count("*").alias("size")).filter("size > 1")
        both = keys.drop("first").join(lead.drop("size"), "t").select(F.struct("l", "n", "b0", "b1").alias("a"), "b")
        found.append(written(both.filter(alike(percent)).select(*candidate()), "ends"))
        release(classes.sparkSession)
    return written(found[0].unionByName(found[1]).distinct(), "ends")


def by_twos(lines: DataFrame, rarity: DataFrame, bits: int, percent: int) -> DataFrame:
    """Of ``lines`` (l, c, e, h, n, b0, b1), e its place, all (t, q, l, c, e, n, p, b0, b1, size, lead): the twos of neighbours that
    others have too, the two before each, how many others, and the earliest one of them.

    Two similar sets differ in so few words that fewer twos of their common words are parted by them than there are.
    The first one that isn't has at most so many twos before it as words that its set alone has, counted double, and
    words that only the other has: ``2 * n * (100 - percent) / 100`` at most.
    """
    sets = by_rarity(lines, rarity, bits, "l", "c", "e", "n", "b0", "b1")
    last = f"least(n - 2, {2 * (100 - percent)} * n div 100)"
    keys = F.expr(f"if(n = 1, array(xxhash64(s[0])), transform(sequence(0, cast(greatest(0, {last}) as int)), i -> xxhash64(get(s, i), get(s, i + 1))))")
    twos = sets.select("l", "c", "e", "n", "b0", "b1", keys.alias("k")).select("l", "c", "e", "n", "b0", "b1", "k", F.posexplode("k").alias("p", "t"))
    twos = written(twos.withColumn("q", F.expr("coalesce(get(k, p - 1), l)")).drop("k"), "twos")
    groups = twos.groupBy("t").agg(F.count("*").alias("size"), F.min(F.struct("e", "l", "n", "b0", "b1")).alias("lead")).filter("size > 1")
    return written(twos.join(groups, "t"), "shared")


def with_address(classes: DataFrame, addresses: DataFrame, rows: int) -> DataFrame:
    """(l, c, first) of the classes of ``addresses`` (l), of which there are not many more than ``rows``. A list of longs
    is broadcast also where Spark takes it for too long, so that classes need no shuffle for it."""
    return classes.join(F.broadcast(addresses) if rows <= BROADCAST_LONGS else addresses, "l", "left_semi").select("l", "c", "first")


def matches(lines: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, gone: DataFrame | None = None) -> DataFrame:
    """(l, c): of each candidate (la, lb, apart) whose sets are similar enough, the later class, unless it is ``gone``."""
    with scratch(lines.sparkSession, "gone"):
        ends = pairs.select(F.explode(F.array("la", "lb")).alias("l")).distinct()
        wanted = written(with_address(classes, ends, pairs.count()), "wanted")
        release(lines.sparkSession)
        a, b = (wanted.select(F.col("l").alias(f"l{x}"), F.col("c").alias(f"c{x}"), F.col("first").alias(f"f{x}")) for x in "ab")
        pairs = pairs.join(a, "la").join(b, "lb")
        later = F.col("fa") > F.col("fb")
        turned = [F.when(later, F.col(f"{x}a")).otherwise(F.col(f"{x}b")).alias(x) for x in "lc"] + [F.when(later, F.col(f"{x}b")).otherwise(F.col(f"{x}a")).alias(f"e{x}") for x in "lc"]
        pairs = pairs.select(*turned, "apart")
        pairs = written(pairs if gone is None else pairs.join(gone, ["l", "c"], "left_anti"), "ordered")
        release(lines.sparkSession)
        if gone is not None:  # words are read only for what there is to compare
            ends = pairs.select("l", "c").union(pairs.select("el", "ec")).distinct()
            wanted = written(wanted.join(ends, ["l", "c"], "left_semi"), "compared")
        sets = written(sets_of(lines, wanted), "sets")
        release(lines.sparkSession)

        def verified(p: DataFrame) -> DataFrame:
            p = written(p, "next")
            few = p.count() <= BROADCAST_LONGS
            # Only the sets of its own side are shuffled for each of the two joins.
            side = lambda l: sets.join(F.broadcast(p.select(F.col(l).alias("l")).distinct()), "l", "left_semi") if few else sets
            p = p.join(side("l").select("l", "c", F.col("h").alias("ha")), ["l", "c"])
            p = p.join(side("el").select(F.col("l").alias("el"), F.col("c").alias("ec"), F.col("h").alias("hb")), ["el", "ec"])
            same = F.size(F.array_intersect("ha", "hb"))
            out = written(p.filter(same * 100 >= percent * (F.size("ha") + F.size("hb") - same)).select("l", "c").distinct(), "gone")
            release(lines.sparkSession)
            return out

        best = pairs.groupBy("l", "c").agg(F.min(F.struct("apart", "el", "ec")).alias("x")).select("l", "c", "x.el", "x.ec")
        first = verified(best)
        return first.unionByName(verified(pairs.join(first, ["l", "c"], "left_anti").select("l", "c", "el", "ec")))


def removed_classes(lines: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(classes, removed) of ``lines_of``: every class of lines (l, c, its first line, rows), and those (l, c) that an
    earlier line matches."""
    bits = counter_bits(lines.count())
    lines = lines.filter("l is not null")
    rarity = counters(lines, bits)
    release(lines.sparkSession)
    ends = [F.expr(f"xxhash64({n}, slice(h, {at}, {ENDS}))").alias(f"k{n}") for n, at in ((0, "1"), (1, f"greatest(1, size(h) - {ENDS - 1})"))]
    of_class = [F.first(x).alias(x) for x in ("k0", "k1", "n", "b0", "b1")]
    classes = lines.select("l", "c", earlier().alias("first"), "n", "b0", "b1", *ends).groupBy("l", "c")
    classes = written(classes.agg(F.min("first").alias("first"), F.count("*").alias("rows"), *of_class), "classes")
    release(lines.sparkSession)
    with scratch(lines.sparkSession, "gone"):
        near = matches(lines, classes, by_ends(classes, percent), percent)
    release(lines.sparkSession)
    # The lines with the most copies are told apart here, so that each is entered but once; repeats of the others, which
    # are many lines with few copies each, are entered as they are.
    total, most = 0, 1
    for n, rows in sorted(classes.filter("rows > 1").groupBy(F.least("rows", F.lit(10_000)).alias("n")).count().collect(), reverse=True):
        if (total := total + rows) > BROADCAST_ROWS:
            most = n
            break
    hot = classes.filter(F.col("rows") > most).select("l", "c", "first")
    once = lines if most >= 10_000 else lines.join(F.broadcast(hot), ["l", "c"], "left").filter(F.col("first").isNull() | (F.col("first") == earlier()))
    # Where two classes have one address, the line of the other one is not marked, or once with and once without.
    mark = near.select("l", F.col("c").alias("mc"))
    once = once.join(F.broadcast(mark) if mark.count() <= BROADCAST_LONGS else mark, "l", "left")
    once = once.select("l", "h", "n", "b0", "b1", F.expr("coalesce(c = mc, false)").cast("int").alias("marked"))
    found = None
    for over, upto in bands(classes, percent):
        some = by_words(once, rarity, bits, int(4 * log2(1 + COMMON_WORD)), percent, over, upto)
        found = some if found is None else found.unionByName(some)
        release(lines.sparkSession)  # the entries, more than the texts where all sizes are entered at once
    alone = found.filter("pair is null").select("l").distinct()
    crowd = written(with_address(classes, alone, alone.count()), "crowd")
    release(lines.sparkSession)
    two = by_twos(sets_of(lines, crowd, "n", "b0", "b1").withColumnRenamed("first", "e"), rarity, bits, percent)
    few, many = two.filter(F.col("size") <= SMALL_GROUP).drop("lead"), two.filter(F.col("size") > SMALL_GROUP)
    # Pairs are told by the first of several twos in a row that they share.
    shorter = few.filter(f"p <= {3 * (100 - percent)} * n div {100 + percent}")
    close = shorter.alias("a").join(few.alias("b"), F.expr(f"a.t = b.t and a.q != b.q and (a.n < b.n or a.n = b.n and a.l < b.l) and {alike(percent)}")).select(*candidate())
    star = many.select(F.struct("l", "n", "b0", "b1").alias("a"), F.col("lead").alias("b")).filter(alike(percent)).select(*candidate())
    pairs = found.filter("pair is not null").select("pair.*").unionByName(close).unionByName(star)
    pairs = written(pairs.groupBy("la", "lb").agg(F.min("apart").alias("apart")), "pairs")
    release(lines.sparkSession)
    gone = near.unionByName(matches(lines, classes, pairs, percent, near))
    # Lines that are still there meet the others of their large groups.
    a, b = many.join(gone, ["l", "c"], "left_anti").alias("a"), many.alias("b")
    more = a.join(b, F.expr(f"a.t = b.t and b.e < a.e and b.l != a.lead.l and {alike(percent)}")).select(*candidate())
    more = written(more.groupBy("la", "lb").agg(F.min("apart").alias("apart")).join(pairs, ["la", "lb"], "left_anti"), "more")
    if not more.isEmpty():
        gone = gone.unionByName(matches(lines, classes, more, percent))
    return classes, written(gone.distinct(), "removed")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, least: int = 1) -> DataFrame:
    """``docs``, all rows and columns, with the text without the lines that an earlier line matches, and
    ``dropped_lines``, which takes the place of a column of that name.

    Lines stand between line feeds, words between single spaces; case does not count. All lines take part that hold
    more than white space; those that do not, and those of fewer than ``least`` words, stay. The order of lines is that
    of ``key``, nulls last, and of their place; rows of one key are ordered by a hash of their texts, and rows with
    equal key and text are one document. A null text stays null. ``percent`` is from 70 to 100.
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent must be from 70 to 100")
    d, th, tc, out, lines = (fresh(docs, x) for x in ("d", "th", "tc", "out", "lines"))
    with scratch(docs.sparkSession, "change"):
        all_lines = lines_of(docs, key, text, least)
        classes, gone = removed_classes(all_lines, percent)
        # For each document the numbers of the lines that go, as bits of one long for 64 lines.
        word, bit, none = F.expr("i div 64").alias("w"), F.expr("shiftleft(1L, i % 64)"), F.lit(0).cast("long")
        have = all_lines.select("d", "th", "tc", word, F.when(F.col("l").isNotNull(), bit).otherwise(none).alias("long"), none.alias("kept"))
        kept = classes.join(gone, ["l", "c"], "left_anti").select("first.*").select("d", "th", "tc", word, none.alias("long"), bit.alias("kept"))
        both = have.unionByName(kept).groupBy("d", "th", "tc", "w").agg(F.expr("bit_or(long) & ~bit_or(kept)").alias("out"))
        change = both.groupBy("d", "th", "tc").agg(F.bit_or("out").alias("some"), F.array_sort(F.collect_list(F.struct("w", "out"))).alias("out"))
        change = written(change.filter("some != 0").select(F.col("d").alias(d), F.col("th").alias(th), F.col("tc").alias(tc), F.col("out.out").alias(out)), "change")
    few = change.agg(F.count("*") + F.coalesce(F.sum(F.size(out)), F.lit(0))).first()[0] <= 2 * BROADCAST_ROWS
    own = [F.col(key).eqNullSafe(F.col(d)), F.xxhash64(text) == F.col(th), F.xxhash64(F.lit(1), text) == F.col(tc)]
    rows = docs.join(F.broadcast(change) if few else change, own[0] & own[1] & own[2], "left")
    stays = lambda x, i: F.getbit(F.get(F.col(out), F.floor(i / 64).cast("int")), i % 64) == 0
    rows = rows.withColumn(lines, F.when(F.col(out).isNotNull(), F.filter(F.split(text, "\n"), stays)))
    new = F.when(F.col(out).isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))
    dropped = F.when(F.col(out).isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n")) - F.size(lines)).cast("long")
    return rows.select(*(new.alias(c) if c == text else F.col(c) for c in docs.columns if c != "dropped_lines"), dropped.alias("dropped_lines"))
