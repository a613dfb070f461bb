"""Quality rules with suffix-array repetition.

The words of a block of texts become numbers and their suffixes are sorted by prefix doubling, each text for itself;
only suffixes that are still tied go into the next round. Longest common prefixes of neighbours come from the ranks of
the rounds. The deepest longest-common-prefix interval around a suffix is the longest string that starts there and
occurs elsewhere in its text; the union of these spans is the union of all maximal repeated substrings' spans. A text
fails if that union covers too much of it, or if one repeated string is too long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words sorted together; a longer text is a block of its own.
BLOCK_WORDS = 200_000


@dataclass(frozen=True)
class Limits:
    """``min_words``, ``window`` and ``max_repeat_percent`` are the base rule. Of the method: repeats of at least
    ``min_repeat`` words count, they may cover ``max_covered`` of the words, and the longest may have ``max_longest``
    words or ``max_longest_share`` of the words, whichever is more."""

    min_words: int = 50
    window: int = 3
    max_repeat_percent: int = 50
    min_repeat: int = 6
    max_covered: float = 0.4
    max_longest: int = 120
    max_longest_share: float = 0.25


def longest_repeats(ids: np.ndarray, text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest string of words that starts there and also starts elsewhere in the
    same text. ``ids``: numbers of words; ``text``: the text of each place, rising; ``end``: where its text ends."""
    n = len(ids)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    levels = [np.unique(text * (int(ids.max()) + 1) + ids, return_inverse=True)[1].ravel().astype(np.int64)]
    order = np.argsort(levels[0], kind="stable")
    tied = _tied(levels[0][order])
    active, step = order[tied], 1  # suffixes that share their first words with another, in sorted order
    while len(active):
        old = levels[-1]
        beyond = active + step
        inside = beyond < end[active]
        second = np.where(inside, old[np.minimum(beyond, n - 1)] + 1, 0)
        key = old[active] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        # A group keeps its first rank and its parts follow within the room that it has.
        new_key = np.r_[True, key[1:] != key[:-1]]
        group = old[active]
        new_group = np.r_[True, group[1:] != group[:-1]]
        at = np.arange(len(active))
        first_of_key = np.maximum.accumulate(np.where(new_key, at, 0))
        first_of_group = np.maximum.accumulate(np.where(new_group, at, 0))
        rank = old.copy() if step > 1 else _spread(old, order)
        base = rank[active]
        rank[active] = base + (first_of_key - first_of_group)
        levels.append(rank)
        still = _tied(key)
        active, step = active[still], step * 2
    # Suffixes in order, and the common prefixes of neighbours by the levels from the longest down.
    order = np.argsort(levels[-1] if len(levels) > 1 else _spread(levels[0], order), kind="stable")
    a, b = order[:-1], order[1:]
    same = levels[0][a] == levels[0][b]
    a, b = a[same], b[same]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < end[a]) & (y < end[b])
        ok &= levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]
        # Equal ranks at level k mean 2**k equal words; ranks of places that were never tied there are their own.
        common += np.where(ok, 1 << k, 0)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def _tied(sorted_keys: np.ndarray) -> np.ndarray:
    same = sorted_keys[1:] == sorted_keys[:-1]
    return np.r_[same, False] | np.r_[False, same]


def _spread(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Dense ranks as the first place of their group in the sorted order, which leaves room for its parts."""
    sorted_rank = rank[order]
    first = np.maximum.accumulate(np.where(np.r_[True, sorted_rank[1:] != sorted_rank[:-1]], np.arange(len(rank)), 0))
    out = np.empty_like(rank)
    out[order] = first
    return out


def covered(lengths: np.ndarray, text: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Which places lie in the union of the spans that start where ``lengths`` is at least ``least``; each span is
    ``width`` long, or as long as the repeat."""
    n = len(lengths)
    starts = np.flatnonzero(lengths >= least)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + (lengths[starts] if width is None else width), -1)
    return np.cumsum(change[:-1]) > 0


def measure(texts: list[bytes], limits: Limits) -> list[tuple]:
    """(n_words, n_repeat_words, n_covered, longest) of each text."""
    out: list[tuple] = []
    block: list[list[bytes]] = []
    size = 0
    for t in texts:
        words = t.split()
        if block and size + len(words) > BLOCK_WORDS:
            out += _measure(block, limits)
            block, size = [], 0
        block.append(words)
        size += len(words)
    return out + (_measure(block, limits) if block else [])


def _measure(block: list[list[bytes]], limits: Limits) -> list[tuple]:
    number: dict[bytes, int] = {}
    put = number.setdefault
    ids = np.fromiter((put(w, len(number)) for words in block for w in words), np.int64)
    sizes = np.array([len(w) for w in block])
    stops = np.cumsum(sizes)
    text = np.repeat(np.arange(len(block)), sizes)
    end = np.repeat(stops, sizes)
    lengths = longest_repeats(ids, text, end)
    count = lambda mask: np.bincount(text[mask], minlength=len(block)).tolist()
    repeat = count(covered(lengths, text, limits.window, limits.window))
    cover = count(covered(lengths, text, limits.min_repeat))
    longest = np.zeros(len(block), np.int64)
    np.maximum.at(longest, text, lengths)
    return list(zip(sizes.tolist(), repeat, cover, longest.tolist()))


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits(), extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (``key``, ``extra`` columns, measures, base_failed, kept) of every whole text.

    A null text counts as empty; an empty text has no words and fails. Null and repeated keys stay. Words are runs of
    bytes other than ASCII white space, and all lengths of repeats are in words.
    """

    def run(keys: list, texts: list, *rest: list) -> list[list]:
        texts = [t or "" for t in texts]
        found = measure([t.encode("utf-8", "surrogatepass") for t in texts], limits)
        n_words, repeat, cover, longest = ([x[k] for x in found] for k in range(4))
        failed = [n < limits.min_words or 100 * r > limits.max_repeat_percent * n for n, r in zip(n_words, repeat)]
        good = [c <= limits.max_covered * n and g <= max(limits.max_longest, limits.max_longest_share * n) for n, c, g in zip(n_words, cover, longest)]
        return [
            keys, *rest, n_words,
            [len(t) - sum(t.count(c) for c in SPACE) for t in texts],
            [sum(t.count(c) for c in SYMBOLS) for t in texts],
            [dup_lines(t) for t in texts],
            repeat, failed, [g and not f for g, f in zip(good, failed)], cover, longest,
        ]

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in (key, *extra))
    schema = kinds + "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
    return map_rows(df, [F.col(key), F.col(text), *(F.col(c) for c in extra)], run, schema)


def quality_filter(df: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``df``, all columns, whose whole text passes the rules; what is said of ``quality_rules`` holds."""
    from .common import ship

    ship(df.sparkSession)
    names = df.columns
    at = names.index(text)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(at).to_pylist()]
                keep = [
                    n >= limits.min_words and 100 * r <= limits.max_repeat_percent * n
                    and c <= limits.max_covered * n and g <= max(limits.max_longest, limits.max_longest_share * n)
                    for n, r, c, g in measure(texts, limits)
                ]
                if any(keep):
                    yield part.filter(_mask(keep))

    return df.mapInArrow(run, df.schema)


def _mask(keep: list[bool]):
    import pyarrow as pa

    return pa.array(keep, pa.bool_())
