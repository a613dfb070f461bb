"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a block of texts are laid out as one chain of byte symbols. An inverted index holds, for each
rank, the places where a pair of neighbours would merge into the token of that rank. Ranks are applied in order, each
at all its places; only the neighbours of a merged pair are looked at again. The result equals encoding every piece
alone, as pieces never touch; a block bounds the memory and is of no influence on the ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Pieces remembered by a task before it starts afresh with those of its block, and the longest piece that is remembered.
CACHE_PIECES, CACHE_CHARS = 200_000, 64


#: Texts of characters below this one are split by the standard library's quicker matcher.
LOW = "\u0250"


high = re.compile(f"[^\x00-{chr(ord(LOW) - 1)}]").search


def low_pattern(pattern: str):
    """``findall`` of the standard library for ``pattern`` over characters below LOW: the three classes that it lacks
    or reads otherwise are written out. None if the pattern has other escapes."""
    if regex.search(r"\\(?![psS])|\\p(?!\{[LN]\})", pattern):
        return None
    has = lambda c: "".join(f"\\x{i:02x}" if i < 256 else f"\\u{i:04x}" for i in range(ord(LOW)) if regex.match(c, chr(i)))
    letters, numbers, spaces = has(r"\p{L}"), has(r"\p{N}"), has(r"\s")
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\S", f"[^{spaces}]")
    return re.compile(pattern.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]")).findall


class Vocabulary:
    """Ranks of a tiktoken file: ``tokens`` by rank, and the rank that each mergeable pair of ranks makes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.find_any, self.find_low = regex.compile(pattern).findall, low_pattern(pattern)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.text = {r: str(r) for r in self.tokens}
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.by_rank = range(max(self.tokens) + 1)
        self.shift = max(self.tokens).bit_length()
        get = self.ranks.get
        self.pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << self.shift | b] = rank
        self.known: dict[str, tuple[int, ...]] = {}

    def replay(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece. Within a piece the lowest rank merges first and leftmost first, as tiktoken does."""
        single, symbols, starts = self.single, [-1], []  # -1: a wall before, between and after the pieces
        for p in pieces:
            starts.append(len(symbols))
            symbols += [single[c] for c in p.encode("utf-8", "surrogatepass")]
            symbols.append(-1)
        n, pair, shift, top = len(symbols), self.pairs.get, self.shift, len(self.by_rank)
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: list[list[int] | None] = [None] * top
        a = -1
        for i, b in enumerate(symbols):
            if a >= 0 <= b and (x := pair(a << shift | b)) is not None:
                if (places := index[x]) is None:
                    index[x] = [i - 1]
                else:
                    places.append(i - 1)
            a = b
        rank = 0
        while rank < top:
            if (now := index[rank]) is None:
                rank += 1
                continue
            index[rank], lowest = None, rank
            now.sort()
            for at, i in enumerate(now):
                if (a := symbols[i]) < 0 or (b := symbols[j := follow[i]]) < 0 or pair(a << shift | b) != rank:
                    continue  # a neighbour merged meanwhile
                symbols[i], symbols[j] = rank, -2
                k, h = follow[j], before[i]
                follow[i], before[k] = k, i
                if (c := symbols[k]) >= 0 and (x := pair(rank << shift | c)) is not None:
                    if (places := index[x]) is None:
                        index[x] = [i]
                    else:
                        places.append(i)
                    if x < lowest:
                        lowest = x
                if (c := symbols[h]) >= 0 and (x := pair(c << shift | rank)) is not None:
                    if (places := index[x]) is None:
                        index[x] = [h]
                    else:
                        places.append(h)
                    if x < lowest:
                        lowest = x
                if lowest < rank:  # that pair comes first; the other places wait for their turn
                    index[rank] = (index[rank] or []) + now[at + 1 :] or None
                    rank = lowest
                    break
        out = []
        for start in starts:
            ids, i = [], start
            while (c := symbols[i]) != -1:
                ids.append(c)
                i = follow[i]
            out.append(tuple(ids))
        return out

    def split(self, text: str) -> list[str]:
        return (self.find_low if self.find_low and not high(text) else self.find_any)(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        known = self.known
        new = {p for pieces in split for p in pieces if p not in known}
        if len(known) + len(new) > CACHE_PIECES:  # the frequent ones are in this block too
            here = {p: known[p] for pieces in split for p in pieces if p in known}
            known.clear()
            known.update(here)
        new = sorted(new)
        known.update(zip(new, self.replay(new)))
        out = [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in split]
        for p in new:
            if len(p) > CACHE_CHARS:
                del known[p]
        return out

    def forget(self) -> None:
        """Workers stay when a task has ended, beside other stages; they keep the vocabulary, but no pieces."""
        self.known.clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary, read once a process; ``path`` names a file that every executor has."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Vocabulary(path, pattern)
    return _loaded[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Rows (``key``, ids array<int>, n_tokens, ids_sha256, decoded_sha256, round_trip) of every row's whole text.

    A null text counts as empty: no ids, the hashes of nothing. Null and repeated keys are kept as they are. Other
    columns are not read. ``ids=False`` leaves the array out. ``round_trip``: the decoded bytes are those of the text.
    """

    def run(keys: list, texts: list) -> list[list]:
        v = vocabulary(path, pattern)
        texts = [t or "" for t in texts]
        coded = v.encode(texts)
        decoded = [v.decode(x) for x in coded]
        named = v.text.__getitem__
        out = [
            [len(x) for x in coded],
            [hashlib.sha256(" ".join(map(named, x)).encode()).hexdigest() for x in coded],
            [hashlib.sha256(x).hexdigest() for x in decoded],
            [d == t.encode("utf-8", "surrogatepass") for d, t in zip(decoded, texts)],
        ]
        return [keys, *([coded] if ids else []), *out]

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {'ids array<int>, ' if ids else ''}n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return map_rows(df, [F.col(key), F.col(text)], run, schema, rows=512, done=lambda: vocabulary(path, pattern).forget())


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (``key``, text string) from arrays of ids; a null array gives an empty text.

    Ids may end within a character when they were cut: such bytes become U+FFFD.
    """

    def run(keys: list, arrays: list) -> list[list]:
        v = vocabulary(path, pattern)
        return [keys, [v.decode(x or []).decode("utf-8", "replace") for x in arrays]]

    return map_rows(df, [F.col(key), F.col(ids)], run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
