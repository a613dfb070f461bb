"""Toxicity scores by a counterfactual-regularised linear classifier.

Features are hashed words and character n-grams that occur in a text, at least once, whatever its length. The model is
a logistic regression over the features that tell the labels apart best. For labelled texts that name a group of
people, counterfactuals are made by swapping the identity term with others of its kind; the loss penalises the squared
difference between the scores of a text and of its counterfactuals, so that a group's name alone can't make a text
toxic.

A corpus need not have the names that are listed here. So a labelled text without one is a template: a term is put
between two of its words, at a place that its checksum decides, and the differences between this sentence and those with
the others of its kind are penalised. So no weight may hang on which group a text names, whichever text it stands in.

The fit uses a bounded sample of labelled rows; features are counted and selected and scores made on the executors. The
driver holds the selected features, the weights, and the sample's occurrences of those features only.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, ship, written

#: Terms of one kind can stand for each other. Single words, lower case.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "transgender", "bisexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "refugiados", "extranjeros"),
)


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled rows at most that the fit sees; ``features``: selected ones; ``least``: texts
    that a feature occurs in; ``chi``: least chi-square of a feature; ``bits``: of the hash;
    ``grams``: lengths of character n-grams; ``penalty``: of score differences; ``ridge``: of weights; ``swaps``: of a
    term at most; ``insert``: whether texts without a term are templates."""

    sample: int = 20_000
    features: int = 3_000
    bits: int = 20
    grams: tuple[int, ...] = (5, 7)
    least: int = 3
    chi: float = 25.0
    penalty: float = 4.0
    ridge: float = 0.3
    steps: int = 600
    swaps: int = 3
    terms: tuple[tuple[str, ...], ...] = field(default=IDENTITY_TERMS)
    insert: bool = True


_BASE = np.uint64(0x9E3779B97F4A7C15)
_word, _word_sub = re.compile(r"\w+").finditer, re.compile(r"\w+").sub


def hashed(text: str, s: Settings) -> np.ndarray:
    """Hash buckets of all words and character n-grams of the lower-cased text, repeats included. N-grams are taken
    over word characters, with other characters as one space between words."""
    words = [m.group() for m in _word(text.lower())]
    if not words:
        return np.zeros(0, np.int64)
    x = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    shift = np.uint64(64 - s.bits)
    out = []
    with np.errstate(over="ignore"):
        mixed = (x + np.uint64(1)) * _BASE
        mixed ^= mixed >> np.uint64(29)
        for n in s.grams:
            if len(x) >= n:
                h = np.zeros(len(x) - n + 1, np.uint64)
                for k in range(n):
                    h = h * np.uint64(0x100000001B3) + mixed[k : k + len(h)]
                out.append(((h ^ np.uint64(n)) * _BASE) >> shift)
        # A word is the sum over its characters, weighted by their places: prefix sums give all words at once.
        blank = np.flatnonzero(x == 32)
        place = np.arange(len(x)) - np.repeat(blank, np.diff(np.r_[blank, len(x)]))
        sums = np.r_[np.uint64(0), np.cumsum(mixed * (_POWERS[place % len(_POWERS)]), dtype=np.uint64)]
        out.append(((sums[blank[1:]] - sums[blank[:-1] + 1]) * _BASE) >> shift)
    return np.concatenate(out).astype(np.int64)


with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(4096, 0x5851F42D4C957F2D, np.uint64), dtype=np.uint64)


@lru_cache(4)
def places(terms: tuple[tuple[str, ...], ...]) -> dict[str, tuple[int, int]]:
    """(kind, number) of each term; of a term in several kinds the last one counts."""
    return {t: (k, i) for k, kind in enumerate(terms) for i, t in enumerate(kind)}


def counterfactuals(text: str, s: Settings) -> list[str]:
    """The text with every identity term replaced by the next, second next, ... of its kind; none if it has no term."""
    kinds = places(s.terms)
    if not any(m.group() in kinds for m in _word(text.lower())):
        return []

    def swapped(by: int) -> str:
        def other(m: re.Match) -> str:
            k, i = kinds.get(m.group().lower(), (-1, 0))
            return m.group() if k < 0 else s.terms[k][(i + by) % len(s.terms[k])]

        return _word_sub(other, text)

    out = {swapped(by): None for by in range(1, s.swaps + 1)}
    out.pop(text, None)
    return list(out)


def mentioning(text: str, s: Settings) -> str:
    """The text with an identity term between two of its words; which one and where its checksum decides. A text that has
    a term, or no words, stays as it is."""
    found = list(_word(text))
    if not found or any(m.group().lower() in places(s.terms) for m in found):
        return text
    h = zlib.crc32(text.encode("utf-8", "replace"))
    kind = s.terms[h % len(s.terms)]
    at = found[(h >> 8) % len(found)].end()
    return f"{text[:at]} {kind[(h >> 4) % len(kind)]}{text[at:]}"


@dataclass
class Model:
    """``column``: for each hash bucket its place in ``weights``, 0 where it has none; ``weights[0]`` is the bias;
    ``n_counterfactuals``: those that the fit saw."""

    settings: Settings
    column: np.ndarray
    weights: np.ndarray
    n_counterfactuals: int = 0

    def active(self, text: str | None) -> np.ndarray:
        found = self.column[hashed(text or "", self.settings)]
        return np.unique(found[found > 0])

    def score(self, text: str | None) -> float:
        z = float(self.weights[0] + self.weights[self.active(text)].sum())
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, swapped: list[tuple[np.ndarray, np.ndarray]], width: int, s: Settings) -> np.ndarray:
    """Weights, the bias first, of the regularised logistic regression. ``rows``: features of each text; ``swapped``:
    of each counterfactual the features that it loses and those that it gains, as only what differs counts.
    Accelerated gradient steps from zero: the same every time."""

    def flat(groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(groups), dtype=np.int32), [len(g) for g in groups]), np.concatenate([*groups, np.zeros(0, np.int32)]).astype(np.int32)

    n, m = len(rows), len(swapped)
    at, col = flat(rows)
    lost, won = [x for x, _ in swapped], [x for _, x in swapped]
    (at_lost, col_lost), (at_won, col_won) = flat(lost), flat(won)
    # Steps from a bound of the curvature, row sums of absolute values, so that they cannot overshoot.
    size = np.array([len(g) + 1.0 for g in rows])
    change = np.array([len(a) + len(b) for a, b in zip(lost, won)], float)
    bound = 0.25 * np.bincount(col, size[at], width) + s.ridge + 1e-9
    bound += 2 * s.penalty * (np.bincount(col_lost, change[at_lost], width) + np.bincount(col_won, change[at_won], width))
    bound[0] = 0.25 * size.sum() + 1e-9
    w, old = np.zeros(width), np.zeros(width)
    for k in range(s.steps if n else 0):
        v = w + (w - old) * (k / (k + 3))  # accelerated
        z = v[0] + np.bincount(at, v[col], n)
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        grad = np.bincount(col, error[at], width)
        grad[0] = error.sum()
        if m:
            gap = np.bincount(at_lost, v[col_lost], m) - np.bincount(at_won, v[col_won], m)
            grad += 2 * s.penalty * (np.bincount(col_lost, gap[at_lost], width) - np.bincount(col_won, gap[at_won], width))
        grad[1:] += s.ridge * v[1:]
        old, w = w, v - grad / bound
    return w


def telling(n: int, n_positive: int) -> str:
    """Chi-square of the presence of what ``seen`` rows have, ``positive`` ones among them, against the labels."""
    a, b = "cast(positive as double)", "cast(seen - positive as double)"
    c, d = f"({n_positive} - {a})", f"({n - n_positive} - {b})"
    return f"{n} * power({a} * {d} - {b} * {c}, 2) / greatest(({a} + {b}) * ({c} + {d}) * ({a} + {c}) * ({b} + {d}), 1e-9)"


def fit(texts: DataFrame, s: Settings) -> Model:
    """Fit on ``texts`` (text, toxic), which must be bounded; counts and features are made on the executors."""
    ship(texts.sparkSession)

    def count(batches):
        seen, positive = np.zeros(1 << s.bits, np.int32), np.zeros(1 << s.bits, np.int32)
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u = np.unique(hashed(t or "", s))
                seen[u] += 1
                if y:
                    positive[u] += 1
        u = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int32()), pa.array(positive[u]), pa.array(seen[u])], ["bucket", "positive", "seen"])

    n, n_positive = (int(x) for x in texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first())
    counts = texts.mapInArrow(count, "bucket int, positive int, seen int").groupBy("bucket").agg(F.sum("positive").alias("positive"), F.sum("seen").alias("seen"))
    counts = counts.filter(F.col("seen") >= s.least).withColumn("chi", F.expr(telling(n, n_positive))).filter(F.col("chi") > s.chi)
    best = counts.orderBy(F.desc("chi"), "bucket").limit(s.features).select("bucket").collect()  # s.features rows at most
    chosen = np.array(sorted(r.bucket for r in best), np.int64)
    column = np.zeros(1 << s.bits, np.int16)
    column[chosen] = np.arange(1, len(chosen) + 1)
    model = Model(s, column, np.zeros(len(chosen) + 1))

    def features(ids: list, texts: list, labels: list) -> list[list]:
        own = [model.active(t) for t in texts]
        named = [mentioning(t or "", s) if s.insert else t or "" for t in texts]
        first = [model.active(x) for x in named]
        other = [[model.active(x) for x in counterfactuals(t, s)] for t in named]
        packed = lambda groups: [np.concatenate([[len(g), *g] for g in gs] or [[]]).astype(np.int16).tobytes() for gs in groups]
        lost = [[np.setdiff1d(x, y) for y in ys] for x, ys in zip(first, other)]
        won = [[np.setdiff1d(y, x) for y in ys] for x, ys in zip(first, other)]
        return [ids, labels, packed([x] for x in own), packed(lost), packed(won)]

    def unpacked(x: bytes) -> list[np.ndarray]:
        groups, at, x = [], 0, np.frombuffer(x, np.int16)
        while at < len(x):
            groups.append(x[at + 1 : at + 1 + x[at]])
            at += 1 + x[at]
        return groups

    kept = map_rows(texts, [F.xxhash64("text"), F.col("text"), F.col("toxic")], features, "id long, toxic int, own binary, lost binary, won binary")
    rows = sorted((r.id, r.toxic, bytes(r.own), bytes(r.lost), bytes(r.won)) for r in kept.collect())  # the sample's: a bounded number
    swapped = [x for r in rows for x in zip(unpacked(r[3]), unpacked(r[4]))]
    model.n_counterfactuals = len(swapped)
    swapped = [x for x in swapped if len(x[0]) + len(x[1])]
    model.weights = fit_weights([unpacked(r[2])[0] for r in rows], np.array([r[1] for r in rows], float), swapped, len(chosen) + 1, s)
    return model


def held_out(key):
    """Rows that no label is learnt from: a fifth of the keys, by their text's checksum."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, s: Settings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, toxic) of ``s.sample`` labelled rows at most that aren't held out, those with the least hash of the key.

    Rows without a label or key are out; a key with several labels counts as toxic if one of them says so. Rows with
    the same key and text are one; a key of many different texts is as many rows, up to ``s.sample`` in all.
    """
    own = labels.filter(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    own = own.groupBy(F.col(key).alias("k")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.orderBy(F.xxhash64("k"), "k").limit(s.sample)
    joined = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(own), "k")  # s.sample keys at most
    joined = joined.groupBy("k", "toxic", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    some = joined.orderBy(F.xxhash64("k"), "k", "h").limit(s.sample).select("text", "toxic")
    return written(some.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, F.xxhash64("text")), "sample")  # a limit is one partition


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (``key``, held_out, score, predicted, n_terms) of every whole text, the last one the number of words in it
    that are swapped in counterfactuals. A null or empty text has the score of no features at all; null and repeated
    keys stay; only the text is an input of the score."""
    kinds = places(model.settings.terms)

    def run(keys: list, held: list, texts: list) -> list[list]:
        scores = [model.score(t) for t in texts]
        terms = [sum(m.group() in kinds for m in _word((t or "").lower())) for t in texts]
        return [keys, held, scores, [int(x >= 0.5) for x in scores], terms]

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int, n_terms long"
    return map_rows(docs, [F.col(key), held_out(key), F.col(text)], run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    return score(docs, fit(sample(docs, labels, settings, key, text), settings), key, text)


def is_held_out(key) -> bool:
    return zlib.crc32(str("" if key is None else key).encode()) % 5 == 0
