"""What built-in functions cannot express: line diffs, strict JSON and canonical JSON. Arrow-batched."""

from __future__ import annotations

import difflib
import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def _fields(kind, *names: str) -> StructType:
    return StructType([StructField(n, kind) for n in names])


@F.pandas_udf(_fields(IntegerType(), "added", "deleted", "replaced"))
def line_diff_counts(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Lines added, deleted and replaced; a replacement counts in all three, by its longer side in the third. A null
    counts as the text ``nan``."""
    rows = []
    for a, b in zip(old, new):
        a, b = ("nan" if x is None else x for x in (a, b))
        added = deleted = replaced = 0
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a.splitlines(), b.splitlines(), autojunk=False).get_opcodes():
            if tag != "equal":
                deleted, added = deleted + j - i, added + m - k
                replaced += max(j - i, m - k) if tag == "replace" else 0
        rows.append((added, deleted, replaced))
    return pd.DataFrame(rows, columns=["added", "deleted", "replaced"])


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff of two states, named ``S_t`` and ``S_t+1``; empty where nothing changed."""
    return pd.Series(["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), "S_t", "S_t+1")) for a, b in zip(old, new)], dtype=object)


@F.pandas_udf(StructType([StructField("items", ArrayType(StringType())), StructField("reason", StringType())]))
def strict_json_list(text: pd.Series) -> pd.DataFrame:
    """Items of a JSON list as texts, or why it is none, by a strict parser: nothing may follow the list."""
    rows = []
    for t in text:
        if t is None:
            rows.append((None, "missing"))
            continue
        try:
            v = json.loads(t)
        except ValueError as e:
            rows.append((None, f"malformed: {type(e).__name__}"))
            continue
        ok = isinstance(v, list)
        rows.append(([x if isinstance(x, str) else json.dumps(x) for x in v], None) if ok else (None, f"expected list, found {type(v).__name__}"))
    return pd.DataFrame(rows, columns=["items", "reason"])


def canonical(value) -> str:
    """Sorted keys, no spaces, characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else canonical(json.loads(t)) for t in text], dtype=object)


@F.pandas_udf(_fields(StringType(), "stated", "computed"))
def packet_hash(text: pd.Series) -> pd.DataFrame:
    """The hash that a JSON packet states in ``packet_sha256`` and that of its canonical form without this key."""
    rows = []
    for t in text:
        packet = json.loads(t)
        stated = packet.pop("packet_sha256", None)
        rows.append((stated, hashlib.sha256(canonical(packet).encode()).hexdigest()))
    return pd.DataFrame(rows, columns=["stated", "computed"])
