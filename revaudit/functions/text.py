"""Text and value functions as Column expressions; all stay inside the JVM.

White space is Python's: ASCII control characters 0x1c-0x1f, U+0085 and every Unicode separator count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must be equal to these for equal results.
HASH_SALT = "revground-codestream-stage45-v1"
SPLIT_SEED = "revground-problem-split-v1"
LANGUAGE_ALIASES = {"c++": "C++", "cpp": "C++", "gnu c++": "C++", "c": "C", "java": "Java"}
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"(?U)\b\w+(?:[-']\w+)*\b"
SENTENCE = r"(?s).+?(?:[.!?](?=\s|$)|$)"
COMPOSITE = r"(?i)(?:\balso\b|;|\bwhile\b|\band no\b|\band each\b|\bfirst\b.*\bthen\b)"
IMPERATIVE = r"(?i)^(compile|check|focus|review|reassess|inspect|ensure|verify|replace|move|remove|confirm|address)\b"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sha256_text(x: str | Column, missing: str = "nan") -> Column:
    """Hex SHA-256; a null counts as the text ``missing``."""
    return F.sha2(F.coalesce(col(x).cast("string"), F.lit(missing)), 256)


def pseudonym(user: str | Column, salt: str = HASH_SALT) -> Column:
    return F.substring(sha256_text(F.concat(F.lit(f"{salt}|"), F.coalesce(col(user).cast("string"), F.lit("nan")))), 1, 16)


def composite_key(*parts: str | Column, length: int | None = None) -> Column:
    """Hash of the parts joined by ``|``; nulls count as ``nan``, unlike in ``concat_ws``, which would skip them."""
    texts = [F.coalesce(col(p).cast("string"), F.lit("nan")) for p in parts]
    key = F.sha2(F.array_join(F.array(*texts), "|"), 256)
    return F.substring(key, 1, length) if length else key


def normalize_language(x: str | Column) -> Column:
    bare, out = F.lower(F.trim(col(x))), F.trim(col(x))
    for alias, name in LANGUAGE_ALIASES.items():
        out = F.when(bare == alias, name).otherwise(out)
    return out


def normalize_code(x: str | Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(col(x), f"{WHITE}+", "")


def problem_tokens(x: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(x)), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_problem_text(x: str | Column) -> Column:
    return F.array_join(problem_tokens(x), " ")


def missing_token(x: str | Column, tokens: tuple[str, ...] = NA_TOKENS) -> Column:
    """Null where the text is one of the tokens that stand for a missing value."""
    return F.when(~col(x).isin(*tokens), col(x))


def as_bool(x: str | Column) -> Column:
    """true/1/yes and false/0/no in any case; anything else, null included, is an error."""
    bare = F.lower(F.trim(col(x).cast("string")))
    bad = F.raise_error(F.concat(F.lit("invalid boolean: "), F.coalesce(col(x).cast("string"), F.lit("null")))).cast("boolean")
    return F.when(bare.isin("true", "1", "yes"), True).when(bare.isin("false", "0", "no"), False).otherwise(bad)


def word_count(x: str | Column) -> Column:
    return F.regexp_count(col(x), F.lit(WORD))


def strip(x: str | Column) -> Column:
    return F.regexp_replace(col(x), f"^{WHITE}+|{WHITE}+$", "")


def focal_claim(x: str | Column) -> Column:
    """(start, end, text, kind): the first sentence, or the second if the first is an instruction without a colon.

    Offsets are in code points. ``kind`` is ``composite`` where several assertions are joined, ``none`` without text.
    """
    text = col(x)
    found = F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: strip(s) != "")
    first, second = strip(F.get(found, F.lit(0))), strip(F.get(found, F.lit(1)))
    take_second = first.rlike(IMPERATIVE) & (F.instr(first, ":") == 0) & (F.size(found) > 1)
    claim = F.when(take_second, second).otherwise(first)
    skip = F.when(take_second, F.instr(text, first) - 1 + F.length(first)).otherwise(F.lit(0))
    start = F.when(claim.isNull(), 0).otherwise(skip + F.instr(F.substring(text, skip + 1, F.length(text)), claim) - 1)
    kind = F.when(claim.isNull(), "none").when(claim.rlike(COMPOSITE), "composite").otherwise("diagnostic")
    return F.struct(start.cast("int").alias("start"), (start + F.coalesce(F.length(claim), F.lit(0))).cast("int").alias("end"), claim.alias("text"), kind.alias("kind"))


def span_matches(text: str | Column, start: str | Column, end: str | Column, claim: str | Column) -> Column:
    return F.coalesce(F.substring(col(text), col(start) + 1, col(end) - col(start)) == col(claim), F.lit(False))


def normalize_output(x: str | Column) -> Column:
    return F.regexp_replace(F.replace(col(x), F.lit("\r\n"), F.lit("\n")), f"{WHITE}+$", "")


def process_status(returncode: str | Column, stdout: str | Column, expected: str | Column, ran: str | Column | None = None, infra: str | Column | None = None) -> Column:
    """PASS or FAIL of a program that ended well, PROGRAM_TIMEOUT for code 124, else RUNTIME_ERROR; before these
    NOT_RUN_COMPILE_ERROR where it did not run and INFRA_TIMEOUT where the host gave up."""
    same = F.coalesce(normalize_output(stdout) == normalize_output(expected), F.lit(False))
    out = F.when(col(returncode) == 0, F.when(same, "PASS").otherwise("FAIL")).when(col(returncode) == 124, "PROGRAM_TIMEOUT").otherwise("RUNTIME_ERROR")
    if infra is not None:
        out = F.when(col(infra), "INFRA_TIMEOUT").otherwise(out)
    return F.when(~col(ran), "NOT_RUN_COMPILE_ERROR").otherwise(out) if ran is not None else out


# Statuses of test evidence.
TEST_STATUSES = ("PASS", "FAIL", "PROGRAM_TIMEOUT", "RUNTIME_ERROR", "INFRA_TIMEOUT", "NOT_RUN_COMPILE_ERROR")
RUNTIME_ERRORS = {
    "INFRA_TIMEOUT": "host timeout while waiting for locked-down container",
    "PROGRAM_TIMEOUT": "student program exceeded the in-container execution limit",
    "NOT_RUN_COMPILE_ERROR": "not run because compilation failed",
}


def test_status(status: str | Column, code: str | Column, match: str | Column) -> Column:
    """Legacy statuses as the explicit ones; an unknown status is an error."""
    s = col(status)
    ended = F.when(col(code) == 0, F.when(F.coalesce(col(match), F.lit(False)), "PASS").otherwise("FAIL")).when(col(code) == 124, "PROGRAM_TIMEOUT").otherwise("RUNTIME_ERROR")
    return (
        F.when(s.isin(*TEST_STATUSES), s)
        .when(s == "host_timeout", "INFRA_TIMEOUT")
        .when(s.isin("completed", "compile_or_runtime_failure"), ended)
        .otherwise(F.raise_error(F.concat(F.lit("unknown test status: "), F.coalesce(s, F.lit("null")))))
    )


def runtime_error(status: str | Column, stderr: str | Column, code: str | Column) -> Column:
    s = col(status)
    out = F.when(s == "RUNTIME_ERROR", F.coalesce(F.nullif(strip(stderr), F.lit("")), F.concat(F.lit("non-zero process exit code: "), F.coalesce(col(code).cast("string"), F.lit("None")))))
    for name, text in RUNTIME_ERRORS.items():
        out = F.when(s == name, text).otherwise(out)
    return out


def joined(x: str | Column) -> Column:
    """A list as one value of a flat file."""
    return F.array_join(col(x), "|")


def first_text(*fields: str | Column) -> Column:
    """The first field that is neither null nor empty."""
    return F.coalesce(*(F.nullif(col(f), F.lit("")) for f in fields))


def divide(a: str | Column, b: str | Column) -> Column:
    """``a / b``; null where ``b`` is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def percent(a: str | Column, b: str | Column) -> Column:
    """``100 * a / b``, not rounded; 0 where ``b`` is zero."""
    return F.coalesce(F.try_divide(col(a).cast("double") * 100, col(b).cast("double")), F.lit(0.0))


def wilson(k: str | Column, n: str | Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The 95% Wilson interval, within 0 and 1; nulls for no trials."""
    k, n = col(k).cast("double"), F.nullif(col(n).cast("double"), F.lit(0.0))
    p, zz = k / n, F.lit(z * z)
    den = 1 + zz / n
    center, half = (p + zz / (2 * n)) / den, F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / den
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), center - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), center + half))


def array_last(x: str | Column) -> Column:
    return F.try_element_at(col(x), F.lit(-1))


def array_length(x: str | Column) -> Column:
    return F.when(col(x).isNotNull(), F.size(col(x)))


def json_list(x: str | Column, item: str = "string") -> Column:
    return F.from_json(col(x), f"array<{item}>")


def json_list_reason(x: str | Column) -> Column:
    """Why a text is no JSON list: ``missing``, ``malformed`` or ``expected list, found ...``; null for a list.

    The parser is lenient: it takes text after the end of a list. Where that matters use ``udfs.strict_json_list``.
    """
    v = F.try_parse_json(col(x))
    kind = F.schema_of_variant(v)
    name = F.when(kind.startswith("OBJECT"), "dict").when(kind == "STRING", "str").when(kind == "BIGINT", "int").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "NoneType").otherwise("float")
    return F.when(col(x).isNull(), "missing").when(v.isNull(), "malformed").when(~kind.startswith("ARRAY"), F.concat(F.lit("expected list, found "), name))


def items_have_keys(x: str | Column, keys: list[str]) -> Column:
    """Whether each object of a JSON list has all keys."""
    maps = F.from_json(col(x), "array<map<string,string>>")
    return F.coalesce(F.forall(maps, lambda m: F.forall(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(m, k))), F.lit(False))


def key_patterns(x: str | Column) -> Column:
    """The distinct sorted key lists of a JSON list's objects, as one text."""
    maps = F.from_json(col(x), "array<map<string,string>>")
    each = F.transform(maps, lambda m: F.array_join(F.array_sort(F.map_keys(m)), "|"))
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(each)), ";"), F.lit(""))
