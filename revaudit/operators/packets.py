"""Nested evidence packets: construction, projection, validation and key walks.

Numbers in packets are whole, so that canonical JSON is ``to_json`` of structs with sorted fields.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import col

# Keys that must not occur anywhere in evidence, and statuses that are not final.
FORBIDDEN_FIELDS = (
    "a01_label", "a02_label", "adjudicated_gold", "adjudicated_answer", "expected_answer", "expected_lifecycle",
    "predicted_label", "system_prediction", "annotator_1", "annotator_2",
)
FORBIDDEN_PREFIX = "^(a01|a02)"
UNFINISHED = ("pending", "running", "queued", "in_progress", "unknown", "not_started")
ID_KEYS = ("evidence_id", "official_evidence_id")


def source_id(item: Column, state: str) -> Column:
    return F.concat(F.lit("source:"), item, F.lit(f":{state}"))


def evidence_ids(item: Column) -> dict[str, Column]:
    """The fixed evidence ids of an item."""
    return {
        "earlier_source": source_id(item, "S_t"), "later_source": source_id(item, "S_t+1"), "diff": F.concat(F.lit("diff:"), item),
        "earlier_trace": F.concat(F.lit("stored_trace:"), item, F.lit(":S_t")), "later_trace": F.concat(F.lit("stored_trace:"), item, F.lit(":S_t+1")),
        "earlier_compile": F.concat(F.lit("execution:"), item, F.lit(":st:compile")), "later_compile": F.concat(F.lit("execution:"), item, F.lit(":st1:compile")),
    }


def official_tests(cases: str | Column, problem: str | Column) -> Column:
    """A problem's test cases in the order of their whole numbers, each with its official id."""
    ordered = F.array_sort(col(cases), lambda a, b: F.when(a.test_case_no.cast("int") < b.test_case_no.cast("int"), -1).when(a.test_case_no.cast("int") > b.test_case_no.cast("int"), 1).otherwise(0))
    name = lambda t: F.concat(col(problem).cast("string"), F.lit("_T"), t.test_case_no.cast("string"))
    return F.transform(ordered, lambda t: F.struct(name(t).alias("test_case_id"), F.concat(F.lit("official_test:"), name(t)).alias("official_evidence_id"), t.input.alias("input"), t.output.alias("expected_output")))


def build(df: DataFrame, item: str, problem: str, statement: str, earlier: str, later: str, claim: str, tests: str) -> DataFrame:
    """Packets before any run: sources with hashes, the claim, tests that are NOT_REPLAYED, and all evidence ids."""
    i, ids = F.col(item), evidence_ids(F.col(item))
    run = lambda state, t: F.struct(F.concat(F.lit("execution:"), i, F.lit(f":{state}:"), t.test_case_id).alias("evidence_id"), F.lit("NOT_REPLAYED").alias("status"))
    full = F.transform(tests, lambda t: F.struct(t.test_case_id.alias("test_case_id"), t.official_evidence_id.alias("official_evidence_id"), t.input.alias("input"), t.expected_output.alias("expected_output"), run("st", t).alias("earlier"), run("st1", t).alias("later")))
    own = F.concat(F.array(*ids.values()), F.transform(full, lambda t: t.official_evidence_id), F.transform(full, lambda t: t.earlier.evidence_id), F.transform(full, lambda t: t.later.evidence_id))
    side = lambda c: F.struct(F.col(c).alias("source"), F.sha2(F.col(c), 256).alias("source_sha256"))
    compiled = lambda name: F.struct(ids[name].alias("evidence_id"), F.lit("NOT_REPLAYED").alias("status"))
    return df.select(
        i.cast("string").alias("item_id"), F.col(problem).cast("string").alias("problem_id"), F.col(statement).alias("problem_statement"),
        side(earlier).alias("earlier"), side(later).alias("later"), F.struct(F.col(claim).alias("text")).alias("claim_span"),
        F.struct(compiled("earlier_compile").alias("earlier"), compiled("later_compile").alias("later")).alias("compiler"),
        full.alias("tests"), F.array_sort(F.array_distinct(own)).alias("all_evidence_ids"), F.lit(True).alias("packet_prepared_without_method_predictions"),
    )


def canonical(df: DataFrame) -> Column:
    """Canonical JSON of a row: sorted keys at each level that ``sorted_struct`` has sorted, nulls kept."""
    return F.to_json(sorted_struct(df), {"ignoreNullFields": "false"})


def sorted_struct(df: DataFrame) -> Column:
    def arrange(c: Column, t) -> Column:
        from pyspark.sql import types as T

        if isinstance(t, T.StructType):
            fields = sorted(t.fields, key=lambda f: f.name)
            return F.when(c.isNotNull(), F.struct(*(arrange(c[f.name], f.dataType).alias(f.name) for f in fields)))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: arrange(x, t.elementType))
        return c

    return F.struct(*(arrange(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)))


def sealed(df: DataFrame) -> DataFrame:
    """Adds ``packet_sha256``, the hash of the packet's canonical form."""
    return df.withColumn("packet_sha256", F.sha2(canonical(df), 256))


def seal_intact(df: DataFrame) -> Column:
    bare = df.drop("packet_sha256")
    return F.coalesce(F.col("packet_sha256") == F.sha2(canonical(bare), 256), F.lit(False))


def replayed(packets: DataFrame, runs: DataFrame) -> DataFrame:
    """Packets with the results of runs (item_id, state, test_case_id, status) in their tests; a run that no test names
    is dropped, a test without a run stays NOT_REPLAYED. Only names and statuses go through the join."""
    results = runs.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "state", "test_case_id").alias("k"), F.col("status").alias("v")))).alias("_runs"))
    out = packets.join(results, "item_id", "left")
    put = lambda t, state, name: t[name].withField("status", F.coalesce(F.try_element_at("_runs", F.concat(F.lit(f"{state}|"), t.test_case_id)), t[name].status))
    return out.withColumn("tests", F.transform("tests", lambda t: t.withField("earlier", put(t, "st", "earlier")).withField("later", put(t, "st1", "later")))).drop("_runs")


def assembled(*batches: DataFrame) -> DataFrame:
    """The union of batches of packets, with ``problem``: what keeps a packet out of the frozen whole, null if nothing
    does. Fixed values: the texts of the problems are outputs."""
    from functools import reduce

    out = reduce(DataFrame.unionByName, batches)
    intact = seal_intact(out)
    open_tests = lambda s: F.get(F.filter("tests", lambda t: t[s].status == "NOT_REPLAYED"), F.lit(0)).test_case_id
    several = F.count(F.lit(1)).over(Window.partitionBy("item_id")) > 1
    problem = F.when(several, F.lit("duplicate packet item ID")).when(~intact, F.concat(F.lit("packet hash mismatch: "), "item_id"))
    for s in ("earlier", "later"):
        problem = problem.when(open_tests(s).isNotNull(), F.concat_ws(" ", F.concat(F.lit("test replay missing: "), "item_id"), F.lit(s), open_tests(s)))
    return out.withColumn("problem", problem)


def project(packets: DataFrame) -> DataFrame:
    """The payload that a model may see, and the ids it may cite, sorted. ``ids_listed``: the packet lists them all."""
    i = F.col("item_id")
    tests = F.col("tests")
    ids = F.array_sort(F.array_distinct(F.concat(
        F.array(source_id(i, "S_t"), source_id(i, "S_t+1"), F.concat(F.lit("diff:"), i), F.col("compiler.earlier.evidence_id"), F.col("compiler.later.evidence_id")),
        F.transform(tests, lambda t: t.official_evidence_id), F.transform(tests, lambda t: t.earlier.evidence_id), F.transform(tests, lambda t: t.later.evidence_id),
    )))
    evidence = F.struct(
        i.alias("item_id"), F.col("problem_statement"), F.col("claim_span.text").alias("fixed_focal_claim"),
        F.struct(source_id(i, "S_t").alias("evidence_id"), F.col("earlier.source").alias("code")).alias("S_t"),
        F.struct(source_id(i, "S_t+1").alias("evidence_id"), F.col("later.source").alias("code")).alias("S_t_plus_1"),
        F.col("compiler").alias("compiler_evidence"), tests.alias("official_tests_and_results"),
    )
    return packets.select("item_id", evidence.alias("evidence"), ids.alias("available_evidence_ids"), (F.size(F.array_except(ids, "all_evidence_ids")) == 0).alias("ids_listed"))


def unfinished(status: Column) -> Column:
    bare = F.lower(F.trim(status))
    return F.coalesce(bare.isin("", *UNFINISHED), F.lit(True))


def issues(packets: DataFrame) -> DataFrame:
    """Adds ``issues``: what makes a packet unusable, in order and each once."""
    blank = lambda c, label: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{label} is missing"))
    listed = F.col("all_evidence_ids")
    found = [
        blank(F.col("problem_statement"), "problem statement"), blank(F.col("claim_span.text"), "focal claim"), blank(F.col("earlier.source"), "S_t code"), blank(F.col("later.source"), "S_t+1 code"),
        F.when(~F.coalesce("packet_prepared_without_method_predictions", F.lit(False)), F.lit("packet is not explicitly marked packet_prepared_without_method_predictions=true")),
        F.when(listed.isNull() | F.coalesce(F.exists(listed, lambda x: F.coalesce(x, F.lit("")) == ""), F.lit(False)), F.lit("all_evidence_ids is missing or malformed")),
    ]
    for s in ("earlier", "later"):
        e = F.col(f"compiler.{s}")
        found += [
            F.when(e.isNull(), F.lit(f"compiler evidence {s} entry is missing")),
            F.when(e.isNotNull() & e.evidence_id.isNull(), F.lit(f"compiler evidence {s} is missing an evidence ID")),
            F.when(e.evidence_id.isNotNull() & ~F.array_contains(listed, e.evidence_id), F.concat(F.lit(f"compiler evidence {s} references an evidence ID not supplied in the packet: "), e.evidence_id)),
            F.when(e.isNotNull() & unfinished(e.status), F.lit(f"compiler evidence {s} has no completed status")),
        ]
    found.append(F.when(F.coalesce(F.size("tests"), F.lit(0)) <= 0, F.lit("official tests are missing or empty")))

    def of_test(t: Column, i: Column) -> Column:
        label = F.concat(F.lit("test "), i.cast("string"))
        out = [F.when(t.official_evidence_id.isNull(), F.concat(label, F.lit(" is missing an evidence ID")))]
        for s in ("earlier", "later"):
            r, name = t[s], F.concat(label, F.lit(f" {s} result"))
            out += [
                F.when(r.isNull(), F.concat(name, F.lit(" is missing"))),
                F.when(r.isNotNull() & unfinished(r.status), F.concat(name, F.lit(" has no completed status"))),
                F.when(r.isNotNull() & r.evidence_id.isNull(), F.concat(name, F.lit(" is missing an evidence ID"))),
                F.when(r.evidence_id.isNotNull() & ~F.array_contains(listed, r.evidence_id), F.concat(name, F.lit(" references an evidence ID not supplied in the packet: "), r.evidence_id)),
                F.when(F.instr(r.evidence_id, ":compile") > 0, F.concat(name, F.lit(" is indistinguishable from compiler evidence"))),
            ]
        return F.array_compact(F.array(*out))

    tests = F.coalesce(F.flatten(F.transform("tests", of_test)), F.array().cast("array<string>"))
    return packets.withColumn("issues", F.array_distinct(F.concat(F.array_compact(F.array(*found)), tests)))


#: A token of JSON after white space: punctuation, a string, a number, or a word.
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9.])|true|false|null|NaN|-?Infinity))')
#: What may follow: a value or the end of an empty list, a name or the end of an empty object, and so on.
_VALUE, _FIRST, _NAME, _FIRST_NAME, _COLON, _NEXT = range(6)


def members(text: str) -> list[tuple[str, str | None]]:
    """(name, text) of every object member of a JSON text, in its order; ``text`` is a string, number or boolean as it is
    read, null for null, lists and objects. No members of a text that is no JSON. A stack of one character a level takes
    the place of calls, so a text may be as deep as it is long."""
    out: list[tuple[str, str | None]] = []
    stack, state, at, name = [], _VALUE, 0, None
    while stack or state != _NEXT:
        token = _TOKEN.match(text, at)
        if not token:
            return []
        at = token.end()
        mark, string, word = token.groups()
        if state == _NEXT:
            if mark == ("}" if stack[-1] == "{" else "]"):
                stack.pop()
            elif mark == ",":
                state = _NAME if stack[-1] == "{" else _VALUE
            else:
                return []
        elif state == _COLON:
            if mark != ":":
                return []
            state = _VALUE
        elif state in (_NAME, _FIRST_NAME):
            if string is not None:
                name, state = json.loads(string), _COLON
            elif mark == "}" and state == _FIRST_NAME:
                stack.pop()
                state = _NEXT
            else:
                return []
        elif mark == "]" and state == _FIRST:
            stack.pop()
            state = _NEXT
        elif mark in ("{", "[") or mark is None:
            if name is not None:
                out.append((name, json.loads(string) if string is not None else None if word == "null" else word))
                name = None
            if mark:
                stack.append(mark)
            state = {"{": _FIRST_NAME, "[": _FIRST, None: _NEXT}[mark]
        else:
            return []
    return out if not text[at:].strip(" \t\n\r") else []


def members_of(text: str) -> list[tuple[str, str | None]]:
    """``members`` in an order of their own, by Python's own reader, which goes some hundred levels deep; deeper texts are
    left to ``members``."""
    out: list[tuple[str, str | None]] = []

    def of_object(pairs: list) -> None:  # values that are objects have become None, numbers their texts, as NaN and infinities
        out.extend([(k, v if v.__class__ is str else "true" if v is True else "false" if v is False else None) for k, v in pairs])

    try:
        json.loads(text, object_pairs_hook=of_object, parse_int=str, parse_float=str, parse_constant=str)
    except ValueError:
        return []
    except RecursionError:
        return members(text)
    return out


def walk(df: DataFrame, key: str, json_text: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """(key, name, text) of every object member of a JSON text, at any level, by ``members``, in Arrow batches; rows are
    given out as they come, with ``names`` only those of these names. Repeated names stay; a text that is no JSON has no
    members; a surrogate without its other half is ``?``."""
    schema = StructType([StructField(key, df.schema[key].dataType)] + [StructField(c, StringType()) for c in ("name", "text")])
    arrow = to_arrow_schema(schema)

    def plain(x: str | None) -> str | None:
        return x if x is None or x.isascii() else x.encode("utf-8", "replace").decode()

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for k, t in zip(*(c.to_pylist() for c in batch.columns)):
                for name, text in members_of(t) if t else ():
                    if names is not None and name not in names:
                        continue
                    rows.append((k, plain(name), plain(text)))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.select(key, F.col(json_text).cast("string")).mapInArrow(run, schema)


def carried_ids(walked: DataFrame, key: str) -> DataFrame:
    return walked.filter(F.col("name").isin(*ID_KEYS) & (F.col("text") != "")).groupBy(key).agg(F.array_sort(F.collect_set("text")).alias("evidence_ids"))


def forbidden(walked: DataFrame, key: str) -> DataFrame:
    bare = F.lower(F.trim("name"))
    return walked.filter(bare.isin(*FORBIDDEN_FIELDS) | bare.rlike(FORBIDDEN_PREFIX)).groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("forbidden"))


def invalid_references(df: DataFrame, cited: str, listed: str) -> DataFrame:
    """Rows that cite ids which aren't listed, with these; or that cite none."""
    return df.withColumn("unknown_ids", F.array_except(cited, listed)).filter((F.size("unknown_ids") > 0) | (F.coalesce(F.size(cited), F.lit(0)) <= 0))


def parity(*conditions: DataFrame) -> DataFrame:
    """(item_id, equal): whether an item's projected evidence has one hash in all conditions. Inputs: item_id, hash."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, conditions)
    return rows.groupBy("item_id").agg(F.count("*").alias("conditions"), (F.count_distinct("evidence_sha256") == 1).alias("equal"))


def future_blind_prompt(template: str, statement: str | Column, source: str | Column, verdict: str | Column, hidden: list[str | Column]) -> Column:
    """(prompt, sha256, problem): the template with the three admitted values; ``problem`` names what is missing, or
    says that a hidden value reached the prompt."""
    prompt = F.format_string(template, col(statement).cast(StringType()), col(source), col(verdict))
    gone = F.when(F.coalesce(F.trim(col(statement)), F.lit("")) == "", "missing problem_statement").when(F.coalesce(F.trim(col(source)), F.lit("")) == "", "missing st_source").when(F.coalesce(F.trim(col(verdict)), F.lit("")) == "", "missing verdict")
    leak = F.lit(False)
    for h in hidden:
        leak = leak | F.coalesce((col(h) != "") & (col(h) != col(verdict)) & (F.instr(prompt, col(h)) > 0), F.lit(False))
    problem = F.coalesce(gone, F.when(leak, F.lit("a hidden value reached the prompt")))
    return F.struct(F.when(problem.isNull(), prompt).alias("prompt"), F.when(problem.isNull(), F.sha2(prompt, 256)).alias("sha256"), problem.alias("problem"))
