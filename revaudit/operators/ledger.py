"""Reconciliation of append-only run ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked


def combine(sources: list[DataFrame], key: str) -> DataFrame:
    """The union of the sources with ``source_pos``; missing columns are null. A key of two rows is for
    ``duplicate_keys`` to find."""
    parts = [s.withColumn("source_pos", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


def last_wins(df: DataFrame, key: str, order: str = "source_pos") -> DataFrame:
    """The row of the last source for each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def first_attempts(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key, with its ``sequence`` from 1 in the order of those rows within the first key."""
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")
    return first.withColumn("sequence", F.row_number().over(Window.partitionBy(key[0]).orderBy(*order)))


def coverage(expected: DataFrame, predictions: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """One row: whether predictions and errors split the expected keys exactly, and what breaks that."""
    rows = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("p"), F.lit(0).alias("r")).unionAll(predictions.select(key, F.lit(0), F.lit(1), F.lit(0))).unionAll(errors.select(key, F.lit(0), F.lit(0), F.lit(1)))
    per = rows.groupBy(key).agg(F.max("e").alias("e"), F.sum("p").alias("p"), F.sum("r").alias("r"))
    n = lambda c: F.coalesce(F.sum(F.expr(f"cast({c} as bigint)")), F.lit(0))
    out = per.agg(n("e = 1").alias("expected"), n("e = 1 and p + r = 0").alias("missing"), n("e = 0").alias("unexpected"), n("p > 0 and r > 0").alias("in_both"), n("p > 1 or r > 1").alias("repeated"))
    return out.withColumn("passed", F.expr("missing + unexpected + in_both + repeated = 0"))


def unresolved(attempts: DataFrame, terminals: DataFrame, key: str) -> DataFrame:
    """Attempts that no terminal row answers."""
    return attempts.join(terminals.select(key).distinct(), key, "left_anti")


def recovery(primary: DataFrame, rerun: DataFrame, key: str, status: int = 429) -> DataFrame:
    """The ledger of second attempts of the keys whose first failed with ``status``; a key without a second attempt has
    the outcome ``missing``, one with several is an error when the rows are read (``covered_recovery`` names them)."""
    chosen = primary.filter(F.col("http_status") == status).select(key, F.col("http_status").alias("selected_from_primary_http_status"))
    second = rerun.groupBy(key).agg(F.min("http_status").alias("http_status"), F.min("outcome").alias("outcome"), F.count("*").alias("_n"))
    once = F.assert_true(F.col("_n") == 1, F.concat(F.lit("several second attempts: "), F.col(key).cast("string")))
    second = second.withColumn("_ok", once).filter("_ok is null").drop("_n", "_ok")
    return chosen.join(second, key, "left").select(key, "selected_from_primary_http_status", F.lit(2).alias("attempt_number"), F.coalesce("outcome", F.lit("missing")).alias("outcome"), "http_status")


def recovery_differences(primary: DataFrame, rerun: DataFrame, key: str, position: str, sequence: str, equal: list[str], fixed: dict[str, object], status: int = 429) -> tuple[DataFrame, DataFrame]:
    """(ledger, differences) of second attempts, in the order of the first ones.

    Selected are the rows of ``primary`` whose first attempt failed with ``status``; their order is that of ``position``. The
    ledger has (``position``, ``key``, expected_sequence, attempts, outcome, http_status), a row for each selected key, the last columns those of
    the earliest attempt. ``differences`` has (``key``, ``position``, field, before, after) for whatever must be equal and is not, nulls
    being equal: the columns ``equal`` between the two attempts, ``fixed`` columns and their values, the sequence against the
    place among the selected, and the number of attempts (1). An attempt that was not selected has a null position and
    the field ``selected``.
    """
    chosen = primary.filter(F.col("http_status") == status).select(key, position, *(F.col(c).cast("string").alias(f"_b_{c}") for c in equal))
    chosen = ranked(chosen, [position, key], "expected_sequence")
    fields = list(dict.fromkeys([sequence, *equal, *fixed]))
    each = F.struct(sequence, *(F.col(c).cast("string").alias(f"_a_{c}") for c in fields), F.col("outcome"), F.col("http_status"))
    second = rerun.groupBy(key).agg(F.count("*").alias("attempts"), F.min(each).alias("_a"))  # a key with many attempts meets in partial sums
    both = chosen.join(second, key, "full_outer").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    here, done = F.col("expected_sequence").isNotNull(), F.col("attempts") > 0
    pair = lambda when, name, before, after: F.when(when & ~before.cast("string").eqNullSafe(after.cast("string")), F.struct(F.lit(name).alias("field"), before.cast("string").alias("before"), after.cast("string").alias("after")))
    wrong = [
        pair(~here, "selected", F.lit("false"), F.lit("true")),
        pair(here, "attempts", F.lit(1), F.col("attempts")),
        pair(here & done, sequence, F.col("expected_sequence"), F.col(f"_a._a_{sequence}")),
        *(pair(here & done, c, F.col(f"_b_{c}"), F.col(f"_a._a_{c}")) for c in equal),
        *(pair(here & done, c, F.lit(str(v)), F.col(f"_a._a_{c}")) for c, v in fixed.items()),
    ]
    differences = both.select(key, position, F.inline(F.array_compact(F.array(*wrong))))
    book = both.filter(here).select(position, key, "expected_sequence", "attempts", F.coalesce("_a.outcome", F.lit("missing")).alias("outcome"), F.col("_a.http_status").alias("http_status"))
    return book.orderBy(position, key), differences


def counters(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) of several columns in one pass; missing values are ``<MISSING>``."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("<MISSING>")).alias("value")) for f in fields))
    return df.select(F.inline(rows)).groupBy("field", "value").agg(F.count("*").alias("n"))


def usage_summary(df: DataFrame, *by: str, tokens: str = "total_tokens", latency: str = "latency_ms") -> DataFrame:
    """Token sum, only where every row has one; latency mean, least, most, and the upper middle value."""
    out = df.groupBy(*by).agg(
        F.count("*").alias("requests"), F.count(tokens).alias("with_usage"), F.sum(tokens).alias("_sum"),
        F.avg(latency).alias("mean_latency"), F.min(latency).alias("min_latency"), F.max(latency).alias("max_latency"), F.count(latency).alias("_n"),
    )
    # The middle from the numbers of rows of each value: a large group is as many rows as it has values.
    each = df.filter(F.col(latency).isNotNull()).groupBy(*by, latency).agg(F.count("*").alias("_rows"))
    own = Window.partitionBy(*by)
    upto = F.sum("_rows").over(own.orderBy(latency).rowsBetween(Window.unboundedPreceding, 0))
    middle = each.withColumns({"_upto": upto, "_all": F.sum("_rows").over(own)}).filter(F.expr("_upto > _all div 2"))
    middle = middle.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by))).agg(F.min(latency).alias("median_latency"))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    out = out.join(middle, on, "left").drop(*(f"_k{i}" for i in range(len(by))), "_n") if by else out.join(middle, how="left").drop("_n")
    return out.withColumn("tokens", F.when(F.col("requests") == F.col("with_usage"), F.col("_sum"))).drop("_sum")


def termination(df: DataFrame, *by: str, code: str = "exit_code", timed_out: str = "timed_out", runtime: str = "runtime_ms") -> DataFrame:
    """The exit code that all runs share, null counting as a code; whether any timed out; the sum of run times."""
    codes = F.count_distinct(F.coalesce(F.col(code).cast("string"), F.lit("none")))
    return df.groupBy(*by).agg(F.when(codes == 1, F.max(code)).alias("exit_code"), F.bool_or(timed_out).alias("timed_out"), F.sum(runtime).alias("runtime_ms"))


def status_counts(packets: DataFrame, states: tuple[str, ...] = ("earlier", "later")) -> DataFrame:
    """(evidence, state, status, n) of nested statuses: of each packet's compiler in each state, and of each of its tests. A
    missing status is ``<MISSING>``; packets without tests have compiler rows only."""
    entry = lambda kind, state, status: F.struct(F.lit(kind).alias("evidence"), F.lit(state).alias("state"), F.coalesce(status, F.lit("<MISSING>")).alias("status"))
    compiled = F.array(*(entry("compiler", s, F.col(f"compiler.{s}.status")) for s in states))
    ran = F.coalesce(F.col("tests"), F.array().cast(packets.schema["tests"].dataType))
    of_tests = lambda s: F.transform(ran, lambda t: entry("test", s, t[s].status))
    tests = [of_tests(s) for s in states]
    return packets.select(F.inline(F.concat(compiled, *tests))).groupBy("evidence", "state", "status").agg(F.count("*").alias("n"))


def exploded_counts(df: DataFrame, items: str) -> DataFrame:
    """How often each item of an array column occurs."""
    return df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def add_interrupted(log: DataFrame, attempt: DataFrame, key: str) -> DataFrame:
    """The log with the row of an attempt that was never logged; one that is there already stays as it is."""
    return log.unionByName(attempt.join(log.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


#: Fixed values of a reconstructed attempt; they are outputs.
RECONSTRUCTED = {"provider_called": True, "attempt_class": "PRIMARY_FIRST_ATTEMPT", "record_origin": "terminal_log_reconstruction_no_provider_reissue"}


def reconstructed(attempts: DataFrame, raw: DataFrame, errors: DataFrame, metadata: DataFrame, key: str, error_type: str = "IncompleteRead") -> dict[str, DataFrame]:
    """The rows that each of three logs gets for attempts (key, sequence, request_sha256) which were made but never
    logged: what came back is unknown, so it is null. An attempt that any of the logs has is an error when the rows are
    read."""
    logged = raw.select(key).unionByName(errors.select(key)).unionByName(metadata.select(key)).distinct().withColumn("_logged", F.lit(True))
    own = attempts.select(key, "sequence", "request_sha256").join(logged, key, "left")
    own = own.withColumn("_ok", F.assert_true(F.col("_logged").isNull(), F.concat(F.lit("refusing to duplicate an already recorded item: "), F.col(key).cast("string"))))
    own = own.filter("_ok is null").drop("_ok", "_logged").withColumns({k: F.lit(v) for k, v in RECONSTRUCTED.items()}).withColumn("http_status", F.lit(None).cast("int"))
    none = F.lit(None).cast("string")
    return {
        "raw": own.withColumns({"raw_response": F.lit(""), "completion_content": none, "returned_model": none}),
        "errors": own.withColumns({"error_type": F.lit(error_type), "raw_response_sha256": none}),
        "metadata": own.withColumns({"status": F.lit("error"), "response_sha256": none, "usage_available": F.lit(False)}),
    }


def covered_recovery(expected: DataFrame, metadata: DataFrame, predictions: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """The ledger of second attempts, whose rows may come from several folders: (key, outcome, http_status, error_type,
    problem). ``problem`` says where the attempts do not cover the expected keys once each, or where predictions and
    errors do not part them."""
    seen = metadata.groupBy(key).agg(F.count("*").alias("_rows"), F.min("http_status").alias("http_status"))
    hit = predictions.groupBy(key).agg(F.lit(True).alias("_hit"))
    failed = errors.groupBy(key).agg(F.lit(True).alias("_failed"), F.min("error_type").alias("error_type"))
    out = expected.select(key).distinct().withColumn("_expected", F.lit(True))
    for d in (seen, hit, failed):
        out = out.join(d, key, "full")
    has = lambda c: F.coalesce(c, F.lit(False))
    problem = F.when(~has("_expected"), "not selected").when(F.col("_rows").isNull(), "no attempt").when(F.col("_rows") > 1, "several attempts")
    problem = problem.when(has("_hit") & has("_failed"), "prediction and error").when(~has("_hit") & ~has("_failed"), "neither prediction nor error")
    return out.select(key, F.when(has("_hit"), "accepted").otherwise("error").alias("outcome"), "http_status", "error_type", problem.alias("problem"))


def constant_settings(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, values, passed): settings must have a single value, null included."""
    per = df.agg(*(F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("<MISSING>"))).alias(f) for f in fields))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("values"), (F.col(f) <= 1).alias("passed")) for f in fields))
    return per.select(F.inline(rows))


def enrich(metadata: DataFrame, usage: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Metadata with the fields filled in from ``usage`` where they are missing. Several usage rows of a key must agree, nulls
    aside: a field that they give two values is an error when the rows are read. Null keys have no usage."""
    own = usage.filter(F.col(key).isNotNull()).groupBy(key).agg(*(F.max(f).alias(f"_{f}") for f in fields), *(F.count_distinct(f).alias(f"_n_{f}") for f in fields))
    same = reduce(lambda a, b: a & b, (F.col(f"_n_{f}") <= 1 for f in fields))
    own = own.withColumn("_ok", F.assert_true(same, F.concat(F.lit("usage rows disagree: "), F.col(key).cast("string")))).filter("_ok is null")
    filled = {f: F.coalesce(f, f"_{f}") if f in metadata.columns else F.col(f"_{f}") for f in fields}
    return metadata.join(own.select(key, *(f"_{f}" for f in fields)), key, "left").withColumns(filled).drop(*(f"_{f}" for f in fields))
