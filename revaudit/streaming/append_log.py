"""An extension: the append-only log as a stream, with first attempts kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 64) -> DataFrame:
    """JSON lines that keep arriving as new files in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def first_attempts(log: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key that arrives; the state of a key is dropped once its time is past the watermark."""
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def outcome_counts(log: DataFrame, time: str, width: str, field: str, late: str = "1 hour") -> DataFrame:
    """Rows of each value in windows of event time; a window is given out once the watermark has passed it."""
    w = F.window(time, width)
    return log.withWatermark(time, late).groupBy(w.alias("w"), field).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), field, "n")


def write_log(stream: DataFrame, path: str, checkpoint: str):
    """Append to a folder, exactly once, and stop when all that is there now is written."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def unresolved_intents(events: DataFrame, key: str, time: str, terminal: str, timeout: str = "1 hour") -> DataFrame:
    """(``key``, status, attempted_at, resolved_at) as a stream: what became of each attempt of an append-only log.

    Rows of ``events`` are attempts, or with ``terminal`` their ends, and come in any order within the watermark. A key is ``resolved`` once both
    are there, ``unresolved`` once the watermark has passed its attempt by ``timeout`` without an end, and ``late`` if the end comes after
    that; an end without an attempt is ``orphan`` by the same rule. A key's state is a few bytes and is dropped an equal time
    after the key was given out, so what repeats in that time is passed over. A null key takes no part.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    wait = int(pd.Timedelta(timeout).total_seconds() * 1000)
    rows = events.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(time).alias("at"), F.unix_millis(F.col(time)).alias("ms"), F.coalesce(F.col(terminal), F.lit(False)).alias("terminal"))
    rows = rows.withWatermark("at", timeout)

    def step(name, batches, state):
        attempted, resolved, given = state.get if state.exists else (None, None, "")
        out: list[tuple] = []
        if state.hasTimedOut:
            if given:
                state.remove()
                return
            given = "unresolved" if attempted is not None else "orphan"
            out.append((name[0], given, attempted, resolved))
        for batch in batches:
            for at, end in zip(batch["ms"].tolist(), batch["terminal"].tolist()):
                if end:
                    resolved = at if resolved is None else min(resolved, at)
                else:
                    attempted = at if attempted is None else min(attempted, at)
        if attempted is not None and resolved is not None and given in ("", "unresolved"):
            given = "late" if given else "resolved"
            out.append((name[0], given, attempted, resolved))
        state.update((attempted, resolved, given))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), min(x for x in (attempted, resolved) if x is not None)) + wait)
        if out:
            yield pd.DataFrame(out, columns=["key", "status", "attempted", "resolved"])

    found = rows.groupBy("key").applyInPandasWithState(step, "key string, status string, attempted long, resolved long", "attempted long, resolved long, given string", "append", GroupStateTimeout.EventTimeTimeout)
    moment = lambda c: F.timestamp_millis(F.col(c))
    return found.select(F.col("key").alias(key), "status", moment("attempted").alias("attempted_at"), moment("resolved").alias("resolved_at"))
