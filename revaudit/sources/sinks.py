"""Writers: projected CSV, canonical JSON lines, append logs, workbooks, and checksum manifests."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import same_rows
from ..operators.packets import canonical


def reindex(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in that order; those that are missing are null texts."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    (reindex(df, columns) if columns else df).write.mode(mode).options(header="true", quote='"', escape='"').csv(path)


def write_canonical(df: DataFrame, path: str, mode: str = "errorifexists", gzip: bool = False) -> None:
    """Canonical JSON lines. Spark's committer makes the files appear only when all are whole."""
    df.select(canonical(df).alias("value")).write.mode(mode).options(**({"compression": "gzip"} if gzip else {})).text(path)


def append_log(df: DataFrame, path: str) -> None:
    write_canonical(df, path, mode="append")


MARKERS = "_batches"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Append the rows of a batch to a log as canonical JSON lines, once whatever is tried again; whether it was this call
    that did.

    A try writes to a folder of its own and then puts a marker of the batch's name in place, by a move that fails where
    there is one already. Readers take the folders that markers name, so what a try left that died before its marker is
    never seen, and a batch that was committed is left alone. Names of batches are plain: letters, digits, ``.``, ``_``
    and ``-``.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch) or batch.startswith("."):
        raise ValueError(f"not a name of a batch: {batch!r}")
    spark = df.sparkSession
    store, place = _files(spark, path)
    marker = place(f"{path}/{MARKERS}/{batch}")
    if store.exists(marker):
        return False
    folder = f"{batch}-{uuid.uuid4().hex}"
    write_canonical(df, f"{path}/{folder}")
    return commit_batch(spark, path, batch, folder)


def commit_batch(spark: SparkSession, path: str, batch: str, folder: str) -> bool:
    """Make ``folder`` the batch, if no other one is."""
    store, place = _files(spark, path)
    store.mkdirs(place(f"{path}/{MARKERS}"))
    draft = place(f"{path}/{MARKERS}/.{folder}")
    out = store.create(draft, True)
    out.write(bytearray(folder.encode()))
    out.close()
    try:
        options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place(path).toUri(), spark._jsc.hadoopConfiguration()).rename(draft, place(f"{path}/{MARKERS}/{batch}"), options)
    except Exception as e:  # the JVM's error, known by its name
        if "FileAlreadyExistsException" not in str(e):
            raise
        store.delete(draft, False)
        return False
    return True


def batch_writer(path: str, prefix: str = "batch"):
    """For ``foreachBatch``: a micro-batch that is replayed is appended once. Each query needs a ``prefix`` of its own, and
    keeps it over restarts."""
    return lambda df, number: append_batch(df, path, f"{prefix}-{number}")


def checksum_lines(hashes: DataFrame) -> DataFrame:
    """``digest  path`` lines, each once and in path order."""
    return hashes.select("path", "sha256").distinct().orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))


def rebuild_check(rebuilt: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: how many rows only one of the two has, and whether they are the same."""
    return same_rows(rebuilt, stored).withColumn("identical", F.expr("only_left + only_right = 0"))


#: Rows that a sheet may have.
SHEET_ROWS = 1 << 20


def workbook(sheets: dict[str, DataFrame]) -> DataFrame:
    """(sheet, payload): each small table as ``{"columns": [...], "rows": [...]}``, its rows in order. A sheet is one value, so a
    table of more than ``SHEET_ROWS`` rows is refused."""
    from functools import reduce

    parts = []
    for name, df in sheets.items():
        if df.limit(SHEET_ROWS + 1).count() > SHEET_ROWS:
            raise ValueError(f"sheet {name} has more than {SHEET_ROWS} rows")
        row = F.struct(F.array(*map(F.lit, df.columns)).alias("columns"), F.sort_array(F.collect_list(F.array(*(F.col(c).cast("string") for c in df.columns)))).alias("rows"))
        parts.append(df.agg(F.to_json(row, {"ignoreNullFields": "false"}).alias("payload")).select(F.lit(name).alias("sheet"), "payload"))
    return reduce(DataFrame.unionByName, parts)
