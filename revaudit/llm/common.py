"""What the operators of this subpackage share: the shared folder, code shipping, and Arrow row mapping."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows turned into Python objects at once; an Arrow batch itself is bounded by Spark's bytes per batch.
SLICE_ROWS = 256
#: (name, path) of the tables written in the innermost ``scratch``.
_made: ContextVar[list | None] = ContextVar("_made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, the place that driver and executors share.

    Only where the setting is missing in a local session (tests) a temporary folder takes its place; on a cluster the
    executors would each write to their own, so there it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = getattr(spark, "_revaudit_dir", None) or tempfile.mkdtemp(prefix="revaudit-")
        spark._revaudit_dir = top
    return f"{top.rstrip('/')}/revaudit-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t", options: dict | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.options(**(options or {})).parquet(path)
    if (made := _made.get()) is not None:
        made.append((name, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, *keep: str):
    """Tables that are ``written`` in it are deleted at its end, but those of the names ``keep``, which belong to the
    ``scratch`` around it. What is returned from it must read only those."""
    made: list[tuple[str, str]] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
    for name, path in made:
        if name not in keep:
            at = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])  # the folder of this table alone
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        elif (outer := _made.get()) is not None:
            outer.append((name, path))


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing holds any more: Spark's cleaner waits for the driver's garbage to be
    collected, which a driver that does little may put off until the disks of the executors are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    have = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in have:
        pass
    return name


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, wherever their import path points."""
    if getattr(spark.sparkContext, "_revaudit_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="revaudit-")) / "revaudit_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._revaudit_shipped = True


def struct_of(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else _parse_datatype_string(schema)


def map_rows(df: DataFrame, columns: list, fn: Callable[..., list[list]], schema: str, rows: int = SLICE_ROWS, done: Callable[[], None] = lambda: None) -> DataFrame:
    """``fn(*columns)`` over slices of ``df``: it gets one list a column and returns one list an output column. ``done``
    is called at the end of each task.

    Text columns that ``fn`` wants as UTF-8 should be cast to binary first. Integers with nulls stay integers.
    """
    ship(df.sparkSession)
    arrow = to_arrow_schema(struct_of(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, rows):
                    part = batch.slice(start, rows)
                    out = fn(*(c.to_pylist() for c in part.columns))
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow)], schema=arrow)
        finally:
            done()

    return df.select(*columns).mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
