"""Typed readers: CSV, JSON lines, JSON arrays, multi-source unions, and checksum manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import missing_token
from ..operators.quality import require_columns

CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}


def read_csv(spark: SparkSession, path: str, schema: StructType, required: list[str] | None = None, na_tokens: bool = True) -> DataFrame:
    """A CSV file with a header, by an explicit schema; a leading byte order mark, quoted line breaks and doubled quotes
    are read. With ``na_tokens`` the usual tokens for missing values become null."""
    header = spark.read.options(**CSV).option("inferSchema", "false").csv(path).columns
    require_columns(spark.createDataFrame([], StructType([StructField(c, StringType()) for c in header])), required or schema.fieldNames(), path)
    texts = spark.read.options(**CSV).schema(StructType([StructField(c, StringType()) for c in header])).csv(path)
    value = (lambda c: missing_token(c)) if na_tokens else (lambda c: F.col(c))
    return texts.select(*(value(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields))


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as texts, nothing made null but empty fields."""
    return spark.read.options(**CSV).option("inferSchema", "false").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; blank lines are passed over, a broken line is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


#: Ranges of files whose offsets are broadcast at most; more are joined by a shuffle.
BROADCAST_RANGES = 200_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line) of text files, numbered from 1 in each, blank lines included; files are read in ranges.

    The first pass counts the lines that begin in each range, and sums of these by file and offset give the number of
    lines before it; the second pass adds a line's place in its range. Both passes plan the same ranges, as they read
    the same files in one session.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    ranges = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))  # a row a range, not a line
    if ranges.count() <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    return lines.join(ranges, ["file", "start"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_number"), "line")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line): lines that are neither blank nor a JSON object."""
    kind = F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False))
    return numbered_lines(spark, path).filter((F.trim("line") != "") & ~kind)


def read_batches(spark: SparkSession, path: str, schema: StructType, batch: str = "batch") -> DataFrame:
    """The rows of a log's committed batches, with the name of each in the column ``batch``; a log without one is empty.

    The folders of batches are known from their markers, small files that Spark reads; names of batches, not rows, reach
    the driver.
    """
    store = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    markers = f"{path}/_batches"
    top = spark._jvm.org.apache.hadoop.fs.Path(markers)
    listed = [x.getPath() for x in (store.listStatus(top) if store.exists(top) else []) if not x.getPath().getName().startswith(".")]
    if not listed:
        return spark.createDataFrame([], StructType([*schema.fields, StructField(batch, StringType())]))
    named = spark.read.text([x.toString() for x in listed], wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).collect()
    lines = spark.read.text([f"{path}/{r.value}" for r in named]).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("folder"))
    names = F.broadcast(spark.createDataFrame([(r.value, r.name) for r in named], "folder string, name string"))
    parsed = lines.join(names, "folder").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.col("name").alias(batch))
    return parsed.select("r.*", batch)


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON files whose root is a list of objects, or an object whose first list value is that list. A file without one
    is an error. A file is one document, so one task reads it."""

    def run(batches):
        import json

        for batch in batches:
            for text in batch.column(0).to_pylist():
                root = json.loads(text.removeprefix("\ufeff"))
                rows = root if isinstance(root, list) else next((v for v in root.values() if isinstance(v, list)), None)
                if rows is None:
                    raise ValueError("no list in a JSON file")
                for start in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pydict({"value": [json.dumps(r, ensure_ascii=False) for r in rows[start : start + 10_000]]})

    lines = spark.read.text(path, wholetext=True).mapInArrow(run, "value string")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def union_sources(sources: list[DataFrame], key: str) -> DataFrame:
    """The union of sources; a key that occurs twice is an error when the rows are read."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    twice = rows.groupBy(key).agg(F.count("*").alias("_n"))
    checked = twice.withColumn("_ok", F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate key: "), F.col(key).cast("string"))))
    return rows.join(checked.select(key, "_ok"), key, "left").filter("_ok is null").drop("_ok")


#: Bytes of a file that are held at once.
PIECE = 1 << 20


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, bytes) of all files below a folder, with ``/`` in relative paths.

    Only the list of files comes from Spark; each is read piece by piece by one task, so a file may be larger than
    memory. A store that only Spark can open is read by Spark instead, a file at a time, each under 2 GB and not empty.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/") + "/"
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "^file:/+", "/")
    path = F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 10_000)).otherwise(path)
    names = [unquote(uri) if uri.startswith("file:") else uri for uri in files.inputFiles()]  # the list that Spark's own index holds
    try:
        if names:
            _store(names[0])
    except (pa.ArrowInvalid, OSError):
        return files.select(path.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for uri in batch.column(0).to_pylist():
                digest, size = hashlib.sha256(), 0
                store, at = _store(uri)
                with store.open_input_stream(at, compression=None) as f:
                    while piece := f.read(PIECE):
                        digest.update(piece)
                        size += len(piece)
                found.append(digest.hexdigest())
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(sizes, pa.int64())], names=["path", "sha256", "bytes"])

    parts = spark.sparkContext.defaultParallelism * 4
    listed = spark.createDataFrame([(x,) for x in names], "path string").repartition(parts, "path").mapInArrow(digests, "path string, sha256 string, bytes long")
    return listed.select(path.alias("path"), "sha256", "bytes")


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    local = uri.startswith(("file:", "/"))
    return (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(uri)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, path) of a checksum file; a path that leads out of its folder is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parts = lines.select(F.regexp_extract("value", r"^([0-9a-f]{64})\s+\*?(.+)$", 1).alias("sha256"), F.replace(F.regexp_extract("value", r"^([0-9a-f]{64})\s+\*?(.+)$", 2), F.lit("\\"), F.lit("/")).alias("path"))
    safe = (F.col("sha256") != "") & ~F.col("path").rlike(r"^/|(^|/)\.\.(/|$)|^[A-Za-z]:")
    return parts.withColumn("_ok", F.assert_true(safe, F.concat(F.lit("bad checksum line: "), F.col("path")))).filter("_ok is null").drop("_ok")


def verify_checksums(stated: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status) of each stated file: ok, mismatch or missing."""
    return stated.join(found.select("path", F.col("sha256").alias("_f")), "path", "left").select("path", F.when(F.col("_f").isNull(), "missing").when(F.col("_f") == F.col("sha256"), "ok").otherwise("mismatch").alias("status"))
