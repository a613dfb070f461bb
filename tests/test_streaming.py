from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from revaudit.streaming import append_log


def test_first_attempts_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    schema = StructType([StructField("item_id", StringType()), StructField("n", LongType()), StructField("at", TimestampType())])
    (log / "1.jsonl").write_text('{"item_id":"a","n":1,"at":"2026-01-01T00:00:00Z"}\n\n{"item_id":"b","n":2,"at":"2026-01-01T00:01:00Z"}\n')
    (log / "2.jsonl").write_text('{"item_id":"a","n":3,"at":"2026-01-01T00:02:00Z"}\n')
    stream = append_log.first_attempts(append_log.read_log(spark, str(log), schema, 1), ["item_id"], "at")
    append_log.write_log(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.item_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} in ({("a", 1), ("b", 2)}, {("a", 3), ("b", 2)})
    counts = append_log.outcome_counts(append_log.read_log(spark, str(log), schema), "at", "1 minute", "item_id")
    assert counts.isStreaming
