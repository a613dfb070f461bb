"""From raw documents to training tokens: five stages, each over all that the one before it kept.

Quality rules drop documents; line dedup takes repeated lines out of the rest; of each group of near duplicates (five
words, similarity 0.8) one document stays; the mix draws nine tenths of the tokens by target weights; the last stage
encodes what is left. All stages but the last return the columns of ``documents``. Every stage states in its operator
what it makes of nulls, empty texts, ties and repeated rows; an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revaudit.llm import bpe, line_dedup, mixing, ngram_join, repetition
from revaudit.llm.common import scratch, written
from revaudit.llm.queries import WEIGHTS, levels

#: Dropped documents up to this number are broadcast as a list of keys; more are joined by a shuffle.
BROADCAST_ROWS = 400_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return repetition.quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line matches. Documents that lose all their words with them, being
    repeats throughout, go."""
    out = line_dedup.dedup_lines(docs)
    out = out.filter((F.col("dropped_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("dropped_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that links of 0.8 over five words connect, the one with the smallest doc_id, nulls last, then the
    smallest hash of its text, then the smallest other columns. Rows decide, not keys: a repeated doc_id or a null one
    takes nothing else along, and of repeated rows one stays. Texts without words all stay."""
    with scratch(spark, "change"):
        found = written(ngram_join.linked(docs, "doc_id", "text", 5, 80).filter("root is not null"), "found")
        first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))).alias("f"))
        first = first.select(F.col("f.d").alias("fd"), F.col("f.h").alias("fh"), F.lit(True).alias("first"))
        keys = found.groupBy(F.col("doc_id").alias("kd"), F.col("text_hash").alias("kh")).agg(F.count("*").alias("times"))
        keys = keys.join(first, F.col("kd").eqNullSafe(F.col("fd")) & (F.col("kh") == F.col("fh")), "left").filter("first is null or times > 1")
        change = written(keys.select("kd", "kh", F.col("first").isNotNull().alias("stays")), "change")
    few = change.count() <= BROADCAST_ROWS
    rows = docs.join(F.broadcast(change) if few else change, F.col("doc_id").eqNullSafe(F.col("kd")) & (F.xxhash64("text") == F.col("kh")), "left")
    alone = rows.filter("stays is null").select(*docs.columns)
    repeated = rows.filter("stays").groupBy("kd", "kh").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return alone.unionByName(repeated)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, shared out by the target weights, each document at most once."""
    return mixing.mix(docs, levels(), WEIGHTS, budget_percent=90, epochs=1).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and the hashes of ids and of the decoded text."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: SQL expresses neither suffix arrays nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
