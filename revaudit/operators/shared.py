"""Tables computed once, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: written where the session has a folder for checkpoints, which cuts the lineage safely and
    gives its real size to the plans that follow (a checkpoint has an estimate that rounds of joins blow up); else
    persisted."""
    spark = df.sparkSession
    if not (top := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        return df.persist()
    path = f"{top.rstrip('/')}/revaudit-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
