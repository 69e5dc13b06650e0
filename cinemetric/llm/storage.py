"""Written intermediate tables: every step that is read twice or ends an
iteration is written as Parquet under ``spark.checkpoint.dir`` (the folder all
executors share), so a lost executor costs a task, not the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the table read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def total_bytes(df: DataFrame, column: str) -> int:
    """Sum of the UTF-8 lengths of a text column (one aggregate)."""
    from pyspark.sql import functions as F
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"])
