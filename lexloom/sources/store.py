"""A session's index as Parquet tables, one folder each, partitioned by session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_index(tables: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    for name, df in tables.items():
        writer = df.write.mode(mode)
        (writer.partitionBy("session_id") if "session_id" in df.columns else writer).parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: list[str], session_id: str | None = None) -> dict[str, DataFrame]:
    """The tables; of one session, by partition pruning, if it is named."""
    out = {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        out[name] = df.where(df["session_id"].cast("string") == session_id) if session_id is not None and "session_id" in df.columns else df
    return out
