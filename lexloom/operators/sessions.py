"""Sessions: collections of documents, as a column of every table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def created(sessions: DataFrame, session_id: str, name: str, now: str) -> DataFrame:
    """sessions (session_id, name, created_at) with one more; an id that exists stays as it is."""
    spark = sessions.sparkSession
    new = spark.createDataFrame([(session_id, name, now)], "session_id string, name string, created_at string")
    return sessions.unionByName(new.join(sessions.select("session_id"), "session_id", "left_anti"))


def appended(documents: DataFrame, new: DataFrame) -> DataFrame:
    """Documents of all sessions with new ones appended; what was there stays searchable."""
    return documents.unionByName(new, allowMissingColumns=True)


def info(documents: DataFrame, title_col: str = "title") -> DataFrame:
    """Per session: document_count, n_titles and the first title in order."""
    return documents.groupBy("session_id").agg(F.count("*").alias("document_count"), F.count_distinct(title_col).alias("n_titles"), F.min(title_col).alias("first_title"))


def titles(documents: DataFrame, title_col: str = "title") -> DataFrame:
    """The distinct titles of each session, as rows: a session may hold any number."""
    return documents.select("session_id", F.col(title_col).alias("title")).distinct()


def status(documents: DataFrame) -> DataFrame:
    """Sessions and documents in all."""
    return documents.groupBy("session_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_documents"))


def lookup(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Each request (request_id, session_id) with its session's document count, or found = false."""
    rows = requests.join(documents.groupBy("session_id").agg(F.count("*").alias("document_count")), "session_id", "left")
    return rows.select("request_id", "session_id", F.col("document_count").isNotNull().alias("found"), F.coalesce("document_count", F.lit(0)).alias("document_count"))


def context_rows(hits: DataFrame) -> DataFrame:
    """Response rows with defaults for what a hit lacks. hits: title, score, relevance_score, chunk_index, terms, passages."""
    none = F.array().cast("array<string>")
    return hits.select(
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("score", "relevance_score", F.lit(0.0)).alias("score"),
        F.coalesce("chunk_index", F.lit(0)).cast("long").alias("chunk_index"),
        F.array_join(F.coalesce("terms", none), "|").alias("terms"),
        F.array_join(F.coalesce("passages", none), "|").alias("passages"),
    )
