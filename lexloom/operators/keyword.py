"""Keyword search: postings, term statistics and the two BM25 profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import saved

#: Queries that meet the chunks together.
BLOCK = 1024

#: Hits of a query up to which the smallest ids are enough to fill it up.
FEW = 1000

#: Parameters of the profiles: the session profile's idf may be negative; the advanced one puts 0.25 of the mean instead.
SESSION = {"k1": 1.2, "b": 0.75, "floor": None}
OKAPI = {"k1": 1.5, "b": 0.75, "floor": 0.25}


def terms(text: Column) -> Column:
    return T.words(F.lower(text))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk_id, term, tf."""
    return docs.select(F.col(id_col).alias("chunk_id"), F.explode(terms(F.col(text_col))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def inverse_frequency(df: DataFrame, n: int, floor: float | None) -> DataFrame:
    """term, df, idf = ln((n - df + .5) / (df + .5)); with a floor, negative ones become that part of the mean idf."""
    out = df.withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    if floor is None:
        return out
    mean = out.agg(F.avg("idf").alias("mean_idf"))
    return out.join(F.broadcast(mean)).withColumn("idf", F.when(F.col("idf") < 0, floor * F.col("mean_idf")).otherwise(F.col("idf"))).drop("mean_idf")


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("chunk_id"), F.size(terms(F.col(text_col))).alias("dl"))


def bm25_hits(queries: DataFrame, index: DataFrame, sizes: DataFrame, profile: dict) -> DataFrame:
    """query_id, chunk_id, score of chunks with any query term; repeated query terms count again.

    queries: query_id, text. The index is read by the queries' terms only. Collection size and mean length are one row.
    """
    k1, b = profile["k1"], profile["b"]
    n, mean = sizes.agg(F.count("*"), F.avg("dl")).first()
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    if profile["floor"] is None:  # only the terms asked for matter
        idf = inverse_frequency(document_frequency(index.join(asked.select("term").distinct(), "term", "left_semi")), n, None)
    else:
        idf = inverse_frequency(document_frequency(index), n, profile["floor"])
    hits = asked.join(idf, "term").join(index, "term").join(sizes, "chunk_id")
    gain = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean))
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(gain).alias("score"))


def top(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best of each query with their rank from 1; scores equal to nine decimals tie, by chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.round(by, 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def bm25_top(queries: DataFrame, index: DataFrame, sizes: DataFrame, profile: dict, k: int) -> DataFrame:
    """The k best chunks of each query; chunks without any of its terms score 0 and fill up, or stand before negative ones.

    Only queries with fewer than k positive hits are filled. Of a query with n hits in all, up to FEW, the k chunks to fill
    up with are among the k + n smallest ids. Queries with more hits, of very common terms with negative scores, meet all
    chunks in blocks of queries, and a task hands on no more than its k smallest ids for each query.
    """
    hits = saved(bm25_hits(queries, index, sizes, profile), "hits")
    found = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("score") > 0, 1)).alias("positive"))
    needing = queries.select("query_id").distinct().join(found, "query_id", "left").fillna(0, ["n", "positive"])
    needing = saved(needing.where(F.col("positive") < k).select("query_id", "n"), "needing")
    first = F.lit([r[0] for r in sizes.select("chunk_id").orderBy("chunk_id").limit(k + FEW).collect()]).cast(f"array<{sizes.schema['chunk_id'].dataType.simpleString()}>")
    every = needing.where(F.col("n") <= FEW).select(F.explode(F.slice(first, 1, (F.col("n") + k).cast("int"))).alias("chunk_id"), "query_id")
    many = needing.where(F.col("n") > FEW)
    if n := many.count():
        blocks = -(-n // BLOCK)
        asked = many.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("query_id").alias("ids"))
        met = sizes.select("chunk_id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(asked, "block")
        every = every.unionByName(met.select("chunk_id", F.explode("ids").alias("query_id")))
    rest = top(every.join(hits, ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0)), k).drop("rank")
    return top(hits.unionByName(rest.select(*hits.columns)), k)


def token_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = 512) -> DataFrame:
    """The distinct tokens of each chunk's first characters."""
    return docs.select(F.explode(terms(F.substring(text_col, 1, head))).alias("token"), F.col(id_col).alias("chunk_id")).distinct()
