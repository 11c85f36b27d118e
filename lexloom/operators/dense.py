"""Vectors of texts and exact vector search in blocks."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyword import top

#: Rows of a block on either side of a search.
BLOCK = 1024


@functools.lru_cache(maxsize=200_000)
def _feature(term: str) -> tuple[int, float]:
    digest = hashlib.md5(term.encode()).hexdigest()
    return int(digest[:8], 16), 1.0 if int(digest[8], 16) < 8 else -1.0


def hashed_terms(text: str, width: int = 64) -> list[float]:
    """Default encoder: signed feature hashing of lower-cased words, by their MD5."""
    out = [0.0] * width
    for term in text.lower().split():
        place, sign = _feature(term)
        out[place % width] += sign
    return out


def embedded(rows: DataFrame, text_col: str, out_col: str, encoder: Callable[[str], list[float]] = hashed_terms, unit: bool = True, head: int | None = None) -> DataFrame:
    """rows with out_col, the encoder's vector of each text (of its first `head` characters if given), null as empty."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "")[:head] for t in batch.column(text_col).to_pylist()]
            x = np.array([encoder(t) for t in texts], np.float64).reshape(len(texts), -1)
            if unit:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x), pa.list_(pa.float64()))], names=[*batch.schema.names, out_col])

    return rows.mapInArrow(run, f"{columns}, `{out_col}` array<double>")


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of one length as rows, without Python objects."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def dense_top(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k largest inner products of each query: query_id, chunk_id, score, rank; ties by chunk_id.

    queries: query_id, vector; chunks: chunk_id, vector. Both sides are packed into blocks; every chunk block meets every
    query block once, and only its k best per query go on. A null vector is in no result.
    """
    count = max(1, -(-queries.count() // BLOCK))
    asked = queries.where("vector is not null").select(F.pmod(F.xxhash64("query_id"), F.lit(count)).cast("int").alias("block"), "query_id", F.col("vector").cast("array<double>").alias("vector"))
    asked = asked.groupBy("block").agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(c)])) for c in ("chunk_id", "vector")]
                yield pa.RecordBatch.from_arrays(lists, names=["ids", "vectors"])

    rows = chunks.where("vector is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("vector").cast("array<double>").alias("vector"))
    packed = rows.mapInArrow(pack, "ids array<long>, vectors array<array<double>>")
    met = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(asked, "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values.to_numpy(zero_copy_only=False)
                own = _matrix(batch.column("vectors")[row].values)
                wanted = batch.column("asked")[row].values
                asked_ids = wanted.field("query_id").to_numpy(zero_copy_only=False)
                scores = np.round(_matrix(wanted.field("vector")) @ own.T, 9)  # equal vectors tie
                best = [np.lexsort((ids, -s))[:k] for s in scores]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(asked_ids, [len(b) for b in best]), pa.int64()), pa.array(np.concatenate([ids[b] for b in best])), pa.array(np.concatenate([s[b] for s, b in zip(scores, best, strict=True)]))],
                    names=["query_id", "chunk_id", "score"],
                )

    return top(met.select("ids", "vectors", "asked").mapInArrow(compare, "query_id long, chunk_id long, score double"), k)


def centroids(rows: DataFrame, key: str, vector_col: str, unit: bool = False) -> DataFrame:
    """Element-wise means per key as rows: key, dim, value; of unit length if asked."""
    parts = rows.select(key, F.posexplode(F.col(vector_col).cast("array<double>")).alias("dim", "x"))
    out = parts.groupBy(key, "dim").agg(F.avg("x").alias("value"))
    if unit:
        size = out.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
        out = out.join(size, key).select(key, "dim", (F.col("value") / F.greatest("size", F.lit(1e-9))).alias("value"))
    return out.withColumn("dim", F.col("dim").cast("long"))


def centroid_cosine(rows: DataFrame, id_col: str, key: str, vector_col: str) -> DataFrame:
    """id, key, cosine of each vector with its key's centroid; 0 for a zero vector."""
    parts = rows.select(id_col, key, F.posexplode(F.col(vector_col).cast("array<double>")).alias("dim", "x"))
    met = parts.withColumn("dim", F.col("dim").cast("long")).join(centroids(rows, key, vector_col), [key, "dim"])
    sums = met.groupBy(id_col, key).agg(F.sum(F.col("x") * F.col("value")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("value") * F.col("value")).alias("yy"))
    return sums.select(id_col, key, F.coalesce(F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")), F.lit(0.0)).alias("cosine"))
