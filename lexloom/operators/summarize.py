"""Extractive summaries: sentence scores, diverse selection, sentence ranks."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import text as T
from . import dense


_TERM = re.compile(r"\w{2,}")
_GAP = re.compile(r"[ \t\n\v\f\r]+")


def position_score(idx: Column, n: Column) -> Column:
    """1, .9, .8 for the first three, .6, .7, .8 for the last three, .5 between; the first rule wins in short texts."""
    return F.when(idx < 3, 1.0 - idx * 0.1).when(idx >= n - 3, 0.8 - (n - idx - 1) * 0.1).otherwise(F.lit(0.5))


def lexicon_score(sentence: Column, tiers: dict[float, list[str]] = L.TIERS) -> Column:
    """Weights of the terms held, over the square root of the number of words."""
    total = sum((F.size(T.contained(sentence, terms)) * w for w, terms in tiers.items()), F.lit(0.0))
    return F.coalesce(F.try_divide(total, F.sqrt(T.word_count(sentence))), F.lit(0.0))


def term_weights(sentences: list[str], stop_words: frozenset[str], features: int) -> list[float]:
    """Each sentence's summed TF-IDF weights over the largest sum; see tfidf()."""
    n = len(sentences)
    if n < 2:
        return [1.0] * n
    counts = []
    for s in sentences:
        tokens = [t for t in _TERM.findall(s.lower()) if t not in stop_words]
        counts.append(Counter([*tokens, *map(" ".join, zip(tokens, tokens[1:], strict=False))]))
    totals, df = Counter(), Counter()
    for c in counts:
        totals.update(c)
        df.update(c.keys())
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in sorted(totals, key=lambda t: (-totals[t], t.encode()))[:features]}
    sums = []
    for c in counts:
        weights = [c[t] * idf[t] for t in c.keys() & idf.keys()]
        sums.append(math.fsum(weights) / math.sqrt(math.fsum(w * w for w in weights)) if weights else 0.0)
    largest = max(sums)
    return [s / largest for s in sums] if largest else [1.0] * n


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: list[str] | None = None, features: int = 100) -> DataFrame:
    """doc, idx, tfidf: each sentence's summed weights over its document's largest sum.

    The corpus is the document's sentences. Terms are words of two or more characters that aren't stop words, and pairs
    of neighbours among them; the most frequent ones of the document count, ties in order. Weights are counts times
    ln((1 + n) / (1 + df)) + 1, of unit length per sentence. Documents of one sentence, and those without terms, get 1.
    """
    stop = frozenset(L.STOP_WORDS if stop_words is None else stop_words)
    return per_document(docs, lambda sentences: list(enumerate(term_weights(sentences, stop, features))), "idx long, tfidf double", id_col, text_col)


def combined_scores(sentences: list[str], x: np.ndarray, stop_words: frozenset[str], tiers: dict[float, list[str]], weights: dict[str, float]) -> dict[str, list[float]]:
    """Position, tfidf, lexicon, semantic and their weighted sum, combined, of a document's sentences; x: their vectors."""
    n = len(sentences)
    centre = x.mean(axis=0)
    size = np.linalg.norm(x, axis=1) * np.linalg.norm(centre)
    out = {
        "position": [1.0 - i * 0.1 if i < 3 else 0.8 - (n - i - 1) * 0.1 if i >= n - 3 else 0.5 for i in range(n)],
        "tfidf": term_weights(sentences, stop_words, 100),
        "semantic": np.divide(x @ centre, size, out=np.zeros(n), where=size > 0).tolist(),
        "lexicon": [lexicon_weight(s, tiers) for s in sentences],
    }
    out["combined"] = [math.fsum(out[c][i] * w for c, w in weights.items()) for i in range(n)]
    return out


def lexicon_weight(sentence: str, tiers: dict[float, list[str]]) -> float:
    """As lexicon_score()."""
    low, words = sentence.lower(), len(_GAP.split(sentence.strip(" \t\n\v\f\r"))) if sentence.strip(" \t\n\v\f\r") else 0
    return sum(w * sum(t in low for t in terms) for w, terms in tiers.items()) / math.sqrt(words) if words else 0.0


def scored_sentences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiers: dict[float, list[str]] = L.TIERS, encoder: Callable[[str], list[float]] = dense.hashed_terms, weights: dict[str, float] = L.SENTENCE_WEIGHTS
) -> DataFrame:
    """Sentences with n, position, tfidf, lexicon, semantic (cosine with the document's centroid) and combined."""
    stop = frozenset(L.STOP_WORDS)

    def work(sentences: list[str]) -> list[tuple]:
        own = combined_scores(sentences, np.array([encoder(s) for s in sentences], np.float64), stop, tiers, weights)
        return list(zip(range(len(sentences)), [len(sentences)] * len(sentences), sentences, *(own[c] for c in SCORES), strict=True))

    return per_document(docs, work, f"idx long, n long, sentence string, {', '.join(f'{c} double' for c in SCORES)}", id_col, text_col)


SCORES = ("position", "tfidf", "lexicon", "semantic", "combined")


def summary(scored: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """The k best sentences of each document in their order, as rows and joined: id, n_selected, indices, summary."""
    # combined scores are rounded for the order, so that equal ones tie whatever the order of summation
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.round("combined", 9).desc(), "idx"))).where(F.col("r") <= k)
    kept = F.array_sort(F.collect_list(F.struct("idx", "sentence")))
    return best.groupBy(id_col).agg(F.count("*").alias("n_selected"), F.array_join(F.transform(kept, lambda s: s["idx"].cast("string")), ",").alias("indices"), F.array_join(F.transform(kept, lambda s: s["sentence"]), " ").alias("summary"))


def select_diverse(scores: np.ndarray, vectors: np.ndarray, k: int, weight: float = 0.7) -> list[int]:
    """Maximal marginal relevance: the best, then again and again the best of weight * score - (1 - weight) * nearest chosen."""
    n = len(scores)
    if n <= k:
        return list(range(n))
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    chosen = [int(np.argmax(scores))]
    nearest = unit @ unit[chosen[0]]
    free = np.ones(n, bool)
    free[chosen[0]] = False
    while len(chosen) < k:
        gain = np.where(free, weight * scores - (1 - weight) * nearest, -np.inf)
        chosen.append(int(np.argmax(gain)))
        free[chosen[-1]] = False
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return chosen


def sentence_rank(vectors: np.ndarray, damping: float = 0.85, rounds: int = 50) -> np.ndarray:
    """PageRank over cosine similarities, self-loops included, by power iteration without the matrix of all pairs."""
    n = len(vectors)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    out = unit @ unit.sum(axis=0)
    out = np.where(np.abs(out) > 1e-12, out, np.inf)  # a sentence like none, not even itself, passes nothing on
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        hanging = rank[np.isinf(out)].sum()
        rank = damping * (unit @ (unit.T @ (rank / out)) + hanging / n) + (1 - damping) / n
    return rank


def per_document(docs: DataFrame, work: Callable[[list[str]], list[tuple]], columns: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows that `work` makes of each document's sentences; nothing is shuffled, as a document's sentences are in its row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), T.long_sentences(F.coalesce(F.col(text_col), F.lit(""))).alias("sentences"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, made = [], []
            for i, sentences in zip(batch.column("id").to_pylist(), batch.column("sentences").to_pylist(), strict=True):
                own = work(sentences) if sentences else []
                ids += [i] * len(own)
                made += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([m[j] for m in made]) .cast(t) for j, t in enumerate(kinds))], names=[id_col, *names])

    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in columns.split(", ")]
    return rows.mapInArrow(run, f"`{id_col}` long, {columns}")


def diverse_summary(
    docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text", encoder: Callable[[str], list[float]] = dense.hashed_terms, tiers: dict[float, list[str]] = L.TIERS, weights: dict[str, float] = L.SENTENCE_WEIGHTS
) -> DataFrame:
    """doc, rank (order of choice), idx, sentence: sentences chosen by their combined score against their likeness to those chosen before."""
    stop = frozenset(L.STOP_WORDS)

    def work(sentences: list[str]) -> list[tuple]:
        x = np.array([encoder(s) for s in sentences], np.float64)
        scores = np.round(combined_scores(sentences, x, stop, tiers, weights)["combined"], 9)
        return [(r, i, sentences[i]) for r, i in enumerate(select_diverse(scores, x, k), 1)]

    return per_document(docs, work, "rank long, idx long, sentence string", id_col, text_col)


def ranked_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", encoder: Callable[[str], list[float]] = dense.hashed_terms) -> DataFrame:
    """doc, idx, textrank."""

    def work(sentences: list[str]) -> list[tuple]:
        return [(i, float(round(r, 9))) for i, r in enumerate(sentence_rank(np.array([encoder(s) for s in sentences], np.float64)))]

    return per_document(docs, work, "idx long, textrank double", id_col, text_col)


def summary_statistics(rows: DataFrame, text_col: str, summary_col: str) -> DataFrame:
    """rows with sentences and words of the summary and its compression in percent of characters."""
    s, t = F.col(summary_col), F.col(text_col)
    return rows.select(
        "*",
        F.size(T.sentences(s)).cast("long").alias("summary_sentences"),
        F.size(F.split(s, " ")).cast("long").alias("summary_words"),
        F.round((1 - F.coalesce(F.try_divide(F.length(s).cast("double"), F.length(t)), F.lit(1.0))) * 100).cast("long").alias("compression_pct"),
    )
