"""The engine's surface: DataFrames of documents and questions in, DataFrames of results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexicon as L
from .functions import text as T
from .operators import chunking, dense, entities, keyword, retrieval, sessions, summarize
from .session import saved


#: The session of documents that name none.
DEFAULT = "default"
NOTHING_FOUND = "No relevant documents found for your query."
NO_ANSWERER = "No model for answers is plugged in."


class Engine:
    """Documents have doc_id, text, and optionally title and session_id; questions have query_id and text.

    encoder, recognizer, generator (of refined summaries), hypothesis (of a made-up answer to a question, one more form of
    it) and answerer (of an answer from a question and its context) stand for trained models, the last four as functions of
    columns; the defaults are deterministic: hashed terms, patterns, and no generated text.
    """

    def __init__(
        self,
        spark: SparkSession,
        encoder: Callable[[str], list[float]] = dense.hashed_terms,
        recognizer=entities.extracted,
        generator: Callable | None = None,
        concepts: dict[str, list[str]] = L.CONCEPTS,
        hypothesis: Callable | None = None,
        answerer: Callable | None = None,
    ):
        self.spark, self.encoder, self.recognizer, self.generator, self.concepts = spark, encoder, recognizer, generator, concepts
        self.hypothesis, self.answerer = hypothesis, answerer

    def entities(self, docs: DataFrame) -> DataFrame:
        """doc_id, text, entity_type, importance: one row per occurrence."""
        rows = docs.select("doc_id", F.explode(self.recognizer(F.col("text"))).alias("e"))
        return rows.select("doc_id", "e.text", "e.entity_type", "e.importance")

    def summarize(self, docs: DataFrame, k: int = 5, mmr: bool = True) -> DataFrame:
        if mmr:
            chosen = summarize.diverse_summary(docs, k, encoder=self.encoder)
            kept = F.array_sort(F.collect_list(F.struct("idx", "sentence")))
            out = chosen.groupBy("doc_id").agg(F.count("*").alias("n_selected"), F.array_join(F.transform(kept, lambda s: s["sentence"]), " ").alias("summary"))
        else:
            out = summarize.summary(summarize.scored_sentences(docs, encoder=self.encoder), k)
        return out.withColumn("refined_summary", self.generator(F.col("summary")) if self.generator else F.col("summary"))

    def analyze(self, docs: DataFrame, k: int = 5) -> DataFrame:
        """Text statistics, summary and entity counts per document."""
        stats = docs.select("doc_id", T.character_count(F.col("text")).alias("character_count"), T.word_count(F.col("text")).alias("word_count"), T.dot_pieces(F.col("text")).alias("sentence_count"))
        found = self.entities(docs).groupBy("doc_id").agg(F.count("*").alias("total_entities"), F.sort_array(F.collect_set("entity_type")).alias("unique_labels"))
        return stats.join(self.summarize(docs, k), "doc_id", "left").join(found, "doc_id", "left")

    def index(self, docs: DataFrame) -> dict[str, DataFrame]:
        """chunks, postings, lengths, chunk_entities, vectors; keyed by chunk_id, written to the shared folder.

        Documents keep their title and session; without a title column they are called by their number, and without a
        session_id column all are in the session DEFAULT. A doc_id stands for one document of a session.
        """
        title = F.coalesce(F.col("title"), F.lit("Untitled")) if "title" in docs.columns else F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
        session = F.col("session_id").cast("string") if "session_id" in docs.columns else F.lit(DEFAULT)
        own = docs.select(F.struct(session.alias("session_id"), "doc_id").alias("key"), title.alias("title"), "text")
        rows = chunking.section_chunks(own, "key", "text", "title").drop("chunk_id").join(own.select("key", "title"), "key")
        rows = rows.select("key.session_id", "key.doc_id", "chunk_ord", "section", "text", F.xxhash64("key.session_id", "key.doc_id", "chunk_ord").alias("chunk_id"), "title")
        score = entities.importance(F.col("section"), self.recognizer(F.col("text")), F.col("text"), L.concept_terms(self.concepts))
        chunks = saved(rows.withColumn("importance", score), "chunks")
        return {
            "chunks": chunks,
            "postings": saved(keyword.postings(chunks, "chunk_id"), "postings"),
            "lengths": saved(keyword.lengths(chunks, "chunk_id"), "lengths"),
            "chunk_entities": saved(entities.entity_rows(chunks, "chunk_id", "text"), "chunk-entities"),
            "vectors": saved(dense.embedded(chunks.select("chunk_id", "text"), "text", "vector", self.encoder).drop("text"), "vectors"),
        }

    def graph(self, index: dict[str, DataFrame]) -> DataFrame:
        """The concept graph's edges: every pair of chunks that share an entity. Retrieval itself reads no edges."""
        return entities.shared_edges(index["chunk_entities"])

    def of_session(self, index: dict[str, DataFrame], session: str | None) -> dict[str, DataFrame]:
        """The index of one session alone, with its own term statistics; of all sessions for None."""
        if session is None:
            return index
        chunks = index["chunks"].where(F.col("session_id") == session)
        return {"chunks": chunks, **{name: rows.join(chunks.select("chunk_id"), "chunk_id", "left_semi") for name, rows in index.items() if name != "chunks"}}

    def search(self, queries: DataFrame, index: dict[str, DataFrame], top_k: int = 10, session: str | None = None, profile: str = "advanced", rerank: bool = False) -> DataFrame:
        """Ranked chunks of each question: query_id, chunk_id, score, rank (the advanced profile also section).

        The advanced profile joins dense, keyword, entity and graph scores. The session profile takes dense hits, then
        keyword hits at a lower weight; with rerank they are sorted by a mix with the cosine of the chunks' first characters.
        """
        index = self.of_session(index, session)
        if profile == "session":
            return self._session_search(queries, index, top_k, rerank)
        asked = saved(retrieval.analyzed(queries, self.concepts, self.hypothesis), "questions")
        forms = asked.select("query_id", F.posexplode(F.slice("expanded_queries", 1, 3)).alias("ord", "text"))
        vectors = dense.embedded(forms, "text", "vector", self.encoder)
        near = retrieval.last_dense(vectors, index["vectors"], 2 * top_k)
        words = keyword.bm25_top(asked, index["postings"], index["lengths"], keyword.OKAPI, 2 * top_k)
        named = entities.matches(asked.select("query_id", F.explode(F.transform(self.recognizer(F.col("text")), lambda e: e["text"])).alias("entity")), index["chunk_entities"])
        found = retrieval.candidates(near, words, named, index["chunk_entities"])
        hits = retrieval.fused(found, asked, index["chunks"], 2 * top_k if rerank else top_k)
        if not rerank:
            return hits
        own = retrieval.cross_reranked(hits, queries, index["chunks"].select("chunk_id", "text"), top_k, self.encoder)
        return own.join(hits.select("query_id", "chunk_id", "section"), ["query_id", "chunk_id"])

    def _session_search(self, queries: DataFrame, index: dict[str, DataFrame], top_k: int, rerank: bool) -> DataFrame:
        asked = saved(dense.embedded(queries.select("query_id", "text"), "text", "vector", self.encoder), "asked")
        near = saved(dense.dense_top(asked.select("query_id", "vector"), index["vectors"], 3 * top_k), "near")
        found = retrieval.session_candidates(near, keyword.bm25_top(asked, index["postings"], index["lengths"], keyword.SESSION, 3 * top_k))
        if not rerank:
            return retrieval.session_top(found, top_k)
        heads = dense.embedded(index["chunks"].select("chunk_id", "text"), "text", "vector", self.encoder, head=512)
        return retrieval.reranked(found, asked, heads, 2 * top_k).where(F.col("rank") <= top_k)

    def answer(self, queries: DataFrame, index: dict[str, DataFrame], top_k: int = 5, session: str | None = None) -> DataFrame:
        """A row for each question: answer, error, confidence, context and sources.

        The answerer gets the question and the context. Without one there is no answer but an error; context and sources
        don't depend on it. A question without results has no context, and its answer says so.
        """
        hits, chunks = saved(self.search(queries, index, top_k, session), "hits"), index["chunks"].select("chunk_id", "title", "text")
        sources = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "title", "section", "score", "excerpt", "entities")))
        rows = queries.select("query_id", "text").join(retrieval.prompt(hits, chunks), "query_id", "left").join(retrieval.confidence(hits), "query_id", "left")
        rows = rows.join(retrieval.sources(hits, chunks).groupBy("query_id").agg(sources.alias("sources")), "query_id", "left")
        given = self.answerer(F.col("text"), F.col("context")) if self.answerer else F.lit(None).cast("string")
        none = F.col("context").isNull()
        return rows.select(
            "query_id",
            F.when(none, NOTHING_FOUND).otherwise(given).alias("answer"),
            F.when(none, NOTHING_FOUND).when(F.lit(self.answerer is None), NO_ANSWERER).alias("error"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            "context",
            "sources",
        )

    def sessions(self, docs: DataFrame) -> DataFrame:
        return sessions.info(docs)
