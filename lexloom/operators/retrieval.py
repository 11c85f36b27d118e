"""Questions: analysis, expansion, hybrid retrieval in two profiles, evidence and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import text as T
from . import dense, entities, keyword


def intent(question: Column, intents: dict[str, list[str]] = L.INTENTS) -> Column:
    """The first intent, in listed order, any of whose patterns the lower-cased question holds, else general."""
    low, out = F.lower(question), F.lit("general")
    for name, patterns in reversed(intents.items()):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | low.contains(p)
        out = F.when(hit, name).otherwise(out)
    return out


def related(question: Column, concepts: dict[str, list[str]] = L.CONCEPTS) -> Column:
    """For each concept held, in order, the others of its category."""
    low = F.lower(question)
    none = F.array().cast("array<string>")
    parts = [F.when(low.contains(t), F.array(*(F.lit(o) for o in terms if o != t))).otherwise(none) for terms in concepts.values() for t in terms]
    return F.concat(*parts)


def expansions(question: Column, hypothetical: Column | None = None, concepts: dict[str, list[str]] = L.CONCEPTS) -> Column:
    """The question, with up to three related concepts, rephrased by intent, and a hypothetical answer if there is one."""
    more = related(question, concepts)
    kind = intent(question)
    none = F.lit(None).cast("string")
    text = lambda prefix: F.concat(F.lit(prefix), question)
    return F.array_compact(
        F.array(
            question,
            F.when(F.size(more) > 0, F.concat_ws(" ", question, F.array_join(F.slice(more, 1, 3), " "))),
            F.when(kind == "precedent", text("legal precedent case law ")).when(kind == "statute_interpretation", text("statutory interpretation meaning ")),
            F.when(kind == "precedent", text("court held ruling ")).when(kind == "statute_interpretation", text("legislative intent purpose ")),
            none if hypothetical is None else hypothetical,
        )
    )


def analyzed(queries: DataFrame, concepts: dict[str, list[str]] = L.CONCEPTS, hypothetical=None) -> DataFrame:
    """query_id, text, query_type, citations, key_concepts, expanded_queries; hypothetical: a function of the question to a made-up answer."""
    q = F.col("text")
    return queries.select("query_id", "text", intent(q).alias("query_type"), T.found(q, T.CITATION).alias("citations"), T.contained(q, L.concept_terms(concepts)).alias("key_concepts"), expansions(q, hypothetical(q) if hypothetical else None, concepts).alias("expanded_queries"))


def last_dense(queries: DataFrame, chunks: DataFrame, k: int, combine: str = "last") -> DataFrame:
    """Dense hits of several vectors of one question (query_id, ord, vector): a later one's score replaces an earlier one's.

    combine="max" keeps the largest instead. Returns query_id, chunk_id, score, and ord, the first vector with that hit.
    """
    keyed = queries.withColumn("key", F.xxhash64("query_id", "ord"))
    hits = dense.dense_top(keyed.select(F.col("key").alias("query_id"), "vector"), chunks, k).withColumnRenamed("query_id", "key")
    hits = hits.join(keyed.select("key", "query_id", "ord"), "key")
    best = F.max("score") if combine == "max" else F.max_by("score", "ord")
    return hits.groupBy("query_id", "chunk_id").agg(best.alias("score"), F.min("ord").alias("ord"), F.min_by("rank", "ord").alias("rank"))


def candidates(dense_hits: DataFrame, bm25_hits: DataFrame, entity_hits: DataFrame, chunk_entities: DataFrame, seeds: int = 5, most: int = 3) -> DataFrame:
    """All stages' scores per query and chunk: dense, bm25, entity, and graph (0.5) for neighbours of the first candidates.

    Candidates are in the order in which the stages find them: dense by vector and rank, then keyword hits by rank, then
    entity matches by id. Seeds are the first five; neighbours, which share an entity (chunk_entities: chunk_id, entity) with a
    seed, get no graph score where they are candidates already.
    """
    stage = lambda df, number, name, order: df.select("query_id", "chunk_id", F.lit(name).alias("stage"), F.col("score").alias("score"), F.struct(F.lit(number).alias("s"), *order).alias("found"))
    zero = F.lit(0).cast("long")
    rows = stage(dense_hits, 1, "dense", (F.col("ord").cast("long").alias("a"), F.col("rank").cast("long").alias("b")))
    rows = rows.unionByName(stage(bm25_hits, 2, "bm25", (zero.alias("a"), F.col("rank").cast("long").alias("b"))))
    rows = rows.unionByName(stage(entity_hits, 3, "entity", (zero.alias("a"), F.col("chunk_id").cast("long").alias("b"))))
    own = rows.groupBy("query_id", "chunk_id").agg(*(F.max(F.when(F.col("stage") == n, F.col("score"))).alias(n) for n in ("dense", "bm25", "entity")), F.min("found").alias("found"))
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("found"))).where(F.col("n") <= seeds)
    near = entities.first_neighbours(first, chunk_entities, most).select("query_id", "chunk_id").distinct().join(own, ["query_id", "chunk_id"], "left_anti")
    return own.drop("found").withColumn("graph", F.lit(None).cast("double")).unionByName(near.select("query_id", "chunk_id", *(F.lit(None).cast("double").alias(n) for n in ("dense", "bm25", "entity")), F.lit(0.5).alias("graph")))


def fused(found: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, weights: dict[str, float] = L.FUSION_WEIGHTS) -> DataFrame:
    """The k best candidates of each query by the weighted sum of normalized scores, times importance and section boost.

    queries: query_id, query_type; chunks: chunk_id, section, importance.
    """
    parts = {"dense": (F.col("dense") + 1) / 2, "bm25": F.least(F.col("bm25") / 10, F.lit(1.0)), "entity": F.least(F.col("entity") / 3, F.lit(1.0)), "graph": F.col("graph")}
    total = sum((F.coalesce(parts[n] * w, F.lit(0.0)) for n, w in weights.items()), F.lit(0.0))
    boost = F.when(((F.col("query_type") == "precedent") & (F.col("section") == "holding")) | ((F.col("query_type") == "factual") & (F.col("section") == "facts")), 1.5).otherwise(1.0)
    rows = found.join(queries.select("query_id", "query_type"), "query_id").join(chunks.select("chunk_id", "section", "importance"), "chunk_id")
    return keyword.top(rows.select("query_id", "chunk_id", "section", (total * F.col("importance") * boost).alias("score")), k)


def confidence(results: DataFrame) -> DataFrame:
    """Mean of the three best scores as a percentage, at most 100."""
    return results.where("rank <= 3").groupBy("query_id").agg(F.least(F.avg("score") * 100, F.lit(100.0)).alias("confidence"))


def sources(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence rows: the first 200 characters of the text and the first five entities. chunks: chunk_id, title, text."""
    rows = results.join(chunks.select("chunk_id", "title", "text"), "chunk_id")
    names = F.transform(F.slice(entities.extracted(F.col("text")), 1, 5), lambda e: e["text"])
    return rows.select("query_id", "rank", "chunk_id", "title", "section", "score", F.concat(F.substring("text", 1, 200), F.lit("...")).alias("excerpt"), F.array_join(names, "|").alias("entities"))


def prompt(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """One text per query: a block per source in order, joined by rules."""
    rows = results.join(chunks.select("chunk_id", "title", "text"), "chunk_id")
    names = F.array_join(F.transform(F.slice(entities.extracted(F.col("text")), 1, 3), lambda e: e["text"]), ", ")
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit(" ("), F.col("section"), F.lit(", "), F.format_string("%.2f", F.round("score", 2)), F.lit(")\n"), F.substring("text", 1, 800), F.lit("\nEntities: "), names)
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda b: b["block"])
    return rows.groupBy("query_id").agg(F.array_join(blocks, "\n---\n").alias("context"))


def session_candidates(dense_hits: DataFrame, bm25_hits: DataFrame, weight: float = 0.3) -> DataFrame:
    """Dense hits in rank order, then keyword hits that aren't among them at a lower weight: query_id, chunk_id, score, place."""
    extra = bm25_hits.join(dense_hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    rows = dense_hits.select("query_id", "chunk_id", "score", F.struct(F.lit(1).alias("stage"), F.col("rank").alias("r")).alias("place"))
    return rows.unionByName(extra.select("query_id", "chunk_id", (F.col("score") * weight).alias("score"), F.struct(F.lit(2).alias("stage"), F.col("rank").alias("r")).alias("place")))


def session_top(found: DataFrame, k: int) -> DataFrame:
    """The first k in candidate order (without reranking the order is that of the stages)."""
    order = Window.partitionBy("query_id").orderBy("place", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def reranked(found: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """0.6 of the score plus 0.4 of the cosine of the rerank vectors, sorted, cut to k. queries, chunks: id, vector."""
    from ..functions import vectors as V

    rows = found.join(queries.select("query_id", F.col("vector").alias("qv")), "query_id").join(chunks.select("chunk_id", F.col("vector").alias("cv")), "chunk_id")
    return keyword.top(rows.select("query_id", "chunk_id", (0.6 * F.col("score") + 0.4 * V.cosine(F.col("qv"), F.col("cv"))).alias("score")), k)


def passages(results: DataFrame, most: int = 3, near: float = 0.5) -> DataFrame:
    """Of each result's sentences (query_id, chunk_id, idx, sentence, similarity, n) the most similar ones and similar neighbours.

    Texts of up to `most` sentences are kept whole; else the best `most`, each neighbour above `near`, and of those the
    first most + 1 in order.
    """
    own = Window.partitionBy("query_id", "chunk_id")
    rows = results.withColumn("best", F.row_number().over(own.orderBy(F.col("similarity").desc(), F.col("idx").desc())) <= most)
    by = own.orderBy("idx")
    beside = F.coalesce(F.lag("best").over(by), F.lit(False)) | F.coalesce(F.lead("best").over(by), F.lit(False))
    rows = rows.withColumn("kept", F.col("best") | (beside & (F.col("similarity") > near)) | (F.col("n") <= most)).where("kept")
    rows = rows.withColumn("place", F.row_number().over(by).cast("long"))
    return rows.where((F.col("place") <= most + 1) | (F.col("n") <= most)).select("query_id", "chunk_id", "place", "idx", "sentence")


def cut_text(text: Column, most: int = 2000) -> Column:
    """Texts over `most` characters end before the first sentence that would pass it."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("size"), F.lit(False).alias("over"))

    def add(state: Column, s: Column) -> Column:
        over = state["over"] | (state["size"] + F.length(s) > most)
        joined = F.when(state["size"] == 0, s).otherwise(F.concat(state["out"], F.lit(" "), s))
        return F.struct(F.when(over, state["out"]).otherwise(joined).alias("out"), F.when(over, state["size"]).otherwise(state["size"] + F.length(s)).alias("size"), over.alias("over"))

    return F.when(F.length(text) > most, F.aggregate(T.sentences(text), start, add, lambda s: s["out"])).otherwise(text)


def within_budget(contexts: DataFrame, most_words: int = 3000) -> DataFrame:
    """Contexts (query_id, rank, text) in order until one takes the words past the budget, that one included."""
    n = T.word_count(F.col("text")).cast("long")
    before = F.sum(n).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return contexts.withColumn("words", n).withColumn("words_before", F.coalesce(before, F.lit(0))).where(F.col("words_before") <= most_words)


def cross_reranked(results: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, encoder=dense.hashed_terms, head: int = 400) -> DataFrame:
    """Results by a pair's own score: the sigmoid of the mean of the vector of the question with the chunk's first characters."""
    rows = results.select("query_id", "chunk_id").join(queries.select("query_id", F.col("text").alias("question")), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    rows = rows.select("query_id", "chunk_id", F.concat("question", F.lit(" "), F.substr("text", F.lit(1), F.lit(head))).alias("pair"))
    rows = dense.embedded(rows, "pair", "vector", encoder, unit=False).drop("pair")
    mean = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x) / F.size("vector")
    return keyword.top(rows.select("query_id", "chunk_id", (1 / (1 + F.exp(-mean))).alias("score")), k)


def token_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", encoder=dense.hashed_terms, most: int = 512) -> DataFrame:
    """A row for each of a text's first tokens with its own vector: id, idx, token, vector; special tokens are left out."""
    tokens = F.filter(F.slice(keyword.terms(F.col(text_col)), 1, most), lambda t: ~t.isin("[cls]", "[sep]", "[pad]"))
    rows = docs.select(id_col, tokens.alias("tokens")).select(id_col, F.posexplode("tokens").alias("idx", "token"))
    return dense.embedded(rows, "token", "vector", encoder)
