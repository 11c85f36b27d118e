"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def sentence_rows(docs: DataFrame, sentences: Column, id_col: str = "doc_id") -> DataFrame:
    """One row per sentence, numbered from 0."""
    return docs.select(id_col, F.posexplode(sentences).alias("idx", "sentence")).withColumn("idx", F.col("idx").cast("long"))


def section_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str = "title", size: int = 5, strict: bool = False) -> DataFrame:
    """A parent chunk (number 0: the first 1000 characters) and chunks of up to `size` sentences of one section.

    A sentence belongs to the last heading at or before its first occurrence in the text, or else to the section of the
    sentence before. By default a chunk also ends at a sentence that lies behind headings of more than one kind, as the
    described behaviour walks through all of them; strict=True ends it only where the section changes.
    """
    squeezed = docs.select(F.col(id_col).alias("doc"), F.col(title_col).alias("title"), T.squeeze(F.col(text_col)).alias("text"))
    rows = squeezed.select("doc", "title", "text", T.section_starts(F.col("text")).alias("starts"), T.sentences(F.col("text")).alias("sentences"))
    rows = rows.select("doc", "title", "text", "starts", F.posexplode("sentences").alias("idx", "sentence"))  # after it, starts would be worked out for each sentence
    passed = T.let(F.instr(F.col("text"), F.col("sentence")) - 1, lambda at: F.transform(F.filter("starts", lambda s: s["pos"] <= at), lambda s: s["section"]))
    rows = rows.select("doc", "title", "idx", "sentence", passed.alias("passed"))
    order = Window.partitionBy("doc").orderBy("idx")
    rows = rows.withColumn("section", F.coalesce(F.last(F.try_element_at("passed", F.lit(-1)), ignorenulls=True).over(order), F.lit("introduction")))
    before = F.lag("section", 1, "introduction").over(order)
    if strict:
        ends = F.col("section") != before
    else:
        ends = F.coalesce((F.array_min("passed") != before) | (F.array_max("passed") != before), F.lit(False))
    rows = rows.withColumn("island", F.sum(ends.cast("long")).over(order))
    rows = rows.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("doc", "island").orderBy("idx")) - 1) / size))
    chunks = rows.groupBy("doc", "title", "island", "part").agg(
        F.first("section").alias("section"),
        F.count("*").alias("n_sentences"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sentence"))), lambda s: s["sentence"]), " ").alias("text"),
    )
    chunks = chunks.withColumn("chunk_ord", F.row_number().over(Window.partitionBy("doc").orderBy("island", "part")).cast("long"))
    chunks = chunks.select(F.col("doc").alias(id_col), "chunk_ord", "section", "n_sentences", "text", T.digest16(F.col("title"), F.col("section"), F.col("chunk_ord").cast("string")).alias("chunk_id"))
    parents = squeezed.select(
        F.col("doc").alias(id_col), F.lit(0).cast("long").alias("chunk_ord"), F.lit("full").alias("section"), F.lit(0).cast("long").alias("n_sentences"), F.substring("text", 1, 1000).alias("text"), T.digest16(F.col("title"), F.lit("parent")).alias("chunk_id")
    )
    return parents.unionByName(chunks)


def _packed(pieces: Column, budget: int, overlap) -> Column:
    """Greedy packing of pieces into lists: a piece that would pass the budget starts a new list, after overlap(list so far)."""
    empty = F.array().cast("array<string>")
    count = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + T.word_count(x))
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("now"), F.lit(0).alias("tokens"))

    def add(state: Column, piece: Column) -> Column:
        def with_count(n: Column) -> Column:
            full = (state["tokens"] + n > budget) & (F.size(state["now"]) > 0)
            rest = overlap(state["now"])
            return F.struct(
                F.when(full, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"]).alias("done"),
                F.when(full, F.concat(rest, F.array(piece))).otherwise(F.concat(state["now"], F.array(piece))).alias("now"),
                F.when(full, count(rest) + n).otherwise(state["tokens"] + n).alias("tokens"),
            )

        return T.let(T.word_count(piece), with_count)

    return F.aggregate(pieces, start, add, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def paragraph_pack(text: Column, budget: int = 400) -> Column:
    """Paragraphs packed to a token budget; the last paragraph is repeated if the chunk had more than one."""
    pieces = F.split(T.paragraphs_kept(text), "\n\n")
    return F.transform(_packed(pieces, budget, lambda now: F.when(F.size(now) > 1, F.slice(now, -1, 1)).otherwise(F.array().cast("array<string>"))), lambda c: F.array_join(c, "\n\n"))


def section_pack(text: Column, budget: int = 400) -> Column:
    """Numbered sections within the budget whole, larger ones as packed sentences with a quarter of them repeated."""
    kept = lambda now: F.slice(now, -F.greatest(F.lit(1), F.floor(F.size(now) / 4).cast("int")), F.greatest(F.lit(1), F.size(now)))
    split = lambda s: F.transform(_packed(T.sentences(s), budget, lambda now: F.when(F.size(now) > 0, kept(now)).otherwise(now)), lambda c: F.array_join(c, " "))
    return F.flatten(F.transform(T.numbered_sections(text), lambda s: F.when(T.word_count(s) <= budget, F.array(s)).otherwise(split(s))))


def budget_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 400, session: str = "", keywords: list[str] | None = None) -> DataFrame:
    """Chunks within a token budget: by numbered sections where a text has any, else by paragraphs."""
    text = F.col(text_col)
    packed = F.when(F.size(T.numbered_sections(text)) > 0, section_pack(text, budget)).otherwise(paragraph_pack(text, budget))
    rows = docs.select(F.col(id_col), packed.alias("chunks")).select(id_col, F.size("chunks").cast("long").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "text"))
    title = F.concat(F.lit("doc "), F.col(id_col).cast("string"))
    return rows.select(
        id_col,
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "total_chunks",
        T.word_count(F.col("text")).cast("long").alias("n_tokens"),
        F.length("text").cast("long").alias("text_length"),
        T.digest16(F.lit(session), title, F.col("chunk_index").cast("string"), F.substring("text", 1, 50)).alias("chunk_id"),
        F.array_join(T.term_set(F.col("text"), keywords or []), "|").alias("terms"),
        "text",
    )


def text_slices(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts cut into pieces of fixed length with their offsets, so that spans found in a piece can be shifted back."""
    rows = docs.select(id_col, F.posexplode(T.slices(F.col(text_col), size)).alias("slice", "s"))
    return rows.select(id_col, F.col("slice").cast("long").alias("slice"), F.col("s.start").cast("long").alias("start"), F.col("s.piece").alias("text"))
