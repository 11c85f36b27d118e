"""Text as Column expressions: words, sentences, sections, references, digests.

White space is ASCII white space throughout. Sentences end at . ! or ? before white space; the splitter and the word
count stand in for trained tokenizers and can be replaced by any function from Column to Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks the places where a text is cut; documents hold no such character.
MARK = "\u0001"

#: Headings of sections (fixed values), in any case, before a colon or white space.
HEADING = r"(?i)\b(FACTS?|HOLDING|REASONING|DISSENT|CONCLUSION|BACKGROUND)\b([:\s])"
#: References (fixed values): case citations of queries and of chunks, statutes, references in lower-cased text.
CITATION = r"\b\d+\s+[A-Z][a-z]+\.?\s+\d+\b|\bv\.\s+[A-Z][a-z]+"
CHUNK_CITATION = r"\b\d+\s+[A-Z][a-z]+\.?\s+\d+\b"
STATUTE = r"§\s*\d+|\bSection\s+\d+"
REFERENCE = r"(?:section|article|clause)\s+\d+[a-z]?"


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once for each row however often it is used, also inside of lambdas."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    """Trimmed sentences, without empty ones."""
    marked = F.regexp_replace(F.trim(squeeze(text)), r"([.!?])\s+", f"$1{MARK}")
    return F.filter(F.split(marked, MARK), lambda s: s != "")


def long_sentences(text: Column, over: int = 5) -> Column:
    return F.filter(sentences(text), lambda s: word_count(s) > over)


def character_count(text: Column) -> Column:
    return F.length(text)


def dot_pieces(text: Column) -> Column:
    """Pieces between full stops: one more than there are stops."""
    return F.size(F.split(text, r"\."))


def section_starts(text: Column) -> Column:
    """Headings as an array of (pos, section) in order; pos counts characters from 0."""
    pieces = F.split(F.regexp_replace(text, HEADING, f"{MARK}$1$2"), MARK)
    name = lambda piece: F.regexp_replace(F.regexp_extract(F.lower(piece), r"^(fact|holding|reasoning|dissent|conclusion|background)", 1), "^fact$", "facts")

    def starts(pieces: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda total, x: total + F.length(x))
        return F.slice(F.transform(pieces, lambda piece, i: F.named_struct(F.lit("pos"), before(i), F.lit("section"), name(piece))), 2, F.size(pieces))

    return let(pieces, starts)


def paragraphs_kept(text: Column) -> Column:
    """White space normalized with blank lines kept."""
    return F.regexp_replace(F.regexp_replace(text, r"\n\s*\n", "\n\n"), " +", " ")


def numbered_sections(text: Column) -> Column:
    """Spans from one "number." to the next or the end, before a last newline; what stands before the first is dropped."""
    pieces = F.split(F.regexp_replace(F.regexp_replace(paragraphs_kept(text), r"\n\z", ""), r"(\d+\.)", f"{MARK}$1"), MARK)
    return let(pieces, lambda p: F.slice(p, 2, F.size(p)))


def slices(text: Column, size: int) -> Column:
    """Pieces of fixed length as an array of (start, piece); none of an empty text."""
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.expr("0"), F.floor((F.length(text) - 1) / size).cast("int"))), lambda i: i * size)
    return F.when(F.length(text) > 0, F.transform(starts, lambda s: F.named_struct(F.lit("start"), s, F.lit("piece"), F.substr(text, s + 1, F.lit(size)))))


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def contained(text: Column, terms: list[str]) -> Column:
    """Of the terms, in their order, those that the lower-cased text holds."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>"), lambda t: low.contains(t))


def term_set(text: Column, keywords: list[str]) -> Column:
    """Keywords held and references to sections, articles and clauses, sorted, each once."""
    return F.array_sort(F.array_distinct(F.concat(contained(text, keywords), found(F.lower(text), REFERENCE))))


def digest16(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", *parts).cast("binary")), 1, 16)


def nonblank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"\s+", "") != "", F.lit(False))
