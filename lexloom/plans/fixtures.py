"""Documents composed from the synthetic tables so that headings, citations and names occur in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.entities import Joined
from ..session import table

QUESTIONS = [
    (1, "What case held negligence under 12 Rep. 5"),
    (2, "meaning of Section 10 on damages and breach"),
    (3, "what happened in the dispute"),
    (4, "how to file for jurisdiction"),
    (5, "compare hearsay versus privilege in Doe v. Smith"),
    (6, "the the of"),
    (7, "released license"),
    (8, "because thion qui"),
]
TERM_QUERIES = [(1, "the thion of"), (2, "qui que the the"), (3, "released license zzzz"), (4, "der und thion")]
TERMS = ["released", "license", "thion", "the", "qui", "und", "que", "stre", "of"]
TIERS = {3.0: ["released", "license", "thion"], 2.0: ["qui", "und", "que"], 1.0: ["the", "stre", "of"]}
FILES = [
    ("brief.TXT", "48656C6C6F", 5), ("scan.jpeg", "FFD8FFE0", 52428800), ("no_extension", "255044462D", 9), ("archive.bin", "504B0304", 52428801),
    ("photo.gif", "47494638", 100), ("notes.md", None, None), ("claim.docx", "504B0304", 60000000), ("letter", "00FF", 3), ("draft.pdf", "2550", 10), (None, "89504E47", 4),
]
REQUESTS = [(1, 0), (2, 3), (3, 9), (4, None)]


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def questions(spark: SparkSession, rows: list[tuple] = QUESTIONS) -> DataFrame:
    return literal(spark, rows, "query_id long, text string")


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in thirds under three headings, the last with what it cites."""
    docs = cited(spark, sf_dir)
    third = F.floor(F.length("body") / 3).cast("int")
    text = F.concat(F.lit("BACKGROUND: "), F.substr("body", F.lit(1), third), F.lit(" FACTS: "), F.substr("body", third + 1, third), F.lit(" HOLDING: "), F.substr("body", third * 2 + 1, F.length("body")), "citation")
    return docs.select("doc_id", "title", "session_id", text.alias("text"))


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a case citation, made of its order's customer, and a statute, which four documents share."""
    docs, orders = table(spark, sf_dir, "documents"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = docs.join(orders, docs["doc_id"] == orders["o_orderkey"], "left")
    customer = F.coalesce("o_custkey", "doc_id")
    citation = F.concat(F.lit(" See "), customer.cast("string"), F.lit(" Rep. "), (customer % 7).cast("string"), F.lit(" and Section "), F.expr("doc_id div 4").cast("string"), F.lit("."))
    return rows.select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), (F.col("doc_id") % 4).alias("session_id"), F.col("text").alias("body"), citation.alias("citation"), F.concat("text", citation).alias("text"))


def organization_names(spark: SparkSession, sf_dir: str) -> Joined:
    """Entities that join a customer's and a supplier's name, by nation."""
    label = F.when(F.col("c_custkey") % 3 == 0, "PRECEDENT").when(F.col("c_custkey") % 3 == 1, "ORG").otherwise("PERSON")
    firsts = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), label.alias("label"), F.col("c_name").alias("name"))
    seconds = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("doc_id"), F.col("s_name").alias("name"))
    return Joined(firsts.where("doc_id is not null"), seconds.where("doc_id is not null"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items as questions of different intents, each with the citation of the document that has its number."""
    items, docs = table(spark, sf_dir, "benchmark"), cited(spark, sf_dir)
    prefix = F.when(F.col("item_id") % 3 == 0, "What case held: ").when(F.col("item_id") % 3 == 1, "what happened: ").otherwise("")
    rows = items.join(docs.select("doc_id", "citation"), items["item_id"] == docs["doc_id"], "left")
    return rows.select(F.col("item_id").alias("query_id"), F.concat(prefix, "text", F.coalesce("citation", F.lit(""))).alias("text"))
