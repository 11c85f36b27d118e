"""Operators on small frames, and against plain restatements of what they mean."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions import vectors as V
from lexloom.operators import chunking, dense, entities, keyword, retrieval, sessions, summarize


def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"doc {i}") for i, t in enumerate(texts)], "doc_id long, text string, title string")


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize(("text", "words", "sentences"), [("", 0, []), ("  \n ", 0, []), ("One.", 1, ["One."]), ("A b. C d! E?", 5, ["A b.", "C d!", "E?"]), ("no end\n here", 3, ["no end here"])])
def test_words_and_sentences(spark, text, words, sentences):
    assert one(spark, T.word_count, text) == words
    assert one(spark, T.sentences, text) == sentences


def test_numbered_sections(spark):
    assert one(spark, T.numbered_sections, "before 1. one 2. two\n") == ["1. one ", "2. two"]
    assert one(spark, T.numbered_sections, "none") == []


def test_term_set_and_citations(spark):
    assert one(spark, lambda t: T.term_set(t, ["court", "writ"]), "The Court cited Section 5a and section 5a") == ["court", "section 5a"]
    assert one(spark, lambda t: T.found(t, T.CITATION), "in 12 Rep. 5 and Doe v. Smith") == ["12 Rep. 5", "v. Smith"]


def loop_chunks(text):
    """The section walk as a loop."""
    text = re.sub(r"\s+", " ", text)
    heads = sorted((m.start(), m[1].lower().replace("facts", "fact").replace("fact", "facts")) for m in re.finditer(r"(?i)\b(FACTS?|HOLDING|REASONING|DISSENT|CONCLUSION|BACKGROUND)\b[:\s]", text))
    out, now, held = [], "introduction", []
    for s in [x for x in re.sub(r"([.!?])\s+", "\\1\x01", text.strip()).split("\x01") if x]:
        for at, kind in heads:
            if text.find(s) >= at:
                if held and kind != now:
                    out.append((now, " ".join(held)))
                    held = []
                now = kind
        held.append(s)
        if len(held) == 5:
            out.append((now, " ".join(held)))
            held = []
    return out + ([(now, " ".join(held))] if held else [])


def test_section_chunks_like_the_loop(spark):
    rng = random.Random(4)
    parts = ["Facts: a b.", "Holding: c.", "One two.", "Three.", "Background: x y.", "Four five six.", "One two.", "Conclusion: z."]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    got = {}
    for r in chunking.section_chunks(docs(spark, texts)).where("chunk_ord > 0").orderBy("doc_id", "chunk_ord").collect():
        got.setdefault(r.doc_id, []).append((r.section, r.text))
    assert [got.get(i, []) for i in range(len(texts))] == [loop_chunks(t) for t in texts]


def pack(pieces, budget, overlap):
    out, now, n = [], [], 0
    for p in pieces:
        if n + len(p.split()) > budget and now:
            out.append(now)
            now = overlap(now)
            n = sum(len(x.split()) for x in now)
        now = [*now, p]
        n += len(p.split())
    return out + ([now] if now else [])


def test_budget_chunks_like_the_loop(spark):
    rng = random.Random(5)
    paragraphs = ["\n\n".join(" ".join(["w"] * rng.randint(1, 9)) for _ in range(rng.randint(1, 12))) for _ in range(30)]
    sections = [f"intro 1. {' '.join('a b c.' for _ in range(rng.randint(1, 9)))} 2. end." for _ in range(10)]
    texts = paragraphs + sections
    got = {}
    for r in chunking.budget_chunks(docs(spark, texts), budget=12).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.total_chunks >= r.chunk_index + 1
    for i, t in enumerate(paragraphs):
        assert got[i] == ["\n\n".join(c) for c in pack(t.split("\n\n"), 12, lambda now: now[-1:] if len(now) > 1 else [])]
    for i, t in enumerate(sections, len(paragraphs)):
        expected = []
        for s in re.findall(r"\d+\.[^0-9]*", t):
            if len(s.split()) <= 12:
                expected.append(s.rstrip() if s.endswith("end.") else s)
            else:
                sentences = [x for x in re.sub(r"([.!?])\s+", "\\1\x01", s.strip()).split("\x01") if x]
                expected += [" ".join(c) for c in pack(sentences, 12, lambda now: now[-max(1, len(now) // 4) :])]
        assert got[i] == expected


def test_slices_shift_back(spark):
    text = "abcdefghij" * 3
    for r in chunking.text_slices(docs(spark, [text, "", "x"]), 7).collect():
        assert r.text == (text if r.doc_id == 0 else "x")[r.start : r.start + 7]


def test_entities(spark):
    rows = spark.createDataFrame([(1, "A and B", "ORG"), (1, "C and D", "PERSON"), (1, "A", "ORG")], "doc_id long, text string, label string")
    split = entities.split_joint(rows)
    assert sorted((r.label, r.text) for r in split.collect()) == [("ORG", "A"), ("ORG", "A"), ("ORG", "B"), ("PERSON", "C and D")]
    assert entities.repetition(split).first().repetition_pct == 133
    spans = entities.spans(docs(spark, ["see 1 Rep. 2, 3 Rep. 4"]), {"P": T.CHUNK_CITATION}).collect()
    assert sorted((s.start, s.end, s.text) for s in spans) == [(4, 12, "1 Rep. 2"), (14, 22, "3 Rep. 4")] if hasattr(spans[0], "start") else spans


def test_importance_without_entities(spark):
    row = docs(spark, ["plain", "1 Rep. 2 held"]).select(entities.importance(F.lit("holding"), entities.extracted(F.col("text")), F.col("text"), ["held"]).alias("x")).collect()
    assert [round(r.x, 6) for r in row] == [2.0, 4.4]


def test_bm25_profiles(spark):
    texts = ["a a b", "a c", "a d", ""]
    rows = docs(spark, texts)
    index, sizes = keyword.postings(rows), keyword.lengths(rows)
    asked = spark.createDataFrame([(1, "a a"), (2, "zz"), (3, "b")], "query_id long, text string")
    for profile in (keyword.SESSION, keyword.OKAPI):
        got = {(r.query_id, r.chunk_id): r.score for r in keyword.bm25_top(asked, index, sizes, profile, 10).collect()}
        assert len(got) == 12  # every chunk, though k is larger than their number
        n, mean, df = 4, 7 / 4, {"a": 3, "b": 1, "c": 1, "d": 1}
        idf = {t: np.log((n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
        if profile["floor"]:
            floor = profile["floor"] * np.mean(list(idf.values()))
            idf = {t: v if v >= 0 else floor for t, v in idf.items()}
        for q, text in ((1, "a a"), (2, "zz"), (3, "b")):
            for i, t in enumerate(texts):
                w = t.split()
                expected = sum(idf.get(x, 0) * w.count(x) * (profile["k1"] + 1) / (w.count(x) + profile["k1"] * (0.25 + 0.75 * len(w) / mean)) for x in text.split() if x in w)
                assert got[q, i] == pytest.approx(expected)
    assert (got[1, 0] > 0) and [r.chunk_id for r in keyword.bm25_top(asked.where("query_id = 2"), index, sizes, keyword.OKAPI, 2).orderBy("rank").collect()] == [0, 1]


def test_dense_top_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "chunk_id long, vector array<double>")
    asked = rows.where("chunk_id < 20").withColumnRenamed("chunk_id", "query_id")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in dense.dense_top(asked, rows, 4).collect()}
    for q in range(20):
        assert [got[q, k] for k in (1, 2, 3, 4)] == np.lexsort((np.arange(60), -np.round(x @ x[q], 9)))[:4].tolist()


def test_last_dense_keeps_the_last_or_the_largest(spark):
    chunks = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(5, 0, [1.0, 0.0]), (5, 1, [0.2, 0.1])], "query_id long, ord int, vector array<double>")
    assert {r.chunk_id: r.score for r in retrieval.last_dense(asked, chunks, 2).collect()} == {0: 0.2, 1: 0.1}
    assert {r.chunk_id: r.score for r in retrieval.last_dense(asked, chunks, 2, "max").collect()} == {0: 1.0, 1: 0.1}


def test_passages_and_budget(spark):
    rows = [(1, 1, i, f"s{i}", x, 6) for i, x in enumerate([0.9, 0.1, 0.8, 0.7, 0.6, 0.2])] + [(1, 2, i, f"t{i}", 0.0, 2) for i in range(2)]
    got = retrieval.passages(spark.createDataFrame(rows, "query_id long, chunk_id long, idx int, sentence string, similarity double, n int")).orderBy("chunk_id", "idx").collect()
    assert [r.sentence for r in got] == ["s0", "s2", "s3", "s4", "t0", "t1"]
    long = " ".join(f"{'x' * 30}{i}." for i in range(100))
    cut = one(spark, lambda t: retrieval.cut_text(t, 100), long)
    assert cut == " ".join(f"{'x' * 30}{i}." for i in range(3))
    contexts = spark.createDataFrame([(1, r, "w " * 5) for r in (1, 2, 3, 4)], "query_id long, rank long, text string")
    assert [r["rank"] for r in retrieval.within_budget(contexts, 9).orderBy("rank").collect()] == [1, 2]


def test_position_scores(spark):
    row = spark.createDataFrame([(i, 5) for i in range(5)], "i int, n int").select(summarize.position_score(F.col("i"), F.col("n")).alias("x")).collect()
    assert [round(r.x, 6) for r in row] == [1.0, 0.9, 0.8, 0.7, 0.8]


def test_selection_and_rank_like_plain_loops():
    rng = np.random.default_rng(2)
    for n in (1, 3, 12):
        x, scores = rng.standard_normal((n, 4)), rng.random(n)
        x[0] = 0
        unit = np.array([v / np.linalg.norm(v) if np.linalg.norm(v) else v for v in x])
        chosen = [int(np.argmax(scores))]
        while n > 5 and len(chosen) < 5:
            rest = [i for i in range(n) if i not in chosen]
            chosen.append(max(rest, key=lambda i: (0.7 * scores[i] - 0.3 * max(unit[i] @ unit[j] for j in chosen), -i)))
        assert summarize.select_diverse(scores, x, 5) == (chosen if n > 5 else list(range(n)))
        s = unit @ unit.T
        out = s.sum(axis=1)
        p = np.full(n, 1 / n)
        for _ in range(50):
            p = np.array([0.85 * (sum(s[j, i] / out[j] * p[j] for j in range(n) if abs(out[j]) > 1e-12) + sum(p[j] for j in range(n) if abs(out[j]) <= 1e-12) / n) + 0.15 / n for i in range(n)])
        assert summarize.sentence_rank(x) == pytest.approx(p)


def test_cosine_of_zero(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.normalized(F.col("a")).alias("n")).first()
    assert (row.c, row.n) == (0.0, [0.0, 0.0])


def test_sessions(spark):
    none = spark.createDataFrame([], "session_id string, name string, created_at string")
    some = sessions.created(none, "s1", "first", "2024-01-01")
    assert sessions.created(some, "s1", "again", "2024-01-02").collect() == some.collect()
    assert sessions.status(docs(spark, []).withColumn("session_id", F.lit(1))).first() == (0, 0)


@pytest.mark.parametrize("few", [0, 1, 1000])
def test_filled_keyword_results(spark, monkeypatch, few):
    """Chunks without a term fill up, before those of negative score, whichever way they are found."""
    monkeypatch.setattr(keyword, "FEW", few)
    docs = spark.createDataFrame([(i, "common words" if i % 3 else f"common rare{i}") for i in range(30)] + [(i, "else") for i in range(30, 36)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "common"), (2, "rare0 rare3"), (3, "absent")], "query_id long, text string")
    got = keyword.bm25_top(asked, keyword.postings(docs), keyword.lengths(docs), keyword.SESSION, 4).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in got] == [30, 31, 32, 33, 0, 3, 1, 2, 0, 1, 2, 3] and [r.score for r in got[:4]] == [0] * 4
    none = docs.limit(0)
    assert keyword.bm25_top(asked, keyword.postings(none), keyword.lengths(none), keyword.SESSION, 4).count() == 0
