"""Files, the index store, streams and the engine's surface."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.engine import Engine
from lexloom.sources import files, images, store
from lexloom.streaming import ingest


def docx(paragraphs, rows):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_extraction(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    (tmp_path / "c.docx").write_bytes(docx(["One", " ", "Two"], [["x", "y"]]))
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4\nstream\nBT (Hello \\(you\\)) Tj T* (there) Tj ET\nendstream\n")
    (tmp_path / "e.png").write_bytes(b"\x89PNG")
    (tmp_path / "f.txt").write_bytes(b" \n")
    got = {r.filename: r for r in files.extract(files.read_files(spark, str(tmp_path))).collect()}
    assert {n: r.text for n, r in got.items()} == {"a.txt": "héllo", "b.txt": "café", "c.docx": "One\n\nTwo\n\nx | y", "d.pdf": "Hello (you)\nthere", "e.png": "", "f.txt": " \n"}
    assert {n for n, r in got.items() if r.success} == {"a.txt", "b.txt", "c.docx", "d.pdf"}
    assert "recognizer" in got["e.png"].error and got["f.txt"].error == "no text"


def test_own_extractor_and_null_content(spark):
    rows = spark.createDataFrame([("x.png", b"12", 2), ("y.txt", None, None)], "filename string, content binary, file_size long")
    got = {r.filename: r for r in files.extract(rows, {"image": lambda b: {"text": f"{len(b)} bytes", "confidence": 0.5}}).collect()}
    assert got["x.png"].text == "2 bytes" and got["x.png"].confidence == 0.5
    assert not got["y.txt"].success


def test_images():
    page = np.full((20, 30), 200, np.uint8)
    page[5:15, 10:14] = 20  # a stroke
    page[2, 25] = 0  # a speck
    content = b"P5\n# made here\n30 20\n255\n" + page.tobytes()
    ready = images.prepared(images.decoded_pnm(content))
    assert ready[10, 11] == 0 and ready[2, 25] == 255 and set(np.unique(ready)) == {0, 255}
    colour = images.decoded_pnm(b"P6 1 1 255\n\xff\x00\x00")
    assert colour.shape == (1, 1, 3)
    extract = images.image_extractor(lambda image: [("one", 80), ("bad", -1), ("two", 40)])
    assert extract(content)["text"] == "one two" and extract(content)["confidence"] == pytest.approx(0.6)
    paged = images.paged_extractor(lambda b: [("page one", b""), (" ", content)], extract)
    got = paged(b"")
    assert (got["text"], got["ocr_pages"], got["pages_processed"]) == ("page one\n\none two", 1, 2) and got["confidence"] == pytest.approx(0.6)


def test_store_prunes_by_session(spark, tmp_path):
    rows = spark.range(10).withColumn("session_id", (F.col("id") % 2).cast("string"))
    store.save_index({"t": rows}, str(tmp_path))
    own = store.load_index(spark, str(tmp_path), ["t"], "1")["t"]
    assert sorted(r.id for r in own.collect()) == [1, 3, 5, 7, 9]
    assert "PartitionFilters: [isnotnull(session_id" in own._jdf.queryExecution().toString()


def test_streamed_postings(spark, tmp_path):
    for part in range(3):
        spark.createDataFrame([(part, f"word{part} common")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = ingest.document_stream(spark, f"{tmp_path}/in/*", "doc_id long, text string", 1)
    ingest.index_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/postings")
    assert got.count() == 6 and got.where("term = 'common'").count() == 3


def test_streamed_counts(spark, tmp_path):
    events = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet*")
    counts = ingest.event_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_engine(spark):
    rows = spark.createDataFrame([(1, "Facts: the court in 12 Rep. 5 found a breach of contract here today. Holding: damages are due for the breach."), (2, "Nothing of note is said in this rather short text at all."), (3, "")], "doc_id long, text string")
    engine = Engine(spark)
    assert {r.doc_id: r.total_entities for r in engine.analyze(rows).collect()} == {1: 1, 2: None, 3: None}
    index = engine.index(rows)
    asked = spark.createDataFrame([(1, "which case held a breach under 12 Rep. 5")], "query_id long, text string")
    best = engine.search(asked, index, 3).orderBy("rank").collect()
    chunk = {r.chunk_id: r.doc_id for r in index["chunks"].collect()}
    assert chunk[best[0].chunk_id] == 1 and len(best) == 3
    assert engine.summarize(rows, 1, mmr=False).where("doc_id = 2").first().summary.startswith("Nothing")


def test_engine_sessions_and_answers(spark):
    docs = spark.createDataFrame([(1, "FACTS: Apples are red. HOLDING: 12 Rep. 5 applies to apples.", "a", "One"), (2, "Pears are green, as 12 Rep. 5 says.", "b", "Two"), (3, "", "b", None)], "doc_id long, text string, session_id string, title string")
    asked = spark.createDataFrame([(1, "what are apples"), (2, "pears under 12 Rep. 5")], "query_id long, text string")
    engine = Engine(spark, answerer=lambda q, context: F.concat(q, F.lit("? "), F.substring(context, 1, 3)), hypothesis=lambda q: F.concat(F.lit("pears "), q))
    index = engine.index(docs)
    titles = {r.chunk_id: (r.session_id, r.title) for r in index["chunks"].collect()}
    assert set(titles.values()) == {("a", "One"), ("b", "Two"), ("b", "Untitled")}
    for profile in ("advanced", "session"):
        for rerank in (False, True):
            hits = engine.search(asked, index, 3, session="b", profile=profile, rerank=rerank).collect()
            assert hits and all(titles[r.chunk_id][0] == "b" and 1 <= r.rank <= 3 for r in hits)
            assert {titles[r.chunk_id][0] for r in engine.search(asked, index, 9, profile=profile, rerank=rerank).collect()} == {"a", "b"}
    got = {r.query_id: r for r in engine.answer(asked, index, 2, session="b").collect()}
    assert got[2].answer == "pears under 12 Rep. 5? [1]" and got[2].error is None and 0 < got[2].confidence <= 100 and [s.rank for s in got[2].sources] == [1, 2]
    nothing = engine.answer(asked, index, 2, session="none").collect()
    assert all(r.answer == r.error == "No relevant documents found for your query." and r.sources is None for r in nothing) and len(nothing) == 2
    alone = Engine(spark).answer(asked, index, 2).collect()
    assert all(r.answer is None and r.error and r.context for r in alone)
    assert engine.graph(index).count() == 3  # three chunks hold the citation whole


def test_text_that_pages_show():
    show = files.shown_text
    assert show(rb"BT /F1 12 Tf 72 700 Td [(Hel) -20 (lo) -300 (wor\154d)] TJ 0 -14 Td <48692 > Tj (a \(b\) (c)) ' ET") == "Hello world\nHi \na (b) (c)"
    assert show(b"BT <FEFF00E900E8> Tj T* (x\\\ny\\)) Tj 1 2 (q) \" ET (not shown) q") == "éè\nxy)\nq"
    assert show(b"BT ET") == "" and show(b"") == "" and show(b"BT (never closed Tj ET") == ""
