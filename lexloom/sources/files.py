"""Uploaded files to documents: type detection, validation, text extraction through pluggable extractors."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions by type, the extensions an upload may have, and first bytes by type.
EXTENSIONS = {"text": ["txt", "md"], "pdf": ["pdf"], "docx": ["docx", "doc"], "image": ["png", "jpg", "jpeg", "tiff", "bmp", "gif"]}
ACCEPTED = ["txt", "md", "pdf", "docx", "doc", "png", "jpg", "jpeg", "tiff", "bmp", "gif"]
MAGIC = {"pdf": [b"%PDF"], "docx": [b"PK"], "image": [b"\xff\xd8\xff", b"\x89PNG", b"GIF8"]}
MOST_BYTES = 50 * 1024 * 1024


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def file_type(name: Column, content: Column) -> Column:
    """By extension, else by first bytes, else text."""
    out = F.lit("text")
    for kind, heads in reversed(MAGIC.items()):
        for head in heads:
            out = F.when(F.coalesce(F.substring(content, 1, len(head)) == F.lit(bytearray(head)), F.lit(False)), kind).otherwise(out)
    for kind, names in EXTENSIONS.items():
        out = F.when(extension(name).isin(*names), kind).otherwise(out)
    return out


def accepted(name: Column, size: Column, most: int = MOST_BYTES) -> Column:
    """Whether an upload is taken: a known extension, and not over the size where the size is known."""
    return F.coalesce(extension(name).isin(*ACCEPTED), F.lit(False)) & F.coalesce(size <= most, F.lit(True))


def decoded(content: bytes) -> tuple[str, str]:
    """Text and the encoding that fits: UTF-8, else Latin-1, which fits anything."""
    try:
        return content.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return content.decode("latin-1"), "latin-1"


def extracted_text(content: bytes) -> dict:
    text, encoding = decoded(content)
    return {"text": text, "extraction_method": f"text-{encoding}", "confidence": 1.0}


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extracted_docx(content: bytes) -> dict:
    """Paragraphs that aren't blank, then tables with cells joined by bars, all parted by blank lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    parts = [text(p) for p in body.findall(f"{_W}p")]
    for grid in body.findall(f"{_W}tbl"):
        parts += [" | ".join(text(c).strip() for c in row.findall(f"{_W}tc")) for row in grid.findall(f"{_W}tr")]
    return {"text": "\n\n".join(p for p in parts if p.strip()), "extraction_method": "docx-xml", "confidence": 1.0}


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_TOKEN = re.compile(rb"(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\))|<([0-9A-Fa-f\s]*)>|([\[\]])|([-+]?(?:\d+\.?\d*|\.\d+))|/[^\s()<>\[\]/%]*|([A-Za-z]+\*?|['\"])", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|\r?\n|(.))", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A shift to the right between two shown strings by so many thousandths of the font's size is a space.
SPACE = 200


def shown_text(content: bytes) -> str:
    """What a content stream's text operators show, a line for each move to another line."""
    out: list[str] = []
    held: list[str] = []
    listed = False
    for literal, digits, bracket, number, operator in _TOKEN.findall(content):
        if literal:
            raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else _ESCAPED.get(m[2], m[2] or b""), literal[1:-1])
            held.append(shown_string(raw))
        elif bracket:
            listed = bracket == b"["
        elif number:
            if listed and float(number) < -SPACE:
                held.append(" ")
        elif operator:
            if operator in (b"Tj", b"TJ", b"'", b'"'):
                out += ["\n"] * (operator in (b"'", b'"')) + held
            elif operator in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                out.append("\n")
            held, listed = [], False
        elif digits:
            held.append(shown_string(bytes.fromhex((d := b"".join(digits.split()).decode()) + "0" * (len(d) % 2))))
    return "\n".join(line for line in "".join(out).splitlines() if line.strip())


def shown_string(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def extracted_pdf(content: bytes) -> dict:
    """The text layer of simple files: literal and hexadecimal strings shown by content streams, plain or deflated; a blank line per stream.

    Strings are bytes of Latin-1, or UTF-16 with its mark. Files with fonts of their own encoding, and pages without a text
    layer, need an extractor of their own in EXTRACTORS.
    """
    pages = []
    for raw in _STREAM.findall(content):
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        if b"BT" in raw and (text := shown_text(raw)):
            pages.append(text)
    if not pages:
        raise ValueError("no text layer")
    return {"text": "\n\n".join(pages), "extraction_method": "pdf-text", "confidence": 1.0, "pages_processed": len(pages)}


def no_recognizer(content: bytes) -> dict:
    raise ValueError("no recognizer of text in images is installed")


Extractor = Callable[[bytes], dict]
EXTRACTORS: dict[str, Extractor] = {"text": extracted_text, "docx": extracted_docx, "pdf": extracted_pdf, "image": no_recognizer}
RECORD = "filename string, file_type string, file_size long, text string, extraction_method string, confidence double, pages_processed long, ocr_pages long, success boolean, error string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """filename, content, file_size of the files below a path."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.col("length").alias("file_size"))


def extract(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """files: filename, content, file_size. One record per file; a failure is stated in error and never taken for text.

    A file is a success if its text isn't blank. Null content is a failure.
    """
    known = EXTRACTORS | (extractors or {})
    rows = files.select("filename", F.coalesce("file_size", F.octet_length("content")).cast("long").alias("file_size"), "content", file_type(F.col("filename"), F.col("content")).alias("file_type"))

    def one(name, size, content, kind) -> dict:
        out = {"filename": name, "file_type": kind, "file_size": size, "text": "", "extraction_method": None, "confidence": 0.0, "pages_processed": 0, "ocr_pages": 0, "success": False, "error": None}
        try:
            if content is None:
                raise ValueError("no content")
            out |= known[kind](content)
        except Exception as e:  # whatever an extractor raises is the record's error
            return out | {"text": "", "error": f"{type(e).__name__}: {e}"}
        blank = not out["text"].strip()
        return out | {"success": not blank, "error": "no text" if blank else None}

    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = one(*(batch.column(c)[row].as_py() for c in ("filename", "file_size", "content", "file_type")))
                yield pa.RecordBatch.from_pylist([{n: found[n] for n in names}], schema)

    return rows.mapInArrow(run, RECORD)


def word_confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """Text and confidence of recognized words per page: words with conf > 0 in order, and their mean conf / 100.

    words: keys, ord, word, conf (0 to 100). A page without such a word has an empty text and confidence 0.
    """
    good = F.when(F.col("conf") > 0, F.struct("ord", "word"))
    kept = F.transform(F.array_sort(F.collect_list(good)), lambda w: w["word"])
    return words.groupBy(*keys).agg(F.array_join(kept, " ").alias("text"), F.coalesce(F.avg(F.when(F.col("conf") > 0, F.col("conf"))) / 100, F.lit(0.0)).alias("confidence"))
