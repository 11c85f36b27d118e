"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces. Text within k edits of the item holds at least
one piece unchanged. One automaton finds all pieces of all items in a text; around each hit, Myers' bit-parallel distance
says whether the whole item is there within its budget. Both sides are compared lower-cased with white space collapsed.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved, shared_folder
from . import arrays
from .common import sliced

#: Edits allowed for each character of an item, rounded down.
BUDGET = 0.05
#: An item's budget is cut until its pieces have so many characters, where its length allows, so that hits are rare.
LEAST_PIECE = 12
#: Items that a task searches for at once; more are searched for in several passes over its text.
ITEMS = 20_000
#: Automata that a worker keeps; where there are more passes, each goes over so much text at once.
KEPT, TEXT_BYTES = 4, 32 << 20
#: Hits whose ends lie in the same stretch of so many characters are verified together.
STRETCH = 64

_WHITE = re.compile(r"[ \t-\r]+")


def normal(text: str | None) -> str:
    """Lower case, runs of ASCII white space as one space, trimmed. Characters whose lower case is longer stay."""
    text = _WHITE.sub(" ", text or "").strip(" ")
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def budget(length: int, rate: float) -> int:
    return max(0, min(int(length * rate), length // LEAST_PIECE - 1))


class Items:
    """Some test items: the automaton of their pieces, and each character's bits in each item."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.budgets = [budget(len(t), rate) for t in self.texts]
        self.bits: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (text, k) in enumerate(zip(self.texts, self.budgets, strict=True)):
            cuts = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                found.setdefault(text[start:stop], []).append((number, start))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """Item number, start, end and edits of the best place of each item that the text holds."""
        if not self.texts:
            return []
        wanted: dict[tuple[int, int], list[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for number, offset in places:
                start = end + 1 - size - offset  # where the item would start without edits
                wanted.setdefault((number, start // STRETCH), []).append(start)
        best: dict[int, tuple[int, int, int]] = {}
        for (number, _), starts in wanted.items():
            k, m = self.budgets[number], len(self.texts[number])
            if number in best and best[number][0] == 0:
                continue
            low, high = max(0, min(starts) - k), min(len(text), max(starts) + m + k)
            if (got := self.verify(number, text[low:high])) and (number not in best or got[0] < best[number][0]):
                best[number] = (got[0], low + got[1], low + got[2])
        return [(number, start, end, edits) for number, (edits, start, end) in sorted(best.items())]

    def verify(self, number: int, window: str) -> tuple[int, int, int] | None:
        """Edits, start and end of the item's best place in the window, if within its budget."""
        item, k = self.texts[number], self.budgets[number]
        if (at := window.find(item)) >= 0:
            return 0, at, at + len(item)
        if number not in self.bits:
            self.bits[number] = masks(item)
        edits, end = myers(self.bits[number], len(item), window)
        if edits > k:
            return None
        _, back = myers(masks(item[::-1]), len(item), window[:end][::-1], anchored=True)
        return edits, end - back, end


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(bits: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of the item to a substring of text (to a prefix if anchored), and where the first such ends.

    One bit per character of the item, in integers of any length: the vertical differences of a column of the matrix.
    """
    full = (1 << m) - 1
    plus, minus, score = full, 0, m
    best, at, last = m, 0, 1 << m - 1
    for j, c in enumerate(text, 1):
        match = bits.get(c, 0)
        diagonal = ((match & plus) + plus ^ plus) | match | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up = up << 1 & full | anchored
        down = down << 1 & full
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        if score < best:
            best, at = score, j
    return best, at


@functools.lru_cache(maxsize=KEPT)
def pass_items(folder: str, number: int, rate: float) -> Items:
    """One for each worker process and pass; a few are kept."""
    ids, ends, text = (arrays.load(folder, f"{name}-{number}") for name in ("ids", "ends", "text"))
    return Items([(i, text[a:b].tobytes().decode()) for i, a, b in zip(ids.tolist(), [0, *ends.tolist()], ends.tolist(), strict=False)], rate)


def prepared(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[str, int]:
    """Writes the distinct items to the shared folder in passes of bounded size; their folder and number."""
    folder = shared_folder(benchmark.sparkSession, "items")
    clean = F.trim(F.regexp_replace(F.coalesce(benchmark[text_col], F.lit("")), "[ \\t-\\r]+", " "))
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), clean.alias("text")).where("item is not null and text <> ''").distinct()
    items = saved(items, "benchmark")
    passes = -(-items.count() // ITEMS)
    if passes == 0:
        return folder, 0

    def write(key, table):
        put(key[0].as_py(), sorted(zip(table["item"].to_pylist(), map(normal, table["text"].to_pylist()), strict=True)))
        return pa.table({"pass": pa.array([key[0].as_py()], pa.int32())})

    def put(number: int, rows: list[tuple[int, str]]) -> None:
        """Ids, and texts as bytes end to end with where each ends."""
        texts = [t.encode() for _, t in rows]
        for name, array in (("ids", [i for i, _ in rows]), ("ends", np.cumsum([len(t) for t in texts]))):
            arrays.save(folder, f"{name}-{number}", np.array(array, np.int64))
        arrays.save(folder, f"text-{number}", np.frombuffer(b"".join(texts), np.uint8))

    numbered = items.withColumn("pass", F.pmod(F.xxhash64("item", "text"), F.lit(passes)).cast("int"))
    done = {r[0] for r in numbered.groupBy("pass").applyInArrow(write, "pass int").collect()}
    for number in set(range(passes)) - done:
        put(number, [])
    return folder, passes


HITS = "array<struct<item_id: bigint, start: bigint, end: bigint, edits: bigint>>"


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str, out_col: str, item_col: str, item_text: str, rate: float) -> DataFrame:
    """All columns of docs and out_col, a list of the items that the text holds."""
    folder, passes = prepared(benchmark, item_col, item_text)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "end", "edits")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in sliced(batches, text_col):
            held.append(batch)
            size += batch.column(text_col).nbytes
            if passes <= KEPT or size >= TEXT_BYTES:
                yield from searched(held)
                held, size = [], 0
        yield from searched(held)

    def searched(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [[normal(t) for t in batch.column(text_col).to_pylist()] for batch in held]
        found: list[list[list[dict]]] = [[[] for _ in own] for own in texts]
        for number in range(passes):
            items = pass_items(folder, number, rate)
            for own, rows in zip(found, texts, strict=True):
                for into, text in zip(own, rows, strict=True):
                    into += [{"item_id": items.ids[i], "start": start, "end": end, "edits": edits} for i, start, end, edits in items.search(text)]
        for batch, own in zip(held, found, strict=True):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, kind)], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, f"{columns}, `{out_col}` {HITS}")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = BUDGET
) -> DataFrame:
    """A row for each document and test item that it holds: id, item_id, edits, start, end (of the item's best place).

    start and end count characters of the normalized text (see normal()). An item is held if a stretch of the document
    differs from it in at most rate * its length edits. Null or blank items and items without an id are held by nothing;
    a null or empty text holds nothing. Repeated items with one id and text count once; repeated documents each give
    their rows; a null document id is kept; other columns are no matter.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    found = hits(rows, benchmark, "text", "found", item_col, item_text, rate).select("id", F.explode("found").alias("hit"))
    return found.select(F.col("id").alias(id_col), "hit.item_id", "hit.edits", "hit.start", "hit.end")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = BUDGET) -> DataFrame:
    """The rows of docs, with their own columns, whose text holds no test item; see contaminated()."""
    own = docs.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)))
    name = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    clean = hits(own, benchmark, name[text_col], "found", item_col, item_text, rate).where(F.size("found") == 0)
    return clean.select(*(F.col(name[c]).alias(c) for c in docs.columns))
