"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted."""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bytepairs import pattern, pieces
from .common import Recent, byte_lengths, sliced, without_gc

#: Entries of a worker's cache of piece counts, in each of its two parts, and characters of a piece or word that is kept.
CACHE, KEPT = 400_000, 64


class Counter:
    """Counts a byte-level BPE tokenizer's tokens, from its tokenizer.json.

    The file's added special tokens, where a text contains their strings, count as one token each, as the library has
    it by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or spec["normalizer"] or split["add_prefix_space"]:
            raise ValueError(f"{path}: only byte-level BPE without a normalizer or a prefix space is counted")
        vocabulary = model["vocab"]
        self.byte = [vocabulary[c] for c in byte_characters()]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank.setdefault(vocabulary[a] << 32 | vocabulary[b], len(self.made))
            self.made.append(vocabulary[a + b])
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.match = pattern(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
        self.known, self.words = Recent(CACHE), Recent(CACHE)

    def of_match(self, match: str) -> int:
        """Initial symbols minus merges: the pair of lowest rank, leftmost first, is merged again and again."""
        symbols = [self.byte[b] for b in match.encode()]
        n = len(symbols)
        rank, made = self.rank, self.made
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbols[i] < 0 or rank.get(symbols[i] << 32 | symbols[j]) != r:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = made[r], -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank.get(symbols[i] << 32 | symbols[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank.get(symbols[h] << 32 | symbols[i])) is not None:
                heapq.heappush(heap, r << 32 | h)
        return left

    def of_pieces(self, found: list[str]) -> list[int]:
        matches = list(map(self.match.findall, found))
        for match in self.words.missing(m for own in matches for m in own if len(m) <= KEPT):
            self.words.new[match] = self.of_match(match)
        get = self.words.new.__getitem__
        return [sum(get(m) if len(m) <= KEPT else self.of_match(m) for m in own) for own in matches]

    @without_gc
    def of_texts(self, texts: list[str]) -> list[int]:
        plain, marks = [], []  # parts between special tokens, and how many parts each text has
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            plain += [pieces(p) for p in parts]
            marks.append(len(parts))
        todo = self.known.missing(p for part in plain for p in part[1:] if len(p) <= KEPT)
        long = [p for part in plain for p in part[1:] if len(p) > KEPT]
        done = self.of_pieces([" " + p for p in todo] + [" " + p for p in long] + [part[0] for part in plain])
        self.known.new.update(zip(todo, done, strict=False))
        known, heads, counts, at = self.known.new, done[len(todo) + len(long) :], [], 0
        if long:
            known = {**dict(zip(long, done[len(todo) : len(todo) + len(long)], strict=True)), **{p: known[p] for part in plain for p in part[1:] if len(p) <= KEPT}}
        get = known.__getitem__
        for n in marks:
            counts.append(n - 1 + sum(heads[i] + sum(map(get, plain[i][1:])) for i in range(at, at + n)))
            at += n
        return counts


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


@functools.cache
def counter(path: str) -> Counter:
    """One for each worker process."""
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of each whole text: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer: path of a tokenizer.json, at the same place on every worker. A null text counts as an empty one, which
    has no tokens; null ids, repeated rows and other columns are no matter: every row gives one row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in sliced(batches, "text"):
            n = own.of_texts([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(byte_lengths(batch.column("text"))), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(count, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
