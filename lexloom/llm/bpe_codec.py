"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

Texts are cut into pieces at spaces, each encoded by itself whatever stands beside it. The distinct pieces of the corpus
are dealt into shards by their hash; in each, the words of all its pieces that are no whole token are laid end to end, and
an inverted index from a pair's rank to the places where such a pair stands replays the merges in rank order over all of
them at once; a merge updates only the pairs at the two touched neighbours. A shard is written as sorted hashes and ids to
the shared folder. Then each task looks the pieces of its texts up there, shard by shard. Very long pieces, which hardly
repeat, stay out of the shards and are replayed where they stand.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from . import arrays
from .bytepairs import pattern, pieces
from .common import gathered, numbered, sliced, without_gc

#: Characters of a piece that goes into the shards, pieces that a task holds before it emits them, text to each shard, and
#: text that a task encodes at once.
LONG, PIECES, SHARD, SLICE = 200, 400_000, 8 << 20, 8 << 20
#: Pairs whose rank a worker remembers, and places of a rank from which on its merges are made all at once.
PAIRS, MANY = 200_000, 100


def stand(places: dict[int, array], ranks: list[int], found: np.ndarray, at: np.ndarray) -> None:
    """Adds places, of pairs of the ranks found (-1: none), to those of each rank, and ranks that are new to the heap."""
    there = found >= 0
    own, at = found[there], at[there]
    order = np.argsort(own.astype(np.uint16) if own.max(initial=0) < 1 << 16 else own, kind="stable")  # small numbers are sorted by digits
    own, at = own[order], at[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
    stops = np.append(starts, len(own))[1:].tolist()
    for s, a, b in zip(own[starts].tolist(), starts.tolist(), stops, strict=True):
        if s not in places:
            heapq.heappush(ranks, s)
            places[s] = array("q")
        places[s].frombytes(at[a:b].tobytes())


class Codec:
    """A tiktoken rank file with its pattern; no special tokens."""

    def __init__(self, path: str, source: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        self.match = pattern(source)
        self.pair: dict[int, int] = {}

    def rank(self, a: int, b: int) -> int:
        """The rank of what the pair makes, -1 if that is no token."""
        pair = a << 32 | b
        if (r := self.pair.get(pair)) is None:
            if len(self.pair) > PAIRS:
                self.pair.clear()
            r = self.pair[pair] = self.ranks.get(self.token[a] + self.token[b], -1)
        return r

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As rank(), of many pairs."""
        pairs, at = np.unique(a << 32 | b, return_inverse=True)
        return np.fromiter((self.rank(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()), np.int64, len(pairs))[at]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed: every merge in rank order, and within a word from the left."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        # arrays for loops over few places, and views of them for many places at once; no place is -1, nor is a symbol that is merged away
        symbols = array("q", np.array(self.byte, np.int64)[raw].tobytes())
        after, before = array("q", np.arange(1, n + 1).tobytes()), array("q", np.arange(-1, n - 1).tobytes())
        views = tuple(np.frombuffer(x, np.int64) for x in (symbols, after, before))
        some = size > 0
        views[1][ends[some] - 1] = -1
        views[2][(ends - size)[some]] = -1
        places: dict[int, array] = {}
        inner = np.flatnonzero(views[1] >= 0)
        pairs = raw[inner].astype(np.int64) << 8 | raw[inner + 1]
        first = np.full(1 << 16, -1)
        for p in np.flatnonzero(np.bincount(pairs, minlength=1 << 16)).tolist():
            first[p] = self.rank(self.byte[p >> 8], self.byte[p & 255])
        stand(places, [], first[pairs], inner)
        ranks = list(places)
        heapq.heapify(ranks)
        rank = self.rank
        while ranks:
            r = heapq.heappop(ranks)
            own = places.pop(r, ())
            if len(own) >= MANY and self.merged(r, np.sort(np.frombuffer(own, np.int64)), *views, places, ranks):
                continue
            now = sorted(own)
            for done, i in enumerate(now, 1):
                j = after[i]
                if j < 0 or symbols[i] < 0 or rank(symbols[i], symbols[j]) != r:
                    continue
                symbols[i], symbols[j] = r, -1
                after[i] = k = after[j]
                again = False
                if k >= 0:
                    before[k] = i
                    if (s := rank(r, symbols[k])) >= 0:
                        if s not in places:
                            heapq.heappush(ranks, s)
                            places[s] = array("q")
                        places[s].append(i)
                        again = s <= r
                if (h := before[i]) >= 0 and (s := rank(symbols[h], r)) >= 0:
                    if s not in places:
                        heapq.heappush(ranks, s)
                        places[s] = array("q")
                    places[s].append(h)
                    again |= s <= r
                if again:  # a pair that comes before the rest of this rank: the rest waits for its turn
                    if r not in places:
                        heapq.heappush(ranks, r)
                        places[r] = array("q")
                    places[r].extend(now[done:])
                    break
        left = views[0] >= 0
        stops = (4 * np.concatenate([[0], np.cumsum(left)])[ends]).tolist()
        ids = packed(views[0][left])
        return [ids[a:b] for a, b in zip([0, *stops][:-1], stops, strict=True)]

    def merged(self, r: int, i: np.ndarray, symbols: np.ndarray, after: np.ndarray, before: np.ndarray, places: dict[int, array], ranks: list[int]) -> bool:
        """The merges of a rank at its places i, in order, all at once; False, and nothing is done, if a new pair would come before the rest of them."""
        i = i[(symbols[i] >= 0) & (after[i] >= 0) & np.concatenate([[True], i[1:] != i[:-1]])]
        if not len(i):
            return True
        i = i[self.ranks_of(symbols[i], symbols[after[i]]) == r]
        if not len(i):
            return True
        # of a row of pairs that each overlap the next, the first, the third and so on
        alone = np.ones(len(i), bool)
        alone[1:] = after[i[:-1]] != i[1:]
        number = np.arange(len(i))
        i = i[(number - np.maximum.accumulate(np.where(alone, number, 0))) % 2 == 0]
        j = after[i]
        k, h = after[j], before[i]
        # the right neighbour is as it was; the left one may be the merge just before
        beside = np.zeros(len(i), bool)
        beside[1:] = j[:-1] == h[1:]
        h = np.where(beside, np.concatenate([h[:1], i[:-1]]), h)
        has_k, has_h = k >= 0, h >= 0
        right = self.ranks_of(np.full(int(has_k.sum()), r), symbols[k[has_k]])
        left = self.ranks_of(np.where(beside, r, symbols[h])[has_h], np.full(int(has_h.sum()), r))
        if ((right >= 0) & (right <= r)).any() or ((left >= 0) & (left <= r)).any():
            return False
        symbols[i], symbols[j], after[i], before[k[has_k]] = r, -1, k, i[has_k]
        stand(places, ranks, np.concatenate([right, left]), np.concatenate([i[has_k], h[has_h]]))
        return True

    def replayed(self, found: list[list[str]]) -> list[bytes]:
        """The encoded form of each list of matches; of all distinct ones, those that are no token are replayed together."""
        words: dict[str, bytes] = dict.fromkeys(m for matches in found for m in matches)
        hard = []
        for match in words:
            raw = match.encode()
            if (whole := self.ranks.get(raw)) is not None:
                words[match] = packed([whole])
            else:
                hard.append((match, raw))
        for (match, _), ids in zip(hard, self.replay([raw for _, raw in hard]), strict=True):
            words[match] = ids
        return [b"".join(map(words.__getitem__, matches)) for matches in found]

    @without_gc
    def encode(self, texts: list[str], shards: Shards | None = None) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; pieces that the shards don't have are replayed here."""
        distinct, place, ends = numbered(split(t) for t in texts)
        found = [unit(p) for p in distinct]
        known: list[bytes | None] = [None] * len(found)
        if shards:
            short = [i for i, u in enumerate(found) if len(u) <= LONG]
            for i, ids in zip(short, shards.find([found[i] for i in short]), strict=True):
                known[i] = ids
        todo = [i for i, ids in enumerate(known) if ids is None]
        for i, ids in zip(todo, self.replayed([self.match.findall(found[i]) for i in todo]), strict=True):
            known[i] = ids
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        each = size[place]
        until = np.cumsum(each)
        stops = (4 * np.concatenate([[0], until])[ends]).tolist()
        ids = np.frombuffer(b"".join(known), "<u4")[np.arange(until[-1] if len(until) else 0) - np.repeat(until - np.cumsum(size)[place], each)].tobytes()
        return [ids[a:b] for a, b in zip([0, *stops][:-1], stops, strict=True)]

    @without_gc
    def shard(self, own: list[str]) -> list[bytes]:
        """The ids of all pieces of a shard."""
        return self.replayed([self.match.findall(u) for u in own])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def split(text: str) -> list[str | tuple[str]]:
    """The text in pieces: the first, in a tuple, and the others without the space that each begins with."""
    found: list = pieces(text)
    found[0] = (found[0],)
    return found


def unit(piece: str | tuple[str]) -> str:
    return piece[0] if type(piece) is tuple else " " + piece


@functools.lru_cache(maxsize=4)
def codec(ranks: str, source: str) -> Codec:
    """One for each worker process."""
    return Codec(ranks, source)


def hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Shards(arrays.Shelf):
    """The corpus's encoded pieces: sorted hashes, where the ids of each end, and the ids."""

    def __init__(self, folder: str, shards: int):
        super().__init__(folder)
        self.shards = shards

    def find(self, wanted: list[str]) -> list[bytes | None]:
        """The ids of each piece, None for pieces that aren't there."""
        h = hashes(wanted)
        order = np.argsort(h)
        ends = np.searchsorted(shard_of(h[order], self.shards), np.arange(self.shards + 1))
        out: list[bytes | None] = [None] * len(wanted)
        for s in np.flatnonzero(np.diff(ends)).tolist():
            own = order[ends[s] : ends[s + 1]]
            known, stops, ids = (self.load(f"{name}-{s}") for name in ("pieces", "ends", "ids"))
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, h[own]), len(known) - 1)
            there = known[at] == h[own]
            at, own = at[there], own[there]
            stop = stops[at].astype(np.int64)
            size = stop - np.where(at > 0, stops[at - 1], 0).astype(np.int64)
            until = np.cumsum(size)
            blob = ids[np.arange(until[-1] if len(until) else 0) - np.repeat(until - stop, size)].astype("<u4").tobytes()
            for i, a, b in zip(own.tolist(), (4 * (until - size)).tolist(), (4 * until).tolist(), strict=True):
                out[i] = blob[a:b]
        return out


@functools.lru_cache(maxsize=2)
def shelf(folder: str, shards: int) -> Shards:
    """One for each worker process and corpus; two are kept."""
    return Shards(folder, shards)


def learned(docs: DataFrame, ranks: str, source: str, text_col: str) -> tuple[str, int]:
    """Encodes the distinct pieces of all texts into the shared folder; the folder and its number of shards.

    Two pieces of one hash, should there be such, both stay out, and are replayed where they stand.
    """
    folder = shared_folder(docs.sparkSession, "pieces")
    rows = docs.select(docs[text_col].alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str | tuple[str]] = set()
        for batch in sliced(batches, "text"):
            for text in batch.column("text").to_pylist():
                held.update(split(text))
            if len(held) >= PIECES:
                yield blocks(held)
                held = set()
        if held:
            yield blocks(held)

    def blocks(held: set[str | tuple[str]]) -> pa.RecordBatch:
        own = sorted({u for u in map(unit, held) if len(u) <= LONG})
        shard = shard_of(hashes(own), shards)
        order = np.argsort(shard, kind="stable")
        names, starts = np.unique(shard[order], return_index=True)
        out = []
        for part in np.split(order, starts[1:]) if len(order) else []:
            raw = [own[i].encode() for i in part.tolist()]
            sizes = np.fromiter(map(len, raw), "<u2", len(raw))
            out.append(len(raw).to_bytes(4, "little") + zstandard.ZstdCompressor(level=3).compress(sizes.tobytes() + b"".join(raw)))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(out, pa.binary())], names=["shard", "block"])

    def merge(key, table):
        found: set[str] = set()
        for block in table["block"].to_pylist():
            raw, n = zstandard.ZstdDecompressor().decompress(block[4:]), int.from_bytes(block[:4], "little")
            stops = np.cumsum(np.frombuffer(raw[: 2 * n], "<u2").astype(np.int64)) + 2 * n
            found.update(raw[a:b].decode() for a, b in zip([2 * n, *stops[:-1].tolist()], stops.tolist(), strict=True))
        own = sorted(found)
        h = hashes(own)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        alone = np.ones(len(h), bool)
        alone[1:][same] = alone[:-1][same] = False
        order = order[alone]
        put(key[0].as_py(), h[order], codec(ranks, source).shard([own[i] for i in order.tolist()]))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32())})

    def put(s: int, h: np.ndarray, ids: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(ids), "<u4")
        arrays.save(folder, f"ends-{s}", np.cumsum([len(x) // 4 for x in ids], dtype=np.uint32) if ids else np.zeros(0, np.uint32))
        arrays.save(folder, f"ids-{s}", flat.astype(np.min_scalar_type(int(flat.max())) if len(flat) else np.uint8))
        arrays.save(folder, f"pieces-{s}", h)

    done = rows.mapInArrow(collect, "shard int, block binary").repartition(shards, "shard").groupBy("shard").applyInArrow(merge, "shard int")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards without a piece are empty."""
        for batch in batches:
            for s in batch.column("id").to_pylist():
                if not arrays.exists(folder, f"pieces-{s}"):
                    put(s, np.zeros(0, np.uint64), [])
            yield batch

    done.agg(F.count("*")).first()
    docs.sparkSession.range(shards).mapInArrow(rest, "id long").agg(F.count("*")).first()
    return folder, shards


def encode(docs: DataFrame, ranks: str, source: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each row and `ids`, its whole text's token ids as little-endian unsigned 32-bit integers.

    ranks: path of a tiktoken rank file, at the same place on every worker; source: the pattern that splits texts. A
    null or empty text has no ids. Every row gives one row; ids may be null or repeat, other columns are no matter.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    folder, shards = learned(rows, ranks, source, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, source)
        for batch in gathered(batches, "text", SLICE):
            ids = own.encode([t or "" for t in batch.column("text").to_pylist()], shelf(folder, shards))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` long, ids binary")


def decode(encoded: DataFrame, ranks: str, source: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The inverse of encode(): id and text, null where the ids are null. Bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, source)
        for batch in sliced(batches, "ids"):
            texts = [None if ids is None else own.decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=[id_col, "text"])

    rows = encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(run, f"`{id_col}` long, text string")


def round_trip(docs: DataFrame, ranks: str, source: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, then decodes the ids: id, n_tokens, ids_sha256 and decoded_sha256 (of the decoded bytes), without ever writing the ids.

    Rows as in encode().
    """

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    folder, shards = learned(rows, ranks, source, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, source)
        for batch in gathered(batches, "text", SLICE):
            ids = own.encode([t or "" for t in batch.column("text").to_pylist()], shelf(folder, shards))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
