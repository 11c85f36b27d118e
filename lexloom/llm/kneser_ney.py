"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, read by memory mapping.

Counting. Words are counted first, by shards that are ranges of their 64-bit hash; a word's id is its place among all. Then
each task sums the n-grams of what it reads and emits one compact block of ids per shard. A shard is merged by one task and
written as sorted hashes of n-grams, of which five bytes are kept beside an index of their first two, and counts of a byte
(larger ones apart) to the shared folder. N-grams are
dealt by the hash of their context, so that a context's totals are known where its n-grams are; pairs of words are dealt by
both, so a frequent word's pairs lie in all shards, and its totals are summed per shard of words. Each level hands the
next lower one its distinct n-grams without their first word: there they are counted by how many words stand before them.
The number of shards follows from the text, so that a shard has the same size whatever the corpus.

Scoring. A task looks up the n-grams of a slice of text, sorted, shard by shard, in the mapped arrays. Nothing of the model
is collected or broadcast but its shards' sizes and its totals. Of stores that aren't mounted a worker reads one shard
after another and keeps a few.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from . import arrays
from .common import byte_lengths, gathered, numbered, sliced, trim

#: Words of an n-gram.
ORDER = 3
#: The token that ends each text; no word is a space.
END = b" "
#: Text that a task counts or scores at once, words that it holds before it emits them, and text to each shard.
SLICE, WORDS, SHARD = 6 << 20, 600_000, 12 << 20
#: Tokens of a stretch that is scored by itself.
STRETCH = 32
#: The id of what stands before a text's first word.
START = 1 << 62


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


@dataclass(frozen=True)
class Model:
    """Where the arrays are, how many words each shard has, and totals."""

    folder: str
    order: int
    sizes: tuple[int, ...]  # words of each shard
    tokens: int
    types: int  # different pairs
    discounts: tuple[tuple[float, float, float], ...]  # of each level, from single words on
    lower_mass: float  # of the lowest level, for words not seen
    start: tuple[int, int, int, int]  # START as a context of pairs: how often, and words after it once, twice, more often

    @property
    def vocabulary(self) -> int:
        return sum(self.sizes)

    @property
    def shards(self) -> int:
        return len(self.sizes)


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(32)


def gram(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of each n-gram; columns: the ids of its words."""
    h = np.full(len(columns[0]) if columns else 0, len(columns), np.uint64)
    for c in columns:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + c + np.uint64(1))
    return h


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """By ranges, so that shards in order are hashes in order."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def cut(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that has rows, and its rows in order."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")  # small numbers are sorted by digits
    ends = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])
    for s in np.flatnonzero(np.diff(ends)).tolist():
        yield s, order[ends[s] : ends[s + 1]]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each hash stands, in the hashes' order, and how many there are of it."""
    by = np.argsort(h)  # which of equal ones comes first is no matter
    sorted_ = h[by]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), sorted_[1:] != sorted_[:-1]]))
    return by[starts], np.diff(starts, append=len(h))


def batch_of(blocks: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names=["shard", "block"])


def dealt(columns: list[np.ndarray], counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """A block for each shard of the n-grams of those words, with their counts."""
    home = shard_of(gram(columns[:-1] if len(columns) > 2 else columns), shards)
    out = []
    for s, own in cut(home, shards):
        own = own[np.argsort(columns[0][own], kind="stable")]
        out.append((s, arrays.pack(columns[0][own], *(c[own] for c in (*columns[1:], counts)))))
    return batch_of(out)


#: Bits of a hash that say where in a shard it is looked for, and that are kept of it: five bytes.
PLACE, KEPT = 16, 40


def keys_of(h: np.ndarray) -> np.ndarray:
    """Hashes of a shard, evenly spread again, as a shard has a range of them."""
    return mixed(h + np.uint64(1)) >> np.uint64(64 - PLACE - KEPT)


def save_keys(folder: str, name: str, h: np.ndarray) -> np.ndarray:
    """Hashes as sorted keys: where each range of keys begins, and each key's last five bytes. Returns their order."""
    keys = keys_of(h)
    order = np.argsort(keys)
    keys = keys[order]
    arrays.save(folder, f"{name}-at", np.searchsorted(keys, np.arange((1 << PLACE) + 1, dtype=np.uint64) << np.uint64(KEPT)).astype(np.uint32))
    arrays.save(folder, f"{name}-low", keys.astype(np.uint32))
    arrays.save(folder, f"{name}-high", (keys >> np.uint64(32)).astype(np.uint8))
    return order


def find_keys(at: np.ndarray, low: np.ndarray, high: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are there, and their places among the sorted keys."""
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, low, high = map(np.asarray, (at, low, high))  # plain views of what is mapped
    keys = keys_of(h)
    order = np.argsort(keys)  # so that the arrays are walked from their beginning to their end
    keys = keys[order]
    place = (keys >> np.uint64(KEPT)).astype(np.int64)
    wanted = keys & np.uint64((1 << KEPT) - 1)
    value = lambda i: high[i].astype(np.uint64) << np.uint64(32) | low[i]
    a = at[place].astype(np.int64)
    left = at[place + 1] - a
    # the first place from a on that isn't less: each step halves all ranges at once, of which those of no length stay where they are
    for _ in range(int(left.max(initial=0)).bit_length()):
        half = left >> 1
        less = (value(np.minimum(a + half, len(low) - 1)) < wanted) & (left > 0)
        a += np.where(less, half + 1, 0)
        left = np.where(less, left - half - 1, half)
    found = np.flatnonzero((a < at[place + 1]))
    found = found[value(a[found]) == wanted[found]]
    return order[found], a[found]


def save_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """Counts of a byte; where one doesn't fit, it is 255 and stands apart with its place."""
    big = np.flatnonzero(counts > 254)
    arrays.save(folder, f"{name}", np.minimum(counts, 255).astype(np.uint8))
    arrays.save(folder, f"{name}-big", np.stack([big, counts[big]]).astype(np.int64))


class Tokens:
    """The tokens of some texts: places of each in `distinct`, and where each text ends."""

    def __init__(self, texts: list[str | None]):
        self.distinct, self.place, self.ends = numbered([*words(text), END] for text in texts)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.within = np.arange(len(self.place)) - np.repeat(self.starts, self.ends - self.starts)

    def before(self, own: np.ndarray, k: int) -> np.ndarray:
        """For each token the id of that k places before it in its text, or START."""
        if not k:
            return own
        out = np.concatenate([own[:k], own[:-k]]) if k < len(own) else own.copy()
        out[self.within < k] = START
        return out


class Lookup(arrays.Shelf):
    """A model's arrays."""

    def ids(self, distinct: list[bytes], sizes: tuple[int, ...]) -> np.ndarray:
        """Each word's id, its place in the order of all words; -1 if it isn't there."""
        h = hashes(distinct)
        out = np.full(len(h), -1, np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        order = np.argsort(h)
        for s, own in cut(shard_of(h[order], len(sizes)), len(sizes)):
            if sizes[s]:
                own = order[own]
                known = self.load(f"words-{s}")
                at = np.minimum(np.searchsorted(known, h[own]), sizes[s] - 1)
                out[own] = np.where(known[at] == h[own], first[s] + at, -1)
        return out

    def of_words(self, name: str, ids: np.ndarray, sizes: tuple[int, ...], width: int) -> np.ndarray:
        """Rows of the words' arrays `name`; zeros for words that aren't there."""
        out = np.zeros((len(ids), width), np.int64)
        order = np.argsort(ids)
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ends = np.searchsorted(ids[order], first)
        for s in np.flatnonzero(np.diff(ends)):
            own = order[ends[s] : ends[s + 1]]
            out[own] = self.load(f"{name}-{s}")[ids[own] - first[s]].reshape(-1, width)
        return out

    def of_grams(self, names: tuple[str, ...], keys: np.ndarray, home: np.ndarray, shards: int) -> np.ndarray:
        """For each key a row of the counts in each of the arrays `names`; zeros for keys that aren't in its home shard."""
        out = np.zeros((len(keys), len(names) - 1), np.int64)
        for s, own in cut(home, shards):
            there, at = find_keys(*(self.load(f"{names[0]}-{s}-{part}") for part in ("at", "low", "high")), keys[own])
            own = own[there]
            for k, name in enumerate(names[1:]):
                n = self.load(f"{name}-{s}")[at].astype(np.int64)
                if (large := np.flatnonzero(n == 255)).size:
                    big = self.load(f"{name}-{s}-big")
                    n[large] = big[1][np.searchsorted(big[0], at[large])]
                out[own, k] = n
        return out


@functools.lru_cache(maxsize=2)
def lookup(folder: str) -> Lookup:
    """One for each worker process and model; two models are kept."""
    return Lookup(folder)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of one, two and more, from how many counts are one to four."""
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def taken(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array((0.0, *d))[np.minimum(counts, 3)]


def kept(batches: Iterator[pa.RecordBatch], only: Callable | None) -> Iterator[pa.RecordBatch]:
    return map(only, batches) if only else batches


def train(texts: DataFrame, text_col: str = "text", order: int = ORDER, shard_bytes: int = SHARD, slice_bytes: int = SLICE, only: Callable | None = None) -> Model:
    """Counts the whole texts of all rows, null as empty, and writes the model, of n-grams up to `order` (at least 2), to the shared folder.

    only: gives the rows of a batch, with all its columns, that count, if not all do.
    """
    spark = texts.sparkSession
    folder = shared_folder(spark, "kneser-ney")
    rows = texts.select(texts[text_col].alias("text"), *(c for c in texts.columns if only and c != text_col))

    def count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kept(batches, only):
            yield pa.RecordBatch.from_arrays([pa.array([byte_lengths(batch.column("text")).sum()], pa.int64())], names=["size"])

    sizes_of = rows.mapInArrow(count_bytes, "size long") if only else rows.select(F.octet_length("text").cast("long").alias("size"))
    size = sizes_of.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()

        def flush() -> pa.RecordBatch:
            h, n = arrays.summed([(hashes(list(counted)), np.fromiter(counted.values(), np.int64, len(counted)))])
            counted.clear()
            return batch_of([(s, arrays.pack(h[own], n[own])) for s, own in cut(shard_of(h, shards), shards)])

        for batch in sliced(kept(batches, only), "text"):
            for text in batch.column("text").to_pylist():
                counted.update(words(text))
                counted[END] += 1
            if len(counted) > WORDS:
                yield flush()
        if counted:
            yield flush()

    def merge_words(key, table):
        shard = key[0].as_py()
        h, n = arrays.summed([arrays.unpack(b) for b in table["block"].to_pylist()])
        arrays.save(folder, f"words-{shard}", h)
        arrays.save(folder, f"word_counts-{shard}", arrays.narrow(n))
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": pa.array([len(h)], pa.int64()), "tokens": pa.array([n.sum()], pa.int64())})

    blocks = rows.mapInArrow(count_words, "shard int, block binary")
    merged = {r.shard: r for r in blocks.repartition(shards, "shard").groupBy("shard").applyInArrow(merge_words, "shard int, words long, tokens long").collect()}
    sizes = tuple(merged[s].words if s in merged else 0 for s in range(shards))
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(kept(batches, only), "text", slice_bytes):
            tokens = Tokens(batch.column("text").to_pylist())
            own = lookup(folder).ids(tokens.distinct, sizes).astype(np.uint64)[tokens.place]
            columns = [tokens.before(own, k) for k in range(order - 1, -1, -1)]
            at, n = distinct(gram(columns))
            yield dealt([c[at] for c in columns], n, shards)

    def merge_grams(level: int):
        def merge(key, table):
            """Writes the shard of a level; returns the next lower level's blocks, or after pairs what their words' shards need."""
            trim()  # what the shard before has left
            shard = key[0].as_py()
            parts = [arrays.unpack(b, np.uint64) for b in table["block"].to_pylist()]
            *columns, n = (np.concatenate([p[i] for p in parts]) for i in range(level + 1))
            del parts
            h = gram(columns)
            by = np.argsort(h)
            starts = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))
            n = np.add.reduceat(n[by].astype(np.int64), starts)
            at = by[starts]
            columns, h = [c[at] for c in columns], h[at]
            save_counts(folder, f"counts{level}-{shard}", n[save_keys(folder, f"grams{level}-{shard}", h)])
            totals = [len(h), *(int((n == k).sum()) for k in (1, 2, 3, 4))]
            if level > 2:
                context = gram(columns[:-1])
                by = np.argsort(context)
                starts = np.flatnonzero(np.concatenate([[True], context[by][1:] != context[by][:-1]]))
                total, *after = (np.add.reduceat(x[by], starts) for x in (n, n == 1, n == 2, n > 2))
                own = (total > 1) | (columns[0][by[starts]] == START)  # of others it is enough that they are known
                placed = save_keys(folder, f"contexts{level}-{shard}", context[by[starts]][own])
                for name, x in zip(("total", "once", "twice", "more"), (total, *after), strict=True):
                    save_counts(folder, f"{name}{level}-{shard}", x[own].astype(np.int64)[placed])
                rest = columns[1:]
                at, n = distinct(gram(rest))
                arrays.save(folder, f"totals{level}-{shard}", np.array(totals, np.int64))
                batch = dealt([c[at] for c in rest], n, shards)
                return pa.Table.from_batches([batch])
            before, after = columns
            at_start = before == START
            starting = [int(x) for x in (n[at_start].sum(), *((np.minimum(n[at_start], 3) == k).sum() for k in (1, 2, 3)))]
            arrays.save(folder, f"totals{level}-{shard}", np.array([*totals, *starting], np.int64))
            small, zero = np.minimum(n, 3), np.zeros(len(n), np.int64)
            as_context = (before[~at_start], *(x[~at_start] for x in (n, small == 1, small == 2, small == 3)), zero[~at_start])
            ids, *stats = arrays.summed([as_context, (after, zero, zero, zero, zero, zero + 1)])
            part = np.searchsorted(first, ids.astype(np.int64), "right") - 1
            return pa.Table.from_batches([batch_of([(s, arrays.pack(ids[own], *(c[own] for c in stats))) for s, own in cut(part, shards)])])

        return merge

    def merge_stats(key, table):
        shard = key[0].as_py()
        ids, *columns = arrays.summed([arrays.unpack(b) for b in table["block"].to_pylist()])
        rows = np.zeros((sizes[shard], 5), np.int64)
        rows[ids.astype(np.int64) - first[shard]] = np.stack(columns, axis=1)
        arrays.save(folder, f"stats-{shard}", arrays.narrow(rows))
        continued = rows[:, 4]
        return pa.table({"totals": pa.array([[int((continued == k).sum()) for k in (1, 2, 3, 4)] + [int((continued > 2).sum())]], pa.list_(pa.int64()))})

    blocks = rows.mapInArrow(count_grams, "shard int, block binary")
    for level in range(order, 1, -1):
        blocks = blocks.repartition(shards, "shard").groupBy("shard").applyInArrow(merge_grams(level), "shard int, block binary")
    lower = blocks.repartition(shards, "shard").groupBy("shard").applyInArrow(merge_stats, "totals array<long>")
    lower = [x or 0 for x in lower.agg(*(F.sum(F.get("totals", F.lit(i))) for i in range(5))).first()]

    def total(level: int, width: int) -> list[int]:
        """The sum of a level's totals, which lie with its shards, and empty arrays for shards without n-grams."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.zeros(width, np.int64)
                for s in batch.column("id").to_pylist():
                    if arrays.exists(folder, f"totals{level}-{s}"):
                        own += arrays.load(folder, f"totals{level}-{s}")
                        continue
                    for name in (f"grams{level}", f"contexts{level}"):
                        save_keys(folder, f"{name}-{s}", np.zeros(0, np.uint64))
                    for name in ("counts", "total", "once", "twice", "more"):
                        save_counts(folder, f"{name}{level}-{s}", np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([own.tolist()], pa.list_(pa.int64()))], names=["totals"])

        found = spark.range(shards).mapInArrow(add, "totals array<long>")
        return [x or 0 for x in found.agg(*(F.sum(F.get("totals", F.lit(i))) for i in range(width))).first()]

    totals = {level: total(level, 9 if level == 2 else 5) for level in range(2, order + 1)}
    every = (discounts(*lower[:4]), *(discounts(*totals[level][1:5]) for level in range(2, order + 1)))
    # the lowest level counts, for each word, the different words before it: as many as there are different pairs
    types = totals[2][0]
    mass = (every[0][0] * lower[0] + every[0][1] * lower[1] + every[0][2] * lower[4]) / types if types else 1.0
    return Model(folder, order, sizes, sum(r.tokens for r in merged.values()), types, every, mass, tuple(totals[2][5:]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known (tokens seen in training), base_score and score (log10 probabilities of the text).

    base_score: each token by itself, half a count added to each of the seen tokens and one more. score: the model's,
    where an n-gram's counts are discounted and interpolated with the next lower level, and the lowest with the uniform
    distribution over the vocabulary and one unknown word. A null or empty text is its end token alone. Every row gives one
    row; ids may be null or repeat, other columns are no matter.
    """
    rows = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].alias("text"))
    return score_rows(rows, model, "text", SCORES).drop("text")


SCORES = ("n_tokens", "n_known", "base_score", "score")


def score_rows(docs: DataFrame, model: Model, text_col: str, wanted: tuple[str, ...], slice_bytes: int = SLICE, only: Callable | None = None) -> DataFrame:
    """All columns of docs and the wanted ones of SCORES and worst, whose names docs must not have.

    worst: the lowest mean score (log10) of any STRETCH tokens in a row, null for shorter texts.
    only: as in train().
    """
    types = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double", "worst": "double"}
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lookup(model.folder)
        for batch in gathered(kept(batches, only), text_col, slice_bytes):
            found = scores_of(batch.column(text_col).to_pylist(), model, own, "worst" in wanted)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[k], from_pandas=True) for k in wanted)], names=[*batch.schema.names, *wanted])

    return docs.mapInArrow(run, f"{columns}, {', '.join(f'{k} {types[k]}' for k in wanted)}")


def scores_of(texts: list[str | None], model: Model, own: Lookup, worst: bool = True) -> dict[str, np.ndarray]:
    size, n = model.vocabulary, model.tokens
    tokens = Tokens(texts)
    ids = own.ids(tokens.distinct, model.sizes)
    seen = own.of_words("word_counts", ids, model.sizes, 1)[:, 0]
    stats = own.of_words("stats", ids, model.sizes, 5)
    base = np.log10((seen + 0.5) / (n + 0.5 * (size + 1)))
    lower = np.maximum(stats[:, 4] - taken(stats[:, 4], model.discounts[0]), 0) / max(model.types, 1) + model.lower_mass / (size + 1)
    p = lower[tokens.place]
    row = ids.astype(np.uint64)[tokens.place]
    known = ids[tokens.place] >= 0
    before = tokens.before(tokens.place.astype(np.uint64), 1)
    before[tokens.within < 1] = len(stats)
    # contexts of pairs are single words; the last row is START
    after = np.concatenate([stats[:, :4], [model.start]])[before.astype(np.int64)] if len(p) else np.zeros((0, 4), np.int64)
    for level in range(2, model.order + 1):
        columns = [tokens.before(row, k) for k in range(level - 1, -1, -1)]
        if level > 2:
            context = gram(columns[:-1])
            wanted = np.flatnonzero(met_before | (tokens.within < level - 1))
            after = np.zeros((len(p), 4), np.int64)
            home = shard_of(context[wanted], model.shards)
            after[wanted] = own.of_grams((f"contexts{level}", *(f"{x}{level}" for x in ("total", "once", "twice", "more"))), context[wanted], home, model.shards)
            after[met_before & (after[:, 0] == 0)] = (1, 1, 0, 0)  # contexts seen once aren't kept
        often = after[:, 0]
        met = np.flatnonzero((often > 0) & known)
        keys = gram([c[met] for c in columns])
        counts = np.zeros(len(p), np.int64)
        home = shard_of(gram([c[met] for c in columns[:-1]]) if level > 2 else keys, model.shards)
        counts[met] = own.of_grams((f"grams{level}", f"counts{level}"), keys, home, model.shards)[:, 0]
        d = model.discounts[level - 1]
        has = often > 0
        p[has] = (np.maximum(counts - taken(counts, d), 0)[has] + sum(after[has, k] * x for k, x in enumerate(d, 1)) * p[has]) / often[has]
        # whether the words before each token, one less than a context of the next level has, were seen as an n-gram
        found = counts > 0
        met_before = np.concatenate([[False], found[:-1]]) if len(found) else found
        met_before[tokens.within < level] = False
    p = np.log10(p)
    n_known, base_score, score = (np.add.reduceat(x, tokens.starts) if len(p) else x for x in ((seen > 0).astype(np.int64)[tokens.place], base[tokens.place], p))
    found = {"n_tokens": tokens.ends - tokens.starts, "n_known": n_known, "base_score": base_score, "score": score}
    return found | {"worst": worst_of(p, tokens)} if worst else found


def worst_of(scores: np.ndarray, tokens: Tokens) -> np.ndarray:
    if not len(scores):
        return scores
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    ends = np.minimum(np.arange(len(scores)) + STRETCH, len(scores))
    own = np.where(tokens.within + STRETCH <= np.repeat(tokens.ends - tokens.starts, tokens.ends - tokens.starts), sums[ends] - sums[:-1], np.inf)
    least = np.minimum.reduceat(own, tokens.starts) / STRETCH
    return np.where(np.isinf(least), np.nan, least)


def held_out(id_col):
    """Whether a document is held out of training: a fifth of all, by the checksum of its id. Null ids are not."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 1, F.lit(False))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Trains on the documents that aren't held out and scores all: as score(), with held_out and train_tokens."""
    model = train(docs.where(~held_out(docs[id_col])), text_col, order)
    scored = score(docs, model, id_col, text_col)
    return scored.select(id_col, held_out(scored[id_col]).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
