"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in few bits differ in very few bits of some segment:
all values near a fingerprint's segment (a small Hamming ball) are looked up in that segment's table, and matches are
verified over the whole fingerprint. Equal fingerprints are taken together first, so copies cost nothing.

keep_dissimilar() finds documents by the likeness of their shingle sets instead, by the same search over longer fingerprints,
whose length follows from the likeness and the number of documents; see Plan. What such fingerprints miss, and links that
representatives hide, missed_pairs() finds exactly among documents that aren't yet in one group.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, named, relieve, saved, saved_at, shared_folder
from . import arrays
from .common import numbered, sliced
from .components import components

BITS = 64
SEED = 42
#: The bits of each byte value, lowest first.
_BITS_OF = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def fingerprints_of(texts: list[str | None], width: int = 3) -> np.ndarray:
    """The 64-bit fingerprints of whole texts."""
    hashes, counts = [], []
    for text in texts:
        words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
        if len(words) > width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            own = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - width + 1)
        elif words:
            own = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        else:
            own = np.zeros(0, np.uint64)
        hashes.append(own)
        counts.append(len(own))
    n = np.array(counts, np.int64)
    each = np.concatenate(hashes or [np.zeros(0, np.uint64)]).view(np.uint8).reshape(-1, 8)  # little-endian bytes
    doc = np.repeat(np.arange(len(n)), n) * 256
    out = np.zeros(len(n), np.uint64)
    for byte in range(8):
        ones = np.bincount(doc + each[:, byte], minlength=256 * len(n)).reshape(len(n), 256) @ _BITS_OF
        set_bits = (2 * ones > n[:, None]).astype(np.uint64) << np.arange(8 * byte, 8 * byte + 8, dtype=np.uint64)
        out |= np.bitwise_or.reduce(set_bits, axis=1)
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            fp = fingerprints_of(batch.column("text").to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp)], names=["id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id long, fp long")


def balls(radius: int, segments: int) -> list[tuple[int, int, list[int]]]:
    """For each segment its lowest bit, its width and the masks to probe with, so that no pair within the radius is missed.

    With radius = segments * q + a, a pair beyond q bits in the first a + 1 segments and beyond q - 1 bits in the others
    would differ in more than radius bits; those are the balls' radii.
    """
    q, a = divmod(radius, segments)
    out, low = [], 0
    for s in range(segments):
        width = BITS // segments + (s < BITS % segments)
        most = q if s <= a else q - 1
        if most >= 0:
            out.append((low, width, [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(width), k)]))
        low += width
    return out


def near_pairs(fps: DataFrame, radius: int = 3, segments: int = 2) -> DataFrame:
    """fps: fp (long, distinct). Pairs a < b that differ in at most radius bits, each once."""
    table = probes = None
    for number, (low, width, masks) in enumerate(balls(radius, segments)):
        segment = F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1)
        own = fps.select(F.lit(number).alias("segment"), segment.alias("value"), F.col("fp").alias("b"))
        ball = fps.select(F.lit(number).alias("segment"), segment.alias("value"), F.col("fp").alias("a"))
        ball = ball.select("segment", F.explode(F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.col("value").bitwiseXOR(m))).alias("value"), "a")
        table = own if table is None else table.unionByName(own)
        probes = ball if probes is None else probes.unionByName(ball)
    met = probes.join(table, ["segment", "value"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return met.select("a", "b").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, segments: int = 2, width: int = 3) -> DataFrame:
    """Each row's id, fingerprint (16 lower-case hex digits) and component_id: the smallest id that links reach.

    A null or blank text has fingerprint zero and links like any other; fewer words than a shingle are one shingle. Rows
    may repeat: each gives one row. A null id gives a row, but is never a component_id unless its component has no other
    id. Other columns are no matter. Rows with equal fingerprints link through the fingerprint, not pair by pair.
    """
    rows = saved(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = saved(rows.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    parts = components(near_pairs(classes.select("fp"), radius, segments))
    grouped = classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    smallest = grouped.groupBy("part").agg(F.min("first").alias("component_id"))
    of_class = grouped.join(smallest, "part").select("fp", "component_id")
    return rows.join(of_class, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, segments: int = 2, width: int = 3) -> DataFrame:
    """The rows of docs, with their own columns, but for those whose group holds a smaller id; see simhash_groups().

    Rows without an id stay, and so do rows that repeat an id that stays.
    """
    groups = simhash_groups(docs, id_col, text_col, radius, segments, width)
    gone = groups.where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias("gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")


#: First bits of a long fingerprint that go with each of its segments.
CHECK = 32
#: Text whose shingles a task holds at once: less than elsewhere, as joins before have filled the executors' heaps.
SLICE = 1 << 20


@dataclass(frozen=True)
class Plan:
    """Segments of the long fingerprints, bits of each, and bits in which two documents of the wanted likeness may differ: in all, and in the first CHECK bits."""

    segments: int
    bits: int
    radius: int
    near: int

    @classmethod
    def of(cls, rows: int, least: float) -> Plan:
        """For shingle sets of a Jaccard likeness of `least`, whose fingerprints differ in a bit with probability angle / pi.

        A segment has some bits more than the rows' number, so that strangers seldom meet; there are so many segments that
        one of them differs in at most one bit for 97 of 100 pairs just at the threshold. The radius is three standard
        deviations above what such a pair differs in on average; that of the first bits, which sort out most strangers before
        whole fingerprints are fetched, three and a half.
        """
        differs = math.acos(min(1.0, 2 * least / (1 + least))) / math.pi
        bits = min(56, max(12, math.ceil(math.log2(max(1, rows))) + 2))
        meets = (1 - differs) ** bits + bits * differs * (1 - differs) ** (bits - 1)
        segments = max(1, math.ceil(math.log(0.03) / math.log1p(-meets))) if meets < 1 else 1
        n = segments * bits
        most = lambda n, k: min(n, math.ceil(n * differs + k * math.sqrt(n * differs * (1 - differs))))
        return cls(segments, bits, most(n, 3), most(CHECK, 3.5))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(32)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, as hashes: text number and hash, sorted. Fewer words than a shingle are one; no word, none."""
    distinct, at, ends = numbered((text or "").encode().lower().split() for text in texts)
    h = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[at]
    size = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(ends)), size)
    run = np.zeros(len(h), np.uint64)
    for k in range(width):  # beyond a text's end nothing is added; only short texts keep such a run
        own = h[k:] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1)
        run[: len(own)] += np.where(owner[k:] == owner[: len(own)], own, np.uint64(0))
    place = np.arange(len(h)) - np.repeat(ends - size, size)
    whole = place <= np.maximum(size[owner] - width, 0)
    owner, run = owner[whole], _mixed(run[whole])
    order = np.lexsort((run, owner))
    owner, run = owner[order], run[order]
    first = np.ones(len(run), bool)
    first[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    return owner[first], run[first]


def long_fingerprints(texts: list[str | None], width: int, plan: Plan) -> np.ndarray:
    """A row of segments for each text."""
    owner, run = shingle_sets(texts, width)
    n = np.bincount(owner, minlength=len(texts))
    bits = np.zeros((len(texts), 64 * -(-plan.segments * plan.bits // 64)), bool)
    for word in range(bits.shape[1] // 64):
        each = _mixed(run * np.uint64(2 * word + 3) + np.uint64(word + 1)).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones = np.bincount(owner * 256 + each[:, byte], minlength=256 * len(texts)).reshape(len(texts), 256) @ _BITS_OF
            bits[:, 64 * word + 8 * byte : 64 * word + 8 * byte + 8] = 2 * ones > n[:, None]
    own = bits[:, : plan.segments * plan.bits].reshape(len(texts), plan.segments, plan.bits)
    return (own.astype(np.int64) << np.arange(plan.bits)).sum(axis=2)


def similar_pairs(docs: DataFrame, id_col: str, text_col: str, least: float, width: int) -> tuple[DataFrame, DataFrame]:
    """Classes (id, first: the smallest id with its fingerprint) and verified pairs a, b of such first ids whose shingle sets are alike.

    First each class is compared with the smallest of each of its buckets of equal segments, once per segment; those found
    alike have a representative. Then balls of radius 1 around the segments are looked up, but for pairs of which both have
    one, as in a large group they all do. So groups cost in proportion to their size; a group hangs together by its
    representatives.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id is not null")
    plan = Plan.of(rows.count(), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            found = long_fingerprints(batch.column("text").to_pylist(), width, plan)
            ends = pa.array(np.arange(0, found.size + 1, plan.segments), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names=["id", "fp"])

    fps = saved(rows.mapInArrow(run, "id long, fp array<long>"), "fingerprints")
    classes = saved(fps.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    check = F.lit(0).cast("bigint")
    for s in range(min(plan.segments, -(-CHECK // plan.bits))):
        check = check.bitwiseOR(F.shiftleft(F.get("fp", F.lit(s)), s * plan.bits))
    check = F.when(check.bitwiseAND(1 << 31) != 0, check.bitwiseAND((1 << 31) - 1) - (1 << 31)).otherwise(check.bitwiseAND((1 << 31) - 1)).cast("int")  # its low 32 bits
    close = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)).cast("bigint").bitwiseAND((1 << 32) - 1)) <= plan.near
    own = classes.select(F.col("first").alias("id"), check.alias("check"), F.posexplode("fp").alias("segment", "value"))
    leaders = own.groupBy("segment", "value").agg(F.min(F.struct("id", "check")).alias("l"), F.count("*").alias("n")).where("n > 1")
    leaders, path = saved_at(leaders.select("segment", "value", F.col("l.id").alias("leader"), F.col("l.check").alias("other_check")), "leaders")
    led = own.join(leaders, ["segment", "value"]).where("id <> leader").where(close("check", "other_check")).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    first = saved(_alike(led, classes, rows, plan, least, width), "alike")
    discard(docs.sparkSession, path)
    covered = first.select(F.col("b").alias("first"), F.lit(True).alias("covered")).distinct()
    marked = saved(classes.join(covered, "first", "left").select(F.col("first").alias("id"), F.coalesce("covered", F.lit(False)).alias("covered"), check.alias("check"), "fp"), "marked")
    exact = marked.select("id", "covered", "check", F.posexplode("fp").alias("segment", "value"))
    # two values that differ in one bit: the one that lacks it meets the other when it is set
    masks = F.lit([1 << b for b in range(plan.bits)]).cast("array<bigint>")
    ball = F.concat(F.array("value"), F.transform(F.filter(masks, lambda m: F.col("value").bitwiseAND(m) == 0), lambda m: F.col("value").bitwiseOR(m)))
    balls_ = exact.select(F.col("id").alias("other"), F.col("covered").alias("other_covered"), F.col("check").alias("other_check"), "segment", F.explode(ball).alias("value"))
    met = exact.join(balls_.where("not other_covered"), ["segment", "value"]).unionByName(exact.where("not covered").join(balls_.where("other_covered"), ["segment", "value"]))
    met = met.where("id <> other").where(close("check", "other_check")).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return fps.join(classes, "fp").select("id", "first"), first.unionByName(_alike(met, classes, rows, plan, least, width))


def _alike(pairs: DataFrame, classes: DataFrame, rows: DataFrame, plan: Plan, least: float, width: int) -> DataFrame:
    """Of the pairs a, b those whose fingerprints are near and whose shingle sets are alike."""
    one, two = (classes.select(F.col("first").alias(c), F.col("fp").alias(f"fp_{c}")) for c in "ab")
    far = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda t, x: t + x)
    near = saved(pairs.join(one, "a").join(two, "b").where(far <= plan.radius).select("a", "b"), "near")
    wanted = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            owner, run = shingle_sets(batch.column("text").to_pylist(), width)
            parts = np.split(run, np.searchsorted(owner, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "shingles"])

    # equal ids with several texts: the one of them that comes last in order
    held = saved(rows.join(wanted, "id", "left_semi").mapInArrow(sets, "id long, shingles binary").groupBy("id").agg(F.max("shingles").alias("shingles")), "shingles")
    return _verified(near, held, least)


def _verified(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Of the pairs a, b those whose shingle sets are alike; held: id, shingles."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("one"), batch.column("two"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(held.select(F.col("id").alias("a"), F.col("shingles").alias("one")), "a").join(held.select(F.col("id").alias("b"), F.col("shingles").alias("two")), "b")
    return joined.mapInArrow(verify, "a long, b long")


#: Text whose shingles are counted for their order; which one it is changes what a search costs, not what it finds.
COUNTED = 32 << 20


@functools.lru_cache(maxsize=2)
def _common(folder: str) -> tuple[np.ndarray, np.ndarray]:
    return arrays.load(folder, "hash"), arrays.load(folder, "count")


def common_shingles(rows: DataFrame, width: int) -> str:
    """The folder of the shingles that more than one text has, of some texts of about COUNTED bytes, and in how many of these each is."""
    folder = shared_folder(rows.sparkSession, "common")
    part = max(1, -(-(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // COUNTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(batch.column("text").to_pylist(), width)[1].view(np.int64))], names=["h"])

    found = rows.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0).select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    arrays.save(folder, "hash", h[order])
    arrays.save(folder, "count", n[order])
    return folder


def set_key(run: np.ndarray) -> int:
    """A hash of a set of shingles."""
    return int(_mixed(np.array([_mixed(run).sum(dtype=np.uint64) + np.uint64(len(run))], np.uint64)).view(np.int64)[0])


def prefix_of(run: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a set, in the order of all shingles by count and hash: any two sets that are alike have one of theirs in common."""
    known, n = common
    count = np.zeros(len(run), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, run), len(known) - 1)
        count = np.where(known[at] == run, n[at], 0)
    return run[np.lexsort((run, count))[: len(run) - math.ceil(least * len(run) - 1e-9) + 1]] if len(run) else run


def bits_of(run: np.ndarray) -> np.ndarray:
    """A set as bits, at least as many as shingles and a power of two of words of 64: whether the number of shingles that fall on each is odd.

    Shingles that two sets share cancel out, so the bits in which they differ are at most as many as shingles that only one has, and
    for strangers nearly half of all. So few bits are enough to tell them apart; they travel with every shingle of a prefix.
    """
    words = 1 << max(0, math.ceil(math.log2(max(1, len(run)) / 64)))
    odd = np.bincount((_mixed(run) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def missed_pairs(rows: DataFrame, groups: DataFrame, least: float, width: int) -> DataFrame:
    """All pairs a, b of ids whose shingle sets are alike and that aren't in one group yet, copies by their smallest id.

    rows: id, text; groups: id, kept. Sets that are alike have a shingle of their prefixes in common (see prefix_of). Where a
    shingle's holders are of several groups, those of different groups are compared: by size and place, then by the bits in which the
    sets differ, of which each stands for a shingle that only one has, and then by the sets themselves.
    """
    folder = common_shingles(rows, width)

    def sets(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            owner, run = shingle_sets(batch.column("text").to_pylist(), width)
            parts = np.split(run, np.searchsorted(owner, np.arange(1, batch.num_rows)))
            keys = pa.array([set_key(p) for p in parts], pa.int64())
            if whole:
                yield pa.RecordBatch.from_arrays([keys, pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "shingles"])
                continue
            columns = [pa.array([len(p) for p in parts], pa.int32())]
            for f in (lambda p: prefix_of(p, _common(folder), least).view(np.int64), bits_of):
                columns.append(pa.array([f(p) for p in parts], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("id"), keys, *columns], names=["id", "node", "n", "prefix", "bits"])

    found, path = saved_at(rows.mapInArrow(lambda batches: sets(batches, False), "id long, node long, n int, prefix array<long>, bits array<long>"), "prefixes")
    nodes = found.where("n > 0").select("id", "node").join(groups, "id").groupBy("node").agg(F.min("id").alias("first"), F.min("kept").alias("kept"))
    nodes = saved(nodes, "nodes")
    own = found.join(nodes.withColumnRenamed("first", "id"), ["node", "id"]).select("node", "kept", F.posexplode("prefix").alias("place", "shingle"))
    all_of = Window.partitionBy("shingle")
    met, met_path = saved_at(own.select("*", F.min("kept").over(all_of).alias("low"), F.max("kept").over(all_of).alias("high")).where("low <> high").drop("low", "high"), "met")
    traits = found.join(met.select("node").distinct(), "node", "left_semi").select("node", "n", "bits").dropDuplicates(["node"])
    met, traits_path = saved_at(met.join(traits, "node"), "met-traits")
    del own, found
    discard(rows.sparkSession, path, met_path)
    one, two = (met.select("shingle", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "kept", "place", "n", "bits"))) for k in "ab")
    pairs = one.join(two, "shingle").where("node_a < node_b and kept_a <> kept_b").where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9)
    # before the first shingle that both have there is none, so from its places on enough must be left
    pairs = pairs.where(F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= least / (1 + least) * (F.col("n_a") + F.col("n_b")) - 1e-6)
    half = lambda x: F.zip_with(F.slice(x, 1, F.size(x) / 2), F.slice(x, F.size(x) / 2 + 1, F.size(x) / 2), lambda p, q: p.bitwiseXOR(q))
    cut = lambda x, y: F.when(F.size(x) > F.size(y), half(F.col(x))).otherwise(F.col(x))
    differ = F.aggregate(F.zip_with(cut("bits_a", "bits_b"), cut("bits_b", "bits_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda t, x: t + x)
    pairs = pairs.where(differ <= (1 - least) / (1 + least) * (F.col("n_a") + F.col("n_b")) + 1e-6)
    pairs = saved(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "candidates")
    discard(rows.sparkSession, traits_path)
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes, "node").select(F.col("first").alias("id")).distinct()
    held = rows.join(wanted, "id", "left_semi").mapInArrow(lambda batches: sets(batches, True), "id long, shingles binary")
    alike = _verified(pairs, saved(held.groupBy("id").agg(F.first("shingles").alias("shingles")), "shingles"), least)
    first = lambda c: nodes.select(F.col("node").alias(c), F.col("first").alias(f"first_{c}"))
    return alike.join(first("a"), "a").join(first("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of docs, with their own columns, but for those that a chain of near-duplicates joins to a smaller id.

    Near-duplicates are texts whose sets of `width`-word shingles (A-Z in lower case) have a Jaccard likeness of at least
    `least`. Texts without a word are copies of each other. Rows without an id stay, and so do rows that repeat an id that stays.
    """
    before = named()
    classes, pairs = similar_pairs(docs, id_col, text_col, least, width)
    parts = components(pairs)
    groups, groups_path = saved_at(classes.join(parts, classes["first"] == parts["node"], "left").select("id", F.coalesce("component", "first").alias("kept")), "groups")
    del classes, pairs, parts
    discard(docs.sparkSession, *(path for path in named() if path not in (*before, groups_path)))
    relieve(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id is not null")
    more = missed_pairs(rows, groups, least, width)
    linked = groups.where("id <> kept").select(F.col("id").alias("a"), F.col("kept").alias("b"))
    parts = components(linked.unionByName(more))
    grouped = groups.join(parts, groups["id"] == parts["node"], "left").select("id", F.coalesce("component", "id").alias("kept"))
    gone = grouped.where("id > kept").select(F.col("id").alias("gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
