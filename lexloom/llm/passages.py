"""Passages that documents share, exactly or nearly, by collinear chaining.

Seeds are runs of K words, chosen by winnowing: of every WINDOW neighbouring runs the one with the least hash, so that any
exact passage of K + WINDOW - 1 words has one wherever it stands. Each seed is joined to the first document that has it
(not to every document), so a passage in n documents gives n - 1 matches per seed and not n * n. Where neighbouring seeds
have different first holders, runs of them are joined to the first document that has the whole run. For these joins the
keys of a slice of text travel as one compact block for each shard of the key space; see meetings(). A document's matches
with one other document are chained in order on both sides, with a cost for gaps, through a Fenwick tree of prefix
maxima; a chain is then aligned word by word and cut where that is poor, and its parts are passages if they are long and
alike enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, saved_at
from .common import numbered, sliced, without_gc

#: Words of a seed; neighbouring seeds of which one is kept.
K, WINDOW = 4, 4
#: Words of a passage at least, and how alike the two sides are at least (1 - edits / words of the longer side).
LEAST_WORDS, ALIKE = 40, 0.8
#: Cost of each word of a gap on either side, against K for a matched seed; words of a gap at most.
GAP_COST, MOST_GAP = 0.045, 40
#: An end is extended over single edits, as long as so many of the next words agree.
LOOK = 4
#: An alignment is cut where more words than this in a row have no equal on the other side; see parted().
POOR = 4
#: Words of a piece of text that is sent to documents that share some of it.
CHUNK = 128
#: Words beyond a chain's ends that are looked at, as edits may leave a passage's ends without seeds.
MARGIN = 60
#: Words from the first to the last seed of a run, whose first holder is looked for too. The longer one lies within any
#: exact passage of LEAST_WORDS, and its seeds don't depend on the words around the passage.
SPANS = (9, LEAST_WORDS - K - 3 * (WINDOW - 1))

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = [pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1 for k in range(1, K + 1)]


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def seeds_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of each text: its number, the seed and its place (a word's number)."""
    distinct, at, ends = numbered(map(words, texts))
    h = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[at]
    none = np.zeros(0, np.int64)
    if len(h) < K:
        return none, none.astype(np.uint64), none
    n = len(h) - K + 1
    run = np.zeros(n, np.uint64)
    for k in range(K):
        run += h[k : k + n] * np.uint64(_ODD[k])
    run = (run ^ run >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    run ^= run >> np.uint64(29)
    text_of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    start = np.array([0, *ends[:-1]])
    valid = np.flatnonzero(text_of[:n] == text_of[K - 1 :])  # runs within one text
    if not len(valid):
        return none, none.astype(np.uint64), none
    run, owner = run[valid], text_of[valid]
    # equal neighbours (a word again and again) are told apart by their number in the row of equals, and thinned
    fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])])
    number = np.arange(len(run)) - np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
    run = (run + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.where(number % WINDOW == 0, 1, 0).astype(np.uint64) + np.where(number % WINDOW == 0, 0, (1 << 64) - 1).astype(np.uint64)
    m = len(run)
    best, least = np.arange(m), run.copy()  # of the window that starts here, within its text
    for k in range(1, min(WINDOW, m)):
        other = run[k:]
        better = (other < least[: m - k]) & (owner[k:] == owner[: m - k])
        best[: m - k][better] = np.flatnonzero(better) + k
        least[: m - k][better] = other[better]
    whole = np.zeros(m, bool)  # windows that don't run over the text's end, or the only one of a short text
    whole[: max(0, m - WINDOW + 1)] = owner[WINDOW - 1 :] == owner[: max(0, m - WINDOW + 1)] if m >= WINDOW else False
    whole |= np.concatenate([[True], owner[1:] != owner[:-1]])
    kept = np.unique(best[whole])
    kept = kept[number[kept] % WINDOW == 0]
    return owner[kept], run[kept], valid[kept] - start[owner[kept]]


def runs_of(id_: np.ndarray, source: np.ndarray, place: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of seeds whose first holders aren't one place: the run's key, its first and its last seed; rows sorted by id and place."""
    n = len(id_)
    follows = np.zeros(n, bool)
    follows[1:] = (id_[1:] == id_[:-1]) & (source[1:] == source[:-1]) & (other[1:] - place[1:] == other[:-1] - place[:-1])
    changes = np.cumsum(~follows)
    # a run's key is a polynomial in its places over its seeds, each known by its first holder
    seed = mixed(mixed(source.astype(np.uint64)) + other.astype(np.uint64))
    at = place.astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(seed * power(_ODD[0], at), dtype=np.uint64)])
    doc = np.cumsum(np.concatenate([[0], id_[1:] != id_[:-1]])) if n else np.zeros(0, np.int64)
    wide = int(place.max()) + 2 * SPANS[-1] if n else 0
    line = doc * wide + place
    keys, starts, ends = [], [], []
    inverse = power(pow(_ODD[0], -1, 1 << 64), at)
    for span in SPANS:
        last = np.searchsorted(line, line + span, "right") - 1
        i = np.flatnonzero(changes[last] > changes)
        keys.append(mixed((sums[last[i] + 1] - sums[i]) * inverse[i] + np.uint64(span)))
        starts.append(i)
        ends.append(last[i])
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(ends)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(32)


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base to each exponent, modulo 2 ** 64."""
    out, left = np.ones(len(exponents), np.uint64), exponents.copy()
    while left.any():
        out *= np.where(left & np.uint64(1), np.uint64(base), np.uint64(1))
        base = base * base % (1 << 64)
        left >>= np.uint64(1)
    return out


def chains_of(place: np.ndarray, other: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """Chains of the matches (place, other), both rising strictly along each; every match is in at most one chain.

    A match's score is K and the best score of a match before it on both sides, less the cost of the gap between, or K
    alone. The cost is linear, so the best one before is a prefix maximum over `other`, kept in a Fenwick tree.
    """
    pairs = sorted(zip(np.asarray(place).tolist(), np.negative(other).tolist(), strict=True))  # most are few, for which calls of numpy cost more
    p, o = [x for x, _ in pairs], [-y for _, y in pairs]
    rank = {y: i for i, y in enumerate(sorted(set(o)))}
    ranks = [rank[y] for y in o]
    n, size = len(p), len(rank)
    tree_score, tree_at = [0.0] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    for i in range(n):
        here = GAP_COST * (p[i] + o[i])
        best, at, r = 0.0, -1, ranks[i]
        while r > 0:
            if tree_at[r] >= 0 and (at < 0 or tree_score[r] > best):
                best, at = tree_score[r], tree_at[r]
            r &= r - 1
        gained = best - here if at >= 0 else 0.0
        if gained > 0 and p[at] < p[i]:
            score[i], back[i] = K + gained, at
        else:
            score[i] = K
        value, r = score[i] + here, ranks[i] + 1
        while r <= size:
            if tree_at[r] < 0 or value > tree_score[r]:
                tree_score[r], tree_at[r] = value, i
            r += r & -r
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        chain.reverse()
        cut = 0
        for k in range(1, len(chain) + 1):
            if k == len(chain) or p[chain[k]] - p[chain[k - 1]] > MOST_GAP + K or o[chain[k]] - o[chain[k - 1]] > MOST_GAP + K:
                part = chain[cut:k]
                if len(part) > 1:
                    out.append(([p[j] for j in part], [o[j] for j in part]))
                cut = k
    return out


def distance(a: list, b: list) -> int:
    """Edits between two lists, by Myers' bit-parallel columns."""
    if not a or not b:
        return len(a) + len(b)
    bits: dict = {}
    for i, x in enumerate(a):
        bits[x] = bits.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for x in b:
        match = bits.get(x, 0)
        diagonal = ((match & plus) + plus ^ plus) | match | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        score += bool(up & last) - bool(down & last)
        up = up << 1 & full | 1
        down = down << 1 & full
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
    return score


def extended(a: list, b: list) -> list[tuple[int, int, int]]:
    """Runs of equal words (places in each, length) by which two lists go on alike: over one edit at a time, before LOOK equal words."""
    i = j = n = 0
    out = []
    while i + n < len(a) and j + n < len(b):
        if a[i + n] == b[j + n]:
            n += 1
            continue
        for di, dj in ((1, 1), (1, 0), (0, 1)):
            after = a[i + n + di : i + n + di + LOOK]
            if len(after) == LOOK and after == b[j + n + dj : j + n + dj + LOOK]:
                out.append((i, j, n))
                i, j, n = i + n + di, j + n + dj, 0
                break
        else:
            break
    return [x for x in [*out, (i, j, n)] if x[2]]


def between(a: list, b: list) -> list[tuple[int, int, int]]:
    """Runs of equal words (places in each, length) in an alignment of two lists with the fewest edits."""
    short = min(len(a), len(b))
    head = next((i for i in range(short) if a[i] != b[i]), short)
    tail = next((i for i in range(short - head) if a[-1 - i] != b[-1 - i]), short - head)
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    out = [(head + i, head + j, 1) for i, j in _pairs(x, y)] if x and y and not set(x).isdisjoint(y) else []
    return [r for r in [(0, 0, head), *out, (len(a) - tail, len(b) - tail, tail)] if r[2]]


def _pairs(x: list, y: list) -> list[tuple[int, int]]:
    rows = [list(range(len(y) + 1))]
    for i, u in enumerate(x, 1):
        last, row = rows[-1], [i]
        for j, v in enumerate(y, 1):
            row.append(last[j - 1] if u == v else 1 + min(last[j - 1], last[j], row[j - 1]))
        rows.append(row)
    i, j, out = len(x), len(y), []
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i][j] == 1 + rows[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif rows[i][j] == 1 + rows[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def aligned(a: list, b: list, places: list[int], others: list[int]) -> list[tuple[int, int, int]] | None:
    """The runs of equal words (places in a and b, length) that a chain gives; None if its seeds aren't there.

    a and b are words, and places and others places in them. Both ends are extended; see extended().
    """
    for p, o in zip(places, others, strict=True):
        if o < 0 or len(a) < p + K or a[p : p + K] != b[o : o + K]:
            return None
    a0, b0 = places[0], others[0]
    a1, b1 = a0, b0
    left = extended(a[max(0, a0 - MARGIN) : a0][::-1], b[max(0, b0 - MARGIN) : b0][::-1])
    found = [(a0 - i - n, b0 - j - n, n) for i, j, n in reversed(left)]
    for p, o in zip(places, others, strict=True):
        if p > a1 and o > b1:
            x, y = a[a1:p], b[b1:o]
            found += [(a1, b1, len(x))] if x == y else [(a1 + i, b1 + j, n) for i, j, n in between(x, y)]
        inside = max(0, a1 - p, b1 - o)  # seeds may overlap
        found.append((p + inside, o + inside, K - inside))
        a1, b1 = p + K, o + K
    found += [(a1 + i, b1 + j, n) for i, j, n in extended(a[a1 : a1 + MARGIN], b[b1 : b1 + MARGIN])]
    runs: list[tuple[int, int, int]] = []
    for i, j, n in found:
        if runs and n > 0 and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1] = (*runs[-1][:2], runs[-1][2] + n)
        elif n > 0:
            runs.append((i, j, n))
    return runs


#: Part of an alignment: words [a0, a1) of one side, [b0, b1) of the other, and the edits.
Part = tuple[int, int, int, int, int]


def joined(x: Part, y: Part) -> Part:
    return x[0], y[1], x[2], y[3], x[4] + y[4] + gap(x, y)


def gap(x: Part, y: Part) -> int:
    return max(y[0] - x[1], y[2] - x[3])


def alike(x: Part) -> int:
    """Equal words, counted on the longer side."""
    return max(x[1] - x[0], x[3] - x[2]) - x[4]


def passes(x: Part) -> bool:
    return min(x[1] - x[0], x[3] - x[2]) >= LEAST_WORDS and alike(x) >= ALIKE * max(x[1] - x[0], x[3] - x[2])


def longest(parts: list[Part]) -> list[tuple[Part, bool]]:
    """Parts in order, from each that no passage holds yet the longest row of neighbours that is a passage together, or itself; and which."""
    if not parts or min(parts[-1][1] - parts[0][0], parts[-1][3] - parts[0][2]) < LEAST_WORDS:
        return [(part, False) for part in parts]
    a0, a1, b0, b1, own = np.array(parts).T
    edits = np.cumsum(own + np.array([0, *map(gap, parts, parts[1:])]))
    ends = np.maximum(a1 - a0, b1 - b0) - own >= LOOK
    out, i = [], 0
    while i < len(parts):
        a, b = a1[i:] - a0[i], b1[i:] - b0[i]
        longer, e = np.maximum(a, b), edits[i:] - edits[i] + own[i]
        good = np.flatnonzero((np.minimum(a, b) >= LEAST_WORDS) & (longer - e >= ALIKE * longer) & ends[i:]) if ends[i] else ()
        if len(good):
            j = i + int(good[-1])
            out.append(((int(a0[i]), int(a1[j]), int(b0[i]), int(b1[j]), int(e[good[-1]])), True))
            i = j + 1
        else:
            out.append((parts[i], False))
            i += 1
    return out


def parted(runs: list[tuple[int, int, int]]) -> list[Part]:
    """The passages of an alignment. It is cut at gaps of more than POOR words, and what is a passage by itself stays apart from the next.

    What is none by itself is joined over such gaps if that makes a passage, or to a neighbour that is one if it brings more
    equal words than ALIKE asks for the gap's edits. Ends of fewer than LOOK words behind an edit are left out.
    """
    rows: list[list[Part]] = []
    for i, j, n in runs:
        part = (i, i + n, j, j + n, 0)
        if rows and gap(rows[-1][-1], part) <= POOR:
            rows[-1].append(part)
        else:
            rows.append([part])
    parts: list[tuple[Part, bool]] = []
    for row in rows:
        while len(row) > 1 and alike(row[0]) < LOOK:
            del row[0]
        while len(row) > 1 and alike(row[-1]) < LOOK:
            del row[-1]
        whole = row[0]
        for part in row[1:]:
            whole = joined(whole, part)
        parts += [(whole, True)] if passes(whole) else longest(row)
    groups: list[tuple[Part, bool]] = []
    waiting: list[Part] = []
    for part, good in [*parts, ((0, 0, 0, 0, 0), True)]:
        if good:
            groups += [*longest(waiting), (part, True)]
            waiting = []
        else:
            waiting.append(part)
    del groups[-1]
    out: list[tuple[Part, bool]] = []
    for part, good in groups:  # a good one takes those before it, and those after it join it
        while out and (good and not out[-1][1] and _gains(out[-1][0], part, out[-1][0])):
            part = joined(out.pop()[0], part)
        if out and not good and out[-1][1] and _gains(out[-1][0], part, part):
            out[-1] = (joined(out[-1][0], part), True)
        else:
            out.append((part, good))
    return [part for part, good in out if good]


def _gains(x: Part, y: Part, new: Part) -> bool:
    return (1 - ALIKE) * alike(new) > ALIKE * (new[4] + gap(x, y)) and passes(joined(x, y))


def connected(alignments: list[tuple[int, list[tuple[int, int, int]]]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Alignments (source, runs), those of one source that run into each other taken together."""
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    for source, runs in sorted(alignments):
        if out and out[-1][0] == source:
            own = out[-1][1]
            a1, b1 = own[-1][0] + own[-1][2], own[-1][1] + own[-1][2]
            after = [(i + k, j + k, n - k) for i, j, n in runs for k in [max(0, a1 - i, b1 - j)] if k < n]
            i, j, _ = runs[0]
            within = runs[-1][0] + runs[-1][2] <= a1 and runs[-1][1] + runs[-1][2] <= b1
            if i <= a1 and own[0][1] <= j <= b1 and (abs(after[0][0] - a1 - after[0][1] + b1) <= POOR if after else within):
                own += after
                continue
        out.append((source, list(runs)))
    return out


def long_enough(runs: list[tuple[int, int, int]]) -> bool:
    """Whether an alignment has a passage's words from end to end."""
    (a0, b0, _), (a1, b1, n) = runs[0], runs[-1]
    return min(a1 - a0, b1 - b0) + n >= LEAST_WORDS


@without_gc
def passages_of(text: str, chains: list[dict], chunks: list[dict]) -> list[dict]:
    """Of a document's chains the passages: characters, words and edits on its side, and the other's words; chunks: the pieces of the others' words around the chains."""
    own = words(text)
    unzip = zstandard.ZstdDecompressor()
    pieces = {(c["source"], c["chunk"]): unzip.decompress(c["words"]).split(b" ") for c in chunks}
    alignments = []
    for c in chains:
        low, high = max(0, c["others"][0] - MARGIN), c["others"][-1] + K + MARGIN
        shift = low // CHUNK * CHUNK
        other: list[bytes] = []
        for k in range(low // CHUNK, high // CHUNK + 1):
            other += pieces.get((c["source"], k), ())
        other = other[low - shift : high - shift]
        runs = aligned(own, other, c["places"], [o - low for o in c["others"]]) or []
        if runs:
            alignments.append((c["source"], [(i, j + low, n) for i, j, n in runs]))
    found = {(source, a0, -a1, b0, b1, edits) for source, runs in connected(alignments) if long_enough(runs) for a0, a1, b0, b1, edits in parted(runs)}
    if not found:
        return []
    spans = list(map(re.Match.span, _WORD.finditer(text)))
    kept: list[tuple[int, ...]] = []  # of each source as few as cover what all of them cover: a line again and again gives very many
    for x in sorted(found):
        own = [y for y in kept[-2:] if y[0] == x[0]]
        if own and -x[2] <= -own[-1][2]:
            continue
        if len(own) == 2 and x[1] <= -own[0][2]:
            kept.pop()
        kept.append(x)
    out = [{"start": spans[a0][0], "end": spans[-a1 - 1][1], "n_words": -a1 - a0, "edits": edits, "source_id": key, "source_word": b0, "source_words": b1 - b0} for key, a0, a1, b0, b1, edits in kept]
    # of passages that lie within another the holder of the longer one has a row of its own, which leads on to the same source
    rows, end = [], -1
    for x in sorted(out, key=lambda x: (x["start"], -x["end"], x["edits"], x["source_id"], x["source_word"])):
        if x["end"] > end:
            rows.append(x)
            end = x["end"]
    return rows


#: Text whose keys a task packs at once, text to each shard of the keys, and text whose words a task holds.
PACKED, SHARD, SLICE = 8 << 20, 8 << 20, 2 << 20
#: A key that a slice holds more often than this travels once for all of them in its block, and its places apart.
HOT = 8
_FLAG = np.uint32(1 << 31)


def pack(key: np.ndarray, id_: np.ndarray, place: np.ndarray, on: np.ndarray) -> bytes:
    """Rows sorted by key; differences and small numbers are laid out byte by byte, so that their high bytes vanish."""
    ids, number = np.unique(id_, return_inverse=True)
    steps = np.diff(key, prepend=np.uint64(0))
    columns = [(steps, 8), (number.astype("<u4"), 4), (place.astype("<u4"), 4), (on.astype("<u4"), 4), (np.diff(ids, prepend=0).view(np.uint64), 8)]
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), width).T).tobytes() for c, width in columns]
    return np.array([len(key), len(ids)], "<u8").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(block: bytes) -> list[np.ndarray]:
    n, m = np.frombuffer(block[:16], "<u8").tolist()
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[16:], max_output_size=20 * n + 8 * m), np.uint8)
    out, at = [], 0
    for size, width in ((n, 8), (n, 4), (n, 4), (n, 4), (m, 8)):
        out.append(np.ascontiguousarray(raw[at : at + size * width].reshape(width, size).T).view(f"<u{width}").ravel())
        at += size * width
    return [np.cumsum(out[0], dtype=np.uint64), np.cumsum(out[4], dtype=np.uint64).view(np.int64)[out[1]], out[2], out[3]]


def dealt(shards: int, key: np.ndarray, id_: np.ndarray, place: np.ndarray, on: np.ndarray) -> pa.RecordBatch:
    """A block for each shard; a hot key has its first row in its shard's block, flagged, and all others in block -1."""
    order = np.lexsort((place, id_, key))
    key, id_, place, on = key[order], id_[order], place[order].astype(np.uint32), on[order].astype(np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(key)))
    hot = np.repeat(count > HOT, count)
    lead = np.zeros(len(key), bool)
    lead[starts] = True
    place = np.where(hot & lead, place | _FLAG, place)
    apart = hot & ~lead
    shard = np.where(apart, -1, ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64))
    order = np.argsort(shard, kind="stable")  # the key's high bits deal it, so rows stay sorted within each
    names, starts = np.unique(shard[order], return_index=True)
    parts = np.split(order, starts[1:]) if len(order) else []
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([pack(key[p], id_[p], place[p], on[p]) for p in parts], pa.binary())], names=["shard", "block"])


MATCHES = "id long, source long, place int, other int, on int"


def meetings(blocks: DataFrame, shards: int) -> tuple[DataFrame, list[str]]:
    """blocks: shard, block, as dealt() makes them. A row for each place of a key that stands at several: id, place, and the key's first holder, source, with its place, other; and on.

    A shard's size follows from the text to a shard, but for hot keys: of each, a slice has one row in a shard. Their other
    rows are joined to the hot keys' first holders row by row, a join of two written tables that can be split where it is hot.
    Also the folders that the rows are read from.
    """
    blocks, one = saved_at(blocks, "blocks")

    def meet(key, table):
        parts = [unpack(b) for b in table["block"].to_pylist()]
        key, id_, place, on = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        several = np.zeros(len(key), bool)
        several[order[1:][same]] = several[order[:-1][same]] = True
        own = np.flatnonzero(several | (place >= _FLAG))
        hot, place = place >= _FLAG, place & ~_FLAG
        own = own[np.lexsort((place[own], id_[own], key[own]))]
        key, id_, place, on, hot = key[own], id_[own], place[own], on[own], hot[own]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        source, other = id_[starts], place[starts]
        named = np.unique(group[hot])
        rows = [(id_, source[group], place, other[group], on, np.zeros(len(id_), np.int64)), (key[starts[named]].view(np.int64), source[named], other[named], other[named], on[starts[named]], np.ones(len(named), np.int64))]
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.int32()] * 4), strict=True)], names=["id", "source", "place", "other", "on", "hot"])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block").to_pylist():
                key, id_, place, on = unpack(block)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(id_), pa.array(place, pa.int32()), pa.array(on, pa.int32())], names=["key", "id", "place", "on"])

    met, two = saved_at(blocks.where("shard >= 0").repartition(shards, "shard").groupBy("shard").applyInArrow(meet, f"{MATCHES}, hot int"), "met")
    firsts = met.where("hot = 1").select(F.col("id").alias("key"), "source", "other")
    hot = blocks.where("shard < 0").select("block").mapInArrow(apart, "key long, id long, place int, on int").join(firsts, "key")
    return met.where("hot = 0").drop("hot").unionByName(hot.select("id", "source", "place", "other", "on")), [one, two]


def chains(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document with chains: id, chains (arrays of source and places on both sides), chunks (the sources' words around them, in pieces)."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in sliced(batches, "text", SLICE):
            owner, seed, place = seeds_of(batch.column("text").to_pylist())
            held.append((seed, batch.column("id").to_numpy()[owner], place))
            n += batch.column("text").nbytes
            if n >= PACKED:
                yield _dealt(held)
                held, n = [], 0
        if held:
            yield _dealt(held)

    def _dealt(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, id_, place = (np.concatenate(c) for c in zip(*held, strict=True))
        return dealt(shards, key, id_, place, np.zeros(len(key), np.int64))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows come sorted by id; a document's rows may be cut by the end of a batch."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            last = int(np.searchsorted(ids, ids[-1]))
            if last or held and held[-1].column("id")[-1].as_py() != ids[0]:
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for table in whole(batches):
            own, source, place, other = (table[c].to_numpy() for c in ("id", "source", "place", "other"))
            key, first, last = runs_of(own, source, place, other)
            held.append((key, own[first], place[first], place[last] - place[first]))
            n += len(key)
            if n >= PACKED // 16:
                yield dealt(shards, *(np.concatenate(c) for c in zip(*held, strict=True)))
                held, n = [], 0
        if held:
            yield dealt(shards, *(np.concatenate(c) for c in zip(*held, strict=True)))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            yield from chained(table)

    def chained(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, sources, place, other = (table[c].to_numpy() for c in ("id", "source", "place", "other"))
        new = np.ones(len(ids), bool)  # a match may come by its seed and by runs
        new[1:] = (ids[1:] != ids[:-1]) | (sources[1:] != sources[:-1]) | (place[1:] != place[:-1]) | (other[1:] != other[:-1])
        ids, sources, place, other = ids[new], sources[new], place[new], other[new]
        cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (sources[1:] != sources[:-1]), [True]]))
        out: list[tuple] = []
        for i, j in zip(cuts[:-1][np.diff(cuts) > 1].tolist(), cuts[1:][np.diff(cuts) > 1].tolist(), strict=True):
            for places, others in chains_of(place[i:j], other[i:j]):
                out.append((int(ids[i]), int(sources[i]), places, others))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], names=["id", "source", "places", "others"]
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, "text", SLICE):
            ids, number, out = [], [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = words(text)
                for k in range(0, len(own), CHUNK):
                    ids.append(i)
                    number.append(k // CHUNK)
                    out.append(zip_.compress(b" ".join(own[k : k + CHUNK])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(out, pa.binary())], names=["source", "chunk", "words"])

    spark = docs.sparkSession
    matches, read = meetings(rows.mapInArrow(find, "shard int, block binary"), shards)
    matches, path = saved_at(matches.drop("on"), "matches")
    discard(spark, *read)
    longer, read = meetings(matches.repartition(shards, "id").sortWithinPartitions("id", "place").mapInArrow(run, "shard int, block binary"), shards)
    longer = longer.select("id", "source", F.explode(F.array(F.lit(0), "on")).alias("more"), "place", "other")
    longer = longer.select("id", "source", (F.col("place") + F.col("more")).alias("place"), (F.col("other") + F.col("more")).alias("other"))
    matches = matches.unionByName(longer).where("id <> source or place <> other")
    found = matches.repartition(shards, "id").sortWithinPartitions("id", "source", "place", "other").mapInArrow(chain, "id long, source long, places array<int>, others array<int>")
    found = saved_at(found, "chains")[0]
    discard(spark, path, *read)
    low, high = F.greatest(F.lit(0), F.get("others", F.lit(0)) - MARGIN), F.element_at("others", -1) + K + MARGIN
    wanted = found.select("id", "source", F.explode(F.sequence(F.floor(low / CHUNK).cast("int"), F.floor(high / CHUNK).cast("int"))).alias("chunk")).distinct()
    pieces = rows.mapInArrow(cut, "source long, chunk int, words binary")
    sent = wanted.join(pieces, ["source", "chunk"]).groupBy("id").agg(F.collect_list(F.struct("source", "chunk", "words")).alias("chunks"))
    return found.groupBy("id").agg(F.collect_list(F.struct("source", "places", "others")).alias("chains")).join(sent, "id")


def compressed(rows: DataFrame) -> DataFrame:
    """id, zipped: texts as they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([z.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["id", "zipped"])

    return rows.mapInArrow(run, "id long, zipped binary")


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each passage of a document that another document (or an earlier place of its own) has first.

    Columns: id, start and end (characters of the text), n_words, edits, source_id (whose the passage is, the smallest id
    that has its seeds or a run of them; of several for the same words the most alike), source_word and source_words (where, in words). The first holder has no row. Words
    are compared with A-Z in lower case. Null or empty texts, and rows without an id, hold and share nothing. Rows with
    one id are read as one document, and each gives those passages that its own text holds. Other columns are no matter.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id is not null and text is not null")
    joined = compressed(rows).join(chains(docs, id_col, text_col), "id")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        names = ["start", "end", "n_words", "edits", "source_id", "source_word", "source_words"]
        for batch in batches:
            ids, out = [], []
            for i, zipped, own, chunks in zip(batch.column("id").to_pylist(), *(batch.column(c) for c in ("zipped", "chains", "chunks")), strict=True):
                found = passages_of(unzip.decompress(zipped.as_py()).decode(), own.as_py(), chunks.as_py())
                ids += [i] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([x[n] for x in out], pa.int64()) for n in names)], names=[id_col, *names])

    return joined.mapInArrow(align, f"`{id_col}` long, start long, end long, n_words long, edits long, source_id long, source_word long, source_words long")


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """docs with their own columns, each shared passage cut from all texts but that of its first holder; see shared_passages().

    A text that was one passage becomes empty; rows stay. Where a column n_chars_col exists it is the new text's length.
    """
    own = docs.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)))
    name = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    text, key = name[text_col], F.col(name[id_col]).cast("long")
    joined = own.join(chains(docs, id_col, text_col), key == F.col("id"), "left").drop("id")
    kept = [f for f in own.schema.fields]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            texts = batch.column(text).to_pylist()
            for i, (own_chains, chunks) in enumerate(zip(batch.column("chains"), batch.column("chunks"), strict=True)):
                if own_chains.is_valid and texts[i]:
                    texts[i] = spared(texts[i], passages_of(texts[i], own_chains.as_py(), chunks.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if f.name == text else batch.column(f.name) for f in kept], names=[f.name for f in kept])

    out = joined.mapInArrow(cut, columns)
    if n_chars_col in name:
        out = out.withColumn(name[n_chars_col], F.when(F.col(text).isNotNull(), F.char_length(text)).cast(docs.schema[n_chars_col].dataType))
    return out.select(*(F.col(name[c]).alias(c) for c in docs.columns))


def spared(text: str, found: list[dict]) -> str:
    """The text without the passages, and without the white space after each."""
    parts, at = [], 0
    for x in found:
        if x["end"] > at:
            parts.append(text[at : max(at, x["start"])])
            at = x["end"]
            while at < len(text) and text[at] in " \t\n\v\f\r":
                at += 1
    return "".join([*parts, text[at:]])
