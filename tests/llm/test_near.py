"""Near-duplicates against all pairs: fingerprints, vectors, components."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lexloom import session
from lexloom.llm import components, simhash, vector_forest

from .frames import ODD, documents


def roots(ids, links):
    part = {i: i for i in ids}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        part[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 50)]
    loose = [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in path + star + loose] + [(7, 7), (7, 8), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    expected = roots({x for e in real for x in e}, real)
    assert got == expected
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            words, word = words + [word] if word else words, ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("rows", [[], ODD])
def test_simhash_odd(spark, rows):
    got = simhash.simhash_groups(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.fingerprint) for r in got), key=repr) == sorted([(i, f"{fingerprint(t if len(t or '') < 90_000 else 'word word word'):016x}") for i, t in rows], key=repr)
    by = {r.fingerprint: r.component_id for r in got}
    if rows:
        assert by["0" * 16] == 0
    assert simhash.keep_one(documents(spark, rows)).columns == documents(spark, rows).columns


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_all_near_fingerprints_meet(spark, segments):
    rng = random.Random(segments)
    fps = {rng.getrandbits(64) for _ in range(30)} | {0, (1 << 64) - 1}
    for f in list(fps):
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, segments).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def vectors():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((150, 16))
    near = x[:40] + 0.15 * rng.standard_normal((40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near, x[:5], 3 * x[5:8]]))]
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 0.0]]
    return rows + [(1000 + i, v) for i, v in enumerate(odd)] + [(None, x[0].tolist()), (3, x[3].tolist())]


@pytest.mark.parametrize(("leaf", "block"), [(256, 2048), (8, 2048), (256, 16)])
def test_vectors_against_all_pairs(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(vector_forest, "BLOCK_ROWS", block)
    rows = vectors()
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, label int, key string, links long")
    got = vector_forest.near_vectors(frame, leaf_rows=leaf, trees=20).collect()
    good = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in good}
    links = [(a, b) for a in good for b in good if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    part = roots(range(len(rows)), links)
    smallest = {p: min((rows[k][0] for k in part if part[k] == p and rows[k][0] is not None), default=None) for p in set(part.values())}
    expected = sorted(((i, sum(a == k for a, _ in links), smallest[part[k]]) for k, (i, _) in enumerate(rows)), key=repr)
    found = sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr)
    assert [f[0] for f in found] == [e[0] for e in expected] and all(f[1] <= e[1] for f, e in zip(found, expected, strict=True))
    assert sum(f[1] for f in found) >= 0.9 * sum(e[1] for e in expected)
    if leaf == 256:
        assert found == expected  # one leaf, or its blocks: nothing can be missed
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_no_vectors(spark):
    assert vector_forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert vector_forest.near_vectors(spark.createDataFrame([(1, None), (2, None)], "vec_id long, embedding array<float>")).where("n_links = 0 and kept").count() == 2


def test_recall_on_the_synthetic_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.toPandas()
    x = np.stack(rows.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    expected = ((x @ x.T >= 0.95).sum(axis=1) - 1).sum()
    got = vector_forest.near_vectors(frame).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * expected <= got <= expected


def clustered(n, mean, k, rng, width=64):
    """Unit vectors around k centres; two of one centre have this cosine as a rule."""
    centre = rng.standard_normal((k, width))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = np.sqrt(mean) * centre[rng.integers(0, k, n)] + np.sqrt((1 - mean) / width) * rng.standard_normal((n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def beside(x, cosine, rng):
    r = rng.standard_normal(x.shape)
    r -= (r * x).sum(axis=1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * r / np.linalg.norm(r, axis=1, keepdims=True)


@pytest.mark.parametrize(("n", "mean", "k"), [(60_000, 0.0, 1), (60_000, 0.8, 1), (60_000, 0.9, 1), (200_000, 0.85, 1), (200_000, 0.9, 1), (100_000, 0.8, 50), (200_000, 0.9, 50)])
def test_recall_of_leaves(n, mean, k):
    """Of 1500 planted pairs at cosine 0.951, at the default settings, so many meet in a leaf."""
    rng = np.random.default_rng(1)
    x = clustered(n, mean, k, rng)
    forest = vector_forest.grow(x[rng.permutation(n)[:32_768]], n, 0.95, vector_forest.TREES, vector_forest.LEAF_ROWS, np.random.default_rng(7))
    one, two = ([set() for _ in range(1500)] for _ in range(2))
    for sets, rows in ((one, x[:1500]), (two, beside(x[:1500], 0.951, rng))):
        for r, leaf in zip(*forest.find(rows), strict=True):
            sets[r].add(leaf)
    assert sum(bool(a & b) for a, b in zip(one, two, strict=True)) >= 0.98 * 1500


@pytest.mark.parametrize(("mean", "k"), [(0.8, 1), (0.9, 1), (0.9, 30)])
def test_clusters_against_all_pairs(spark, mean, k):
    rng = np.random.default_rng(2)
    x = clustered(16_000, mean, k, rng)
    x[15_000:] = beside(x[:1000], 0.951, rng)
    expected = sum(int((x[i : i + 2000] @ x.T >= 0.95).sum()) for i in range(0, len(x), 2000)) - len(x)
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))}))
    got = vector_forest.near_vectors(frame).agg({"n_links": "sum"}).first()[0]
    assert 0.98 * expected <= got <= expected


def near_texts(rng):
    """Texts with copies, and with one to twelve words changed, in some chains."""
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    texts = []
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120, 300, 700]))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 5)):
            words = list(words) if rng.random() < 0.5 else texts[-1].split()
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return [*enumerate(texts), (900, None), (901, ""), (902, " \n")]


def test_simhash_groups_against_all_pairs(spark):
    rows = near_texts(random.Random(31))
    fps = {i: fingerprint(t) for i, t in rows}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert sum(fps[a] != fps[b] for a, b in links) > 10
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(documents(spark, rows)).collect()}
    assert got == {i: (f"{fps[i]:016x}", part) for i, part in roots(fps, links).items()}


def test_similar_documents_against_all_pairs(spark):
    rows = near_texts(random.Random(32))
    sets = {}
    for i, t in rows:
        words = (t or "").lower().split()
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    links = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    assert sum(sets[a] != sets[b] for a, b in links) > 30
    part = roots(sets, links)
    docs = documents(spark, [*rows, (None, "no id"), (None, "no id"), (0, rows[0][1])])
    kept = simhash.keep_dissimilar(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    expected = {i for i in sets if part[i] == i}
    assert got.count(None) == 2 and got.count(0) == 2 * (0 in expected)
    assert set(got) - {None} >= expected and len(set(got) - {None} - expected) <= 0.03 * (len(sets) - len(expected))
    assert simhash.keep_dissimilar(documents(spark, [])).count() == 0 and simhash.keep_dissimilar(documents(spark, ODD)).count() >= 6


def edited_chains(rng):
    """Texts each of which has some words of the one before replaced, so that many are just at a likeness of 0.8."""
    texts = []
    for k in range(60):
        words = [f"w{k}x{i}" for i in range(rng.choice([12, 30, 80, 200]))]
        for _ in range(14):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 45))):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
    rng.shuffle(texts)
    return [*enumerate(texts)]


def test_no_similar_document_is_missed(spark, monkeypatch):
    rows = edited_chains(random.Random(33))
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    part = roots(sets, links)
    docs = documents(spark, rows)
    assert sorted(r.doc_id for r in simhash.keep_dissimilar(docs).collect()) == [i for i in sorted(sets) if part[i] == i]
    plain = docs.selectExpr("doc_id as id", "text")
    alone = simhash.missed_pairs(plain, plain.selectExpr("id", "id as kept"), 0.8, 5)  # nothing is grouped yet
    assert sorted((min(r), max(r)) for r in alone.collect()) == links
    monkeypatch.setattr(simhash, "COUNTED", 1000)  # another order of the shingles
    alone = simhash.missed_pairs(plain, plain.selectExpr("id", "id as kept"), 0.8, 5)
    assert sorted((min(r), max(r)) for r in alone.collect()) == links


def test_words_of_a_slice_are_not_held_one_by_one():
    texts = [" ".join(f"w{(i * i + j * 7) % 900}" for j in range(400)) for i in range(400)]
    simhash.shingle_sets(texts[:10], 5)
    tracemalloc.start()
    owner, run = simhash.shingle_sets(texts, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 19 * sum(map(len, texts))
    assert len(owner) == len(run) > 0
    assert [len(x) for x in simhash.shingle_sets([], 5)] == [len(x) for x in simhash.shingle_sets([None, " "], 5)] == [0, 0]


def test_bits_of_sets_are_few_and_bound_their_difference():
    rng = np.random.default_rng(4)
    new = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    for n in [0, 1, 64, 65, 300, 900, *rng.integers(1, 2000, 300)]:
        one = new(n)
        two = np.concatenate([one[: rng.integers(0, n + 1)], new(rng.integers(0, n + 1))])
        x, y = sorted(map(simhash.bits_of, (one, two)), key=len)
        assert max(1, n) <= 64 * max(len(x), len(y)) or len(two) > n
        assert 8 * len(simhash.bits_of(one)) <= max(8, n / 4)  # 64 bytes for 300 shingles
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert int(np.unpackbits((x ^ y).view(np.uint8)).sum()) <= len(np.setxor1d(one, two))
    for n in (65, 128, 300, 900):  # strangers are beyond what sets of a likeness of 0.8 may differ in
        assert int(np.unpackbits((simhash.bits_of(new(n)) ^ simhash.bits_of(new(n))).view(np.uint8)).sum()) > 0.2 / 1.8 * 2 * n


def test_executors_give_memory_back(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    before = sum(b.getCollectionCount() for b in beans())
    session.relieve(spark)
    assert sum(b.getCollectionCount() for b in beans()) > before
