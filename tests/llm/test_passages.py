"""Shared passages and test items, planted and looked for."""

import random

import numpy as np
import pytest

from lexloom.llm import decontaminate, passages

from .frames import ODD, documents


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_planted_passages(spark):
    rng = random.Random(1)
    shared = prose(rng, 60)
    edited = shared.split()
    for k in (15, 30, 31, 45):
        edited[k] = "zzz"
    del edited[50]
    texts = [(1, f"{prose(rng, 80)} {shared} {prose(rng, 20)}"), (2, f"{prose(rng, 30)}\n{shared.upper()}\n{prose(rng, 30)}"), (3, f"{prose(rng, 5)} {' '.join(edited)} {prose(rng, 90)}"), (4, prose(rng, 300)), (5, f"{shared} tail"), (6, f"{prose(rng, 100)} {' '.join(shared.split()[:20])}")]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in passages.shared_passages(docs).collect()}
    assert set(got) == {2, 3, 5}
    for i, n in ((2, 60), (3, 59), (5, 60)):
        own = dict(texts)[i][got[i].start : got[i].end].split()
        assert abs(len(own) - n) <= 2 and got[i].source_id == 1 and got[i].n_words == len(own)
    assert got[2].edits == got[5].edits == 0 and 4 <= got[3].edits <= 6
    kept = {r.doc_id: r for r in passages.without_passages(docs).collect()}
    assert all(kept[i].text == t for i, t in texts if i in (1, 4, 6))
    assert all(shared.split()[25] not in kept[i].text.lower() for i in (2, 3, 5)) and kept[5].text == "tail"
    assert all(r.n_chars == len(r.text) for r in kept.values())


def test_unshared_words_between_passages(spark):
    """Parts that are passages by themselves are found, and what stands between them on one side or both stays."""
    rng = random.Random(6)
    cases = [(50, 26, 26), (40, 22, 22), (50, 30, 30), (60, 25, 0), (60, 0, 25), (45, 47, 47)]
    texts, own = [], {}
    for i, (n, mine, theirs) in enumerate(cases):
        for k in range(10):
            x, y, d = prose(rng, n), prose(rng, n), 1000 + 10 * i + k
            own[d] = prose(rng, mine)
            texts += [(10 * i + k, f"{prose(rng, 20)} {x} {prose(rng, theirs)} {y}"), (d, f"{x} {own[d]} {y} {prose(rng, 9)} end")]
    docs = documents(spark, texts)
    got = passages.shared_passages(docs).collect()
    for i, (n, _, _) in enumerate(cases):
        for k in range(10):
            found = sorted((r.start, r.n_words, r.source_id) for r in got if r.doc_id == 1000 + 10 * i + k)
            # a chain needs two seeds, and 40 words hold two but where they stand badly
            assert [(x[1], x[2]) for x in found] == [(n, 10 * i + k)] * 2, cases[i]
    kept = {r.doc_id: r.text for r in passages.without_passages(docs).collect()}
    assert all(kept[d].startswith(words) and len(kept[d].split()) == len(words.split()) + 10 for d, words in own.items())
    # an edited middle doesn't split what is no passage in two
    x, y = prose(rng, 39), prose(rng, 39)
    one = passages.shared_passages(documents(spark, [(1, f"{x} {prose(rng, 10)} {y}"), (2, f"{x} {prose(rng, 10)} {y}")])).collect()
    assert [(r.n_words, r.edits) for r in one] == [(88, 10)]


@pytest.mark.parametrize("n, every, least", [(60, 5, 50), (100, 5, 70), (60, 6, 85), (60, 8, 97), (60, 10, 99), (100, 15, 99)])
def test_evenly_edited_passages(spark, n, every, least):
    """Of 100 planted passages with every so manyth word replaced, so many are found."""
    rng = random.Random(7)
    texts = []
    for d in range(100):
        shared = prose(rng, n).split()
        at = rng.randrange(every)
        edited = ["zz" + w if i % every == at else w for i, w in enumerate(shared)]
        texts += [(d, f"{prose(rng, 30)} {' '.join(shared)} {prose(rng, 30)}"), (1000 + d, f"{prose(rng, 20)} {' '.join(edited)} {prose(rng, 40)}")]
    got = passages.shared_passages(documents(spark, texts)).collect()
    assert all(r.source_id == r.doc_id - 1000 and r.n_words <= n + 4 and r.edits <= 0.2 * (n + 4) for r in got)
    assert len({r.doc_id for r in got}) == len(got) >= least


def test_parts_with_earlier_holders(spark):
    """A passage is found though no earlier document is the first to hold two of its parts."""
    rng = random.Random(8)
    texts, expected = [], {}
    for d in range(0, 400, 10):
        size = rng.choice([14, 20, 30])
        parts = [prose(rng, size) for _ in range(60 // size + (size == 14))]
        texts += [(d + i, f"{prose(rng, 20)} {x} {prose(rng, 20)}") for i, x in enumerate(parts)]
        texts += [(d + 1000 + k, f"{prose(rng, 15)} {' '.join(parts)} {prose(rng, 15)}") for k in range(3)]
        expected |= {d + 1000 + k: (size * len(parts), d + 1000) for k in (1, 2)}
    got = passages.shared_passages(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_words, r.source_id) for r in got} == expected and len(got) == len(expected)


def test_copies_and_repeats(spark):
    rng = random.Random(2)
    text, line = prose(rng, 120), prose(rng, 45)
    got = passages.shared_passages(documents(spark, [(9, text), (4, text), (7, text), (1, f"{line} {prose(rng, 70)} {line} {prose(rng, 3)}"), (2, "same " * 300), (3, "same " * 300)])).collect()
    whole = {r.doc_id: (r.start, r.end, r.source_id) for r in got if r.doc_id in (4, 7, 9)}
    assert whole == {7: (0, len(text), 4), 9: (0, len(text), 4)}
    own = [r for r in got if r.doc_id == 1]
    assert len(own) == 1 and own[0].source_id == 1 and own[0].n_words == 45
    assert [r.source_id for r in got if r.doc_id == 3] == [2]


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_documents(spark, rows):
    docs = documents(spark, rows)
    assert passages.shared_passages(docs).columns[0] == "doc_id" and passages.shared_passages(docs).count() >= 0
    kept = passages.without_passages(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    items = spark.createDataFrame([(1, "one"), (2, None), (None, "no id here"), (3, " ")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()) == [(3, 1), (3, 1)][: 2 * bool(rows)]
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and clean.count() == len([r for r in rows if r[0] != 3])
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == len(rows)


def test_chains_like_all_orders():
    rng = random.Random(3)
    import numpy as np

    for _ in range(200):
        n = rng.randint(1, 9)
        p, o = np.array([rng.randint(0, 30) for _ in range(n)]), np.array([rng.randint(0, 30) for _ in range(n)])
        found = passages.chains_of(p, o)
        assert all(all(a < b for a, b in zip(x, x[1:], strict=False)) for c in found for x in c)
        best = {}
        for i in sorted(range(n), key=lambda i: (p[i], -o[i])):
            before = [best[j] - passages.GAP_COST * (p[i] - p[j] + o[i] - o[j]) for j in best if p[j] < p[i] and o[j] < o[i]]
            best[i] = passages.K + max([0, *before])
        if found and max(best.values()) > passages.K:
            score = lambda c: passages.K * len(c[0]) - passages.GAP_COST * (c[0][-1] - c[0][0] + c[1][-1] - c[1][0])
            assert max(map(score, found)) == pytest.approx(max(best.values()))


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_distances():
    rng = random.Random(4)
    for _ in range(500):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (12, 25))
        assert decontaminate.myers(decontaminate.masks(p), len(p), t)[0] == edits(p, t)
        full = list(range(len(t) + 1))
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(full[j - 1] + (a != b), full[j] + 1, new[j - 1] + 1))
            full = new
        assert passages.distance(list(p), list(t)) == full[-1]


def test_planted_items_against_all_places(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 3)  # several passes
    rng = random.Random(5)
    items = [(i, prose(rng, 25)) for i in range(10)]
    rows, expected = [], set()
    for d in range(60):
        i = rng.randrange(10)
        text, k = list(items[i][1]), rng.choice([0, 3, decontaminate.budget(len(items[i][1]), 0.05), 25])
        for _ in range(k):
            at = rng.randrange(len(text))
            text[at] = rng.choice("xyz")
        whole = f"{prose(rng, 20)} {''.join(text).upper() if k == 0 else ''.join(text)}\n {prose(rng, 20)}"
        rows.append((d, whole))
        normal = decontaminate.normal(whole)
        expected |= {(d, j) for j, t in items if edits(t, normal) <= decontaminate.budget(len(t), 0.05)} if d < 12 else set()
    frame = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = decontaminate.contaminated(documents(spark, rows), frame).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id < 12} == expected
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    for r in got:
        assert edits(dict(items)[r.item_id], decontaminate.normal(rows[r.doc_id][1])[r.start : r.end]) == r.edits


def test_thirds_with_earlier_holders(spark):
    rng = random.Random(11)
    parts = [prose(rng, 32 if i < 2 else 26) for i in range(3)]
    texts = [(i + 1, f"{prose(rng, 20)} {x} {prose(rng, 20)}") for i, x in enumerate(parts)] + [(d, f"{prose(rng, 15)} {' '.join(parts)} {prose(rng, 15)}") for d in (5, 9, 11)]
    got = sorted((r.doc_id, r.source_id, r.n_words) for r in passages.shared_passages(documents(spark, texts)).collect())
    assert got == [(9, 5, 90), (11, 5, 90)]
    kept = {r.doc_id: len(r.text.split()) for r in passages.without_passages(documents(spark, texts)).collect()}
    assert kept[9] == kept[11] == 30 and kept[5] == 120


def test_all_common_runs(spark, monkeypatch):
    """Every run of 40 words or more that an earlier document holds lies in found passages, but for a word at its ends; nothing else does."""
    monkeypatch.setattr(passages, "SHARD", 2000)
    monkeypatch.setattr(passages, "HOT", 2)
    rng = random.Random(12)
    pool = [prose(rng, rng.randint(15, 130)).split() for _ in range(30)]
    texts = []
    for d in range(220):
        words = []
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(pool)
            at = rng.randrange(max(1, len(part) - 20)) if rng.random() < 0.5 else 0
            words += prose(rng, rng.randint(3, 30)).split() + part[at : at + rng.randint(20, 130) if rng.random() < 0.5 else None]
        texts.append((d, " ".join([*words, *prose(rng, 5).split()])))
    held, expected, words = {}, {}, {}
    for d, text in texts:
        words[d] = text.split()
        runs = [tuple(words[d][i : i + 40]) for i in range(len(words[d]) - 39)]
        expected[d] = {j for i, r in enumerate(runs) if held.get(r, d) < d for j in range(i, i + 40)}
        for r in runs:
            held.setdefault(r, d)
    got = {d: set() for d, _ in texts}
    for r in passages.shared_passages(documents(spark, texts)).collect():
        first = len(texts[r.doc_id][1][: r.start].split())
        got[r.doc_id] |= set(range(first, first + r.n_words))
        other = texts[r.source_id][1].split()[r.source_word : r.source_word + r.source_words]
        assert r.source_id <= r.doc_id and passages.distance(words[r.doc_id][first : first + r.n_words], other) == r.edits <= 0.2 * max(r.n_words, len(other))
    every = sum(map(len, expected.values()))
    lost = sum(len(expected[d] - got[d]) for d in got)
    assert every > 10_000 and lost <= 0.005 * every, (lost, every)
    assert sum(not got[d] for d in got if expected[d]) == 0


def test_hot_passages(spark, monkeypatch):
    """A passage of very many documents: each but the first has it."""
    monkeypatch.setattr(passages, "PACKED", 20_000)
    rng = random.Random(13)
    shared = prose(rng, 60)
    texts = [(d, f"{prose(rng, 10)} {shared} {prose(rng, 20)}") for d in range(400)]
    got = passages.shared_passages(documents(spark, texts)).collect()
    assert {r.doc_id for r in got if r.source_id == 0 and r.n_words == 60} >= set(range(1, 400)) - {r.doc_id for r in got if r.n_words > 60}
    assert {r.doc_id for r in got} == set(range(1, 400)) and all(60 <= r.n_words <= 63 for r in got)  # neighbouring words may agree by chance


@pytest.mark.parametrize("kept", [1, 4])
def test_long_and_odd_items(spark, monkeypatch, kept):
    """One item of a million characters among others, NULs kept, more passes than automata."""
    monkeypatch.setattr(decontaminate, "ITEMS", 200)
    monkeypatch.setattr(decontaminate, "KEPT", kept)
    decontaminate.pass_items.cache_clear()
    rng = random.Random(14)
    long = prose(rng, 180_000)
    items = [(i, prose(rng, 12)) for i in range(1000)] + [(1000, long), (1001, "abc\0")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [(1, f"x {long} y"), (2, f"so {items[500][1]} it is"), (3, "zz abc\0 zz"), (4, "zz abc zz")])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, frame).collect()) == [(1, 1000), (2, 500), (3, 1001)]


def test_equal_words_between_seeds_are_not_aligned(monkeypatch):
    asked = []
    between = passages.between
    monkeypatch.setattr(passages, "between", lambda a, b: asked.append(1) or between(a, b))
    a = [f"w{i}" for i in range(100)]
    assert passages.aligned(a, a, [0, 20, 22, 60], [0, 20, 22, 60]) == [(0, 0, 100)] and not asked
    b = [*a[:30], "x", *a[31:]]
    assert passages.aligned(a, b, [0, 50], [0, 50]) == [(0, 0, 30), (31, 31, 69)] and asked


def test_short_alignments_are_no_passages(monkeypatch):
    monkeypatch.setattr(np, "cumsum", lambda *a, **k: pytest.fail("parts too short together were tried one by one"))
    assert passages.longest([(0, 4, 0, 4, 0), (20, 24, 22, 26, 0)]) == [((0, 4, 0, 4, 0), False), ((20, 24, 22, 26, 0), False)]
