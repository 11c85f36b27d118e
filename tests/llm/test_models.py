"""The language model against plain counting, and quality on labelled documents."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexloom.llm import arrays, quality
from lexloom.llm import kneser_ney as K
from lexloom.session import table

from .frames import ODD, documents

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["<end>"]


class Plain:
    """The model by dictionaries."""

    def __init__(self, texts, order=K.ORDER):
        self.order, self.c, top = order, Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.c.update(w)
            padded = ["<start>"] * (order - 1) + w
            top.update(tuple(padded[i : i + order]) for i in range(len(w)))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.counts = {order: top}
        for level in range(order - 1, 0, -1):
            self.counts[level] = Counter(g[1:] for g in self.counts[level + 1])
        self.total, self.after, self.d = {}, {}, {}
        for level, grams in self.counts.items():
            total, after = Counter(), defaultdict(lambda: [0, 0, 0])
            for g, n in grams.items():
                total[g[:-1]] += n
                after[g[:-1]][min(n, 3) - 1] += 1
            of = Counter(grams.values())
            self.total[level], self.after[level], self.d[level] = total, after, K.discounts(*(of[k] for k in (1, 2, 3, 4)))

    def p(self, w, context, level=None):
        """Of a word behind a context of order - 1 words."""
        if level is None:
            level = self.order
        if level == 0:
            return 1 / (self.v + 1)
        context = tuple(context)[len(context) - level + 1 :]
        rest = self.p(w, context, level - 1)
        if not self.total[level][context]:
            return rest
        n, d = self.counts[level][(*context, w)], self.d[level]
        return (max(n - d[min(n, 3) - 1], 0) * (n > 0) + sum(a * b for a, b in zip(d, self.after[level][context], strict=True)) * rest) / self.total[level][context]

    def row(self, text):
        w = tokens(text)
        base = sum(math.log10((self.c[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        padded = ["<start>"] * (self.order - 1) + w
        score = sum(math.log10(self.p(x, padded[i : i + self.order - 1])) for i, x in enumerate(w))
        return len(w), sum(self.c[x] > 0 for x in w), self.n, base, score


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("rows", [[], [(1, "a b a b c")], [(2, "a b a b c"), (3, "a b a b d a b"), (4, "b a"), (5, ""), (6, None)], ODD])
def test_scores_like_plain_counting(spark, rows, order, monkeypatch):
    monkeypatch.setattr(K, "WORDS", 3)
    monkeypatch.setattr(K, "SHARD", 10 if len(rows) < 9 else 50_000)
    check(rows, K.lm_scores(documents(spark, rows), order=order).collect(), order)


def check(rows, got, order=K.ORDER):
    plain = Plain([t for i, t in rows if not held(i)], order)
    expected = sorted([(i, held(i), *plain.row(t)) for i, t in rows], key=repr)
    assert len(got) == len(expected)
    for r, e in zip(sorted(map(tuple, got), key=repr), expected, strict=True):
        assert tuple(r)[:5] == e[:5] and tuple(r)[5:] == pytest.approx(e[5:], rel=1e-9, abs=1e-9)


def test_scores_of_the_synthetic_documents(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = K.lm_scores(docs).collect()
    check(rows, got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)  # better than single tokens on text not seen


def test_probabilities_sum_to_one():
    plain = Plain(["a b a b c", "b c d", ""], 3)
    for context in (("<start>", "<start>"), ("<start>", "a"), ("a", "b"), ("zzz", "a"), ("zzz", "zzz")):
        assert sum(plain.p(w, context) for w in [*plain.c, "unknown"]) == pytest.approx(1)


@pytest.mark.parametrize("order", [2, 3])
def test_better_with_context(spark, order, monkeypatch):
    monkeypatch.setattr(K.arrays, "load", lambda folder, name, load=K.arrays.load: np.array(load(folder, name)))  # as from a store that isn't mounted
    docs = table(spark, SF, "documents")
    K.lookup.cache_clear()
    check([(r.doc_id, r.text) for r in docs.limit(60).collect()], K.lm_scores(spark.createDataFrame(docs.limit(60).collect(), docs.schema), order=order).collect(), order)


def test_quality_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality.quality(docs, labels).join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in got if r.quality == q and not r.toxic] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good)  # clean documents stay
    assert sum(bad) <= 0.1 * len(bad)
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {r.doc_id for r in got if r.kept}


def test_worst_stretches():
    rng = np.random.default_rng(1)
    texts = [" ".join(["w"] * n) for n in (0, 5, 30, 31, 32, 100, 64)]
    tokens = K.Tokens(texts)
    scores = rng.standard_normal(len(tokens.place))
    expected = [min((scores[i : i + 32].mean() for i in range(a, b - 31)), default=math.nan) for a, b in zip(tokens.starts, tokens.ends, strict=True)]
    assert K.worst_of(scores, tokens) == pytest.approx(expected, nan_ok=True)


def test_quality_like_plain_perplexity(spark):
    """Scores, thresholds and decisions from the model by dictionaries."""
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    rows = {r.doc_id: r for r in docs.collect()}
    chosen = {r.trusted_id: r.unseen for r in quality.chosen(labels, "doc_id", quality.TRUSTED_ROWS).collect()}
    plain = Plain([rows[i].text for i, unseen in chosen.items() if not unseen and i in rows])

    def costs(text):
        w = tokens(text)
        padded = ["<start>"] * (plain.order - 1) + w
        return [-math.log10(plain.p(x, padded[i : i + plain.order - 1])) for i, x in enumerate(w)]

    unseen = [(rows[i].lang, costs(rows[i].text)) for i, u in chosen.items() if u and i in rows]
    overall = sum(sum(c) for _, c in unseen) / sum(len(c) for _, c in unseen)
    by = {lang: [c for x, c in unseen if x == lang] for lang, _ in unseen}
    means = {k: sum(map(sum, v)) / sum(map(len, v)) for k, v in by.items() if len(v) >= quality.LEAST_ROWS}
    smooth = lambda c, lang: (sum(c) + means.get(lang, overall) * quality.PRIOR_TOKENS) / (len(c) + quality.PRIOR_TOKENS)
    worst = lambda c: max((sum(c[i : i + 32]) / 32 for i in range(len(c) - 31)), default=None)

    def limits(group):
        return [np.quantile([x for x in values if x is not None], 1 - quality.ABOVE) + quality.MARGIN for values in ([smooth(c, lang) for lang, c in group], [worst(c) for _, c in group])]

    per = {k: limits([(k, c) for c in by[k]]) for k in means}
    other = limits(unseen)
    for r in quality.quality(docs, labels).collect():
        c, (first, second) = costs(rows[r.doc_id].text), per.get(r.lang, other)
        assert (r.mean_score, r.threshold, r.worst_threshold) == pytest.approx((smooth(c, r.lang), first, second)) and r.perplexity == pytest.approx(10 ** (sum(c) / len(c)))
        assert r.worst_score == (None if worst(c) is None else pytest.approx(worst(c)))
        assert r.kept == (r.mean_score <= first and (worst(c) is None or r.worst_score <= second))


@pytest.mark.parametrize("labelled", [[], [(3, 1, 0), (3, 1, 0), (None, 1, 0), (5, 0, 1), (4, 1, None), (1, None, None)]])
@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_quality(spark, rows, labelled):
    docs = documents(spark, rows)
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    got = quality.quality(documents(spark, rows), labels)
    assert got.count() == len(rows)
    if not labelled:
        assert got.where("not kept").count() == 0
    assert quality.keep_quality(docs, labels).columns == docs.columns


def test_all_labelled_documents_are_trusted(spark):
    labels = spark.range(60_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert quality.chosen(labels, "doc_id").count() == 60_000
    docs = spark.range(90_000).union(spark.range(3)).selectExpr("id - 10000 as id", "'x' as text").unionByName(documents(spark, [(None, "x")]).selectExpr("doc_id as id", "text"))
    got = [r.id for r in quality.trusted_rows_of(docs, quality.chosen(labels, "doc_id")).collect()]
    assert sorted(got) == list(range(60_000))
    assert quality.trusted_rows_of(docs, quality.chosen(labels.where("false"), "doc_id")).count() == 0


def test_shards_of_trusted_ids(spark, monkeypatch):
    monkeypatch.setattr(quality, "ID_SHARD", 100)
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "trusted_id")
    docs = spark.range(3000).union(spark.range(9))
    assert sorted(r.id for r in quality.trusted_rows_of(docs, ids).collect()) == sorted([*range(0, 3000, 3), 0, 3, 6])


def held(f, texts):
    """Bytes that Python and numpy hold at most in f, for each byte of text."""
    f(texts[:10])
    tracemalloc.start()
    f(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / sum(len(t) for t in texts)


def test_words_of_a_slice_are_not_held_one_by_one():
    texts = [" ".join(f"w{(i * i + j * 7) % 900}" for j in range(400)) for i in range(400)]
    assert held(K.Tokens, texts) < 12
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    at, n = K.distinct(np.concatenate([keys, keys[:700]]))
    assert (np.concatenate([keys, keys[:700]])[at] == np.sort(keys)).all() and n.sum() == 5700 and (n == 2).sum() == 700


@pytest.mark.parametrize("n", [0, 1, 3, 70_000, 400_000])
def test_keys_are_found_where_they_lie(tmp_path, n):
    rng = np.random.default_rng(n)
    h, other = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (n, 1000))
    placed = K.save_keys(str(tmp_path), "k", h)
    arrays_ = [arrays.load(str(tmp_path), f"k-{part}") for part in ("at", "low", "high")]
    there, at = K.find_keys(*arrays_, np.concatenate([h, other]))
    assert sorted(there.tolist()) == list(range(n)) and (placed[at] == there).all()
