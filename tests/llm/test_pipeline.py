"""The pipeline: planted cases, and each stage's decisions."""

import base64
import hashlib
import math
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from lexloom.llm import bpe_codec, decontaminate, kneser_ney, quality
from lexloom.session import saved, table

from .test_models import Plain, tokens
from .test_near import roots
from .test_passages import edits, prose


@pytest.fixture
def folder(spark, tmp_path):
    """The synthetic tables with planted documents."""
    rng = random.Random(9)
    sf = "/root/testdata/sf0.01"
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    base = {r.doc_id: r.text for r in docs.where("doc_id < 40").collect()}
    item = items.first().text
    clean = next(t for t in base.values() if 800 < len(t) < 3000 and "|" not in t and "!!" not in t and "&&&" not in t)
    words = clean.split()
    others = [t.split() for t in base.values() if t != clean and len(t) > 1200 and not any(m in t for m in ("|", "!!", "&&&"))]
    mix = lambda k: " ".join(others[k][:90] + others[k + 1][60:150])
    planted = [(10_000, clean + " extra"), (10_001, clean + " extra"), (10_002, f"{mix(0)} {item}"), (10_003, f"{mix(2)} {' '.join(words[:70])} {mix(4)}")]
    junk = [(10_004, " ".join(f"{w}&&&" for w in prose(rng, 200).split()))]
    more = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in planted + junk], docs.schema)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, sf, name).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs, columns, left = table(spark, folder, "documents"), ["doc_id", "text", "lang", "source", "n_chars"], []
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, folder), name)
        left.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns == (columns if name != "byte_level_bpe" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    assert 10_004 not in left[0] and 10_000 in left[0]
    assert 10_001 not in left[1]
    assert left[2].keys() == left[1].keys() and len(left[2][10_003].text) < len(left[1][10_003].text)
    assert 10_002 not in left[3]
    assert left[4].keys() == left[3].keys()
    codec = bpe_codec.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for i, r in list(left[4].items())[:50]:
        assert r.n_tokens == len(codec.encode([left[3][i].text])[0]) // 4
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.collect())) == sorted(tuple(r) for r in left[4].values())


def synthetic(rng):
    """Documents with junk, near copies, shared passages and test items planted; labels; items."""
    vocabulary = prose(rng, 400).split()
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = [text(rng.randint(70, 130)) for _ in range(90)]
    items = [" ".join(rng.choices(vocabulary, k=14)) for _ in range(4)]
    docs = list(enumerate(base))
    for i in range(8):
        words = base[i].split()
        words[rng.randrange(len(words))] = "changed"
        docs.append((100 + i, " ".join(words)))
    docs += [(120 + i, base[20 + i]) for i in range(4)]
    for i in range(8):
        words, at = base[30 + i].split(), rng.randrange(10)
        docs.append((140 + i, f"{text(40)} {' '.join(words[at : at + 55])} {text(30) if i % 2 else ''}".strip()))
    for i in range(6):
        item = items[i % 4] if i % 2 else items[i % 4].replace(items[i % 4][7], "_", 1)
        docs.append((160 + i, f"{text(30)} {item.upper()}\n{text(25)}"))
    docs += [(180 + i, " ".join(f"{w}&&&{i}" for w in text(80).split())) for i in range(5)]
    docs += [(190, f"{base[50]} {' '.join('#' + w for w in text(60).split())}"), (191, ""), (192, None), (193, "one")]
    return docs, [(i, 1, 0) for i in range(90)] + [(i, 0, 0) for i in range(180, 185)], list(enumerate(items))


def test_run_like_brute_force(spark, tmp_path):
    docs, labels, items = synthetic(random.Random(21))
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labelled.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = dict(docs)

    # the classifier: whole text and worst stretch under the model by dictionaries
    chosen = {r.trusted_id: r.unseen for r in quality.chosen(labelled, "doc_id", quality.TRUSTED_ROWS).collect()}
    plain = Plain([text[i] for i, unseen in chosen.items() if not unseen])

    def costs(t):
        w = tokens(t)
        padded = ["<start>"] * (plain.order - 1) + w
        return [-math.log10(plain.p(x, padded[i : i + plain.order - 1])) for i, x in enumerate(w)]

    unseen = [costs(text[i]) for i, u in chosen.items() if u]
    mean = sum(map(sum, unseen)) / sum(map(len, unseen))
    smooth = lambda c: (sum(c) + mean * quality.PRIOR_TOKENS) / (len(c) + quality.PRIOR_TOKENS)
    n = kneser_ney.STRETCH
    worst = lambda c: max((sum(c[i : i + n]) / n for i in range(len(c) - n + 1)), default=-1)
    limits = [np.quantile([f(c) for c in unseen], 1 - quality.ABOVE) + quality.MARGIN for f in (smooth, worst)]
    kept = [i for i, t in docs if smooth(costs(t)) <= limits[0] and worst(costs(t)) <= limits[1]]
    assert set(range(180, 185)) | {190} == set(text) - set(kept)

    # near-duplicates: all pairs of sets of five-word shingles
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := tokens(text[i])[:-1]) else frozenset() for i in kept}
    links = [(a, b) for a in kept for b in kept if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    part = roots(kept, links)
    kept = [i for i in kept if part[i] == i]
    assert {100 + i for i in range(8)} | {120 + i for i in range(4)} | {192} <= set(text) - set(kept)

    # shared passages: every run of 40 words that an earlier document holds goes, with the white space behind
    cut, held = {}, {}
    for i in sorted(kept):
        words = (text[i] or "").split()
        runs = [tuple(w.lower() for w in words[k : k + 40]) for k in range(len(words) - 39)]
        gone = {j for k, r in enumerate(runs) if held.get(r, i) < i for j in range(k, k + 40)}
        for r in runs:
            held.setdefault(r, i)
        out, at = "", 0
        for j, w in enumerate(words):
            start = text[i].index(w, at)
            if j not in gone:
                out += text[i][at:start] + w
                at = start + len(w)
            else:
                out += text[i][at:start] if j - 1 not in gone else ""
                at = start + len(w)
                while at < len(text[i]) and text[i][at].isspace():
                    at += 1
        cut[i] = out + ((text[i] or "")[at:])
    assert sum(len(cut[i]) < len(text[i] or "") for i in kept) == 8

    # test items: edit distance to every stretch of the text
    hit = {i for i in kept for _, item in items if edits(item, decontaminate.normal(cut[i])) <= decontaminate.budget(len(item), 0.05)}
    assert hit == set(range(160, 166))

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i in set(kept) - hit:
        ids = library.encode_ordinary(cut[i])
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(cut[i].encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(expected)


def test_memory_is_given_back_before_each_stage(spark, monkeypatch):
    done = []
    monkeypatch.setattr(corpus_pipeline, "relieve", lambda spark: done.append("relieve"))
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: None)
    for module, name in ((quality, "keep_quality"), (corpus_pipeline.simhash, "keep_dissimilar"), (corpus_pipeline.passages, "without_passages"), (decontaminate, "decontaminate"), (bpe_codec, "round_trip")):
        monkeypatch.setattr(module, name, lambda *_, name=name: done.append(name))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, None, "")
    assert done[::2] == ["relieve"] * 5 and done[1::2] == ["keep_quality", "keep_dissimilar", "without_passages", "decontaminate", "round_trip"]
