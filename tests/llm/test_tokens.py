"""Token counts and the byte-pair codec against the libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lexloom.llm import bpe_codec, token_counts

from .frames import ODD, documents

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def texts():
    rng = random.Random(1)
    odd = ["", " ", "  ", "a  b", "a   b \n c\n\n d", " lead", "trail ", "x<|endoftext|>y <|endoftext|> z", "don't we'll 'S I'm", "\t\tfoo\n \n", "ab" * 3000, "é" * 999, " 's 't'd"]
    return odd + ["".join(rng.choice("ab 's\n\t é1!  \x1c日😀") for _ in range(rng.randint(0, 60))) for _ in range(800)]


def test_counts_like_the_library():
    library = Tokenizer.from_file(JSON)
    assert token_counts.Counter(JSON).of_texts(texts()) == [len(e.ids) for e in library.encode_batch(texts(), add_special_tokens=False)]


def test_ids_like_the_library(monkeypatch):
    monkeypatch.setattr(bpe_codec, "PAIRS", 50)  # what is forgotten is worked out again
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe_codec.Codec(RANKS, P.PATTERN)
    found = codec.encode(texts())
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [library.encode_ordinary(t) for t in texts()]
    assert [codec.decode(x) for x in found] == [t.encode() for t in texts()]


def anywhere(n, seed):
    """Random characters of all planes, and some that Unicode has since version 17."""
    rng = random.Random(seed)
    char = lambda: chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0xA0, 0xD800), rng.randrange(0xE000, 0x110000), rng.choice([0x558, 0x209D, 0x16FF4, 0x18F34, 0x1E6C0, 0x3D000, 0x12560])]))
    return ["".join(rng.choice([" ", char()]) if rng.random() < 0.3 else char() for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_all_planes_like_the_libraries():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe_codec.Codec(RANKS, P.PATTERN).encode(anywhere(20_000, 2))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == library.encode_ordinary_batch(anywhere(20_000, 2))
    counts = Tokenizer.from_file(JSON).encode_batch(anywhere(20_000, 3), add_special_tokens=False)
    assert token_counts.Counter(JSON).of_texts(anywhere(20_000, 3)) == [len(e.ids) for e in counts]


def test_corpus_like_the_library(spark, monkeypatch):
    """Through the shards, several of them, with long pieces beside."""
    monkeypatch.setattr(bpe_codec, "SHARD", 20_000)
    monkeypatch.setattr(bpe_codec, "PIECES", 500)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t) for i, t in enumerate([*texts(), *anywhere(2000, 4), "x " + "日本語" * 500 + " y", "q" * 3000])]
    got = {r.doc_id: r for r in bpe_codec.round_trip(documents(spark, rows), RANKS, P.PATTERN).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_documents(spark, rows):
    docs = documents(spark, rows)
    counts = token_counts.token_counts(docs, JSON).collect()
    library = Tokenizer.from_file(JSON)
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in counts), key=repr) == sorted(expected, key=repr)
    assert all(r.over_limit == (r.n_tokens > 512) for r in counts)
    trip = bpe_codec.round_trip(docs, RANKS, P.PATTERN).collect()
    digests = [(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(((r.doc_id, r.decoded_sha256) for r in trip), key=repr) == sorted(digests, key=repr)
    back = bpe_codec.decode(bpe_codec.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted([(i, t or "") for i, t in rows], key=repr)


def test_merges_at_many_places_at_once(monkeypatch):
    """Also with ranks in any order, against the least rank from the left, one merge after another."""
    rng = random.Random(7)
    for many in (1, 5, 1 << 30):
        monkeypatch.setattr(bpe_codec, "MANY", many)
        for _ in range(60):
            tokens = list({bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(rng.randint(1, 25))})
            codec = bpe_codec.Codec(RANKS, P.PATTERN)
            codec.ranks = {bytes([b]): 1000 + b for b in range(256)} | {t: r for r, t in enumerate(tokens)}
            codec.token, codec.byte, codec.pair = {r: t for t, r in codec.ranks.items()}, [1000 + b for b in range(256)], {}
            words = [bytes(rng.choices(b"abc", k=rng.randint(0, 14))) for _ in range(30)]
            for word, found in zip(words, codec.replay(words), strict=True):
                parts = [bytes([b]) for b in word]
                while pairs := [(codec.ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in codec.ranks]:
                    i = min(pairs)[1]
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                assert np.frombuffer(found, "<u4").tolist() == [codec.ranks[p] for p in parts]


def test_few_pairs_are_looked_up_one_by_one(monkeypatch):
    asked = []
    rank = bpe_codec.Codec.rank
    monkeypatch.setattr(bpe_codec.Codec, "rank", lambda self, a, b: asked.append(1) or rank(self, a, b))
    rng = random.Random(3)
    words = ["".join(rng.choices("aeionrst", k=8)) for _ in range(20_000)]
    bpe_codec.Codec(RANKS, P.PATTERN).shard(words)
    assert len(asked) < sum(map(len, words))
