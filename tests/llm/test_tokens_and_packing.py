from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import packing, prefix_tokens

from .conftest import documents

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def real():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcde the ing\n\t▁<>s/ é☃日0", max_size=60))
def test_every_prefix_equals_the_library(text):
    import sentencepiece

    real = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    c = prefix_tokens.counter(MODEL)
    for i in range(len(text) + 1):
        assert c.count(text, i) == len(real.encode(text[:i]))


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abcde the ing\né", max_size=80), st.integers(0, 20))
def test_longest_prefix_within_a_budget(text, budget):
    c = prefix_tokens.counter(MODEL)
    n = c.fitting(text, budget)
    assert n == max(i for i in range(len(text) + 1) if c.count(text, i) <= budget)


def test_counts_of_documents(docs, no_docs, real):
    got = {(r["doc_id"], r["n_bytes"]): r for r in prefix_tokens.token_counts(docs, MODEL, 64).collect()}
    for d, t, *_ in documents():
        r, n = got[d, len((t or "").encode())], len(real.encode(t or ""))
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 64)
    assert prefix_tokens.token_counts(no_docs, MODEL).collect() == []


def test_both_encoders_agree():
    e = packing.ByteBpe(BPE)
    for t in ["", "<|endoftext|> a", "it's  x\n\n y", "\xa0x\x85 1½ ª", *[chr(c) * 2 + "a1 " + chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]]]:
        assert e(t).tolist() == e.full.encode(t, add_special_tokens=False).ids
    assert e("日本").tolist() == e.full.encode("日本", add_special_tokens=False).ids


def check_packing(rows, want, room):
    ids = {}
    e = packing.encoder(BPE)
    for r in rows:
        assert r["length"] <= room
        ids.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in ids.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= room
    left = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    right = []
    for d, t in want:
        full = np.append(e(t or ""), 2).astype("<u4")
        cut = len(full) % room or room
        edges = [0, *range(min(cut, len(full)), len(full) + 1, room)]
        right += [(d if d is not None else -1, i, a, b - a, zlib.crc32(full[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    assert left == sorted(right)
    return len(ids), sum(r["length"] for r in rows)


def test_packing_keeps_every_token(docs, no_docs):
    for room, block in ((1024, 4096), (64, 20)):
        rows = packing.pack_documents(docs, BPE, room=room, block=block).collect()
        n, total = check_packing(rows, [(r[0], r[1]) for r in documents()], room)
        assert n <= 1.15 * total / room + 12
    assert packing.pack_documents(no_docs, BPE).collect() == []


def test_underfull_sequences_of_all_blocks_are_packed_together(spark):
    docs = spark.createDataFrame([(i, None) for i in range(250)], "doc_id long, text string")
    rows = packing.pack_documents(docs, BPE, room=64, block=100).collect()
    assert check_packing(rows, [(i, None) for i in range(250)], 64) == (4, 250)


def test_local_search_never_needs_more_and_raises_the_squared_fill():
    rng = random.Random(3)
    for _ in range(30):
        lengths = np.array([rng.choice([rng.randrange(1, 100), rng.randrange(30, 45)]) for _ in range(rng.randrange(1, 120))])
        first = packing.best_fit(lengths, 100)
        better = packing.improve(lengths, first, 100)
        a, b = (np.bincount(x, weights=lengths) for x in (first, better))
        assert b.max() <= 100 and b.sum() == a.sum() and (b**2).sum() >= (a**2).sum() and (b > 0).sum() <= (a > 0).sum()


def test_local_search_empties_bins_that_best_fit_leaves():
    emptied = 0
    for seed in range(40):
        rng = np.random.default_rng(seed)
        lengths = rng.integers(200, 500, 300)
        first = packing.best_fit(lengths, 1024)
        emptied += len(set(packing.improve(lengths, first, 1024).tolist())) < len(set(first.tolist()))
    assert emptied >= 25


def test_ids_of_packed_sequences_give_the_texts_back(spark, docs):
    rows = packing.pack_documents(docs, BPE, room=64, block=20, with_ids=True).collect()
    check_packing(rows, [(r[0], r[1]) for r in documents()], 64)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    e = packing.encoder(BPE)
    own = {}
    for r in sorted((r for r in rows if r["doc_id"] == 87), key=lambda r: r["piece"]):
        own.setdefault(87, []).extend(np.frombuffer(r["ids"], dtype="<u4").tolist())
    assert own[87][-1] == 2 and e.full.decode(own[87][:-1]) == next(r[1] for r in documents() if r[0] == 87)
