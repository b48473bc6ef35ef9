from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import kernels as K
from sightline.llm import minhash_dedup, runs, substring_dedup

from .conftest import documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(edges: dict, nodes):
    label = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                moved = True
    return label


def brute_near(rows, k):
    sets = {}
    for d, t in rows:
        if d is None:
            continue
        ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = components(edges, ids)
    return {d: (len(sets[d]), label[d], label[d] == d) for d in ids}


def test_near_duplicates_equal_brute_force(docs):
    want = brute_near([(r[0], r[1]) for r in documents()], 2)
    for short, block in ((32, 1024), (2, 5)):  # posting lists in one block, and cut into blocks
        got = minhash_dedup.near_duplicates(docs, k=2, short=short, block=block).collect()
        assert len(got) == len(documents())
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == want
        assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)


def test_near_duplicates_of_five_words_equal_brute_force(docs):
    want = brute_near([(r[0], r[1]) for r in documents()], 5)
    got = minhash_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == want


def test_near_duplicates_of_nothing(no_docs):
    assert minhash_dedup.near_duplicates(no_docs).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    both = np.unique(rng.integers(0, 1 << 62, 900)).astype(np.uint64)
    a, b = np.sort(both[:800]), np.sort(both[100:])
    m = minhash_dedup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((m[0] == m[1]).mean() - 700 / 900) < 0.2


def thue_morse(n: int) -> tuple[str, str]:
    """A word of a and b and its complement, on which polynomial hashes modulo powers of two agree."""
    x = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_words_that_cancel_out_in_polynomial_hashes_stay_apart(spark):
    x, y = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(49))
    few = " ".join(thue_morse(64)[0]), " ".join(thue_morse(64)[1])
    rows = [(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, x), (4, y), (5, few[0]), (6, few[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (2, 5):
        got = minhash_dedup.near_duplicates(docs, k=k).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_near(rows, k)
    got = substring_dedup.substring_dedup(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_substrings(rows, 50)


def brute_substrings(rows, window):
    texts = {d: WORD.findall(t or "") for d, t in rows if d is not None}
    first = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - window + 1):
            first.setdefault(tuple(texts[d][i : i + window]), d)
    out = {}
    for d, ws in texts.items():
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out[d] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup_equals_brute_force(docs):
    rows = [(r[0], r[1]) for r in documents()]
    for window, gram, batches in ((50, 10, 2), (50, 10, 5), (12, 4, 1)):
        got = substring_dedup.substring_dedup(docs, window, gram, batches).collect()
        assert len(got) == len(documents())
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got if r["doc_id"] is not None} == brute_substrings(rows, window)
        assert all(r["n_removed"] == 0 for r in got if r["doc_id"] is None)
        for r in got:
            if r["n_removed"]:
                assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_batches_into_one_index_equal_the_whole_table(spark, docs):
    index, want = substring_dedup.open_index(spark), brute_substrings([(r[0], r[1]) for r in documents()], 50)
    got, cuts = {}, [0, 30, 42, 62, 73, 1000]
    for a, b in zip(cuts[:-1], cuts[1:]):
        batch = docs.filter(f"doc_id >= {a} and doc_id < {b}")
        rows = substring_dedup.substring_dedup(batch, batches=1, index=index, max_runs=2).collect()
        got |= {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}
        if a == 30:  # as after a crash: opened by its path, and the last batch given again
            index = substring_dedup.open_index(spark, index.path)
            again = substring_dedup.substring_dedup(batch, batches=1, index=index, max_runs=2).collect()
            assert all(got[r["doc_id"]] == (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in again)
    assert got == want and len(index.state["anchors"]["runs"]) <= 3


def test_an_id_with_another_text_in_an_earlier_batch(spark):
    a, b = prose(1, 60), prose(2, 60)
    index = substring_dedup.open_index(spark)
    substring_dedup.substring_dedup(spark.createDataFrame([(1, a)], "doc_id long, text string"), index=index)
    got = substring_dedup.substring_dedup(spark.createDataFrame([(1, b + " " + a), (2, b), (3, a)], "doc_id long, text string"), index=index)
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {1: 0, 2: 60, 3: 60}


def test_later_batches_may_have_smaller_ids(spark, docs):
    rows = [(r[0], r[1]) for r in documents() if r[0] is not None]
    index = substring_dedup.open_index(spark)
    substring_dedup.substring_dedup(docs.filter("doc_id >= 45"), index=index)
    got = substring_dedup.substring_dedup(docs.filter("doc_id < 45"), index=index).collect()
    want = brute_substrings(rows, 50)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {d: w for d, w in want.items() if d < 45}


def test_substring_dedup_of_nothing(no_docs):
    assert substring_dedup.substring_dedup(no_docs).collect() == []


LEVEL = {"x": ("key bigint, least bigint, n int", ["key"], {"least": "least({a}, {b})", "n": "coalesce({a}, 0) + coalesce({b}, 0)"})}


def test_runs_are_merged_without_shuffle_or_sort(spark):
    store = runs.RunStore(spark, LEVEL)
    for n in range(3):
        store.commit({"x": store.write("x", spark.range(2000).selectExpr(f"id * {n + 1} key", f"id + {100 * n} least", "1 n"), 2000)})
    new = store.write("x", spark.range(50).selectExpr("id * 3 key", "id least", "1 n"), 50)
    with runs.merging(spark):
        beside = store.beside("x", new)
        plan = beside._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "Sort [" not in plan
        got = {r["key"]: r["old_n"] for r in beside.collect()}
    assert got == {3 * i: 2 + ((3 * i) % 2 == 0) for i in range(50)}
    before = {(r["key"], r["least"], r["n"]) for r in store._merged("x", store.state["x"]["runs"]).collect()}
    store.compact("x", 2)
    assert len(store.state["x"]["runs"]) == 1
    again = runs.RunStore(spark, LEVEL, store.path)
    assert again.state == store.state
    assert {(r["key"], r["least"], r["n"]) for r in again.read("x", again.state["x"]["runs"][0]).collect()} == before
    assert {k for k, _, _ in before} == {i * m for m in (1, 2, 3) for i in range(2000)}
    with pytest.raises(OSError):  # a second writer doesn't replace a manifest
        again.version = 0
        again._write_manifest()


def test_a_store_without_its_manifest_is_not_taken_for_an_empty_one(spark):
    store = runs.RunStore(spark, LEVEL)
    store.write("x", spark.range(5).selectExpr("id key", "id least", "1 n"), 5)
    with pytest.raises(ValueError):
        runs.RunStore(spark, LEVEL, store.path)
    assert runs.RunStore(spark, LEVEL, store.path + "x").state["x"]["runs"] == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t.", max_size=30), min_size=1, max_size=6))
def test_words_of_bytes_equal_the_pattern(texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
    starts, ends, bounds = K.word_spans(data, offsets)
    got = [[bytes(data[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [WORD.findall(t) for t in texts]
    hashes, _ = K.word_hashes(data, offsets)
    flat = [w for ws in got for w in ws]
    assert len(set(hashes.tolist())) == len(set(flat)) and all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 12))
def test_sliding_minimum(values, w):
    a = np.array(values, dtype=np.uint64)
    assert substring_dedup.sliding_min(a, w).tolist() == [min(values[i : i + w]) for i in range(len(values) - w + 1)]
