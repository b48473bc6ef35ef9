from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

import numpy as np
import pytest

from sightline.llm import pq_dedup, warc
from sightline.plans.store import fresh_path

PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, None), (3, "http://b/\r\nX: y", ""), (4, "http://c/", "<p>x</p>"), (5, "http://d/", "é" * 5000), (6, "http://e/", "<p>x</p>"), (None, "http://n/", "only"), (7, "http://f/", "w" * 100_000), (7, "http://f/", "w" * 100_000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    folder = fresh_path(spark, "warc-test")
    manifest = warc.write_warc(pages, folder, roll_bytes=600, shard_bytes=20_000)
    rows = warc.read_warc(manifest, folder).collect()
    assert len(rows) == len(PAGES)
    raw = {p: (h or "").encode() for p, _, h in PAGES}
    largest = {}
    for p, h in raw.items():
        if p is not None:
            largest[h] = max(p, largest.get(h, p))
    for r in rows:
        h = raw[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode())
        if r["page_id"] not in (None, 7):
            top = largest[h]
            assert (r["record_type"], r["refers_to"]) == (("response", None) if top == r["page_id"] else ("revisit", top))
    assert sorted(r["record_type"] for r in rows if r["page_id"] == 7) == ["response", "revisit"]
    path = Path(folder.removeprefix("file://"))
    files = {f.name: f.read_bytes() for f in path.iterdir() if f.is_file()}
    told = {r["file"]: r for r in manifest.collect()}
    assert set(files) == set(told) and len(files) > 1 and not any(f.startswith(".") for f in files)
    for name, content in files.items():
        assert hashlib.sha256(content).hexdigest() == told[name]["sha256"] and len(content) == told[name]["bytes"]
        assert gzip.decompress(content).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert sorted(map(str, warc.read_warc(warc.open_manifest(spark, folder), folder).collect())) == sorted(map(str, rows))  # by the folder alone
    again = fresh_path(spark, "warc-again")
    twin = {r["file"]: r["sha256"] for r in warc.write_warc(pages.repartition(7), again, roll_bytes=600, shard_bytes=20_000).collect()}
    assert twin == {k: v["sha256"] for k, v in told.items()}  # the rows alone decide the bytes


@pytest.mark.parametrize("shards", [2, 7, 300, 5000])
def test_shards_are_even_ranges_of_ids(spark, shards):
    light = spark.range(1000).selectExpr("id * 7 as page_id")
    cuts = warc._cuts(light, 1000, shards)
    assert len(cuts) == min(shards, 1000) - 1 and cuts == sorted(set(cuts))
    rows = light.unionByName(spark.createDataFrame([(None,), (-5,)], "page_id long")).withColumn("shard", warc.shard_of(cuts)).collect()
    assert all(r["shard"] == (sum(c <= r["page_id"] for c in cuts) if r["page_id"] is not None else 0) for r in rows)
    sizes = np.bincount([r["shard"] for r in rows])
    assert sizes.max() <= 1000 // shards + 3


def test_warc_of_nothing(spark):
    folder = fresh_path(spark, "warc-none")
    manifest = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert manifest.collect() == [] and warc.read_warc(manifest, folder).collect() == []


def test_a_broken_record_is_noticed():
    raw = gzip.decompress(warc.record("response", 1, "http://a/", b"text", "D", None))
    warc.parse(raw)
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"text", b"tent"))


def vectors():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(150)]
    for i in range(150, 260):
        base = np.array(rows[i % 20][1])
        rows.append((i, (base + rng.normal(size=16) * 0.05 * (i % 5)).tolist(), rows[i % 20][2]))
    rows += [(300 + i, (np.array(rows[0][1]) * (i + 1)).tolist(), 0) for i in range(4)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] + [1.0] * 15, 0), (403, [None] + [1.0] * 15, 0), (404, rows[0][1], None), (405, [], 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (408, [1e-30] * 16, 1), (409, [1e30] * 16, 1), (None, rows[0][1], 0), rows[1]]
    return rows


def brute_vectors(rows, least):
    good = {v: (label, np.array(x, dtype=float)) for v, x, label in rows if v is not None and label is not None and x and None not in x and np.isfinite(x).all() and any(x)}
    ids = sorted(good)
    links = {v: set() for v, *_ in rows}
    for a in ids:
        for b in ids:
            (la, xa), (lb, xb) = good[a], good[b]
            if a != b and la == lb and len(xa) == len(xb):
                ua, ub = xa / np.abs(xa).max(), xb / np.abs(xb).max()
                if ua @ ub / np.sqrt((ua @ ua) * (ub @ ub)) >= least:
                    links[a].add(b)
    label = {v: v for v in links if v is not None}
    for _ in range(len(label)):
        new = {v: min([label[v], *(label[w] for w in links[v])]) for v in label}
        if new == label:
            break
        label = new
    return {v: (len(links[v]), label[v], label[v] == v) for v in label}


def test_vectors_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, links int")
    want = brute_vectors(rows, 0.98)
    for kw in ({}, {"rows": 16, "queries": 24, "per_list": 10}):  # one list, and many lists cut into blocks
        got = pq_dedup.near_vectors(df, **kw).collect()
        assert len(got) == len(rows)
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None} == want
        assert all((r["n_links"], r["component_id"], r["kept"]) == (0, None, True) for r in got if r["vec_id"] is None)
    assert pq_dedup.near_vectors(df.limit(0)).collect() == []


def test_links_of_many_lists_and_two_levels_equal_brute_force(spark, monkeypatch):
    """Recall against brute force is 1 with the default reach, in one level of lists and in two."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=64).tolist(), i % 2) for i in range(400)]
    for i in range(400, 700):
        base = np.array(rows[i % 100][1])
        rows.append((i, (base + rng.normal(size=64) * 0.03 * (i % 6)).tolist(), rows[i % 100][2]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(v, np.array(x, dtype=np.float32).astype(float).tolist(), label) for v, x, label in rows]
    want = brute_vectors(rows, 0.98)
    assert sum(n for n, _, _ in want.values()) > 300
    for first in (1024, 6):
        monkeypatch.setattr(pq_dedup, "FIRST", first)
        got = pq_dedup.near_vectors(df, per_list=20).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == want


def test_probed_share_falls_as_lists_grow():
    rng = np.random.default_rng(2)
    x = pq_dedup._unit(rng.normal(size=(4000, 64)))
    share = []
    for lists in (4, 16, 64):
        q = pq_dedup.Quantiser(x, lists)
        row, which = q.probes(x, 0.6 * 0.2)
        share.append(len(row) / len(x) / lists)
        own = q.encode(x)[0]
        assert (np.bincount(row[which == own[row]], minlength=len(x)) == 1).all()
    assert share[0] > share[1] > share[2] and share[2] < 0.25


def test_table_distances_bound_the_true_ones():
    rng = np.random.default_rng(1)
    x = pq_dedup._unit(rng.normal(size=(300, 16)))
    q = pq_dedup.Quantiser(x[:200], 4, 4, 16)
    own, codes, left = q.encode(x)
    for which in range(4):
        base = np.flatnonzero(own == which)
        t = q.tables(x[:20], which)
        adc = np.sqrt(sum(t[:, m, :][:, codes[base, m]] for m in range(4)))
        true = np.sqrt(((x[:20, None] - x[base]) ** 2).sum(2))
        assert (np.abs(adc - true) <= left[base] + 1e-9).all()
