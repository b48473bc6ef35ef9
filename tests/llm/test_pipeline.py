from __future__ import annotations

import pytest

import corpus_pipeline
from sightline.llm import decontaminate, language_id

from .conftest import documents, prose
from .test_judges import edits
from .test_text_dedup import WORD, brute_near, brute_substrings
from .test_tokens_and_packing import check_packing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(d_, t, lang, s, len(t) if t is not None else None) for d_, t, lang, s in documents() if d_ is not None]
    leaks = ["Intro. " + prose(7000 + i, 12) + " " + prose(950, 16).upper() + " and more" for i in range(4)]
    rows += [(200 + i, t, "en", "s", len(t)) for i, t in enumerate(leaks)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, prose(950, 16)), (2, prose(951, 16))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def kept_rows(df):
    return sorted((r["doc_id"], r["text"] or "") for r in df.collect())


def test_every_stage_equals_brute_force(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)

    judge = language_id.Classifier(language_id.train(docs))
    want = sorted((d, t) for d, t in ((r["doc_id"], r["text"] or "") for r in docs.collect()) if judge(t)[1] >= language_id.ACCEPT)
    docs = stage["language_id"](spark, docs, folder)
    assert docs.columns == corpus_pipeline.COLUMNS and kept_rows(docs) == want and len(want) > 60

    near = brute_near(want, 5)
    want = [(d, t) for d, t in want if near[d][2]]
    docs = stage["near_dedup"](spark, docs, folder)
    assert docs.columns == corpus_pipeline.COLUMNS and kept_rows(docs) == want

    cut = brute_substrings(want, 50)
    want = [(d, t) for d, t in want if cut[d][1] == 0 or cut[d][1] < cut[d][0]]
    docs = stage["substring_dedup"](spark, docs, folder)
    got = kept_rows(docs)
    assert [d for d, _ in got] == [d for d, _ in want] and any(cut[d][1] for d, _ in got)
    for (d, before), (_, after) in zip(want, got):
        assert after == before if not cut[d][1] else len(WORD.findall(after)) == cut[d][0] - cut[d][1]
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] is not None)

    items = [decontaminate.clean(prose(s, 16)) for s in (950, 951)]
    leak = lambda t: any(edits(i, decontaminate.clean(t)) <= int(decontaminate.ERRORS * len(i)) for i in items)
    want = [(d, t) for d, t in got if len(t) > 20_000 or not leak(t)]
    docs = stage["decontamination"](spark, docs, folder)
    assert kept_rows(docs) == want and len(want) < len(got)

    check_packing(stage["packing"](spark, docs, folder).collect(), want, 1024)
    packed = corpus_pipeline.run(spark, folder).collect()
    check_packing(packed, want, 1024)


def test_stages_take_empty_and_strange_tables(spark, folder):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, component_id long, kept boolean")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).collect() == [], name
    odd = spark.createDataFrame([(None, "some words here that say the thing", True, "x"), (1, None, False, "y")], "doc_id long, text string, kept boolean, seq string")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert len(stage(spark, odd, folder).collect()) == 2, name
