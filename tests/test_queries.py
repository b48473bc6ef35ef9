"""Every core query against its SQL oracle in DuckDB, on the small test tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from sightline import queries
from sightline.operators import reconcile

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    return con


def rows(cols, found):
    fix = lambda v: "null" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(fix(r[cols.index(c)]) for c in sorted(cols)) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    told = duck.execute(queries.ORACLES[name])
    cols = [d[0] for d in told.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, told.fetchall())


#: Their joins grow with the documents.
SHUFFLED = ["near_duplicates", "grouped_split", "assign_groups", "cross_dataset_pairs", "eval_only_split", "image_units", "leak_groups", "pair_examples", "near_pair_summary"]


@pytest.mark.parametrize("name", SHUFFLED)
def test_sides_that_grow_are_not_broadcast(spark, monkeypatch, name):
    kind, plans = type(spark.range(1)), []
    write = kind.write.fget
    monkeypatch.setattr(kind, "write", property(lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1]))
    queries.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]


def test_export_keys_of_even_ids_are_checked(spark, tmp_path):
    for file in os.listdir(FOLDER):
        os.symlink(f"{FOLDER}/{file}", tmp_path / file)
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    (tmp_path / "orders.parquet").unlink()
    orders.union(orders.filter("o_orderkey % 2 = 0").limit(1)).write.parquet(str(tmp_path / "orders.parquet"))
    with pytest.raises(reconcile.AmbiguousKey):
        queries.QUERIES["reconcile_export"](spark, str(tmp_path))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
