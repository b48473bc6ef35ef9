"""Immutable sorted runs in shared storage, joined by merging.

A level is a table of rows with unique keys, kept as runs.  Each run is a bucketed table sorted by
its keys, one file a bucket, and all runs of a level have the same buckets: joins and compaction
of runs are merge joins without a shuffle or a sort of what is already written.

A store's state is its newest manifest.  Manifests are numbered, written under a temporary name
and renamed, and never replaced; runs count once a manifest names them.  So a store can be opened
again by its path, also after a crash at any moment.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.plans.store import delete, fresh_path, tidy
from sightline.sources.files import list_files

#: A bucket of a new level holds about so many rows of its first run, and there are so many at least.
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 8
_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def merging(spark: SparkSession):
    """Lets Spark rely on the order of bucket files while plans in the block run."""
    before = spark.conf.get(_SORTED, None)
    spark.conf.set(_SORTED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SORTED)
        else:
            spark.conf.set(_SORTED, before)


class RunStore:
    """Levels of runs.  ``levels`` maps a name to (columns with types, keys, merge expressions).

    A merge expression gives a column of two merged rows from its names ``a`` and ``b``, of which
    one may be null.
    """

    def __init__(self, spark: SparkSession, levels: dict[str, tuple[str, list[str], dict[str, str]]], path: str | None = None, private: bool = False):
        self.spark, self.levels, self.path = spark, levels, path or fresh_path(spark, "runs")
        self.state: dict[str, dict] = {name: {"buckets": 0, "runs": []} for name in levels}
        self.tables: dict[str, str] = {}
        self.version, self.private = 0, private
        known = list_files(spark, f"{self.path}/manifest-*.json")
        if known:
            self.version = int(known[-1].rsplit("-", 1)[1].removesuffix(".json"))
            self.state = json.loads("".join(r["value"] for r in spark.read.text(known[-1]).collect()))
        elif path and list_files(spark, f"{self.path}/run-*"):
            raise ValueError(f"{self.path} holds runs but no manifest")

    def _table(self, level: str, run: str) -> str:
        """The catalog's name of a run."""
        if run not in self.tables:
            kind, keys, _ = self.levels[level]
            name, buckets = f"sightline_{uuid.uuid4().hex}", self.state[level]["buckets"]
            self.spark.sql(f"CREATE TABLE {name} ({kind}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{self.path}/{run}'")
            self.tables[run] = name
        return self.tables[run]

    def read(self, level: str, run: str) -> DataFrame:
        return self.spark.table(self._table(level, run))

    def write(self, level: str, rows: DataFrame, expected: int) -> str:
        """Writes rows with unique keys as a run, which no manifest names yet."""
        kind, keys, _ = self.levels[level]
        state = self.state[level]
        state["buckets"] = state["buckets"] or max(LEAST_BUCKETS, -(-expected // BUCKET_ROWS))
        run = f"run-{level}-{uuid.uuid4().hex}"
        names = [f.split()[0] for f in kind.split(", ")]
        with tidy(self.spark):
            rows.select(*names).repartition(state["buckets"], *keys).write.insertInto(self._table(level, run))
        return run

    def commit(self, added: dict[str, str]) -> None:
        """All runs of a step come in with one manifest, or none does."""
        self.state = {name: {"buckets": s["buckets"], "runs": s["runs"] + ([added[name]] if name in added else [])} for name, s in self.state.items()}
        self._write_manifest()

    def _write_manifest(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        to = path(f"{self.path}/manifest-{self.version + 1:08d}.json")
        temp = path(f"{self.path}/.manifest-{uuid.uuid4().hex}")
        fs = to.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(temp)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        if fs.exists(to) or not fs.rename(temp, to):
            raise OSError(f"another writer has made {to}")
        self.version += 1

    def _merged(self, level: str, runs: list[str]) -> DataFrame:
        """The rows of several runs with their keys merged."""
        kind, keys, merge = self.levels[level]
        out = self.read(level, runs[0])
        for run in runs[1:]:
            a, b = out.alias("a"), self.read(level, run).alias("b")
            on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
            cols = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys] + [F.expr(e.format(a=f"a.{c}", b=f"b.{c}")).alias(c) for c, e in merge.items()]
            out = a.join(b.hint("merge"), on, "full").select(*cols)
        return out

    def compact(self, level: str, max_runs: int) -> None:
        """One run instead of more than ``max_runs``.

        Old files stay, so that running readers are not disturbed, unless the store is private.
        """
        runs = self.state[level]["runs"]
        if len(runs) <= max_runs:
            return
        with merging(self.spark):
            whole = self.write(level, self._merged(level, runs), 0)
        self.state[level] = {"buckets": self.state[level]["buckets"], "runs": [whole]}
        self._write_manifest()
        for run in runs if self.private else []:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run)}")
            delete(self.spark, f"{self.path}/{run}")

    def beside(self, level: str, run: str) -> DataFrame:
        """The rows of a new run, with what earlier runs say of their keys in columns ``old_...``, null if nothing."""
        kind, keys, merge = self.levels[level]
        out, names = self.read(level, run), [*keys, *merge]
        rows = out.select(*names, *[F.lit(None).cast(out.schema[c].dataType).alias(f"old_{c}") for c in merge])
        for old in self.state[level]["runs"]:
            a, b = rows.alias("a"), self.read(level, old).alias("b")
            on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
            cols = [F.col(f"a.{n}").alias(n) for n in names] + [F.expr(e.format(a=f"a.old_{c}", b=f"b.{c}")).alias(f"old_{c}") for c, e in merge.items()]
            rows = a.join(b.hint("merge"), on, "left").select(*cols)
        return rows

    def close(self) -> None:
        """Forgets the catalog's names; files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = {}
