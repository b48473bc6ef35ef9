"""Near-duplicate vectors by product quantisation with coarse inverted lists.

* Equal vectors of one label form a class; one of them stands for all.
* Coarse centroids and residual subspace codebooks are fitted on a bounded sample of at most
  ``SAMPLE`` unit vectors.  Every vector is indexed: it lies in the list of its nearest centroid
  with a code for each subspace and the length of what the code leaves out.  There is a list for
  every ``PER_LIST`` vectors; beyond ``FIRST`` lists, a second level divides what the first leaves
  out, alike in all its cells, so that lists grow with the data and not with the sample.
* A query probes its own list and those of higher number whose cell it may reach: the distance to
  the plane that bounds a cell is at most the share ``reach`` of the wanted distance.  With 1.0, no
  link can be missed.  A lower share relies on the difference of two vectors to point along the
  plane's normal by no more than that; a random direction in d dimensions does so with a deviation
  of 1 / sqrt(d), and the default is DEVIATIONS of these, 0.6 in 64 dimensions (a chance of 1e-6 to
  go beyond), and 1.0 below 24.
* In a list, table look-ups give the asymmetric distance to every code.  A vector survives if that
  is at most the wanted distance plus what its code leaves out, a triangle inequality.  Survivors
  are confirmed by cosine in double precision.

Lists are cut into blocks of rows and of queries.  A block pair gives partial link counts and the
links of a spanning forest, never all its pairs.

Defined cases: null, empty or zero vectors, those with null or non-finite components, and rows with
a null label or id link with nothing and are kept; vectors of different lengths never link; a
repeated row counts once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import kernels as K
from sightline.operators.components import connected_components
from sightline.plans.store import materialize

SAMPLE, SUBSPACES, CODES, PER_LIST, FIRST, ROUNDS = 16_384, 8, 64, 256, 1024, 8
DEVIATIONS = 4.8
ROWS, QUERIES = 2048, 4096
SLACK = 1e-4


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of the sample; empty centroids stay where they are."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=np.int64)


class Quantiser:
    """Two levels of coarse centroids and one codebook a subspace, for vectors padded with zeros to ``dim``."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES):
        self.dim = sample.shape[1]
        self.levels, rest = [], sample
        for n in (min(lists, FIRST), -(-lists // FIRST)):
            c = kmeans(rest, min(n, len(sample)))
            rest = rest - c[nearest(rest, c)]
            self.levels.append((c, np.sqrt(distances(c, c))))
        self.cuts = [slice(self.dim * i // subspaces, self.dim * (i + 1) // subspaces) for i in range(subspaces)]
        self.books = [kmeans(rest[:, c], min(codes, len(sample))) for c in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and the length of what the codes leave out, of each unit vector."""
        (first, _), (second, _) = self.levels
        one = nearest(x, first)
        rest = x - first[one]
        two = nearest(rest, second)
        rest = rest - second[two]
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1)
        told = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return one * len(second) + two, codes.astype(np.uint8), np.sqrt(((rest - told) ** 2).sum(1))

    @staticmethod
    def _reached(x: np.ndarray, level: tuple[np.ndarray, np.ndarray], radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells of a level that can hold a vector within ``radius`` of each row."""
        c, gaps = level
        out = []
        step = max(1, 4_000_000 // len(c))
        for at in range(0, len(x), step):
            d = distances(x[at : at + step], c)
            own = d.argmin(1)
            row, cell = np.nonzero(d - d[np.arange(len(d)), own][:, None] <= 2 * (radius + SLACK) * gaps[own] + SLACK)
            out.append((row + at, cell))
        return tuple(np.concatenate(p) for p in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 2

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that can hold a vector within ``radius`` of each row."""
        row, one = self._reached(x, self.levels[0], radius)
        at, two = self._reached(x[row] - self.levels[0][0][one], self.levels[1], radius)
        return row[at], one[at] * len(self.levels[1][0]) + two

    def tables(self, x: np.ndarray, which: int) -> np.ndarray:
        """(rows, subspaces, codes) squared distances of the residuals in one list."""
        (first, _), (second, _) = self.levels
        rest = x - first[which // len(second)] - second[which % len(second)]
        out = np.full((len(x), len(self.books), max(map(len, self.books))), np.inf)
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[:, i, : len(b)] = distances(rest[:, c], b)
        return out


def _vectors(column, dim: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else []] = lists.flatten().to_numpy()
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow
    return x / np.sqrt((x * x).sum(1))[:, None]


#: Columns of the index beside the vector itself, which keeps the type it came with.
INDEXED = "label string, dim int, list int, query boolean, rep long, weight long, codes binary, left double"


def _index(shared, radius: float, reach: float, kind: pa.DataType):
    """Each class once as a row of its list and once as a query of every list it probes."""
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("list", pa.int32()), ("query", pa.bool_()), ("rep", pa.int64()), ("weight", pa.int64()), ("codes", pa.binary()), ("left", pa.float64()), ("v", pa.list_(kind))])

    def run(batches):
        q = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = pa.Table.from_batches([batch.slice(at, 1024)])
                x = _unit(_vectors(part["v"], q.dim))
                own, codes, left = q.encode(x)
                row, which = q.probes(x, reach * radius)
                up = which >= own[row]  # a pair in two lists is found from the lower one
                row, which = row[up], which[up]
                take = np.concatenate([np.arange(len(x)), row])
                base = np.arange(len(take)) < len(x)
                t = part.take(pa.array(take))
                told = [codes[i].tobytes() if b else None for i, b in zip(take, base, strict=True)]
                arrays = [t["label"], t["dim"], pa.array(np.concatenate([own, which]).astype(np.int32)), pa.array(~base), t["rep"], t["weight"], pa.array(told, pa.binary()), pa.array(np.where(base, left[take], np.concatenate([own, which]) == own[take])), t["v"].cast(pa.list_(kind))]
                yield from pa.Table.from_arrays([a if isinstance(a, pa.ChunkedArray) else pa.chunked_array([a]) for a in arrays], schema=schema).to_batches()

    return run


def _search(shared, least: float, radius: float):
    """One block of rows and one of queries of a list: link counts, and links of a spanning forest."""
    schema = K.columns("rep long, links long, other long")

    def run(key, t):
        q = shared.value
        which = key[2].as_py()
        is_query = t["query"].to_numpy()
        x, reps, weight = _vectors(t["v"], q.dim), t["rep"].to_numpy(), t["weight"].to_numpy()
        unit = _unit(x) if len(x) else x
        base = np.flatnonzero(~is_query)
        codes = np.frombuffer(b"".join(c for c in t["codes"].to_pylist() if c is not None), dtype=np.uint8).reshape(len(base), -1)
        bound = (radius + t["left"].to_numpy()[base] + SLACK) ** 2
        parent: dict[int, int] = {}
        links: list[tuple[int, int, int]] = []
        counted: list[tuple[np.ndarray, np.ndarray]] = []

        def root(a: int) -> int:
            while parent.setdefault(a, a) != a:
                parent[a] = a = parent[parent[a]]
            return a

        queries = np.flatnonzero(is_query)
        inside = t["left"].to_numpy()[queries] > 0  # for queries, whether this is their own list
        for at in range(0, len(queries) if len(base) else 0, 128):
            own, local = queries[at : at + 128], inside[at : at + 128]
            tables = q.tables(unit[own], which)
            adc = np.zeros((len(own), len(base)))
            for m in range(codes.shape[1]):
                adc += tables[:, m, :][:, codes[:, m]]
            a, b = np.nonzero((adc <= bound) & (~local[:, None] | (reps[own][:, None] < reps[base][None, :])))
            for lo in range(0, len(a), 65_536):
                i, j = own[a[lo : lo + 65_536]], base[b[lo : lo + 65_536]]
                good = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
                i, j = i[good], j[good]
                if not len(i):
                    continue
                counted.append(_summed(np.concatenate([reps[i], reps[j]]), np.concatenate([weight[j], weight[i]])))
                for one, two in zip(reps[i].tolist(), reps[j].tolist(), strict=True):
                    if (r := root(one)) != (s := root(two)):
                        parent[r] = s
                        links.append((one, 0, two))
        sums = _summed(*(np.concatenate(c) for c in zip(*counted, strict=True))) if counted else (np.zeros(0, dtype=np.int64),) * 2
        extra = np.array(links, dtype=np.int64).reshape(-1, 3)
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in ((sums[0], extra[:, 0]), (sums[1], extra[:, 1]), (np.full(len(sums[0]), -1), extra[:, 2]))], schema=schema)

    return run


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(k), dtype=np.int64)
    np.add.at(out, at, values)
    return k, out


def near_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rows: int = ROWS, queries: int = QUERIES, per_list: int = PER_LIST, reach: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    told = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    told = told.withColumn("fine", fine)
    usable = told.filter("fine").select("vec_id", "label", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    classes = materialize(usable.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("weight")), "vectors")
    dim, n = classes.agg(F.max(F.size("v")), F.count("*")).first()
    parts = None
    if n:
        lists = max(1, -(-n // per_list))
        step = max(1, 2 * n // SAMPLE)
        picked = classes.filter(F.pmod(F.xxhash64("rep"), F.lit(step)) == 0).select("rep", "v").limit(SAMPLE).collect() or classes.select("rep", "v").limit(64).collect()
        sample = np.zeros((len(picked), dim))
        for i, r in enumerate(sorted(picked)):
            sample[i, : len(r["v"])] = r["v"]
        shared = spark.sparkContext.broadcast(Quantiser(_unit(sample), lists))
        radius = math.sqrt(2 - 2 * least)
        reach = min(1.0, DEVIATIONS / math.sqrt(dim)) if reach is None else reach
        source = classes.select("label", F.size("v").alias("dim"), "rep", "weight", "v")
        single = isinstance(vectors.schema[vec_col].dataType, T.ArrayType) and isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType)
        kind, told_kind = (pa.float32(), "array<float>") if single else (pa.float64(), "array<double>")
        indexed = materialize(source.mapInArrow(_index(shared, radius, reach, kind), f"{INDEXED}, v {told_kind}"), "indexed")
        key = ["label", "dim", "list"]
        sizes = indexed.groupBy(*key).agg(F.count_if(~F.col("query")).alias("nr"), F.count_if("query").alias("nq")).filter("nr > 0 and nq > 0")
        dealt = indexed.join(sizes, key).withColumn("br", F.ceil(F.col("nr") / rows).cast("int")).withColumn("bq", F.ceil(F.col("nq") / queries).cast("int"))
        own = lambda n: F.array(F.pmod(F.xxhash64("rep"), F.col(n)).cast("int"))
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        dealt = dealt.withColumn("i", F.explode(F.when(F.col("query"), every("br")).otherwise(own("br")))).withColumn("j", F.explode(F.when(F.col("query"), own("bq")).otherwise(every("bq"))))
        parts = materialize(dealt.select(*key, "i", "j", "query", "rep", "weight", "v", "codes", "left").groupBy(*key, "i", "j").applyInArrow(_search(shared, least, radius), "rep long, links long, other long"), "links")
    out = classes.select("label", "v", "rep", "weight").withColumn("component", F.col("rep")).withColumn("links", F.lit(0))
    if parts is not None:
        counts = parts.filter("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
        found = connected_components(parts.filter("other >= 0 or links = 0").select("rep", "other"), "rep", "other").withColumnRenamed("node", "rep")
        out = classes.join(counts, "rep", "left").join(found, "rep", "left").select("label", "v", "rep", "weight", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    id_ = F.col("vec_id")
    keyed = told.withColumn("v", F.when(F.col("fine"), F.transform("v", lambda x: x + F.lit(0.0))))
    joined = keyed.join(out, ["label", "v"], "left")
    component = F.when(id_.isNotNull(), F.coalesce("component", id_))
    return joined.select("vec_id", F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == id_, F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE f AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), r AS (
  SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v
), c AS (SELECT v, min(c) AS c FROM r GROUP BY v), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings x JOIN c ON c.v = x.vec_id LEFT JOIN n ON n.a = x.vec_id
"""


def op8_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
