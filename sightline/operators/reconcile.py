"""Comparing what was written with what came back, manifests, and choosing among runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sightline.functions import names as N


class AmbiguousKey(ValueError):
    """Two expected images share a matching key."""


def check_keys(expected: DataFrame) -> None:
    twice = expected.groupBy(N.match_key(F.col("file_name")).alias("k")).count().filter("count > 1").count()
    if twice:
        raise AmbiguousKey(f"{twice} keys name more than one expected image")


def compare_export(expected: DataFrame, exported: DataFrame, augmented: bool = False) -> DataFrame:
    """(problem, name, from_split, to_split) for missing, extra, moved and boxes_changed.

    Both sides have (split, histogram), a sorted array of (label, n) structs; expected ones have
    file_name, exported ones source_name.  Of exported images with one key the first by source
    name, split and histogram counts.  With ``augmented`` train images may come back several
    times in train, with any boxes of the original's classes.
    """
    e = expected.select(N.match_key(F.col("file_name")).alias("k"), F.col("file_name").alias("name"), F.col("split").alias("want"), F.col("histogram").alias("had"))
    x = exported.select(N.match_key(F.col("source_name")).alias("k"), "source_name", F.col("split").alias("got"), F.col("histogram").alias("has"))
    x = x.withColumn("i", F.row_number().over(W.partitionBy("k").orderBy("source_name", "got", F.to_json("has"))))
    both = x.join(e, "k", "left")
    copies = F.lit(augmented) & F.coalesce(F.col("want") == "train", F.lit(False))
    classes = lambda c: F.transform(c, lambda s: s["label"])
    none = F.lit(None).cast("string")
    both = both.withColumn("copy", copies)
    extra = both.filter("want is null or (i > 1 and not copy)").select(F.lit("extra").alias("problem"), F.col("source_name").alias("name"), none.alias("from_split"), F.col("got").alias("to_split"))
    known = both.filter("want is not null and (i = 1 or copy)")
    moved = known.filter("want <> got").select(F.lit("moved"), "name", "want", "got")
    fresh = F.size(F.array_except(classes("has"), classes("had"))) > 0
    changed = known.filter(F.when(F.col("copy"), fresh).otherwise(F.col("has") != F.col("had"))).select(F.lit("boxes_changed"), "name", "want", "got")
    missing = e.join(x.select("k"), "k", "left_anti").select(F.lit("missing"), "name", "want", none)
    return extra.union(moved).union(changed).union(missing)


def compare_sizes(expected: DataFrame, reported: DataFrame) -> DataFrame:
    """(split, expected, reported) where the counts of (split, n) differ."""
    both = expected.select("split", F.col("n").alias("expected")).join(reported.select("split", F.col("n").alias("reported")), "split", "full_outer")
    return both.fillna(0, ["expected", "reported"]).filter("expected <> reported")


def verify_manifest(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) for missing, changed and unlisted files of (path, size, sha256)."""
    both = listed.select("path", F.struct("size", "sha256").alias("a")).join(found.select("path", F.struct("size", "sha256").alias("b")), "path", "full_outer")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unlisted").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", problem.alias("problem")).filter("problem is not null")


def manifest_digest(files: DataFrame) -> DataFrame:
    """(dir, n, digest): files of a folder as one digest of their lines in order of path."""
    line = F.concat_ws("  ", "sha256", F.col("size").cast("string"), "path")
    folder = F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1)
    rows = files.groupBy(folder.alias("dir")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("ls"))
    return rows.select("dir", "n", F.sha2(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), 256).alias("digest"))


def select_runs(runs: DataFrame, key: list[str], created: str = "created", dir_: str = "dir") -> DataFrame:
    """The newest clean, whole run of each key; the first folder wins a tie."""
    usable = runs.filter("not dirty and not sliced")
    return usable.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(created), dir_))).filter("_n = 1").drop("_n")


class NotReady(ValueError):
    """A dataset isn't fit to be handed over."""


def check_before_upload(images: DataFrame, reported: DataFrame, field: DataFrame | None, d: int) -> dict[str, int]:
    """Split sizes of (split, file_name, sha256, hash); raises where they aren't as reported, where names or
    contents repeat, or where an image is near a field-test hash."""
    from sightline.operators.hamming import near_hashes

    sizes = images.groupBy("split").agg(F.count("*").alias("n"))
    if wrong := compare_sizes(reported, sizes).orderBy("split").collect():
        raise NotReady("; ".join(f"{r['split']} has {r['reported']}, the report says {r['expected']}" for r in wrong))
    check_keys(images)
    copies = images.groupBy("sha256").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
    if copies:
        raise NotReady(f"{copies} images are byte-identical to another image")
    if field is not None and (n := near_hashes(images, field, d).count()):
        raise NotReady(f"{n} pairs of hashes match the field test")
    return {r["split"]: r["n"] for r in sizes.collect()}


def check_rescore(metrics: dict, meta: dict, model: str, dataset: str, split: str) -> bool:
    """Whether an earlier run, whose predictions are scored again, was dirty; raises if it scored something else."""
    had = tuple(metrics.get(k) for k in ("model", "dataset", "split"))
    if had != (model, dataset, split):
        raise NotReady(f"the earlier run scored {had}, not {(model, dataset, split)}")
    return bool(meta["git"]["dirty"] or meta.get("source_dirty", False))
