"""Near-duplicate search on 64-bit hashes within a Hamming distance, as exact keyed equi-joins.

Of d + m blocks of bits, two hashes within d bits agree on m at least, so an equi-join on every
choice of m blocks finds every pair.  With more hashes m rises: keys get longer, and their lists
stay short.  Equal hashes are merged first: a group of copies is one row of the join and is only
expanded where pairs are asked for.

Sides of joins grow with the data, and compressed files and posted keys look smaller to the planner
than they are; so they are always shuffled, never broadcast through the driver.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sightline.plans.store import materialize, shuffled

MAX_DISTANCE, MOST_BLOCKS = 15, 4


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def blocks_to_agree(hashes: int, d: int) -> int:
    """The least m whose keys are long enough to tell that many hashes apart."""
    for m in range(1, MOST_BLOCKS):
        if 2 ** (64 * m // (d + m)) >= hashes:
            return m
    return MOST_BLOCKS


def keys(hash_: Column, d: int, m: int = 1) -> Column:
    """An array of (choice, bits) structs, one for each choice of m of the d + m blocks."""
    n = d + m
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    chosen = [sum(masks[i] for i in c) for c in itertools.combinations(range(n), m)]
    return F.array(*[F.struct(F.lit(i).alias("choice"), hash_.bitwiseAND(F.lit(signed(mask)).cast("long")).alias("bits")) for i, mask in enumerate(chosen)])


def near_hashes(left: DataFrame, right: DataFrame, d: int, hash_: str = "hash") -> DataFrame:
    """Distinct (a, b, distance) with a from the left, b from the right and distance <= d."""
    if d > MAX_DISTANCE:
        raise ValueError(f"keys don't tell hashes apart beyond {MAX_DISTANCE} bits; use a smaller distance")
    once = lambda df: materialize(df.select(F.col(hash_).alias("h")).filter("h is not null").distinct(), "hashes")
    sides = [once(left)]
    sides = [sides[0].withColumnRenamed("h", "a"), (sides[0] if right is left else once(right)).withColumnRenamed("h", "b")]
    m = blocks_to_agree(max(s.count() for s in sides), d)
    posted = [s.select(n, F.explode(keys(F.col(n), d, m)).alias("k")) for s, n in zip(sides, ("a", "b"), strict=True)]
    found = posted[0].join(shuffled(posted[1]), "k").select("a", "b").withColumn("distance", distance(F.col("a"), F.col("b")))
    return found.filter(F.col("distance") <= d).distinct()


def near_pairs(df: DataFrame, d: int, id_: str, hash_: str = "hash") -> DataFrame:
    """(id_a, id_b, distance) of all pairs within d bits, each once with id_a < id_b."""
    same = near_hashes(df, df, d, hash_)
    rows = df.select(F.col(id_).alias("id"), F.col(hash_).alias("h"))
    out = same.join(shuffled(rows.select(F.col("id").alias("id_a"), F.col("h").alias("a"))), "a").join(shuffled(rows.select(F.col("id").alias("id_b"), F.col("h").alias("b"))), "b")
    return out.filter("id_a < id_b").select("id_a", "id_b", "distance")


def pairs_between(left: DataFrame, right: DataFrame, d: int, id_: str, hash_: str = "hash") -> DataFrame:
    """(id_a, id_b, distance) of all pairs of a row of the left and one of the right within d bits."""
    sides = [df.select(F.col(id_).alias(i), F.col(hash_).alias(h)) for df, i, h in ((left, "id_a", "a"), (right, "id_b", "b"))]
    return near_hashes(left, right, d, hash_).join(shuffled(sides[0]), "a").join(shuffled(sides[1]), "b").select("id_a", "id_b", "distance")


def near_links(df: DataFrame, d: int, id_: str, hash_: str = "hash") -> DataFrame:
    """Edges that connect what ``near_pairs`` connects, without expanding groups of equal hashes."""
    least = df.filter(F.col(hash_).isNotNull()).groupBy(F.col(hash_).alias("h")).agg(F.min(id_).alias("rep"))
    copies = df.join(shuffled(least), F.col(hash_) == F.col("h")).filter(F.col(id_) != F.col("rep")).select(F.col(id_).alias("src"), F.col("rep").alias("dst"))
    a, b = (least.select(F.col("h").alias(c), F.col("rep").alias(r)) for c, r in (("a", "src"), ("b", "dst")))
    return near_hashes(df, df, d, hash_).filter("a < b").join(shuffled(a), "a").join(shuffled(b), "b").select("src", "dst").union(copies)


def near_any(candidates: DataFrame, protected: DataFrame, d: int, views: str = "views", hash_: str = "hash") -> DataFrame:
    """Candidates of whose view hashes any lies within d bits of a protected hash.

    Candidates are told apart by their views alone, since equal views are near the same hashes.
    """
    each = candidates.select(F.col(views).alias("_views")).filter(F.size("_views") > 0).distinct()
    posted = materialize(each.select("_views", F.explode("_views").alias("a")), "views")
    hit = near_hashes(posted.select(F.col("a").alias(hash_)), protected, d, hash_).select("a").distinct()
    near = posted.join(shuffled(hit), "a", "left_semi").select("_views").distinct()
    return candidates.join(shuffled(near), F.col(views) == F.col("_views"), "left_semi")


def near_test(df: DataFrame, d: int, split: str = "split", hash_: str = "hash") -> DataFrame:
    """Rows outside the test split within d bits of a test row."""
    outside, test = df.filter(F.col(split) != "test"), df.filter(F.col(split) == "test")
    hit = near_hashes(outside, test, d, hash_).select(F.col("a").alias(hash_)).distinct()
    return outside.join(shuffled(hit), hash_, "left_semi").select(*df.columns)


class SplitLeak(ValueError):
    """Rows outside test are near duplicates of test rows."""


def check_no_leak(df: DataFrame, d: int, id_: str) -> None:
    found = near_test(df, d)
    if n := found.count():
        raise SplitLeak(f"{n} rows near a test row, first {found.agg(F.min(id_)).first()[0]}")


def exact_members(df: DataFrame, content: str, id_: str) -> DataFrame:
    """(sha256, id, first, copies): every row whose content others hold too, and the least id that does."""
    keyed = df.select(F.sha2(F.col(content), 256).alias("sha256"), F.col(id_).alias("id"))
    shared = keyed.groupBy("sha256").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    return keyed.join(shuffled(shared), "sha256").select("sha256", "id", "first", "copies")


def exact_groups(df: DataFrame, content: str, id_: str) -> DataFrame:
    """(sha256, ids) as lists, for reports; a group is one row, so use exact_members where groups may be large."""
    return exact_members(df, content, id_).groupBy("sha256").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def pair_kind(dataset_a: Column, dataset_b: Column, split_a: Column, split_b: Column) -> Column:
    return F.when(dataset_a != dataset_b, "cross_dataset").when(split_a != split_b, "cross_split").otherwise("within_split")


def summarize_pairs(pairs: DataFrame, refs: DataFrame, id_: str) -> DataFrame:
    """(kind, side_a, side_b, n): pairs by kind and by their sides (dataset/split) in order."""
    side = lambda c, k: refs.select(F.col(id_).alias(c), F.col("dataset").alias(f"d{k}"), F.col("split").alias(f"s{k}"))
    both = pairs.join(shuffled(side("id_a", "a")), "id_a").join(shuffled(side("id_b", "b")), "id_b")
    return _by_sides(both.withColumn("n", F.lit(1)))


def pair_examples(pairs: DataFrame, refs: DataFrame, id_: str, n: int) -> DataFrame:
    """(kind, id_a, id_b): the first n pairs of each kind, in order of their ids."""
    side = lambda c, k: refs.select(F.col(id_).alias(c), F.col("dataset").alias(f"d{k}"), F.col("split").alias(f"s{k}"))
    both = pairs.join(shuffled(side("id_a", "a")), "id_a").join(shuffled(side("id_b", "b")), "id_b")
    told = both.select(pair_kind(F.col("da"), F.col("db"), F.col("sa"), F.col("sb")).alias("kind"), "id_a", "id_b")
    return told.withColumn("_n", F.row_number().over(W.partitionBy("kind").orderBy("id_a", "id_b"))).filter(F.col("_n") <= n).drop("_n")


def _by_sides(both: DataFrame) -> DataFrame:
    a, b = F.concat_ws("/", "da", "sa"), F.concat_ws("/", "db", "sb")
    told = both.select(pair_kind(F.col("da"), F.col("db"), F.col("sa"), F.col("sb")).alias("kind"), F.least(a, b).alias("side_a"), F.greatest(a, b).alias("side_b"), "n")
    return told.groupBy("kind", "side_a", "side_b").agg(F.sum("n").cast("long").alias("n")).filter("n > 0")


def count_pairs(df: DataFrame, d: int, hash_: str = "hash") -> DataFrame:
    """What summarize_pairs tells of near_pairs, from counts by hash and side; no pair of copies is made."""
    sides = materialize(df.groupBy(F.col(hash_).alias("h"), "dataset", "split").agg(F.count("*").alias("c")).filter("h is not null"), "sides")
    left, right = (sides.select(F.col("h").alias(h), F.col("dataset").alias(f"d{k}"), F.col("split").alias(f"s{k}"), F.col("c").alias(f"c{k}")) for h, k in (("a", "a"), ("b", "b")))
    cross = near_hashes(df, df, d, hash_).filter("a < b").join(shuffled(left), "a").join(shuffled(right), "b").withColumn("n", F.col("ca") * F.col("cb"))
    place = lambda k: F.struct(f"d{k}", f"s{k}")
    same = left.join(shuffled(right.withColumnRenamed("b", "a")), "a").filter(place("a") <= place("b"))
    same = same.withColumn("n", F.when(place("a") == place("b"), F.expr("ca * (ca - 1) div 2")).otherwise(F.col("ca") * F.col("cb")))
    cols = ["da", "sa", "db", "sb", "n"]
    return _by_sides(cross.select(*cols).union(same.select(*cols)))
