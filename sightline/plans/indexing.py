"""Global positions without a single sorted partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sightline.plans.store import materialize


def with_index(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with its 0-based position in ``order``.

    Rows are range-partitioned and numbered within partitions; only one count a partition is
    gathered to shift them.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    kept = materialize(ranged, "ranged")
    counts = kept.groupBy("_part").agg(F.count("*").alias("n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return kept.join(F.broadcast(starts), "_part").withColumn(name, own + F.col("_start")).drop("_part", "_start")
