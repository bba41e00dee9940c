"""Row numbers within keys that may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.sources.tables import checkpoint


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with a column ``name``, their number from 1 within ``keys`` by ``order``.

    Rows are dealt to range partitions of keys and order, numbered within each, and
    the numbers of a key's earlier partitions added: a key of any size is numbered by
    many tasks. Null keys and orders are values, sorted first.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))  # a row for each key and partition
    base = base.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_at"), "_base")
    here = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    same = F.col("_part") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return ranged.withColumn("_here", here).join(base, same).withColumn(name, (F.col("_base") + F.col("_here")).cast("int")).select(*rows.columns, name)
