"""Exact numbering that never puts one large group, or the whole table, into a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import written


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of each row inside its key group (or the whole table when ``keys`` is empty).

    Rows are range-partitioned on keys and order, so a hot group spans many partitions. Each range is numbered on
    its own and shifted by the number of rows of the same group in earlier ranges. The ranges are written down
    first: the range number has to stay the same for both uses. ``keys`` must not be NULL.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_range = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    ranges = written(by_range.withColumn("_range", F.spark_partition_id()), "ranges")
    cell = [*keys, "_range"]
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per range and group: the window below is as small as the number of ranges.
    shift = ranges.groupBy(*cell).agg(F.count("*").alias("_n")).select(
        *cell, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    numbered = ranges.withColumn("_inside", inside).join(shift, cell)
    return numbered.withColumn(name, F.col("_inside") + F.col("_shift")).drop("_range", "_inside", "_shift")


def with_new_ids(rows: DataFrame, existing: DataFrame, order: list[Column], id_column: str = "id") -> DataFrame:
    """Give rows the ids after the largest existing one, in the stated order."""
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("bigint")).scalar()
    plain = rows.drop(id_column) if id_column in rows.columns else rows
    return ranked(plain, [], order, "_n").withColumn(id_column, top + F.col("_n")).drop("_n")
