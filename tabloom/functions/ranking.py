"""Dense positions in a global sort order, without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import local_frame, scratch_path


def sorted_positions(df: DataFrame, key: str, position: str, path: str | None = None) -> DataFrame:
    """Distinct non-null values of *key* with their 0-based rank, as a written table.

    Values are range-partitioned and written once; each file-level partition id
    is then data, so a lost executor cannot change it. Ranks are the rank
    inside a partition plus the number of values in the partitions before it.
    """
    spark = df.sparkSession
    stage = scratch_path(spark, "sorted")
    (
        df.select(key).filter(F.col(key).isNotNull()).distinct()
        .repartitionByRange(key)
        .withColumn("_part", F.spark_partition_id())
        .write.parquet(stage)
    )
    staged = spark.read.parquet(stage)
    # one row per partition: the running total over them is tiny by construction
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    ranked = (
        staged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
        .join(offsets, "_part")
        .select(key, (F.col("_offset") + F.col("_rank") - 1).cast("bigint").alias(position))
    )
    target = path or scratch_path(spark, "positions")
    ranked.write.parquet(target)
    return spark.read.parquet(target)


def numbered_rows(df: DataFrame, order: Sequence[Column], position: str) -> DataFrame:
    """All rows of *df* with their 0-based place in *order*, which must not leave ties.

    Rows are range-partitioned and written once with the number of their range; a place is the rank
    inside the range plus the rows of the ranges before. One count per range reaches the driver.
    """
    spark = df.sparkSession
    stage = scratch_path(spark, "ranges")
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(stage)
    staged = spark.read.schema(f"{df.schema.toDDL()}, _range int" if df.columns else "_range int").parquet(stage)
    rows, total = [], 0
    for r in sorted(staged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()):
        rows.append((r["_range"], total))
        total += r["n"]
    before = local_frame(spark, rows, "_range int, _before bigint")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return staged.withColumn("_rank", rank).join(before, "_range").withColumn(
        position, F.col("_before") + F.col("_rank") - 1).drop("_range", "_rank", "_before")
