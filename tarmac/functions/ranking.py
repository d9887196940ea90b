"""Position of a row inside its group without putting a whole group in one task.

``row_number() OVER (PARTITION BY key ORDER BY ...)`` sends every row of a key to one
task; a customer holding a third of all orders would then be sorted by one core.  Here
the rows are range-partitioned on ``(key, order...)`` so a hot key is cut into many
contiguous slices, each slice numbers its own rows, and a per-(slice, key) count table
(at most one row per slice for any key) supplies the offset of the earlier slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def position_in_group(df: DataFrame, key: str, order: list[str | Column], out: str,
                      num_slices: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based rank of the row within ``key`` by ``order`` (ties must not exist).

    Equal to ``row_number() OVER (PARTITION BY key ORDER BY order) - 1``.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_slices or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                          spark.sparkContext.defaultParallelism)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    # Range partitioning samples the sort key, so one heavy key spans several slices.
    # The slice id depends on the physical layout, so it is frozen by a reliable
    # checkpoint (shared checkpoint folder) before it is read twice below.
    sliced = (df.repartitionByRange(n, F.col(key), *order_cols)
              .withColumn("_slice", F.spark_partition_id())
              .checkpoint(eager=True))
    # Rows of one key in earlier slices: the count table has <= n rows per key.
    counts = sliced.groupBy("_slice", key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_slice", key,
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # Within one slice a (slice, key) group is bounded by the slice size.
    local = F.row_number().over(Window.partitionBy("_slice", key).orderBy(*order_cols)) - 1
    return (sliced.withColumn("_local", local)
            .join(offsets, ["_slice", key])
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_slice", "_local", "_off"))


def running_totals(df: DataFrame, order: Column, sums: list[str], suffix: str = "_cum",
                   num_slices: int | None = None) -> DataFrame:
    """Add ``<c><suffix>`` = sum of ``c`` over every row up to this one in ``order``.

    Equal to ``sum(c) OVER (ORDER BY order ROWS UNBOUNDED PRECEDING)`` (order keys must
    be distinct) without that window's single task: rows are range-partitioned on the
    order, each slice sums its own rows, and the totals of earlier slices (a table of
    one row per slice) give the offset.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_slices or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                          spark.sparkContext.defaultParallelism)
    sliced = (df.repartitionByRange(n, order)
              .withColumn("_slice", F.spark_partition_id())
              .checkpoint(eager=True))
    totals = sliced.groupBy("_slice").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # <= n rows
    offsets = totals.select("_slice", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0))
                                        .alias(f"_o_{c}") for c in sums])
    local = Window.partitionBy("_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (sliced.join(F.broadcast(offsets), "_slice")   # one row per slice: bounded by n
            .withColumns({f"{c}{suffix}": F.col(f"_o_{c}") + F.sum(c).over(local) for c in sums})
            .drop("_slice", *[f"_o_{c}" for c in sums]))
