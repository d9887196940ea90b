"""Mergeable states: stored day by day, and summaries with a proven error.

* ``DayStates`` (R6 and the aggregate queries): for every day and value of a dimension the
  additive parts of the metrics (counts and sums), with a distinct-count sketch and a
  quantile sketch on the day's total row, and the day's fares as (fare, count) pairs.  The
  states lie in one partition a month (or another period).  Adding a day reads that day's
  bookings and the states of its period, and rewrites that partition; every report is a sum
  over the states.
* ``column_sketches`` (Q6): distinct counts by HyperLogLog and the commonest values by
  Misra-Gries counters, both combined from per-task states of fixed size.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import running_totals
from ..session import scratch_path, ship
from .report import DIMENSIONS, TOTAL, long_form

DAY = "day"
SUMS = ["bookings", "fare_sum", "fare_n", "cancelled", "satisfaction_sum", "satisfaction_n"]
COMPLAINT_DIMENSIONS = ["category", "airline", "booking_channel"]
#: Values that a task counts per column: no count is short by more than rows / (COUNTERS + 1).
COUNTERS = 1000


def _day_sets(df: DataFrame, dims: list[str], aggs: list) -> DataFrame:
    """(day, dimension, value, aggs...) per single dimension and in total, in one aggregation."""
    day = F.col(DAY)
    agg = (df.groupingSets([[day, F.col(d)] for d in dims] + [[day]], DAY, *dims)
           .agg(*aggs, *[F.grouping(d).alias(f"_g_{d}") for d in dims]))
    names = [c for c in agg.columns if c not in dims and not c.startswith("_g_") and c != DAY]
    return long_form(agg, dims, [DAY, *names])


class DayStates:
    """The stored states below ``path``: tables ``metrics``, ``complaints`` and ``fares`` by day."""

    def __init__(self, spark: SparkSession, path: str, period: str = "yyyy-MM"):
        self.spark, self.path, self.period = spark, path.rstrip("/"), period

    def _write(self, df: DataFrame, name: str) -> None:
        """Put the states in, instead of those of the same days; only their periods are rewritten."""
        path = f"{self.path}/{name}"
        df = df.withColumn("period", F.date_format(DAY, self.period))
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            aside = scratch_path(self.spark, f"states-{uuid.uuid4().hex[:12]}")
            df.write.parquet(aside)
            df = self.spark.read.parquet(aside)
            days = F.broadcast(df.select(F.col(DAY).alias("_d"), F.col("period").alias("_m")).distinct())   # the calendar
            periods = days.select("_m").distinct()
            old = self.spark.read.schema(df.schema).parquet(path)
            old = old.join(periods, F.col("period").eqNullSafe(F.col("_m")), "left_semi")
            df = df.unionByName(old.join(days, F.col(DAY).eqNullSafe(F.col("_d")), "left_anti"))
        (df.repartition("period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("period").parquet(path))

    def add(self, fa: DataFrame, tagged: DataFrame, date: str = "booking_date") -> None:
        """Add (or replace) the days of ``fa`` and of its tagged complaints; reads nothing else.

        A row without a date belongs to the day null, in a partition of its own.
        """
        day = F.col(date).cast("date")
        rows, told = fa.withColumn(DAY, day), tagged.withColumn(DAY, day)
        fare, sat = F.col("total_fare_inr"), F.col("satisfaction_score")
        sums = [F.count(F.lit(1)).alias("bookings"), F.sum(fare).alias("fare_sum"), F.count(fare).alias("fare_n"),
                F.sum("is_cancelled").cast("bigint").alias("cancelled"),
                F.sum(sat).alias("satisfaction_sum"), F.count(sat).alias("satisfaction_n")]
        sketches = [F.hll_sketch_agg("route").alias("routes"),
                    F.kll_sketch_agg_double(fare.cast("double")).alias("fares")]
        made = _day_sets(rows, DIMENSIONS, sums)
        total = rows.groupBy(DAY).agg(*sketches)
        self._write(made.join(total.withColumn("dimension", F.lit(TOTAL)).withColumnRenamed(DAY, "_d"),
                              (made[DAY].eqNullSafe(F.col("_d"))) & (made["dimension"] == F.lit(TOTAL)), "left")
                    .select(DAY, made["dimension"], "value", *SUMS, "routes", "fares"), "metrics")
        self._write(_day_sets(told, COMPLAINT_DIMENSIONS, [F.count(F.lit(1)).alias("complaints")]), "complaints")
        self._write(rows.where(fare.isNotNull()).groupBy(DAY, fare.alias("fare")).agg(F.count(F.lit(1)).alias("n")),
                    "fares")

    def _read(self, name: str, days: tuple | None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}")
        return df if days is None else df.where(F.col(DAY).between(*[F.lit(d).cast("date") for d in days]))

    def dimension_metrics(self, days: tuple | None = None) -> DataFrame:
        """``report.dimension_metrics`` of all days, or of those from ``days[0]`` to ``days[1]``."""
        merged = (self._read("metrics", days).groupBy("dimension", "value")
                  .agg(*[F.sum(c).alias(c) for c in SUMS], F.min(DAY).alias("first_date"), F.max(DAY).alias("last_date")))
        return merged.select(
            "dimension", "value", "bookings", F.col("fare_sum").alias("revenue"),
            F.try_divide("fare_sum", "fare_n").alias("avg_fare"),
            (F.col("cancelled") / F.col("bookings")).alias("cancel_rate"),
            F.try_divide(F.col("satisfaction_sum").cast("double"), F.col("satisfaction_n")).alias("avg_satisfaction"),
            "cancelled", "first_date", "last_date")

    def complaint_metrics(self, days: tuple | None = None) -> DataFrame:
        return (self._read("complaints", days).groupBy("dimension", "value")
                .agg(F.sum("complaints").alias("complaints")))

    def median_fare(self, days: tuple | None = None) -> DataFrame:
        """One row ``median_fare``: exact and interpolated, from the (fare, count) pairs."""
        pairs = (self._read("fares", days).groupBy(F.col("fare").cast("double").alias("fare"))
                 .agg(F.sum("n").cast("bigint").alias("n")))
        upto = running_totals(pairs, F.col("fare").asc(), ["n"])
        half = (pairs.agg(F.sum("n")).first()[0] or 0) - 1
        low, high = half // 2, -(-half // 2)              # the two middle places, from 0
        at = [F.min(F.when(F.col("n_cum") > p, F.col("fare"))) for p in (low, high)]
        return upto.agg(((at[0] + at[1]) / 2).alias("median_fare"))

    def approximate(self, days: tuple | None = None) -> DataFrame:
        """One row from the sketches alone: distinct routes and the fare quartiles."""
        total = self._read("metrics", days).where(F.col("dimension") == TOTAL)
        one = total.agg(F.hll_union_agg("routes").alias("r"), F.kll_merge_agg_double("fares").alias("f"))
        return one.select(F.hll_sketch_estimate("r").alias("routes"), *[
            F.kll_sketch_get_quantile_double("f", F.lit(q)).alias(f"fare_q{int(100 * q)}") for q in (0.25, 0.5, 0.75)])


def _frequent(counters: int, columns: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: Counter() for c in columns}
        short = dict.fromkeys(columns, 0)
        for batch in batches:
            for c in columns:
                counts = batch.column(c).drop_null().value_counts()
                held[c].update(dict(zip(counts.field(0).to_pylist(), counts.field(1).to_pylist())))
                if len(held[c]) > counters:
                    # Every count pays the (counters + 1)-th largest: at least that many rows per
                    # unit of the shortfall are gone, hence the bound.
                    cut = sorted(held[c].values(), reverse=True)[counters]
                    short[c] += cut
                    held[c] = Counter({v: n - cut for v, n in held[c].items() if n > cut})
        rows = [(c, v, n, 0) for c in columns for v, n in held[c].items()]
        rows += [(c, None, 0, short[c]) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["column_name", "value", "n", "short"])
    return count


def column_sketches(df: DataFrame, columns: list[str], counters: int = COUNTERS) -> DataFrame:
    """Q6 at scale: rows, nulls, distinct count by sketch, commonest value with both bounds.

    ``top_low`` <= true count of ``top_value`` <= ``top_high``, and no other value's count is above
    ``top_high``; ``top_high`` - ``top_low`` is at most rows / (counters + 1), and 0 where a
    column has no more than ``counters`` values.  Ties go to the smaller value.
    """
    ship(df.sparkSession)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    one = text.agg(F.count(F.lit(1)).alias("rows"),
                   *[x for c in columns for x in (F.count(c).alias(f"{c}__n"), F.hll_sketch_agg(c).alias(f"{c}__h"))])
    stats = one.select("rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("non_null"),
                 F.hll_sketch_estimate(f"{c}__h").alias("approx_distinct")) for c in columns])).alias("s")).select("rows", "s.*")
    found = (text.mapInArrow(_frequent(counters, columns), "column_name string, value string, n long, short long")
             .groupBy("column_name", "value").agg(F.sum("n").alias("n"), F.sum("short").alias("short")))
    short = Window.partitionBy("column_name")
    best = (found.withColumn("short", F.sum("short").over(short)).where(F.col("value").isNotNull())
            .withColumn("k", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value")))
            .where("k = 1").select("column_name", F.col("value").alias("top_value"), F.col("n").alias("top_low"),
                                   (F.col("n") + F.col("short")).alias("top_high")))
    return (stats.join(best, "column_name", "left")
            .select("column_name", "rows", (F.col("rows") - F.col("non_null")).alias("nulls"), "approx_distinct",
                    "top_value", "top_low", "top_high"))
