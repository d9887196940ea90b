"""The business-metrics context as ordered text lines, built from one-pass aggregates.

The context has ~25 blocks (revenue by airline, cancel rate by channel, monthly volume,
...).  Instead of one job per block, all dimension metrics come from ONE grouping-sets
aggregation over the feature table (its empty grouping set gives the grand totals),
complaint counts from a second one over the tagged complaints, and the headline row
from their total rows plus the exact median.  Each block is then a projection of those
small results, so the text costs two scans of the data and the median's passes.

Number formats follow the dashboard: ``{:,.0f}`` money, ``{:.2f}`` rates, pandas-style
rounding to 2 places before display where the dashboard rounds first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import order_dim, with_scalars
from ..functions.quantiles import quantiles
from ..session import checkpoint_dir
from ..schema import CABIN_ORDER, MONTHS_SHORT

SEP = "=" * 60
TITLE = "BOOKINGS DATASET — FULL BUSINESS METRICS CONTEXT"

DIMENSIONS = ["airline", "cabin_class", "booking_source", "booking_channel", "route",
              "booking_status", "trip_type", "booking_month_name", "customer_type"]


def money(c) -> Column:
    """'{:,.0f}' with thousands separators.  Amounts are sums of 2-decimal fares, so they
    are first rounded to 2 places: that removes summation-order noise and makes an exact
    .5 format the same (half to even) whatever order the partial sums arrived in."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.format_number(F.round(c, 2), 0), F.lit("nan"))


def fixed(c, d: int) -> Column:
    return F.coalesce(F.format_number(c, d), F.lit("nan"))


TOTAL = "__total__"   # dimension name of the grand-total row


def long_form(agg: DataFrame, dims: list[str], metrics: list[str]) -> DataFrame:
    """(dimension, value, metrics...) from a GROUPING SETS result: one row per non-NULL
    value of each single-dimension set, plus the grand-total row (dimension TOTAL)."""
    keep = dimension = value = None
    total = None
    for d in dims:
        on = F.col(f"_g_{d}") == 0
        c = on & F.col(d).isNotNull()
        keep = c if keep is None else keep | c
        dimension = F.when(on, F.lit(d)) if dimension is None else dimension.when(on, F.lit(d))
        value = F.when(on, F.col(d)) if value is None else value.when(on, F.col(d))
        off = F.col(f"_g_{d}") == 1
        total = off if total is None else total & off
    return (agg.where(keep | total)
            .select(dimension.otherwise(F.lit(TOTAL)).alias("dimension"), value.alias("value"), *metrics))


def dimension_metrics(fa: DataFrame, dims=tuple(DIMENSIONS)) -> DataFrame:
    """Long (dimension, value, metrics...) table for every dimension and the grand total,
    in one aggregation (GROUPING SETS with the empty set)."""
    dims = list(dims)
    metrics = ["bookings", "revenue", "avg_fare", "cancel_rate", "avg_satisfaction", "cancelled",
               "first_date", "last_date"]
    agg = (fa.groupingSets([[F.col(d)] for d in dims] + [[]], *dims)
           .agg(F.count(F.lit(1)).alias("bookings"),
                F.sum("total_fare_inr").alias("revenue"),
                F.avg("total_fare_inr").alias("avg_fare"),
                F.avg(F.col("is_cancelled").cast("double")).alias("cancel_rate"),
                F.avg("satisfaction_score").alias("avg_satisfaction"),
                F.sum("is_cancelled").cast("bigint").alias("cancelled"),
                F.min("booking_date").alias("first_date"), F.max("booking_date").alias("last_date"),
                *[F.grouping(d).alias(f"_g_{d}") for d in dims]))
    return long_form(agg, dims, metrics)


def complaint_metrics(tagged: DataFrame, dims=("category", "airline", "booking_channel")) -> DataFrame:
    """Complaint counts per value of each dimension and in total, in one aggregation."""
    dims = list(dims)
    agg = (tagged.groupingSets([[F.col(d)] for d in dims] + [[]], *dims)
           .agg(F.count(F.lit(1)).alias("complaints"), *[F.grouping(d).alias(f"_g_{d}") for d in dims]))
    return long_form(agg, dims, ["complaints"])


def headline(dm: DataFrame, cm: DataFrame, med: DataFrame) -> DataFrame:
    """One row of overall numbers from the grand-total rows of the two aggregates, the
    airline values of ``dm`` and the exact median fare (one row, ``median_fare``)."""
    g = dm.where(F.col("dimension") == TOTAL).select(
        F.col("bookings").alias("n"), "first_date", "last_date", "revenue",
        F.col("avg_fare").alias("mean_fare"), "cancel_rate", "cancelled", "avg_satisfaction")
    airlines = dm.where(F.col("dimension") == "airline").agg(
        F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("airlines"))
    c = cm.where(F.col("dimension") == TOTAL).select(F.col("complaints").alias("n_complaints"))
    return with_scalars(g, airlines, c, med)


class _Consts:
    """Fixed header lines, gathered into one small local frame."""

    def __init__(self):
        self.rows = []

    def __call__(self, spark, block: int, pos: int, text: str):
        self.rows.append((block, pos, text))
        return None

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "block int, pos bigint, line string")


def _rows(df: DataFrame, block: int, line: Column, order: list[Column], start: int = 1) -> DataFrame:
    """Item lines of one block, with a generic sort key (k1 numeric, k2 text).

    ``order`` is [numeric key] or [numeric key, text key]; descending keys are passed
    negated.  Positions are assigned later by ONE window over all blocks.
    """
    k1 = order[0].cast("double") if order else F.lit(0.0)
    k2 = order[1].cast("string") if len(order) > 1 else F.lit("")
    return df.select(F.lit(block).alias("block"), F.lit(start).cast("bigint").alias("_start"),
                     k1.alias("_k1"), k2.alias("_k2"), line.alias("line"))


def fact_lines(fa: DataFrame, tagged: DataFrame) -> DataFrame:
    """(block, pos, line) for the whole context; order by block, pos to read it."""
    med = quantiles(fa, "total_fare_inr", [0.5]).select(F.col("q")[0].alias("median_fare"))
    return lines_of(dimension_metrics(fa), complaint_metrics(tagged), med)


def lines_of(dm: DataFrame, cm: DataFrame, median: DataFrame) -> DataFrame:
    """The context's lines from the two aggregates and the median, scanned or stored."""
    spark = dm.sparkSession
    checkpoint_dir(spark)
    _const = _Consts()
    # The three aggregates are tiny (rows bounded by the vocabularies) but are read by
    # ~25 blocks with different filters; Catalyst would push each block's filter below
    # the aggregate and rescan the table per block.  A reliable checkpoint in the shared
    # folder computes each once and survives executor loss.
    dm = dm.checkpoint(eager=True)
    cm = cm.checkpoint(eager=True)
    h = headline(dm, cm, median).checkpoint(eager=True)

    def dim(name):
        return dm.where(F.col("dimension") == name)

    def cdim(name):
        return cm.where(F.col("dimension") == name)

    v, key = F.col("value"), F.col("value").asc()
    parts = [
        _const(spark, 0, 0, SEP), _const(spark, 0, 1, TITLE),
        h.select(F.lit(0).alias("block"), F.lit(2).cast("bigint").alias("pos"),
                 F.concat(F.lit("Total bookings: "), money("n")).alias("line")),
        h.select(F.lit(0).alias("block"), F.lit(3).cast("bigint").alias("pos"),
                 F.concat(F.lit("Date range: "), F.col("first_date").cast("string"), F.lit(" to "),
                          F.col("last_date").cast("string")).alias("line")),
        h.select(F.lit(0).alias("block"), F.lit(4).cast("bigint").alias("pos"),
                 F.concat(F.lit("Airlines: "), F.col("airlines")).alias("line")),
        _const(spark, 0, 5, SEP),
        _const(spark, 1, 0, "\n-- REVENUE --"),
        h.select(F.lit(1).alias("block"), F.lit(1).cast("bigint").alias("pos"),
                 F.concat(F.lit("Total revenue: INR "), money("revenue")).alias("line")),
        h.select(F.lit(1).alias("block"), F.lit(2).cast("bigint").alias("pos"),
                 F.concat(F.lit("Average fare per booking: INR "), money("mean_fare")).alias("line")),
        h.select(F.lit(1).alias("block"), F.lit(3).cast("bigint").alias("pos"),
                 F.concat(F.lit("Median fare: INR "), money("median_fare")).alias("line")),
        _const(spark, 2, 0, "Revenue by airline:"),
        _rows(dim("airline"), 2, F.concat(F.lit("  "), v, F.lit(": INR "), money("revenue")),
              [-F.col("revenue"), v]),
        _const(spark, 3, 0, "Revenue by cabin class:"),
        _rows(F.broadcast(order_dim(spark, "value", CABIN_ORDER)).join(dim("cabin_class"), "value", "left"),
              3, F.concat(F.lit("  "), v, F.lit(": INR "), money("revenue")), [F.col("ord")]),
        _const(spark, 4, 0, "Revenue by booking source (NDC vs GDS):"),
        _rows(dim("booking_source"), 4, F.concat(F.lit("  "), v, F.lit(": INR "), money("revenue")), [F.lit(0.0), v]),
        _const(spark, 5, 0, "Revenue by booking channel:"),
        _rows(dim("booking_channel"), 5, F.concat(F.lit("  "), v, F.lit(": INR "), money("revenue")),
              [-F.col("revenue"), v]),
        _const(spark, 6, 0, "Top 10 routes by revenue:"),
        _rows(dim("route").orderBy(F.col("revenue").desc(), key).limit(10), 6,
              F.concat(F.lit("  "), v, F.lit(": INR "), money("revenue")), [-F.col("revenue"), v]),
        _const(spark, 7, 0, "\n-- CANCELLATIONS --"),
        h.select(F.lit(7).alias("block"), F.lit(1).cast("bigint").alias("pos"),
                 F.concat(F.lit("Overall cancellation/refund rate: "), fixed(F.col("cancel_rate") * 100, 2),
                          F.lit("%")).alias("line")),
        h.select(F.lit(7).alias("block"), F.lit(2).cast("bigint").alias("pos"),
                 F.concat(F.lit("Total cancelled/refunded: "), money("cancelled"), F.lit(" of "), money("n"))
                 .alias("line")),
        _const(spark, 8, 0, "Booking status breakdown:"),
        _rows(with_scalars(dim("booking_status"), h.select("n")), 8,
              F.concat(F.lit("  "), v, F.lit(": "), money("bookings"), F.lit(" ("),
                       fixed(F.col("bookings") / F.col("n") * 100, 1), F.lit("%)")),
              [-F.col("bookings"), v]),
    ]
    for b, (name, title) in enumerate([("booking_channel", "Cancellation rate by booking channel:"),
                                       ("cabin_class", "Cancellation rate by cabin class:"),
                                       ("trip_type", "Cancellation rate by trip type:"),
                                       ("airline", "Cancellation rate by airline:")], start=9):
        parts += [_const(spark, b, 0, title),
                  _rows(dim(name), b, F.concat(F.lit("  "), v, F.lit(": "),
                                               fixed(F.col("cancel_rate") * 100, 2), F.lit("%")),
                        [-F.col("cancel_rate"), v])]
    months = F.broadcast(order_dim(spark, "value", MONTHS_SHORT)).join(dim("booking_month_name"), "value", "left")
    parts += [
        _const(spark, 13, 0, "\n-- BOOKING TRENDS --"), _const(spark, 13, 1, "Monthly booking volume:"),
        _rows(months, 13, F.concat(F.lit("  "), v, F.lit(": "), money(F.coalesce("bookings", F.lit(0)))),
              [F.col("ord")], start=2),
        _const(spark, 14, 0, "Monthly revenue:"),
        _rows(months, 14, F.concat(F.lit("  "), v, F.lit(": INR "), money(F.coalesce("revenue", F.lit(0.0)))),
              [F.col("ord")]),
        _const(spark, 15, 0, "\n-- ROUTE POPULARITY --"), _const(spark, 15, 1, "Top 10 routes by booking volume:"),
        _rows(dim("route").orderBy(F.col("bookings").desc(), key).limit(10), 15,
              F.concat(F.lit("  "), v, F.lit(": "), money("bookings"), F.lit(" bookings")),
              [-F.col("bookings"), v], start=2),
        _const(spark, 16, 0, "\n-- CUSTOMER BEHAVIOUR --"), _const(spark, 16, 1, "New vs Repeat customer comparison:"),
        _rows(dim("customer_type"), 16,
              F.concat(F.lit("  "), v, F.lit(": "), money("bookings"), F.lit(" bookings | Avg fare INR "),
                       money(F.bround("avg_fare", 2)), F.lit(" | Cancel rate "),
                       fixed(F.bround("cancel_rate", 2) * 100, 1), F.lit("% | Avg satisfaction "),
                       fixed(F.bround("avg_satisfaction", 2), 2)), [F.lit(0.0), v], start=2),
        _const(spark, 17, 0, "\n-- SATISFACTION --"),
        h.select(F.lit(17).alias("block"), F.lit(1).cast("bigint").alias("pos"),
                 F.concat(F.lit("Overall avg satisfaction: "), fixed("avg_satisfaction", 2), F.lit(" / 5"))
                 .alias("line")),
        _const(spark, 17, 2, "Average satisfaction by airline:"),
        _rows(dim("airline"), 17, F.concat(F.lit("  "), v, F.lit(": "), fixed("avg_satisfaction", 2)),
              [F.coalesce(-F.col("avg_satisfaction"), F.lit(float("inf"))), v], start=3),
        _const(spark, 18, 0, "\n-- COMPLAINTS --"),
        h.select(F.lit(18).alias("block"), F.lit(1).cast("bigint").alias("pos"),
                 F.concat(F.lit("Total bookings with complaints: "), money("n_complaints"), F.lit(" ("),
                          fixed(F.col("n_complaints") / F.col("n") * 100, 1), F.lit("%)")).alias("line")),
        _const(spark, 18, 2, "Complaint categories:"),
        _rows(cdim("category"), 18, F.concat(F.lit("  "), v, F.lit(": "), money("complaints")),
              [-F.col("complaints"), v], start=3),
        _const(spark, 19, 0, "Complaints by airline:"),
        _rows(cdim("airline"), 19, F.concat(F.lit("  "), v, F.lit(": "), money("complaints")),
              [-F.col("complaints"), v]),
        _const(spark, 20, 0, "Complaints by channel:"),
        _rows(cdim("booking_channel"), 20, F.concat(F.lit("  "), v, F.lit(": "), money("complaints")),
              [-F.col("complaints"), v]),
        _const(spark, 21, 0, "\n-- CHANNEL PERFORMANCE --"),
        _const(spark, 21, 1, "Booking channel performance summary:"),
        _rows(dim("booking_channel"), 21,
              F.concat(F.lit("  "), v, F.lit(": "), money("bookings"), F.lit(" bookings | Revenue INR "),
                       money("revenue"), F.lit(" | Avg fare INR "), money("avg_fare"),
                       F.lit(" | Cancel rate "), fixed(F.col("cancel_rate") * 100, 1), F.lit("%")),
              [F.lit(0.0), v], start=2),
        _const(spark, 22, 0, "\n" + SEP),
    ]
    items = None
    for p in parts:
        if p is not None and "_k1" in p.columns:
            items = p if items is None else items.unionByName(p)
    # One window over all item lines (a few hundred rows: bounded by vocabularies).
    w = Window.partitionBy("block").orderBy("_k1", "_k2")
    ranked = items.select("block", (F.row_number().over(w) + F.col("_start") - 1).cast("bigint").alias("pos"),
                          "line")
    out = _const.frame(spark).unionByName(ranked)
    for p in parts:
        if p is not None and "_k1" not in p.columns:
            out = out.unionByName(p.select(F.col("block").cast("int"), "pos", "line"))
    return out.select(F.col("block").cast("int").alias("block"), "pos", "line")


def context_text(lines: DataFrame) -> DataFrame:
    """All lines joined by newlines in (block, pos) order - one row (bounded line count)."""
    return lines.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "pos", "line"))),
                                 lambda s: s["line"]), "\n").alias("context"),
        F.count(F.lit(1)).alias("n_lines"))
