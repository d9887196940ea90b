"""Business aggregates A1-A29 over the dashboard feature table.

Every function takes the feature DataFrame (``features_app``) and returns a small
result DataFrame.  Plans are single-pass where the reference groups the same table
several times: GROUPING SETS for rates over several dimensions, one ``agg`` for
multi-metric summaries.  NULL group keys are dropped (as a pandas groupby does).
Fixed display orders (months, cabins) are 4- or 12-row dimensions joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import order_dim, safe_div, share_pct, top_k, with_scalars
from ..functions.quantiles import quantiles
from ..schema import CABIN_ORDER, LEAD_TIME_BANDS_APP, MONTHS_SHORT


def _nonnull(df: DataFrame, *keys: str) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def kpi_overview(fa: DataFrame) -> DataFrame:
    """Headline numbers in one aggregate pass."""
    return fa.agg(
        F.count(F.lit(1)).alias("total_bookings"),
        F.sum("total_fare_inr").alias("total_revenue"),
        (F.sum("total_fare_inr") / 1e7).alias("total_revenue_cr"),
        F.avg(F.col("is_cancelled").cast("double")).alias("cancel_rate"),
        F.sum("is_cancelled").cast("bigint").alias("cancelled"),
        F.avg("satisfaction_score").alias("avg_satisfaction"),
        F.countDistinct("airline").alias("n_airlines"),
        F.countDistinct("route").alias("n_routes"),
    )


def revenue_by(fa: DataFrame, key: str) -> DataFrame:
    """Total fare per key."""
    return _nonnull(fa, key).groupBy(key).agg(F.sum("total_fare_inr").alias("revenue"))


def top_routes_revenue(fa: DataFrame, k: int = 10) -> DataFrame:
    """A3: the k routes with the largest revenue."""
    return top_k(revenue_by(fa, "route"), k, "revenue", "route")


def revenue_by_cabin(fa: DataFrame, fill_zero: bool = True) -> DataFrame:
    """A4: revenue per cabin in the fixed cabin order; missing cabins 0 (or NULL)."""
    spark = fa.sparkSession
    dim = order_dim(spark, "cabin_class", CABIN_ORDER)
    out = F.broadcast(dim).join(revenue_by(fa, "cabin_class"), "cabin_class", "left")
    if fill_zero:
        out = out.fillna({"revenue": 0.0})
    return out.select("cabin_class", F.col("ord").alias("cabin_ord"), "revenue")


def revenue_by_source_share(fa: DataFrame) -> DataFrame:
    """A5: revenue per booking source and its share of the total in percent."""
    rev = revenue_by(fa, "booking_source")
    return rev.withColumn("share_pct", share_pct("revenue"))


def avg_fare_by(fa: DataFrame, key: str = "cabin_class") -> DataFrame:
    """Mean fare per key."""
    return _nonnull(fa, key).groupBy(key).agg(F.avg("total_fare_inr").alias("avg_fare"))


def fare_mean_median(fa: DataFrame) -> DataFrame:
    """Overall mean and (exact, interpolated, bounded-memory) median fare."""
    med = quantiles(fa, "total_fare_inr", [0.5]).select(F.col("q")[0].alias("median_fare"))
    return with_scalars(fa.agg(F.avg("total_fare_inr").alias("mean_fare")), med)


CANCEL_DIMENSIONS = ["booking_channel", "cabin_class", "trip_type", "airline"]


def cancel_rate_by_dims(fa: DataFrame, dims=tuple(CANCEL_DIMENSIONS)) -> DataFrame:
    """A10: cancellation rate per value of several dimensions in ONE aggregation.

    GROUPING SETS expands each row once per dimension inside the partial aggregate
    (Expand -> HashAggregate), so a single shuffle serves all dimensions.
    """
    dims = list(dims)
    out = (fa.groupingSets([[F.col(d)] for d in dims], *dims)
           .agg(F.count(F.lit(1)).alias("bookings"),
                F.avg(F.col("is_cancelled").cast("double")).alias("cancel_rate"),
                *[F.grouping(d).alias(f"_g_{d}") for d in dims]))
    keep = None
    for d in dims:
        c = (F.col(f"_g_{d}") == 0) & F.col(d).isNotNull()
        keep = c if keep is None else keep | c
    dimension = None
    value = None
    for d in dims:
        on = F.col(f"_g_{d}") == 0
        dimension = F.when(on, F.lit(d)) if dimension is None else dimension.when(on, F.lit(d))
        value = F.when(on, F.col(d)) if value is None else value.when(on, F.col(d))
    return out.where(keep).select(dimension.alias("dimension"), value.alias("value"),
                                  "bookings", "cancel_rate")


def cancel_rate_by(fa: DataFrame, key: str) -> DataFrame:
    """A10 for one dimension, highest rate first."""
    return (_nonnull(fa, key).groupBy(key)
            .agg(F.avg(F.col("is_cancelled").cast("double")).alias("cancel_rate")))


def cancel_rate_by_lead_band(fa: DataFrame) -> DataFrame:
    """Rate (percent) per lead-time band; bands without rows and NULL band dropped."""
    spark = fa.sparkSession
    labels = LEAD_TIME_BANDS_APP[1]
    dim = order_dim(spark, "lead_time_bin", labels)
    agg = (_nonnull(fa, "lead_time_bin").groupBy("lead_time_bin")
           .agg(F.count(F.lit(1)).alias("bookings"),
                (F.avg(F.col("is_cancelled").cast("double")) * 100).alias("cancel_rate_pct")))
    return (agg.join(F.broadcast(dim), "lead_time_bin")
            .select("lead_time_bin", F.col("ord").alias("bin_ord"), "bookings", "cancel_rate_pct"))


def cancel_rate_by_fare_quintile(fq: DataFrame) -> DataFrame:
    """Rate (percent) per fare quintile (input carries fare_quintile[_ord])."""
    return (_nonnull(fq, "fare_quintile").groupBy("fare_quintile", "fare_quintile_ord")
            .agg(F.count(F.lit(1)).alias("bookings"),
                 (F.avg(F.col("is_cancelled").cast("double")) * 100).alias("cancel_rate_pct")))


def satisfaction_by(fa: DataFrame, key: str) -> DataFrame:
    """Mean satisfaction per key (NULL scores skipped)."""
    return _nonnull(fa, key).groupBy(key).agg(F.avg("satisfaction_score").alias("avg_satisfaction"))


def _monthly(fa: DataFrame) -> DataFrame:
    return (_nonnull(fa, "booking_month_name").groupBy("booking_month_name")
            .agg(F.count(F.lit(1)).alias("bookings"), F.sum("total_fare_inr").alias("revenue")))


def monthly(fa: DataFrame) -> DataFrame:
    """A14 + A15: 12 calendar months (years merged), empty months 0."""
    dim = order_dim(fa.sparkSession, "booking_month_name", MONTHS_SHORT)
    return (F.broadcast(dim).join(_monthly(fa), "booking_month_name", "left")
            .fillna({"bookings": 0, "revenue": 0.0})
            .select(F.col("ord").alias("month_ord"), "booking_month_name", "bookings", "revenue"))


def month_kpis(fa: DataFrame) -> DataFrame:
    """Peak volume month, peak revenue month (first month on ties), mean per month."""
    m = monthly(fa)
    peak_vol = (m.orderBy(F.col("bookings").desc(), F.col("month_ord")).limit(1)
                .select(F.col("booking_month_name").alias("peak_volume_month"),
                        F.col("bookings").alias("peak_volume")))
    peak_rev = (m.orderBy(F.col("revenue").desc(), F.col("month_ord")).limit(1)
                .select(F.col("booking_month_name").alias("peak_revenue_month"),
                        F.col("revenue").alias("peak_revenue")))
    avg_m = m.agg(F.avg(F.col("bookings").cast("double")).alias("avg_monthly_bookings"))
    return with_scalars(peak_vol, peak_rev, avg_m)


def channel_mix_by_month(fa: DataFrame) -> DataFrame:
    """Month x channel counts and row percent; 12 months x seen channels.

    One aggregate: a row per channel with a count per calendar month (the 12 pivot
    values are given, so no pass is needed to find them), unpivoted back to long form.
    A month without bookings keeps NULL counts and shares (the reindexed wide table has
    an all-NaN row); a seen month missing one channel gets 0.
    """
    base = _nonnull(fa, "booking_month_name", "booking_channel")
    wide = base.groupBy("booking_channel").pivot("booking_month_name", MONTHS_SHORT).count()
    long = wide.unpivot("booking_channel", [F.col(f"`{m}`") for m in MONTHS_SHORT],
                        "booking_month_name", "n")
    month = Window.partitionBy("booking_month_name")
    seen = F.max(F.col("n").isNotNull().cast("int")).over(month) == 1
    bookings = F.when(seen, F.coalesce("n", F.lit(0))).cast("bigint")
    month_ord = F.array_position(F.array(*[F.lit(m) for m in MONTHS_SHORT]), F.col("booking_month_name")) - 1
    return (long.withColumn("bookings", bookings)
            .select(month_ord.cast("int").alias("month_ord"), "booking_month_name", "booking_channel",
                    "bookings",
                    safe_div(F.col("bookings") * 100.0, F.sum("bookings").over(month)).alias("share_pct")))


def customer_summary(fa: DataFrame, with_prior: bool = False) -> DataFrame:
    """A18 + A19: new vs repeat - bookings, mean fare, cancel rate, satisfaction, share."""
    aggs = [F.count("booking_id").alias("bookings"),
            F.avg("total_fare_inr").alias("avg_fare"),
            F.avg(F.col("is_cancelled").cast("double")).alias("cancel_rate"),
            F.avg("satisfaction_score").alias("avg_satisfaction")]
    if with_prior:
        aggs.append(F.avg("prior_bookings").alias("avg_prior"))
    out = _nonnull(fa, "customer_type").groupBy("customer_type").agg(*aggs)
    return out.withColumns({
        # Presentation column as on the page: rate rounded to 2 places, then x 100.
        "cancel_rate_pct": F.bround(F.bround("cancel_rate", 2) * 100, 2),
        "share_pct": share_pct("bookings"),
    })


def channel_performance(fa: DataFrame) -> DataFrame:
    """Bookings, revenue, mean fare, cancellation rate per channel."""
    return (_nonnull(fa, "booking_channel").groupBy("booking_channel")
            .agg(F.count("booking_id").alias("bookings"),
                 F.sum("total_fare_inr").alias("revenue"),
                 F.avg("total_fare_inr").alias("avg_fare"),
                 F.avg(F.col("is_cancelled").cast("double")).alias("cancel_rate")))


def value_counts(df: DataFrame, key: str, dropna: bool = True) -> DataFrame:
    """Q7 / Q8: count per value, NULLs dropped unless ``dropna=False``."""
    src = _nonnull(df, key) if dropna else df
    return src.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def top_routes_volume(fa: DataFrame, k: int = 10) -> DataFrame:
    """The k routes with most bookings."""
    return top_k(value_counts(fa, "route").withColumnRenamed("count", "bookings"), k, "bookings", "route")


def status_share(fa: DataFrame) -> DataFrame:
    """Bookings per status and share of all bookings (percent)."""
    total = fa.agg(F.count(F.lit(1)).alias("_all"))
    return (with_scalars(value_counts(fa, "booking_status").withColumnRenamed("count", "bookings"), total)
            .withColumn("share_pct", F.col("bookings") * 100.0 / F.col("_all")).drop("_all"))


def date_range_airlines(fa: DataFrame) -> DataFrame:
    """A27 + A28: first/last booking date and the sorted distinct airline list.

    The set is bounded by the airline vocabulary; the partial aggregate keeps one set
    per task, so no task sees more than the distinct airlines.
    """
    return fa.agg(F.min("booking_date").alias("first_booking_date"),
                  F.max("booking_date").alias("last_booking_date"),
                  F.array_join(F.array_sort(F.collect_set("airline")), ", ").alias("airlines"))
