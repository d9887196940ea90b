"""Named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver tables of ``sf_dir`` (through the materialised
``bookings`` table) and applies the library operators.  Floating results are rounded
at the very end - money sums to 2 places, means and rates further out - so that the
independent DuckDB plan in ``oracle.py`` can be compared value by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, complaints, features, metrics, profile
from ..schema import (BOOKING_COLUMNS, CORRELATION_COLUMNS, NUMERIC_COLUMNS, PROFILED_CATEGORICALS,
                      TARGET_CORRELATION_COLUMNS)
from ..session import scratch_path
from ..sources import files
from ..sources.bookings import materialized_bookings

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def rnd(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return materialized_bookings(spark, sf)


def fa(spark: SparkSession, sf: str) -> DataFrame:
    return features.features_app(raw(spark, sf))


# ----------------------------------------------------------------------------- A: business
@query("kpi_overview")
def q_kpi_overview(spark, sf):
    return rnd(metrics.kpi_overview(fa(spark, sf)),
               {"total_revenue": 2, "total_revenue_cr": 6, "cancel_rate": 9, "avg_satisfaction": 9})


@query("revenue_by_airline")
def q_revenue_by_airline(spark, sf):
    return rnd(metrics.revenue_by(fa(spark, sf), "airline"), {"revenue": 2})


@query("top_routes_revenue")
def q_top_routes_revenue(spark, sf):
    return rnd(metrics.top_routes_revenue(fa(spark, sf)), {"revenue": 2})


@query("revenue_by_cabin")
def q_revenue_by_cabin(spark, sf):
    return rnd(metrics.revenue_by_cabin(fa(spark, sf)), {"revenue": 2})


@query("revenue_by_source_share")
def q_revenue_by_source_share(spark, sf):
    return rnd(metrics.revenue_by_source_share(fa(spark, sf)), {"revenue": 2, "share_pct": 6})


@query("revenue_by_channel")
def q_revenue_by_channel(spark, sf):
    return rnd(metrics.revenue_by(fa(spark, sf), "booking_channel"), {"revenue": 2})


@query("avg_fare_by_cabin")
def q_avg_fare_by_cabin(spark, sf):
    return rnd(metrics.avg_fare_by(fa(spark, sf), "cabin_class"), {"avg_fare": 9})


@query("fare_mean_median")
def q_fare_mean_median(spark, sf):
    return rnd(metrics.fare_mean_median(fa(spark, sf)), {"mean_fare": 9, "median_fare": 9})


@query("cancel_rate_by_dims")
def q_cancel_rate_by_dims(spark, sf):
    return rnd(metrics.cancel_rate_by_dims(fa(spark, sf)), {"cancel_rate": 9})


@query("cancel_rate_by_lead_band")
def q_cancel_rate_by_lead_band(spark, sf):
    return rnd(metrics.cancel_rate_by_lead_band(fa(spark, sf)), {"cancel_rate_pct": 7})


@query("cancel_rate_by_fare_quintile")
def q_cancel_rate_by_fare_quintile(spark, sf):
    fq = features.with_fare_quintile(fa(spark, sf))
    return rnd(metrics.cancel_rate_by_fare_quintile(fq), {"cancel_rate_pct": 7})


@query("satisfaction_by_status")
def q_satisfaction_by_status(spark, sf):
    return rnd(metrics.satisfaction_by(fa(spark, sf), "booking_status"), {"avg_satisfaction": 9})


@query("satisfaction_by_airline")
def q_satisfaction_by_airline(spark, sf):
    return rnd(metrics.satisfaction_by(fa(spark, sf), "airline"), {"avg_satisfaction": 9})


@query("monthly_volume")
def q_monthly_volume(spark, sf):
    return metrics.monthly(fa(spark, sf)).select("month_ord", "booking_month_name", "bookings")


@query("monthly_revenue")
def q_monthly_revenue(spark, sf):
    return rnd(metrics.monthly(fa(spark, sf)).select("month_ord", "booking_month_name", "revenue"),
               {"revenue": 2})


@query("month_kpis")
def q_month_kpis(spark, sf):
    return rnd(metrics.month_kpis(fa(spark, sf)), {"peak_revenue": 2, "avg_monthly_bookings": 6})


@query("channel_mix_by_month")
def q_channel_mix_by_month(spark, sf):
    return rnd(metrics.channel_mix_by_month(fa(spark, sf)), {"share_pct": 7})


@query("customer_summary")
def q_customer_summary(spark, sf):
    return rnd(metrics.customer_summary(fa(spark, sf)),
               {"avg_fare": 9, "cancel_rate": 9, "avg_satisfaction": 9, "share_pct": 7})


@query("channel_performance")
def q_channel_performance(spark, sf):
    return rnd(metrics.channel_performance(fa(spark, sf)),
               {"revenue": 2, "avg_fare": 9, "cancel_rate": 9})


@query("top_routes_volume")
def q_top_routes_volume(spark, sf):
    return metrics.top_routes_volume(fa(spark, sf))


@query("status_share")
def q_status_share(spark, sf):
    return rnd(metrics.status_share(fa(spark, sf)), {"share_pct": 7})


@query("date_range_airlines")
def q_date_range_airlines(spark, sf):
    return metrics.date_range_airlines(fa(spark, sf))


# ----------------------------------------------------------------------------- Q: profiling
@query("null_profile")
def q_null_profile(spark, sf):
    return rnd(profile.null_profile(raw(spark, sf)).drop("dtype"), {"null_pct": 7})


@query("duplicate_rows")
def q_duplicate_rows(spark, sf):
    return profile.duplicate_rows(raw(spark, sf))


@query("numeric_summary")
def q_numeric_summary(spark, sf):
    return rnd(profile.numeric_summary(raw(spark, sf), NUMERIC_COLUMNS),
               {"mean": 9, "std": 9, "min": 9, "p25": 9, "p50": 9, "p75": 9, "max": 9})


@query("column_profile")
def q_column_profile(spark, sf):
    return profile.column_profile(raw(spark, sf), "airline")


@query("value_counts_all")
def q_value_counts_all(spark, sf):
    return profile.value_counts_all(raw(spark, sf), PROFILED_CATEGORICALS)


@query("validate_lead_time")
def q_validate_lead_time(spark, sf):
    return profile.validate_lead_time(raw(spark, sf))


@query("validate_total_fare")
def q_validate_total_fare(spark, sf):
    return profile.validate_total_fare(raw(spark, sf))


@query("fare_outliers_iqr")
def q_fare_outliers_iqr(spark, sf):
    return rnd(profile.iqr_outlier_summary(raw(spark, sf), "total_fare_inr"),
               {"q1": 9, "q3": 9, "iqr": 9, "lower": 9, "upper": 9})


@query("box_stats_by_cancel")
def q_box_stats_by_cancel(spark, sf):
    # Only the notebook-cleaned columns and the cancel flag are needed (no quintile pass).
    df = clean.clean_notebook(raw(spark, sf)).withColumn("is_cancelled", features.is_cancelled())
    out = profile.box_stats(df, ["lead_time_days", "total_fare_inr", "ancillary_revenue_inr"],
                            by="is_cancelled")
    return rnd(out, {c: 9 for c in ["q1", "median", "q3", "lower_fence", "upper_fence",
                                    "whisker_low", "whisker_high"]})


@query("lead_time_histogram")
def q_lead_time_histogram(spark, sf):
    return rnd(profile.histogram(raw(spark, sf), "lead_time_days", 30), {"bin_start": 6, "bin_end": 6})


@query("fare_histogram_by_cancel")
def q_fare_histogram_by_cancel(spark, sf):
    return rnd(profile.histogram(fa(spark, sf), "total_fare_inr", 30, by="is_cancelled"),
               {"bin_start": 9, "bin_end": 9})


@query("correlation_matrix")
def q_correlation_matrix(spark, sf):
    return rnd(profile.correlation_matrix(raw(spark, sf), CORRELATION_COLUMNS), {"r": 9})


@query("target_correlation")
def q_target_correlation(spark, sf):
    return rnd(profile.target_correlation(fa(spark, sf), TARGET_CORRELATION_COLUMNS), {"r": 9})


# ----------------------------------------------------------------------------- C / P: tables
@query("clean_notebook")
def q_clean_notebook(spark, sf):
    return clean.clean_notebook(raw(spark, sf)).select(*BOOKING_COLUMNS)


@query("clean_app")
def q_clean_app(spark, sf):
    return clean.clean_app(raw(spark, sf)).select(*BOOKING_COLUMNS)


@query("csv_round_trip")
def q_csv_round_trip(spark, sf):
    """Bookings written as CSV with a header, read back by name, then cleaned."""
    path = scratch_path(spark, f"bookings-csv-{uuid.uuid4().hex[:12]}")
    files.write_table(raw(spark, sf), path, fmt="csv")
    return clean.clean_app(files.read_csv(spark, path)).select(*BOOKING_COLUMNS)


@query("parsed_dates")
def q_parsed_dates(spark, sf):
    """Dates that arrive as text."""
    text = raw(spark, sf).select("booking_id", *[F.col(c).cast("string").alias(c) for c in
                                                 ("booking_date", "departure_date")])
    return clean.parse_dates(text)


@query("revenue_per_ancillary")
def q_revenue_per_ancillary(spark, sf):
    """A zero divisor counts as missing."""
    ratio = F.col("total_fare_inr") / clean.zero_to_null("ancillary_revenue_inr")
    return rnd(raw(spark, sf).select("booking_id", ratio.alias("fare_per_ancillary")), {"fare_per_ancillary": 6})


@query("base_fare_outlier_rows")
def q_base_fare_outlier_rows(spark, sf):
    """Q14, row form, on a column that has rows outside the fences."""
    return profile.iqr_outliers(raw(spark, sf), "base_fare_inr").select("booking_id", "base_fare_inr")


@query("fare_outlier_rows")
def q_fare_outlier_rows(spark, sf):
    """Q14, row form: the bookings outside the fences."""
    return profile.iqr_outliers(raw(spark, sf), "total_fare_inr").select("booking_id", "total_fare_inr")


FEATURE_ROUNDING_APP = {"base_fare_inr": 6, "taxes_inr": 6, "ancillary_revenue_inr": 6,
                        "fare_per_passenger": 6, "fare_to_avg_route_fare": 9, "tax_ratio": 9}


@query("features_app")
def q_features_app(spark, sf):
    return rnd(fa(spark, sf), FEATURE_ROUNDING_APP)


@query("features_notebook")
def q_features_notebook(spark, sf):
    df = features.features_notebook(raw(spark, sf))
    return rnd(df, {"base_fare_inr": 6, "taxes_inr": 6, "ancillary_revenue_inr": 6,
                    "fare_per_passenger": 6, "fare_to_avg_route_fare": 9, "ancillary_ratio": 9,
                    "expected_total_fare": 6})


@query("fare_vs_route_avg")
def q_fare_vs_route_avg(spark, sf):
    df = features.with_group_mean(clean.clean_app(raw(spark, sf)).withColumn("route", features.route()),
                                  "route", "total_fare_inr", "route_avg_fare")
    out = df.select("booking_id", "route", "total_fare_inr", "route_avg_fare",
                    F.try_divide("total_fare_inr", "route_avg_fare").alias("fare_to_avg_route_fare"))
    return rnd(out, {"route_avg_fare": 9, "fare_to_avg_route_fare": 9})


@query("what_if_rows")
def q_what_if_rows(spark, sf):
    f = fa(spark, sf)
    cand = f.select("booking_id", "airline", "cabin_class", "trip_type", "haul_type", "booking_channel",
                    "booking_source", "lead_time_days", "pax_count", "prior_bookings",
                    "base_fare_inr", "taxes_inr", "booking_month")
    out = features.what_if_rows(cand, f)
    return rnd(out, {"base_fare_inr": 6, "taxes_inr": 6, "total_fare_inr": 6, "fare_per_passenger": 6,
                     "fare_to_avg_route_fare": 9, "tax_ratio": 9})


def names() -> list[str]:
    return list(REGISTRY)


# Further query groups register themselves on import.
from . import catalog_model, catalog_retrieval, catalog_stream, catalog_text  # noqa: E402,F401
