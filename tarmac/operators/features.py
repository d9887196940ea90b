"""Row-level derived columns P1-P23 and the group-mean spread W1.

All derived columns are built-in expressions in one projection (one codegen stage).
Group statistics that feed rows (route mean, fare quintile edges) are aggregated first
and joined back: the route table has one row per route, the edge table one row in total,
so no group is ever gathered into a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import band, checked_lookup, flag, quantile_exprs, safe_div, with_scalars
from ..functions.quantiles import quantiles
from ..schema import (BOOKING_WINDOW_BANDS, CANCELLED_STATUSES, CUSTOMER_TYPE_APP,
                      FARE_QUINTILE_LABELS, LEAD_TIME_BANDS_APP, LEAD_TIME_BANDS_NOTEBOOK,
                      LOYALTY_BANDS, ROUTE_SEP_APP, ROUTE_SEP_NOTEBOOK)
from .clean import clean_app, clean_notebook


def is_cancelled():
    """Status in {Cancelled, Refunded} -> 1, else (NULL too) 0."""
    return flag(F.col("booking_status").isin(*CANCELLED_STATUSES))


def route(sep: str = ROUTE_SEP_APP):
    """Origin + sep + destination; NULL if either side is NULL."""
    return F.concat(F.col("origin"), F.lit(sep), F.col("destination"))


def with_group_mean(df: DataFrame, key: str, value: str, out: str,
                    means_from: DataFrame | None = None) -> DataFrame:
    """Mean of ``value`` per ``key`` spread back to every row.

    Aggregate (partial/final, so a hot key collapses map-side) and join back.  The
    aggregate has one row per key; it is written, counted and broadcast if small, so the
    fact table is not shuffled.  ``means_from`` takes the means from other rows (training
    rows only, say).  NULL keys get NULL, as a dropped group would.
    """
    means = ((df if means_from is None else means_from).where(F.col(key).isNotNull())
             .groupBy(key).agg(F.avg(value).alias(out)))
    return df.join(checked_lookup(means, keys=[key]), key, "left")


def quintile_edges(df: DataFrame, value: str = "total_fare_inr", exact: bool = True) -> DataFrame:
    """One-row frame with the 0/20/40/60/80/100 % cut points of ``value`` (exact,
    bounded memory; ``exact=False`` uses the sketch alone)."""
    probs = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    if exact:
        return quantiles(df, value, probs, out="_edges")
    return df.agg(quantile_exprs(value, probs, exact=False).alias("_edges"))


def with_fare_quintile(df: DataFrame, value: str = "total_fare_inr", out: str = "fare_quintile",
                       labels=FARE_QUINTILE_LABELS, exact: bool = True) -> DataFrame:
    """Equal-frequency bins; min included in bin 1; duplicate edges raise.

    Bin = 1 + number of inner edges strictly below the value (right-closed bins).
    """
    edges = quintile_edges(df, value, exact)  # exactly one row: a scalar subquery
    e = F.col("_edges")
    v = F.col(value)
    ordinal = (F.lit(1) + (v > e[1]).cast("int") + (v > e[2]).cast("int")
               + (v > e[3]).cast("int") + (v > e[4]).cast("int"))
    increasing = (e[0] < e[1]) & (e[1] < e[2]) & (e[2] < e[3]) & (e[3] < e[4]) & (e[4] < e[5])
    label_arr = F.array(*[F.lit(x) for x in labels])
    labelled = F.when(v.isNull(), F.lit(None)).otherwise(F.element_at(label_arr, ordinal))
    checked = F.when(~increasing, F.raise_error(F.lit("Bin edges must be unique: quantile cut points repeat")))
    return (with_scalars(df, edges)
            .withColumn(out, F.coalesce(checked.cast("string"), labelled))
            .withColumn(out + "_ord", F.when(v.isNotNull(), ordinal))
            .drop("_edges"))


def features_app(bookings: DataFrame, route_mean_from: DataFrame | None = None) -> DataFrame:
    """Dashboard feature table: dashboard cleaning + P1-P4, P7, P9-P12, P15, P20, P22.

    The route mean is that of ``route_mean_from`` (cleaned here too) or of all rows.
    """
    df = clean_app(bookings).withColumn("route", route(ROUTE_SEP_APP))
    source = None if route_mean_from is None else clean_app(route_mean_from).withColumn("route", route(ROUTE_SEP_APP))
    df = with_group_mean(df, "route", "total_fare_inr", "_route_avg", source)
    repeat, new = CUSTOMER_TYPE_APP
    return (df.withColumns({
        "is_cancelled": is_cancelled(),
        "booking_month": F.month("booking_date"),
        "booking_month_name": F.date_format("booking_date", "MMM"),
        "booking_dayofweek": F.weekday("booking_date"),
        "fare_per_passenger": safe_div("total_fare_inr", "pax_count"),
        "is_repeat_customer": flag(F.col("prior_bookings") > 0),
        "has_ancillary": flag(F.col("ancillary_revenue_inr") > 0),
        "fare_to_avg_route_fare": safe_div("total_fare_inr", "_route_avg"),
        "tax_ratio": safe_div("taxes_inr", "total_fare_inr"),
        "customer_type": F.when(F.col("prior_bookings") > 0, repeat).otherwise(new),
        "lead_time_bin": band("lead_time_days", *LEAD_TIME_BANDS_APP),
    }).drop("_route_avg"))


def features_notebook(bookings: DataFrame) -> DataFrame:
    """Notebook chain (EDA notebook then model notebook) on the notebook-cleaned table.

    P5, P6, P16-P21 from the EDA; P1, P3, P8-P11, P13, P14, P22 re-derived by the model
    notebook (its route uses '-' and its customer labels are Repeat/New).
    """
    df = clean_notebook(bookings)
    df = df.withColumns({
        "calculated_lead_time": F.datediff("departure_date", "booking_date"),
        "expected_total_fare": (F.col("base_fare_inr") + F.col("taxes_inr")) * F.col("pax_count"),
        "route": route(ROUTE_SEP_NOTEBOOK),
        "booking_month": F.month("booking_date"),
        "booking_month_name": F.date_format("booking_date", "MMM"),
        "booking_day": F.date_format("booking_date", "EEEE"),
        "travel_month": F.date_format("departure_date", "MMMM"),
        "fare_per_passenger": safe_div("total_fare_inr", "pax_count"),
        "booking_window": band("lead_time_days", *BOOKING_WINDOW_BANDS),
        "loyalty_segment": band("prior_bookings", *LOYALTY_BANDS),
        "is_cancelled": is_cancelled(),
        "lead_time_bin": band("lead_time_days", *LEAD_TIME_BANDS_NOTEBOOK),
    })
    df = with_fare_quintile(df).drop("fare_quintile_ord")
    df = with_group_mean(df, "route", "total_fare_inr", "_route_avg")
    return (df.withColumns({
        "is_repeat_customer": flag(F.col("prior_bookings") > 0),
        "fare_to_avg_route_fare": safe_div("total_fare_inr", "_route_avg"),
        "has_complaint": flag(F.col("customer_complaint") != "No"),
        "is_weekend_booking": flag(F.weekday("booking_date") >= 5),
        "is_weekend_travel": flag(F.weekday("departure_date") >= 5),
        "ancillary_ratio": safe_div("ancillary_revenue_inr", "total_fare_inr"),
        "customer_type": F.when(F.col("prior_bookings") > 0, "Repeat").otherwise("New"),
    }).drop("_route_avg"))


def what_if_rows(candidates: DataFrame, reference: DataFrame, use_route_mean: bool = False) -> DataFrame:
    """Model inputs for hypothetical bookings.

    ``candidates`` carries the form inputs (airline, cabin_class, trip_type, haul_type,
    booking_channel, booking_source, lead_time_days, pax_count, prior_bookings,
    base_fare_inr, taxes_inr, booking_month).  The fare ratio is taken against the global
    mean fare (one-row broadcast), or against the route mean when ``use_route_mean``.
    """
    total = (F.col("base_fare_inr") + F.col("taxes_inr")) * F.col("pax_count")
    df = candidates.withColumn("total_fare_inr", total)
    if use_route_mean:
        means = (reference.where(F.col("route").isNotNull())
                 .groupBy("route").agg(F.avg("total_fare_inr").alias("_mean_fare")))
        df = df.join(means, "route", "left")
    else:
        df = with_scalars(df, reference.agg(F.avg("total_fare_inr").alias("_mean_fare")))
    return (df.withColumns({
        "fare_per_passenger": F.when(F.col("pax_count") != 0, F.col("total_fare_inr") / F.col("pax_count"))
                               .otherwise(F.col("total_fare_inr")),
        "booking_dayofweek": F.lit(1),
        "is_repeat_customer": flag(F.col("prior_bookings") > 0),
        "has_ancillary": F.lit(0),
        "fare_to_avg_route_fare": F.when(F.coalesce(F.col("_mean_fare"), F.lit(0.0)) != 0,
                                         F.col("total_fare_inr") / F.col("_mean_fare")).otherwise(F.lit(1.0)),
        "tax_ratio": F.when(F.col("total_fare_inr") != 0, F.col("taxes_inr") / F.col("total_fare_inr"))
                      .otherwise(F.lit(0.0)),
    }).drop("_mean_fare"))
