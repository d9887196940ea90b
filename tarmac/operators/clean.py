"""Cleaning (C1-C6) and the two cleaned-table variants of the analysis.

Statistics used as fill values (mode, median) are one-row aggregates attached as scalar
subqueries (run once, value inlined), so the fill stays inside one lazy plan with no
join; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import with_scalars


def fill_with_stat(df: DataFrame, column: str, stat: str) -> DataFrame:
    """Fill NULLs of ``column`` with its mode (ties -> smallest) or median."""
    if stat == "mode":
        agg = F.mode(column, deterministic=True)
    elif stat == "median":
        agg = F.median(column)
    else:
        raise ValueError(f"unknown statistic {stat!r}")
    one_row = df.agg(agg.alias("_fill"))
    return (with_scalars(df, one_row)
            .withColumn(column, F.coalesce(F.col(column), F.col("_fill").cast(df.schema[column].dataType)))
            .drop("_fill"))


def fill_constant(df: DataFrame, values: dict) -> DataFrame:
    """Fill with fixed values (0, 'Unknown', ...)."""
    return df.fillna(values)


def zero_to_null(c: str):
    """0 -> NULL (used before dividing)."""
    return F.nullif(F.col(c), F.lit(0))


def parse_dates(df: DataFrame, columns=("booking_date", "departure_date"), lenient: bool = False) -> DataFrame:
    """Text dates to DATE.  Strict by default (bad input raises, as the source does)."""
    fn = F.try_to_date if lenient else F.to_date
    return df.withColumns({c: fn(F.col(c).cast("string")) for c in columns})


def clean_app(df: DataFrame) -> DataFrame:
    """Dashboard cleaning: constants only; satisfaction stays NULL."""
    return fill_constant(df, {"fare_basis": "Unknown", "ancillary_revenue_inr": 0.0,
                              "payment_method": "Unknown", "customer_complaint": ""})


def clean_notebook(df: DataFrame) -> DataFrame:
    """Notebook cleaning: mode / 0 / 'Unknown' / median / 'No'.

    Mode and median come from one aggregate pass over the raw table; both keep a
    value -> count map, which is bounded here (fare bases and 1-5 scores).
    """
    stats = df.agg(F.mode("fare_basis", deterministic=True).alias("_fb"),
                   F.median("satisfaction_score").alias("_sat"))
    return (with_scalars(df, stats)
            .withColumns({
                "fare_basis": F.coalesce("fare_basis", "_fb"),
                "ancillary_revenue_inr": F.coalesce("ancillary_revenue_inr", F.lit(0.0)),
                "payment_method": F.coalesce("payment_method", F.lit("Unknown")),
                "satisfaction_score": F.coalesce("satisfaction_score", "_sat"),
                "customer_complaint": F.coalesce("customer_complaint", F.lit("No")),
            })
            .drop("_fb", "_sat"))
