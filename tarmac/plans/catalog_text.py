"""Named queries over complaint texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import rules
from ..operators import complaints
from .catalog import fa, query, raw, rnd


def tagged(spark, sf):
    return complaints.complaints_app(fa(spark, sf))


@query("classify_dashboard")
def q_classify_dashboard(spark, sf):
    df = complaints.tag(fa(spark, sf).where(F.length("customer_complaint") > 0))
    return df.select("booking_id", "customer_complaint", "category", "severity", "routing_team",
                     "routing_action",
                     F.array_join("matched_keywords", ", ").alias("matched_keywords"))


@query("classify_notebook")
def q_classify_notebook(spark, sf):
    return complaints.complaints_notebook(raw(spark, sf)).select(
        "booking_id", "customer_complaint", "complaint_category")


@query("rule_table")
def q_rule_table(spark, sf):
    return complaints.rule_table(spark, tagged(spark, sf))


@query("complaints_by_dim")
def q_complaints_by_dim(spark, sf):
    return complaints.complaints_by_dims(tagged(spark, sf))


@query("complaint_crosstab_status")
def q_complaint_crosstab_status(spark, sf):
    return rnd(complaints.crosstab_pct(tagged(spark, sf), "booking_status"), {"col_pct": 7})


@query("complaint_crosstab_airline")
def q_complaint_crosstab_airline(spark, sf):
    return rnd(complaints.crosstab_pct(tagged(spark, sf), "airline"), {"col_pct": 7})


@query("airline_category_pivot")
def q_airline_category_pivot(spark, sf):
    return complaints.airline_category_pivot(tagged(spark, sf))


@query("complaint_kpis")
def q_complaint_kpis(spark, sf):
    f = fa(spark, sf)
    n = f.agg(F.count(F.lit(1)).alias("bookings"))
    return rnd(complaints.complaint_kpis(complaints.complaints_app(f), n), {"complaint_share_pct": 7})


@query("complaint_listing")
def q_complaint_listing(spark, sf):
    return tagged(spark, sf).select("booking_id", "airline", "booking_channel", "booking_status",
                                    "total_fare_inr", "customer_complaint", "category")


@query("summary_input")
def q_summary_input(spark, sf):
    return complaints.summary_input(tagged(spark, sf), 30, rules("dashboard"))
