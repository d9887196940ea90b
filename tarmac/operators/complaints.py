"""Complaint intelligence T1-T9 as DataFrame -> DataFrame functions.

Tagging is a projection (no shuffle).  Counts are partial/final aggregates; the
cross-tables build their zero cells from the distinct categories x distinct column
values seen, both bounded by vocabularies (categories <= 10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import top_k, with_scalars
from ..functions.text import (category_of, classify_notebook, found, has_complaint, keywords_of,  # noqa: F401
                              routing_action, routing_team, rules, severity)
from ..schema import OTHER_CATEGORY, ROUTING, SEVERITY


def tag(df: DataFrame, text: str = "customer_complaint", rule_set=None,
        with_details: bool = True) -> DataFrame:
    """T1 + T3 + T4 + T5: category, severity, routing and matched keywords per row."""
    rule_set = rule_set or rules("dashboard")
    # The text is scanned once; category and keywords are read from the pieces found.
    pieces = F.col("_pieces")
    out = df.withColumn("_pieces", found(F.col(text), rule_set)).withColumn("category", category_of(pieces, rule_set))
    if with_details:
        out = out.withColumns({
            "severity": severity(F.col("category")),
            "routing_team": routing_team(F.col("category")),
            "routing_action": routing_action(F.col("category")),
            "matched_keywords": keywords_of(pieces, rule_set),
        })
    return out.drop("_pieces")


def complaints_app(fa: DataFrame, rule_set=None, with_details: bool = False) -> DataFrame:
    """Rows with a complaint (dashboard definition: length > 0) tagged with a category."""
    return tag(fa.where(has_complaint(F.col("customer_complaint"), "length")),
               rule_set=rule_set, with_details=with_details)


def complaints_notebook(raw: DataFrame) -> DataFrame:
    """Notebook classifier on raw rows with a complaint that is not 'No'."""
    return (raw.where(has_complaint(F.col("customer_complaint"), "not_no"))
            .withColumn("complaint_category", classify_notebook(F.col("customer_complaint"))))


def rule_table(spark, tagged: DataFrame | None = None, rule_set=None) -> DataFrame:
    """Category reference (priority, severity, team), with observed counts if given."""
    rule_set = rule_set or rules("dashboard")
    cats = [c for c, _ in rule_set] + [OTHER_CATEGORY]
    rows = [(i, c, SEVERITY.get(c, "Low"), ROUTING.get(c, ("—", "—"))[0]) for i, c in enumerate(cats)]
    ref = spark.createDataFrame(rows, "priority int, category string, severity string, routing_team string")
    if tagged is None:
        return ref
    counts = tagged.groupBy("category").agg(F.count(F.lit(1)).alias("complaints"))
    return (F.broadcast(ref).join(counts, "category", "left")
            .fillna({"complaints": 0}))


def counts_by(tagged: DataFrame, key: str) -> DataFrame:
    """Complaints per key (NULL keys dropped)."""
    return (tagged.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("complaints")))


def complaints_by_dims(tagged: DataFrame, dims=("category", "airline", "booking_channel")) -> DataFrame:
    """A23 in one pass: GROUPING SETS over the dimensions, long form (dimension, value, n)."""
    dims = list(dims)
    agg = (tagged.groupingSets([[F.col(d)] for d in dims], *dims)
           .agg(F.count(F.lit(1)).alias("complaints"),
                *[F.grouping(d).alias(f"_g_{d}") for d in dims]))
    keep = dimension = value = None
    for d in dims:
        on = F.col(f"_g_{d}") == 0
        c = on & F.col(d).isNotNull()
        keep = c if keep is None else keep | c
        dimension = F.when(on, F.lit(d)) if dimension is None else dimension.when(on, F.lit(d))
        value = F.when(on, F.col(d)) if value is None else value.when(on, F.col(d))
    return agg.where(keep).select(dimension.alias("dimension"), value.alias("value"), "complaints")


def crosstab_pct(tagged: DataFrame, column: str, rule_set=None) -> DataFrame:
    """Category x column counts and column percent, zero cells included.

    One aggregate: a row per value of ``column`` with a count per category of the rule
    set (given pivot values), unpivoted to long form.  Cells are kept for the observed
    categories only (those with a count somewhere), as in a crosstab of the data.
    """
    rule_set = rule_set or rules("dashboard")
    cats = [c for c, _ in rule_set] + [OTHER_CATEGORY]
    wide = (tagged.where(F.col(column).isNotNull())
            .groupBy(column).pivot("category", cats).count())
    long = wide.unpivot(column, [F.col(f"`{c}`") for c in cats], "category", "n")
    observed = F.max(F.col("n").isNotNull().cast("int")).over(Window.partitionBy("category")) == 1
    w = Window.partitionBy(column)
    return (long.withColumn("_obs", observed).where(F.col("_obs"))
            .withColumn("complaints", F.coalesce("n", F.lit(0)).cast("bigint"))
            .withColumn("col_pct", F.col("complaints") * 100.0 / F.sum("complaints").over(w))
            .select("category", column, "complaints", "col_pct"))


def airline_category_pivot(tagged: DataFrame, rule_set=None) -> DataFrame:
    """Airline x category counts, one column per category of the rule set, 0 filled.

    The pivot values are given, so Spark needs no extra pass to find them.
    """
    rule_set = rule_set or rules("dashboard")
    cats = [c for c, _ in rule_set] + [OTHER_CATEGORY]
    return (tagged.where(F.col("airline").isNotNull())
            .groupBy("airline").pivot("category", cats).count().fillna(0, subset=cats))


def complaint_kpis(tagged: DataFrame, n_bookings: DataFrame) -> DataFrame:
    """Total, share of bookings, top category / airline / channel (ties: first key)."""
    total = tagged.agg(F.count(F.lit(1)).alias("total_complaints"),
                       F.countDistinct("category").alias("n_categories"))
    top_cat = top_k(counts_by(tagged, "category"), 1, "complaints", "category").select(
        F.col("category").alias("top_category"), F.col("complaints").alias("top_category_complaints"))
    top_air = top_k(counts_by(tagged, "airline"), 1, "complaints", "airline").select(
        F.col("airline").alias("top_airline"))
    top_ch = top_k(counts_by(tagged, "booking_channel"), 1, "complaints", "booking_channel").select(
        F.col("booking_channel").alias("top_channel"))
    return (with_scalars(total, n_bookings, top_cat, top_air, top_ch)
            .withColumn("complaint_share_pct", F.try_divide(F.col("total_complaints") * 100.0, F.col("bookings")))
            .drop("bookings"))


def sample_order(key: str = "booking_id", seed: int = 42):
    """Repeatable pseudo-random order, identical on any engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def summary_input(tagged: DataFrame, n_sample: int = 30, rule_set=None) -> DataFrame:
    """Inputs of the executive summary as one row of text.

    Category distribution, airline x category table and 30 sampled complaints, each
    rendered as lines.  Every part is bounded (categories, airlines, 30 samples) before
    it is gathered into one string.
    """
    rule_set = rule_set or rules("dashboard")
    cats = counts_by(tagged, "category")
    cat_lines = cats.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("complaints")).alias("k"), "category", "complaints"))),
        lambda s: F.concat(s["category"], F.lit(": "), s["complaints"].cast("string"))), "\n")
        .alias("category_distribution"))
    piv = airline_category_pivot(tagged, rule_set)
    cat_names = [c for c, _ in rule_set] + [OTHER_CATEGORY]
    line = F.concat_ws(" | ", F.col("airline"),
                       *[F.concat(F.lit(c + "="), F.col(f"`{c}`").cast("string")) for c in cat_names])
    air_lines = piv.select("airline", line.alias("line")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("airline", "line"))), lambda s: s["line"]), "\n")
        .alias("airline_table"))
    sample = (tagged.select(sample_order().alias("k"), "customer_complaint")
              .orderBy("k").limit(n_sample))
    sample_lines = sample.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("k", "customer_complaint"))),
        lambda s: F.concat(F.lit("- "), s["customer_complaint"])), "\n").alias("sample_complaints"),
        F.count(F.lit(1)).alias("n_sampled"))
    total = tagged.agg(F.count(F.lit(1)).alias("n_complaints"))
    return with_scalars(total, cat_lines, air_lines, sample_lines)
