"""Stored states, sketches and the little bootstraps against what they stand for."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.operators import complaints, profile, report
from tarmac.operators.states import DayStates, column_sketches
from tarmac.plans.catalog import fa


@pytest.fixture(scope="module")
def bookings(spark, small_dir):
    return fa(spark, small_dir)


def lines(spark, states):
    out = report.lines_of(states.dimension_metrics(), states.complaint_metrics(), states.median_fare())
    return sorted(map(tuple, out.collect()))


def test_days_merge_to_the_scan_and_a_day_can_be_replaced(spark, bookings, tmp_path):
    states = DayStates(spark, str(tmp_path / "s"))
    cut = bookings.agg(F.percentile_approx(F.unix_date(F.col("booking_date").cast("date")), 0.6)).first()[0]
    early = F.unix_date(F.col("booking_date").cast("date")) <= cut
    for part in (bookings.where(early), bookings.where(~early)):
        states.add(part, complaints.complaints_app(part))
    want = sorted(map(tuple, report.fact_lines(bookings, complaints.complaints_app(bookings)).collect()))
    assert lines(spark, states) == want
    # One day once more, as corrected rows: only that day's partition changes.
    day = bookings.agg(F.max("booking_date")).first()[0]
    fixed = bookings.where(F.col("booking_date") == day).withColumn("total_fare_inr", F.lit(1.0))
    states.add(fixed, complaints.complaints_app(fixed))
    both = bookings.withColumn("total_fare_inr", F.when(F.col("booking_date") == day, 1.0).otherwise(F.col("total_fare_inr")))
    assert lines(spark, states) == sorted(map(tuple, report.fact_lines(both, complaints.complaints_app(both)).collect()))
    one = states.dimension_metrics(days=(day, day)).where("dimension = '__total__'").first()
    assert one.bookings == fixed.count() and one.revenue == pytest.approx(one.bookings)


def test_sketches_of_the_states_are_within_their_bounds(spark, bookings, tmp_path):
    states = DayStates(spark, str(tmp_path / "s"), period="yyyy")
    states.add(bookings, complaints.complaints_app(bookings))
    got = states.approximate().first()
    fares = np.sort([r[0] for r in bookings.select("total_fare_inr").where("total_fare_inr is not null").collect()])
    routes = bookings.select("route").distinct().where("route is not null").count()
    assert abs(got.routes - routes) <= 0.05 * routes + 1
    for q in (0.25, 0.5, 0.75):
        rank = np.searchsorted(fares, got[f"fare_q{int(100 * q)}"]) / len(fares)
        assert abs(rank - q) < 0.03


def test_misra_gries_bounds_hold_on_skewed_values(spark):
    rng = np.random.default_rng(3)
    values = [f"v{int(x)}" for x in rng.zipf(1.3, 20_000)] + ["hot"] * 4000 + [None] * 7
    rng.shuffle(values)
    df = spark.createDataFrame([(None if v is None else str(v),) for v in values], "c string").repartition(5)
    true = Counter(v for v in values if v is not None)
    top, n = max(true.items(), key=lambda x: (x[1], x[0]))
    for counters in (20, 100, 10**6):
        r = column_sketches(df, ["c"], counters).first()
        assert r.top_low <= true[r.top_value] <= r.top_high and n <= r.top_high
        assert r.top_high - r.top_low <= len(values) / (counters + 1)
        assert r.rows == len(values) and abs(r.approx_distinct - len(true)) < 0.06 * len(true)
    assert (r.top_value, r.top_low, r.top_high) == (top, n, n)
    empty = column_sketches(df.limit(0), ["c"]).first()
    assert (empty.rows, empty.approx_distinct, empty.top_value) == (0, 0, None)


def test_little_bootstraps_cover_and_agree_with_the_full_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{g}", float(np.round(rng.gamma(2.0, 50.0 * (g % 4 + 1)), 1)), f"{g}-{i}") for g in range(40) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, v double, booking_id string")
    little = {r.k: r for r in profile.little_bootstraps(df, "k", "v").collect()}
    inside = sum(little[f"g{g}"].ci_low <= 100.0 * (g % 4 + 1) <= little[f"g{g}"].ci_high for g in range(40))
    assert inside >= 33                                                    # 95 % intervals of the planted means
    some = df.where("k in ('g1', 'g2', 'g3')")
    for r in profile.bootstrap_mean(some, "k", "v", n_boot=300).collect():
        width = r.ci_high - r.ci_low
        assert abs(little[r.k].mean - r["mean"]) < 1e-9
        assert abs((little[r.k].ci_high - little[r.k].ci_low) - width) < 0.25 * width
    again = {r.k: r for r in profile.little_bootstraps(df.repartition(7), "k", "v").collect()}
    assert all(abs(again[k].ci_low - r.ci_low) < 1e-9 for k, r in little.items())


def test_little_bootstraps_edges(spark):
    df = spark.createDataFrame([("a", 5.0, "1")] * 3 + [("b", None, "2"), (None, 1.0, "3")], "k string, v double, booking_id string")
    assert [(r.k, r["mean"], r.ci_low, r.ci_high) for r in profile.little_bootstraps(df, "k", "v").collect()] in (
        [("a", 5.0, 5.0, 5.0)], [])
