"""Physical-plan properties that matter at scale (pruning, single passes, no hot windows)."""

import re

import __spark_entry__ as entry
from tarmac.sources.bookings import bookings


def _plan(df) -> str:
    df.collect()  # final adaptive plan; the initial plan printed after it is dropped
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_aggregate_scans_only_needed_columns(spark, small_dir):
    plan = _plan(entry.queries()["channel_performance"](spark, small_dir))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert scans, plan
    for cols in scans:
        assert len(cols.split(",")) <= 4, cols   # booking_id, channel, fare, status


def test_grouping_sets_is_one_aggregation(spark, small_dir):
    plan = _plan(entry.queries()["cancel_rate_by_dims"](spark, small_dir))
    assert "Expand" in plan
    assert len(re.findall(r"FileScan parquet", plan)) == 1


def test_prior_bookings_has_no_window_on_the_customer_alone(spark, small_dir):
    plan = bookings(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    # Windows partition by (slice, key) or over the per-slice count table, never by the
    # customer key alone over raw orders.
    for m in re.finditer(r"Window \[.*?\], \[([^\]]*)\]", plan):
        assert "_slice" in m.group(1) or "o_custkey" in m.group(1)
    assert "_slice" in plan


def test_report_reads_checkpointed_aggregates_only(spark, small_dir):
    plan = _plan(entry.queries()["metrics_text"](spark, small_dir))
    assert "FileScan parquet" not in plan


def test_topk_uses_group_limit_before_shuffle(spark, small_dir):
    plan = _plan(entry.queries()["cosine_topk"](spark, small_dir))
    assert "WindowGroupLimit" in plan


def test_no_query_plans_a_cross_product(spark, small_dir):
    """No registered query (models and streams aside) plans a Cartesian product or a
    nested-loop join: one-row statistics are scalar subqueries, grids are pivots."""
    from tarmac.plans import catalog_model, catalog_stream
    skip = {n for n, f in entry.queries().items()
            if f.__module__ in (catalog_model.__name__, catalog_stream.__name__)}
    offenders = []
    for name, fn in entry.queries().items():
        if name in skip:
            continue
        plan = fn(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
            offenders.append(name)
    assert not offenders, offenders
