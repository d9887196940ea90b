"""Round trips, metamorphic relations and model invariants."""

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tarmac.operators import features, metrics, model
from tarmac.sources import files
from tarmac.sources.bookings import materialized_bookings, materialized_bookings_path
from tarmac.streaming import jobs


def test_csv_round_trip_with_missing_markers(spark, small_dir):
    raw = materialized_bookings(spark, small_dir)
    out = tempfile.mkdtemp(prefix="tarmac-csv-")
    files.write_table(raw, os.path.join(out, "csv"), fmt="csv")
    back = files.read_csv(spark, os.path.join(out, "csv"))
    assert back.schema == raw.schema
    # an empty field in the CSV is a missing value, as every marker is
    assert back.where(F.col("satisfaction_score").isNull()).count() == raw.where(
        F.col("satisfaction_score").isNull()).count()
    assert back.exceptAll(raw.na.fill({"customer_complaint": ""}).select(*raw.columns)
                          .withColumn("customer_complaint", F.nullif("customer_complaint", F.lit("")))).count() == 0


def test_csv_markers_become_null(spark):
    d = tempfile.mkdtemp(prefix="tarmac-csv-")
    p = os.path.join(d, "x.csv")
    with open(p, "w") as f:
        f.write("a,b\nNA,1\nfoo,N/A\nnan,2.5\n")
    from pyspark.sql import types as T
    df = files.read_csv(spark, p, T.StructType([T.StructField("a", T.StringType()),
                                                T.StructField("b", T.DoubleType())]))
    assert [tuple(r) for r in df.collect()] == [(None, 1.0), ("foo", None), (None, 2.5)]


def test_hand_over_keeps_types(spark, small_dir):
    raw = materialized_bookings(spark, small_dir)
    back = files.hand_over(raw, os.path.join(tempfile.mkdtemp(prefix="tarmac-ho-"), "t"))
    assert back.schema == raw.schema and back.count() == raw.count()
    assert files.shape(back) == (raw.count(), 23)
    assert files.tail(back, 3).count() == 3 and files.head(back, 5).count() == 5


def test_revenue_by_any_dimension_sums_to_total(spark, small_dir):
    fa = features.features_app(materialized_bookings(spark, small_dir))
    total = fa.agg(F.sum("total_fare_inr")).first()[0]
    for key in ["airline", "booking_channel", "cabin_class", "route"]:
        s = metrics.revenue_by(fa, key).agg(F.sum("revenue")).first()[0]
        assert abs(s - total) < 1e-6 * total


def test_shares_sum_to_100(spark, small_dir):
    fa = features.features_app(materialized_bookings(spark, small_dir))
    assert abs(metrics.status_share(fa).agg(F.sum("share_pct")).first()[0] - 100) < 1e-9
    assert abs(metrics.revenue_by_source_share(fa).agg(F.sum("share_pct")).first()[0] - 100) < 1e-9


def test_classification_unchanged_by_shuffle(spark, small_dir):
    q = entry.queries()["classify_dashboard"](spark, small_dir)
    shuffled = q.repartition(7, "booking_id")
    assert q.exceptAll(shuffled).count() == 0


def test_stream_equals_batch(spark, small_dir):
    src = jobs.booking_stream(spark, materialized_bookings_path(spark, small_dir))
    out = tempfile.mkdtemp(prefix="tarmac-stream-")
    jobs.run_to_sink(jobs.tag_stream(src), os.path.join(out, "o"), os.path.join(out, "c"))
    streamed = spark.read.parquet(os.path.join(out, "o"))
    batch = entry.queries()["classify_dashboard"](spark, small_dir)
    cols = ["booking_id", "customer_complaint", "category", "severity", "routing_team", "routing_action",
            "matched_keywords"]
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert streamed.count() == batch.count()


def test_logistic_model_invariants(spark, small_dir):
    res = entry.queries()["lr_metrics"](spark, small_dir).first()
    assert 0 <= res.roc_auc <= 1 and 0 <= res.precision <= 1 and 0 <= res.recall <= 1
    split = entry.queries()["stratified_split"](spark, small_dir)
    assert res.tp + res.fp + res.tn + res.fn == split.where("split = 'test'").count()
    coef = entry.queries()["coefficients"](spark, small_dir)
    assert coef.count() == 15


def test_gbt_small(spark, small_dir):
    fa = features.features_app(materialized_bookings(spark, small_dir))
    split = model.stratified_split(fa)
    m = model.fit_gbt(split.where("split = 'train'"), n_trees=5)
    ev = model.evaluate(m, split.where("split = 'test'"), "gbt").first()
    assert 0 <= ev.roc_auc <= 1
    names = model.feature_names(model.score(m, split.limit(1)))
    assert len(names) == len(m.stages[-1].featureImportances.toArray())


def test_bootstrap_interval_contains_mean(spark, small_dir):
    fa = features.features_app(materialized_bookings(spark, small_dir))
    from tarmac.operators import profile
    for r in profile.bootstrap_mean(fa, "cabin_class", "total_fare_inr", n_boot=50).collect():
        assert r.ci_low <= r.mean <= r.ci_high


def test_two_models_scored_in_one_pass(spark, small_dir):
    """score_bookings chains both fitted pipelines on one pass; equal to a keyed join."""
    fa = features.features_app(materialized_bookings(spark, small_dir))
    train = model.stratified_split(fa).where("split = 'train'")
    lr = model.fit_logistic(train, max_iter=20)
    gbt = model.fit_gbt(train, n_trees=3)
    first = model.score(lr, fa, out="p_lr").select(*fa.columns, "p_lr")
    chained = model.score(gbt, first, out="p_gbt").select("booking_id", "p_lr", "p_gbt")
    a = model.score(lr, fa, out="p_lr").select("booking_id", "p_lr")
    b = model.score(gbt, fa, out="p_gbt").select("booking_id", "p_gbt")
    joined = a.join(b, "booking_id")
    assert chained.count() == fa.count()
    assert chained.exceptAll(joined).count() == 0 and joined.exceptAll(chained).count() == 0


def test_one_csv_file_is_split_among_tasks_without_line_breaks_in_quotes(spark, tmp_path):
    from pyspark.sql import types as T
    path = tmp_path / "rows.csv"
    path.write_text('a,b\n' + "".join(f'{i},"text, {i}"\n' for i in range(20_000)))
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "65536")
        spark.conf.set(keys[1], "0")
        df = files.read_csv(spark, str(path), schema, multi_line=False)
        assert df.rdd.getNumPartitions() > 1
        assert sorted(map(tuple, df.collect())) == [(i, f"text, {i}") for i in range(20_000)]
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
