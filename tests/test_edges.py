"""Edge cases: empty tables, missing fields, white space, CSV quoting, empty bins, plan shapes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarmac.functions import columns
from tarmac.functions.columns import checked_lookup
from tarmac.functions.text import classify_notebook, has_complaint
from tarmac.operators import complaints, features, model, profile, retrieval
from tarmac.plans.catalog import fa, raw
from tarmac.schema import BOOKING_SCHEMA, NO_COMPLAINT
from tarmac.sources.files import read_csv


def one_booking(spark, **changes):
    row = {f.name: None for f in BOOKING_SCHEMA.fields}
    row |= {"booking_id": "b1", "airline": "A", "origin": "X", "destination": "Y", "booking_date": dt.date(2024, 1, 2),
            "total_fare_inr": 12345678.5, "customer_complaint": " late \n"}
    row |= changes
    return spark.createDataFrame([tuple(row[f.name] for f in BOOKING_SCHEMA.fields)], BOOKING_SCHEMA)


def test_empty_tables_give_null_shares(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert {r.null_pct for r in profile.null_profile(empty).collect()} == {None}
    tagged = spark.createDataFrame([], "category string, airline string, booking_channel string")
    bookings = spark.createDataFrame([(0,)], "bookings bigint")
    assert complaints.complaint_kpis(tagged, bookings).first().complaint_share_pct is None
    assert profile.histogram(spark.createDataFrame([], "v double"), "v").count() == 0


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1), (100.0, 2), (None, 2)], "v double, g int")
    got = [r["count"] for r in profile.histogram(df, "v", 30).orderBy("bin").collect()]
    assert got == [2] + [0] * 28 + [1]
    assert profile.histogram(df, "v", 30, by="g").count() == 60


def test_white_space_of_any_kind_is_no_complaint(spark):
    df = spark.createDataFrame([("\t\n",), (" nan\n",), ("late",)], "c string")
    got = df.select(has_complaint(F.col("c"), "stripped").alias("h"), classify_notebook(F.col("c")).alias("k")).collect()
    assert [r.h for r in got] == [False, False, True]
    assert [r.k == NO_COMPLAINT for r in got] == [True, True, False]


def test_documents_survive_missing_fields_and_print_large_fares_plainly(spark):
    doc = retrieval.booking_documents(one_booking(spark)).first()
    assert doc.text is not None and "(nan, nan, nan)" in doc.text
    assert doc.metadata["total_fare_inr"] == "12345678.5"
    whole = retrieval.complaint_documents(one_booking(spark, customer_complaint="x" * 300)).first()
    assert len(whole.metadata["complaint_text"]) == 300
    cut = retrieval.complaint_documents(one_booking(spark, customer_complaint="x" * 300), metadata_chars=200).first()
    assert len(cut.metadata["complaint_text"]) == 200 and whole.text == cut.text


def test_upsert_stores_a_repeated_batch_key_once(spark):
    index = spark.createDataFrame([("a", "old"), ("b", "old")], "doc_id string, text string")
    batch = spark.createDataFrame([("a", "new"), ("a", "newer"), ("c", "new")], "doc_id string, text string")
    got = retrieval.upsert(index, batch).collect()
    assert sorted(r.doc_id for r in got) == ["a", "b", "c"]
    assert {r.text for r in got if r.doc_id == "a"} <= {"new", "newer"}


def test_context_keeps_hits_without_text(spark):
    hits = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 11, 0.8)], "query_id int, rank int, vec_id int, similarity double")
    texts = spark.createDataFrame([(10, "t")], "vec_id int, text string")
    assert retrieval.prompt_context(hits, texts).first().n_records == 2


def test_csv_quotes_line_breaks_and_header_order(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    path = tmp_path / "x.csv"
    path.write_text('b,extra,a\n"said ""no"" to me, twice",1,2\n"two\nlines",1,NA\n,1,4\n')
    got = [tuple(r) for r in read_csv(spark, str(path), schema).orderBy("a").collect()]
    assert got == [(None, "two\nlines"), (2, 'said "no" to me, twice'), (4, None)]
    path.write_text("b\n1\n")
    with pytest.raises(ValueError, match="lacks a"):
        read_csv(spark, str(path), schema)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("name", ["features_app", "rate_score"])
def test_fact_rows_are_not_shuffled_for_lookups(spark, small_dir, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        df = features.features_app(raw(spark, small_dir)) if name == "features_app" else model.rate_score(fa(spark, small_dir))
        plan = executed(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Nothing but the lookup itself (which has no booking column) may be dealt by route.
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_lookup_beyond_the_limit_is_not_broadcast(spark):
    small = spark.range(50).groupBy("id").count()
    assert "broadcast" in checked_lookup(small)._jdf.queryExecution().logical().toString().lower()
    assert "strategy=broadcast" not in checked_lookup(small, limit=10)._jdf.queryExecution().logical().toString().lower()
    renamed = checked_lookup(spark.range(50).groupBy("id").count().withColumnRenamed("count", "n"))
    assert renamed.columns == ["id", "n"] and renamed.first().n == 1
    assert columns.LOOKUP_ROWS > 0


def test_split_has_exact_sizes_and_narrow_sort(spark):
    df = spark.range(1003).select(F.col("id").alias("booking_id"), (F.col("id") % 5 == 0).cast("int").alias("is_cancelled"))
    got = {(r.is_cancelled, r.split): r["count"] for r in
           model.stratified_split(df).groupBy("is_cancelled", "split").count().collect()}
    assert got == {(1, "test"): 41, (1, "train"): 160, (0, "test"): 161, (0, "train"): 641}


def test_route_mean_can_come_from_other_rows(spark):
    train = one_booking(spark, total_fare_inr=100.0, customer_complaint=None)
    rows = one_booking(spark, total_fare_inr=300.0, customer_complaint=None)
    assert features.features_app(rows, route_mean_from=train).first().fare_to_avg_route_fare == pytest.approx(3.0)
