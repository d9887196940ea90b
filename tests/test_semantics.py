"""Unit checks of the semantics table on the hand-made frames of FIXTURES 4."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tarmac.functions.columns import band, quantile_exprs
from tarmac.functions.ranking import position_in_group
from tarmac.functions.text import classify, classify_notebook, matched_keywords, rules
from tarmac.operators import clean, complaints, features, metrics, model, profile, retrieval
from tarmac.schema import BOOKING_WINDOW_BANDS, LEAD_TIME_BANDS_APP, LOYALTY_BANDS
from tarmac.sources.bookings import COMPLAINT_PHRASES


def test_lead_time_bands_are_right_closed(spark):
    vals = [0, 1, 7, 8, 30, 31, 90, 180, 181, 365, 366, None]
    df = spark.createDataFrame([(v,) for v in vals], "lead_time_days bigint")
    got = [r[0] for r in df.select(band("lead_time_days", *LEAD_TIME_BANDS_APP)).collect()]
    assert got == [None, "0–7d", "0–7d", "8–30d", "8–30d", "31–90d", "31–90d", "91–180d",
                   "181d+", "181d+", None, None]
    win = [r[0] for r in df.select(band("lead_time_days", *BOOKING_WINDOW_BANDS)).collect()]
    assert win[:3] == [None, "Last_Minute", "Last_Minute"] and win[9] == "Early_Bird" and win[10] is None


def test_loyalty_bands(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 5, 6, 10, 11, 100, 101]], "prior_bookings bigint")
    got = [r[0] for r in df.select(band("prior_bookings", *LOYALTY_BANDS)).collect()]
    assert got == ["New", "Occasional", "Occasional", "Regular", "Regular", "Frequent", "Frequent", None]


def test_quantiles_interpolate_linearly(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 10.0, 4.0, None]], "v double")
    q = df.agg(quantile_exprs("v", [0.25, 0.5, 0.75]).alias("q")).first().q
    assert q == [1.75, 3.0, 5.5]
    assert df.agg(F.median("v")).first()[0] == 3.0


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([(k,) for k in "babac"], "fare_basis string").union(
        spark.createDataFrame([(None,)], "fare_basis string"))
    filled = clean.fill_with_stat(df, "fare_basis", "mode")
    assert sorted(r[0] for r in filled.collect()) == ["a", "a", "a", "b", "b", "c"]


def test_zero_divisor_gives_null(spark):
    df = spark.createDataFrame([(0.0, 0, 0.0)], "total_fare_inr double, pax_count bigint, taxes_inr double")
    r = df.select(F.try_divide("total_fare_inr", "pax_count").alias("fpp"),
                  F.try_divide("taxes_inr", "total_fare_inr").alias("tr")).first()
    assert r.fpp is None and r.tr is None


def test_null_group_key_dropped(spark):
    df = spark.createDataFrame([("A", 1.0), (None, 2.0), ("A", 3.0)], "booking_channel string, total_fare_inr double")
    out = metrics.revenue_by(df, "booking_channel").collect()
    assert out == [Row(booking_channel="A", revenue=4.0)]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125,), (2.675,)], "x double")
    assert [r[0] for r in df.select(F.bround("x", 2)).collect()] == [0.12, 2.68]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert profile.duplicate_rows(df).first().duplicates == 1


def test_months_reindexed(spark):
    df = spark.createDataFrame([("Jan", "X", 10.0), ("Mar", "Y", 5.0), ("Mar", "X", 1.0)],
                               "booking_month_name string, booking_channel string, total_fare_inr double")
    m = {r.booking_month_name: r.bookings for r in metrics.monthly(df).collect()}
    assert len(m) == 12 and m["Jan"] == 1 and m["Mar"] == 2 and m["Feb"] == 0
    mix = metrics.channel_mix_by_month(df).collect()
    feb = [r for r in mix if r.booking_month_name == "Feb"]
    mar_y = [r for r in mix if r.booking_month_name == "Mar" and r.booking_channel == "Y"][0]
    jan_y = [r for r in mix if r.booking_month_name == "Jan" and r.booking_channel == "Y"][0]
    assert all(r.bookings is None and r.share_pct is None for r in feb)
    assert mar_y.share_pct == 50.0 and jan_y.bookings == 0 and jan_y.share_pct == 0.0


def test_weekday_monday_is_zero(spark):
    df = spark.createDataFrame([("2024-01-01",)], "d string").select(F.to_date("d").alias("d"))
    assert df.select(F.weekday("d")).first()[0] == 0  # 2024-01-01 was a Monday


@pytest.mark.parametrize("k", range(len(COMPLAINT_PHRASES)))
def test_complaint_phrases_both_taxonomies(spark, k):
    expected_dash = ["Schedule / Delay", "Refund Issues", "Ticketing Issues", "Other", "Payment / Pricing",
                     "Baggage", "Other", "Seat Issues", "Visa / Documentation", "Ancillary Services",
                     "Customer Service", "Customer Service", "Other", "Other", "Ticketing Issues",
                     "Schedule / Delay", "Schedule / Delay", "Payment / Pricing", "Ancillary Services"]
    expected_nb = ["Refund Issues", "Refund Issues", "Ticketing Issues", "Ticketing Issues",
                   "Payment / Pricing Issues", "Baggage Issues", "Seat Issues", "Seat Issues",
                   "Visa / Documentation Issues", "Ancillary Service Issues", "Other", "Other", "Other",
                   "No Complaint", "Other", "Other", "Baggage Issues", "Payment / Pricing Issues", "Other"]
    df = spark.createDataFrame([(COMPLAINT_PHRASES[k],)], "t string")
    r = df.select(classify(F.col("t"), rules("dashboard")).alias("d"),
                  classify_notebook(F.col("t")).alias("n")).first()
    assert (r.d, r.n) == (expected_dash[k], expected_nb[k])


def test_regex_is_unicode_aware(spark):
    df = spark.createDataFrame([("Where is my refundé?",)], "t string")
    assert df.select(classify(F.col("t"), rules("dashboard"))).first()[0] == "Refund Issues"


def test_matched_keywords_over_all_categories(spark):
    df = spark.createDataFrame([("Flight delayed and no refund, bag lost",)], "t string")
    kw = df.select(matched_keywords(F.col("t"), rules("dashboard"))).first()[0]
    assert kw == ["bag", "delayed", "no refund", "refund"]


def test_dead_pnr_pattern_and_fix(spark):
    df = spark.createDataFrame([("PNR missing",)], "t string")
    assert df.select(classify(F.col("t"), rules("dashboard"))).first()[0] == "Other"
    assert df.select(classify(F.col("t"), rules("dashboard", fix_pnr=True))).first()[0] == "Ticketing Issues"


def test_position_in_group_matches_row_number_under_skew(spark):
    # One key holds most rows; the positional rank must equal row_number() - 1.
    rows = [(0 if i % 10 else i % 7, i, (i * 37) % 101) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, id int, t int")
    got = position_in_group(df, "k", ["t", "id"], "pos", num_slices=6)
    from pyspark.sql import Window
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")) - 1)
    assert got.select("k", "id", "pos").exceptAll(want.select("k", "id", F.col("pos").cast("bigint"))).count() == 0
    assert got.count() == 3000


def test_stratified_split_is_exact(spark):
    rows = [(str(i), 1 if i % 3 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "booking_id string, is_cancelled int")
    s = model.stratified_split(df)
    counts = {(r.is_cancelled, r.split): r["count"] for r in s.groupBy("is_cancelled", "split").count().collect()}
    assert counts[(1, "test")] == 67 and counts[(0, "test")] == 134   # ceil(20 %) of 334 / 666
    assert counts[(1, "train")] + counts[(1, "test")] == 334


def test_fare_quintile_and_duplicate_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "total_fare_inr double")
    q = [r.fare_quintile_ord for r in features.with_fare_quintile(df).orderBy("total_fare_inr").collect()]
    assert q == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    flat = spark.createDataFrame([(1.0,)] * 10, "total_fare_inr double")
    with pytest.raises(Exception, match="unique"):
        features.with_fare_quintile(flat).collect()


def test_unseen_and_null_levels_encode_to_zeros(spark):
    train = spark.createDataFrame([("A", 1.0, 0.0), ("B", 2.0, 1.0), ("A", 3.0, 1.0), ("B", 4.0, 0.0)],
                                  "airline string, lead_time_days double, is_cancelled double")
    m = model.fit_logistic(train, categorical=["airline"], numeric=["lead_time_days"], max_iter=10)
    test = spark.createDataFrame([("A", 1.0, 0.0), ("Z", 1.0, 0.0), (None, 1.0, 0.0)],
                                 "airline string, lead_time_days double, is_cancelled double")
    vecs = [r.features.toArray().tolist() for r in
            m.transform(model.model_input(test, ["airline"], ["lead_time_days"])).collect()]
    assert vecs[1][1:] == vecs[2][1:] and sum(vecs[1][1:]) == 0 and sum(vecs[0][1:]) == 1


def test_roc_auc_average_ranks(spark):
    # scores with ties; AUC by average ranks = (3 + 0.5 + 1) / 6 ... computed by hand below
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.4, 1), (0.1, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    auc = model.roc_table(df).first().auc
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(auc - want) < 1e-12


def test_cosine_topk_returns_itself_first(spark):
    vecs = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [0.6, 0.8], 1)]
    emb = spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int")
    hits = retrieval.top_k_cosine(emb, retrieval.label_exemplar_queries(emb), k=2)
    got = {(r.query_id, r.rank): (r.vec_id, r.similarity) for r in hits.collect()}
    assert got[(1, 1)] == (1, 1.0) and got[(1, 2)][0] == 3
    assert got[(2, 1)] == (2, 1.0) and got[(2, 2)] == (3, 0.8)


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "doc_id string, text string")
    new = spark.createDataFrame([("b", "2"), ("c", "2")], "doc_id string, text string")
    got = sorted(tuple(r) for r in retrieval.upsert(old, new).collect())
    assert got == [("a", "1"), ("b", "2"), ("c", "2")]


def test_has_complaint_modes(spark):
    df = spark.createDataFrame([(None,), ("",), ("No",), (" nan ",), ("Late",)], "c string")
    got = {m: [r[0] for r in df.select(complaints.has_complaint(F.col("c"), m)).collect()]
           for m in ["nonempty", "not_no", "length", "stripped"]}
    assert got["nonempty"] == [False, False, True, True, True]
    assert got["not_no"] == [False, False, False, True, True]
    assert got["length"] == [False, False, True, True, True]
    assert got["stripped"] == [False, False, True, False, True]


def test_bounded_quantiles_equal_exact_percentile_at_many_sizes(spark):
    import random
    from tarmac.functions.quantiles import quantiles
    rnd = random.Random(7)
    rows = []
    for g in range(40):
        size = rnd.choice([1, 2, 3, 5, 8, 13, 40, 101, 300])
        tie_heavy = g % 3 == 0
        for _ in range(size):
            v = float(rnd.randint(0, 4)) if tie_heavy else round(rnd.uniform(-50, 50), 2)
            rows.append((g, v))
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.g: r.q for r in quantiles(df, "v", probs, by=["g"]).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert all(abs(a - b) <= 1e-9 * max(1.0, abs(b)) for a, b in zip(got[g], want[g])), (g, got[g], want[g])


def test_tfidf_paths_agree_and_every_question_gets_k(spark):
    docs = spark.createDataFrame(
        [(f"d{i}", t) for i, t in enumerate(["refund late refund", "seat seat window", "late flight",
                                              "refund the seat", "  spaced   words here ", "window"])],
        "doc_id string, text string")
    qs = spark.createDataFrame([(0, "refund"), (1, "seat window"), (2, "unseen words")],
                               "query_id int, question string")
    out = []
    # Whole-vocabulary broadcast and the hot/cold split (max_broadcast_terms=0, and
    # max_hot_terms=2 so both hot and rare terms occur) must give the same scores.
    for max_terms in (1_000_000, 0):
        tf, idf, norms = retrieval.tfidf(docs, max_hot_terms=2, max_broadcast_terms=max_terms)
        qv = retrieval.embed_queries(qs, idf, 6)
        out.append(sorted(tuple(r) for r in retrieval.sparse_top_k(tf, norms, qv, k=3, questions=qs)
                          .select("query_id", "rank", "doc_id", "score").collect()))
    assert out[0] == out[1] and out[0][0][:3] == (0, 1, "d0")
    assert [r[:2] for r in out[0]] == [(q, k) for q in range(3) for k in (1, 2, 3)]


def test_terms_are_stems_without_signs(spark):
    docs = spark.createDataFrame([(1, "Ticketed. ticketing, (delayed) delay!")], "doc_id int, text string")
    assert sorted(r.term for r in retrieval.tokens(docs, "doc_id", "text").collect()) == ["delay", "delay", "ticket", "ticket"]


def test_running_totals_equal_a_global_window(spark):
    import random
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from tarmac.functions.ranking import running_totals
    rnd = random.Random(7)
    rows = [(float(t), rnd.randint(0, 5), rnd.randint(0, 3)) for t in rnd.sample(range(10_000), 1000)]
    df = spark.createDataFrame(rows, "t double, a int, b int")
    got = running_totals(df, F.col("t").desc(), ["a", "b"], num_slices=7)
    w = Window.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("t", F.sum("a").over(w).alias("a_cum"), F.sum("b").over(w).alias("b_cum"))
    assert sorted(got.select("t", "a_cum", "b_cum").collect()) == sorted(want.collect())


def test_with_scalars_contract(spark):
    import pytest
    from pyspark.sql import functions as F
    from tarmac.functions.columns import with_scalars
    df = spark.createDataFrame([(1, 2.0), (2, 4.0)], "k int, v double")
    stats = df.agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    got = with_scalars(df, stats).orderBy("k").collect()
    assert [(r.k, r.m, r.n) for r in got] == [(1, 3.0, 2), (2, 3.0, 2)]
    plan = with_scalars(df, stats)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
    # An empty one-row frame gives NULLs (rows are kept); two rows break the contract.
    empty = df.where("k > 5").select(F.col("v").alias("top"))
    assert [r.top for r in with_scalars(df, empty).collect()] == [None, None]
    with pytest.raises(Exception):
        with_scalars(df, df.select(F.col("v").alias("x"))).collect()


def test_crosstab_zero_cells_and_observed_categories(spark):
    from tarmac.operators import complaints
    df = spark.createDataFrame([("Baggage", "A"), ("Baggage", "A"), ("Seat Issues", "B"), ("Baggage", None)],
                               "category string, airline string")
    out = {(r.category, r.airline): (r.complaints, r.col_pct)
           for r in complaints.crosstab_pct(df, "airline").collect()}
    # Observed categories only (4 cells), zero cell kept, NULL airline dropped.
    assert out == {("Baggage", "A"): (2, 100.0), ("Seat Issues", "A"): (0, 0.0),
                   ("Baggage", "B"): (0, 0.0), ("Seat Issues", "B"): (1, 100.0)}


def test_stems_merge_inflections_but_no_numbers_and_no_other_words(spark):
    from tarmac.operators import retrieval
    text = "ticketed ticketing delay delayed cancelled cancel customs customer 1000001 1000002 class"
    got = retrieval.tokens(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", retrieval.suffix_stem)
    assert [r.term for r in got.collect()] == ["ticket", "ticket", "delay", "delay", "cancel", "cancel", "custom",
                                               "customer", "1000001", "1000002", "class"]


def test_searches_ask_for_every_id_divisible_by_20_and_chunks_change_nothing(spark, small_dir):
    from pyspark.sql import functions as F
    from tarmac.operators import retrieval
    from tarmac.plans import catalog, catalog_retrieval as plans
    emb = plans._embeddings(spark, small_dir)
    want = {r[0] for r in emb.where(F.col("vec_id") % 20 == 0).select("vec_id").collect()}
    one = catalog.REGISTRY["cosine_search"](spark, small_dir).select("query_id", "rank", "vec_id").collect()
    assert {r.query_id for r in one} == want and len(one) == 8 * len(want)
    many = retrieval.top_k_cosine(emb, plans._search_queries(emb), max_broadcast=7)
    assert sorted(map(tuple, many.select("query_id", "rank", "vec_id").collect())) == sorted(map(tuple, one))
    docs = spark.createDataFrame([(f"d{i}", f"word{i % 5} word{i % 3} other") for i in range(40)], "doc_id string, text string")
    tf, idf, norms = retrieval.tfidf(docs)
    asked = docs.selectExpr("doc_id AS query_id", "text AS question")
    qvec = retrieval.embed_queries(asked, idf, 40)
    whole, cut = [sorted(map(tuple, retrieval.sparse_top_k(tf, norms, qvec, questions=asked, max_broadcast_terms=n)
                             .select("query_id", "rank", "doc_id", "score").collect())) for n in (1000, 30)]
    assert whole == cut and len(whole) == 320


@pytest.mark.parametrize("few", [0, 200_000])
def test_bookings_join_many_parts_first_and_read_codes_back(spark, tmp_path, monkeypatch, few):
    import datetime as dt

    from tarmac.sources import bookings as source
    day = dt.date(2024, 1, 1)
    tables = {
        "nation": ([(0, "Oman", 1), (1, "Peru", 2)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(1, 0, "Web"), (2, 1, None)], "c_custkey long, c_nationkey long, c_mktsegment string"),
        "supplier": ([(1, 0, 5.0), (2, 1, None), (3, 9, 1.0)], "s_suppkey long, s_nationkey long, s_acctbal double"),
        "part": ([(1, "A", "PROMO", 3), (2, "B", "LARGE", 1), (3, "C", "MEDIUM", None), (4, None, None, 2), (4, "D", "x", 2)],
                 "p_partkey long, p_brand string, p_type string, p_size int"),
        "orders": ([(1, 1, "O", day, "1-URGENT"), (2, 2, "F", day, None), (3, 1, None, day, "4-NOT SPECIFIED")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_orderpriority string"),
        "lineitem": ([(o, p, s, n, 3.0, 90.0, 0.0, 0.5, rf, ls, day) for n, (o, p, s, rf, ls) in enumerate([
            (1, 1, 1, "R", "F"), (1, 2, 2, "R", "O"), (2, 3, 1, "A", None), (2, 4, 2, "N", "O"), (3, 4, 1, None, "F"),
            (3, 1, 3, "R", "F"), (9, 1, 1, "R", "F"), (None, 1, 1, "R", "F"), (3, 2, 1, "R", None)])],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(source, "LOOKUP_ROWS", few)
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        df = source.bookings(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = df.select("booking_id", "airline", "cabin_class", "trip_type", "booking_status", "haul_type",
                        "origin", "destination").collect()
    finally:
        spark.conf.unset(key)
    assert ("hashpartitioning(l_partkey" in plan) == (few == 0)
    if few == 0:                                     # the exchange nearer to the result comes first in the text
        assert plan.index("hashpartitioning(l_orderkey") < plan.index("hashpartitioning(l_partkey")
    m, lg = "Medium-Haul", "Long-Haul"
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        ("1-0-1-1-3", "A", "First", "One-Way", "Cancelled", m, "Oman", "Oman"),
        ("1-1-2-2-3", "B", "Business", "One-Way", "Refunded", lg, "Peru", "Oman"),
        ("2-2-3-1-3", "C", "Premium Economy", "Round-Trip", "Ticketed", lg, "Oman", "Peru"),
        ("2-3-4-2-3", None, "Economy", "Round-Trip", "Confirmed", m, "Peru", "Peru"),
        ("2-3-4-2-3", "D", "Economy", "Round-Trip", "Confirmed", m, "Peru", "Peru"),
        ("3-4-4-1-3", None, "Economy", "Multi-City", None, m, "Oman", "Oman"),
        ("3-4-4-1-3", "D", "Economy", "Multi-City", None, m, "Oman", "Oman"),
        ("3-8-2-1-3", "B", "Business", "Multi-City", None, m, "Oman", "Oman")]))
