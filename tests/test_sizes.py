"""What moves and what is kept when tables grow: the work of a query, not its results only."""

import collections
import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from tarmac.operators import boosting, model, retrieval, vector_store


def test_split_sorts_the_rows_around_the_cut_only(spark, monkeypatch):
    sorted_rows = []
    ranked = model.position_in_group

    def watched(df, *rest, **named):
        sorted_rows.append(df.count())
        return ranked(df, *rest, **named)
    monkeypatch.setattr(model, "position_in_group", watched)
    rows = [(None if i % 997 == 0 else f"b{i % 19_000}", i % 19_000 % 4 // 3) for i in range(20_000)]
    df = spark.createDataFrame(rows, "booking_id string, is_cancelled int")
    got = sorted((r.booking_id or "", r.is_cancelled, r.split) for r in model.stratified_split(df).collect())
    order = {c: sorted((("", "") if k is None else (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
                       for k, y in rows if y == c) for c in (0, 1)}
    cut = {c: x[math.ceil(len(x) * 0.2)] for c, x in order.items()}
    mine = {k: ("", "") if k is None else (hashlib.md5(f"42:{k}".encode()).hexdigest(), k) for k, _ in rows}
    assert got == sorted((k or "", y, "test" if mine[k] < cut[y] else "train") for k, y in rows)
    assert sorted_rows and max(sorted_rows) < 100
    hot = df.withColumn("booking_id", F.lit("one"))
    assert {r.split for r in model.stratified_split(hot).collect()} == {"train"}
    assert model.stratified_split(df.limit(0)).count() == 0


def test_upsert_moves_only_the_rows_it_replaces(spark, tmp_path, monkeypatch):
    seen = []
    among = vector_store._maybe_among

    def watched(keys, key, n):
        seen.append(n)
        return among(keys, key, n)
    monkeypatch.setattr(vector_store, "_maybe_among", watched)
    store = vector_store.VectorStore(spark, str(tmp_path / "s"), buckets=4)
    rows = spark.range(4000).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    store.upsert(rows)
    twice = rows.where("doc_id in ('d1', 'd2')").withColumn("text", F.lit("again"))
    none = spark.createDataFrame([(None, "none"), (None, "none")], "doc_id string, text string")
    store.upsert(twice.unionByName(twice).unionByName(none))
    got = store.read()
    assert got.count() == 4001 and got.where("text = 'again'").count() == 2 and store.space().docs == 4001
    assert seen == [3]
    known = vector_store._maybe_among(rows.where("doc_id < 'd2'"), "doc_id", 1200)
    marked = rows.select("doc_id", known.alias("maybe"))
    assert marked.where("doc_id < 'd2' and not maybe").count() == 0
    assert marked.where("doc_id >= 'd2' and maybe").count() < 600


def test_text_index_is_a_row_per_document_and_pairs_stay_in_the_task(spark):
    texts = [(f"d{i:03}", "all same words" + " rare" * (i % 7) + f" n{i % 40}") for i in range(200)]
    texts += [("d001", "all twice"), ("d001", None), ("none", None), (None, "all rare")]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    index, idf, norms = retrieval.tfidf(docs)
    assert index.count() == 202 and norms.count() == 202 and index.agg(F.sum("copies")).first()[0] == 204
    asked = docs.where("doc_id < 'd050'").distinct().dropDuplicates(["doc_id"]).selectExpr("doc_id query_id", "text question")
    qvec = retrieval.embed_queries(asked, idf, 204)
    part = retrieval._chunk_scores(index, norms.select("_dkey", "norm"), qvec, 3, "doc_id", "query_id").groupBy("query_id")
    assert part.count().agg(F.max("count")).first()[0] <= 60                  # of 200 that share a word, 3 a task

    tf = {}
    for d, t in texts:
        c = tf.setdefault(d, collections.Counter())
        c.update(w for w in (t or "").split())
    df = collections.Counter(w for c in tf.values() for w in c)
    weight = {w: math.log(205 / (n + 1)) for w, n in df.items()}
    norm = {d: math.sqrt(sum((n * weight[w]) ** 2 for w, n in c.items())) for d, c in tf.items()}
    copies = collections.Counter(d for d, _ in texts)
    want = set()
    for q in asked.collect():
        c = collections.Counter((q.question or "").split())
        qn = math.sqrt(sum((n * weight[w]) ** 2 for w, n in c.items()))
        score = {d: round(copies[d] * sum(n * weight[w] ** 2 * tf[d][w] for w, n in c.items()) / (norm[d] * qn), 9)
                 if norm[d] and qn else 0.0 for d in tf if d}
        best = sorted(score, key=lambda d: (-score[d], d))[:3]
        want |= {(q.query_id, r + 1, d) for r, d in enumerate(best) if score[d] > 0}
    got = retrieval.sparse_top_k(index, norms, qvec, k=3, questions=asked)
    assert {(r.query_id, r["rank"], r.doc_id) for r in got.where("score > 0").collect()} == want


def test_boosted_rows_are_written_once_and_keep_their_margins(spark, monkeypatch):
    made = []
    path = boosting.scratch_path
    monkeypatch.setattr(boosting, "scratch_path", lambda s, name: made.append(name) or path(s, name))
    df = spark.range(300).selectExpr("id booking_id", "id % 7 x", "concat('c', id % 3) c", "cast(id % 7 > id % 5 as int) is_cancelled")
    fits = []
    for refresh in (2, 15):
        monkeypatch.setattr(boosting, "REFRESH", refresh)
        fits.append(boosting.fit_newton(df, ["c"], ["x"], n_trees=5, depth=2).trees)
    assert (fits[0].column == fits[1].column).all() and abs(fits[0].value - fits[1].value).max() < 1e-9
    assert len(made) == 2                                                     # one table a fit


def test_bootstrap_draws_are_the_hash_of_the_row_and_no_row_is_replicated(spark):
    from tarmac.functions import draws
    from tarmac.operators import profile
    ids = [("é" + "abcdefghij" * 8)[:n] for n in range(75)] + [None]
    df = spark.createDataFrame([(s,) for s in ids], "id string")
    seeds = draws.replicate_seeds(7, 5)
    for r in df.select("id", F.array(*[F.xxhash64(F.lit(7), F.lit(b), "id") for b in range(5)]).alias("h")).collect():
        raw = (r.id or "").encode()
        got = seeds if r.id is None else draws.xxhash64(np.frombuffer(raw, np.uint8).reshape(1, -1), seeds)[0]
        assert got.view(np.int64).tolist() == r.h

    draw = (F.abs(F.xxhash64(F.lit(7), F.col("b"), F.col("i"))) % draws.MODULUS) / float(draws.MODULUS)
    weight = sum(((draw >= p).cast("int") for p in draws.CDF), F.lit(0))
    rows = spark.range(400).selectExpr("concat('b', id) s", "cast(id - 9 as int) i4", "id - 9 i8", "concat('k', id % 3) k",
                                       "if(id % 50 = 0, null, sqrt(id)) v").withColumn("s", F.nullif("s", F.lit("b7")))
    for name in ("s", "i4", "i8"):
        plain = (rows.where("v is not null").withColumn("i", F.col(name)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(39))))
                 .withColumn("w", weight).groupBy("k", "b").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
                 .groupBy("k").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).collect())
        made = profile.bootstrap_mean(rows, "k", "v", n_boot=40, seed=7, row_id=name)
        got = {r.k: (r.ci_low, r.ci_high) for r in made.collect()}
        assert len(got) == 3 and all(abs(a - b) < 1e-9 for r in plain for a, b in zip(r.q, got[r.k]))
        assert "explode" not in made._jdf.queryExecution().toString().lower()


def test_a_csv_file_is_cut_into_files_that_one_task_can_read(spark, tmp_path, monkeypatch):
    from pyspark.sql import types as T
    from tarmac.sources import files
    monkeypatch.setattr(files, "CSV_FILE_ROWS", 100)
    rows = spark.range(250).selectExpr("id a", "if(id % 7 = 0, concat('x\n\"', id), null) b").coalesce(1)
    files.write_table(rows, str(tmp_path / "t"), fmt="csv")
    assert len(list((tmp_path / "t").glob("*.csv"))) == 3
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    back = files.read_csv(spark, str(tmp_path / "t"), schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_cells_are_assigned_without_all_products_of_a_batch():
    import tracemalloc
    from tarmac.operators import cell_search
    rng = np.random.default_rng(3)
    rows, centres = rng.normal(size=(10_000, 4)), rng.normal(size=(4096, 4))
    tracemalloc.start()
    near, cosine = cell_search._nearest(rows, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20                                                    # 328 MB in one product
    some = rows[::500] @ centres.T
    assert np.allclose(cosine[::500], some.max(axis=1)) and (near[::500] == some.argmax(axis=1)).all()
    assert [len(x) for x in cell_search._nearest(rows[:0], centres)] == [0, 0]
    assert [(p.start, p.stop) for p in cell_search._parts(3, cell_search.PRODUCTS * 2)] == [(0, 1), (1, 2), (2, 3)]
