"""The model block on planted signal: fills, scaling, learning, storing and the stream."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tarmac.operators import model

CATS, NUMS = ["colour"], ["x", "y"]


@pytest.fixture(scope="module")
def planted(spark):
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(10_000)) / 10_000.0
    df = spark.range(3000).select(
        F.col("id").alias("booking_id"), (u(1) * 10).alias("x"), F.when(u(5) < 0.1, None).otherwise(u(2) * 4).alias("y"),
        F.when(u(3) < 0.5, "red").when(u(3) < 0.8, "blue").alias("colour"), u(4).alias("noise"))
    logit = 1.5 * (F.col("x") - 5) + F.when(F.col("colour") == "red", 3.0).otherwise(0.0) - 1.5
    return df.withColumn("is_cancelled", (F.col("noise") < 1 / (1 + F.exp(-logit))).cast("int"))


def test_logistic_regression_learns_a_planted_signal_and_survives_storing(spark, planted, tmp_path):
    split = model.stratified_split(planted)
    train, test = (split.where(F.col("split") == s) for s in ("train", "test"))
    m = model.fit_logistic(train, CATS, NUMS, category_fill="mode")
    m.write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    row = model.evaluate(loaded, test, "lr", CATS, NUMS).first()
    assert row.roc_auc > 0.9 and row.tp + row.fp + row.tn + row.fn == test.count()
    names = model.feature_names(model.score(loaded, test, CATS, NUMS), NUMS)
    weights = dict(zip(names, loaded.stages[-1].coefficients.toArray()))
    assert weights["x"] > 1 and abs(weights["y"]) < 0.5 * weights["x"]
    a = model.score(m, test, CATS, NUMS).select("booking_id", "probability_1").orderBy("booking_id").collect()
    assert a == model.score(loaded, test, CATS, NUMS).select("booking_id", "probability_1").orderBy("booking_id").collect()


def test_fills_and_scaling_are_exact(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, 2.0, "b"), (3, 10.0, "a"), (4, None, None), (5, 4.0, "a"), (6, 7.0, "c")],
                               "booking_id int, x double, colour string").withColumn("is_cancelled", F.lit(0))
    data = model.model_input(df, CATS, ["x"])
    for fill, want in (("mode", "a"), ("constant", "Unknown")):
        stages = model.preprocess_stages(data, CATS, ["x"], fill)
        out = stages[1].transform(stages[0].transform(data)).orderBy("booking_id").collect()
        x = [1.0, 2.0, 10.0, 4.0, 4.0, 7.0]                      # median of the known five is 4
        mean = sum(x) / 6
        std = (sum((v - mean) ** 2 for v in x) / 6) ** 0.5
        assert [r["x__dz"] for r in out] == pytest.approx([(v - mean) / std for v in x])
        assert out[3]["colour__f"] == want


def test_stream_scores_equal_batch_scores(spark, small_dir):
    import __spark_entry__ as entry
    from tarmac.plans.catalog_model import fitted
    from tarmac.plans.catalog import fa
    lr, _ = fitted(spark, small_dir, "lr")
    want = {r.booking_id: r.p for r in model.score(lr, fa(spark, small_dir), out="p").select("booking_id", "p").collect()}
    got = entry.queries()["stream_score"](spark, small_dir)
    name = next(c for c in got.columns if "prob" in c)
    rows = got.select("booking_id", F.col(name).alias("p")).collect()
    scale = 100.0 if max(r.p for r in rows) > 1 else 1.0
    assert len(rows) == len(want)
    assert all(abs(r.p / scale - want[r.booking_id]) < 1e-6 for r in rows)


@pytest.mark.parametrize("fit", [model.fit_gbt, model.fit_logistic])
def test_a_fit_makes_its_inputs_once(planted, tmp_path, fit):
    made = str(tmp_path / "made")

    @F.udf("double")
    def counted(x):
        with open(made, "a") as f:
            f.write("x")
        return x
    train = planted.where("booking_id < 400").withColumn("x", counted("x"))
    fit(train, CATS, NUMS, **({"n_trees": 2, "depth": 2} if fit is model.fit_gbt else {"max_iter": 3}))
    assert len(open(made).read()) == 400
