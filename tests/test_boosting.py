"""Second-order trees against a brute-force booster, and what a fit must not depend on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.operators import boosting, model

CATS, NUMS = ["colour", "shop"], ["x", "y"]


@pytest.fixture(scope="module")
def planted(spark):
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(10_000)) / 10_000.0
    df = spark.range(400).select(
        F.col("id").alias("booking_id"), F.round(u(1) * 10, 0).alias("x"),
        F.when(u(5) < 0.1, None).otherwise(F.round(u(2) * 4, 1)).alias("y"),
        F.when(u(3) < 0.5, "red").when(u(3) < 0.8, "blue").alias("colour"),
        F.concat(F.lit("s"), F.floor(u(6) * 5).cast("string")).alias("shop"), u(4).alias("noise"))
    logit = 0.8 * (F.col("x") - 5) + F.when(F.col("colour") == "red", 2.0).otherwise(0.0) - 1.0
    return df.withColumn("is_cancelled", (F.col("noise") < 1 / (1 + F.exp(-logit))).cast("int"))


def columns_of(m, rows):
    """The dense columns a one-hot encoder would make, in order: numbers, then levels."""
    made = m.prep.transform(model.model_input(rows, CATS, NUMS)).orderBy("booking_id").toPandas()
    dense = [made[f"{c}__dz"].to_numpy() for c in NUMS]
    for c, levels in zip(CATS, m.levels):
        dense += [(made[f"{c}__idx"].to_numpy() == i).astype(float) for i in range(len(levels))]
    return np.column_stack(dense), made["label"].to_numpy()


def brute_margins(x, y, edges, n_trees, depth, rate, l2, least, seen):
    """Boosting by trying every column and cut of every node, with plain sums."""
    margin = np.zeros(len(y))
    cuts = [edges[i] if i < len(NUMS) else np.array([0.5]) for i in range(x.shape[1])]
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        groups = [np.ones(len(y), bool)]
        step = np.zeros(len(y))
        for level in range(depth + 1):
            after = []
            for rows in groups:
                sums = lambda r: (g[r & seen[t]].sum(), h[r & seen[t]].sum())
                ga, ha = sums(rows)
                best, pick = 1e-6, None
                if level < depth:
                    for c in range(x.shape[1]):
                        for cut in cuts[c]:
                            left = rows & (x[:, c] <= cut)
                            gl, hl = sums(left)
                            gr, hr = ga - gl, ha - hl
                            if hl >= least and hr >= least:
                                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - ga**2 / (ha + l2)
                                if gain > best * (1 + 1e-9):
                                    best, pick = gain, left
                if pick is None:
                    step[rows] = -rate * ga / (ha + l2)
                else:
                    after += [pick, rows & ~pick]
            groups = after
        margin += step
    return margin


@pytest.mark.parametrize("depth,rate,share,trees", [(3, 0.3, 1.0, 4), (2, 0.1, 0.7, 5)])
def test_margins_equal_a_brute_force_booster(spark, planted, monkeypatch, depth, rate, share, trees):
    monkeypatch.setattr(boosting, "REFRESH", 2)           # margins are stored in between, too
    m = boosting.fit_newton(planted, CATS, NUMS, n_trees=trees, depth=depth, rate=rate, subsample=share)
    x, y = columns_of(m, planted)
    keys = planted.orderBy("booking_id").select(F.xxhash64("booking_id")).toPandas().iloc[:, 0].to_numpy()
    seen = [boosting.sampled(keys, t, 42, share) for t in range(trees)]
    assert share == 1 or 0.6 < np.mean(seen) < 0.8
    want = brute_margins(x, y, m.edges, trees, depth, rate, 1.0, 1.0, seen)
    got = m.score(planted).orderBy("booking_id").toPandas()["probability_1"].to_numpy()
    assert np.abs(np.log(got / (1 - got)) - want).max() < 1e-5


def test_a_fit_does_not_depend_on_partitions_and_survives_storing(spark, planted, monkeypatch, tmp_path):
    a = boosting.fit_newton(planted, CATS, NUMS, n_trees=6, depth=3)
    monkeypatch.setattr(boosting, "TASK_ROWS", 37)
    monkeypatch.setattr(boosting, "WIDE", 2)
    b = boosting.fit_newton(planted.repartition(7, "x"), CATS, NUMS, n_trees=6, depth=3)
    for one, other in ((a.trees.column, b.trees.column), (a.trees.cut, b.trees.cut), (a.trees.value, b.trees.value)):
        assert np.array_equal(one, other)
    a.save(spark, str(tmp_path / "m"))
    c = boosting.BoostedModel.load(spark, str(tmp_path / "m"))
    p = [m.score(planted).orderBy("booking_id").select("probability_1").collect() for m in (a, c)]
    assert p[0] == p[1]


def test_it_learns_and_names_what_matters(spark, planted):
    split = model.stratified_split(planted)
    train, test = (split.where(F.col("split") == s) for s in ("train", "test"))
    m = boosting.fit_newton(train, CATS, NUMS, n_trees=20, depth=3, rate=0.2)
    row = model.metrics_row(m.score(test), "trees").first()
    assert row.roc_auc > 0.8 and row.tp + row.fp + row.tn + row.fn == test.count()
    top = m.importance(spark, 3).orderBy("rank").collect()
    named = {r.feature for r in top}
    assert "x" in named and any(f.startswith("colour_") for f in named) and all(r.importance > 0 for r in top)


def test_edges_constant_columns_unseen_levels_and_missing_values(spark, planted):
    flat = planted.withColumns({"x": F.lit(1.0), "colour": F.lit(None).cast("string")})
    m = boosting.fit_newton(flat, CATS, NUMS, n_trees=2, depth=2)
    assert len(m.edges[0]) <= 1
    new = planted.limit(3).withColumns({"shop": F.lit("never seen"), "y": F.lit(None).cast("double")})
    assert m.score(new).where("probability_1 > 0 and probability_1 < 1").count() == 3
    one = planted.withColumn("is_cancelled", F.lit(1))                 # a single class
    assert boosting.fit_newton(one, CATS, NUMS, n_trees=2, depth=2).score(one).where("probability_1 <= 0.5").count() == 0
