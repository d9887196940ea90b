"""Cancellation-risk modelling M1-M18 on Spark ML.

* M3 split: exact stratified 80/20 - rows are ordered inside their class by a seeded md5
  key and the first ceil(20 %) of each class is the test set.  The cut is found by counts
  per hash prefix; the skew-safe positional rank orders the rows of one prefix only.
* M4/M5 preprocessing is a ``Pipeline``: median imputation (train medians) + standard
  scaling for numbers; 'Unknown' fill + StringIndexer(keep) + OneHotEncoder for
  categories - unseen and missing levels encode to all zeros.
* M7 logistic regression with balanced class weights (weight = n / (2 n_class)) and
  regParam = 1 / n_train, the Spark form of an L2 penalty with C = 1.
* M8 gradient-boosted trees (first-order boosting; same task, not the same numbers as
  a second-order library).
* M9 metrics from confusion counts; ROC-AUC with ``BinaryClassificationEvaluator``
  without down-sampling (numBins=0: exact, tie-aware); ROC curve and rank-sum AUC from a
  per-distinct-score table (aggregate first, then cumulate the small table).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import checked_lookup, with_scalars
from ..functions.quantiles import column_medians
from ..functions.ranking import position_in_group, running_totals
from ..schema import APP_CATEGORICAL_FEATURES, APP_NUMERIC_FEATURES, RISK_TIERS
from . import first_order


# ----------------------------------------------------------------------------- M3 split
#: Hex digits of the hash by which rows are counted before the cut is looked for.
HASH_DIGITS = 4


def stratified_split(df: DataFrame, label: str = "is_cancelled", key: str = "booking_id",
                     test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` in {'train','test'}: exactly ceil(test_fraction x n_class) test rows per
    class, chosen by the order of md5('<seed>:' || key) - repeatable on any engine."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    # Rows are counted per class and hash prefix; only the rows of the one prefix that holds a
    # class's cut (the first row beyond its test rows) are sorted.  A missing key sorts first.
    prefix = F.coalesce(F.conv(F.substring("_h", 1, HASH_DIGITS), 16, 10).cast("int"), F.lit(-1))
    narrow = (df.select(F.col(label).alias("_class"), h.alias("_h"), F.col(key).alias("_key"))
              .withColumn("_prefix", prefix))
    counts = checked_lookup(narrow.groupBy("_class", "_prefix").agg(F.count(F.lit(1)).alias("_c")))
    upto = Window.partitionBy("_class").orderBy("_prefix")
    sizes = counts.groupBy("_class").agg(F.sum("_c").alias("_n"))
    place = F.ceil(F.col("_n") * test_fraction)
    holds = (counts.withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
             .withColumn("_n", F.sum("_c").over(Window.partitionBy("_class")))
             .where((F.col("_before") <= place) & (place < F.col("_before") + F.col("_c")))
             .select("_class", "_prefix", (place - F.col("_before")).alias("_at")))
    near = narrow.join(checked_lookup(holds), ["_class", "_prefix"])
    cuts = (position_in_group(near, "_class", ["_h", "_key"], "_pos").where(F.col("_pos") == F.col("_at"))
            .select("_class", F.struct("_h", "_key").alias("_cut")))
    classes = checked_lookup(sizes.select("_class").join(cuts, "_class", "left"))  # one row per class
    mine = F.struct(h.alias("_h"), F.col(key).alias("_key"))
    test = F.col("_cut").isNull() | (mine < F.col("_cut"))
    return (df.join(classes, F.col(label) == F.col("_class"))
            .withColumn("split", F.when(test, "test").otherwise("train")).drop("_class", "_cut"))


# ----------------------------------------------------------------------------- M6 one-hot
def onehot_drop_first(df: DataFrame, columns: list[str], key: str = "booking_id",
                      sep: str = "|") -> DataFrame:
    """Active one-hot feature names per row with the first (sorted) level of every column
    dropped; a missing value is its own level 'nan' (sorted last, as NaN is).

    The first level per column comes from one aggregate (a one-row scalar subquery);
    the encoding itself is a projection - no shuffle of the rows.
    """
    firsts = df.agg(*[F.coalesce(F.min(F.col(c).cast("string")), F.lit("nan")).alias(f"_f_{c}")
                      for c in columns])
    feats = []
    for c in columns:
        v = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        feats.append(F.when(v != F.col(f"_f_{c}"), F.concat(F.lit(f"{c}_"), v)))
    return (with_scalars(df, firsts)
            .select(key, F.array_join(F.array_sort(F.array_compact(F.array(*feats))), sep)
                    .alias("active_features")))


# ----------------------------------------------------------------------------- M16/M17
def risk_tier(prob_pct):
    """Tier label and action from a probability in percent."""
    (hi, hi_lab, hi_act), (mid, mid_lab, mid_act), (_, lo_lab, lo_act) = RISK_TIERS
    tier = F.when(prob_pct >= hi, hi_lab).when(prob_pct >= mid, mid_lab).otherwise(lo_lab)
    action = F.when(prob_pct >= hi, hi_act).when(prob_pct >= mid, mid_act).otherwise(lo_act)
    return tier, action


def risk_reasons(df: DataFrame) -> DataFrame:
    """Lead time, fare and history impact labels."""
    lead, fare, prior = F.col("lead_time_days"), F.col("total_fare_inr"), F.col("prior_bookings")
    return df.withColumns({
        "lead_impact": F.when(lead > 90, "High").when(lead > 30, "Medium").otherwise("Low"),
        "fare_impact": F.when(fare > 100000, "High").when(fare > 30000, "Medium").otherwise("Low"),
        "history_impact": F.when(prior > 3, "Low (loyal customer)").when(prior > 0, "Medium")
                           .otherwise("High (new customer)"),
    })


def rate_score(fa: DataFrame) -> DataFrame:
    """A transparent formula score: mean of the historical cancellation rate of the
    booking's channel and of its lead-time band (overall rate when the band is empty).
    Rates are per-group aggregates joined back.  The lead-band table has the 5 fixed
    bands (broadcast); the channel table is data-derived, so it is written and counted
    before it may be broadcast."""
    label = F.col("is_cancelled").cast("double")
    ch = fa.groupBy("booking_channel").agg(F.avg(label).alias("_ch_rate"))
    lb = fa.where(F.col("lead_time_bin").isNotNull()).groupBy("lead_time_bin").agg(F.avg(label).alias("_lb_rate"))
    overall = fa.agg(F.avg(label).alias("_all_rate"))
    return (with_scalars(fa.join(checked_lookup(ch), "booking_channel", "left")
                         .join(F.broadcast(lb), "lead_time_bin", "left"), overall)
            .withColumn("score", (F.col("_ch_rate") + F.coalesce("_lb_rate", "_all_rate")) / 2)
            .withColumn("channel_cancel_pct", F.col("_ch_rate") * 100)
            .drop("_ch_rate", "_lb_rate", "_all_rate"))


# ----------------------------------------------------------------------------- M9/M10
def confusion_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """2x2 grid (actual, predicted, count) with zero cells."""
    spark = pred.sparkSession
    grid = spark.createDataFrame([(a, p) for a in (0, 1) for p in (0, 1)], "actual int, predicted int")
    counts = (pred.select(F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted"))
              .groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("count")))
    return F.broadcast(grid).join(counts, ["actual", "predicted"], "left").fillna({"count": 0})


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M9: precision, recall, F1 (0 when undefined) from one aggregate of confusion counts."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    c = pred.agg(F.sum(((y == 1) & (p == 1)).cast("bigint")).alias("tp"),
                 F.sum(((y == 0) & (p == 1)).cast("bigint")).alias("fp"),
                 F.sum(((y == 0) & (p == 0)).cast("bigint")).alias("tn"),
                 F.sum(((y == 1) & (p == 0)).cast("bigint")).alias("fn"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return (c.withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                      F.col("precision") + F.col("recall")), F.lit(0.0))))


def roc_table(scored: DataFrame, score: str = "score", label: str = "label", digits: int | None = None) -> DataFrame:
    """M9 curve: one row per distinct score (desc) with cumulative TP/FP, TPR, FPR and the
    tie-aware AUC (= rank-sum AUC with average ranks).

    Rows are aggregated by score first (partial aggregation); the cumulative counts over
    the distinct scores are range-sliced running totals, so no task holds the whole
    curve.  Negatives below a threshold are N - FP (thresholds are distinct); class
    totals and the AUC are scalar subqueries.  ``digits`` bins continuous scores.
    """
    s = F.col(score).cast("double")
    if digits is not None:
        s = F.round(s, digits)
    per = (scored.select(s.alias("threshold"), F.col(label).cast("int").alias("_y"))
           .groupBy("threshold").agg(F.sum("_y").cast("bigint").alias("pos"),
                                     F.sum(1 - F.col("_y")).cast("bigint").alias("neg")))
    cum = (running_totals(per, F.col("threshold").desc(), ["pos", "neg"])
           .withColumnsRenamed({"pos_cum": "tp", "neg_cum": "fp"}))
    totals = per.agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    out = with_scalars(cum, totals).withColumn(
        "_auc_part", F.col("pos") * ((F.col("_N") - F.col("fp")) + F.col("neg") / 2.0))
    auc = out.agg(F.try_divide(F.sum("_auc_part"), (F.first("_P") * F.first("_N")).cast("double"))
                  .alias("auc"))
    return (with_scalars(out, auc)
            .withColumn("tpr", F.try_divide(F.col("tp").cast("double"), F.col("_P")))
            .withColumn("fpr", F.try_divide(F.col("fp").cast("double"), F.col("_N")))
            .select("threshold", "pos", "neg", "tp", "fp", "tpr", "fpr", "auc"))


# ----------------------------------------------------------------------------- M4-M8
def class_weights(train: DataFrame, label: str = "is_cancelled") -> DataFrame:
    """Balanced weights n / (2 n_class) as a two-row frame."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = counts.agg(F.sum("_nc").alias("_n"))
    return with_scalars(counts, total).select(label, (F.col("_n") / (2.0 * F.col("_nc"))).alias("weight"))


def preprocess_stages(train: DataFrame, categorical: list[str], numeric: list[str],
                      category_fill: str = "constant") -> list:
    """M4 / M5: fill, scale, index and one-hot encode ``model_input`` columns.

    Numbers: the exact interpolated median of the training rows for missing values, then
    (x - mean) / population standard deviation (1 where that is 0).  Categories: 'Unknown',
    or with ``category_fill="mode"`` the commonest training value (ties: the first in
    order).  The fitted numbers are literals of two SQL stages, so a saved pipeline holds them.
    """
    stages = []
    if category_fill == "mode":
        # All columns in one pass: the least (-count, value) of each.
        cells = train.select([F.col(f"{c}__s") for c in categorical]).unpivot(
            [], [f"{c}__s" for c in categorical], "column_name", "v").where(F.col("v").isNotNull())
        top = (cells.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("column_name").agg(F.min(F.struct(-F.col("n"), F.col("v"))).alias("_top")))
        modes = {r["column_name"]: r["_top"]["v"] for r in top.collect()}
        filled = [f"coalesce(`{c}__s`, {_sql_text(modes.get(f'{c}__s', 'Unknown'))}) AS `{c}__f`" for c in categorical]
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__"))
    else:
        filled = [f"coalesce(`{c}__s`, 'Unknown') AS `{c}__f`" for c in categorical]
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__"))
    names = [f"{c}__d" for c in numeric]
    medians = column_medians(train, names)
    whole = {c: F.coalesce(F.col(c), F.lit(float(medians.get(c, 0.0)))) for c in names}
    one = train.agg(*[F.avg(x).alias(f"{c}_m") for c, x in whole.items()],
                    *[F.stddev_pop(x).alias(f"{c}_s") for c, x in whole.items()]).first()
    scaled = [f"(coalesce(`{c}`, {float(medians.get(c, 0.0))!r}D) - {float(one[f'{c}_m'] or 0.0)!r}D)"
              f" / {float(one[f'{c}_s'] or 1.0)!r}D AS `{c}z`" for c in names]
    stages += [SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"),
               VectorAssembler(inputCols=[f"{c}z" for c in names], outputCol="_num_scaled", handleInvalid="keep")]
    idx = [f"{c}__idx" for c in categorical]
    ohe = [f"{c}__ohe" for c in categorical]
    stages += [StringIndexer(inputCols=[f"{c}__f" for c in categorical], outputCols=idx,
                             handleInvalid="keep", stringOrderType="alphabetAsc"),
               OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True),
               VectorAssembler(inputCols=["_num_scaled"] + ohe, outputCol="features")]
    return stages


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def model_input(df: DataFrame, categorical: list[str], numeric: list[str], label: str = "is_cancelled") -> DataFrame:
    """Typed model inputs: doubles and strings; missing values stay null."""
    cols = {f"{c}__d": F.col(c).cast("double") for c in numeric}
    cols.update({f"{c}__s": F.col(c).cast("string") for c in categorical})
    cols["label"] = F.col(label).cast("double")
    return df.withColumns(cols)


def typed_inputs(train: DataFrame, categorical: list[str], numeric: list[str], *more: str) -> DataFrame:
    """The model inputs alone, kept (memory, then disk) while a fit passes over them a dozen times.

    Features and split are made in the first pass only.  The rows stay in their partitions, in their
    order, so that the row samples of the trees are those of the table itself.
    """
    data = model_input(train, categorical, numeric)
    return data.select(*[f"{c}__d" for c in numeric], *[f"{c}__s" for c in categorical], "label", *more).persist()


def fit_logistic(train: DataFrame, categorical=APP_CATEGORICAL_FEATURES, numeric=APP_NUMERIC_FEATURES,
                 max_iter: int = 1000, category_fill: str = "constant") -> PipelineModel:
    """M7: balanced logistic regression, L2 with C = 1 (regParam = 1 / n_train)."""
    data = typed_inputs(train.where(F.col("is_cancelled").isNotNull()), categorical, numeric)
    try:
        weights = [(r["label"], r["weight"]) for r in class_weights(data, "label").collect()]     # one row per class
        n_train = data.count()
        lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                                maxIter=max_iter, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                standardization=False)
        weight = F.coalesce(F.lit(None).cast("double"), *[F.when(F.col("label") == y, F.lit(w)) for y, w in weights])
        return Pipeline(stages=preprocess_stages(data, categorical, numeric, category_fill) + [lr]).fit(
            data.withColumn("weight", weight))
    finally:
        data.unpersist()


def fit_gbt(train: DataFrame, categorical=APP_CATEGORICAL_FEATURES, numeric=APP_NUMERIC_FEATURES,
            n_trees: int = 300, depth: int = 4, rate: float = 0.05, subsample: float = 0.8,
            seed: int = 42, category_fill: str = "constant") -> PipelineModel:
    """M8: boosted trees - 300 trees, depth 4, learning rate 0.05, row sample 0.8."""
    data = typed_inputs(train, categorical, numeric)
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=n_trees, maxDepth=depth,
                        stepSize=rate, subsamplingRate=subsample, seed=seed)
    try:
        prep = Pipeline(stages=preprocess_stages(data, categorical, numeric, category_fill)).fit(data)
        levels = next(s for s in prep.stages if isinstance(s, StringIndexerModel)).labelsArray
        trees = first_order.fit(gbt, prep.transform(data), [f"{c}__dz" for c in numeric],
                                [f"{c}__idx" for c in categorical], [list(x) for x in levels])
        return PipelineModel(prep.stages + [trees])
    finally:
        data.unpersist()


def score(model: PipelineModel, df: DataFrame, categorical=APP_CATEGORICAL_FEATURES,
          numeric=APP_NUMERIC_FEATURES, out: str = "probability_1") -> DataFrame:
    """P(cancel) per row (works on batch and streaming DataFrames)."""
    pred = model.transform(model_input(df, categorical, numeric))
    return pred.withColumn(out, vector_to_array("probability")[1])


def evaluate(model: PipelineModel, test: DataFrame, name: str, categorical=APP_CATEGORICAL_FEATURES,
             numeric=APP_NUMERIC_FEATURES) -> DataFrame:
    """M9 + M14: one metrics row for a fitted model on the test rows."""
    return metrics_row(score(model, test, categorical, numeric), name)


def metrics_row(pred: DataFrame, name: str) -> DataFrame:
    """M9 + M14 of scored rows (``label``, ``prediction``, ``probability_1``)."""
    auc = BinaryClassificationEvaluator(rawPredictionCol="probability_1", labelCol="label",
                                        metricName="areaUnderROC", numBins=0).evaluate(pred)
    return (classification_metrics(pred)
            .select(F.lit(name).alias("model"), "precision", "recall", "f1", F.lit(auc).alias("roc_auc"),
                    "tp", "fp", "tn", "fn"))


def feature_names(scored: DataFrame, numeric=APP_NUMERIC_FEATURES) -> list[str]:
    """Names of the assembled feature vector from its ML attribute metadata: the numeric
    inputs by position, then '<column>_<level>' for every one-hot slot."""
    attrs = scored.schema["features"].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a.get("name", "")) for group in attrs.values() for a in group)
    names = []
    for idx, name in slots:
        if idx < len(numeric):
            names.append(numeric[idx])
        else:
            names.append(name.replace("__ohe_", "_"))
    return names


def ranked_weights(spark, names: list[str], values: list[float], k: int = 15, name: str = "importance") -> DataFrame:
    """Top-k features by |value| (ties by name) from a fitted vector."""
    df = spark.createDataFrame(list(zip(names, [float(v) for v in values])), f"feature string, {name} double")
    w = Window.orderBy(F.abs(F.col(name)).desc(), F.col("feature"))  # one row per feature
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# FIXED VALUES: the features whose importance the dashboard looks up by name.
LOOKUP_FEATURES = ["lead_time_days", "total_fare_inr", "fare_to_avg_route_fare", "tax_ratio", "base_fare_inr"]


def importance_lookup(top: DataFrame, names: list[str] = LOOKUP_FEATURES) -> DataFrame:
    """F6 + W4: each named feature's importance ('{:.4f}', or a dash when it is not in
    the ranked table) and its rank; ``top`` is the small ranked-importance frame."""
    spark = top.sparkSession
    wanted = spark.createDataFrame(list(enumerate(names)), "ord int, feature string")
    return (F.broadcast(wanted).join(top, "feature", "left")
            .select("ord", "feature", "rank",
                    F.coalesce(F.format_number("importance", 4), F.lit("—")).alias("importance_text")))
