"""M8, second-order boosted trees on binned rows.

Every number becomes the index of one of at most ``MAX_BINS`` quantile bins (a byte), every
category the index of its level, once, before the first tree.  A level of a tree is one pass
over the binned rows (``tree_rows.py``): tasks add up gradient and hessian per (node, column,
bin), and the driver, which only sees sums, picks for each
node the split of the largest gain.  The one-hot columns are never built: a split on
one is "this level against all others", read from the level's own sums.

* Leaf weight -G / (H + l2), gain of a split GL²/(HL+l2) + GR²/(HR+l2) - G²/(H+l2), both
  children at least ``min_child_weight`` of hessian, shrinkage ``rate``; the base score is
  a probability of 0.5.
* Gradients and hessians are added as integers (units of 2**-24), so neither the number of
  tasks nor their order changes a tree.
* The rows' margins are kept beside their bins: a tree is applied to them once, when the next
  one is begun.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import APP_CATEGORICAL_FEATURES, APP_NUMERIC_FEATURES
from ..session import scratch_path, ship
from .model import model_input, preprocess_stages, typed_inputs
from .tree_rows import OUT, Layout, TreeRows, Trees, bin_codes, binned, grow

MAX_BINS = 256
#: Trees after which the grown trees are sent to the executors; a pass carries the later ones.
REFRESH = 15
#: Rows of a task of the histogram pass: this many on small data, and on large data not fewer
#: tasks than cores and not more rows than MOST_ROWS.
TASK_ROWS, MOST_ROWS = 25_000, 1_000_000
#: Partial sums are added in two steps beyond this many tasks.
WIDE = 64
#: A gain below this is no split.
LEAST_GAIN = 1e-6
UNIT = float(1 << 24)


@dataclass
class BoostedModel:
    """Fitted preprocessing, bin edges and trees; stored as Spark tables."""
    prep: PipelineModel
    numeric: list[str]
    categorical: list[str]
    levels: list[list[str]]
    edges: list[np.ndarray]
    trees: Trees

    def save(self, spark: SparkSession, path: str) -> None:
        self.prep.write().overwrite().save(f"{path}/prep")
        t = self.trees
        nodes = [(k, i, int(t.column[k, i]), int(t.cut[k, i]), float(t.gain[k, i]), float(t.value[k, i]))
                 for k in range(len(t.column)) for i in range(t.column.shape[1])]
        spark.createDataFrame(nodes, "tree int, node int, split int, cut int, gain double, value double") \
             .write.mode("overwrite").parquet(f"{path}/trees")
        columns = [(i, c, "numeric", [float(x) for x in e], None)
                   for i, (c, e) in enumerate(zip(self.numeric, self.edges))]
        columns += [(len(self.numeric) + i, c, "category", None, v)
                    for i, (c, v) in enumerate(zip(self.categorical, self.levels))]
        spark.createDataFrame(columns, "place int, name string, kind string, edges array<double>, "
                                       "levels array<string>").write.mode("overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        nodes = spark.read.parquet(f"{path}/trees").toPandas().sort_values(["tree", "node"])
        n = nodes["tree"].nunique()
        arrays = [nodes[c].to_numpy().reshape(n, -1) for c in ("split", "cut", "gain", "value")]
        depth = int(np.log2(arrays[0].shape[1] + 1)) - 1
        columns = spark.read.parquet(f"{path}/columns").orderBy("place").collect()
        numeric = [r for r in columns if r["kind"] == "numeric"]
        category = [r for r in columns if r["kind"] == "category"]
        return cls(PipelineModel.load(f"{path}/prep"), [r["name"] for r in numeric], [r["name"] for r in category],
                   [r["levels"] for r in category], [np.array(r["edges"]) for r in numeric], Trees(*arrays, depth))

    def score(self, df: DataFrame, out: str = "probability_1") -> DataFrame:
        """``df`` with ``label``, ``prediction`` and P(cancel); for tables and streams."""
        ship(df.sparkSession)
        made = self.prep.transform(model_input(df, self.categorical, self.numeric))
        inputs = [f"{c}__dz" for c in self.numeric] + [f"{c}__idx" for c in self.categorical]
        edges, trees, n_numeric = self.edges, self.trees, len(self.numeric)

        @F.pandas_udf("double")
        def probability(values: pd.DataFrame) -> pd.Series:
            codes = _codes([values[c].to_numpy() for c in inputs], edges)
            return pd.Series(1 / (1 + np.exp(-trees.margin(codes, n_numeric))))
        keep = [c for c in df.columns] + ["label"]
        return (made.withColumn(out, probability(F.struct(*inputs))).select(*keep, out)
                .withColumn("prediction", (F.col(out) > 0.5).cast("double")))

    def importance(self, spark: SparkSession, k: int = 15) -> DataFrame:
        """``feature``, ``importance`` (mean gain of its splits, all adding up to 1), ``splits``, ``rank``."""
        n = len(self.numeric)
        rows: dict[str, list[float]] = {}
        t = self.trees
        for tree, node in zip(*np.nonzero(t.column >= 0)):
            c = int(t.column[tree, node])
            name = self.numeric[c] if c < n else \
                f"{self.categorical[c - n]}_{self.levels[c - n][int(t.cut[tree, node])]}"
            rows.setdefault(name, []).append(float(t.gain[tree, node]))
        total = sum(sum(g) / len(g) for g in rows.values()) or 1.0
        df = spark.createDataFrame([(f, sum(g) / len(g) / total, len(g)) for f, g in rows.items()],
                                   "feature string, importance double, splits int")
        by = Window.orderBy(F.desc("importance"), "feature")              # one row per feature
        return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _codes(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Rows x columns: the bin of each number (how many edges are below it), the level of each category."""
    return np.column_stack(bin_codes(columns, edges)).astype(np.int32)


def _mix(x: np.ndarray) -> np.ndarray:
    """Even 64-bit hashes of 64-bit keys, for the row samples."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sampled(keys: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows tree number ``tree`` sees: a hash of the row's key, the same on every run."""
    if share >= 1:
        return np.ones(len(keys), bool)
    salt = _mix(np.array([seed * 1_000_003 + tree + 1], np.uint64))[0]
    return _mix(keys.astype(np.int64).view(np.uint64) ^ salt) < np.uint64(int(share * 2**64))


def quantile_edges(rows: DataFrame, columns: list[str], bins: int = MAX_BINS) -> list[np.ndarray]:
    """At most ``bins`` - 1 distinct edges per column, at its evenly spaced quantiles (one pass)."""
    at = [float(q) for q in np.arange(1, bins) / bins]
    found = rows.agg(*[F.percentile_approx(c, at, 20 * bins).alias(c) for c in columns]).first()
    return [np.unique(np.array(found[c] or [], float)) for c in columns]


@dataclass
class SecondOrder:
    """Gradient and hessian of the logistic loss, in units of 2**-24, for a tree's sample of the rows."""
    seed: int
    share: float
    channels = stored = 2

    def values(self, label: np.ndarray, margin: np.ndarray, tree: int, key: np.ndarray, part: int,
               first: int) -> np.ndarray:
        p = 1 / (1 + np.exp(-margin))
        out = np.empty((2, len(label)), np.int32)
        out[0] = np.rint((p - label) * UNIT)
        out[1] = np.rint(np.maximum(p * (1 - p), 1e-16) * UNIT)
        if self.share < 1:
            out[0, ~sampled(key, tree, self.seed, self.share)] = OUT
        return out

    def weights(self, values: np.ndarray) -> list:
        return [values[0].astype(float), values[1].astype(float)]


def _ten_digits(x: np.ndarray) -> np.ndarray:
    scale = 10.0 ** (9 - np.floor(np.log10(np.maximum(np.abs(x), 1e-30))))
    return np.rint(x * scale) / scale


def best_split(g: np.ndarray, h: np.ndarray, widths: list[int], n_numeric: int, l2: float,
               min_child_weight: float) -> tuple[float, int, int, float, float]:
    """(gain, column, cut, left gradient, left hessian) of a node from its sums per bin; no split: gain 0.

    Of equal gains the first column and the first cut win; gains are compared to 10 digits.
    """
    g_all, h_all = g[:widths[0]].sum(), h[:widths[0]].sum()
    best = (0.0, -1, 0, 0.0, 0.0)
    first = 0
    for c, width in enumerate(widths):
        gc, hc = g[first:first + width], h[first:first + width]
        first += width
        if c < n_numeric:
            gl, hl = np.cumsum(gc)[:-1], np.cumsum(hc)[:-1]
        else:                                   # the level goes right, all others left
            gl, hl = g_all - gc, h_all - hc
        gr, hr = g_all - gl, h_all - hl
        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g_all**2 / (h_all + l2)
        gain[(hl < min_child_weight) | (hr < min_child_weight)] = 0.0
        if len(gain):
            rounded = _ten_digits(gain)
            k = int(np.argmax(rounded))
            if rounded[k] > max(best[0], LEAST_GAIN):
                best = (float(rounded[k]), c, k, float(gl[k]), float(hl[k]))
    return best


def fit_newton(train: DataFrame, categorical: list[str] = APP_CATEGORICAL_FEATURES,
               numeric: list[str] = APP_NUMERIC_FEATURES, n_trees: int = 100, depth: int = 6, rate: float = 0.3,
               subsample: float = 1.0, l2: float = 1.0, min_child_weight: float = 1.0, seed: int = 42,
               category_fill: str = "constant", key: str = "booking_id", bins: int = MAX_BINS) -> BoostedModel:
    """M8: fit boosted trees; the defaults are the library's defaults of the reference's notebook.

    The dashboard's form is ``n_trees=300, depth=4, rate=0.05, subsample=0.8``.
    """
    spark = train.sparkSession
    ship(spark)
    data = typed_inputs(train.withColumn("_key", F.xxhash64(key)), categorical, numeric, "_key")
    try:
        fill, scale = preprocess_stages(data, categorical, numeric, category_fill)[:2]
        index = StringIndexer(inputCols=[f"{c}__f" for c in categorical], outputCols=[f"{c}__idx" for c in categorical],
                              handleInvalid="keep", stringOrderType="alphabetAsc")
        prep = Pipeline(stages=[fill, scale, index]).fit(data)
        made = prep.transform(data)
        levels = [list(x) for x in prep.stages[-1].labelsArray]
        scaled = [f"{c}__dz" for c in numeric]
        edges = quantile_edges(made, scaled, bins)
        n = data.count()
        tasks = max(1, min(n // TASK_ROWS, max(spark.sparkContext.defaultParallelism, n // MOST_ROWS)))
        inputs = scaled + [f"{c}__idx" for c in categorical]
        widths = [len(e) + 1 for e in edges] + [len(x) for x in levels]
        layout = Layout(len(numeric), widths)
        blocks = binned(made.withColumnRenamed("_key", "key"), inputs, edges, layout)
        rows = TreeRows(blocks, layout, SecondOrder(seed, subsample),
                        scratch_path(spark, f"boosting-{uuid.uuid4().hex[:12]}"), tasks, REFRESH, WIDE)
    finally:
        data.unpersist()

    def choose(sums: np.ndarray) -> tuple:
        gain, column, cut, gl, hl = best_split(*(sums / UNIT), widths, len(numeric), l2, min_child_weight)
        return gain, column, cut, np.array([gl, hl]) * UNIT

    def settle(trees: Trees, tree: int, node: int, sums: np.ndarray) -> None:
        g, h = sums / UNIT
        trees.value[tree, node] = -rate * g / (h + l2)
    try:
        trees = grow(rows, n_trees, depth, choose, settle)
    finally:
        rows.drop()
    return BoostedModel(prep, list(numeric), list(categorical), levels, edges, trees)
