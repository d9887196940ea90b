"""Operator 6, embedding near-dedup: spherical k-means cells, blocked cosine products.

Vectors with equal labels are compared within the cells of a spherical k-means.  A pair
above the threshold may lie in two cells; a vector is therefore also sent, as a guest, to
every cell that could own a partner: if u is nearest to centre c' and v to c, and
cos(u, v) >= t, then v.c - v.c' <= |u - v| |c - c'| <= sqrt(2 - 2t) |c - c'|.  The cells
only divide the work; no link is lost, however good or bad the centres are.

Equal vectors are one representative with a count of copies.  A large cell is dealt into
blocks, and a task multiplies two blocks.  It returns, per linked vector, the number of its
links and the root of its part of the task's links, so neither pairs nor a whole cell ever
meet in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .util import hot_split_join, ship, written

#: Vectors a cell should have, and the most cells in all; centres are at most
#: MAX_CELLS x dimension numbers, the only thing that is broadcast.
CELL = 2048
MAX_CELLS = 8192
#: A label of more than FEW vectors has cells, FEW of them at least where it has FEW times as many
#: (and there are not so many labels that this is over MAX_CELLS).
FEW = 8
#: Sampled vectors per cell that the centres are fitted on, and rounds of the fit.
SAMPLE, ROUNDS = 48, 5
#: Vectors of a block.
BLOCK = 1024
#: Products with centres a task holds at once.
PRODUCTS = 1 << 21


def unit(rows: list) -> np.ndarray:
    """The rows at length 1; scaled by a power of two first, so that no square overflows or vanishes."""
    x = np.array(rows, np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, PRODUCTS // len(centres))
    return np.concatenate([np.argmax(x[at:at + step] @ centres.T, axis=1) for at in range(0, len(x), step)])


def _representatives(vecs: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _row, _k1, _k2; keys null for unusable vectors) and one row per distinct vector."""
    v, label = F.col(vec_col), F.col(label_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = label.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    # -0.0 is 0.0 here, as it is in a product.
    plain = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))
    base = vecs.select(F.col(id_col).alias("_id"), F.when(usable, label).alias("_label"),
                       F.when(usable, plain).alias("_v"), F.monotonically_increasing_id().alias("_row"))
    keyed = base.select("*", F.when(F.col("_v").isNotNull(), F.xxhash64("_label", "_v")).alias("_k1"),
                        F.when(F.col("_v").isNotNull(), F.xxhash64(F.lit(1), "_label", "_v")).alias("_k2"))
    keyed = written(keyed, "vectors")
    reps = (keyed.where(F.col("_v").isNotNull()).groupBy("_k1", "_k2")
            .agg(F.min("_row").alias("gid"), F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies"),
                 F.first("_label").alias("label"), F.first("_v").alias("v")))
    return keyed.drop("_v", "_label"), written(reps.withColumn("dim", F.size("v")), "representatives")


def _centres(reps: DataFrame, cell: int, max_cells: int) -> dict:
    """(label, dim) -> centres, by spherical k-means on a sample of every label with some vectors.

    The first centres are the sampled vectors of the least hashes; a round adds up, in every
    task, the vectors nearest to each centre, and only these sums, a row per centre and
    task, are brought together.
    """
    sizes = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    total, labels = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    goal = max(cell, -(-total // max_cells))
    few = min(FEW, max_cells // max(1, labels))
    k = F.greatest(F.ceil(F.col("n") / goal), F.least(F.lit(few), F.ceil(F.col("n") / FEW))).cast("int")
    split = (sizes.withColumn("k", k).where("k > 1")
             .withColumn("rate", F.least(F.lit(1.0), F.col("k") * SAMPLE / F.col("n"))))
    sample = (reps.join(F.broadcast(split.drop("n")), ["label", "dim"])     # max_cells rows at most
              .where(F.pmod(F.xxhash64("gid"), F.lit(1 << 20)) < F.col("rate") * (1 << 20))
              .select("label", "dim", "k", "gid", "v"))
    sample = written(sample, "kmeans-sample")
    order = Window.partitionBy("label", "dim").orderBy(F.xxhash64("gid", F.lit(1)), "gid")
    first = sample.withColumn("cell", F.row_number().over(order) - 1).where(F.col("cell") < F.col("k"))
    centres: dict = {}
    for r in first.select("label", "dim", "cell", "v").orderBy("label", "dim", "cell").collect():
        centres.setdefault((r["label"], r["dim"]), []).append(r["v"])          # 2 max_cells rows at most
    centres = {key: unit(c) for key, c in centres.items()}
    for _ in range(ROUNDS if centres else 0):
        for r in _moved(sample, centres).collect():                            # a row per centre
            total_v = np.array(r["s"])
            if total_v.any():
                centres[r["label"], r["dim"]][r["cell"]] = unit([total_v])[0]
    return centres


def _moved(sample: DataFrame, centres: dict) -> DataFrame:
    """The sum of the sampled unit vectors nearest to each centre (label, dim, cell, s)."""
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(centres)
    kind = sample.schema["label"].dataType.simpleString()
    shape = f"label {kind}, dim int, cell int, s array<double>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for key, part in batch.to_pandas().groupby(["label", "dim"], sort=True):
                c = shared.value[key]
                x = unit(part["v"].tolist())
                np.add.at(sums.setdefault(key, np.zeros_like(c)), nearest(x, c), x)
        rows = [(label, dim, i, row) for (label, dim), s in sums.items() for i, row in enumerate(s) if row.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((_arrow(kind), pa.int32(), pa.int32(),
                                                                     pa.list_(pa.float64())))],
            names=["label", "dim", "cell", "s"])

    def total(key: tuple, table: pa.Table) -> pa.Table:
        s = np.sum(table.column("s").to_pylist(), axis=0)
        return pa.table([pa.array([k.as_py()], t) for k, t in zip(key, (_arrow(kind), pa.int32(), pa.int32()))]
                        + [pa.array([s], pa.list_(pa.float64()))], names=["label", "dim", "cell", "s"])
    return (sample.mapInArrow(add, shape).groupBy("label", "dim", "cell").applyInArrow(total, shape))


def _cells(v: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, guest) of the unit vectors ``v`` in their own cells and as guests in others."""
    dots = v @ c.T
    own = np.argmax(dots, axis=1)
    # |c - c'|, for the centres met here only; never too small, whatever the rounding.
    met, back = np.unique(own, return_inverse=True)
    gap = np.sqrt(np.maximum(2 - 2 * (c[met] @ c.T), 0) + 1e-12)
    may = dots[np.arange(len(own)), own][:, None] - dots <= reach * gap[back] + 1e-9
    may &= np.arange(len(c))[None, :] < own[:, None]
    extra, where = np.nonzero(may)
    return (np.concatenate((np.arange(len(v)), extra)), np.concatenate((own, where)),
            np.concatenate((np.zeros(len(v), bool), np.ones(len(extra), bool))))


def _assign(reps: DataFrame, centres: dict, threshold: float) -> DataFrame:
    """Every representative in its own cell, and as a guest in cells of smaller number."""
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast(centres)
    reach = float(np.sqrt(2 - 2 * threshold))
    kind = reps.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pandas()
            for (label, dim), part in d.groupby(["label", "dim"], sort=True):
                c = shared.value.get((label, dim))
                step = len(part) if c is None else max(1, PRODUCTS // len(c))
                for at in range(0, len(part), step):
                    some = part.iloc[at:at + step]
                    if c is None:
                        rows, cells, guest = np.arange(len(some)), np.zeros(len(some), int), np.zeros(len(some), bool)
                    else:
                        rows, cells, guest = _cells(unit(some["v"].tolist()), c, reach)
                    out = some.iloc[rows][["label", "dim", "gid", "copies", "v"]]
                    yield pa.RecordBatch.from_pandas(out.assign(cell=cells.astype(np.int32), guest=guest),
                                                     schema=schema, preserve_index=False)

    inner = reps.select("label", "dim", "gid", "copies", "v")
    schema = pa.schema([("label", _arrow(kind)), ("dim", pa.int32()), ("gid", pa.int64()), ("copies", pa.int64()),
                        ("v", pa.list_(pa.float64())), ("cell", pa.int32()), ("guest", pa.bool_())])
    return inner.mapInArrow(run, f"label {kind}, dim int, gid bigint, copies bigint, v array<double>, "
                                 "cell int, guest boolean")


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())


def _block_links(threshold: float):
    def links(part: pd.DataFrame) -> pd.DataFrame:
        same = part["i"].iloc[0] == part["j"].iloc[0] and not part["guest"].any()
        part = part.sort_values("gid")
        left = part[part["side"] == 0]
        right = left if same else part[part["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"gid": [], "links": [], "root": []}).astype("int64")
        hit = unit(left["v"].tolist()) @ unit(right["v"].tolist()).T >= threshold
        a, b = left["gid"].to_numpy(), right["gid"].to_numpy()
        if same:
            np.fill_diagonal(hit, False)
        per = pd.Series(hit @ right["copies"].to_numpy(), a)
        if not same:
            per = pd.concat([per, pd.Series(left["copies"].to_numpy() @ hit, b)])
        root = {int(x): int(x) for x in np.concatenate((a, b))}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(*np.nonzero(hit)):
            p, q = find(int(a[x])), find(int(b[y]))
            root[max(p, q)] = min(p, q)
        per = per[per > 0]
        return pd.DataFrame({"gid": per.index.astype("int64"), "links": per.to_numpy().astype("int64"),
                             "root": [find(int(x)) for x in per.index]})
    return links


def _links(cells: DataFrame, threshold: float, block: int) -> DataFrame:
    """(gid, links, root) per task of two blocks and linked vector in it."""
    key = ["label", "dim", "cell"]
    counts = cells.groupBy(*key).agg(F.ceil(F.sum(F.when(F.col("guest"), 0).otherwise(1)) / block).cast("int").alias("m"),
                                     F.ceil(F.sum(F.when(F.col("guest"), 1).otherwise(0)) / block).cast("int").alias("g"))
    own = F.pmod(F.xxhash64("gid"), F.when(F.col("guest"), F.col("g")).otherwise(F.col("m"))).cast("int")
    # A cell of centres only (m = 0) has guests and nobody to meet.
    placed = cells.join(counts, key).where("m > 0").withColumn("b", own)
    nums = lambda n: F.sequence(F.lit(0), n - 1)
    # Home block b meets home blocks (b, j >= b) and guest blocks numbered m, m + 1, ...
    home = F.concat(
        F.transform(nums(F.col("m")), lambda o: F.struct(F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j"),
                                                         F.when(o < F.col("b"), 1).otherwise(0).alias("side"))),
        F.when(F.col("g") > 0, F.transform(nums(F.greatest(F.col("g"), F.lit(1))), lambda o: F.struct(
            F.col("b").alias("i"), (F.col("m") + o).alias("j"), F.lit(0).alias("side")))).otherwise(F.array()))
    guest = F.transform(nums(F.col("m")), lambda o: F.struct(o.alias("i"), (F.col("m") + F.col("b")).alias("j"),
                                                             F.lit(1).alias("side")))
    dealt = placed.select(*key, "gid", "copies", "v", "guest", F.explode(
        F.when(F.col("guest"), guest).otherwise(home)).alias("t")).select(*key, "gid", "copies", "v", "guest", "t.*")
    return dealt.groupBy(*key, "i", "j").applyInPandas(_block_links(threshold), "gid bigint, links bigint, root bigint")


def embedding_groups(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                     threshold: float = 0.98, cell: int = CELL, max_cells: int = MAX_CELLS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vecs``: id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their dimensions are equal and
    their cosine in double precision is at least ``threshold``.  Null and zero vectors and
    those with null or non-finite components link with nothing.  ``component_id`` is the
    smallest non-null id reachable.  Repeated ids are vectors of their own; a null id is
    never kept unless its component has null ids only.  Other columns are not read; an
    empty table gives no rows.
    """
    ship(vecs.sparkSession)
    rows, reps = _representatives(vecs, id_col, vec_col, label_col)
    cells = written(_assign(reps, _centres(reps, cell, max_cells), threshold), "cells")
    links = written(_links(cells, threshold, block), "links")
    roots = components(links.select(F.col("gid").alias("a"), F.col("root").alias("b")))
    partners = links.groupBy("gid").agg(F.sum("links").alias("links"))
    classes = (reps.select("_k1", "_k2", "gid", "least", "copies").join(partners, "gid", "left")
               .join(roots.withColumnRenamed("node", "gid"), "gid", "left")
               .where((F.col("copies") > 1) | F.col("links").isNotNull())
               .withColumn("root", F.coalesce("root", "gid")))
    classes = written(classes, "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(classes.join(least, "root").select(
        "_k1", "_k2", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "class-ids")
    # Unusable vectors have no key and join with nothing.
    out = hot_split_join(rows, found, ["_k1", "_k2"], "copies", rows.count())
    component = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
