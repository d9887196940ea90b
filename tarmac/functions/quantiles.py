"""Exact, interpolated quantiles in bounded memory: sketch to bracket, then select.

``percentile`` (exact) keeps a value -> count map of the whole group in one task's
memory; with billions of distinct fares that does not fit.  Here:

1. One aggregate per group: row count, min, max and a Greenwald-Khanna sketch
   (``percentile_approx``) evaluated just below and just above every requested
   probability.  The sketch's rank error is at most n / accuracy, so the exact order
   statistics at ranks floor(h) and ceil(h) (h = p (n - 1)) lie inside [lo, hi].
2. One pass over the rows: per (group, probability) count the rows below ``lo`` and
   keep the rows inside [lo, hi] collapsed to (value, count) pairs - partial
   aggregation makes ties (one value repeated a billion times) a single row.
3. A running count over the few candidate values per (group, probability) gives the
   two order statistics; the result interpolates exactly like ``percentile``.

A bracket that misses (impossible within the sketch's guarantee) raises instead of
returning a wrong value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .columns import with_scalars

DEFAULT_ACCURACY = 100_000


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
              accuracy: int = DEFAULT_ACCURACY, out: str = "q", materialize: bool = True) -> DataFrame:
    """One row per group of ``by`` with ``out`` = array of exact quantiles (NULLs skipped);
    equal to ``percentile(value, probs)``.  Groups whose values are all NULL are absent."""
    by = list(by)
    probs = [float(p) for p in probs]
    k = len(probs)
    # Bracket half-widths in probability space, narrowest first.  A width w brackets
    # the exact ranks when w * n covers the sketch error (n / accuracy) plus a few ranks;
    # per group the narrowest sufficient width is used, and [min, max] when n is tiny.
    widths = [4.0 / accuracy, 1e-4, 1e-3, 1e-2, 1e-1]
    widths = sorted({w for w in widths if w >= 4.0 / accuracy})
    asks = []
    for w in widths:
        asks += [max(p - w, 0.0) for p in probs] + [min(p + w, 1.0) for p in probs]
    # The narrow (group, value) input is read by both passes; a reliable checkpoint in
    # the shared folder keeps the upstream plan from being computed twice.
    base = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if materialize:  # skip when the caller already passes a materialised frame
        checkpoint_dir(df.sparkSession)
        base = base.checkpoint(eager=True)

    sk = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"),
        F.percentile_approx("_v", F.array(*[F.lit(a) for a in asks]), accuracy).alias("_ap"))
    rows = []
    n = F.col("_n")
    for i, p in enumerate(probs):
        lo = F.col("_mn")
        hi = F.col("_mx")
        # Walk from the widest width to the narrowest so the narrowest sufficient wins.
        for j in range(len(widths) - 1, -1, -1):
            w = widths[j]
            base_ix = j * 2 * k
            ok = n * F.lit(w) >= F.lit(4.0) + n / F.lit(float(accuracy))
            lo_j = F.col("_mn") if p - w <= 0.0 else F.col("_ap")[base_ix + i]
            hi_j = F.col("_mx") if p + w >= 1.0 else F.col("_ap")[base_ix + k + i]
            lo = F.when(ok, lo_j).otherwise(lo)
            hi = F.when(ok, hi_j).otherwise(hi)
        h = F.lit(p) * (n - 1)
        rows.append(F.struct(F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi"), h.alias("h"),
                             F.floor(h).alias("r0"), F.ceil(h).alias("r1")))
    # One row per (group, probability); bounded by groups x len(probs).
    brackets = sk.select(*by, F.explode(F.array(*rows)).alias("_b")).select(*by, "_b.*")

    if by:
        # One bracket row per (group, probability): bounded by groups x len(probs).
        joined = base.join(F.broadcast(brackets), by, "inner")
    else:
        # No groups: the len(probs) brackets are one scalar array, exploded per row.
        packed = brackets.agg(F.collect_list(F.struct("i", "lo", "hi", "h", "r0", "r1")).alias("_bs"))
        joined = (with_scalars(base, packed).select("_v", F.explode("_bs").alias("_b"))
                  .select("_v", "_b.*"))
    inside = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
    # ONE aggregation: a row per candidate value (ties collapsed) plus one NULL-key row
    # per (group, probability) carrying the count of rows below the bracket.
    agg = (joined.groupBy(*by, "i", "h", "r0", "r1", F.when(inside, F.col("_v")).alias("_kv"))
           .agg(F.count(F.lit(1)).alias("_c"), F.sum((F.col("_v") < F.col("lo")).cast("bigint")).alias("_b")))
    part = Window.partitionBy(*by, "i")
    w = part.orderBy("_kv").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (agg.withColumn("_below", F.sum("_b").over(part))
              .where(F.col("_kv").isNotNull())
              .withColumn("_v", F.col("_kv"))
              .withColumn("_end", F.col("_below") + F.sum("_c").over(w))   # exclusive end rank
              .withColumn("_start", F.col("_end") - F.col("_c")))
    hit0 = (F.col("_start") <= F.col("r0")) & (F.col("r0") < F.col("_end"))
    hit1 = (F.col("_start") <= F.col("r1")) & (F.col("r1") < F.col("_end"))
    picked = (ranked.groupBy(*by, "i", "h", "r0", "r1")
              .agg(F.max(F.when(hit0, F.col("_v"))).alias("_x0"), F.max(F.when(hit1, F.col("_v"))).alias("_x1")))
    # Same interpolation as percentile: (r1 - h) * x0 + (h - r0) * x1, exact when r0 == r1.
    val = F.when(F.col("r0") == F.col("r1"), F.col("_x0")).otherwise(
        (F.col("r1") - F.col("h")) * F.col("_x0") + (F.col("h") - F.col("r0")) * F.col("_x1"))
    checked = F.when(F.col("_x0").isNull() | F.col("_x1").isNull(),
                     F.raise_error(F.lit("quantile bracket missed: raise the sketch accuracy")).cast("double")
                     ).otherwise(val)
    per = picked.select(*by, "i", checked.alias("_q"))
    return (per.groupBy(*by)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "_q"))), lambda s: s["_q"]).alias(out)))


def median(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "median") -> DataFrame:
    return quantiles(df, value, [0.5], by).select(*by, F.col("q")[0].alias(out))


def column_medians(df: DataFrame, columns: Sequence[str], accuracy: int = 20_000) -> dict[str, float]:
    """The exact interpolated median of every column (doubles; NULLs skipped; a column without values is absent).

    The method of ``quantiles`` for many columns of the same rows: one pass makes all sketches,
    one counts what is below the brackets and one keeps the values inside them.  The rows are not
    unpivoted, so only values inside a bracket are moved; ``df`` should be kept (it is read thrice).
    """
    columns, w = list(columns), 4.0 / accuracy
    cols = [F.col(c).cast("double") for c in columns]
    asks = F.array(F.lit(0.5 - w), F.lit(0.5 + w))
    one = df.agg(*[F.struct(F.count(x).alias("n"), F.min(x).alias("mn"), F.max(x).alias("mx"),
                            F.percentile_approx(x, asks, accuracy).alias("ap")).alias(f"_{i}")
                   for i, x in enumerate(cols)]).first()
    # A bracket must cover the sketch's error and a few ranks; a small column is taken whole.
    found = {i: one[f"_{i}"] for i in range(len(columns)) if one[f"_{i}"]["n"]}
    brackets = {i: (r["ap"][0], r["ap"][1]) if r["n"] * w >= 4 + r["n"] / accuracy else (r["mn"], r["mx"])
                for i, r in found.items()}
    if not found:
        return {}
    below = df.agg(*[F.count(F.when(cols[i] < F.lit(lo), 1)).alias(f"_{i}") for i, (lo, _) in brackets.items()]).first()
    kept = F.array(*[F.when((cols[i] >= F.lit(lo)) & (cols[i] <= F.lit(hi)), F.struct(F.lit(i).alias("i"), cols[i].alias("v")))
                     for i, (lo, hi) in brackets.items()])
    values = (df.select(F.explode(F.array_compact(kept)).alias("_k")).select("_k.*")
              .groupBy("i", "v").agg(F.count(F.lit(1)).alias("c")))
    order = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lower = F.coalesce(*[F.when(F.col("i") == i, F.lit(below[f"_{i}"])) for i in brackets])
    h = F.coalesce(*[F.when(F.col("i") == i, F.lit(0.5 * (r["n"] - 1))) for i, r in found.items()])
    ranked = (values.withColumn("_end", lower + F.sum("c").over(order))          # exclusive end rank
              .withColumn("_start", F.col("_end") - F.col("c")))
    at = lambda r: F.max(F.when((F.col("_start") <= r) & (r < F.col("_end")), F.col("v")))
    picked = {r["i"]: r for r in ranked.groupBy("i").agg(at(F.floor(h)).alias("x0"), at(F.ceil(h)).alias("x1")).collect()}
    out = {}
    for i, r in found.items():
        x0, x1 = (picked[i]["x0"], picked[i]["x1"]) if i in picked else (None, None)
        if x0 is None or x1 is None:
            raise ValueError("quantile bracket missed: raise the sketch accuracy")
        place = 0.5 * (r["n"] - 1)
        out[columns[i]] = x0 if place == int(place) else 0.5 * x0 + 0.5 * x1
    return out
