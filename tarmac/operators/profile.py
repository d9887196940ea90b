"""Profiling and data-quality checks Q1-Q20.

Per-column statistics are computed for all columns in ONE aggregate (one scan, one
tiny shuffle) and turned into long form with ``stack``/``unpivot`` afterwards, instead
of one job per column.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws
from ..functions.columns import checked_lookup, quantile_exprs, with_scalars, safe_div
from ..functions.quantiles import quantiles
from ..session import checkpoint_dir, ship


def _stack(one_row: DataFrame, names: list[str], fields: list[str], name_col: str = "column_name") -> DataFrame:
    """Turn a one-row frame with columns ``{name}__{field}`` into one row per name."""
    parts = []
    for n in names:
        parts.append(F.struct(F.lit(n).alias(name_col),
                              *[F.col(f"`{n}__{f}`").alias(f) for f in fields]))
    return one_row.select(F.explode(F.array(*parts)).alias("_r")).select("_r.*")


def null_profile(df: DataFrame) -> DataFrame:
    """Q1-Q3: per column - position, type, non-null count, null count, null percent."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"{c}__non_null"))
    one = df.agg(*aggs)
    parts = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                      F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                      F.col(f"`{c}__non_null`").alias("non_null"))
             for i, c in enumerate(cols)]
    return (one.select("_rows", F.explode(F.array(*parts)).alias("_r"))
            .select("_r.position", "_r.column_name", "_r.dtype", "_r.non_null",
                    (F.col("_rows") - F.col("_r.non_null")).alias("nulls"),
                    safe_div((F.col("_rows") - F.col("_r.non_null")) * 100.0, F.col("_rows")).alias("null_pct")))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Q4: rows that repeat an earlier identical row (count - 1 per distinct row).

    Grouping by all columns is partial-aggregated map-side, so a heavily repeated row
    is collapsed before the shuffle.
    """
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
                      F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                                       T.FloatType, T.DoubleType, T.DecimalType))]


def numeric_summary(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Q5: count, mean, sample std, min, 25/50/75 %, max per numeric column (one pass)."""
    cols = columns or numeric_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    one = df.agg(*aggs)
    long = _stack(one, cols, ["count", "mean", "std", "min", "max"])
    # Quartiles of all columns at once: unpivot, then bounded-memory exact selection.
    values = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "column_name", "v")
    if exact:
        q = quantiles(values, "v", [0.25, 0.5, 0.75], by=["column_name"])
    else:
        q = values.groupBy("column_name").agg(quantile_exprs("v", [0.25, 0.5, 0.75], False).alias("q"))
    return long.join(F.broadcast(q), "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def column_profile(df: DataFrame, column: str) -> DataFrame:
    """Q6: rows, nulls, distinct count, most frequent value (ties: smallest) and its count."""
    c = F.col(column)
    freq = df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = freq.orderBy(F.col("n").desc(), F.col("value")).limit(1)
    stats = df.agg(F.count(F.lit(1)).alias("rows"), F.count(c).alias("non_null"),
                   F.countDistinct(c).alias("n_distinct"))
    return (with_scalars(stats, top.select(F.col("value").cast("string").alias("top_value"),
                                           F.col("n").alias("top_count")))
            .select(F.lit(column).alias("column_name"), "rows", "non_null",
                    (F.col("rows") - F.col("non_null")).alias("nulls"), "n_distinct",
                    "top_value", "top_count"))


def value_counts_all(df: DataFrame, columns: list[str], dropna: bool = True) -> DataFrame:
    """Q7-Q9: value counts of several columns in ONE groupBy over an unpivot."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "value")
    if dropna:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def normalized_counts(df: DataFrame, key: str) -> DataFrame:
    """Q10: share of each value in percent (NULLs out)."""
    vc = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return vc.withColumn("share_pct", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()))


def validate_lead_time(df: DataFrame) -> DataFrame:
    """Q12: departure - booking (days) equals lead_time_days on every row."""
    bad = F.coalesce(F.datediff("departure_date", "booking_date") != F.col("lead_time_days"), F.lit(True))
    return (df.agg(F.sum(bad.cast("bigint")).alias("violations"), F.count(F.lit(1)).alias("rows"))
            .withColumn("passes", F.col("violations") == 0))


def validate_total_fare(df: DataFrame) -> DataFrame:
    """Q13: (base + tax) x pax equals total after rounding both to 2 places."""
    expected = (F.col("base_fare_inr") + F.col("taxes_inr")) * F.col("pax_count")
    bad = F.coalesce(F.bround(expected, 2) != F.bround("total_fare_inr", 2), F.lit(True))
    return (df.agg(F.sum(bad.cast("bigint")).alias("violations"), F.count(F.lit(1)).alias("rows"))
            .withColumn("passes", F.col("violations") == 0))


def iqr_bounds(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """One-row frame: Q1, Q3, IQR and the 1.5 x IQR fences of ``column``."""
    q = (quantiles(df, column, [0.25, 0.75], out="_q") if exact
         else df.agg(quantile_exprs(column, [0.25, 0.75], False).alias("_q")))
    return q.select(F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3")).withColumns({
        "iqr": F.col("q3") - F.col("q1"),
        "lower": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
        "upper": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
    })


def iqr_outliers(df: DataFrame, column: str = "total_fare_inr", exact: bool = True) -> DataFrame:
    """Q14 rows: the rows outside the fences (bounds attached as scalar subqueries)."""
    b = iqr_bounds(df, column, exact)
    x = F.col(column)
    return with_scalars(df, b).where((x < F.col("lower")) | (x > F.col("upper")))


def iqr_outlier_summary(df: DataFrame, column: str = "total_fare_inr", exact: bool = True) -> DataFrame:
    """Q14 count form: fences plus number of outliers and rows."""
    b = iqr_bounds(df, column, exact)
    x = F.col(column)
    out = (x < F.col("lower")) | (x > F.col("upper"))
    return (with_scalars(df.select(column), b)
            .groupBy("q1", "q3", "iqr", "lower", "upper")
            .agg(F.sum(F.coalesce(out, F.lit(False)).cast("bigint")).alias("n_outliers"),
                 F.count(F.lit(1)).alias("rows"))
            .withColumn("column_name", F.lit(column)))


def box_stats(df: DataFrame, columns: list[str], by: str | None = None, exact: bool = True) -> DataFrame:
    """Q15: box-plot statistics per column (and per group ``by``).

    Two passes: quartiles per (group, column) on a long unpivot, then the whiskers
    (extreme values inside the fences) and outlier counts by joining the fences back.
    The fence table has one row per (group, column).
    """
    keys = [by] if by else []
    checkpoint_dir(df.sparkSession)
    # Narrow long frame, read by the quartile passes and the whisker pass: materialised
    # once in the shared folder so the upstream plan runs once.
    long = (df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        keys, columns, "column_name", "v").where(F.col("v").isNotNull()).checkpoint(eager=True))
    gk = keys + ["column_name"]
    qs = (quantiles(long, "v", [0.25, 0.5, 0.75], by=gk, out="_q", materialize=False) if exact
          else long.groupBy(*gk).agg(quantile_exprs("v", [0.25, 0.5, 0.75], False).alias("_q")))
    q = (qs
         .select(*gk, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3"))
         .withColumns({"lower_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                       "upper_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))}))
    inside = (F.col("v") >= F.col("lower_fence")) & (F.col("v") <= F.col("upper_fence"))
    return (long.join(F.broadcast(q), gk)
            .groupBy(*gk, "q1", "median", "q3", "lower_fence", "upper_fence")
            .agg(F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
                 F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
                 F.sum((~inside).cast("bigint")).alias("n_outliers"),
                 F.count(F.lit(1)).alias("n")))


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Q16 / Q20: equal-width histogram over [min, max]; the max falls in the last bin.

    Range comes from a one-row aggregate (a scalar subquery); bins of all groups share it.
    Every group has all ``bins`` rows, empty bins with count 0.  Without any value there
    is no range and no row.
    """
    x = F.col(column).cast("double")
    rng = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("_lo")) / width * bins), F.lit(bins - 1)))
    keys = [by] if by else []
    binned = (with_scalars(df.where(x.isNotNull()), rng)
              .select(*keys, idx.cast("int").alias("bin"), "_lo", "_hi"))
    # One row per group and the bin counts in an array of fixed length, then one row per bin.
    counts = binned.groupBy(*keys, "_lo", "_hi").agg(F.array(*[
        F.count_if(F.col("bin") == i) for i in range(bins)]).alias("_c"))
    return (counts.select(*keys, "_lo", "_hi", F.posexplode("_c").alias("bin", "count"))
            .select(*keys, "bin",
                    (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / bins).alias("bin_start"),
                    (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("bin") + 1) / bins).alias("bin_end"),
                    "count"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q17: pairwise-complete Pearson r for every pair, in one aggregate; diagonal 1."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
                   for a, b in pairs])
    structs = []
    for a, b in pairs:
        structs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"`{a}|{b}`").alias("r")))
        structs.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"`{a}|{b}`").alias("r")))
    for a in columns:
        structs.append(F.struct(F.lit(a).alias("col_a"), F.lit(a).alias("col_b"), F.lit(1.0).alias("r")))
    return one.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def target_correlation(df: DataFrame, columns: list[str], target: str = "is_cancelled") -> DataFrame:
    """Q18: correlation of each column with the 0/1 target, ranked by |r|."""
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("r")) for c in columns]
    out = one.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")
    w = Window.orderBy(F.abs("r").desc_nulls_last(), F.col("column_name"))
    return out.withColumn("rank", F.row_number().over(w))  # window over len(columns) rows


#: Rows of a batch that are drawn for at once, rows of a block, and keys whose sums a task holds.
DRAW_ROWS, DRAW_BLOCK, DRAW_KEYS = 2000, 32, 256


def _row_bytes(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """(places, rows x length bytes) for every length of an id column; the bytes of missing ids are None."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    out = [(np.flatnonzero(missing), None)] if missing.any() else []
    if pa.types.is_integer(column.type):
        whole = np.ascontiguousarray(column.fill_null(0).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(~missing)
        return [*out, (at, whole.view(np.uint8).reshape(len(whole), -1)[at])]
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    for n in np.unique(lengths[~missing]):
        at = np.flatnonzero((lengths == n) & ~missing)
        out.append((at, data[offsets[at][:, None] + np.arange(n)]))
    return out


def bootstrap_mean(df: DataFrame, key: str, value: str, n_boot: int = 1000, seed: int = 42,
                   ci: float = 95.0, row_id: str = "booking_id") -> DataFrame:
    """Q19: group mean with a bootstrap interval (Poisson(1) weights, seeded per row).

    Each row has ``n_boot`` Poisson weights derived from hash(seed, replicate, row id): the
    draw depends only on the row's own key, so a recomputed task after an executor loss draws
    the same weights.  A task draws a block of rows for all replicates at once and holds the
    weighted sums per (key, replicate), so nothing is replicated and nothing concentrates
    beyond (groups x replicates) rows.
    """
    ship(df.sparkSession)
    x = F.col(value).cast("double")
    kind = df.schema[row_id].dataType
    # xxhash64 of a whole number is that of its bytes (four up to int); other ids are hashed as text.
    kind = "int" if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)) else \
        "long" if isinstance(kind, T.LongType) else "binary" if isinstance(kind, T.BinaryType) else "string"
    base = df.where(F.col(key).isNotNull() & x.isNotNull()).select(
        F.col(key), x.alias("_v"), F.col(row_id).cast(kind).alias("_row"))
    # A row costs n_boot draws and the scan's tasks are few and uneven, so the narrow rows are dealt out.
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    base = base.repartition(tasks, "_row", "_v")
    fields = T.StructType([base.schema[key], T.StructField("_b", T.IntegerType()),
                           T.StructField("_s", T.DoubleType()), T.StructField("_n", T.LongType())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = draws.replicate_seeds(seed, n_boot)
        held: dict = {}

        def sums() -> pa.RecordBatch:
            names = pa.array(list(held), kind_of_key)
            return pa.RecordBatch.from_arrays(
                [names.take(pa.array(np.repeat(np.arange(len(held)), n_boot))),
                 pa.array(np.tile(np.arange(n_boot, dtype=np.int32), len(held))),
                 pa.array(np.concatenate([s[0] for s in held.values()])),
                 pa.array(np.concatenate([s[1] for s in held.values()]).astype(np.int64))],
                names=fields.names)
        kind_of_key = None
        for whole in batches:
            kind_of_key = whole.column(key).type
            for first in range(0, whole.num_rows, DRAW_ROWS):
                batch = whole.slice(first, DRAW_ROWS)
                coded = batch.column(key).dictionary_encode()
                codes, v = coded.indices.to_numpy(), batch.column("_v").to_numpy()
                found = np.zeros((2, len(coded.dictionary), n_boot))
                for at, rows in _row_bytes(batch.column("_row")):
                    by = np.argsort(codes[at], kind="stable")
                    for i in range(0, len(by), DRAW_BLOCK):
                        part = by[i:i + DRAW_BLOCK]
                        mine = at[part]
                        # A missing id is left out of the hash, as xxhash64 does.
                        h = np.tile(seeds, (len(part), 1)) if rows is None else draws.xxhash64(rows[part], seeds)
                        weight = draws.poisson(h).astype(np.float64)
                        present, place = np.unique(codes[mine], return_inverse=True)
                        for k, c in enumerate(present):
                            one = place == k
                            found[:, c] += np.stack([v[mine[one]], np.ones(one.sum())]) @ weight[one]
                for c, name in enumerate(coded.dictionary.to_pylist()):
                    if name in held:
                        held[name] += found[:, c]
                    else:
                        held[name] = found[:, c].copy()
                if len(held) > DRAW_KEYS:
                    yield sums()
                    held.clear()
        if held:
            yield sums()
    weighted = (base.mapInArrow(draw, fields)
                .groupBy(key, "_b").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
                .where(F.col("_n") > 0)
                .select(key, (F.col("_s") / F.col("_n")).alias("_m")))
    lo, hi = (100 - ci) / 200.0, 1 - (100 - ci) / 200.0
    ci_df = weighted.groupBy(key).agg(F.percentile("_m", F.array(F.lit(lo), F.lit(hi))).alias("_ci"))
    means = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(x).alias("mean"))
    return means.join(ci_df, key).select(key, "mean", F.col("_ci")[0].alias("ci_low"),
                                         F.col("_ci")[1].alias("ci_high"))


def little_bootstraps(df: DataFrame, key: str, value: str, n_boot: int = 200, subsets: int = 20, power: float = 0.7,
                      seed: int = 42, ci: float = 95.0, row_id: str = "booking_id") -> DataFrame:
    """Q19 without rows x replicates: group mean with a bag-of-little-bootstraps interval.

    Of a group of n rows, ``subsets`` disjoint subsets of about n ** ``power`` rows are chosen by a
    hash of the row id.  A subset, collapsed to (value, count) pairs, is drawn n rows large
    ``n_boot`` times by multinomial counts; the offsets of the drawn means from the subset's
    mean give its interval, and the intervals of the subsets are averaged around the mean of
    all rows.  The draws' cost is subsets x n_boot x n ** power at most, and a task holds one
    subset.  Rows without a value are left out; a group of one value has a point interval.
    """
    ship(df.sparkSession)
    base = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(
        F.col(key), F.col(value).cast("double").alias("_v"), F.col(row_id).alias("_row"))
    sizes = base.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("mean"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("_row")), F.lit(1 << 40)) / float(1 << 40)
    share = F.least(F.pow(F.col("_n").cast("double"), F.lit(power - 1.0)), F.lit(1.0 / subsets))
    pairs = (base.join(checked_lookup(sizes), key).withColumn("_s", F.floor(u / share)).where(F.col("_s") < subsets)
             .groupBy(key, "_s", "_n", "_v").agg(F.count(F.lit(1)).alias("_c")))
    tail = (100.0 - ci) / 2

    def draw(group: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_v")
        v, c = table.column("_v").to_numpy(), table.column("_c").to_numpy()
        n = int(table.column("_n")[0].as_py())
        state = zlib.crc32(f"{seed}:{group[0].as_py()}:{group[1].as_py()}".encode())
        rng = np.random.default_rng(state)
        share = c / c.sum()
        center = float(share @ v)
        means = np.array([rng.multinomial(n, share) @ v / n - center for _ in range(n_boot)])
        low, high = np.percentile(means, [tail, 100 - tail])
        return pa.table({key: [group[0].as_py()], "_low": [float(low)], "_high": [float(high)]},
                        schema=pa.schema([(key, table.schema.field(key).type), ("_low", pa.float64()),
                                          ("_high", pa.float64())]))
    kind = df.schema[key].dataType.simpleString()
    found = (pairs.groupBy(key, "_s").applyInArrow(draw, f"`{key}` {kind}, _low double, _high double")
             .groupBy(key).agg(F.avg("_low").alias("_low"), F.avg("_high").alias("_high")))
    return sizes.join(found, key).select(key, "mean", (F.col("mean") + F.col("_low")).alias("ci_low"),
                                         (F.col("mean") + F.col("_high")).alias("ci_high"))
