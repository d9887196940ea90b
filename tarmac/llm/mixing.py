"""Operator 7, mixing sources to target weights.

Words are aggregated per source, targets follow from the weights, and the repetition
rate of a source is target / words.  Every document is emitted floor(rate) times plus one
Bernoulli copy with probability equal to the fraction of the rate.

The Bernoulli draw compares a hash of the document id with the fraction, so reruns agree
and no shared random state is needed.  Each source picks, out of ``DRAWS`` hash seeds, the
one whose total comes closest to its target: one aggregate sums all seeds in one pass.  A
source with few or very uneven documents thus comes near its target too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import WORD_RE, free_name, written

#: Hash seeds tried per source: eight SHA-256 digests of eight 32-bit draws each.
DRAWS = 64
#: A source is repeated at most this many times.
MAX_RATE = 3
#: Weights by the code-point rank of the source, repeating.
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Number of words in ``text`` as long; null counts as no word."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """``sizes`` (source, source_size) with each source's ``target``.

    Targets are the weighted shares of all words; one above ``max_rate`` times its source's
    size is cut to that, and the excess goes to the others by weight until none is above.
    That fixed point is found in closed form: with sources ordered by cap / weight, the
    capped ones are a prefix, and the prefix is the longest for which the level
    (words left / weight left) exceeds the next source's cap / weight.

    The frame has one row per source name, already aggregated; the two windows below order
    those rows only, not documents.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]),
                        (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * max_rate
    ranked = sizes.withColumn("_w", pick.cast("double")).withColumn("_cap", cap.cast("double"))
    up = (Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
          .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(whole).cast("double")
    left = total - F.coalesce(F.sum("_cap").over(up), F.lit(0.0))
    weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(up), F.lit(0.0))
    level = ranked.withColumn("_level", left / weight)
    # Beyond the right prefix the level only sinks, so of the levels that keep their own
    # source below its cap the largest belongs to the shortest prefix.
    level = level.withColumn("_final", F.max(F.when(
        F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(whole))
    return level.select("source", "source_size", F.least(
        F.col("_cap"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap"))).alias("target"))


def _digest(block: Column, key: Column) -> Column:
    return F.sha2(F.concat(block.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("null"))), 256)


def _uniform(hexes: Column, start: Column) -> Column:
    """Eight hex digits from ``start`` as a number in [0, 1)."""
    return F.conv(F.substr(hexes, start, F.lit(8)), 16, 10).cast("double") / 4294967296.0


def draws(key: Column) -> Column:
    """All ``DRAWS`` uniform numbers of ``key``."""
    hexes = [_digest(F.lit(s), key) for s in range(DRAWS // 8)]
    return F.array(*[_uniform(h, F.lit(1 + 8 * i)) for h in hexes for i in range(8)])


def draw(key: Column, seed: Column) -> Column:
    """The number that ``draws`` has at place ``seed``."""
    return _uniform(_digest(F.floor(seed / 8).cast("int"), key), (1 + 8 * F.pmod(seed, F.lit(8))).cast("int"))


def _key(source: str) -> Column:
    """A never-null join key for ``source``."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
                               _key(source_col).alias("_key"),
                               word_count(F.col(text_col)).alias("size")), "sizes")


def source_plan(sized: DataFrame) -> DataFrame:
    """One row per source: _key, source_size, target, _rate and the hash seed it uses."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = written(source_targets(sizes).withColumn("_rate", rate)
                      .withColumn("_key", _key("source")), "targets")
    # Whether the target table is broadcast is left to the planner, which knows its written
    # size; otherwise the skew join splits a source that holds a third of all rows.
    drawn = sized.join(targets.drop("source"), "_key", "left").withColumn("_u", draws(F.col("_id")))
    extra = F.col("_rate") - F.floor("_rate")
    sums = drawn.groupBy("_key", "target", "_rate", "source_size").agg(
        *[F.sum(F.when(F.col("_u")[i] < extra, F.col("size")).otherwise(0)).alias(f"_d{i}")
          for i in range(DRAWS)])
    gap = [F.struct(F.abs(F.col(f"_d{i}") + F.floor("_rate") * F.col("source_size")
                          - F.col("target")).alias("g"), F.lit(i).alias("i")) for i in range(DRAWS)]
    return written(sums.select("_key", "source_size", "target", "_rate",
                               F.array_min(F.array(*gap))["i"].alias("_seed")), "seeds")


def _copies(id_col: str, rate: str, seed: str) -> Column:
    extra = draw(F.col(id_col), F.col(seed)) < F.col(rate) - F.floor(rate)
    return (F.floor(rate) + extra.cast("bigint")).cast("bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, copies and taken (copies x size).

    A null or empty text has size 0; null sources form one source.  Rows with the same
    identifier draw alike.  A table without words gives targets of 0 and no copies.  Other
    columns are not read.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    copies = _copies("_id", "_rate", "_seed")
    return (sized.join(source_plan(sized), "_key", "left").withColumn("copies", copies)
            .select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def emit_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """The mixed corpus: every row of ``docs``, all columns, as often as the mix takes it."""
    names = docs.columns
    inner = [free_name(names, x) for x in ("mix_key", "mix_rate", "mix_seed", "mix_copies")]
    key, rate, seed, copies = inner
    plan = source_plan(_sized(docs, id_col, text_col, source_col)).select(
        F.col("_key").alias(key), F.col("_rate").alias(rate), F.col("_seed").alias(seed))
    return (docs.withColumn(key, _key(source_col)).join(plan, key, "left")
            .withColumn(copies, _copies(id_col, rate, seed)).where(F.col(copies) > 0)
            .withColumn(copies, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))))
            .drop(*inner))
