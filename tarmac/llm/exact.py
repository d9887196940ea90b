"""Operator 9, exact dedup: tree-merge of sorted digest runs in binomial rounds.

Every partition sorts its digests into a run that has each digest once, with the best
identifier and the number of rows.  In a round ``2**bits`` neighbouring runs become one:
their entries are exchanged by digest range, so a task gets the same range of all runs of
one merge, brought into digest order, and a streaming pass merges equal neighbours, keeping
the best identifier.  The outcome is again a sorted run, cut into ranges.  A digest has at
most ``2**bits`` entries in a merge, however many rows share the text.

An entry is verified at every level: two entries are equal only if the SHA-256, the byte
length and an independent 64-bit hash all agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import hot_split_join, ship, without_rows, written

KEY = ["_sha", "_len", "_xx"]


def digests(text: str) -> list[Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.unhex(F.sha2(t, 256)).alias("_sha"),
            F.octet_length(t).cast("bigint").alias("_len"), F.xxhash64(t).alias("_xx")]


def digest_groups(rows: DataFrame, bits: int = 4, keep: str = "max") -> DataFrame:
    """One entry per distinct digest of ``rows`` (KEY, ``_id``, ``_row``).

    Returns KEY, ``keep_id``, ``keep_row``, ``group_size``.  ``keep`` says whether the
    largest or the smallest identifier stays; a null one loses against any other, and of
    rows with the same identifier the smallest ``_row`` stays.
    """
    n_runs = max(1, rows.rdd.getNumPartitions())
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    level = first_runs(rows, keep)
    for r in range(max(1, math.ceil(math.log2(n_runs) / bits))):
        runs_left = max(1, math.ceil(n_runs / 2 ** (bits * (r + 1))))
        level = merge_runs(level, bits, max(1, tasks // runs_left), tasks, keep)
    return level.select(*KEY, F.col("_id").alias("keep_id"), F.col("_row").alias("keep_row"),
                        F.col("_n").alias("group_size"))


def _order(keep: str) -> list[Column]:
    """Digest order; of equal digests the best entry first."""
    best = F.col("_id").desc_nulls_last() if keep == "max" else F.col("_id").asc_nulls_last()
    return [*[F.col(k) for k in KEY], best, F.col("_row")]


def first_runs(rows: DataFrame, keep: str) -> DataFrame:
    """Level 0: each partition's digests as one sorted run (KEY, _id, _row, _n, _run)."""
    entries = rows.select(*KEY, "_id", "_row", F.lit(1).cast("bigint").alias("_n"),
                          F.spark_partition_id().alias("_run"), F.lit(0).alias("_range"))
    return _merged(entries.sortWithinPartitions(*_order(keep)))


def merge_runs(level: DataFrame, bits: int, ranges: int, tasks: int, keep: str) -> DataFrame:
    """One round: ``2**bits`` neighbouring runs each become one sorted run of ``ranges`` ranges."""
    # The first two bytes of a SHA-256 are uniform: equal ranges are equal shares.
    head = F.conv(F.hex(F.substring("_sha", 1, 2)), 16, 10).cast("int")
    dealt = (level.withColumn("_run", F.shiftright("_run", bits))
             .withColumn("_range", F.floor(head * ranges / 65536).cast("int"))
             .repartition(tasks, "_run", "_range"))
    return _merged(dealt.sortWithinPartitions("_run", "_range", *_order(keep)))


def _merged(entries: DataFrame) -> DataFrame:
    """Sorted entries with equal neighbours merged, in one streaming pass per partition."""
    ship(entries.sparkSession)
    same = ["_run", "_range", *KEY]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                   # the last entry: the next batch may go on with it
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            n = batch.num_rows
            if not n:
                continue
            new = np.ones(n, bool)
            differ = np.zeros(n - 1, bool)
            for c in same:
                column = batch.column(c)
                differ |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[1:] = differ
            starts = np.flatnonzero(new)
            counts = np.add.reduceat(batch.column("_n").to_numpy(), starts)
            best = batch.take(pa.array(starts)).set_column(
                batch.schema.get_field_index("_n"), batch.schema.field("_n"), pa.array(counts))
            held = best.slice(best.num_rows - 1)
            yield best.slice(0, best.num_rows - 1)
        if held is not None:
            yield held
    return entries.mapInArrow(merge, entries.schema)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "max") -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    A null text counts as empty and equals an empty one.  Of equal texts exactly one row is
    kept, also when its identifier is repeated or null.  Other columns of ``docs`` are not
    read.  An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("_id"), *digests(text_col))
    base = written(base.withColumn("_row", F.monotonically_increasing_id()), "digests")
    groups = written(digest_groups(base, keep=keep).where("group_size > 1"), "digest-groups")
    total = base.count()
    out = hot_split_join(base, groups, KEY, "group_size", total)
    single = F.col("group_size").isNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(single, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (single | (F.col("_row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      keep: str = "max") -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of every group of equal texts.

    Texts are compared as in ``exact_groups``; which of fully equal (identifier, text) rows
    stays is not defined, as their texts and identifiers are the same.  All is decided on the
    digests; the documents themselves are only filtered (``util.without_rows``).
    """
    base = written(docs.select(F.col(id_col).alias("_id"), *digests(text_col), F.lit(0).cast("bigint").alias("_row")),
                   "digests")
    groups = written(digest_groups(base, keep=keep).where("group_size > 1").drop("keep_row"), "digest-groups")
    members = hot_split_join(base, groups, KEY, "group_size", base.count()).where(F.col("group_size").isNotNull())
    stays = F.col("_id").eqNullSafe(F.col("keep_id"))
    gone = (members.groupBy("_id", "_xx", stays.alias("again")).agg(F.count(F.lit(1)).alias("_same"))
            .where(~F.col("again") | (F.col("_same") > 1)))
    return without_rows(docs, id_col, text_col, gone)
