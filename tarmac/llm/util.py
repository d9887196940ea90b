"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path, ship  # noqa: F401  (the operators import them from here)

#: Words are runs of anything but blank and the five ASCII control blanks.
WORD_RE = r"[^\x20\x09-\x0D]+"

#: At most this many dropped rows' keys are broadcast (see ``without_rows``).
DROPPED_KEYS = 1_000_000

#: At most this many keys may ride along as "hot" in a broadcast (see ``hot_split_join``).
HOT_KEYS = 10_000

#: Clearing functions of what a Python worker remembers between tasks, by operator.
CACHES: dict = {}


def use_cache(name: str) -> None:
    """Called where a task starts: what a reused worker remembers for other operators goes.

    What is free is given back to the system, so that it counts for the next stage's workers.
    """
    for other, clear in CACHES.items():
        if other != name:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):        # another C library: nothing to give back
        pass


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A driver table by its Parquet path, with a narrow column list."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*cols) if cols else df


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the folder behind a ``written`` table that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        remove_path(df.sparkSession, path)


def free_name(taken: list[str], base: str) -> str:
    """``base``, prolonged until no column of ``taken`` has the name (case-insensitively)."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def hot_split_join(rows: DataFrame, lookup: DataFrame, key: list[str], weight: str,
                   total: int) -> DataFrame:
    """Left join ``rows`` to ``lookup`` (unique per ``key``) without one hot key in one task.

    ``weight`` in ``lookup`` says how many of the ``total`` rows have the key.  Keys with
    more than ``total / HOT_KEYS`` rows number fewer than ``HOT_KEYS``, whatever the data,
    so they are broadcast; every other key is small, and a shuffle join deals it.
    """
    limit = max(1000, -(-total // HOT_KEYS))
    values = [c for c in lookup.columns if c not in key]
    hot = lookup.where(F.col(weight) > limit).withColumn("_hot", F.lit(True))
    hot = hot.select(*key, *[F.col(c).alias(f"_h_{c}") for c in values], "_hot")
    marked = rows.join(F.broadcast(hot), key, "left")
    done = marked.where(F.col("_hot")).select(
        *rows.columns, *[F.col(f"_h_{c}").alias(c) for c in values])
    rest = (marked.where(F.col("_hot").isNull()).select(*rows.columns)
            .join(lookup.where(F.col(weight) <= limit), key, "left"))
    return done.unionByName(rest.select(*rows.columns, *values))


def without_rows(docs: DataFrame, id_col: str, text_col: str, gone: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that ``gone`` names; documents stay where they are.

    ``gone`` has the distinct keys (``_id``, ``_xx``: the text's 64-bit hash, ``again``): rows of a
    key go, but one of them stays where ``again`` is true (all rows of such a key are copies).
    The keys are written and counted: up to DROPPED_KEYS of them are broadcast, so no document
    is shuffled; beyond that the join deals the documents by key.  Only rows of ``again`` keys
    are looked at once more.
    """
    names = docs.columns
    gone = written(gone.select("_id", "_xx", "again"), "dropped-keys")
    n, again = gone.agg(F.count(F.lit(1)), F.count_if("again")).first()
    if n == 0:
        return docs
    side = F.broadcast(gone) if n <= DROPPED_KEYS else gone
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(id_col).alias("_did"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_dxx"))
    same = wide["_did"].eqNullSafe(side["_id"]) & (wide["_dxx"] == side["_xx"])
    out = wide.join(side, same, "left_anti").select("_doc")
    if again:
        once = wide.join(side.where("again"), same, "left_semi").dropDuplicates(["_did", "_dxx"])
        out = out.unionByName(once.select("_doc"))
    return out.select("_doc.*")
