"""Operator 1, token-id store in ORC.

Documents go in ascending id order into ORC files: ids are run-length encoded integers,
every stripe has row indexes and a Bloom filter on the document id.  Readers take stripes
in parallel, and a filter on the document id prunes files, stripes and row groups by their
statistics before any token is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encode import SEGMENT, Encoder
from .util import ship, use_cache, written

ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
                text_col: str = "text") -> None:
    """Encode ``docs`` and write (doc_id, row, ids) files at ``path``, in ascending id order.

    A null or empty text is the end id alone.  Null ids come first; rows with one id stand
    as they are read.  ``row`` numbers a file's rows.  Other columns are
    not read; an empty table gives a store without rows.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache("encode")
        encoder, row = Encoder.of(tokenizer), 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, first = [], 0, at
                while at < batch.num_rows and (not texts or size < SEGMENT):
                    texts.append(batch.column(1)[at].as_py())
                    size += len(texts[-1] or "")
                    at += 1
                ids = [np.concatenate((x, end)) for x in encoder.encode(texts)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, at - first), pa.array(np.arange(row, row + len(ids))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).view(np.int32)))],
                    names=["doc_id", "row", "ids"])
                row += len(ids)

    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"),
                        F.monotonically_increasing_id().alias("_k"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_k")]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The read position in the key lets a repeated id span several files; no text is read to
    # find the ranges.
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "_t")
    (dealt.mapInArrow(run, f"doc_id {kind}, row bigint, ids array<int>")
     .write.options(**ORC).orc(path))


def read_store(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The store's rows (doc_id, row, ids, file); a ``where`` on doc_id prunes stripes."""
    df = spark.read.orc(path)
    if where is not None:
        df = df.where(where)
    return df.withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int"))


def ids_crc32(df: DataFrame, ids: str = "ids") -> DataFrame:
    """``df`` with ``ids`` replaced by its length ``n`` and its crc32 ``crc`` (little-endian uint32)."""
    ship(df.sparkSession)
    rest = [f for f in df.schema.fields if f.name != ids]
    schema = T.StructType([*rest, T.StructField("n", T.LongType()), T.StructField("crc", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.schema.get_field_index(ids))
            ends = col.offsets.to_numpy()
            data = np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).view(np.uint8)
            crc = [zlib.crc32(data[4 * x:4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(b.schema.get_field_index(f.name)) for f in rest],
                 pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                names=schema.names)

    return df.mapInArrow(run, schema)


def store_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all rows before), n_tokens, ids_crc32 of every stored row.

    ``start`` adds the totals of the files before, one number per file, to a running sum
    within the file.  The ids are read once, into a narrow written table.
    """
    rows = written(ids_crc32(read_store(spark, path)), "store-index")
    files = rows.groupBy("file").agg(F.sum("n").alias("_t"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, "file").select(
        "doc_id", (F.col("_o") + F.sum("n").over(inside) - F.col("n")).alias("start"),
        F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
