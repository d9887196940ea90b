"""Operator 11, target-distribution importance resampling: array-scored weights, quickselect.

A text's features are its runs of one to three consecutive words, hashed into buckets.
Two passes read the texts: one counts the buckets of the corpus and of the target texts
(partitions send their non-zero buckets, at most ``BUCKETS`` rows each), the other adds up
an array of log-ratio gains over each document's features.  A Gumbel draw by the hash of
the identifier is added to the weight, so the largest scores are a draw without
replacement in proportion to the weights.

The cut is found without sorting the corpus: random rows of the live range serve as
pivots, exact counts of the rows below, at and above each of them narrow the range until
a pivot is the k-th key.  Only the winners are sorted and ranked.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import position_in_group
from .util import ship, written

BUCKETS = 10_000
#: Longest run of words that is a feature.
GRAMS = 3
#: Bytes of text whose words are held at once; longer texts go piece by piece.
PIECE = 1 << 20
#: Rows of the live range that serve as pivots in one round of the selection.
PIVOTS = 12

#: A-Z are lowered; what is neither an ASCII letter or digit nor part of a longer UTF-8
#: sequence separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def word_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The folded words of a text in lists of about PIECE bytes, cut between words."""
    at, size = 0, len(text or b"")
    while at < size:
        cut = _BREAK.search(text, at + PIECE) if size - at > PIECE else None
        end = cut.start() if cut else size
        yield text[at:end].translate(_FOLD).split()
        at = end


def _lists(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """(words, row of each, how many words at the start were in the list before)."""
    words: list[bytes] = []
    rows: list[int] = []
    counts: list[int] = []
    held = 0
    for row, text in enumerate(texts):
        whole = len(text or b"") <= PIECE
        if not whole or held > PIECE:
            yield words, np.repeat(rows, counts).astype(np.int64), 0
            words, rows, counts, held = [], [], [], 0
        tail: list[bytes] = []
        for part in word_lists(text):
            if whole:
                words += part
                rows.append(row)
                counts.append(len(part))
                held += len(text)
            else:
                joined = tail + part
                yield joined, np.full(len(joined), row), len(tail)
                tail = joined[-(GRAMS - 1):]
    yield words, np.repeat(rows, counts).astype(np.int64), 0


def features(texts: list[bytes | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every feature of the texts, in arrays of bounded size.

    The CRC-32 of a run is carried on from that of the run without its last word.
    """
    for words, row, seen in _lists(texts):
        spaced = [b" " + w for w in words]
        crcs = list(map(zlib.crc32, words))
        for n in range(GRAMS):
            if n:
                crcs = list(map(zlib.crc32, spaced[n:], crcs))
            if not crcs:
                break
            new = row[n:] == row[:len(row) - n]
            new[:max(0, seen - n)] = False          # runs that end inside the repeated words
            yield row[n:][new], np.array(crcs, np.int64)[new] % buckets


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of every bucket in the one text column of ``texts``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket in features(_bytes(batch.column(0)), buckets):
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])
    ship(texts.sparkSession)
    parts = texts.mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():      # `buckets` rows at most
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of every bucket's smoothed share in the target over that in the corpus."""
    size = len(corpus)
    s_all, t_all = float(corpus.sum()) + size, float(target.sum()) + size
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all)))
                     for s, t in zip(corpus, target)], np.int64)


def weighted(docs: DataFrame, id_col: str, text_col: str, gain: np.ndarray, carry: bool) -> DataFrame:
    """``_id``, ``n_words``, ``n_features``, ``weight`` (and ``document``: all columns) per row."""
    cols = [F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    rows = docs.select(*cols)
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            count, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for row, bucket in features(_bytes(batch.column("_text")), len(gain)):
                count += np.bincount(row, minlength=n)
                np.add.at(weight, row, gain[bucket])
            # n words have n + (n - 1) + (n - 2) runs, fewer words the triangular numbers.
            words = np.where(count >= 3, count // 3 + 1, np.where(count > 0, 1, 0))
            arrays = [batch.column(f.name) for f in fields] + [pa.array(a) for a in (words, count, weight)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])
    ship(docs.sparkSession)
    return rows.mapInArrow(score, schema)


def kth_key(rows: DataFrame, order: list[str], k: int, total: int) -> list:
    """The k-th (1-based) of ``total`` rows by ``order`` (columns whose values are distinct).

    Distributed quickselect: every round draws PIVOTS random rows of the live range and
    counts the rows below and at each pivot in one aggregation.
    """
    key = F.struct(*order)
    types = [rows.schema[c].dataType for c in order]

    def lit(values: list) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(values, types, order)])

    low = high = None
    before, turn = 0, 0                       # rows at or before `low`
    while True:
        live = rows
        if low is not None:
            live = live.where((F.col(order[0]) >= F.lit(low[0])) & (key > lit(low)))
        if high is not None:
            live = live.where((F.col(order[0]) <= F.lit(high[0])) & (key < lit(high)))
        turn += 1
        picks = (live.select(*order).orderBy(F.xxhash64(F.lit(turn), *order)).limit(PIVOTS)
                 .orderBy(*order).collect())
        pivots = [list(p) for p in picks]
        counts = live.agg(*[F.count_if(c) for p in pivots for c in (key < lit(p), key == lit(p))]).first()
        low_next, before_next, high_next = low, before, high
        for i, p in enumerate(pivots):
            less, equal = before + counts[2 * i], counts[2 * i + 1]
            if less < k <= less + equal:
                return p
            if less + equal < k:
                low_next, before_next = p, less + equal
            else:
                high_next = p
                break
        low, before, high = low_next, before_next, high_next


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", percent: int = 5, min_words: int = 20, seed: int = 42,
             buckets: int = BUCKETS, carry: bool = False) -> DataFrame:
    """Every row of ``docs`` with its weight, score and, if drawn, its rank.

    Returns ``id_col``, ``n_features``, ``weight``, ``score``, ``rank`` and with ``carry`` the
    struct ``document`` of all input columns.  Of the N rows with at least ``min_words`` words
    the floor(``percent`` N / 100) highest scores are drawn, ties to the smaller identifier;
    a null identifier is drawn by the hash of the word null and comes after all others, and
    rows with equal identifier and score stand in the order of the written table.  A null or
    empty text has no words: weight 0, never drawn.  An empty target gives every document
    gains against an even spread; an empty ``docs`` gives no rows.  Other columns of ``docs``
    are not read unless carried, so their names cannot clash.
    """
    gain = gains(bucket_counts(docs.select(F.col(text_col).cast("string")), buckets),
                 bucket_counts(target.select(F.col(target_text).cast("string")), buckets))
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"),
                                                                       F.lit("null"))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((u.cast("double") + 0.5) / 4294967296.0)))
    score = F.col("weight") + noise.cast("long")
    rows = written(weighted(docs, id_col, text_col, gain, carry)
                   .withColumns({"score": score, "_down": -score, "_null": F.col("_id").isNull(),
                                 "_row": F.monotonically_increasing_id()}), "weights")
    order = ["_down", "_null", "_id", "_row"]
    fit = F.col("n_words") >= min_words
    total = rows.where(fit).count()
    k = percent * total // 100
    out = [F.col("_id").alias(id_col), "n_features", "weight", "score", "rank"] + ["document"] * carry
    none = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return rows.withColumn("rank", none).select(*out)
    last = kth_key(rows.where(fit), order, k, total)
    types = [rows.schema[c].dataType for c in order]
    drawn = fit & (F.struct(*order) <= F.struct(*[F.lit(v).cast(t).alias(c)
                                                  for v, t, c in zip(last, types, order)]))
    winners = position_in_group(rows.where(drawn).withColumn("_all", F.lit(0)), "_all", order, "rank")
    return (winners.withColumn("rank", F.col("rank") + 1).select(*out)
            .unionByName(rows.where(~drawn).withColumn("rank", none).select(*out)))


def draw_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns (see ``resample``)."""
    return resample(docs, target, carry=True, **options).where(F.col("rank").isNotNull()).select("document.*")
