"""Operator 3, packing by Karmarkar-Karp multiway differencing.

Documents are encoded, cut into windows of the full capacity and one remainder, and the
remainders of a block of documents are dealt into near-equal windows: every remainder
starts as a partition of its own, and the two partitions with the largest imbalance are
merged with opposing order (the fullest window of one onto the emptiest of the other)
until one partition is left.  If a window of it exceeds the capacity, the window count
rises and the block is dealt anew.

A block is a run of rows of one input partition, bounded by ``BLOCK`` remainders, so the
packing needs no shuffle, a task holds one block at a time, and a lost task is repeated
with the same result.  A long document's full windows leave the task as they are cut.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import SEGMENT, Encoder
from .util import ship, use_cache

CAPACITY = 1024
#: Remainders dealt together.
BLOCK = 512
#: A remainder above twice this many ids is cut once more: its end is a small piece, with
#: which the last merges even out what the large pieces leave.
TAIL = 32


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` dealt into ``k`` windows of near-equal sum."""
    # A partition lists its non-empty windows, fullest first, as (sum, indices).
    heap = [(-s if k > 1 else 0, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:
            # Opposing order: a's emptiest windows meet b's emptiest, the fuller of the one
            # with the emptier of the other; b's fullest fill windows that a leaves empty.
            keep, alone = len(a) - over, len(b) - over
            merged = a[:keep] + b[:alone]
            for (x, left), (y, right) in zip(a[keep:], reversed(b[alone:])):
                left.extend(right)
                merged.append((x + y, left))
        merged.sort(key=itemgetter(0), reverse=True)
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], serial, merged))
        serial += 1
    return [w for _, w in heap[0][2]] if heap else []


def deal(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``, as few as differencing manages, near-equal."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k += max(1, k // 128)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = 0, block: int = BLOCK, tail: int = TAIL,
         digest: bool = False) -> DataFrame:
    """One row per piece: id, start, doc_tokens, sequence_id, offset, ids (array of int).

    With ``digest`` a piece's length ``n`` and the crc32 ``crc`` of its ids (little-endian unsigned
    32-bit integers) stand for the ids, made in the same pass: no second worker reads them.

    Each id of a document, ``end_id`` at its end included, is in exactly one piece.  A null
    or empty text is the end id alone.  Rows are packed as they are, repeated or not; a null
    document id stays null.  Sequence ids are unique, not gapless.  Other columns are not
    read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache("encode")
        encoder = Encoder.of(tokenizer)
        serial = TaskContext.get().partitionId() << 33
        end = np.array([end_id], np.uint32)
        out: list[tuple] = []
        held = 0
        rest: list[tuple] = []          # (doc, start, doc_tokens, ids) to be dealt

        def dealt() -> None:
            nonlocal serial, rest, held
            for window in deal([len(r[3]) for r in rest], capacity):
                at = 0
                for i in window:
                    doc, start, total, ids = rest[i]
                    out.append((doc, start, total, serial, at, ids))
                    at += len(ids)
                    held += len(ids)
                serial += 1
            rest = []

        def batch() -> pa.RecordBatch:
            nonlocal out, held
            doc, start, total, seq, at, ids = zip(*out)
            lens = [len(x) for x in ids]
            if digest:
                last = [pa.array(lens, pa.int64()),
                        pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids], pa.int64())]
            else:
                ends = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
                last = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).view(np.int32)))]
            made = pa.RecordBatch.from_arrays(
                [pa.array(doc, id_type), pa.array(start, pa.int64()), pa.array(total, pa.int64()),
                 pa.array(seq, pa.int64()), pa.array(at, pa.int64()), *last],
                names=["_id", "start", "doc_tokens", "sequence_id", "offset", *(["n", "crc"] if digest else ["ids"])])
            out, held = [], 0
            return made

        for arrow in batches:
            id_type = arrow.schema.field(0).type
            rows = arrow.num_rows
            at = 0
            while at < rows:
                # Texts are encoded about SEGMENT characters at a time.
                texts, size, first = [], 0, at
                while at < rows and (not texts or size < SEGMENT):
                    texts.append(arrow.column(1)[at].as_py())
                    size += len(texts[-1] or "")
                    at += 1
                for doc, ids in zip(arrow.column(0).slice(first, at - first).to_pylist(), encoder.encode(texts)):
                    ids = np.concatenate((ids, end))
                    total = len(ids)
                    whole = total // capacity * capacity
                    for start in range(0, whole, capacity):
                        out.append((doc, start, total, serial, 0, ids[start:start + capacity]))
                        held += capacity
                        serial += 1
                        if held >= 1 << 20:
                            yield batch()
                    if whole < total:
                        cut = total - tail if tail and total - whole > 2 * tail else total
                        rest.append((doc, whole, total, ids[whole:cut]))
                        if cut < total:
                            rest.append((doc, cut, total, ids[cut:]))
                        if len(rest) >= block:
                            dealt()
                            if held >= 1 << 20:
                                yield batch()
        if rest:
            dealt()
        if out:
            yield batch()

    cols = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    out = cols.mapInArrow(run, f"_id {kind.simpleString()}, start bigint, doc_tokens bigint, "
                               "sequence_id bigint, offset bigint, "
                               + ("n bigint, crc bigint" if digest else "ids array<int>"))
    return out.withColumnRenamed("_id", id_col)
