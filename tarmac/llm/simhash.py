"""Operator 4, SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at 3 or fewer differing bits have a word between them that is at most
one bit from the one and two bits from the other.  Every distinct fingerprint emits its
ball of variants, the variants are shuffled, and fingerprints that meet in a variant are
linked and verified.

Which variants suffice: an odd distance joins a fingerprint of even bit count with one of
odd bit count, so only even ones emit two-bit variants; and of three differing bits two
lie in the same half of the word, so only two-bit variants within a half are needed.

No pairs are listed within a bucket.  A bucket holds distinct fingerprints around one
word, 2,081 at most whatever the data, and those within one bit of it ("near") lie within
3 bits of all others; linking every member to the smallest near one keeps all of them in
one component, and a pair at distance 3 or less always has a bucket with a near member.

Before the balls, fingerprints that provably have no neighbour are put aside: 3 differing
bits leave at most one in one half of the word, so a fingerprint that meets no other one
in its half-words or their one-bit variants cannot be linked.  This is counted per
half-word (a sum combined before the shuffle), not by pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import hot_split_join, ship, use_cache, without_rows, written

#: Bytes of text whose words are held at once; longer texts go piece by piece.
PIECE = 1 << 20
BLANKS = b" \t\n\x0b\x0c\r"
#: Fingerprints whose balls one task emits.
EMITTED = 2000


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of ``data`` in lists, each from about PIECE bytes cut at a blank."""
    if len(data) <= PIECE:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and data[end] not in BLANKS:
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of ``text`` as an unsigned 64-bit number."""
    ones, n, carry = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carry + words
        if len(words) >= shingle:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            count = len(words) - shingle + 1
            hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(
                starts[:count].tolist(), ends[shingle - 1:].tolist())), "<u8", count)
            for i in range(0, count, 65536):
                ones += np.unpackbits(hashes[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1,
                                      bitorder="little").sum(axis=0, dtype=np.int64)
            n += count
            carry = words[len(words) - shingle + 1:]
        else:
            carry = words
    if n == 0:
        if not carry:
            return 0
        return digest(b" ".join(carry), seed)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(_id, _xx, _fp) per row: ``_xx`` hashes the text, ``_fp`` is its fingerprint as a long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache("")
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)),
                              np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                names=["_id", "_xx", "_fp"])
    narrow = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_xx"),
                         F.col(text_col).alias("_t"))
    kind = narrow.schema["_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"_id {kind}, _xx bigint, _fp bigint")


def _masks(bits: range) -> list[int]:
    return [1 << b for b in bits]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flip(word: Column, masks: list[int]) -> Column:
    """Array of ``word`` with each mask applied."""
    return F.transform(F.array(*[F.lit(_signed(m)) for m in masks]), lambda m: word.bitwiseXOR(m))


def _candidates(fps: DataFrame) -> DataFrame:
    """Fingerprints that meet another one in a half-word or a one-bit variant of it."""
    fp = F.col("fp")
    halves = fps.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), fp.bitwiseAND(F.lit(0xFFFFFFFF)).alias("word")),
        F.struct(F.lit(1).alias("side"), F.shiftrightunsigned(fp, 32).alias("word")))).alias("h"))
    word = F.col("h.word")
    # A half of even bit count also emits its one-bit variants, an odd one only itself.
    keys = F.when(F.bit_count(word) % 2 == 0,
                  F.concat(F.array(word), _flip(word, _masks(range(32))))).otherwise(F.array(word))
    emitted = halves.select("fp", F.col("h.side").alias("side"), F.explode(keys).alias("key"))
    met = (emitted.groupBy("side", "key").agg(F.count(F.lit(1)).alias("n"))
           .where("n > 1").select("side", "key"))
    return emitted.join(met, ["side", "key"], "left_semi").select("fp").distinct()


def ball_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """``fps`` (fp long, distinct) -> links (a, b) that connect all within ``radius`` bits."""
    if radius != 3:
        raise ValueError("the ball variants are laid out for a radius of 3 bits")
    fp = F.col("fp")
    # A fingerprint emits hundreds of variants: few of them to a task, however small their table.
    fps = fps.repartition(max(1, -(-fps.count() // EMITTED)), "fp")
    pairs = [(1 << i) | (1 << j) for half in (0, 32)
             for i in range(half, half + 32) for j in range(i + 1, half + 32)]
    ones = _masks(range(64))
    even = F.bit_count(fp) % 2 == 0
    close = fps.select("fp", F.lit(True).alias("near"), F.explode(
        F.when(even, F.concat(F.array(fp), _flip(fp, ones))).otherwise(_flip(fp, ones))).alias("word"))
    wide = fps.where(even).select("fp", F.lit(False).alias("near"),
                                  F.explode(_flip(fp, pairs)).alias("word"))
    # One shuffle of the variants; a bucket has a proven size, see the module text.
    bucket = close.unionByName(wide).groupBy("word").agg(
        F.min(F.when(F.col("near"), fp)).alias("hub"), F.collect_list("fp").alias("all"))
    met = (bucket.where(F.col("hub").isNotNull() & (F.size("all") > 1))
           .select("hub", F.explode("all").alias("fp")).where(fp != F.col("hub")).distinct())
    return (met.where(F.bit_count(fp.bitwiseXOR(F.col("hub"))) <= radius)
            .select(F.col("hub").alias("a"), fp.alias("b")))


def _components(prints: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Per distinct fingerprint: _n rows and, if linked, _root; per component: its best row.

    The best row has the smallest non-null id, then the smallest text hash.
    """
    distinct = written(prints.select(F.col("_fp").alias("fp")).distinct(), "distinct-fps")
    active = written(_candidates(distinct), "candidates")
    roots = components(ball_links(active, radius)).select(
        F.col("node").alias("_fp"), F.col("root").alias("_root"))
    rows = prints.groupBy("_fp", "_id", "_xx").agg(F.count(F.lit(1)).alias("_same"))
    first = F.min(F.struct(F.col("_id").isNull().alias("no"), "_id", "_xx", "_same"))
    per_fp = (rows.groupBy("_fp").agg(first.alias("_best"), F.sum("_same").alias("_n"))
              .join(roots, "_fp", "left"))
    per_fp = written(per_fp, "per-fingerprint")
    best = per_fp.groupBy(F.coalesce("_root", "_fp").alias("_root")).agg(F.min("_best").alias("_best"))
    return per_fp, best


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest non-null id reachable over links of ``radius`` bits.  A
    null or blank text has fingerprint zero, which links like any other.  Rows with equal
    fingerprints are handled as one.  Other columns are not read; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    per_fp, best = _components(prints, radius)
    # A fingerprint of one row and without links needs no lookup: its id is the answer.
    shared = per_fp.where(F.col("_root").isNotNull() | (F.col("_n") > 1))
    classes = written(shared.withColumn("_root", F.coalesce("_root", "_fp")).join(best.select(
        "_root", F.col("_best._id").alias("component_id"), F.lit(True).alias("_found")), "_root")
        .select("_fp", "component_id", "_found", "_n"), "classes")
    out = hot_split_join(prints, classes, ["_fp"], "_n", prints.count())
    return out.select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("_found"), F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns: of each component the one with the smallest id.

    Rows with that same id differ by text hash, and the smallest stays; of rows equal in both
    one stays.  A component whose ids are all null keeps one row.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    per_fp, best = _components(prints, radius)
    shared = per_fp.where(F.col("_root").isNotNull() | (F.col("_n") > 1))
    best = best.select("_root", F.col("_best._id").alias("_bid"), F.col("_best._xx").alias("_bxx"),
                       F.lit(True).alias("_found"))
    classes = written(shared.withColumn("_root", F.coalesce("_root", "_fp")).join(best, "_root")
                      .select("_fp", "_bid", "_bxx", "_found", "_n"), "classes")
    rows = hot_split_join(prints, classes, ["_fp"], "_n", prints.count()).where("_found")
    stays = F.col("_id").eqNullSafe(F.col("_bid")) & (F.col("_xx") == F.col("_bxx"))
    gone = (rows.groupBy("_id", "_xx", stays.alias("again")).agg(F.count(F.lit(1)).alias("_same"))
            .where(~F.col("again") | (F.col("_same") > 1)))
    return without_rows(docs, id_col, text_col, gone)
