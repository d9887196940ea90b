"""Operator 12, source divergence audit on run-length columns.

Each language's vocabulary is laid out in an order that puts terms of equal counts side by
side and is cut into blocks.  Within a block every source is a column of counts; the
block's terms are reordered by the columns so that equal counts cluster, every column is
run-length encoded, and for a pair of sources the run boundaries are intersected: the
divergence f of two probabilities is evaluated once per common run and multiplied by the
run's length.  Block sums add up to the divergence of a pair.

Term counts are combined inside the map tasks before the shuffle.  A task never holds more
than ``BLOCK`` terms of ``2 * TILE`` sources: sources come in tiles, and each pair of tiles
of a block is a group of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import position_in_group
from .util import hot_split_join, ship, written

#: Terms of a block and sources of a tile.
BLOCK, TILE = 4096, 64
#: Counted terms a map task holds before it hands them on.
HELD = 500_000
#: Bytes of text whose words are held at once.
PIECE = 1 << 20
#: Probabilities are integers of this unit.
UNIT = 1_000_000_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists of about PIECE bytes, cut between terms."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), combined per task."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            if n:
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n)), pa.array([source] * len(n)), terms, pa.array(list(n.values())),
                     pa.array([docs[t] for t in n])], names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    held = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            own: set[bytes] = set()
            for words in _pieces(text.as_py()):
                n.update(words)
                own.update(words)
            docs.update(own)
            held += len(n) - before
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` occurrences, ``docs`` rows that have it."""
    ship(docs.sparkSession)
    parts = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, vocabulary: str) -> Column:
    """1 + floor(UNIT (n + 2) / (total + 2 vocabulary)), exact at any size."""
    return F.expr(f"""1 + cast((cast({UNIT} as decimal(10,0)) * cast({n} + 2 as decimal(19,0)))
                      div cast({total} + 2 * {vocabulary} as decimal(20,0)) as bigint)""")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); the squares of UNIT-sized numbers fit a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def encode_runs(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values) of the runs of equal neighbours."""
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if len(column) else \
        np.empty(0, np.int64)
    return starts, column[starts]


def runs_divergence(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """Sum of f over ``length`` positions of two run-length columns of probabilities."""
    starts = np.union1d(a[0], b[0])                          # the intersected run boundaries
    p = a[1][np.searchsorted(a[0], starts, side="right") - 1]
    q = b[1][np.searchsorted(b[0], starts, side="right") - 1]
    f = (p - q) ** 2 // (p + q)
    return int((f * np.diff(np.append(starts, length))).sum())


def block_columns(counts: np.ndarray, totals: list[int], vocabulary: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Run-length columns of probabilities of a block (sources x terms), terms reordered."""
    variety = [len(np.unique(c)) for c in counts]
    # The last key of lexsort leads: columns of few different counts first, longest runs.
    order = np.lexsort(counts[np.argsort(variety)[::-1]]) if counts.size else np.arange(counts.shape[1])
    out = []
    for column, total in zip(counts[:, order], totals):
        starts, values = encode_runs(column)
        kinds, kind = np.unique(values, return_inverse=True)
        exact = [1 + UNIT * (int(c) + 2) // (total + 2 * vocabulary) for c in kinds]
        out.append((starts, np.array(exact, np.int64)[kind]))
    return out


def _block_pairs(tile: int, key: tuple, table: pa.Table) -> pa.Table:
    """Partial sums of all pairs of sources of one block and pair of tiles."""
    tile_a, tile_b = key[2].as_py(), key[3].as_py()
    head = table.filter(pc.is_null(table.column("pos"))).sort_by("idx")
    body = table.filter(pc.is_valid(table.column("pos")))
    heads = list(zip(*(head.column(c).to_pylist() for c in ("idx", "source", "total"))))
    length = table.column("terms")[0].as_py()
    counts = np.zeros((len(heads), length), np.int64)
    idx, pos, n = (body.column(c).to_numpy() for c in ("idx", "pos", "n"))
    counts[np.searchsorted(head.column("idx").to_numpy(), idx), pos] = n
    columns = block_columns(counts, [t for _, _, t in heads], table.column("vocabulary")[0].as_py())
    out = {"lang": [], "a": [], "b": [], "value": []}
    for x, (i, source, _) in enumerate(heads):
        for y in range(x + 1, len(heads)):
            if tile_a == tile_b or i // tile != heads[y][0] // tile:
                out["lang"].append(key[0].as_py())
                out["a"].append(source)
                out["b"].append(heads[y][1])
                out["value"].append(runs_divergence(columns[x], columns[y], length))
    return pa.table(out, schema=pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()),
                                           ("value", pa.int64())]))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how sources diverge.

    Part ``pair``: every other source of the language with the summed divergence, all ranks.
    Part ``term``: the ``top`` terms by which a source exceeds its language.  A null language,
    source or text counts as the empty string.  A language whose terms are all rare has pairs
    of value 0 and no terms; a language with one source has no pairs; an empty table gives no
    rows.  Equal values stand by the item's UTF-8 bytes.  Repeated rows count as often as they
    stand there.  Other columns are not read, so their names cannot clash.
    """
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                          for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = written(term_counts(clean), "term-counts")
    terms = (counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs"))
             .where(F.col("lang_docs") >= min_docs))
    # Equal counts side by side; the block's own order does the rest.
    placed = written(position_in_group(terms, "lang", [F.desc("lang_n"), F.desc("lang_docs"), "term"], "at"),
                     "vocabulary")
    langs = placed.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("at").alias("vocabulary"))
    entries = written(counted.join(placed, ["lang", "term"])
                      .select("lang", "source", "term", "n", "lang_n", "at"), "entries")
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("at").alias("kinds"))
    groups = (clean.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
              .join(langs, "lang", "left").na.fill(0))
    groups = written(position_in_group(groups, "lang", ["source"], "idx"), "sources")
    facts = hot_split_join(entries, groups, ["lang", "source"], "kinds", entries.count())
    facts = written(facts, "facts")

    # Part pair: a header per source and block, entries with a count, for every pair of tiles.
    tiles = groups.groupBy("lang").agg((F.floor(F.max("idx") / TILE) + 1).cast("int").alias("tiles"))
    headed = groups.join(tiles, "lang")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / BLOCK))
    heads = (headed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
             .select("lang", "block", "tiles", "idx", "source", "total", "vocabulary",
                     F.lit(None).cast("int").alias("pos"), F.lit(None).cast("long").alias("n")))
    body = (facts.join(tiles, "lang")
            .select("lang", F.floor(F.col("at") / BLOCK).alias("block"), "tiles", "idx",
                    F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("total"),
                    "vocabulary", (F.col("at") % BLOCK).cast("int").alias("pos"), "n"))
    own = F.floor(F.col("idx") / TILE).cast("int")
    dealt = (heads.unionByName(body)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumn("terms", F.greatest(F.lit(0), F.least(F.lit(BLOCK), F.col("vocabulary")
                                                               - F.col("block") * BLOCK)).cast("int"))
             .select("lang", "block", F.least(own, "other").alias("tile_a"),
                     F.greatest(own, "other").alias("tile_b"), "idx", "source", "total", "vocabulary", "terms",
                     "pos", "n"))
    tile = TILE

    def block_pairs(key: tuple, table: pa.Table) -> pa.Table:
        return _block_pairs(tile, key, table)
    sums = (dealt.groupBy("lang", "block", "tile_a", "tile_b")
            .applyInArrow(block_pairs, "lang string, a string, b string, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    sums = written(sums, "pairs")
    pairs = (sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
             .unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")))

    # Part term: where the source's share exceeds the language's.
    both = (facts.withColumn("p", probability("n", "total", "vocabulary"))
            .withColumn("q", probability("lang_n", "lang_total", "vocabulary")).where("p > q")
            .select("lang", "source", F.col("term").alias("item"),
                    divergence(F.col("p"), F.col("q")).alias("value")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = both.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    order = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumns({"rank": F.row_number().over(ranked), "part": F.lit("pair")}).select(*order)
            .unionByName(best.withColumn("part", F.lit("term")).select(*order)))
