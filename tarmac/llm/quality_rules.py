"""Operator 13, quality rules: repetition coverage by rolling hashes of several n-gram lengths.

Words get numbers, one hash per word, and the hash of every window of n words rolls on
from that of n - 1 words, for a stack of documents at once in numpy.  Windows found twice
in a document cover words; the characters covered are held against a limit per length,
and so are the characters in lines that repeat an earlier line.  Equal hashes are
verified by the words, so no figure depends on the hash.

A window of n + 1 words can only occur twice where its first n words do, so beyond the
shortest length only the positions left are looked at.  One pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import ship

#: Windows of so many words, and the share of a text's word characters (percent) that those
#: found twice or more may cover: the limits of published repetition rules for web text.
COVER_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Percent of the word characters that lines equal to an earlier line may hold.
LINE_LIMIT = 20
#: Base rules: fewest words, and percent of the words in repeated windows of BASE_GRAM words.
MIN_WORDS, REPEAT_LIMIT, BASE_GRAM = 10, 20, 5
#: Bytes of text judged at once; a longer text is judged alone, its words split piece by piece.
STACK = 1 << 20

SYMBOLS = b"#*$%&|<>"
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_IN_WORD = ~_BLANK & ~((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0))   # a word's code points
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """A fixed random-looking 64-bit value per number."""
    z = (numbers.astype(np.uint64) + np.uint64(1)) * _ODD
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _numbers(data: bytes, n: int, start: np.ndarray) -> np.ndarray:
    """A number per word of ``data`` (``n`` words starting at ``start``), equal for equal words."""
    known: dict[bytes, int] = {}
    out = np.empty(n, np.int64)
    at = 0
    while at < n:
        last = int(np.searchsorted(start, start[at] + STACK))
        end = int(start[last]) if last < n else len(data)
        words = data[start[at]:end].split()
        out[at:at + len(words)] = [known.setdefault(w, len(known)) for w in words]
        at += len(words)
    return out


def _twice(hashes: np.ndarray, at: np.ndarray, number: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Those of the window starts ``at`` whose ``n`` words start a window elsewhere in the row too."""
    key = hashes[at]
    order = np.argsort(key, kind="stable")
    place, key = at[order], key[order]
    same = key[1:] == key[:-1]
    if not same.any():
        return at[:0]
    a, b = place[:-1][same], place[1:][same]
    true = row[a] == row[b]
    for j in range(n):
        true &= number[a + j] == number[b + j]
    if not true.all():                      # two texts under one hash: compare the words themselves
        near = np.zeros(len(place), bool)
        near[1:] |= same
        near[:-1] |= same
        found = place[near]
        windows = np.column_stack([row[found]] + [number[found + j] for j in range(n)])
        _, back, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        return np.sort(found[count[back.ravel()] > 1])
    twice = np.zeros(len(place), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return np.sort(place[twice])


def _covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of ``n`` words that starts in ``at``."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes], lengths: list[int]) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, dup_line_chars, words and
    characters in windows found twice or more (``words_n``, ``chars_n`` for every length)."""
    data = b"\n".join(texts)
    byte = np.frombuffer(data, np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size + 1) - size - 1                    # where each text starts
    solid = np.concatenate([[False], ~_BLANK[byte], [False]])
    start = np.flatnonzero(solid[1:-1] & ~solid[:-2])
    end = np.flatnonzero(solid[1:-1] & ~solid[2:]) + 1
    chars = np.concatenate([[0], np.cumsum(_IN_WORD[byte], dtype=np.int64)])
    signs = np.concatenate([[0], np.cumsum(_SYMBOL[byte], dtype=np.int64)])
    word_first = np.searchsorted(start, first)
    n_words = np.searchsorted(start, first + size) - word_first
    out = {"n_words": n_words, "word_chars": chars[first + size] - chars[first],
           "n_symbols": signs[first + size] - signs[first]}

    # Lines: the stack's line breaks are the texts' own and one after each text.
    breaks = np.concatenate([np.flatnonzero(byte == 10), [len(data)]])
    line_first = np.concatenate([[0], breaks[:-1] + 1])
    line_row = np.searchsorted(first, line_first, side="right") - 1
    line_chars = chars[breaks] - chars[line_first]
    worded = np.flatnonzero(np.searchsorted(start, breaks) > np.searchsorted(start, line_first))
    again, seen, last = [], set(), -1
    for i, r, a, b in zip(worded.tolist(), line_row[worded].tolist(), line_first[worded].tolist(),
                          breaks[worded].tolist()):
        if r != last:
            seen, last = set(), r
        line = data[a:b]
        if line in seen:
            again.append(i)
        seen.add(line)
    again = np.array(again, np.int64)
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=len(texts))
    out["dup_line_chars"] = np.bincount(line_row[again], line_chars[again], len(texts)).astype(np.int64)

    n = len(start)
    number = _numbers(data, n, start)
    row = np.repeat(np.arange(len(texts)), n_words)
    long = (chars[end] - chars[start])
    value = _mixed(number)
    rolled, at = value + _mixed(row + (1 << 40)), np.arange(n)    # windows of other texts hash apart
    for k in range(1, max(lengths) + 1):
        if k > 1:
            rolled = rolled[:-1] * _ODD + value[k - 1:] if len(rolled) else rolled
            at = at[at + k <= n]
            at = at[row[at + k - 1] == row[at]]
        if k in lengths:
            at = _twice(rolled, at, number, row, k)
            inside = _covered(at, k, n)
            out[f"words_{k}"] = np.bincount(row[inside], minlength=len(texts))
            out[f"chars_{k}"] = np.bincount(row[inside], long[inside], len(texts)).astype(np.int64)
    return out


def _stacks(texts: list[bytes]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for t in texts:
        if held and size + len(t) > STACK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False,
               limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT) -> DataFrame:
    """One row per row of ``docs``: the measures, ``base_failed`` and ``kept``.

    ``kept`` is false if a base rule fails, if repeated windows of some length cover more than
    its limit of the word characters, or if repeated lines hold more than ``line_limit``
    percent of them.  A null, empty or blank text has no words and fails the base rules.
    Identifiers may be of any type, null or repeated: each row is judged by its own text.
    With ``carry`` the struct ``document`` holds all input columns; otherwise only the
    identifier and the text are read, so other columns' names cannot clash.
    """
    limits = limits or COVER_LIMITS
    lengths = sorted({BASE_GRAM, *limits})
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars",
             *[f"{kind}_{n}" for n in lengths for kind in ("words", "chars")]]
    cols = [F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    rows = docs.select(*cols)
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in names])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("_text").cast(pa.large_binary())
            texts = [t or b"" for t in column.to_pylist()]
            parts = [measure(stack, lengths) for stack in _stacks(texts)]
            arrays = [batch.column(f.name) for f in fields]
            arrays += [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])
    ship(docs.sparkSession)
    found = rows.mapInArrow(judge, schema)

    def over(part: str, percent: int, whole: str) -> Column:
        return 100 * F.col(part) > percent * F.col(whole)
    failed = (F.col("n_words") < MIN_WORDS) | over(f"words_{BASE_GRAM}", REPEAT_LIMIT, "n_words")
    bad = over("dup_line_chars", line_limit, "word_chars")
    for n, limit in limits.items():
        bad = bad | over(f"chars_{n}", limit, "word_chars")
    return (found.withColumn("base_failed", failed).withColumn("kept", ~(F.col("base_failed") | bad))
            .withColumnsRenamed({"_id": id_col, f"words_{BASE_GRAM}": "n_repeat_words"})
            .drop(*[f"words_{n}" for n in lengths if n != BASE_GRAM]))


def drop_repetitive(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns (see ``repetition``)."""
    return repetition(docs, carry=True, **options).where("kept").select("document.*")
