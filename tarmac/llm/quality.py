"""Operator 10, quality classifier: ordinal cumulative-link regression on graded ratings.

The model has one weight vector over hashed text features and ordered thresholds:
P(grade >= j | text) = sigmoid(w . x(text) - threshold_j).  The features of a text are the
distinct lower-cased words, their four-letter parts and the letter shapes, and three
binned shares: distinct words, the commonest word, and signs, all hashed.

The model is fitted on a bounded sample of the rated rows: about ``PER_GRADE`` of each
grade, chosen by a hash of the id and weighted so that the grades count as in the whole.
Everything else covers every row and every text in full: each document gets its expected
grade and the tail probability of the best grade, by which it is selected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import CACHES, ship, use_cache, written

#: Rated rows per grade that the model is fitted on, about.
PER_GRADE = 2000
BITS = 18
#: A feature must occur in this many sampled texts to get a weight.
MIN_TEXTS = 4
#: ... and must be this far (log odds) from even between some grade and the others; it
#: counts in proportion to that distance.
MIN_ODDS = 1.5
#: Characters of a text whose words are held at once.
PIECE = 1 << 20
#: Words whose features are remembered per worker; beyond it the memory starts anew.
REMEMBER = 250_000

#: Rows scored at once.
ROWS = 1000
#: Letters of the word parts, and of a word whose features are remembered at most.
PART, LETTERS = 4, 64
#: Letters of a word whose parts are held as strings at once.
STRETCH = 1 << 16
#: Bytes of feature numbers after which repeated ones are dropped.
HELD = 1 << 23

_memory: dict[str, bytes] = {}
CACHES["quality"] = _memory.clear
_SIGN = re.compile(r"[\W_]")
_BLANK = re.compile(r"\s")


def _shape_number(word: str) -> int:
    """Of the letter shape: runs of upper case, lower case and digits as one sign, others as they are."""
    digest, last = xxhash.xxh64("s"), ""
    for at in range(0, len(word), STRETCH):
        out = ""
        for c in word[at:at + STRETCH]:
            s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if s != last:
                out += s
                last = s
        digest.update(out)
    return digest.intdigest() & ((1 << BITS) - 1)


def _number(name: str) -> int:
    return xxhash.xxh64_intdigest(name) & ((1 << BITS) - 1)


def _word_features(word: str) -> bytes:
    """The feature numbers of ``word``, all of it, as 32-bit integers."""
    core = _SIGN.sub("", word.lower())
    found = {_number("w" + core), _shape_number(word)}
    for at in range(0, len(core) - PART + 1, STRETCH):
        end = min(at + STRETCH, len(core) - PART + 1)
        found.update(map(_number, {"p" + core[i:i + PART] for i in range(at, end)}))
    return np.fromiter(found, np.int32, len(found)).tobytes()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of ``text`` (null or blank: none)."""
    counts: Counter[str] = Counter()
    text, at = text or "", 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE and (m := _BLANK.search(text, at + PIECE)):
            end = m.start()
        counts.update(text[at:end].split())
        at = end
    if not counts:
        return np.zeros(0, np.int32)
    if len(_memory) > REMEMBER:
        _memory.clear()
    found, held, signs, chars = [], 0, 0, 0
    for w, n in counts.items():
        known = _memory.get(w)
        if known is None:
            known = _word_features(w)
            if len(w) <= LETTERS:
                _memory[w] = known
        found.append(known)
        held += len(known)
        if held > HELD:
            found = [np.unique(np.frombuffer(b"".join(found), np.int32)).tobytes()]
            held = len(found[0])
        chars += n * len(w)
        if not w.isalnum():
            signs += n * len(_SIGN.findall(w))
    total = counts.total()
    size = total.bit_length()
    shares = [_number(f"distinct:{size}:{10 * len(counts) // total}"),
              _number(f"commonest:{size}:{20 * max(counts.values()) // total}"),
              _number(f"signs:{30 * signs // chars}")]
    return np.unique(np.concatenate((np.frombuffer(b"".join(found), np.int32), np.array(shares, np.int32))))


def sigmoid(x):
    return 0.5 * (1 + np.tanh(np.asarray(x) / 2))


def _log_odds(flat: np.ndarray, owner: np.ndarray, grades: np.ndarray, levels: int) -> np.ndarray:
    """How far a feature's share of the texts of one grade is from its share of the others, in logs."""
    n = 1 << BITS
    all_texts, most = np.bincount(flat, minlength=n), np.zeros(n)
    for g in range(levels):
        mine = grades == g
        if 0 < mine.sum() < len(mine):
            a = np.bincount(flat[mine[owner]], minlength=n)
            b = all_texts - a
            most = np.maximum(most, np.abs(np.log((a + 1) / (mine.sum() + 2) * ((~mine).sum() + 2) / (b + 1))))
    return most


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, weights: np.ndarray, levels: int,
                steps: int = 250, rate: float = 0.05, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2**BITS) and ``levels - 1`` ascending thresholds by full-batch Adam."""
    flat = np.concatenate(rows).astype(np.int32, copy=False) if rows else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    scale = _log_odds(flat, owner, grades, levels)
    known = np.flatnonzero((np.bincount(flat, minlength=1 << BITS) >= MIN_TEXTS) & (scale >= MIN_ODDS))
    renumber = np.full(1 << BITS, -1, np.int32)
    renumber[known] = np.arange(len(known))
    col = renumber[flat]
    keep = col >= 0
    col, row, scale = col[keep], owner[keep], scale[known]
    del flat, owner, keep
    total = weights.sum()
    # Thresholds as a first one and positive steps, so they stay in order.
    tail = np.array([max(weights[grades >= j].sum() / total, 1e-3) for j in range(1, levels)])
    first = -np.log(tail / np.maximum(1 - tail, 1e-3))
    theta = np.concatenate((first[:1], np.log(np.maximum(np.diff(first), 0.1))))
    params = np.concatenate((np.zeros(len(known)), theta))
    m, v = np.zeros_like(params), np.zeros_like(params)
    lo_open, hi_open = grades == 0, grades == levels - 1
    for t in range(1, steps + 1):
        w, theta = params[:len(known)], params[len(known):]
        cuts = np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:]))))
        score = np.bincount(row, (w * scale)[col], minlength=len(rows))
        up = np.where(lo_open, 1.0, sigmoid(score - cuts[np.maximum(grades - 1, 0)]))
        down = np.where(hi_open, 0.0, sigmoid(score - cuts[np.minimum(grades, levels - 2)]))
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up), down * (1 - down)
        g_score = -weights * (d_up - d_down) / p / total
        g_cut = np.zeros(levels - 1)
        np.add.at(g_cut, np.maximum(grades - 1, 0), weights * np.where(lo_open, 0, d_up) / p / total)
        np.add.at(g_cut, np.minimum(grades, levels - 2), -weights * np.where(hi_open, 0, d_down) / p / total)
        after = np.cumsum(g_cut[::-1])[::-1]
        g_theta = np.concatenate((after[:1], after[1:] * np.exp(theta[1:])))
        g = np.concatenate((scale * np.bincount(col, g_score[row], minlength=len(known)) + ridge * w, g_theta))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    full = np.zeros(1 << BITS)
    full[known] = params[:len(known)] * scale
    theta = params[len(known):]
    return full, np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:]))))


def train(docs: DataFrame, ratings: DataFrame, levels: int, id_col: str = "doc_id", text_col: str = "text",
          per_grade: int = PER_GRADE) -> tuple[np.ndarray, np.ndarray]:
    """Fit on ``ratings`` (id, grade 0..levels-1) joined with ``docs``; returns (weights, thresholds).

    Null grades and ids are left out.  Without any rated row the weights are zero.
    """
    ship(docs.sparkSession)
    rated = (ratings.where(F.col(id_col).isNotNull() & F.col("grade").between(0, levels - 1))
             .select(F.col(id_col).alias("_id"), F.col("grade").cast("int").alias("grade")).dropDuplicates(["_id"]))
    rated = written(rated, "ratings")
    counts = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return np.zeros(1 << BITS), np.arange(levels - 1, dtype=float)
    share = F.element_at(F.create_map(*[x for g, n in counts.items() for x in (
        F.lit(g), F.lit(min(1.0, per_grade / n)))]), F.col("grade"))
    uniform = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = rated.where(uniform < share).select("_id", "grade", (1 / share).alias("weight"))
    # The sample's ids are about ``levels x per_grade`` rows, whatever the input.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(picked), "_id")
    one = _featured(texts).withColumn("one", F.lit(0))      # a bounded sample, see PER_GRADE
    found = one.groupBy("one").applyInPandas(_fit_group(levels), "w binary, cuts array<double>").collect()
    if not found:
        return np.zeros(1 << BITS), np.arange(levels - 1, dtype=float)
    return np.frombuffer(found[0]["w"], np.float64), np.array(found[0]["cuts"])


def _featured(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([features(t.as_py()) for t in b.column(3)],
                                                                 pa.list_(pa.int32()))],
                names=["_id", "grade", "weight", "f"])
    cols = texts.select("_id", "grade", "weight", "_t")
    kind = cols.schema["_id"].dataType.simpleString()
    return cols.mapInArrow(run, f"_id {kind}, grade int, weight double, f array<int>")


def _fit_group(levels: int):
    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_id")
        w, cuts = fit_ordinal([np.asarray(x) for x in part["f"]], part["grade"].to_numpy(),
                              part["weight"].to_numpy(), levels)
        return pd.DataFrame({"w": [w.tobytes()], "cuts": [cuts.tolist()]})
    return fit


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: tuple[str, ...]) -> DataFrame:
    """``docs`` with ``score``, ``expected_grade`` and ``tail_probability`` (of the best grade).

    ``text`` names the text column, or a struct column and its field.  The frame's columns
    pass through; those three names must be free in it.
    """
    spark = docs.sparkSession
    ship(spark)
    names = docs.columns
    place = names.index(text[0])
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache("quality")
        w, cuts = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                texts = b.column(place)
                for field in text[1:]:
                    texts = pc.struct_field(texts, field)
                s = np.array([float(w[features(t.as_py())].sum(dtype=np.float64)) for t in texts])
                tails = sigmoid(s[:, None] - cuts[None, :])
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(s, pa.float64()), pa.array(tails.sum(axis=1), pa.float64()),
                     pa.array(tails[:, -1], pa.float64())],
                    names=[*names, "score", "expected_grade", "tail_probability"])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in (
        "score", "expected_grade", "tail_probability")]])
    return docs.mapInArrow(run, schema)


def grade_documents(docs: DataFrame, ratings: DataFrame, levels: int = 3, min_tail: float = 0.5,
                    id_col: str = "doc_id", text_col: str = "text", per_grade: int = PER_GRADE) -> DataFrame:
    """One row per row of ``docs``: id, score, expected_grade, tail_probability, kept.

    A null or empty text has no features and score 0; it is kept if the rated rows lean
    to the best grade.  Without ratings every text has score 0.  Other columns are not read.
    """
    model = train(docs, ratings, levels, id_col, text_col, per_grade)
    out = score(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), model, ("_t",))
    return out.select(F.col("_id").alias(id_col), "score", "expected_grade", "tail_probability",
                      (F.col("tail_probability") >= min_tail).alias("kept"))


def keep_good(docs: DataFrame, ratings: DataFrame, levels: int = 3, min_tail: float = 0.5, id_col: str = "doc_id",
              text_col: str = "text", per_grade: int = PER_GRADE) -> DataFrame:
    """The rows of ``docs``, all columns, whose tail probability is at least ``min_tail``."""
    model = train(docs, ratings, levels, id_col, text_col, per_grade)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return (score(packed, model, ("_doc", text_col))
            .where(F.col("tail_probability") >= min_tail).select("_doc.*"))
