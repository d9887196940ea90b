"""Resampling, the divergence audit and the repetition rules against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarmac.llm import divergence, quality_rules, resample
from tarmac.llm.divergence import audit
from tarmac.llm.quality_rules import drop_repetitive, repetition
from tarmac.llm.resample import draw_documents

from .data import DOC, awkward_rows, frame, shuffled, words

ROWS = awkward_rows()
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return shuffled(frame(spark, ROWS, clash=True))


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def key(row):
    return tuple((x is None, str(x)) for x in row)


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- operator 11

def buckets_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))
    runs = [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return w, [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute_draw(rows, target):
    s = Counter(b for _, t, *_ in rows for b in buckets_of(t)[1])
    t = Counter(b for x in target for b in buckets_of(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, text, *_ in rows:
        w, bs = buckets_of(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
                     for b in bs)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(bs), weight, score, None, len(w) >= 20])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:5 * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=key)


TARGET = [words(__import__("random").Random(9), 40), ROWS[3][1][:80], None, "", "Ein TEXT, ein Text"]


def test_resample_equals_brute_force(spark, docs):
    rng = __import__("random").Random(11)
    more = ROWS + [(1000 + i, words(rng, rng.randint(0, 60)), "en", "s", 1) for i in range(300)]
    target = spark.createDataFrame([(t, i) for i, t in enumerate(TARGET)], "text string, score int")
    got = resample.resample(shuffled(frame(spark, more, clash=True)), target).collect()
    want = brute_draw(more, TARGET)
    assert sorted(map(tuple, got), key=key) == want
    assert sum(r[4] is not None for r in want) > 10


def test_resample_edges(spark, docs, nothing):
    empty = nothing.select("text")
    assert resample.resample(nothing, empty).count() == 0
    assert resample.resample(docs, empty).where("rank is not null").count() == 5 * sum(
        len(buckets_of(t)[0]) >= 20 for _, t, *_ in ROWS) // 100
    short = frame(spark, [(1, "a b", None, None, None), (2, None, None, None, None)])
    assert {(r.doc_id, r.n_features, r.rank) for r in resample.resample(short, empty).collect()} == {(1, 3, None),
                                                                                                   (2, 0, None)}
    got = draw_documents(docs, empty, percent=50)
    assert got.columns == docs.columns and got.where("length(text) > 0").count() == got.count() > 0


def test_ties_repeated_and_null_ids_are_drawn_in_order(spark):
    text = "eins zwei drei " * 10
    rows = [(7, text, None, None, None)] * 30 + [(None, text, None, None, None)] * 10
    got = resample.resample(shuffled(frame(spark, rows)), frame(spark, []).select("text"), percent=80).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 33))
    seven, null = ([r["rank"] for r in got if (r.doc_id is None) == n] for n in (False, True))
    best = seven if got[0].weight is not None and max(r.score for r in got if r.doc_id == 7) >= max(
        r.score for r in got if r.doc_id is None) else null
    assert None not in best or len(best) > 32


@pytest.mark.parametrize("k", [1, 2, 17, 250, 499, 500])
def test_quickselect_finds_every_place(spark, k):
    rng = np.random.default_rng(k)
    values = [(int(v), i) for i, v in enumerate(rng.integers(0, 40, 500))]
    df = spark.createDataFrame(values, "v long, i long")
    assert tuple(resample.kth_key(df, ["v", "i"], k, 500)) == sorted(values)[k - 1]


def test_long_texts_go_piece_by_piece(monkeypatch):
    rng = __import__("random").Random(2)
    texts = [words(rng, n).encode() for n in (0, 1, 2, 3, 50, 400, 2, 900, 1)] + [None, b"x" * 500, b" , "]
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(resample, "PIECE", piece)
        got = defaultdict(Counter)
        for row, bucket in resample.features(texts, 10_000):
            for r, b in zip(row.tolist(), bucket.tolist()):
                got[r][b] += 1
        for i, t in enumerate(texts):
            assert got[i] == Counter(buckets_of((t or b"").decode())[1]), (piece, i)


# ---- operator 12

def brute_audit(rows, min_docs):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded(text))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]

        def probs(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        p = {s: probs(counts[lang, s]) for s in sources}
        q = probs(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:10])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize("block,tile", [(4096, 64), (5, 2)])
def test_audit_equals_brute_force(spark, docs, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    for min_docs in (3, 10):
        got = sorted(map(tuple, audit(docs, min_docs=min_docs).collect()))
        assert got == brute_audit(ROWS, min_docs)
    assert any(r[2] == "term" for r in got) and any(r[4] == 0 for r in got)


def test_audit_edges(spark, nothing):
    assert audit(nothing).count() == 0
    rows = [(1, None, None, None, 1), (2, "selten", "xx", "a", 1), (3, None, "xx", "b", 1), (4, "x y", "yy", "a", 1)]
    assert sorted(map(tuple, audit(frame(spark, rows)).collect())) == [
        ("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)]


def test_counts_flushed_early_and_in_pieces_add_up(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "" for r in ROWS], "source": [r[3] or "" for r in ROWS],
                                        "text": [r[1] or "" for r in ROWS]})

    def counted():
        total = Counter()
        for part in divergence._count(iter([batch, batch.slice(0, 9)])):
            for lang, source, term, n, docs in zip(*(c.to_pylist() for c in part.columns)):
                total[lang, source, term, "n"] += n
                total[lang, source, term, "docs"] += docs
        return total
    whole = counted()
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "PIECE", 40)
    assert counted() == whole and len(whole) > 1000


def test_probability_and_divergence_are_exact_beyond_long(spark):
    n, total, v = 9_000_000_000_000, 70_000_000_000_000, 123_456_789
    df = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    p, q = df.select(divergence.probability("n", "total", "v"),
                     divergence.divergence(F.lit(10**9 + 1).cast("long"), F.lit(1).cast("long"))).first()
    assert p == 1 + 10**9 * (n + 2) // (total + 2 * v) and q == 10**18 // (10**9 + 2)


def test_block_columns_keep_every_pair_sum():
    rng = np.random.default_rng(5)
    counts = rng.geometric(0.4, (7, 300)) - 1
    totals = counts.sum(axis=1).tolist()
    columns = divergence.block_columns(counts, totals, 300)
    probs = [[1 + 10**9 * (int(c) + 2) // (t + 600) for c in row] for row, t in zip(counts, totals)]
    for a in range(7):
        for b in range(7):
            assert divergence.runs_divergence(columns[a], columns[b], 300) == sum(
                (x - y) ** 2 // (x + y) for x, y in zip(probs[a], probs[b]))
    assert max(len(s) for s, _ in columns) < 300          # equal counts do cluster


# ---- operator 13

def brute_rules(text):
    data = (text or "").encode()
    w = [x.decode() for x in WORDS.findall(data)]
    total = sum(map(len, w))
    lines = [x for x in (text or "").split("\n") if WORDS.search(x.encode())]
    seen, dup, dup_chars = set(), 0, 0
    for line in lines:
        if line in seen:
            dup += 1
            dup_chars += sum(len(x.decode()) for x in WORDS.findall(line.encode()))
        seen.add(line)

    def cover(n):
        grams = Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
        inside = {j for i in range(len(w) - n + 1) if grams[tuple(w[i:i + n])] > 1 for j in range(i, i + n)}
        return len(inside), sum(len(w[j]) for j in inside)
    repeats = cover(5)[0]
    failed = len(w) < 10 or 100 * repeats > 20 * len(w)
    chars = [cover(n)[1] for n in range(5, 11)]
    bad = 100 * dup_chars > 20 * total or any(100 * c > (20 - n) * total for n, c in zip(range(5, 11), chars))
    return (len(w), total, sum((text or "").count(c) for c in "#*$%&|<>"), dup, repeats, failed,
            not failed and not bad, dup_chars, *chars)


def repetitive_rows():
    rng = __import__("random").Random(21)
    line = words(rng, 6)
    base = [words(rng, 120) for _ in range(8)]
    texts = [line + "\n" + base[0] + "\n" + line, "\n".join([line] * 5), base[1] + " " + base[1][:150] + " #|<>",
             base[2] + "\r\n" + base[2], "a " * 400, "ab " * 9, "w " * 10, "\n\n \n", base[3] + "\n\n" + base[3][:60],
             "\n".join(f"{line} {i % 3}" for i in range(12)), "ééé " * 30 + base[4], base[5].replace(" ", "\x0b"),
             " ".join(base[6].split()), "Z\x85z   " + base[7], "one two three four five six seven eight nine ten"]
    return ROWS + [(2000 + i, t, "en", "s", 1) for i, t in enumerate(texts)]


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
           "dup_line_chars", *[f"chars_{n}" for n in range(5, 11)]]


def test_repetition_equals_brute_force(spark):
    rows = repetitive_rows()
    got = repetition(shuffled(frame(spark, rows, clash=True))).select("doc_id", *COLUMNS).collect()
    want = [(i, *brute_rules(t)) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r[7] for r in want} == {True, False} and sum(r[6] for r in want) > 0


@pytest.mark.parametrize("stack", [50, 3000])
def test_stacks_and_pieces_change_nothing(monkeypatch, stack):
    texts = [(t or "").encode() for i, t, *_ in repetitive_rows()]
    whole = quality_rules.measure(texts, [5, 7])
    monkeypatch.setattr(quality_rules, "STACK", stack)
    parts = [quality_rules.measure(s, [5, 7]) for s in quality_rules._stacks(texts)]
    assert len(parts) > 1
    for c, values in whole.items():
        assert np.array_equal(np.concatenate([p[c] for p in parts]), values), c


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(quality_rules, "_mixed", lambda n: (n % 2).astype(np.uint64))
    texts = [t.encode() for _, t, *_ in repetitive_rows()[-15:]]
    got = quality_rules.measure(texts, [5, 6, 7, 8, 9, 10])
    for i, t in enumerate(texts):
        want = brute_rules(t.decode())
        assert (got["words_5"][i], *[got[f"chars_{n}"][i] for n in range(5, 11)]) == (want[4], *want[8:])


def test_repetition_edges(spark, docs, nothing):
    assert repetition(nothing).count() == 0
    got = drop_repetitive(docs)
    assert got.columns == docs.columns
    keep = sorted((str(i), t) for i, t, *_ in ROWS if brute_rules(t)[6])
    assert sorted((str(r.doc_id), r.text) for r in got.select("doc_id", "text").collect()) == keep
