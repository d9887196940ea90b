"""WARC archives, embedding near-dedup, the quality classifier and the pipeline on small tables."""

import base64
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tarmac.llm import quality
from tarmac.llm.embed_dedup import embedding_groups
from tarmac.llm.quality import grade_documents, keep_good
from tarmac.llm.warc import archive_pages, parse_record, read_archives, resolve_revisits, write_archives
from tarmac.llm.util import scratch_dir

from .data import awkward_rows, frame, words

PAGE = "page_id bigint, url string, html string, _doc string, _id int, _sha string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


PAGES = [(1, "http://a/1", "<p>eins</p>"), (2, "http://a/2", "<p>eins</p>"), (3, None, "<p>zwei\r\n\r\nWARC/1.1</p>"),
         (4, "http://a/\r\nX: 4", ""), (5, "http://a/5", None), (6, "http://a/6", "é" * 200_000), (None, "u", "<p>eins</p>"),
         (None, None, "nur null"), (8, "u", "zweimal"), (8, "v", "zweimal"), (9, "w", "x\r\n\r\n")]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x", 1, "y") for r in PAGES], PAGE).repartition(4)
    got = archive_pages(pages).collect()
    groups = defaultdict(list)
    for i, _, html in PAGES:
        groups[digest(html)].append(i)
    assert len(got) == len(PAGES)
    for r in got:
        best = max((i for i in groups[r.payload_digest] if i is not None), default=None)
        assert r.record_type == ("response" if r.page_id == best else "revisit")
        assert r.refers_to == (None if r.page_id == best else best)
        if r.record_type == "response":
            assert digest(bytes(r.payload).decode()) == r.payload_digest and len(r.payload) == r.payload_bytes
        else:
            assert r.payload is None
    want = sorted((str(i), digest(h), len((h or "").encode())) for i, _, h in PAGES)
    assert sorted((str(r.page_id), r.payload_digest, r.payload_bytes) for r in got) == want
    assert archive_pages(spark.createDataFrame([], PAGE)).count() == 0


def test_small_payloads_stay_responses_below_the_limit(spark):
    pages = spark.createDataFrame([(i, "u", "ab") for i in range(4)], "page_id bigint, url string, html string")
    assert {r.record_type for r in archive_pages(pages, min_bytes=3).collect()} == {"response"}


def test_files_are_gzip_members_with_warc_records(spark):
    import gzip
    import os
    pages = spark.createDataFrame([r for r in PAGES], "page_id bigint, url string, html string").coalesce(1)
    folder = scratch_dir(spark, "t-warc")
    manifest = write_archives(resolve_revisits(pages, "page_id", "html"), folder, "url", "2020-01-01T00:00:00Z")
    rows = manifest.orderBy("offset").collect()
    path = folder.removeprefix("file:")
    data = open(os.path.join(path, rows[0].file), "rb").read()
    assert rows[-1].offset + rows[-1].length == len(data)
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    fields, _ = parse_record(gzip.decompress(data[rows[0].offset:rows[0].offset + rows[0].length]))
    assert fields["WARC-Date"] == "2020-01-01T00:00:00Z" and fields["WARC-Record-ID"].startswith("<urn:page:")
    # A file of a lost attempt is not in the manifest and is not read.
    open(os.path.join(path, "part-99999-7-0000.warc.gz"), "wb").write(b"half a file")
    assert read_archives(manifest, folder).count() == len(PAGES)


def vectors():
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (0, 1, None):
        centres = rng.normal(size=(25, 8))
        for c in centres:
            for _ in range(rng.integers(1, 6)):
                rows.append((n, (c + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.5])).astype(float).tolist(), label))
                n += 1
    rows += [(n + i, rows[3][1], 0) for i in range(4)]                   # equal vectors
    rows += [(n + 10, [2 * x for x in rows[3][1]], 0), (n + 11, [0.0] * 8, 0), (n + 12, None, 0),
             (n + 13, [float("nan")] + [1.0] * 7, 0), (n + 14, [None] + [1.0] * 7, 0), (n + 15, [float("inf")] * 8, 0),
             (n + 16, [1.0, 2.0], 0), (n + 17, [1.0, 2.0], 0), (None, rows[3][1], 0), (n + 18, [], 0), (5, rows[8][1], 1)]
    return rows


@pytest.mark.parametrize("sizes", [dict(), dict(cell=12, block=5)])
def test_embedding_groups_equal_brute_force(spark, sizes):
    rows = vectors()
    schema = "vec_id bigint, embedding array<double>, label int, v string, gid int"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3)
    got = embedding_groups(df, **sizes).collect()
    ok = [r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if k else None for r, k in zip(rows, ok)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    want = [(r[0], links[i], c := min(least[find(i)], default=None), r[0] == c) for i, r in enumerate(rows)]
    assert sum(links) > 40
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert embedding_groups(spark.createDataFrame([], schema)).count() == 0


def rated(n=420, seed=4):
    rng = random.Random(seed)
    rows, grades = [], []
    for i in range(n):
        text, grade = words(rng, rng.randint(30, 120)), (2, 2, 1, 0)[i % 4]
        if grade == 1:
            text = " ".join(w + rng.choice(["###", "%%%"]) for w in text.split())
        if grade == 0:
            text += f" xq{rng.choice('abc')}zzik " * rng.randint(1, 3) + words(rng, 5)
        rows.append((i, text, "en", "s", len(text)))
        grades.append((i, grade))
    return rows, grades


def test_more_than_512_centres_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1300, 8))
    base[650:] = base[:650] + 0.08 * rng.normal(size=(650, 8))
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(base)]
    got = embedding_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"),
                           cell=2, max_cells=650, block=64).collect()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert want.sum() > 1000 and {r.vec_id: r.n_links for r in got} == dict(enumerate(want.tolist()))


def test_norms_out_of_range_and_the_threshold_itself(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [2e200, 2e200], 1), (3, [1.0, 1.0], 1), (4, [1e-200, 1e-200], 1), (5, [5e-324, 5e-324], 1),
            (6, [1e-200, 0.0], 2), (7, [1e300, 0.0], 2), (8, [-1e300, 0.0], 2), (9, [0.8, 0.6], 3), (10, [1.0, 0.0], 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(df, threshold=0.8).collect()}
    assert got == {**{i: (4, 1) for i in range(1, 6)}, 6: (1, 6), 7: (1, 6), 8: (0, 8), 9: (1, 9), 10: (1, 9)}


def test_labels_of_some_vectors_have_cells_and_the_fit_moves_centres(spark):
    from tarmac.llm import embed_dedup as e
    vecs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label")
    _, reps = e._representatives(vecs, "vec_id", "embedding", "label")
    centres = e._centres(reps, e.CELL, e.MAX_CELLS)
    sizes = {r["label"]: r["count"] for r in reps.groupBy("label").count().collect()}
    assert {k[0]: len(c) for k, c in centres.items()} == {l: min(8, -(-n // 8)) for l, n in sizes.items() if n > 8}
    own = {r["label"]: [] for r in reps.select("label").distinct().collect()}
    for r in reps.select("label", "v").collect():
        own[r["label"]].append(r["v"])
    for (label, _), c in centres.items():
        x = e.unit(own[label])
        fitted, start = (x @ c.T).max(axis=1).mean(), (x @ x[:len(c)].T).max(axis=1).mean()
        assert np.allclose(np.linalg.norm(c, axis=1), 1) and fitted > start - 0.05


def test_many_centres_need_little_memory_and_lose_no_guest():
    import tracemalloc
    from tarmac.llm import embed_dedup as e
    rng = np.random.default_rng(5)
    x = e.unit(list(rng.normal(size=(48 * 700, 16))))
    tracemalloc.start()
    c = x[:700].copy()
    e.nearest(x, c)
    assert tracemalloc.get_traced_memory()[1] < 60e6              # all products at once: 188 MB
    tracemalloc.stop()
    c = np.concatenate((c, e.unit(list(c[:50] + 1e-8 * rng.normal(size=(50, 16))))))      # centres next to others
    v, reach = x[1000:1400], np.sqrt(2 - 2 * 0.98)
    tracemalloc.start()
    rows, cells, guest = e._cells(v, c, reach)
    assert tracemalloc.get_traced_memory()[1] < 25e6              # rows x centres x dim: 38 MB
    tracemalloc.stop()
    dots = v @ c.T
    own = dots.argmax(axis=1)
    gap = np.linalg.norm(c[own][:, None] - c[None], axis=2)
    need = (dots[np.arange(400), own][:, None] - dots <= reach * gap) & (np.arange(len(c)) < own[:, None])
    got = np.zeros_like(need)
    got[rows[guest], cells[guest]] = True
    assert need.sum() > 400 and not (need & ~got).any() and got.sum() < 1.01 * need.sum() + 5
    assert (rows[~guest] == np.arange(400)).all() and (cells[~guest] == own).all()


def test_classifier_on_held_out_texts(spark):
    rows, grades = rated()
    docs = frame(spark, rows, clash=True)
    train = [(i, g) for i, g in grades if i % 3]
    ratings = spark.createDataFrame(train + [(None, 1), (3, None), (10**9, 2)], "doc_id bigint, grade int")
    got = {r.doc_id: r for r in grade_documents(docs, ratings).collect()}
    held = [(i, g) for i, g in grades if i % 3 == 0]
    assert np.mean([got[i].kept == (g == 2) for i, g in held]) > 0.95
    by = [np.mean([got[i].expected_grade for i, g in held if g == level]) for level in range(3)]
    assert by[0] < by[1] < by[2]
    kept = keep_good(docs, ratings)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.kept}


def test_classifier_edges(spark):
    docs = frame(spark, awkward_rows(), clash=True)
    none = spark.createDataFrame([], "doc_id bigint, grade int")
    got = grade_documents(docs, none).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.0}
    one = spark.createDataFrame([(1, 2), (2, 2)], "doc_id bigint, grade int")
    assert grade_documents(docs, one).count() == docs.count()
    assert grade_documents(frame(spark, []), one).count() == 0


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    true = rng.normal(size=40)
    rows = [np.flatnonzero(rng.random(40) < 0.3) for _ in range(1500)]
    s = np.array([true[r].sum() for r in rows]) + rng.logistic(size=1500) * 0.3
    grades = np.digitize(s, [-1.0, 1.5])
    w, cuts = quality.fit_ordinal(rows, grades, np.ones(1500), 3)
    assert cuts[0] < cuts[1]
    fit = np.array([w[r].sum() for r in rows])
    assert np.corrcoef(fit, s)[0, 1] > 0.4


def test_features_of_a_long_text_do_not_depend_on_the_pieces(monkeypatch):
    text = " ".join(r[1] for r in awkward_rows() if r[1])[:40_000]
    whole = quality.features(text)
    monkeypatch.setattr(quality, "PIECE", 1000)
    assert (quality.features(text) == whole).all()


def test_features_cover_the_whole_of_a_long_word(monkeypatch):
    clean, bad = "温和的文字" * 40, "恶劣言语"
    numbers = set(quality.features(clean + bad).tolist())
    assert {quality._number("p" + bad), quality._number("p字恶劣言")} <= numbers
    whole = quality.features(("Ab1-" * 50 + clean + bad) * 3 + " x " + "y" * 90)
    for name in ("STRETCH", "HELD"):
        monkeypatch.setattr(quality, name, 7)
        assert quality.features(("Ab1-" * 50 + clean + bad) * 3 + " x " + "y" * 90).tolist() == whole.tolist()
    assert not [w for w in quality._memory if len(w) > quality.LETTERS]
    assert quality._shape_number("A" * 70 + "1") != quality._shape_number("A" * 70)


def test_pipeline_stages_take_effect(spark, tmp_path):
    rows, grades = rated(300)
    good = [r for r, (_, g) in zip(rows, grades) if g == 2]
    rows += [(1000 + i, good[i][1], "en", "t", 1) for i in range(5)]             # exact copies
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(g != 1), int(g == 0)) for i, g in grades]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), docs.schema)
        assert now.columns == columns
        counts.append(now.count())
    bad = {i for i, g in grades if g != 2}
    assert not bad & {r.doc_id for r in now.collect()}
    assert counts[0] > counts[1] and {good[i][0] for i in range(5)}.isdisjoint(r.doc_id for r in now.collect())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    per = defaultdict(int)
    for p in pieces:
        per[p.sequence_id] += p.length
    assert max(per.values()) <= 1024
    assert {p.doc_id for p in pieces} == {r.doc_id for r in now.collect()}
