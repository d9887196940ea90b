"""Each document operator against brute force, on awkward rows, empty tables and clashing names."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarmac.llm import catalog, packing, suffix
from tarmac.llm.exact import drop_exact_copies, exact_groups
from tarmac.llm.mixing import MAX_RATE, emit_mix, mix
from tarmac.llm.sharding import cut_links, shard
from tarmac.llm.simhash import drop_near_copies, simhash_groups
from tarmac.llm.token_store import ids_crc32, read_store, store_index, write_store
from tarmac.llm.util import scratch_dir

from .data import awkward_rows, frame, shuffled

ROWS = awkward_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return shuffled(frame(spark, ROWS, clash=True))


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def key(x):
    return (x is None, x if x is not None else 0)


def ids_of(name, text, end):
    lib = Tokenizer.from_file(catalog.tokenizer_file(name))
    return lib.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_exact_groups(docs, nothing):
    got = exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    groups = defaultdict(list)
    for i, text, *_ in ROWS:
        groups[hashlib.sha256((text or "").encode()).hexdigest()].append(i)
    kept = defaultdict(int)
    for r in got:
        own = groups[r.text_sha256]
        assert r.group_size == len(own)
        assert r.keep_id == max((i for i in own if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept) == set(groups) and set(kept.values()) == {1}
    assert exact_groups(nothing).count() == 0


@pytest.mark.parametrize("keep", ["max", "min"])
def test_drop_exact_copies(docs, nothing, keep):
    got = drop_exact_copies(docs, keep=keep)
    assert got.columns == docs.columns
    rows = got.select("doc_id", "text").collect()
    texts = [r.text or "" for r in rows]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in ROWS})
    best = max if keep == "max" else min
    for r in rows:
        own = [i for i, t, *_ in ROWS if (t or "") == (r.text or "") and i is not None]
        assert r.doc_id == best(own, default=None)
    assert drop_exact_copies(nothing).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, near):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if near(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {f: find(f) for f in fps}


def test_simhash_groups(docs, nothing):
    got = simhash_groups(docs).collect()
    fps = {i: brute_fingerprint(t) for i, (_, t, *_) in enumerate(ROWS)}
    roots = brute_components(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(list)
    for n, (i, *_) in enumerate(ROWS):
        if i is not None:
            least[roots[fps[n]]].append(i)
    want = sorted(((i, f"{fps[n]:016x}", min(least[roots[fps[n]]], default=None))
                   for n, (i, *_) in enumerate(ROWS)), key=lambda r: (key(r[0]), r[1]))
    assert sorted(map(tuple, got), key=lambda r: (key(r[0]), r[1])) == want
    assert len(set(r[2] for r in want)) < len(set(r[1] for r in want))   # some link joins two fingerprints
    assert simhash_groups(nothing).count() == 0


def test_drop_near_copies(docs, nothing):
    got = drop_near_copies(docs)
    assert got.columns == docs.columns
    want = {r.component_id for r in simhash_groups(docs).collect()}
    assert sorted((r.doc_id for r in got.select("doc_id").collect()), key=key) == sorted(want, key=key)
    assert drop_near_copies(nothing).count() == 0


def test_ball_links_reach_every_distance(spark):
    """Planted pairs at 0 to 4 differing bits, in every mix of halves and parities."""
    import random

    from tarmac.llm.simhash import _candidates, _signed, ball_links
    from tarmac.llm.components import components
    rng = random.Random(5)
    pairs = []
    for distance in (1, 2, 3, 4):
        for _ in range(40):
            a = rng.getrandbits(64)
            bits = rng.sample(range(64), distance)
            pairs.append((a, a ^ sum(1 << b for b in bits), distance))
    flat = sorted({_signed(x) for a, b, _ in pairs for x in (a, b)})
    fps = spark.createDataFrame([(x,) for x in flat], "fp bigint")
    root = {r.node: r.root for r in components(ball_links(_candidates(fps))).collect()}
    for a, b, distance in pairs:
        linked = _signed(a) in root and root.get(_signed(a)) == root.get(_signed(b))
        assert linked == (distance <= 3)


def test_mix(docs, nothing):
    got = mix(docs).collect()
    assert len(got) == len(ROWS)
    total = sum(r["size"] for r in got)
    per = {r.source_size: r.target for r in got if r.source_size}
    assert abs(sum({(r.source_size, r.target) for r in got} and
                   [t for t in {(r.source_size, r.target): r.target for r in got}.values()]) - total) < 1e-6 * total
    assert all(t <= MAX_RATE * s + 1e-9 for s, t in per.items())
    assert all(r.taken <= MAX_RATE * r["size"] and r.taken % max(r["size"], 1) == 0 for r in got)
    emitted = emit_mix(docs)
    assert emitted.columns == docs.columns
    assert emitted.count() == sum(r.copies for r in got)
    assert sorted(map(tuple, mix(docs.repartition(3)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mix(nothing).count() == 0 and emit_mix(nothing).count() == 0


def test_targets_stop_at_three_times_and_reshare(spark):
    from tarmac.llm.mixing import source_targets
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 400, None: 2}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in source_targets(df).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, want, free = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            want.update(share)
            break
        want.update({s: 3.0 * sizes[s] for s in over})
        free -= over
    assert got == pytest.approx(want)


def test_shard_rows_law_and_links(docs, nothing):
    got = shard(docs, shards=7, rounds=2)
    rows = got.collect()
    assert len(rows) == len(ROWS)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(7)]
    assert max(counts) - min(counts) <= 1
    want = sorted((key(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert sorted((key(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    links = cut_links(got, "text_crc32").first()
    assert links["cut"] == 0
    assert shard(nothing, shards=7, rounds=1).count() == 0


def test_shard_splits_a_hot_group_evenly(spark):
    rows = [(i, "same" if i < 200 else f"text {i // 2}", "", "", 0) for i in range(600)]
    got = shard(frame(spark, rows), shards=8, rounds=2).collect()
    counts = defaultdict(int)
    for r in got:
        counts[r.shard] += 1
    assert sorted(counts.values()) == [75] * 8
    hot = zlib.crc32(b"same")
    assert len({r.shard for r in got if r.text_crc32 == hot}) <= 5      # 200 rows need three shards


@pytest.mark.parametrize("size,share", [(60, 0.6), (60, 1.0), (30, 0.8), (30, 1.0), (20, 1.0), (4, 1.0)])
def test_groups_that_fit_are_not_cut(spark, size, share):
    total = 8 * 120                                                     # 8 shards of 120 rows
    rows = [(i, f"group {i // size}" if i < share * total else f"text {i}", "", "", 0) for i in range(total)]
    got = shard(frame(spark, rows), shards=8)
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [120] * 8
    assert cut_links(got, "text_crc32").first()["cut"] == 0


def test_token_store(spark, docs, nothing):
    path = scratch_dir(spark, "t-store")
    write_store(docs, path, catalog.tokenizer_file("word_bpe_49k.json"), end_id=1)
    got = sorted(store_index(spark, path).collect(), key=lambda r: r.start)
    want = sorted((key(i), crc(x := ids_of("word_bpe_49k.json", t, 1)), len(x)) for i, t, *_ in ROWS)
    assert sorted((key(r.doc_id), r.ids_crc32, r.n_tokens) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in got][:2] == [None, None]
    assert read_store(spark, path, F.col("doc_id") == 304).count() == 1
    empty = scratch_dir(spark, "t-store")
    write_store(nothing, empty, catalog.tokenizer_file("word_bpe_49k.json"))
    assert store_index(spark, empty).count() == 0


def test_pack(docs, nothing):
    tokenizer = catalog.tokenizer_file("byte_bpe_50k.json")
    pieces = ids_crc32(packing.pack(docs, tokenizer, capacity=256, block=16, tail=8)).collect()
    want = sorted(crc(ids_of("byte_bpe_50k.json", t, 0)) for _, t, *_ in ROWS)
    back = packing.pack(docs, tokenizer, capacity=256, block=16, tail=8).collect()
    assert sorted(p.crc for p in pieces) == sorted(crc([x & 0xFFFFFFFF for x in r.ids]) for r in back)
    texts = defaultdict(list)
    for r in back:
        texts[r.doc_id].append((r.start, r.doc_tokens, r.ids))
    whole = []
    for i, parts in texts.items():
        if i in (None, 7):
            continue                            # repeated ids: several documents under one key
        parts.sort()
        ids = [x for _, _, p in parts for x in p]
        assert parts[0][1] == len(ids)
        assert [s for s, _, _ in parts] == list(np.cumsum([0, *[len(p) for *_, p in parts]])[:-1])
        whole.append(crc(ids))
    assert set(whole) <= set(want)
    windows = defaultdict(list)
    for r in back:
        windows[r.sequence_id].append((r.offset, len(r.ids)))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 256
    total = sum(len(r.ids) for r in back)
    assert total == sum(len(ids_of("byte_bpe_50k.json", t, 0)) for _, t, *_ in ROWS)
    short = packing.pack(docs, tokenizer, capacity=256, block=16, tail=8, digest=True).collect()
    assert sorted(map(str, short)) == sorted(map(str, pieces))
    assert packing.pack(nothing, tokenizer).count() == 0


def test_differencing_is_near_equal_and_raises_the_window_count():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 400):
        sizes = rng.integers(1, 1024, n).tolist()
        windows = packing.deal(sizes)
        assert sorted(i for w in windows for i in w) == list(range(n))
        sums = [sum(sizes[i] for i in w) for w in windows]
        assert max(sums) <= 1024
    assert len(packing.deal([600, 600, 600])) == 3
    small = [sum(4 for _ in w) for w in packing.difference([4] * 40, 8)]
    assert small == [20] * 8


def brute_repeats(rows, span=50):
    order = lambda i: i if i is not None else 1 << 62
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for x in range(len(b) - span + 1):
            w = b[x:x + span]
            first[w] = min(first.get(w, 1 << 63), order(i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for x in range(len(b) - span + 1):
            if first[b[x:x + span]] < order(i):
                gone[x:x + span] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (key(r[0]), r[1:]))


@pytest.mark.parametrize("hot", [100_000, 1])
def test_suffix_repeats(spark, nothing, monkeypatch, hot):
    rows = awkward_rows() + [(400 + i, "ab" * 60 + "x" * i, "", "", 0) for i in range(8)]
    rows += [(500, "z" * 300, "", "", 0), (501, "z" * 49, "", "", 0), (502, "z" * 51 + "y", "", "", 0)]
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SORT", 50)
    got = suffix.drop_repeats(frame(spark, rows, clash=True).repartition(5, "text")).drop("kept").collect()
    assert sorted(map(tuple, got), key=lambda r: (key(r[0]), r[1:])) == brute_repeats(rows)
    assert suffix.drop_repeats(nothing).count() == 0


def test_hot_grams_need_no_further_pass_over_the_texts(spark, monkeypatch):
    rows = [(i, "the very same long passage that all of these documents hold, word by word, " + "xyz"[i % 3] * i, "", "", 0)
            for i in range(40)]
    read = {}
    for hot in (100_000, 1):
        monkeypatch.setattr(suffix, "HOT", hot)
        seen = spark.sparkContext.accumulator(0)

        def counted(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b
        docs = frame(spark, rows).select("doc_id", "text").mapInArrow(counted, "doc_id bigint, text string")
        suffix.repeated_spans(docs).count()
        read[hot] = seen.value
    assert read[1] == read[100_000] > 0


def test_one_document_stands_for_the_windows_of_a_hot_gram():
    import pyarrow as pa
    text = b"0123456789" * 5
    n = 3000
    held = pa.table([pa.array(x) for x in ([7] * n, range(n), range(n), [0] * n, [0] * n, [0] * n, [0] * n, [text] * n)],
                    names=suffix.CONTEXT.names).cast(suffix.CONTEXT)
    windows, found = suffix.hot_windows(held)
    assert windows.select(["doc", "k", "start", "n"]).to_pylist() == [{"doc": 0, "k": 0, "start": 0, "n": 1}]
    assert sorted(found["k"].to_pylist()) == list(range(1, n))


def test_long_texts_are_cut_into_overlapping_buffers(monkeypatch):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 5000).astype(np.uint8).tobytes()
    whole = {(int(p), int(a), int(b)) for buf, _, s, _ in suffix._buffers([text])
             for _, p, a, b, _ in zip(*suffix._anchors(buf, s))}
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    starts = set()
    for buf, _, s, off in suffix._buffers([text]):
        part, pos, first, stop, _ = suffix._anchors(buf, s)
        for p, x, a, b in zip(part, pos, first, stop):
            shift = off[p] - s[p]
            starts.update((int(x + shift), w) for w in range(int(a + shift), int(b + shift) + 1))
    assert starts == {(p, w) for p, a, b in whole for w in range(a, b + 1)}


AWKWARD = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|startoftext|> x", "<|ENDOFTEXT|>, no",
           "", " ", "  two  blanks ", "tab\tand\nline \r\n", "Stops... here!? (no); x.", "don't I'll WE'RE", "123 45a a45 ½ ²",
           "ünïcode Äpfel 中文 字 🎉🎉 é", " nbsp em \x85nel", "a  b", "x" * 300, "İstanbul ΣΑΣ ﬁ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys_also_with_added_token_strings(name):
    from tarmac.llm.encode import Encoder
    path = catalog.tokenizer_file(name)
    lib = Tokenizer.from_file(path)
    texts = AWKWARD + [t for _, t, *_ in ROWS] + [" ".join(AWKWARD)]
    got = Encoder(path).encode(texts)
    for t, ids in zip(texts, got):
        assert ids.tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_word_before_any_signs_goes_through_the_library_once(name):
    import random
    import string

    from tarmac.llm.encode import Encoder
    import public_tokenizers
    path = public_tokenizers.path(name)
    lib, rng = Tokenizer.from_file(path), random.Random(3)
    signs = string.punctuation
    texts = ["tower" + a + b + "\n" + a + "tower" + b + c for a in signs for b in signs for c in ("", " ", "\n", "'s")]
    alphabet = signs + "aZ9é\u0301ßΣ²五 \n\r\t\u00a0"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    for text, got in zip(texts, Encoder(path).encode(texts)):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids, text

    encoder, seen = Encoder(path), []

    class Counting:
        def encode_batch_fast(self, part, **kwargs):
            seen.extend(part)
            return lib.encode_batch_fast(part, **kwargs)
    encoder.lib = Counting()
    encoder.encode([" ".join(["a", *[f"towerx{x}" for x in ("***", "&&&", "%%%", "###,", "$$$.", '")')]])])
    assert " ".join(seen).count("towerx") == 1


def test_a_tokenizer_that_merges_over_blanks_sees_whole_texts(monkeypatch, tmp_path):
    from tokenizers import models
    from tarmac.llm import encode
    lib = Tokenizer(models.BPE(vocab={"a": 0, " ": 1, "b": 2, "a ": 3, "a b": 4}, merges=[("a", " "), ("a ", "b")]))
    lib.save(str(tmp_path / "t.json"))
    monkeypatch.setattr(encode, "SEGMENT", 4)
    text = "aaaa b" * 5 + "a"
    assert encode.Encoder(str(tmp_path / "t.json")).encode([text])[0].tolist() == lib.encode(text).ids


def test_the_store_has_bloom_filters_row_indexes_and_prunes(spark):
    """Footers and streams of the ORC files, and what a filtered read leaves out."""
    import glob
    from pyarrow import orc
    path = scratch_dir(spark, "t-orc")
    rows = [(i, f"text number {i} " * 5, None, None, None) for i in range(0, 9000, 3)]
    write_store(frame(spark, rows), path, catalog.tokenizer_file("word_bpe_49k.json"))
    files = sorted(glob.glob(path.replace("file:", "") + "/*.orc"))
    assert len(files) > 1
    last = -1
    for f in files:
        table = orc.ORCFile(f)
        assert table.compression == "ZSTD" and table.row_index_stride == 1000
        ids = table.read(columns=["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and ids[0] > last                  # a file holds a range of its own
        last = ids[-1]
    reader = spark._jvm.org.apache.orc.OrcFile.createReader(
        spark._jvm.org.apache.hadoop.fs.Path(files[0]),
        spark._jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    stripe = reader.getFileTail().getFooter().getStripes(0)
    assert stripe.getIndexLength() > 0 and str(reader.getWriterVersion()) != ""
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0)) if hasattr(reader.rows(), "readStripeFooter") else None
    if footer is not None:
        kinds = {str(s.getKind()) for s in footer.getStreamsList()}
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
        assert all(str(c.getKind()).startswith("DIRECT") for c in footer.getColumnsList())
    plan = read_store(spark, path, F.col("doc_id") == 4500)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4500)]" in plan
    assert read_store(spark, path, F.col("doc_id") == 4500).count() == 1
    assert read_store(spark, path, F.col("doc_id") == 4501).count() == 0      # between two ids of a file


@pytest.mark.parametrize("keep", ["max", "min"])
def test_every_level_is_sorted_distinct_runs_with_the_best_identifier(spark, keep):
    from tarmac.llm.exact import KEY, digests, first_runs, merge_runs
    rng = __import__("random").Random(4)
    rows = [(rng.choice([None, *range(300)]), f"text {rng.choice([1, 1, 1, rng.randint(0, 60)])}", None, None, None)
            for _ in range(900)]
    df = frame(spark, rows).repartition(9).select(F.col("doc_id").alias("_id"), *digests("text"),
                                                  F.monotonically_increasing_id().alias("_row"))
    df = spark.createDataFrame(df.collect(), df.schema).repartition(9, "_row")
    pick = max if keep == "max" else min
    level = first_runs(df, keep)
    for step in range(4):
        if step:
            level = merge_runs(level, 1, 2, 4, keep)
        got = level.withColumn("_p", F.spark_partition_id()).collect()
        runs = defaultdict(list)
        for r in got:
            runs[r["_p"], r["_run"], r["_range"]].append(tuple(r[k] for k in KEY))
        assert all(k == sorted(set(k)) for k in runs.values())
        seen = {(r["_run"], *(r[k] for k in KEY)) for r in got}
        assert len(seen) == len(got) and sum(r["_n"] for r in got) == len(rows)
    assert len({r["_run"] for r in got}) == 2
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[hashlib.sha256(t.encode()).digest()].append(i)
    last = merge_runs(level, 1, 2, 4, keep).collect()
    assert {bytes(r["_sha"]): r["_id"] for r in last} == {
        k: pick((i for i in v if i is not None), default=None) for k, v in ids.items()}
