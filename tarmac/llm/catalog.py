"""Queries ``opN_<name>`` of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .divergence import audit
from .exact import exact_groups
from .embed_dedup import embedding_groups
from .mixing import DRAWS, mix
from .packing import pack
from .quality import grade_documents
from .quality_rules import BASE_GRAM, COVER_LIMITS, LINE_LIMIT, repetition
from .resample import resample
from .sharding import shard
from .simhash import simhash_groups
from .suffix import drop_repeats
from .token_store import store_index, write_store
from .util import scratch_dir, table
from .warc import archive_pages


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-store")
    write_store(table(spark, sf_dir, "documents", "doc_id", "text"), path,
                tokenizer_file("word_bpe_49k.json"), end_id=1)
    return store_index(spark, path)


def op2_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents", "doc_id", "text"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op3_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents", "doc_id", "text"),
                  tokenizer_file("byte_bpe_50k.json"), capacity=1024, end_id=0, digest=True)
    return pieces.select("doc_id", "start", F.col("n").alias("length"),
                                    F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=3, radius=3)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return archive_pages(pages, min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), threshold=0.98)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the rated documents: 0 toxic, 1 poor, 2 good."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"), keep="max")


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(table(spark, sf_dir, "documents", "doc_id", "text"), ratings(spark, sf_dir))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents", "lang", "source", "text"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "dup_line_chars", *[f"chars_{n}" for n in COVER_LIMITS])


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_balanced_shards": op2_balanced_shards,
    "op3_kk_packing": op3_kk_packing,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_source_mix": op7_source_mix,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ordinal_quality": op10_ordinal_quality,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_source_divergence": op12_source_divergence,
    "op13_quality_rules": op13_quality_rules,
}

_DRAW = ", ".join(
    f"('0x' || substr(sha256('{s}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), {1 + 8 * i}, 8))"
    "::BIGINT / 4294967296.0" for s in range(DRAWS // 8) for i in range(8))

_LENGTHS = sorted({BASE_GRAM, *COVER_LIMITS})
_LEADS = ", ".join(f"lead(word, {j}) OVER o AS w{j}" for j in range(1, max(_LENGTHS)))
_GRAMS = " UNION ALL ".join(
    f"SELECT r, {n} AS n, i, concat_ws(' ', word, {', '.join(f'w{j}' for j in range(1, n))}) AS gram "
    f"FROM a WHERE w{n - 1} IS NOT NULL" for n in _LENGTHS)
_COVER = ", ".join(f"max(CASE WHEN n = {n} THEN c ELSE 0 END) AS chars_{n}" for n in COVER_LIMITS)
_OVER = " OR ".join(f"100 * chars_{n} > {limit} * word_chars" for n, limit in COVER_LIMITS.items())
_CHARS = ", ".join(f"coalesce(chars_{n}, 0)::BIGINT AS chars_{n}" for n in COVER_LIMITS)

ORACLE = {
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS ln FROM c GROUP BY ALL HAVING sum(docs) >= 10),
l AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM k GROUP BY lang),
e AS (SELECT c.* FROM c JOIN k USING (lang, term)),
g AS (SELECT x.lang, x.source, coalesce(y.total, 0)::HUGEINT AS total
      FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n) AS total FROM e GROUP BY ALL) y
        USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(e.n, 0) AS n, k.ln, l.lt, l.v,
        1 + (1000000000::HUGEINT * (coalesce(e.n, 0) + 2)) // (g.total + 2 * l.v) AS p
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN e USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
q AS (SELECT *, 1 + (1000000000::HUGEINT * (ln + 2)) // (lt + 2 * v) AS q FROM p WHERE n > 0),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM q WHERE p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, k::INT AS rank FROM ranked
WHERE part = 'pair' OR k <= 10""",
    "op13_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
s AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
a AS (SELECT r, i, word, {_LEADS} FROM s WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS ({_GRAMS}),
u AS (SELECT r, n, unnest(places) AS i FROM (SELECT r, n, gram, list(i) AS places FROM g GROUP BY ALL
      HAVING count(*) > 1)),
v AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS i FROM u),
x AS (SELECT r, n, count(*) AS words, sum(length(word)) AS c FROM v JOIN s USING (r, i) GROUP BY ALL),
y AS (SELECT r, max(CASE WHEN n = {BASE_GRAM} THEN words ELSE 0 END) AS repeats, {_COVER} FROM x GROUP BY r),
lines AS (SELECT r, line, count(*) - 1 AS again FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
z AS (SELECT r, sum(again) AS dup, sum(again * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS c
      FROM lines GROUP BY r),
b AS (SELECT r, doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols FROM d JOIN w USING (r)),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(z.dup, 0)::BIGINT AS n_dup_lines,
        coalesce(repeats, 0)::BIGINT AS n_repeat_words, coalesce(z.c, 0)::BIGINT AS dup_line_chars, {_CHARS}
      FROM b LEFT JOIN y USING (r) LEFT JOIN z USING (r)),
o AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT (base_failed OR {_OVER} OR 100 * dup_line_chars > {LINE_LIMIT} * word_chars) AS kept FROM o""",
    "op6_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)""",
    "op5_warc_revisits": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html) AS payload_bytes, upper(sha1(html)) AS h,
        max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5))::BIGINT
      >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS INT), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d""",
    "op7_source_mix": f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text,
        '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, [{_DRAW}] AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
      FROM d GROUP BY source),
c AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER up, 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER up, 0)) AS level FROM c
      WINDOW up AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END)
        OVER () * w, cap)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
j AS (SELECT d.*, r.source_size, r.target, r.rate FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
g AS (SELECT source, i, abs(sum(CASE WHEN u[i] < rate - floor(rate) THEN size ELSE 0 END)
        + floor(any_value(rate)) * any_value(source_size) - any_value(target)) AS gap
      FROM j, range(1, {DRAWS + 1}) AS q(i) GROUP BY source, i),
b AS (SELECT source, i FROM (SELECT source, i, row_number() OVER (PARTITION BY source ORDER BY gap, i) AS k
      FROM g) WHERE k = 1)
SELECT doc_id, size, j.source_size, target, CAST(size * (CAST(floor(rate) AS BIGINT)
    + CASE WHEN u[b.i] < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM j JOIN b ON j.source IS NOT DISTINCT FROM b.source""",
    "op9_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)""",
}
