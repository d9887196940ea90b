"""Named queries for documents, upsert, embeddings and top-k retrieval."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import functions as F

from ..functions.text import rules
from ..operators import clean, embedding, retrieval
from ..operators.cell_search import cell_top_k
from ..operators.vector_store import VectorStore, store_completeness
from ..session import scratch_path
from ..sources.tables import read_table
from .catalog import fa, query, raw


@query("booking_documents")
def q_booking_documents(spark, sf):
    d = retrieval.booking_documents(fa(spark, sf))
    return d.select("doc_id", "doc_type", "text", F.to_json("metadata").alias("metadata_json"))


@query("complaint_documents")
def q_complaint_documents(spark, sf):
    d = retrieval.complaint_documents(fa(spark, sf), metadata_chars=200)
    return d.select("doc_id", "doc_type", "text", F.to_json("metadata").alias("metadata_json"))


def _corrections(spark, sf):
    """A correction batch: booking documents re-rendered from the notebook-cleaned table for
    bookings whose satisfaction was missing."""
    # Flag the rows before cleaning fills the score: one pass, no self-join on the id.
    flagged = raw(spark, sf).withColumn("_sat_missing", F.col("satisfaction_score").isNull())
    return retrieval.booking_documents(clean.clean_notebook(flagged).where(F.col("_sat_missing")))


def _index(spark, sf):
    return retrieval.all_documents(fa(spark, sf), metadata_chars=200)


@query("upsert_documents")
def q_upsert_documents(spark, sf):
    return retrieval.upsert(_index(spark, sf), _corrections(spark, sf)).select("doc_id", "doc_type", "text")


_STORES: dict = {}
_LOCK = threading.Lock()


def store(spark, sf) -> VectorStore:
    """The stored index of all documents with the corrections merged in; made once per
    session and data, as a persistent index is."""
    key = (spark.sparkContext.applicationId, sf)
    with _LOCK:
        if key not in _STORES:
            made = VectorStore(spark, scratch_path(spark, f"index-{uuid.uuid4().hex[:12]}"), buckets=32)
            made.upsert(_index(spark, sf))
            made.upsert(_corrections(spark, sf))
            _STORES[key] = made
        return _STORES[key]


def vector_digest(vector: str):
    """One number per vector: its components weighted by their place."""
    weighted = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 4)


@query("stored_documents")
def q_stored_documents(spark, sf):
    """S4 + R3: what is read back from the store: text and vector of every document."""
    return store(spark, sf).read().select(
        "doc_id", "doc_type", "text", F.size("metadata").alias("n_metadata"), F.size("vector").alias("dim"),
        vector_digest("vector").alias("vector_digest"))


@query("index_completeness")
def q_index_completeness(spark, sf):
    return store_completeness(fa(spark, sf), store(spark, sf))


@query("conversation_search")
def q_conversation_search(spark, sf):
    """R3 + R4: the turns of every conversation divisible by SEARCH_EVERY against all turns,
    as dense vectors, by cells with an exact stop."""
    turns = read_table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        "conv_id", F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    vectors = embedding.embed(turns, embedding.fit_space(turns)).select("conv_id", "doc_id", "vector")
    asked = vectors.where(F.col("conv_id") % SEARCH_EVERY == 0).select(
        F.col("doc_id").alias("query_id"), F.col("vector").alias("query_vector"))
    hits = cell_top_k(vectors.select("doc_id", "vector"), asked, key="doc_id", vector="vector",
                      query_key="query_id", query_vec="query_vector")
    return hits.select("query_id", "rank", "doc_id", F.bround("score", 4).alias("similarity"))


def _embeddings(spark, sf):
    return read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")


@query("cosine_topk")
def q_cosine_topk(spark, sf):
    emb = _embeddings(spark, sf)
    hits = retrieval.top_k_cosine(emb, retrieval.label_exemplar_queries(emb))
    return hits.select("query_label", "query_id", "rank", "vec_id", "label", "similarity")


@query("prompt_context")
def q_prompt_context(spark, sf):
    emb = _embeddings(spark, sf)
    hits = retrieval.top_k_cosine(emb, retrieval.label_exemplar_queries(emb))
    texts = read_table(spark, sf, "documents", "doc_id", "text").withColumnRenamed("doc_id", "vec_id")
    return retrieval.prompt_context(hits, texts)


def _search_queries(emb):
    """The search's query set: every row whose id is divisible by SEARCH_EVERY."""
    return emb.where(F.col("vec_id") % SEARCH_EVERY == 0).select(
        F.col("label").alias("query_label"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


SEARCH_EVERY = 20


def _cell_hits(spark, sf):
    emb = _embeddings(spark, sf)
    asked = _search_queries(emb)
    hits = cell_top_k(emb.select("vec_id", "embedding"), asked)
    return hits.withColumn("similarity", F.bround("score", 4))


@query("cosine_search")
def q_cosine_search(spark, sf):
    labels = _embeddings(spark, sf).select("vec_id", "label")
    asked = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return (_cell_hits(spark, sf).join(labels, "vec_id").join(asked, "query_id")
            .select("query_label", "query_id", "rank", "vec_id", "label", "similarity"))


@query("prompt_context_search")
def q_prompt_context_search(spark, sf):
    texts = read_table(spark, sf, "documents", "doc_id", "text").withColumnRenamed("doc_id", "vec_id")
    return retrieval.prompt_context(_cell_hits(spark, sf), texts)


@query("text_search")
def q_text_search(spark, sf):
    """Every turn of the conversations divisible by SEARCH_EVERY against all turns."""
    turns = read_table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        "conv_id", F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tf, idf, norms = retrieval.tfidf(turns)
    questions = turns.where(F.col("conv_id") % SEARCH_EVERY == 0).select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    n_docs = turns.count()
    qvec = retrieval.embed_queries(questions, idf, n_docs)
    return retrieval.sparse_top_k(tf, norms, qvec, questions=questions).select("query_id", "rank", "doc_id", "score")


QUESTION_CATEGORIES = [c for c, _ in rules("dashboard")]


def _category_hits(spark, sf, stem):
    corpus = retrieval.all_documents(fa(spark, sf)).select("doc_id", "text")
    tf, idf, norms = retrieval.tfidf(corpus, stem=stem)
    questions = spark.createDataFrame(list(enumerate(QUESTION_CATEGORIES)), "query_id int, question string")
    n_docs = idf.select("_m").first()[0]
    qvec = retrieval.embed_queries(questions, idf, n_docs, stem=stem)
    return retrieval.sparse_top_k(tf, norms, qvec, questions=questions).select("query_id", "rank", "doc_id", "score")


@query("text_embed_topk")
def q_text_embed_topk(spark, sf):
    return _category_hits(spark, sf, retrieval.suffix_stem)


@query("text_embed_topk_stems")
def q_text_embed_topk_stems(spark, sf):
    return _category_hits(spark, sf, retrieval.suffix_stem)


@query("metrics_facts")
def q_metrics_facts(spark, sf):
    from ..operators import complaints, report
    f = fa(spark, sf)
    return report.fact_lines(f, complaints.complaints_app(f))


@query("metrics_text")
def q_metrics_text(spark, sf):
    from ..operators import report
    return report.context_text(q_metrics_facts(spark, sf))


@query("metrics_facts_stored")
def q_metrics_facts_stored(spark, sf):
    """R6 from the stored day states: no scan of the bookings after the states are written."""
    from ..operators import complaints, report
    from ..operators.states import DayStates
    f = fa(spark, sf)
    states = DayStates(spark, scratch_path(spark, f"day-states-{uuid.uuid4().hex[:12]}"), period="yyyy")
    states.add(f, complaints.complaints_app(f))
    return report.lines_of(states.dimension_metrics(), states.complaint_metrics(), states.median_fare())


@query("column_sketches")
def q_column_sketches(spark, sf):
    """Q6 by mergeable states of fixed size."""
    from ..operators.states import column_sketches
    from ..schema import PROFILED_CATEGORICALS
    return column_sketches(raw(spark, sf), PROFILED_CATEGORICALS)


@query("value_counts_with_null")
def q_value_counts_with_null(spark, sf):
    """Q8: payment methods with the missing ones counted."""
    from ..operators.metrics import value_counts
    return value_counts(raw(spark, sf), "payment_method", dropna=False)
