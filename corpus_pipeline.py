"""The training-data pipeline: documents in, packed token sequences out.

Each stage calls one operator of ``tarmac.llm`` on all rows its predecessor kept.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.catalog import ratings, tokenizer_file
from tarmac.llm.exact import drop_exact_copies
from tarmac.llm.mixing import emit_mix
from tarmac.llm.packing import pack
from tarmac.llm.quality import keep_good
from tarmac.llm.simhash import drop_near_copies
from tarmac.llm.util import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose tail probability of the best grade is below one half go."""
    return keep_good(docs, ratings(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts the document with the largest doc_id stays."""
    return drop_exact_copies(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each component of near copies the smallest doc_id stays."""
    return drop_near_copies(docs, shingle=3, radius=3)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every document as often as its source's target weight asks for."""
    return emit_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one row per piece of a sequence of at most 1,024 tokens."""
    pieces = pack(docs, tokenizer_file("byte_bpe_50k.json"), capacity=1024, end_id=0, digest=True)
    return pieces.select("doc_id", "start", F.col("n").alias("length"), F.col("crc").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("kk_packing", packing),
]

#: The classifier, the fingerprints' links and the tokenizer are beyond SQL; tests/llm holds
#: the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
