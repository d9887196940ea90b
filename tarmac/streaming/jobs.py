"""Structured Streaming jobs: T10 complaint tagging and M15 scoring over arriving bookings.

Both read booking files as they land in a directory (file source with a declared
schema), apply exactly the column functions of the batch path (so stream output equals
batch output on the same files), and append to a parquet sink.  The sink and the
checkpoint live in the shared checkpoint folder, so a restarted job resumes from its
last committed micro-batch and never re-emits committed rows (exactly-once file sink).
"""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import checked_lookup, flag
from ..functions.text import has_complaint, rules
from ..operators import complaints, model
from ..operators.clean import clean_app
from ..operators.features import is_cancelled
from ..schema import BOOKING_SCHEMA

TAG_COLUMNS = ["booking_id", "airline", "booking_channel", "booking_status", "customer_complaint",
               "category", "severity", "routing_team", "routing_action", "matched_keywords"]


def booking_stream(spark: SparkSession, source_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Arriving booking files (parquet) as a stream; all new files per micro-batch unless limited."""
    reader = spark.readStream.schema(BOOKING_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(source_dir)


def tag_stream(bookings: DataFrame) -> DataFrame:
    """The batch complaint tagger applied to a stream (stateless, append mode)."""
    df = clean_app(bookings).where(has_complaint(F.col("customer_complaint"), "length"))
    return (complaints.tag(df, rule_set=rules("dashboard"))
            .withColumn("matched_keywords", F.array_join("matched_keywords", ", "))
            .select(*TAG_COLUMNS))


def score_stream(bookings: DataFrame, fitted: PipelineModel, reference_fa: DataFrame) -> DataFrame:
    """M15 streaming: score arriving bookings with a fitted pipeline.

    Dashboard features that are row-local are derived per row; the route mean (W1) is a
    static table, written before the stream starts and joined as a stream-static join, so
    no micro-batch aggregates the reference table again.
    """
    route_means = (reference_fa.where(F.col("route").isNotNull())
                   .groupBy("route").agg(F.avg("total_fare_inr").alias("_route_avg")))
    df = clean_app(bookings).withColumn("route", F.concat("origin", F.lit(" → "), "destination"))
    df = (df.join(checked_lookup(route_means), "route", "left")
          .withColumns({
              "is_cancelled": is_cancelled(),
              "booking_month": F.month("booking_date"),
              "booking_dayofweek": F.weekday("booking_date"),
              "fare_per_passenger": F.try_divide("total_fare_inr", "pax_count"),
              "is_repeat_customer": flag(F.col("prior_bookings") > 0),
              "has_ancillary": flag(F.col("ancillary_revenue_inr") > 0),
              "fare_to_avg_route_fare": F.try_divide("total_fare_inr", "_route_avg"),
              "tax_ratio": F.try_divide("taxes_inr", "total_fare_inr"),
          }))
    scored = model.score(fitted, df, out="probability")
    tier, action = model.risk_tier(F.col("probability") * 100)
    return scored.select("booking_id", "probability", tier.alias("risk_tier"), action.alias("risk_action"))


def run_to_sink(stream: DataFrame, sink_dir: str, checkpoint: str, query_name: str | None = None) -> None:
    """Process everything available now (in micro-batches) into an append parquet sink."""
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True))
    if query_name:
        w = w.queryName(query_name)
    q = w.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_paths(base: str, name: str) -> tuple[str, str]:
    return os.path.join(base, name, "out"), os.path.join(base, name, "checkpoint")
