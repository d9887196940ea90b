"""Named streaming queries: run to completion (availableNow) and read the sink back."""

from __future__ import annotations

import uuid

from ..session import scratch_path
from ..sources.bookings import materialized_bookings_path
from ..streaming import jobs
from .catalog import fa, query


def _run(spark, stream, name):
    out, ckpt = jobs.stream_paths(scratch_path(spark, "streams"), f"{name}-{uuid.uuid4().hex[:8]}")
    jobs.run_to_sink(stream, out, ckpt)
    return spark.read.parquet(out)


@query("stream_classify")
def q_stream_classify(spark, sf):
    src = jobs.booking_stream(spark, materialized_bookings_path(spark, sf))
    return _run(spark, jobs.tag_stream(src), "classify")


@query("stream_score")
def q_stream_score(spark, sf):
    from .catalog_model import fitted
    lr, _ = fitted(spark, sf, "lr")
    src = jobs.booking_stream(spark, materialized_bookings_path(spark, sf))
    return _run(spark, jobs.score_stream(src, lr, fa(spark, sf)), "score")
