"""The live recorder as streams: envelopes to reports, days of reports, counts, silences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from pelorus.sources.archive import envelopes

LATE = "7 days"


def reports(lines: DataFrame) -> DataFrame:
    """A stream of reports from a stream of envelope lines (value, received_at), each delivery once within LATE."""
    rows = envelopes(lines, F.col("received_at"))
    key = ["user_id", "time_utc", "lat", "lon", "speed_knots", "course_deg"]
    return rows.withWatermark("time_utc", LATE).dropDuplicatesWithinWatermark(key)


def to_days(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Reports appended by UTC day of observation, exactly once; runs until what there is is read."""
    dated = rows.withColumn("date", F.to_date("time_utc"))
    return (
        dated.writeStream.format("parquet").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def counts(rows: DataFrame, every: str = "1 hour", late: str = LATE) -> DataFrame:
    """Reports and vessels (about) by window of observation, closed as the watermark passes."""
    w = F.window("time_utc", every)
    counted = rows.withWatermark("time_utc", late).groupBy(w.alias("w")).agg(F.count("*").alias("reports"), F.approx_count_distinct("user_id").alias("vessels"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "reports", "vessels")


_GAP = "session string, from_us bigint, to_us bigint, seconds double"


def silences(beats: DataFrame, longest_s: float, late: str = "1 hour") -> DataFrame:
    """Silences of more than longest_s between rows (session, at) of a session, in order of time.

    Rows are held until the watermark passes them, so that late ones still close a silence.
    """
    longest_us = int(longest_s * 1e6)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, [])
        held = list(held)
        for f in frames:
            held.extend(int(x) for x in f["us"])
        mark = state.getCurrentWatermarkMs() * 1000
        out = []
        for t in sorted(x for x in held if x <= mark):
            if last is not None and t - last > longest_us:
                out.append((key[0], last, t, (t - last) / 1e6))
            last = t if last is None else max(last, t)
        held = [x for x in held if x > mark]
        state.update((last, held))
        if held:
            state.setTimeoutTimestamp(max(min(held) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "from_us", "to_us", "seconds"])

    timed = beats.where("at is not null and session is not null").withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    return timed.groupBy("session").applyInPandasWithState(
        step, StructType.fromDDL(_GAP), StructType.fromDDL("last bigint, held array<bigint>"), "append", GroupStateTimeout.EventTimeTimeout
    )
