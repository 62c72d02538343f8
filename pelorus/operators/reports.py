"""Position reports as an archive: cleaned, counted, and read for silence and reception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.functions.cleaning import course_deg, finite, grid_key, speed_knots, vessel_id


def clean(reports: DataFrame) -> DataFrame:
    """Reports with vessel, place and time; unknown speed and course are null. No shuffle."""
    lat, lon = finite(F.col("latitude")), finite(F.col("longitude"))
    out = reports.select(
        "report_id", vessel_id(F.col("user_id")).alias("user_id"), lat.alias("lat"), lon.alias("lon"), "time_utc", "received_at",
        speed_knots(F.col("sog")).alias("speed_knots"), course_deg(F.col("cog")).alias("course_deg"), "message_type", "timestamp_basis",
    )
    return out.where(F.col("user_id").isNotNull() & F.col("time_utc").isNotNull() & lat.between(-90, 90) & lon.between(-180, 180))


def distinct_reports(cleaned: DataFrame) -> DataFrame:
    """Each report once, however often it was delivered: the one with the smallest id, and how often (n_delivered)."""
    key = ["user_id", "time_utc", "lat", "lon", "speed_knots", "course_deg"]
    rest = [c for c in cleaned.columns if c not in key]
    kept = cleaned.groupBy(*key).agg(F.min(F.struct("report_id", *[c for c in rest if c != "report_id"])).alias("_r"), F.count("*").alias("n_delivered"))
    return kept.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest], "n_delivered").select(*cleaned.columns, "n_delivered")


def archive_counts(reports: DataFrame) -> DataFrame:
    """One row: reports in, valid, duplicate, with their first and last instant and days."""
    cleaned = clean(reports)
    once = distinct_reports(cleaned).agg(
        F.count("*").alias("kept"), F.min("time_utc").alias("first_utc"), F.max("time_utc").alias("last_utc"), F.countDistinct(F.to_date("time_utc")).alias("days")
    )
    counts = reports.agg(F.count("*").alias("input")).join(cleaned.agg(F.count("*").alias("valid")))
    return counts.join(once).select(
        "input", (F.col("input") - F.col("valid")).alias("invalid"), (F.col("valid") - F.col("kept")).alias("duplicates"), "kept", "first_utc", "last_utc", "days"
    )


def in_window(cleaned: DataFrame, instant: Column, half_s: float, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Reports within half_s seconds of an instant and in a box (west, south, east, north), bounds included."""
    near = F.abs(F.unix_micros("time_utc") - F.unix_micros(instant)) <= int(half_s * 1_000_000)
    if box:
        near &= F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])
    return cleaned.where(near)


def conflicting(cleaned: DataFrame) -> DataFrame:
    """Vessels and instants that hold more than one position."""
    places = F.countDistinct("lat", "lon")
    return cleaned.groupBy("user_id", "time_utc").agg(places.alias("positions")).where("positions > 1")


def silences(cleaned: DataFrame, key: str, instant: str, longest_s: float) -> DataFrame:
    """Silences of more than longest_s between consecutive rows of a key: key, from_utc, to_utc, seconds.

    Days are taken apart and joined again over their first and last rows, so one key is no one task.
    """
    day = F.to_date(instant)
    rows = cleaned.select(key, F.col(instant).alias("t")).withColumn("day", F.to_date("t")).distinct()
    w = Window.partitionBy(key, "day").orderBy("t")
    inside = rows.withColumn("from_utc", F.lag("t").over(w)).where("from_utc is not null").select(key, "from_utc", F.col("t").alias("to_utc"))
    days = rows.groupBy(key, "day").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    wd = Window.partitionBy(key).orderBy("day")
    across = days.withColumn("from_utc", F.lag("last").over(wd)).where("from_utc is not null").select(key, "from_utc", F.col("first").alias("to_utc"))
    seconds = (F.unix_micros("to_utc") - F.unix_micros("from_utc")) / 1e6
    del day
    return inside.unionByName(across).withColumn("seconds", seconds).where(F.col("seconds") > longest_s)


def reception(cleaned: DataFrame) -> DataFrame:
    """By day: reports, vessels, hours heard, first and last instant, and the longest silence, edges included."""
    rows = cleaned.withColumn("day", F.to_date("time_utc"))
    stats = rows.groupBy("day").agg(
        F.count("*").alias("reports"), F.countDistinct("user_id").alias("vessels"), F.countDistinct(F.hour("time_utc")).alias("hours"),
        F.min("time_utc").alias("first_utc"), F.max("time_utc").alias("last_utc"),
    )
    stamps = rows.select("day", F.hour("time_utc").alias("hour"), "time_utc").distinct()
    w = Window.partitionBy("day", "hour").orderBy("time_utc")
    gap = (F.unix_micros("time_utc") - F.unix_micros(F.lag("time_utc").over(w))) / 1e6
    hours = stamps.withColumn("gap", gap).groupBy("day", "hour").agg(F.max("gap").alias("gap"), F.min("time_utc").alias("a"), F.max("time_utc").alias("b"))
    wh = Window.partitionBy("day").orderBy("hour")
    start = F.unix_micros(F.col("day").cast("timestamp"))
    lead_in = (F.unix_micros("a") - F.coalesce(F.unix_micros(F.lag("b").over(wh)), start)) / 1e6
    tail = (start + F.lit(86_400_000_000) - F.unix_micros("b")) / 1e6
    last = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("hour"))) == 1
    longest = hours.withColumn("x", F.greatest("gap", lead_in, F.when(last, tail))).groupBy("day").agg(F.max("x").alias("longest_silence_s"))
    return stats.join(longest, "day")


def reception_map(cleaned: DataFrame, step: float) -> DataFrame:
    """By grid cell: reports, vessels, days, fastest, and the latest instant."""
    cell = cleaned.withColumn("cell", grid_key(F.col("lon"), F.col("lat"), step))
    return cell.groupBy(F.col("cell.x").alias("cell_x"), F.col("cell.y").alias("cell_y")).agg(
        F.count("*").alias("reports"), F.countDistinct("user_id").alias("vessels"), F.countDistinct(F.to_date("time_utc")).alias("days"),
        F.max("speed_knots").alias("fastest_knots"), F.max("time_utc").alias("latest_utc"),
    )


def latency(reports: DataFrame) -> DataFrame:
    """By message type: seconds from report to receipt, median and 95th percentile exactly."""
    s = (F.unix_micros("received_at") - F.unix_micros("time_utc")) / 1e6
    p = F.percentile("s", F.array(F.lit(0.5), F.lit(0.95)))
    out = reports.withColumn("s", s).groupBy("message_type").agg(
        F.count("s").alias("n"), F.count_if(F.col("s") < 0).alias("negative"), p.alias("p"), F.max("s").alias("longest_s")
    )
    return out.select("message_type", "n", "negative", F.col("p")[0].alias("median_s"), F.col("p")[1].alias("p95_s"), "longest_s")


def merged_intervals(intervals: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Intervals of a key merged where they overlap or touch: key, a, b, pieces."""
    w = Window.partitionBy(key).orderBy(a, b)
    reached = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
    valid = intervals.where(F.col(b) >= F.col(a))
    marked = valid.withColumn("_new", F.when(F.col(a) <= reached, 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min(a).alias(a), F.max(b).alias(b), F.count("*").alias("pieces")).drop("_island")


def coverage(intervals: DataFrame, key: str, a: str, b: str, start: Column, stop: Column) -> DataFrame:
    """Seconds of [start, stop] covered by the union of a key's intervals, and the share; a, b in seconds."""
    clipped = intervals.withColumn(a, F.greatest(F.col(a), start)).withColumn(b, F.least(F.col(b), stop)).where(F.col(b) > F.col(a))
    covered = merged_intervals(clipped, key, a, b).groupBy(key).agg(F.sum(F.col(b) - F.col(a)).alias("covered_s"))
    return covered.withColumn("share", F.try_divide("covered_s", stop - start))


def beat_intervals(events: DataFrame, key: str, t: str, beat: Column, broken: Column, longest_s: float) -> DataFrame:
    """Stretches between consecutive beats of a key with no break between and at most longest_s long."""
    w = Window.partitionBy(key).orderBy(t)
    breaks = F.sum(F.when(broken, 1).otherwise(0)).over(w.rangeBetween(Window.unboundedPreceding, 0))
    beats = events.withColumn("_breaks", breaks).where(beat)
    nxt = F.lead(F.struct(F.col(t).alias("t"), F.col("_breaks").alias("n"))).over(Window.partitionBy(key).orderBy(t))
    pairs = beats.withColumn("_next", nxt).where(F.col("_next").isNotNull() & (F.col("_next.n") == F.col("_breaks")))
    span = F.col("_next.t") - F.col(t)
    return pairs.where((span > 0) & (span <= longest_s)).select(key, F.col(t).alias("a"), F.col("_next.t").alias("b"))


def filled_forward(events: DataFrame, key: str, t: str, value: Column, name: str, epoch: Column | None = None) -> DataFrame:
    """events with the last known value at each, within an epoch that starts anew at each true of `epoch`."""
    keys = [key]
    if epoch is not None:
        w = Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
        events = events.withColumn("_epoch", F.sum(F.when(epoch, 1).otherwise(0)).over(w))
        keys.append("_epoch")
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(name, F.last(value, ignorenulls=True).over(w)).drop("_epoch")


def health(status: DataFrame, now: Column) -> DataFrame:
    """status with `state` of a recorder: what is stale comes first. Columns: heartbeat_at, connected, observed_at, received_at."""

    def age(c: str) -> Column:
        return (F.unix_micros(now) - F.unix_micros(c)) / 1e6

    def stale(c: str, most: float) -> Column:
        return F.coalesce((age(c) < -60) | (age(c) > most), F.lit(True))

    state = (
        F.when(stale("heartbeat_at", 180), "heartbeat_stale").when(~F.coalesce(F.col("connected"), F.lit(False)), "disconnected")
        .when(stale("observed_at", 600) | stale("received_at", 600), "observations_stale").otherwise("fresh")
    )
    return status.withColumn("state", state)
