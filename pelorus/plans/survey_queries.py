"""Queries of the survey's operators over the test tables; each whole, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.functions import cleaning, geodesy, radar
from pelorus.functions.geo import wrap_lon
from pelorus.operators import alignment, association, catalogue, detection, proximity, regions, reports, statistics
from pelorus.session import shared_path

#: (query, SQL) by name; filled by the decorator.
ALL: dict[str, tuple] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table == "events":  # written without a zone; instants are UTC
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


def query(sql: str | None, *tables: str):
    """Registers a function of DataFrames as a query over those tables."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[read(spark, sf_dir, t) for t in tables])

        ALL[f.__name__] = (run, sql)
        return f

    return register


def queries() -> dict:
    return {name: run for name, (run, _) in ALL.items()}


def sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ALL.items() if text}


_CLEAN = """
    select report_id, user_id, latitude as lat, longitude as lon, time_utc, received_at,
        case when sog >= 0 and sog < 102.2 then sog end as speed_knots, case when cog >= 0 and cog < 360 then cog end as course_deg,
        message_type, timestamp_basis
    from position_reports where user_id between 100000000 and 999999999 and time_utc is not null
        and latitude between -90 and 90 and longitude between -180 and 180
"""


# ---- scans and cleaning ----


@query(f"select report_id, user_id, lat, lon, speed_knots, course_deg, message_type from ({_CLEAN})", "position_reports")
def ais_clean(r):
    return reports.clean(r).select("report_id", "user_id", "lat", "lon", "speed_knots", "course_deg", "message_type")


@query(
    f"select min(report_id) as report_id, user_id, count(*) as n from ({_CLEAN}) group by user_id, time_utc, lat, lon, speed_knots, course_deg",
    "position_reports",
)
def ais_distinct(r):
    return reports.distinct_reports(reports.clean(r)).select("report_id", "user_id", F.col("n_delivered").alias("n"))


@query(
    f"""with c as ({_CLEAN}), d as (select distinct user_id, time_utc, lat, lon, speed_knots, course_deg from c)
    select (select count(*) from position_reports) as input, (select count(*) from position_reports) - (select count(*) from c) as invalid,
        (select count(*) from c) - count(*) as duplicates, count(*) as kept, count(distinct cast(time_utc as date)) as days from d""",
    "position_reports",
)
def ais_counts(r):
    return reports.archive_counts(r).drop("first_utc", "last_utc")


@query(
    f"select report_id, user_id from ({_CLEAN}) where abs(epoch_us(time_utc) - epoch_us(timestamptz '2017-01-10 12:00:00+00')) <= 43200000000 and lon between -51.5 and -50.5 and lat between 47 and 48",
    "position_reports",
)
def ais_window(r):
    noon = F.lit("2017-01-10T12:00:00Z").cast("timestamp")
    return reports.in_window(reports.clean(r), noon, 43_200, (-51.5, 47.0, -50.5, 48.0)).select("report_id", "user_id")


@query(
    f"""select user_id, t_us, count(distinct (lat, lon)) as positions from (select user_id, lat, lon, epoch_us(date_trunc('minute', time_utc)) as t_us from ({_CLEAN})) group by user_id, t_us having count(distinct (lat, lon)) > 1""",
    "position_reports",
)
def ais_conflicts(r):
    """Vessels in several places within one minute: to the microsecond the tables hold none."""
    minute = reports.clean(r).withColumn("time_utc", F.date_trunc("minute", "time_utc"))
    return reports.conflicting(minute).select("user_id", F.unix_micros("time_utc").alias("t_us"), "positions")


@query(
    f"""with t as (select distinct user_id, epoch_us(time_utc) as t from ({_CLEAN})),
    g as (select user_id, lag(t) over (partition by user_id order by t) as a, t as b from t)
    select user_id, a as from_us, b as to_us from g where b - a > 3600000000""",
    "position_reports",
)
def ais_silences(r):
    out = reports.silences(reports.clean(r), "user_id", "time_utc", 3600)
    return out.select("user_id", F.unix_micros("from_utc").alias("from_us"), F.unix_micros("to_utc").alias("to_us"))


@query(
    f"""with c as (select *, cast(time_utc as date) as day from ({_CLEAN})), s as (select distinct day, epoch_us(time_utc) as t from c
        union select day, epoch_us(cast(day as timestamptz)) from c union select day, epoch_us(cast(day as timestamptz)) + 86400000000 from c),
    g as (select day, max(d) as gap from (select day, t - lag(t) over (partition by day order by t) as d from s) group by day)
    select cast(c.day as varchar) as day, count(*) as reports, count(distinct user_id) as vessels, count(distinct hour(time_utc)) as hours, round(max(g.gap) / 1e6, 3) as longest_silence_s
    from c join g using (day) group by c.day""",
    "position_reports",
)
def reception_daily(r):
    out = reports.reception(reports.clean(r))
    return out.select(F.col("day").cast("string").alias("day"), "reports", "vessels", "hours", F.round("longest_silence_s", 3).alias("longest_silence_s"))


@query(
    f"""select cast(floor(lon / 0.1) as bigint) as cell_x, cast(floor(lat / 0.1) as bigint) as cell_y, count(*) as reports, count(distinct user_id) as vessels,
        count(distinct cast(time_utc as date)) as days, max(speed_knots) as fastest_knots from ({_CLEAN}) group by 1, 2""",
    "position_reports",
)
def reception_cells(r):
    return reports.reception_map(reports.clean(r), 0.1).drop("latest_utc")


@query(
    """select message_type, count(s) as n, count(*) filter (s < 0) as negative, round(quantile_cont(s, 0.5), 4) as median_s, round(quantile_cont(s, 0.95), 4) as p95_s
    from (select message_type, (epoch_us(received_at) - epoch_us(time_utc)) / 1e6 as s from position_reports) group by message_type""",
    "position_reports",
)
def reception_latency(r):
    out = reports.latency(r).drop("longest_s")
    return out.withColumn("median_s", F.round("median_s", 4)).withColumn("p95_s", F.round("p95_s", 4))


@query(
    f"""select user_id, count(*) as reports, max(time_utc) >= timestamptz '2017-01-20 00:00:00+00' as lately, max(speed_knots) as fastest
    from ({_CLEAN}) where speed_knots >= 1 group by user_id""",
    "position_reports",
)
def moving_vessels(r):
    moving = reports.clean(r).where("speed_knots >= 1").groupBy("user_id")
    late = F.max("time_utc") >= F.lit("2017-01-20T00:00:00Z").cast("timestamp")
    return moving.agg(F.count("*").alias("reports"), late.alias("lately"), F.max("speed_knots").alias("fastest"))


# ---- scenes and reports ----

#: Microseconds of an instant in any spelling of the manifest: a bare number is seconds, one without offset is UTC.
_AT_US = """
    case when regexp_full_match(trim(reference_midpoint_utc), '[+-]?\\d+(\\.\\d+)?') then cast(round(try_cast(trim(reference_midpoint_utc) as decimal(38, 9)) * 1000000) as bigint)
        when regexp_matches(trim(reference_midpoint_utc), '^\\d{4}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d') then epoch_us(try_cast(regexp_replace(regexp_replace(
            case when regexp_matches(trim(reference_midpoint_utc), '(Z|[+-]\\d\\d:?\\d\\d( UTC)?)$') then trim(reference_midpoint_utc) else trim(reference_midpoint_utc) || 'Z' end,
            ' UTC$', ''), ' ([+-]\\d\\d)(\\d\\d)$', '\\1:\\2') as timestamptz)) end
"""
_SCENES = f"select scene_id, at_us from (select area_id as scene_id, {_AT_US} as at_us from manifest) where at_us is not null"
_PAIRS = f"""
    select scene_id, report_id, user_id, lat, lon, speed_knots, course_deg, epoch_us(time_utc) as t, (epoch_us(time_utc) - at_us) / 1e6 as dt
    from ({_SCENES}) join ({_CLEAN}) on epoch_us(time_utc) between at_us - 300000000 and at_us + 300000000
"""


def scenes(manifest: DataFrame) -> DataFrame:
    """Each area whose midpoint denotes an instant, in any spelling of the table."""
    at = cleaning.instant_us(F.col("reference_midpoint_utc"))
    return manifest.select(F.col("area_id").alias("scene_id"), at.alias("at_us")).where("at_us is not null")


@query(
    f"""select scene_id, count(*) as reports, count(distinct user_id) as vessels, min(abs(dt)) as nearest_s,
        case when min(abs(dt)) <= 120 then 'temporal_candidate' else 'sparse_support_only' end as status from ({_PAIRS}) group by scene_id""",
    "manifest", "position_reports",
)
def scene_support(m, r):
    counts = alignment.support_counts(scenes(m), reports.clean(r), 300.0)
    return counts.withColumn("status", F.when(F.col("nearest_s") <= 120, "temporal_candidate").otherwise("sparse_support_only"))


_ALIGN = f"""
    with p as ({_PAIRS}), torn as (select distinct scene_id, user_id from (select scene_id, user_id, t from p group by 1, 2, 3 having count(distinct (lat, lon)) > 1)),
    one as (select * from (select *, row_number() over (partition by scene_id, user_id, t order by report_id) as n from p) where n = 1
        and (scene_id, user_id) not in (select (scene_id, user_id) from torn)),
    k as (select scene_id, user_id, count(*) as reports, max_by(lat, t) filter (dt <= 0) as la, max_by(lon, t) filter (dt <= 0) as lo, max(dt) filter (dt <= 0) as ld,
        min_by(lat, t) filter (dt >= 0) as ra, min_by(lon, t) filter (dt >= 0) as ro, min(dt) filter (dt >= 0) as rd,
        min_by({{'sp': speed_knots, 'co': course_deg}}, (abs(dt), t)) as m, min(abs(dt)) as near from one group by 1, 2),
    d as (select *, m.sp as sp, m.co as co, radians((la + ra) / 2) as mid from k),
    e as (select *, 1 - 0.0066943799901413165 * sin(mid) * sin(mid) as w from d),
    f as (select *, case when ld < 0 and rd > 0 then sqrt(pow(radians(ra - la) * 6378137.0 * (1 - 0.0066943799901413165) / (w * sqrt(w)), 2)
        + pow(radians(ro - lo) * 6378137.0 / sqrt(w) * cos(mid), 2)) / (rd - ld) end as v from e)
    select * from (select scene_id, user_id, reports, case when near = 0 or v is null then near else greatest(-ld, rd) end as report_age_s,
        case when near = 0 then 'observed' when v is not null then case when v <= 60 * 1852.0 / 3600 then 'interpolated' end
            when near <= 120 and sp <= 60 and co is not null then 'velocity_propagated' when near <= 60 then 'nearest' end as method from f)
    where method is not null
"""


@query(_ALIGN, "manifest", "position_reports")
def scene_alignment(m, r):
    out = alignment.aligned(scenes(m), reports.clean(r))
    return out.select("scene_id", "user_id", "reports", "report_age_s", "method")


#: A vessel may be this far from a target besides its own uncertainty, which is at most that of AGE_S.
_GATE_M = 500.0
_FARTHEST_M = _GATE_M + alignment.BASE_M + alignment.DRIFT_M_S * alignment.AGE_S


def _near_targets(m: DataFrame, r: DataFrame, a: DataFrame, radius_m: float, *carried: Column) -> DataFrame:
    """Pairs of a target and a vessel aligned to a scene, within radius_m, by grid cells: l_id (target_id, lat, lon), r_id, distance_m.

    Targets repeated by cell are more than their file's size says, so they are not broadcast. Cells are not counted for
    salts, as the tracks would be worked out twice or stored for that; the join splits a partition that grows too large.
    """
    tracks = alignment.aligned(scenes(m), reports.clean(r))
    lat, lon = F.get("coordinates", F.lit(1)).cast("double"), F.get("coordinates", F.lit(0)).cast("double")
    targets = proximity.points(a, F.struct(F.col("annotation_id").alias("target_id"), lat.alias("lat"), wrap_lon(lon).alias("lon")), lat, lon, "l")
    placed = proximity.points(tracks, F.struct("scene_id", "user_id", *carried), F.col("lat"), F.col("lon"), "r")
    return proximity.within_distance(targets.hint("merge"), placed, radius_m, total=0)


def _gated(m: DataFrame, r: DataFrame, a: DataFrame) -> DataFrame:
    """Every target within the gate of a vessel aligned to a scene."""
    near = _near_targets(m, r, a, _FARTHEST_M, F.col("uncertainty_m")).where(F.col("distance_m") <= F.col("r_id.uncertainty_m") + _GATE_M)
    return near.select("r_id.scene_id", "l_id.target_id", "r_id.user_id", "distance_m")


@query(None, "manifest", "position_reports", "annotations")
def scene_candidates(m, r, a):
    return alignment.flagged(_gated(m, r, a)).select("scene_id", "target_id", "user_id", F.round("distance_m", 1).alias("distance_m"), "ambiguous")


@query(None, "manifest", "position_reports", "annotations")
def scene_assignment(m, r, a):
    return alignment.one_to_one(_gated(m, r, a), ["scene_id"], "target_id", "user_id", "distance_m", flags=True)


@query(None, "manifest", "position_reports")
def scene_covariance(m, r):
    w = alignment.aligned(scenes(m), reports.clean(r), written=True)
    return w.select("scene_id", "user_id", alignment.covariance(F.col("speed_m_s"), F.col("course_deg"), F.col("report_age_s")).alias("c")).select("scene_id", "user_id", "c.*")


@query(
    f"""with c as (select report_id, speed_knots is not null and course_deg is not null as known, coalesce(speed_knots, 0) * 1852.0 / 3600 * 60 as s, radians(coalesce(course_deg, 0)) as r from ({_CLEAN})),
    v as (select report_id, r, case when known then pow(s * 0.15, 2) else pow(60 * 60 * 1852.0 / 3600, 2) end + 10000 as a, case when known then pow(s * 0.05, 2) else pow(60 * 60 * 1852.0 / 3600, 2) end + 10000 as b from c)
    select report_id, round(a * sin(r) * sin(r) + b * cos(r) * cos(r), 3) as ee, round((a - b) * sin(r) * cos(r), 3) + 0.0 as en, round(a * cos(r) * cos(r) + b * sin(r) * sin(r), 3) as nn from v""",
    "position_reports",
)
def report_covariance(r):
    """The covariance of each report's position a minute on."""
    c = reports.clean(r).select("report_id", alignment.covariance(F.col("speed_knots") * 1852.0 / 3600, F.col("course_deg"), F.lit(60.0)).alias("c"))
    return c.select("report_id", *[(F.round(f"c.{k}", 3) + 0.0).alias(k) for k in ("ee", "en", "nn")])


def _targets(a: DataFrame) -> DataFrame:
    return a.select(F.col("annotation_id").alias("target_id"), F.get("coordinates", F.lit(1)).alias("lat"), F.get("coordinates", F.lit(0)).alias("lon"))


@query(None, "manifest", "position_reports", "annotations")
def scene_uncertain_pairs(m, r, a):
    return association.uncertain_pairs(scenes(m), reports.clean(r), _targets(a))


@query(None, "manifest", "position_reports", "annotations")
def matcher_comparison(m, r, a):
    """How far the assignment by distance and the one by uncertainty agree, target by target."""
    return association.compared(scenes(m), reports.clean(r), _targets(a))


@query(
    f"""select r.report_id, b.roi_key from ({_CLEAN}) r join (select roi_key, center[1] as lon, center[2] as lat from selection_rois where len(center) >= 2) b
        on r.lon >= b.lon - 0.02 and r.lon <= b.lon + 0.02 and r.lat >= b.lat - 0.01 and r.lat <= b.lat + 0.01""",
    "position_reports", "selection_rois",
)
def region_members(r, s):
    lon, lat = F.col("center")[0], F.col("center")[1]
    corner = lambda dx, dy: F.struct((lon + dx).alias("lon"), (lat + dy).alias("lat"))
    ring = F.array(corner(-0.02, -0.01), corner(0.02, -0.01), corner(0.02, 0.01), corner(-0.02, 0.01), corner(-0.02, -0.01))
    boxes = s.where(F.size("center") >= 2).select(F.col("roi_key").alias("r_id"), F.array(ring).alias("rings"))
    places = proximity.points(reports.clean(r), F.col("report_id"), F.col("lat"), F.col("lon"), "l")
    return regions.containing(places, boxes).select(F.col("l_id").alias("report_id"), F.col("r_id").alias("roi_key"))


def _stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by hour as a stream over the files, to their end."""
    path = f"{sf_dir}/position_reports.parquet"
    live = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")
    hour = F.floor(F.unix_seconds("time_utc") / 3600)
    counted = reports.clean(live).groupBy(hour.alias("hour")).agg(F.count("*").alias("reports"), F.max("speed_knots").alias("fastest"))
    where = shared_path(spark, "hourly")
    kept = lambda df, _: df.write.mode("overwrite").parquet(f"{where}/out")
    running = counted.writeStream.outputMode("complete").foreachBatch(kept).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{where}/out")


ALL["stream_hourly"] = (_stream_hourly, f"select cast(floor(epoch(time_utc) / 3600) as bigint) as hour, count(*) as reports, max(speed_knots) as fastest from ({_CLEAN}) group by 1")


# ---- intervals and states, on the event stream ----

_E = "select event_id, user_id, event_type, value, epoch_us(ts) / 1e6 as t from events"


def _events(e: DataFrame) -> DataFrame:
    return e.select("event_id", "user_id", "event_type", "value", (F.unix_micros("ts") / 1e6).alias("t"))


@query(
    f"""with i as (select user_id, t as a, t + 600 + value * 60 as b from ({_E})),
    m as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as r from i),
    g as (select *, sum(case when a <= r then 0 else 1 end) over (partition by user_id order by a, b rows unbounded preceding) as k from m)
    select user_id, round(min(a), 3) as a, round(max(b), 3) as b, count(*) as pieces from g group by user_id, k""",
    "events",
)
def intervals_merged(e):
    i = _events(e).select("user_id", F.col("t").alias("a"), (F.col("t") + 600 + F.col("value") * 60).alias("b"))
    return reports.merged_intervals(i, "user_id", "a", "b").select("user_id", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "pieces")


@query(
    f"""with i as (select user_id, greatest(t, 1704153600) as a, least(t + 600 + value * 60, 1704240000) as b from ({_E})), c as (select * from i where b > a),
    m as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as r from c),
    g as (select *, sum(case when a <= r then 0 else 1 end) over (partition by user_id order by a, b rows unbounded preceding) as k from m),
    u as (select user_id, max(b) - min(a) as s from g group by user_id, k)
    select user_id, round(sum(s), 3) as covered_s, round(sum(s) / 86400, 6) as share from u group by user_id""",
    "events",
)
def intervals_coverage(e):
    i = _events(e).select("user_id", F.col("t").alias("a"), (F.col("t") + 600 + F.col("value") * 60).alias("b"))
    out = reports.coverage(i, "user_id", "a", "b", F.lit(1704153600.0), F.lit(1704240000.0))
    return out.select("user_id", F.round("covered_s", 3).alias("covered_s"), F.round("share", 6).alias("share"))


@query(
    f"""with x as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by t range unbounded preceding) as k from ({_E})),
    b as (select user_id, t, k, lead(t) over (partition by user_id order by t) as t2, lead(k) over (partition by user_id order by t) as k2 from x where event_type = 'view')
    select user_id, round(t, 3) as a, round(t2, 3) as b from b where k2 = k and t2 > t and t2 - t <= 7200""",
    "events",
)
def heartbeat_pairs(e):
    beat, broken = F.col("event_type") == "view", F.col("event_type") == "error"
    out = reports.beat_intervals(_events(e), "user_id", "t", beat, broken, 7200)
    return out.select("user_id", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"))


@query(
    f"""with x as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by t rows unbounded preceding) as k from ({_E}))
    select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id, k order by t rows unbounded preceding) as last_purchase from x""",
    "events",
)
def state_timeline(e):
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return reports.filled_forward(_events(e), "user_id", "t", bought, "last_purchase", F.col("event_type") == "error").select("event_id", "last_purchase")


@query(
    """with s as (select user_id, max(ts) filter (event_type = 'view') as h, max(ts) filter (event_type = 'click') as o, max(ts) as r,
        arg_max(event_type, ts) <> 'error' as c from events group by user_id), n as (select max(ts) as now from events)
    select user_id, case when h is null or epoch_us(now) - epoch_us(h) > 180000000 then 'heartbeat_stale' when not c then 'disconnected'
        when o is null or epoch_us(now) - epoch_us(o) > 600000000 or epoch_us(now) - epoch_us(r) > 600000000 then 'observations_stale' else 'fresh' end as state from s, n""",
    "events",
)
def recorder_health(e):
    s = e.groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("heartbeat_at"), F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("observed_at"),
        F.max("ts").alias("received_at"), (F.max_by("event_type", "ts") != "error").alias("connected"),
    )
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    return reports.health(s.join(now), F.col("now")).select("user_id", "state")


@query(
    """select user_id, count(*) as attempts, count(*) filter (event_type = 'error') as failures, arg_max(event_type, (ts, event_id)) as latest_state,
        count(*) filter (event_type = 'error') >= 3 and arg_max(event_type, (ts, event_id)) not in ('processed', 'measured') as exhausted from events group by user_id""",
    "events",
)
def latest_attempts(e):
    a = e.select("user_id", F.col("event_type").alias("state"), F.struct("ts", "event_id").alias("at"))
    return catalogue.latest_attempts(a, "user_id", "at", F.col("state") == "error").drop("latest_at")


@query(
    """select cast(epoch(time_bucket(interval '1 hour', ts)) as bigint) as hour_s, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2""",
    "events",
)
def events_hourly(e):
    w = F.window("ts", "1 hour")
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.unix_seconds("w.start").alias("hour_s"), "event_type", "n", "total")


@query(
    """with l as (select user_id, epoch_us(ts) as t, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as p from events),
    s as (select *, sum(case when p is null or t - p >= 1800000000 then 1 else 0 end) over (partition by user_id order by t rows unbounded preceding) as k from l)
    select user_id, min(t) as start_us, max(t) as end_us, count(*) as n from s group by user_id, k""",
    "events",
)
def events_sessions(e):
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return s.select("user_id", F.unix_micros("a").alias("start_us"), F.unix_micros("b").alias("end_us"), "n")


# ---- catalogue ----

_SLICE = "regexp_replace(upper(trim(product_name)), '_[0-9A-F]{4}(_COG)?(\\.SAFE)?$', '')"


@query(
    f"""with p as (select distinct {_SLICE} as slice, product_name as name from manifest where product_name is not null)
    select slice, arg_min(name, (contains(name, '_COG'), name)) as name, case when count(*) > 1 then list_aggregate(list_sort(list(name)), 'string_agg', ',') end as aliases from p group by slice""",
    "manifest",
)
def slice_aliases(m):
    p = m.where("product_name is not null").withColumn("slice", cleaning.slice_name(F.col("product_name")))
    out = catalogue.one_per_slice(p, ["slice"], F.col("product_name").contains("_COG"), F.col("product_name"))
    return out.withColumn("aliases", F.array_join("aliases", ","))


@query(
    """select native_acquisition_group as g, list_aggregate(list_sort(list_distinct(list(lower(trim(split))))), 'string_agg', ',') as splits, count(*) as areas
    from manifest where native_acquisition_group is not null group by 1 having count(distinct lower(trim(split))) > 1""",
    "manifest",
)
def groups_over_splits(m):
    out = catalogue.over_splits(m.withColumnRenamed("native_acquisition_group", "g"), "g", F.lower(F.trim("split")))
    return out.withColumn("splits", F.array_join("splits", ","))


@query(
    """with recursive e as (select distinct 'a:' || native_acquisition_group as a, 'g:' || geographic_group as b from manifest where native_acquisition_group is not null and geographic_group is not null),
    b as (select a, b from e union select b, a from e), r(v, x) as (select a, a from b union select r.v, b.b from r join b on b.a = r.x)
    select v, min(x) as label from r group by v""",
    "manifest",
)
def dependence_blocks(m):
    e = m.select(F.concat(F.lit("a:"), "native_acquisition_group").alias("a"), F.concat(F.lit("g:"), "geographic_group").alias("b"))
    return catalogue.components(e.where("a is not null and b is not null").distinct())


@query(
    f"""select * from (select cell_x, cell_y, day, n, row_number() over (partition by day order by n desc, cell_x, cell_y) as rank from (
        select cast(floor(lon / 0.1) as bigint) as cell_x, cast(floor(lat / 0.1) as bigint) as cell_y, cast(cast(time_utc as date) as varchar) as day, count(*) as n from ({_CLEAN}) group by 1, 2, 3)) where rank <= 8""",
    "position_reports",
)
def busiest_cells(r):
    c = reports.clean(r).withColumn("cell", cleaning.grid_key(F.col("lon"), F.col("lat"), 0.1))
    n = c.groupBy(F.col("cell.x").alias("cell_x"), F.col("cell.y").alias("cell_y"), F.to_date("time_utc").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return catalogue.ranked(n, ["day"], [F.desc("n"), F.col("cell_x"), F.col("cell_y")], 8)


@query(
    """with c as (select distinct cast(floor(center[1] / 0.2) as bigint) as fx, cast(floor(center[2] / 0.2) as bigint) as fy from selection_rois),
    n as (select fx + dx as x, fy + dy as y, greatest(abs(dx), abs(dy)) as ring, fx, fy from c, (select unnest(range(-2, 3)) as dx), (select unnest(range(-2, 3)) as dy))
    select x, y, ring, fx as from_x, fy as from_y from (select *, row_number() over (partition by x, y order by ring, fx, fy) as k from n) where k = 1""",
    "selection_rois",
)
def cell_neighbours(s):
    c = s.select(F.floor(F.col("center")[0] / 0.2).alias("x"), F.floor(F.col("center")[1] / 0.2).alias("y")).where("x is not null and y is not null").distinct()
    return catalogue.around_cells(c, "x", "y", 2)


_ROI = "select roi_key, lower(trim(split)) as split, center[1] as lon, center[2] as lat, size_px from selection_rois where len(center) >= 2"
_HAV = "2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"


@query(
    f"""select a.roi_key as a, b.roi_key as b from ({_ROI}) a join ({_ROI}) b on a.roi_key < b.roi_key and a.split <> b.split and {_HAV} <= 10000""",
    "selection_rois",
)
def cross_split_rois(s):
    p = lambda k: proximity.points(s, F.col("roi_key"), F.get("center", F.lit(1)), F.get("center", F.lit(0)), k)
    near = proximity.within_distance(p("l"), p("r"), 10_000.0).where("l_id < r_id")
    named = lambda k, n: s.select(F.col("roi_key").alias(k), F.lower(F.trim("split")).alias(n))
    out = near.join(named("l_id", "sl"), "l_id").join(named("r_id", "sr"), "r_id").where("sl <> sr")
    return out.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


@query(
    f"""select b.roi_key, count(*) as reports, count(distinct r.user_id) as vessels from ({_CLEAN}) r join ({_ROI}) b
        on 6371008.8 * radians(abs(r.lat - b.lat)) <= 5 * b.size_px and 6371008.8 * cos(radians(b.lat)) * radians(abs(r.lon - b.lon)) <= 5 * b.size_px group by 1""",
    "position_reports", "selection_rois",
)
def roi_reports(r, s):
    c = reports.clean(r)
    boxes = proximity.points(s, F.col("roi_key"), F.get("center", F.lit(1)), F.get("center", F.lit(0)), "r")
    boxes = boxes.join(s.select(F.col("roi_key").alias("r_id"), (F.col("size_px") * 5.0).alias("r_half_m")), "r_id")
    inside = proximity.inside_boxes(proximity.points(c, F.struct("report_id", "user_id"), F.col("lat"), F.col("lon"), "l"), boxes)
    return inside.groupBy(F.col("r_id").alias("roi_key")).agg(F.count("*").alias("reports"), F.countDistinct("l_id.user_id").alias("vessels"))


@query(
    f"""with a as (select annotation_id as id, coordinates[2] as lat, case when coordinates[1] > 180 then coordinates[1] - 360 else coordinates[1] end as lon from annotations
        where len(coordinates) >= 2 and abs(coordinates[2]) <= 90 and coordinates[1] is not null),
    d as (select a.id as annotation_id, b.id as nearest_id, {_HAV} as m from a join a b on a.id <> b.id and abs(a.lat - b.lat) < 0.02)
    select annotation_id, arg_min(nearest_id, (round(m, 3), nearest_id)) as nearest_id, min(round(m, 3)) as distance_m from d where m <= 2000 group by 1""",
    "annotations",
)
def nearest_annotation(a):
    p = lambda k: proximity.points(a, F.col("annotation_id"), F.get("coordinates", F.lit(1)), F.get("coordinates", F.lit(0)), k)
    near = proximity.within_distance(p("l"), p("r"), 2000.0).where("l_id <> r_id").withColumn("m", F.round("distance_m", 3))
    best = near.groupBy(F.col("l_id").alias("annotation_id")).agg(F.min(F.struct("m", "r_id")).alias("b"))
    return best.select("annotation_id", F.col("b.r_id").alias("nearest_id"), F.col("b.m").alias("distance_m"))


# ---- joins and sets ----


@query(
    """select a.annotation_id, r.roi_key, r.roi_id is not null as known from annotations a left join selection_rois r on r.roi_id = a.roi_id""",
    "annotations", "selection_rois",
)
def annotation_regions(a, s):
    out = a.select("annotation_id", "roi_id").join(s.select("roi_id", "roi_key"), "roi_id", "left")
    return out.select("annotation_id", "roi_key", F.col("roi_key").isNotNull().alias("known"))


@query(
    """select coalesce(m.product_id, a.product_id) as product_id, case when m.product_id is null then 'annotations' else 'manifest' end as only_in
    from (select distinct product_id from manifest where product_id is not null) m full join (select distinct product_id from annotations where product_id is not null) a
        on a.product_id = m.product_id where m.product_id is null or a.product_id is null""",
    "manifest", "annotations",
)
def inventory_gaps(m, a):
    left = m.select("product_id").where("product_id is not null").distinct().withColumn("l", F.lit(True))
    right = a.select("product_id").where("product_id is not null").distinct().withColumn("r", F.lit(True))
    return left.join(right, "product_id", "full").where("l is null or r is null").select("product_id", F.when(F.col("l").isNull(), "annotations").otherwise("manifest").alias("only_in"))


@query(
    """select product_id, 'kept' as role from (select product_id from selection_rois intersect select product_id from annotations) where product_id is not null
    union all select product_id, 'missing' from (select product_id from annotations except select product_id from selection_rois) where product_id is not null""",
    "annotations", "selection_rois",
)
def product_roles(a, s):
    x, y = a.select("product_id").where("product_id is not null"), s.select("product_id").where("product_id is not null")
    return x.intersect(y).withColumn("role", F.lit("kept")).unionByName(x.subtract(y).withColumn("role", F.lit("missing")))


# ---- aggregates ----


@query(
    """select coalesce(object_class, 'unknown') as object_class, count(*) as n, count(*) filter (decision is null) as undecided, count(distinct annotator) as annotators from annotations group by 1""",
    "annotations",
)
def annotation_states(a):
    return a.groupBy(F.coalesce("object_class", F.lit("unknown")).alias("object_class")).agg(F.count("*").alias("n"), F.count_if(F.col("decision").isNull()).alias("undecided"), F.countDistinct("annotator").alias("annotators"))


@query(
    """select regime, count(*) filter (lower(trim(split)) = 'train') as train, count(*) filter (lower(trim(split)) = 'validation') as validation, count(*) filter (lower(trim(split)) = 'test') as test
    from selection_rois group by regime""",
    "selection_rois",
)
def regime_by_split(s):
    return s.withColumn("split", F.lower(F.trim("split"))).groupBy("regime").pivot("split", ["train", "validation", "test"]).count().na.fill(0)


@query(
    """select stream, 'areas' as metric, cast(count(*) as double) as value from manifest group by 1 union all
    select stream, 'approved', cast(count(*) filter (training_approved) as double) from manifest group by 1 union all
    select stream, 'uncertainty_m', round(avg(search_uncertainty_m), 4) from manifest group by 1""",
    "manifest",
)
def metrics_long(m):
    wide = m.groupBy("stream").agg(F.count("*").cast("double").alias("areas"), F.count_if("training_approved").cast("double").alias("approved"), F.round(F.avg("search_uncertainty_m"), 4).alias("uncertainty_m"))
    return wide.unpivot("stream", ["areas", "approved", "uncertainty_m"], "metric", "value")


_SCORED = "select l_orderkey, l_returnflag as regime, l_discount * 10 as score, l_quantity > 25 as truth from lineitem"
_METRICS = f"""
    select regime, t as threshold, count(*) filter (truth and score > t) as tp, count(*) filter (not truth and score > t) as fp, count(*) filter (truth and not score > t) as fn,
        count(*) filter (not truth and not score > t) as tn from ({_SCORED}), (select unnest([0.15, 0.35, 0.55, 0.75]) as t) group by 1, 2
"""
_THRESHOLDS = [0.15, 0.35, 0.55, 0.75]


def _scored(l: DataFrame) -> DataFrame:  # noqa: E741
    return l.select(F.col("l_returnflag").alias("regime"), (F.col("l_discount") * 10).alias("score"), (F.col("l_quantity") > 25).alias("truth"))


@query(f"select *, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall from ({_METRICS})", "lineitem")
def threshold_metrics(l):  # noqa: E741
    out = statistics.confusion(statistics.at_thresholds(_scored(l), _THRESHOLDS), ["regime", "threshold"], F.col("truth"), F.col("score"), F.col("threshold"))
    return out.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query(
    f"""select regime, arg_min(threshold, (-recall, fp, threshold)) as threshold, arg_min(fp, (-recall, fp, threshold)) as fp
    from (select *, tp / nullif(tp + fn, 0) as recall from ({_METRICS})) where recall >= 0.4 group by 1""",
    "lineitem",
)
def chosen_threshold(l):  # noqa: E741
    m = statistics.confusion(statistics.at_thresholds(_scored(l), _THRESHOLDS), ["regime", "threshold"], F.col("truth"), F.col("score"), F.col("threshold"))
    return statistics.best_threshold(m, ["regime"], 0.4).drop("recall")


_BINOMIAL = "list_sum(list_transform(range({a}, {b}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))))"


@query(
    f"""with recursive m as (select regime, threshold, tp as k, tp + fn as n from ({_METRICS})),
    s as (select regime, threshold, k, n, 0 as step, 1e-12 as la, 1 - 1e-12 as lb, 1e-12 as ha, 1 - 1e-12 as hb from m
        union all select regime, threshold, k, n, step + 1, case when k > 0 and {_BINOMIAL.format(a="k", b="n + 1", p="((la + lb) / 2)")} < 0.025 then (la + lb) / 2 else la end, case when k > 0 and {_BINOMIAL.format(a="k", b="n + 1", p="((la + lb) / 2)")} < 0.025 then lb else (la + lb) / 2 end,
            case when k < n and {_BINOMIAL.format(a="0", b="k + 1", p="((ha + hb) / 2)")} > 0.025 then (ha + hb) / 2 else ha end, case when k < n and {_BINOMIAL.format(a="0", b="k + 1", p="((ha + hb) / 2)")} > 0.025 then hb else (ha + hb) / 2 end from s where step < 36)
    select regime, threshold, round(case when k = 0 then 0 else (la + lb) / 2 end, 5) as low, round(case when k = n then 1 else (ha + hb) / 2 end, 5) as high from s where step = 36""",
    "lineitem",
)
def recall_intervals(l):  # noqa: E741
    m = statistics.confusion(statistics.at_thresholds(_scored(l), _THRESHOLDS), ["regime", "threshold"], F.col("truth"), F.col("score"), F.col("threshold"))
    return m.select("regime", "threshold", statistics.share_interval(F.col("tp"), F.col("tp") + F.col("fn")).alias("i")).select("regime", "threshold", F.round("i.low", 5).alias("low"), F.round("i.high", 5).alias("high"))


@query(
    """select case when l < 20 then 0 when l < 50 then 20 when l < 100 then 50 else 100 end as band, count(*) as vessels from (
        select l_suppkey, max(l_quantity) * 2 as l from lineitem where l_quantity > 0 group by 1) group by 1""",
    "lineitem",
)
def length_bands(l):  # noqa: E741
    v = l.where("l_quantity > 0").groupBy("l_suppkey").agg((F.max("l_quantity") * 2).alias("l"))
    band = F.when(F.col("l") < 20, 0).when(F.col("l") < 50, 20).when(F.col("l") < 100, 50).otherwise(100)
    return v.groupBy(band.alias("band")).agg(F.count("*").alias("vessels"))


# ---- scalar functions ----


@query(
    """select l_orderkey, l_linenumber, round(case when coalesce(l_quantity - 1, 0) <= 0 then -60 when l_tax <= 0 then -100 else 10 * log10(greatest((l_quantity - 1) * (l_quantity - 1) / (l_tax * l_tax), 1e-10)) end, 6) as db,
        round(1 / (1 + exp(-(l_quantity + 20) * 0.18)), 9) as squashed, cast(floor(least(1, greatest(0, (l_quantity) / 35)) * 255) as int) as shade from lineitem""",
    "lineitem",
)
def calibrated(l):  # noqa: E741
    return l.select(
        "l_orderkey", "l_linenumber", F.round(radar.sigma0_db(F.col("l_quantity") - 1, F.col("l_tax")), 6).alias("db"), F.round(radar.squash(F.col("l_quantity")), 9).alias("squashed"),
        radar.preview(F.col("l_quantity") - 30.0).alias("shade"),
    )


@query(
    """with b as (select annotation_id, roi_id, bbox_px[1] - 120 as x0, bbox_px[2] - 120 as y0, bbox_px[3] + 120 as x1, bbox_px[4] + 120 as y1 from annotations where len(bbox_px) = 4),
    p as (select a.annotation_id as a, b.annotation_id as b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as i,
        (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as s from b a join b on a.roi_id = b.roi_id and a.annotation_id < b.annotation_id)
    select a, b, round(i / nullif(s - i, 0), 6) as iou from p where i > 0""",
    "annotations",
)
def overlapping_boxes(a):
    """Boxes of one region that overlap, each taken 120 pixels wider, as they hardly ever do themselves."""
    b = a.where(F.size("bbox_px") == 4).select("annotation_id", "roi_id", *[(F.col("bbox_px")[k] + (-120 if k < 2 else 120)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])
    l, r = b.alias("l"), b.alias("r")  # noqa: E741
    side = lambda s: {k: F.col(f"{s}.{k}") for k in ("x0", "y0", "x1", "y1")}
    pairs = l.join(r, F.col("l.roi_id") == F.col("r.roi_id")).where("l.annotation_id < r.annotation_id")
    out = pairs.select(F.col("l.annotation_id").alias("a"), F.col("r.annotation_id").alias("b"), F.round(radar.box_iou(side("l"), side("r")), 6).alias("iou"))
    return out.where("iou > 0")


@query(
    """select roi_key, round((center[1] + 180) / 360 * 4194304, 4) as col, round((1 - ln(tan(radians(center[2])) + 1 / cos(radians(center[2]))) / pi()) / 2 * 4194304, 4) as row from selection_rois where len(center) >= 2""",
    "selection_rois",
)
def mercator_pixels(s):
    p = s.where(F.size("center") >= 2).select("roi_key", geodesy.mercator_pixel(F.col("center")[0], F.col("center")[1], 13).alias("p"))
    return p.select("roi_key", F.round("p.col", 4).alias("col"), F.round("p.row", 4).alias("row"))


@query(
    """select area_id, sha256(coalesce(area_code, '') || '|' || coalesce(product_id, '') || '|' || coalesce(split, '')) as digest from manifest""",
    "manifest",
)
def digests(m):
    return m.select("area_id", F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("area_code", "product_id", "split")]), 256).alias("digest"))


@query(
    """select area_id, regexp_extract(upper(product_name), '^(S1.)_.*_(\\d{6})_([0-9A-F]{6})_', 1) as satellite, cast(regexp_extract(upper(product_name), '_(\\d{6})_[0-9A-F]{6}_', 1) as int) as orbit
    from manifest where product_name is not null""",
    "manifest",
)
def native_groups(m):
    g = F.split(cleaning.native_group(F.col("product_name")), "_")
    return m.where("product_name is not null").select("area_id", g[0].alias("satellite"), g[1].cast("int").alias("orbit"))


@query(f"select scene_id as area_id, round((at_us - 946684800000000) / 86400e6, 8) as mjd2000 from ({_SCENES})", "manifest")
def days_since_2000(m):
    s = scenes(m)
    return s.select(F.col("scene_id").alias("area_id"), F.round((F.col("at_us") - 946684800000000) / 86400e6, 8).alias("mjd2000"))


# ---- detection ----


@query(
    """with s as (select roi_key, size_px as n from selection_rois where size_px is not null)
    select roi_key, c as col, r as row, least(128, n - c) as w, least(128, n - r) as h from (select roi_key, n, unnest(range(0, n - 32, 96)) as c from s) join (select roi_key, unnest(range(0, n - 32, 96)) as r from s) using (roi_key)""",
    "selection_rois",
)
def tile_windows(s):
    n = F.col("size_px")
    return detection.windows(s.where("size_px is not null").select("roi_key", "size_px"), n, n, 128, 32).select("roi_key", "col", "row", "w", "h")


@query(
    """with s as (select roi_key, size_px as n from selection_rois where size_px is not null), k as (select distinct roi_key, greatest(0, least(unnest(range(0, n - 32, 96)), n - 128)) as c from s)
    select a.roi_key, a.c as col, b.c as row from k a join k b using (roi_key)""",
    "selection_rois",
)
def whole_tiles(s):
    n = F.col("size_px")
    return detection.fixed_tiles(s.where("size_px is not null").select("roi_key", "size_px"), n, n, 128, 32).select("roi_key", "col", "row")


#: The objects' own boxes hardly ever meet: they are taken wider by so many pixels.
_GROWN = 120.0
_NUMBERED = f"""
    select *, row_number() over (partition by image, kind order by score desc, annotation_id) as rk, row_number() over (partition by image order by score desc, annotation_id) as ri from (
        select coalesce(roi_id, '?' || annotation_id) as image, coalesce(object_class, '?') as kind, annotation_id, bbox_px[1] - {_GROWN} as x0, bbox_px[2] - {_GROWN} as y0, bbox_px[3] + {_GROWN} as x1, bbox_px[4] + {_GROWN} as y1,
            (annotation_id * 7919) % 1000 / 1000.0 as score from annotations where len(bbox_px) = 4)
"""
_SUPPRESSED = f"""
    with recursive b as materialized ({_NUMBERED}), k(image, kind, rk, kept) as (
        select distinct image, kind, 0::bigint, []::struct(id bigint, x0 double, y0 double, x1 double, y1 double)[] from b
        union all select k.image, k.kind, k.rk + 1, case when len(list_filter(k.kept, lambda r: greatest(0, least(r.x1, b.x1) - greatest(r.x0, b.x0)) * greatest(0, least(r.y1, b.y1) - greatest(r.y0, b.y0)) > 0
            and greatest(0, least(r.x1, b.x1) - greatest(r.x0, b.x0)) * greatest(0, least(r.y1, b.y1) - greatest(r.y0, b.y0)) >= 0.3 * ((r.x1 - r.x0) * (r.y1 - r.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)
            - greatest(0, least(r.x1, b.x1) - greatest(r.x0, b.x0)) * greatest(0, least(r.y1, b.y1) - greatest(r.y0, b.y0))))) = 0
            then list_append(k.kept, {{'id': b.annotation_id, 'x0': b.x0::double, 'y0': b.y0::double, 'x1': b.x1::double, 'y1': b.y1::double}}) else k.kept end
        from k join b on b.image = k.image and b.kind = k.kind and b.rk = k.rk + 1),
    u as (select unnest(kept).id as annotation_id from (select arg_max(kept, rk) as kept from k group by image, kind))
    select annotation_id, image, score::double as score from u join b using (annotation_id)
"""
_APART = f"""
    with recursive p as materialized (select image, annotation_id, ri, score, (x0 + x1) / 2 as col, (y0 + y1) / 2 as row, cast(cast(floor(x0 / 96) as bigint) as varchar) as tile from ({_NUMBERED})), k(image, ri, kept) as (
        select distinct image, 0::bigint, []::struct(id bigint, col double, row double, tile varchar)[] from p
        union all select k.image, k.ri + 1, case when len(list_filter(k.kept, lambda r: (r.col - p.col) * (r.col - p.col) + (r.row - p.row) * (r.row - p.row) < 14400 and r.tile <> p.tile)) = 0
            then list_append(k.kept, {{'id': p.annotation_id, 'col': p.col::double, 'row': p.row::double, 'tile': p.tile}}) else k.kept end
        from k join p on p.image = k.image and p.ri = k.ri + 1),
    u as (select unnest(kept).id as annotation_id from (select arg_max(kept, ri) as kept from k group by image))
    select annotation_id, image, score::double as score from u join p using (annotation_id)
"""


def _boxes(a: DataFrame) -> DataFrame:
    # boxes without a region lie in no image that is known, so each is an image of its own
    own = F.concat(F.lit("?"), F.col("annotation_id").cast("string"))
    b = a.where(F.size("bbox_px") == 4).select(F.coalesce("roi_id", own).alias("image"), F.coalesce("object_class", F.lit("?")).alias("kind"), "annotation_id", *[(F.col("bbox_px")[k].cast("double") + (-_GROWN if k < 2 else _GROWN)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])
    return b.withColumn("score", F.pmod(F.col("annotation_id") * 7919, F.lit(1000)) / 1000.0)


@query(_SUPPRESSED, "annotations")
def suppressed_boxes(a):
    return detection.suppress(_boxes(a), ["image", "kind"], 0.3).select("annotation_id", "image", "score")


@query(_APART, "annotations")
def distinct_detections(a):
    p = _boxes(a).select("image", "annotation_id", ((F.col("x0") + F.col("x1")) / 2).alias("col"), ((F.col("y0") + F.col("y1")) / 2).alias("row"), "score", F.floor(F.col("x0") / 96).cast("string").alias("tile"))
    return detection.apart(p, ["image"], 120.0).select("annotation_id", "image", "score")


@query(
    """select l_orderkey as image_id, l_linenumber as row, l_partkey as col, round(0.65 + ((l_linenumber + l_partkey) % 100) / 285.0, 6) as score from lineitem where l_quantity >= 45 and l_tax >= 0.05""",
    "lineitem",
)
def mock_detections(l):  # noqa: E741
    px = l.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("bigint").alias("row"), F.col("l_partkey").alias("col"), "l_quantity", "l_tax")
    out = detection.mock_scores(px, F.col("l_quantity"), F.col("l_tax"), 45.0, 0.05)
    return out.select("image_id", F.col("row").cast("int").alias("row"), "col", F.round("score", 6).alias("score"))


# ---- models ----


@query(None, "embeddings")
def logistic_scores(e):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = e.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"), (F.col("label") < 5).cast("double").alias("y"))
    model = statistics.logistic(rows, "x", "y")
    return model.transform(rows).select("vec_id", "y", F.round(vector_to_array("probability")[1], 4).alias("p"))


# ---- relational shapes on the order tables ----


@query(
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n
    from lineitem where l_shipdate <= timestamp '2001-09-02' group by 1, 2""",
    "lineitem",
)
def pricing_summary(l):  # noqa: E741
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    kept = l.where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(revenue), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query(
    """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
    join region on r_regionkey = n_regionkey group by 1""",
    "lineitem", "orders", "customer", "nation", "region",
)
def revenue_by_nation(l, o, c, n, r):  # noqa: E741
    j = l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    j = j.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(
    "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by rollup (l_returnflag, l_linestatus)",
    "lineitem",
)
def rollup_counts(l):  # noqa: E741
    return l.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query(
    """select l_suppkey, l_orderkey, l_linenumber, rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem) where rank <= 3""",
    "lineitem",
)
def dearest_lines(l):  # noqa: E741
    out = catalogue.ranked(l, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query(
    """select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey) and o_custkey in (select c_custkey from customer)""",
    "orders", "lineitem", "customer",
)
def orders_without_lines(o, l, c):  # noqa: E741
    out = o.join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").join(c, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return out.select("o_orderkey")
