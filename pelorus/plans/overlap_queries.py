"""Queries of scenes with footprints, journals and near tracks; each whole, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.operators import overlap, proximity, reports
from pelorus.plans.survey_queries import _ALIGN, _AT_US, _CLEAN, _HAV, query, scenes

#: The test tables hold no footprints: an area's is a box about the region whose key is its own modulo their number, and of every tenth area it is open.
_FOOTPRINTS = f"""
    select a.scene_id, a.at_us, a.barred, b.lon - 0.35 as west, b.lon + 0.35 as east, b.lat - 0.2 as south, b.lat + 0.2 as north, b.lon as c_lon, b.lat as c_lat,
        b.lon is not null and b.lat is not null and a.scene_id % 10 <> 0 as whole
    from (select area_id as scene_id, {_AT_US} as at_us, coalesce(lower(trim(split)) = 'test', false) as barred from manifest) a
    left join (select roi_key, center[1] as lon, center[2] as lat from selection_rois) b on b.roi_key = 1 + a.scene_id % (select max(roi_key) from selection_rois)
"""


def footprints(m: DataFrame, s: DataFrame) -> DataFrame:
    """scene_id, at_us, barred, c_lon, c_lat, ring of every area."""
    at = scenes(m).join(m.select(F.col("area_id").alias("scene_id"), F.coalesce(F.lower(F.trim("split")) == "test", F.lit(False)).alias("barred")), "scene_id", "right")
    most = F.broadcast(s.agg(F.max("roi_key").alias("most")))  # one row
    keyed = at.join(most).withColumn("roi_key", F.col("scene_id") % F.col("most") + 1).drop("most")
    centres = s.select("roi_key", F.get("center", F.lit(0)).alias("c_lon"), F.get("center", F.lit(1)).alias("c_lat"))
    corner = lambda dx, dy: F.struct((F.col("c_lon") + dx).alias("lon"), (F.col("c_lat") + dy).alias("lat"))
    ring = F.array(corner(-0.35, -0.2), corner(0.35, -0.2), corner(0.35, 0.2), corner(-0.35, 0.2), corner(-0.35, -0.2))
    ring = F.when(F.col("scene_id") % 10 == 0, F.slice(ring, 1, 4)).when(F.col("c_lon").isNotNull() & F.col("c_lat").isNotNull(), ring)
    return keyed.join(centres, "roi_key", "left").select("scene_id", "at_us", "barred", "c_lon", "c_lat", ring.alias("ring"))


def _timed(r: DataFrame) -> DataFrame:
    return reports.clean(r).withColumn("t_us", F.unix_micros("time_utc"))


_SWATH = f"""
    with s as materialized ({_FOOTPRINTS}), c as materialized (select *, epoch_us(time_utc) as t from ({_CLEAN})),
    ok as (select * from s where at_us is not null and whole and not barred),
    wide as (select ok.*, c.user_id, c.lat, c.lon, c.t from ok join c on c.t between ok.at_us - 1800000000 and ok.at_us + 1800000000),
    raw as (select scene_id, count(*) as n from wide where lon between west and east and lat between south and north group by 1),
    hist as (select scene_id, user_id, min(abs(t - at_us)) / 1e6 as nearest_s, (min(t) filter (t >= at_us) - max(t) filter (t <= at_us)) / 1e6 as bracket_s from wide group by 1, 2),
    pos as (select * from ({{align}})),
    sup as (select h.* from pos p join ok using (scene_id) join hist h using (scene_id, user_id) where p.lon between west and east and p.lat between south and north)
"""
_POSITIONS = _ALIGN.replace("{'sp': speed_knots, 'co': course_deg}", "{'sp': speed_knots, 'co': course_deg, 'lat': lat, 'lon': lon, 'dt': dt}").replace(
    "select * from (select scene_id, user_id, reports,",
    """select scene_id, user_id, method,
        case method when 'interpolated' then la + (ra - la) * -ld / (rd - ld) when 'velocity_propagated' then m.lat + degrees(-m.dt * m.sp * 1852.0 / 3600 * cos(radians(m.co)) / 6371008.8) else m.lat end as lat,
        case method when 'interpolated' then lo + (ro - lo) * -ld / (rd - ld)
            when 'velocity_propagated' then m.lon + degrees(-m.dt * m.sp * 1852.0 / 3600 * sin(radians(m.co)) / 6371008.8 / cos(radians(m.lat))) else m.lon end as lon
    from (select scene_id, user_id, reports, la, ra, lo, ro, ld, rd, m,""",
)
_SWATH = _SWATH.replace("{align}", _POSITIONS)


@query(
    f"""{_SWATH}, agg as (select scene_id, count(*) as aligned, count(*) filter (nearest_s <= 120) as close, count(*) filter (bracket_s <= 240) as bracketed from sup group by 1)
    select s.scene_id, case when at_us is null then 'invalid_identity_or_time' when not whole then 'missing_or_invalid_footprint' when barred then 'barred_group'
            when agg.close > 0 then 'temporal_candidate' when raw.n > 0 then 'sparse_support_only' else 'no_observed_overlap' end as status,
        coalesce(aligned, 0) as aligned, coalesce(close, 0) as close, coalesce(bracketed, 0) as bracketed, coalesce(raw.n, 0) as rows
    from s left join agg using (scene_id) left join raw using (scene_id)""",
    "manifest", "selection_rois", "position_reports",
)
def swath_audit(m, s, r):
    return overlap.audit(footprints(m, s), _timed(r), F.col("barred"))


@query(
    f"""with s as ({_FOOTPRINTS}), c as (select *, epoch_us(time_utc) as t from ({_CLEAN}))
    select s.scene_id, c.report_id, c.user_id from s join c on whole and abs(c.t - at_us) <= 300000000 and lon between west and east and lat between south and north""",
    "manifest", "selection_rois", "position_reports",
)
def swath_reports(m, s, r):
    return overlap.in_swath(footprints(m, s), _timed(r), 300.0).select("scene_id", "report_id", "user_id")


@query(
    f"""with s as ({_FOOTPRINTS}), c as (select *, epoch_us(time_utc) as t from ({_CLEAN}))
    select s.scene_id, c.report_id, (c.t - at_us) / 1e6 as offset_s, abs(c.t - at_us) / 1e6 <= 1800 as eligible, 300 + abs(c.t - at_us) / 1e6 as uncertainty_m
    from s join c on whole and speed_knots is null and abs(c.t - at_us) <= 7200000000 and lon between west and east and lat between south and north""",
    "manifest", "selection_rois", "position_reports",
)
def sighting_overlaps(m, s, r):
    """Sightings, here the reports without a speed, in the footprints within two hours."""
    seen = overlap.in_swath(footprints(m, s), _timed(r).where("speed_knots is null"), 7200.0)
    offset = (F.col("t_us") - F.col("at_us")) / 1e6
    return seen.select("scene_id", "report_id", offset.alias("offset_s"), (F.abs(offset) <= 1800).alias("eligible"), (F.abs(offset) + 300).alias("uncertainty_m"))


@query(
    f"""with s as ({_FOOTPRINTS}), b as (select *, epoch_us(time_utc) as t from ({_CLEAN})), p as (select scene_id, report_id, user_id, abs(t - at_us) / 1e6 as dt, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - c_lat) / 2), 2)
            + cos(radians(c_lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - c_lon) / 2), 2))) as m from s join b on abs(t - at_us) <= 1800000000 and abs(b.lat - c_lat) < 0.06)
    select scene_id, count(*) as rows, count(distinct user_id) as vessels from p where m <= 3000 + dt group by 1""",
    "manifest", "selection_rois", "position_reports",
)
def source_gates(m, s, r):
    """Areas with the reports that could be what was seen at their centre: within half an hour, and 3 km and a metre for each second."""
    met = overlap.around(footprints(m, s).where("at_us is not null and c_lat is not null and c_lon is not null"), _timed(r), 1800.0, 3000.0, 1.0)
    return met.groupBy("scene_id").agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("vessels"))


@query(
    f"""with c as (select report_id, user_id, lat, lon, epoch_us(time_utc) as t from ({_CLEAN})), p as (select a.report_id as x, b.report_id as y, abs(a.t - b.t) / 1e6 as dt, {_HAV} as m
        from c a join c b on a.user_id = b.user_id and a.report_id <> b.report_id and abs(a.t - b.t) <= 600000000)
    select x as report_id, count(*) as others, count(*) filter (m <= 300 + dt) as compatible from p group by 1""",
    "position_reports",
)
def repeat_sightings(r):
    return overlap.repeats(_timed(r), "user_id", "report_id", 600.0, 300.0, 1.0)


_NEAREST = f"""
    select scene_id, user_id, m.lat as lat, m.lon as lon, m.dt as dt, m.sp as sp from (
        select scene_id, user_id, arg_min({{'lat': lat, 'lon': lon, 'dt': dt, 'sp': speed_knots}}, (abs(dt), t, report_id)) as m from (
            select scene_id, report_id, user_id, lat, lon, speed_knots, epoch_us(time_utc) as t, (epoch_us(time_utc) - at_us) / 1e6 as dt from ({_FOOTPRINTS}) s join ({_CLEAN}) c
                on whole and abs(epoch_us(time_utc) - at_us) <= 300000000 and lon between west and east and lat between south and north) group by 1, 2)
"""


def _nearest_in_swath(m: DataFrame, s: DataFrame, r: DataFrame) -> DataFrame:
    """The nearest report of each vessel in a footprint within AGE_S: scene_id, user_id, lat, lon, dt, speed_knots."""
    dt = (F.col("t_us") - F.col("at_us")) / 1e6
    inside = overlap.in_swath(footprints(m, s), _timed(r), 300.0).withColumn("dt", dt)
    best = inside.groupBy("scene_id", "user_id").agg(F.min_by(F.struct("lat", "lon", "dt", "speed_knots"), F.struct(F.abs("dt").alias("d"), F.col("t_us"), F.col("report_id"))).alias("b"))
    return best.select("scene_id", "user_id", "b.*")


@query(
    f"""with n as materialized ({_NEAREST}) select a.scene_id, count(*) as pairs, round(min({_HAV}), 3) as nearest_m from n a join n b on a.scene_id = b.scene_id and a.user_id < b.user_id where {_HAV} <= 40000 group by 1""",
    "manifest", "selection_rois", "position_reports",
)
def near_tracks(m, s, r):
    """Pairs of vessels of a scene within forty kilometres of each other."""
    return overlap.near_pairs(_nearest_in_swath(m, s, r), 40_000.0).groupBy("scene_id").agg(F.count("*").alias("pairs"), F.round(F.min("distance_m"), 3).alias("nearest_m"))


@query(
    f"""with n as ({_NEAREST}), x as (select unnest(case when len(l) = 0 then ['passed'] else l end) as reason from (select list_filter([case when abs(dt) > 120 then 'far_in_time' end,
        case when sp is null then 'speed_unknown' end, case when sp < 1 then 'not_moving' end, case when sp > 60 then 'implausible_speed' end], lambda y: y is not null) as l from n))
    select reason, count(*) as n from x group by 1""",
    "manifest", "selection_rois", "position_reports",
)
def source_screen(m, s, r):
    """How many vessels of the footprints fail each check of a source; one may fail several."""
    checks = {"far_in_time": F.abs("dt") > 120, "speed_unknown": F.col("speed_knots").isNull(), "not_moving": F.col("speed_knots") < 1, "implausible_speed": F.col("speed_knots") > 60}
    return overlap.counted_reasons(overlap.reasons_of(_nearest_in_swath(m, s, r), checks))


@query(
    f"""with n as materialized ({_NEAREST}), p as (select a.scene_id, count(*) as pairs from n a join n b on a.scene_id = b.scene_id and a.user_id < b.user_id where {_HAV} <= 5000 group by 1),
    k as (select scene_id, count(*) as vessels, count(*) filter (abs(dt) <= 120) as close from n group by 1)
    select scene_id, close, pairs, vessels, row_number() over (order by close desc, pairs desc, vessels desc, at_us, scene_id) as rank
    from (select k.scene_id, close, coalesce(pairs, 0) as pairs, vessels, at_us from k join ({_FOOTPRINTS}) using (scene_id) left join p using (scene_id)) order by rank limit 50""",
    "manifest", "selection_rois", "position_reports",
)
def scene_shortlist(m, s, r):
    """The fifty scenes best supported: most vessels close in time, most near pairs, most vessels, the earliest."""
    near = _nearest_in_swath(m, s, r)
    pairs = overlap.near_pairs(near, 5000.0).groupBy("scene_id").agg(F.count("*").alias("pairs"))
    k = near.groupBy("scene_id").agg(F.count("*").alias("vessels"), F.count_if(F.abs("dt") <= 120).alias("close"))
    rows = k.join(footprints(m, s).select("scene_id", "at_us"), "scene_id").join(pairs, "scene_id", "left").na.fill(0, ["pairs"])
    order = [F.desc("close"), F.desc("pairs"), F.desc("vessels"), F.col("at_us"), F.col("scene_id")]
    from pyspark.sql import Window

    top = rows.orderBy(*order).limit(50)  # the report itself; ranked in one task, as it is fifty rows
    return top.select("scene_id", "close", "pairs", "vessels", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"))


@query(
    f"""with a as (select annotation_id as id, coordinates[2] as lat, coordinates[1] as lon from annotations where len(coordinates) >= 2 and abs(coordinates[2]) <= 90), b as ({_CLEAN}),
    d as (select a.id, {_HAV} as m from a join b on abs(a.lat - b.lat) < 0.02)
    select id as annotation_id, count(*) filter (m <= 500) as within_500, count(*) as within_2000, round(min(m), 3) as nearest_m from d where m <= 2000 group by 1""",
    "annotations", "position_reports",
)
def support_distances(a, r):
    """Objects with the reports within 500 m and 2 km of them, and the nearest."""
    left = proximity.points(a, F.col("annotation_id"), F.get("coordinates", F.lit(1)), F.get("coordinates", F.lit(0)), "l")
    right = proximity.points(reports.clean(r), F.col("report_id"), F.col("lat"), F.col("lon"), "r")
    d = proximity.within_distance(left, right, 2000.0).groupBy(F.col("l_id").alias("annotation_id"))
    return d.agg(F.count_if(F.col("distance_m") <= 500).alias("within_500"), F.count("*").alias("within_2000"), F.round(F.min("distance_m"), 3).alias("nearest_m"))


@query(
    f"""with s as ({_FOOTPRINTS}), c as (select *, epoch_us(time_utc) as t from ({_CLEAN})), x as (select s.scene_id, cast(floor(lon / 0.2) as bigint) as cell_x, cast(floor(lat / 0.2) as bigint) as cell_y, user_id, (epoch_us(received_at) - t) / 1e6 as late
        from s join c on whole and abs(t - at_us) <= 300000000 and lon between west and east and lat between south and north)
    select scene_id, cell_x, cell_y, count(*) as reports, count(distinct user_id) as vessels, count(*) filter (late < 0) as negative, round(quantile_cont(late, 0.5), 4) as median_s, round(quantile_cont(late, 0.95), 4) as p95_s from x group by 1, 2, 3""",
    "manifest", "selection_rois", "position_reports",
)
def pass_cells(m, s, r):
    """Reports around a scene by cell of its footprint, with how late they were received."""
    x = overlap.in_swath(footprints(m, s), _timed(r), 300.0).withColumn("late", (F.unix_micros("received_at") - F.col("t_us")) / 1e6)
    cell = lambda c: F.floor(F.col(c) / 0.2)
    p = F.percentile("late", F.array(F.lit(0.5), F.lit(0.95)))
    out = x.groupBy("scene_id", cell("lon").alias("cell_x"), cell("lat").alias("cell_y")).agg(
        F.count("*").alias("reports"), F.countDistinct("user_id").alias("vessels"), F.count_if(F.col("late") < 0).alias("negative"), p.alias("p")
    )
    return out.select("scene_id", "cell_x", "cell_y", "reports", "vessels", "negative", F.round(F.col("p")[0], 4).alias("median_s"), F.round(F.col("p")[1], 4).alias("p95_s"))


@query(
    f"""with cells as (select distinct cast(floor(center[1] / 0.2) as bigint) as x, cast(floor(center[2] / 0.2) as bigint) as y from selection_rois where len(center) >= 2),
    m as (select cast(floor(lon / 0.2) as bigint) as x, cast(floor(lat / 0.2) as bigint) as y, user_id, epoch_us(time_utc) as t, speed_knots as v from ({_CLEAN})
        where speed_knots >= 1 and epoch_us(time_utc) > 1484784000000000 and epoch_us(time_utc) <= 1485388800000000)
    select x, y, count(user_id) as reports, count(distinct user_id) as vessels, round(max(t) / 1e6, 3) as latest_s, max(v) as fastest from cells left join m using (x, y) group by 1, 2""",
    "selection_rois", "position_reports",
)
def moving_cells(s, r):
    """Moving vessels in the regions' cells over the seven days before an instant; cells without any stay."""
    cells = s.select(F.floor(F.col("center")[0] / 0.2).alias("x"), F.floor(F.col("center")[1] / 0.2).alias("y")).where("x is not null and y is not null").distinct()
    moving = _timed(r).where("speed_knots >= 1 and t_us > 1484784000000000 and t_us <= 1485388800000000").select(F.floor(F.col("lon") / 0.2).alias("x"), F.floor(F.col("lat") / 0.2).alias("y"), "user_id", "t_us", "speed_knots")
    # counted before the join, so that a busy cell is one row there
    m = moving.groupBy("x", "y").agg(F.count("*").alias("reports"), F.countDistinct("user_id").alias("vessels"), F.round(F.max("t_us") / 1e6, 3).alias("latest_s"), F.max("speed_knots").alias("fastest"))
    return cells.join(m, ["x", "y"], "left").na.fill(0, ["reports", "vessels"])


@query(
    """with e as (select user_id, event_type, value > 50 as connected, epoch_us(ts) / 1e6 as t from events), b as (select * from e where event_type in ('view', 'click')),
    x as (select user_id, arg_max(connected, (t, connected)) filter (t <= 1705190400) as lc, max(t) filter (t <= 1705190400) as a, arg_min(connected, (t, connected)) filter (t >= 1705190400) as rc, min(t) filter (t >= 1705190400) as b from b group by 1)
    select user_id, round(a, 3) as a, round(b, 3) as b from x where lc and rc and b - a <= 864000 and not exists (select 1 from e where e.user_id = x.user_id and event_type = 'error' and e.t between x.a and x.b)""",
    "events",
)
def bracketing_beats(e):
    """Users heard on both sides of an instant without an error between."""
    rows = e.select("user_id", "event_type", (F.col("value") > 50).alias("connected"), (F.unix_micros("ts") / 1e6).alias("t"))
    out = overlap.bracketing_beats(rows.where("event_type in ('view', 'click')"), rows.where("event_type = 'error'"), "user_id", "t", 1705190400.0, 864_000.0)
    return out.select("user_id", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"))


@query(
    f"""with a as (select annotation_id as id, coordinates[2] as lat, coordinates[1] as lon from annotations where len(coordinates) >= 2 and abs(coordinates[2]) <= 90),
    b as (select roi_key as id, roi_id, center[1] as lon, center[2] as lat from selection_rois where len(center) >= 2 and regime = 'harbour'),
    d as (select a.id as x, b.id as y, b.roi_id, {_HAV} as m from a join b on abs(a.lat - b.lat) < 0.05), n as (select x, arg_min(roi_id, (m, y)) as site, min(m) as m from d where m <= 4000 group by 1)
    select site, count(*) as objects, round(min(m), 3) as nearest_m from n group by 1""",
    "annotations", "selection_rois",
)
def near_sites(a, s):
    """Fixed sites, here the harbour regions, with the objects they are the nearest of within 4 km."""
    harbours = s.where("regime = 'harbour'")
    left = proximity.points(a, F.col("annotation_id"), F.get("coordinates", F.lit(1)), F.get("coordinates", F.lit(0)), "l")
    right = proximity.points(harbours, F.col("roi_key"), F.get("center", F.lit(1)), F.get("center", F.lit(0)), "r")
    named = proximity.nearest_site(left, right, 4000.0).join(harbours.select(F.col("roi_key").alias("r_id"), F.col("roi_id").alias("site")), "r_id")
    return named.groupBy("site").agg(F.count("*").alias("objects"), F.round(F.min("distance_m"), 3).alias("nearest_m"))


@query(
    f"""with n as materialized ({_NEAREST}), a as (select annotation_id as id, coordinates[2] as lat, coordinates[1] as lon from annotations where len(coordinates) >= 2 and abs(coordinates[2]) <= 90),
    d as (select b.scene_id, a.id, {_HAV} as m, 500 + 100 + 2 * abs(b.dt) as gate from a join n b on abs(a.lat - b.lat) < 0.02)
    select scene_id, count(distinct id) filter (m <= 100) as at_100_m, count(distinct id) as in_gate from d where m <= gate group by 1""",
    "manifest", "selection_rois", "position_reports", "annotations",
)
def gate_support(m, s, r, a):
    """By scene how many objects have a vessel within 100 m, and within the gate that widens with the report's age."""
    near = _nearest_in_swath(m, s, r).withColumn("gate", F.lit(600.0) + 2 * F.abs("dt"))
    left = proximity.points(a, F.col("annotation_id"), F.get("coordinates", F.lit(1)), F.get("coordinates", F.lit(0)), "l")
    right = proximity.points(near, F.struct("scene_id", "user_id", "gate"), F.col("lat"), F.col("lon"), "r")
    met = proximity.within_distance(left, right, 1200.0).where(F.col("distance_m") <= F.col("r_id.gate"))
    at = F.countDistinct(F.when(F.col("distance_m") <= 100, F.col("l_id")))
    return met.groupBy(F.col("r_id.scene_id").alias("scene_id")).agg(at.alias("at_100_m"), F.countDistinct("l_id").alias("in_gate"))
