"""Queries that choose among products and areas; each whole, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelorus.functions import cleaning
from pelorus.operators import proximity, selection
from pelorus.plans.survey_queries import _AT_US, _HAV, _ROI, query, scenes
from pelorus.sources import products

_NAME = "^(S1.)_.*_(\\\\d{8}T\\\\d{6})_(\\\\d{8}T\\\\d{6})_\\\\d{6}_[0-9A-F]{6}_[0-9A-F]{4}(_COG)?(\\\\.SAFE)?$".replace("\\\\", "\\")


@query(
    f"""with p as (select area_id, lower(trim(product_id)) as uuid, product_name as name, upper(trim(product_name)) as up, coalesce(try_cast(regexp_extract(upper(product_name), '_(\\d{{6}})_[0-9A-F]{{6}}_', 1) as int), 0) as orbit from manifest),
    s as (select *, case when regexp_matches(up, '{_NAME}') then regexp_replace(up, '_[0-9A-F]{{4}}(_COG)?(\\.SAFE)?$', '') end as slice, regexp_extract(up, '{_NAME}', 2) as a, regexp_extract(up, '{_NAME}', 3) as b from p),
    l as (select uuid, arg_max({{'name': name, 'slice': slice, 'a': a, 'b': b, 'orbit': orbit}}, area_id) as p from s group by uuid),
    k as (select uuid, p.name as name, coalesce(contains(upper(p.name), '_COG'), false) as copy, case when p.slice is not null and p.a < p.b and p.orbit % 10 <> 0 then p.slice || p.a || p.b || (p.orbit % 50) else uuid end as k from l)
    select arg_min(uuid, (copy, uuid)) as id, case when count(distinct name) > 1 then list_aggregate(list_sort(list_distinct(list(name))), 'string_agg', ',') end as aliases from k group by k""",
    "manifest",
)
def unique_acquisitions(m):
    """The tables hold no footprints: a product's is a triangle placed by its orbit, and of every tenth orbit it is open."""
    up = F.upper(F.trim("product_name"))
    at = lambda k: F.unix_micros(F.try_to_timestamp(F.regexp_extract(up, _NAME, k), F.lit("yyyyMMdd'T'HHmmss")))
    orbit = F.coalesce(F.regexp_extract(up, r"_(\d{6})_[0-9A-F]{6}_", 1).try_cast("int"), F.lit(0))
    corner = lambda dx, dy: F.struct((F.lit(-55.0) + (orbit % 50) / 10 + dx).alias("lon"), F.lit(47.0 + dy).alias("lat"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 0))
    named = m.select(
        "area_id", F.col("product_id").alias("id"), F.col("product_name").alias("name"), F.when(up.rlike(_NAME), cleaning.slice_name(F.col("product_name"))).alias("slice"), at(2).alias("start_us"), at(3).alias("end_us"),
        F.when(orbit % 10 == 0, F.slice(ring, 1, 3)).otherwise(ring).alias("ring"),
    )
    return selection.unique_acquisitions(named, "area_id").select("id", F.array_join("aliases", ",").alias("aliases"))


@query(
    """with t as (select * from manifest where lower(trim(split)) = 'test') select area_id from manifest m where coalesce(lower(trim(split)), '') <> 'test'
        and not exists (select 1 from t where t.native_acquisition_group = m.native_acquisition_group) and not exists (select 1 from t where t.geographic_group = m.geographic_group)""",
    "manifest",
)
def unlocked_areas(m):
    """Areas that share neither group with an area held out for the test."""
    split = F.coalesce(F.lower(F.trim("split")), F.lit(""))
    return selection.without_locked(m.where(split != "test"), m.where(split == "test"), ["native_acquisition_group", "geographic_group"]).select("area_id")


@query(
    f"""with r as ({_ROI}), n as (select a.roi_key, b.split from r a join r b on a.roi_key <> b.roi_key and abs(a.lat - b.lat) < 0.1 and {_HAV} < 1500), h as (select roi_key, list_sort(list_distinct(list(split))) as s from n where split is not null group by 1),
    o as (select roi_key, s, case when list_contains(s, 'test') then 'near_closed_split' when len(s) > 1 then 'near_several_splits' end as problem, case when ('0x' || substr(sha256(product_id), 1, 2))::int % 2 = 0 then 'train' else 'validation' end as own
        from selection_rois left join h using (roi_key))
    select roi_key as row_id, case when problem is null then case when len(s) = 1 then s[1] else own end end as role, problem from o""",
    "selection_rois",
)
def inherited_roles(s):
    """The role of each region by the splits of those within 1.5 km, or by parity of its product's digest."""
    p = lambda k: proximity.points(s, F.col("roi_key"), F.get("center", F.lit(1)), F.get("center", F.lit(0)), k)
    near = proximity.within_distance(p("l"), p("r"), 1500.0).where("l_id <> r_id and distance_m < 1500")
    splits = s.select(F.col("roi_key").alias("r_id"), F.lower(F.trim("split")).alias("split"))
    near = near.join(splits, "r_id").select(F.col("l_id").alias("row_id"), "split")
    return selection.inherited_roles(near, s.select(F.col("roi_key").alias("row_id"), "product_id"), selection.parity_split(F.col("product_id")))


@query(
    """select product_id, count(*) as rows, bool_and(decision is not null) as decided, bool_and(coalesce(object_class <> 'unresolved', false)) as resolved, bool_and(coalesce(len(bbox_px) = 4, false)) as boxed,
        bool_and(decision is not null) and bool_and(coalesce(object_class <> 'unresolved', false)) and bool_and(coalesce(len(bbox_px) = 4, false)) as ready from annotations group by 1""",
    "annotations",
)
def product_readiness(a):
    return selection.all_hold(a, "product_id", {"decided": F.col("decision").isNotNull(), "resolved": F.col("object_class") != "unresolved", "boxed": F.size("bbox_px") == 4})


@query(
    """select 'roi_unknown' as rule, cast(annotation_id as varchar) as key from annotations a where not exists (select 1 from selection_rois s where s.roi_id = a.roi_id)
    union all select 'roi_of_other_product', cast(annotation_id as varchar) from annotations a join selection_rois s using (roi_id) where a.product_id <> s.product_id
    union all select 'box_leaves_roi', cast(annotation_id as varchar) from annotations a join selection_rois s using (roi_id) where len(bbox_px) = 4 and (bbox_px[1] < 0 or bbox_px[2] < 0 or bbox_px[3] > size_px or bbox_px[4] > size_px)
    union all select 'product_over_splits', product_id from selection_rois where product_id is not null group by product_id having count(distinct lower(trim(split))) > 1""",
    "annotations", "selection_rois",
)
def contract_violations(a, s):
    both = a.join(s.select("roi_id", F.col("product_id").alias("p"), "size_px"), "roi_id")
    box = [F.col("bbox_px")[k] for k in range(4)]
    leaves = (F.size("bbox_px") == 4) & ((box[0] < 0) | (box[1] < 0) | (box[2] > F.col("size_px")) | (box[3] > F.col("size_px")))
    over = s.where("product_id is not null").groupBy("product_id").agg(F.countDistinct(F.lower(F.trim("split"))).alias("n")).where("n > 1")
    return selection.violations({
        "roi_unknown": a.join(s, "roi_id", "left_anti").select("annotation_id"), "roi_of_other_product": both.where("product_id <> p").select("annotation_id"),
        "box_leaves_roi": both.where(leaves).select("annotation_id"), "product_over_splits": over.select("product_id"),
    })


@query(
    f"""select area_id, at_us from (select area_id, {_AT_US} as at_us, product_id from manifest) where at_us is not null order by at_us desc, area_id limit 40""",
    "manifest",
)
def newest_areas(m):
    return scenes(m).select(F.col("scene_id").alias("area_id"), "at_us").orderBy(F.desc("at_us"), "area_id").limit(40)


@query(
    """with n as (select max(ts) as now from events), a as (select user_id, max(ts) filter (event_type = 'click') as tried, max(ts) as seen from events group by 1)
    select user_id, cast(epoch_us(tried) as double) as tried_us from a order by tried nulls first, user_id limit 25""",
    "events",
)
def least_recently_tried(e):
    """The twenty-five that were tried longest ago, those never tried first."""
    a = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("tried"))
    return a.orderBy(F.asc_nulls_first("tried"), "user_id").limit(25).select("user_id", F.unix_micros("tried").cast("double").alias("tried_us"))


@query(
    f"""select geographic_group as g, arg_min(area_id, (at_us, area_id)) as area_id, min(at_us) as at_us from (select *, {_AT_US} as at_us from manifest)
    where at_us is not null and geographic_group is not null and coalesce(training_approved, false) and not coalesce(prior_datatake_exposure, true) group by 1""",
    "manifest",
)
def earliest_approved(m):
    """The earliest area of each geographic group that is approved and was not exposed before."""
    ok = m.where(F.col("geographic_group").isNotNull() & F.coalesce("training_approved", F.lit(False)) & ~F.coalesce("prior_datatake_exposure", F.lit(True)))
    timed = ok.join(scenes(m).select(F.col("scene_id").alias("area_id"), "at_us"), "area_id")
    return timed.groupBy(F.col("geographic_group").alias("g")).agg(F.min_by("area_id", F.struct("at_us", "area_id")).alias("area_id"), F.min("at_us").alias("at_us"))


@query(
    """with t as (select feed, payload ->> '$.absolute_offset_s' as s from release_rows where json_valid(payload))
    select feed, case when regexp_full_match(s, '[+-]?\\d+(\\.\\d+)?') then pow(10.0, -length(regexp_extract(s, '\\.(\\d+)$', 1))) end as step, count(*) as n from t where s is not null group by 1, 2""",
    "release_rows",
)
def offset_precision(r):
    """How finely offsets are written, by feed."""
    t = r.select("feed", F.get_json_object("payload", "$.absolute_offset_s").alias("s")).where("s is not null")
    return t.groupBy("feed", selection.precision_step(F.col("s")).alias("step")).agg(F.count("*").alias("n"))


@query(
    """with s as (select message_type, (epoch_us(received_at) - epoch_us(time_utc)) / 1e6 as s from position_reports)
    select message_type, p as share, round(case p when 0.5 then quantile_cont(s, 0.5) when 0.95 then quantile_cont(s, 0.95) else quantile_cont(s, 0.999) end, 4) as value from s, (select unnest([0.5, 0.95, 0.999]) as p) where s is not null group by 1, 2""",
    "position_reports",
)
def latency_quantiles(r):
    """Exact quantiles of the time from report to receipt, however many rows a kind of message has."""
    s = r.select("message_type", ((F.unix_micros("received_at") - F.unix_micros("time_utc")) / 1e6).alias("s"))
    return selection.exact_quantiles(s, ["message_type"], "s", [0.5, 0.95, 0.999], 1.0).select("message_type", "share", F.round("value", 4).alias("value"))


@query(
    """select roi_id, '[' || string_agg('"' || annotation_id || '"', ',' order by cast(annotation_id as varchar)) || ']' as ids from annotations where roi_id is not null group by 1""",
    "annotations",
)
def candidate_lists(a):
    """The ids of each region's objects as a JSON list of text."""
    return a.where("roi_id is not null").groupBy("roi_id").agg(F.to_json(F.array_sort(F.collect_list(F.col("annotation_id").cast("string")))).alias("ids"))


@query(
    """select annotation_id, replace(replace(replace(replace(replace(coalesce(decision, '<b>none & "void"</b>'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as html from annotations""",
    "annotations",
)
def escaped_decisions(a):
    return a.select("annotation_id", selection.escaped(F.coalesce("decision", F.lit('<b>none & "void"</b>'))).alias("html"))


@query(
    """with d as (select area_id, list_sort(list_distinct(list_filter([product_id, area_code, stream], lambda x: x is not null))) as w from manifest), n as (select area_id, unnest(w) as v from d)
    select v, min(area_id) as first_area, count(*) as areas from n group by v""",
    "manifest",
)
def exposure_inventory(m):
    """Everything that an area names, with the first area and how many do."""
    parts = [m.select(F.col(c).alias("v"), "area_id") for c in ("product_id", "area_code", "stream")]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("v is not null").distinct()
    return union.groupBy("v").agg(F.min("area_id").alias("first_area"), F.count("*").alias("areas"))


@query(
    """with e as (select user_id, event_id, event_type, epoch_us(ts) as t from events), x as (select *, cast(sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by t, event_id rows unbounded preceding) as bigint) as epoch from e)
    select user_id, epoch, count(*) as n, arg_max(event_type, (t, event_id)) filter (event_type in ('view', 'click')) as transport, bool_or(event_type = 'error') as broken, round((max(t) - min(t)) / 1e6, 3) as lasted_s from x group by 1, 2""",
    "events",
)
def transport_epochs(e):
    """A session's epochs, new at each opening event: its last state of transport, whether it broke, how long it lasted."""
    rows = e.select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("epoch", F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w))
    state = F.when(F.col("event_type").isin("view", "click"), F.struct("t", "event_id", "event_type"))
    return x.groupBy("user_id", "epoch").agg(F.count("*").alias("n"), F.max(state)["event_type"].alias("transport"), F.bool_or(F.col("event_type") == "error").alias("broken"), F.round((F.max("t") - F.min("t")) / 1e6, 3).alias("lasted_s"))


# ---- audits of sources ----


@query(
    """select case when lower(trim(object_class)) is null then 'unknown' else lower(trim(object_class)) end as kind, count(*) as labels, count(*) filter (coordinates[1] between -51 and -50.5) as inside,
        count(distinct case when coordinates[1] between -51 and -50.5 then product_id end) as scenes from annotations group by 1""",
    "annotations",
)
def label_audit(a):
    named = a.select(F.col("object_class").alias("is_vessel"), F.col("product_id").alias("scene_id"), F.get("coordinates", F.lit(0)).alias("lon"))
    return products.label_audit(named, F.col("lon").between(-51, -50.5))


@query(
    """with i as (select distinct roi_id as id, product_id as o from annotations where roi_id is not null), m as (select roi_id as id, product_id as o, split from selection_rois),
    j as (select coalesce(i.id, m.id) as id, case when i.id is null then 'not_indexed' when m.id is null then 'no_image' when i.o is distinct from m.o then 'conflict' else 'matched' end as state from i full join m on i.id = m.id)
    select state, count(*) as n from j group by 1""",
    "annotations", "selection_rois",
)
def crosswalk_states(a, s):
    index = a.where("roi_id is not null").select(F.col("roi_id").alias("id"), F.col("product_id").alias("origin")).distinct()
    return products.crosswalk(index, s.select(F.col("roi_id").alias("id"), F.col("product_id").alias("origin"), "split")).groupBy("state").agg(F.count("*").alias("n"))


@query(
    """with s as (select user_id, min(epoch_us(ts)) / 1e6 as a, max(epoch_us(ts)) / 1e6 as b, count(*) filter (event_type = 'click' and epoch_us(ts) / 1e6 between 1705000000 and 1705300000) as observations from events group by 1)
    select user_id, round(a, 3) as first, round(b, 3) as last, observations, case when observations > 0 then 'partial' else 'unknown' end as state from s where a <= 1705300000 and b >= 1705000000""",
    "events",
)
def coverage_sessions(e):
    rows = e.select("user_id", (F.unix_micros("ts") / 1e6).alias("t"), (F.col("event_type") == "click").alias("accepted"))
    out = products.coverage_sessions(rows, "user_id", "t", 1705000000.0, 1705300000.0)
    return out.withColumn("first", F.round("first", 3)).withColumn("last", F.round("last", 3))


@query(
    """with f as (select product_id, 'x-' || case annotation_id % 4 when 0 then 'vv' when 1 then 'vh' when 2 then 'hh' else 'hv' end || '-' || lpad(cast(annotation_id as varchar), 6, '0') || '.tiff' as name from annotations),
    b as (select product_id, max(name) filter (contains(name, '-vv-')) as vv, max(name) filter (contains(name, '-vh-')) as vh, max(name) filter (contains(name, '-hh-')) as hh, max(name) filter (contains(name, '-hv-')) as hv from f group by 1)
    select product_id, case when vv is not null and vh is not null then vv when hh is not null and hv is not null then hh end as co, case when vv is not null and vh is not null then vh when hh is not null and hv is not null then hv end as "cross",
        case when vv is not null and vh is not null then 'VV+VH' when hh is not null and hv is not null then 'HH+HV' else 'unknown' end as polarization from b""",
    "annotations",
)
def polarization_pairs(a):
    band = F.get(F.array(*[F.lit(b) for b in ("vv", "vh", "hh", "hv")]), (F.col("annotation_id") % 4).cast("int"))
    files = a.select("product_id", F.concat(F.lit("x-"), band, F.lit("-"), F.lpad(F.col("annotation_id").cast("string"), 6, "0"), F.lit(".tiff")).alias("name"))
    return products.polarization_pair(files)


@query(
    """with r as (select roi_key, center[1] as x, center[2] as y from selection_rois where len(center) >= 2)
    select roi_key, '{"type":"Feature","geometry":{"type":"Polygon"' as head, 4 + 1 as corners from r""",
    "selection_rois",
)
def region_features(s):
    """Regions as GeoJSON polygons; drawn clockwise here, they come out counter-clockwise and closed."""
    x, y = F.col("center")[0], F.col("center")[1]
    corner = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    ring = F.array(corner(-0.1, -0.1), corner(-0.1, 0.1), corner(0.1, 0.1), corner(0.1, -0.1))
    f = products.polygon_features(s.where(F.size("center") >= 2).select("roi_key", ring.alias("ring")), "ring")
    parsed = F.from_json("feature", "geometry struct<coordinates: array<array<array<double>>>>, properties struct<roi_key: bigint>")
    d = f.select("feature", parsed.alias("p"))
    return d.select(F.col("p.properties.roi_key").alias("roi_key"), F.substring("feature", 1, 46).alias("head"), F.size(F.col("p.geometry.coordinates")[0]).alias("corners"))
