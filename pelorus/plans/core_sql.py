"""The SQL that each query of core_queries.py is checked by, where SQL can say it."""

_POINT = """
    select {id} as id, ((({lon}) % 360) + 360) % 360 as lon, {lat} as lat from {table}
    where {lat} is not null and {lon} is not null and not isnan({lat}) and not isnan({lon}) and abs({lat}) <= 90
"""
_NEAR = """
    2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
        + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 300
"""
_A = _POINT.format(id="annotation_id", lon="coordinates[1]", lat="coordinates[2]", table="annotations")
_R = _POINT.format(id="report_id", lon="longitude", lat="latitude", table="position_reports")
_B = _POINT.format(id="roi_key", lon="center[1]", lat="center[2]", table="selection_rois")

SQL = {
    "p1_found": f"""
        with a as ({_A}), r as ({_R}), b as (select p.*, 5.0 * s.size_px as half from ({_B}) p join selection_rois s on s.roi_key = p.id)
        select 'annotation' as kind, a.id as left_id, b.id as right_id from a join a b on a.id < b.id and abs(a.lat - b.lat) < 0.01 and {_NEAR}
        union all
        select 'report', a.id, b.id from a join r b on abs(a.lat - b.lat) < 0.01 and {_NEAR}
        union all
        select 'roi', a.id, b.id from a join b on 6371008.8 * radians(abs(a.lat - b.lat)) <= b.half
            and 6371008.8 * cos(radians(b.lat)) * radians(abs(((a.lon - b.lon + 180) % 360 + 360) % 360 - 180)) <= b.half
    """,
    "p5_found": """
        with v as (select file_id, feed, file_no, payload ->> '$.id' as area, e.key as field, e.type as t,
                case when e.type = 'NULL' then null else cast(e.value as varchar) end as raw
            from release_rows, json_each(payload) e where json_valid(payload) and json_type(payload) = 'OBJECT'),
        k as (select *, case when t in ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') then 'number' when t = 'VARCHAR' then 'string' when t = 'NULL' then null else lower(t) end as kind from v),
        ff as (select file_id, field, arg_max(kind, n) as kind from (select file_id, field, kind, case when kind is null then -1 else count(*) end as n from k group by 1, 2, 3) group by 1, 2),
        f as (select file_id, lag(file_id) over (partition by feed order by file_no, file_id) as prev_id from (select distinct feed, file_no, file_id from release_rows)),
        ord as (select * from f where prev_id is not null),
        now as (select ord.file_id, ff.field, ff.kind from ff join ord using (file_id)),
        prev as (select ord.file_id, ff.field, ff.kind from ff join ord on ff.file_id = ord.prev_id),
        added as (select file_id, field from now where field <> 'id' except select file_id, field from prev),
        removed as (select file_id, field from prev where field <> 'id' except select file_id, field from now),
        common as (select distinct ord.file_id, a.area from ord join k a on a.file_id = ord.file_id join k b on b.file_id = ord.prev_id and a.area = b.area),
        new as (select k.file_id, k.area, k.field, k.raw from k join added using (file_id, field) join common using (file_id, area) where raw is not null),
        old as (select r.file_id, k.area, k.field, k.raw from removed r join ord using (file_id) join k on k.file_id = ord.prev_id and k.field = r.field join common c on c.file_id = r.file_id and c.area = k.area where raw is not null),
        same as (select old.file_id, old.field as o, new.field as n, count(*) as c from old join new on old.file_id = new.file_id and old.area = new.area and old.raw = new.raw group by 1, 2, 3),
        fit as (select s.*, levenshtein(o, n) as gap from same s where c = (select count(*) from old where old.file_id = s.file_id and old.field = s.o)
            and c = (select count(*) from new where new.file_id = s.file_id and new.field = s.n)),
        ren as (select file_id, o, n from (select *, row_number() over (partition by file_id, o order by gap, n) as a, row_number() over (partition by file_id, n order by gap, o) as b from fit) where a = 1 and b = 1)
        select file_id, 'retyped' as change, field as old_field, field as new_field from now join prev using (file_id, field) where field <> 'id' and now.kind <> prev.kind
        union all select file_id, 'renamed', o, n from ren
        union all select file_id, 'added', '', field from added a where not exists (select 1 from ren where ren.file_id = a.file_id and ren.n = a.field)
        union all select file_id, 'removed', field, '' from removed r where not exists (select 1 from ren where ren.file_id = r.file_id and ren.o = r.field)
    """,
    "p5_paths": """
        with recursive r(feed, file_no, file_id, path, j, depth) as (
            select feed, file_no, file_id, '$', cast(payload as json), 0 from release_rows where json_valid(payload) and json_type(payload) = 'OBJECT'
            union all select r.feed, r.file_no, r.file_id, r.path || case when json_type(r.j) = 'ARRAY' then '[*]' else '.' || e.key end, cast(e.value as json), r.depth + 1
            from r, json_each(r.j) e where json_type(r.j) in ('ARRAY', 'OBJECT')),
        k as (select *, json_type(j) as t from r where depth > 0)
        select feed, file_no, file_id, path, case when t in ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') then 'number' when t = 'VARCHAR' then 'string' when t = 'NULL' then null else lower(t) end as kind, count(*) as n from k group by 1, 2, 3, 4, 5
    """,
    "p6_areas": """
        with d as (select record_id, cast(payload as json) as j from collection_records where json_valid(payload)),
        b as (select record_id, case when json_type(j, '$.collection') = 'OBJECT' then j -> '$.collection' when json_type(j, '$.annotation_decisions') = 'OBJECT' then j -> '$.annotation_decisions' else j end as j from d where json_type(j) = 'OBJECT'),
        e as (select record_id, unnest(case json_type(j, '$.areas') when 'ARRAY' then range(0, json_array_length(j, '$.areas')::bigint) when 'OBJECT' then range(0, len(json_keys(j, '$.areas'))::bigint) else [] end) as n, j from b),
        a as (select record_id, n, case json_type(j, '$.areas') when 'OBJECT' then json_keys(j, '$.areas')[n + 1] end as name, case json_type(j, '$.areas') when 'ARRAY' then json_extract(j, '$.areas[' || n || ']') else json_extract(j, '$.areas."' || json_keys(j, '$.areas')[n + 1] || '"') end as v from e)
        select record_id, record_id || '/area:' || n as pk, cast(record_id as varchar) as parent_pk, coalesce(v ->> '$.id', v ->> '$.roi_id', name) as area_id, v ->> '$.product_id' as product_id, v ->> '$.split' as split, v ->> '$.notes' as notes,
            case when json_type(v, '$.prior_datatake_exposure') = 'BOOLEAN' then cast(v ->> '$.prior_datatake_exposure' as boolean) end as prior_datatake_exposure, try_cast(v ->> '$.source_coverage.all_scenarios_complete' as boolean) as all_scenarios_complete from a
    """,
    "p6_found": """
        with d as (select record_id, cast(payload as json) as j from collection_records where json_valid(payload)),
        b as (select record_id, case when json_type(j, '$.collection') = 'OBJECT' then j -> '$.collection' when json_type(j, '$.annotation_decisions') = 'OBJECT' then j -> '$.annotation_decisions' else j end as j from d where json_type(j) = 'OBJECT'),
        a as (select record_id, coalesce(e.value ->> '$.id', e.value ->> '$.roi_id', case when json_type(j, '$.areas') = 'OBJECT' then e.key end) as area_id, e.value as v
            from b, json_each(j, '$.areas') e where json_type(j, '$.areas') in ('ARRAY', 'OBJECT') and e.type = 'OBJECT'),
        o as (select record_id, area_id, case when json_type(v, '$.objects') = 'VARCHAR' and json_valid(v ->> '$.objects') then cast(v ->> '$.objects' as json) else v -> '$.objects' end as o, v from a),
        m as (select record_id, area_id, e.value as x, coalesce(e.value ->> '$.id', case when json_type(o) = 'OBJECT' then e.key end) as id from o, json_each(o) e
                where json_type(o) = 'ARRAY' or (json_type(o) = 'OBJECT' and json_type(o, '$.id') is distinct from 'VARCHAR')
            union all select record_id, area_id, o, o ->> '$.id' from o where json_type(o) = 'OBJECT' and json_type(o, '$.id') = 'VARCHAR'),
        s as (select record_id, area_id, coalesce(e.value ->> '$.name', e.key) as id from o, json_each(v, '$.source_coverage.scenarios') e where json_type(v, '$.source_coverage.scenarios') in ('ARRAY', 'OBJECT'))
        select distinct record_id, area_id, 'object' as child_kind, id as child_id from m where id is not null and area_id is not null
        union all select distinct record_id, area_id, 'decision', id from m where id is not null and area_id is not null and json_type(x, '$.decision') <> 'NULL'
        union all select distinct record_id, area_id, 'scenario', id from s where area_id is not null
    """,
}
