"""The SQL that each query of this folder is checked by, where SQL can say it."""

from pelorus.llm.quality import COMMON_SHARE, LANGUAGE_DOCUMENTS, LANGUAGE_SHARE

_AREAS = """
    select area_id, split, geographic_group, native_acquisition_group, product_name,
        try_cast(nullif(regexp_replace(regexp_replace(regexp_replace(upper(trim(support_user_id)), '^MMSI\\s*', ''), '\\.0*$', ''), '\\s', '', 'g'), '') as bigint) as vessel,
        case when regexp_full_match(trim(reference_midpoint_utc), '\\d+(\\.\\d+)?')
             then cast(round(try_cast(trim(reference_midpoint_utc) as decimal(38, 9)) * 1000000) as bigint)
             else epoch_us(try_cast(regexp_replace(regexp_replace(case when regexp_matches(reference_midpoint_utc, '(Z|[+-]\\d\\d:?\\d\\d( UTC)?)$')
                then reference_midpoint_utc else reference_midpoint_utc || 'Z' end, ' UTC$', ''), ' ([+-]\\d\\d)(\\d\\d)$', '\\1:\\2') as timestamptz)) end as mid
    from manifest
"""

_CHAINS = """
    with recursive area as (
        select area_id, case lower(trim(split)) when 'training' then 'train' when 'valid' then 'validation' when 'val' then 'validation' else lower(trim(split)) end as split,
            list_concat(
                list_transform(list_filter(string_split(lower(coalesce(geographic_group, '')), '+'), lambda x: trim(x) <> ''), lambda x: 'g' || replace(trim(x), ' ', '_')),
                list_filter(['a' || coalesce(replace(upper(trim(native_acquisition_group)), '-', '_'),
                    nullif(regexp_replace(product_name, '^(S1.)_.*_(\\d{6})_([0-9A-F]{6})_.*$', '\\1_\\2_\\3'), ''))], lambda x: x is not null)) as groups
        from manifest),
    named as (select distinct area_id, unnest(groups) as g from area),
    near as (select distinct a.g as x, b.g as y from named a join named b using (area_id)),
    reach(x, y) as (select x, y from near union select r.x, n.y from reach r join near n on r.y = n.x),
    label as (select x as g, min(y) as label from reach group by x),
    comp as (select a.area_id, a.split, coalesce(min(l.label), 'record:' || a.area_id) as component
        from area a left join named n using (area_id) left join label l on l.g = n.g group by a.area_id, a.split)
"""

SQL = {
    "p2_found": f"""
        with a as ({_AREAS}), m as (
            select a.area_id, r.report_id, row_number() over (partition by a.area_id
                order by abs(epoch_us(r.time_utc) - a.mid), epoch_us(r.time_utc), r.report_id) as n
            from a join position_reports r on r.user_id = a.vessel and abs(epoch_us(r.time_utc) - a.mid) <= 300000000
            where a.vessel between 100000000 and 999999999)
        select area_id, report_id from m where n = 1
    """,
    "p2_offsets": f"""
        with a as ({_AREAS}), m as (
            select a.area_id, r.report_id, (epoch_us(r.time_utc) - a.mid) / 1e6 as off, row_number() over (partition by a.area_id
                order by abs(epoch_us(r.time_utc) - a.mid), epoch_us(r.time_utc), r.report_id) as n
            from a join position_reports r on r.user_id = a.vessel and abs(epoch_us(r.time_utc) - a.mid) <= 300000000
            where a.vessel between 100000000 and 999999999)
        select m.area_id, m.report_id, m.off as offset_s, abs(m.off) as absolute_offset_s, f.absolute_offset_s as stated_offset_s,
            coalesce(abs(abs(m.off) - f.absolute_offset_s) > 0.001, true) as corrected
        from m join manifest f on f.area_id = m.area_id where n = 1
    """,
    "p4_found": _CHAINS + "select area_id from comp where component in (select component from comp group by component having count(distinct split) > 1)",
    "p4_balance": _CHAINS + "select count(*) as areas, count(distinct component) as components, 0::bigint as mixed, true as balanced from comp",
    "p10_statistics": f"""
        with d as (select doc_id, lang, coalesce(text, '') as t from documents),
        k as (select doc_id, lang, t, list_filter(string_split_regex(regexp_replace(lower(t), '[^\\p{{L}}''’\\n]+', ' ', 'g'), '[ \\n]'), lambda x: x <> '') as spoken from d),
        big as (select lang, count(*) as n from d where t <> '' and lang is not null group by 1 having count(*) >= greatest({LANGUAGE_DOCUMENTS}, {LANGUAGE_SHARE} * (select count(*) from d where t <> ''))),
        g as (select case when (select count(*) from big) > 0 then lang else '' end as lang, spoken from k where t <> '' and ((select count(*) from big) = 0 or lang in (select lang from big))),
        size as (select lang, ceil({COMMON_SHARE} * count(*)) as least from g group by 1),
        common as (select distinct w from (select lang, w, count(*) as c from (select lang, unnest(list_distinct(spoken)) as w from g) group by 1, 2) join size using (lang) where c >= least),
        c as (select k.doc_id, count(*) as n from (select doc_id, unnest(spoken) as w from k) k join common using (w) group by 1),
        w as (select doc_id, t, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') as words,
            list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r\\x{{00a0}}>]+', '')), lambda x: x <> '') as lines from d)
        select doc_id, len(words) as words,
            round(coalesce(list_sum(list_transform(words, lambda x: length(x))) / nullif(len(words), 0), 0), 6) as mean_word_length,
            round(coalesce(length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\s]+', '', 'g')) / nullif(length(t), 0), 0), 6) as symbol_ratio,
            round(coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…:;][ \\t\\r\\x{{00a0}}")\\]»”’'']*$'))) / nullif(len(lines), 0), 0), 6) as punctuated_line_share,
            round(coalesce(c.n, 0) / greatest(len(words), 1), 6) as common_word_share
        from w left join c using (doc_id)
    """,
}
