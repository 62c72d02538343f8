"""Queries that hold detections against truths; each whole, each beside its SQL.

Lines of orders stand for features and orders for truths, as the test tables hold no detections: a line is near its own order
only, an order near several lines, so that the best assignment can be said in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.operators import evaluation, proximity
from pelorus.plans.survey_queries import _BINOMIAL, _HAV, query

_FEATURES = """
    select l_suppkey % 40 as case_id, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as feature_id, l_orderkey as order_id, 0.01 + l_discount * 9 as score, l_linestatus = 'F' as on_water,
        case when l_linestatus = 'F' then 'water' when l_quantity < 40 then 'land' end as surface, case when l_quantity > 2 then l_quantity * 20 end as shore_m, l_tax * 100 + l_linenumber / 100.0 + l_partkey / 1e8 as distance_m from lineitem
"""
_TRUTHS = f"select distinct case_id, order_id as truth_id from ({_FEATURES}) where order_id % 3 = 0"
_THRESHOLDS = [0.15, 0.35, 0.55]


def _features(l: DataFrame) -> DataFrame:  # noqa: E741
    water = F.col("l_linestatus") == "F"
    return l.select(
        (F.col("l_suppkey") % 40).alias("case_id"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("feature_id"), F.col("l_orderkey").alias("order_id"),
        (F.lit(0.01) + F.col("l_discount") * 9).alias("score"), water.alias("on_water"), F.when(water, "water").when(F.col("l_quantity") < 40, "land").alias("surface"),
        F.when(F.col("l_quantity") > 2, F.col("l_quantity") * 20).alias("shore_m"), (F.col("l_tax") * 100 + F.col("l_linenumber") / 100.0 + F.col("l_partkey") / 1e8).alias("distance_m"),
    )


def _parts(l: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: E741
    f = _features(l)
    return f, f.where("order_id % 3 = 0").select("case_id", F.col("order_id").alias("truth_id")).distinct(), f.where("order_id % 3 = 0").select("case_id", "feature_id", F.col("order_id").alias("truth_id"), "distance_m")


_SCORES = f"""with f as materialized ({_FEATURES}), t as ({_TRUTHS}), th as (select unnest([0.15, 0.35, 0.55]) as threshold), c as (select s_suppkey as case_id, case when s_acctbal > 0 then s_acctbal / 100 end as km2 from supplier where s_suppkey < 40),
    kept as (select * from f, th where score > threshold), n as (select case_id, threshold, count(*) as kept, count(*) filter (on_water) as wet from kept group by 1, 2),
    m as (select case_id, threshold, order_id, arg_min(on_water, distance_m) as on_water from kept where order_id % 3 = 0 group by 1, 2, 3), h as (select case_id, threshold, count(*) as tp, count(*) filter (on_water) as wet_hits from m group by 1, 2),
    v as (select case_id, count(*) as vessels from t group by 1),
    o as (select c.case_id, threshold, km2, coalesce(tp, 0) as tp, coalesce(wet_hits, 0) as wet_hits, coalesce(kept, 0) as kept, coalesce(wet, 0) as wet, coalesce(vessels, 0) as vessels from c cross join th left join n using (case_id, threshold) left join h using (case_id, threshold) left join v using (case_id))
    select case_id, threshold, tp, kept - tp as fp, vessels - tp as fn, wet - wet_hits as wet_alarms, round(tp / nullif(kept, 0), 6) as precision, round(tp / nullif(vessels, 0), 6) as recall, round((wet - wet_hits) / km2, 6) as alarms_km2 from o"""


@query(_SCORES, "lineitem", "supplier")
def case_scores(l, s):  # noqa: E741
    out = _case_scores(l, s)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "alarms_km2")})


def _case_scores(l: DataFrame, s: DataFrame) -> DataFrame:  # noqa: E741
    f, t, p = _parts(l)
    cases = s.where("s_suppkey < 40").select(F.col("s_suppkey").alias("case_id"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 100).alias("water_km2"))
    return evaluation.score_cases(f, t, p, cases, _THRESHOLDS, 0.01)


@query(
    f"""with recursive m as materialized (select case_id, threshold, tp as k, tp + fn as n from ({_SCORES})),
    s as (select *, 0 as step, 1e-12 as la, 1 - 1e-12 as lb, 1e-12 as ha, 1 - 1e-12 as hb from m where n > 0
        union all select case_id, threshold, k, n, step + 1, case when k > 0 and {_BINOMIAL.format(a="k", b="n + 1", p="((la + lb) / 2)")} < 0.025 then (la + lb) / 2 else la end, case when k > 0 and {_BINOMIAL.format(a="k", b="n + 1", p="((la + lb) / 2)")} < 0.025 then lb else (la + lb) / 2 end,
            case when k < n and {_BINOMIAL.format(a="0", b="k + 1", p="((ha + hb) / 2)")} > 0.025 then (ha + hb) / 2 else ha end, case when k < n and {_BINOMIAL.format(a="0", b="k + 1", p="((ha + hb) / 2)")} > 0.025 then hb else (ha + hb) / 2 end from s where step < 36)
    select m.case_id, m.threshold, m.k as tp, m.n - m.k as fn, round(case when m.k = 0 and m.n > 0 then 0 else (la + lb) / 2 end, 5) as recall_low, round(case when m.k = m.n and m.n > 0 then 1 else (ha + hb) / 2 end, 5) as recall_high
    from m left join (select * from s where step = 36) s using (case_id, threshold)""",
    "lineitem", "supplier",
)
def case_intervals(l, s):  # noqa: E741
    return evaluation.with_intervals(_case_scores(l, s)).select("case_id", "threshold", "tp", "fn", F.round("recall_low", 5).alias("recall_low"), F.round("recall_high", 5).alias("recall_high"))


@query(None, "lineitem", "supplier", "nation")
def threshold_choice(l, s, n):  # noqa: E741
    m = _case_scores(l, s).join(s.select(F.col("s_suppkey").alias("case_id"), F.col("s_nationkey").alias("n_nationkey"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 100).alias("water_km2")), "case_id")
    m = m.join(n.select("n_nationkey", F.col("n_regionkey").alias("region")), "n_nationkey")
    out = evaluation.choose_threshold(m, ["region"], 30, 2, 0.05, 1000.0)
    return out.select("threshold", F.array_join("blockers", ",").alias("blockers"), F.round("recall", 6).alias("recall"), "winner")


@query(
    f"""with f as materialized ({_FEATURES}), t as ({_TRUTHS}), b as (select unnest([0.0, 200.0, 500.0]) as buffer_m), p as (select * from f where order_id % 3 = 0),
    raw as (select case_id, count(distinct order_id) as raw from p group by 1), o as (select * from f, b where surface = 'water' and shore_m > buffer_m),
    n as (select case_id, buffer_m, count(*) as features from o group by 1, 2), e as (select case_id, buffer_m, count(distinct order_id) as eligible from o where order_id % 3 = 0 group by 1, 2),
    k as (select case_id, bool_and(surface is not null and shore_m is not null) as measured from f group by 1), v as (select case_id, count(*) as vessels from t group by 1)
    select case_id, buffer_m, coalesce(vessels, 0) as vessels, coalesce(features, 0) as features, coalesce(raw, 0) as raw, coalesce(eligible, 0) as eligible, coalesce(raw, 0) - coalesce(eligible, 0) as added_misses, measured
    from k cross join b left join v using (case_id) left join raw using (case_id) left join n using (case_id, buffer_m) left join e using (case_id, buffer_m)""",
    "lineitem",
)
def buffer_sweep(l):  # noqa: E741
    f, t, p = _parts(l)
    return evaluation.buffer_sweep(f, t, p, [0.0, 200.0, 500.0, 200.0])


_CASES = """
    select s_suppkey as case_id, n_regionkey as region, case when s_suppkey % 2 = 0 then 'HH' else 'VV' end as polarization, case when s_suppkey % 97 <> 5 then 100 + abs(s_acctbal) / 50 end as water_km2,
        abs(s_acctbal) / 100 as covered_km2, s_acctbal > 500 as measured from supplier join nation on n_nationkey = s_nationkey
"""


@query(
    f"""with c as ({_CASES}), d as (select 'all' as dimension, '' as value, * from c union all select 'region', cast(region as varchar), * from c union all select 'polarization', polarization, * from c),
    a as (select dimension, value, count(*) as cases, count(*) filter (measured) as measured, case when count(*) = count(water_km2) then sum(water_km2) end as water_km2,
        case when count(*) = count(water_km2) then coalesce(sum(covered_km2) filter (measured), 0) end as covered_km2 from d group by 1, 2)
    select dimension, value, cases, measured, round(water_km2, 3) as water_km2, round(covered_km2, 3) as covered_km2, round(covered_km2 / water_km2, 6) as share from a""",
    "supplier", "nation",
)
def coverage_by_stratum(s, n):
    c = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("n_regionkey").alias("region"), F.when(F.col("s_suppkey") % 2 == 0, "HH").otherwise("VV").alias("polarization"),
        F.when(F.col("s_suppkey") % 97 != 5, F.lit(100) + F.abs("s_acctbal") / 50).alias("water_km2"), (F.abs("s_acctbal") / 100).alias("covered_km2"), (F.col("s_acctbal") > 500).alias("measured"),
    )
    out = evaluation.coverage_sums(c, ["region", "polarization"])
    return out.withColumns({"water_km2": F.round("water_km2", 3), "covered_km2": F.round("covered_km2", 3), "share": F.round("share", 6)})


@query(
    """with t as (select l_returnflag as regime, l_quantity * 2.2 as length_m, case when l_linestatus = 'F' then 'water' when l_tax > 0.02 then 'land' end as surface, l_discount * 9000 as shore_m,
        l_partkey % 3 = 0 as matched, l_partkey % 6 = 0 as eligible from lineitem),
    x as (select *, case when coalesce(surface <> 'water', true) then 'land_or_shoreline_mismatch' when shore_m <= 300 then 'harbour_coastal' else 'open_water' end as place,
        case when length_m < 20 then '0-20' when length_m < 50 then '20-50' when length_m < 100 then '50-100' else '100-100000' end as band from t)
    select regime, place, band, count(*) as vessels, count(*) filter (matched) as found, count(*) filter (eligible) as found_eligible, count(*) filter (length_m >= 50) as resolvable,
        round(count(*) filter (matched) / count(*), 4) as recall, round(count(*) filter (eligible) / count(*), 4) as recall_eligible from x group by 1, 2, 3""",
    "lineitem",
)
def subset_recall(l):  # noqa: E741
    t = l.select(
        F.col("l_returnflag").alias("regime"), (F.col("l_quantity") * 2.2).alias("length_m"), F.when(F.col("l_linestatus") == "F", "water").when(F.col("l_tax") > 0.02, "land").alias("surface"),
        (F.col("l_discount") * 9000).alias("shore_m"), (F.col("l_partkey") % 3 == 0).alias("matched"), (F.col("l_partkey") % 6 == 0).alias("eligible_match"),
    )
    return evaluation.subset_recall(t, ["regime"])


_LABELS = ("matched", "no_association", "ambiguous", "unresolved")


@query(
    """with t as (select l_returnflag as regime, ['matched', 'no_association', 'ambiguous', 'unresolved'][1 + l_partkey % 4] as label, l_suppkey % 5 <> 0 as correct, l_quantity > 10 as predicted, l_linenumber > 4 as ambiguous from lineitem),
    x as (select *, predicted and not ambiguous as accepted from t)
    select regime, count(*) as targets, count(*) filter (accepted) as accepted, count(*) filter (predicted and ambiguous) as held_back, count(*) filter (label = 'matched' and accepted and correct) as right,
        count(*) filter (label = 'matched' and accepted and not correct) as wrong, count(*) filter (label = 'matched' and not accepted) as missed, count(*) filter (label = 'no_association' and accepted) as false_association,
        count(*) filter (label = 'no_association' and not accepted) as right_refusal, count(*) filter (label = 'ambiguous' and accepted) as unsafe, count(*) filter (label = 'unresolved') as unresolved from x group by 1""",
    "lineitem",
)
def identity_counts(l):  # noqa: E741
    label = F.get(F.array(*[F.lit(x) for x in _LABELS]), (F.col("l_partkey") % 4).cast("int"))
    t = l.select(F.col("l_returnflag").alias("regime"), label.alias("label"), (F.col("l_suppkey") % 5 != 0).alias("correct"), (F.col("l_quantity") > 10).alias("predicted"), (F.col("l_linenumber") > 4).alias("ambiguous"))
    return evaluation.identity_counts(t, ["regime"])


@query(
    """with t as (select l_returnflag as regime, least(1, l_discount * 10) as p, l_quantity > 25 as y from lineitem)
    select regime, count(*) as n, count(*) filter (y and p >= 0.5) as tp, count(*) filter (not y and p >= 0.5) as fp, count(*) filter (y and p < 0.5) as fn, count(*) filter (not y and p < 0.5) as tn,
        round(avg(case when y then -ln(greatest(1e-7, least(1 - 1e-7, p))) else -ln(1 - greatest(1e-7, least(1 - 1e-7, p))) end), 6) as log_loss, round(avg(pow(p - cast(y as int), 2)), 6) as brier,
        round((count(*) filter (y = (p >= 0.5))) / count(*), 6) as accuracy from t group by 1""",
    "lineitem",
)
def binary_metrics(l):  # noqa: E741
    t = l.select(F.col("l_returnflag").alias("regime"), F.least(F.lit(1.0), F.col("l_discount") * 10).alias("p"), (F.col("l_quantity") > 25).alias("y"))
    out = evaluation.binary_metrics(t, ["regime"], F.col("p"), F.col("y"))
    return out.withColumns({c: F.round(c, 6) for c in ("log_loss", "brier", "accuracy")})


@query(
    f"""with a as (select annotation_id as id, roi_id, coordinates[2] as lat, coordinates[1] as lon from annotations where len(coordinates) >= 2 and abs(coordinates[2]) <= 90)
    select a.roi_id as scene_id, count(*) as pairs, count(*) filter (a.roi_id = b.roi_id) as positive, count(distinct a.id) as targets from a join a b on a.id <> b.id and abs(a.lat - b.lat) < 0.02 and {_HAV} <= 2000 group by 1""",
    "annotations",
)
def reviewed_pairs(a):
    """Pairs of objects within 2 km, and those whose other object is of the same region by its label."""
    p = lambda k: proximity.points(a, F.struct("annotation_id", "roi_id"), F.get("coordinates", F.lit(1)), F.get("coordinates", F.lit(0)), k)
    near = proximity.within_distance(p("l"), p("r"), 2000.0).where(F.col("l_id.annotation_id") != F.col("r_id.annotation_id"))
    pairs = near.select(F.col("l_id.roi_id").alias("scene_id"), F.col("l_id.annotation_id").alias("target_id"), F.col("r_id.annotation_id").alias("other_id"))
    members = a.where("roi_id is not null").groupBy("roi_id").agg(F.collect_set("annotation_id").alias("others"))
    return evaluation.pair_counts(pairs, a.join(members, "roi_id").select(F.col("annotation_id").alias("target_id"), "others"))
