"""Detections held against truths: matched anew under each threshold or buffer, counted by case and stratum.

Defined cases: a ratio over nothing is null, and so is a rate over no known area; a score must be above a threshold, not
at it; a null score, surface or distance never passes; cases without features or truths still have a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.operators.alignment import one_to_one
from pelorus.operators.statistics import share_interval

#: Places of reported vessels (fixed values of the report).
PLACES = ("land_or_shoreline_mismatch", "harbour_coastal", "open_water")
#: Bands of length in metres.
BANDS = ((0, 20), (20, 50), (50, 100), (100, 100_000))


def rematched(pairs: DataFrame, variant: str) -> DataFrame:
    """The chosen pairs of each case and variant: as many as can be, each feature and truth once, nearest overall.

    pairs: case_id, feature_id, truth_id, distance_m and the variant's column.
    """
    chosen = one_to_one(pairs, ["case_id", variant], "feature_id", "truth_id", "distance_m")
    return chosen.where("selected").drop("selected")


def score_cases(features: DataFrame, truths: DataFrame, pairs: DataFrame, cases: DataFrame, thresholds: list[float], floor: float) -> DataFrame:
    """Per case and threshold: tp, fp, fn, false alarms on water, precision, recall and false alarms a square kilometre.

    features: case_id, feature_id, score, on_water, every score in (floor, 1]. truths: case_id, truth_id. cases: case_id, water_km2.
    """
    if not all(0 < floor <= t < 1 for t in thresholds):
        raise ValueError("thresholds must lie from the floor to below 1")
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    kept = features.withColumn("threshold", F.explode(levels)).where(F.col("score") > F.col("threshold"))
    candidates = pairs.join(kept.select("case_id", "feature_id", "threshold", "on_water"), ["case_id", "feature_id"])
    hit = rematched(candidates.select("case_id", "threshold", "feature_id", "truth_id", "distance_m", "on_water"), "threshold")
    tp = hit.groupBy("case_id", "threshold").agg(F.count("*").alias("tp"), F.count_if("on_water").alias("wet_hits"))
    n = kept.groupBy("case_id", "threshold").agg(F.count("*").alias("kept"), F.count_if("on_water").alias("wet"))
    vessels = truths.groupBy("case_id").agg(F.count("*").alias("vessels"))
    out = cases.select("case_id", "water_km2", F.explode(levels).alias("threshold")).join(n, ["case_id", "threshold"], "left").join(tp, ["case_id", "threshold"], "left").join(vessels, "case_id", "left")
    out = out.na.fill(0, ["tp", "wet_hits", "kept", "wet", "vessels"])
    area = F.when(F.col("water_km2") > 0, F.col("water_km2"))
    return out.select(
        "case_id", "threshold", "tp", (F.col("kept") - F.col("tp")).alias("fp"), (F.col("vessels") - F.col("tp")).alias("fn"), (F.col("wet") - F.col("wet_hits")).alias("wet_alarms"),
        F.try_divide("tp", "kept").alias("precision"), F.try_divide("tp", "vessels").alias("recall"), F.try_divide(F.col("wet") - F.col("wet_hits"), area).alias("alarms_km2"),
    )


def with_intervals(metrics: DataFrame) -> DataFrame:
    """metrics with the exact interval of the recall."""
    return metrics.withColumn("_i", share_interval(F.col("tp"), F.col("tp") + F.col("fn"))).select(*metrics.columns, F.col("_i.low").alias("recall_low"), F.col("_i.high").alias("recall_high"))


def buffer_sweep(features: DataFrame, truths: DataFrame, pairs: DataFrame, buffers: list[float]) -> DataFrame:
    """Per case and buffer: matches of all features, of those eligible, and the misses that the policy adds.

    features: case_id, feature_id, surface, shore_m (null: unknown; infinite: no coast in reach). Matched anew for each buffer,
    as a feature that is left out frees its truth for another.
    """
    raw = rematched(pairs.withColumn("buffer_m", F.lit(0.0)), "buffer_m").groupBy("case_id").agg(F.count("*").alias("raw"))
    each = features.withColumn("buffer_m", F.explode(F.array(*[F.lit(float(b)) for b in dict.fromkeys(buffers)])))
    open_ = each.where((F.col("surface") == "water") & (F.col("shore_m") > F.col("buffer_m")))
    hit = rematched(pairs.join(open_.select("case_id", "feature_id", "buffer_m"), ["case_id", "feature_id"]), "buffer_m").groupBy("case_id", "buffer_m").agg(F.count("*").alias("eligible"))
    n = open_.groupBy("case_id", "buffer_m").agg(F.count("*").alias("features"))
    known = features.groupBy("case_id").agg(F.min((F.col("surface").isNotNull() & F.col("shore_m").isNotNull())).alias("measured"))
    vessels = truths.groupBy("case_id").agg(F.count("*").alias("vessels"))
    grid = known.join(vessels, "case_id", "full").withColumn("buffer_m", F.explode(F.array(*[F.lit(float(b)) for b in dict.fromkeys(buffers)])))
    out = grid.join(raw, "case_id", "left").join(n, ["case_id", "buffer_m"], "left").join(hit, ["case_id", "buffer_m"], "left").na.fill(0, ["raw", "features", "eligible", "vessels"])
    return out.select("case_id", "buffer_m", "vessels", "features", "raw", "eligible", (F.col("raw") - F.col("eligible")).alias("added_misses"), F.coalesce("measured", F.lit(True)).alias("measured"))


def by_dimension(rows: DataFrame, dimensions: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by each dimension on its own, and over all: dimension, value, …; one pass over the rows."""
    named = [F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value"))]
    named += [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dimensions]
    spread = rows.withColumn("_d", F.explode(F.array(*named)))
    return spread.groupBy(F.col("_d.dimension").alias("dimension"), F.col("_d.value").alias("value")).agg(*aggregates)


def coverage_sums(cases: DataFrame, dimensions: list[str]) -> DataFrame:
    """Area-weighted coverage of cases (water_km2, covered_km2, measured) by stratum; one unknown area makes all three unknown."""
    known = F.min(F.col("water_km2").isNotNull())
    total = lambda c: F.when(known, F.sum(F.coalesce(c, F.lit(0.0))))
    measured = F.when(F.col("measured"), F.col("covered_km2"))
    out = by_dimension(cases, dimensions, F.count("*").alias("cases"), F.count_if("measured").alias("measured"), total(F.col("water_km2")).alias("water_km2"), total(measured).alias("covered_km2"))
    return out.withColumn("share", F.try_divide("covered_km2", "water_km2"))


def choose_threshold(metrics: DataFrame, dimensions: list[str], least_vessels: int, least_cases: int, least_recall: float, most_alarms_km2: float, alpha: float = 0.05) -> DataFrame:
    """Per threshold its blockers over all strata, in order, and whether it is the winner.

    metrics: case_id, threshold, tp, fn, wet_alarms, water_km2 and the dimensions. In each stratum there must be
    enough vessels and cases, the lower bound of the exact recall interval at alpha / (2 k) (k strata) must reach least_recall and
    false alarms stay below most_alarms_km2. Of thresholds without blockers the one of the highest recall wins, then of the fewest
    alarms, then the lowest.
    """
    from pyspark.sql.functions import pandas_udf

    from pelorus.operators.statistics import binomial_interval

    named = [F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value"))]
    named += [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dimensions]
    sums = metrics.withColumn("_d", F.explode(F.array(*named))).groupBy("threshold", "_d.dimension", "_d.value").agg(
        F.sum("tp").alias("tp"), F.sum(F.col("tp") + F.col("fn")).alias("vessels"), F.countDistinct("case_id").alias("cases"), F.sum("wet_alarms").alias("alarms"), F.sum("water_km2").alias("km2")
    )
    k = sums.groupBy("threshold").agg(F.count("*").alias("k"))
    rows = sums.join(F.broadcast(k), "threshold")  # one row a threshold

    @pandas_udf("double")
    def low(tp, n, strata):  # noqa: ANN001
        out = tp.astype(float)
        for s, at in strata.groupby(strata).indices.items():
            out.iloc[at] = binomial_interval(tp.iloc[at], n.iloc[at], alpha / s)[0]
        return out

    rows = rows.withColumn("low", F.nanvl(low(F.col("tp"), F.col("vessels"), F.col("k")), F.lit(None)))
    rate = F.try_divide("alarms", "km2")
    why = F.array_compact(
        F.array(
            F.when(F.col("vessels") < least_vessels, "few_vessels"), F.when(F.col("cases") < least_cases, "few_cases"),
            F.when(F.coalesce(F.col("low") < least_recall, F.lit(True)), "recall"), F.when(F.coalesce(rate > most_alarms_km2, F.lit(True)), "alarms"),
        )
    )
    blockers = rows.withColumn("why", F.explode_outer(why)).groupBy("threshold").agg(
        F.array_sort(F.collect_set(F.when(F.col("why").isNotNull(), F.concat_ws(":", "dimension", "value", "why")))).alias("blockers"),
        F.max(F.when(F.col("dimension") == "all", F.try_divide("tp", "vessels"))).alias("recall"), F.max(F.when(F.col("dimension") == "all", rate)).alias("alarms_km2"),
    )
    best = blockers.where(F.size("blockers") == 0).agg(F.max_by("threshold", F.struct("recall", -F.col("alarms_km2"), -F.col("threshold"))).alias("best"))
    return blockers.join(F.broadcast(best)).select("threshold", "blockers", "recall", "alarms_km2", F.coalesce(F.col("threshold") == F.col("best"), F.lit(False)).alias("winner"))


def subset_recall(truths: DataFrame, by: list[str]) -> DataFrame:
    """Recall of reported vessels (length_m, surface, shore_m, matched, eligible_match) by stratum of place and band of length.

    Places are those of the reports: land or an unknown surface is a mismatch, within 300 m of a shore is coastal; the denominator
    is every vessel of a stratum. Vessels of 50 m and more count as resolvable.
    """
    place = F.when(F.coalesce(F.col("surface") != "water", F.lit(True)), PLACES[0]).when(F.col("shore_m") <= 300, PLACES[1]).otherwise(PLACES[2])
    band = reduce(lambda c, b: c.when((F.col("length_m") >= b[0]) & (F.col("length_m") < b[1]), f"{b[0]}-{b[1]}"), BANDS, F.when(F.lit(False), "")).otherwise("unknown")
    out = truths.withColumn("place", place).withColumn("band", band).groupBy(*by, "place", "band").agg(
        F.count("*").alias("vessels"), F.count_if("matched").alias("found"), F.count_if("eligible_match").alias("found_eligible"), F.count_if(F.col("length_m") >= 50).alias("resolvable")
    )
    return out.withColumn("recall", F.round(F.try_divide("found", "vessels"), 4)).withColumn("recall_eligible", F.round(F.try_divide("found_eligible", "vessels"), 4))


def identity_counts(targets: DataFrame, by: list[str]) -> DataFrame:
    """Outcomes of associations (label: matched, no_association, ambiguous or unresolved; correct; predicted; ambiguous).

    An ambiguous prediction is not accepted. A matched label without an accepted right one is a miss, with an accepted
    wrong one an error; an accepted one where there is none, or where it is ambiguous, is false or unsafe.
    """
    accepted = F.col("predicted") & ~F.col("ambiguous")
    is_ = lambda s: F.col("label") == s
    count = lambda c, n: F.count_if(c).alias(n)
    return targets.groupBy(*by).agg(
        F.count("*").alias("targets"), count(accepted, "accepted"), count(F.col("predicted") & F.col("ambiguous"), "held_back"), count(is_("matched") & accepted & F.col("correct"), "right"),
        count(is_("matched") & accepted & ~F.col("correct"), "wrong"), count(is_("matched") & ~accepted, "missed"), count(is_("no_association") & accepted, "false_association"),
        count(is_("no_association") & ~accepted, "right_refusal"), count(is_("ambiguous") & accepted, "unsafe"), count(is_("unresolved"), "unresolved"),
    )


def binary_metrics(rows: DataFrame, by: list[str], p: Column, y: Column) -> DataFrame:
    """Confusion at one half, accuracy, Brier score and log loss (clipped at 1e-7) of probabilities against the truth."""
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    said = p >= 0.5
    out = rows.where(p.isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(y & said).alias("tp"), F.count_if(~y & said).alias("fp"), F.count_if(y & ~said).alias("fn"), F.count_if(~y & ~said).alias("tn"),
        F.avg(F.when(y, -F.ln(q)).otherwise(-F.ln(1 - q))).alias("log_loss"), F.avg((p - y.cast("double")) ** 2).alias("brier"),
    )
    return out.withColumn("accuracy", F.try_divide(F.col("tp") + F.col("tn"), "n"))


def pair_counts(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """By scene how many pairs (scene_id, target_id, other_id) are positive: the other is among the target's labels (target_id, others)."""
    out = pairs.join(labels, "target_id", "left").withColumn("positive", F.coalesce(F.array_contains("others", F.col("other_id")), F.lit(False)))
    return out.groupBy("scene_id").agg(F.count("*").alias("pairs"), F.count_if("positive").alias("positive"), F.countDistinct("target_id").alias("targets"))
