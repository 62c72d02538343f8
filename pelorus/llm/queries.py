"""Queries of the training-data problems, over the whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.llm import leaks, nearest_time, packing, quality, splits
from pelorus.session import stored, widened


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


TOLERANCE_S = 300.0
SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}


def _areas(manifest: DataFrame) -> DataFrame:
    return manifest.select(
        nearest_time.vessel_number(F.col("support_user_id")).alias("entity"),
        nearest_time.instant_us(F.col("reference_midpoint_utc")).alias("t"),
        F.col("area_id").alias("id"),
    ).where("entity is not null and t is not null")


#: Areas whose rows a trigger of the replay takes up, and those that a shard of its state holds.
TRIGGER_AREAS, SHARD_AREAS = 1_000_000, 1000


def _nearest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = read(spark, sf_dir, "manifest")
    areas, n = _areas(manifest), manifest.count()
    reports = read(spark, sf_dir, "position_reports").where("time_utc is not null")
    reports = reports.select(F.col("user_id").alias("entity"), F.unix_micros("time_utc").alias("t"), F.col("report_id").alias("id"))
    slice_us = 3600 * nearest_time.MICRO
    keyed = reports.withColumn("slot", F.floor(F.col("t") / slice_us))
    # reports that no area's slices can reach match nothing
    reports = keyed.join(nearest_time.reachable(areas, TOLERANCE_S), ["entity", "slot"], "left_semi").drop("slot")
    triggers = max(nearest_time.TRIGGERS, n // TRIGGER_AREAS)
    return nearest_time.replay(areas, reports, TOLERANCE_S, shards=max(32, n // triggers // SHARD_AREAS), triggers=triggers)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_reports(spark, sf_dir).select(F.col("left_id").alias("area_id"), F.col("right_id").alias("report_id"))


def p2_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each matched area with its offset in seconds, beside the one stated at the time."""
    matched = _nearest_reports(spark, sf_dir).withColumnRenamed("left_id", "area_id")
    stated = read(spark, sf_dir, "manifest").select("area_id", F.col("absolute_offset_s").alias("stated_offset_s"))
    signed = F.col("offset_us") / nearest_time.MICRO
    out = matched.join(stated, "area_id").select(
        "area_id", F.col("right_id").alias("report_id"), signed.alias("offset_s"), F.abs(signed).alias("absolute_offset_s"), "stated_offset_s"
    )
    wrong = F.abs(F.col("absolute_offset_s") - F.col("stated_offset_s")) > 0.001
    return out.withColumn("corrected", F.coalesce(wrong, F.lit(True)))


def _related(manifest: DataFrame) -> DataFrame:
    acq = splits.acquisition(F.col("native_acquisition_group"), F.col("product_name"))
    groups = F.concat(splits.split_groups(F.col("geographic_group"), "geo:"), F.array_compact(F.array(acq)))
    return splits.components(manifest.withColumn("_groups", groups), "area_id", "_groups")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = read(spark, sf_dir, "manifest")
    labels = stored(_related(manifest), "components")
    return splits.violations(manifest, labels, "area_id", splits.split_name(F.col("split"))).select("area_id")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New splits of all areas: related ones together, 70, 15 and 15 % as near as can be."""
    labels = stored(_related(read(spark, sf_dir, "manifest")), "components")
    weights = labels.groupBy("component").agg(F.count("*").alias("weight"))
    return labels.join(splits.assign(weights, SHARES), "component").select("area_id", "component", "split")


def p4_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on the new splits: areas, components, components over several splits, and whether each share is as wanted to a point."""
    new = p4_splits(spark, sf_dir)
    whole = new.groupBy("component").agg(F.countDistinct("split").alias("n"))
    off = [F.abs(F.count_if(F.col("split") == k) / F.count("*") - v) for k, v in SHARES.items()]
    sums = new.agg(F.count("*").alias("areas"), F.greatest(*off).alias("off"))
    counted = whole.agg(F.count("*").alias("components"), F.count_if(F.col("n") > 1).alias("mixed"))
    return sums.join(counted).select("areas", "components", "mixed", (F.col("off") <= 0.01).alias("balanced"))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each speech or piece of one."""
    texts = widened(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    packed = packing.pack(packing.token_counts(texts))
    return packed.select(F.col("id").alias("doc_id"), "piece_no", "first_token", F.col("size").alias("tokens"), "container_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, tokens in them, the fewest containers there could be, and the share left unused."""
    used = p8_packing(spark, sf_dir).where("container_id > 0")
    out = used.agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    least = F.ceil(F.col("tokens") / packing.CAPACITY)
    return out.withColumn("least_containers", least).withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * packing.CAPACITY))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(widened(read(spark, sf_dir, "documents").select("doc_id", "text")), read(spark, sf_dir, "test_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked test item with the documents it is in and the longest run of its words in one."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("run").alias("longest_run"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(widened(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))).where("junk").select("doc_id")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five plain statistics of each speech."""
    documents = widened(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    stats = quality.statistics(documents.select("doc_id", "text"), quality.common_words(documents))
    five = ("mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share")
    return stats.select("doc_id", F.col("words").cast("bigint").alias("words"), *[F.round(c, 6).alias(c) for c in five])


def p10_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of each speech with the probability that it is a list, a table or junk."""
    return quality.judged(widened(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_offsets, p4_found, p4_splits, p4_balance, p8_packing, p8_fill, p9_found, p9_items, p10_found, p10_statistics, p10_judged)
}
