"""Queries of the general problems, over the whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.operators import drift, nested, proximity, spikes, trips
from pelorus.session import stored


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


NEAR_M = 300.0
PIXEL_M = 10.0


def _annotation_points(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    a = read(spark, sf_dir, "annotations")
    xy = F.col("coordinates")
    return proximity.points(a, F.col("annotation_id"), F.get(xy, F.lit(1)), F.get(xy, F.lit(0)), prefix)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = read(spark, sf_dir, "position_reports")
    annotations = read(spark, sf_dir, "annotations")
    rois = read(spark, sf_dir, "selection_rois")
    n_reports, n_annotations = reports.count(), annotations.count()
    left = _annotation_points(spark, sf_dir, "l")
    report_points = proximity.points(reports, F.col("report_id"), F.col("latitude"), F.col("longitude"), "r")
    near_reports = proximity.within_distance(left, report_points, NEAR_M, n_reports)
    near_others = proximity.within_distance(left, _annotation_points(spark, sf_dir, "r"), NEAR_M, n_annotations, once=True)
    centre = F.col("center")
    boxes = proximity.points(rois, F.col("roi_key"), F.get(centre, F.lit(1)), F.get(centre, F.lit(0)), "r")
    sizes = rois.select(F.col("roi_key").alias("r_id"), (F.col("size_px") * (PIXEL_M / 2)).alias("r_half_m"))
    containing = proximity.inside_boxes(left, boxes.join(sizes, "r_id"), n_annotations)
    kinds = (
        near_others.select(F.lit("annotation").alias("kind"), "l_id", "r_id"),
        near_reports.select(F.lit("report").alias("kind"), "l_id", "r_id"),
        containing.select(F.lit("roi").alias("kind"), "l_id", "r_id"),
    )
    out = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return out.select("kind", F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.field_changes(read(spark, sf_dir, "release_rows"))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table of all release rows."""
    rows = read(spark, sf_dir, "release_rows")
    values = stored(drift.field_values(rows), "field-values")
    columns, typed = drift.column_names(drift.field_changes(rows, values), values)
    return drift.consistent_table(rows, columns, typed)


def p5_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each column didn't fit its type, by feed."""
    failed = p5_table(spark, sf_dir).select("feed", F.explode("failed_casts").alias("field"))
    return failed.groupBy("feed", "field").agg(F.count("*").alias("failed"))


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and raw types by file, nested ones too."""
    return drift.nested_paths(read(spark, sf_dir, "release_rows"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.children_of_areas(nested.collection_tables(read(spark, sf_dir, "collection_records")))


def p6_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of objects, each naming its area."""
    tables = nested.collection_tables(read(spark, sf_dir, "collection_records"))
    objects = tables.table("object", "class string, kind string, reason string, source_consistent boolean, bbox_px string")
    box = F.col("bbox_px")
    from_object = F.from_json(box, "x0 int, y0 int, x1 int, y1 int")
    bbox = F.when(box.startswith("{"), F.array(*[from_object[k] for k in ("x0", "y0", "x1", "y1")])).otherwise(F.from_json(box, "array<int>"))
    return objects.withColumn("bbox_px", bbox).withColumnRenamed("parent_pk", "area_pk").withColumnRenamed("own_id", "object_id")


def p6_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of areas, each naming its record."""
    tables = nested.collection_tables(read(spark, sf_dir, "collection_records"))
    schema = "product_id string, split string, notes string, prior_datatake_exposure boolean, source_coverage string"
    areas = tables.table("area", schema).withColumnRenamed("own_id", "area_id")
    whole = F.get_json_object("source_coverage", "$.all_scenarios_complete").try_cast("boolean")
    return areas.withColumn("all_scenarios_complete", whole).drop("source_coverage")



def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays = trips.stays(trips.parts(read(spark, sf_dir, "position_reports")))
    return stays.select("user_id", F.floor((F.col("start_s") + F.col("end_s")) / 2 / 3600).alias("mid_hour")).distinct()


def p3_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays and voyages of every vessel."""
    return trips.stays_and_voyages(stored(trips.parts(read(spark, sf_dir, "position_reports")), "trip-parts"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible(read(spark, sf_dir, "position_reports"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p3_found, p3_trips, p5_found, p5_table, p5_casts, p5_paths, p6_found, p6_objects, p6_areas, p7_found)
}
