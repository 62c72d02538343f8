"""Queries of the operators on images; each whole, each beside its SQL. The vectors of 64 numbers stand for images of 8 by 8."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.operators import raster
from pelorus.plans.survey_queries import query

_PX = "select vec_id as image_id, cast(floor((n - 1) / 8) as int) as row, cast((n - 1) % 8 as int) as col, cast(embedding[n] as double) as value from embeddings, (select unnest(range(1, 65)) as n)"


def _images(e: DataFrame) -> DataFrame:
    db = F.transform("embedding", lambda v: v.cast("double") * 40 - 20)
    return e.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda v: v.cast("double")).alias("band"), db.alias("db"), "label")


@query(
    f"""with p as materialized ({_PX}) select a.image_id, a.row, a.col, a.value as score from p a join p b on a.image_id = b.image_id and abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1
    where a.value > 0.25 group by 1, 2, 3, 4 having max(b.value) = a.value""",
    "embeddings",
)
def score_peaks(e):
    return raster.peaks(_images(e), "band", 0.25)


_CONTRAST = f"""
    with p as materialized (select image_id, row, col, value * 40 - 20 as db from ({_PX})), v as (select * from p where db > -60),
    r as (select a.image_id, a.row, a.col, a.db, sum(pow(10, b.db / 10)) as s, count(*) as n from v a join v b on a.image_id = b.image_id and abs(a.row - b.row) <= 2 and abs(a.col - b.col) <= 2
        and (abs(a.row - b.row) > 1 or abs(a.col - b.col) > 1) where a.row between 2 and 5 and a.col between 2 and 5 group by 1, 2, 3, 4)
    select image_id, row, col, db - 10 * log10(s / 16) as contrast_db from r where n = 16
"""


@query(f"select image_id, row, col, round(contrast_db, 6) as contrast_db from ({_CONTRAST})", "embeddings")
def ring_contrast(e):
    return raster.contrast(_images(e), "db", 2, 1).withColumn("contrast_db", F.round("contrast_db", 6))


@query(
    f"""with recursive h as materialized (select image_id, row * 8 + col as i, row, col, contrast_db - 6 as m from ({_CONTRAST}) where contrast_db >= 6),
    reach(image_id, i, j) as (select image_id, i, i from h union select r.image_id, r.i, b.i from reach r join h a on a.image_id = r.image_id and a.i = r.j join h b on b.image_id = a.image_id and abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1),
    l as (select image_id, i, min(j) as label from reach group by 1, 2)
    select image_id, arg_min(row, (-m, i)) as row, arg_min(col, (-m, i)) as col, cast(count(*) as int) as pixels, round(max(m), 6) as margin_db from h join l using (image_id, i) group by image_id, label""",
    "embeddings",
)
def bright_regions(e):
    return raster.bright(_images(e), ["db"], [6.0], 2, 1).withColumn("margin_db", F.round("margin_db", 6))


_LUT = ([0.0, 3.0, 9.0], [0.0, 5.0, 8.0], [[1.0, 2.0, 4.0], [2.0, 3.0, 5.0], [8.0, 9.0, 12.0]])


@query(
    f"""with p as ({_PX}), l as (select *, case when row <= 3 then 0 else 1 end as i, case when col <= 5 then 0 else 1 end as j, case when row <= 3 then row / 3.0 else (row - 3) / 6.0 end as u, case when col <= 5 then col / 5.0 else (col - 5) / 3.0 end as w from p),
    k as (select *, [[1.0, 2.0, 4.0], [2.0, 3.0, 5.0], [8.0, 9.0, 12.0]] as t from l)
    select image_id, row, col, round((t[i + 1][j + 1] * (1 - w) + t[i + 1][j + 2] * w) * (1 - u) + (t[i + 2][j + 1] * (1 - w) + t[i + 2][j + 2] * w) * u, 6) as a from k where image_id % 4 = 0""",
    "embeddings",
)
def calibration_values(e):
    px = raster.pixels(_images(e).where("image_id % 4 = 0"), "band").drop("value")
    return raster.calibrated(px, _LUT).withColumn("a", F.round("a", 6))


@query(
    f"""with p as ({_PX}), x as (select *, (row between 0 and 4)::int + (row between 4 and 7 and col >= 2)::int as covers,
        case when col <= 4 then 0.01 + col * 0.005 else 0.03 + (col - 4) * 0.01 end as r, case when row <= 4 then 1 + row * 0.1 else 1.5 - (row - 4) * 0.2 end as z from p)
    select image_id, row, col, covers, round(case when covers = 1 then r * z end, 8) as noise,
        round(case when covers = 1 then 10 * log10(greatest(1e-10, greatest(0, value * value - r * z) / 4)) end, 6) as db from x""",
    "embeddings",
)
def noise_removed(e):
    blocks = [(0, 4, 0, 7, [0.0, 4.0], [1.0, 1.4]), (4, 7, 2, 7, [4.0, 9.0], [1.5, 0.5])]
    px = raster.noise_power(raster.pixels(_images(e), "band"), ([0.0, 4.0, 7.0], [0.01, 0.03, 0.06]), blocks)
    db = F.when(F.col("covers") == 1, raster.corrected_db(F.col("value"), F.col("noise"), F.lit(2.0)))
    return px.select("image_id", "row", "col", "covers", F.round("noise", 8).alias("noise"), F.round(db, 6).alias("db"))


@query(
    f"""select image_id, row, col, round(-52 + col * 0.25 + row * 0.015625, 6) as lon, round(48 - row * 0.125 + col * 0.0078125, 6) as lat from ({_PX})""",
    "embeddings",
)
def pixel_places(e):
    """Places by an affine transform; the spline over four corners of the same transform gives them too."""
    px = raster.pixels(_images(e), "band").select("image_id", "row", "col")
    t = (0.25, 0.015625, -52.0, 0.0078125, -0.125, 48.0)
    corner = lambda c, r: (c, r, t[0] * c + t[1] * r + t[2], t[3] * c + t[4] * r + t[5])
    placed = raster.georeferenced(px, [corner(c, r) for c in (0, 7) for r in (0, 7)])
    own = raster.affine(F.col("col"), F.col("row"), t)
    gap = F.greatest(F.abs(F.col("lon") - own["lon"]), F.abs(F.col("lat") - own["lat"]))
    lon, lat = F.when(gap < 1e-7, own["lon"]), F.when(gap < 1e-7, own["lat"])
    return placed.select("image_id", "row", "col", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_BOXES = "select vec_id as image_id, vec_id * 2 + k as box_id, (vec_id + k * 3) % 7 as x0, (vec_id * 3 + k) % 7 as y0, (vec_id + k * 3) % 7 + 1 as x1, (vec_id * 3 + k) % 7 + 1 as y1 from embeddings, (select unnest([0, 1]) as k)"


def _boxes(e: DataFrame) -> DataFrame:
    k = e.select(F.col("vec_id").alias("image_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    x, y = (F.col("image_id") + F.col("k") * 3) % 7, (F.col("image_id") * 3 + F.col("k")) % 7
    return k.select("image_id", (F.col("image_id") * 2 + F.col("k")).alias("box_id"), x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"))


@query(
    f"""with b as ({_BOXES}), c as (select *, cast(floor((x0 + x1) / 2) as int) - 1 as c0, cast(floor((y0 + y1) / 2) as int) - 1 as r0 from b), f as (select *, c0 >= 0 and r0 >= 0 and c0 + 3 <= 8 and r0 + 3 <= 8 as fits from c),
    p as (select f.image_id, f.box_id, avg(value) as m, count(*) as n from f join ({_PX}) p on p.image_id = f.image_id and fits and p.row between r0 and r0 + 2 and p.col between c0 and c0 + 2 group by 1, 2)
    select f.image_id, f.box_id, case when fits then n else 0 end as n, round(case when fits then m end, 6) as mean, case when not fits then 'leaves_image' end as reason from f left join p using (image_id, box_id)""",
    "embeddings",
)
def chip_means(e):
    c = raster.array_statistics(raster.chips(_images(e), _boxes(e), "band", 3), "chip")
    return c.select("image_id", "box_id", F.when(F.col("chip").isNotNull(), F.col("n").cast("bigint")).otherwise(0).alias("n"), F.round("mean", 6).alias("mean"), "reason")


@query(
    """select vec_id as image_id, len(embedding) as n, round(list_avg(embedding::double[]), 6) as mean, round(list_stddev_pop(embedding::double[]), 6) as sd, round(list_median(embedding::double[]), 6) as median from embeddings""",
    "embeddings",
)
def chip_statistics(e):
    out = raster.array_statistics(_images(e), "band")
    return out.select("image_id", F.col("n").cast("bigint").alias("n"), *[F.round(c, 6).alias(c) for c in ("mean", "sd", "median")])


@query(
    f"""with p as (select *, value > -0.2 as valid from ({_PX})), b as ({_BOXES}),
    m as (select p.*, b.box_id, p.col between x0 and x1 and p.row between y0 and y1 as own, p.col between x0 - 1 and x1 + 1 and p.row between y0 - 1 and y1 + 1 as guarded
        from p join b on b.image_id = p.image_id and p.col between x0 - 2 and x1 + 2 and p.row between y0 - 2 and y1 + 2),
    r as (select *, max(guarded::int) over (partition by image_id, row, col) as g from m), k as (select image_id, box_id, case when not valid then 'no_data' when own then 'object' when g = 0 then 'ring' end as role from r)
    select image_id, box_id, role, count(*) as n from k where role is not null group by 1, 2, 3""",
    "embeddings",
)
def mask_counts(e):
    px = raster.pixels(_images(e), "band").withColumn("valid", F.col("value") > -0.2)
    return raster.ring_mask(px, _boxes(e), 1, 2).groupBy("image_id", "box_id", "role").agg(F.count("*").alias("n"))


@query(
    f"""with a as ({_PX}), b as (select image_id, row, col, round(value, 2) as value from ({_PX}) where row < 7), j as (select a.image_id as x, b.image_id as y, a.value - b.value as d from a full join b on a.image_id = b.image_id and a.row = b.row and a.col = b.col)
    select count(*) filter (x is not null and y is not null) as both, count(*) filter (x is null or y is null) as one_only, round(max(abs(d)), 6) as greatest, round(avg(d), 8) as mean, round(sqrt(avg(d * d)), 8) as rms, count(*) filter (abs(d) > 0.004) as beyond from j""",
    "embeddings",
)
def rounding_compared(e):
    a = raster.pixels(_images(e), "band")
    b = a.where("row < 7").withColumn("value", F.round("value", 2))
    out = raster.compared(a, b, ["image_id", "row", "col"], "value", 0.004)
    return out.select("both", "one_only", F.round("greatest", 6).alias("greatest"), F.round("mean", 8).alias("mean"), F.round("rms", 8).alias("rms"), "beyond")


@query(None, "embeddings")
def alike_images(e):
    """Groups of images alike; each fifth image comes once more, turned, and each seventh with a little noise."""
    a = _images(e).select("image_id", "height", "width", "band")
    rows = F.flatten(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.get("band", (r * 8 + c).cast("int")))))
    turned = a.where("image_id % 5 = 0").select((F.col("image_id") + 1_000_000).alias("image_id"), "height", "width", rows.alias("band"))
    noisy = a.where("image_id % 7 = 0").select((F.col("image_id") + 2_000_000).alias("image_id"), "height", "width", F.transform("band", lambda v, k: v + F.sin(k.cast("double")) * 0.001).alias("band"))
    return raster.alike_groups(a.unionByName(turned).unionByName(noisy), "band", 0.995, 0.01)


@query(
    f"""with p as (select image_id, row, col, case when row = 0 then 0.0 when col = 7 then null else value end as v from ({_PX})), q as (select vec_id as image_id, cast(vec_id % 9 as int) as row, cast(vec_id * 5 % 9 as int) as col from embeddings)
    select q.image_id, q.row, q.col, coalesce(p.v <> 0, false) as valid from q left join p using (image_id, row, col)""",
    "embeddings",
)
def valid_points(e):
    """A place a image, some of them beyond it, on zeros or without data."""
    px = raster.pixels(_images(e), "band").withColumn("value", F.when(F.col("row") == 0, 0.0).when(F.col("col") != 7, F.col("value")))
    points = e.select(F.col("vec_id").alias("image_id"), (F.col("vec_id") % 9).cast("int").alias("row"), (F.col("vec_id") * 5 % 9).cast("int").alias("col"))
    return raster.valid_points(points, px, False)
