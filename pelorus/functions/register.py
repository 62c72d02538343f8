"""The engine's functions under names for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pelorus.functions import geodesy


@F.pandas_udf(DoubleType())
def geodesic_m(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Metres between two places on the WGS84 ellipsoid."""
    return pd.Series(geodesy.inverse(lat1, lon1, lat2, lon2)[0])


@F.pandas_udf(DoubleType())
def area_km2(ring: pd.Series) -> pd.Series:
    """Square kilometres of a ring of (lon, lat) structs on the authalic sphere; null below three corners."""
    return pd.Series([geodesy.ring_area_km2(r) for r in ring], dtype=float)


@F.udtf(returnType="col int, row int, w int, h int")
class TileWindows:
    """Sliding windows over an image: width, height, tile, overlap."""

    def eval(self, width: int, height: int, tile: int, overlap: int):
        if None in (width, height) or not 0 <= overlap < tile:
            return
        step = tile - overlap
        for row in range(0, max(1, height - overlap), step):
            for col in range(0, max(1, width - overlap), step):
                yield col, row, min(tile, width - col), min(tile, height - row)


def register(spark: SparkSession) -> list[str]:
    """Makes geodesic_m, area_km2, recall_interval and tile_windows known to SQL."""
    from pelorus.operators.statistics import share_interval

    spark.udf.register("geodesic_m", geodesic_m)
    spark.udf.register("area_km2", area_km2)
    spark.udf.register("recall_interval", share_interval)
    spark.udtf.register("tile_windows", TileWindows)
    return ["area_km2", "geodesic_m", "recall_interval", "tile_windows"]
