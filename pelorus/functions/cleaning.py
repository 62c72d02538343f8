"""Conservative readings of raw values: what is unknown becomes null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """A number as double, null if it is none or not finite."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def vessel_id(value: Column) -> Column:
    """A nine-digit vessel number as bigint, null for any other."""
    x = finite(value)
    return F.when((x == F.floor(x)) & x.between(100_000_000, 999_999_999), x.cast("bigint"))


def speed_knots(value: Column) -> Column:
    """Speed over ground; 102.2 and more stand for unknown."""
    x = finite(value)
    return F.when((x >= 0) & (x < 102.2), x)


def course_deg(value: Column) -> Column:
    """Course over ground; 360 and more stand for unknown."""
    x = finite(value)
    return F.when((x >= 0) & (x < 360), x)


def utc(text: Column, allow_naive: bool = False) -> Column:
    """An instant from text with an offset; without one only if allowed, and then UTC."""
    s = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s*UTC$", ""), r"[zZ]$", "+00:00")
    s = F.regexp_replace(s, r"\s*([+-]\d{2}):?(\d{2})$", "$1:$2")
    has = s.rlike(r"\d[+-]\d{2}:\d{2}$") & s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d")
    naive = s.rlike(r"^\d{4}-\d{2}-\d{2}([T ][\d:.]+)?$") & F.lit(allow_naive)
    return F.when(has, s.try_cast("timestamp")).when(naive, F.concat(s, F.lit("Z")).try_cast("timestamp"))


def instant_us(text: Column) -> Column:
    """Microseconds since 1970 of an instant as text, null if it denotes none.

    An instant without offset is UTC, a bare number is seconds since 1970, a trailing zone name UTC or GMT
    after an offset is left out.
    """
    s = F.upper(F.trim(text))
    number = F.when(s.rlike(r"^[+-]?\d+(\.\d+)?$"), F.round(s.try_cast("decimal(38,9)") * 1_000_000).cast("bigint"))
    iso = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2})[T ]+", "$1T")
    iso = F.regexp_replace(iso, r"\s*(?:UTC|GMT|Z)$", "Z")
    iso = F.regexp_replace(iso, r"\s*([+-]\d{2}):?(\d{2})Z?$", "$1:$2")
    iso = F.when(iso.rlike(r"(?:Z|[+-]\d{2}:\d{2})$") & iso.contains("T"), iso).otherwise(F.concat(iso, F.lit("Z")))
    whole = iso.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$")
    return F.coalesce(number, F.when(whole, F.unix_micros(iso.try_cast("timestamp"))))


def utc_text(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def grid_key(lon: Column, lat: Column, step: float) -> Column:
    """The cell of a degree grid as (x, y)."""
    return F.struct(F.floor(lon / step).cast("bigint").alias("x"), F.floor(lat / step).cast("bigint").alias("y"))


def slice_name(product: Column) -> Column:
    """A product's name without the suffix that tells copies of one slice apart."""
    return F.regexp_replace(F.upper(F.trim(product)), r"_[0-9A-F]{4}(_COG)?(\.SAFE)?$", "")


def native_group(product: Column) -> Column:
    """Satellite, orbit and datatake in a product's name; null if it isn't one."""
    part = r"^(S1[A-Z])_\w{2}_\w{4}_\w{4}_\d{8}T\d{6}_\d{8}T\d{6}_(\d{6})_([0-9A-F]{6})_[0-9A-F]{4}(_COG)?(\.SAFE)?$"
    name = F.upper(F.trim(product))
    return F.when(name.rlike(part), F.concat_ws("_", *[F.regexp_extract(name, part, k) for k in (1, 2, 3)]))


def real_source(coverage: Column) -> Column:
    """True if a statement of coverage names a real source of reports."""
    return F.coalesce(~F.lower(F.trim(coverage)).isin("", "none", "mock", "unknown", "n/a", "synthetic"), F.lit(False))
