"""The same semantics on one thread, in pandas: what the engine's times are held against."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd


def _table(folder: str, name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{folder}/{name}.parquet")


def _clean(folder: str) -> pd.DataFrame:
    r = _table(folder, "position_reports")
    ok = r.user_id.between(100_000_000, 999_999_999) & r.time_utc.notna() & r.latitude.between(-90, 90) & r.longitude.between(-180, 180)
    r = r[ok].copy()
    r["speed_knots"] = r.sog.where((r.sog >= 0) & (r.sog < 102.2))
    r["course_deg"] = r.cog.where((r.cog >= 0) & (r.cog < 360))
    r["t_us"] = r.time_utc.dt.tz_convert("UTC").dt.tz_localize(None).astype("datetime64[us]").astype("int64")
    return r


def _scenes(folder: str) -> pd.DataFrame:
    m = _table(folder, "manifest")
    s = m.reference_midpoint_utc.str.strip().str.replace(r"\s*UTC$", "", regex=True)
    number = pd.to_numeric(s, errors="coerce") * 1e6
    at = pd.to_datetime(s.where(number.isna()), utc=True, errors="coerce", format="mixed").dt.tz_localize(None).astype("datetime64[us]")
    us = np.where(at.notna(), at.astype("int64"), number.round())
    return pd.DataFrame({"scene_id": m.area_id, "at_us": us}).dropna().astype("int64")


def ais_clean(folder: str) -> int:
    return len(_clean(folder))


def ais_distinct(folder: str) -> int:
    key = ["user_id", "t_us", "latitude", "longitude", "speed_knots", "course_deg"]
    return len(_clean(folder).groupby(key, dropna=False).agg(report_id=("report_id", "min"), n=("report_id", "size")))


def reception_cells(folder: str) -> int:
    r = _clean(folder)
    r["x"], r["y"], r["day"] = np.floor(r.longitude / 0.1), np.floor(r.latitude / 0.1), r.t_us // 86_400_000_000
    return len(r.groupby(["x", "y"]).agg(reports=("user_id", "size"), vessels=("user_id", "nunique"), days=("day", "nunique"), fastest=("speed_knots", "max")))


def _pairs(folder: str) -> pd.DataFrame:
    r, s = _clean(folder).sort_values("t_us"), _scenes(folder)
    lo = np.searchsorted(r.t_us.to_numpy(), s.at_us.to_numpy() - 300_000_000, "left")
    hi = np.searchsorted(r.t_us.to_numpy(), s.at_us.to_numpy() + 300_000_000, "right")
    n = hi - lo
    at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    p = r.iloc[at].copy()
    p["scene_id"], p["dt"] = np.repeat(s.scene_id.to_numpy(), n), (p.t_us.to_numpy() - np.repeat(s.at_us.to_numpy(), n)) / 1e6
    return p


def scene_support(folder: str) -> int:
    p = _pairs(folder)
    return len(p.assign(away=p.dt.abs()).groupby("scene_id").agg(reports=("report_id", "size"), vessels=("user_id", "nunique"), nearest=("away", "min")))


def scene_alignment(folder: str) -> int:
    """A vessel's track at a time, as one would write it first."""
    p = _pairs(folder).sort_values(["scene_id", "user_id", "t_us", "report_id"])
    found = 0
    for _, g in p.groupby(["scene_id", "user_id"], sort=False):
        t, dt = g.t_us.to_numpy(), g.dt.to_numpy()
        lat, lon, v, c = (g[k].to_numpy() for k in ("latitude", "longitude", "speed_knots", "course_deg"))
        same = np.flatnonzero(t[1:] == t[:-1])
        if ((lat[same] != lat[same + 1]) | (lon[same] != lon[same + 1])).any():
            continue
        k = int(np.lexsort((t, np.abs(dt)))[0])
        before, after = np.flatnonzero(dt < 0), np.flatnonzero(dt > 0)
        if dt[k] == 0:
            found += 1
        elif len(before) and len(after):
            a, b = before[-1], after[0]
            m = np.radians((lat[a] + lat[b]) / 2)
            d = 111_195 * np.hypot(lat[b] - lat[a], (lon[b] - lon[a]) * np.cos(m))
            found += d / (dt[b] - dt[a]) <= 60 * 1852 / 3600
        else:
            known = v[k] <= 60 and not np.isnan(c[k])
            found += bool(abs(dt[k]) <= 120 and known or abs(dt[k]) <= 60)
    return found


def intervals_merged(folder: str) -> int:
    e = _table(folder, "events")
    a = e.ts.astype("datetime64[us]").astype("int64").to_numpy() / 1e6
    b = a + 600 + e["value"].to_numpy() * 60
    n = 0
    for _, g in pd.DataFrame({"u": e.user_id, "a": a, "b": b}).sort_values(["u", "a", "b"]).groupby("u", sort=False):
        reached = -np.inf
        for x, y in zip(g.a.to_numpy(), g.b.to_numpy(), strict=True):
            n += x > reached
            reached = max(reached, y)
    return n


def slice_aliases(folder: str) -> int:
    m = _table(folder, "manifest").dropna(subset=["product_name"])
    key = m.product_name.str.strip().str.upper().str.replace(r"_[0-9A-F]{4}(_COG)?(\.SAFE)?$", "", regex=True)
    return len(m.groupby(key).product_name.agg(lambda x: sorted(set(x))))


VERSIONS = {f.__name__: f for f in (ais_clean, ais_distinct, reception_cells, scene_support, scene_alignment, intervals_merged, slice_aliases)}


def times(folder: str) -> dict[str, float]:
    """Seconds of each on one thread, reading its tables anew."""
    out = {}
    for name, f in VERSIONS.items():
        began = time.time()
        f(folder)
        out[name] = round(time.time() - began, 3)
    return out
