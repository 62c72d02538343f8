"""Stays, voyages and implausible readings on made-up tracks."""

import datetime as dt

import numpy as np

from pelorus.operators import spikes, trips

T0 = dt.datetime(2017, 1, 5, tzinfo=dt.UTC)
SCHEMA = "report_id bigint, user_id bigint, latitude double, longitude double, sog double, cog double, time_utc timestamp, bucket string"
DEG = 111_195.0


def track(legs, user=123_456_789, step=60, seed=0):
    """legs: (minutes, knots, course); rows without ids."""
    rng = np.random.default_rng(seed)
    lat, lon, s, rows = 47.0, -51.0, 0, []
    for minutes, knots, course in legs:
        for _ in range(minutes * 60 // step):
            v = knots * 1852 / 3600 * step
            lat += v * np.cos(np.radians(course)) / DEG
            lon += v * np.sin(np.radians(course)) / DEG / np.cos(np.radians(lat))
            n = rng.normal(0, 8, 2) / DEG
            cog = course + rng.normal(0, 2) if knots > 1 else rng.uniform(0, 359)
            sog = max(0.0, knots + rng.normal(0, 0.3)) if knots > 1 else abs(rng.normal(0, 0.1))
            rows.append([user, lat + n[0], lon + n[1], round(float(sog), 1), round(float(cog % 360), 1), T0 + dt.timedelta(seconds=s)])
            s += step
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, int(r[0]), *[None if x is None else float(x) for x in r[1:5]], r[5], "x") for i, r in enumerate(rows)], SCHEMA)


def stays(spark, rows):
    return sorted(tuple(r) for r in trips.stays(trips.parts(frame(spark, rows))).select("user_id", "start_s", "end_s").collect())


def test_stays_and_voyages(spark):
    rows = track([(60, 0, 0), (40, 12, 90), (10, 0, 0), (30, 12, 90), (45, 0, 0), (30, 10, 0), (90, 0, 0)])
    rows[20][1] += 0.3  # one wrong position in a stay
    del rows[160:165]
    got = stays(spark, rows)
    t = T0.timestamp()
    ends = [((a - t) / 60, (b - t) / 60) for _, a, b in got]
    want = [(0, 60), (140, 185), (215, 305)]
    assert len(ends) == 3 and all(abs(a - c) <= 3 and abs(b - d) <= 3 for (a, b), (c, d) in zip(ends, want, strict=True))
    out = trips.stays_and_voyages(trips.parts(frame(spark, rows))).collect()
    sailed = sorted((r.start_s, r.distance_m) for r in out if r.kind == "voyage")
    assert len(sailed) == 2
    assert abs(sailed[0][1] - 70 * 60 * 12 * 1852 / 3600) < 1500 and abs(sailed[1][1] - 30 * 60 * 10 * 1852 / 3600) < 1000


def test_a_silence_at_one_spot_and_a_boundary_of_stretches_do_not_end_a_stay(spark):
    rows = track([(20, 0, 0)]) + [[*r[:5], r[5] + dt.timedelta(days=9)] for r in track([(20, 0, 0)], seed=1)]
    got = stays(spark, rows)
    assert len(got) == 1 and got[0][2] - got[0][1] > 9 * 86_400
    long = track([(10 * 24 * 60, 0, 0)], step=600)
    assert len(stays(spark, long)) == 1


def test_nulls_short_stays_foreign_numbers_and_empty_tables(spark):
    rows = track([(25, 0, 0), (60, 12, 90)]) + track([(60, 0, 0)], user=77)
    rows += [[123_456_789, None, 1.0, None, None, T0], [123_456_789, 1.0, 1.0, 1.0, 1.0, None]]
    assert stays(spark, rows) == []
    assert stays(spark, []) == []
    assert trips.stays_and_voyages(trips.parts(frame(spark, []))).count() == 0


def flagged(spark, rows):
    return sorted((r.report_id, r.field) for r in spikes.implausible(frame(spark, rows)).collect())


def test_bounds_leaps_and_stuck_values(spark):
    rows = track([(120, 12, 45), (60, 0, 0), (60, 12, 45)])
    rows[10][3] = 102.3
    rows[11][4] = 360.0
    rows[12][1] = 91.0
    rows[30][3] = 40.0
    rows[40][3], rows[41][3] = 0.0, 0.1
    rows[50][4] = (rows[50][4] + 120) % 360
    rows[60][1] += 0.2
    rows[70][1] = -rows[70][1]
    for k in range(90, 102):
        rows[k][4] = 44.93
    rows.append(list(rows[30]))  # delivered twice
    want = {(10, "sog"), (11, "cog"), (12, "latitude"), (30, "sog"), (len(rows) - 1, "sog"), (40, "sog"), (41, "sog"), (50, "cog"), (60, "latitude"), (70, "latitude")}
    want |= {(k, "cog") for k in range(90, 102)}
    assert set(flagged(spark, rows)) == want


def test_turns_halts_and_nulls_are_none(spark):
    rows = track([(40, 12, 45), (40, 12, 150), (3, 0, 0), (40, 12, 150), (50, 0, 0), (4, 25, 10), (50, 0, 0)])
    for k in range(0, len(rows), 7):
        rows[k][3] = None
        rows[k + 1 if k + 1 < len(rows) else k][4] = None
    assert flagged(spark, rows) == []
    assert flagged(spark, []) == []


def test_out_of_bounds_needs_no_time_and_other_numbers_are_left_out(spark):
    rows = [[123_456_789, 1.0, 1.0, 204.0, 1.0, None], [5, 1.0, 1.0, 204.0, 1.0, T0], [123_456_789, None, None, None, None, None]]
    assert flagged(spark, rows) == [(0, "sog")]


def test_latitudes_stuck_on_the_way_north_or_out_and_back(spark):
    def stuck(rows, first, last):
        for k in range(first, last):
            rows[k][1] = rows[first][1]
        return [(k, "latitude") for k in range(first, last)]

    north = track([(60, 3, 10)])
    assert flagged(spark, north) == []
    want = stuck(north, 20, 33)
    assert flagged(spark, north) == want
    for r in north:  # without speeds the positions before and after tell it
        r[3] = None
    assert flagged(spark, north) == want
    back = track([(30, 4, 90), (30, 4, 270)])
    want = stuck(back, 23, 38)
    for r in back:
        r[3] = None
    assert flagged(spark, back) == want
    there = track([(27, 3, 10), (33, 3, 190)])  # back where it was: only its speeds tell it
    want = stuck(there, 20, 34)
    assert flagged(spark, there) == want


def test_speeds_and_courses_stuck_out_and_back_but_not_at_anchor(spark):
    rows = track([(30, 5, 60), (30, 5, 240)])
    for k in range(24, 36):
        rows[k][3] = 5.1
    assert flagged(spark, rows) == [(k, "sog") for k in range(24, 36)]
    still = track([(30, 0, 0)], step=20)
    for k in range(20, 60):
        still[k][1], still[k][3], still[k][4] = still[20][1], 0.1, 77.0
    still[30][2] += 0.2
    assert flagged(spark, still) == []
