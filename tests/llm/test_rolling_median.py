"""Rolling medians against sorting every window, with and without slices."""

import math
import random
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pagewright.llm.rolling_median import micros, rolling_median

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, block int, slice int, n string, c int, role int, t int"
START = datetime(2024, 3, 31, 1, 30)


def rows_of(clicks):
    return [(i, t, t, 1, k, v, "{}", 3, 4, "n", 5, 6, 7) for i, t, k, v in clicks]


def middle2(v):
    v = sorted(v)
    return v[(len(v) - 1) // 2] + v[len(v) // 2]


def plainly(clicks, minutes):
    best = {}
    for i, t, k, v in clicks:
        if t is not None:
            order = (t, (k is not None, k or ""), (v is not None, v or 0.0))
            if i not in best or order < best[i][0]:
                best[i] = (order, t, k, v)
    cents = lambda v: None if v is None or not math.isfinite(v) or abs(v) > 1e15 else math.floor(v * 100 + 0.5)
    held = [(i, t, k, cents(v)) for i, (_, t, k, v) in best.items()]
    out = set()
    for i, t, k, c in held:
        w = [x for _, u, j, x in held if j == k and x is not None and t - timedelta(minutes=minutes) <= u <= t]
        if len(w) < 2:
            out.add((i, k, len(w), None, None, None))
            continue
        m = middle2(w)
        d = middle2([abs(2 * x - m) for x in w])
        out.add((i, k, len(w), m, d, None if c is None else 2 * abs(2 * c - m) > 3 * d))
    return out


def check(spark, clicks, minutes=60, limit=200_000):
    found = rolling_median(spark.createDataFrame(rows_of(clicks), SCHEMA), minutes, limit)
    assert found.columns[:6] == ["click_id", "kind", "n", "median2", "mad4", "far"]
    rows = found.collect()
    assert len(rows) == len({tuple(r) for r in rows}) and {tuple(r)[:6] for r in rows} == plainly(clicks, minutes)


def made(rng, n, spread, kinds, steps=1):
    return [(k, START + timedelta(microseconds=rng.randrange(0, int(spread * 3.6e9), steps)), rng.choice(kinds), rng.choice([None, rng.randrange(-300, 300) / 100, rng.gauss(20, 50), rng.randrange(5) + 0.005])) for k in range(n)]


@pytest.mark.parametrize("limit", [200_000, 150, 20])
def test_windows(spark, limit):
    rng = random.Random(limit)
    clicks = made(rng, 500, 30, ["a", "b", None, ""]) + [(1000 + i, t, k, v) for i, t, k, v in made(rng, 500, 2.5, ["a", "hot"])]
    clicks += [(2000 + i, START + timedelta(minutes=30 * i), "edge", float(i % 7)) for i in range(40)]  # exactly one window apart
    check(spark, clicks, 60, limit)


@pytest.mark.parametrize("limit", [200_000, 10])
def test_odd_rows(spark, limit):
    t = START
    clicks = [(1, t, "a", 1.0), (1, t, "a", 1.0), (1, None, "a", 9.0), (2, None, "a", 1.0), (None, t, "a", 5.0), (None, t, "a", 4.0), (3, t, "a", math.nan), (4, t, "a", math.inf), (5, t, "a", 1e300), (6, datetime(1969, 12, 31, 23, 59, 59, 999999), "a", -0.005), (7, datetime(1970, 1, 1), "a", 0.005), (8, t, None, None)]
    clicks += [(100 + k, t + timedelta(minutes=60), "tie", float(k // 3)) for k in range(60)]  # one moment, in one cell
    check(spark, clicks, 60, limit)
    assert rolling_median(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wide_numbers_are_exact(spark):
    rng = random.Random(8)
    check(spark, [(k, START + timedelta(seconds=k), "a", rng.choice([-1e15, 1e15, rng.uniform(-1e12, 1e12)])) for k in range(80)], 1)


def test_micros_have_no_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # 02:30 of that day exists there only without a zone
        moments = [datetime(2024, 3, 31, 2, 30, 0, 1), datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2024, 1, 1)]
        rows = spark.createDataFrame([(m,) for m in moments], "ts timestamp_ntz").select(micros(F.col("ts"), False)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r[0] for r in rows] == [int(Fraction((m - datetime(1970, 1, 1)) // timedelta(microseconds=1))) for m in moments]
