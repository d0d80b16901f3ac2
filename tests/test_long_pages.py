"""Pages of any size: the same rows as one page to a task, by sorts, jumps and counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import detections as D
from pagewright.operators import layout as L
from pagewright.operators import long_pages as LP
from pagewright.operators import scans

DETECTIONS = "doc_id long, page_idx int, det_ord int, text string, conf double, x1 int, y1 int, x2 int, y2 int"


def made(rng, page, n, tall, wide):
    rows = []
    for k in range(n):
        x, y = rng.randrange(wide), rng.randrange(tall)
        rows.append((page, 0, k, "t", 1.0, x, y, x + rng.randrange(1, 60), y + rng.randrange(-2, 60)))
    return rows


@pytest.mark.parametrize("limit", [0, 40])
def test_same_as_a_page_in_a_task(spark, limit):
    rng = random.Random(limit)
    rows = [r for page, (n, tall, wide) in enumerate([(1, 50, 9), (2, 50, 900), (5, 10, 900), (7, 500, 2000), (60, 900, 900), (200, 9000, 200), (300, 40, 3000)]) for r in made(rng, page, n, tall, wide)]
    rows += [(90, 0, k, "t", 1.0, 500 * (k % 2), 3 * k, 500 * (k % 2) + 9, 3 * k + 9) for k in range(150)]  # two columns, many bands
    rows += [(91, 0, k, "t", 1.0, 5, 7, 5, 7) for k in range(50)]  # all alike, no width
    df = spark.createDataFrame(rows, DETECTIONS)
    plain = {tuple(r) for r in L.reading_order_rtl(df).select("doc_id", "det_ord", "col", "band", "read_ord").collect()}
    found = LP.reading_order_any(df, limit=limit)
    assert {tuple(r) for r in found.select("doc_id", "det_ord", "col", "band", "read_ord").collect()} == plain and found.count() == len(rows)
    medians = {tuple(r) for r in LP.page_medians(df).select("doc_id", "median_height").collect()}
    assert medians == {tuple(r) for r in D.median_box_height(df).select("doc_id", "median_height").collect()}


def test_no_rows(spark):
    empty = spark.createDataFrame([], DETECTIONS)
    assert LP.reading_order_any(empty, limit=0).count() == 0 and LP.page_medians(empty).count() == 0 and LP.long_reading_order(empty).count() == 0


def test_medians_by_digits(spark):
    rng = random.Random(4)
    rows = [(k, v) for k in range(6) for v in [rng.choice([None, 0, 1, rng.randrange(300), rng.randrange(1 << 31), (1 << 31) - 1]) for _ in range(rng.randrange(0, 40))]]
    found = {r.k: r.median for r in scans.radix_median(spark.createDataFrame(rows, "k int, v int"), ["k"], "v").collect()}
    held = {k: [v for j, v in rows if j == k and v is not None] for k in range(6)}
    assert found == {k: float(np.median(v)) for k, v in held.items() if v}


def test_running_sums_cross_ranges(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(50), rng.randrange(4)) for k in range(2000)]
    found = scans.running(spark.createDataFrame(rows, "id int, a int, v int"), ["a", F.desc("id")], "v", "total").collect()
    total, expected = 0, {}
    for k, _, v in sorted(rows, key=lambda r: (r[1], -r[0])):
        expected[k] = total = total + v
    assert {r.id: r.total for r in found} == expected


def test_long_pages_are_spread_over_tasks(spark):
    """One page of 200 000 lines: after the sort no task has more than its range, and nothing is a window over a page."""
    lines = spark.range(200_000).selectExpr("1L AS doc_id", "0 AS page_idx", "CAST(id AS INT) AS det_ord", "'t' AS text", "1.0D AS conf", "CAST(id % 7 * 4 AS INT) AS x1", "CAST(id AS INT) AS y1", "CAST(id % 7 * 4 + 30 AS INT) AS x2", "CAST(id + 10 AS INT) AS y2")
    ordered = LP.long_reading_order(lines)
    assert "Window" not in ordered._jdf.queryExecution().executedPlan().toString()
    assert ordered.agg(F.max("read_ord"), F.countDistinct("read_ord"), F.max("band")).first()[:] == (200_000, 200_000, 199_999 // 15)


def test_bands_cross_many_ranges(spark):
    """Pages of few heights, of one, and of many, in more ranges than a page has bands."""
    rng = random.Random(8)
    rows = [r for page, (n, tall) in enumerate([(80, 12), (400, 60), (400, 7000), (30, 20000), (1, 5), (200, 1)]) for r in made(rng, page, n, tall, 900)]
    df = spark.createDataFrame(rows, DETECTIONS)
    plain = {tuple(r) for r in L.reading_order_rtl(df).select("doc_id", "det_ord", "col", "band", "read_ord").collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert {tuple(r) for r in LP.long_reading_order(df).select("doc_id", "det_ord", "col", "band", "read_ord").collect()} == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_jobs_do_not_grow_with_the_bands(spark):
    """A page of 20 000 bands takes no more jobs than one of two."""

    def jobs(n):
        group = f"bands-{n}"
        spark.sparkContext.setJobGroup(group, group)
        rows = spark.range(n).selectExpr("1L AS doc_id", "0 AS page_idx", "CAST(id AS INT) AS det_ord", "5 AS x1", "CAST(20 * id AS INT) AS y1", "9 AS x2", "CAST(20 * id + 10 AS INT) AS y2")
        assert LP.long_reading_order(rows).agg(F.max("band")).first()[0] == n - 1
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(20_000) <= jobs(2) + 4
