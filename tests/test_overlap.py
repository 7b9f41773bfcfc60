from math import acos, pi, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from basinframe.operators import overlap as ov
from basinframe.operators import polygons as pg

DEG = pi * ov.MAP_RADIUS_M / 180.0  # map metres of a degree of longitude


def lat_at(y):
    """Latitude of a height on the map, in discs of 100 km above the equator."""
    return float(np.degrees(2 * np.arctan(np.exp(y * 1e5 / ov.MAP_RADIUS_M)) - pi / 2))


def lon_at(x):
    return x * 1e5 / DEG


def edges_of(spark, rings):
    """Edges of areas given in units of a disc of 100 km around (0, 0)."""
    rows = [(a, [[float(lon_at(x)), lat_at(y)] for x, y in [*ring, ring[0]]]) for a, ring in rings]
    return pg.edges_of_rings(spark.createDataFrame(rows, "area_id int, ring array<array<double>>"), "area_id", "ring")


def box(x1, y1, x2, y2):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]


def shares(spark, rings, at=(0.0, 0.0)):
    blocks = spark.createDataFrame([("b", lat_at(at[1]), lon_at(at[0]))], "block_id string, lat double, lon double")
    row = ov.overlap_exact(blocks, edges_of(spark, rings), "block_id", 100.0).first()
    return row["overlap_pct"], row["summed_pct"], row["n_areas"]


def test_closed_forms(spark):
    cap = 100 * (acos(0.5) - 0.5 * sqrt(0.75)) / pi
    assert shares(spark, [(1, box(-9, -9, 9, 9))]) == pytest.approx((100, 100, 1))
    assert shares(spark, [(1, box(-9, -9, -1.5, 9))]) == pytest.approx((0, 0, 0))
    assert shares(spark, [(1, box(0.5, -9, 9, 9))]) == pytest.approx((cap, cap, 1))
    assert shares(spark, [(1, box(-9, -9, -0.5, 9)), (2, box(-9, 0.5, 9, 9))])[1] == pytest.approx(2 * cap)
    # A square inside the disc, of either direction, with a hole and met twice.
    square = box(-0.5, -0.5, 0.5, 0.5)
    hole = box(-0.25, -0.25, 0.25, 0.25)
    assert shares(spark, [(1, square)]) == pytest.approx((100 / pi, 100 / pi, 1))
    assert shares(spark, [(1, square[::-1]), (1, hole)]) == pytest.approx((75 / pi, 75 / pi, 1))
    assert shares(spark, [(1, square), (2, square)]) == pytest.approx((100 / pi, 200 / pi, 2))
    # A diamond across the square: both hold the octagon in their middle.
    d = 0.6
    diamond = [(d, 0), (0, d), (-d, 0), (0, -d)]
    corner = (1.0 - d) ** 2 / 2  # of the square, beyond a side of the diamond
    both = 1.0 - 4 * corner
    union = 1.0 + 2 * d * d - both
    assert shares(spark, [(1, square), (2, diamond)]) == pytest.approx((100 * union / pi, 100 * (1 + 2 * d * d) / pi, 2))
    # Neighbours that share a side add up without a seam.
    assert shares(spark, [(1, box(-9, -9, 0.3, 9)), (2, box(0.3, -9, 9, 9))]) == pytest.approx((100, 100, 2))


def test_many_edges_and_strips(spark):
    """A fine outline fills many strips; its surface is that of the regular polygon."""
    for n in (700, 3000):
        angle = np.arange(n) * 2 * pi / n + 0.1
        ring = list(zip(0.8 * np.cos(angle), 0.8 * np.sin(angle), strict=True))
        want = 100 * 0.64 * n / 2 * np.sin(2 * pi / n) / pi
        assert shares(spark, [(1, ring), (2, box(-0.1, -0.1, 0.1, 0.1))])[0] == pytest.approx(want, rel=1e-9)


def test_random_triangles_by_sampling(spark):
    rng = np.random.default_rng(8)
    rings = [(i, list(map(tuple, rng.uniform(-1.6, 1.6, (3, 2))))) for i in range(12)]
    got = shares(spark, rings)
    k = 1500
    axis = (np.arange(k) + 0.5) / k * 2 - 1
    x, y = np.meshgrid(axis, axis)
    disc = x**2 + y**2 < 1
    hits = []
    for _, ring in rings:
        side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) > 0 for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
        hits.append((np.all(side, 0) | ~np.any(side, 0)) & disc)
    assert got[0] == pytest.approx(100 * np.any(hits, 0).sum() / disc.sum(), abs=0.05)
    assert got[1] == pytest.approx(100 * sum(h.sum() for h in hits) / disc.sum(), abs=0.3)
    assert got[2] == sum(h.any() for h in hits)


def test_rows_without_a_place_and_repeats(spark):
    rows = [("a", 0.0, 0.0), ("a", 0.0, 0.0), ("b", None, 1.0), ("c", float("nan"), 1.0), ("d", 40.0, 40.0), (None, 0.0, -0.0)]
    blocks = spark.createDataFrame(rows, "block_id string, lat double, lon double").withColumn("area_id", F.lit("mine"))
    out = ov.overlap_exact(blocks, edges_of(spark, [(7, box(-9, -9, 9, 0))]), "block_id", 100.0)
    got = sorted(((r[0], None if r[1] is None else round(r[1], 6), r[3]) for r in out.collect()), key=repr)
    assert got == sorted([("a", 50.0, 1), ("a", 50.0, 1), ("b", None, None), ("c", None, None), ("d", 0.0, 0), (None, 50.0, 1)], key=repr)
    none = edges_of(spark, [(7, box(-9, -9, 9, 0))]).limit(0)
    assert {tuple(r)[1:] for r in ov.overlap_exact(blocks.where("block_id = 'a'"), none, "block_id").collect()} == {(0.0, 0.0, 0)}


def test_copies_of_an_area_meet_a_disc_once(spark, monkeypatch):
    """Copies, whichever way they are drawn, count in the sums by their number only."""
    met = []
    strips = ov._strips
    monkeypatch.setattr(ov, "_strips", lambda *a: met.append(strips(*a)) or met[0])
    square = box(-0.5, -0.5, 0.5, 0.5)
    rings = [(i, square[::-1] if i % 2 else square) for i in range(40)] + [(40, box(0.3, -0.5, 0.6, 0.5))]
    assert shares(spark, rings) == pytest.approx((110 / pi, (40 * 100 + 30) / pi, 41))
    assert met[0].count() <= 4


def test_strips_reach_over_batches(spark):
    """Batches of two edges: every strip lies in several."""
    rows = [(float(p), 0.0, 0, a, x, -1.0, x, 1.0) for p in range(5) for a, x in ((p, -0.5), (p, 0.5), (p + 1, 0.0), (p + 1, 0.5))]
    ddl = "lat double, lon double, strip int, area_id int, x1 double, y1 double, x2 double, y2 double"
    whole = spark.createDataFrame(rows, ddl).toArrow()
    for size in (2, 3, 20):
        parts = [r.to_pylist() for r in ov._sweep_strips(iter(whole.to_batches(max_chunksize=size)))]
        got = sorted((r["lat"], -1 if r["area_id"] is None else r["area_id"], round(r["surface"], 6)) for p in parts for r in p)
        half = float(sqrt(0.75) / 2 + np.arcsin(0.5))
        want = ((0, 2 * half), (1, half), (-1, 2 * half))  # between -0.5 and 0.5, and half of it
        assert got == sorted((float(p), a if a < 0 else p + a, round(v, 6)) for p in range(5) for a, v in want)
