import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basinframe.functions.geo import Grid, chord_of_km
from basinframe.operators import polygons as pg
from basinframe.operators import raster as r
from basinframe.operators import spatial as sp

KM = 6371.0088


def unit(lat, lon):
    la, lo = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])


@pytest.fixture(scope="module")
def world(spark):
    """A third of the references in one small cluster, some of them at one spot,
    queries near it, at the antimeridian and at a pole."""
    rng = np.random.default_rng(3)
    n, m = 900, 240
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    lat[:300], lon[:300] = 26.5 + rng.normal(0, 0.2, 300), -91 + rng.normal(0, 0.2, 300)
    lat[:60], lon[:60] = 26.5, -91.0
    qlat, qlon = np.degrees(np.arcsin(rng.uniform(-1, 1, m))), rng.uniform(-180, 180, m)
    qlat[:80], qlon[:80] = 26.5 + rng.normal(0, 0.3, 80), -91 + rng.normal(0, 0.3, 80)
    qlon[80:90], qlat[90:93] = 179.99, 90.0
    ref = spark.createDataFrame(pd.DataFrame({"r": np.arange(n), "lat": lat, "lon": lon}))
    q = spark.createDataFrame(pd.DataFrame({"q": np.arange(m), "lat": qlat, "lon": qlon}))
    dist = np.sqrt(((unit(qlat, qlon)[:, None] - unit(lat, lon)[None]) ** 2).sum(2))
    return q, ref, dist


def test_nearest_equals_brute_force(world):
    q, ref, dist = world
    got = sp.nearest_join(q, ref, "q", "r", 5).toPandas().sort_values(["q", "rank"])
    want = 2 * np.arcsin(np.sort(dist, 1)[:, :5] / 2) * KM
    assert np.abs(got.distance_km.values.reshape(-1, 5) - want).max() < 1e-6


def test_ties_go_to_the_smaller_id(world):
    q, ref, _ = world
    at = q.limit(1).select(F.lit(0).alias("q"), F.lit(26.5).alias("lat"), F.lit(-91.0).alias("lon"))
    assert [x["r"] for x in sp.nearest_join(at, ref, "q", "r", 3).orderBy("rank").collect()] == [0, 1, 2]


@pytest.mark.parametrize("radius", [50.0])
def test_radius_equals_brute_force(world, radius):
    q, ref, dist = world
    near = dist <= chord_of_km(radius)
    got = sp.radius_totals(q, ref.withColumn("one", F.lit(1)), "q", radius, ["one"]).toPandas().sort_values("q")
    assert (got.n_rows.values == near.sum(1)).all() and (got.one.values == near.sum(1)).all()


def test_pairs_and_buffer(world):
    q, ref, dist = world
    near = dist <= chord_of_km(60.0)
    assert sp.radius_pairs(q, ref, "q", "r", 60.0).count() == near.sum()
    kept = {x["q"] for x in sp.buffer_anti_join(q, ref, "q", 60.0).collect()}
    assert kept == set(np.flatnonzero(~near.any(1)))


def test_same_result_at_other_partition_counts(world):
    q, ref, _ = world
    few = ref.where("r % 3 = 0")
    a = sp.nearest_join(q.coalesce(1), few.coalesce(1), "q", "r").select("q", "r")
    b = sp.nearest_join(q.repartition(7), few.repartition(5), "q", "r").select("q", "r")
    assert a.exceptAll(b).count() == 0


def test_one_degree_at_the_equator(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "q int, lat double, lon double")
    b = spark.createDataFrame([(2, 0.0, 1.0)], "r int, lat double, lon double")
    assert sp.nearest_join(a, b, "q", "r").first()["distance_km"] == pytest.approx(111.195, abs=0.001)


def grid_frame(spark, data):
    rows = [(i, j, float(v)) for i, row in enumerate(data) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "row int, col int, v double")


def test_coarsen_and_gradient(spark):
    g = Grid(30.0)
    data = np.arange(72, dtype=float).reshape(6, 12)
    data[0, 0] = np.nan
    cells = grid_frame(spark, data)
    got = {(x["row"], x["col"]): x["v"] for x in r.coarsen_mean(cells, 3, "v").collect()}
    assert got[(0, 0)] == pytest.approx(np.nanmean(data[:3, :3]))
    data[0, 0] = 0.0
    out = r.gradient(grid_frame(spark, data), g, "v", "g").toPandas().sort_values(["row", "col"])
    dr, dc = np.gradient(data)
    km = 30.0 * np.pi * KM / 180
    lat = 90 - 15 - 30 * np.arange(6)
    want = np.hypot(dr / km, dc / (km * np.cos(np.radians(lat))[:, None]))
    assert np.allclose(out.g.values.reshape(6, 12), want)


def test_neighbourhood_wraps_columns_and_stops_at_poles(spark):
    g = Grid(30.0)
    data = np.random.default_rng(0).normal(size=(6, 12))
    out = r.neighbourhood(grid_frame(spark, data), g, ["v"], {"a": 1, "b": 2})
    got = {(x["row"], x["col"]): x for x in out.collect()}
    for (i, j), k in (((0, 0), 1), ((3, 11), 2), ((5, 6), 2)):
        w = data[max(0, i - k) : i + k + 1][:, np.arange(j - k, j + k + 1) % 12]
        tag = {1: "a", 2: "b"}[k]
        assert got[(i, j)][f"v_mean_{tag}"] == pytest.approx(w.mean())
        assert got[(i, j)][f"v_std_{tag}"] == pytest.approx(w.std())


def test_neighbourhood_of_wanted_cells(spark):
    """The same values as over the whole grid, from the tiles around the cells alone; cells
    without a row, poles and the seam included."""
    g = Grid(5.0)
    data = np.random.default_rng(1).normal(size=(36, 72))
    cells = grid_frame(spark, data).where("(row * 7 + col) % 5 <> 0")
    wanted = [(0, 0), (35, 71), (17, 70), (17, 1), (20, 20), (20, 21), (5, 63), (20, 20), (None, 3)]
    asked = spark.createDataFrame(wanted, "row int, col int")
    whole = {(x["row"], x["col"]): x for x in r.neighbourhood(cells, g, ["v"], {"a": 1, "b": 4}).collect()}
    got = r.neighbourhood(cells, g, ["v"], {"a": 1, "b": 4}, wanted=asked, tile=8).collect()
    assert sorted((x["row"], x["col"]) for x in got) == sorted({w for w in wanted if w[0] is not None})
    for x in got:
        want = whole[x["row"], x["col"]]
        assert all(x[k] == pytest.approx(want[k]) for k in want.asDict())
    tiles = r._tiles_around(g, asked.where("row = 20"), 4, 9).collect()
    assert sorted((x["tr"], x["tc"]) for x in tiles) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_idw_exact_hit_and_cutoff(spark):
    pts = spark.createDataFrame([(1, 15.0, 15.0, 5.0), (2, -75.0, -165.0, 9.0)], "p int, lat double, lon double, v double")
    out = r.idw(Grid(30.0).centres(spark), pts, "v", "p", k=12, max_km=100.0).toPandas()
    hit = out[(out.row == 2) & (out.col == 6)].field.iloc[0]
    assert hit == pytest.approx(5.0)
    assert out.field.isna().sum() == len(out) - 2


def test_constant_channel_raises(spark):
    cells = grid_frame(spark, np.ones((3, 3)))
    with pytest.raises(ValueError, match="no spread"):
        r.robust_z(cells, "v", "z", r.channel_stats(cells, ["v"]))


def test_regrid_corners(spark):
    src = grid_frame(spark, [[1.0, 2.0], [3.0, 4.0]])
    dst = spark.createDataFrame([(0, 0, 0.0, 0.5), (1, 0, 1.0, 1.0), (2, 0, 2.0, 0.0)], "row int, col int, lat double, lon double")
    args = dict(lat0=1.0, lon0=0.0, d_lat=1.0, d_lon=1.0, n_lat=2, n_lon=2)
    got = {x["row"]: x["v"] for x in r.regrid(src, dst, "v", **args).collect()}
    assert got == {0: pytest.approx(3.5), 1: pytest.approx(2.0), 2: None}
    near = {x["row"]: x["v"] for x in r.regrid(src, dst, "v", method="nearest", **args).collect()}
    assert near[0] == 3.0  # a tie goes to the lower index


def test_polygons(spark):
    rings = spark.createDataFrame(
        [(1, [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]), (2, [[5.0, 5.0], [15.0, 5.0], [15.0, 15.0], [5.0, 15.0], [5.0, 5.0]])],
        "area_id int, ring array<array<double>>",
    )
    edges = pg.edges_of_rings(rings, "area_id", "ring")
    pts = spark.createDataFrame([(1.0, 1.0), (7.0, 7.0), (12.0, 12.0), (20.0, 1.0)], "lon double, lat double")
    got = {(x["lon"], x["area_id"]) for x in pg.points_in_polygons(pts, edges).collect()}
    assert got == {(1.0, 1), (7.0, 1), (7.0, 2), (12.0, 2)}
    areas = spark.createDataFrame([(1, 1, 11, "p"), (2, 2, 22, None)], "area_id int, ord int, code int, type string")
    cells = pg.province_cells(edges, areas, Grid(2.0)).toPandas()
    assert len(cells) == 25 + 25 - 9  # centres at odd degrees, nine of them in both areas
    assert (cells.province_code == 22).sum() == 25
    assert {x["area_id"]: x["area"] for x in pg.ring_area(edges).collect()} == {1: 100.0, 2: 100.0}
    block = spark.createDataFrame([("b", 7.0, 7.0), ("far", 60.0, 60.0)], "block_id string, lat double, lon double")
    share = {x["block_id"]: x["overlap_pct"] for x in pg.overlap_share(block, edges, "block_id", 25.0).collect()}
    assert share == {"b": 100.0, "far": 0.0}  # two areas cover it, counted once


def test_decimate(spark):
    for n, want in ((188, [0, 50, 100, 150, 187]), (2, [0, 1]), (51, [0, 50]), (1, [0])):
        df = spark.range(1).select(F.sequence(F.lit(0), F.lit(n - 1)).alias("x"))
        assert df.select(pg.decimate_line("x", 50).alias("y")).first()["y"] == want


def test_every_point_is_stored_once(spark):
    rows = [(i, 10.0 + (i % 40) * 1e-3, 20.0 + (i // 40) * 1e-3) for i in range(2000)]
    rows += [(2000 + i, -60.0 + i % 120, -170.0 + 0.085 * i) for i in range(4000)]
    ref = spark.createDataFrame(rows, "id long, lat double, lon double").repartition(4)
    index = sp.CubeIndex(ref, ids=["id"], keep=20)
    leaves = index.leaves.groupBy("leaf_level", "leaf_cell").count().toPandas()
    assert leaves["count"].sum() == 6000 and leaves["count"].max() <= index.leaf == 20
    full = index.nodes.where(f"n > {index.leaf} and level < {index.bottom}").select("level", "cell")
    on = [F.col("leaf_level") == F.col("level"), F.col("leaf_cell") == F.col("cell")]
    assert index.leaves.join(full, on, "left_semi").count() == 0


def test_areas_of_one_size_follow_their_ids(spark):
    """The same diamond elsewhere: the last digits of its shoelace sum do not rank it."""
    ring = lambda x, y: [[x + 12 * i, y + 12 * j] for i, j in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))]
    rows = [(k, ring((k * 15013 % 32000) / 100.0 - 159.987, (k * 6151 % 14000) / 100.0 - 69.983)) for k in range(60)]
    edges = pg.edges_of_rings(spark.createDataFrame(rows, "area_id int, ring array<array<double>>"), "area_id", "ring")
    picked = pg.largest_areas(edges, edges.select("area_id").distinct(), 10).collect()
    assert [r["area_id"] for r in picked] == list(range(10))


def test_cells_of_areas_and_points_in_them(spark):
    """Whole cells need no edge; walls on cell borders, level edges and holes are met by edges."""
    box = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d], [a, b]]
    rings = [(1, box(-3.0, -2.0, 4.0, 5.0)), (1, box(0.25, 0.25, 1.75, 2.75)), (2, [[-6.3, -4.1], [5.2, 0.3], [-1.7, 6.4], [-6.3, -4.1]])]
    edges = pg.edges_of_rings(spark.createDataFrame(rings, "area_id int, ring array<array<double>>"), "area_id", "ring")
    cells = {(r["tx"], r["ty"]): r for r in pg.cover(edges).where("area_id = 1").collect()}
    assert cells[(2, 2)]["whole"] and cells[(2, 2)]["cut"] is None and not cells[(0, 1)]["whole"]
    assert not cells[(-3, -2)]["whole"] and not cells[(4, 0)]["whole"] and (6, 0) not in cells
    rng = np.random.default_rng(3)
    at = np.vstack([rng.uniform(-7, 7, (3000, 2)), rng.integers(-7, 8, (300, 2)) + 0.5])
    def even_odd(area, px, py):  # noqa: E306
        n = 0
        for k, ring in rings:
            for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
                n += k == area and (y1 > py) != (y2 > py) and px < x1 + (py - y1) / (y2 - y1) * (x2 - x1)
        return n % 2 == 1
    want = {(x, y, k) for x, y in at.tolist() for k in (1, 2) if even_odd(k, x, y)}
    pts = spark.createDataFrame([*map(tuple, at.tolist()), (float("nan"), 0.0)], "lon double, lat double")
    assert {tuple(r) for r in pg.points_in_polygons(pts, edges).collect()} == want
    # The disc's share by the same lattice, one disc inside, one on an edge, one away.
    blocks = spark.createDataFrame([("in", -1.5, -1.5), ("edge", 4.0, -2.9), ("off", 30.0, 30.0)], "block_id string, lat double, lon double")
    share = {r["block_id"]: r for r in pg.overlap_share(blocks, edges, "block_id", 40.0).collect()}
    assert share["in"]["overlap_pct"] == 100.0 and 50 < share["edge"]["overlap_pct"] < 100 and share["edge"]["n_areas"] == 2
    assert (share["off"]["overlap_pct"], share["off"]["n_areas"]) == (0.0, 0)
    short = pg.overlap_share(blocks, edges, "block_id", 40.0, count_areas=False)
    assert {r["block_id"]: r["overlap_pct"] for r in short.collect()} == {k: r["overlap_pct"] for k, r in share.items()}


def test_cells_and_samples_are_not_broadcast_as_small(spark):
    """Areas and places of few bytes make many cells and samples, which no join may broadcast."""
    # A broadcast of one row counts as 32 MB here, the cells of these areas as more than 64.
    limits = {"spark.sql.autoBroadcastJoinThreshold": "100k", "spark.sql.maxBroadcastTableSize": "40m"}
    at = lambda i, step, span: i * step % (span * 100) / 100.0
    i, h = F.col("id"), F.col("id") % 5 + 8
    corners = ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))
    ring = F.array(*(F.array(at(i, 1013, 30) + 0.013 + h * x, at(i, 617, 30) + 0.017 + h * y) for x, y in corners))
    edges = pg.edges_of_rings(spark.range(2500).select(i.alias("area_id"), ring.alias("ring")), "area_id", "ring")
    points = spark.range(5000).select(at(i, 4729, 50).alias("lon"), at(i, 7919, 50).alias("lat"))
    blocks = spark.range(600).select("id", (at(i, 9100, 60) - 15.0).alias("lon"), (at(i, 3700, 60) - 15.0).alias("lat"))
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        inside = pg.points_in_polygons(points, edges).count()
        share = {r["id"]: r["overlap_pct"] for r in pg.overlap_share(blocks, edges, "id", 150.0, count_areas=False).collect()}
    finally:
        for key in limits:
            spark.conf.unset(key)
    k, p = np.arange(2500), np.arange(5000)[:, None]
    within = lambda x, y: abs(x - at(k, 1013, 30) - 0.013) + abs(y - at(k, 617, 30) - 0.017) < k % 5 + 8
    assert inside == within(at(p, 4729, 50), at(p, 7919, 50)).sum()
    steps = np.array([(a, b) for a in range(-20, 21) for b in range(-20, 21) if a * a + b * b <= 420.25]) * 15e4 / 20.5 / pg.MAP_RADIUS_M
    for b in range(0, 600, 20):
        y = np.log(np.tan(np.pi / 4 + np.radians(at(b, 3700, 60) - 15.0) / 2)) + steps[:, 1:]
        hit = within(at(b, 9100, 60) - 15.0 + np.degrees(steps[:, :1]), np.degrees(np.arctan(np.exp(y)) * 2 - np.pi / 2)).any(axis=1)
        assert share[b] == pytest.approx(100 * hit.mean(), abs=0.0051)
    assert len(share) == 600 and {0.0, 100.0} < set(share.values())


def test_touched_gathers_groups_and_pairs_keep_repeats(spark):
    """One row a query with all groups near it; queries at one place are searched as one."""
    ref = spark.createDataFrame([(1, 0.0, 0.0, 3), (2, 0.0, 0.5, 1), (3, 0.0, 0.5, 3), (4, 40.0, 40.0, 2)], "r int, lat double, lon double, g int")
    q = spark.createDataFrame([(1, 0.0, 0.2), (2, 0.0, 0.2), (3, 40.0, 40.1), (4, -60.0, 0.0)], "q int, lat double, lon double")
    got = sp.CubeIndex(ref, carry=["g"]).touched(sp.as_queries(q, ["q"]), ["q"], 60.0, "near")
    assert {r["q"]: r["near"] for r in got.collect()} == {1: [1, 3], 2: [1, 3], 3: [2]}
    index = sp.CubeIndex(ref, ids=["r"])
    searched = []
    start = index._start
    index._start = lambda queries: searched.append(queries.count()) or start(queries)
    pairs = index.pairs(sp.as_queries(q, ["q"]), ["q"], 60.0).collect()
    assert {(r["q"], r["r"]) for r in pairs} == {(k, j) for k in (1, 2) for j in (1, 2, 3)} | {(3, 4)} and len(pairs) == 7
    assert searched == [3]  # four queries at three places


def test_searches_use_all_tasks(spark):
    """A place is a few bytes; sized by bytes, all places would be one task's."""
    rows = [(i, (i * 37 % 160) - 80.0, (i * 91 % 360) - 180.0) for i in range(400)]
    places = spark.createDataFrame(rows, "q long, lat double, lon double")
    index = sp.CubeIndex(places, ids=["q"], keep=1)
    spots = index._spots(sp.as_queries(places, ["q"]))
    used = spots.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == index.width > 1
    assert len(index.base.inputFiles()) == index.width
