"""Spatial and raster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basinframe.catalog.registry import fix, fix_sql, query
from basinframe.catalog.shapes import (
    CELLS_SQL,
    GEO_SQL,
    GRID_DEG,
    N_COLS,
    N_ROWS,
    cells,
    chord_sql,
    customers_as_points,
    km_sql,
    lat_sql,
    lon_sql,
    suppliers_as_points,
    xyz_sql,
)
from basinframe.functions.geo import Grid, chord_of_km, km_of_chord, unit_xyz, wrap_lon
from basinframe.operators import polygons as pg
from basinframe.operators.overlap import overlap_exact
from basinframe.operators import raster as r
from basinframe.operators import spatial as sp

GRID = Grid(GRID_DEG)

_DIST = f"WITH {GEO_SQL}, d AS (SELECT c_custkey, s_suppkey, {chord_sql('c', 's')} AS chord FROM c, s)"


@query(
    "cell_index",
    f"""SELECT c_custkey, CAST(least(greatest(floor((9e1 - {lat_sql('c_custkey')}) / 5e-2), 0), 3599) AS INT) AS row,
        CAST(least(greatest(floor(({lon_sql('c_custkey')} + 18e1) / 5e-2), 0), 7199) AS INT) AS col FROM customer""",
)
def cell_index(t):
    g = Grid()
    return customers_as_points(t).select("c_custkey", g.row_of("lat").alias("row"), g.col_of("lon").alias("col"))


@query(
    "cell_centres",
    """WITH g AS (SELECT unnest(range(36)) AS r), h AS (SELECT unnest(range(72)) AS c)
       SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, 875e-1 - 5e0 * r AS lat, -1775e-1 + 5e0 * c AS lon,
         CAST((SELECT count(*) FROM supplier WHERE floor((9e1 - ((s_suppkey * 6151 % 16000) / 1e2 - 8e1)) / 5e0) = r
           AND floor((((s_suppkey * 15013 % 36000) / 1e2 - 18e1) + 18e1) / 5e0) = c) AS BIGINT) AS n_suppliers FROM g, h""",
)
def cell_centres(t):
    """Every grid cell with its centre and the suppliers in it."""
    s = suppliers_as_points(t)
    n = s.groupBy(GRID.row_of("lat").alias("row"), GRID.col_of("lon").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    out = GRID.centres(t.spark).join(n, ["row", "col"], "left")
    return out.select("row", "col", "lat", "lon", F.coalesce("n", F.lit(0)).alias("n_suppliers"))


@query(
    "unit_vectors",
    f"WITH {GEO_SQL} SELECT c_custkey, {fix_sql('x', 9)} AS x, {fix_sql('y', 9)} AS y, {fix_sql('z', 9)} AS z FROM c",
)
def unit_vectors(t):
    v = customers_as_points(t).select("c_custkey", *unit_xyz("lat", "lon"))
    return v.select("c_custkey", *[fix(k, 9).alias(k) for k in "xyz"])


@query(
    "wrapped_longitude",
    "SELECT o_orderkey, CASE WHEN l >= 180 THEN l - 36e1 ELSE l END AS lon FROM (SELECT o_orderkey, (o_custkey * 104729 % 36000) / 1e2 AS l FROM orders)",
)
def wrapped_longitude(t):
    lon = (F.col("o_custkey") * 104729 % 36000) / F.lit(100.0)
    return t.orders.select("o_orderkey", wrap_lon(lon).alias("lon"))


@query("radius_join", f"{_DIST} SELECT c_custkey, s_suppkey, {fix_sql(km_sql('chord'), 5)} AS distance_km FROM d WHERE chord <= {chord_of_km(500.0)!r}")
def radius_join(t):
    out = sp.radius_pairs(customers_as_points(t), suppliers_as_points(t), "c_custkey", "s_suppkey", 500.0)
    return out.withColumn("distance_km", fix("distance_km", 5))


@query(
    "radius_totals",
    f"""{_DIST} SELECT c_custkey, count(*) FILTER (chord <= {chord_of_km(800.0)!r}) AS n_rows,
        CAST(coalesce(sum(s_suppkey % 2) FILTER (chord <= {chord_of_km(800.0)!r}), 0) AS BIGINT) AS label FROM d GROUP BY 1""",
)
def radius_totals(t):
    """How many suppliers, and how many of one kind, lie within 800 km."""
    s = suppliers_as_points(t).withColumn("label", F.col("s_suppkey") % 2)
    return sp.radius_totals(customers_as_points(t), s, "c_custkey", 800.0, ["label"])


@query(
    "offset_statistics",
    f"""{_DIST} SELECT s_suppkey, count(*) FILTER (near) AS n_wells, count(*) FILTER (near AND c_custkey % 5 > 0) AS n_labeled,
        CAST(coalesce(sum(c_custkey % 2) FILTER (near AND c_custkey % 5 > 0), 0) AS BIGINT) AS n_discoveries FROM (SELECT *, chord <= {chord_of_km(1000.0)!r} AS near FROM d) GROUP BY 1""",
)
def offset_statistics(t):
    """Offset-well totals around every block, excluded wells apart."""
    c = customers_as_points(t).withColumns(
        {
            "n_labeled": (F.col("c_custkey") % 5 > 0).cast("long"),
            "n_discoveries": F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") % 2).otherwise(0),
        }
    )
    out = sp.radius_totals(suppliers_as_points(t), c, "s_suppkey", 1000.0, ["n_labeled", "n_discoveries"])
    return out.withColumnRenamed("n_rows", "n_wells")


@query(
    "nearest_join",
    f"{_DIST} SELECT c_custkey, arg_min(s_suppkey, chord) AS s_suppkey, {fix_sql(km_sql('min(chord)'), 5)} AS distance_km FROM d GROUP BY 1",
)
def nearest(t):
    out = sp.nearest_join(customers_as_points(t), suppliers_as_points(t), "c_custkey", "s_suppkey")
    return out.select("c_custkey", "s_suppkey", fix("distance_km", 5).alias("distance_km"))


@query(
    "knn5",
    f"{_DIST}, n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY chord, s_suppkey) AS rank FROM d) SELECT c_custkey, s_suppkey, CAST(rank AS INT) AS rank, {fix_sql(km_sql('chord'), 5)} AS distance_km FROM n WHERE rank <= 5",
)
def knn5(t):
    out = sp.nearest_join(customers_as_points(t), suppliers_as_points(t), "c_custkey", "s_suppkey", 5)
    return out.select("c_custkey", "s_suppkey", "rank", fix("distance_km", 5).alias("distance_km"))


@query(
    "knn20",
    f"{_DIST}, n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY chord, s_suppkey) AS rank FROM d) SELECT c_custkey, s_suppkey, CAST(rank AS INT) AS rank, {fix_sql(km_sql('chord'), 5)} AS distance_km FROM n WHERE rank <= 20",
)
def knn20(t):
    out = sp.nearest_join(customers_as_points(t), suppliers_as_points(t), "c_custkey", "s_suppkey", 20)
    return out.select("c_custkey", "s_suppkey", "rank", fix("distance_km", 5).alias("distance_km"))


@query("buffer_anti", f"{_DIST} SELECT c_custkey FROM d GROUP BY 1 HAVING min(chord) > {chord_of_km(500.0)!r}")
def buffer_anti(t):
    """Customers farther than 500 km from every supplier."""
    return sp.buffer_anti_join(customers_as_points(t), suppliers_as_points(t), "c_custkey", 500.0).select("c_custkey")


# ---- polygons ------------------------------------------------------------------------------

_SQUARES = """sq AS (SELECT s_suppkey AS area_id, x AS cx, y AS cy, 4 + s_suppkey % 9 AS h FROM (
  SELECT s_suppkey, (s_suppkey * 15013 % 32000) / 1e2 - 16e1 + 13e-3 AS x, (s_suppkey * 6151 % 14000) / 1e2 - 7e1 + 17e-3 AS y FROM supplier))"""


def diamonds(t):
    """A diamond around every supplier as an edge table."""
    k = F.col("s_suppkey")
    cx = (k * 15013 % 32000) / F.lit(100.0) - 160.0 + 0.013
    cy = (k * 6151 % 14000) / F.lit(100.0) - 70.0 + 0.017
    h = k % 9 + 4
    ring = F.array(
        *[F.array(cx + h * dx, cy + h * dy) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))]
    )
    rings = t.supplier.select(k.alias("area_id"), ring.alias("ring"))
    return pg.edges_of_rings(rings, "area_id", "ring")


@query(
    "point_in_polygon",
    f"""WITH {_SQUARES}, c AS (SELECT c_custkey, {lat_sql('c_custkey')} AS lat, {lon_sql('c_custkey')} AS lon FROM customer)
        SELECT c_custkey, area_id FROM c, sq WHERE abs(lon - cx) + abs(lat - cy) < h""",
)
def point_in_polygon(t):
    pts = customers_as_points(t)
    inside = pg.points_in_polygons(pts, diamonds(t))
    return pts.join(inside, ["lon", "lat"]).select("c_custkey", "area_id")


@query(
    "province_cells",
    f"""WITH {_SQUARES}, g AS (SELECT r, c, 89e0 - 2e0 * r AS lat, -179e0 + 2e0 * c AS lon FROM (SELECT unnest(range(90)) AS r), (SELECT unnest(range(180)) AS c))
        SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, arg_max(area_id * 10, area_id) AS province_code,
          CAST(arg_max(CASE area_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END, area_id) AS INT) AS province_type
        FROM g, sq WHERE abs(lon - cx) + abs(lat - cy) < h GROUP BY 1, 2""",
)
def province_cells(t):
    """Diamonds filled into a two-degree grid, the later area winning."""
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "p").when(k % 3 == 1, "b")
    areas = t.supplier.select(k.alias("area_id"), k.alias("ord"), (k * 10).alias("code"), kind.alias("type"))
    return pg.province_cells(diamonds(t), areas, Grid(2.0))


@query(
    "overlap_pct",
    f"""WITH {_SQUARES}, b AS (SELECT c_custkey, lat, lon, lon * (pi() * 6378137e0 / 18e1) AS bx, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137e0 AS byy
          FROM (SELECT c_custkey, {lat_sql('c_custkey')} AS lat, {lon_sql('c_custkey')} AS lon FROM customer)),
        o AS (SELECT i, j FROM (SELECT unnest(range(-20, 21)) AS i), (SELECT unnest(range(-20, 21)) AS j) WHERE i * i + j * j <= 42025e-2),
        near AS (SELECT DISTINCT c_custkey FROM b, sq WHERE abs(lon - cx) <= h + 4 AND abs(lat - cy) <= h + 4),
        p AS (SELECT c_custkey, i, j, (bx + i * 15e4 / 205e-1) * (18e1 / (pi() * 6378137e0)) AS lon,
                degrees(atan(exp((byy + j * 15e4 / 205e-1) / 6378137e0)) * 2 - pi() / 2) AS lat FROM b SEMI JOIN near USING (c_custkey), o),
        q AS (SELECT c_custkey, i, j, count(area_id) AS n FROM p LEFT JOIN sq ON abs(lon - cx) + abs(lat - cy) < h GROUP BY 1, 2, 3),
        s AS (SELECT c_custkey, {fix_sql('1e2 * count(*) FILTER (n > 0) / count(*)', 2)} AS pct FROM q GROUP BY 1)
        SELECT b.c_custkey, coalesce(pct, 0) AS overlap_pct FROM b LEFT JOIN s USING (c_custkey)""",
)
def overlap_pct(t):
    """Share of a 150 km disc covered by diamonds, overlaps counted once."""
    out = pg.overlap_share(customers_as_points(t), diamonds(t), "c_custkey", 150.0, count_areas=False)
    return out.select("c_custkey", fix("overlap_pct", 2).alias("overlap_pct"))


def _corner_sql(x: str, y: str) -> str:
    """Surface of the unit disc to the lower left of a point, by the circle's segments."""
    h = lambda t: f"(({t}) * sqrt(1 - ({t}) * ({t})) + asin({t})) / 2"
    cap = lambda t: f"(acos({t}) - ({t}) * sqrt(1 - ({t}) * ({t})))"
    x, y = f"least(greatest({x}, -1e0), 1e0)", f"least(greatest({y}, -1e0), 1e0)"
    s = f"(-sqrt(1 - ({y}) * ({y})))"
    return f"""CASE WHEN ({x}) * ({x}) + ({y}) * ({y}) < 1 THEN
          CASE WHEN {y} >= 0 THEN 2 * ({h(s)} + pi() / 4) ELSE 0 END + ({y}) * (({x}) - {s}) + {h(x)} - {h(s)}
        WHEN {x} < 0 AND {y} < 0 THEN 0e0
        WHEN {y} < 0 THEN {cap(f'-({y})')} WHEN {x} < 0 THEN {cap(f'-({x})')}
        ELSE pi() - {cap(x)} - {cap(y)} END"""


def _map_sql(lat: str) -> str:
    return f"ln(tan(pi() / 4 + radians({lat}) / 2)) * 6378137e0"


_BOXES = f"""bx AS (SELECT s_suppkey AS area_id, floor({lon_sql('s_suppkey', 15013)} / 4) AS gx, floor({lat_sql('s_suppkey', 6151)} / 4) AS gy FROM supplier),
m AS (SELECT area_id, gx * 4 * (pi() * 6378137e0 / 18e1) AS x1, (gx + 1) * 4 * (pi() * 6378137e0 / 18e1) AS x2,
  {_map_sql('gy * 4')} AS y1, {_map_sql('(gy + 1) * 4')} AS y2 FROM bx),
b AS (SELECT c_custkey, {lon_sql('c_custkey')} * (pi() * 6378137e0 / 18e1) AS cx, {_map_sql(lat_sql('c_custkey'))} AS cy FROM customer),
u AS (SELECT c_custkey, area_id, (x1 - cx) / 15e4 AS x1, (x2 - cx) / 15e4 AS x2, (y1 - cy) / 15e4 AS y1, (y2 - cy) / 15e4 AS y2
  FROM b JOIN m ON x1 < cx + 15e4 AND x2 > cx - 15e4 AND y1 < cy + 15e4 AND y2 > cy - 15e4),
s AS (SELECT *, ({_corner_sql('x2', 'y2')}) - ({_corner_sql('x1', 'y2')}) - ({_corner_sql('x2', 'y1')}) + ({_corner_sql('x1', 'y1')}) AS v FROM u),
a AS (SELECT c_custkey, sum(v) AS v, count(*) FILTER (v > 1e-9) AS n FROM s GROUP BY 1),
o AS (SELECT c_custkey, sum(v) AS v FROM (SELECT DISTINCT c_custkey, round(x1, 6) AS rx, round(y1, 6) AS ry, first(v) AS v FROM s GROUP BY ALL) GROUP BY 1)"""


@query(
    "overlap_exact",
    f"""WITH {_BOXES} SELECT c_custkey, {fix_sql('coalesce(o.v, 0) * 1e2 / pi()', 5)} AS overlap_pct,
          {fix_sql('coalesce(a.v, 0) * 1e2 / pi()', 5)} AS summed_pct, coalesce(n, 0) AS n_areas
        FROM customer LEFT JOIN a USING (c_custkey) LEFT JOIN o USING (c_custkey)""",
)
def overlap_share_exact(t):
    """Boxes of four degrees around suppliers; those of one cell lie on each other."""
    side = lambda c, d: (F.floor(F.col(c) / 4) + d) * F.lit(4.0)
    ring = F.array(*[F.array(side("lon", i), side("lat", j)) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    rings = suppliers_as_points(t).select(F.col("s_suppkey").alias("area_id"), ring.alias("ring"))
    out = overlap_exact(customers_as_points(t), pg.edges_of_rings(rings, "area_id", "ring"), "c_custkey", 150.0)
    return out.select("c_custkey", fix("overlap_pct", 5).alias("overlap_pct"), fix("summed_pct", 5).alias("summed_pct"), "n_areas")


@query(
    "overlap_names",
    f"""WITH {_SQUARES}, c AS (SELECT c_custkey % 50 AS block, {lat_sql('c_custkey')} AS lat, {lon_sql('c_custkey')} AS lon FROM customer),
        n AS (SELECT DISTINCT block, 'A' || area_id AS name FROM c, sq WHERE abs(lon - cx) + abs(lat - cy) < h),
        k AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY name) AS i FROM n)
        SELECT block, string_agg(name, ',' ORDER BY name) AS areas FROM k WHERE i <= 10 GROUP BY 1""",
)
def overlap_names(t):
    # A block's customers at one place see the same areas.
    pts = customers_as_points(t).select("lat", "lon", (F.col("c_custkey") % 50).alias("block")).distinct()
    inside = pts.join(pg.points_in_polygons(pts, diamonds(t)), ["lon", "lat"]).select("block", "area_id").distinct()
    named = inside.select("block", F.concat(F.lit("A"), "area_id").alias("name"))
    return pg.overlap_names(named, "block", "name").select("block", F.array_join("areas", ",").alias("areas"))


@query(
    "largest_areas",
    f"WITH {_SQUARES} SELECT area_id, {fix_sql('2e0 * h * h', 4)} AS area FROM sq ORDER BY h DESC, area_id LIMIT 600",
)
def largest_areas(t):
    areas = t.supplier.select(F.col("s_suppkey").alias("area_id"))
    return pg.largest_areas(diamonds(t), areas).withColumn("area", fix("area", 4))


# ---- cells ---------------------------------------------------------------------------------


@query(
    "coarsen_mean",
    f"WITH {CELLS_SQL} SELECT CAST(row // 3 AS INT) AS row, CAST(col // 3 AS INT) AS col, {fix_sql('avg(CASE WHEN w % 9 > 0 THEN v END)', 5)} AS v FROM cells GROUP BY 1, 2 HAVING count(*) FILTER (w % 9 > 0) > 0",
)
def coarsen_mean(t):
    gappy = cells(t).withColumn("v", F.when(F.col("w") % 9 > 0, F.col("v")).otherwise(F.lit(float("nan"))))
    return r.coarsen_mean(gappy, 3, "v").where("v IS NOT NULL").withColumn("v", fix("v", 5))


_GRAD_SQL = f"""{CELLS_SQL}, n AS (SELECT c.*, u.v AS up, d.v AS dn, l.v AS lf, r.v AS rt FROM cells c
  LEFT JOIN cells u ON u.col = c.col AND u.row = c.row - 1 LEFT JOIN cells d ON d.col = c.col AND d.row = c.row + 1
  LEFT JOIN cells l ON l.row = c.row AND l.col = c.col - 1 LEFT JOIN cells r ON r.row = c.row AND r.col = c.col + 1),
g AS (SELECT row, col, CASE WHEN row = 0 THEN dn - v WHEN row = {N_ROWS - 1} THEN v - up ELSE (dn - up) / 2 END AS dr,
  CASE WHEN col = 0 THEN rt - v WHEN col = {N_COLS - 1} THEN v - lf ELSE (rt - lf) / 2 END AS dc,
  5e0 * pi() * 6371.0088e0 / 18e1 AS s FROM n),
grad AS (SELECT row, col, sqrt(power(dr / s, 2) + power(dc / (s * cos(radians(875e-1 - 5e0 * row))), 2)) AS g FROM g WHERE dr IS NOT NULL AND dc IS NOT NULL)"""


@query("gradient", f"WITH {_GRAD_SQL} SELECT row, col, {fix_sql('g', 7)} AS g FROM grad")
def gradient(t):
    out = r.gradient(cells(t), GRID, "v", "g")
    return out.where("g IS NOT NULL").select("row", "col", fix("g", 7).alias("g"))


@query("slope", f"WITH {_GRAD_SQL} SELECT row, col, {fix_sql('degrees(atan(g / 1e3))', 9)} AS slope FROM grad")
def slope(t):
    out = r.slope_degrees(cells(t), GRID, "v", "slope")
    return out.where("slope IS NOT NULL").select("row", "col", fix("slope", 9).alias("slope"))


@query(
    "robust_z",
    f"""WITH {CELLS_SQL}, s AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM cells)
        SELECT row, col, {fix_sql('(v - m) / (b - a)', 7)} AS z FROM cells, s""",
)
def robust_z(t):
    c = cells(t)
    return r.robust_z(c, "v", "z", r.channel_stats(c, ["v"])).select("row", "col", fix("z", 7).alias("z"))


@query(
    "channel_metadata",
    f"""WITH {CELLS_SQL}, l AS (SELECT 'v' AS channel, v AS x FROM cells UNION ALL SELECT 'w', CASE WHEN w % 4 > 0 THEN w END FROM cells)
        SELECT channel, CASE channel WHEN 'v' THEN 'mGal' ELSE 'm' END AS units, {fix_sql('quantile_cont(x, 0.5)', 6)} AS median,
          {fix_sql('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)', 6)} AS iqr, {fix_sql('count(x) / count(*)', 6)} AS valid_share FROM l GROUP BY 1""",
)
def channel_metadata(t):
    c = cells(t).withColumn("w", F.when(F.col("w") % 4 > 0, F.col("w")))
    meta = r.channel_metadata(r.channel_stats(c, ["v", "w"]), {"v": "mGal", "w": "m"}, "grid", "v1")
    return meta.select("channel", "units", fix("median").alias("median"), fix("iqr").alias("iqr"), fix("valid_share").alias("valid_share"))


@query(
    "channel_sentinel",
    f"WITH {CELLS_SQL} SELECT row, count(*) FILTER (w <> 50) AS n_valid FROM cells GROUP BY 1",
)
def channel_sentinel(t):
    return r.sentinel_to_null(cells(t), "w", 50.0).groupBy("row").agg(F.count("w").alias("n_valid"))


@query(
    "class_of_code",
    f"WITH {CELLS_SQL} SELECT row, col, CAST(CAST(w AS INT) % 6 % 3 AS DOUBLE) AS class FROM cells",
)
def class_of_code(t):
    """Coded cells to ordinal classes through a map drawn from the parts."""
    code = F.concat(F.lit("k"), (F.col("w") % 6).cast("int"))
    size = F.col("p_size") % 6
    classes = t.part.select(F.concat(F.lit("k"), size).alias("code"), (size % 3).alias("class")).distinct()
    coded = cells(t).withColumn("crust", code)
    return r.class_of_code(coded, "crust", classes, "crust").select("row", "col", "class")


_DST = f"dst AS (SELECT c_custkey AS row, 0 AS col, {lat_sql('c_custkey')} AS lat, {lon_sql('c_custkey')} AS lon FROM customer)"
_FRAC = f"""{CELLS_SQL}, {_DST}, f AS (SELECT row, col, {N_ROWS - 1} - (875e-1 - lat) / 5e0 AS u, (lon + 1775e-1) / 5e0 AS r FROM dst),
k AS (SELECT *, CAST(least(floor(u), {N_ROWS - 2}) AS INT) AS i, CAST(least(floor(r), {N_COLS - 2}) AS INT) AS j,
      u BETWEEN 0 AND {N_ROWS - 1} AND r BETWEEN 0 AND {N_COLS - 1} AS inside FROM f)"""


def _dst(t):
    return customers_as_points(t).select(F.col("c_custkey").alias("row"), F.lit(0).alias("col"), "lat", "lon")


_SRC = dict(lat0=87.5, lon0=-177.5, d_lat=5.0, d_lon=5.0, n_lat=N_ROWS, n_lon=N_COLS)


@query(
    "regrid",
    f"""WITH {_FRAC} SELECT k.row, CASE WHEN inside AND a.v IS NOT NULL AND b.v IS NOT NULL AND c.v IS NOT NULL AND d.v IS NOT NULL THEN
          {fix_sql('(1-(u-i))*(1-(r-j))*a.v + (1-(u-i))*(r-j)*b.v + (u-i)*(1-(r-j))*c.v + (u-i)*(r-j)*d.v', 5)} ELSE -1 END AS v
        FROM k LEFT JOIN cells a ON a.row = {N_ROWS - 1} - i AND a.col = j LEFT JOIN cells b ON b.row = {N_ROWS - 1} - i AND b.col = j + 1
        LEFT JOIN cells c ON c.row = {N_ROWS - 2} - i AND c.col = j LEFT JOIN cells d ON d.row = {N_ROWS - 2} - i AND d.col = j + 1""",
)
def regrid(t):
    out = r.regrid(cells(t), _dst(t), "v", **_SRC)
    return out.select("row", F.coalesce(fix("v", 5), F.lit(-1.0)).alias("v"))


@query(
    "regrid_nearest",
    f"""WITH {_FRAC} SELECT k.row, CASE WHEN inside AND v IS NOT NULL THEN v ELSE -1 END AS v FROM k LEFT JOIN cells c
        ON c.row = {N_ROWS - 1} - (CASE WHEN u - i <= 5e-1 THEN i ELSE i + 1 END) AND c.col = (CASE WHEN r - j <= 5e-1 THEN j ELSE j + 1 END)""",
)
def regrid_nearest(t):
    out = r.regrid(cells(t), _dst(t), "v", method="nearest", **_SRC)
    return out.select("row", F.coalesce("v", F.lit(-1.0)).alias("v"))


@query(
    "neighbourhood",
    f"""WITH {CELLS_SQL} SELECT a.row, a.col, {fix_sql('avg(b.v)', 5)} AS v_mean_near, {fix_sql('stddev_pop(b.v)', 5)} AS v_std_near, count(b.v) AS n
        FROM cells a JOIN cells b ON abs(a.row - b.row) <= 2 AND least(abs(a.col - b.col), {N_COLS} - abs(a.col - b.col)) <= 2 GROUP BY 1, 2""",
)
def neighbourhood(t):
    """Mean and spread over five by five cells, columns wrapping."""
    c = cells(t)
    out = r.neighbourhood(c, GRID, ["v"], {"near": 2})
    n = c.select(F.col("row").alias("r2"), F.col("col").alias("c2"))
    near = c.select("row", "col", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("dr")).withColumn(
        "dc", F.explode(F.sequence(F.lit(-2), F.lit(2)))
    )
    hits = near.select(
        "row", "col", (F.col("row") + F.col("dr")).alias("r2"), F.pmod(F.col("col") + F.col("dc"), F.lit(N_COLS)).alias("c2")
    ).join(n, ["r2", "c2"])
    counts = hits.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    return out.join(counts, ["row", "col"]).select(
        "row", "col", fix("v_mean_near", 5).alias("v_mean_near"), fix("v_std_near", 5).alias("v_std_near"), "n"
    )


_CENTRES = """g0 AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, 875e-1 - 5e0 * r AS lat, -1775e-1 + 5e0 * c AS lon
  FROM (SELECT unnest(range(36)) AS r), (SELECT unnest(range(72)) AS c))"""


@query(
    "distance_grid",
    f"WITH {GEO_SQL}, {_CENTRES}, g AS (SELECT *, {xyz_sql('g0')} FROM g0) SELECT row, col, {fix_sql(km_sql('min(' + chord_sql('g', 's') + ')'), 4)} AS km FROM g, s GROUP BY 1, 2",
)
def distance_grid(t):
    out = r.distance_grid(GRID.centres(t.spark), suppliers_as_points(t), "km")
    return out.withColumn("km", fix("km", 4))


@query(
    "well_distance_channels",
    f"""WITH {GEO_SQL}, {_CENTRES}, g AS (SELECT *, {xyz_sql('g0')} FROM g0)
        SELECT row, col, {fix_sql(km_sql('min(' + chord_sql('g', 'c') + ') FILTER (c_custkey % 3 = 0)'), 4)} AS dist_discovery_km,
          {fix_sql(km_sql('min(' + chord_sql('g', 'c') + ') FILTER (c_custkey % 3 > 0)'), 4)} AS dist_dryhole_km FROM g, c WHERE 1950 + c_custkey % 70 <= 1999 GROUP BY 1, 2""",
)
def well_distance_channels(t):
    """Distances to what was known by 1999."""
    wells = customers_as_points(t).withColumns(
        {"label": (F.col("c_custkey") % 3 == 0).cast("int"), "spud_year": F.col("c_custkey") % 70 + 1950}
    )
    out = r.well_distance_channels(GRID.centres(t.spark), wells, 1999)
    return out.select("row", "col", fix("dist_discovery_km", 4).alias("dist_discovery_km"), fix("dist_dryhole_km", 4).alias("dist_dryhole_km"))


_SHELF = f"""{CELLS_SQL}, e AS (SELECT row, col, NOT (v * 37 % 100 - 50 > -2e1) AS deep FROM cells),
shelf AS (SELECT a.row, a.col FROM e a WHERE NOT deep AND EXISTS (SELECT 1 FROM e b WHERE b.deep AND abs(a.row - b.row) + abs(a.col - b.col) = 1))"""


@query("shelf_break", f"WITH {_SHELF} SELECT row, col FROM shelf")
def shelf_break(t):
    return r.shelf_break_cells(cells(t).withColumn("e", F.col("v") * 37 % 100 - 50.0), "e", -20.0).select("row", "col")


@query(
    "shelf_distance",
    f"""WITH {_SHELF}, {_CENTRES}, g AS (SELECT *, {xyz_sql('g0')} FROM g0), h AS (SELECT g.* FROM g JOIN shelf USING (row, col))
        SELECT g.row, g.col, {fix_sql(km_sql('min(' + chord_sql('g', 'h') + ')'), 4)} AS km FROM g, h GROUP BY 1, 2""",
)
def shelf_distance(t):
    """Distance from every cell to the nearest cell of the break."""
    shelf = r.shelf_break_cells(cells(t).withColumn("e", F.col("v") * 37 % 100 - 50.0), "e", -20.0)
    pts = shelf.select(GRID.lat_of("row").alias("lat"), GRID.lon_of("col").alias("lon"))
    return r.distance_grid(GRID.centres(t.spark), pts, "km").withColumn("km", fix("km", 4))


@query(
    "idw",
    f"""WITH {GEO_SQL}, {_CENTRES}, g AS (SELECT *, {xyz_sql('g0')} FROM g0),
        d AS (SELECT row, col, s_suppkey, {km_sql(chord_sql('g', 's'))} AS km FROM g, s),
        n AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY km, s_suppkey) AS i FROM d)
        SELECT row, col, {fix_sql('sum((s_suppkey % 50) / power(greatest(km, 1e-9), 2)) / sum(1 / power(greatest(km, 1e-9), 2))', 5)} AS field,
          {fix_sql('avg(km)', 4)} AS mean_distance_km FROM n WHERE i <= 12 GROUP BY 1, 2""",
)
def idw(t):
    pts = suppliers_as_points(t).withColumn("q", (F.col("s_suppkey") % 50).cast("double"))
    out = r.idw(GRID.centres(t.spark), pts, "q", "s_suppkey", k=12)
    return out.select("row", "col", fix("field", 5).alias("field"), fix("mean_distance_km", 4).alias("mean_distance_km"))


@query(
    "chord_to_km",
    f"WITH {GEO_SQL} SELECT c_custkey, {fix_sql(km_sql('sqrt(power(x-1,2)+power(y,2)+power(z,2))'), 5)} AS km FROM c",
)
def chord_to_km(t):
    """Great-circle distance of every customer from the origin of coordinates."""
    v = customers_as_points(t).select("c_custkey", *unit_xyz("lat", "lon"))
    chord = F.sqrt(F.pow(F.col("x") - 1, 2) + F.pow("y", 2) + F.pow("z", 2))
    return v.select("c_custkey", fix(km_of_chord(chord), 5).alias("km"))

