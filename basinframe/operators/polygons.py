"""Polygons as edge tables ``(area_id, ord, x1, y1, x2, y2)``.

A point is inside when a ray to the east crosses an odd number of edges. Areas are filed
under the cells they touch: a cell without an edge is inside as a whole, and a point in
another cell meets the area's edges of its row of cells. Grids are filled row by row from
sorted crossings.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.functions.geo import Grid
from basinframe.session import materialize, shuffle_width

BAND_DEG = 0.5
CELL_DEG = 1.0
TILE_DEG = 5.0


def edges_of_rings(rings: DataFrame, area_id: str, coords: str) -> DataFrame:
    """One row per edge from closed rings ``ARRAY<ARRAY<DOUBLE>>`` of [lon, lat]."""
    n = F.size(coords)
    pairs = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.struct(
            F.element_at(F.element_at(coords, i), 1).alias("x1"),
            F.element_at(F.element_at(coords, i), 2).alias("y1"),
            F.element_at(F.element_at(coords, i + 1), 1).alias("x2"),
            F.element_at(F.element_at(coords, i + 1), 2).alias("y2"),
        ),
    )
    return rings.where(n > 1).select(area_id, F.explode(pairs).alias("e")).select(area_id, "e.*")


def boxes(edges: DataFrame) -> DataFrame:
    return edges.groupBy("area_id").agg(
        F.min(F.least("x1", "x2")).alias("min_x"),
        F.max(F.greatest("x1", "x2")).alias("max_x"),
        F.min(F.least("y1", "y2")).alias("min_y"),
        F.max(F.greatest("y1", "y2")).alias("max_y"),
    )


def _band(c, size: float = BAND_DEG):
    return F.floor(c / F.lit(size)).cast("int")


def _cover_rows(edges: DataFrame, size: float) -> DataFrame:
    """``(area_id, ty, cut, edge, mid)``: an area's edges in a row of cells, the cells there
    that an edge comes near, and those it covers whole."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    # Edges on a cell's wall count for the cells on both sides.
    near = 1e-9
    filed = edges.withColumn("ty", F.explode(F.sequence(_band(low - near, size), _band(high + near, size))))
    bottom, centre = F.col("ty") * size, (F.col("ty") + 0.5) * size
    level = F.col("y1") == F.col("y2")

    def at(y: Column) -> Column:
        inside = F.least(F.greatest(y, low), high)
        return F.col("x1") + (inside - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) * (F.col("x2") - F.col("x1"))

    ends = [F.when(level, F.col(x)).otherwise(at(y)) for x, y in (("x1", bottom), ("x2", bottom + size))]
    crosses = (F.col("y1") > centre) != (F.col("y2") > centre)
    # A small table of areas makes many cells, which many tasks should write.
    filed = filed.repartition(shuffle_width(edges.sparkSession), "area_id", "ty")
    rows = filed.groupBy("area_id", "ty").agg(
        F.collect_list(F.when(~level, F.struct("x1", "y1", "x2", "y2"))).alias("cut"),
        F.sort_array(F.collect_list(F.when(crosses, at(centre)))).alias("xs"),
        F.collect_set(
            F.struct(_band(F.least(*ends) - near, size).alias("a"), _band(F.greatest(*ends) + near, size).alias("b"))
        ).alias("marks"),
    )
    edge_cells = F.array_distinct(F.flatten(F.transform("marks", lambda m: F.sequence(m["a"], m["b"]))))
    starts = F.when(F.size("xs") > 1, F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))

    def span(i: Column) -> Column:
        a, b = (F.ceil(F.element_at("xs", k) / size - 0.5).cast("int") for k in (i, i + 1))
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))

    rows = rows.withColumns({"edge": edge_cells, "mid": F.flatten(F.transform(starts, span))})
    return rows.select("area_id", "ty", "cut", "edge", F.array_except("mid", "edge").alias("mid"))


def _cells(rows: DataFrame) -> DataFrame:
    tagged = F.concat(
        F.transform("edge", lambda c: F.struct(c.alias("tx"), F.lit(False).alias("whole"))),
        F.transform("mid", lambda c: F.struct(c.alias("tx"), F.lit(True).alias("whole"))),
    )
    cells = rows.select("area_id", "ty", "cut", F.explode(tagged).alias("c"))
    return cells.select("c.tx", "ty", "area_id", "c.whole", F.when(~F.col("c.whole"), F.col("cut")).alias("cut"))


def cover(edges: DataFrame, size: float = CELL_DEG) -> DataFrame:
    """``(tx, ty, area_id, whole, cut)``: the cells of ``size`` degrees that an area touches.

    No edge comes near a ``whole`` cell, and its centre is inside, so all of it is. The
    others carry the area's edges in their row of cells, which decide for a point there.
    Rows of cells are stored: by the areas' few bytes a join would take cells for small
    and broadcast them all.
    """
    return _cells(materialize(_cover_rows(edges, size), "cover"))


def _inside(px: str, py: str) -> Column:
    """Whether a point lies in the area whose row of :func:`cover` it met."""
    x, y = F.col(px), F.col(py)

    def crossed(e: Column) -> Column:
        at = e["x1"] + (y - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < at)

    return F.col("whole") | (F.size(F.filter("cut", crossed)) % 2 == 1)


def points_in_polygons(points: DataFrame, edges: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """``(x, y, area_id)`` for every distinct location inside an area.

    Equal locations are tested once; join the answer back to the rows.
    """
    spots = points.select(F.col(x).alias("px"), F.col(y).alias("py")).where("NOT isnan(px) AND NOT isnan(py)").distinct()
    placed = spots.withColumns({"tx": _band(F.col("px"), CELL_DEG), "ty": _band(F.col("py"), CELL_DEG)})
    met = placed.join(cover(edges), ["tx", "ty"])
    return met.where(_inside("px", "py")).select(F.col("px").alias(x), F.col("py").alias(y), "area_id")


def rasterize(edges: DataFrame, grid: Grid) -> DataFrame:
    """``(row, col, area_id)`` for every cell whose centre lies inside an area."""
    half, res = grid.res_deg / 2.0, grid.res_deg
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    # Rows whose centre latitude lies in [low, high).
    first = F.greatest(F.floor((90.0 - half - high) / res).cast("int"), F.lit(0))
    last = F.least(F.ceil((90.0 - half - low) / res).cast("int"), F.lit(grid.n_rows - 1))
    hit = (
        edges.where("y1 <> y2")
        .withColumns({"__a": first, "__b": last})
        .where("__a <= __b")
        .withColumn("row", F.explode(F.sequence("__a", "__b")))
        .withColumn("__y", grid.lat_of("row"))
        .where((F.col("y1") > F.col("__y")) != (F.col("y2") > F.col("__y")))
    )
    at = F.col("x1") + (F.col("__y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    # One row of one area has as many crossings as the outline has folds there.
    spans = hit.groupBy("area_id", "row").agg(F.array_sort(F.collect_list(at)).alias("xs"))
    spans = spans.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2))))
    x_in, x_out = F.element_at("xs", F.col("i")), F.element_at("xs", F.col("i") + 1)
    c0 = F.greatest(F.ceil((x_in + 180.0 - half) / res).cast("int"), F.lit(0))
    c1 = F.least((F.ceil((x_out + 180.0 - half) / res) - 1).cast("int"), F.lit(grid.n_cols - 1))
    return (
        spans.withColumns({"__c0": c0, "__c1": c1})
        .where("__c0 <= __c1")
        .select("area_id", "row", F.explode(F.sequence("__c0", "__c1")).alias("col"))
    )


def province_cells(edges: DataFrame, areas: DataFrame, grid: Grid) -> DataFrame:
    """``(row, col, province_code, province_type)``: where areas overlap the one
    later in file order wins. ``areas`` has ``area_id, ord, code, type``."""
    kind = F.when(F.col("type") == "p", 2).when(F.col("type") == "b", 1).otherwise(0)
    return (
        rasterize(edges, grid)
        .join(areas.select("area_id", "ord", "code", kind.alias("kind")), "area_id")
        .groupBy("row", "col")
        .agg(F.max_by(F.struct("code", "kind"), "ord").alias("w"))
        .select(
            "row", "col", F.col("w.code").alias("province_code"), F.col("w.kind").alias("province_type")
        )
    )


#: Fixed value: radius of the sphere of the web map projection, in metres.
MAP_RADIUS_M = 6378137.0


def overlap_share(
    blocks: DataFrame, edges: DataFrame, block_id: str, radius_km: float = 25.0, half_steps: int = 20, count_areas: bool = True
) -> DataFrame:
    """``block_id, overlap_pct, n_areas``: share of the disc around each block that
    lies inside at least one area. The disc is drawn in the web map projection and
    tested at the centres of a square lattice, so overlapping areas count once.

    Only discs that are not covered by whole cells are sampled at all, and of their samples
    only those in cells that an edge crosses are tested, by the edges of these cells alone.
    ``n_areas`` needs every area of every disc; without ``count_areas`` it is left out.
    """
    k, r = half_steps, radius_km * 1000.0
    step = r / (k + 0.5)
    to_x = F.col("lon") * (pi * MAP_RADIUS_M / 180.0)
    to_y = F.log(F.tan(F.lit(pi / 4) + F.radians("lat") / 2)) * MAP_RADIUS_M
    pad = F.lit(r * 180.0 / (pi * MAP_RADIUS_M))
    parts = cover(edges, BAND_DEG)
    cells = materialize(parts.groupBy("tx", "ty").agg(F.bool_or("whole").alias("whole")), "cells")
    # Places are few bytes and fan out to many cells and samples, which many tasks should make.
    width = shuffle_width(blocks.sparkSession)
    spots = blocks.select("lat", "lon").where("NOT isnan(lat) AND NOT isnan(lon)").repartition(width, "lat", "lon").distinct()
    reach = spots.withColumns(
        {f"__{t}": F.sequence(_band(F.col(c) - pad), _band(F.col(c) + pad)) for t, c in (("x", "lon"), ("y", "lat"))}
    )
    reach = reach.withColumn("n", F.size("__x") * F.size("__y")).withColumn("tx", F.explode("__x")).withColumn("ty", F.explode("__y"))
    # Joins keep their left side, which fans out from few bytes and must not be the one broadcast.
    met = reach.join(cells, ["tx", "ty"], "left").groupBy("lat", "lon", "n").agg(
        F.count_if("whole").alias("n_whole"), F.count("whole").alias("n_met")
    )
    met = materialize(met.where("n_met > 0").drop("n_met"), "discs")
    axis = range(-k, k + 1)
    n_samples = sum(i * i + j * j <= (k + 0.5) ** 2 for i in axis for j in axis)
    steps = F.sequence(F.lit(-k), F.lit(k))

    def sampled(discs: DataFrame) -> DataFrame:
        fan = discs.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
        return fan.where(F.col("i") * F.col("i") + F.col("j") * F.col("j") <= (k + 0.5) ** 2).select(
            F.col("lat").alias("at_lat"),
            F.col("lon").alias("at_lon"),
            ((to_x + F.col("i") * step) * (180.0 / (pi * MAP_RADIUS_M))).alias("px"),
            F.degrees(F.atan(F.exp((to_y + F.col("j") * step) / MAP_RADIUS_M)) * 2 - pi / 2).alias("py"),
        )

    samples = sampled(met.where("n_whole < n").repartition(width, "lat", "lon"))
    samples = samples.withColumns({"tx": _band(F.col("px")), "ty": _band(F.col("py"))})
    # A cell that one area covers whole needs no edges of the others; equal ones count once.
    cut = parts.where("NOT whole").join(cells.where("NOT whole").select("tx", "ty"), ["tx", "ty"], "left_semi")
    cut = cut.select("tx", "ty", "whole", F.sort_array("cut").alias("cut")).distinct()
    filled = materialize(cut.unionByName(cells.where("whole"), allowMissingColumns=True), "filled")
    covered = samples.alias("s").join(
        filled.alias("c"), (F.col("s.tx") == F.col("c.tx")) & (F.col("s.ty") == F.col("c.ty")) & _inside("px", "py"), "left_semi"
    )
    share = covered.groupBy(F.col("at_lat").alias("lat"), F.col("at_lon").alias("lon")).agg(
        (F.count(F.lit(1)).cast("double") / float(n_samples) * 100.0).alias("overlap_pct")
    )
    share = share.unionByName(met.where("n_whole = n").select("lat", "lon", F.lit(100.0).alias("overlap_pct")))
    pct = F.round(F.coalesce("overlap_pct", F.lit(0.0)), 2).alias("overlap_pct")
    out = blocks.select(block_id, "lat", "lon").join(share, ["lat", "lon"], "left").select(block_id, "lat", "lon", pct)
    if not count_areas:
        return out.select(block_id, "overlap_pct")
    every = materialize(sampled(met), "samples")
    inside = points_in_polygons(every, edges, "px", "py")
    areas = every.join(inside, ["px", "py"]).groupBy(F.col("at_lat").alias("lat"), F.col("at_lon").alias("lon")).agg(
        F.count_distinct("area_id").alias("n_areas")
    )
    return out.join(areas, ["lat", "lon"], "left").select(block_id, "overlap_pct", F.coalesce("n_areas", F.lit(0)).alias("n_areas"))


def overlap_names(blocks_areas: DataFrame, block_id: str, name: str, n: int = 10) -> DataFrame:
    """First ``n`` names of the areas found for each block, in order."""
    from basinframe.operators.ordered import top_n

    named = top_n(blocks_areas.select(block_id, name).distinct(), [block_id], [name], n)
    return named.groupBy(block_id).agg(F.array_sort(F.collect_list(name)).alias("areas"))


def ring_area(edges: DataFrame) -> DataFrame:
    """Planar area of each polygon from its edges (shoelace)."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return edges.groupBy("area_id").agg((F.abs(F.sum(cross)) / 2.0).alias("area"))


def largest_areas(edges: DataFrame, attributes: DataFrame, n: int = 600) -> DataFrame:
    """The ``n`` largest areas, the overlay a map shows. Areas that differ by the rounding
    of their coordinates only are equal, and the smaller id comes first."""
    sized = ring_area(edges).join(attributes, "area_id")
    return sized.orderBy(F.round("area", 9).desc(), "area_id").limit(n)


def decimate_line(coords: str, stride: int = 50):
    """Every ``stride``-th vertex of a line and always its last, in order."""
    # The last vertex is appended outside the lambda, which would otherwise read
    # the whole line again for every vertex.
    kept = F.filter(coords, lambda v, i: i % stride == 0)
    last = F.slice(coords, -1, 1)
    n = F.size(coords)
    return F.when((n - 1) % stride == 0, kept).when(n > 0, F.concat(kept, last)).otherwise(kept)
