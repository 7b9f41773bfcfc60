"""Exact share of a disc that areas cover, each place counted once.

Areas are edge tables ``(area_id, x1, y1, x2, y2)`` in degrees under the even-odd rule, so
holes and rings of either direction need no care. Discs are drawn in the web map
projection, where edges are straight between projected vertices. Edges meet the discs
near their area in latitude bands, are cut into strips of a disc that hold few edges each,
and a strip is swept from bottom to top.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.operators.polygons import MAP_RADIUS_M, TILE_DEG, boxes
from basinframe.session import materialize, shuffle_width

#: The projection ends here; areas that reach a pole are cut at this latitude.
MAX_LAT = 89.0
#: Edges a strip should hold; its sweep compares them with each other.
STRIP_EDGES = 128
BAND_M = 50_000.0
PLACE = ["lat", "lon"]


def _map_x(lon: Column) -> Column:
    return lon * (pi * MAP_RADIUS_M / 180.0)


def _map_y(lat: Column) -> Column:
    cut = F.greatest(F.least(lat, F.lit(MAX_LAT)), F.lit(-MAX_LAT))
    return F.log(F.tan(F.lit(pi / 4) + F.radians(cut) / 2)) * MAP_RADIUS_M


def _tiles(low: Column, high: Column) -> Column:
    size = pi * MAP_RADIUS_M / 180.0 * TILE_DEG
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def _reach(places: DataFrame, edges: DataFrame, r: float) -> DataFrame:
    """(place, area) whose boxes meet."""
    tiled = boxes(edges).withColumn("tx", _tiles(F.col("min_x"), F.col("max_x")))
    tiled = tiled.withColumn("ty", _tiles(F.col("min_y"), F.col("max_y")))
    near = places.withColumn("tx", _tiles(F.col("cx") - r, F.col("cx") + r))
    near = near.withColumn("ty", _tiles(F.col("cy") - r, F.col("cy") + r)).join(tiled, ["tx", "ty"])
    meet = (
        (F.col("cx") + r >= F.col("min_x")) & (F.col("cx") - r <= F.col("max_x"))
        & (F.col("cy") + r >= F.col("min_y")) & (F.col("cy") - r <= F.col("max_y"))
    )
    return near.where(meet).select(*PLACE, "cx", "cy", "area_id").distinct()


def _cut(low: Column, high: Column) -> list[Column]:
    """The edge's columns between two heights; edges run upwards."""
    a, b = F.greatest("y1", low), F.least("y2", high)
    x_at = F.col("x1") + (F.col("x2") - F.col("x1")) * ((a - F.col("y1")) / (F.col("y2") - F.col("y1")))
    x_to = F.col("x1") + (F.col("x2") - F.col("x1")) * ((b - F.col("y1")) / (F.col("y2") - F.col("y1")))
    return [x_at.alias("x1"), a.alias("y1"), x_to.alias("x2"), b.alias("y2")]


def _strips(places: DataFrame, edges: DataFrame, r: float) -> DataFrame:
    """Edges in units of the disc's radius from its centre, cut to strips of the disc."""
    up = F.col("y1") < F.col("y2")
    edges = edges.select(
        "area_id",
        *(F.when(up, F.col(f"{c}{i}")).otherwise(F.col(f"{c}{3 - i}")).alias(f"{c}{i}") for i in (1, 2) for c in "xy"),
    )
    band = lambda y: F.floor(y / BAND_M)
    filed = edges.where("y1 < y2").withColumn("band", F.explode(F.sequence(band(F.col("y1")), band(F.col("y2")))))
    south, north = F.col("cy") - r, F.col("cy") + r
    asked = _reach(places, edges, r).withColumn("band", F.explode(F.sequence(band(south), band(north))))
    # An edge is taken in the first band it shares with the disc. What lies east of the disc
    # never decides what is inside; what lies west of it does.
    near = asked.join(filed, ["area_id", "band"]).where(
        (F.col("band") == band(F.greatest(F.col("y1"), south)))
        & (F.col("y1") < north) & (F.col("y2") > south) & (F.least("x1", "x2") <= F.col("cx") + r)
    )
    unit = near.select(
        *PLACE, "area_id", *(((F.col(f"{c}{i}") - F.col(f"c{c}")) / r).alias(f"{c}{i}") for i in (1, 2) for c in "xy")
    )
    cut = unit.select(*PLACE, "area_id", *_cut(F.lit(-1.0), F.lit(1.0))).where("y1 < y2")
    cut = materialize(cut, "disc_edges")
    n = cut.groupBy(*PLACE).agg(F.ceil(F.count(F.lit(1)) / STRIP_EDGES).alias("n_strips"))
    tall = 2.0 / F.col("n_strips")
    strip = lambda y: F.least(F.floor((y + 1.0) / tall), F.col("n_strips") - 1)
    spread = cut.join(n, PLACE).withColumn("strip", F.explode(F.sequence(strip(F.col("y1")), strip(F.col("y2")))))
    low, high = F.col("strip") * tall - 1.0, (F.col("strip") + 1) * tall - 1.0
    return spread.select(*PLACE, "strip", "area_id", *_cut(low, high)).where("y1 < y2")


def _arc(y: np.ndarray) -> np.ndarray:
    """Integral of sqrt(1 - y^2)."""
    y = np.clip(y, -1.0, 1.0)
    return (y * np.sqrt(1.0 - y * y) + np.arcsin(y)) / 2.0


def _events(x1, y1, x2, y2) -> np.ndarray:
    """Heights at which edges end, cross each other or cross the circle."""
    slope = (x2 - x1) / (y2 - y1)
    low, high = np.maximum(y1[:, None], y1), np.minimum(y2[:, None], y2)
    gap = lambda y: (x1 + (y - y1) * slope) - (x1[:, None] + (y - y1[:, None]) * slope[:, None])
    a, b = gap(low), gap(high)
    crossing = (low < high) & (a * b < 0)
    met = low[crossing] + (high - low)[crossing] * a[crossing] / (a - b)[crossing]
    # x = p + slope * y on the circle.
    p = x1 - slope * y1
    qa, qb = 1.0 + slope**2, p * slope
    root = np.sqrt(np.maximum(qb**2 - qa * (p**2 - 1.0), 0.0))
    on = np.concatenate([(-qb - root) / qa, (-qb + root) / qa])
    on = on[(on > np.tile(y1, 2)) & (on < np.tile(y2, 2))]
    return np.unique(np.concatenate([y1, y2, met, on]))


def sweep(x1, y1, x2, y2, area: np.ndarray, n_areas: int) -> np.ndarray:
    """Surface inside the unit disc of each area, and last of their union.

    Between two events edges keep their order and their side of the circle, so a boundary
    integrates to its middle times the height, or to an arc.
    """
    events = _events(x1, y1, x2, y2)
    slope = (x2 - x1) / (y2 - y1)
    arcs = np.diff(_arc(events))
    out = np.zeros(n_areas + 1)
    for bottom, top, arc in zip(events[:-1], events[1:], arcs, strict=True):
        mid = (bottom + top) / 2.0
        here = np.flatnonzero((y1 <= bottom) & (y2 >= top))
        if not len(here):
            continue
        x = x1[here] + (mid - y1[here]) * slope[here]
        order = np.argsort(x, kind="stable")
        x, of = x[order], area[here][order]
        half = np.sqrt(max(0.0, 1.0 - mid * mid))
        surface = np.where(x <= -half, -arc, np.where(x >= half, arc, x * (top - bottom)))
        # The k-th edge of an area enters it for even k and leaves it for odd k.
        by_area = np.argsort(of, kind="stable")
        first = np.searchsorted(of[by_area], of[by_area])
        sign = np.empty(len(x))
        sign[by_area] = np.where((np.arange(len(x)) - first) % 2 == 0, -1.0, 1.0)
        inside = -np.cumsum(sign)
        before = np.concatenate([[0.0], inside[:-1]])
        # Edges east of the disc are absent: what is still open there ends at the arc.
        np.add.at(out, of, sign * surface)
        open_areas = np.bincount(of, -sign, n_areas)
        out[:-1] += open_areas * arc
        out[-1] += ((inside == 0) & (before > 0)) @ surface - ((inside > 0) & (before == 0)) @ surface
        out[-1] += arc if inside[-1] > 0 else 0.0
    return out


def _sweep_strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surfaces of strips from edges sorted by strip; a strip may reach over batches."""
    names = [*PLACE, "strip"]

    def swept(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        coded = rows["area_id"].combine_chunks().dictionary_encode()
        area = coded.indices.to_numpy()
        edges = [rows[c].to_numpy() for c in ("x1", "y1", "x2", "y2")]
        ids, surfaces, sizes = [], [], []
        for at, to in zip(starts, [*starts[1:], len(rows)], strict=True):
            here, codes = np.unique(area[at:to], return_inverse=True)
            surfaces.append(sweep(*(e[at:to] for e in edges), codes, len(here)))
            ids.append([*here, -1])
            sizes.append(len(here) + 1)
        ids = np.concatenate(ids)
        place = [np.repeat(rows[c].to_numpy()[starts], sizes) for c in PLACE]
        found = coded.dictionary.take(pa.array(ids, mask=ids < 0))
        columns = [*place, found, np.concatenate(surfaces), ids < 0]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*PLACE, "area_id", "surface", "is_union"])

    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        changed = [np.diff(rows[c].to_numpy()) != 0 for c in names]
        starts = np.concatenate([[0], np.flatnonzero(np.any(changed, axis=0)) + 1]) if len(rows) else np.array([], int)
        if len(starts) > 1:
            yield swept(rows.slice(0, starts[-1]), starts[:-1])
        rest = rows.slice(starts[-1]) if len(starts) else None
    if rest is not None and len(rest):
        yield swept(rest, np.array([0]))


def overlap_surfaces(places: DataFrame, edges: DataFrame, radius_km: float = 25.0) -> DataFrame:
    """``lat, lon, area_id, is_union, share_pct``: share of the disc around each distinct
    place inside each area near it and, in rows with ``is_union`` and a null area, inside
    any. Places without an edge near have no row."""
    r = radius_km * 1000.0
    placed = places.select(*PLACE).distinct().withColumns({"cx": _map_x(F.col("lon")), "cy": _map_y(F.col("lat"))})
    mapped = edges.select(
        "area_id", *(f(F.col(f"{c}{i}")).alias(f"{c}{i}") for i in (1, 2) for c, f in (("x", _map_x), ("y", _map_y)))
    )
    kind = edges.schema["area_id"].dataType.simpleString()
    # Sorted strips go through a task in batches, as most hold few edges.
    strips = _strips(placed, mapped, r).repartition(shuffle_width(places.sparkSession), *PLACE, "strip")
    swept = strips.sortWithinPartitions(*PLACE, "strip").mapInArrow(
        _sweep_strips, f"lat double, lon double, area_id {kind}, surface double, is_union boolean"
    )
    area = F.when(~F.col("is_union"), F.col("area_id")).alias("area_id")
    return swept.groupBy(*PLACE, area, "is_union").agg((F.sum("surface") * (100.0 / pi)).alias("share_pct"))


def _alike(edges: DataFrame) -> DataFrame:
    """``area_id, same, x1, y1, x2, y2``: areas with equal outlines as one, under the smallest
    id, and how many they are. The order and direction of edges do not matter."""
    ends = F.array_sort(F.array(*(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2))))
    areas = edges.where("area_id IS NOT NULL").groupBy("area_id").agg(F.sort_array(F.collect_list(ends)).alias("outline"))
    alike = areas.groupBy("outline").agg(F.min("area_id").alias("area_id"), F.count(F.lit(1)).alias("same"))
    back = alike.select("area_id", "same", F.explode("outline").alias("e"))
    return back.select("area_id", "same", *(F.col("e")[i - 1][c].alias(f"{c}{i}") for i in (1, 2) for c in "xy"))


def overlap_exact(blocks: DataFrame, edges: DataFrame, block_id: str, radius_km: float = 25.0) -> DataFrame:
    """``block_id, overlap_pct, summed_pct, n_areas`` for every row of ``blocks``.

    ``overlap_pct`` is the share of the disc around (``lat``, ``lon``) inside at least one
    area; ``summed_pct`` adds the shares of all areas, so overlaps count as often as they
    occur; ``n_areas`` counts areas with a surface in the disc. A block without a finite
    place has nulls, one without an area near zeros. Repeated blocks repeat; blocks at one
    place share a disc. Areas may touch and share edges; nothing wraps at the antimeridian.
    """
    place = [F.col(c).cast("double").alias(c) for c in PLACE]
    rows = blocks.select(F.col(block_id).alias("__id"), *place)
    known = F.abs("lat").between(0.0, 90.0) & F.abs("lon").between(0.0, 360.0)
    # Copies of an area meet the discs once and count by their number.
    alike = materialize(_alike(edges), "areas")
    surfaces = overlap_surfaces(rows.where(known), alike.drop("same"), radius_km)
    surfaces = surfaces.join(alike.select("area_id", "same").distinct(), "area_id", "left")
    any_area = F.col("is_union")
    share = surfaces.groupBy(*PLACE).agg(
        F.sum(F.when(any_area, F.col("share_pct"))).alias("overlap_pct"),
        F.sum(F.when(~any_area, F.col("share_pct") * F.col("same"))).alias("summed_pct"),
        # A touching area has a surface of rounding errors only.
        F.sum(F.when(~any_area & (F.col("share_pct") > 1e-9), F.col("same"))).alias("n_areas"),
    )
    filled = (F.when(known, F.coalesce(c, F.lit(0))).alias(c) for c in ("overlap_pct", "summed_pct", "n_areas"))
    return rows.join(share, PLACE, "left").select(F.col("__id").alias(block_id), *filled)
