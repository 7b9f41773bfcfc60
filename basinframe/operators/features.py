"""Feature matrix: fixed physics channels, and well-derived features per fold.

Well-derived features only ever read a fold's training wells. ``fold`` is a
column of every join, so one job serves all folds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basinframe.functions.geo import Grid, km_of_chord
from basinframe.functions.scalars import water_depth_class
from basinframe.operators.contracts import require_none
from basinframe.operators.raster import lookup, neighbourhood
from basinframe.operators.spatial import CubeIndex, as_queries
from basinframe.session import materialize

#: The channels and their order in the matrix.
STATIC_CHANNELS = [
    "grav_mgal",
    "grav_gradient_mgal_km",
    "mag_anomaly_nt",
    "sed_thickness_m",
    "sed_gradient_m_km",
    "moho_depth_km",
    "crust_type_class",
    "elevation_m",
    "slope_deg",
    "heat_flow_mw_m2",
    "heat_flow_obs_dist_km",
    "dist_shelf_break_km",
]
NEIGHBOURHOOD_CHANNELS = ["grav_mgal", "mag_anomaly_nt", "sed_thickness_m", "elevation_m"]
NEIGHBOURHOOD_RADII = {"25km": 5, "100km": 18}
REFERENCE_FEATURES = [
    "dist_discovery_km",
    "dist_dryhole_km",
    "water_depth_class",
    "province_success_rate",
    "basin_maturity",
]
FEATURE_NAMES = (
    STATIC_CHANNELS
    + [
        f"{c}_{stat}_{tag}"
        for c in NEIGHBOURHOOD_CHANNELS
        for tag in NEIGHBOURHOOD_RADII
        for stat in ("mean", "std")
    ]
    + REFERENCE_FEATURES
)

#: Chords below this are the same place (about 6 cm).
SAME_PLACE = 1e-8


def static_features(
    points: DataFrame,
    cells: DataFrame,
    grid: Grid,
    channels: Sequence[str] = tuple(STATIC_CHANNELS),
    around: Sequence[str] = tuple(NEIGHBOURHOOD_CHANNELS),
    radii: dict[str, int] | None = None,
    elevation: str = "elevation_m",
) -> DataFrame:
    """Channel values, neighbourhood statistics and depth class per point. Squares are
    summed in the tiles around the points alone."""
    wanted = points.select(grid.row_of("lat").alias("row"), grid.col_of("lon").alias("col"))
    near = neighbourhood(cells, grid, list(around), radii or NEIGHBOURHOOD_RADII, wanted)
    at = lookup(points, cells, grid, list(channels))
    out = at.join(near, ["row", "col"], "left").drop("row", "col")
    return out.withColumn("water_depth_class", water_depth_class(elevation).cast("double"))


def _nearest_km(points: DataFrame, ref: DataFrame, self_flag: str, out: str) -> DataFrame:
    """Distance to the nearest reference of the fold. Where ``self_flag`` holds and
    the nearest lies at the point itself, the second nearest counts: the rule is
    positional, so a co-located twin is skipped only once."""
    without = points.select("fold").distinct().join(ref.select("fold").distinct(), "fold", "left_anti")
    require_none(without, out, "folds without a reference of this class")
    index = CubeIndex(ref.select("fold", "well_id", "lat", "lon").withColumnRenamed("well_id", "ref_id"),
                      scope=["fold"], ids=["ref_id"], keep=2)
    q = as_queries(points, ["fold", "well_id", self_flag])
    near = index.nearest(q, ["well_id", self_flag], 2)
    first = F.min(F.when(F.col("rank") == 1, F.col("chord")))
    second = F.min(F.when(F.col("rank") == 2, F.col("chord")))
    chord = F.when(F.col(self_flag) & (first < SAME_PLACE), second).otherwise(first)
    return near.groupBy("fold", "well_id", self_flag).agg(km_of_chord(chord).alias(out)).drop(self_flag)


def reference_features(points: DataFrame, reference: DataFrame) -> DataFrame:
    """``fold, well_id`` and the four well-derived features.

    ``points``: ``fold, well_id, lat, lon, province_code, label, spud_year,
    in_reference``; ``reference``: the training wells, ``fold, well_id, lat, lon,
    province_code, label, spud_year``. A point that is itself a reference is left
    out of its own distances and its own success rate.
    """
    pts = materialize(
        points.select("fold", "well_id", "lat", "lon", "province_code", "label", "spud_year", "in_reference"),
        "points",
    )
    ref = materialize(
        reference.select("fold", "well_id", "lat", "lon", "province_code", "label", "spud_year"), "reference"
    )
    hit = _nearest_km(pts, ref.where("label = 1"), "in_reference", "dist_discovery_km")
    dry = _nearest_km(pts, ref.where("label = 0"), "in_reference", "dist_dryhole_km")
    rate = province_success(pts, ref)
    age = basin_maturity(pts, ref)
    keys = ["fold", "well_id"]
    return (
        pts.select(*keys)
        .join(hit, keys, "left")
        .join(dry, keys, "left")
        .join(rate, keys)
        .join(age, keys)
    )


def province_success(points: DataFrame, reference: DataFrame) -> DataFrame:
    """Success rate of the point's province among the fold's references, its own
    outcome removed. With nothing left the fold's overall rate stands in, and that
    one still contains the point."""
    g = reference.groupBy("fold", "province_code").agg(
        F.sum("label").alias("s"), F.count(F.lit(1)).alias("n")
    )
    overall = g.groupBy("fold").agg((F.sum("s") / F.sum("n")).alias("overall"))
    own = F.col("in_reference").cast("int")
    s = F.col("s") - own * F.col("label")
    n = F.col("n") - own
    return (
        points.join(g, ["fold", "province_code"], "left")
        .join(overall, "fold", "left")
        .select(
            "fold",
            "well_id",
            F.coalesce(s / F.nullif(n, F.lit(0)), F.col("overall")).alias("province_success_rate"),
        )
    )


def basin_maturity(points: DataFrame, reference: DataFrame) -> DataFrame:
    """Share of the province's references drilled strictly before the point's year;
    0 in an undrilled province, 1 without a year. A reference without a year counts in
    the total and is never earlier."""
    yearly = reference.groupBy("fold", "province_code", "spud_year").agg(
        F.count(F.lit(1)).alias("n"), F.count("spud_year").alias("dated")
    )
    # Yearly totals: a few hundred rows per fold and province.
    before = Window.partitionBy("fold", "province_code").orderBy("spud_year").rangeBetween(
        Window.unboundedPreceding, 0
    )
    everything = Window.partitionBy("fold", "province_code")
    steps = yearly.select(
        "fold",
        "province_code",
        "spud_year",
        F.sum("dated").over(before).alias("upto"),
        F.sum("n").over(everything).alias("total"),
        F.lead("spud_year").over(Window.partitionBy("fold", "province_code").orderBy("spud_year")).alias("next_year"),
    )
    totals = steps.groupBy("fold", "province_code").agg(F.first("total").alias("total"))
    # Each distinct question (fold, province, year) is answered once.
    asked = points.select("fold", "province_code", "spud_year").distinct()
    answer = (
        asked.join(
            steps.select("fold", "province_code", F.col("spud_year").alias("y0"), "next_year", "upto"),
            ["fold", "province_code"],
        )
        .where((F.col("y0") < F.col("spud_year")) & (F.col("next_year").isNull() | (F.col("next_year") >= F.col("spud_year"))))
        .select("fold", "province_code", "spud_year", "upto")
    )
    share = F.coalesce("upto", F.lit(0)) / F.col("total")
    return (
        points.join(totals, ["fold", "province_code"], "left")
        .join(answer, ["fold", "province_code", "spud_year"], "left")
        .select(
            "fold",
            "well_id",
            F.when(F.col("total").isNull(), 0.0)
            .when(F.col("spud_year").isNull(), 1.0)
            .otherwise(share)
            .alias("basin_maturity"),
        )
    )


def feature_matrix(static: DataFrame, reference: DataFrame, names: Sequence[str] = tuple(FEATURE_NAMES)) -> DataFrame:
    """``fold, well_id`` and the features in their fixed order."""
    both = reference.join(static, "well_id")
    return both.select("fold", "well_id", *names)


def reference_roles(members: DataFrame, wells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, reference) for :func:`reference_features` from fold membership."""
    cols = ["well_id", "lat", "lon", "province_code", "label", "spud_year"]
    placed = members.where(F.col("role") != "dropped").join(wells.select(*cols), "well_id")
    placed = placed.withColumn("in_reference", F.col("role") == "train")
    return placed, placed.where("in_reference")
