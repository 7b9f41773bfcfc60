"""Label build: five well tables to one deduplicated, placed and labelled table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinframe.functions.geo import Grid
from basinframe.operators.raster import lookup
from basinframe.operators.wells import (
    HARMONISED,
    decision_points,
    keep_placed_and_dated,
    map_outcomes,
    name_provinces,
    variant_summary,
    variants,
)
from basinframe.session import materialize

KEPT = [
    "well_id",
    "source_id",
    "lat",
    "lon",
    "spud_year",
    "purpose",
    "content_raw",
    "label",
    "shows",
    "excluded",
    "td_m",
    "discovery_id",
]


@dataclass
class Labels:
    harmonised: DataFrame
    variants: dict[str, DataFrame]
    dropped: DataFrame
    summary: DataFrame


def stack_sources(tables: dict[str, DataFrame]) -> DataFrame:
    """Source tables under one column list, each row naming its source."""
    cols = [c for c in KEPT if c not in ("source_id", "label", "shows", "excluded")]
    parts = [df.select(*cols).withColumn("source_id", F.lit(s)) for s, df in sorted(tables.items())]
    return reduce(lambda a, b: a.unionByName(b), parts)


def build_labels(
    wells: DataFrame,
    outcome_map: DataFrame,
    province_cells: DataFrame,
    province_names: DataFrame,
    grid: Grid | None = None,
    strict: bool = True,
) -> Labels:
    """``wells`` as from :func:`stack_sources`. One shuffle by location for the
    dedupe; code and province tables are joined by their own size."""
    kept, dropped = keep_placed_and_dated(wells)
    mapped = map_outcomes(kept, outcome_map, strict).select(*KEPT)
    points = decision_points(mapped)
    placed = lookup(points, province_cells, grid or Grid(), ["province_code"]).drop("row", "col")
    placed = placed.withColumn("province_code", F.coalesce("province_code", F.lit(0)).cast("int"))
    # Stored once: the checks, the variants and the summary all read it.
    table = materialize(name_provinces(placed, province_names), "harmonised")
    if strict:
        HARMONISED.enforce(HARMONISED.coerce(table))
    return Labels(table, variants(table), dropped, variant_summary(table))
