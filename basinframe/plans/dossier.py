"""Dossiers: what every screen says about each block, side by side, and the memo table.

All blocks are screened at once; a screen whose table is not given leaves its columns out
of the dossier, and a screen that has nothing for a block leaves nulls, never values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.functions.geo import Grid
from basinframe.functions.scalars import finite_or_null
from basinframe.operators import screening as sc
from basinframe.operators.overlap import overlap_exact
from basinframe.operators.polygons import overlap_names, points_in_polygons
from basinframe.operators.raster import lookup
from basinframe.operators.spatial import nearest_join, radius_totals
from basinframe.operators.wells import basin_stats

#: (agent, dossier column, sources) of a memo's fields.
FIELDS = (
    ("geoscience", "in_scoreable_mask", ("usgs_provinces", "globsed")),
    ("geoscience", "offset_wells", ("labels_harmonized",)),
    ("geoscience", "offset_discoveries", ("labels_harmonized",)),
    ("geoscience", "offset_success_rate", ("labels_harmonized",)),
    ("geoscience", "basin_wildcats", ("labels_harmonized", "usgs_provinces")),
    ("geoscience", "basin_success_rate", ("labels_harmonized", "usgs_provinces")),
    ("infrastructure", "elevation_m", ("etopo2022",)),
    ("environment", "summed_pct", ("wdpa",)),
    ("political_risk", "governance_year", ("wgi",)),
    ("political_risk", "fsi_total", ("fsi",)),
    ("political_risk", "sanctioned", ("ofac_eu",)),
    ("economist", "institutions_checked", ("curated_exclusions",)),
    ("economist", "institutions_restricting", ("curated_exclusions",)),
)


def offset_wells(blocks: DataFrame, wells: DataFrame, radius_km: float, k: int, sources: Sequence[str]) -> DataFrame:
    """Wells within the radius by totals, the sources among them, and the ``k`` nearest
    wells at any distance as an array ordered by rank."""
    found = (~F.col("excluded")).cast("long")
    known = wells.select(
        "lat",
        "lon",
        found.alias("n_labelled"),
        (found * F.col("label").cast("long")).alias("n_found"),
        *[(F.col("source_id") == s).cast("long").alias(f"__s{i}") for i, s in enumerate(sources)],
    )
    flags = [f"__s{i}" for i in range(len(sources))]
    totals = radius_totals(blocks, known, "block_id", radius_km, ["n_labelled", "n_found", *flags])
    present = [F.when(F.col(f) > 0, F.lit(s)) for s, f in sorted(zip(sources, flags, strict=True))]
    totals = totals.select(
        "block_id",
        F.col("n_rows").alias("offset_wells"),
        F.col("n_labelled").alias("offset_labelled"),
        F.col("n_found").alias("offset_discoveries"),
        F.round(F.col("n_found") / F.nullif(F.col("n_labelled"), F.lit(0)), 3).alias("offset_success_rate"),
        F.array_compact(F.array(*present)).cast("array<string>").alias("offset_sources"),
    )
    about = wells.select("well_id", "outcome_raw", F.when(~F.col("excluded"), F.col("label")).alias("label"), "spud_year")
    near = nearest_join(blocks, wells, "block_id", "well_id", k).join(about, "well_id")
    row = F.struct("rank", "well_id", "outcome_raw", "label", "spud_year", F.round("distance_km", 1).alias("distance_km"))
    # k rows a block.
    near = near.groupBy("block_id").agg(F.array_sort(F.collect_list(row)).alias("nearest_wells"))
    return totals.join(near, "block_id", "left")


def protected(blocks: DataFrame, edges: DataFrame, names: DataFrame, radius_km: float) -> DataFrame:
    """Share of the disc around each block in any area and summed over areas, and the first
    names of the areas that hold the block itself. ``names`` has ``area_id, name``."""
    share = overlap_exact(blocks, edges, "block_id", radius_km)
    inside = blocks.select("block_id", "lat", "lon").join(points_in_polygons(blocks, edges), ["lon", "lat"])
    listed = overlap_names(inside.join(names, "area_id").select("block_id", "name"), "block_id", "name")
    return share.join(listed.select("block_id", F.col("areas").alias("protected_areas")), "block_id", "left")


def block_dossier(
    blocks: DataFrame,
    *,
    wells: DataFrame,
    cells: DataFrame | None = None,
    grid: Grid | None = None,
    governance: DataFrame | None = None,
    indicators: Sequence[str] = (),
    index: DataFrame | None = None,
    programs: DataFrame | None = None,
    financing: DataFrame | None = None,
    areas: tuple[DataFrame, DataFrame] | None = None,
    sources: Sequence[str] = (),
    radius_km: float = 100.0,
    disc_km: float = 25.0,
    k: int = 5,
) -> DataFrame:
    """One row per block with the columns of every screen whose tables are given.

    ``blocks``: ``block_id`` (one row each), ``lat, lon, iso3, country_name``, and
    ``province_code`` unless ``cells`` (``row, col, score_mask, elevation_m,
    province_code``) has it. ``wells``: ``well_id, source_id, lat, lon, purpose, outcome_raw,
    label, excluded, spud_year, province_code, province_name``; ``sources`` are the source
    ids to look for among the wells within the radius. ``areas`` are edges and names of
    protected areas; ``financing`` the institutions' policies, the same for all blocks.
    """
    out = blocks
    if cells is not None:
        channels = ["score_mask", "elevation_m", "province_code"]
        at = lookup(blocks.select("block_id", "lat", "lon"), cells, grid, channels)
        mask = F.coalesce(finite_or_null("score_mask") > 0, F.lit(False))
        at = at.select("block_id", mask.alias("in_scoreable_mask"), "elevation_m", "province_code")
        out = out.drop("elevation_m", "province_code").join(at, "block_id", "left")
    primary = wells.where((F.col("purpose") == "wildcat") & ~F.col("excluded"))
    basin = basin_stats(out, primary, "block_id").select(
        "block_id",
        "province_name",
        F.col("n_wildcats").alias("basin_wildcats"),
        F.col("n_discoveries").alias("basin_discoveries"),
        F.col("success_rate").alias("basin_success_rate"),
        "first_spud_year",
        "last_spud_year",
    )
    out = out.join(basin, "block_id", "left").join(offset_wells(blocks, wells, radius_km, k, sources), "block_id", "left")
    out = out.withColumn("iso3", F.upper("iso3"))
    if governance is not None:
        scores = sc.with_second_index(sc.governance(governance, list(indicators)), index)
        out = out.join(scores.withColumnRenamed("year", "governance_year"), "iso3", "left")
    if programs is not None:
        out = out.join(sc.sanctions_screen(blocks, programs), "block_id", "left")
    if financing is not None:
        n = sc.financing_screen(financing).first()
        out = out.withColumns({"institutions_checked": F.lit(n["n_checked"]).cast("long"), "institutions_restricting": F.lit(n["n_restricting"]).cast("long")})
    if areas is not None:
        out = out.join(protected(blocks, *areas, disc_km), "block_id", "left")
    return out


def dossier_fields(dossier: DataFrame) -> DataFrame:
    """``block_id, agent, field, value, source_ids`` of the columns a dossier has; a null
    is a stated gap of the snapshot."""
    rows = [
        F.struct(
            F.lit(agent).alias("agent"),
            F.lit(name).alias("field"),
            F.coalesce(F.col(name).cast("string"), F.lit("data gap")).alias("value"),
            F.when(F.col(name).isNull(), F.array(F.lit("snapshot"))).otherwise(F.array(*map(F.lit, cited))).alias("source_ids"),
        )
        for agent, name, cited in FIELDS
        if name in dossier.columns
    ]
    return dossier.select("block_id", F.explode(F.array(*rows)).alias("f")).select("block_id", "f.*")


def block_memos(fields: DataFrame) -> DataFrame:
    """One memo per block: fields, gaps, citation coverage, rejection, sources and hash.

    Coverage is the share of fields that name a source; below the minimum the memo is
    rejected and says so. The hash is over the fields and values in order of their names;
    prose and sources stay outside it. A memo has a dozen fields, so its rows fit an array.
    """
    name = F.concat_ws(".", "agent", "field")
    cited: Column = F.coalesce(F.size("source_ids") > 0, F.lit(False))
    memo = fields.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n_fields"),
        F.count_if(F.col("value") == "data gap").alias("n_gaps"),
        F.avg(cited.cast("double")).alias("coverage"),
        F.array_sort(F.collect_list(F.struct(name.alias("field"), "value"))).alias("__q"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("source_ids", F.array().cast("array<string>")))))).alias("sources"),
    )
    rejected = F.when(F.col("coverage") < sc.MIN_CITATION_COVERAGE, "citation coverage below minimum")
    digest = F.sha2(F.to_json(F.map_from_entries("__q")), 256)
    return memo.select("block_id", "n_fields", "n_gaps", "coverage", rejected.alias("rejected"), "sources", digest.alias("quant_hash"))
