"""Block screening: every screen, the economics and the verdict for all blocks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinframe.functions.scalars import development_concept, water_depth
from basinframe.operators import economics as ec
from basinframe.operators import screening as sc
from basinframe.operators.spatial import radius_totals
from basinframe.operators.wells import basin_stats
from basinframe.session import materialize


def screen_blocks(
    blocks: DataFrame,
    *,
    wells: DataFrame,
    regimes: DataFrame,
    costs: DataFrame,
    strip: DataFrame,
    programs: DataFrame | None = None,
    overlap: DataFrame | None = None,
    rate_policy: str = "published",
    offset_km: float = 100.0,
    n_draws: int = 10_000,
    seed: int = 7,
) -> DataFrame:
    """``blocks``: ``block_id, lat, lon, iso3, country_name, province_code,
    elevation_m, host_distance_km, pg, p90, p50, p10, well_cost_musd``.

    A block whose inputs are incomplete keeps its row: NULL economics, NULL verdict
    and the reasons in ``data_gaps`` and ``cost_gap``.
    """
    known = wells.select(
        "lat",
        "lon",
        (~F.col("excluded")).cast("long").alias("n_labelled"),
        F.when(~F.col("excluded"), F.col("label")).otherwise(0).cast("long").alias("n_found"),
    )
    offsets = radius_totals(blocks, known, "block_id", offset_km, ["n_labelled", "n_found"])
    offsets = offsets.select(
        "block_id",
        F.col("n_rows").alias("offset_wells"),
        F.round(F.col("n_found") / F.nullif(F.col("n_labelled"), F.lit(0)), 3).alias("offset_success_rate"),
    )
    primary = wells.where((F.col("purpose") == "wildcat") & ~F.col("excluded"))
    basin = basin_stats(blocks, primary, "block_id").select(
        "block_id", "province_name", F.col("n_wildcats").alias("basin_wildcats")
    )
    depth = F.round(water_depth("elevation_m"), 1)
    placed = blocks.withColumns(
        {
            "water_depth_m": depth,
            "concept": development_concept(water_depth("elevation_m"), "host_distance_km"),
        }
    )
    costed = ec.cost_inputs(placed, costs)
    rated = costed.join(sc.fiscal_rates(regimes, rate_policy), "iso3", "left")
    m1 = ec.price_deck(strip).where("scenario = 'm1'").select("price_usd_bbl")
    price = m1.first()
    full = rated.withColumns(
        {
            "price_usd_bbl": F.lit(price["price_usd_bbl"] if price else None).cast("double"),
            "resource_mmbbl": F.col("p50"),
        }
    )
    full = materialize(full, "blocks")
    plan = ec.Plan(schedule_years="schedule_years")
    valued = ec.evaluate_blocks(full, plan).withColumns(
        {
            "npv_musd": F.round("npv_musd", 2),
            "emv_musd": F.round(ec.expected_value("pg", "npv_musd", "well_cost_musd"), 2),
            "breakeven_usd_bbl": F.round("breakeven_usd_bbl", 2),
            "government_take": F.round("government_take", 4),
        }
    )
    ready = full.where(F.col("schedule_years").isNotNull())
    spread = ec.scenario_spread(ready, n_draws, seed, plan, points=False)
    spread = spread.select("block_id", F.round("p_emv_positive", 4).alias("p_emv_positive"))
    out = (
        valued.join(spread, "block_id", "left").join(offsets, "block_id", "left").join(basin, "block_id", "left")
    )
    if programs is not None:
        out = out.join(sc.sanctions_screen(blocks, programs), "block_id", "left")
    else:
        out = out.withColumn("sanctioned", F.lit(None).cast("boolean"))
    if overlap is not None:
        out = out.join(overlap.select("block_id", "overlap_pct"), "block_id", "left")
    else:
        out = out.withColumn("overlap_pct", F.lit(None).cast("double"))
    return sc.decide(out)


def memo_fields(screened: DataFrame) -> DataFrame:
    """The verdict's numbers as cited fields ``block_id, agent, field, value, source_ids``."""
    spec = [
        ("geoscience", "offset_wells", ["labels_harmonized"]),
        ("geoscience", "basin_wildcats", ["labels_harmonized", "usgs_provinces"]),
        ("infrastructure", "concept", ["etopo2022", "curated_costs"]),
        ("infrastructure", "water_depth_m", ["etopo2022"]),
        ("fiscal", "cit_rate", ["curated_fiscal"]),
        ("fiscal", "royalty_rate", ["curated_fiscal"]),
        ("environment", "overlap_pct", ["wdpa"]),
        ("political_risk", "sanctioned", ["ofac_eu"]),
        ("economist", "price_usd_bbl", ["yf_curve"]),
        ("economist", "npv_musd", ["economics", "curated_fiscal", "curated_costs"]),
        ("economist", "emv_musd", ["economics", "curated_fiscal", "curated_costs"]),
        ("economist", "breakeven_usd_bbl", ["economics", "curated_fiscal", "curated_costs"]),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(agent).alias("agent"),
                F.lit(name).alias("field"),
                F.coalesce(F.col(name).cast("string"), F.lit("data gap")).alias("value"),
                F.when(F.col(name).isNull(), F.array(F.lit("snapshot")))
                .otherwise(F.array(*[F.lit(s) for s in sources]))
                .alias("source_ids"),
            )
            for agent, name, sources in spec
        ]
    )
    return screened.select("block_id", F.explode(rows).alias("f")).select("block_id", "f.*")
