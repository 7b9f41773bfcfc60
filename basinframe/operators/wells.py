"""Well outcomes: code map, one decision point per location, discovery series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basinframe.functions.codes import LABEL_GATE, PROXY_SOURCE, PURPOSES, UNASSIGNED, WELL_SOURCES
from basinframe.functions.scalars import cluster_key
from basinframe.operators.contracts import (
    Contract,
    drop_and_count,
    ge,
    in_range,
    isin,
    non_null,
    nullable,
    require_none,
)
from basinframe.operators.ordered import prefix

HARMONISED = Contract(
    "harmonised",
    {
        "well_id": non_null("string"),
        "source_id": non_null("string", isin(WELL_SOURCES)),
        "lat": non_null("double", in_range(-90, 90)),
        "lon": non_null("double", in_range(-180, 180)),
        "spud_year": non_null("int", in_range(1800, 2100)),
        "purpose": non_null("string", isin(PURPOSES)),
        "content_raw": non_null("string"),
        "label": non_null("int", isin([0, 1])),
        "shows": non_null("boolean"),
        "excluded": non_null("boolean"),
        "td_m": nullable("double", ge(0)),
        "discovery_id": nullable("string"),
        "n_wellbores": non_null("bigint", ge(1)),
    },
    unique=("well_id",),
)


def keep_placed_and_dated(wells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, counts by source): lacking a year is counted before lacking a place."""
    return drop_and_count(
        wells,
        "source_id",
        [
            ("no_spud_year", F.col("spud_year").isNull()),
            ("no_coordinates", F.col("lat").isNull() | F.col("lon").isNull()),
        ],
    )


def unmapped_outcomes(wells: DataFrame, outcome_map: DataFrame) -> DataFrame:
    """``source_id, content_raw, n_wells`` of the codes missing from the map."""
    seen = wells.groupBy("source_id", "content_raw").agg(F.count(F.lit(1)).alias("n_wells"))
    return seen.join(outcome_map.select("source_id", "content_raw"), ["source_id", "content_raw"], "left_anti")


def map_outcomes(wells: DataFrame, outcome_map: DataFrame, strict: bool = True) -> DataFrame:
    """Attach ``label, shows, excluded``. A code outside the map raises."""
    if strict:
        require_none(unmapped_outcomes(wells, outcome_map), "outcome_map", "unmapped outcome codes")
    codes = outcome_map.select("source_id", "content_raw", "label", "shows", "excluded")
    return wells.join(codes, ["source_id", "content_raw"], "left")


def decision_points(wells: DataFrame, digits: int = 3) -> DataFrame:
    """One row per source and rounded location, in a single aggregation.

    Any success makes the location a success, any shows makes it one with shows,
    it is excluded only if every wellbore is, and it dates from its first
    wellbore, whose other columns represent it. A well without coordinates has no
    location to share and raises.
    """
    adrift = wells.where("lat is null or lon is null or isnan(lat) or isnan(lon)").select("source_id", "well_id")
    require_none(adrift, "decision_points", "wells without coordinates")
    merged = {"label", "shows", "excluded", "spud_year", "source_id"}
    rest = [c for c in wells.columns if c not in merged]
    keyed = wells.withColumns(
        {"__la": cluster_key("lat", digits), "__lo": cluster_key("lon", digits)}
    )
    g = keyed.groupBy("source_id", "__la", "__lo").agg(
        F.min_by(F.struct(*rest), F.struct("spud_year", "well_id")).alias("r"),
        F.max("label").alias("label"),
        F.bool_or("shows").alias("shows"),
        F.bool_and("excluded").alias("excluded"),
        F.min("spud_year").alias("spud_year"),
        F.count(F.lit(1)).alias("n_wellbores"),
    )
    return g.select(
        "source_id",
        *[F.col(f"r.{c}").alias(c) for c in rest],
        "label",
        "shows",
        "excluded",
        "spud_year",
        "n_wellbores",
    )


def primary_set(wells: DataFrame) -> DataFrame:
    return wells.where((F.col("purpose") == "wildcat") & ~F.col("excluded"))


def variants(wells: DataFrame, proxy: str = PROXY_SOURCE) -> dict[str, DataFrame]:
    """The main set and the three it is compared with."""
    main = primary_set(wells)
    return {
        "primary": main,
        "with_appraisal": wells.where(
            ~F.col("excluded") & F.col("purpose").isin("wildcat", "appraisal")
        ),
        "shows_excluded": main.where(~F.col("shows")),
        "primary_ex_proxy": main.where(F.col("source_id") != proxy),
    }


def variant_summary(wells: DataFrame, proxy: str = PROXY_SOURCE) -> DataFrame:
    """``variant, n, positives, success_rate, by_source`` in one pass: each well is
    tagged with every variant it belongs to."""
    labelled = ~F.col("excluded")
    main = labelled & (F.col("purpose") == "wildcat")
    tags = F.filter(
        F.array(
            F.when(main, F.lit("primary")),
            F.when(labelled & F.col("purpose").isin("wildcat", "appraisal"), F.lit("with_appraisal")),
            F.when(main & ~F.col("shows"), F.lit("shows_excluded")),
            F.when(main & (F.col("source_id") != proxy), F.lit("primary_ex_proxy")),
        ),
        lambda t: t.isNotNull(),
    )
    per_source = (
        wells.select(F.explode(tags).alias("variant"), "source_id", "label")
        .groupBy("variant", "source_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))
    )
    return per_source.groupBy("variant").agg(
        F.sum("n").alias("n"),
        F.sum("positives").alias("positives"),
        F.round(F.sum("positives") / F.sum("n"), 4).alias("success_rate"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", "n")))).alias("by_source"),
    )


def label_gate(wells: DataFrame, target: int = LABEL_GATE) -> DataFrame:
    return primary_set(wells).agg(F.count(F.lit(1)).alias("primary_actual")).select(
        F.lit(target).alias("target"), "primary_actual", (F.col("primary_actual") >= target).alias("met")
    )


def name_provinces(wells: DataFrame, names: DataFrame) -> DataFrame:
    """``province_name`` from ``province_code``; no match is "(unassigned)"."""
    one = names.groupBy("province_code").agg(F.min(F.trim("province_name")).alias("province_name"))
    return wells.join(one, "province_code", "left").withColumn(
        "province_name", F.coalesce("province_name", F.lit(UNASSIGNED))
    )


# ---- discovery series ------------------------------------------------------------------


def wells_per_year(wells: DataFrame) -> DataFrame:
    g = wells.groupBy("spud_year").agg(
        F.count(F.lit(1)).alias("wildcats"), F.sum("label").alias("discoveries")
    )
    return g.withColumn("success_rate", F.col("discoveries") / F.col("wildcats"))


def decade_rates(wells: DataFrame) -> DataFrame:
    decade = (F.floor(F.col("spud_year") / 10) * 10).cast("int")
    return wells.groupBy(decade.alias("decade")).agg(
        F.count(F.lit(1)).alias("wildcats"), F.avg("label").alias("success_rate")
    )


def rates_by_source(wells: DataFrame) -> DataFrame:
    return wells.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("success_rate")
    )


def creaming_curve(wells: DataFrame, by: str = "province_name") -> DataFrame:
    """Cumulative wildcats and discoveries per province and year. The window runs
    over yearly totals, a few hundred rows per province."""
    yearly = wells.groupBy(by, "spud_year").agg(
        F.count(F.lit(1)).alias("__w"), F.sum("label").alias("__d")
    )
    upto = Window.partitionBy(by).orderBy("spud_year").rowsBetween(Window.unboundedPreceding, 0)
    return yearly.select(
        by,
        "spud_year",
        F.sum("__w").over(upto).alias("cum_wildcats"),
        F.sum("__d").over(upto).alias("cum_discoveries"),
    )


def creaming_by_well(wells: DataFrame, by: str = "province_name") -> DataFrame:
    """The same curve with one point per well, in drilling order."""
    ranked = prefix(
        wells.select(by, "spud_year", "well_id", "label"),
        [by],
        ["spud_year", "well_id"],
        sums={"__before": "label"},
        ordinal="nth_well",
    )
    return ranked.select(
        by, "well_id", "nth_well", (F.col("__before") + F.col("label")).alias("cum_discoveries")
    )


def top_provinces(wells: DataFrame, n: int = 6, by: str = "province_name") -> DataFrame:
    counts = wells.where(F.col(by) != UNASSIGNED).groupBy(by).agg(F.count(F.lit(1)).alias("n_wells"))
    return counts.orderBy(F.desc("n_wells"), by).limit(n)


def basin_stats(blocks: DataFrame, wells: DataFrame, block_id: str) -> DataFrame:
    """Province totals for every block; a block in an undrilled province keeps a row."""
    g = wells.groupBy("province_code").agg(
        F.min("province_name").alias("province_name"),
        F.count(F.lit(1)).alias("n_wildcats"),
        F.sum("label").alias("n_discoveries"),
        F.round(F.avg("label"), 3).alias("success_rate"),
        F.min("spud_year").alias("first_spud_year"),
        F.max("spud_year").alias("last_spud_year"),
    )
    return blocks.select(block_id, "province_code").join(g, "province_code", "left").select(
        block_id,
        "province_code",
        F.coalesce("province_name", F.lit("(no drilled wildcats)")).alias("province_name"),
        F.coalesce("n_wildcats", F.lit(0)).alias("n_wildcats"),
        F.coalesce("n_discoveries", F.lit(0)).alias("n_discoveries"),
        "success_rate",
        "first_spud_year",
        "last_spud_year",
    )


def extent(wells: DataFrame) -> DataFrame:
    return wells.agg(
        *[
            f(c).alias(f"{n}_{c}")
            for c in ("lon", "lat", "spud_year")
            for n, f in (("min", F.min), ("max", F.max))
        ]
    )
