"""Compact column sets for display layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.functions.scalars import outcome_code, phase_of_name


def wells_payload(wells: DataFrame) -> DataFrame:
    kept = wells.dropna(subset=["lat", "lon", "spud_year"])
    return kept.select(
        F.round("lon", 4).alias("lon"),
        F.round("lat", 4).alias("lat"),
        outcome_code("label", "excluded", "content_raw").alias("outcome"),
        "spud_year",
    )


def fields_payload(fields: DataFrame) -> DataFrame:
    return fields.dropna(subset=["lat", "lon"]).select(
        F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat"), phase_of_name("name").alias("phase")
    )


def infra_payload(infra: DataFrame) -> DataFrame:
    group = F.when(F.col("kind").isin("oil_pipeline", "gas_pipeline"), "pipelines").when(
        F.col("kind").isin("lng_import", "lng_export"), "terminals"
    )
    placed = infra.dropna(subset=["lat", "lon"])
    return placed.where(group.isNotNull()).select(
        group.alias("layer"), "kind", "name", F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat")
    )


def drilled_by(wells: DataFrame, year: int | Column) -> DataFrame:
    """Wells up to a year, the slider of a map."""
    return wells.where(F.col("spud_year") <= year)
