"""Curated tables kept by hand: every row names its public source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinframe.errors import ContractViolation
from basinframe.operators.contracts import Guard, duplicate_keys, guard, require_columns, require_none


def _uncited() -> Column:
    return F.coalesce(F.trim("source_url"), F.lit("")) == ""


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """All text; an empty code stays an empty string."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


def outcome_map(raw: DataFrame) -> DataFrame:
    """Typed outcome map ``source_id, content_raw, label, shows, excluded, source_url``."""
    require_columns(raw, ["source_id", "content_raw", "label", "shows", "source_url"], "outcome_map")
    if "excluded" not in raw.columns:
        raw = raw.withColumn("excluded", F.lit("false"))

    def flag(c: str) -> Column:
        return F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)

    typed = raw.select(
        "source_id",
        "content_raw",
        F.col("label").try_cast("int").alias("label"),
        flag("shows").alias("shows"),
        flag("excluded").alias("excluded"),
        "source_url",
    )
    return typed


def load_outcome_map(raw: DataFrame) -> DataFrame:
    typed = outcome_map(raw)
    require_none(duplicate_keys(typed, ["source_id", "content_raw"]), "outcome_map", "duplicate codes")
    guard(
        typed,
        "outcome_map",
        [
            Guard("uncited row", _uncited()),
            Guard("shows must be true or false", F.col("shows").isNull()),
            Guard("excluded must be true or false", F.col("excluded").isNull()),
            Guard("label must be 0 or 1", F.col("label").isNull() | ~F.col("label").isin(0, 1)),
            Guard("excluded rows must carry label 0", F.col("excluded") & (F.col("label") != 0)),
        ],
    )
    return typed


def load_pins(raw: DataFrame, required: list[str]) -> DataFrame:
    """Pinned series or targets: no required key may be blank."""
    require_columns(raw, required, "pins")
    blank = [Guard(f"{c} missing", F.coalesce(F.trim(c), F.lit("")) == "") for c in required]
    guard(raw, "pins", blank, empty="nothing pinned")
    return raw


def load_costs(raw: DataFrame) -> DataFrame:
    """Cost ranges per concept; a blank bound is NULL."""
    text = {"concept", "source_url", "retrieved_at", "notes"}
    return raw.select(*[F.col(c) if c in text else F.col(c).try_cast("double").alias(c) for c in raw.columns])


FISCAL_JSON = (
    "iso3 string, country string, regime_type string, royalty_rate double, cit_rate double, "
    "engine_mapping struct<royalty_rate: double, cit_rate: double, "
    "suggested_royalty_rate: double, suggested_cit_rate: double>, source_urls array<string>"
)


def load_fiscal(raw: DataFrame) -> DataFrame:
    """Regime rows from landed JSON, the mapping flattened beside the own rates."""
    guard(
        raw,
        "fiscal",
        [
            Guard(f"{c} missing", F.col(c).isNull()) for c in ("iso3", "regime_type", "cit_rate", "source_urls")
        ],
        empty="no regimes",
    )
    m = "engine_mapping."
    return raw.select(
        F.upper("iso3").alias("iso3"),
        "country",
        "regime_type",
        "royalty_rate",
        "cit_rate",
        F.col(m + "royalty_rate").alias("mapped_royalty_rate"),
        F.col(m + "cit_rate").alias("mapped_cit_rate"),
        F.col(m + "suggested_royalty_rate").alias("suggested_royalty_rate"),
        F.col(m + "suggested_cit_rate").alias("suggested_cit_rate"),
    )


REGISTRY_COLUMNS = ["source_id", "name", "access", "base_url", "cadence", "sla_days", "verified_at"]


def load_registry(raw: DataFrame) -> DataFrame:
    """One row per source; addresses must be https."""
    require_columns(raw, REGISTRY_COLUMNS, "registry")
    guard(
        raw,
        "registry",
        [
            Guard("address is not https", ~F.coalesce(F.col("base_url").startswith("https://"), F.lit(False))),
            Guard("no agreed age", F.col("sla_days").try_cast("double").isNull()),
        ],
        empty="no sources registered",
    )
    require_none(duplicate_keys(raw, ["source_id"]), "registry", "duplicate sources", ContractViolation)
    return raw.withColumn("sla_days", F.col("sla_days").cast("double"))
