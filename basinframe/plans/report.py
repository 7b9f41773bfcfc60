"""Validation report: every check's rows under one schema, with a roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.functions.codes import ISO2_TO_ISO3
from basinframe.functions.scalars import code_lookup
from basinframe.operators.series import (
    common_months,
    consistency_input,
    curve_checks,
    freshness,
    latest_batch,
    reconcile,
    weekly_consistency,
)


def reconciliation_inputs(
    production: DataFrame, flows: DataFrame, months: int = 24
) -> tuple[DataFrame, DataFrame]:
    """Both sources as ``country, month, production_kbd`` over their last common months."""
    a = production.select(
        F.col("country_iso3").alias("country"),
        F.date_format("period", "yyyy-MM").alias("month"),
        F.col("value").alias("production_kbd"),
    )
    country = code_lookup("ref_area", ISO2_TO_ISO3)
    kept = flows.where(
        (F.col("flow_breakdown") == "INDPROD") & (F.col("unit_measure") == "KBD") & country.isNotNull()
    )
    b = kept.select(
        country.alias("country"),
        F.date_format("period", "yyyy-MM").alias("month"),
        F.col("value").alias("production_kbd"),
    )
    window = common_months(a, b, months)
    return a.join(window, "month", "left_semi"), b.join(window, "month", "left_semi")


def section(name: str, rows: DataFrame) -> DataFrame:
    """A check's rows as ``section, status, row`` with the row as JSON."""
    return rows.select(
        F.lit(name).alias("section"), "status", F.to_json(F.struct(*rows.columns)).alias("row")
    )


def build_report(
    ledger: DataFrame,
    registry: DataFrame,
    now: Column,
    *,
    production: DataFrame | None = None,
    flows: DataFrame | None = None,
    weekly: DataFrame | None = None,
    strip: DataFrame | None = None,
    weekly_metric: str = "crude_stocks_excl_spr_kbbl",
) -> DataFrame:
    """All sections whose inputs exist; a missing table shows as stale, never as a pass."""
    parts = [section("freshness", freshness(ledger, registry, now))]
    if production is not None and flows is not None:
        pair = reconciliation_inputs(production, flows)
        recon = reconcile(*pair, ["country", "month"], "production_kbd")
        parts.append(section("reconciliation", recon))
    if weekly is not None:
        levels = consistency_input(weekly, weekly_metric)
        parts.append(section("weekly_consistency", weekly_consistency(levels, ["metric"])))
    if strip is not None:
        newest = latest_batch(strip, "asof_date")
        parts.append(section("curve_checks", curve_checks(newest, now)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def summarize(report: DataFrame) -> DataFrame:
    """``section, n_pass, n_warn, n_fail, overall`` per section and over all."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "warn", "fail")]
    per = report.groupBy("section").agg(*counts)
    total = per.agg(*[F.sum(f"n_{s}").alias(f"n_{s}") for s in ("pass", "warn", "fail")])
    both = per.unionByName(total.select(F.lit("all").alias("section"), "n_pass", "n_warn", "n_fail"))
    worst = F.when(F.col("n_fail") > 0, "fail").when(F.col("n_warn") > 0, "warn").otherwise("pass")
    return both.withColumn("overall", worst)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").partitionBy("section").json(path)
