"""Market series: bands, changes, correlations, tails and cross-source checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinframe.functions.scalars import age_days, agreement_band, delta_pct, finite_or_null
from basinframe.operators.contracts import require_none
from basinframe.operators.ordered import prefix, top_n


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Both values side by side where both sources report, with a banded delta."""
    left = a.select(*keys, F.col(value).alias(f"{value}_a"))
    right = b.select(*keys, F.col(value).alias(f"{value}_b"))
    both = left.join(right, list(keys), "inner")
    return both.withColumn("delta_pct", delta_pct(f"{value}_a", f"{value}_b")).withColumn(
        "status", agreement_band("delta_pct")
    )


def recon_tally(recon: DataFrame, by: str = "country") -> DataFrame:
    """Pass / warn / fail counts and the latest month per country, worst first."""
    latest = F.max_by(F.struct("month", "delta_pct", "status"), F.col("month"))
    return recon.groupBy(by).agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "warn", "fail")],
        latest.alias("l"),
    ).select(
        by,
        "n_pass",
        "n_warn",
        "n_fail",
        F.col("l.month").alias("latest_month"),
        F.col("l.delta_pct").alias("latest_delta_pct"),
        F.col("l.status").alias("latest_status"),
    )


def severity(status: Column) -> Column:
    return F.when(status == "fail", 0).when(status == "warn", 1).otherwise(2)


def worst_first(df: DataFrame, status: str, name: str) -> DataFrame:
    return df.orderBy(severity(F.col(status)), name)


def common_months(a: DataFrame, b: DataFrame, n: int = 24, month: str = "month") -> DataFrame:
    """Last ``n`` months that both sources cover."""
    both = a.select(month).intersect(b.select(month))
    return both.orderBy(F.desc(month)).limit(n)


def weekly_consistency(
    stocks: DataFrame, keys: Sequence[str], tolerance: float = 1.0
) -> DataFrame:
    """Change computed from levels against the change reported, first week dropped.

    Input ``keys, week, stocks_kbbl, reported_change_kbbl``.
    """
    lagged = prefix(stocks, keys, ["week"], lags={"__prev": "stocks_kbbl"})
    out = lagged.withColumn("computed_change_kbbl", F.col("stocks_kbbl") - F.col("__prev"))
    gap = F.abs(F.col("computed_change_kbbl") - F.col("reported_change_kbbl"))
    return (
        out.where("computed_change_kbbl IS NOT NULL")
        .withColumn("status", F.when(gap <= tolerance, "pass").otherwise("fail"))
        .select(*keys, "week", "stocks_kbbl", "reported_change_kbbl", "computed_change_kbbl", "status")
    )


def consistency_input(weekly: DataFrame, metric: str, n: int = 53) -> DataFrame:
    """Last ``n`` weeks of one metric with the change recomputed from the levels."""
    levels = weekly.where(F.col("metric") == metric).select(
        F.col("metric"), F.col("period").alias("week"), F.col("value").alias("stocks_kbbl")
    )
    tail = top_n(levels, ["metric"], ["-week"], n + 1)
    w = Window.partitionBy("metric").orderBy("week")
    changed = tail.withColumn(
        "reported_change_kbbl",
        F.coalesce(F.col("stocks_kbbl") - F.lag("stocks_kbbl").over(w), F.lit(0.0)),
    )
    return top_n(changed, ["metric"], ["-week"], n)


def latest_previous(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Latest and previous value per series with their difference."""
    two = top_n(df.select(*keys, order, value), keys, [f"-{order}"], 2)
    return (
        two.groupBy(*keys)
        .agg(
            F.max(order).alias("asof"),
            F.max_by(value, order).alias("last_value"),
            F.when(F.count(F.lit(1)) > 1, F.min_by(value, order)).alias("previous_value"),
        )
        .withColumn("delta", F.col("last_value") - F.col("previous_value"))
    )


def last_per_date(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Where a date carries several points the last one stands."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return g.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def pair_spread(df: DataFrame, on: str, series: str, value: str, a: str, b: str) -> DataFrame:
    """``a - b`` on the dates both series have, in one aggregation (no self join)."""
    both = df.where(F.col(series).isin(a, b)).groupBy(on).agg(
        F.max(F.when(F.col(series) == a, F.col(value))).alias("a_value"),
        F.max(F.when(F.col(series) == b, F.col(value))).alias("b_value"),
    )
    return both.dropna().withColumn("spread", F.col("a_value") - F.col("b_value"))


def five_year_band(weekly: DataFrame, keys: Sequence[str], period: str, value: str, asof_year: Column) -> DataFrame:
    """Lowest and highest value per ISO week over the five calendar years before
    ``asof_year``. Years are calendar years, weeks are ISO weeks."""
    y = F.year(period)
    window = weekly.where((y >= asof_year - 5) & (y < asof_year))
    return window.groupBy(*keys, F.weekofyear(period).alias("week_of_year")).agg(
        F.min(value).alias("band_min"), F.max(value).alias("band_max")
    )


def with_band(weekly: DataFrame, band: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    dated = weekly.withColumn("week_of_year", F.weekofyear(period))
    return dated.join(band, [*keys, "week_of_year"], "left")


def lead_lag(
    a: DataFrame, b: DataFrame, keys: Sequence[str], month: str, max_lag: int = 12
) -> DataFrame:
    """Correlation of ``a`` leading ``b`` by 0..max_lag positions.

    Both frames carry ``keys, month, value``; months that only one of them has raise.
    The ordinal is exact at any length; a lag is then an equi-join on it.
    """
    require_none(unmatched_index(a, b, [*keys, month]), "lead_lag", "months of only one series")
    left = a.select(*keys, month, finite_or_null("value").alias("av"))
    right = b.select(*keys, month, finite_or_null("value").alias("bv"))
    both = left.join(right, [*keys, month], "full")
    numbered = prefix(both, keys, [month], ordinal="__i")
    lagged = numbered.select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag_months"), "__i", "av"
    ).withColumn("__i", F.col("__i") + F.col("lag_months"))
    pairs = lagged.join(numbered.select(*keys, "__i", "bv"), [*keys, "__i"])
    both_set = F.col("av").isNotNull() & F.col("bv").isNotNull()
    g = pairs.where(both_set).groupBy(*keys, "lag_months").agg(F.corr("av", "bv").alias("correlation"))
    all_lags = numbered.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag_months")
    ) if keys else a.sparkSession.range(max_lag + 1).select(F.col("id").cast("int").alias("lag_months"))
    return all_lags.join(g, [*keys, "lag_months"], "left").select(
        *keys, "lag_months", finite_or_null("correlation").alias("correlation")
    )


def unmatched_index(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index entries only one of two series has; must be empty for lead-lag."""
    left, right = a.select(*keys), b.select(*keys)
    return left.exceptAll(right).unionByName(right.exceptAll(left))


def latest_batch(df: DataFrame, batch: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the newest batch. The maximum is one row (per key), joined back."""
    newest = df.groupBy(*keys).agg(F.max(batch).alias(batch)) if keys else df.agg(F.max(batch).alias(batch))
    return df.join(newest, [*keys, batch], "left_semi")


def curve_checks(strip: DataFrame, now: Column, batch: str = "asof_date") -> DataFrame:
    """Expired contracts fail; a strip whose expiries ever fall fails as a whole.
    A batch is one strip of at most a few dozen contracts."""
    w = Window.partitionBy(batch).orderBy("month_index")
    whole = Window.partitionBy(batch)
    step = strip.withColumn(
        "__ok", F.coalesce(F.col("expiry") >= F.lag("expiry").over(w), F.lit(True))
    )
    out = step.withColumns(
        {
            "monotonic_expiry": F.bool_and("__ok").over(whole),
            "stale": F.col("expiry").cast("timestamp") < now.cast("timestamp"),
        }
    ).drop("__ok")
    return out.withColumn(
        "status", F.when(F.col("stale") | ~F.col("monotonic_expiry"), "fail").otherwise("pass")
    )


def freshness(ledger: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """Age of every registered source against its agreed age. No data is a failure."""
    newest = ledger.groupBy("source_id").agg(F.max("retrieved_at").alias("retrieved_at"))
    joined = registry.select("source_id", "sla_days").join(newest, "source_id", "left")
    at = F.col("retrieved_at").cast("timestamp").cast("double")
    exact = (now.cast("timestamp").cast("double") - at) / 86400.0
    return joined.select(
        "source_id",
        age_days(now, "retrieved_at").alias("age_days"),
        "sla_days",
        "retrieved_at",
        F.when(exact <= F.col("sla_days"), "pass").otherwise("fail").alias("status"),
        F.when(F.col("retrieved_at").isNull(), "no data written").otherwise("").alias("detail"),
    )


def source_catalog(registry: DataFrame, fresh: DataFrame) -> DataFrame:
    """Registry rows with their freshness beside them."""
    return registry.join(fresh.drop("sla_days"), "source_id", "left")


def weekly_totals(rigs: DataFrame, region: str | None = None) -> DataFrame:
    """Rig total per week (and its change), from counts by basin and fuel."""
    kept = rigs if region is None else rigs.where(F.col("region") == region)
    totals = kept.groupBy("region", "week").agg(F.sum("rig_count").alias("rig_count"))
    # One row per week: a century of weeks is five thousand rows.
    w = Window.partitionBy("region").orderBy("week")
    return totals.withColumn("delta", F.col("rig_count") - F.lag("rig_count").over(w))
