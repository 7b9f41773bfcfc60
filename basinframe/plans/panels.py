"""Display tables over the stored feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.functions.scalars import (
    crack_spread_321,
    curve_structure,
    days_of_cover,
    pct_of_target,
    spread,
)
from basinframe.operators import wells as w
from basinframe.operators.ordered import top_n
from basinframe.operators.series import (
    five_year_band,
    latest_batch,
    latest_previous,
    pair_spread,
    weekly_totals,
)

STOCK_METRICS = ["crude_stocks_excl_spr_kbbl", "gasoline_stocks_kbbl", "distillate_stocks_kbbl"]


def _line(label, value: Column, unit: str, asof: Column, delta: Column | None = None, note: Column | None = None):
    none = F.lit(None)
    return [
        (label if isinstance(label, Column) else F.lit(label)).alias("label"),
        value.cast("double").alias("value"),
        F.lit(unit).alias("unit"),
        (none.cast("double") if delta is None else delta.cast("double")).alias("delta"),
        asof.cast("string").alias("asof"),
        (none.cast("string") if note is None else note).alias("note"),
    ]


def ticker(
    spot: DataFrame | None = None,
    front: DataFrame | None = None,
    strip: DataFrame | None = None,
    rigs: DataFrame | None = None,
) -> DataFrame | None:
    """One row per instrument from whichever tables exist."""
    parts: list[DataFrame] = []
    if spot is not None:
        last = latest_previous(spot, ["metric"], "date", "value")
        for metric, label, unit, digits in (
            ("brent_usd_bbl", "BRENT", "$/bbl", 2),
            ("wti_usd_bbl", "WTI", "$/bbl", 2),
            ("usd_broad_index", "USD BROAD", "index", 1),
        ):
            one = last.where(F.col("metric") == metric)
            parts.append(
                one.select(*_line(label, F.round("last_value", digits), unit, F.col("asof"), F.round("delta", digits)))
            )
        gap = pair_spread(spot, "date", "metric", "value", "brent_usd_bbl", "wti_usd_bbl")
        newest = gap.agg(F.max_by("spread", "date").alias("s"), F.max("date").alias("d"))
        parts.append(newest.where("d IS NOT NULL").select(*_line("B-W", F.round("s", 2), "$/bbl", F.col("d"))))
    if front is not None:
        at = {t: F.max(F.when(F.col("ticker") == t, F.coalesce("settle_usd_bbl", "settle_usd_gal"))) for t in ("CL=F", "RB=F", "HO=F")}
        wide = latest_batch(front, "asof_date").agg(
            at["CL=F"].alias("cl"), at["RB=F"].alias("rb"), at["HO=F"].alias("ho"), F.max("asof_date").alias("d")
        ).dropna()
        parts.append(wide.select(*_line("3-2-1", F.round(crack_spread_321("rb", "ho", "cl"), 2), "$/bbl", F.col("d"))))
    if strip is not None:
        m = {i: F.max(F.when(F.col("month_index") == i, F.col("settle_usd_bbl"))).alias(f"m{i}") for i in (1, 12)}
        wide = latest_batch(strip, "asof_date").agg(*m.values(), F.max("asof_date").alias("d")).dropna()
        parts.append(
            wide.select(*_line("M1-M12", F.round(spread("m1", "m12"), 2), "$/bbl", F.col("d"), note=curve_structure("m1", "m12")))
        )
    if rigs is not None:
        weeks = weekly_totals(rigs, "us")
        newest = top_n(weeks, ["region"], ["-week"], 1)
        parts.append(newest.select(*_line("US RIGS", F.col("rig_count"), "rigs", F.col("week"), F.col("delta"))))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def spot_history(spot: DataFrame, n: int = 520) -> DataFrame:
    kept = spot.where(F.col("metric").isin("brent_usd_bbl", "wti_usd_bbl"))
    return top_n(kept, ["metric"], ["-date"], n).select("metric", "date", "value")


def inventories(weekly: DataFrame, metrics: list[str] = STOCK_METRICS, n: int = 56) -> DataFrame:
    """Recent weeks of each stock metric beside its five-year band."""
    stocks = weekly.where(F.col("metric").isin(metrics))
    asof = stocks.groupBy("metric").agg(F.max("period").alias("asof"))
    dated = stocks.join(asof, "metric")
    band = five_year_band(dated, ["metric"], "period", "value", F.year("asof"))
    recent = top_n(stocks, ["metric"], ["-period"], n).withColumn("week_of_year", F.weekofyear("period"))
    return recent.join(band, ["metric", "week_of_year"], "left")


def stock_headline(weekly: DataFrame, metrics: list[str] = STOCK_METRICS) -> DataFrame:
    return latest_previous(weekly.where(F.col("metric").isin(metrics)), ["metric"], "period", "value")


def cover(weekly: DataFrame, stocks: str = STOCK_METRICS[0], use: str = "product_supplied_kbd") -> DataFrame:
    """Days of cover from the newest stock level and the newest daily use."""
    newest = weekly.where(F.col("metric").isin(stocks, use)).groupBy("metric").agg(F.max_by("value", "period").alias("v"))
    wide = newest.agg(
        F.max(F.when(F.col("metric") == stocks, F.col("v"))).alias("s"),
        F.max(F.when(F.col("metric") == use, F.col("v"))).alias("u"),
    ).dropna()
    return wide.select(F.round(days_of_cover("s", "u"), 1).alias("days_of_cover"))


def members(production: DataFrame, targets: DataFrame) -> DataFrame:
    """Newest month of member production against optional targets, largest first."""
    newest = latest_batch(production, "month")
    wanted = targets.select(F.trim("country").alias("country"), F.col("target_kbd").try_cast("double").alias("target_kbd"))
    joined = newest.join(wanted, "country", "left")
    has = F.col("target_kbd").isNotNull() & (F.col("target_kbd") != 0)
    pct = F.when(has, F.round(pct_of_target("production_kbd", "target_kbd"), 1))
    return joined.select("country", "month", "production_kbd", "target_kbd", pct.alias("pct_of_target")).orderBy(
        F.desc("production_kbd"), "country"
    )


def discovery(primary: DataFrame, first_year: int = 1950, n: int = 6) -> tuple[DataFrame, DataFrame]:
    """(wells per year, creaming curves of the busiest provinces)."""
    per_year = w.wells_per_year(primary).where(F.col("spud_year") >= first_year)
    top = w.top_provinces(primary, n).select("province_name")
    return per_year, w.creaming_curve(primary.join(top, "province_name", "left_semi"))


def recent_events(events: DataFrame, n: int = 50) -> DataFrame:
    return events.orderBy(F.desc_nulls_last("seen_at"), "url").limit(n).select("seen_at", "title", "url", "domain")

