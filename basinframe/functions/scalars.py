"""Column expressions shared by sources and plans. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

GALLONS_PER_BARREL = 42
FEET_TO_METRES = 0.3048


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- market arithmetic -------------------------------------------------------


def crack_spread_321(rbob_gal, ho_gal, wti_bbl) -> Column:
    """Two barrels of gasoline and one of heating oil against three of crude."""
    gasoline, heating, crude = _c(rbob_gal), _c(ho_gal), _c(wti_bbl)
    return (2 * gasoline * GALLONS_PER_BARREL + heating * GALLONS_PER_BARREL - 3 * crude) / 3


def spread(a, b) -> Column:
    """Brent over WTI, prompt spread, first-to-twelfth slope and weekly change."""
    return _c(a) - _c(b)


def curve_structure(first, last) -> Column:
    slope = _c(first) - _c(last)
    return F.when(slope > 0, "backwardation").when(slope < 0, "contango").when(slope == 0, "flat")


def guarded_ratio(num, den, scale: float = 1.0) -> Column:
    """``scale * num / den``; a denominator that is not positive fails the query."""
    d = _c(den)
    return F.when(d <= 0, F.raise_error(F.lit("denominator must be positive")).cast("double")).otherwise(
        F.lit(scale) * _c(num) / d
    )


def days_of_cover(stocks, daily_use) -> Column:
    return guarded_ratio(stocks, daily_use)


def pct_of_target(delivered, target) -> Column:
    return guarded_ratio(delivered, target, 100.0)


def delta_pct(a, b) -> Column:
    return F.lit(100.0) * (_c(a) - _c(b)) / F.nullif(_c(b), F.lit(0.0))


def agreement_band(pct) -> Column:
    """Absolute difference up to 5 % passes, up to 10 % warns."""
    size = F.abs(_c(pct))
    return F.when(size <= 5, "pass").when(size <= 10, "warn").otherwise("fail")


# ---- text --------------------------------------------------------------------


def blank_to_null(x) -> Column:
    text = F.trim(_c(x))
    return F.when(text != "", text)


def strip_bom(x) -> Column:
    return F.regexp_replace(_c(x), "^﻿", "")


def remove_prefix(x, prefix: str) -> Column:
    c = _c(x)
    return F.when(c.startswith(prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def split_tokens(x, joiner: str) -> Column:
    """Split on a literal joiner, trim, drop blanks."""
    parts = F.split(_c(x), "\\Q" + joiner + "\\E")
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def join_sorted_distinct(x, joiner: str = "+") -> Column:
    """Aggregate: distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(_c(x))), joiner)


def mentions(x, word: str) -> Column:
    return F.contains(F.upper(F.coalesce(_c(x), F.lit(""))), F.lit(word.upper()))


def code_lookup(x, codes: Mapping[str, object]) -> Column:
    """Small fixed code map as a literal; a code outside it gives NULL."""
    pairs = [F.lit(v) for kv in codes.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), _c(x))


# ---- dates and years ---------------------------------------------------------


def parse_date(x, fmt: str) -> Column:
    return F.to_date(F.try_to_timestamp(_c(x), F.lit(fmt)))


def month_start(x) -> Column:
    """``yyyy-MM`` text."""
    return parse_date(F.concat(_c(x), F.lit("-01")), "yyyy-MM-dd")


def sheet_month(x) -> Column:
    """``yyyy'M'MM`` text, e.g. 1960M01."""
    text = F.trim(_c(x))
    return F.when(
        text.rlike(r"^\d{4}M\d{2}$"), month_start(F.regexp_replace(text, "M", "-"))
    )


def parse_seen_at(x) -> Column:
    """Compact UTC stamp first, ISO text second, NULL when neither fits."""
    text = blank_to_null(x)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp(text)
    )


def start_year(x) -> tuple[Column, Column]:
    """(year, junk flag). A range gives its first year; an upper bound gives none."""
    text = F.trim(F.coalesce(_c(x), F.lit("")))
    ends = F.transform(F.split(F.translate(text, "–", "-"), "-"), F.trim)
    is_year = lambda e: (F.length(e) == 4) & (F.translate(e, "0123456789", "") == "")
    dated = (F.size(ends) <= 2) & F.forall(ends, is_year)
    words = F.split(text, r"\s+")
    bound = (F.size(words) == 2) & F.get(words, 0).isin("Before", "before") & is_year(F.get(words, 1))
    return F.when(dated, F.get(ends, 0).try_cast("int")), ~(dated | bound | (text == ""))


def int_year(x) -> tuple[Column, Column]:
    text = F.trim(F.coalesce(_c(x), F.lit("")))
    year = F.when(text != "", text.try_cast("int"))
    return year, (text != "") & year.isNull()


def epoch_ms_year(x) -> Column:
    """Negative values are years before 1970."""
    return F.year(F.timestamp_millis(_c(x).try_cast("bigint")))


def age_days(now: Column, then) -> Column:
    seconds = now.cast("timestamp").cast("double") - _c(then).cast("timestamp").cast("double")
    return F.round(seconds / 86400.0, 2)


def last_trade_date(delivery_month) -> Column:
    """Three weekdays before the 25th of the month before delivery, four when
    that 25th falls on a weekend. Exchange holidays are not considered."""
    the_25th = F.date_add(F.add_months(_c(delivery_month), -1), 24)
    day = F.weekday(the_25th)
    back = (
        F.when(day <= 2, 5)  # Mon-Wed: three weekdays back crosses a weekend
        .when(day <= 4, 3)
        .when(day == 5, 4)
        .otherwise(5)
    )
    return F.date_sub(the_25th, back)


#: Futures month letters, January to December.
MONTH_LETTERS = "FGHJKMNQUVXZ"


def contract_code(delivery_month, root: str = "CL", suffix: str = ".NYM") -> Column:
    d = _c(delivery_month)
    letter = F.substring(F.lit(MONTH_LETTERS), F.month(d), F.lit(1))
    return F.concat(F.lit(root), letter, F.date_format(d, "yy"), F.lit(suffix))


def first_delivery(asof) -> Column:
    """Nearest delivery month whose last trade date has not passed."""
    coming = F.add_months(F.trunc(_c(asof), "month"), 1)
    return F.when(last_trade_date(coming) >= _c(asof), coming).otherwise(F.add_months(coming, 1))


# ---- numbers -----------------------------------------------------------------


def cluster_key(x, digits: int = 3) -> Column:
    """Integer key of a coordinate: scale, then round half to even."""
    return F.rint(_c(x) * float(10**digits)).cast("long")


def finite_or_null(x) -> Column:
    c = _c(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def feet_to_metres(x) -> Column:
    return _c(x) * FEET_TO_METRES


def water_depth(elevation) -> Column:
    return F.greatest(F.lit(0.0), -_c(elevation))


def round_ring(coords, digits: int = 3) -> Column:
    """Round every coordinate of a nested line (array of points)."""
    return F.transform(_c(coords), lambda pt: F.transform(pt, lambda v: F.round(v, digits)))


def round_rings(coords, digits: int = 3) -> Column:
    """The same one level deeper (array of lines)."""
    return F.transform(_c(coords), lambda line: round_ring(line, digits))


# ---- labels for display and rules ---------------------------------------------


def outcome_code(label, excluded, content) -> Column:
    """2 oil, 1 gas, 3 discovery of unnamed phase, 0 dry, -1 no outcome."""
    oil, gas = mentions(content, "OIL"), mentions(content, "GAS")
    return (
        F.when(_c(excluded), -1)
        .when((_c(label) == 1) & gas & ~oil, 1)
        .when((_c(label) == 1) & oil, 2)
        .when(_c(label) == 1, 3)
        .otherwise(0)
    )


def phase_of_name(name) -> Column:
    oil, gas = mentions(name, "OIL"), mentions(name, "GAS")
    return F.when(oil & gas, "both").when(gas, "gas").when(oil, "oil").otherwise("und")


def water_depth_class(elevation) -> Column:
    """0 onshore, 1 shelf down to 400 m, 2 deeper, NULL without bathymetry."""
    e = _c(elevation)
    return F.when(e >= 0, 0).when(e >= -400, 1).when(e < -400, 2)


def development_concept(depth_m, host_km) -> Column:
    """NULL depth or distance gives NULL, which the caller reports as a gap."""
    d, h = finite_or_null(depth_m), finite_or_null(host_km)
    return (
        F.when(d.isNull() | h.isNull(), F.lit(None).cast("string"))
        .when(d <= 0, "onshore")
        .when((d <= 400) & (h <= 50), "shelf_tieback")
        .when((d > 400) & (h <= 70), "deepwater_tieback")
        .otherwise("fpso_standalone")
    )


def threshold_score(x, threshold: float = 500.0) -> Column:
    """1 strictly above the threshold, else 0; missing counts as 0."""
    return F.coalesce((finite_or_null(x) > threshold).cast("double"), F.lit(0.0))


def score_mask(province_code, sediment_m) -> Column:
    inside = F.coalesce(_c(province_code) > 0, F.lit(False))
    thick = F.coalesce(finite_or_null(sediment_m), F.lit(0.0)) > 500.0
    return (inside & thick).cast("int")
