import datetime as dt

import pytest
from pyspark.sql import functions as F

from basinframe.functions import scalars as s
from basinframe.functions.geo import Grid, km_of_chord


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_market_formulas(spark):
    L = F.lit
    assert one(spark, s.crack_spread_321(L(2.5), L(2.6), L(70.0))) == pytest.approx(36.4)
    assert one(spark, s.days_of_cover(L(421000.0), L(20000.0))) == pytest.approx(21.05)
    assert one(spark, s.spread(L(80.0), L(77.5))) == pytest.approx(2.5)
    assert [one(spark, s.curve_structure(L(a), L(b))) for a, b in ((80.0, 75.0), (70.0, 75.0), (7.0, 7.0))] == [
        "backwardation",
        "contango",
        "flat",
    ]
    with pytest.raises(Exception, match="denominator must be positive"):
        one(spark, s.days_of_cover(L(1.0), L(0.0)))


def test_bands(spark):
    got = [one(spark, s.agreement_band(F.lit(x))) for x in (3.4, -5.0, 8.2, -10.0, 13.6)]
    assert got == ["pass", "pass", "warn", "warn", "fail"]


@pytest.mark.parametrize(
    "text, year, junk",
    [("1982", 1982, False), ("2013-2017", 2013, False), ("Before 2024", None, False), ("", None, False), ("soon", None, True)],
)
def test_start_year(spark, text, year, junk):
    y, j = s.start_year(F.lit(text))
    assert (one(spark, y), one(spark, j)) == (year, junk)


def test_int_year_and_epoch(spark):
    assert one(spark, s.int_year(F.lit(" 1953 "))[0]) == 1953
    assert one(spark, s.int_year(F.lit("19x3"))[1]) is True
    assert one(spark, s.epoch_ms_year(F.lit("-110160000000"))) == 1966


def test_dates(spark):
    assert one(spark, s.month_start(F.lit("2026-01"))) == dt.date(2026, 1, 1)
    assert one(spark, s.sheet_month(F.lit("1960M01"))) == dt.date(1960, 1, 1)
    assert one(spark, s.parse_date(F.lit("7/4/1999"), "M/d/yyyy")) == dt.date(1999, 7, 4)
    assert one(spark, s.parse_seen_at(F.lit("20260718T041500Z"))).hour == 4
    assert one(spark, s.parse_seen_at(F.lit("not-a-date"))) is None


def last_trade(year, month):
    """Walk back day by day, the rule as it is worded."""
    y, m = (year - 1, 12) if month == 1 else (year, month - 1)
    day = dt.date(y, m, 25)
    steps = 3 if day.weekday() < 5 else 4
    while steps:
        day -= dt.timedelta(days=1)
        steps -= day.weekday() < 5
    return day


def test_last_trade_date_matches_the_walk(spark):
    months = [(y, m) for y in range(2020, 2032) for m in range(1, 13)]
    df = spark.createDataFrame([(dt.date(y, m, 1),) for y, m in months], "d date")
    got = [r["v"] for r in df.select("d", s.last_trade_date("d").alias("v")).orderBy("d").collect()]
    assert got == [last_trade(y, m) for y, m in months]


def test_cluster_key_follows_scaled_half_even(spark):
    df = spark.createDataFrame([(61.1234,), (61.12345,), (2.0005,), (-3.4565,), (0.0005,)], "x double")
    import numpy as np

    want = [int(np.rint(r[0] * 1000)) for r in df.collect()]
    assert [r["v"] for r in df.select(s.cluster_key("x").alias("v")).collect()] == want


def test_outcome_codes(spark):
    cases = [(1, False, "OIL", 2), (1, False, "GAS", 1), (1, False, "OIL/GAS", 2), (1, False, "X", 3), (0, False, "DRY", 0), (1, True, "OIL", -1)]
    df = spark.createDataFrame([c[:3] for c in cases], "l int, e boolean, c string")
    assert [r["v"] for r in df.select(s.outcome_code("l", "e", "c").alias("v")).collect()] == [c[3] for c in cases]


def test_tokens(spark):
    assert one(spark, s.split_tokens(F.lit("SDGT] [CYBER2] [ "), "] [")) == ["SDGT", "CYBER2"]
    assert one(spark, s.remove_prefix(F.lit("GOV_WGI_RL.EST"), "GOV_WGI_")) == "RL.EST"
    assert one(spark, s.strip_bom(F.lit("﻿a"))) == "a"


def test_concepts_and_depth(spark):
    cases = [(0.0, 10.0, "onshore"), (100.0, 40.0, "shelf_tieback"), (900.0, 60.0, "deepwater_tieback"), (900.0, 99.0, "fpso_standalone"), (100.0, 60.0, "fpso_standalone"), (float("nan"), 1.0, None)]
    for d, h, want in cases:
        assert one(spark, s.development_concept(F.lit(d), F.lit(h))) == want
    assert [one(spark, s.water_depth_class(F.lit(x))) for x in (0.0, -400.0, -400.5)] == [0, 1, 2]


def test_grid_cells(spark):
    g = Grid()
    assert (g.n_rows, g.n_cols) == (3600, 7200)
    assert one(spark, g.row_of(F.lit(89.99))) == 0
    assert one(spark, g.row_of(F.lit(-90.0))) == 3599
    assert one(spark, g.col_of(F.lit(180.0))) == 0
    assert one(spark, g.col_of(F.lit(-180.0))) == 0
    assert one(spark, km_of_chord(F.lit(2.0))) == pytest.approx(20015.1, abs=0.2)


def test_missing_positions_stay_missing(spark):
    none = F.lit(None).cast("double")
    g = Grid()
    assert one(spark, km_of_chord(none)) is None
    assert one(spark, g.row_of(none)) is None and one(spark, g.col_of(none)) is None
