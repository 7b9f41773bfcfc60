import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from basinframe.errors import ContractViolation
from basinframe.functions.geo import Grid
from basinframe.operators import series as s
from basinframe.operators import wells as w
from basinframe.operators.contracts import Contract, Provenance, ge, non_null
from basinframe.plans import panels
from basinframe.plans.blocks import memo_fields, screen_blocks
from basinframe.plans.dossier import block_dossier, block_memos, dossier_fields
from basinframe.plans.gate import gate_run
from basinframe.plans.labels import build_labels, stack_sources
from basinframe.plans.report import build_report, summarize
from basinframe.sources import store
from basinframe.streaming import feeds

WELL = "well_id string, source_id string, lat double, lon double, spud_year int, purpose string, content_raw string, td_m double, discovery_id string"
CODES = [("sodir", "OIL", 1, False, False), ("sodir", "DRY", 0, False, False), ("sodir", "SHOWS", 0, True, False), ("sodir", "", 0, False, True), ("boem_bsee", "FIELD_LEASE_MATCH", 1, False, False)]
MAP = "source_id string, content_raw string, label int, shows boolean, excluded boolean"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        ("sodir:a", "sodir", 61.1234, 2.0, 1981, "wildcat", "OIL", 10.0, "d"),
        ("sodir:b", "sodir", 61.12345, 2.0, 1979, "wildcat", "DRY", 20.0, None),
        ("sodir:c", "sodir", 62.0, 2.0, 1990, "wildcat", "SHOWS", None, None),
        ("sodir:d", "sodir", 63.0, 2.0, 1991, "appraisal", "OIL", None, None),
        ("sodir:e", "sodir", 64.0, 2.0, 1992, "wildcat", "", None, None),
        ("boem:f", "boem_bsee", 27.0, -90.0, 2000, "wildcat", "FIELD_LEASE_MATCH", None, None),
        ("sodir:g", "sodir", None, 2.0, 1992, "wildcat", "OIL", None, None),
        ("sodir:h", "sodir", None, 2.0, None, "wildcat", "OIL", None, None),
    ]
    return spark.createDataFrame(rows, WELL)


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame(CODES, MAP)


def test_label_rules(raw, codes):
    kept, counts = w.keep_placed_and_dated(raw)
    row = {r["source_id"]: r for r in counts.collect()}["sodir"]
    assert (row["n_raw"], row["dropped_no_spud_year"], row["dropped_no_coordinates"], row["n_kept"]) == (7, 1, 1, 5)
    points = w.decision_points(w.map_outcomes(kept, codes))
    at = {r["well_id"]: r for r in points.collect()}
    b = at["sodir:b"]  # earliest of the two sidetracks represents the location
    assert (b["label"], b["spud_year"], b["n_wellbores"], b["td_m"], b["content_raw"]) == (1, 1979, 2, 20.0, "DRY")
    sizes = {k: v.count() for k, v in w.variants(points).items()}
    assert sizes == {"primary": 3, "with_appraisal": 4, "shows_excluded": 2, "primary_ex_proxy": 2}
    summary = {r["variant"]: r for r in w.variant_summary(points).collect()}
    assert {k: r["n"] for k, r in summary.items()} == sizes
    assert summary["primary"]["by_source"] == {"sodir": 2, "boem_bsee": 1}


def test_unmapped_code_raises(raw, codes):
    with pytest.raises(ContractViolation, match="unmapped"):
        w.map_outcomes(raw, codes.where("content_raw <> 'SHOWS'"))


def test_excluded_needs_every_wellbore(spark):
    rows = [("a", "sodir", 1.0, 1.0, 1980, 0, False, True), ("b", "sodir", 1.0, 1.0, 1981, 0, True, False)]
    df = spark.createDataFrame(rows, "well_id string, source_id string, lat double, lon double, spud_year int, label int, shows boolean, excluded boolean")
    row = w.decision_points(df).first()
    assert row["excluded"] is False and row["shows"] is True and row["well_id"] == "a"


def test_creaming(spark):
    rows = [("A", 2000, "1", 1), ("A", 2000, "2", 0), ("A", 2001, "3", 1), ("A", 2001, "4", 0), ("B", 1999, "5", 0)]
    df = spark.createDataFrame(rows, "province_name string, spud_year int, well_id string, label int")
    got = {(r["province_name"], r["spud_year"]): (r["cum_wildcats"], r["cum_discoveries"]) for r in w.creaming_curve(df).collect()}
    assert got == {("A", 2000): (2, 1), ("A", 2001): (4, 2), ("B", 1999): (1, 0)}


def test_label_build(spark, raw, codes):
    cells = spark.createDataFrame([(28, 182, 7)], "row int, col int, province_code int")
    names = spark.createDataFrame([(7, " North ")], "province_code int, province_name string")
    stacked = stack_sources({"sodir": raw.where("source_id = 'sodir'"), "boem_bsee": raw.where("source_id = 'boem_bsee'")})
    out = build_labels(stacked, codes, cells, names, Grid(1.0))
    named = {r["well_id"]: r["province_name"] for r in out.harmonised.collect()}
    assert named["sodir:b"] == "North" and named["boem:f"] == "(unassigned)"
    assert out.variants["primary"].count() == 3 and out.dropped.count() == 2


# ---- series -----------------------------------------------------------------------------------


def test_reconciliation(spark):
    a = spark.createDataFrame([("SAU", "2026-01", 9000.0), ("USA", "2026-01", 13200.0), ("RUS", "2026-01", 9500.0), ("NOR", "2026-01", 1.0)], "country string, month string, v double")
    b = spark.createDataFrame([("SAU", "2026-01", 8700.0), ("USA", "2026-01", 12200.0), ("RUS", "2026-01", 11000.0)], "country string, month string, v double")
    recon = s.reconcile(a, b, ["country", "month"], "v")
    assert {r["country"]: r["status"] for r in recon.collect()} == {"SAU": "pass", "USA": "warn", "RUS": "fail"}
    tally = s.worst_first(s.recon_tally(recon), "latest_status", "country")
    assert [r["country"] for r in tally.collect()] == ["RUS", "USA", "SAU"]


def test_weekly_consistency(spark):
    rows = [("m", 1, 420000.0, 0.0), ("m", 2, 424300.0, 4300.0), ("m", 3, 421100.0, -3000.0)]
    df = spark.createDataFrame(rows, "metric string, week int, stocks_kbbl double, reported_change_kbbl double")
    assert [r["status"] for r in s.weekly_consistency(df, ["metric"]).orderBy("week").collect()] == ["pass", "fail"]


def test_lead_lag_finds_the_shift(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = np.r_[rng.normal(size=3), x[:-3]]
    a = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "month int, value double")
    b = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "month int, value double")
    out = {r["lag_months"]: r["correlation"] for r in s.lead_lag(a, b, [], "month").collect()}
    assert out[3] == pytest.approx(1.0) and abs(out[0]) < 0.5 and len(out) == 13
    assert s.unmatched_index(a, b.where("month > 0"), ["month"]).count() == 1


def test_five_year_band(spark):
    days = [dt.date(y, 1, 5) + dt.timedelta(weeks=k) for y in range(2019, 2027) for k in range(50)]
    df = spark.createDataFrame([("m", d, float(d.year)) for d in days], "metric string, period date, value double")
    band = s.five_year_band(df, ["metric"], "period", "value", F.lit(2026))
    assert band.agg(F.min("band_min"), F.max("band_max")).first() == (2021.0, 2025.0)


def test_curve_checks(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2026, 7, 1), i + 1, e) for i, e in enumerate((d(2026, 6, 1), d(2026, 8, 1), d(2026, 8, 1)))], "asof_date date, month_index int, expiry date")
    assert [r["status"] for r in s.curve_checks(df, F.lit("2026-07-18")).orderBy("month_index").collect()] == ["fail", "pass", "pass"]
    falling = df.withColumn("expiry", F.when(F.col("month_index") == 3, F.lit(d(2026, 7, 25))).otherwise(F.col("expiry")))
    assert {r["status"] for r in s.curve_checks(falling, F.lit("2026-07-18")).collect()} == {"fail"}


def test_freshness_and_report(spark):
    registry = spark.createDataFrame([("a", 8.0), ("b", 8.0), ("c", 1.0)], "source_id string, sla_days double")
    ts = dt.datetime(2026, 7, 15)
    ledger = spark.createDataFrame([("a", ts), ("c", ts)], "source_id string, retrieved_at timestamp")
    rows = {r["source_id"]: r for r in s.freshness(ledger, registry, F.lit("2026-07-18")).collect()}
    assert (rows["a"]["status"], rows["a"]["age_days"]) == ("pass", 3.0)
    assert rows["b"]["detail"] == "no data written" and rows["c"]["status"] == "fail"
    report = build_report(ledger, registry, F.lit("2026-07-18"))
    assert {r["section"]: r["overall"] for r in summarize(report).collect()} == {"freshness": "fail", "all": "fail"}


def test_ticker(spark):
    d = dt.date
    spot = spark.createDataFrame(
        [("brent_usd_bbl", d(2026, 7, 16), 80.0), ("brent_usd_bbl", d(2026, 7, 17), 82.0), ("wti_usd_bbl", d(2026, 7, 16), 78.0)], "metric string, date date, value double"
    )
    rigs = spark.createDataFrame([("us", d(2026, 7, 10), 5), ("us", d(2026, 7, 17), 7), ("canada", d(2026, 7, 17), 90)], "region string, week date, rig_count int")
    out = {r["label"]: r for r in panels.ticker(spot=spot, rigs=rigs).collect()}
    assert (out["BRENT"]["value"], out["BRENT"]["delta"]) == (82.0, 2.0)
    assert (out["B-W"]["value"], out["B-W"]["asof"]) == (2.0, "2026-07-16")
    assert (out["US RIGS"]["value"], out["US RIGS"]["delta"]) == (7.0, 2.0) and out["WTI"]["delta"] is None
    assert panels.ticker() is None


# ---- whole plans ----------------------------------------------------------------------------


def test_block_screening(spark):
    blocks = spark.createDataFrame(
        [("ok", 26.5, -91.0, "USA", "United States", 1, -2000.0, 200.0, 0.22, 80.0, 150.0, 281.0, 120.0), ("shelf", 27.0, -90.0, "USA", "United States", 1, -100.0, 20.0, 0.2, 80.0, 150.0, 281.0, 120.0), ("cut", 26.5, -91.0, "CUB", "Cuba", 1, -2000.0, 200.0, 0.22, 80.0, 150.0, 281.0, 120.0)],
        "block_id string, lat double, lon double, iso3 string, country_name string, province_code int, elevation_m double, host_distance_km double, pg double, p90 double, p50 double, p10 double, well_cost_musd double",
    )
    wells = spark.createDataFrame([("w1", 26.6, -91.0, 2000, "wildcat", 1, False, 1, "Gulf"), ("w2", 26.6, -91.0, 2001, "wildcat", 0, True, 1, "Gulf")], "well_id string, lat double, lon double, spud_year int, purpose string, label int, excluded boolean, province_code int, province_name string")
    regimes = spark.createDataFrame([("USA", 0.125, 0.21), ("CUB", 0.1, 0.3)], "iso3 string, royalty_rate double, cit_rate double")
    for c in ("mapped_royalty_rate", "mapped_cit_rate", "suggested_royalty_rate", "suggested_cit_rate"):
        regimes = regimes.withColumn(c, F.lit(None).cast("double"))
    n = None
    costs = spark.createDataFrame(
        [("fpso_standalone", 8.0, 18.0, 6.28, 6.65, 60.0, 240.0, 2.5, 3.2, "u", "d", ""), ("shelf_tieback", n, n, n, n, 12.0, 50.0, n, n, "u", "d", "")],
        "concept string, capex_usd_boe_low double, capex_usd_boe_high double, opex_usd_bbl_low double, opex_usd_bbl_high double, well_cost_musd_low double, well_cost_musd_high double, schedule_years_low double, schedule_years_high double, source_url string, retrieved_at string, notes string",
    )
    strip = spark.createDataFrame([(dt.date(2026, 7, 18), 1, 82.49), (dt.date(2026, 7, 17), 1, 50.0)], "asof_date date, month_index int, settle_usd_bbl double")
    programs = spark.createDataFrame([("CUB", "Cuba", "CUBA", "OFAC")], "iso3 string, country_name string, program string, list_source string")
    out = {r["block_id"]: r for r in screen_blocks(blocks, wells=wells, regimes=regimes, costs=costs, strip=strip, programs=programs, n_draws=2000).collect()}
    ok = out["ok"]
    assert (ok["npv_musd"], ok["emv_musd"], ok["breakeven_usd_bbl"], ok["verdict"]) == (2524.26, 461.74, 38.2, "GO")
    assert ok["offset_wells"] == 2 and ok["offset_success_rate"] == 1.0 and ok["basin_wildcats"] == 1 and ok["data_gaps"] == ["overlap"]
    assert out["shelf"]["verdict"] is None and "opex_usd_bbl" in out["shelf"]["cost_gap"] and "economics" in out["shelf"]["data_gaps"]
    assert out["cut"]["verdict"] == "NO_GO" and out["cut"]["programs"] == ["CUBA"]
    fields = memo_fields(screen_blocks(blocks.limit(1), wells=wells, regimes=regimes, costs=costs, strip=strip, n_draws=10))
    assert fields.where("size(source_ids) = 0").count() == 0


def test_block_dossier_and_memos(spark):
    blocks = spark.createDataFrame(
        [("a", 10.5, 10.5, "usa", "United States"), ("far", -40.0, 100.0, "ATL", "Atlantis"), ("none", None, None, None, None)],
        "block_id string, lat double, lon double, iso3 string, country_name string",
    )
    wells = spark.createDataFrame(
        [(f"w{i}", "sb"[i % 2], 10.5 + i * 0.1, 10.5, "wildcat", "oil", i % 2, i == 3, 1990 + i, 7, "Gulf") for i in range(7)],
        "well_id string, source_id string, lat double, lon double, purpose string, outcome_raw string, label int, excluded boolean, spud_year int, province_code int, province_name string",
    )
    cells = spark.createDataFrame([(7, 19, float("nan"), -20.0, 7)], "row int, col int, score_mask double, elevation_m double, province_code int")
    scores = spark.createDataFrame([("USA", 2020, "VA.EST", 0.5), ("USA", 2021, "VA.EST", 0.87654)], "iso3 string, year int, indicator string, value double")
    programs = spark.createDataFrame([("XXX", "atlantis", "P", "EU")], "iso3 string, country_name string, program string, list_source string")
    policy = spark.createDataFrame([(" True",), ("no",), (None,)], "upstream_oil_excluded string")
    box = [(10.0, 10.0), (11.0, 10.0), (11.0, 11.0), (10.0, 11.0), (10.0, 10.0)]
    edges = spark.createDataFrame([(1, i, *p, *q) for i, (p, q) in enumerate(zip(box, box[1:], strict=False))], "area_id int, ord int, x1 double, y1 double, x2 double, y2 double")
    names = spark.createDataFrame([(1, "Reef")], "area_id int, name string")
    table = block_dossier(
        blocks, wells=wells, cells=cells, grid=Grid(10.0), governance=scores, indicators=["VA.EST"], programs=programs, financing=policy,
        areas=(edges, names), sources=["s", "b", "other"], radius_km=40.0,
    )
    out = {r["block_id"]: r for r in table.collect()}
    a, far, none = out["a"], out["far"], out["none"]
    assert (a["offset_wells"], a["offset_labelled"], a["offset_discoveries"], a["offset_success_rate"]) == (4, 3, 1, 0.333)
    assert a["offset_sources"] == ["b", "s"] and far["offset_sources"] == [] and far["offset_success_rate"] is None
    assert [(n["rank"], n["well_id"], n["label"], n["distance_km"]) for n in a["nearest_wells"]] == [(1, "w0", 0, 0.0), (2, "w1", 1, 11.1), (3, "w2", 0, 22.2), (4, "w3", None, 33.4), (5, "w4", 0, 44.5)]
    assert (a["province_name"], a["basin_wildcats"], a["basin_discoveries"], a["elevation_m"], a["in_scoreable_mask"]) == ("Gulf", 6, 2, -20.0, False)
    assert (a["governance_year"], a["va_est"], a["fsi_total"], a["sanctioned"], far["sanctioned"]) == (2021, 0.877, None, False, True)
    assert (a["institutions_checked"], a["institutions_restricting"]) == (3, 1)
    assert a["protected_areas"] == ["Reef"] and a["overlap_pct"] == pytest.approx(100.0) and far["overlap_pct"] == 0
    assert none["nearest_wells"] is None and none["offset_wells"] == 0 and none["overlap_pct"] is None and none["governance_year"] is None
    fields = dossier_fields(table)
    got = {r["block_id"]: r for r in block_memos(fields).collect()}
    assert got["a"]["n_fields"] == 13 and got["a"]["n_gaps"] == 1 and got["a"]["rejected"] is None and "wdpa" in got["a"]["sources"]
    prose = fields.withColumn("source_ids", F.when(F.col("agent") != "economist", F.col("source_ids")))
    cut = {r["block_id"]: r for r in block_memos(prose).collect()}
    assert cut["a"]["rejected"] and cut["a"]["coverage"] == pytest.approx(11 / 13) and cut["a"]["quant_hash"] == got["a"]["quant_hash"]
    changed = block_memos(fields.withColumn("value", F.when(F.col("field") == "offset_wells", "5").otherwise(F.col("value"))))
    assert changed.where("block_id = 'a'").first()["quant_hash"] != got["a"]["quant_hash"]


def test_gate_run(spark):
    rng = np.random.default_rng(11)
    rows = []
    for p, (la, lo) in {"A": (0.0, 0.0), "B": (20.0, 20.0), "C": (-20.0, 40.0)}.items():
        for i in range(40):
            y = int(rng.uniform() < 0.5)
            rows.append((f"{p}{i}", ("sodir", "boem_bsee")[i % 4 == 0], la + rng.normal(), lo + rng.normal(), p, ord(p), y, int(rng.integers(1960, 2000)), float(y + rng.normal() * 0.3)))
    wells = spark.createDataFrame(rows, "well_id string, source_id string, lat double, lon double, province_name string, province_code int, label int, spud_year int, sed_thickness_m double")
    static = wells.select("well_id", "sed_thickness_m")
    verdict, runs = gate_run(wells.drop("sed_thickness_m"), static, features=["sed_thickness_m", "dist_discovery_km", "province_success_rate"], min_wells=25, rounds=5, depth=2)
    got = {r["pooling"]: r for r in verdict.collect()}
    assert set(got) == {"raw", "rank"} and got["rank"]["passed"] and got["rank"]["n_sets"] == 2
    oof = runs["primary"].oof.toPandas()
    assert len(oof) == 120 and oof.groupby("well_id").size().max() == 1
    assert runs["primary"].folds.where("fold = 'pooled'").count() == 1


# ---- streams -----------------------------------------------------------------------------------


def test_streamed_events_keep_one_per_link(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("http://a", "t1", "20260718T041500Z"), ("http://a", "t2", "20260718T050000Z"), (" ", "x", None), ("http://b", None, "junk")]
    df = spark.createDataFrame(rows, "url string, title string, seendate string").withColumns(
        {"domain": F.lit("d"), "sourcecountry": F.lit(None).cast("string"), "arrived_at": F.lit("2026-07-18 06:00:00").cast("timestamp")}
    )
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    out = feeds.deduplicated(feeds.timed_events(stream), "1 day")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["url"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {"http://a", "http://b"}
    assert got["http://b"]["seen_at"] is None and got["http://b"]["event_time"].hour == 6


def test_contracted_append_is_repeatable(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 5.0), (2, -1.0)], "id int, v double").write.parquet(str(src))
    rule = Contract("t", {"id": non_null("int"), "v": non_null("double", ge(0))})
    prov = Provenance("t", dt.datetime(2026, 7, 18, tzinfo=dt.UTC), "https://t", "1")
    for attempt in range(2):  # a lost checkpoint runs the same batch again
        stream = spark.readStream.schema("id int, v double").parquet(str(src))
        feeds.contracted_append(stream, rule, prov, "t", str(tmp_path / "root"), str(tmp_path / f"cp{attempt}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "root/t")).count() == 1
    assert spark.read.parquet(str(tmp_path / "root/t_quarantine")).first()["failed_checks"] == ["v:ge"]
    ledger = store.read_ledger(spark, str(tmp_path / "root"))
    assert [r["rows"] for r in ledger.collect()] == [1] and ledger.first()["written_at"] is not None
    assert store.read_table(spark, str(tmp_path / "root"), "t").count() == 1


def test_contracted_append_keeps_keys_unique_over_batches(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "root")
    rule = Contract("t", {"id": non_null("int"), "v": non_null("double", ge(0))}, unique=("id",))
    prov = Provenance("t", dt.datetime(2026, 7, 18, tzinfo=dt.UTC), "https://t", "1")
    for rows in ([(1, 5.0), (2, 1.0), (2, 2.0)], [(1, 7.0), (3, 1.0)]):
        spark.createDataFrame(rows, "id int, v double").write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("id int, v double").parquet(str(src))
        feeds.contracted_append(stream, rule, prov, "t", root, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["id"], r["v"]) for r in store.read_table(spark, root, "t").collect()) == [(1, 5.0), (3, 1.0)]
    bad = spark.read.parquet(f"{root}/t_quarantine").collect()
    assert sorted((r["id"], r["failed_checks"][0]) for r in bad) == [(1, "unique:id"), (2, "unique:id"), (2, "unique:id")]


def test_wells_without_coordinates_raise(spark):
    wells = spark.createDataFrame([("s", "a", None, 1.0)], "source_id string, well_id string, lat double, lon double")
    with pytest.raises(ContractViolation):
        w.decision_points(wells)


def test_lead_lag_needs_one_index(spark):
    a = spark.createDataFrame([("m", 1, 1.0), ("m", 2, 2.0)], "k string, month int, value double")
    b = spark.createDataFrame([("m", 1, 1.0), ("m", 3, 2.0)], "k string, month int, value double")
    with pytest.raises(ContractViolation):
        s.lead_lag(a, b, ["k"], "month", 1)
