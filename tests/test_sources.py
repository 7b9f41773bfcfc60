import json

import pytest
from pyspark.sql import functions as F

from basinframe.errors import ContractViolation, SourceUnavailable
from basinframe.functions import codes
from basinframe.sources import curated, events, governance, infrastructure, links, market, wells


def docs(spark, tmp_path, payloads, schema):
    """Documents landed as files and read as the feeds are."""
    for i, p in enumerate(payloads):
        (tmp_path / f"d{i}.json").write_text(json.dumps(p))
    return spark.read.schema(schema).option("multiLine", True).json(str(tmp_path))


def test_spot(spark, tmp_path):
    ok = {"series_id": "DCOILWTICO", "observations": [{"date": "2020-04-20", "value": "-36.98"}, {"date": "2020-04-21", "value": "."}]}
    out = market.SPOT.load(docs(spark, tmp_path, [ok], market.SPOT_JSON)).collect()
    assert [(r["metric"], r["value"]) for r in out] == [("wti_usd_bbl", -36.98)]
    (tmp_path / "bad.json").write_text(json.dumps({"series_id": "DCOILWTICO", "error_message": "no key"}))
    with pytest.raises(SourceUnavailable, match="no observations"):
        market.SPOT.load(spark.read.schema(market.SPOT_JSON).option("multiLine", True).json(str(tmp_path)))


def weekly(**response):
    return {"series_id": "PET.WCESTUS1.W", "metric": "crude_stocks_excl_spr_kbbl", "response": response}


def test_weekly(spark, tmp_path):
    rows = [{"period": "2026-07-10", "value": 421000}, {"period": "2026-07-03", "value": "420000"}, {"period": "2026-06-26", "value": None}, {"period": "2026-06-19", "value": "--"}]
    out = market.WEEKLY.load(docs(spark, tmp_path, [weekly(total="4", data=rows)], market.WEEKLY_JSON))
    assert sorted(r["value"] for r in out.collect()) == [420000.0, 421000.0]


@pytest.mark.parametrize(
    "payload, message",
    [
        (weekly(total="9", data=[{"period": "2026-07-10", "value": 1}]), "truncated"),
        (weekly(total="0", data=[]), "empty response"),
        ({"series_id": "x", "metric": "y", "error": {"code": "API_KEY_MISSING", "message": "m"}}, "error body"),
    ],
)
def test_weekly_failures(spark, tmp_path, payload, message):
    with pytest.raises(SourceUnavailable, match=message):
        market.WEEKLY.load(docs(spark, tmp_path, [payload], market.WEEKLY_JSON))


def test_flows(spark, tmp_path):
    head = ",".join(codes.FLOW_COLUMNS)
    body = ["SA,2026-01,CRUDEOIL,INDPROD,KBD,9000.5,1", "SA,2026-01,CRUDEOIL,STOCKCH,KBD,-12,1", "RU,2026-01,CRUDEOIL,INDPROD,KBD,N/A,3", "RU,2026-01,NGL,INDPROD,KBD,5,1"]
    (tmp_path / "f.csv").write_text("\n".join([head, *body]))
    out = market.FLOWS.load(market.read_flows(spark, str(tmp_path))).collect()
    assert sorted(r["value"] for r in out) == [-12.0, 9000.5]
    (tmp_path / "f.csv").write_text("\n".join([head, "SA,2026-01,CRUDEOIL,INDPROD,KBD,??,1"]))
    with pytest.raises(ContractViolation, match="unrecognised value"):
        market.FLOWS.load(market.read_flows(spark, str(tmp_path)))


def test_rigs(spark):
    rows = [("UNITED STATES", " Permian ", "Oil", "2026-07-17", 10), ("UNITED STATES", "Permian", "Oil", "2026-07-17", 5), ("CANADA", "Other", "Gas", "2026-07-17", None)]
    df = spark.createDataFrame(rows, "Country string, Basin string, DrillFor string, US_PublishDate string, `Rig Count Value` int")
    out = market.RIGS.load(df).collect()
    assert [(r["region"], r["basin"], r["rig_count"]) for r in out] == [("us", "Permian", 15)]
    with pytest.raises(ContractViolation, match="country"):
        market.RIGS.load(df.withColumn("Country", F.lit("MEXICO")))


def test_strip_calendar(spark):
    asof = spark.createDataFrame([("2026-07-18",)], "d string").select(F.to_date("d").alias("asof_date"))
    cal = market.strip_calendar(asof).orderBy("month_index").collect()
    assert cal[0]["contract"] == "CLQ26.NYM" and cal[-1]["contract"] == "CLN27.NYM" and len(cal) == 12
    quotes = market.strip_calendar(asof).select(
        "asof_date", F.col("contract").alias("ticker"), F.lit("80.5").alias("last_price"), F.lit(None).cast("string").alias("previous_close"), F.lit("USD").alias("currency")
    )
    assert market.load_strip(quotes).count() == 12
    with pytest.raises(ContractViolation, match="strip quote missing"):
        market.load_strip(quotes.where("ticker <> 'CLU26.NYM'"))
    with pytest.raises(ContractViolation, match="USD"):
        market.load_strip(quotes.withColumn("currency", F.lit("EUR")))


def test_front_months(spark):
    rows = [("2026-07-18", t, "2.5", None, "USD") for t in codes.FRONT_TICKERS]
    df = spark.createDataFrame(rows, "asof_date string, ticker string, last_price string, previous_close string, currency string")
    out = {r["ticker"]: r for r in market.load_front_months(df).collect()}
    assert out["RB=F"]["settle_usd_gal"] == 2.5 and out["RB=F"]["settle_usd_bbl"] is None
    with pytest.raises(ContractViolation, match="front-month quote missing"):
        market.load_front_months(df.where("ticker <> 'HO=F'"))


def test_members(spark):
    rows = [(f"Land {chr(65 + i)}", "1,000*", "1,010", "2,005", "10") for i in range(8)]
    rows += [("Land Z", "..", "500", "5", "0"), ("Total OPEC", "8,000", "8,580", "x", "y")]
    wide = spark.createDataFrame(rows, "country string, `May 26` string, `Jun 26` string, `2Q26` string, `Jun/May` string")
    out = market.load_members(wide)
    assert out.count() == 17 and out.agg(F.max("production_kbd")).first()[0] == 1010.0
    off = wide.withColumn("Jun 26", F.when(F.col("country") == "Land A", "1,100").otherwise(F.col("`Jun 26`")))
    with pytest.raises(ContractViolation, match="member sum"):
        market.load_members(off)


def test_sheet(spark):
    names = list(codes.COMMODITIES)
    wide = spark.createDataFrame([("1960M01", *["1.5"] * 4, "…")], ["date", *names])
    units = dict.fromkeys(names, "($/bbl)") | {names[-1]: "($/mt)"}
    out = market.normalize_sheet(wide, units)
    assert market.SHEET_CONTRACT.enforce(out).count() == 4
    with pytest.raises(SourceUnavailable, match="unit"):
        market.normalize_sheet(wide, units | {names[0]: "($/kg)"})
    with pytest.raises(ContractViolation):
        market.SHEET_CONTRACT.enforce(market.normalize_sheet(wide.withColumn(names[0], F.lit("junk")), units))


def test_events(spark):
    art = lambda **k: {"url": None, "title": None, "seendate": None, "domain": None, "sourcecountry": None} | k
    payload = [art(url=" http://a ", title=" "), art(title="no link"), art(url="http://a", title="second"), art(url="http://b", seendate="not-a-date")]
    df = spark.createDataFrame([("f1", json.dumps({"articles": payload}))], "file string, j string")
    landed = df.select("file", F.from_json("j", events.EVENTS_JSON).alias("d")).select("file", "d.*")
    out = {r["url"]: r for r in events.EVENTS.load(landed).collect()}
    assert set(out) == {"http://a", "http://b"}
    assert out["http://a"]["title"] is None and out["http://b"]["seen_at"] is None


def governance_text(spark, payload):
    return spark.createDataFrame([("﻿" + json.dumps(payload),)], "value string")


def test_governance(spark):
    row = lambda ind, v, iso="NOR": {"indicator": {"id": f"GOV_WGI_{ind}"}, "country": {"value": "Norway"}, "countryiso3code": iso, "date": "2024", "value": v}
    six = [row(i, 1.5) for i in codes.GOVERNANCE_INDICATORS]
    out = governance.load_governance(governance_text(spark, [{"pages": 1}, [*six, row("RL.EST", None, "SWE"), row("RL.EST", -2.75, ""), row("PV.EST", -2.75, "YEM")]]))
    assert out.count() == 7
    with pytest.raises(SourceUnavailable, match="indicator has no rows"):
        governance.load_governance(governance_text(spark, [{"pages": 1}, six[1:]]))
    with pytest.raises(SourceUnavailable, match="message body"):
        governance.load_governance(governance_text(spark, [{"message": [{"value": "bad"}]}]))


def test_us_list(spark, tmp_path):
    line = '{},"NAME, X",-0-,"{}",-0-,-0-,-0-,-0-,-0-,-0-,-0-,-0-'
    path = tmp_path / "sdn.csv"
    path.write_text("\n".join([line.format(1, "CUBA] [SDGT"), line.format(2, "CUBA"), "\x1a"]))
    out = governance.load_us(governance.read_us_list(spark, str(path))).collect()
    assert [(r["program"], r["iso3"], r["designation_count"]) for r in out] == [("CUBA", "CUB", 2)]
    path.write_text(line.format(1, "NEWLAND"))
    with pytest.raises(ContractViolation, match="unknown programme"):
        governance.load_us(governance.read_us_list(spark, str(path)))
    path.write_text("1,short,row")
    with pytest.raises(ContractViolation, match="columns wide"):
        governance.load_us(governance.read_us_list(spark, str(path)))


def test_eu_list(spark, tmp_path):
    path = tmp_path / "eu.xml"
    body = '<sanctionEntity logicalId="1"><regulation programme="RUS"/><regulation programme="RUS"/></sanctionEntity>'
    body += '<sanctionEntity logicalId="2"><regulation programme="RUS"/><regulation programme="HR"/></sanctionEntity>'
    path.write_text(f'<export generationDate="2026-06-05T00:00:00Z">{body}</export>')
    out = governance.load_eu(*governance.read_eu_list(spark, str(path))).collect()
    assert [(r["program"], r["designation_count"], str(r["list_generated_at"])[:10]) for r in out] == [("RUS", 2, "2026-06-05")]
    us = governance.normalize_us(spark.createDataFrame([("CUBA",)], "programs string"))
    with pytest.raises(ContractViolation, match="jurisdiction absent"):
        governance.combine_lists(us, governance.load_eu(*governance.read_eu_list(spark, str(path))))


def feature(geometry, **props):
    base = {"project-id": "P1", "name": "n", "status": "operating", "country-area1": "X", "start-year": "1982", "facility-type": "", "fuel": "Gas"}
    return {"properties": base | props, "geometry": geometry}


def infra_docs(spark, tracker, features):
    df = spark.createDataFrame([(tracker, json.dumps({"features": features}))], "tracker string, j string")
    return df.select("tracker", F.from_json("j", infrastructure.FEATURES_JSON).alias("d")).select("tracker", "d.*")


def test_infra(spark):
    long_line = {"type": "LineString", "coordinates": [[i / 10.0, 1.0] for i in range(188)]}
    parts = {"type": "MultiLineString", "coordinates": [[[0.0, 0.0], [1.0, 1.0]], [[2.0, 2.0]]]}
    point = {"type": "Point", "coordinates": [5.0, 6.0]}
    f = [
        feature(long_line), feature(parts), feature(long_line, status="proposed"),
        feature(point, **{"project-id": "T", "facility-type": "Import", "Latitude": 6.0, "Longitude": 5.0, "start-year": "2013-2017"}),
        feature(point, **{"project-id": "Q", "fuel": ""}),
    ]
    out = infrastructure.load_infra(infra_docs(spark, "ggit-lng", f)).orderBy("kind", "vertex_idx").collect()
    pipe = [r for r in out if r["kind"] == "gas_pipeline"]
    assert [r["vertex_idx"] for r in pipe] == list(range(7)) and pipe[4]["lon"] == pytest.approx(18.7) and pipe[6]["lat"] == 2.0
    assert [(r["kind"], r["start_year"], r["lat"], r["lon"]) for r in out if r["project_id"] == "T"] == [("lng_import", 2013, 6.0, 5.0)]
    for bad, msg in ((feature(long_line, **{"start-year": "soon"}), "start year"), (feature(point), "without a line"), (feature(long_line, **{"project-id": " "}), "project id")):
        with pytest.raises(ContractViolation, match=msg):
            infrastructure.load_infra(infra_docs(spark, "ggit-lng", [bad]))


def test_releases(spark):
    keys = ["interim_maps/goit_map_2026-01.geojson", "interim_maps/goit_map_2026-06.geojson", "interim_maps/ggit-lng_map_2025-11.geojson", "other.txt"]
    listing = spark.createDataFrame([(k, 5) for k in keys], "Key string, Size int")
    head = spark.createDataFrame([("false",)], "IsTruncated string")
    got = {r["tracker"]: r["release"] for r in infrastructure.load_latest_releases(listing, head).collect()}
    assert got == {"goit": "2026-06", "ggit-lng": "2025-11"}
    with pytest.raises(SourceUnavailable, match="truncated"):
        infrastructure.load_latest_releases(listing, head.withColumn("IsTruncated", F.lit("true")))


def test_fields_conflict(spark):
    f = lambda lat, y="1953": {"properties": {"project-id": "L1", "name": "A", "status": "operating", "country-area1": "X", "discovery-year": y}, "geometry": {"type": "Point", "coordinates": [1.0, lat]}}
    load = lambda feats: infrastructure.FIELDS.load(infra_docs(spark, "t", feats).drop("tracker"))
    assert load([f(2.0), f(2.0)]).count() == 1
    with pytest.raises(ContractViolation, match="unique:field_id"):
        load([f(2.0), f(3.0)])
    with pytest.raises(ContractViolation, match="discovery year"):
        load([f(2.0, "x")])


def test_areas(spark):
    rows = [("1", "A", "d", "II", "Designated", 0, "MOZ;ZAF", "Marine"), ("2", "B", "d", "II", "Designated", 1999, "NOR", "Terrestrial")]
    out = infrastructure.AREAS.load(spark.createDataFrame(rows, codes.AREA_COLUMNS)).collect()
    assert len(out) == 1 and out[0]["status_yr"] is None and out[0]["marine"] is True


def test_norway(spark, tmp_path):
    head = ",".join(codes.NORWAY_COLUMNS)
    (tmp_path / "n.csv").write_text("﻿" + head + "\n1/2-3  ,61.5,2.1,01.02.1979,WILDCAT ,OIL,3000,FOO ,77\n1/2-4,61.5,2.1,,WILDCAT-CCS,,,,", encoding="utf-8")
    out = {r["well_id"]: r for r in wells.NORWAY.load(wells.read_norway(spark, str(tmp_path))).collect()}
    assert out["sodir:1/2-3"]["discovery_id"] == "sodir:77:FOO" and out["sodir:1/2-3"]["spud_year"] == 1979
    assert out["sodir:1/2-4"]["purpose"] == "other" and out["sodir:1/2-4"]["discovery_id"] is None
    (tmp_path / "n.csv").write_text(head + "\nA,61.5,2.1,1979-02-01,WILDCAT,OIL,1,,")
    with pytest.raises(ContractViolation, match="DD.MM.YYYY"):
        wells.NORWAY.load(wells.read_norway(spark, str(tmp_path)))
    (tmp_path / "n.csv").write_text("<html>\nerror")
    with pytest.raises(SourceUnavailable, match="missing columns"):
        wells.read_norway(spark, str(tmp_path))


def uk_pages(spark, *features, **extra):
    df = spark.createDataFrame([(json.dumps({"features": list(features)} | extra),)], "j string")
    return df.select(F.from_json("j", wells.UK_JSON).alias("d")).select("d.*")


def test_uk(spark):
    base = {"WELLREGNO": "41/18- 2", "ORIGINTENT": "Exploration", "FLOWCLASS": None, "SPUDDATE": -110160000000, "TDTVDSSM": -930.55, "TARGETFLD": "No Data Available", "TOPHOLEXDD": "1.5", "TOPHOLEYDD": "54.5"}
    ok = {"attributes": base, "geometry": None}
    stored = {"attributes": base | {"WELLREGNO": "C48/30- 21"}, "geometry": {"x": 2.0, "y": 55.0}}
    out = {r["well_id"]: r for r in wells.UK.load(uk_pages(spark, ok, stored, ok)).collect()}
    a, b = out["nsta:41/18- 2"], out["nsta:C48/30- 21"]
    assert (a["lat"], a["spud_year"], a["td_m"], a["content_raw"], a["discovery_id"]) == (54.5, 1966, 930.55, "", None)
    assert b["purpose"] == "other" and b["lat"] == 55.0
    lacking = {k: v for k, v in base.items() if k != "FLOWCLASS"}
    with pytest.raises(ContractViolation, match="attribute missing"):
        wells.UK.load(uk_pages(spark, {"attributes": lacking, "geometry": None}))
    with pytest.raises(ContractViolation, match="unique:well_id"):
        wells.UK.load(uk_pages(spark, ok, {"attributes": base | {"TDTVDSSM": 5.0}, "geometry": None}))


def test_netherlands(spark):
    props = {"BOREHOLE_CODE": "A1", "START_DATE_DRILLING": "1800-01-01", "BOREHOLE_TYPE_CODE": "EXP", "BOREHOLE_RESULT_CODE": None, "END_DEPTH_MAH": None, "FIELD_CODE": ""}
    def pages(p, n=1, m=1):
        j = json.dumps({"numberMatched": m, "numberReturned": n, "features": [{"properties": p, "geometry": {"coordinates": [5.0, 52.0]}}]})
        return spark.createDataFrame([(j,)], "j string").select(F.from_json("j", wells.NETHERLANDS_JSON).alias("d")).select("d.*")
    row = wells.NETHERLANDS.load(pages(props)).first()
    assert (row["spud_year"], row["content_raw"], row["purpose"], row["discovery_id"]) == (1800, "", "wildcat", None)
    with pytest.raises(SourceUnavailable, match="truncated"):
        wells.NETHERLANDS.load(pages(props, 1, 2))
    with pytest.raises(ContractViolation, match="type code"):
        wells.NETHERLANDS.load(pages(props | {"BOREHOLE_TYPE_CODE": "NEW"}))


def test_us_gulf(spark, tmp_path):
    head = ",".join(codes.US_GULF_COLUMNS)
    (tmp_path / "b.csv").write_text("\n".join([head, "1,7/4/1999,10000,E,28.0,-90.0, 00023,G", "2,,*****,D,28.0,-90.0,G1,G", "3,1/1/2000,5,E,60,-150,x,Y"]))
    (tmp_path / "l.csv").write_text("\n".join(["WD030,00023,a,b,c,d,e,f,g,h", "WD027, 00023,a,b,c,d,e,f,g,h"]))
    leases = wells.read_us_leases(spark, str(tmp_path / "l.csv"))
    out = {r["well_id"]: r for r in wells.load_us_gulf(wells.read_us_gulf(spark, str(tmp_path / "b.csv")), leases).collect()}
    assert out["boem:1"]["discovery_id"] == "WD027+WD030" and out["boem:1"]["td_m"] == pytest.approx(3048.0)
    assert out["boem:2"]["td_m"] is None and out["boem:2"]["content_raw"] == "NO_FIELD_LEASE" and len(out) == 2
    with pytest.raises(ContractViolation):
        wells.load_us_gulf(wells.read_us_gulf(spark, str(tmp_path / "b.csv")), leases.where("false"))


def test_australia(spark):
    w = [{"Borehole_ID": k, "Kick_Off_Date": "1970-01-02", "Borehole_Reason": None, "Drillers_TD_m": 1.0} for k in ("a", "b", "a")]
    def pages(key, rows, schema):
        j = json.dumps({key: rows})
        return spark.createDataFrame([(j,)], "j string").select(F.from_json("j", schema).alias("d")).select("d.*")
    pt = lambda k, lat: {"attributes": {"Ubhi": k, "Latitude": lat, "Longitude": 115.0}}
    wp = pages("value", w, wells.AUSTRALIA_WELLS_JSON)
    out = wells.load_australia(wp, pages("features", [pt("a", -20.0), pt("c", -21.0)], wells.AUSTRALIA_POINTS_JSON)).collect()
    assert [(r["well_id"], r["purpose"], r["content_raw"]) for r in out] == [("nopims:a", "other", "")]
    with pytest.raises(ContractViolation, match="conflicting points"):
        wells.load_australia(wp, pages("features", [pt("a", -20.0), pt("a", -22.0)], wells.AUSTRALIA_POINTS_JSON))
    with pytest.raises(SourceUnavailable):
        wells.load_australia(wp, pages("features", [pt("z", -20.0)], wells.AUSTRALIA_POINTS_JSON))


def test_links(spark):
    t = links.WORKBOOK_TYPE
    html = f"""<a href="/static-files/1" type="{t}" title="07-10-2026 North_America Rig_Count Report.xlsx">a</a>
    <A class=x href='/static-files/2' type="{t}" title="07-17-2026 North America Rig Count Report.xlsx">b</A>
    <a href="/static-files/3" type="{t}" title="Rig Count undated">c</a><a href="x/{links.SHEET_FILE}">d</a>"""
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id int, html string")
    out = links.latest_workbook(df, "https://r.example/na").collect()
    assert [(r["page_id"], r["url"]) for r in out] == [(1, "https://r.example/static-files/2")]
    sheet = links.first_link_to(df, "https://w.example/en/markets").collect()
    assert [r["url"] for r in sheet] == [f"https://w.example/en/x/{links.SHEET_FILE}"]


def test_outcome_map(spark, tmp_path):
    head = "source_id,content_raw,label,shows,source_url,excluded"
    path = tmp_path / "m.csv"
    path.write_text("\n".join([head, "nlog,GAS,1,false,u,false", 'nlog,"",0,false,u,true']))
    rows = curated.load_outcome_map(curated.read_curated(spark, str(path))).orderBy("content_raw").collect()
    assert rows[0]["content_raw"] == "" and rows[0]["excluded"] is True
    for line, msg in (("nlog,GAS,0,false,u,false", "duplicate"), ("nlog,X,1,false, ,false", "uncited"), ("nlog,X,1,maybe,u,false", "shows"), ("nlog,X,1,false,u,true", "label 0")):
        path.write_text("\n".join([head, "nlog,GAS,1,false,u,false", line]))
        with pytest.raises(ContractViolation, match=msg):
            curated.load_outcome_map(curated.read_curated(spark, str(path)))


def test_registry_and_fiscal(spark):
    reg = spark.createDataFrame([("a", "A", "rest", "https://x", "weekly", "8", "2026")], curated.REGISTRY_COLUMNS)
    assert curated.load_registry(reg).first()["sla_days"] == 8.0
    with pytest.raises(ContractViolation, match="https"):
        curated.load_registry(reg.withColumn("base_url", F.lit("http://x")))
    j = json.dumps({"iso3": "nor", "regime_type": "tax", "royalty_rate": 0.0, "cit_rate": 0.22, "engine_mapping": {"suggested_cit_rate": 0.78}, "source_urls": ["u"]})
    df = spark.createDataFrame([(j,)], "j string").select(F.from_json("j", curated.FISCAL_JSON).alias("d")).select("d.*")
    row = curated.load_fiscal(df).first()
    assert (row["iso3"], row["mapped_cit_rate"], row["suggested_cit_rate"]) == ("NOR", None, 0.78)
