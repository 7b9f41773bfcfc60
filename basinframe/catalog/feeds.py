"""Feed queries: raw rows shaped from the supplied tables, then normalised."""

from __future__ import annotations

from pyspark.sql import functions as F

from basinframe.catalog.registry import day, fix, fix_sql, query
from basinframe.catalog.shapes import lat_of, lat_sql, lon_of, lon_sql
from basinframe.functions import codes
from basinframe.sources import curated, events, export, governance, infrastructure, links, market, wells
from basinframe.sources.store import (
    availability,
    data_mode,
    latest_by_table,
    manifest,
    read_cells,
    read_ledger,
    run_source,
    write_cells,
)


def _pick(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


K = "o_orderkey"
_SPOT = list(codes.SPOT_METRICS)


@query(
    "price_observations",
    f"""SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, {_list(_SPOT)}[o_orderkey % 4 + 1] AS series_id,
        {_list(codes.SPOT_METRICS.values())}[o_orderkey % 4 + 1] AS metric, o_totalprice - 2e5 AS value
        FROM orders WHERE o_orderkey % 10 <> 0""",
)
def price_observations(t):
    """One landed document per order, parsed, exploded and typed."""
    value = F.when(F.col(K) % 10 == 0, ".").otherwise((F.col("o_totalprice") - 200000.0).cast("string"))
    doc = F.to_json(
        F.struct(
            _pick(F.col(K) % 4, _SPOT).alias("series_id"),
            F.array(F.struct(day("o_orderdate").alias("date"), value.alias("value"))).alias("observations"),
        )
    )
    docs = t.orders.select(F.from_json(doc, market.SPOT_JSON).alias("d")).select("d.*")
    out = market.normalize_spot(market.spot_rows(docs))
    return out.withColumn("date", day("date"))


@query(
    "weekly_series",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS period, 'PET.W' || (o_orderkey % 3) || '.W' AS series_id,
       'stocks' || (o_orderkey % 3) || '_kbbl' AS metric, o_totalprice AS value
       FROM orders WHERE o_orderkey % 11 > 3""",
)
def weekly_series(t):
    k = F.col(K)
    value = (
        F.when(k % 11 == 0, "--").when(k % 11 == 1, "NA").when(k % 11 == 2, "W")
        .when(k % 11 == 3, F.lit(None)).otherwise(F.col("o_totalprice").cast("string"))
    )
    data = F.array(F.struct(day("o_orderdate").alias("period"), value.alias("value")))
    docs = t.orders.select(
        F.concat(F.lit("PET.W"), k % 3, F.lit(".W")).alias("series_id"),
        F.concat(F.lit("stocks"), k % 3, F.lit("_kbbl")).alias("metric"),
        F.struct(F.lit("1").alias("total"), data.alias("data")).alias("response"),
    )
    out = market.normalize_weekly(market.weekly_rows(docs))
    return out.withColumn("period", day("period"))


@query(
    "country_production",
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, 'INTL.' || n_nationkey AS series_id,
       'C' || chr(CAST(65 + n_nationkey AS INT)) || 'X' AS country_iso3, 'crude_production_kbd' AS metric, o_totalprice AS value
       FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
       WHERE o_orderkey % 9 <> 0 AND n_nationkey < 20""",
)
def country_production(t):
    """Monthly series of the pinned countries only."""
    pins = t.nation.where("n_nationkey < 20").select(
        F.concat(F.lit("INTL."), "n_nationkey").alias("series_id"),
        F.concat(F.lit("C"), F.char(F.col("n_nationkey") + 65), F.lit("X")).alias("iso3"),
    )
    raw = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.concat(F.lit("INTL."), "c_nationkey").alias("series_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.when(F.col(K) % 9 == 0, "--").otherwise(F.col("o_totalprice").cast("string")).alias("value"),
    )
    out = market.normalize_country_production(raw, pins)
    return out.withColumn("period", day("period"))


@query(
    "country_flows",
    f"""SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS period, 'C' || (l_suppkey % 10) AS ref_area,
        'CRUDEOIL' AS energy_product, {_list(codes.FLOWS)}[l_linenumber % 10 + 1] AS flow_breakdown,
        {_list(codes.FLOW_UNITS)}[l_partkey % 5 + 1] AS unit_measure, l_extendedprice - 5e4 AS value,
        CAST(l_linenumber % 3 + 1 AS VARCHAR) AS assessment_code
        FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey % 13 > 3""",
)
def country_flows(t):
    k = F.col("l_orderkey")
    marker = F.when(k % 13 <= 3, _pick(F.least(k % 13, F.lit(3)), codes.FLOW_ABSENT))
    raw = t.lineitem.select(
        F.concat(F.lit("C"), F.col("l_suppkey") % 10).alias("REF_AREA"),
        F.date_format("l_shipdate", "yyyy-MM").alias("TIME_PERIOD"),
        F.when(F.col("l_returnflag") == "A", "CRUDEOIL").otherwise("NGL").alias("ENERGY_PRODUCT"),
        _pick(F.col("l_linenumber") % 10, codes.FLOWS).alias("FLOW_BREAKDOWN"),
        _pick(F.col("l_partkey") % 5, codes.FLOW_UNITS).alias("UNIT_MEASURE"),
        F.coalesce(marker, (F.col("l_extendedprice") - 50000.0).cast("string")).alias("OBS_VALUE"),
        (F.col("l_linenumber") % 3 + 1).cast("string").alias("ASSESSMENT_CODE"),
    )
    return market.normalize_flows(raw).withColumn("period", day("period"))


@query(
    "rig_counts",
    """SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week,
       CASE WHEN o_custkey % 2 = 0 THEN 'us' ELSE 'canada' END AS region, 'B' || (o_custkey % 8) AS basin,
       ['oil','gas','miscellaneous'][o_orderkey % 3 + 1] AS drill_for, CAST(sum(o_orderkey % 9) AS BIGINT) AS rig_count
       FROM orders WHERE o_orderkey % 17 <> 0 GROUP BY ALL""",
)
def rig_counts(t):
    k = F.col(K)
    raw = t.orders.select(
        F.when(F.col("o_custkey") % 2 == 0, "UNITED STATES").otherwise("CANADA").alias("Country"),
        F.concat(F.lit(" B"), F.col("o_custkey") % 8, F.lit(" ")).alias("Basin"),
        _pick(k % 3, list(codes.RIG_FUELS)).alias("DrillFor"),
        F.date_trunc("week", "o_orderdate").alias("US_PublishDate"),
        F.when(k % 17 != 0, k % 9).alias("Rig Count Value"),
    )
    return market.normalize_rigs(raw).withColumn("week", day("week"))


@query(
    "export_values",
    """SELECT CAST(year(o_orderdate) AS INT) AS year, 'R' || lpad(CAST(o_custkey % 90 AS VARCHAR), 2, '0') AS reporter_iso,
       'Reporter ' || (o_custkey % 90) AS reporter, o_totalprice AS export_value_usd,
       (o_orderkey % 4 = 0 OR o_orderkey % 5 = 0) AS is_estimate, (o_custkey % 2 = 0) AS truncated
       FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0""",
)
def export_values(t):
    k, c = F.col(K), F.col("o_custkey")
    docs = t.orders.select(
        F.when(c % 2 == 0, 500).otherwise(120).alias("count"),
        F.array(
            F.struct(
                F.year("o_orderdate").alias("refYear"),
                F.concat(F.lit("R"), F.lpad((c % 90).cast("string"), 2, "0")).alias("reporterISO"),
                F.concat(F.lit("Reporter "), c % 90).alias("reporterDesc"),
                F.when(k % 7 != 0, F.col("o_totalprice")).alias("primaryValue"),
                F.lit("X").alias("flowCode"),
                F.lit("2709").alias("cmdCode"),
                (k % 3).cast("int").alias("partnerCode"),
                F.lit(0).alias("partner2Code"),
                F.lit(0).alias("motCode"),
                F.lit("C00").alias("customsCode"),
                (k % 4 != 0).alias("isReported"),
                F.when(k % 5 == 0, True).alias("isAggregate"),
            )
        ).alias("data"),
    )
    return market.normalize_exports(market.export_rows(docs))


@query(
    "event_dedupe_first",
    """WITH raw AS (
         SELECT event_type AS file, event_id AS pos, 'http://x/' || (user_id * 7 % 500) AS url,
                CASE WHEN event_id % 5 = 0 THEN '' ELSE 'T' || event_id END AS title,
                CASE WHEN event_id % 4 <> 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '' END AS seen
         FROM events WHERE event_id % 6 <> 0),
       r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY file, pos) AS n FROM raw)
       SELECT url, title, seen, 'd' || (pos % 3) AS domain FROM r WHERE n = 1""",
)
def event_dedupe_first(t):
    e, k = t.events, F.col("event_id")
    stamp = (
        F.when(k % 4 == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
        .when(k % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(k % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise("not-a-date")
    )
    raw = e.select(
        F.col("event_type").alias("file"),
        k.alias("pos"),
        F.when(k % 6 != 0, F.concat(F.lit(" http://x/"), F.col("user_id") * 7 % 500)).otherwise("  ").alias("url"),
        F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("T"), k)).alias("title"),
        stamp.alias("seendate"),
        F.concat(F.lit("d"), k % 3).alias("domain"),
        F.lit(None).cast("string").alias("sourcecountry"),
    )
    out = events.normalize_events(raw)
    return out.select(
        "url",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("seen"),
        "domain",
    )


_IND = list(codes.GOVERNANCE_INDICATORS)


@query(
    "governance_rows",
    f"""SELECT 'C' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') AS iso3, 'Land ' || (o_custkey % 60) AS country,
        {_list(_IND)}[o_orderkey % 6 + 1] AS indicator, CAST(year(o_orderdate) AS INT) AS year,
        (o_orderkey % 500 - 250) / 1e2 AS value
        FROM orders WHERE o_orderkey % 8 <> 0 AND o_orderkey % 9 <> 0""",
)
def governance_rows(t):
    """Two-element documents ``[meta, rows]`` as text, with a byte-order mark."""
    k, c = F.col(K), F.col("o_custkey")
    row = F.struct(
        F.struct(F.concat(F.lit("GOV_WGI_"), _pick(k % 6, _IND)).alias("id")).alias("indicator"),
        F.struct(F.concat(F.lit("Land "), c % 60).alias("value")).alias("country"),
        F.when(k % 9 != 0, F.concat(F.lit("C"), F.lpad((c % 60).cast("string"), 2, "0")))
        .otherwise("")
        .alias("countryiso3code"),
        F.year("o_orderdate").cast("string").alias("date"),
        F.when(k % 8 != 0, (k % 500 - 250) / F.lit(100.0)).alias("value"),
    )
    text = F.concat(F.lit('﻿[{"page":1},'), F.to_json(F.array(row)), F.lit("]"))
    docs = governance.governance_documents(t.orders.select(text.alias("value")))
    return governance.normalize_governance(governance.governance_rows(docs))


_US = list(codes.US_COUNTRY_TOKENS)
_US_ALL = _US + list(codes.US_THEMATIC_TOKENS)
_EU = list(codes.EU_COUNTRY_TOKENS)
_US_SQL = f"""us AS (
  SELECT unnest([{_list(_US_ALL)}[o_orderkey % {len(_US_ALL)} + 1], {_list(_US_ALL)}[o_custkey % {len(_US_ALL)} + 1]]) AS program
  FROM orders),
us_n AS (SELECT program, count(*) AS designation_count FROM us WHERE list_contains({_list(_US)}, program) GROUP BY 1)"""
_EU_SQL = f"""eu AS (
  SELECT DISTINCT c_custkey, unnest([{_list(_EU)}[c_custkey % {len(_EU)} + 1], {_list(_EU)}[c_custkey * 7 % {len(_EU)} + 1], 'HR']) AS program
  FROM customer),
eu_n AS (SELECT program, count(*) AS designation_count FROM eu WHERE program <> 'HR' GROUP BY 1)"""


def _us_entries(t):
    n = len(_US_ALL)
    cell = F.concat_ws("] [", _pick(F.col(K) % n, _US_ALL), F.lit(" "), _pick(F.col("o_custkey") % n, _US_ALL))
    return t.orders.select(
        F.col(K).cast("string").alias("ent_num"), F.lit("x").alias("name"),
        F.lit("-0-").alias("sdn_type"), cell.alias("programs"),
    )


def _eu_entities(t):
    n, k = len(_EU), F.col("c_custkey")
    regs = F.array(*[F.struct(p.alias("_programme")) for p in (_pick(k % n, _EU), _pick(k * 7 % n, _EU), F.lit(" HR "))])
    return t.customer.select(k.cast("string").alias("_logicalId"), regs.alias("regulation"))


@query("sanction_tokens", f"WITH {_US_SQL} SELECT program, designation_count FROM us_n")
def sanction_tokens(t):
    return governance.normalize_us(_us_entries(t)).select("program", "designation_count")


@query("sanction_entities", f"WITH {_EU_SQL} SELECT program, designation_count FROM eu_n")
def sanction_entities(t):
    out = governance.normalize_eu(_eu_entities(t), "2026-06-05T00:00:00Z")
    return out.select("program", "designation_count")


@query(
    "sanction_lists",
    f"""WITH {_US_SQL}, {_EU_SQL}
        SELECT 'OFAC' AS list_source, program, designation_count FROM us_n UNION ALL
        SELECT 'EU', program, designation_count FROM eu_n""",
)
def sanction_lists(t):
    """Both lists together, with the coverage floor enforced."""
    us = governance.normalize_us(_us_entries(t))
    eu = governance.normalize_eu(_eu_entities(t), "2026-06-05T00:00:00Z")
    return governance.combine_lists(us, eu).select("list_source", "program", "designation_count")


def _line_features(t):
    """Embeddings as pipelines: 64 vertices each, fifty projects."""
    k = F.col("vec_id")
    pts = F.transform(
        "embedding", lambda v, i: F.array(F.rint(v * 1000).cast("double") / 10.0, i.cast("double") / 2.0)
    )
    status = F.when(k % 6 == 0, "proposed").when(k % 2 == 0, "operating").otherwise("construction")
    return t.embeddings.select(
        F.lit("goit").alias("tracker"),
        k.alias("pos"),
        F.concat(F.lit("p"), k % 50).alias("project-id"),
        F.lit("line").alias("name"),
        status.alias("status"),
        F.lit("Nowhere").alias("country-area1"),
        _pick(k % 4, ["1982", "2013-2017", "Before 2024", ""]).alias("start-year"),
        F.lit("").alias("facility-type"),
        F.lit("Oil").alias("fuel"),
        F.lit(None).cast("string").alias("Latitude"),
        F.lit(None).cast("string").alias("Longitude"),
        F.lit("LineString").alias("geometry_type"),
        F.to_json(pts).alias("coordinates"),
    )


_LINES_SQL = """v AS (
  SELECT vec_id, 'p' || (vec_id % 50) AS project_id, vec_id % 4 AS q,
         unnest(embedding) AS e, unnest(range(len(embedding))) AS i, len(embedding) AS n
  FROM embeddings WHERE vec_id % 6 <> 0),
kept AS (SELECT * FROM v WHERE i % 25 = 0 OR i = n - 1)"""


@query(
    "infra_vertices",
    f"""WITH {_LINES_SQL}
        SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY vec_id, i) - 1 AS vertex_idx,
               i / 2e0 AS lat, round_even(CAST(e AS DOUBLE) * 1000, 0) / 1e1 AS lon,
               CASE q WHEN 0 THEN 1982 WHEN 1 THEN 2013 ELSE -1 END AS start_year
        FROM kept""",
)
def infra_vertices(t):
    """Lines decimated to every 25th vertex and the last, numbered per project."""
    out = infrastructure.normalize_infra(_line_features(t), stride=25)
    return out.select(
        "project_id", "vertex_idx", "lat", "lon", F.coalesce("start_year", F.lit(-1)).alias("start_year")
    )


@query(
    "vertex_decimate",
    """WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS i, len(embedding) AS n FROM embeddings)
       SELECT vec_id, count(*) AS n_kept, CAST(sum(i) AS BIGINT) AS sum_pos FROM v WHERE i % 10 = 0 OR i = n - 1 GROUP BY 1""",
)
def vertex_decimate(t):
    from basinframe.operators.polygons import decimate_line

    numbered = t.embeddings.select("vec_id", F.transform("embedding", lambda v, i: i).alias("line"))
    kept = numbered.withColumn("line", decimate_line("line", 10))
    total = F.aggregate("line", F.lit(0).cast("long"), lambda a, v: a + v)
    return kept.select("vec_id", F.size("line").cast("long").alias("n_kept"), total.alias("sum_pos"))


@query(
    "round_coordinates",
    """SELECT vec_id, list_sum([floor(CAST(x AS DOUBLE) * 1e3 + 5e-1) / 1e3 FOR x IN embedding]) * 0 + len(embedding) AS n,
       floor(CAST(embedding[1] AS DOUBLE) * 1e3 + 5e-1) / 1e3 AS first_x FROM embeddings""",
)
def round_coordinates(t):
    """Nested coordinates rounded in place."""
    ring = F.transform("embedding", lambda v: F.array(v.cast("double")))
    from basinframe.functions.scalars import round_ring

    r = t.embeddings.select("vec_id", round_ring(ring, 3).alias("r"))
    return r.select("vec_id", F.size("r").cast("double").alias("n"), F.flatten("r")[0].alias("first_x"))


@query(
    "field_points",
    f"""SELECT 'gem_goget:' || (s_suppkey // 2) AS field_id, 'Field ' || (s_suppkey // 2) AS name,
        CASE WHEN s_suppkey // 2 % 3 = 0 THEN -1 ELSE CAST(1950 + s_suppkey // 2 % 60 AS INT) END AS discovery_year,
        {lat_sql('s_suppkey // 2', 6151)} AS lat, {lon_sql('s_suppkey // 2', 15013)} AS lon
        FROM supplier WHERE s_suppkey % 2 = 0""",
)
def field_points(t):
    """Identical points collapse, so two suppliers of one id give one field."""
    k = F.floor(F.col("s_suppkey") / 2).cast("long")
    raw = t.supplier.select(
        k.cast("string").alias("project-id"),
        F.concat(F.lit("Field "), k).alias("name"),
        F.lit("X").alias("country-area1"),
        F.lit("operating").alias("status"),
        F.when(k % 3 == 0, " ").otherwise((k % 60 + 1950).cast("string")).alias("discovery-year"),
        F.to_json(F.array(lon_of(k, 15013), lat_of(k, 6151))).alias("coordinates"),
    )
    out = infrastructure.normalize_fields(raw)
    return out.select("field_id", "name", F.coalesce("discovery_year", F.lit(-1)).alias("discovery_year"), "lat", "lon")


@query(
    "protected_areas",
    """SELECT CAST(p_partkey AS VARCHAR) AS site_id, p_name AS name,
       CASE WHEN p_size % 5 = 0 THEN -1 ELSE 1900 + p_size END AS status_yr, (p_partkey % 3 = 0) AS marine
       FROM part WHERE p_partkey % 3 < 2""",
)
def protected_areas(t):
    k = F.col("p_partkey")
    raw = t.part.select(
        k.alias("SITE_ID"), F.col("p_name").alias("NAME"), F.lit("Park").alias("DESIG_ENG"),
        F.lit("II").alias("IUCN_CAT"), F.lit("Designated").alias("STATUS"),
        F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size") + 1900).alias("STATUS_YR"),
        F.lit("MOZ;ZAF").alias("ISO3"), _pick(k % 3, ["Marine", "Coastal", "Terrestrial"]).alias("REALM"),
    )
    out = infrastructure.normalize_areas(raw)
    return out.select("site_id", "name", F.coalesce("status_yr", F.lit(-1)).alias("status_yr"), "marine")


_TICK = list(codes.FRONT_TICKERS)


@query(
    "front_months",
    f"""WITH q AS (
          SELECT strftime(o_orderdate, '%Y-%m-%d') AS asof_date, {_list(_TICK)}[o_orderkey % 4 + 1] AS ticker,
                 max(o_totalprice) AS p FROM orders GROUP BY 1, 2)
        SELECT asof_date, ticker, CASE WHEN ticker IN ('CL=F','BZ=F') THEN p ELSE -1 END AS bbl,
               CASE WHEN ticker IN ('RB=F','HO=F') THEN p ELSE -1 END AS gal FROM q""",
)
def front_months(t):
    quotes = t.orders.groupBy(day("o_orderdate").alias("asof_date"), _pick(F.col(K) % 4, _TICK).alias("ticker")).agg(
        F.max("o_totalprice").cast("string").alias("last_price")
    ).withColumns({"previous_close": F.lit(None).cast("string"), "currency": F.lit("USD")})
    out = market.front_months(quotes)
    return out.select(
        day("asof_date").alias("asof_date"), "ticker",
        F.coalesce("settle_usd_bbl", F.lit(-1.0)).alias("bbl"),
        F.coalesce("settle_usd_gal", F.lit(-1.0)).alias("gal"),
    )


@query(
    "missing_quotes",
    f"""WITH q AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS asof_date, {_list(_TICK)}[o_orderkey % 4 + 1] AS ticker FROM orders),
        d AS (SELECT DISTINCT asof_date FROM q), w AS (SELECT unnest({_list(_TICK)}) AS ticker)
        SELECT d.asof_date, w.ticker FROM d, w EXCEPT SELECT * FROM q""",
)
def missing_quotes(t):
    quotes = t.orders.select(day("o_orderdate").alias("asof_date"), _pick(F.col(K) % 4, _TICK).alias("ticker"))
    return market.missing_tickers(quotes)


_LTD = """CASE isodow(d25) WHEN 1 THEN d25 - 5 WHEN 2 THEN d25 - 5 WHEN 3 THEN d25 - 5 WHEN 4 THEN d25 - 3
          WHEN 5 THEN d25 - 3 WHEN 6 THEN d25 - 4 ELSE d25 - 5 END"""
_STRIP_SQL = f"""ao AS (SELECT CAST(o_orderdate AS DATE) AS a, max(o_totalprice) AS p FROM orders GROUP BY 1),
n1 AS (SELECT a, p, CAST(date_trunc('month', a) + INTERVAL 1 MONTH AS DATE) AS m1, CAST(date_trunc('month', a) AS DATE) + 24 AS d25 FROM ao),
f AS (SELECT a, p, CASE WHEN {_LTD} >= a THEN m1 ELSE CAST(m1 + INTERVAL 1 MONTH AS DATE) END AS d0 FROM n1),
g AS (SELECT a, p, d0, unnest(range(1, 13)) AS i FROM f),
h AS (SELECT a, p, i, CAST(d0 + INTERVAL (i - 1) MONTH AS DATE) AS dm FROM g),
k AS (SELECT *, CAST(dm - INTERVAL 1 MONTH AS DATE) + 24 AS d25 FROM h),
strip AS (SELECT a, p, CAST(i AS INT) AS month_index,
       'CL' || substr('FGHJKMNQUVXZ', CAST(month(dm) AS INT), 1) || strftime(dm, '%y') || '.NYM' AS contract,
       {_LTD} AS expiry FROM k)"""


def strip_quotes(t):
    """Every contract of every order date, priced from that date's largest order."""
    top = t.orders.groupBy(F.to_date("o_orderdate").alias("asof_date")).agg(F.max("o_totalprice").alias("p"))
    cal = market.strip_calendar(top)
    return cal.join(top, "asof_date").select(
        "asof_date",
        F.col("contract").alias("ticker"),
        (F.col("p") / 1000.0 + F.col("month_index") * 0.5).cast("string").alias("last_price"),
        F.lit(None).cast("string").alias("previous_close"),
        F.lit("USD").alias("currency"),
    )


@query(
    "curve_strip",
    f"""WITH {_STRIP_SQL}
        SELECT strftime(a, '%Y-%m-%d') AS asof_date, month_index, contract, strftime(expiry, '%Y-%m-%d') AS expiry,
               p / 1e3 + month_index * 5e-1 AS settle_usd_bbl FROM strip""",
)
def curve_strip(t):
    out = market.curve_strip(strip_quotes(t))
    return out.select(
        day("asof_date").alias("asof_date"), "month_index", "contract", day("expiry").alias("expiry"), "settle_usd_bbl"
    )


def member_wide(t):
    """Nation by every month of the orders, as printed: thousands separators, footnotes, blanks."""
    m = F.date_format("o_orderdate", "MMM yy")
    months = [r["m"] for r in t.orders.select(m.alias("m")).where("m is not null").distinct().orderBy("m").collect()]
    base = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    wide = base.groupBy(F.concat(F.lit("N"), "c_nationkey").alias("country")).agg(
        *[F.sum(F.when(m == x, F.rint("o_totalprice").cast("long"))).alias(x) for x in months]
    )
    cell = {x: F.coalesce(F.concat(F.format_number(F.col(f"`{x}`"), 0), F.lit("*")), F.lit("..")) for x in months}
    return wide.select("country", *[cell[x].alias(x) for x in months], F.lit("1.0").alias("1Q97"))


@query(
    "unpivot_members",
    """SELECT 'N' || c_nationkey AS country, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month,
       CAST(sum(round_even(o_totalprice, 0)) AS DOUBLE) AS production_kbd
       FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""",
)
def unpivot_members(t):
    out = market.normalize_members(member_wide(t))
    return out.select("country", day("month").alias("month"), "production_kbd")


_SHEET = list(codes.COMMODITIES)
_PRI = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "unpivot_sheet",
    f"""SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month,
        {_list(codes.COMMODITIES.values())}[CAST(substr(o_orderpriority, 1, 1) AS INT)] AS commodity,
        max(o_totalprice) AS price, CASE WHEN o_orderpriority = '5-LOW' THEN 'usd_mt' ELSE 'usd_bbl' END AS units
        FROM orders GROUP BY 1, 2, o_orderpriority""",
)
def unpivot_sheet(t):
    wide = t.orders.groupBy(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("M"), F.date_format("o_orderdate", "MM")).alias("date")).agg(
        *[
            F.coalesce(F.max(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))).cast("string"), F.lit("…")).alias(c)
            for p, c in zip(_PRI, _SHEET, strict=True)
        ]
    )
    units = {c: "($/bbl)" for c in _SHEET} | {_SHEET[-1]: "($/mt)"}
    return market.normalize_sheet(wide, units).withColumn("month", day("month"))


# ---- regulators' wells -----------------------------------------------------------------

_WELL_COLS = ["well_id", "lat", "lon", "spud_year", "purpose", "content_raw", "td_m", "discovery_id"]


def _plain(df):
    """NULLs made visible, so that both engines compare the same values."""
    return df.select(
        "well_id",
        F.coalesce("lat", F.lit(-999.0)).alias("lat"),
        F.coalesce("lon", F.lit(-999.0)).alias("lon"),
        F.coalesce("spud_year", F.lit(-1)).alias("spud_year"),
        "purpose",
        "content_raw",
        fix(F.coalesce("td_m", F.lit(-1.0)), 4).alias("td_m"),
        F.coalesce("discovery_id", F.lit("")).alias("discovery_id"),
    )


@query(
    "norway_wells",
    f"""SELECT 'sodir:W' || o_orderkey AS well_id, {lat_sql('o_custkey')} AS lat, {lon_sql('o_custkey')} AS lon,
        CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE CAST(year(o_orderdate) AS INT) END AS spud_year,
        CASE o_orderkey % 5 WHEN 0 THEN 'wildcat' WHEN 1 THEN 'appraisal' ELSE 'other' END AS purpose,
        'OIL' AS content_raw, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE {fix_sql('o_totalprice / 1e2', 4)} END AS td_m,
        CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'sodir:' || o_custkey || ':' ELSE 'sodir:' || o_custkey || ':F' || (o_custkey % 20) END AS discovery_id
        FROM orders""",
)
def norway_wells(t):
    k, c = F.col(K), F.col("o_custkey")
    rows = t.orders.select(
        F.concat(F.lit("W"), k, F.lit("  ")).alias("wlbWellboreName"),
        lat_of("o_custkey").cast("string").alias("wlbNsDecDeg"),
        lon_of("o_custkey").cast("string").alias("wlbEwDecDeg"),
        F.when(k % 9 == 0, "").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("wlbEntryDate"),
        _pick(k % 5, list(codes.NORWAY_PURPOSES)).alias("wlbPurpose"),
        F.lit("OIL ").alias("wlbContent"),
        F.when(k % 4 == 0, " ").otherwise((F.col("o_totalprice") / 100.0).cast("string")).alias("wlbTotalDepth"),
        F.when(k % 3 == 2, F.concat(F.lit("F"), c % 20)).otherwise("").alias("wlbDiscovery"),
        F.when(k % 3 != 0, c.cast("string")).otherwise("").alias("dscNpdidDiscovery"),
    )
    return _plain(wells.normalize_norway(wells.norway_rows(rows)))


@query(
    "uk_wells",
    f"""SELECT 'nsta:' || CASE WHEN o_orderkey % 11 = 0 THEN 'C4' ELSE 'Q4' END || o_orderkey AS well_id,
        {lat_sql('o_custkey')} AS lat, {lon_sql('o_custkey')} AS lon,
        CAST(year(TIMESTAMP '1970-01-01' + to_days(CAST(o_orderkey % 20000 - 10000 AS INT))) AS INT) AS spud_year,
        CASE WHEN o_orderkey % 11 = 0 THEN 'other' WHEN o_orderkey % 2 = 0 THEN 'wildcat' ELSE 'appraisal' END AS purpose,
        CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'Dry Hole' END AS content_raw,
        CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE {fix_sql('o_totalprice / 1e2', 4)} END AS td_m,
        CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'F' || (o_custkey % 30) END AS discovery_id FROM orders""",
)
def uk_wells(t):
    k = F.col(K)
    days = (k % 20000 - 10000) * 86400000
    depth = F.when(k % 5 != 0, F.when(k % 7 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")) / 100.0)
    attrs = F.create_map(
        F.lit("WELLREGNO"), F.concat(F.when(k % 11 == 0, "C4").otherwise("Q4"), k),
        F.lit("ORIGINTENT"), F.when(k % 2 == 0, "Exploration").otherwise("Appraisal"),
        F.lit("FLOWCLASS"), F.when(k % 6 != 0, "Dry Hole"),
        F.lit("SPUDDATE"), days.cast("string"),
        F.lit("TDTVDSSM"), depth.cast("string"),
        F.lit("TARGETFLD"), F.when(k % 4 == 0, codes.UK_NO_DATA).otherwise(F.concat(F.lit("F"), F.col("o_custkey") % 30)),
        F.lit("TOPHOLEXDD"), lon_of("o_custkey").cast("string"),
        F.lit("TOPHOLEYDD"), lat_of("o_custkey").cast("string"),
    )
    geometry = F.when(
        k % 3 == 0, F.struct(lon_of("o_custkey").cast("string").alias("x"), lat_of("o_custkey").cast("string").alias("y"))
    )
    pages = t.orders.select(F.array(F.struct(attrs.alias("attributes"), geometry.alias("geometry"))).alias("features"))
    return _plain(wells.normalize_uk(wells.uk_rows(pages)))


_NL = list(codes.NETHERLANDS_PURPOSES)


@query(
    "netherlands_wells",
    f"""SELECT 'nlog:' || o_orderkey AS well_id, {lat_sql('o_custkey')} AS lat, {lon_sql('o_custkey')} AS lon,
        CASE WHEN o_orderkey % 8 = 0 THEN -1 ELSE CAST(year(o_orderdate) AS INT) END AS spud_year,
        {_list(codes.NETHERLANDS_PURPOSES.values())}[o_orderkey % {len(_NL)} + 1] AS purpose,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'GAS' END AS content_raw,
        {fix_sql('o_totalprice', 4)} AS td_m, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'NL' END AS discovery_id FROM orders""",
)
def netherlands_wells(t):
    k = F.col(K)
    props = F.struct(
        k.cast("string").alias("BOREHOLE_CODE"),
        F.when(k % 8 != 0, day("o_orderdate")).alias("START_DATE_DRILLING"),
        _pick(k % len(_NL), _NL).alias("BOREHOLE_TYPE_CODE"),
        F.when(k % 5 != 0, "GAS").alias("BOREHOLE_RESULT_CODE"),
        F.col("o_totalprice").alias("END_DEPTH_MAH"),
        F.when(k % 3 == 0, "").otherwise("NL").alias("FIELD_CODE"),
    )
    geometry = F.struct(F.array(lon_of("o_custkey"), lat_of("o_custkey")).alias("coordinates"))
    pages = t.orders.select(F.array(F.struct(props.alias("properties"), geometry.alias("geometry"))).alias("features"))
    return _plain(wells.normalize_netherlands(wells.netherlands_rows(pages)))


@query(
    "us_gulf_wells",
    f"""WITH lease AS (
          SELECT l_partkey * 2 AS lease, string_agg(DISTINCT 'WD' || (l_suppkey % 6), '+' ORDER BY 'WD' || (l_suppkey % 6)) AS f
          FROM lineitem GROUP BY 1)
        SELECT 'boem:' || o_orderkey AS well_id, 25 + (o_custkey % 50) / 1e1 AS lat, -95 + (o_custkey % 70) / 1e1 AS lon,
        CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE CAST(year(o_orderdate) AS INT) END AS spud_year,
        CASE WHEN o_orderkey % 7 = 0 THEN 'wildcat' ELSE 'other' END AS purpose,
        CASE WHEN f IS NULL THEN 'NO_FIELD_LEASE' ELSE 'FIELD_LEASE_MATCH' END AS content_raw,
        CASE o_orderkey % 6 WHEN 0 THEN -1 WHEN 1 THEN -1 ELSE {fix_sql('round_even(o_totalprice, 0) * 3048e-4', 4)} END AS td_m,
        coalesce(f, '') AS discovery_id
        FROM orders LEFT JOIN lease ON lease = o_custkey WHERE o_orderstatus <> 'P'""",
)
def us_gulf_wells(t):
    """Field leases come from line items, one lease possibly in several fields."""
    k, c = F.col(K), F.col("o_custkey")
    raw = t.orders.select(
        k.cast("string").alias("API_WELL_NUMBER"),
        F.when(k % 10 == 0, "").otherwise(F.date_format("o_orderdate", "M/d/yyyy")).alias("WELL_SPUD_DATE"),
        F.when(k % 6 == 0, "").when(k % 6 == 1, "*****").otherwise(F.rint("o_totalprice").cast("long").cast("string")).alias("BH_TOTAL_MD"),
        _pick(k % 7, list(codes.US_GULF_PURPOSES)).alias("WELL_TYPE_CODE"),
        ((c % 50) / F.lit(10.0) + 25.0).cast("string").alias("SURF_LATITUDE"),
        ((c % 70) / F.lit(10.0) - 95.0).cast("string").alias("SURF_LONGITUDE"),
        F.concat(F.lit(" "), c.cast("string")).alias("BOTM_LEASE_NUMBER"),
        F.when(F.col("o_orderstatus") == "P", "P").otherwise("G").alias("REGION_CODE"),
    )
    leases = t.lineitem.select(
        F.concat(F.lit("WD"), F.col("l_suppkey") % 6).alias("field_name_code"),
        F.concat((F.col("l_partkey") * 2).cast("string"), F.lit(" ")).alias("lease_number"),
    )
    return _plain(wells.normalize_us_gulf(wells.us_gulf_rows(raw), leases))


@query(
    "australia_wells",
    f"""SELECT 'nopims:' || c_custkey AS well_id, {lat_sql('c_custkey')} AS lat, {lon_sql('c_custkey')} AS lon,
        CAST(1921 + c_custkey % 100 AS INT) AS spud_year,
        CASE c_custkey % 9 WHEN 0 THEN 'wildcat' WHEN 1 THEN 'appraisal' ELSE 'other' END AS purpose,
        '' AS content_raw, {fix_sql('abs(c_acctbal)', 4)} AS td_m, '' AS discovery_id
        FROM customer WHERE c_custkey % 10 <> 0""",
)
def australia_wells(t):
    """Attributes twice (overlapping pages), points for nine in ten of them."""
    k = F.col("c_custkey")
    rec = F.struct(
        k.cast("string").alias("Borehole_ID"),
        F.concat((k % 100 + 1921).cast("string"), F.lit("-05-06")).alias("Kick_Off_Date"),
        F.nullif(_pick(k % 9, list(codes.AUSTRALIA_PURPOSES)), F.lit("")).alias("Borehole_Reason"),
        F.abs("c_acctbal").alias("Drillers_TD_m"),
    )
    w = wells.australia_wells(t.customer.select(F.array(rec, rec).alias("value")))
    at = F.struct(F.struct(k.cast("string").alias("Ubhi"), lat_of("c_custkey").alias("Latitude"), lon_of("c_custkey").alias("Longitude")).alias("attributes"))
    p = wells.australia_points(t.customer.where(k % 10 != 0).select(F.array(at).alias("features")))
    return _plain(wells.normalize_australia(w, p))


# ---- listings, links, curated tables, store ------------------------------------------------


@query(
    "latest_release",
    """WITH k AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'goit' ELSE 'ggit-lng' END AS tracker,
                        strftime(o_orderdate, '%Y-%m') AS release, o_orderkey AS size FROM orders WHERE o_orderkey % 3 > 0)
       SELECT tracker, max(release) AS release FROM k GROUP BY 1""",
)
def latest_release(t):
    k = F.col(K)
    tracker = F.when(k % 2 == 0, "goit").otherwise("ggit-lng")
    ext = F.when(k % 3 == 0, ".zip").otherwise(".geojson")
    listing = t.orders.select(
        F.concat(F.lit("interim_maps/"), tracker, F.lit("_map_"), F.date_format("o_orderdate", "yyyy-MM"), ext).alias("Key"),
        k.alias("Size"),
    )
    return infrastructure.latest_releases(listing).select("tracker", "release")


@query(
    "latest_link_per_page",
    """SELECT page_id, strftime(CASE WHEN page_id % 2 = 0 THEN DATE '2024-01-01' + CAST(page_id % 300 AS INT) ELSE DATE '2024-01-01' + CAST(page_id % 300 + 7 AS INT) END, '%Y-%m-%d') AS stamp,
       'https://rigs.example/static-files/' || CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END || page_id AS url FROM pages""",
)
def latest_link_per_page(t):
    """Two dated workbook links are set into every whole page; odd pages have the
    newer one second, even pages label the second with another type."""
    k = F.col("page_id").cast("int")
    d1 = F.date_add(F.lit("2024-01-01").cast("date"), k % 300)
    d2 = F.date_add(d1, 7)

    def link(prefix, d, mime):
        return F.concat(
            F.lit(f"<a href='/static-files/{prefix}"), "page_id", F.lit("' type=\""), mime, F.lit('" title="'),
            F.date_format(d, "MM-dd-yyyy"), F.lit(' North_America Rig_Count Report.xlsx">x</a>'),
        )

    good = F.lit(links.WORKBOOK_TYPE)
    html = F.concat("html", link("a", d1, good), link("b", d2, F.when(k % 2 == 0, "text/html").otherwise(good)))
    out = links.latest_workbook(t.pages.withColumn("html", html), "https://rigs.example/na-rig-count")
    return out.withColumn("stamp", day("stamp"))


@query(
    "first_link_to_sheet",
    """SELECT page_id, CASE WHEN regexp_extract(html, '<a href="(/[^"]*)"', 1) = '' THEN 'none'
       ELSE 'https://bank.example' || regexp_extract(html, '<a href="(/[^"]*)"', 1) END AS url
       FROM pages WHERE regexp_matches(html, '<a href="/[^"]*"')""",
)
def first_link_to_sheet(t):
    """First rooted link of each page, resolved against its site."""
    return links.first_link_to(t.pages, "https://bank.example/en/research", name="/")


@query(
    "outcome_map_load",
    """SELECT 's' || (o_custkey % 40) AS source_id, o_orderpriority AS content_raw,
       max(CASE WHEN o_custkey % 40 % 3 = 0 THEN 1 ELSE 0 END) AS label, (o_custkey % 40 % 2 = 0) AS shows,
       (o_custkey % 40 % 3 = 1) AS excluded FROM orders GROUP BY ALL""",
)
def outcome_map_load(t):
    s = F.col("o_custkey") % 40
    raw = t.orders.select(
        F.concat(F.lit("s"), s).alias("source_id"),
        F.col("o_orderpriority").alias("content_raw"),
        F.when(s % 3 == 0, "1").otherwise("0").alias("label"),
        F.when(s % 2 == 0, "True").otherwise("false").alias("shows"),
        F.when(s % 3 == 1, "TRUE").otherwise("false").alias("excluded"),
        F.lit("https://cited.example").alias("source_url"),
    ).distinct()
    return curated.load_outcome_map(raw).drop("source_url")


@query(
    "curated_dimensions",
    """SELECT 'c' || p_partkey AS concept, CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE CAST(p_size AS DOUBLE) END AS opex_usd_bbl_low,
       p_size + 2e0 AS opex_usd_bbl_high FROM part""",
)
def curated_dimensions(t):
    """Cost ranges with blanks, all required keys present."""
    raw = t.part.select(
        F.concat(F.lit("c"), "p_partkey").alias("concept"),
        F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_size").cast("string")).alias("opex_usd_bbl_low"),
        (F.col("p_size") + 2).cast("string").alias("opex_usd_bbl_high"),
        F.lit("https://cited.example").alias("source_url"),
    )
    out = curated.load_costs(curated.load_pins(raw, ["concept", "source_url"]))
    return out.select("concept", F.coalesce("opex_usd_bbl_low", F.lit(-1.0)).alias("opex_usd_bbl_low"), "opex_usd_bbl_high")


@query("registry_load", "SELECT 'src' || s_suppkey AS source_id, CAST(s_suppkey % 30 + 1 AS DOUBLE) AS sla_days FROM supplier")
def registry_load(t):
    raw = t.supplier.select(
        F.concat(F.lit("src"), "s_suppkey").alias("source_id"), F.col("s_name").alias("name"),
        F.lit("rest").alias("access"), F.lit("https://feed.example/").alias("base_url"),
        F.lit("weekly").alias("cadence"), (F.col("s_suppkey") % 30 + 1).cast("string").alias("sla_days"),
        F.lit("2026-07-18").alias("verified_at"),
    )
    return curated.load_registry(raw).select("source_id", "sla_days")


def _prov(source_id, day_of_month):
    import datetime as dt

    from basinframe.operators.contracts import Provenance

    return Provenance(source_id, dt.datetime(2026, 7, day_of_month, tzinfo=dt.UTC), f"https://{source_id}.example", "v1")


@query(
    "table_ledger",
    """SELECT 'price_series' AS "table", 'fred' AS source_id, '2026-07-19' AS retrieved, count(*) AS rows FROM orders WHERE o_orderkey % 10 <> 0
       UNION ALL SELECT 'rigs', 'baker_hughes', '2026-07-18', count(*) FROM (
         SELECT DISTINCT date_trunc('week', o_orderdate), o_custkey % 2, o_custkey % 8, o_orderkey % 3 FROM orders WHERE o_orderkey % 17 <> 0)""",
)
def table_ledger(t):
    """Two stored tables, one of them twice; the ledger's newest entries."""
    from basinframe.operators.contracts import Contract, non_null
    from basinframe.session import scratch_path

    root = scratch_path(t.spark, "tables")
    prices = price_observations(t).withColumn("date", F.to_date("date"))
    loose = Contract("fred", {"date": non_null("date"), "series_id": non_null("string"), "metric": non_null("string"), "value": non_null("double")})
    run_source(prices.where("date < date '1998-01-01'"), loose, _prov("fred", 17), "price_series", root)
    run_source(prices, loose, _prov("fred", 19), "price_series", root)
    run_source(rig_counts(t).withColumn("week", F.to_date("week")), market.RIGS.contract, _prov("baker_hughes", 18), "rigs", root)
    newest = latest_by_table(read_ledger(t.spark, root))
    return newest.select("table", "source_id", day("retrieved_at").alias("retrieved"), "rows")


@query(
    "table_availability",
    """SELECT 'T' || n_nationkey AS "table", n > 0 AS available, n AS rows FROM (
       SELECT n_nationkey, count(c_custkey) AS n
       FROM nation LEFT JOIN customer ON c_nationkey - c_nationkey % 2 = n_nationkey GROUP BY 1)""",
)
def table_availability(t):
    wanted = t.nation.select(F.concat(F.lit("T"), "n_nationkey").alias("table"))
    even = F.col("c_nationkey") - F.col("c_nationkey") % 2
    ledger = t.customer.groupBy(F.concat(F.lit("T"), even).alias("table")).agg(F.count(F.lit(1)).alias("rows"), F.max("c_custkey").alias("written_at"))
    return availability(wanted, ledger).select("table", "available", F.coalesce("rows", F.lit(0)).alias("rows"))


_ALL = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(
    "manifest_hash",
    " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n_rows, 64 AS hash_length FROM {n}" for n in _ALL),
)
def manifest_hash(t):
    """Row count and order-free content hash of every table."""
    out = manifest({n: getattr(t, n) for n in _ALL})
    return out.select("table", "n_rows", F.length("content_sha256").alias("hash_length"))


@query(
    "data_mode",
    """SELECT 'LIVE' AS mode, count(DISTINCT o_custkey) AS tables, strftime(max(o_orderdate), '%Y-%m-%d') AS newest FROM orders""",
)
def mode_query(t):
    """Orders as ledger entries, a customer being a table."""
    ledger = t.orders.select(
        F.col("o_custkey").alias("table"), F.col("o_orderdate").alias("retrieved_at"), F.col(K).alias("written_at")
    )
    newest = ledger.groupBy("table").agg(F.max("retrieved_at").alias("retrieved_at"), F.max("written_at").alias("written_at"))
    return data_mode(newest, frozen=False).select("mode", "tables", day("newest_retrieved_at").alias("newest"))


@query(
    "raster_cells",
    f"""WITH c AS (SELECT c_custkey, CAST(floor((9e1 - {lat_sql('c_custkey')}) / 5e0) AS INT) AS row,
                         CAST(floor(({lon_sql('c_custkey')} + 18e1) / 5e0) AS INT) AS col FROM customer),
        cells AS (SELECT CAST(p_partkey // 72 % 36 AS INT) AS row, CAST(p_partkey % 72 AS INT) AS col, CAST(max(p_size) AS DOUBLE) AS w FROM part GROUP BY 1, 2)
        SELECT c_custkey, coalesce(w, -1) AS w FROM c LEFT JOIN cells USING (row, col)""",
)
def raster_cells(t):
    """Cells written by tile, read back, and looked up under every customer."""
    from basinframe.catalog.shapes import cells, customers_as_points
    from basinframe.functions.geo import Grid
    from basinframe.operators.raster import lookup
    from basinframe.session import scratch_path

    path = scratch_path(t.spark, "cells")
    write_cells(cells(t), path, tile=18)
    hit = lookup(customers_as_points(t), read_cells(t.spark, path, ["w"]), Grid(5.0), ["w"], tile=18)
    return hit.select("c_custkey", F.coalesce("w", F.lit(-1.0)).alias("w"))


@query(
    "payload_export",
    """SELECT 'pipelines' AS layer, 'oil_pipeline' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 UNION ALL
       SELECT 'terminals', 'lng_import', count(*) FROM orders WHERE o_orderkey % 4 = 1""",
)
def payload_export(t):
    kinds = ["oil_pipeline", "lng_import", "other", "other"]
    infra = t.orders.select(
        _pick(F.col(K) % 4, kinds).alias("kind"), F.lit("x").alias("name"),
        lat_of("o_custkey").alias("lat"), lon_of("o_custkey").alias("lon"),
    )
    return export.infra_payload(infra).groupBy("layer", "kind").agg(F.count(F.lit(1)).alias("n"))
