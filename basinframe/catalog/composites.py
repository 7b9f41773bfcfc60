"""Queries over whole plans: label build, report, panels, block screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from basinframe.catalog import feeds
from basinframe.catalog.registry import day, fix, fix_sql, query
from basinframe.catalog.shapes import (
    MAPPED_SQL,
    POINTS_SQL,
    blocks,
    customers_as_points,
    km_sql,
    lat_of,
    lon_of,
    mapped_wells,
    outcome_rows,
    suppliers_as_points,
)
from basinframe.catalog.space import _DIST, _SQUARES, diamonds
from basinframe.functions.geo import Grid, chord_of_km
from basinframe.operators.polygons import province_cells
from basinframe.operators.wells import primary_set
from basinframe.plans import panels
from basinframe.plans.blocks import memo_fields, screen_blocks
from basinframe.plans.dossier import block_dossier, block_memos, dossier_fields
from basinframe.plans.labels import build_labels
from basinframe.plans.report import build_report, reconciliation_inputs, summarize
from basinframe.sources.market import curve_strip


def _labels(t):
    k = F.col("s_suppkey")
    areas = t.supplier.select(k.alias("area_id"), k.alias("ord"), ((k + 1) * 10).alias("code"), F.lit("p").alias("type"))
    cells = province_cells(diamonds(t), areas, Grid(2.0))
    names = t.supplier.select(((k + 1) * 10).alias("province_code"), F.col("s_name").alias("province_name"))
    return build_labels(t.wells, outcome_rows(t), cells, names, Grid(2.0))


@query(
    "label_build",
    f"""WITH {POINTS_SQL}, m AS (SELECT p.*, w.purpose FROM points p JOIN mapped w ON w.well_id = p.rep)
        SELECT purpose, excluded, count(*) AS n, CAST(sum(n_wellbores) AS BIGINT) AS wellbores, CAST(sum(label) AS BIGINT) AS positives FROM m GROUP BY 1, 2""",
)
def label_build(t):
    """The whole label build with contracts on; its table counted."""
    return _labels(t).harmonised.groupBy("purpose", "excluded").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_wellbores").alias("wellbores"), F.sum("label").alias("positives")
    )


@query(
    "label_provinces",
    f"""WITH {POINTS_SQL}, {_SQUARES}, r AS (SELECT p.rep, 89e0 - 2e0 * floor((9e1 - w.lat) / 2e0) AS glat, -179e0 + 2e0 * floor((w.lon + 18e1) / 2e0) AS glon FROM points p JOIN mapped w ON w.well_id = p.rep),
        a AS (SELECT rep, max(area_id) AS area_id FROM r LEFT JOIN sq ON abs(glon - cx) + abs(glat - cy) < h GROUP BY 1)
        SELECT coalesce(s_name, '(unassigned)') AS province_name, count(*) AS n FROM a LEFT JOIN supplier ON s_suppkey = area_id GROUP BY 1""",
)
def label_provinces(t):
    """Wells per province after the raster lookup."""
    return _labels(t).harmonised.groupBy("province_name").agg(F.count(F.lit(1)).alias("n"))


def _weekly_stocks(t):
    from basinframe.catalog.markets import weekly

    name = F.when(F.col("metric") == "1-URGENT", "crude_stocks_excl_spr_kbbl").when(
        F.col("metric") == "2-HIGH", "gasoline_stocks_kbbl"
    ).when(F.col("metric") == "3-MEDIUM", "product_supplied_kbd").otherwise("other_kbbl")
    return weekly(t).withColumn("metric", name).where("metric <> 'other_kbbl'")


_CENTS = "CAST(sum(CAST(round_even(o_totalprice * 100, 0) AS BIGINT)) AS BIGINT)"
_STOCKS = f"""st AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'crude_stocks_excl_spr_kbbl' WHEN '2-HIGH' THEN 'gasoline_stocks_kbbl' ELSE 'product_supplied_kbd' END AS metric,
  CAST(date_trunc('week', o_orderdate) AS DATE) AS period, {_CENTS} / 1e2 AS value FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1, 2)"""


@query(
    "validation_report",
    f"""WITH n AS (SELECT user_id % 40 AS k, max(ts) AS r FROM events GROUP BY 1),
        fr AS (SELECT CASE WHEN r IS NOT NULL AND (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(r)) / 864e8 <= s_suppkey % 3 / 1e1 THEN 1 ELSE 0 END AS ok FROM supplier LEFT JOIN n ON n.k = s_suppkey),
        s AS (SELECT 'freshness' AS section, CAST(sum(ok) AS BIGINT) AS p, 0 AS w, CAST(sum(1 - ok) AS BIGINT) AS f FROM fr UNION ALL
              SELECT 'weekly_consistency', 52, 0, 0 UNION ALL SELECT 'curve_checks', 0, 0, 12)
        SELECT section, CAST(p AS BIGINT) AS n_pass, CAST(w AS BIGINT) AS n_warn, CAST(f AS BIGINT) AS n_fail, CASE WHEN f > 0 THEN 'fail' ELSE 'pass' END AS overall FROM s UNION ALL
        SELECT 'all', CAST(sum(p) AS BIGINT), 0, CAST(sum(f) AS BIGINT), 'fail' FROM s""",
)
def validation_report(t):
    """Three sections put together and rolled up; the strip is long expired."""
    registry = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("source_id"), (F.col("s_suppkey") % 3 / F.lit(10.0)).alias("sla_days"))
    ledger = t.events.select(F.concat(F.lit("s"), F.col("user_id") % 40).alias("source_id"), F.col("ts").alias("retrieved_at"))
    report = build_report(
        ledger, registry, F.lit("2024-01-30 00:00:00").cast("timestamp"),
        weekly=_weekly_stocks(t), strip=curve_strip(feeds.strip_quotes(t)),
    )
    return summarize(report)


@query(
    "recon_inputs",
    f"""WITH a AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders WHERE o_orderkey % 2 = 0),
        b AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS m FROM lineitem WHERE l_partkey % 2 = 0 AND l_suppkey % 4 < 3 AND l_linenumber % 2 = 1),
        k AS (SELECT m FROM a INTERSECT SELECT m FROM b ORDER BY m DESC LIMIT 24)
        SELECT 'a' AS side, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 AND strftime(o_orderdate, '%Y-%m') IN (SELECT m FROM k) UNION ALL
        SELECT 'b', count(*) FROM lineitem WHERE l_partkey % 2 = 0 AND l_suppkey % 4 < 3 AND l_linenumber % 2 = 1 AND strftime(l_shipdate, '%Y-%m') IN (SELECT m FROM k)""",
)
def recon_inputs(t):
    """Country codes mapped, one flow in one unit, the last common months."""
    production = t.orders.where("o_orderkey % 2 = 0").select(
        F.lit("SAU").alias("country_iso3"), F.to_date("o_orderdate").alias("period"), F.col("o_totalprice").alias("value")
    )
    flows = t.lineitem.select(
        F.element_at(F.array(F.lit("SA"), F.lit("RU"), F.lit("NO"), F.lit("ZZ")), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("ref_area"),
        F.to_date("l_shipdate").alias("period"), F.when(F.col("l_partkey") % 2 == 0, "INDPROD").otherwise("STOCKCH").alias("flow_breakdown"),
        F.when(F.col("l_linenumber") % 2 == 1, "KBD").otherwise("KL").alias("unit_measure"), F.col("l_quantity").alias("value"),
    )
    a, b = reconciliation_inputs(production, flows)
    n = F.count(F.lit(1)).alias("n")
    return a.agg(n).select(F.lit("a").alias("side"), "n").unionByName(b.agg(n).select(F.lit("b").alias("side"), "n"))


@query(
    "market_ticker",
    f"""WITH d AS (SELECT ['brent_usd_bbl','wti_usd_bbl','usd_broad_index','x'][o_orderkey % 4 + 1] AS metric, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS v FROM orders GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY date DESC) AS i FROM d),
        l AS (SELECT metric, max(date) AS date, max(v) FILTER (i = 1) AS a, max(v) FILTER (i = 2) AS b FROM r WHERE i <= 2 GROUP BY 1),
        bw AS (SELECT x.date, x.v - y.v AS s FROM d x JOIN d y ON x.date = y.date AND x.metric = 'brent_usd_bbl' AND y.metric = 'wti_usd_bbl'),
        rg AS (SELECT date_trunc('week', o_orderdate) AS wk, CAST(sum(o_orderkey % 9) AS BIGINT) AS n FROM orders WHERE o_orderkey % 17 <> 0 AND o_custkey % 2 = 0 GROUP BY 1),
        rl AS (SELECT *, n - lag(n) OVER (ORDER BY wk) AS dl FROM rg)
        SELECT CASE metric WHEN 'brent_usd_bbl' THEN 'BRENT' WHEN 'wti_usd_bbl' THEN 'WTI' ELSE 'USD BROAD' END AS label,
          CASE metric WHEN 'usd_broad_index' THEN {fix_sql('a', 1)} ELSE {fix_sql('a', 2)} END AS value, CASE metric WHEN 'usd_broad_index' THEN {fix_sql('a - b', 1)} ELSE {fix_sql('a - b', 2)} END AS delta, strftime(date, '%Y-%m-%d') AS asof FROM l WHERE metric <> 'x'
        UNION ALL SELECT 'B-W', {fix_sql('s', 2)}, 0, strftime(date, '%Y-%m-%d') FROM bw WHERE date = (SELECT max(date) FROM bw)
        UNION ALL SELECT 'US RIGS', n, dl, strftime(wk, '%Y-%m-%d') FROM rl WHERE wk = (SELECT max(wk) FROM rl)""",
)
def market_ticker(t):
    metric = F.element_at(F.array(*[F.lit(x) for x in ("brent_usd_bbl", "wti_usd_bbl", "usd_broad_index", "x")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    spot = t.orders.groupBy(metric.alias("metric"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("value"))
    out = panels.ticker(spot=spot, rigs=feeds.rig_counts(t))
    one = F.col("label") == "USD BROAD"
    return out.select(
        "label", F.when(one, fix("value", 1)).otherwise(fix("value", 2)).alias("value"),
        F.coalesce(F.when(one, fix("delta", 1)).otherwise(fix("delta", 2)), F.lit(0.0)).alias("delta"), "asof",
    )


@query(
    "inventory_panel",
    f"""WITH {_STOCKS}, a AS (SELECT metric, max(period) AS d FROM st WHERE metric LIKE '%stocks%' GROUP BY 1),
        bd AS (SELECT metric, CAST(weekofyear(period) AS INT) AS w, min(value) AS lo, max(value) AS hi FROM st JOIN a USING (metric) WHERE year(period) >= year(d) - 5 AND year(period) < year(d) GROUP BY 1, 2),
        rc AS (SELECT * FROM st WHERE metric LIKE '%stocks%' QUALIFY row_number() OVER (PARTITION BY metric ORDER BY period DESC) <= 56)
        SELECT rc.metric, strftime(period, '%Y-%m-%d') AS period, value, coalesce(lo, -1) AS band_min, coalesce(hi, -1) AS band_max FROM rc LEFT JOIN bd ON bd.metric = rc.metric AND w = weekofyear(period)""",
)
def inventory_panel(t):
    out = panels.inventories(_weekly_stocks(t))
    gap = F.lit(-1.0)
    return out.select("metric", day("period").alias("period"), "value", F.coalesce("band_min", gap).alias("band_min"), F.coalesce("band_max", gap).alias("band_max"))


@query(
    "days_of_cover",
    f"WITH {_STOCKS}, l AS (SELECT metric, arg_max(value, period) AS v FROM st GROUP BY 1) SELECT {fix_sql('max(v) FILTER (metric LIKE $$crude%$$) / max(v) FILTER (metric LIKE $$product%$$)', 1)} AS days_of_cover FROM l",
)
def days_of_cover(t):
    return panels.cover(_weekly_stocks(t)).withColumn("days_of_cover", fix("days_of_cover", 1))


@query(
    "member_panel",
    f"""WITH m AS (SELECT c_nationkey AS k, date_trunc('month', o_orderdate) AS month, CAST(sum(round_even(o_totalprice, 0)) AS DOUBLE) AS v
          FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
        p AS (SELECT k, 'N' || k AS country, v FROM m WHERE month = (SELECT max(month) FROM m))
        SELECT country, v AS production_kbd, CASE WHEN k % 2 = 0 THEN -1 ELSE {fix_sql('1e2 * v / (k * 1e5)', 1)} END AS pct_of_target FROM p""",
)
def member_panel(t):
    from basinframe.sources.market import normalize_members

    k = F.col("n_nationkey")
    targets = t.nation.select(F.concat(F.lit("N"), k, F.lit(" ")).alias("country"), F.when(k % 2 == 0, "").otherwise((k * 100000).cast("string")).alias("target_kbd"))
    out = panels.members(normalize_members(feeds.member_wide(t)), targets)
    return out.select("country", "production_kbd", F.coalesce(fix("pct_of_target", 1), F.lit(-1.0)).alias("pct_of_target"))


@query(
    "discovery_panel",
    f"""WITH {MAPPED_SQL}, prim AS (SELECT * FROM mapped WHERE purpose = 'wildcat' AND NOT excluded),
        top AS (SELECT province_name FROM prim GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6)
        SELECT province_name, spud_year, CAST(sum(count(*)) OVER x AS BIGINT) AS cum_wildcats, CAST(sum(sum(label)) OVER x AS BIGINT) AS cum_discoveries
        FROM prim SEMI JOIN top USING (province_name) GROUP BY 1, 2 WINDOW x AS (PARTITION BY province_name ORDER BY spud_year)""",
)
def discovery_panel(t):
    return panels.discovery(primary_set(mapped_wells(t)))[1]


@query(
    "event_panel",
    """WITH r AS (SELECT 'http://x/' || (user_id * 7 % 500) AS url, CASE WHEN event_id % 4 <> 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS seen, row_number() OVER (PARTITION BY user_id * 7 % 500 ORDER BY event_type, event_id) AS n FROM events WHERE event_id % 6 <> 0)
       SELECT url, coalesce(seen, '') AS seen FROM r WHERE n = 1 ORDER BY seen DESC NULLS LAST, url LIMIT 50""",
)
def event_panel(t):
    ev = feeds.event_dedupe_first(t).select(
        F.nullif(F.col("seen"), F.lit("")).cast("timestamp").alias("seen_at"), F.col("title"), "url", "domain"
    )
    out = panels.recent_events(ev)
    return out.select("url", F.coalesce(F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("seen"))


def _screened(t):
    k = F.col("stream")
    base = blocks(t).select(
        "block_id", lat_of("stream").alias("lat"), lon_of("stream").alias("lon"),
        F.concat(F.lit("N"), k % 25).alias("iso3"), F.concat(F.lit("NATION_"), k % 25).alias("country_name"),
        (k % 25).cast("int").alias("province_code"), ((k % 30 - 25) * 60.0).alias("elevation_m"),
        (k % 90).cast("double").alias("host_distance_km"), "pg", "p90", "p50", "p10", "well_cost_musd",
    )
    n = F.col("n_nationkey")
    none = F.lit(None).cast("double")
    regimes = t.nation.where("n_nationkey < 20").select(
        F.concat(F.lit("N"), n).alias("iso3"), (n % 4 * 0.05).alias("royalty_rate"), (n % 5 * 0.1 + 0.1).alias("cit_rate"),
        none.alias("mapped_royalty_rate"), none.alias("mapped_cit_rate"), none.alias("suggested_royalty_rate"), none.alias("suggested_cit_rate"),
    )
    names = F.array(*[F.lit(c) for c in ("onshore", "shelf_tieback", "deepwater_tieback", "fpso_standalone")])
    s = F.col("s_suppkey")
    blank = s != 1
    costs = t.supplier.where("s_suppkey < 4").select(
        F.element_at(names, (s + 1).cast("int")).alias("concept"),
        F.when(blank, 8.0).alias("capex_usd_boe_low"), F.when(blank, 18.0).alias("capex_usd_boe_high"),
        F.lit(6.0).alias("opex_usd_bbl_low"), F.lit(7.0).alias("opex_usd_bbl_high"),
        F.lit(60.0).alias("well_cost_musd_low"), F.lit(240.0).alias("well_cost_musd_high"),
        F.lit(2.5).alias("schedule_years_low"), F.lit(3.2).alias("schedule_years_high"),
        F.lit("u").alias("source_url"), F.lit("d").alias("retrieved_at"), F.lit("").alias("notes"),
    )
    programs = t.supplier.where("s_acctbal > 9000").select(
        F.concat(F.lit("N"), "s_nationkey").alias("iso3"), F.lit("nowhere").alias("country_name"), F.lit("PR").alias("program"), F.lit("L").alias("list_source")
    )
    strip = curve_strip(feeds.strip_quotes(t)).withColumn("settle_usd_bbl", F.col("settle_usd_bbl") * 0 + 82.49)
    return screen_blocks(base, wells=mapped_wells(t), regimes=regimes, costs=costs, strip=strip, programs=programs)


@query("block_screening")
def block_screening(t):
    """Every screen, the economics and the verdict for all blocks in one plan."""
    out = _screened(t)
    return out.select(
        "block_id", "verdict", "npv_musd", "emv_musd", "breakeven_usd_bbl", "p_emv_positive", "offset_wells",
        F.coalesce("cost_gap", F.lit("")).alias("cost_gap"), F.array_join("data_gaps", ",").alias("gaps"),
    )


@query("memo_fields")
def cited_fields(t):
    """The screened numbers as cited fields, ready for coverage and appendix."""
    return memo_fields(_screened(t)).groupBy("agent", "field").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == "data gap").alias("n_gaps")
    )


_DOSSIER_SQL = f"""{_DIST}, w AS (SELECT c_custkey, c_custkey % 5 = 0 AS excluded, c_custkey % 2 AS label, 'S' || c_custkey % 4 AS source_id,
    CAST(1950 + c_custkey % 70 AS INT) AS spud_year, c_nationkey AS province_code, c_custkey % 3 = 0 AS wildcat FROM customer),
  o AS (SELECT s_suppkey, count(*) FILTER (near) AS offset_wells, count(*) FILTER (near AND NOT excluded) AS offset_labelled,
      CAST(coalesce(sum(label) FILTER (near AND NOT excluded), 0) AS BIGINT) AS offset_discoveries,
      coalesce(string_agg(DISTINCT source_id, ',' ORDER BY source_id) FILTER (near), '') AS offset_sources
    FROM (SELECT *, chord <= {chord_of_km(1000.0)!r} AS near FROM d) JOIN w USING (c_custkey) GROUP BY 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY chord, c_custkey) AS rank FROM d),
  n AS (SELECT s_suppkey, string_agg(rank || ':' || c_custkey || ':' || CASE WHEN excluded THEN 'x' ELSE label || '' END || ':' || spud_year || ':' || CAST(floor({km_sql('chord')} * 10 + 5e-1) AS BIGINT), ';' ORDER BY rank) AS nearest
    FROM k JOIN w USING (c_custkey) WHERE rank <= 5 GROUP BY 1),
  cell AS (SELECT CAST(p_partkey // 72 % 36 AS INT) AS row, CAST(p_partkey % 72 AS INT) AS col, max(p_size) AS z FROM part GROUP BY 1, 2),
  b AS (SELECT s.s_suppkey, s_nationkey, cell.z AS z FROM supplier p JOIN s ON s.s_suppkey = p.s_suppkey
    LEFT JOIN cell ON row = CAST(floor((9e1 - lat) / 5e0) AS INT) AND col = CAST(floor((lon + 18e1) / 5e0) AS INT)),
  g AS (SELECT province_code, count(*) AS n, CAST(sum(label) AS BIGINT) AS f, min(spud_year) AS a, max(spud_year) AS z FROM w WHERE wildcat AND NOT excluded GROUP BY 1),
  gov AS (SELECT c_nationkey, CAST(year(o_orderdate) AS INT) AS year, max(o_totalprice) FILTER (o_orderstatus = 'F') / 1e5 AS f, max(o_totalprice) FILTER (o_orderstatus = 'O') / 1e5 AS o
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2 QUALIFY year = max(year) OVER (PARTITION BY c_nationkey)),
  fsi AS (SELECT c_nationkey, arg_max(c_acctbal, c_custkey) AS v FROM customer GROUP BY 1),
  fin AS (SELECT count(*) AS checked, count(*) FILTER (p_size % 3 = 0) AS restricting FROM part)"""


def _dossier(t):
    k = F.col("c_custkey")
    wells = customers_as_points(t).join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").select(
        k.alias("well_id"), F.concat(F.lit("S"), k % 4).alias("source_id"), "lat", "lon",
        F.when(k % 3 == 0, "wildcat").otherwise("appraisal").alias("purpose"), F.lit("oil").alias("outcome_raw"),
        (k % 2).cast("int").alias("label"), (k % 5 == 0).alias("excluded"), (k % 70 + 1950).cast("int").alias("spud_year"),
        F.col("c_nationkey").alias("province_code"), F.concat(F.lit("P"), "c_nationkey").alias("province_name"),
    )
    own = suppliers_as_points(t).join(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey").select(
        F.col("s_suppkey").alias("block_id"), "lat", "lon", F.concat(F.lit("n"), "s_nationkey").alias("iso3"), F.lit("nowhere").alias("country_name")
    )
    p = F.col("p_partkey")
    cell = t.part.groupBy((F.floor(p / 72) % 36).cast("int").alias("row"), (p % 72).cast("int").alias("col")).agg(F.max("p_size").alias("z"))
    cell = cell.select(
        "row", "col", (F.col("z") - 25.0).alias("score_mask"), (F.col("z") * -10.0).alias("elevation_m"), (F.col("z") % 30).alias("province_code")
    )
    nation = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    scores = nation.groupBy(
        F.concat(F.lit("N"), "c_nationkey").alias("iso3"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("indicator")
    ).agg((F.max("o_totalprice") / 100000.0).alias("value"))
    index = t.customer.select(F.concat(F.lit("N"), "c_nationkey").alias("iso3"), fix("c_acctbal", 1).alias("total"), k.alias("year"))
    listed = t.nation.where("n_nationkey % 4 = 0").select(
        F.concat(F.lit("N"), "n_nationkey").alias("iso3"), F.lit("-").alias("country_name"),
        F.concat(F.lit("PR"), "n_regionkey").alias("program"), F.lit("L").alias("list_source"),
    )
    policy = t.part.select(F.when(F.col("p_size") % 3 == 0, " Partial").otherwise("false").alias("upstream_oil_excluded"))
    return block_dossier(
        own, wells=wells, cells=cell, grid=Grid(5.0), governance=scores, indicators=["F", "O"], index=index,
        programs=listed, financing=policy, sources=["S3", "S1", "S0", "S2"], radius_km=1000.0,
    )


@query(
    "block_dossier",
    f"""{_DOSSIER_SQL} SELECT s_suppkey AS block_id, coalesce(b.z > 25, false) AS in_mask, coalesce(b.z * -1e1, 1) AS elevation_m, offset_wells, offset_labelled, offset_discoveries,
        coalesce(floor(1e3 * offset_discoveries / nullif(offset_labelled, 0) + 5e-1) / 1e3, -1) AS offset_rate, offset_sources, nearest,
        CASE WHEN n IS NULL THEN '(no drilled wildcats)' ELSE 'P' || province_code END AS province_name, coalesce(n, 0) AS basin_wildcats, coalesce(g.f, 0) AS basin_discoveries,
        coalesce(a, -1) AS first_spud_year, coalesce(g.z, -1) AS last_spud_year, year AS governance_year, coalesce({fix_sql('gov.f', 3)}, -1) AS f, coalesce({fix_sql('gov.o', 3)}, -1) AS o, {fix_sql('v', 1)} AS fsi_total,
        s_nationkey % 4 = 0 AS sanctioned, CASE WHEN s_nationkey % 4 = 0 THEN 'PR' || n_regionkey ELSE '' END AS programs, checked, restricting
        FROM b JOIN o USING (s_suppkey) JOIN n USING (s_suppkey) JOIN nation ON n_nationkey = s_nationkey LEFT JOIN g ON province_code = b.z % 30
        LEFT JOIN gov ON gov.c_nationkey = s_nationkey LEFT JOIN fsi ON fsi.c_nationkey = s_nationkey, fin""",
)
def dossier(t):
    """What every screen says about each block, nearest wells and cells included."""
    well = lambda n: F.concat_ws(
        ":", n["rank"], n["well_id"], F.coalesce(n["label"].cast("string"), F.lit("x")), n["spud_year"], F.round(n["distance_km"] * 10).cast("long")
    )
    filled = lambda c, none: F.coalesce(c, F.lit(none)).alias(c)
    return _dossier(t).select(
        "block_id", F.col("in_scoreable_mask").alias("in_mask"), filled("elevation_m", 1.0), "offset_wells", "offset_labelled", "offset_discoveries",
        F.coalesce("offset_success_rate", F.lit(-1.0)).alias("offset_rate"), F.array_join("offset_sources", ",").alias("offset_sources"),
        F.array_join(F.transform("nearest_wells", well), ";").alias("nearest"), "province_name", "basin_wildcats", "basin_discoveries",
        filled("first_spud_year", -1), filled("last_spud_year", -1), "governance_year",
        F.coalesce(fix("f", 3), F.lit(-1.0)).alias("f"), F.coalesce(fix("o", 3), F.lit(-1.0)).alias("o"), fix("fsi_total", 1).alias("fsi_total"),
        "sanctioned", F.coalesce(F.array_join("programs", ","), F.lit("")).alias("programs"),
        F.col("institutions_checked").alias("checked"), F.col("institutions_restricting").alias("restricting"),
    )


@query(
    "block_memos",
    f"""{_DOSSIER_SQL} SELECT s_suppkey AS block_id, CAST(4 AS BIGINT) AS n_fields, CAST(CASE WHEN year IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_gaps, 1e0 AS coverage,
        sha256('{{"geoscience.offset_discoveries":"' || offset_discoveries || '","geoscience.offset_wells":"' || offset_wells || '","political_risk.governance_year":"' || coalesce(year || '', 'data gap')
          || '","political_risk.sanctioned":"' || (CASE WHEN s_nationkey % 4 = 0 THEN 'true' ELSE 'false' END) || '"}}') AS quant_hash
        FROM b JOIN o USING (s_suppkey) LEFT JOIN gov ON gov.c_nationkey = s_nationkey""",
)
def memos(t):
    """Coverage, gate and hash of every block's memo in one plan."""
    picked = _dossier(t).select("block_id", "offset_wells", "offset_discoveries", "governance_year", "sanctioned")
    out = block_memos(dossier_fields(picked)).where("rejected IS NULL")
    return out.select("block_id", "n_fields", "n_gaps", "coverage", "quant_hash")
