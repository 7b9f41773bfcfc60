"""Well-outcome queries on orders read as wellbores."""

from __future__ import annotations

from pyspark.sql import functions as F

from basinframe.catalog.registry import fix, fix_sql, query
from basinframe.catalog.shapes import MAPPED_SQL, POINTS_SQL, WELLS_SQL, lat_sql, mapped_wells, outcome_rows
from basinframe.functions.scalars import (
    development_concept,
    outcome_code,
    phase_of_name,
    score_mask,
    threshold_score,
    water_depth,
    water_depth_class,
)
from basinframe.operators import wells as w
from basinframe.operators.raster import plausible_points
from basinframe.sources.export import drilled_by, fields_payload, wells_payload

_PRIMARY = f"WITH {MAPPED_SQL}, prim AS (SELECT * FROM mapped WHERE purpose = 'wildcat' AND NOT excluded)"


@query(
    "outcome_map_join",
    f"WITH {MAPPED_SQL} SELECT source_id, content_raw, label, shows, excluded, count(*) AS n FROM mapped GROUP BY ALL",
)
def outcome_map_join(t):
    mapped = w.map_outcomes(t.wells, outcome_rows(t))
    return mapped.groupBy("source_id", "content_raw", "label", "shows", "excluded").agg(F.count(F.lit(1)).alias("n"))


@query(
    "unmapped_outcomes",
    f"WITH {WELLS_SQL} SELECT source_id, content_raw, count(*) AS n_wells FROM wells WHERE content_raw IN ('', 'SHOWS') GROUP BY 1, 2",
)
def unmapped_outcomes(t):
    """Codes a shortened map does not know."""
    return w.unmapped_outcomes(t.wells, outcome_rows(t).where("content_raw NOT IN ('', 'SHOWS')"))


@query(
    "union_sources",
    f"WITH {WELLS_SQL} SELECT source_id, count(*) AS n FROM wells GROUP BY 1",
)
def union_sources(t):
    """Five source tables brought to one column list and put together."""
    from functools import reduce

    from basinframe.functions.codes import WELL_SOURCES

    cols = ["well_id", "source_id", "lat", "lon", "spud_year"]
    parts = [t.wells.where(F.col("source_id") == s).select(*cols) for s in WELL_SOURCES]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "decision_point_dedupe",
    f"WITH {POINTS_SQL} SELECT p.source_id, p.rep AS well_id, p.label, p.shows, p.excluded, p.spud_year, p.n_wellbores, m.purpose, m.content_raw FROM points p JOIN mapped m ON m.well_id = p.rep",
)
def decision_point_dedupe(t):
    """One row per source and rounded location, represented by its first wellbore."""
    one = w.decision_points(mapped_wells(t))
    return one.select(
        "source_id", "well_id", "label", "shows", "excluded", "spud_year", "n_wellbores", "purpose", "content_raw"
    )


@query(
    "wells_per_year",
    f"""{_PRIMARY}, pts AS (SELECT source_id, max(label) AS label, min(spud_year) AS spud_year
          FROM prim GROUP BY source_id, round_even(lat * 1000, 0), round_even(lon * 1000, 0))
        SELECT spud_year, count(*) AS wildcats, CAST(sum(label) AS BIGINT) AS discoveries, sum(label) / count(*) AS success_rate FROM pts GROUP BY 1""",
)
def wells_per_year(t):
    """Primary wellbores, one decision point per location, counted by year."""
    return w.wells_per_year(w.decision_points(w.primary_set(mapped_wells(t))))


@query(
    "decade_rates",
    f"{_PRIMARY} SELECT CAST(spud_year // 10 * 10 AS INT) AS decade, count(*) AS wildcats, {fix_sql('sum(label) / count(*)', 9)} AS success_rate FROM prim GROUP BY 1",
)
def decade_rates(t):
    return w.decade_rates(w.primary_set(mapped_wells(t))).withColumn("success_rate", fix("success_rate", 9))


@query(
    "rates_by_source",
    f"{_PRIMARY} SELECT source_id, count(*) AS n, {fix_sql('sum(label) / count(*)', 9)} AS success_rate FROM prim GROUP BY 1",
)
def rates_by_source(t):
    return w.rates_by_source(w.primary_set(mapped_wells(t))).withColumn("success_rate", fix("success_rate", 9))


@query(
    "variant_summary",
    f"""WITH {MAPPED_SQL}, tagged AS (
          SELECT 'primary' AS variant, * FROM mapped WHERE NOT excluded AND purpose = 'wildcat' UNION ALL
          SELECT 'with_appraisal', * FROM mapped WHERE NOT excluded AND purpose IN ('wildcat', 'appraisal') UNION ALL
          SELECT 'shows_excluded', * FROM mapped WHERE NOT excluded AND purpose = 'wildcat' AND NOT shows UNION ALL
          SELECT 'primary_ex_proxy', * FROM mapped WHERE NOT excluded AND purpose = 'wildcat' AND source_id <> 'boem_bsee'),
        s AS (SELECT variant, source_id, count(*) AS c FROM tagged GROUP BY 1, 2)
        SELECT variant, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, {fix_sql('sum(label) / count(*)', 4)} AS success_rate,
          (SELECT string_agg(s.source_id || '=' || s.c, ',' ORDER BY s.source_id) FROM s WHERE s.variant = tagged.variant) AS by_source
        FROM tagged GROUP BY variant""",
)
def variant_summary(t):
    out = w.variant_summary(mapped_wells(t))
    pairs = F.transform(F.map_entries("by_source"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.withColumns(
        {"by_source": F.array_join(F.array_sort(pairs), ","), "success_rate": fix(F.col("positives") / F.col("n"), 4)}
    )


@query(
    "sensitivity_sets",
    f"""WITH {MAPPED_SQL} SELECT 'primary' AS variant, count(*) AS n FROM mapped WHERE NOT excluded AND purpose = 'wildcat' UNION ALL
        SELECT 'with_appraisal', count(*) FROM mapped WHERE NOT excluded AND purpose IN ('wildcat', 'appraisal') UNION ALL
        SELECT 'shows_excluded', count(*) FROM mapped WHERE NOT excluded AND purpose = 'wildcat' AND NOT shows UNION ALL
        SELECT 'primary_ex_proxy', count(*) FROM mapped WHERE NOT excluded AND purpose = 'wildcat' AND source_id <> 'boem_bsee'""",
)
def sensitivity_sets(t):
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("variant"), "n")
        for name, df in w.variants(mapped_wells(t)).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "label_gate",
    f"{_PRIMARY} SELECT 5000 AS target, count(*) AS primary_actual, count(*) >= 5000 AS met FROM prim",
)
def label_gate(t):
    return w.label_gate(mapped_wells(t))


@query(
    "keep_placed_and_dated",
    f"""WITH {WELLS_SQL}, g AS (SELECT source_id, CAST(substr(well_id, 2) AS BIGINT) AS k FROM wells)
        SELECT source_id, count(*) AS n_raw, count(*) FILTER (k % 11 = 0) AS dropped_no_spud_year,
        count(*) FILTER (k % 11 <> 0 AND k % 13 = 0) AS dropped_no_coordinates, count(*) FILTER (k % 11 <> 0 AND k % 13 <> 0) AS n_kept
        FROM g GROUP BY 1""",
)
def keep_placed_and_dated(t):
    k = F.substring("well_id", 2, 30).cast("long")
    gappy = t.wells.withColumns(
        {"spud_year": F.when(k % 11 != 0, F.col("spud_year")), "lon": F.when(k % 13 != 0, F.col("lon"))}
    )
    return w.keep_placed_and_dated(gappy)[1]


@query(
    "province_names",
    f"""WITH {WELLS_SQL} SELECT CASE WHEN province_code % 3 = 0 THEN '(unassigned)' ELSE n_name END AS province_name, count(*) AS n
        FROM wells JOIN nation ON n_nationkey = province_code GROUP BY 1""",
)
def province_names(t):
    names = t.nation.where("n_nationkey % 3 <> 0").select(
        F.col("n_nationkey").alias("province_code"), F.concat(F.col("n_name"), F.lit(" ")).alias("province_name")
    )
    return w.name_provinces(t.wells.drop("province_name"), names).groupBy("province_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "creaming_curve",
    f"""{_PRIMARY}, y AS (SELECT province_name, spud_year, count(*) AS wc, sum(label) AS d FROM prim GROUP BY 1, 2)
        SELECT province_name, spud_year, CAST(sum(wc) OVER x AS BIGINT) AS cum_wildcats, CAST(sum(d) OVER x AS BIGINT) AS cum_discoveries
        FROM y WINDOW x AS (PARTITION BY province_name ORDER BY spud_year)""",
)
def creaming_curve(t):
    return w.creaming_curve(w.primary_set(mapped_wells(t)))


@query(
    "creaming_by_well",
    f"""{_PRIMARY} SELECT province_name, well_id, row_number() OVER x AS nth_well, CAST(sum(label) OVER x AS BIGINT) AS cum_discoveries
        FROM prim WINDOW x AS (PARTITION BY province_name ORDER BY spud_year, well_id ROWS UNBOUNDED PRECEDING)""",
)
def creaming_by_well(t):
    """A point per well, without a province ever sitting in one task."""
    return w.creaming_by_well(w.primary_set(mapped_wells(t)))


@query(
    "top_provinces",
    f"{_PRIMARY} SELECT province_name, count(*) AS n_wells FROM prim GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6",
)
def top_provinces(t):
    return w.top_provinces(w.primary_set(mapped_wells(t)))


@query(
    "basin_stats",
    f"""{_PRIMARY}, g AS (SELECT CASE WHEN province_code < 20 THEN province_code END AS province_code, min(province_name) AS province_name, count(*) AS n, CAST(sum(label) AS BIGINT) AS d,
          min(spud_year) AS a, max(spud_year) AS z FROM prim GROUP BY 1)
        SELECT s_suppkey, coalesce(g.province_name, '(no drilled wildcats)') AS province_name, coalesce(n, 0) AS n_wildcats,
          coalesce(floor(1e3 * d / n + 5e-1) / 1e3, -1) AS success_rate, coalesce(d, 0) AS n_discoveries, coalesce(a, -1) AS first_spud_year, coalesce(z, -1) AS last_spud_year
        FROM supplier LEFT JOIN g ON g.province_code = s_nationkey""",
)
def basin_stats(t):
    blocks = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("province_code"))
    wells = w.primary_set(mapped_wells(t)).withColumn("province_code", F.expr("if(province_code < 20, province_code, null)"))
    out = w.basin_stats(blocks, wells, "s_suppkey")
    return out.select(
        "s_suppkey", "province_name", "n_wildcats", "n_discoveries", F.coalesce("success_rate", F.lit(-1.0)).alias("success_rate"),
        F.coalesce("first_spud_year", F.lit(-1)).alias("first_spud_year"),
        F.coalesce("last_spud_year", F.lit(-1)).alias("last_spud_year"),
    )


@query(
    "extent",
    f"WITH {WELLS_SQL} SELECT min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat, min(spud_year) AS min_spud_year, max(spud_year) AS max_spud_year FROM wells",
)
def extent(t):
    return w.extent(t.wells)


@query(
    "outcome_display",
    f"""WITH {MAPPED_SQL} SELECT CASE WHEN excluded THEN -1 WHEN label = 1 AND content_raw LIKE '%OIL%' THEN 2
          WHEN label = 1 AND content_raw LIKE '%GAS%' THEN 1 WHEN label = 1 THEN 3 ELSE 0 END AS outcome, count(*) AS n FROM mapped GROUP BY 1""",
)
def outcome_display(t):
    code = outcome_code("label", "excluded", "content_raw")
    return mapped_wells(t).groupBy(code.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "map_payload",
    f"WITH {MAPPED_SQL} SELECT spud_year, count(*) AS n, {fix_sql('max(lat)', 4)} AS max_lat FROM mapped GROUP BY 1",
)
def map_payload(t):
    """The columns a map layer reads, rounded."""
    return wells_payload(mapped_wells(t)).groupBy("spud_year").agg(F.count(F.lit(1)).alias("n"), fix(F.max("lat"), 4).alias("max_lat"))


@query(
    "drilled_by_year",
    f"WITH {WELLS_SQL} SELECT source_id, count(*) AS n FROM wells WHERE spud_year <= 1998 GROUP BY 1",
)
def drilled_by_year(t):
    return drilled_by(t.wells, 1998).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "field_phase",
    """SELECT CASE WHEN upper(p_name) LIKE '%R%' AND upper(p_name) LIKE '%G%' THEN 'both' WHEN upper(p_name) LIKE '%G%' THEN 'gas'
       WHEN upper(p_name) LIKE '%R%' THEN 'oil' ELSE 'und' END AS phase, count(*) AS n FROM part GROUP BY 1""",
)
def field_phase(t):
    """Phase parsed from a name; letters of the part name stand in for the words."""
    name = F.concat(
        F.when(F.contains(F.upper("p_name"), F.lit("R")), "Oil ").otherwise(""),
        F.when(F.contains(F.upper("p_name"), F.lit("G")), "gas").otherwise(""),
    )
    fields = t.part.select(name.alias("name"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    return fields_payload(fields).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query(
    "phase_of_names",
    """SELECT p_partkey, ['oil', 'gas', 'both', 'und'][p_partkey % 4 + 1] AS phase FROM part""",
)
def phase_of_names(t):
    suffix = F.element_at(
        F.array(*[F.lit(x) for x in (" Oil Field", " gas", " OIL & GAS", "")]), (F.col("p_partkey") % 4 + 1).cast("int")
    )
    return t.part.select("p_partkey", phase_of_name(F.concat("p_name", suffix)).alias("phase"))


@query(
    "depth_class",
    """WITH e AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal - 9e2 END AS e FROM customer)
       SELECT CASE WHEN e >= 0 THEN 0 WHEN e >= -400 THEN 1 WHEN e < -400 THEN 2 ELSE -1 END AS depth_class, count(*) AS n FROM e GROUP BY 1""",
)
def depth_class(t):
    e = F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal") - 900.0)
    return t.customer.groupBy(F.coalesce(water_depth_class(e), F.lit(-1)).alias("depth_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "development_concept",
    """WITH b AS (SELECT greatest(0, -(p_retailprice - 94e1) * 2e1) AS d, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size * 2e0 END AS h FROM part)
       SELECT CASE WHEN h IS NULL THEN 'gap' WHEN d <= 0 THEN 'onshore' WHEN d <= 400 AND h <= 50 THEN 'shelf_tieback'
         WHEN d > 400 AND h <= 70 THEN 'deepwater_tieback' ELSE 'fpso_standalone' END AS concept, count(*) AS n FROM b GROUP BY 1""",
)
def concept(t):
    b = t.part.select(
        water_depth((F.col("p_retailprice") - 940.0) * 20.0).alias("d"),
        F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") * 2.0).alias("h"),
    )
    return b.groupBy(F.coalesce(development_concept("d", "h"), F.lit("gap")).alias("concept")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "score_mask",
    """SELECT CASE WHEN p_partkey % 3 > 0 AND p_partkey % 7 > 0 AND p_size * 2e1 > 500 THEN 1 ELSE 0 END AS mask, count(*) AS n FROM part GROUP BY 1""",
)
def mask(t):
    k = F.col("p_partkey")
    sediment = F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.col("p_size") * 20.0)
    return t.part.groupBy(score_mask(k % 3, sediment).alias("mask")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "sediment_baseline",
    "SELECT p_brand, CAST(sum(CASE WHEN p_partkey % 5 > 0 AND p_size * 2e1 > 500 THEN 1 ELSE 0 END) AS DOUBLE) AS score FROM part GROUP BY 1",
)
def sediment_baseline(t):
    x = F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") * 20.0)
    return t.part.groupBy("p_brand").agg(F.sum(threshold_score(x)).alias("score"))


@query(
    "plausible_points",
    f"""SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders
        WHERE o_orderkey % 6 > 0 AND o_totalprice / 8e2 > 0 AND o_totalprice / 8e2 <= 500 AND abs({lat_sql('o_custkey')}) <= 90""",
)
def plausible(t):
    from basinframe.catalog.shapes import lat_of, lon_of

    raw = t.orders.select(
        "o_custkey",
        F.when(F.col("o_orderkey") % 6 == 0, "n/a").otherwise((F.col("o_totalprice") / 800.0).cast("string")).alias("q"),
        lat_of("o_custkey").cast("string").alias("lat"),
        lon_of("o_custkey").cast("string").alias("lon"),
    )
    return plausible_points(raw, "q", "lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("total"))
