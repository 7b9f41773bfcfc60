"""The supplied tables in the shapes the library works on, and the same in SQL.

Positions and codes are fixed arithmetic of the keys, so both sides agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.functions.codes import WELL_SOURCES
from basinframe.session import small_table

#: Priority of an order -> regulator the wellbore is reported by.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: Outcome codes of the wellbores with label, shows, excluded.
OUTCOMES = [
    ("OIL", 1, False, False),
    ("GAS", 1, False, False),
    ("OIL/GAS", 1, False, False),
    ("DRY", 0, False, False),
    ("SHOWS", 0, True, False),
    ("", 0, False, True),
]


def lat_of(key: Column | str, step: int = 7919) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return (k * step % 16000) / F.lit(100.0) - F.lit(80.0)


def lon_of(key: Column | str, step: int = 104729) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return (k * step % 36000) / F.lit(100.0) - F.lit(180.0)


def lat_sql(key: str, step: int = 7919) -> str:
    return f"(({key} * {step} % 16000) / 1e2 - 8e1)"


def lon_sql(key: str, step: int = 104729) -> str:
    return f"(({key} * {step} % 36000) / 1e2 - 18e1)"


def xyz_sql(alias: str) -> str:
    return (
        f"cos(radians({alias}.lat))*cos(radians({alias}.lon)) AS x, "
        f"cos(radians({alias}.lat))*sin(radians({alias}.lon)) AS y, sin(radians({alias}.lat)) AS z"
    )


def chord_sql(a: str, b: str) -> str:
    return f"sqrt(power({a}.x-{b}.x,2)+power({a}.y-{b}.y,2)+power({a}.z-{b}.z,2))"


def km_sql(chord: str) -> str:
    return f"(2*6371.0088e0*asin(least(greatest({chord}/2,0e0),1e0)))"


def _pick(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def wells(t) -> DataFrame:
    """Orders as wellbores; the customer is the surface location."""
    o = t.orders
    source = F.lit(None).cast("string")
    for p, s in zip(PRIORITIES, WELL_SOURCES, strict=True):
        source = F.when(F.col("o_orderpriority") == p, s).otherwise(source)
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("w"), k).alias("well_id"),
        source.alias("source_id"),
        (lat_of("o_custkey") + (k % 7) * F.lit(0.0002)).alias("lat"),
        (lon_of("o_custkey") + (k % 5) * F.lit(0.0002)).alias("lon"),
        F.year("o_orderdate").alias("spud_year"),
        F.when(k % 5 <= 2, "wildcat").when(k % 5 == 3, "appraisal").otherwise("other").alias("purpose"),
        _pick(k % 6, [c for c, *_ in OUTCOMES]).alias("content_raw"),
        (F.col("o_totalprice") / 100.0).alias("td_m"),
        F.when(k % 3 == 0, F.concat(F.lit("d"), k % 40)).alias("discovery_id"),
        (F.col("o_custkey") % 25).cast("int").alias("province_code"),
        F.concat(F.lit("P"), F.col("o_custkey") % 25).alias("province_name"),
    )


def outcome_rows(t) -> DataFrame:
    """Outcome map over the codes the wells carry, one row per source and code."""
    rows = [(s, c, la, sh, ex) for s in WELL_SOURCES for c, la, sh, ex in OUTCOMES]
    ddl = "source_id string, content_raw string, label int, shows boolean, excluded boolean"
    return small_table(t.spark, rows, ddl)


_SOURCE_CASE = "CASE o_orderpriority " + " ".join(
    f"WHEN '{p}' THEN '{s}'" for p, s in zip(PRIORITIES, WELL_SOURCES, strict=True)
) + " END"
_CODES = "[" + ",".join(f"'{c}'" for c, *_ in OUTCOMES) + "]"

WELLS_SQL = f"""wells AS (
  SELECT 'w' || o_orderkey AS well_id, {_SOURCE_CASE} AS source_id,
         {lat_sql('o_custkey')} + (o_orderkey % 7) * 2e-4 AS lat,
         {lon_sql('o_custkey')} + (o_orderkey % 5) * 2e-4 AS lon,
         CAST(year(o_orderdate) AS INT) AS spud_year,
         CASE WHEN o_orderkey % 5 <= 2 THEN 'wildcat' WHEN o_orderkey % 5 = 3 THEN 'appraisal' ELSE 'other' END AS purpose,
         {_CODES}[o_orderkey % 6 + 1] AS content_raw,
         o_totalprice / 1e2 AS td_m,
         CASE WHEN o_orderkey % 3 = 0 THEN 'd' || (o_orderkey % 40) END AS discovery_id,
         CAST(o_custkey % 25 AS INT) AS province_code, 'P' || (o_custkey % 25) AS province_name
  FROM orders)"""

MAPPED_SQL = f"""{WELLS_SQL},
codes(content_raw, label, shows, excluded) AS (VALUES {",".join(
    f"('{c}',{la},{str(sh).lower()},{str(ex).lower()})" for c, la, sh, ex in OUTCOMES)}),
mapped AS (SELECT w.*, c.label, c.shows, c.excluded FROM wells w JOIN codes c USING (content_raw))"""

POINTS_SQL = f"""{MAPPED_SQL},
points AS (
  SELECT source_id, arg_min(well_id, CAST(spud_year AS VARCHAR) || well_id) AS rep,
         max(label) AS label, bool_or(shows) AS shows, bool_and(excluded) AS excluded,
         min(spud_year) AS spud_year, count(*) AS n_wellbores
  FROM mapped
  GROUP BY source_id, round_even(lat * 1000, 0), round_even(lon * 1000, 0))"""


def mapped_wells(t) -> DataFrame:
    from basinframe.operators.wells import map_outcomes

    return map_outcomes(wells(t), outcome_rows(t), strict=False)


def customers_as_points(t) -> DataFrame:
    return t.customer.select("c_custkey", lat_of("c_custkey").alias("lat"), lon_of("c_custkey").alias("lon"))


def suppliers_as_points(t) -> DataFrame:
    return t.supplier.select(
        "s_suppkey", lat_of("s_suppkey", 6151).alias("lat"), lon_of("s_suppkey", 15013).alias("lon")
    )


GEO_SQL = f"""c0 AS (SELECT c_custkey, {lat_sql('c_custkey')} AS lat, {lon_sql('c_custkey')} AS lon FROM customer),
s0 AS (SELECT s_suppkey, {lat_sql('s_suppkey', 6151)} AS lat, {lon_sql('s_suppkey', 15013)} AS lon FROM supplier),
c AS (SELECT *, {xyz_sql('c0')} FROM c0), s AS (SELECT *, {xyz_sql('s0')} FROM s0)"""


# ---- a coarse cell grid from parts: 5 degrees, keys beyond the grid fold back -------------

GRID_DEG = 5.0
N_ROWS, N_COLS = 36, 72


def cells(t) -> DataFrame:
    """Parts averaged into cells; ``v`` is in exact hundredths."""
    k = F.col("p_partkey")
    g = t.part.groupBy(
        F.floor(k / N_COLS % N_ROWS).cast("int").alias("row"), (k % N_COLS).cast("int").alias("col")
    ).agg(
        F.max(F.rint(F.col("p_retailprice") * 10).cast("long") % 997).alias("v0"),
        F.max("p_size").alias("size"),
    )
    return g.select("row", "col", (F.col("v0") / F.lit(4.0)).alias("v"), F.col("size").cast("double").alias("w"))


CELLS_SQL = f"""cells AS (
  SELECT CAST(p_partkey // {N_COLS} % {N_ROWS} AS INT) AS row, CAST(p_partkey % {N_COLS} AS INT) AS col,
         max(CAST(round_even(p_retailprice * 10, 0) AS BIGINT) % 997) / 4e0 AS v, CAST(max(p_size) AS DOUBLE) AS w
  FROM part GROUP BY 1, 2)"""

# ---- blocks from parts --------------------------------------------------------------------


def blocks(t) -> DataFrame:
    """Parts as blocks with resource, price, fiscal and cost inputs."""
    k = F.col("p_partkey")
    p50 = F.col("p_size") * 6.0 + 10.0
    return t.part.select(
        F.concat(F.lit("b"), k).alias("block_id"),
        k.alias("stream"),
        p50.alias("resource_mmbbl"),
        (p50 / 2.0).alias("p90"),
        p50.alias("p50"),
        (p50 * 2.0).alias("p10"),
        ((k % 60) + 30.0).alias("price_usd_bbl"),
        ((k % 4) * 0.05).alias("royalty_rate"),
        ((k % 5) * 0.1 + 0.1).alias("cit_rate"),
        ((k % 7) + 6.0).alias("opex_usd_bbl"),
        ((k % 9) * 20.0 + 60.0).alias("well_cost_musd"),
        (p50 * 13.0).alias("dev_capex_musd"),
        ((k % 10) / F.lit(20.0) + 0.05).alias("pg"),
    )


BLOCKS_SQL = """blocks AS (
  SELECT 'b' || p_partkey AS block_id, p_partkey AS stream, p_size * 6e0 + 1e1 AS resource_mmbbl,
         (p_size * 6e0 + 1e1) / 2e0 AS p90, p_size * 6e0 + 1e1 AS p50, (p_size * 6e0 + 1e1) * 2e0 AS p10,
         (p_partkey % 60) + 3e1 AS price_usd_bbl, (p_partkey % 4) * 5e-2 AS royalty_rate,
         (p_partkey % 5) * 1e-1 + 1e-1 AS cit_rate, (p_partkey % 7) + 6e0 AS opex_usd_bbl,
         (p_partkey % 9) * 2e1 + 6e1 AS well_cost_musd, (p_size * 6e0 + 1e1) * 13e0 AS dev_capex_musd,
         (p_partkey % 10) / 2e1 + 5e-2 AS pg
  FROM part)"""
