"""Block economics, screening and verdict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basinframe.catalog.registry import fix, fix_sql, query
from basinframe.catalog.shapes import BLOCKS_SQL, blocks
from basinframe.functions.codes import DEFAULT_PROFILE
from basinframe.operators import economics as ec
from basinframe.operators import screening as sc

_P = "[" + ",".join(str(p) for p in DEFAULT_PROFILE) + "]::DOUBLE[]"
_FLOW_SQL = f"""{BLOCKS_SQL}, y AS (SELECT *, unnest(range(13)) AS t FROM blocks),
v AS (SELECT *, CASE WHEN t >= 3 THEN resource_mmbbl * ({_P})[t - 2] ELSE 0e0 END AS prod,
   dev_capex_musd * CASE t WHEN 0 THEN 4e-1 WHEN 1 THEN 6e-1 ELSE 0e0 END + CASE WHEN t = 0 THEN well_cost_musd ELSE 0e0 END AS capex FROM y),
r AS (SELECT *, prod * price_usd_bbl AS revenue, prod * price_usd_bbl * royalty_rate AS royalty, prod * opex_usd_bbl AS opex,
   greatest(0e0, (prod * price_usd_bbl * (1 - royalty_rate) - prod * opex_usd_bbl - CASE WHEN prod > 0 THEN dev_capex_musd / 1e1 ELSE 0e0 END) * cit_rate) AS tax FROM v),
flow AS (SELECT *, revenue - royalty - opex - tax - capex AS ncf FROM r),
cum AS (SELECT *, sum(ncf) OVER (PARTITION BY block_id ORDER BY t) AS c FROM flow),
eco AS (SELECT block_id, any_value(pg) AS pg, any_value(well_cost_musd) AS well, any_value(stream) AS stream, sum(ncf / power(11e-1, t)) AS npv,
   sum((royalty + tax) / power(11e-1, t)) / sum((revenue - opex - capex) / power(11e-1, t)) AS take, sum((revenue - opex - capex) / power(11e-1, t)) AS base,
   min(t) FILTER (c >= 0) AS payback FROM cum GROUP BY 1)"""


@query(
    "dcf_npv",
    f"""WITH {_FLOW_SQL} SELECT block_id, {fix_sql('npv', 4)} AS npv_musd, CASE WHEN base > 0 THEN {fix_sql('take', 7)} ELSE -1 END AS government_take,
        CAST(coalesce(payback, -1) AS INT) AS payback_year FROM eco""",
)
def dcf_npv(t):
    """Value, government take and payback of every block, one projection."""
    out = ec.evaluate_blocks(blocks(t))
    return out.select(
        "block_id", fix("npv_musd", 4).alias("npv_musd"), F.coalesce(fix("government_take", 7), F.lit(-1.0)).alias("government_take"),
        F.coalesce("payback_year", F.lit(-1)).alias("payback_year"),
    )


@query(
    "cash_flow_years",
    f"WITH {_FLOW_SQL} SELECT CAST(t AS INT) AS t, {fix_sql('sum(revenue)', 2)} AS revenue, {fix_sql('sum(tax)', 2)} AS tax, {fix_sql('sum(ncf)', 2)} AS ncf FROM flow GROUP BY 1",
)
def cash_flow_years(t):
    years = ec.cash_flow_years(blocks(t))
    return years.groupBy("t").agg(
        fix(F.sum("revenue_musd"), 2).alias("revenue"), fix(F.sum("tax_musd"), 2).alias("tax"), fix(F.sum("ncf_musd"), 2).alias("ncf")
    )


@query("npv_from_years", f"WITH {_FLOW_SQL} SELECT block_id, {fix_sql('npv', 4)} AS npv_musd FROM eco")
def npv_from_years(t):
    return ec.npv_from_years(ec.cash_flow_years(blocks(t))).withColumn("npv_musd", fix("npv_musd", 4))


@query(
    "breakeven",
    f"""WITH {BLOCKS_SQL}, b AS (SELECT *, well_cost_musd + dev_capex_musd * (4e-1 + 6e-1 / 11e-1) AS spent FROM blocks),
        i AS (SELECT unnest(range(10)) AS i), fr AS (SELECT i, ({_P})[i + 1] AS f, power(11e-1, -(i + 3)) AS df FROM i),
        n AS (SELECT unnest(range(11)) AS n),
        k AS (SELECT n, (SELECT sum(f * df) FROM fr) AS vol, coalesce((SELECT sum(f * df) FROM fr WHERE i < n), 0) AS tv, coalesce((SELECT sum(df) FROM fr WHERE i < n), 0) AS ty FROM n)
        SELECT block_id, {fix_sql('max(((spent - cit_rate * dev_capex_musd * ty / 1e1) / (resource_mmbbl * (vol - cit_rate * tv)) + opex_usd_bbl) / (1 - royalty_rate))', 5)} AS breakeven_usd_bbl
        FROM b, k GROUP BY 1""",
)
def breakeven(t):
    """Zero-value price; the tests check that the value there really is zero."""
    return ec.evaluate_blocks(blocks(t)).select("block_id", fix("breakeven_usd_bbl", 5).alias("breakeven_usd_bbl"))


@query("emv", f"WITH {_FLOW_SQL} SELECT block_id, {fix_sql('pg * npv - (1 - pg) * well', 4)} AS emv_musd FROM eco")
def emv(t):
    out = ec.evaluate_blocks(blocks(t))
    return out.select("block_id", fix(ec.expected_value("pg", "npv_musd", "well_cost_musd"), 4).alias("emv_musd"))


@query(
    "block_validity",
    """SELECT CASE WHEN p_partkey % 11 = 0 THEN 'missing input' WHEN (p_partkey % 4) * 3e-1 + 2e-1 >= 1 THEN 'royalty_rate outside [0, 1)' WHEN p_partkey % 6 = 0 THEN 'negative well cost' ELSE 'ok' END AS input_error, count(*) AS n FROM part GROUP BY 1""",
)
def block_validity(t):
    k = F.col("stream")
    odd = blocks(t).withColumns(
        {
            "royalty_rate": k % 4 * 0.3 + 0.2,
            "well_cost_musd": F.when(k % 6 == 0, -1.0).otherwise(F.col("well_cost_musd")),
            "opex_usd_bbl": F.when(k % 11 != 0, F.col("opex_usd_bbl")),
        }
    )
    out = ec.evaluate_blocks(odd)
    return out.groupBy(F.coalesce("input_error", F.lit("ok")).alias("input_error")).agg(F.count(F.lit(1)).alias("n"))


_DRAWS = 10_000


def _u(dim: int) -> str:
    from basinframe.operators.economics import _STEPS

    shift = f"stream * 6180339887498949e-16 + {7 * 0.7548776662466927 + dim * 0.5698402909980532!r}::DOUBLE"
    raw = f"(d * {_STEPS[dim]!r}::DOUBLE + (({shift}) - floor({shift})))"
    return f"({raw} - floor({raw}))"


def _n(dim: int) -> str:
    return f"(sqrt(ln(greatest({_u(dim)}, 1e-12)) * -2) * cos({_u(dim + 1)} * 2 * pi()))"


_DRAW_SQL = f"""{BLOCKS_SQL}, dr AS (SELECT *, CAST(unnest(range(1, {_DRAWS + 1})) AS DOUBLE) AS d FROM blocks),
s AS (SELECT *, p50 * exp(ln(p10 / p50) / 12815515655446004e-16 * {_n(0)}) AS res, price_usd_bbl * exp(25e-2 * {_n(2)}) AS pr,
   dev_capex_musd * (1 + 3e-1 * (2 * {_u(4)} - 1)) AS cx FROM dr),
i AS (SELECT unnest(range(10)) AS i), fr AS (SELECT ({_P})[i + 1] AS f, power(11e-1, -(i + 3)) AS df FROM i),
e AS (SELECT block_id, d, any_value(pg) AS pg, any_value(well_cost_musd) AS w,
   sum(df * (res * f * pr * (1 - royalty_rate) - res * f * opex_usd_bbl - greatest(0e0, (res * f * pr * (1 - royalty_rate) - res * f * opex_usd_bbl - cx / 1e1) * cit_rate)))
     - any_value(well_cost_musd) - any_value(cx) * (4e-1 + 6e-1 / 11e-1) AS npv FROM s, fr GROUP BY 1, 2),
em AS (SELECT block_id, pg * npv - (1 - pg) * w AS emv FROM e)"""


@query(
    "scenario_summary",
    f"""WITH {_DRAW_SQL} SELECT block_id, {fix_sql('avg(emv)', 3)} AS emv_mean_musd, {fix_sql('quantile_cont(emv, 0.1)', 3)} AS emv_p10_musd,
        {fix_sql('quantile_cont(emv, 0.5)', 3)} AS emv_p50_musd, {fix_sql('quantile_cont(emv, 0.9)', 3)} AS emv_p90_musd,
        {fix_sql('avg(CASE WHEN emv > 0 THEN 1e0 ELSE 0e0 END)', 6)} AS p_emv_positive, count(*) AS n_draws FROM em GROUP BY 1""",
)
def scenario_summary(t):
    """The operator's own number of draws per block, made and summarised block by block."""
    out = ec.scenario_spread(blocks(t), _DRAWS, seed=7, stream=F.col("stream").cast("double"))
    cols = ["emv_mean_musd", "emv_p10_musd", "emv_p50_musd", "emv_p90_musd"]
    return out.select("block_id", *[fix(c, 3).alias(c) for c in cols], fix("p_emv_positive").alias("p_emv_positive"), "n_draws")


@query(
    "resource_sigma",
    f"""SELECT CASE WHEN p_size % 5 = 0 THEN 'bad' ELSE 'ok' END AS triple, count(*) AS n, {fix_sql('sum(CASE WHEN p_size % 5 = 0 THEN 0 ELSE ln(2e0) / 12815515655446004e-16 END)', 5)} AS total FROM part GROUP BY 1""",
)
def resource_sigma(t):
    """Lopsided triples are refused, even ones give their spread."""
    odd = blocks(t).withColumn("p90", F.when((F.col("p50") - 10.0) / 6.0 % 5 == 0, F.col("p50") * 0.9).otherwise(F.col("p90")))
    sigma, bad = ec.resource_sigma("p90", "p50", "p10")
    return odd.groupBy(F.when(bad, "bad").otherwise("ok").alias("triple")).agg(
        F.count(F.lit(1)).alias("n"), fix(F.coalesce(F.sum(sigma), F.lit(0.0)), 5).alias("total")
    )


_CONCEPTS = ["onshore", "shelf_tieback", "deepwater_tieback", "fpso_standalone"]


@query(
    "cost_inputs",
    """WITH c AS (SELECT p_partkey, ['onshore','shelf_tieback','deepwater_tieback','fpso_standalone'][p_partkey % 4 + 1] AS concept, p_size * 6e0 + 1e1 AS p50 FROM part),
       m AS (SELECT s_suppkey AS k, s_suppkey % 7 + 1e0 AS lo, s_suppkey % 7 + 4e0 AS hi FROM supplier WHERE s_suppkey < 4)
       SELECT 'b' || p_partkey AS block_id, CASE WHEN p_partkey % 4 = 1 THEN -1 ELSE (lo + hi) / 2 END AS opex_usd_bbl,
         CASE WHEN p_partkey % 4 = 1 THEN -1 ELSE (lo + hi) / 2 * p50 END AS dev_capex_musd,
         CASE WHEN p_partkey % 4 = 1 THEN 'opex_usd_bbl,dev_capex_musd' ELSE '' END AS cost_gap
       FROM c JOIN m ON m.k = p_partkey % 4""",
)
def cost_inputs(t):
    """Cost midpoints per concept; a blank range is a named gap, never a value."""
    k = F.col("s_suppkey")
    names = F.array(*[F.lit(c) for c in _CONCEPTS])
    lo, hi = k % 7 + 1.0, k % 7 + 4.0
    blank = k != 1
    costs = t.supplier.where("s_suppkey < 4").select(
        F.element_at(names, (k + 1).cast("int")).alias("concept"),
        F.when(blank, lo).alias("capex_usd_boe_low"), F.when(blank, hi).alias("capex_usd_boe_high"),
        F.when(blank, lo).alias("opex_usd_bbl_low"), F.when(blank, hi).alias("opex_usd_bbl_high"),
        F.lit(10.0).alias("well_cost_musd_low"), F.lit(20.0).alias("well_cost_musd_high"),
        F.lit(2.5).alias("schedule_years_low"), F.lit(3.2).alias("schedule_years_high"),
        F.lit("u").alias("source_url"), F.lit("d").alias("retrieved_at"), F.lit("").alias("notes"),
    )
    base = blocks(t).drop("opex_usd_bbl", "dev_capex_musd").withColumn("concept", F.element_at(names, (F.col("stream") % 4 + 1).cast("int")))
    out = ec.cost_inputs(base, costs)
    return out.select(
        "block_id", F.coalesce("opex_usd_bbl", F.lit(-1.0)).alias("opex_usd_bbl"),
        F.coalesce("dev_capex_musd", F.lit(-1.0)).alias("dev_capex_musd"), F.coalesce("cost_gap", F.lit("")).alias("cost_gap"),
    )


@query(
    "verdict",
    f"""WITH {_FLOW_SQL}, b AS (SELECT block_id, pg * npv - (1 - pg) * well AS emv, stream % 21 = 0 AS s, CASE WHEN stream % 13 = 0 THEN NULL ELSE stream % 40 END AS o, stream % 10 / 1e1 AS p FROM eco)
        SELECT block_id, CASE WHEN s OR coalesce(o, 0) > 25 OR emv <= 0 THEN 'NO_GO' WHEN p < 6e-1 OR coalesce(o, 0) > 10 THEN 'CONDITIONAL' ELSE 'GO' END AS verdict,
          CASE WHEN o IS NULL THEN 'overlap' ELSE '' END AS gaps FROM b""",
)
def verdict(t):
    """Rules on screened blocks; what is missing reads as clear and is said so."""
    out = ec.evaluate_blocks(blocks(t))
    k = F.col("stream")
    basis = out.select(
        "block_id", ec.expected_value("pg", "npv_musd", "well_cost_musd").alias("emv_musd"), (k % 21 == 0).alias("sanctioned"),
        F.when(k % 13 != 0, (k % 40).cast("double")).alias("overlap_pct"), (k % 10 / F.lit(10.0)).alias("p_emv_positive"),
    )
    return sc.decide(basis).select("block_id", "verdict", F.array_join("data_gaps", ",").alias("gaps"))


@query(
    "governance_pivot",
    f"""WITH g AS (SELECT c_nationkey AS iso3, CAST(year(o_orderdate) AS INT) AS year, o_orderstatus AS ind, max(o_totalprice) / 1e5 AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
        l AS (SELECT iso3, max(year) AS year FROM g GROUP BY 1)
        SELECT 'C' || iso3 AS iso3, year, coalesce({fix_sql("max(v) FILTER (ind = 'F')", 3)}, -1) AS f, coalesce({fix_sql("max(v) FILTER (ind = 'O')", 3)}, -1) AS o FROM g JOIN l USING (iso3, year) GROUP BY 1, 2""",
)
def governance_pivot(t):
    g = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(
        F.concat(F.lit("C"), "c_nationkey").alias("iso3"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("indicator")
    ).agg((F.max("o_totalprice") / 100000.0).alias("value"))
    out = sc.with_second_index(sc.governance(g, ["F", "O"]), None)
    return out.select("iso3", "year", *[F.coalesce(fix(c, 3), F.lit(-1.0)).alias(c) for c in ("f", "o")])


@query(
    "second_index",
    f"""WITH l AS (SELECT c_nationkey, arg_max(c_acctbal, c_custkey) AS v, max(c_custkey) AS y FROM customer GROUP BY 1)
        SELECT n_name AS iso3, {fix_sql('v', 1)} AS fsi_total, y AS fsi_year FROM nation JOIN l ON c_nationkey = n_nationkey""",
)
def second_index(t):
    index = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("iso3"), F.col("c_acctbal").alias("total"), F.col("c_custkey").alias("year")
    )
    out = sc.with_second_index(t.nation.select(F.col("n_name").alias("iso3")), index.withColumn("total", fix("total", 1)))
    return out.select("iso3", fix("fsi_total", 1).alias("fsi_total"), "fsi_year")


@query(
    "sanctions_or_match",
    """WITH p AS (SELECT s_nationkey AS k, CASE WHEN s_acctbal > 7e3 THEN 'N' || s_nationkey END AS iso3, CASE WHEN s_acctbal > 7e3 THEN lower('NATION_' || ((s_nationkey + 1) % 25)) END AS name, 'PR' || s_suppkey % 6 AS program FROM supplier),
       h AS (SELECT DISTINCT c_custkey, program FROM customer JOIN p ON p.iso3 = 'N' || c_nationkey OR p.name = lower('NATION_' || c_nationkey))
       SELECT c.c_custkey, count(h.program) > 0 AS sanctioned, coalesce(string_agg(h.program, ',' ORDER BY h.program), '') AS programs FROM customer c LEFT JOIN h USING (c_custkey) GROUP BY 1""",
)
def sanctions_or_match(t):
    """All programmes; those of smaller suppliers name no country and match none."""
    k, named = F.col("s_nationkey"), F.col("s_acctbal") > 7000
    programs = t.supplier.select(
        F.when(named, F.concat(F.lit("N"), k)).alias("iso3"), F.when(named, F.concat(F.lit("Nation_"), (k + 1) % 25)).alias("country_name"),
        F.concat(F.lit("PR"), F.col("s_suppkey") % 6).alias("program"), F.lit("L").alias("list_source"),
    )
    places = t.customer.select(
        "c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("iso3"), F.concat(F.lit("NATION_"), "c_nationkey").alias("country_name")
    )
    out = sc.sanctions_screen(places, programs, "c_custkey")
    return out.select("c_custkey", "sanctioned", F.array_join("programs", ",").alias("programs"))


@query(
    "financing_screen",
    "SELECT count(*) AS n_checked, count(*) FILTER (c_custkey % 3 < 2) AS n_restricting, count(*) FILTER (c_custkey % 3 < 2) AS n_rows FROM customer",
)
def financing_screen(t):
    flags = F.element_at(F.array(F.lit(" True"), F.lit("partial"), F.lit("no")), (F.col("c_custkey") % 3 + 1).cast("int"))
    rows = t.customer.select("c_name", flags.alias("upstream_oil_excluded"))
    k = F.lit(1).alias("k")
    n = sc.financing_rows(rows).agg(F.count(F.lit(1)).alias("n_rows"))
    return sc.financing_screen(rows).select(k, "*").join(n.select(k, "n_rows"), "k").drop("k")


@query(
    "fiscal_rates",
    """SELECT n_name AS iso3, CASE WHEN n_nationkey % 4 = 0 THEN 0e0 ELSE n_nationkey / 1e2 END AS royalty_rate, CASE WHEN n_nationkey % 5 = 0 THEN 9e-1 ELSE 3e-1 END AS cit_rate FROM nation""",
)
def fiscal_rates(t):
    k = F.col("n_nationkey")
    none = F.lit(None).cast("double")
    regimes = t.nation.select(
        F.col("n_name").alias("iso3"), F.when(k % 4 != 0, k / F.lit(100.0)).alias("royalty_rate"), F.lit(0.3).alias("cit_rate"),
        none.alias("mapped_royalty_rate"), F.when(k % 5 == 0, 0.9).alias("mapped_cit_rate"),
        F.lit(0.5).alias("suggested_royalty_rate"), F.lit(0.78).alias("suggested_cit_rate"),
    )
    return sc.fiscal_rates(regimes)


# ---- cited fields and reports --------------------------------------------------------------

_FIELDS = """fl AS (SELECT doc_id, lang AS agent, 'k' || (n_chars % 7) AS field, CASE WHEN doc_id % 12 = 0 THEN []::VARCHAR[] ELSE [source, 'snapshot'] END AS ids FROM documents)"""


def fields(t):
    """Documents as cited fields: agent, field and one or two sources."""
    none = F.array().cast("array<string>")
    return t.documents.select(
        "doc_id", F.col("lang").alias("agent"), F.concat(F.lit("k"), F.col("n_chars") % 7).alias("field"),
        F.when(F.col("doc_id") % 12 == 0, none).otherwise(F.array("source", F.lit("snapshot"))).alias("source_ids"),
    )


@query("citation_coverage", f"WITH {_FIELDS} SELECT agent, {fix_sql('count(*) FILTER (len(ids) > 0) / count(*)', 8)} AS coverage FROM fl GROUP BY 1")
def citation_coverage(t):
    return sc.citation_coverage(fields(t), "agent").withColumn("coverage", fix("coverage", 8))


@query(
    "coverage_gate",
    f"""WITH {_FIELDS}, c AS (SELECT agent || field AS b, count(*) FILTER (len(ids) > 0) / count(*) AS v FROM fl WHERE field <> 'k3' GROUP BY 1), a AS (SELECT DISTINCT agent || field AS b FROM fl)
        SELECT a.b, {fix_sql('coalesce(v, 1)', 8)} AS coverage, CASE WHEN coalesce(v, 1) < 9e-1 THEN 'citation coverage below minimum' ELSE '' END AS rejected FROM a LEFT JOIN c USING (b)""",
)
def coverage_gate(t):
    f = fields(t).withColumn("b", F.concat("agent", "field"))
    out = sc.coverage_gate(f.select("b").distinct(), sc.citation_coverage(f.where("field <> 'k3'"), "b"), "b")
    return out.select("b", fix("coverage", 8).alias("coverage"), F.coalesce("rejected", F.lit("")).alias("rejected"))


@query(
    "citation_appendix",
    f"""WITH {_FIELDS}, p AS (SELECT DISTINCT unnest(ids) AS source, agent || '.' || field AS c FROM fl) SELECT source, string_agg(c, ', ' ORDER BY c) AS cited_by FROM p GROUP BY 1""",
)
def citation_appendix(t):
    return sc.citation_appendix(fields(t), [])


@query(
    "quant_hash",
    """SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS quant_hash FROM orders""",
)
def quant_hash(t):
    """Canonical JSON hash; the order of the arguments does not matter."""
    cols = {"status": F.col("o_orderstatus"), "custkey": F.col("o_custkey"), "priority": F.col("o_orderpriority")}
    return t.orders.select("o_orderkey", sc.quant_hash(cols).alias("quant_hash"))


@query(
    "gap_rows",
    "SELECT n_nationkey, 'political_risk' AS agent, 'score missing' AS value FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 6e3)",
)
def gap_rows(t):
    known = F.when(F.col("s_acctbal") > 6000, F.col("s_acctbal"))
    screen = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max(known).alias("score"))
    return sc.gap_rows(t.nation, screen, "n_nationkey", "political_risk", "score").select("n_nationkey", "agent", "value")


_MEMOS = """mm AS (SELECT conv_id, turn, role, text FROM conversations)"""


@query("memo_rollup", f"WITH {_MEMOS} SELECT count(*) AS n_memos, CASE WHEN bool_and(length(trim(text)) > 0) THEN 'pass' ELSE 'fail' END AS overall FROM mm")
def memo_rollup(t):
    memos = t.conversations.select(F.lit(1.0).alias("citation_coverage"), F.col("text").alias("redteam_narrative"))
    return sc.memo_rollup(memos)


@query(
    "memo_listing",
    "SELECT conv_id || '-' || turn AS block_id, 'GO' AS verdict, turn / 2e0 AS emv_musd, role AS narrator FROM conversations",
)
def memo_listing(t):
    """Nested records written as JSON text, parsed and flattened."""
    record = F.to_json(
        F.struct(
            F.struct(
                F.concat_ws("-", "conv_id", "turn").alias("block_id"), F.lit("GO").alias("verdict"),
                F.struct((F.col("turn") / F.lit(2.0)).alias("emv_musd")).alias("verdict_basis"),
                F.lit("2026").alias("generated_at"), F.lit(1.0).alias("citation_coverage"),
            ).alias("memo"),
            F.col("role").alias("narrator"),
        )
    )
    schema = (
        "memo struct<block_id: string, verdict: string, verdict_basis: struct<emv_musd: double>, "
        "generated_at: string, citation_coverage: double>, narrator string"
    )
    parsed = t.conversations.select(F.from_json(record, schema).alias("r")).select("r.*")
    return sc.memo_listing(parsed).select("block_id", "verdict", "emv_musd", "narrator")
