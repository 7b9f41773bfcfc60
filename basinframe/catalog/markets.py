"""Market-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basinframe.catalog.feeds import _STRIP_SQL, strip_quotes
from basinframe.catalog.registry import day, fix, fix_sql, query
from basinframe.functions.scalars import (
    agreement_band,
    crack_spread_321,
    curve_structure,
    days_of_cover,
    pct_of_target,
    spread,
)
from basinframe.operators import series as s
from basinframe.operators.economics import price_deck
from basinframe.operators.ordered import top_n
from basinframe.sources.market import curve_strip

_CENTS = "CAST(sum(CAST(round_even(o_totalprice * 100, 0) AS BIGINT)) AS BIGINT)"


def _cents(c):
    return F.sum(F.rint(F.col(c) * 100).cast("long"))


_WEEKLY_SQL = f"""weekly AS (
  SELECT o_orderpriority AS metric, CAST(date_trunc('week', o_orderdate) AS DATE) AS period, {_CENTS} / 1e2 AS value
  FROM orders GROUP BY 1, 2)"""


def weekly(t):
    """Weekly totals per priority, exact to the cent."""
    return t.orders.groupBy(
        F.col("o_orderpriority").alias("metric"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("period")
    ).agg((_cents("o_totalprice") / F.lit(100.0)).alias("value"))


_RECON_SQL = f"""a AS (SELECT c_nationkey AS country, strftime(o_orderdate, '%Y-%m') AS month, {_CENTS} / 1e2 AS v
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
b AS (SELECT c_nationkey AS country, strftime(o_orderdate, '%Y-%m') AS month,
  CAST(sum(CAST(round_even(o_totalprice * 100, 0) AS BIGINT) + o_orderkey % 5 * 800000) AS BIGINT) / 1e2 AS v
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 50 > 0 GROUP BY 1, 2),
j AS (SELECT a.country, a.month, a.v AS va, b.v AS vb, 1e2 * (a.v - b.v) / b.v AS delta FROM a JOIN b USING (country, month)),
recon AS (SELECT *, CASE WHEN abs(delta) <= 5 THEN 'pass' WHEN abs(delta) <= 10 THEN 'warn' ELSE 'fail' END AS status FROM j)"""


def _two_sources(t):
    base = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    keys = [F.col("c_nationkey").alias("country"), F.date_format("o_orderdate", "yyyy-MM").alias("month")]
    a = base.groupBy(*keys).agg((_cents("o_totalprice") / F.lit(100.0)).alias("production_kbd"))
    extra = F.rint(F.col("o_totalprice") * 100).cast("long") + F.col("o_orderkey") % 5 * 800000
    b = base.where("o_orderkey % 50 > 0").groupBy(*keys).agg((F.sum(extra) / F.lit(100.0)).alias("production_kbd"))
    return a, b


@query(
    "reconcile_bands",
    f"WITH {_RECON_SQL} SELECT country, month, va AS production_kbd_a, vb AS production_kbd_b, {fix_sql('delta', 6)} AS delta_pct, status FROM recon",
)
def reconcile_bands(t):
    out = s.reconcile(*_two_sources(t), ["country", "month"], "production_kbd")
    return out.withColumn("delta_pct", fix("delta_pct", 6))


@query(
    "recon_tally",
    f"""WITH {_RECON_SQL} SELECT country, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'warn') AS n_warn,
        count(*) FILTER (status = 'fail') AS n_fail, max(month) AS latest_month, {fix_sql('arg_max(delta, month)', 6)} AS latest_delta_pct,
        arg_max(status, month) AS latest_status FROM recon GROUP BY 1""",
)
def recon_tally(t):
    out = s.recon_tally(s.reconcile(*_two_sources(t), ["country", "month"], "production_kbd"))
    return s.worst_first(out.withColumn("latest_delta_pct", fix("latest_delta_pct", 6)), "latest_status", "country")


@query(
    "recon_window",
    """WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders INTERSECT SELECT DISTINCT strftime(l_shipdate, '%Y-%m') FROM lineitem)
       SELECT month FROM m ORDER BY month DESC LIMIT 24""",
)
def recon_window(t):
    """The last two years of months both tables cover."""
    a = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    b = t.lineitem.select(F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return s.common_months(a, b, 24)


@query(
    "wow_consistency",
    f"""WITH {_WEEKLY_SQL}, r AS (SELECT metric, period, value, value - lag(value, 1, 0e0) OVER p + (CAST(epoch(period) AS BIGINT) // 604800 % 3) AS rep,
          value - lag(value) OVER p AS comp FROM weekly WINDOW p AS (PARTITION BY metric ORDER BY period))
        SELECT metric, strftime(period, '%Y-%m-%d') AS week, {fix_sql('comp', 4)} AS computed_change_kbbl,
          CASE WHEN abs(comp - rep) <= 15e-1 THEN 'pass' ELSE 'fail' END AS status FROM r WHERE comp IS NOT NULL""",
)
def wow_consistency(t):
    """Change from levels against a reported change that is off in every third week."""
    from basinframe.operators.ordered import prefix

    levels = prefix(weekly(t), ["metric"], ["period"], lags={"prev": "value"})
    week_no = F.floor(F.unix_date("period") * 86400 / 604800)
    reported = levels.select(
        "metric",
        F.col("period").alias("week"),
        F.col("value").alias("stocks_kbbl"),
        (F.col("value") - F.coalesce("prev", F.lit(0.0)) + week_no % 3).alias("reported_change_kbbl"),
    )
    out = s.weekly_consistency(reported, ["metric"], tolerance=1.5)
    return out.select("metric", day("week").alias("week"), fix("computed_change_kbbl", 4).alias("computed_change_kbbl"), "status")


@query(
    "consistency_input",
    f"""WITH {_WEEKLY_SQL}, r AS (SELECT period, value, value - lag(value) OVER (ORDER BY period) AS ch, row_number() OVER (ORDER BY period DESC) AS n
          FROM weekly WHERE metric = '1-URGENT')
        SELECT strftime(period, '%Y-%m-%d') AS week, value AS stocks_kbbl, {fix_sql('coalesce(ch, 0)', 4)} AS reported_change_kbbl FROM r WHERE n <= 53""",
)
def consistency_input(t):
    out = s.consistency_input(weekly(t), "1-URGENT")
    return out.select(day("week").alias("week"), "stocks_kbbl", fix("reported_change_kbbl", 4).alias("reported_change_kbbl"))


@query(
    "latest_previous",
    f"""WITH {_WEEKLY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY period DESC) AS n FROM weekly)
        SELECT metric, strftime(max(period), '%Y-%m-%d') AS asof, max(value) FILTER (n = 1) AS last_value, max(value) FILTER (n = 2) AS previous_value,
          {fix_sql('max(value) FILTER (n = 1) - max(value) FILTER (n = 2)', 4)} AS delta FROM r WHERE n <= 2 GROUP BY 1""",
)
def latest_previous(t):
    out = s.latest_previous(weekly(t), ["metric"], "period", "value")
    return out.withColumns({"asof": day("asof"), "delta": fix("delta", 4)})


@query(
    "tail_n",
    f"WITH {_WEEKLY_SQL} SELECT metric, strftime(period, '%Y-%m-%d') AS period, value FROM weekly QUALIFY row_number() OVER (PARTITION BY metric ORDER BY period DESC) <= 56",
)
def tail_n(t):
    return top_n(weekly(t), ["metric"], ["-period"], 56).withColumn("period", day("period"))


_BAND_SQL = f"""{_WEEKLY_SQL}, y AS (SELECT max(year(period)) AS y FROM weekly),
band AS (SELECT metric, CAST(weekofyear(period) AS INT) AS week_of_year, min(value) AS band_min, max(value) AS band_max
  FROM weekly, y WHERE year(period) >= y.y - 5 AND year(period) < y.y GROUP BY 1, 2)"""


def _band(t):
    wk = weekly(t)
    last = wk.agg(F.max(F.year("period")).alias("y")).first()["y"]
    return wk, s.five_year_band(wk, ["metric"], "period", "value", F.lit(last))


@query("five_year_band", f"WITH {_BAND_SQL} SELECT * FROM band")
def five_year_band(t):
    return _band(t)[1]


@query(
    "band_join",
    f"""WITH {_BAND_SQL} SELECT metric, strftime(period, '%Y-%m-%d') AS period, value, coalesce(band_min, -1) AS band_min, coalesce(band_max, -1) AS band_max
        FROM (SELECT *, CAST(weekofyear(period) AS INT) AS week_of_year FROM weekly) LEFT JOIN band USING (metric, week_of_year)""",
)
def band_join(t):
    wk, band = _band(t)
    out = s.with_band(wk, band, ["metric"], "period")
    return out.select(
        "metric", day("period").alias("period"), "value",
        F.coalesce("band_min", F.lit(-1.0)).alias("band_min"), F.coalesce("band_max", F.lit(-1.0)).alias("band_max"),
    )


@query(
    "lead_lag_corr",
    f"""WITH a AS (SELECT o_orderpriority AS metric, strftime(o_orderdate, '%Y-%m') AS month, {_CENTS} / 1e2 AS av,
            CAST(sum(o_orderkey % 100) AS DOUBLE) AS bv FROM orders GROUP BY 1, 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY month) AS i FROM a),
        g AS (SELECT unnest(range(13)) AS k)
        SELECT x.metric, CAST(k AS INT) AS lag_months, {fix_sql('corr(x.av, y.bv)', 7)} AS correlation FROM g, n x JOIN n y ON y.metric = x.metric WHERE y.i = x.i + k GROUP BY 1, 2""",
)
def lead_lag_corr(t):
    keys = [F.col("o_orderpriority").alias("metric"), F.date_format("o_orderdate", "yyyy-MM").alias("month")]
    a = t.orders.groupBy(*keys).agg((_cents("o_totalprice") / F.lit(100.0)).alias("value"))
    b = t.orders.groupBy(*keys).agg(F.sum(F.col("o_orderkey") % 100).cast("double").alias("value"))
    return s.lead_lag(a, b, ["metric"], "month").withColumn("correlation", fix("correlation", 7))


@query(
    "index_mismatch",
    """WITH a AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders), b AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month FROM lineitem)
       (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def index_mismatch(t):
    """Months only one of two monthly series has."""
    a = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    b = t.lineitem.select(F.date_format("l_shipdate", "yyyy-MM").alias("month")).distinct()
    return s.unmatched_index(a, b, ["month"])


@query(
    "spread_by_date",
    f"""WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus AS st, max(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F','O') GROUP BY 1, 2)
        SELECT f.date, f.v AS a_value, o.v AS b_value, {fix_sql('f.v - o.v', 4)} AS spread FROM d f JOIN d o ON f.date = o.date AND f.st = 'F' AND o.st = 'O'""",
)
def spread_by_date(t):
    out = s.pair_spread(
        t.orders.withColumn("date", day("o_orderdate")), "date", "o_orderstatus", "o_totalprice", "F", "O"
    )
    return out.withColumn("spread", fix("spread", 4))


@query(
    "last_per_date",
    "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, arg_max(o_totalprice, o_orderkey) AS o_totalprice, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1",
)
def last_per_date(t):
    df = t.orders.select(day("o_orderdate").alias("date"), "o_orderkey", "o_totalprice")
    return s.last_per_date(df, ["date"], "o_orderkey")


_STRIP_Q = f"WITH {_STRIP_SQL}, q AS (SELECT *, p / 1e3 + month_index * 5e-1 AS settle FROM strip)"


@query(
    "curve_checks",
    f"""{_STRIP_Q} SELECT strftime(a, '%Y-%m-%d') AS asof_date, month_index, (expiry < DATE '1998-01-01') AS stale,
        CASE WHEN expiry < DATE '1998-01-01' THEN 'fail' ELSE 'pass' END AS status FROM q""",
)
def curve_checks(t):
    out = s.curve_checks(curve_strip(strip_quotes(t)), F.lit("1998-01-01"))
    return out.select(day("asof_date").alias("asof_date"), "month_index", "stale", "status")


@query(
    "latest_batch",
    f"{_STRIP_Q} SELECT contract, month_index, settle AS settle_usd_bbl FROM q WHERE a = (SELECT max(a) FROM q)",
)
def latest_batch(t):
    return s.latest_batch(curve_strip(strip_quotes(t)), "asof_date").select("contract", "month_index", "settle_usd_bbl")


@query(
    "price_deck",
    f"""{_STRIP_Q}, m AS (SELECT {fix_sql('settle', 2)} AS p FROM q WHERE a = (SELECT max(a) FROM q) AND month_index = 1)
        SELECT 'm1' AS scenario, p AS price_usd_bbl FROM m UNION ALL SELECT 'flat_50', 5e1 UNION ALL SELECT 'flat_70', 7e1 UNION ALL SELECT 'flat_90', 9e1""",
)
def deck(t):
    return price_deck(curve_strip(strip_quotes(t))).select("scenario", "price_usd_bbl")


@query(
    "curve_slopes",
    f"""{_STRIP_Q}, w AS (SELECT a, max(settle) FILTER (month_index = 1) AS m1, max(settle) FILTER (month_index = 2) AS m2,
          max(settle) FILTER (month_index = 12) AS m12, min(p) AS p FROM q GROUP BY 1)
        SELECT strftime(a, '%Y-%m-%d') AS asof_date, {fix_sql('m1 - m2', 6)} AS prompt_spread, {fix_sql('m1 - m12', 6)} AS slope, 'contango' AS structure FROM w""",
)
def curve_slopes(t):
    strip = curve_strip(strip_quotes(t))
    at = {i: F.max(F.when(F.col("month_index") == i, F.col("settle_usd_bbl"))).alias(f"m{i}") for i in (1, 2, 12)}
    wide = strip.groupBy(day("asof_date").alias("asof_date")).agg(*at.values())
    return wide.select(
        "asof_date", fix(spread("m1", "m2")).alias("prompt_spread"), fix(spread("m1", "m12")).alias("slope"),
        curve_structure("m1", "m12").alias("structure"),
    )


@query(
    "market_formulas",
    f"""SELECT o_orderkey, {fix_sql('(2 * (o_totalprice / 1e5) * 42 + (o_custkey / 1e3) * 42 - 3 * 7e1) / 3', 6)} AS crack,
        {fix_sql('o_totalprice / (o_custkey + 1)', 4)} AS cover, {fix_sql('1e2 * o_totalprice / (o_custkey + 1)', 4)} AS pct FROM orders""",
)
def market_formulas(t):
    return t.orders.select(
        "o_orderkey",
        fix(crack_spread_321(F.col("o_totalprice") / 100000.0, F.col("o_custkey") / F.lit(1000.0), F.lit(70.0))).alias("crack"),
        fix(days_of_cover("o_totalprice", F.col("o_custkey") + 1), 4).alias("cover"),
        fix(pct_of_target("o_totalprice", F.col("o_custkey") + 1), 4).alias("pct"),
    )


@query(
    "agreement_bands",
    """SELECT CASE WHEN abs(l_discount * 2e2 - 1e1) <= 5 THEN 'pass' WHEN abs(l_discount * 2e2 - 1e1) <= 10 THEN 'warn' ELSE 'fail' END AS band, count(*) AS n
       FROM lineitem GROUP BY 1""",
)
def agreement_bands(t):
    return t.lineitem.groupBy(agreement_band(F.col("l_discount") * 200.0 - 10.0).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "target_share",
    f"""WITH p AS (SELECT c_nationkey, {_CENTS} / 1e2 AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
        SELECT c_nationkey AS country, v AS production_kbd, CASE WHEN c_nationkey % 3 = 0 THEN -1 ELSE {fix_sql('1e2 * v / (c_nationkey * 1e6 + 1e6)', 6)} END AS pct FROM p""",
)
def target_share(t):
    """Production against optional targets kept per nation."""
    prod = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("country")).agg(
        (_cents("o_totalprice") / F.lit(100.0)).alias("production_kbd")
    )
    targets = t.nation.where("n_nationkey % 3 <> 0").select(
        F.col("n_nationkey").alias("country"), (F.col("n_nationkey") * 1e6 + 1e6).alias("target_kbd")
    )
    joined = prod.join(targets, "country", "left")
    pct = F.when(F.col("target_kbd").isNotNull(), pct_of_target("production_kbd", "target_kbd"))
    return joined.select("country", "production_kbd", F.coalesce(fix(pct), F.lit(-1.0)).alias("pct"))


@query(
    "rig_totals",
    """WITH r AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'us' ELSE 'canada' END AS region, date_trunc('week', o_orderdate) AS wk, CAST(sum(o_orderkey % 9) AS BIGINT) AS rig_count
         FROM orders WHERE o_orderkey % 17 <> 0 GROUP BY 1, 2)
       SELECT region, strftime(wk, '%Y-%m-%d') AS week, rig_count, coalesce(rig_count - lag(rig_count) OVER (PARTITION BY region ORDER BY wk), -1) AS delta FROM r""",
)
def rig_totals(t):
    from basinframe.catalog.feeds import rig_counts

    out = s.weekly_totals(rig_counts(t))
    return out.withColumn("delta", F.coalesce("delta", F.lit(-1)))


_NOW = "2024-01-30 00:00:00"


@query(
    "freshness_sla",
    f"""WITH n AS (SELECT user_id % 40 AS k, max(ts) AS r FROM events GROUP BY 1)
        SELECT 's' || s_suppkey AS source_id, CASE WHEN r IS NULL THEN -1 ELSE {fix_sql("(epoch_us(TIMESTAMP '2024-01-30') - epoch_us(r)) / 864e8", 2)} END AS age_days,
          CASE WHEN (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(r)) / 864e8 <= s_suppkey % 3 / 1e1 THEN 'pass' ELSE 'fail' END AS status,
          CASE WHEN r IS NULL THEN 'no data written' ELSE '' END AS detail
        FROM supplier LEFT JOIN n ON n.k = s_suppkey""",
)
def freshness_sla(t):
    """Suppliers as registered sources, events as their ledger."""
    registry = t.supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("source_id"), (F.col("s_suppkey") % 3 / F.lit(10.0)).alias("sla_days")
    )
    ledger = t.events.select(F.concat(F.lit("s"), F.col("user_id") % 40).alias("source_id"), F.col("ts").alias("retrieved_at"))
    out = s.freshness(ledger, registry, F.lit(_NOW).cast("timestamp"))
    exact = (F.lit(_NOW).cast("timestamp").cast("double") - F.col("retrieved_at").cast("timestamp").cast("double")) / 86400.0
    return out.select(
        "source_id", F.when(F.col("retrieved_at").isNull(), -1.0).otherwise(fix(exact, 2)).alias("age_days"), "status", "detail"
    )


@query(
    "source_catalog",
    """WITH n AS (SELECT DISTINCT user_id % 40 AS k FROM events)
       SELECT s_name AS name, s_suppkey % 3 / 1e1 AS sla_days, CASE WHEN k IS NULL THEN 'no data written' ELSE '' END AS detail FROM supplier LEFT JOIN n ON k = s_suppkey""",
)
def source_catalog(t):
    registry = t.supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("source_id"), F.col("s_name").alias("name"),
        (F.col("s_suppkey") % 3 / F.lit(10.0)).alias("sla_days"),
    )
    ledger = t.events.select(F.concat(F.lit("s"), F.col("user_id") % 40).alias("source_id"), F.col("ts").alias("retrieved_at"))
    fresh = s.freshness(ledger, registry, F.lit(_NOW).cast("timestamp"))
    return s.source_catalog(registry, fresh).select("name", "sla_days", "detail")


@query("recent_events", "SELECT event_id, event_type FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 50")
def recent_events(t):
    return t.events.orderBy(F.desc_nulls_last("ts"), "event_id").limit(50).select("event_id", "event_type")


@query(
    "json_props_parse",
    """SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1""",
)
def json_props_parse(t):
    k = F.from_json("props", "k bigint")["k"]
    return t.events.groupBy("event_type").agg(F.sum(k).alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    "nulls_last_sort",
    """SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END DESC NULLS LAST, p_partkey) AS place FROM part
""",
)
def nulls_last_sort(t):
    """Places of a column sort that keeps blanks at the end."""
    from basinframe.operators.ordered import prefix

    v = F.when(F.col("p_size") % 4 != 0, F.col("p_size"))
    placed = prefix(t.part.select("p_partkey", v.alias("v")), [], ["-v", "p_partkey"], ordinal="place")
    return placed.select("p_partkey", "place")


@query(
    "set_operations",
    """SELECT 'intersect' AS op, count(*) AS n FROM (SELECT CASE WHEN c_acctbal > 9900 THEN c_nationkey END FROM customer INTERSECT SELECT CASE WHEN s_acctbal > 8000 THEN s_nationkey END FROM supplier) UNION ALL
       SELECT 'subtract', count(*) FROM (SELECT CASE WHEN c_acctbal > 9900 THEN c_nationkey END FROM customer EXCEPT SELECT CASE WHEN s_acctbal > 8000 THEN s_nationkey END FROM supplier) UNION ALL
       SELECT 'union', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)""",
)
def set_operations(t):
    """Sets with a null for rows that give no key; a null equals a null there."""
    a = t.customer.select(F.when(F.col("c_acctbal") > 9900, F.col("c_nationkey")).alias("k"))
    b = t.supplier.select(F.when(F.col("s_acctbal") > 8000, F.col("s_nationkey")).alias("k"))

    def n(df, op):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")

    return n(a.intersect(b), "intersect").unionByName(n(a.subtract(b), "subtract")).unionByName(n(a.unionByName(b), "union"))
