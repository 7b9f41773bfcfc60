"""Contract and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basinframe.catalog.registry import query
from basinframe.operators.contracts import (
    Contract,
    Guard,
    Monotone,
    attach_provenance,
    collapse_identical,
    drop_and_count,
    duplicate_keys,
    eq,
    ge,
    gt,
    guard_report,
    in_range,
    invalid_provenance,
    isin,
    length,
    matches,
    missing_members,
    non_null,
    not_startswith,
    nullable,
    provenance_of,
    startswith,
    strict_double,
    truncated,
    unknown_codes,
)
from basinframe.operators.ranking import input_guards


def line_contract() -> Contract:
    return Contract(
        "lines",
        {
            "l_orderkey": non_null("bigint", ge(0)),
            "l_linenumber": non_null("int", in_range(1, 6)),
            "l_quantity": non_null("double", gt(1)),
            "l_discount": nullable("double", in_range(0.0, 0.09)),
            "l_returnflag": non_null("string", isin(["A", "N"]), length(1, 1)),
            "l_linestatus": non_null("string", eq("F")),
        },
        unique=("l_orderkey", "l_linenumber"),
        row_checks={"tax_or_discount": lambda: (F.col("l_tax") > 0) != (F.col("l_discount") > 0)},
    )


@query(
    "contract_failures",
    """WITH t AS (SELECT
         count(*) FILTER (l_orderkey IS NULL) a, count(*) FILTER (l_orderkey < 0) b,
         count(*) FILTER (l_linenumber IS NULL) c, count(*) FILTER (l_linenumber NOT BETWEEN 1 AND 6) d,
         count(*) FILTER (l_quantity IS NULL) e, count(*) FILTER (isnan(l_quantity)) f, count(*) FILTER (l_quantity <= 1) g,
         count(*) FILTER (isnan(l_discount)) h, count(*) FILTER (l_discount NOT BETWEEN 0 AND 9e-2) i,
         count(*) FILTER (l_returnflag IS NULL) j, count(*) FILTER (l_returnflag NOT IN ('A','N')) k,
         count(*) FILTER (length(l_returnflag) <> 1) l, count(*) FILTER (l_linestatus IS NULL) m,
         count(*) FILTER (l_linestatus <> 'F') n, count(*) FILTER ((l_tax > 0) = (l_discount > 0)) o FROM lineitem),
       u AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) p FROM (SELECT count(*) n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
       SELECT unnest(['l_orderkey:not_null','l_orderkey:ge','l_linenumber:not_null','l_linenumber:in_range','l_quantity:not_null',
         'l_quantity:not_nan','l_quantity:gt','l_discount:not_nan','l_discount:in_range','l_returnflag:not_null','l_returnflag:isin',
         'l_returnflag:length','l_linestatus:not_null','l_linestatus:eq','row:tax_or_discount','unique:l_orderkey,l_linenumber']) AS "check",
         unnest([a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p]) AS n_failed FROM t, u""",
)
def contract_failures(t):
    """Every check of a contract counted in one pass, zero counts included."""
    return line_contract().failures(t.lineitem)


@query(
    "contract_offending_rows",
    """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
       WHERE l_linenumber NOT BETWEEN 1 AND 6 OR l_quantity <= 1 OR l_discount NOT BETWEEN 0 AND 9e-2
          OR l_returnflag NOT IN ('A','N') OR l_linestatus <> 'F' OR (l_tax > 0) = (l_discount > 0) GROUP BY 1, 2""",
)
def contract_offending_rows(t):
    bad = line_contract().offending(t.lineitem)
    return bad.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "contract_split",
    """SELECT 'good' AS part, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1-%' AND o_totalprice > 5e4 UNION ALL
       SELECT 'bad', count(*) FROM orders WHERE NOT (o_orderpriority LIKE '1-%' AND o_totalprice > 5e4)""",
)
def contract_split(t):
    rule = Contract(
        "orders",
        {
            "o_orderpriority": non_null("string", startswith("1-"), matches(r"^\d-[A-Z]+$"), not_startswith("Total")),
            "o_totalprice": non_null("double", gt(50000.0)),
        },
    )
    good, bad = rule.split(t.orders)
    return good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("part"), "n").unionByName(
        bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("bad").alias("part"), "n")
    )


@query(
    "contract_split_unique",
    """WITH k AS (SELECT o_custkey, o_orderdate, o_totalprice, count(*) OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate)) AS c FROM orders)
       SELECT c > 1 AS repeated, o_totalprice <= 5e4 AS cheap, count(*) AS n FROM k WHERE c > 1 OR o_totalprice <= 5e4 GROUP BY ALL""",
)
def contract_split_unique(t):
    """Bad rows by reason: a repeated customer and month, a price too low, or both."""
    rule = Contract(
        "orders",
        {"o_custkey": non_null("bigint"), "month": non_null("date"), "o_totalprice": non_null("double", gt(50000.0))},
        unique=("o_custkey", "month"),
    )
    rows = t.orders.select("o_custkey", F.trunc("o_orderdate", "month").alias("month"), "o_totalprice")
    _, bad = rule.split(rows)
    why = F.col("failed_checks")
    return bad.groupBy(
        F.exists(why, lambda x: x.startswith("unique:")).alias("repeated"),
        F.exists(why, lambda x: x.startswith("o_totalprice:")).alias("cheap"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "type_coercion",
    """SELECT o_orderkey, coalesce(TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS BIGINT), -1) AS custkey
       FROM orders""",
)
def type_coercion(t):
    """Text to declared types; what does not fit is NULL."""
    raw = t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("custkey"),
    )
    typed = Contract("orders", {"o_orderkey": non_null("bigint"), "custkey": nullable("bigint")}).coerce(raw)
    return typed.select("o_orderkey", F.coalesce("custkey", F.lit(-1)).alias("custkey"))


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicates(t):
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "monotone_groups",
    """WITH s AS (SELECT c_nationkey, c_custkey, c_acctbal, lag(c_acctbal) OVER (PARTITION BY c_nationkey, c_custkey // 20 ORDER BY c_custkey) p FROM customer)
       SELECT 'group:balance_rises' AS "check", count(*) FILTER (c_acctbal < p) AS n_failed FROM s""",
)
def monotone_groups(t):
    """Falls of a value along groups of bounded size."""
    keyed = t.customer.withColumn("batch", F.floor(F.col("c_custkey") / 20))
    rule = Contract(
        "balances", {}, monotone=(Monotone("balance_rises", ("c_nationkey", "batch"), "c_custkey", "c_acctbal"),)
    )
    rows = Contract("balances", {"c_custkey": non_null("bigint")}, monotone=rule.monotone).failures(keyed)
    return rows.where(F.col("check").startswith("group:"))


@query(
    "coverage_floor",
    """SELECT n_name AS member FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5e3)""",
)
def coverage_floor(t):
    """Nations that must appear among large suppliers and do not."""
    have = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    have = have.withColumn("n_name", F.when(F.col("s_acctbal") > 5000, F.col("n_name")))
    return missing_members(have, "n_name", t.nation.select(F.col("n_name").alias("member")), "member")


@query(
    "unmapped_codes",
    """SELECT o_orderpriority AS code, count(*) AS n_rows FROM orders WHERE o_orderpriority NOT IN
       (SELECT c FROM (SELECT DISTINCT substr(o_orderpriority, 1, 1) AS k, o_orderpriority AS c FROM orders) WHERE k IN ('1','2')) GROUP BY 1""",
)
def unmapped_codes(t):
    known = t.orders.where(F.substring("o_orderpriority", 1, 1).isin("1", "2")).select(F.col("o_orderpriority").alias("k"))
    return unknown_codes(t.orders, "o_orderpriority", known, "k")


@query(
    "strict_numeric",
    """SELECT o_orderstatus, count(*) FILTER (o_orderkey % 7 = 0) AS n_absent, count(*) FILTER (o_orderkey % 7 = 1) AS n_junk,
       CAST(sum(CASE WHEN o_orderkey % 7 > 1 THEN o_custkey ELSE 0 END) AS BIGINT) AS total FROM orders GROUP BY 1""",
)
def strict_numeric(t):
    raw = t.orders.select(
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 == 0, " *****")
        .when(F.col("o_orderkey") % 7 == 1, "1,5")
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("cell"),
    )
    value, junk = strict_double("cell", ["", "*****"])
    return raw.groupBy("o_orderstatus").agg(
        F.count_if(value.isNull() & ~junk).alias("n_absent"),
        F.count_if(junk).alias("n_junk"),
        F.coalesce(F.sum(value), F.lit(0.0)).cast("long").alias("total"),
    )


@query(
    "truncation_guard",
    """SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
       WHERE o_custkey % 8 > coalesce(n, 0)""",
)
def truncation_guard(t):
    """Orders that declare more lines than they carry."""
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    docs = t.orders.withColumn("declared", (F.col("o_custkey") % 8).cast("string")).join(n, "o_orderkey", "left")
    return docs.where(truncated(F.col("declared"), F.coalesce("n", F.lit(0)))).select("o_orderkey")


@query(
    "drop_and_count",
    """SELECT o_orderpriority, count(*) AS n_raw, count(*) FILTER (o_orderkey % 5 = 0) AS dropped_no_year,
       count(*) FILTER (o_orderkey % 5 <> 0 AND o_custkey % 7 = 0) AS dropped_no_place,
       count(*) FILTER (o_orderkey % 5 <> 0 AND o_custkey % 7 <> 0) AS n_kept FROM orders GROUP BY 1""",
)
def dropped(t):
    _, counts = drop_and_count(
        t.orders,
        "o_orderpriority",
        [("no_year", F.col("o_orderkey") % 5 == 0), ("no_place", F.col("o_custkey") % 7 == 0)],
    )
    return counts


@query(
    "collapse_identical",
    """SELECT l_returnflag, count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_quantity FROM lineitem) GROUP BY 1""",
)
def collapsed(t):
    """Identical rows become one before they are counted."""
    one = collapse_identical(t.lineitem.select("l_returnflag", "l_suppkey", "l_quantity"))
    return one.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "collapse_subset",
    "SELECT count(*) AS n, (SELECT count(*) FROM (SELECT l_suppkey FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem) GROUP BY 1 HAVING count(*) > 1)) AS n_conflicts FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem)",
)
def collapse_subset(t):
    """Collapse on two columns, then count keys that still conflict."""
    one = collapse_identical(t.lineitem, ["l_suppkey", "l_returnflag"])
    conflicts = duplicate_keys(one, ["l_suppkey"]).agg(F.count(F.lit(1)).alias("n_conflicts"))
    k = F.lit(1).alias("k")
    return one.agg(F.count(F.lit(1)).alias("n")).select(k, "n").join(conflicts.select(k, "n_conflicts"), "k").drop("k")


@query(
    "provenance_stamp",
    """SELECT 'orders_feed' AS source_id, '2026-07-18' AS retrieved, 'https://orders.example' AS source_url, 'v2' AS transform_version,
       (SELECT count(*) FROM orders) AS n_rows, CAST(0 AS BIGINT) AS n_invalid""",
)
def provenance_stamp(t):
    import datetime as dt

    from basinframe.operators.contracts import Provenance

    prov = Provenance("orders_feed", dt.datetime(2026, 7, 18, tzinfo=dt.UTC), "https://orders.example", "v2")
    stamped = attach_provenance(t.orders, prov)
    counts = stamped.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(invalid_provenance()).alias("n_invalid"))
    k = F.lit(1).alias("k")
    head = provenance_of(stamped).select(
        k, "source_id", F.date_format("retrieved_at", "yyyy-MM-dd").alias("retrieved"), "source_url", "transform_version"
    )
    return head.join(counts.select(k, "*"), "k").drop("k")


@query(
    "load_guards",
    """WITH g AS (SELECT n_name, count(c_custkey) AS n, count(c_custkey) FILTER (c_custkey % 3 = 0) AS a, count(c_custkey) FILTER (c_custkey % 97 = 0) AS b
         FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 95e2 GROUP BY 1)
       SELECT n_name, 'no rows' AS rule, CAST(n = 0 AS BIGINT) AS n_bad, CAST(0 AS BIGINT) AS allowed, n = 0 AS stops FROM g
       UNION ALL SELECT n_name, 'unclassifiable', a, CAST(2 AS BIGINT), a > 2 FROM g UNION ALL SELECT n_name, 'no key', b, CAST(0 AS BIGINT), b > 0 FROM g""",
)
def load_guards(t):
    """Every source's load: empty, over its allowance of skipped rows, or broken."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("n_name", F.when(F.col("c_acctbal") > 9500, F.col("n_name")))
    rules = [Guard("unclassifiable", F.col("c_custkey") % 3 == 0, allowed=2), Guard("no key", F.col("c_custkey") % 97 == 0)]
    return guard_report(rows, "n_name", rules, expected=t.nation)


@query(
    "score_guards",
    """WITH g AS (SELECT event_type, count(*) FILTER (user_id % 40 = 0 OR user_id % 40 = 3) AS a, count(*) FILTER (event_id % 50 < 3) AS b FROM events GROUP BY 1)
       SELECT event_type, 'no scored rows' AS rule, CAST(0 AS BIGINT) AS n_bad, CAST(0 AS BIGINT) AS allowed, false AS stops FROM g
       UNION ALL SELECT event_type, 'label must be 0 or 1', a, 0, a > 0 FROM g UNION ALL SELECT event_type, 'score must be finite', b, 0, b > 0 FROM g""",
)
def score_guards(t):
    """What metric inputs break, per set: labels beside 0 and 1, scores null, NaN or infinite."""
    u, e = F.col("user_id") % 40, F.col("event_id") % 50
    odd = F.when(e == 0, F.lit(None).cast("double")).when(e == 1, float("nan")).when(e == 2, float("-inf")).otherwise(F.lit(0.5))
    rows = t.events.select("event_type", F.when(u == 0, 2).when(u != 3, u % 2).alias("label"), odd.alias("score"))
    return guard_report(rows, "event_type", input_guards("label", "score"), empty="no scored rows")
