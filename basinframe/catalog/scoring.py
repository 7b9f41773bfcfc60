"""Fold, feature, metric and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basinframe.catalog.registry import fix, fix_sql, query
from basinframe.catalog.shapes import (
    CELLS_SQL,
    GRID_DEG,
    MAPPED_SQL,
    N_COLS,
    cells,
    chord_sql,
    km_sql,
    lat_of,
    lat_sql,
    lon_of,
    lon_sql,
    mapped_wells,
    xyz_sql,
)
from basinframe.functions.geo import Grid, chord_of_km
from basinframe.operators import features as ft
from basinframe.operators import folds as fo
from basinframe.operators import models as m
from basinframe.operators import ranking as rk
from basinframe.operators import wells as w
from basinframe.session import materialize

# Customers as wells of nations, nations as provinces.
_WELLS = f"""w0 AS (SELECT c_custkey AS well_id, {lat_sql('c_custkey')} AS lat, {lon_sql('c_custkey')} AS lon, c_nationkey AS prov,
    CAST(c_custkey % 3 = 0 AS INT) AS label, 1950 + c_custkey % 60 AS spud_year FROM customer),
w AS (SELECT w0.*, {xyz_sql('w0')} FROM w0),
f AS (SELECT prov AS fold FROM w GROUP BY 1 HAVING count(*) >= 30),
near AS (SELECT DISTINCT a.well_id, b.prov AS fold FROM w a JOIN w b ON a.prov <> b.prov AND {chord_sql('a', 'b')} <= {chord_of_km(200.0)!r} WHERE b.prov IN (SELECT fold FROM f)),
mem AS (SELECT f.fold, w.well_id, CASE WHEN w.prov = f.fold THEN 'test' WHEN n.well_id IS NOT NULL THEN 'dropped' ELSE 'train' END AS role
  FROM f CROSS JOIN w LEFT JOIN near n ON n.well_id = w.well_id AND n.fold = f.fold)"""


def customer_wells(t):
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("well_id"),
        lat_of("c_custkey").alias("lat"),
        lon_of("c_custkey").alias("lon"),
        F.concat(F.lit("N"), "c_nationkey").alias("province_name"),
        F.col("c_nationkey").alias("province_code"),
        (k % 3 == 0).cast("int").alias("label"),
        (k % 60 + 1950).cast("int").alias("spud_year"),
    )


@query("lopo_folds", f"WITH {_WELLS} SELECT 'N' || fold AS fold, role, count(*) AS n, CAST(sum(well_id) AS BIGINT) AS ids FROM mem GROUP BY ALL")
def lopo_folds(t):
    """Leave-one-province-out roles with a 200 km buffer, all folds in one job."""
    members = fo.leave_one_out(customer_wells(t), 30, 200.0)
    return members.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("well_id").alias("ids"))


@query(
    "fold_summary",
    f"""WITH {_WELLS} SELECT 'N' || fold AS fold, count(*) FILTER (role = 'test') AS n_test, count(*) FILTER (role = 'train') AS n_train,
        count(*) FILTER (role = 'dropped') AS n_buffer_dropped, {fix_sql("avg(label) FILTER (role = 'test')", 9)} AS test_base_rate FROM mem JOIN w USING (well_id) GROUP BY 1""",
)
def fold_summary(t):
    wells = customer_wells(t)
    out = fo.fold_summary(fo.leave_one_out(wells, 30, 200.0), wells)
    return out.withColumn("test_base_rate", fix("test_base_rate", 9))


@query(
    "temporal_split",
    f"WITH {MAPPED_SQL} SELECT CASE WHEN spud_year <= 1997 THEN 'train' ELSE 'test' END AS role, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM mapped GROUP BY 1",
)
def temporal_split(t):
    out = fo.temporal_split(mapped_wells(t), 1997)
    return out.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


# Five folds by key: small enough for the exhaustive SQL, shaped like the real thing.
_REF = f"""w0 AS (SELECT c_custkey AS well_id, {lat_sql('c_custkey')} AS lat, {lon_sql('c_custkey')} AS lon, c_nationkey AS prov,
    CAST(c_custkey % 3 = 0 AS INT) AS label, 1950 + c_custkey % 60 AS spud_year FROM customer),
w AS (SELECT w0.*, {xyz_sql('w0')} FROM w0),
mem AS (SELECT f, w.*, (prov % 3 <> f) AS train FROM (SELECT unnest([0, 1, 2]) AS f) CROSS JOIN w),
ref AS (SELECT * FROM mem WHERE train),
nn AS (SELECT p.f, p.well_id, r.label AS rl, {chord_sql('p', 'r')} AS ch,
         row_number() OVER (PARTITION BY p.f, p.well_id, r.label ORDER BY {chord_sql('p', 'r')}, r.well_id) AS i FROM mem p JOIN ref r ON r.f = p.f),
dist AS (SELECT n.f, n.well_id, rl, CASE WHEN any_value(m.train) AND min(ch) FILTER (i = 1) < 1e-8 THEN min(ch) FILTER (i = 2) ELSE min(ch) FILTER (i = 1) END AS ch
         FROM nn n JOIN mem m ON m.f = n.f AND m.well_id = n.well_id WHERE i <= 2 GROUP BY 1, 2, 3),
pr AS (SELECT f, prov, sum(label) AS s, count(*) AS n FROM ref GROUP BY 1, 2),
gl AS (SELECT f, sum(label) / count(*) AS g FROM ref GROUP BY 1)"""


def fold_members(t):
    """Three folds, each holding out the nations of one remainder."""
    wells = customer_wells(t)
    spread = wells.withColumn("f", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    pts = spread.withColumns(
        {"fold": F.concat(F.lit("f"), "f"), "in_reference": F.col("province_code") % 3 != F.col("f")}
    )
    return pts, pts.where("in_reference")


@query(
    "reference_features",
    f"""WITH {_REF} SELECT 'f' || m.f AS fold, m.well_id, {fix_sql(km_sql('a.ch'), 4)} AS dist_discovery_km, {fix_sql(km_sql('b.ch'), 4)} AS dist_dryhole_km,
          {fix_sql("CASE WHEN pr.n - m.train::INT > 0 THEN (pr.s - m.train::INT * m.label) / (pr.n - m.train::INT) ELSE g END", 7)} AS province_success_rate,
          {fix_sql("CASE WHEN pr.n IS NULL THEN 0 ELSE (SELECT count(*) FROM ref r WHERE r.f = m.f AND r.prov = m.prov AND r.spud_year < m.spud_year) / pr.n END", 7)} AS basin_maturity
        FROM mem m JOIN dist a ON a.f = m.f AND a.well_id = m.well_id AND a.rl = 1 JOIN dist b ON b.f = m.f AND b.well_id = m.well_id AND b.rl = 0
        LEFT JOIN pr ON pr.f = m.f AND pr.prov = m.prov JOIN gl ON gl.f = m.f""",
)
def reference_features(t):
    """Distances, success rate and maturity from each fold's training wells only."""
    out = ft.reference_features(*fold_members(t))
    return out.select(
        "fold", "well_id", fix("dist_discovery_km", 4).alias("dist_discovery_km"), fix("dist_dryhole_km", 4).alias("dist_dryhole_km"),
        fix("province_success_rate", 7).alias("province_success_rate"), fix("basin_maturity", 7).alias("basin_maturity"),
    )


_GRID = Grid(GRID_DEG)


@query(
    "static_features",
    f"""WITH {CELLS_SQL}, p AS (SELECT c_custkey AS well_id, CAST(floor((9e1 - {lat_sql('c_custkey')}) / 5e0) AS INT) AS row, CAST(floor(({lon_sql('c_custkey')} + 18e1) / 5e0) AS INT) AS col FROM customer),
        n AS (SELECT p.well_id, avg(b.v) AS mean, stddev_pop(b.v) AS std FROM p JOIN cells b ON abs(p.row - b.row) <= 1 AND least(abs(p.col - b.col), {N_COLS} - abs(p.col - b.col)) <= 1 GROUP BY 1)
        SELECT p.well_id, coalesce(c.v, -1) AS v, coalesce({fix_sql('mean', 5)}, -1) AS v_mean_near, coalesce({fix_sql('std', 5)}, -1) AS v_std_near,
          CASE WHEN c.v >= 125 THEN 0 WHEN c.v IS NULL THEN -1 ELSE 1 END AS water_depth_class FROM p LEFT JOIN cells c USING (row, col) LEFT JOIN n USING (well_id)""",
)
def static_features(t):
    """Channel under the well, its surroundings and the depth class."""
    c = cells(t).withColumn("e", F.col("v") - 125.0)
    pts = t.customer.select(F.col("c_custkey").alias("well_id"), lat_of("c_custkey").alias("lat"), lon_of("c_custkey").alias("lon"))
    out = ft.static_features(pts, c, _GRID, ["v", "e"], ["v"], {"near": 1}, elevation="e")
    gap = F.lit(-1.0)
    return out.select(
        "well_id", F.coalesce("v", gap).alias("v"), F.coalesce(fix("v_mean_near", 5), gap).alias("v_mean_near"),
        F.coalesce(fix("v_std_near", 5), gap).alias("v_std_near"), F.coalesce("water_depth_class", gap).cast("int").alias("water_depth_class"),
    )


@query(
    "feature_matrix",
    f"""WITH {CELLS_SQL}, p AS (SELECT c_custkey AS well_id, c_nationkey % 3 AS k, CAST(floor((9e1 - {lat_sql('c_custkey')}) / 5e0) AS INT) AS row, CAST(floor(({lon_sql('c_custkey')} + 18e1) / 5e0) AS INT) AS col FROM customer)
        SELECT 'f' || f AS fold, count(*) AS n, {fix_sql('coalesce(sum(v), 0)', 3)} AS total_v, count(v) AS n_v FROM p CROSS JOIN (SELECT unnest([0, 1, 2]) AS f) LEFT JOIN cells USING (row, col) GROUP BY 1""",
)
def feature_matrix(t):
    """Both feature families joined in a fixed order; summed per fold."""
    c = cells(t)
    pts = t.customer.select(F.col("c_custkey").alias("well_id"), lat_of("c_custkey").alias("lat"), lon_of("c_custkey").alias("lon"))
    static = ft.static_features(pts, c, _GRID, ["v"], ["v"], {"near": 1}, elevation="v")
    points, ref = fold_members(t)
    names = ["v", "v_mean_near", "v_std_near", "water_depth_class", "province_success_rate", "basin_maturity"]
    both = ft.province_success(points, ref).join(ft.basin_maturity(points, ref), ["fold", "well_id"])
    matrix = ft.feature_matrix(static, both, names)
    return matrix.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), fix(F.coalesce(F.sum("v"), F.lit(0.0)), 3).alias("total_v"), F.count("v").alias("n_v")
    )


# ---- metrics on labelled documents ------------------------------------------------------------

_SCORED = """sc AS (SELECT l.doc_id AS row_id, d.lang AS fold, l.quality AS label, (d.n_chars % 40) / 4e1 AS score FROM labels l JOIN documents d USING (doc_id))"""


def scored(t):
    """Labelled documents; a coarse score with many ties, folds by language."""
    return t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("fold"), F.col("quality").alias("label"),
        ((F.col("n_chars") % 40) / F.lit(40.0)).alias("score"),
    )


_METRICS = f"""{_SCORED}, al AS (SELECT * FROM sc UNION ALL SELECT row_id, 'pooled', label, score FROM sc),
tot AS (SELECT fold, count(*) AS n, sum(label) AS p, avg(power(score - label, 2)) AS brier FROM al GROUP BY 1),
g AS (SELECT fold, score, count(*) AS c, sum(label) AS tp FROM al GROUP BY 1, 2),
k AS (SELECT *, sum(c) OVER x AS cc, sum(tp) OVER x AS ct FROM g WINDOW x AS (PARTITION BY fold ORDER BY score DESC)),
ap AS (SELECT fold, sum(tp * ct / cc) / sum(tp) AS ap, sum((c - tp) * (ct - tp / 2e0)) AS u FROM k GROUP BY 1),
tops AS (SELECT fold, label, row_number() OVER (PARTITION BY fold ORDER BY score DESC, row_id) AS i FROM al),
lift AS (SELECT tops.fold, avg(label) AS prec FROM tops JOIN tot ON tot.fold = tops.fold WHERE i <= ceil(n / 1e1) GROUP BY 1),
met0 AS (SELECT t.fold, t.n, t.p > 0 AND t.p < t.n AS ok, t.p / t.n AS base_rate, ap, u, t.p AS p, brier, prec FROM tot t JOIN ap USING (fold) JOIN lift USING (fold)),
met AS (SELECT fold, n, base_rate, NOT ok AS skipped, CASE WHEN ok THEN ap END AS pr_auc, CASE WHEN ok THEN u / (p * (n - p)) END AS roc_auc,
  CASE WHEN ok THEN brier END AS brier, CASE WHEN ok THEN prec / base_rate END AS lift FROM met0)"""


@query(
    "fold_table",
    f"WITH {_METRICS} SELECT fold, n, {fix_sql('base_rate', 8)} AS base_rate, {fix_sql('pr_auc', 8)} AS pr_auc, {fix_sql('roc_auc', 8)} AS roc_auc, {fix_sql('brier', 8)} AS brier, {fix_sql('lift', 8)} AS lift_top_decile, skipped FROM met",
)
def fold_table(t):
    """All metrics per fold and pooled, in one job."""
    out = rk.fold_table(rk.validate_scores(scored(t)))
    cols = ["base_rate", "pr_auc", "roc_auc", "brier", "lift_top_decile"]
    return out.select("fold", "n", *[fix(c, 8).alias(c) for c in cols], "skipped")


@query("average_precision", f"WITH {_METRICS} SELECT fold, {fix_sql('pr_auc', 8)} AS pr_auc FROM met WHERE fold = 'pooled'")
def average_precision(t):
    return rk.pooled_metrics(scored(t)).select("fold", fix("pr_auc", 8).alias("pr_auc"))


@query("roc_auc", f"WITH {_METRICS} SELECT fold, {fix_sql('roc_auc', 8)} AS roc_auc FROM met WHERE fold = 'pooled'")
def roc_auc(t):
    return rk.pooled_metrics(scored(t)).select("fold", fix("roc_auc", 8).alias("roc_auc"))


@query("lift", f"WITH {_METRICS} SELECT fold, {fix_sql('lift', 8)} AS lift_top_decile FROM met")
def lift(t):
    return rk.fold_table(scored(t)).select("fold", fix("lift_top_decile", 8).alias("lift_top_decile"))


@query(
    "order_ranking",
    """WITH sc AS (SELECT o_orderkey AS row_id, o_orderpriority AS fold, CAST(o_custkey % 4 = 0 AS INT) AS label, round_even(o_totalprice / 1e3, 0) / 6e2 AS score FROM orders),
       g AS (SELECT fold, score, count(*) AS c, sum(label) AS tp FROM sc GROUP BY 1, 2), k AS (SELECT *, sum(c) OVER x AS cc, sum(tp) OVER x AS ct FROM g WINDOW x AS (PARTITION BY fold ORDER BY score DESC))
       SELECT fold, CAST(sum(c) AS BIGINT) AS n, """
    + fix_sql("sum(tp * ct / cc) / sum(tp)", 8)
    + """ AS pr_auc FROM k GROUP BY 1""",
)
def order_ranking(t):
    """Average precision over every order, folds by priority."""
    df = t.orders.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("fold"), (F.col("o_custkey") % 4 == 0).cast("int").alias("label"),
        (F.rint(F.col("o_totalprice") / 1000.0) / 600.0).alias("score"),
    )
    return rk.fold_table(df, pooled=False).select("fold", "n", fix("pr_auc", 8).alias("pr_auc"))


@query(
    "rank_calibrate",
    f"""WITH {_SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) AS rk, count(*) OVER (PARTITION BY fold, score) AS c, count(*) OVER (PARTITION BY fold) AS n FROM sc)
        SELECT row_id, {fix_sql('(rk + (c - 1) / 2e0) / n', 9)} AS calibrated FROM r""",
)
def rank_calibrate(t):
    return rk.rank_calibrate(scored(t)).select("row_id", fix("calibrated", 9).alias("calibrated"))


@query(
    "reliability",
    f"WITH {_SCORED} SELECT floor(score * 1e1 + 1e-9) / 1e1 AS bin_lo, (floor(score * 1e1 + 1e-9) + 1) / 1e1 AS bin_hi, {fix_sql('avg(score)', 7)} AS mean_score, {fix_sql('avg(label)', 7)} AS frac_positive, count(*) AS n FROM sc GROUP BY ALL",
)
def reliability(t):
    out = rk.reliability_bins(scored(t))
    return out.withColumns({"mean_score": fix("mean_score", 7), "frac_positive": fix("frac_positive", 7)})


@query(
    "calibration_summary",
    f"""WITH {_SCORED} SELECT {fix_sql('avg(power(score - label, 2))', 8)} AS brier_raw, {fix_sql('avg(power(score * score - label, 2))', 8)} AS brier_calibrated, true AS monotone FROM sc""",
)
def calibration_summary(t):
    df = scored(t).withColumn("squared", F.col("score") * F.col("score"))
    out = rk.calibration_summary(df, "label", "score", "squared")
    return out.withColumns({"brier_raw": fix("brier_raw", 8), "brier_calibrated": fix("brier_calibrated", 8)})


@query(
    "ranking_preserved",
    """WITH g AS (SELECT round_even(o_totalprice / 1e4, 0) AS r, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1),
       k AS (SELECT lo, max(hi) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM g)
       SELECT bool_and(coalesce(lo >= best - 1e-12, true)) AS monotone FROM k""",
)
def ranking_preserved(t):
    df = t.orders.select(F.rint(F.col("o_totalprice") / 10000.0).alias("raw"), F.col("o_totalprice").alias("cal"))
    return rk.ranking_preserved(df, "raw", "cal")


# ---- models: no SQL form, checked against closed properties in the tests -----------------------


@query("random_baseline")
def random_baseline(t):
    """A keyed uniform score for every well."""
    return customer_wells(t).select("well_id", m.random_score(7, "well_id").alias("score"))


def _logit_data(t):
    pts, _ = fold_members(t)
    x = F.abs("lat") + F.col("well_id") % 17
    p = (F.abs("lat") * 7 + F.col("well_id") * 13) % 100
    return pts.select(
        "fold", "well_id", x.alias("dist_discovery_km"), (p > F.abs("lat") + 10).cast("int").alias("label"),
        F.when(F.col("in_reference"), "train").otherwise("test").alias("role"),
    )


@query("distance_logit")
def distance_logit(t):
    """Slope and intercept of every fold from one aggregation per round."""
    return m.distance_logit(_logit_data(t).where("role = 'train'"))


@query("logit_scores")
def logit_scores(t):
    data = _logit_data(t)
    coef = m.distance_logit(data.where("role = 'train'"))
    return m.logit_score(data.where("role = 'test'"), coef).select("fold", "well_id", "label", "score")


def _fit_sql(rows: str) -> str:
    """Fit by its minimax form: the greatest, over starts, of the least mean up to an end."""
    return f"""g AS (SELECT score, count(*) AS n, sum(label) AS p FROM {rows} GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY score) AS cn, sum(p) OVER (ORDER BY score) AS cp FROM g),
m AS (SELECT a.score AS s0, b.score, (b.cp - a.cp + a.p) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.score <= b.score),
l AS (SELECT score, min(mean) OVER (PARTITION BY s0 ORDER BY score DESC) AS least FROM m),
fit AS (SELECT score, max(least) AS v FROM l GROUP BY 1)"""


@query(
    "isotonic",
    f"WITH {_SCORED}, {_fit_sql('sc')} SELECT row_id, label, score, {fix_sql('v', 9)} AS calibrated FROM sc JOIN fit USING (score)",
)
def isotonic(t):
    """Calibrated probability per labelled document."""
    df = scored(t)
    out = m.apply_isotonic(m.fit_isotonic(df), df)
    return out.select("row_id", "label", "score", fix("calibrated", 9).alias("calibrated"))


@query(
    "isotonic_steps",
    f"""WITH sc AS (SELECT CAST(l_returnflag = 'R' AS INT) AS label, floor(l_extendedprice / 1e2) AS score FROM lineitem), {_fit_sql('sc')}
        SELECT min(score) AS first, max(score) AS last, {fix_sql('v', 9)} AS value FROM fit GROUP BY v""",
)
def isotonic_steps(t):
    """Steps of the share of returned lines over their price."""
    lines = t.lineitem.select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.floor(F.col("l_extendedprice").cast("double") / 100.0).cast("double").alias("score"),
    )
    return m.fit_isotonic(lines).select("first", "last", fix("value", 9).alias("value"))


def _gate_rows(t):
    """Labelled documents as wells of their language, three features, every
    language held out once."""
    d = t.labels.join(t.documents.select("doc_id", "lang", "n_chars", "text"), "doc_id")
    base = d.select(
        F.col("doc_id").alias("well_id"), "lang", F.col("quality").alias("label"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.length(F.regexp_replace("text", "[^ ]", "")).cast("double").alias("n_spaces"),
        F.when(F.col("doc_id") % 5 > 0, (F.col("n_chars") % 97).cast("double")).alias("noise"),
    )
    base = materialize(base, "docs")
    langs = [r["lang"] for r in base.select("lang").distinct().orderBy("lang").collect()]
    fan = base.withColumn("fold", F.explode(F.array(*[F.lit(x) for x in langs])))
    return fan.withColumn("role", F.when(F.col("lang") == F.col("fold"), "test").otherwise("train"))


_FEATURES = ["n_chars", "n_spaces", "noise"]
#: Rounds of the registered fits, of the default depth; the operators' default is 50.
_ROUNDS = 20


@query("tree_scores")
def tree_scores(t):
    """Out-of-fold boosted-tree scores, one fit per language."""
    scores, _ = m.tree_scores(_gate_rows(t), _FEATURES, rounds=_ROUNDS)
    return scores


@query("importance_ranking")
def importance_ranking(t):
    _, gains = m.tree_scores(_gate_rows(t), _FEATURES, rounds=_ROUNDS)
    return m.importance_ranking(gains)


@query("permutation_importance")
def permutation_importance(t):
    """Loss of average precision per shuffled feature, on the held-out rows of every fold."""
    return m.permutation_by_fold(_gate_rows(t), _FEATURES, rounds=_ROUNDS)


@query("gbt_gate")
def gbt_gate(t):
    """Trees against the one-feature logit on two sets, raw and rank-calibrated."""
    rows = materialize(_gate_rows(t), "rows")
    scores, _ = m.tree_scores(rows, _FEATURES, rounds=_ROUNDS)
    coef = m.distance_logit(rows.where("role = 'train'"), x="n_chars")
    logit = m.logit_score(rows.where("role = 'test'"), coef, x="n_chars", out="logit")
    oof = materialize(
        scores.withColumnRenamed("score", "trees").join(logit.select("well_id", "logit"), "well_id"), "oof"
    )
    sets = {"all": oof, "part": oof.where("well_id % 3 <> 0")}
    metrics = None
    for name, df in sets.items():
        part = m.pooled_scores(df, ["trees", "logit"], name)
        metrics = part if metrics is None else metrics.unionByName(part)
    return m.gate(metrics, "trees", "logit")


@query(
    "gate_rule",
    """WITH x AS (SELECT o_orderstatus AS pooling, o_orderpriority AS dataset, max(o_totalprice) FILTER (o_custkey % 2 = 0) AS a, max(o_totalprice) FILTER (o_custkey % 2 = 1) AS b FROM orders GROUP BY 1, 2)
       SELECT pooling, bool_and(a > b) AS passed, count(*) AS n_sets, count(*) FILTER (a > b) AS n_won FROM x GROUP BY 1""",
)
def gate_rule(t):
    """The gate itself: won only if won on every set."""
    metrics = t.orders.select(
        F.col("o_orderstatus").alias("pooling"), F.col("o_orderpriority").alias("dataset"),
        F.when(F.col("o_custkey") % 2 == 0, "trees").otherwise("logit").alias("model"), F.col("o_totalprice").alias("pr_auc"),
    )
    return m.gate(metrics, "trees", "logit")


@query(
    "permuted_feature",
    "SELECT count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS total, CAST(sum(c_nationkey * c_nationkey) AS BIGINT) AS squares FROM customer",
)
def permuted_feature(t):
    """A shuffled column keeps its values; only their rows change."""
    out = m.permuted(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), "c_nationkey", "c_custkey", 7)
    x = F.col("c_nationkey").cast("long")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"))


@query(
    "eligible_folds",
    f"WITH {MAPPED_SQL} SELECT province_name, count(*) AS n FROM mapped WHERE NOT excluded AND purpose = 'wildcat' GROUP BY 1 HAVING count(*) >= 30",
)
def eligible(t):
    """Provinces with enough wells to be held out."""
    prim = w.primary_set(mapped_wells(t))
    ok = fo.eligible_folds(prim).withColumnRenamed("fold", "province_name")
    return prim.groupBy("province_name").agg(F.count(F.lit(1)).alias("n")).join(ok, "province_name")


@query(
    "basin_maturity_gaps",
    f"""WITH ref AS (SELECT p_brand AS prov, CASE WHEN p_size % 5 <> 0 THEN p_size END AS y FROM part WHERE p_partkey % 2 = 0),
        g AS (SELECT prov, count(*) AS n FROM ref GROUP BY 1), r AS (SELECT prov, y, count(*) AS k FROM ref WHERE y IS NOT NULL GROUP BY 1, 2),
        e AS (SELECT p_partkey, sum(r.k) AS k FROM part JOIN r ON r.prov = p_brand AND r.y < p_size GROUP BY 1)
        SELECT p.p_partkey AS well_id, {fix_sql("CASE WHEN g.n IS NULL THEN 0e0 ELSE coalesce(e.k, 0) * 1e0 / g.n END", 7)} AS basin_maturity
        FROM part p LEFT JOIN g ON g.prov = p.p_brand LEFT JOIN e USING (p_partkey) WHERE p.p_partkey % 2 = 1""",
)
def basin_maturity_gaps(t):
    """References without a year: in the total, never earlier."""
    p = t.part.select(
        F.lit("f").alias("fold"), F.col("p_partkey").alias("well_id"), F.col("p_brand").alias("province_code"), F.col("p_size").alias("spud_year")
    )
    reference = p.where("well_id % 2 = 0").withColumn("spud_year", F.when(F.col("spud_year") % 5 != 0, F.col("spud_year")))
    out = ft.basin_maturity(p.where("well_id % 2 = 1"), reference)
    return out.select("well_id", fix("basin_maturity", 7).alias("basin_maturity"))
