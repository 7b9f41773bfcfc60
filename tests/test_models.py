import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from basinframe.functions.geo import chord_of_km
from basinframe.operators import features as ft
from basinframe.operators import folds as fo
from basinframe.operators import models as m
from basinframe.operators import ranking as rk


def scores(spark, y, s, fold="f"):
    df = pd.DataFrame({"row_id": range(len(y)), "label": y, "score": s, "fold": fold})
    return spark.createDataFrame(df)


def average_precision(y, s):
    """Step over every distinct threshold, the textbook sum."""
    total = 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        at = s == t
        total += y[at].sum() / y.sum() * (y[hit].sum() / hit.sum())
    return total


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_metrics_with_ties(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 205)
    s = rng.integers(0, 12, 205) / 12.0
    row = {r["fold"]: r for r in rk.fold_table(scores(spark, y, s)).collect()}["f"]
    assert row["pr_auc"] == pytest.approx(average_precision(y, s))
    assert row["roc_auc"] == pytest.approx(auc(y, s))
    assert row["brier"] == pytest.approx(np.mean((s - y) ** 2))
    top = np.argsort(-s, kind="stable")[:21]
    assert row["lift_top_decile"] == pytest.approx(y[top].mean() / y.mean())


def test_one_hot_score_is_split_by_row_order(spark):
    """Every row has the same score: the top decile is the first rows."""
    y = np.array([1, 1, 0, 1] + [0, 1] * 18)
    row = rk.fold_table(scores(spark, y, np.full(40, 0.5)), pooled=False).first()
    assert row["lift_top_decile"] == pytest.approx(y[:4].mean() / y.mean())


def test_single_class_fold_is_skipped_but_pooled(spark):
    a = scores(spark, [0, 1, 0], [0.1, 0.9, 0.4], "a")
    b = scores(spark, [1, 1], [0.8, 0.2], "b")
    rows = {r["fold"]: r for r in rk.fold_table(a.unionByName(b)).collect()}
    assert rows["b"]["skipped"] and rows["b"]["pr_auc"] is None and rows["b"]["n"] == 2
    assert rows["pooled"]["n"] == 5 and not rows["pooled"]["skipped"]


def test_bad_scores_raise(spark):
    with pytest.raises(Exception, match="0 or 1"):
        rk.validate_scores(scores(spark, [0, 2], [0.1, 0.2]))
    with pytest.raises(Exception, match="finite"):
        rk.validate_scores(scores(spark, [0, 1], [0.1, float("inf")]))


def test_reliability_edges(spark):
    got = rk.reliability_bins(scores(spark, [0, 1, 1, 0], [0.0, 0.3, 1.0, 0.95])).orderBy("bin_lo").collect()
    assert [(round(r["bin_lo"], 1), r["n"]) for r in got] == [(0.0, 1), (0.3, 1), (0.9, 2)]


def test_rank_calibration_averages_ties(spark):
    out = rk.rank_calibrate(scores(spark, [0, 0, 1, 1], [0.2, 0.5, 0.5, 0.9])).orderBy("row_id")
    assert [r["calibrated"] for r in out.collect()] == [0.25, 0.625, 0.625, 1.0]


def test_ranking_preserved(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.2, 0.2), (0.3, 0.1)], "raw double, cal double")
    assert rk.ranking_preserved(df.where("raw < 0.25"), "raw", "cal").first()["monotone"] is True
    assert rk.ranking_preserved(df, "raw", "cal").first()["monotone"] is False


def test_logit_is_the_penalised_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(40, 400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(0.05 * x - 1))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"fold": "a", "dist_discovery_km": x, "label": y}))
    ours = m.distance_logit(df).first()
    vec = VectorAssembler(inputCols=["dist_discovery_km"], outputCol="features").transform(df)
    lr = LogisticRegression(regParam=1 / 400, standardization=False, tol=1e-12, maxIter=500).fit(vec)
    assert ours["slope"] == pytest.approx(lr.coefficients[0], rel=1e-4)
    assert ours["intercept"] == pytest.approx(lr.intercept, rel=1e-4)
    flat = spark.createDataFrame([("b", 1.0, 1), ("b", 2.0, 1)], "fold string, dist_discovery_km double, label int")
    assert m.distance_logit(df.unionByName(flat)).select("fold").collect() == [("a",)]


def test_isotonic_is_monotone_and_clips(spark):
    rng = np.random.default_rng(4)
    s = rng.uniform(size=200)
    y = (rng.uniform(size=200) < s).astype(int)
    df = scores(spark, y, s)
    model = m.fit_isotonic(df)
    out = m.apply_isotonic(model, df)
    summary = rk.calibration_summary(out, "label", "score", "calibrated").first()
    assert summary["monotone"] and summary["brier_calibrated"] <= summary["brier_raw"]
    wide = m.apply_isotonic(model, scores(spark, [0, 1], [-5.0, 5.0])).select("calibrated").collect()
    assert all(0 <= r[0] <= 1 for r in wide)
    with pytest.raises(ValueError, match="both present"):
        m.fit_isotonic(scores(spark, [1, 1], [0.1, 0.2]))


def pooled(points):
    """Plain pool-adjacent-violators over (score, label): [first, last, positives, rows]."""
    out = []
    for x in sorted({s for s, _ in points}):
        ys = [y for s, y in points if s == x]
        out.append([x, x, sum(ys), len(ys)])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return out


@pytest.mark.parametrize("width", ["1", "3", "20"])
def test_isotonic_pools_over_partitions(spark, width):
    rng = np.random.default_rng(int(width))
    s = rng.integers(0, 300, 900) / 300
    s[:300] = 0.5  # a third of the rows share one score
    y = (rng.uniform(size=900) < 0.2 + 0.6 * s).astype(int)
    df = scores(spark, y.tolist(), s.tolist())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        steps = m.fit_isotonic(df)
        got = sorted(tuple(r) for r in steps.select("first", "last", "value").collect())
        want = pooled(list(zip(s.tolist(), y.tolist(), strict=True)))
        assert [g[:2] for g in got] == [tuple(w[:2]) for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] / w[3] for w in want])
        at = m.apply_isotonic(steps, df).select("score", "calibrated").collect()
        assert len(at) == 900
        for x, v in at:
            assert v == pytest.approx(next(w[2] / w[3] for w in want if w[0] <= x <= w[1]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_isotonic_between_and_beyond_steps(spark):
    steps = m.fit_isotonic(scores(spark, [0, 0, 1, 1], [0.0, 1.0, 3.0, 4.0]))
    asked = spark.createDataFrame(
        [(1, -9.0), (2, 0.5), (3, 1.5), (4, 2.0), (5, 9.0), (6, None), (7, float("nan")), (8, float("-inf"))],
        "i int, score double",
    )
    got = dict(m.apply_isotonic(steps, asked).select("i", "calibrated").collect())
    assert got == {1: 0.0, 2: 0.0, 3: 0.25, 4: 0.5, 5: 1.0, 6: None, 7: None, 8: 0.0}


def test_random_score_ignores_partitioning(spark):
    df = spark.range(500)
    a = df.coalesce(1).select("id", m.random_score(7, "id").alias("s"))
    b = df.repartition(8).select("id", m.random_score(7, "id").alias("s"))
    assert a.exceptAll(b).count() == 0
    lo, hi, mean = a.agg(F.min("s"), F.max("s"), F.avg("s")).first()
    assert 0 <= lo and hi < 1 and abs(mean - 0.5) < 0.05


def test_gate_needs_both_sets(spark):
    rows = [("raw", "primary", "trees", 0.6), ("raw", "primary", "logit", 0.5), ("raw", "ex", "trees", 0.4), ("raw", "ex", "logit", 0.45)]
    df = spark.createDataFrame(rows, "pooling string, dataset string, model string, pr_auc double")
    assert m.gate(df, "trees", "logit").first()["passed"] is False
    assert m.gate(df.where("dataset = 'primary'"), "trees", "logit").first()["passed"] is True


# ---- folds and fold-scoped features -----------------------------------------------------------


@pytest.fixture(scope="module")
def wells(spark):
    rng = np.random.default_rng(8)
    rows = []
    for prov, n, lat0 in (("A", 40, 10.0), ("B", 35, 12.0), ("C", 5, 40.0), ("(unassigned)", 60, -20.0)):
        for i in range(n):
            rows.append((f"{prov}{i}", lat0 + rng.normal(0, 1), rng.normal(0, 1), prov, ord(prov[0]), int(rng.integers(0, 2)), int(rng.integers(1960, 2000))))
    rows.append(("near", rows[0][1], rows[0][2] + 10 / 111.0, "C", 67, 1, 1990))
    return spark.createDataFrame(rows, "well_id string, lat double, lon double, province_name string, province_code int, label int, spud_year int")


def test_folds_keep_the_buffer(spark, wells):
    members = fo.leave_one_out(wells).toPandas()
    pdf = wells.toPandas().set_index("well_id")
    assert sorted(members.fold.unique()) == ["A", "B"]
    assert members.groupby(["fold", "well_id"]).size().max() == 1
    for fold, part in members.groupby("fold"):
        test = pdf[pdf.province_name == fold]
        assert set(part[part.role == "test"].well_id) == set(test.index)
        rest = pdf[pdf.province_name != fold]
        la, lo = np.radians(pdf.lat), np.radians(pdf.lon)
        xyz = pd.DataFrame({"x": np.cos(la) * np.cos(lo), "y": np.cos(la) * np.sin(lo), "z": np.sin(la)})
        d = np.sqrt(((xyz.loc[rest.index].values[:, None] - xyz.loc[test.index].values[None]) ** 2).sum(2)).min(1)
        keep = set(rest.index[d > chord_of_km(50.0)])
        assert set(part[part.role == "train"].well_id) == keep
    assert "near" in set(members[(members.fold == "A") & (members.role == "dropped")].well_id)


def test_reference_features_self_rule(spark):
    """Twin discoveries, a lone dry well, and a province with a single reference."""
    rows = [
        ("f", "d1", 10.0, 10.0, 1, 1, 1990, True),
        ("f", "d2", 10.0, 10.0, 1, 1, 1995, True),
        ("f", "d3", 10.0, 11.0, 1, 1, 2000, True),
        ("f", "y1", 10.0, 10.0, 1, 0, 1985, True),
        ("f", "y2", 20.0, 20.0, 2, 0, 1999, True),
        ("f", "t", 10.0, 10.0, 9, 1, None, False),
        ("f", "u", 10.0, 10.0, 1, 1, None, False),
    ]
    pts = spark.createDataFrame(rows, "fold string, well_id string, lat double, lon double, province_code int, label int, spud_year int, in_reference boolean")
    out = {r["well_id"]: r for r in ft.reference_features(pts, pts.where("in_reference")).collect()}
    assert out["d1"]["dist_discovery_km"] == 0.0  # a twin stays although the well itself is skipped
    assert out["d3"]["dist_discovery_km"] == pytest.approx(109.5, abs=0.2)
    assert out["y1"]["dist_discovery_km"] == 0.0  # dry on a twin discovery: one skipped, one left
    assert out["y1"]["dist_dryhole_km"] > 1000  # itself skipped, the other dry well is far
    assert out["t"]["dist_dryhole_km"] == 0.0  # a test well skips nothing
    assert out["d1"]["province_success_rate"] == pytest.approx(2 / 3)
    assert out["y2"]["province_success_rate"] == pytest.approx(3 / 5)  # alone: the overall rate, itself included
    assert out["t"]["province_success_rate"] == pytest.approx(3 / 5)
    assert out["d2"]["basin_maturity"] == pytest.approx(2 / 4)
    assert out["t"]["basin_maturity"] == 0.0 and out["u"]["basin_maturity"] == 1.0


def test_temporal_split(spark):
    df = spark.createDataFrame([(1999,), (2000,), (2001,), (None,)], "spud_year int")
    assert [r["role"] for r in fo.temporal_split(df, 2000).orderBy("spud_year").collect()] == ["train", "train", "test"]


def test_feature_names():
    assert len(ft.FEATURE_NAMES) == 33 and len(set(ft.FEATURE_NAMES)) == 33


def test_permutation_importance_finds_the_signal(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 300)
    pdf = pd.DataFrame({"well_id": range(300), "label": y, "signal": y + rng.normal(0, 0.3, 300), "noise": rng.normal(size=300)})
    df = spark.createDataFrame(pdf)
    got = m.permutation_importance(df, df, ["signal", "noise"], rounds=5, depth=2).collect()
    assert got[0]["feature"] == "signal" and got[0]["importance"] > 0.2
    assert len(got) == 2 and abs(got[1]["importance"]) < 0.05


def test_permutations_are_pooled_over_folds(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 400)
    base = pd.DataFrame({"well_id": range(400), "label": y, "signal": y + rng.normal(0, 0.3, 400), "noise": rng.normal(size=400)})
    part = np.where(base.well_id < 100, "a", np.where(base.well_id < 390, "b", "c"))
    base.loc[base.well_id >= 390, "label"] = 1
    parts = [base.assign(fold=f, role=np.where(part == f, "test", "train")) for f in "abc"]
    rows = spark.createDataFrame(pd.concat(parts))
    got = {r["feature"]: r for r in m.permutation_by_fold(rows, ["signal", "noise"], rounds=3, depth=2).collect()}
    assert {r["n_rows"] for r in got.values()} == {390}
    each = []
    for f in "ab":
        own = rows.where(F.col("fold") == f)
        lost = m.permutation_importance(own.where("role = 'train'"), own.where("role = 'test'"), ["signal", "noise"], rounds=3, depth=2)
        each.append({r["feature"]: r["importance"] for r in lost.collect()})
    for name, r in got.items():
        assert r["importance"] == pytest.approx((each[0][name] * 100 + each[1][name] * 290) / 390)
    assert m.permutation_by_fold(rows.where("fold = 'c'"), ["signal", "noise"]).count() == 0


def test_permuted_column_keeps_its_values(spark):
    df = spark.range(200).select("id", (F.col("id") % 17).alias("v"))
    out = m.permuted(df, "v", "id", 3)
    assert sorted(r["v"] for r in out.collect()) == sorted(r["v"] for r in df.collect())
    assert out.join(df.withColumnRenamed("v", "w"), "id").where("v <> w").count() > 100


def test_a_lone_discovery_has_no_other(spark):
    """The only discovery of a fold is left out of its own distance: nothing remains."""
    rows = [("f", "d", 10.0, 10.0, 1, 1, 1990, True), ("f", "y", 11.0, 10.0, 1, 0, 1991, True)]
    pts = spark.createDataFrame(rows, "fold string, well_id string, lat double, lon double, province_code int, label int, spud_year int, in_reference boolean")
    out = {r["well_id"]: r for r in ft.reference_features(pts, pts.where("in_reference")).collect()}
    assert out["d"]["dist_discovery_km"] is None and out["y"]["dist_dryhole_km"] is None
    assert out["y"]["dist_discovery_km"] == pytest.approx(111.195, abs=0.001)
