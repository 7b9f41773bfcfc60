"""Ranking metrics over scores of any number, per fold and pooled.

Rows are first reduced to one row per (fold, distinct score); cumulative counts
then come from ``ordered.prefix``, so the pooled set is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.operators.contracts import Guard, guard
from basinframe.operators.ordered import prefix
from basinframe.session import materialize

POOLED = "pooled"


def input_guards(label: str = "label", score: str = "score") -> list[Guard]:
    y, s = F.col(label), F.col(score).cast("double")
    return [
        Guard("label must be 0 or 1", y.isNull() | ~y.isin(0, 1)),
        Guard("score must be finite", s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))),
    ]


def validate_scores(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    guard(df, "scores", input_guards(label, score), empty="no scored rows")
    return df


def _by_score(df: DataFrame, fold: str, label: str, score: str) -> DataFrame:
    return df.groupBy(F.col(fold).cast("string").alias("fold"), F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )


def _with_pool(groups: DataFrame) -> DataFrame:
    pooled = groups.groupBy("score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return groups.unionByName(pooled.select(F.lit(POOLED).alias("fold"), "score", "n", "pos"))


def fold_table(
    df: DataFrame,
    fold: str = "fold",
    label: str = "label",
    score: str = "score",
    row_id: str = "row_id",
    pooled: bool = True,
) -> DataFrame:
    """One row per fold and one pooled row over all folds.

    ``pr_auc`` is average precision, ``roc_auc`` gives ties half weight, ``lift``
    is precision in the top ``ceil(n / 10)`` rows over the base rate with ties in
    ``row_id`` order. A fold of one class is marked skipped and has no metrics,
    but its rows count in the pool.
    """
    groups = _by_score(df, fold, label, score)
    groups = _with_pool(groups) if pooled else groups
    cum = materialize(
        prefix(groups, ["fold"], ["-score"], sums={"n_above": "n", "pos_above": "pos"}), "scores"
    )
    totals = cum.groupBy("fold").agg(F.sum("n").alias("n_all"), F.sum("pos").alias("pos_all"))
    n, pos = F.col("n"), F.col("pos")
    precision = (F.col("pos_above") + pos) / (F.col("n_above") + n)
    neg_all = F.col("n_all") - F.col("pos_all")
    top = F.ceil(F.col("n_all") / 10.0)
    ranked = cum.join(totals, "fold").withColumn("__top", top)
    metrics = ranked.groupBy("fold").agg(
        F.first("n_all").alias("n"),
        F.first("pos_all").alias("pos"),
        (F.sum(pos * precision) / F.nullif(F.first("pos_all"), F.lit(0))).alias("ap"),
        (
            F.sum((n - pos) * (F.col("pos_above") + pos / 2.0))
            / F.nullif(F.first(F.col("pos_all") * neg_all), F.lit(0))
        ).alias("auc"),
        F.first("__top").alias("top"),
        F.sum(F.when(F.col("n_above") + n <= F.col("__top"), pos).otherwise(0)).alias("top_pos"),
    )
    # The one tie group that straddles the cut, opened row by row.
    edge = ranked.where((F.col("n_above") < F.col("__top")) & (F.col("n_above") + n > F.col("__top")))
    edge = edge.select("fold", "score", (F.col("__top") - F.col("n_above")).alias("room"))
    rows = df.select(
        F.col(fold).cast("string").alias("fold"),
        F.col(score).cast("double").alias("score"),
        F.col(label).cast("long").alias("y"),
        F.col(row_id).alias("rid"),
    )
    rows = rows.unionByName(rows.withColumn("fold", F.lit(POOLED))) if pooled else rows
    tied = prefix(rows.join(edge, ["fold", "score"]), ["fold"], ["rid"], ordinal="i")
    part = tied.where(F.col("i") <= F.col("room")).groupBy("fold").agg(F.sum("y").alias("edge_pos"))
    brier = _brier(df, fold, label, score, pooled)
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    base = F.col("pos") / F.col("n")
    hits = F.col("top_pos") + F.coalesce("edge_pos", F.lit(0))
    out = metrics.join(part, "fold", "left").join(brier, "fold")
    return out.select(
        "fold",
        "n",
        base.alias("base_rate"),
        F.when(both, F.col("ap")).alias("pr_auc"),
        F.when(both, F.col("auc")).alias("roc_auc"),
        F.when(both, F.col("brier")).alias("brier"),
        F.when(both, hits / F.col("top") / base).alias("lift_top_decile"),
        (~both).alias("skipped"),
    )


def _brier(df: DataFrame, fold: str, label: str, score: str, pooled: bool) -> DataFrame:
    err = F.pow(F.col(score).cast("double") - F.col(label), 2)
    g = df.groupBy(F.col(fold).cast("string").alias("fold")).agg(
        F.sum(err).alias("__e"), F.count(F.lit(1)).alias("__n")
    )
    if pooled:
        g = g.unionByName(
            g.agg(F.sum("__e").alias("__e"), F.sum("__n").alias("__n")).select(
                F.lit(POOLED).alias("fold"), "__e", "__n"
            )
        )
    return g.select("fold", (F.col("__e") / F.col("__n")).alias("brier"))


def pooled_metrics(df: DataFrame, **cols) -> DataFrame:
    return fold_table(df, **cols).where(F.col("fold") == POOLED)


def rank_calibrate(df: DataFrame, fold: str = "fold", score: str = "score", out: str = "calibrated") -> DataFrame:
    """Within-fold percentile rank in (0, 1]; ties share their average rank."""
    s = F.col(score).cast("double")
    groups = df.groupBy(F.col(fold).alias("__f"), s.alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    cum = prefix(groups, ["__f"], ["__s"], sums={"__below": "__n"})
    size = groups.groupBy("__f").agg(F.sum("__n").alias("__all"))
    rank = cum.join(size, "__f").select(
        "__f", "__s", ((F.col("__below") + (F.col("__n") + 1) / 2.0) / F.col("__all")).alias(out)
    )
    on = (df[fold] == rank["__f"]) & (s == rank["__s"])
    return df.join(rank, on).drop("__f", "__s")


def reliability_bins(df: DataFrame, n_bins: int = 10, label: str = "label", score: str = "score") -> DataFrame:
    """Uniform bins on [0, 1], closed below, the last closed above; empty bins absent."""
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    edges = [i / n_bins for i in range(n_bins + 1)]
    s = F.col(score).cast("double")
    # Exact comparisons with the edges; multiplying by n_bins would drift.
    b: Column = F.lit(0)
    for i in range(1, n_bins):
        b = F.when(s >= edges[i], F.lit(i)).otherwise(b)
    lookup = F.array(*[F.lit(e) for e in edges])
    g = df.groupBy(b.alias("bin")).agg(
        F.avg(s).alias("mean_score"),
        F.avg(F.col(label).cast("double")).alias("frac_positive"),
        F.count(F.lit(1)).alias("n"),
    )
    return g.select(
        lookup[F.col("bin")].alias("bin_lo"),
        lookup[F.col("bin") + 1].alias("bin_hi"),
        "mean_score",
        "frac_positive",
        "n",
    )


def ranking_preserved(df: DataFrame, raw: str, calibrated: str, atol: float = 1e-12) -> DataFrame:
    """One row, ``monotone``: a higher raw score never has a lower calibrated one."""
    groups = df.groupBy(F.col(raw).alias("r")).agg(
        F.min(calibrated).alias("lo"), F.max(calibrated).alias("hi")
    )
    chained = prefix(groups, [], ["r"], maxes={"best": "hi"})
    ok = F.coalesce(F.col("lo") >= F.col("best") - atol, F.lit(True))
    return chained.agg(F.bool_and(ok).alias("monotone"))


def calibration_summary(df: DataFrame, label: str, raw: str, calibrated: str) -> DataFrame:
    y = F.col(label)
    brier = df.agg(
        F.avg(F.pow(F.col(raw) - y, 2)).alias("brier_raw"),
        F.avg(F.pow(F.col(calibrated) - y, 2)).alias("brier_calibrated"),
    )
    mono = ranking_preserved(df, raw, calibrated)
    one = F.lit(1).alias("k")
    return brier.select(one, "*").join(mono.select(one, "*"), "k").drop("k")
