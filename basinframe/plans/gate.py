"""Gate run: folds, fold-scoped features, trees and baselines, pooled comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinframe.functions.codes import PROXY_SOURCE
from basinframe.operators import features as ft
from basinframe.operators import models as m
from basinframe.operators.folds import BUFFER_KM, MIN_WELLS, fold_summary, leave_one_out
from basinframe.operators.ranking import fold_table
from basinframe.session import materialize

MODELS = ["trees", "baseline_distance", "baseline_random", "baseline_sediment"]


@dataclass
class Run:
    oof: DataFrame
    folds: DataFrame
    pooled: DataFrame
    importances: DataFrame


def cross_validate(
    wells: DataFrame,
    static: DataFrame,
    dataset: str,
    *,
    features: list[str] | None = None,
    min_wells: int = MIN_WELLS,
    buffer_km: float = BUFFER_KM,
    seed: int = 7,
    rounds: int = 50,
    depth: int = 5,
) -> Run:
    """Out-of-fold scores of the trees and three baselines. Features of all folds are
    one job; only the tree fit runs fold by fold."""
    members = materialize(leave_one_out(wells, min_wells, buffer_km), "members")
    points, reference = ft.reference_roles(members, wells)
    scoped = ft.reference_features(points, reference)
    matrix = scoped.join(static, "well_id").join(
        members.select("fold", "well_id", "role"), ["fold", "well_id"]
    ).join(wells.select("well_id", "label"), "well_id")
    matrix = materialize(matrix, "matrix")
    names = features or [c for c in ft.FEATURE_NAMES if c in matrix.columns]
    trees, gains = m.tree_scores(matrix, names, seed=seed, rounds=rounds, depth=depth)
    train = matrix.where("role = 'train'")
    coef = m.distance_logit(train)
    test = matrix.where("role = 'test'")
    scored = m.logit_score(test, coef, out="baseline_distance").withColumns(
        {
            "baseline_random": m.random_score(seed, "fold", "well_id"),
            "baseline_sediment": m.sediment_score("sed_thickness_m")
            if "sed_thickness_m" in matrix.columns
            else F.lit(0.0),
        }
    )
    oof = trees.withColumnRenamed("score", "trees").join(
        scored.select("fold", "well_id", *MODELS[1:]), ["fold", "well_id"]
    )
    oof = materialize(oof, "oof")
    table = fold_table(oof, score="trees", row_id="well_id").join(fold_summary(members, wells), "fold", "left")
    return Run(oof, table, m.pooled_scores(oof, MODELS, dataset), m.importance_ranking(gains))


def gate_run(wells: DataFrame, static: DataFrame, proxy: str = PROXY_SOURCE, **options) -> tuple[DataFrame, dict[str, Run]]:
    """The gate on the main set and on the set without the proxy source: passed only
    if the trees win on both."""
    runs = {
        "primary": cross_validate(wells, static, "primary", **options),
        "ex_proxy": cross_validate(wells.where(F.col("source_id") != proxy), static, "ex_proxy", **options),
    }
    metrics = runs["primary"].pooled.unionByName(runs["ex_proxy"].pooled)
    return m.gate(metrics, "trees", "baseline_distance"), runs
