"""Baselines, isotonic calibration, boosted trees and the gate between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.functions.scalars import threshold_score
from basinframe.operators.contracts import Guard, guard
from basinframe.operators.isotonic import apply_isotonic, fit_isotonic
from basinframe.operators.ordered import prefix
from basinframe.operators.ranking import fold_table, rank_calibrate
from basinframe.session import materialize, small_table


def random_score(seed: int, *ids: str) -> Column:
    """Uniform in [0, 1) from the row's own key: the same under any partitioning."""
    h = F.xxhash64(F.lit(seed), *[F.col(i) for i in ids])
    return F.pmod(h, F.lit(2**52)) / F.lit(float(2**52))


def sediment_score(thickness: str, threshold: float = 500.0) -> Column:
    return threshold_score(thickness, threshold)


def distance_logit(
    train: DataFrame,
    fold: str = "fold",
    x: str = "dist_discovery_km",
    label: str = "label",
    rounds: int = 50,
    tol: float = 1e-10,
) -> DataFrame:
    """Logistic regression of the label on one distance, for all folds at once.

    The slope carries an L2 penalty of weight one, the intercept none. Each Newton
    round is one aggregation to five sums per fold over the cached pairs; folds
    with a single class are left out.
    """
    guard(
        train,
        "distance_logit",
        [Guard("distance must be finite", F.col(x).isNull() | F.isnan(x))],
        empty="no training rows",
    )
    # Equal pairs count once with a weight.
    pairs = materialize(
        train.groupBy(F.col(fold).alias("fold"), F.col(x).cast("double").alias("x")).agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("pos")
        ),
        "logit",
    )
    stats = pairs.groupBy("fold").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"),
        (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"),
        F.sqrt(F.sum(F.col("n") * F.col("x") * F.col("x")) / F.sum("n")).alias("size"),
    )
    spark = train.sparkSession
    # One row of coefficients per fold, as many as there are provinces.
    coef = {
        r["fold"]: (0.0, 0.0, r["size"] or 1.0)
        for r in stats.where((F.col("pos") > 0) & (F.col("pos") < F.col("n"))).collect()
    }
    schema = "fold string, w double, b double, s double"
    pairs = pairs.withColumn("fold", F.col("fold").cast("string"))
    coef = {str(k): v for k, v in coef.items()}
    for _ in range(rounds):
        state = small_table(spark, [(f, *v) for f, v in coef.items()], schema)
        z = F.col("x") / F.col("s")
        p = 1.0 / (1.0 + F.exp(-(F.col("w") * z + F.col("b"))))
        q = F.col("n") * p * (1.0 - p)
        g = F.col("n") * p - F.col("pos")
        sums = (
            pairs.join(state, "fold")
            .groupBy("fold")
            .agg(
                F.sum(g * z).alias("gw"), F.sum(g).alias("gb"),
                F.sum(q * z * z).alias("hww"), F.sum(q * z).alias("hwb"), F.sum(q).alias("hbb"),
            )
            .collect()
        )
        step = 0.0
        for r in sums:
            w, b, s = coef[r["fold"]]
            # Penalty 0.5 * (w / s)^2 on the slope in original units.
            gw, hww = r["gw"] + w / s**2, r["hww"] + 1.0 / s**2
            det = hww * r["hbb"] - r["hwb"] ** 2
            dw = (r["hbb"] * gw - r["hwb"] * r["gb"]) / det
            db = (hww * r["gb"] - r["hwb"] * gw) / det
            size = max(abs(dw), abs(db))
            damp = 1.0 if size <= 5.0 else 5.0 / size
            coef[r["fold"]] = (w - damp * dw, b - damp * db, s)
            step = max(step, size)
        if step < tol:
            break
    rows = [(f, w / s, b) for f, (w, b, s) in coef.items()]
    return small_table(spark, rows, "fold string, slope double, intercept double")


def logit_score(df: DataFrame, coef: DataFrame, fold: str = "fold", x: str = "dist_discovery_km", out: str = "score") -> DataFrame:
    p = 1.0 / (1.0 + F.exp(-(F.col("slope") * F.col(x) + F.col("intercept"))))
    keyed = coef.withColumnRenamed("fold", "__f")
    return (
        df.join(keyed, df[fold].cast("string") == keyed["__f"])
        .withColumn(out, p)
        .drop("__f", "slope", "intercept")
    )


def impute(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Missing values become 0 beside a missing flag; trees split on the flag."""
    flags = {f"{f}__missing": F.col(f).isNull().cast("double") for f in features}
    filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    return df.withColumns({**flags, **filled}), [*features, *flags]


def tree_scores(
    rows: DataFrame,
    features: Sequence[str],
    fold: str = "fold",
    role: str = "role",
    label: str = "label",
    row_id: str = "well_id",
    seed: int = 7,
    rounds: int = 50,
    depth: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold scores, feature importances), one boosted-tree fit per fold.

    ``rows`` holds every fold's train and test rows, told apart by ``role``.
    Folds with a single training class are skipped.
    """
    ready, cols = impute(rows, features)
    packed = VectorAssembler(inputCols=cols, outputCol="__x").transform(ready)
    packed = materialize(packed.select(fold, row_id, role, label, "__x"), "matrix")
    classes = (
        packed.where(F.col(role) == "train").groupBy(fold).agg(F.count_distinct(label).alias("k"))
    )
    names = [r[fold] for r in classes.where("k = 2").orderBy(fold).collect()]
    scored, gains = None, []
    for name in names:
        part = packed.where(F.col(fold) == name)
        model = GBTClassifier(
            featuresCol="__x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1,
            subsamplingRate=0.9, seed=seed,
        ).fit(part.where(F.col(role) == "train"))
        gains += [(str(name), c, float(v)) for c, v in zip(cols, model.featureImportances.toArray(), strict=True)]
        out = model.transform(part.where(F.col(role) == "test")).select(
            fold, row_id, label, vector_to_array("probability")[1].alias("score")
        )
        scored = out if scored is None else scored.unionByName(out)
    spark = rows.sparkSession
    return scored, small_table(spark, gains, "fold string, feature string, importance double")


def importance_ranking(gains: DataFrame, n: int = 20) -> DataFrame:
    mean = gains.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return mean.orderBy(F.desc("importance"), "feature").limit(n)


def permuted(rows: DataFrame, feature: str, row_id: str, seed: int) -> DataFrame:
    """``rows`` with one feature dealt out anew by two keyed orders."""
    keyed = rows.withColumns(
        {"__a": F.xxhash64(F.col(row_id), F.lit(seed)), "__b": F.xxhash64(F.col(row_id), F.lit(seed + 1))}
    )
    left = prefix(keyed.drop("__b"), [], ["__a", row_id], ordinal="__i").drop(feature, "__a")
    right = prefix(keyed.select("__b", row_id, feature), [], ["__b", row_id], ordinal="__i").select("__i", feature)
    return left.join(right, "__i").drop("__i")


def permutation_importance(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str = "label",
    row_id: str = "well_id",
    seed: int = 7,
    rounds: int = 50,
    depth: int = 5,
) -> DataFrame:
    """``feature, importance``: average precision lost on the test rows when one
    feature is dealt out anew. All features are dealt and scored in one job; only
    rows times features are ever made."""
    names = list(features)
    ready, cols = impute(train, names)
    pack = VectorAssembler(inputCols=cols, outputCol="__x")
    model = GBTClassifier(
        featuresCol="__x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed
    ).fit(pack.transform(ready).select("__x", label))
    rows = materialize(test.select(row_id, label, *names), "rows")
    cells = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("dealt")) for n in names]
    )
    long = rows.select(row_id, F.explode(cells).alias("c")).select(row_id, "c.feature", "c.dealt")

    def in_order(salt: int, keep: list[str]) -> DataFrame:
        keyed = long.withColumn("__h", F.xxhash64("feature", row_id, F.lit(salt)))
        return prefix(keyed, ["feature"], ["__h", row_id], ordinal="__i").select("feature", "__i", *keep)

    dealt = in_order(seed, [row_id]).join(in_order(seed + 1, ["dealt"]), ["feature", "__i"])
    changed = rows.join(dealt, row_id).withColumns(
        {n: F.when(F.col("feature") == n, F.col("dealt")).otherwise(F.col(n).cast("double")) for n in names}
    )
    variants = changed.select("feature", row_id, label, *names).unionByName(
        rows.select(F.lit("").alias("feature"), row_id, label, *[F.col(n).cast("double").alias(n) for n in names])
    )
    scored = model.transform(pack.transform(impute(variants, names)[0])).select(
        F.col("feature").alias("fold"), row_id, label, vector_to_array("probability")[1].alias("score")
    )
    table = fold_table(materialize(scored, "scored"), row_id=row_id, label=label, pooled=False)
    base = table.where("fold = ''").select(F.lit(1).alias("k"), F.col("pr_auc").alias("base"))
    lost = table.where("fold <> ''").withColumn("k", F.lit(1)).join(base, "k")
    return lost.select(F.col("fold").alias("feature"), (F.col("base") - F.col("pr_auc")).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )


def permutation_by_fold(
    rows: DataFrame,
    features: Sequence[str],
    fold: str = "fold",
    role: str = "role",
    label: str = "label",
    row_id: str = "well_id",
    seed: int = 7,
    rounds: int = 50,
    depth: int = 5,
) -> DataFrame:
    """``feature, importance, n_rows``: what :func:`permutation_importance` finds on the
    held-out rows of every fold, weighted by their number.

    Folds whose train or test rows are of one class have no precision to lose and are
    skipped, as in :func:`tree_scores`.
    """
    rows = materialize(rows.select(fold, role, label, row_id, *features), "folds")
    sizes = rows.groupBy(fold, role).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("k")).collect()
    both = {r[fold] for r in sizes if r["k"] == 2 and r[role] == "train"}
    tests = sorted((r[fold], r["n"]) for r in sizes if r["k"] == 2 and r[role] == "test" and r[fold] in both)
    pooled = None
    for name, n in tests:
        part = rows.where(F.col(fold) == name)
        lost = permutation_importance(
            part.where(F.col(role) == "train"), part.where(F.col(role) == "test"), features, label, row_id, seed, rounds, depth
        )
        lost = lost.withColumn("n", F.lit(n).cast("long"))
        pooled = lost if pooled is None else pooled.unionByName(lost)
    if pooled is None:
        return small_table(rows.sparkSession, [], "feature string, importance double, n_rows bigint")
    mean = F.sum(F.col("importance") * F.col("n")) / F.sum("n")
    out = pooled.groupBy("feature").agg(mean.alias("importance"), F.sum("n").alias("n_rows"))
    return out.orderBy(F.desc("importance"), "feature")


def gate(metrics: DataFrame, model: str, opponent: str) -> DataFrame:
    """Whether the model beats the opponent on average precision in every set.

    ``metrics``: ``pooling, dataset, model, pr_auc``. One row per pooling rule.
    """
    wide = metrics.groupBy("pooling", "dataset").agg(
        F.max(F.when(F.col("model") == model, F.col("pr_auc"))).alias("challenger"),
        F.max(F.when(F.col("model") == opponent, F.col("pr_auc"))).alias("opponent"),
    )
    won = F.coalesce(F.col("challenger") > F.col("opponent"), F.lit(False))
    return wide.groupBy("pooling").agg(
        F.bool_and(won).alias("passed"), F.count(F.lit(1)).alias("n_sets"), F.count_if(won).alias("n_won")
    )


def pooled_scores(oof: DataFrame, models: Sequence[str], dataset: str, row_id: str = "well_id") -> DataFrame:
    """``pooling, dataset, model, pr_auc``, raw and rank-calibrated within folds.

    All models are ranked together: model and fold share one key.
    """
    long = oof.select(
        "fold", "label", row_id,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("score")) for m in models])
        ).alias("s"),
    ).select("fold", "label", F.col(row_id).alias("row_id"), "s.model", "s.score").dropna(subset=["score"])
    long = materialize(long, "oof")
    ranked = rank_calibrate(
        long.withColumn("mf", F.concat_ws("|", "model", "fold")), fold="mf", out="ranked"
    ).drop("mf")
    both = long.select(F.lit("raw").alias("pooling"), "model", "label", "row_id", "score").unionByName(
        ranked.select(F.lit("rank").alias("pooling"), "model", "label", "row_id", F.col("ranked").alias("score"))
    )
    key = F.concat_ws("|", "pooling", "model")
    table = fold_table(both.withColumn("fold", key), pooled=False)
    name = F.split("fold", r"\|")
    return table.select(
        name[0].alias("pooling"), F.lit(dataset).alias("dataset"), name[1].alias("model"), "pr_auc"
    )
