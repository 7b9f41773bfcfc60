"""Isotonic calibration over any number of scores, nothing of it on the driver.

The best non-decreasing fit is the slope of the lower convex hull of the points
(rows up to a score, positives up to it). A point that is not on the hull of its own
range of scores is not on the hull of all, so ranges drop their points on their own and
neighbouring ranges then merge, eight at a time. Edges of a hull have different slopes,
each a fraction of whole numbers, so the hull of n rows has at most about
0.9 * n**(2/3) edges: a million for 10^9 rows. That bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinframe.operators.ordered import prefix
from basinframe.operators.ranking import validate_scores
from basinframe.session import materialize, shuffle_width

FAN_IN = 8
_POINT = "rows long, positives long, score double, next_score double"
_STEP = "reach double, first double, last double, value double, next_first double, next_value double"


def _points(scored: DataFrame, label: str, score: str) -> tuple[DataFrame, tuple]:
    """One point per distinct score, counted down from the highest score, and the point
    below all scores. Counts from the top differ from those from below by a constant."""
    x = F.col(score).cast("double") + F.lit(0.0)
    per_score = scored.groupBy(x.alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")
    )
    per_score = materialize(per_score, "scores")
    total = per_score.agg(F.sum("n"), F.sum("p"), F.min("score")).first()
    if total[0] is None or not 0 < total[1] < total[0]:
        raise ValueError("isotonic calibration needs labels 0 and 1, both present")
    above = prefix(
        per_score, [], ["-score"], sums={"na": "n", "pa": "p"}, lags={"next_score": "score"}, label="above"
    )
    points = above.select((-F.col("na")).alias("rows"), (-F.col("pa")).alias("positives"), "score", "next_score")
    return points, (-total[0], -total[1], None, total[2])


def _hull(batches: Iterator[pd.DataFrame], below: tuple | None) -> list[tuple]:
    """Vertices of the lower hull of points that come in order of score."""
    kept = [below] if below else []
    for batch in batches:
        for c in zip(*(batch[k].tolist() for k in ("rows", "positives", "score", "next_score")), strict=True):
            # Whole numbers of any size, so a turn is never misjudged.
            while len(kept) > 1:
                a, b = kept[-2], kept[-1]
                if (b[0] - a[0]) * (c[1] - a[1]) > (b[1] - a[1]) * (c[0] - a[0]):
                    break
                kept.pop()
            kept.append(c)
    return kept


def _thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield pd.DataFrame(_hull(batches, None), columns=["rows", "positives", "score", "next_score"])


def _steps(batches: Iterator[pd.DataFrame], below: tuple) -> Iterator[pd.DataFrame]:
    v = _hull(batches, below)
    out = [(a[3], b[2], (b[1] - a[1]) / (b[0] - a[0])) for a, b in zip(v, v[1:], strict=False)]
    after = [(s[0], s[2]) for s in out[1:]] + [(None, None)]
    reach = [float("-inf")] + [s[0] for s in out[1:]]
    rows = [(r, *s, *n) for r, s, n in zip(reach, out, after, strict=True)]
    yield pd.DataFrame(rows, columns=["reach", "first", "last", "value", "next_first", "next_value"])


def fit_isotonic(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Steps of the fit: ``first`` and ``last`` score, ``value`` between them, the
    score that ``reach``-es it (all below the first step do), and where the next starts. Labels are 0 or 1, both present, scores finite; otherwise it raises."""
    valid = validate_scores(scored, label, score)
    points, below = _points(valid, label, score)
    width = shuffle_width(scored.sparkSession)
    while width > 1:
        ranged = points.repartitionByRange(width, "rows").sortWithinPartitions("rows")
        points = materialize(ranged.mapInPandas(_thin, _POINT), "hull")
        width = -(-width // FAN_IN)
    one = points.repartition(1).sortWithinPartitions("rows")
    return materialize(one.mapInPandas(partial(_steps, below=below), _STEP), "steps")


def apply_isotonic(steps: DataFrame, scored: DataFrame, score: str = "score", out: str = "calibrated") -> DataFrame:
    """Adds the fitted value. Between two steps it is on the line from the end of one to the
    start of the next; scores outside the fitted range take its end values, a null or NaN
    score gets null. Rows and steps are one sequence of scores, so no score owns a task."""
    x = F.col(score).cast("double")
    knots = steps.select(F.col("reach").alias("__x"), F.lit(0).alias("__rank"), F.struct(*steps.columns).alias("__step"))
    rows = scored.withColumns({"__x": F.when(~F.isnan(x), x), "__rank": F.lit(1), "__salt": F.monotonically_increasing_id()})
    both = rows.unionByName(knots, allowMissingColumns=True)
    at = prefix(both, [], ["__x", "__rank", "__salt"], maxes={"__at": "__step"}, label="calibrate").where("__rank = 1")
    gap = F.col("__at.next_first") - F.col("__at.last")
    slope = (F.col("__at.next_value") - F.col("__at.value")) / gap
    value = (
        F.when(F.col("__x").isNull(), None)
        .when((F.col("__x") <= F.col("__at.last")) | F.col("__at.next_first").isNull(), F.col("__at.value"))
        .otherwise(F.col("__at.value") + slope * (F.col("__x") - F.col("__at.last")))
    )
    return at.select(*[F.col(c) for c in scored.columns], value.alias(out))
