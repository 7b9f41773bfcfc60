"""A quality score learned from trusted positives and unlabelled text.

No negatives are used. With the logistic loss l the risk of a score f is
``prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])``: the second term is the
risk on negatives, estimated from unlabelled rows less the positives among them, and is
kept from falling below zero, where it would only be overfit. All expectations are sums
over all rows, added up by Spark; the driver sees one vector of them a round.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.llm.common import chunks, id_ddl, table_columns, utf8
from basinframe.llm.repeats import stored

#: Marks whose share of a text is a feature of its own; fixed values of this module.
_MARKS = (b".", b",", b"!", b"?", b"|", b"#$%&*", b"<>", b"=+~^", b"/\\_@", b"()[]{}", b"\"'`", b":;", b"-")
_TABLES = [bytes(set(range(256)) - set(m)) for m in _MARKS]
_UPPER, _LOWER, _DIGIT = (bytes(set(range(256)) - set(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
_HIGH = bytes(range(128))
_BARE = re.compile(rb"[^A-Za-z\x80-\xff]+")
N_FEATURES = len(_MARKS) + 20


def features_of(text: bytes) -> list[float]:
    """Shares and shapes of one whole text, each about between 0 and 1, none of them about
    its language or subject. An empty text has zeros and a flag."""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    if not n:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    share = lambda table: len(text.translate(None, table)) / size
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    triples = Counter(zip(words, words[1:], words[2:]))
    again = lambda c: sum(v for v in c.values() if v > 1) / max(sum(c.values()), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    short = sum(len(x) < 30 for x in lines)
    upper, lower = share(_UPPER), share(_LOWER)
    bare = [w for w in words if not _BARE.sub(b"", w)]
    ends = sum(w[-1:] not in b".,;:?" and w[-1] < 128 and not w[-1:].isalnum() for w in words)
    found = [share(t) ** 0.5 for t in _TABLES]
    found += [
        upper / max(upper + lower, 1e-9),
        sum(w.upper() == w and w.lower() != w for w in words) / n,
        share(_DIGIT) ** 0.5,
        share(_HIGH) ** 0.5,
        len(bare) / n,
        ends / n,
        len(counts) / n,
        max(counts.values()) / n,
        again(pairs),
        again(triples),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        min(sum(map(len, words)) / n / 20, 2.0),
        sum(len(w) <= 3 for w in words) / n,
        sum(len(w) > 20 for w in words) / n,
        len(lines) / n,
        short / len(lines),
        1 - len(set(lines)) / len(lines),
        min(np.log1p(n) / 10, 2.0),
        float(n < 50),
        0.0,
    ]
    return found


@dataclass
class QualityModel:
    """Weights of the features as they are, the last one of a constant, and the class prior."""

    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _squash(x @ self.weights[:-1] + self.weights[-1])


def _squash(z):
    return 0.5 * (1 + np.tanh(z / 2))


def _totals(rows: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows (x, kind) of what ``fn`` gives for a slice of them.

    Each task adds up its slices and hands on one vector; vectors are added by place in
    one more shuffle, so that the driver receives ``size`` numbers whatever the tasks.
    """

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                total += fn(x, batch.column(1).to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "v"])

    found = rows.select("x", "kind").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for at, v in sorted(map(tuple, found.collect())):
        out[at] = v
    return out


def _standard(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Mean and deviation of the features over unlabelled rows, and both classes' sizes."""
    d = N_FEATURES

    def fn(x, kind):
        u = x[(kind & 2) > 0]
        return np.concatenate([u.sum(0), (u * u).sum(0), [len(u), ((kind & 1) > 0).sum()]])

    total = _totals(rows, fn, 2 * d + 2)
    n_u, n_p = total[-2:]
    mean = total[:d] / max(n_u, 1)
    spread = np.sqrt(np.maximum(total[d : 2 * d] / max(n_u, 1) - mean**2, 0))
    return mean, np.where(spread > 1e-9, spread, 1.0), float(n_u), float(n_p)


def _risk_sums(rows: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> dict[str, np.ndarray]:
    """Per class the sums of l(f), l(-f), their gradients and the curvature."""
    d = N_FEATURES + 1
    part = 2 + 2 * d + d * d

    def fn(x, kind):
        out = []
        for bit in (1, 2):
            own = x[(kind & bit) > 0]
            z = np.hstack([(own - mean) / scale, np.ones((len(own), 1))])
            f = np.clip(z @ w, -500, 500)
            s = _squash(f)
            curve = (z * (s * (1 - s))[:, None]).T @ z
            out += [[np.logaddexp(0, -f).sum(), np.logaddexp(0, f).sum()], z.T @ (s - 1), z.T @ s, curve.ravel()]
        return np.concatenate(out)

    total = _totals(rows, fn, 2 * part)
    found = {}
    for name, own in (("p", total[:part]), ("u", total[part:])):
        found[name] = (own[0], own[1], own[2 : 2 + d], own[2 + d : 2 + 2 * d], own[2 + 2 * d :].reshape(d, d))
    return found


def _descend(
    rows: DataFrame,
    stats,
    risk_of: Callable[[dict], tuple[float, np.ndarray, np.ndarray]],
    ridge: float,
    rounds: int,
    start: np.ndarray,
) -> np.ndarray:
    """Damped Newton steps: a step that raises the risk is halved, from the better place."""
    mean, scale = stats[:2]
    pull = np.append(np.full(N_FEATURES, ridge), ridge * 1e-3)
    best, best_risk, step, trial = start, np.inf, np.zeros_like(start), start
    for _ in range(rounds):
        risk, slope, curve = risk_of(_risk_sums(rows, trial, mean, scale))
        risk += 0.5 * float(pull @ trial**2)
        if risk > best_risk + 1e-12:
            step = step / 4
        else:
            done = best_risk - risk < 1e-7
            best, best_risk = trial, risk
            if done:
                break
            step = -np.linalg.solve(curve + np.diag(pull), slope + pull * trial)
            step *= min(1.0, 10.0 / max(np.abs(step).max(), 1e-12))
        trial = best + step
    return best


def _against_unlabelled(sums, stats):
    """Positives against unlabelled rows, each class with weight one half."""
    n_u, n_p = stats[2:]
    p, u = sums["p"], sums["u"]
    return (p[0] / n_p + u[1] / n_u) / 2, (p[2] / n_p + u[3] / n_u) / 2, (p[4] / n_p + u[4] / n_u) / 2


def _non_negative(sums, stats, prior: float):
    """The risk with the negatives' part kept from below zero.

    Where that part is negative, the way back is along its own slope, as full batches
    would otherwise go on lowering it.
    """
    n_u, n_p = stats[2:]
    p, u = sums["p"], sums["u"]
    positive, negative = prior * p[0] / n_p, u[1] / n_u - prior * p[1] / n_p
    curve = u[4] / n_u
    if negative >= 0:
        return positive + negative, prior * p[2] / n_p + u[3] / n_u - prior * p[3] / n_p, curve
    return positive, -(u[3] / n_u - prior * p[3] / n_p), curve + prior * p[4] / n_p


def estimate_prior(rows: DataFrame, model: QualityModel, bins: int = 1000, delta: float = 0.1) -> float:
    """Share of positives among unlabelled rows, by the best bin of the score.

    Over each threshold, the share of unlabelled rows above it divided by that of the
    positives bounds the prior from above; the threshold is the one with the least bound
    when its sampling error is added. Scores are counted in ``bins`` on the executors.
    """

    def fn(x, kind):
        at = np.minimum((model.score(x) * bins).astype(int), bins - 1)
        return np.concatenate([np.bincount(at[(kind & b) > 0], minlength=bins) for b in (1, 2)]).astype(float)

    total = _totals(rows, fn, 2 * bins)
    p, u = (np.cumsum(part[::-1]) for part in (total[:bins], total[bins:]))
    if not p[-1] or not u[-1]:
        return 0.5
    error = np.sqrt(np.log(4 / delta) / 2 / u[-1]) + np.sqrt(np.log(4 / delta) / 2 / p[-1])
    p, u = p / p[-1], u / u[-1]
    at = np.flatnonzero(p > 0)
    best = at[np.argmin((u[at] + 1.01 * error) / p[at])]
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit_positive_unlabelled(rows: DataFrame, ridge: float = 1e-3, rounds: int = 12) -> QualityModel | None:
    """Fit on rows (x, kind, fold): kind 1 is a positive, 2 an unlabelled row, 3 both.

    Positives against unlabelled rows of fold 0 give a score, the class prior comes from
    that score on fold 1, and the non-negative risk is then minimised over all rows. None
    if a class has no rows.
    """
    first = rows.where("fold = 0")
    stats = _standard(rows)
    half = (*stats[:2], *_standard(first)[2:])
    if min(stats[2:]) < 1:
        return None
    start = np.zeros(N_FEATURES + 1)
    prior = 0.5
    if min(half[2:]) >= 1:
        rough = _descend(first, half, lambda s: _against_unlabelled(s, half), ridge, rounds, start)
        prior = estimate_prior(rows.where("fold = 1"), _plain(rough, stats, 0.5))
    start[-1] = np.log(prior / (1 - prior))
    weights = _descend(rows, stats, lambda s: _non_negative(s, stats, prior), ridge, rounds, start)
    return _plain(weights, stats, prior)


def _plain(weights, stats, prior) -> QualityModel:
    mean, scale = stats[:2]
    own = weights[:-1] / scale
    return QualityModel(np.append(own, weights[-1] - own @ mean), prior)


def held_out_id(column: Column) -> Column:
    """Whether labels of this id may not be learned from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 3 == 1


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, x) of every document, features of its whole text; no shuffle."""
    rows = table_columns(docs, id=id_col, text=text_col).select("id", utf8("text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 4 << 20):
                x = pa.array(np.array([features_of(t) for t in part.column(1).to_pylist()], np.float32).ravel())
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * N_FEATURES)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, x)], names=["id", "x"])

    return rows.mapInArrow(run, f"{id_ddl(rows, 'id')}, x array<float>")


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ridge: float = 1e-3,
    rounds: int = 12,
) -> DataFrame:
    """Per input row the id, ``held_out``, ``score`` (0 to 1, higher: likelier good), ``predicted``.

    Positives are rows of ids outside the held-out third that ``labels`` (doc_id, quality)
    marks 1 and never 0; all other labels stay unseen. Unlabelled text is every row of
    those ids, labelled or not. Ids, languages and sources are no features. The fit reads
    all rows of stored features, some 20 rounds of one sum each.

    A null text is an empty one and is scored as such; repeated rows repeat; without
    positives or other text every score is 0.5; no documents give no rows. Long texts cost
    time in proportion, other columns are ignored.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id"))
    good = marks.agg(F.min("quality").alias("least"), F.max("quality").alias("most")).where("least = 1 and most = 1")
    good = good.where(~held_out_id(F.col("id"))).select("id", F.lit(1).alias("good"))
    rows = stored(text_features(docs, id_col, text_col).withColumn("held_out", held_out_id(F.col("id"))), "features")
    fit = rows.where("not held_out").join(good, "id", "left").select(
        "x",
        (F.coalesce("good", F.lit(0)) + 2).cast("int").alias("kind"),
        (F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("/fold"))) % 2).alias("fold"),
    )
    model = fit_positive_unlabelled(stored(fit, "fit"), ridge, rounds)
    model = model or QualityModel(np.zeros(N_FEATURES + 1), 0.5)

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            score = model.score(x)
            columns = [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "score", "predicted"])

    ddl = f"{id_ddl(rows, 'id')}, held_out boolean, score double, predicted int"
    return rows.mapInArrow(run, ddl).withColumnRenamed("id", id_col)
