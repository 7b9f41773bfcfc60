"""The score learned from positives and unlabelled text: slopes, prior, held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from basinframe.llm import positive
from basinframe.llm.queries import QUERIES

D = positive.N_FEATURES


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def made_rows(spark, rng, n=3000, prior=0.7):
    """Two normal classes in the first features; a third of the positives is known."""
    draw = np.random.default_rng(rng.random.__self__.randrange(1 << 30))
    good = draw.random(n) < prior
    x = draw.normal(size=(n, D)) + np.where(good, 1.5, -1.5)[:, None] * (np.arange(D) < 3)
    kind = np.where(good & (draw.random(n) < 0.3), 3, 2)
    rows = pa.table({"x": list(x.astype(np.float32)), "kind": pa.array(kind, pa.int32()), "fold": np.arange(n) % 2})
    return spark.createDataFrame(rows).repartition(4), good, x


def sums_of(x, kind, w, mean, scale):
    out = {}
    for name, bit in (("p", 1), ("u", 2)):
        own = x[(kind & bit) > 0]
        z = np.hstack([(own - mean) / scale, np.ones((len(own), 1))])
        f = z @ w
        s = 1 / (1 + np.exp(-f))
        out[name] = (np.log1p(np.exp(-f)).sum(), np.log1p(np.exp(f)).sum(), z.T @ (s - 1), z.T @ s, (z * (s * (1 - s))[:, None]).T @ z)
    return out


def test_sums_and_slopes(spark, rng):
    rows, _, _ = made_rows(spark, rng, 200)
    held = rows.toPandas()
    x, kind = np.array(held.x.tolist(), float), held.kind.to_numpy()
    stats = positive._standard(rows)
    w = np.linspace(-0.2, 0.3, D + 1)
    got, want = positive._risk_sums(rows, w, *stats[:2]), sums_of(x, kind, w, *stats[:2])
    for k in "pu":
        for a, b in zip(got[k], want[k], strict=True):
            assert np.allclose(a, b, rtol=1e-5, atol=1e-6)
    for risk in (lambda s: positive._against_unlabelled(s, stats), lambda s: positive._non_negative(s, stats, 0.3)):
        slope = risk(want)[1]
        for j in (0, 5, D):
            step = np.zeros(D + 1)
            step[j] = 1e-5
            ahead, behind = (risk(sums_of(x, kind, w + s, *stats[:2]))[0] for s in (step, -step))
            assert abs((ahead - behind) / 2e-5 - slope[j]) < 1e-4


def test_negative_part_never_counts_below_zero(spark, rng):
    rows, _, _ = made_rows(spark, rng, 200)
    stats = positive._standard(rows)
    sums = positive._risk_sums(rows, np.append(np.zeros(D), 3.0), *stats[:2])
    risk, slope, _ = positive._non_negative(sums, stats, 1.0)
    assert risk >= 0
    negative = sums["u"][1] / stats[2] - 1.0 * sums["p"][1] / stats[3]
    if negative < 0:
        assert risk == pytest.approx(sums["p"][0] / stats[3])
        assert np.allclose(slope, -(sums["u"][3] / stats[2] - sums["p"][3] / stats[3]))


def test_prior_and_classes_of_a_mixture(spark, rng):
    rows, good, x = made_rows(spark, rng, 4000)
    model = positive.fit_positive_unlabelled(rows)
    assert abs(model.prior - good.mean()) < 0.08
    assert ((model.score(x.astype(np.float32)) >= 0.5) == good).mean() > 0.97
    assert positive.fit_positive_unlabelled(rows.where("kind = 2")) is None


def test_query_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    out = QUERIES["op11_quality_score"](spark, folder)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = out.join(labels, "doc_id").toPandas()
    assert (rows.held_out == rows.doc_id.map(held_out)).all() and rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.5)).all()
    rows = rows[rows.held_out]
    assert len(rows) > 80 and set(rows.quality) == {0, 1}
    assert rows[rows.quality == 1].predicted.mean() > 0.97 and rows[rows.quality == 0].predicted.mean() < 0.1


def test_labels_that_must_not_be_seen(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end quality")
    seen = lambda which: {r["doc_id"]: r["score"] for r in positive.score_quality(docs, which, rounds=3).collect()}
    a, b = seen(labels), seen(flipped)
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_scores_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(20)] + [(2, 1), (3, None), (None, 1)], "doc_id long, quality int"
    )
    out = positive.score_quality(odd_docs, labels, rounds=4).collect()
    assert sorted(r["doc_id"] or -1 for r in out) == sorted(r[0] or -1 for r in odd_rows)
    assert all(0 <= r["score"] <= 1 and np.isfinite(r["score"]) for r in out)
    by_id = {r["doc_id"]: r for r in out}
    assert not by_id[None]["held_out"] and by_id[0]["score"] == by_id[1]["score"]
    none = positive.score_quality(odd_docs, labels.where("false"), rounds=4).collect()
    assert {r["score"] for r in none} == {0.5}
    assert positive.score_quality(no_docs, labels).count() == 0


def test_features_are_finite():
    texts = [b"", b" \n", b"a", b"\xff\xfe x", b"### $$$ | |", b"the " * 5000, "É!! ÈA!!".encode(), b"x" * 100_000]
    x = np.array([positive.features_of(t) for t in texts])
    assert x.shape == (len(texts), D) and np.isfinite(x).all() and x[0, -1] == 1 and x[2, -1] == 0
