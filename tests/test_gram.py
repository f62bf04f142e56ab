"""Ridge fits from sums of products against fits on the rows themselves."""

import numpy as np
import pytest

from gridprobe.operators import gram


def table(spark, x, y, split):
    rows = [(s, float(b) if b is not None else None, [float(c) for c in a]) for a, b, s in zip(x, y, split)]
    return spark.createDataFrame(rows, "split string, y double, embedding array<float>").repartition(5)


def plain(x, y, decay, scaled):
    """Weights and intercept by least squares on rows, with the penalty as further rows."""
    centre, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1) if scaled else np.ones(x.shape[1])
    z, n = (x - centre) / scale, len(x)
    more = np.sqrt(decay * n) * np.eye(x.shape[1])
    w = np.linalg.lstsq(np.vstack((z, more)), np.concatenate((y - y.mean(), np.zeros(x.shape[1]))), rcond=None)[0] / scale
    return w, y.mean() - w @ centre


def test_every_decay_and_scaling(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 1, (300, 6)) * [1, 3, 0.2, 1, 1, 1] + 1000).astype(np.float32).astype(float)
    x[:, 5] = 7
    y = x[:, 0] - 2 * x[:, 2] + rng.normal(0, 0.5, 300)
    split = np.array(["train", "valid", "test"])[np.arange(300) % 3]
    fits = gram.ridge(gram.gram(table(spark, x, y, split)), [0.0, 1e-3, 1.0])
    assert [(f["standardised"], f["decay"]) for f in fits] == [(s, d) for s in (True, False) for d in (0.0, 1e-3, 1.0)]
    own = split == "train"
    for f in fits:
        w, b = plain(x[own], y[own], f["decay"], f["standardised"])
        assert f["weights"] == pytest.approx(w, abs=1e-6) and f["intercept"] == pytest.approx(b, abs=1e-3)
        for name, s in f["scores"].items():
            part = split == name
            gap = y[part] - x[part] @ w - b
            assert s["n"] == part.sum() and s["loss"] == pytest.approx((gap**2).mean(), rel=1e-6)
            assert s["r2"] == pytest.approx(1 - (gap**2).mean() / y[part].var(), abs=1e-6)


def test_sums_merge(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=40)
    row = gram.gram(table(spark, x, y, ["train"] * 40)).first()
    z = np.concatenate((np.ones((40, 1)), np.column_stack((x.astype(np.float32), y)) - row["origin"]), axis=1)
    assert row["n"] == 40 and np.array(row["products"]).reshape(5, 5) == pytest.approx(z.T @ z)


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [("train", 1.0, [1.0, 2.0]), ("train", 3.0, [2.0, 1.0]), ("train", None, [1.0, 1.0]), ("train", 1.0, None),
         ("train", 1.0, [None, 1.0]), ("valid", 2.0, [1.0, 1.0])], "split string, y double, embedding array<float>")
    scores = {r["split"]: r for r in gram.ridge_scores(gram.gram(df), [0.1], (False,)).collect()}
    assert scores["train"]["n"] == 2 and scores["valid"]["n"] == 1 and scores["valid"]["r2"] is None
    assert gram.gram(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="no rows of train"):
        gram.ridge(gram.gram(df.filter("split = 'valid'")), [0.1])
    mixed = df.union(spark.createDataFrame([("train", 1.0, [1.0])], df.schema))
    with pytest.raises(Exception, match="are not all"):
        gram.gram(mixed).collect()
    wide = spark.createDataFrame([("train", 1.0, [0.0] * (gram.WIDEST + 1))], df.schema)
    with pytest.raises(ValueError, match="components"):
        gram.gram(wide)
