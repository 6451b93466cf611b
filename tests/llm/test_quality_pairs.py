"""F14 of round 4: quality is learned from every pair of labelled texts."""

import numpy as np

from pointmill.llm import quality_ranking as qr
from pointmill.llm.learning import logistic_fit


def test_sums_over_nodes_are_sums_over_all_pairs():
    rng = np.random.default_rng(4)
    z, y = rng.normal(size=(400, qr.MEASURES)), rng.integers(0, 2, 400)
    w = rng.normal(size=qr.MEASURES)
    s = z @ w
    nodes = qr.nodes_of(s.min(), s.max())
    gradient, curve = qr.pair_step(sum(qr.pair_sums(z[k::3], y[k::3], w, nodes) for k in range(3)))
    g, b = qr.preference_pairs(int((y == 1).sum()), int((y == 0).sum()), 1000)
    apart = z[y == 1][g] - z[y == 0][b]
    p = 1 / (1 + np.exp(-(apart @ w)))
    np.testing.assert_allclose(gradient, apart.T @ (1 - p), rtol=1e-9, atol=1e-8)
    np.testing.assert_allclose(curve, (apart * (p * (1 - p))[:, None]).T @ apart, rtol=1e-9, atol=1e-8)


def test_fit_takes_all_pairs(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(300) < 0.7).astype(int)
    x = rng.random((300, qr.MEASURES)) + 0.3 * y[:, None] * (np.arange(qr.MEASURES) < 3)
    table = spark.createDataFrame([(list(map(float, v)), int(k)) for v, k in zip(x, y, strict=True)], "x array<double>, y int").repartition(3)
    model = qr.fit_pairs(table)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -8, 8)
    good, bad = int(y.sum()), int((1 - y).sum())
    g, b = qr.preference_pairs(good, bad, good)
    assert len(g) == good * bad
    apart = z[y == 1][g] - z[y == 0][b]
    want = logistic_fit(apart, np.ones(len(apart)), np.full(len(apart), 20 / good), ridge=5.0, intercept=False)
    np.testing.assert_allclose(model.weights, want, atol=1e-7)
    raw = np.sort(z @ want)
    assert abs(model.cut - (raw[bad - 1] + raw[bad - 2]) / 2) < 1e-6 or abs(model.cut - (raw[bad] + raw[bad - 1]) / 2) < 1e-6
    weight = np.ones(300)
    slope = logistic_fit((z @ want - model.cut)[:, None], y.astype(float), weight, ridge=1e-3)[0]
    assert abs(model.slope - slope) < 1e-5
