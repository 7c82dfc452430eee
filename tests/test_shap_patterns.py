"""Contributions looked up by pattern equal those of every row's own quadrature."""

import numpy as np

from vigilflow.operators import shap


def explainer(rnd, n_features=9):
    groups = []
    for d in (1, 2, 5, 6):
        n = 40
        feature = np.array([rnd.choice(n_features, d, replace=False) for _ in range(n)])
        low, high = np.sort(rnd.normal(size=(2, n, d)), axis=0)
        low[rnd.random((n, d)) < 0.4] = -np.inf
        groups.append(shap.Leaves(feature, low, high, rnd.uniform(0.05, 0.95, (n, d)), rnd.random(n)))
    return shap.Explainer(tuple(groups), 0.0, n_features)


def test_lookup_equals_quadrature_and_is_worked_out_once_per_pattern(monkeypatch):
    rnd = np.random.default_rng(3)
    ex, x = explainer(rnd), rnd.normal(size=(500, 9))
    x[7, 2], x[8, 3] = np.nan, np.inf
    one_by_one = np.concatenate([shap.shap_matrix(ex, r[None]) for r in x])  # fewer rows than patterns: no lookup
    rows, real = [], shap._gains
    monkeypatch.setattr(shap, "_gains", lambda g, on: rows.append(len(on)) or real(g, on))
    got = shap.shap_matrix(ex, x)
    assert np.array_equal(got, one_by_one)
    assert sum(rows) == 2 + 4 + 32 + 64
    rows.clear()
    assert np.allclose(shap.shap_matrix(ex, x, cells=1_000), one_by_one) and sum(rows) > 2 * len(x)  # no room for tables
