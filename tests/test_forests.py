"""Forests grown from cells of equal bins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import classification as MC

from prismill.operators import boosting, forests
from prismill.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 10, 3000), rng.integers(0, 5, 3000)
    label = np.where((a > 5) & (b < 3), "yes", "no")
    return spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "label": label, "price": 10.0 * a + b}))


class Refused(Exception):
    pass


def refuse(*_):
    raise Refused


def test_few_cells_need_no_passes_over_the_rows(rows, monkeypatch):
    monkeypatch.setattr(MC.RandomForestClassifier, "fit", refuse)
    pipeline = M.TabularPipeline("forest", M.CLASSIFICATION, "label", ["a", "b"], [], options={"n_estimators": 12, "max_depth": 6})
    model = pipeline.fit(rows)
    out = model.transform(rows).collect()
    assert len(out) == 3000 and len(model.model.trees) == 12
    assert np.mean([r["prediction"] == r["label"] for r in out]) > 0.99
    assert all(abs(sum(r["probability"].toArray()) - 1) < 1e-9 for r in out)
    again = pipeline.fit(rows).model.trees
    assert all((x[1] == y[1]).all() and (x[3] == y[3]).all() for x, y in zip(model.model.trees, again))
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 49)  # there are 50 cells
    with pytest.raises(Refused):
        pipeline.fit(rows)


def test_regression_on_cells(rows):
    model = M.TabularPipeline("forest", M.REGRESSION, "price", ["a", "b"], [], options={"n_estimators": 10, "max_depth": 8}).fit(rows)
    out = model.transform(rows).select("label", "prediction").toPandas()
    assert np.abs(out["label"] - out["prediction"]).mean() < 0.5
    assert model.model.featureImportances[0] > 0.9


def test_a_tree_takes_the_best_cut():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 8, (200, 3)).astype(np.uint8)
    classes = rng.integers(0, 5, (200, 3)).astype(float)
    rows = classes.sum(axis=1)
    gini = lambda s: s.sum() - (s * s).sum() / s.sum()
    gains = {
        (f, c): gini(classes.sum(axis=0)) - gini(classes[codes[:, f] <= c].sum(axis=0)) - gini(classes[codes[:, f] > c].sum(axis=0))
        for f in range(3) for c in range(7)
    }
    arrays, gained = forests.grow_tree(codes, classes, rows, 1, 3, rng)
    best = max(gains, key=gains.get)
    assert (arrays[0][0], arrays[1][0]) == best and gained[best[0]] == pytest.approx(gains[best])
    arrays, _ = forests.grow_tree(codes, classes, rows, 20, 2, rng)
    leaf = boosting.leaf_of(arrays, codes)
    for node in np.unique(leaf):  # what a leaf holds is what its rows have
        np.testing.assert_allclose(arrays[3][node], [*classes[leaf == node].sum(axis=0), rows[leaf == node].sum()])
