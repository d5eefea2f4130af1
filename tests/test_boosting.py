"""Boosted trees against a plain greedy learner on the same rows."""

import random

import numpy as np
import pytest

from prismill.operators import boosting


def some(n, seed=1):
    luck = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = luck.randrange(12), luck.randrange(9), luck.randrange(5)
        rows.append((i, i % 3, float(a), float(b), float(c) if luck.random() < 0.9 else None, 2.0 * a + (5 if b > 4 and a < 6 else 0) - c * b + luck.gauss(0, 0.5)))
    return rows


SCHEMA = "id long, fold int, a double, b double, c double, y double"


def greedy(x, grad, hess, leaves, least):
    """Leaf number per row of a tree that always splits the leaf with most to gain."""
    def best(rows):
        found = None
        g, h = grad[rows].sum(), hess[rows].sum()
        for j in range(x.shape[1]):
            for cut in np.unique(x[rows, j])[:-1]:
                left = rows[x[rows, j] <= cut]
                right = rows[x[rows, j] > cut]
                if min(len(left), len(right)) < least:
                    continue
                gain = grad[left].sum() ** 2 / hess[left].sum() + grad[right].sum() ** 2 / hess[right].sum() - g * g / h
                if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, left, right)
        return found

    parts = [np.arange(len(x))]
    splits = [best(parts[0])]
    while len(parts) < leaves:
        at = max(range(len(parts)), key=lambda i: splits[i][0] if splits[i] else -1)
        if not splits[at]:
            break
        _, left, right = splits[at]
        parts[at : at + 1] = [left, right]
        splits[at : at + 1] = [best(left), best(right)]
    return parts


def by_hand(rows, learns, rounds, leaves, rate, least, logistic=False):
    x = np.array([[-np.inf if v is None else v for v in r[2:5]] for r in rows])
    y = np.array([r[5] for r in rows])
    use = np.flatnonzero(learns)
    score = np.full(len(y), np.log(y[use].mean() / (1 - y[use].mean())) if logistic else y[use].mean())
    for _ in range(rounds):
        share = 1 / (1 + np.exp(-score))
        grad, hess = (share - y, share * (1 - share)) if logistic else (score - y, np.ones(len(y)))
        step = np.zeros(len(y))
        parts = greedy(x[use], grad[use], hess[use], leaves, least)
        for part in parts:
            step[use[part]] = -rate * grad[use][part].sum() / hess[use][part].sum()
        yield score[use] + step[use]
        score = score + step


@pytest.mark.parametrize("block", [1 << 14, 97])
@pytest.mark.parametrize("logistic", [False, True])
def test_equals_greedy_growth(spark, monkeypatch, block, logistic):
    """One block, and rows of the key over several blocks."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
    rows = [(*r[:5], float(r[5] > 8) if logistic else r[5]) for r in some(400)]
    settings = boosting.Settings(rounds=3, rate=0.3, leaves=7, min_rows=10, loss=boosting.LOGISTIC if logistic else boosting.SQUARED)
    fitted = boosting.fit(spark.createDataFrame(rows, SCHEMA), [], ["a", "b", "c"], "y", row_id="id", settings=settings)
    got = {r["row"]: r["scores"][0] for r in boosting.out_of_fold(fitted, spark).collect()}
    want = list(by_hand(rows, np.ones(len(rows), bool), 3, 7, 0.3, 10, logistic))[-1]
    assert len(got) == 400
    np.testing.assert_allclose([got[i] for i in range(400)], want, rtol=1e-9)
    scores = fitted.scorer()(0, np.array([[np.nan if v is None else v for v in r[2:5]] for r in rows]))
    np.testing.assert_allclose(scores[:, 0], want, rtol=1e-9)
    assert all(len(t.feature) <= 13 for grown in fitted.trees for t in grown.values())


def test_folds_and_keys_in_one_fit(spark):
    """Each model only learns from its key's other folds: the same scores as fitting it alone."""
    rows = some(300)
    frame = spark.createDataFrame([(f"k{i % 2}", *r) for i, r in enumerate(rows)], f"name string, {SCHEMA}")
    settings = boosting.Settings(rounds=2, leaves=4, min_rows=5)
    both = boosting.fit(frame, ["name"], ["a", "b", "c"], "y", "fold", 3, row_id="id", settings=settings)
    assert both.keys == [("k0",), ("k1",)]
    out = boosting.out_of_fold(both, spark).collect()
    assert len(out) == 300 and {r["name"] for r in out} == {"k0", "k1"}
    for name in ("k0", "k1"):
        for fold in range(3):
            own = frame.where(f"name = '{name}'")
            alone = boosting.fit(own.where(f"fold <> {fold}"), [], ["a", "b", "c"], "y", row_id="id", settings=settings)
            tested = own.where(f"fold = {fold}").collect()
            x = np.array([[np.nan if r[c] is None else r[c] for c in "abc"] for r in tested])
            want = dict(zip([r["id"] for r in tested], alone.scorer()(0, x)[:, 0]))
            got = {r["row"]: r["scores"][0] for r in out if r["name"] == name and r["fold"] == fold}
            assert got.keys() == want.keys()
            np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-9)


def test_rolling_models_see_only_the_past(spark):
    rows = [(i, i // 50, float(i % 7), float(i % 5), 0.0, float(i)) for i in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA)
    changed = spark.createDataFrame([(*r[:5], r[5] * (100 if r[1] == 3 else 1)) for r in rows], SCHEMA)
    settings = boosting.Settings(rounds=2, leaves=4, min_rows=5)
    outs = [
        {r["row"]: r["scores"] for r in boosting.out_of_fold(boosting.fit(f, [], ["a", "b", "c"], "y", "fold", 3, True, "id", settings), spark).collect()}
        for f in (frame, changed)
    ]
    assert outs[0] == outs[1] and set(outs[0]) == set(range(50, 200))


def test_three_classes(spark):
    rows = [(*r[:5], float(int(r[5]) % 3)) for r in some(240)]
    rows += [(1000 + i, 0, float(i % 3), 0.0, 0.0, float(i % 3)) for i in range(240)]
    settings = boosting.Settings(rounds=30, leaves=6, min_rows=5, loss=boosting.LOGISTIC, classes=3, rate=0.2)
    fitted = boosting.fit(spark.createDataFrame(rows, SCHEMA), [], ["a", "b", "c"], "y", row_id="id", settings=settings)
    right = [int(np.argmax(r["scores"])) == r["target"] for r in boosting.out_of_fold(fitted, spark).collect()]
    assert np.mean(right) > 0.75


def test_contributions_equal_enumeration(spark):
    """Three features, all subsets, all background rows."""
    from itertools import combinations
    from math import factorial

    from prismill.operators import explain, models

    rows = spark.createDataFrame([(*r[:4], r[4] or 0.0, r[5]) for r in some(300)], SCHEMA)
    pipeline = models.TabularPipeline("boosted", models.REGRESSION, "y", ["a", "b", "c"], [], models.PreprocessConfig("mean"), 0, {"n_estimators": 6, "num_leaves": 9})
    model = pipeline.fit(rows)
    out = explain.tree_contributions(model, rows, "id", background=20).toPandas()
    assert len(out) == 900
    score = lambda x: model.model.fitted.scorer()(0, np.asarray(x, float))[:, 0]
    x = np.array([[r["a"], r["b"], r["c"]] for r in rows.orderBy("id").collect()])
    from prismill.operators.profile import sample_rows

    numbered = rows.select(rows["id"].alias("row"), "a", "b", "c")
    pool = np.array([[r["a"], r["b"], r["c"]] for r in sample_rows(numbered, 20, "row", 1).collect()])
    for i in (0, 7, 123):
        value = {}
        for size in range(4):
            for kept in combinations(range(3), size):
                mixed = pool.copy()
                mixed[:, list(kept)] = x[i, list(kept)]
                value[kept] = score(mixed).mean()
        own = out[out["id"] == i].set_index("feature")
        assert own["base"].iloc[0] == pytest.approx(value[()]) and own["prediction"].iloc[0] == pytest.approx(value[(0, 1, 2)])
        for j, name in enumerate("abc"):
            want = 0.0
            for size in range(3):
                for kept in combinations([k for k in range(3) if k != j], size):
                    want += factorial(size) * factorial(2 - size) / 6 * (value[tuple(sorted((*kept, j)))] - value[kept])
            assert own.loc[name, "contribution"] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("rows", [1, 3, 40])
def test_donors_go_round(spark, rows):
    from prismill.operators import explain

    df = spark.createDataFrame([(i, f"v{i}") for i in range(rows)], "id long, v string")
    out = {r["v"]: [d["v"] for d in r["donors"]] for r in explain.shifted_donors(df, "id", ["v"], 3).collect()}
    assert len(out) == rows
    for v, donors in out.items():
        assert len(donors) == 3 and donors[1] == out[donors[0]][0] and donors[2] == out[donors[1]][0]
    step, seen = "v0", []
    for _ in range(rows):
        seen.append(step)
        step = out[step][0]
    assert sorted(seen) == sorted(out) and step == "v0"


def test_jobs_do_not_grow_with_the_rounds(spark):
    """Models that fit in one block grow from their first tree to their last in one job; equal rows are one with a weight."""
    rows = [(i, i % 3, float(i % 4), float(i % 3), 0.0, float(i % 4 + i % 3)) for i in range(2400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    context = spark.sparkContext

    def jobs(rounds: int) -> int:
        context.setJobGroup(f"rounds-{rounds}", "")
        try:
            fitted = boosting.fit(frame, [], ["a", "b", "c"], "y", settings=boosting.Settings(rounds=rounds))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        assert len(fitted.trees) == rounds and fitted.trees[0][0, 0, 0].rows[0] == 2400
        return len(context.statusTracker().getJobIdsForGroup(f"rounds-{rounds}"))

    assert jobs(25) == jobs(2)


def test_sets_of_path_features_are_worked_out_alike(spark, monkeypatch):
    """Shares of a path's features come from a table of all sets, those of a long path from the sets that occur."""
    from prismill.operators import explain

    rng = np.random.default_rng(5)
    codes, others = rng.integers(0, 4, (400, 6)).astype(np.uint8), rng.integers(0, 4, (15, 6)).astype(np.uint8)
    boxes = [[(float(rng.normal()), {int(f): (0, int(rng.integers(1, 4))) for f in rng.permutation(6)[:k]}) for k in (0, 1, 2, 4, 6)] for _ in range(3)]
    leaf = lambda x: sum(v * np.all([(x[:, f] > a) & (x[:, f] <= b) for f, (a, b) in box.items()], axis=0) for t in boxes for v, box in t if box)
    found = explain.explain_codes(codes, others, boxes, 6)
    np.testing.assert_allclose(found.sum(axis=1), leaf(codes) - leaf(others).mean(), atol=1e-12)
    monkeypatch.setattr(explain, "_TABLED", 1)
    np.testing.assert_allclose(explain.explain_codes(codes, others, boxes, 6), found, atol=1e-12)


def test_two_classes_share_their_rows(spark):
    """Rows of equal bins are one row whatever class they are of, so that a model's rows are bounded by its bins alone."""
    settings = boosting.Settings(loss=boosting.LOGISTIC)
    binned = spark.createDataFrame([(0, 0, float(i % 3 == 0), i, bytes([i % 2])) for i in range(12)], "key int, fold int, target double, row long, codes binary")
    rows = {bytes(r["codes"]): (r["target"], r["weight"]) for r in boosting._merged(binned, boosting.Plan(1, False), settings, 1).collect()}
    assert rows == {b"\0": (pytest.approx(1 / 3), 6.0), b"\1": (pytest.approx(1 / 3), 6.0)}
    assert boosting._merged(binned, boosting.Plan(1, False), settings, 1).count() == 2
