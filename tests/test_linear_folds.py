"""Folds from merged moments against plain NumPy fits of every fold."""

import numpy as np
import pytest

from tabloom.operators import linear_folds as folds

NAMES = ["a", "b", "same as b"]


def rows_of(seed=2, n=600):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(1e6, 3, n), rng.normal(0, 2, n)  # a large offset must not cost digits
    y = 4 * (a - 1e6) - 3 * b + rng.normal(0, 1, n) + 50
    return [(i % 4, float(p), float(q), float(q), float(r)) for i, (p, q, r) in enumerate(zip(a, b, y))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "fold int, a double, b double, `same as b` double, y double").repartition(7)


def plain(rows, penalty, columns):
    data = np.array(rows, float)
    found = {}
    for f in np.unique(data[:, 0]):
        train, test = data[data[:, 0] != f], data[data[:, 0] == f]
        x, y = train[:, columns], train[:, -1]
        mx, my = x.mean(axis=0), y.mean()
        slopes = np.linalg.pinv((x - mx).T @ (x - mx) + penalty * np.eye(len(columns))) @ (x - mx).T @ (y - my)
        gaps = test[:, -1] - my - (test[:, columns] - mx) @ slopes
        spread = ((test[:, -1] - test[:, -1].mean()) ** 2).sum()
        found[int(f)] = (slopes, len(test), np.abs(gaps).mean(), np.sqrt((gaps**2).mean()), 1 - (gaps**2).sum() / spread)
    return found


@pytest.mark.parametrize("penalty", [0.0, 25.0])
@pytest.mark.parametrize("columns", [[1, 2], [1, 2, 3]])  # with a copied column, too
def test_folds_match_plain_fits(spark, penalty, columns):
    rows = rows_of()
    names = [NAMES[c - 1] for c in columns]
    want = plain(rows, penalty, columns)
    got = {r.fold: r for r in folds.linear_folds(frame(spark, rows), names, "y", penalty=penalty).collect()}
    assert set(got) == set(want)
    for f, (slopes, n, _, rmse, r2) in want.items():
        assert got[f].rows == n and np.allclose(got[f].coefficients, slopes, atol=1e-6)
        assert got[f].rmse == pytest.approx(rmse, abs=1e-6) and got[f].r2 == pytest.approx(r2, abs=1e-6)
    table = {r.metric: r for r in folds.cross_validate_linear(frame(spark, rows), names, "y", penalty=penalty).collect()}
    for place, metric in enumerate(("mae", "rmse", "r2"), start=2):
        values = [w[place] for w in want.values()]
        assert table[metric].mean == pytest.approx(np.mean(values), abs=1e-4)
        assert table[metric].std == pytest.approx(np.std(values), abs=1e-4)
        assert table[metric].folds == len(want) and table[metric].higher_is_better == (metric == "r2")


def test_missing_cells_and_too_few_folds(spark):
    rows = rows_of()
    awkward = [(None, 1.0, 1.0, 1.0, 1.0), (0, None, 1.0, 1.0, 1.0), (1, 1.0, float("nan"), 1.0, 1.0), (2, 1.0, 1.0, 1.0, None)]
    names = ["a", "b"]
    clean = folds.cross_validate_linear(frame(spark, rows), names, "y").collect()
    assert sorted(clean) == sorted(folds.cross_validate_linear(frame(spark, rows + awkward), names, "y").collect())
    constant = [(f, a, b, c, 5.0) for f, a, b, c, _ in rows]
    assert all(r.r2 is None and r.rmse < 1e-9 for r in folds.linear_folds(frame(spark, constant), names, "y").collect())
    for few in ([], rows[:1], [r for r in rows if r[0] == 0]):
        with pytest.raises(ValueError):
            folds.linear_folds(frame(spark, few), names, "y")
