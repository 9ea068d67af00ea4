"""Ranks of a registry come from pieces of it."""

import json

import pytest

from tabloom.operators import lifecycle


@pytest.mark.parametrize("metric", ["rmse", "f1_macro"])
def test_ranks_without_a_window_over_all(spark, metric):
    values = [0.5, None, 0.25, 0.5, 3.0, -1.0, float("nan"), 0.0, None, 2.0]
    rows = [(f"m{i}", "x", "candidate", json.dumps({metric: "NaN" if v != v else v} if v is not None else {})) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "model_id string, model string, status string, metrics string").repartition(4)
    found = lifecycle.compare(df, None, metric)
    assert "row_number" not in found._jdf.queryExecution().executedPlan().toString()
    sign = 1 if metric == "rmse" else -1

    def order(i):
        v = values[i]
        return (2, 0.0) if v is None else (1 if sign == 1 else -1, 0.0) if v != v else (0, sign * v)

    want = sorted(range(len(values)), key=lambda i: (*order(i), f"m{i}"))
    got = found.collect()
    assert [r["model_id"] for r in got] == [f"m{i}" for i in want] and [r["rank"] for r in got] == list(range(1, 11))
    assert lifecycle.compare(df, ["m2", "m4"], metric).count() == 2 and lifecycle.compare(df.limit(0), None, metric).count() == 0
