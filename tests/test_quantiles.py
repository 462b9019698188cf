
import numpy as np
import pytest

from tessera.functions import quantiles as Q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize(("limit", "accuracy"), [(20_000, 10_000), (300, 50), (40, 60)])
def test_selection_matches_linear_rule(spark, monkeypatch, limit, accuracy):
    """With small bounds, ranges are counted, collected and narrowed."""
    monkeypatch.setattr(Q, "LIMIT", limit)
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    rng = np.random.default_rng(12)
    vals = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), [1e300, -1e300, 1e200]])  # a third on one value
    rng.shuffle(vals)
    wide = np.exp(rng.normal(size=len(vals)) * 30)
    rows = [(i, None if i % 19 == 0 else float(v), float("nan") if i % 7 == 0 else float(w), float(i % 5), None, 3.0 if i == 9 else None)
            for i, (v, w) in enumerate(zip(vals, wide, strict=True))]
    df = spark.createDataFrame(rows, "k long, `v.x` double, w double, few double, none double, one double").repartition(5)
    got = Q.quantiles(df, ["v.x", "w", "few", "none", "one"], PROBS)
    assert np.allclose(got["v.x"], np.quantile([v for i, v in enumerate(vals) if i % 19], PROBS), rtol=1e-13, atol=0)
    assert np.allclose(got["w"], np.quantile([v for i, v in enumerate(wide) if i % 7], PROBS), rtol=1e-13, atol=0)
    assert got["few"] == np.quantile([i % 5 for i in range(len(vals))], PROBS).tolist()
    assert got["none"] is None and got["one"] == [3.0] * 7


@pytest.mark.parametrize(("limit", "accuracy"), [(20_000, 10_000), (50, 60)])
def test_grouped_selection(spark, monkeypatch, limit, accuracy):
    monkeypatch.setattr(Q, "LIMIT", limit)
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    rng = np.random.default_rng(13)
    g = rng.integers(-1, 4, size=4000)
    v = rng.normal(size=4000)
    v[g == 0] = np.round(v[g == 0], 1)  # many ties in one group
    rows = [(None if a == 3 else int(a), None if a == 2 else float(b)) for a, b in zip(g, v, strict=True)]
    df = spark.createDataFrame(rows, "cluster int, `a.b` double").repartition(5)
    got = Q.grouped_quantiles(df, "cluster", ["a.b"], [0.25, 0.5, 0.75])
    for c in (-1, 0, 1):
        assert np.allclose(got[(c, "a.b")], np.quantile(v[g == c], [0.25, 0.5, 0.75]), rtol=1e-13, atol=1e-13)
    assert np.allclose(got[(None, "a.b")], np.quantile(v[g == 3], [0.25, 0.5, 0.75]), rtol=1e-13, atol=1e-13)
    assert got[(2, "a.b")] is None and len(got) == 5


def test_no_row_is_shuffled(spark):
    """Both scans are aggregates whose partial results alone are exchanged."""
    df = spark.range(1000).selectExpr("cast(id as double) as v")
    plan = df.agg(Q._counts(Q._value("v"), 1.0, 9.0), Q._sketch(Q._value("v"), [0.5]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "partial" in text and "RangePartitioning" not in text
