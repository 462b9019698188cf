"""Agreement, ANOVA, Dunn index, gap statistic and seed stability."""

import itertools
import math

import numpy as np
import pytest

from tessera.operators import agreement as A
from tessera.operators import anova, separation
from tessera.plans import model_choice

RNG = np.random.default_rng(21)


def labels(spark, values):
    return spark.createDataFrame([(i, None if v is None else int(v)) for i, v in enumerate(values)], "id long, cluster int")


def plain_agreement(a, b):
    n = len(a)
    def c2(v):
        return v * (v - 1) / 2
    both = {k: sum(1 for p in zip(a, b, strict=True) if p == k) for k in set(zip(a, b, strict=True))}
    ca, cb = ({k: s.count(k) for k in set(s)} for s in (a, b))
    p, pa, pb = (sum(c2(v) for v in d.values()) for d in (both, ca, cb))
    expected, best = pa * pb / c2(n), (pa + pb) / 2
    ari = 1.0 if best == expected else (p - expected) / (best - expected)
    mi = sum(v / n * math.log(n * v / (ca[i] * cb[j])) for (i, j), v in both.items())
    ha, hb = (-sum(v / n * math.log(v / n) for v in d.values()) for d in (ca, cb))
    return ari, mi, ha, hb, 1.0 if ha + hb < 1e-12 else mi / ((ha + hb) / 2)


@pytest.mark.parametrize("case", ["random", "same", "one", "single"])
def test_agreement(spark, case):
    a = RNG.integers(-1, 4, size=200).tolist()
    b = {"random": RNG.integers(0, 3, size=200).tolist(), "same": [v + 7 for v in a], "one": [0] * 200, "single": [1] * 200}[case]
    a = [0] * 200 if case == "single" else a
    r = A.agreement(labels(spark, a), labels(spark, b), ["id"]).first()
    assert r["n"] == 200
    assert np.allclose([r["ari"], r["mutual_information"], r["entropy_a"], r["entropy_b"], r["nmi"]], plain_agreement(a, b), atol=1e-12)
    if case == "same":
        assert r["ari"] == 1.0


def test_agreement_of_nothing(spark):
    r = A.agreement(labels(spark, []), labels(spark, [1]), ["id"]).first()
    assert r["n"] is None and r["ari"] is None and r["nmi"] is None
    r = A.agreement(labels(spark, [3]), labels(spark, [1]), ["id"]).first()
    assert r["ari"] == 1.0 and r["nmi"] == 1.0


def test_f_tail_known_values():
    """Closed forms: F(2, m) has tail (1 + 2f/m)^(-m/2); F(1, 1) is the square of a Cauchy."""
    for f, m in itertools.product([0.01, 0.5, 1, 3, 20, 500], [1, 2, 7, 30, 1000]):
        assert anova.f_tail(f, 2, m) == pytest.approx((1 + 2 * f / m) ** (-m / 2), rel=1e-10)
    for f in (0.1, 1, 9, 1e4):
        assert anova.f_tail(f, 1, 1) == pytest.approx(1 - 2 / math.pi * math.atan(math.sqrt(f)), rel=1e-9)
    assert anova.f_tail(3.0, 4, 1_000_000) == pytest.approx(math.exp(-6) * 7, rel=1e-4)  # chi-square with 4 degrees


def test_anova(spark):
    g = RNG.integers(-1, 3, size=300)
    x = RNG.normal(size=300) + g * 0.3
    rows = [(i, int(c), None if i % 11 == 0 else float(v), 2.0, float(c), float("nan")) for i, (c, v) in enumerate(zip(g, x, strict=True))]
    df = spark.createDataFrame(rows, "id long, cluster int, `x.1` double, const double, same double, none double")
    got = {r["feature"]: r for r in anova.anova(df, ["id"]).collect()}
    keep = [i for i in range(300) if g[i] >= 0 and i % 11]
    parts = [x[[i for i in keep if g[i] == c]] for c in range(3)]
    n, mean = len(keep), x[keep].mean()
    f = (sum(len(p) * (p.mean() - mean) ** 2 for p in parts) / 2) / (sum(((p - p.mean()) ** 2).sum() for p in parts) / (n - 3))
    assert got["x.1"]["f"] == pytest.approx(f) and got["x.1"]["rows"] == n and got["x.1"]["clusters"] == 3
    assert got["x.1"]["p"] == pytest.approx((1 + 2 * f / (n - 3)) ** (-(n - 3) / 2))
    assert got["const"]["f"] is None and got["same"]["f"] == math.inf and got["same"]["p"] == 0.0 and got["none"]["f"] is None
    assert {r["feature"]: r["clusters"] for r in anova.anova(df, ["id"], noise=True).collect()}["x.1"] == 4


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dunn(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 3)) * (4 if seed < 3 else 0.5)
    c = rng.integers(-1, 4, size=250)
    x = rng.normal(size=(250, 3)) * rng.random() + centres[np.maximum(c, 0)]
    rows = [(i, [float(v) for v in p], int(k)) for i, (p, k) in enumerate(zip(x, c, strict=True))]
    r = separation.dunn(spark.createDataFrame(rows, "id long, x array<double>, cluster int"), "id", block_rows=16).first()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    own = (c[:, None] == c[None]) & (c[:, None] >= 0)
    cross = (c[:, None] != c[None]) & (c[:, None] >= 0) & (c[None] >= 0)
    assert r["max_diameter"] == pytest.approx(d[own].max(), rel=1e-12) and r["min_separation"] == pytest.approx(d[cross].min(), rel=1e-12)
    assert r["dunn"] == pytest.approx(d[cross].min() / d[own].max(), rel=1e-12)


def test_dunn_of_little(spark):
    schema = "id long, x array<double>, cluster int"
    one = separation.dunn(spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, [9.0], -1)], schema), "id").first()
    assert tuple(one) == (None, None, None)
    points = separation.dunn(spark.createDataFrame([(1, [0.0], 0), (2, [3.0], 1)], schema), "id").first()
    assert tuple(points) == (3.0, 0.0, None)


def planted(spark, k=3, n=50):
    rng = np.random.default_rng(30)
    rows = [(i, [float(v) for v in rng.normal(size=2) * 0.4 + [8 * (i % k), 5 * ((i % k) % 2)]]) for i in range(k * n)]
    return spark.createDataFrame(rows, "id long, x array<double>")


def test_gap_statistic_finds_planted_groups(spark):
    got = model_choice.gap_statistic(planted(spark), "id", max_k=4, references=2).collect()
    assert [r["k"] for r in got if r["chosen"]] == [3]
    assert all(r["gap"] == pytest.approx(r["reference_log_w"] - r["log_w"]) for r in got)


def test_reference_is_reproducible_and_fills_the_box(spark):
    df = planted(spark)
    a, b = (model_choice.reference(df, 7).repartition(p).orderBy("id").collect() for p in (1, 5))
    assert a == b and len(a) == 150
    x, y = np.array([r["x"] for r in a]), np.array([r["x"] for r in df.collect()])
    assert (x.min(axis=0) >= y.min(axis=0)).all() and (x.max(axis=0) <= y.max(axis=0)).all()
    assert abs(np.corrcoef(x.T)[0, 1]) < 0.3 and np.abs((x - y.min(axis=0)) / np.ptp(y, axis=0) - 0.5).mean() == pytest.approx(0.25, abs=0.05)


def test_seed_stability(spark):
    got = {r["k"]: r for r in model_choice.seed_stability(planted(spark), "id", [3], seeds=3).collect()}
    assert got[3]["min_ari"] == pytest.approx(1.0)
