"""Whitening: against numpy, exact deviations, odd rows and several lengths."""

import math

import numpy as np
import pytest

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """{(position of the row, component): (n, deviation, whitened, explained)} and the fit's eigenvalues."""
    use = [(p, [math.floor(256 * float(np.float32(c))) for c in v]) for p, (_, v, *_) in enumerate(rows)
           if v and all(c is not None and math.isfinite(c) for c in v)]
    out, values = {}, {}
    for width in {len(x) for _, x in use}:
        mine = [(p, x) for p, x in use if len(x) == width]
        fit = sorted({tuple(x) for _, x in mine})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        centred = (np.array(fit, dtype=np.float64) - np.array(sums) / n)
        cov = centred.T @ centred / n
        e, u = np.linalg.eigh(cov)
        order = np.argsort(-e)[:4]
        values[width] = e[order]
        for p, x in mine:
            dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            z = (np.array(x) - np.array(sums) / n) @ u[:, order]
            for k, i in enumerate(order):
                if e[i] > 1e-12 * e[order[0]] and e[i] > 0:
                    out[p, k + 1] = (n, dev, z[k] / math.sqrt(e[i]), e[i] / np.trace(cov))
    return out, values


def compare(spark, tmp_path, rows):
    """Rows get their position as id, so that repeated ids can be told apart."""
    path = tmp_path / "t"
    spark.createDataFrame([(p, v, 0) for p, (_, v) in enumerate(rows)], SCHEMA).write.parquet(str(path / "embeddings.parquet"))
    want, _ = brute(rows)
    got = whitening.op13_whitening(spark, str(path)).collect()
    assert len(got) == len(want) == len({(r["vec_id"], r["component"]) for r in got})
    signs = {}
    for r in got:
        n, dev, z, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, dev)
        assert r["explained"] == pytest.approx(share, rel=1e-9) and r["identity_error"] < 1e-9
        key = (len(rows[r["vec_id"]][1]), r["component"])
        if abs(z) > 1e-6:
            signs.setdefault(key, set()).add(math.copysign(1, z) == math.copysign(1, r["whitened"]))
        assert abs(r["whitened"]) == pytest.approx(abs(z), abs=1e-7)
    assert all(len(s) == 1 for s in signs.values())
    return got


def test_given_table(spark, tmp_path):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert compare(spark, tmp_path, rows)


def test_small_blocks(spark, tmp_path, monkeypatch):
    """Many blocks and several products to add up give the same."""
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "BLOCKS", 40)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [5, 4, 3, 2, 1, 1]]) for i in range(500)]
    compare(spark, tmp_path, rows)


def test_nulls_repeats_and_lengths(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [9, 7, 5, 3, 1]]) for i in range(60)]
    rows += [(1, rows[0][1])] * 300  # a third or more of all rows are one vector
    rows += [(2, None), (3, []), (4, [1.0, None, 2.0, 1.0, 1.0]), (5, [float("nan")] * 5), (6, [float("inf")] + [0.0] * 4)]
    rows += [(i, [float(c) for c in rng.normal(size=3)]) for i in range(20)]
    rows += [(7, [0.5] * 2)] * 3  # no variance: no components
    rows += [(8, [2.0, 1.0, 4.0, 4.0]), (9, [3.0, 1.0, 4.0, 4.0])]  # one component with variance
    compare(spark, tmp_path, rows)


def test_empty_and_large_values(spark, tmp_path):
    assert compare(spark, tmp_path, [(0, None)]) == []
    big = [(i, [float(np.float32(3e11 * (i % 17) + i)), float(-i), 1e12, float((i * i) % 97)]) for i in range(80)]
    df = spark.createDataFrame([(i, v, 0) for i, v in big], SCHEMA)
    rows, models = whitening.whiten(df, "vec_id", "embedding")
    assert rows.count() == 80 and rows.where("deviation is null").count() > 0
    assert max(whitening.identity_errors(rows, models).values()) < 1e-4


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], 1, 2, 3, 4.0) for i in range(30)],
                               "id long, x array<double>, idx int, _u int, n int, centred double")
    rows, models = whitening.whiten(df, "id", "x")
    assert rows.columns == ["id", "n", "deviation", "z", "width", "rep"] and rows.count() == 30 and models[2].n == 30
