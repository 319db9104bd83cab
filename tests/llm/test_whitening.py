"""Whitening against numpy on the table and on odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelbom.llm.whitening import whiten, whitened_components


def plain(rows, components=16):
    """{(id, component): (n, deviation, |whitened|, explained)} by numpy over distinct vectors."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(64 * c) + 1000000 for c in v)) for i, v in usable]
    fit = np.array(sorted({x for _, x in xs}), np.int64)
    n, sums = len(fit), fit.sum(0)
    z = fit - sums / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:components]
    out = []
    for i, x in xs:
        far = [n * int(a) - int(s) for a, s in zip(x, sums)]
        for k, at in enumerate(order):
            if values[at] > 1e-9:
                w = (np.array(far) / n) @ axes[:, at] / math.sqrt(values[at])
                out.append((i, k + 1, n, sum(f * f for f in far), abs(w), values[at] / values.sum()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[3], r[4])


def same(got, want):
    got = sorted([(r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got], key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want], atol=1e-6)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-6)


def test_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = whitened_components(table).collect()
    same(got, plain([(r["vec_id"], r["embedding"]) for r in table.collect()]))
    assert {r["identity_error"] for r in got} and max(r["identity_error"] for r in got) < 1e-4
    of = {}
    for r in got:
        of.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    z = np.array([[w[k] for k in range(1, 17)] for w in of.values()])
    assert np.allclose(z.T @ z / len(z), np.eye(16), atol=1e-4)


def odd(spark):
    rnd = np.random.default_rng(3)
    rows = [(k if k % 7 else None, [float(x) for x in rnd.normal(size=4)]) for k in range(60)]
    rows += [(100 + k, rows[1][1]) for k in range(40)] + [(3, rows[3][1]), (200, None), (201, []), (202, [1.0, None, 2.0, 3.0])]
    rows += [(203, [math.nan, 1.0, 1.0, 1.0]), (204, [math.inf, 0.0, 0.0, 0.0]), (205, [-math.inf, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return rows, df.withColumns({c: F.lit("clash") for c in ("x", "w", "key", "id", "n", "component")})


def test_odd_rows(spark):
    rows, df = odd(spark)
    same(whitened_components(df).collect(), plain(rows))
    assert whitened_components(df.where("vec_id < -1")).count() == 0
    equal = whiten(df.where("vec_id >= 100 and vec_id < 140")).collect()
    assert len(equal) == 40 and all(r["whitened"] == [] and r["deviation"] == 0 and r["n"] == 1 for r in equal)
    with pytest.raises(ValueError, match="lengths"):
        whiten(df.unionByName(df.limit(1).withColumn("embedding", F.array(F.lit(1.0)))))


def test_counts_as_weights(spark):
    rows, df = odd(spark)
    got = whiten(df, weights="count").collect()
    x = np.array([[math.floor(64 * c) for c in v] for _, v in rows if v and all(c is not None and math.isfinite(c) for c in v)], float)
    assert {r["n"] for r in got} == {len(x)}
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    assert np.allclose(got[0]["explained"], want / want.sum())
    z = np.array([r["whitened"] for r in got])
    assert np.allclose(z.T @ z / len(z), np.eye(4), atol=1e-9) and got[0]["identity_error"] < 1e-9


def test_sums_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [2.0**45, 0.0]), (2, [-(2.0**45), 1.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitened_components(df).collect()}
    assert got == {1: None, 2: None, 3: sum((3 * x - s) ** 2 for x, s in ((1000000, 3000000), (1000192, 3000256)))}
