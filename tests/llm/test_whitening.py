"""Whitening against plain matrices and whole-number sums."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumgrid.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, id string, x int, v string"


def rows_of(rng, n, d=6):
    base = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    return [(i, [float(c) for c in v], "clash", 1, "z") for i, v in enumerate(base.astype(np.float32))]


def plain(rows, k=4):
    usable = [(i, [math.floor(256 * c) for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in usable})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    matrix = np.array(distinct, dtype=float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(matrix.T @ matrix / n)
    order = np.argsort(-values)[:k]
    return n, {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in usable}, {i: np.abs((np.array(x) - np.array(sums) / n) @ vectors[:, order] / np.sqrt(values[order])) for i, x in usable}, values[order] / values.sum()


def test_whitening_equals_plain_matrices(spark):
    rng = np.random.default_rng(1)
    rows = rows_of(rng, 300)
    odd = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 4), (903, [float("nan")] + [0.0] * 5), (904, [float("-inf")] + [0.0] * 5), (None, rows[3][1]), (905, [-0.0] * 6)]
    rows += [(i, v, "clash", 1, "z") for i, v in odd] + [rows[0]] * 200
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    model = whitening.fit(df)
    got = whitening.whiten(df, model).collect()
    n, deviations, white, explained = plain(rows)
    assert model.n == n == 301 and len(got) == 300 + 200 + 2
    assert np.allclose(model.explained, explained, rtol=1e-9) and model.identity_error < 1e-9
    for r in got:
        assert r["deviation"] == deviations[r["vec_id"]] and np.allclose(np.abs(r["whitened"]), white[r["vec_id"]], atol=1e-8)
    assert {r["vec_id"] for r in got} == set(range(300)) | {None, 905}


def test_moments_merge_like_one(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-(10**6), 10**6, (500, 5)) + 10**9
    whole = whitening.Moments.of(x)
    cuts = [0, 1, 7, 250, 499, 500]
    parts = [whitening.Moments.of(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.merge(p)
    assert merged.n == 500 and merged.sums == whole.sums == x.astype(object).sum(0).tolist()
    assert np.allclose(merged.mean, whole.mean, rtol=1e-15) and np.allclose(merged.scatter, (x - x.mean(0)).T @ (x - x.mean(0)), rtol=1e-9)
    frame = spark.createDataFrame([(r,) for r in x.tolist()], "x array<bigint>").repartition(6)
    spread = whitening.moments(frame)
    assert spread.n == 500 and spread.sums == whole.sums and np.allclose(spread.scatter, whole.scatter, rtol=1e-9)


def test_a_large_mean_leaves_no_trace(spark):
    """Raw products of such vectors would lose the variance; centred ones keep it."""
    rng = random.Random(3)
    rows = [(i, [float(2**36 + rng.randint(0, 255)) for _ in range(3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    model = whitening.fit(df, components=3)
    centred = np.array([v for _, v in rows]) - 2**36
    assert np.allclose(sorted(model.values), np.linalg.eigvalsh(np.cov(centred.T * 256, bias=True)), rtol=1e-9)
    assert model.identity_error < 1e-9
    # n * x - S is exact where doubles are not.
    sums = [sum(int(v[j]) * 256 for _, v in rows) for j in range(3)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df, model).collect()}
    assert got == {i: sum((200 * int(c) * 256 - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in rows}


def test_thin_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9):
        assert whitening.fit(make(rows)) is None and whitening.whiten(make(rows), None).collect() == []
    # Two different vectors span one component.
    line = make([(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 5.0]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 9.0])])
    model = whitening.fit(line)
    got = {r["vec_id"]: r["whitened"] for r in whitening.whiten(line, model).collect()}
    assert set(got) == {1, 2, 3} and all(len(w) == 1 and abs(abs(w[0]) - 1) < 1e-9 for w in got.values()) and got[1] == got[3]
    # Beyond a long: no figure instead of a wrong one.
    huge = make([(1, [1e12, 0.0]), (2, [0.0, 1.0]), (3, [1e12, 1.0])])
    assert {r["deviation"] for r in whitening.whiten(huge, whitening.fit(huge)).collect()} == {None}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_plain_version(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    n, deviations, white, explained = plain(rows)
    got = queries.op12_whitening(spark, folder).collect()
    assert len(got) == 4 * len(white)
    for r in got:
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviations[r["vec_id"]] and r["identity_error"] <= 1e-4
        assert abs(abs(r["whitened"]) - white[r["vec_id"]][k]) < 1e-6 and abs(r["explained"] - explained[k]) <= 1e-4 * explained[k]


def test_query_without_vectors(spark, tmp_path):
    spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.select(F.count("*")).first()[0] == 0
