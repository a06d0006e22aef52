"""The partitioned vector index against the exact search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumgrid.operators import search, vector_cells


def clustered(n=3000, d=16, centres=12, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, d)) * 2
    return [(i, [float(x) for x in middle[i % centres] + rng.normal(size=d)]) for i in range(n)]


def share_found(exact, found):
    a, b = ({(r["question_id"], r["key"]) for r in rows.collect()} for rows in (exact, found))
    return len(a & b) / len(a)


def test_recall_and_rows_read(spark, tmp_path):
    rows = spark.createDataFrame(clustered(), "key long, vector array<double>").repartition(4)
    asked = rows.where("key % 50 = 0").select(F.col("key").alias("question_id"), "vector")
    cells = vector_cells.fit(rows, cells=24)
    vector_cells.write(rows, cells, str(tmp_path / "v"))
    stored, own = vector_cells.open_cells(spark, str(tmp_path / "v"))
    assert own.probes == cells.probes < 24 and stored.count() == 3000
    exact = search.vector_topk(rows, asked)
    assert share_found(exact, vector_cells.search(stored, asked, own)) >= 0.9
    read = vector_cells.probed(asked, own).groupBy("question_id", "cell").count().join(stored.groupBy("cell").agg(F.count("*").alias("n")), "cell").groupBy("question_id").agg(F.sum("n").alias("n")).agg(F.avg("n")).first()[0]
    assert read < 0.5 * 3000
    # With every cell probed, the result is the exact one, ranks and all.
    everything = vector_cells.search(stored, asked, own, probes=24)
    key = lambda r: (r["question_id"], r["rank"], r["key"])
    assert sorted(map(key, everything.collect())) == sorted(map(key, exact.collect()))
    plan = stored.where(F.col("cell").isin("3", "5"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("bound", [48 << 20, -1])
def test_a_cell_of_copies_and_odd_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(search, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(search, "BLOCK_ROWS", 100)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(500)] + clustered(500, 3, 4) + [(9000, None), (9001, [0.0, 0.0, 0.0])]
    rows = [(n, v) for n, (_, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "key long, vector array<double>")
    cells = vector_cells.fit(df, cells=5, k=5)
    assigned = vector_cells.assign(df, cells)
    assert assigned.count() == len(rows) and assigned.where("vector is null and cell = '0'").count() == 1
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 1.0]), (3, None)], "question_id int, vector array<double>")
    got = vector_cells.search(assigned, asked, cells, k=5)
    assert {r["question_id"] for r in got.collect()} == {1, 2} and got.where("question_id = 1").agg(F.min("score")).first()[0] >= 1.0
    none = df.limit(0)
    empty = vector_cells.fit(none)
    assert vector_cells.search(vector_cells.assign(none, empty), asked.limit(0), empty).count() == 0
