import random

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import nearest


def test_cosine_top_against_all_pairs(spark):
    """Blocks of a few rows; copies, opposite, zero, short, null and infinite vectors."""
    r = random.Random(6)
    vecs = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(150)]
    vecs += vecs[:20] + [[-x for x in v] for v in vecs[:10]] + [[0.0] * 8] * 3 + [[1.0, 0.5], None, [float("inf")] * 8, [None] + [0.25] * 7, []]
    rows = spark.createDataFrame([(i - 5, v) for i, v in enumerate(vecs)], "vec_id long, v array<double>")
    asked = rows.filter("vec_id % 5 = 0 or vec_id > 170").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    c = rows.crossJoin(asked).filter("vec_id <> query_id").select("query_id", "vec_id", F.round(text.cosine(F.col("q"), F.col("v")), 6).alias("score"))
    n = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    want = {tuple(x) for x in c.withColumn("n", n).filter("n <= 5").drop("n").collect()}
    out = nearest.cosine_top(rows, asked)
    assert {tuple(x) for x in out.collect()} == want
    assert "CartesianProduct" in out._jdf.queryExecution().executedPlan().toString()  # no join by pairs of rows


def test_scores_computed_again(spark, monkeypatch):
    """With a wide margin all scores are; they are the same as without."""
    r = np.random.default_rng(3)
    v = r.normal(size=(200, 8))
    want = nearest.best(np.arange(40), v[:40], np.arange(200), v, 5)
    monkeypatch.setattr(nearest, "DOUBT", 0.6)
    got = nearest.best(np.arange(40), v[:40], np.arange(200), v, 5)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_cosine_top_of_nothing(spark):
    rows = spark.createDataFrame([], "vec_id long, v array<float>")
    assert nearest.cosine_top(rows, rows.withColumnsRenamed({"vec_id": "query_id", "v": "q"})).count() == 0
