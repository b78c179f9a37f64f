from pyspark.sql import functions as F

from weftline.operators import verdicts


def test_judged(spark):
    def model(prompts):
        if "boom" in prompts:
            raise RuntimeError
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([("a",), ("a",), ("boom",), (None,)], "p string").repartition(1)
    got = sorted(((r.p or "", r.reply) for r in verdicts.judged(rows, "p", model, 1).collect()), key=str)
    assert got == [("", None), ("a", "A"), ("a", "A"), ("boom", None)]


def test_replies(spark):
    r = spark.range(1).select(
        verdicts.kept_indexes(F.lit('sure: {"keep": [1, 2]}')).alias("a"), verdicts.kept_indexes(F.lit("[0, 3]")).alias("b"), verdicts.kept_indexes(F.lit("no idea")).alias("c"),
        verdicts.navigation(F.lit('{"direction": "next", "target": 0}')).alias("d"), verdicts.approved(F.lit(1), F.lit('{"keep": []}'), F.lit(500)).alias("e"),
        verdicts.approved(F.lit(1), F.lit('{"keep": []}'), F.lit(5)).alias("f"), verdicts.approved(F.lit(1), F.lit("?"), F.lit(5)).alias("g"),
    ).first()
    assert (r.a, r.b, r.c, r.d.target, r.e, r.f, r.g) == ([1, 2], [0, 3], None, 0, True, False, True)
