"""Registered queries resample as often as their results need."""

import __spark_entry__ as entry
from evalspark.operators import confound


def test_registered_draws_allow_significance(spark, folder, monkeypatch):
    rows = entry.queries()["b02_draw_units"](spark, folder).groupBy("cohort", "y").count().collect()
    assert rows and all(r["count"] >= 200 for r in rows)
    asked = []
    monkeypatch.setattr(confound, "permutation_control", lambda P, Fr, cols, n, *a, **k: asked.append(n) or P.selectExpr("1.0 AS one"))
    entry.queries()["x07_permutation_control"](spark, folder)
    assert asked == [100]


def test_draw_totals_are_those_of_the_draws(spark, capsys):
    from pyspark.sql import functions as F

    from evalspark.operators import infer

    rows = [(c, k % 2, f"u{k}") for c in ("a", None) for k in range(40) for _ in range(k % 3 + 1)]
    U = infer.units(spark.createDataFrame(rows, "cohort string, y int, unit string"))
    want = infer.draw_units(U, 7).groupBy("cohort", "y", "draw").agg(F.count(F.lit(1)).alias("drawn"), F.sum("weight").alias("total"),
                                                                    F.max("weight").alias("most"))
    got = infer.draw_unit_totals(U, 7)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.dtypes == want.dtypes
    got.explain()
    assert "RoundRobinPartitioning" in capsys.readouterr().out  # the slots are few bytes, but must not meet in one task
