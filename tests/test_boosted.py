"""The boosted additive model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import boosted, explain, models


def steps(spark, n=3000):
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 10_000
    rows = spark.range(n).select("id", u(0).alias("a"), u(1).alias("b"), u(2).alias("c"))
    jump = F.when(F.col("a") > 0.93, 8.0).when(F.col("a") > 0.52, 2.0).otherwise(-1.0)
    return rows.withColumn("y", jump + F.when(F.col("b") < 0.31, 3.0).otherwise(0.0) + (u(3) - 0.5))


def mae(model, rows):
    return model.transform(rows).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]


def test_steps_are_found(spark):
    rows = steps(spark)
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    model = boosted.Boosted(["a", "b", "c"], "y").fit(train)
    ridge = models.Additive(["a", "b", "c"], "y").fit(train)
    assert mae(model, test) < 0.45 < mae(ridge, test)  # the noise alone has 0.25
    told = explain.local_terms(model, test, ["id"])
    sums = told.groupBy("id").agg((F.sum("weight") + F.first("intercept")).alias("s"), F.first("prediction").alias("p"), F.count(F.lit(1)).alias("n"))
    assert sums.where("abs(s - p) > 1e-9 or n <> 3").isEmpty() and sums.count() == test.count()
    importance = {r["feature"]: r["importance"] for r in explain.additive_terms(model, train).select("feature", "importance").distinct().collect()}
    assert importance["a"] > importance["b"] > 5 * importance["c"]
    centred = explain.additive_terms(model, train).groupBy("feature").agg(F.sum(F.col("weight") * F.col("n")).alias("s")).collect()
    assert all(abs(r["s"]) < 1e-6 for r in centred)


def test_pairs_are_found(spark):
    rows = steps(spark).withColumn("y", F.when((F.col("a") > 0.5) == (F.col("c") > 0.5), 2.0).otherwise(-2.0) + F.col("b"))
    alone = boosted.Boosted(["a", "b", "c"], "y", rounds=10, bags=2).fit(rows)
    both = boosted.Boosted(["a", "b", "c"], "y", rounds=10, bags=2, pairs=1).fit(rows)
    assert both.terms == ["a", "b", "c", "a & c"] and mae(both, rows) < 0.3 < 1.5 < mae(alone, rows)
    told = explain.local_terms(both, rows, ["id"]).groupBy("id").agg((F.sum("weight") + F.first("intercept") - F.first("prediction")).alias("d"))
    assert told.where("abs(d) > 1e-9").isEmpty()


def test_missing_values_and_order_of_rows(spark):
    rows = steps(spark, 800).withColumn("a", F.when(F.col("id") % 5 > 0, F.col("a")))
    model = boosted.Boosted(["a", "b"], "y", rounds=8, bags=2).fit(rows)
    again = boosted.Boosted(["a", "b"], "y", rounds=8, bags=2).fit(rows.repartition(7))
    assert all(np.allclose(model.weights[t], again.weights[t]) for t in model.terms)
    assert model.transform(rows.limit(50)).where("prediction is null").isEmpty()
    with pytest.raises(ValueError, match="no rows"):
        boosted.Boosted(["a"], "y").fit(rows.where("false"))
    flat = boosted.Boosted(["k"], "y", rounds=2, bags=1).fit(rows.withColumn("k", F.lit(1.0)))
    assert flat.transform(rows.withColumn("k", F.lit(1.0))).select("prediction").distinct().count() == 1
