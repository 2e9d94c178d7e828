"""Ranks over ranges of values against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import evaluate, explain, models, panel, ranks

VALUES = (None, float("nan"), float("inf"), -3.0, 0.0, 1.5, 2.5, 2.5, 7.0)


def told(seed, n):
    """Groups of which one holds most rows and one is null, and values with ties, nulls and NaN."""
    r = random.Random(seed)
    return [(i, r.choice(("a", "a", "a", "b", None)), r.choice(VALUES) if i % 3 else r.uniform(-9, 9)) for i in range(n)]


def falling(v):
    """Sort key of falling values: NaN is the largest, null the last."""
    return (1, 0) if v is None else (0, -float("inf") if v != v else -v) if v == v else (-1, 0)


@pytest.mark.parametrize("n", [0, 1, 300])
def test_ordinal(spark, n):
    data = told(1, n)
    got = {r["id"]: r["rank"] for r in ranks.ordinal(spark.createDataFrame(data, "id int, g string, v double"), ["g"], "v", ["id"]).collect()}
    want = {}
    for g in ("a", "b", None):
        order = sorted((r for r in data if r[1] == g), key=lambda r: (falling(r[2]), r[0]))
        want |= {r[0]: k for k, r in enumerate(order, 1)}
    assert got == want


def test_running_counts(spark):
    data = [("a", float(v), v % 4 + 1) for v in range(500)] + [("b", 1.0, 9)]
    got = {(r["g"], r["v"]): (r["_upto"], r["_total"]) for r in ranks.running(spark.createDataFrame(data, "g string, v double, c int"), ["g"], "v").collect()}
    total, at = sum(r[2] for r in data[:-1]), 0
    for g, v, c in data[:-1]:
        at += c
        assert got[(g, v)] == (at, total)
    assert got[("b", 1.0)] == (9, 9)


def test_by_hash_is_one_order(spark):
    f = spark.range(1000).withColumn("g", F.when(F.col("id") % 10 < 9, "hot"))
    out = ranks.by_hash(f, ["g"], F.xxhash64("id"), ["id"], "n")
    assert out.columns == ["id", "g", "n"]
    rows = out.withColumn("h", F.xxhash64("id")).collect()
    for g in ("hot", None):
        own = sorted((r for r in rows if r["g"] == g), key=lambda r: r["h"])
        assert [r["n"] for r in own] == list(range(1, len(own) + 1))


def test_quantile_cohorts(spark):
    r = random.Random(2)
    data = [(r.choice((r.uniform(0, 9), 4.0)), r.uniform(0, 9), 1.0) for _ in range(401)]
    got = evaluate.residuals_by_quantile(spark.createDataFrame(data, "a double, p double, same double"), F.col("a"), F.col("p"), ["a", "same"]).collect()
    v, e = np.array([d[0] for d in data]), np.array([d[0] - d[1] for d in data])
    edges = np.unique(np.quantile(v, [0, 0.25, 0.5, 0.75, 1]))
    bins = 1 + np.searchsorted(edges[1:-1], v, side="right")
    own = {x["bin"]: x for x in got if x["column"] == "a"}
    assert sorted(own) == sorted(set(bins.tolist()))
    for b, x in own.items():
        part = e[bins == b]
        assert (x["n"], x["lower"], x["upper"]) == (len(part), pytest.approx(edges[b - 1]), pytest.approx(edges[b]))
        assert (x["bias"], x["mae"], x["rmse"]) == (pytest.approx(part.mean()), pytest.approx(abs(part).mean()), pytest.approx((part**2).mean() ** 0.5))
    assert [(x["bin"], x["n"], x["lower"], x["upper"]) for x in got if x["column"] == "same"] == [(1, 401, 1.0, 1.0)]


def test_last_write_within(spark):
    f = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 2, None, "z"), ("a", 2, 0, "w"), (None, 1, 1, "v"), (None, 1, 3, None)], "e string, k int, seq int, v string")
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(panel.last_write(f, ["e", "k"], ["seq"]).collect(), key=key)
    assert sorted(panel.last_write(f, ["e", "k"], ["seq"], within=["e"]).collect(), key=key) == want
    assert len(want) == 3


def test_panel_takes_one_shuffle(spark):
    f = spark.createDataFrame([("a", 2020, 1, 1, 1.0)], "entity string, season int, week int, seq int, score double")
    out = panel.history_features(panel.last_write(f, ["entity", "season", "week"], ["seq"], within=["entity"]), ["score"], "h")
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("AdaptiveSparkPlan")[-1].count("Exchange") == 1


def test_permuting_keeps_a_period_together(spark):
    f = spark.createDataFrame([(2020 + i % 2, 1, float(i % 2), float(i), float(i % 2)) for i in range(60)], "season int, week int, x double, y double, target double")

    class Model:
        def transform(self, rows):
            return rows.withColumn("prediction", F.col("x"))

    got = {r["feature"]: r["importance"] for r in explain.permutation_importance(Model(), f, ["x", "y"], "target").collect()}
    assert got == {"x": 0.0, "y": 0.0}  # x is the same within a period


def test_pair_terms(spark):
    r = random.Random(3)
    data = [(i, r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(800)]
    f = spark.createDataFrame([(*d, 5.0 * (d[1] > 0) * (d[3] > 0) - 5.0 * (d[1] < 0) * (d[3] > 0) + d[2]) for d in data], "id int, x double, y double, z double, target double")
    plain, paired = models.Additive(["x", "y", "z"], "target").fit(f), models.Additive(["x", "y", "z"], "target", pairs=1).fit(f)
    assert plain.terms == ["x", "y", "z"] and paired.terms == ["x", "y", "z", "x & z"]
    mae = lambda m: evaluate.metrics(m.transform(f), F.col("target"), F.col("prediction")).first()["mae"]
    assert mae(paired) < 0.5 * mae(plain)
    got = explain.local_terms(paired, f, ["id"]).groupBy("id").agg(F.count("weight").alias("n"), (F.sum("weight") + F.first("intercept")).alias("s"), F.first("prediction").alias("p"))
    assert got.where((F.abs(F.col("s") - F.col("p")) > 1e-6) | (F.col("n") != 4)).count() == 0 and got.count() == 800
    assert explain.additive_terms(paired, f).where("feature = 'x & z'").agg(F.sum("n")).first()[0] == 800


def test_quantiles_are_exact(spark):
    """Ranks of more rows than a sketch keeps apart, with ties and nulls; a feature that is null throughout has none."""
    n = 20_963
    rows = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("a"), (F.col("id") % 7).alias("b"), F.when(F.col("id") % 10 == 3, F.col("id")).alias("c"), F.lit(None).cast("double").alias("d"))
    got = ranks.quantiles(rows, ["a", "b", "c", "d"], 10)
    at = lambda values: [values[max(1, -(-k * len(values) // 10)) - 1] for k in range(11)]
    assert got == {"a": at(list(range(n))), "b": at(sorted(k % 7 for k in range(n))), "c": at(list(range(3, n, 10))), "d": []}
    assert models.bin_edges(rows, ["a", "b", "d"], 10) == {"a": got["a"][1:-1], "b": sorted(set(got["b"][1:-1])), "d": [0.0]}
