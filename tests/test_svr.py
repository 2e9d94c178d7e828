"""Support-vector regression: against brute force, kernels against their Gram matrices, the whole search space."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import svr
from panelcast.plans import model_job


def objective(w, b, x, y, c, epsilon):
    return w @ w / 2 + c * np.maximum(np.abs(y - x @ w - b) - epsilon, 0).sum()


def brute(x, y, c, epsilon, seed=0):
    """The least of the objective by random directions that get shorter; convex, so that no other minimum can hold it."""
    rng, at, step = np.random.default_rng(seed), np.zeros(x.shape[1] + 1), 1.0
    f = lambda v: objective(v[:-1], v[-1], x, y, c, epsilon)
    best = f(at)
    while step > 1e-7:
        tries = at + step * rng.normal(size=(400, len(at)))
        values = [f(v) for v in tries]
        k = int(np.argmin(values))
        if values[k] < best - 1e-12:
            at, best = tries[k], values[k]
        else:
            step *= 0.7
    return at, best


def data(spark, n=60, seed=1, noise=0.4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [2.0, 5.0] + [1.0, -3.0]
    y = 1.5 * x[:, 0] - 0.2 * x[:, 1] + 4 + noise * rng.standard_t(2, size=n)
    rows = [(int(k), 2010 + k // 10, k % 10, float(a), float(b), float(v)) for k, ((a, b), v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id bigint, season int, week int, a double, b double, y double").repartition(3), x, y


@pytest.mark.parametrize(("c", "epsilon"), [(0.25, 0.25), (1.0, 0.05), (5.0, 1.0)])
def test_linear_fit_is_the_optimum(spark, c, epsilon):
    frame, x, y = data(spark)
    model = svr.Svr(["a", "b"], "y", svr.Point(c, epsilon)).fit(frame)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want, least = brute(z, y, c, epsilon)
    got = objective(model.weights[:-1], model.weights[-1], z, y, c, epsilon)
    assert got <= least * 1.002 + 1e-3
    assert np.allclose(model.weights, want, atol=0.1)
    told = {r["id"]: r["prediction"] for r in model.transform(frame).collect()}
    assert np.allclose([told[k] for k in range(60)], z @ model.weights[:-1] + model.weights[-1])


def test_tube_and_penalty(spark):
    """Nothing within the tube pulls: a tube wider than the target's range gives a constant; a tiny penalty gives nearly one."""
    frame, x, y = data(spark)
    flat = svr.Svr(["a", "b"], "y", svr.Point(1.0, float(np.ptp(y)))).fit(frame)
    assert np.abs(flat.weights[:-1]).max() < 0.02
    tight, loose = svr.fit_points(frame, ["a", "b"], "y", [svr.Point(1e-4, 0.1), svr.Point(10.0, 0.1)])
    assert np.abs(tight.weights[:-1]).max() < 0.1 < np.abs(loose.weights[:-1]).max()


def test_maps_give_their_kernels():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5))
    none = np.zeros((0, 5))
    for degree in (2, 3):
        z = svr.Map("poly", 0.15, degree, 5, none)(x)
        assert np.allclose(z @ z.T, (0.15 * x @ x.T) ** degree)
    svr_rbf = svr.Map("rbf", 0.1, None, 5, none)(x)
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(svr_rbf @ svr_rbf.T - np.exp(-0.1 * square)).max() < 0.3 and np.abs(svr_rbf @ svr_rbf.T - np.exp(-0.1 * square)).mean() < 0.06
    # on its landmarks a Nystroem map gives the kernel's positive part
    z = svr.Map("sigmoid", 0.1, None, 5, x)(x)
    values, vectors = np.linalg.eigh(np.tanh(0.1 * x @ x.T))
    assert np.allclose(z @ z.T, (vectors * np.maximum(values, 0)) @ vectors.T, atol=1e-6)
    many = rng.normal(size=(40, 60))
    z = svr.Map("poly", 0.05, 3, 60, many)(many)
    assert z.shape[1] <= 40 and np.allclose(z @ z.T, (0.05 * many @ many.T) ** 3, atol=1e-5 * z.max() ** 2)
    with pytest.raises(ValueError, match="no kernel"):
        svr.Map("other", 0.1, None, 5, none)


def curved(spark, n=400):
    rows = spark.range(n).select(
        "id", (F.lit(2010) + F.expr(f"id div {n // 4}")).cast("int").alias("season"), (F.expr(f"id div {n // 20}") % 5 + 1).cast("int").alias("week"), (F.pmod(F.xxhash64("id"), F.lit(6000)) / 1000 - 3).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(6000)) / 1000 - 3).alias("b"))
    return rows.withColumn("y", F.sin(F.col("a") * 1.5) * 4 + F.col("b") * F.col("b"))


def test_rbf_beats_linear_on_a_curve(spark):
    frame = curved(spark, 1600)
    points = [svr.Point(10.0, 0.1, "linear"), svr.Point(10.0, 0.1, "rbf", 0.5), svr.Point(10.0, 0.1, "poly", 0.15, 2)]
    scores = dict(svr.search(frame, ["a", "b"], "y", points, folds=3))
    assert scores[points[1]] < 0.6 * scores[points[0]]
    # the search's error of a fold is that of a fit on the fold's rows: of 19 periods, three folds have 7, 6 and 6
    place = (F.col("season") - 2010) * 5 + F.col("week")
    errors = []
    for low, high in ((2, 9), (9, 15), (15, 21)):
        model = svr.Svr(["a", "b"], "y", points[0]).fit(frame.where(place < low))
        errors.append(model.transform(frame.where((place >= low) & (place < high))).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0])
    assert scores[points[0]] == pytest.approx(np.mean(errors), rel=0.01)


def test_all_points_of_the_search_space(spark):
    frame = curved(spark, 80)
    points = [svr.Point(**p) for p in model_job.search_space()]
    got = svr.search(frame, ["a", "b"], "y", points, folds=2, steps=6)
    assert len(got) == 260 and len({p for p, _ in got}) == 260
    assert all(np.isfinite(s) for _, s in got) and [s for _, s in got] == sorted(s for _, s in got)
    assert got[0][0].kernel in ("rbf", "poly")


def test_odd_rows(spark):
    frame, _, _ = data(spark)
    model = svr.Svr(["a", "b"], "y").fit(frame.withColumn("b", F.lit(2.0)).unionByName(frame.withColumns({"b": F.lit(2.0), "y": F.lit(None).cast("double")})))
    got = model.transform(spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double")).collect()
    assert sorted((r["prediction"] is None) for r in got) == [False, True]
    with pytest.raises(Exception, match="must not be null"):
        svr.Svr(["a", "b"], "y").fit(frame.withColumn("b", F.when(F.col("id") > 3, F.col("b"))))
    with pytest.raises(ValueError, match="periods"):
        svr.search(frame.where("season = 2010 and week < 2"), ["a", "b"], "y", [svr.Point()], folds=3)
