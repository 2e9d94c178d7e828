"""Explanations: terms of additive models, accumulated local effects, permutation importance, Shapley values by permutation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from . import ranks
from .models import AdditiveModel
from .panel import PERIOD


def _bins(frame: DataFrame, terms: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """ids, feature, bin: one row for each term of a row. A term is a feature or a pair of them."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("feature"), F.col(f"`_bin_{t}`").cast("int").alias("bin")) for t in terms)))
    return frame.select(*ids, each.alias("_t")).select(*ids, "_t.*")


def additive_terms(model: AdditiveModel, frame: DataFrame) -> DataFrame:
    """feature, bin, n, weight, centred, importance: weights centred over the rows, and the mean of their size by feature."""
    spark = frame.sparkSession
    table = F.broadcast(spark.createDataFrame(model.coefficients(frame), "feature string, bin int, weight double"))
    counts = _bins(model.transform(frame), model.terms, []).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")).join(table, ["feature", "bin"])
    of = Window.partitionBy("feature")
    out = counts.withColumn("centred", F.col("weight") - F.sum(F.col("weight") * F.col("n")).over(of) / F.sum("n").over(of))
    return out.withColumn("importance", F.sum(F.abs("centred") * F.col("n")).over(of) / F.sum("n").over(of))


def local_terms(model: AdditiveModel, frame: DataFrame, ids: Sequence[str]) -> DataFrame:
    """ids, feature, bin, weight, intercept, prediction: a row's weights and the intercept add up to its prediction."""
    spark = frame.sparkSession
    table = F.broadcast(spark.createDataFrame(model.coefficients(frame), "feature string, bin int, weight double"))
    scored = model.transform(frame)
    return _bins(scored, model.terms, [*ids, "prediction"]).join(table, ["feature", "bin"]).select(*ids, "feature", "bin", "weight", F.lit(model.intercept).alias("intercept"), "prediction")


def accumulated_effects(model, frame: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """feature, bin, upper, n, effect: mean change of the prediction over each bin, summed up and centred by counts. Bins end at exact quantiles.

    Every row stands twice for each feature, with the feature at its bin's edges, in one transform.
    """
    if bins < 2:
        raise ValueError("bins must be 2 or more")
    cuts = {f: sorted(set(found)) for f, found in ranks.quantiles(frame, features, bins).items()}
    if empty := [f for f in features if not cuts[f]]:
        raise ValueError(f"no values of {', '.join(empty)}")
    variants = []
    for f in features:
        arr = F.array(*map(F.lit, cuts[f]))
        at = F.greatest(F.lit(1), F.least(F.size(F.filter(arr, lambda e: e < F.col(f))), F.lit(len(cuts[f]) - 1)))  # noqa: B023
        for side in (0, 1):
            variants.append(F.struct(F.lit(f).alias("_f"), at.alias("_b"), F.lit(side).alias("_s"), F.get(arr, at - 1 + side).alias("_v")))
    rows = frame.withColumn("_id", F.monotonically_increasing_id()).select("_id", *features, F.explode(F.array(*variants)).alias("_x")).select("_id", *features, "_x.*")
    moved = rows.withColumns({f: F.when(F.col("_f") == f, F.col("_v")).otherwise(F.col(f)) for f in features})
    scored = model.transform(moved)
    steps = scored.groupBy(F.col("_f").alias("feature"), F.col("_b").alias("bin")).agg(
        (F.avg(F.when(F.col("_s") == 1, F.col("prediction"))) - F.avg(F.when(F.col("_s") == 0, F.col("prediction")))).alias("_step"), F.count_if(F.col("_s") == 1).alias("n"), F.max(F.when(F.col("_s") == 1, F.col("_v"))).alias("upper"))
    run = Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    of = Window.partitionBy("feature")
    out = steps.withColumn("_sum", F.sum("_step").over(run))
    return out.select("feature", "bin", "upper", "n", (F.col("_sum") - F.sum(F.col("_sum") * F.col("n")).over(of) / F.sum("n").over(of)).alias("effect"))


def multipliers(repeats: int, seed: int) -> list[tuple[int, int, int]]:
    """Two primes and a shift for each repeat, by a rule from the seed."""
    primes, n = [], 1_000_003 + 2 * (abs(seed) % 1_000_000)
    while len(primes) < 2 * repeats:
        if all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            primes.append(n)
        n += 2
    return [(primes[2 * k], primes[2 * k + 1], 104_729 * (seed + k) + 7919 * k * k + 1) for k in range(repeats)]


def giver(rank: Column, n: Column, repeat: tuple[int, int, int]) -> Column:
    """The rank whose value a rank takes, both from 0: a bijection of 0 .. n - 1, as the factor shares no divisor with n (of two primes at least one doesn't, up to 10^12 rows)."""
    one, two, shift = repeat
    factor = F.when(n % one != 0, F.lit(one)).otherwise(F.lit(two)).cast("bigint")
    return F.pmod(rank * factor + F.lit(shift).cast("bigint"), n)


def permutation_importance(model, frame: DataFrame, features: Sequence[str], target: str, repeats: int = 3, seed: int = 42, season: Sequence[str] = (PERIOD[0],), order: Column | None = None) -> DataFrame:
    """feature, importance, deviation: growth of the MAE when a feature is shuffled among the rows of its season.

    A season's rows are numbered once, by a hash (or `order`, a bigint) and in ranges of it. Who gives a row its value is computed from its number: a bijection that is another one in each
    repeat. All features and repeats go through one transform. Rows without a season or without a target are left out.
    """
    rows = frame.dropna(subset=[*season, target]).withColumn("_row", F.xxhash64(*(F.col(f"`{c}`") for c in frame.columns)))
    rows = rows.withColumn("_order", F.xxhash64("_row", F.lit(seed)) if order is None else order.cast("bigint"))
    rows = staged(rows, "shuffled")
    numbered = staged(ranks.by_hash(rows, season, F.col("_order"), ["_row"], "_n").withColumn("_n", F.col("_n") - 1), "numbered")
    sizes = numbered.groupBy(*season).agg(F.count(F.lit(1)).alias("_size"))  # a row a season
    from_ = F.array(*(F.struct(F.lit(k).alias("_repeat"), giver(F.col("_n"), F.col("_size"), m).alias("_from")) for k, m in enumerate(multipliers(repeats, seed))))
    taking = ranks.beside(numbered, sizes, season).withColumn("_x", F.explode(from_)).select("*", "_x.*").drop("_x", "_n", "_size")
    giving = numbered.select(*season, F.col("_n").alias("_from"), *(F.col(f"`{f}`").alias(f"_new_{f}") for f in features))
    mixed = taking.join(giving, [*season, "_from"])
    each = mixed.withColumn("_f", F.explode(F.array(F.lit("_base"), *map(F.lit, features))))
    shuffled = each.withColumns({f: F.when(F.col("_f") == f, F.col(f"`_new_{f}`")).otherwise(F.col(f"`{f}`")) for f in features})
    errors = model.transform(shuffled).groupBy("_f", "_repeat").agg(F.avg(F.abs(F.col("prediction") - F.col(target))).alias("mae"))
    base = errors.where("_f = '_base'").select("_repeat", F.col("mae").alias("_base"))
    grown = errors.where("_f <> '_base'").join(F.broadcast(base), "_repeat").withColumn("_d", F.col("mae") - F.col("_base"))
    return grown.groupBy(F.col("_f").alias("feature")).agg(F.avg("_d").alias("importance"), F.stddev_pop("_d").alias("deviation"))


def shapley_values(model, sample: DataFrame, background: DataFrame, features: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """ids, feature, value, base: over two orders of the features (forward and back) the changes that each makes on its way from a
    background row to the sample's, averaged. base + the values of a row = its prediction. Both frames must be small, bounded samples.
    """
    orders = [list(features), list(reversed(features))]
    steps = F.array(*(F.struct(F.lit(o).alias("_o"), F.lit(k).alias("_k")) for o in range(2) for k in range(len(features) + 1)))
    other = background.select(*(F.col(f).alias(f"_bg_{f}") for f in features)).withColumn("_bg", F.monotonically_increasing_id())
    paths = sample.select(*ids, *features).crossJoin(F.broadcast(other)).withColumn("_x", F.explode(steps)).select("*", "_x.*").drop("_x")

    def place(f: str) -> Column:
        return F.when(F.col("_o") == 0, orders[0].index(f)).otherwise(orders[1].index(f))

    moved = paths.withColumns({f: F.when(place(f) < F.col("_k"), F.col(f)).otherwise(F.col(f"_bg_{f}")) for f in features})
    scored = model.transform(moved).select(*ids, "_bg", "_o", "_k", "prediction")
    w = Window.partitionBy(*ids, "_bg", "_o").orderBy("_k")
    change = scored.withColumns({"_d": F.col("prediction") - F.lag("prediction").over(w), "_start": F.first("prediction").over(w)}).where("_k > 0")
    name = F.when(F.col("_o") == 0, F.get(F.array(*map(F.lit, orders[0])), F.col("_k") - 1)).otherwise(F.get(F.array(*map(F.lit, orders[1])), F.col("_k") - 1))
    return change.withColumn("feature", name).groupBy(*ids, "feature").agg(F.avg("_d").alias("value"), F.avg("_start").alias("base"))


def bounded_sample(frame: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """At most so many rows, by a seeded order."""
    return frame.orderBy(F.xxhash64(F.lit(seed), *(F.col(c) for c in frame.columns))).limit(rows)
