"""Queries of models, explanations and files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosted, explain, models, svr
from ..session import scratch
from ..sources import io
from ..sources.publish import Output, publish, read_published
from .views import FT, M, features, m, p, query, table

FEATURES = ["last_1", "last_10", "month"]
IDS = ["entity", "season", "week"]


def frame(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select(*IDS, (F.col("h_last_1_score") / 1000).alias("last_1"), (F.col("h_last_10_score") / 1000).alias("last_10"), F.col("week").cast("double").alias("month"), (F.col("score") / 1000).alias("target"))


def split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = frame(spark, d)
    return rows.where("season < 1997"), rows.where("season = 1997")


def told(rows: DataFrame) -> DataFrame:
    return rows.select(*IDS, F.round("target", 6).alias("target"), F.round("prediction", 4).alias("prediction"))


@query()
def fit_linear(spark: SparkSession, d: str) -> DataFrame:
    train, test = split(spark, d)
    return told(models.project(models.robust_linear(FEATURES, "target"), train, test, "target"))


@query()
def fit_tree(spark: SparkSession, d: str) -> DataFrame:
    train, test = split(spark, d)
    return told(models.project(models.boosted_trees(FEATURES, "target"), train, test, "target"))


@query()
def fit_svr(spark: SparkSession, d: str) -> DataFrame:
    """The kernel regression with its defaults but for the kernel."""
    train, test = split(spark, d)
    return told(svr.Svr(FEATURES, "target", svr.Point(kernel="rbf", gamma=0.1)).fit(train).transform(test))


@query()
def fit_boosted(spark: SparkSession, d: str) -> DataFrame:
    train, test = split(spark, d)
    return told(boosted.Boosted(FEATURES, "target", rounds=10, bags=2, pairs=1).fit(train).transform(test))


@query()
def svr_search(spark: SparkSession, d: str) -> DataFrame:
    """Points of one map, side by side over all folds."""
    points = [svr.Point(c, e) for c in (0.25, 1.0) for e in (0.05, 0.25)]
    found = svr.search(frame(spark, d), FEATURES, "target", points, folds=3)
    return spark.createDataFrame([(p.c, p.epsilon, round(s, 2)) for p, s in found], "c double, epsilon double, mae double")


@query()
def grid_select(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d).persist()
    grid = [(f"ridge {r} of {len(f)}", models.robust_linear(f, "target", regularisation=r)) for r in (0.01, 1.0) for f in (FEATURES, FEATURES[:2])]
    out = spark.createDataFrame([(n, round(s, 3)) for n, s in models.grid_select(rows, grid, "target", folds=2)], "candidate string, mae double")
    rows.unpersist()
    return out


def additive(spark: SparkSession, d: str) -> tuple[models.AdditiveModel, DataFrame]:
    train, test = split(spark, d)
    return models.Additive(FEATURES, "target", pairs=1).fit(train), test


@query()
def additive_terms(spark: SparkSession, d: str) -> DataFrame:
    model, test = additive(spark, d)
    return explain.additive_terms(model, test).select("feature", "bin", "n", *(F.round(c, 4).alias(c) for c in ("weight", "centred", "importance")))


@query()
def local_terms(spark: SparkSession, d: str) -> DataFrame:
    model, test = additive(spark, d)
    return explain.local_terms(model, test, IDS).select(*IDS, "feature", "bin", *(F.round(c, 4).alias(c) for c in ("weight", "intercept", "prediction")))


def linear(spark: SparkSession, d: str):
    train, test = split(spark, d)
    return models.robust_linear(FEATURES, "target").fit(train), test


@query()
def ale_curve(spark: SparkSession, d: str) -> DataFrame:
    model, test = linear(spark, d)
    return explain.accumulated_effects(model, test, FEATURES).select("feature", "bin", "n", F.round("upper", 4).alias("upper"), F.round("effect", 4).alias("effect"))


@query()
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    model, test = linear(spark, d)
    return explain.permutation_importance(model, test, FEATURES, "target").select("feature", F.round("importance", 4).alias("importance"), F.round("deviation", 4).alias("deviation"))


@query()
def shap_sample(spark: SparkSession, d: str) -> DataFrame:
    """A report on bounded samples: 25 rows against 50 of the background."""
    model, test = linear(spark, d)
    sample, background = explain.bounded_sample(test, 25), explain.bounded_sample(frame(spark, d).where("season < 1997"), 50)
    return explain.shapley_values(model, sample, background, FEATURES, IDS).select(*IDS, "feature", F.round("value", 4).alias("value"), F.round("base", 4).alias("base"))


class Formula:
    """A predictor in closed form, so that explanations can be held against SQL."""

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", F.expr(FORMULA))


FORMULA = "last_1 * month / 12 + abs(last_10 - 150) / 2"
_ROWS = """X AS (SELECT entity, season, week, h_last_1_score / 1000 AS last_1, h_last_10_score / 1000 AS last_10, CAST(week AS DOUBLE) AS month FROM FT)"""


def _moved(feature: str, edge: str) -> str:
    """The formula with one feature at an edge."""
    return re.sub(rf"\b{feature}\b", edge, FORMULA)


_STEPS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, least(greatest(len(list_filter(q, lambda e: e < {f})), 1), len(q) - 1) AS j, q, {_moved(f, 'q[j + 1]')} - ({_moved(f, 'q[j]')}) AS step FROM T, "
    f"(SELECT list_sort(list_distinct(list_concat([min({f}), max({f})], quantile_disc({f}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])))) AS q FROM T)"
    for f in FEATURES
)


@query(f"""WITH {FT}, {_ROWS}, T AS (SELECT * FROM X WHERE season = 1997), L AS ({_STEPS}),
B AS (SELECT feature, j AS bin, any_value(q[j + 1]) AS upper, count(*) AS n, avg(step) AS step FROM L GROUP BY ALL),
C AS (SELECT *, sum(step) OVER (PARTITION BY feature ORDER BY bin) AS run FROM B)
SELECT feature, bin, n, round(upper + 1.3e-7, 4) AS upper, round(run - sum(run * n) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) + 1.3e-7, 4) AS effect FROM C""")
def ale_formula(spark: SparkSession, d: str) -> DataFrame:
    out = explain.accumulated_effects(Formula(), split(spark, d)[1], FEATURES)
    return out.select("feature", F.col("bin").cast("bigint").alias("bin"), "n", F.round(F.col("upper") + 1.3e-7, 4).alias("upper"), F.round(F.col("effect") + 1.3e-7, 4).alias("effect"))


_PATHS = {
    # value of each feature on the way forward (those before it are the row's) and back (those after it are)
    "last_1": ("f(last_1, b10, bm) - f(b1, b10, bm)", "f(last_1, last_10, month) - f(b1, last_10, month)"),
    "last_10": ("f(last_1, last_10, bm) - f(last_1, b10, bm)", "f(b1, last_10, month) - f(b1, b10, month)"),
    "month": ("f(last_1, last_10, month) - f(last_1, last_10, bm)", "f(b1, b10, month) - f(b1, b10, bm)"),
}


def _called(text: str) -> str:
    """f(a, b, c) written out."""
    return re.sub(r"f\((\w+), (\w+), (\w+)\)", r"(\1 * \3 / 12 + abs(\2 - 150) / 2)", text)


_VALUES = " UNION ALL ".join(f"SELECT entity, season, week, '{f}' AS feature, ({_called(one)} + {_called(two)}) / 2 AS value, {_called('f(b1, b10, bm)')} AS base FROM T, G" for f, (one, two) in _PATHS.items())


@query(f"""WITH {FT}, {_ROWS}, T AS (SELECT * FROM X WHERE season = 1997), G AS (SELECT avg(last_1) AS b1, avg(last_10) AS b10, month AS bm FROM X WHERE season < 1997 GROUP BY month), V AS ({_VALUES})
SELECT entity, season, week, feature, round(avg(value) + 1.3e-7, 4) AS value, round(avg(base) + 1.3e-7, 4) AS base FROM V GROUP BY ALL""")
def shap_formula(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the test year against a background of one mean row a month of the years before."""
    train, test = split(spark, d)
    background = train.groupBy("month").agg(F.avg("last_1").alias("last_1"), F.avg("last_10").alias("last_10"))
    out = explain.shapley_values(Formula(), test, background, FEATURES, IDS)
    return out.select(*IDS, "feature", *(F.round(F.col(c) + 1.3e-7, 4).alias(c) for c in ("value", "base")))


_REPEATS, _SEED = 3, 42
_GIVERS = " UNION ALL ".join(
    f"SELECT *, {k} AS repeat, (n * CASE WHEN size % {one} <> 0 THEN {one} ELSE {two} END + {shift}) % size AS giver FROM N" for k, (one, two, shift) in enumerate(explain.multipliers(_REPEATS, _SEED))
)
_ERRORS = " UNION ALL ".join(f"SELECT '{f}' AS feature, repeat, avg(abs({_moved(f, f'new_{f}')} - target)) - avg(abs({FORMULA} - target)) AS grown FROM Z GROUP BY repeat" for f in FEATURES)


@query(f"""WITH {FT}, X AS (SELECT entity, season, week, h_last_1_score / 1000 AS last_1, h_last_10_score / 1000 AS last_10, CAST(week AS DOUBLE) AS month, score / 1000 AS target, md5(entity || '|' || season || '|' || week) AS h FROM FT),
N AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY substr(h, 1, 15)) - 1 AS n, count(*) OVER (PARTITION BY season) AS size FROM X), T AS ({_GIVERS}),
Z AS (SELECT T.*, G.last_1 AS new_last_1, G.last_10 AS new_last_10, G.month AS new_month FROM T JOIN N G ON T.season = G.season AND T.giver = G.n), E AS ({_ERRORS})
SELECT feature, round(avg(grown) + 1.3e-7, 4) AS importance, round(stddev_pop(grown) + 1.3e-7, 4) AS deviation FROM E GROUP BY feature""")
def permutation_formula(spark: SparkSession, d: str) -> DataFrame:
    """Every row is numbered within its season by a hash that SQL has, too."""
    order = F.conv(F.substring(F.md5(F.concat_ws("|", *IDS)), 1, 15), 16, 10).cast("bigint")
    out = explain.permutation_importance(Formula(), frame(spark, d), FEATURES, "target", _REPEATS, _SEED, order=order)
    return out.select("feature", *(F.round(F.col(c) + 1.3e-7, 4).alias(c) for c in ("importance", "deviation")))


class FormulaTerms:
    """An additive model in closed form: ten steps of the last value, and the month."""

    terms, intercept = ["last_1", "month"], 7.5

    def coefficients(self, rows: DataFrame) -> list[tuple[str, int, float]]:
        return [("last_1", b, 2.5 * b - 3) for b in range(10)] + [("month", b, float(b % 4)) for b in range(1, 13)]

    def transform(self, rows: DataFrame) -> DataFrame:
        step = F.least(F.floor(F.col("last_1") / 50), F.lit(9)).cast("int")
        rows = rows.withColumns({"_bin_last_1": step, "_bin_month": F.col("month").cast("int")})
        return rows.withColumn("prediction", 7.5 + 2.5 * F.col("_bin_last_1") - 3 + F.col("_bin_month") % 4)


_TERMS = """B AS (SELECT entity, season, week, CAST(least(floor(last_1 / 50), 9) AS INTEGER) AS b1, CAST(month AS INTEGER) AS b2 FROM X WHERE season = 1997),
L AS (SELECT entity, season, week, 'last_1' AS feature, b1 AS bin, 2.5 * b1 - 3 AS weight, 7.5 + 2.5 * b1 - 3 + b2 % 4 AS prediction FROM B
      UNION ALL SELECT entity, season, week, 'month', b2, b2 % 4, 7.5 + 2.5 * b1 - 3 + b2 % 4 FROM B)"""


@query(f"WITH {FT}, {_ROWS}, {_TERMS} SELECT entity, season, week, feature, bin, CAST(weight AS DOUBLE) AS weight, CAST(7.5 AS DOUBLE) AS intercept, CAST(prediction AS DOUBLE) AS prediction FROM L")
def local_terms_formula(spark: SparkSession, d: str) -> DataFrame:
    return explain.local_terms(FormulaTerms(), split(spark, d)[1], IDS)


@query(f"""WITH {FT}, {_ROWS}, {_TERMS}, C AS (SELECT feature, bin, weight, count(*) AS n FROM L GROUP BY ALL), D AS (SELECT *, weight - sum(weight * n) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS centred FROM C)
SELECT feature, bin, n, CAST(weight AS DOUBLE) AS weight, round(centred + 1.3e-7, 4) AS centred, round(sum(abs(centred) * n) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) + 1.3e-7, 4) AS importance FROM D""")
def additive_terms_formula(spark: SparkSession, d: str) -> DataFrame:
    out = explain.additive_terms(FormulaTerms(), split(spark, d)[1])
    return out.select("feature", "bin", "n", "weight", *(F.round(F.col(c) + 1.3e-7, 4).alias(c) for c in ("centred", "importance")))


@query("""SELECT 'source' AS role, 'orders' AS name, count(*) AS n_rows, '{"entity":"customer"}' AS parameters FROM orders UNION ALL SELECT 'source', 'customer', count(*), '{"entity":"customer"}' FROM customer
UNION ALL SELECT 'output', 'orders of customers', count(*), '{"entity":"customer"}' FROM orders JOIN customer ON o_custkey = c_custkey""")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    """A manifest without its fingerprints, which SQL doesn't have."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return io.manifest([("orders", orders), ("customer", customer)], [("orders of customers", joined)], {"entity": "customer"}).select("role", "name", "n_rows", "parameters")


def _published(spark: SparkSession, d: str) -> str:
    """Orders published as two outputs by the year."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year(F.to_date("o_orderdate")).alias("season"), "o_totalprice")
    path, season = scratch(spark, "published"), F.col("season")
    out = Output("orders", rows.schema)
    publish([(rows, {"train": (out, season.between(1994, 1996)), "test": (out, season == 1997)})], path)
    return path


@query("""SELECT o_orderkey, o_custkey, year(CAST(o_orderdate AS DATE)) AS season, o_totalprice, CASE WHEN year(CAST(o_orderdate AS DATE)) = 1997 THEN 'test' ELSE 'train' END AS output FROM orders
WHERE year(CAST(o_orderdate AS DATE)) BETWEEN 1994 AND 1997""")
def published_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Two outputs written in one pass under a contract and read back by their manifest."""
    path = _published(spark, d)
    parts = [read_published(spark, path, n).withColumn("output", F.lit(n)) for n in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, year(CAST(o_orderdate AS DATE)) AS season FROM orders WHERE year(CAST(o_orderdate AS DATE)) BETWEEN 1995 AND 1996 GROUP BY 3")
def season_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Orders stored by season, one season replaced by itself, and two read by a filter on folders."""
    rows, path = table(spark, d, "orders").withColumn("season", F.year(F.to_date("o_orderdate"))), scratch(spark, "seasons")
    io.write_partitions(rows, path, "season")
    io.write_partitions(rows.where("season = 1996"), path, "season")
    kept = spark.read.parquet(path).where(F.col("season").between(1995, 1996))
    return kept.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows, path = table(spark, d, "nation"), scratch(spark, "csv")
    io.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows, path = table(spark, d, "customer"), scratch(spark, "dataset")
    io.write_dataset(rows, path, rows.schema, nullable=rows.columns)
    return io.read_dataset(spark, path, expected=io.fingerprint(rows, "customer").first()["fingerprint"])


@query(f"WITH {M} SELECT player_id, target_season, target_week, prediction, CASE WHEN model = 'A' THEN position END AS position, CASE model WHEN 'A' THEN 'MEAN' ELSE 'Newest' END AS model FROM M")
def predictions_from_files(spark: SparkSession, d: str) -> DataFrame:
    rows, path = m(spark, d), scratch(spark, "models")
    identity = ["player_id", "target_season", "target_week"]
    io.prediction_columns(rows.where("model = 'A'"), identity, ["position"]).write.parquet(f"{path}/mean")
    io.prediction_columns(rows.where("model = 'B'"), identity).write.parquet(f"{path}/newest")
    return io.read_predictions(spark, [f"{path}/mean", f"{path}/newest"]).select("player_id", "target_season", "target_week", "prediction", "position", "model")


@query()
def frame_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return io.fingerprint(table(spark, d, "lineitem"), "lineitem").unionByName(io.fingerprint(table(spark, d, "orders"), "orders"))


@query()
def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    return io.manifest([("orders", table(spark, d, "orders")), ("customer", table(spark, d, "customer"))], [("panel", p(spark, d))], {"entity": "customer", "period": "month"})
