"""The driver's tables as panels, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boards, panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column) -> Column:
    """Means of two-decimal inputs, compared at six places; the shift keeps means off the ties that engines round differently."""
    return F.round(c + 1.3e-7, 6)


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def p(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a panel: customers by month."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    day = F.to_date("o_orderdate")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("entity"), long(F.year(day)).alias("season"), long(F.month(day)).alias("week"), day.alias("day"),
        F.col("c_name").alias("name"), F.col("n_name").alias("team"), F.col("c_mktsegment").alias("position"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


P = """P AS (
  SELECT o_orderkey AS seq, o_custkey AS entity, CAST(year(o_orderdate) AS BIGINT) AS season, CAST(month(o_orderdate) AS BIGINT) AS week, CAST(o_orderdate AS DATE) AS day,
         c_name AS name, n_name AS team, c_mktsegment AS position, o_totalprice AS score, o_orderstatus AS status, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def pd(spark: SparkSession, d: str) -> DataFrame:
    return panel.last_write(p(spark, d), ["entity", "season", "week"], ["day", "seq"], within=["entity"])


PD = P + """, PD AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY entity, season, week ORDER BY day DESC, seq DESC) AS rn FROM P) WHERE rn = 1)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    return panel.with_history(panel.history_features(pd(spark, d), ["score"], "h"), "h")


FT = PD + """, FT AS (
  SELECT * FROM (
    SELECT *, lag(season) OVER w AS h_through_season, lag(week) OVER w AS h_through_week, lag(score) OVER w AS h_last_1_score,
           avg(score) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h_last_10_score
    FROM PD WINDOW w AS (PARTITION BY entity ORDER BY season, week))
  WHERE h_through_season IS NOT NULL)"""


def m(spark: SparkSession, d: str) -> DataFrame:
    """Two models without training: A the mean of the last ten rows, B the last row."""
    f = features(spark, d)
    told = f.select(
        F.col("entity").cast("string").alias("player_id"), F.col("name").alias("player_name"), "position", "team", F.col("season").alias("target_season"), F.col("week").alias("target_week"),
        F.when(F.col("status") != "P", F.col("score")).alias("actual"), ((F.col("status") == "P") & (F.col("priority") == "1-URGENT")).alias("missed"), "h_last_10_score", "h_last_1_score",
        F.col("h_through_season").alias("history_through_season"))
    each = F.explode(F.array(F.struct(F.lit("A").alias("model"), r6(F.col("h_last_10_score")).alias("prediction")), F.struct(F.lit("B").alias("model"), r6(F.col("h_last_1_score")).alias("prediction")))).alias("x")
    return boards.prepare(told.select("*", each).select("*", "x.*").drop("x"))


M = FT + """, T AS (
  SELECT CAST(entity AS VARCHAR) AS player_id, name AS player_name, position, team, season AS target_season, week AS target_week,
         CASE WHEN status <> 'P' THEN score END AS actual, status = 'P' AND priority = '1-URGENT' AS missed, h_last_10_score, h_last_1_score
  FROM FT), M0 AS (
  SELECT * EXCLUDE (h_last_10_score, h_last_1_score), 'A' AS model, round(h_last_10_score + 1.3e-7, 6) AS prediction FROM T
  UNION ALL SELECT * EXCLUDE (h_last_10_score, h_last_1_score), 'B', round(h_last_1_score + 1.3e-7, 6) FROM T
), M AS (SELECT *, prediction - actual AS error, abs(prediction - actual) AS absolute_error FROM M0)"""

CONSENSUS = M + """, C AS (
  SELECT player_id, player_name, position, team, target_season, target_week, avg(prediction) AS prediction, coalesce(stddev_samp(prediction), 0) AS spread,
         count(DISTINCT model) AS models, max(actual) AS actual, bool_or(missed) AS missed
  FROM M GROUP BY ALL)"""


def s(spark: SparkSession, d: str) -> DataFrame:
    """Line items as counting stats of an order."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(
        F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), count("l_returnflag", "A").alias("n_a"), count("l_returnflag", "N").alias("n_n"), count("l_returnflag", "R").alias("n_r"),
        count("l_linestatus", "F").alias("n_f"), count("l_linestatus", "O").alias("n_o"))


S = """S AS (
  SELECT l_orderkey AS orderkey, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, count(*) FILTER (WHERE l_returnflag = 'A') AS n_a, count(*) FILTER (WHERE l_returnflag = 'N') AS n_n,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_r, count(*) FILTER (WHERE l_linestatus = 'F') AS n_f, count(*) FILTER (WHERE l_linestatus = 'O') AS n_o
  FROM lineitem GROUP BY 1)"""


def g(spark: SparkSession, d: str) -> DataFrame:
    """Orders as games: the customer's nation at home to the nation of the first supplier."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(
        F.min("l_suppkey").alias("s_suppkey"), F.coalesce(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))), F.lit(0.0)).alias("home_score"),
        F.coalesce(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))), F.lit(0.0)).alias("away_score"))
    away = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("away"))
    home = p(spark, d).select("seq", "entity", "season", "week", "day", F.col("team").alias("home"), "position", "score")
    return home.join(lines, "seq").join(away, "s_suppkey").drop("s_suppkey")


G = P + """, G AS (
  SELECT P.seq, entity, season, week, day, P.team AS home, position, score, home_score, away_score, n_name AS away
  FROM P JOIN (SELECT l_orderkey, min(l_suppkey) AS k, coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0) AS home_score, coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0) AS away_score
               FROM lineitem GROUP BY 1) ON l_orderkey = P.seq
  JOIN supplier ON s_suppkey = k JOIN nation ON s_nationkey = n_nationkey)"""


def x(spark: SparkSession, d: str) -> DataFrame:
    """Events as depth charts: slots of teams by day, ranked by value."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), (F.col("user_id") % 10).alias("team"), F.col("event_type").alias("slot"), "value", "event_id", "user_id")
    return e.withColumn("rank", long(F.row_number().over(Window.partitionBy("day", "team", "slot").orderBy(F.desc("value"), "event_id"))))


X = """X AS (
  SELECT *, row_number() OVER (PARTITION BY day, team, slot ORDER BY value DESC, event_id) AS rank
  FROM (SELECT CAST(ts AS DATE) AS day, user_id % 10 AS team, event_type AS slot, value, event_id, user_id FROM events))"""


def r(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as games (purchases), game reports (errors, views) and reserve lists (signups) of users by day."""
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.lit(2024).cast("bigint").alias("season"), long(F.dayofmonth("ts")).alias("week"), "event_type", "value")
    key = ["entity", "season", "week"]
    games = e.where("event_type = 'purchase'").groupBy(*key).agg(F.round(F.sum("value"), 2).alias("score"))
    listed = e.where("event_type in ('error', 'view')").select(*key, F.when(F.col("event_type") == "error", "Out").otherwise("Questionable").alias("status")).distinct()
    reserve = e.where("event_type = 'signup'").select(*key, F.lit("RES").alias("status")).distinct()
    return games, listed, reserve


R = """E AS (SELECT user_id AS entity, CAST(2024 AS BIGINT) AS season, CAST(dayofmonth(ts) AS BIGINT) AS week, event_type, value FROM events),
GAMES AS (SELECT entity, season, week, round(sum(value), 2) AS score FROM E WHERE event_type = 'purchase' GROUP BY ALL),
LISTED AS (SELECT DISTINCT entity, season, week, CASE WHEN event_type = 'error' THEN 'Out' ELSE 'Questionable' END AS status FROM E WHERE event_type IN ('error', 'view')),
RESERVE AS (SELECT DISTINCT entity, season, week, 'RES' AS status FROM E WHERE event_type = 'signup'),
A AS (SELECT entity, season, week, string_agg(DISTINCT status, ' / ' ORDER BY status) AS status FROM (FROM LISTED UNION ALL FROM RESERVE) GROUP BY ALL)"""
