"""Queries of panels, as-of joins, rosters and absences on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import presets, scalar
from ..operators import absence, asof, panel, ranks, roster
from ..session import staged
from .views import FT, G, P, PD, R, S, X, features, g, long, p, pd, query, r, r6, s, table, x

KEY = ["entity", "season", "week"]


@query(f"WITH {PD} SELECT entity, season, week, seq, score FROM PD")
def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    return pd(spark, d).select(*KEY, "seq", "score")


@query(f"WITH {FT} SELECT entity, season, week, h_through_season, h_through_week, h_last_1_score, round(h_last_10_score + 1.3e-7, 6) AS h_last_10_score FROM FT")
def lag_trailing_features(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select(*KEY, "h_through_season", "h_through_week", "h_last_1_score", r6(F.col("h_last_10_score")).alias("h_last_10_score"))


@query(f"""WITH {PD}, K AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY season DESC, week DESC) AS k FROM PD)
SELECT entity, round(avg(score) FILTER (WHERE k <= 5) + 1.3e-7, 6) AS last_5_score, round(avg(score) FILTER (WHERE k <= 10) + 1.3e-7, 6) AS last_10_score FROM K GROUP BY entity""")
def trailing_last_n(spark: SparkSession, d: str) -> DataFrame:
    out = panel.last_means(pd(spark, d), ["entity"], ["season", "week"], "score", [5, 10])
    return out.select("entity", *(r6(F.col(c)).alias(c) for c in ("last_5_score", "last_10_score")))


@query(f"WITH {S} SELECT orderkey, round(qty * 0.25 + n_a * 2 - n_r * 1.5 + n_f + 1.3e-7, 6) AS score, n_a + n_n AS kept_lines, n_r + n_o AS turnovers FROM S")
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    score = scalar.weighted_score({"qty": 0.25, "n_a": 2, "n_r": -1.5, "n_f": 1})
    return s(spark, d).select("orderkey", r6(score).alias("score"), scalar.totals(["n_a", "n_n"]).alias("kept_lines"), scalar.totals(["n_r", "n_o"]).alias("turnovers"))


@query(f"""WITH {S} SELECT orderkey, CASE WHEN n_o <= 0 THEN 10.0 WHEN n_o <= 6 THEN 7.0 WHEN n_o <= 13 THEN 4.0 WHEN n_o <= 20 THEN 1.0 WHEN n_o <= 27 THEN 0.0 WHEN n_o <= 34 THEN -1.0 ELSE -4.0 END::DOUBLE AS points,
CASE WHEN qty <= 0 THEN 10.0 WHEN qty <= 6 THEN 7.0 WHEN qty <= 13 THEN 4.0 WHEN qty <= 20 THEN 1.0 WHEN qty <= 27 THEN 0.0 WHEN qty <= 34 THEN -1.0 ELSE -4.0 END::DOUBLE AS by_quantity FROM S""")
def tiered_score(spark: SparkSession, d: str) -> DataFrame:
    return s(spark, d).select("orderkey", scalar.tiered(F.col("n_o")).alias("points"), scalar.tiered(F.col("qty")).alias("by_quantity"))


@query("SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'NATION_2' WHEN 'NATION_7' THEN 'NATION_8' ELSE n_name END AS code FROM nation")
def alias_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", scalar.current_code(F.col("n_name"), {"NATION_1": "NATION_2", "NATION_7": "NATION_8"}).alias("code"))


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(coalesce(CASE WHEN event_type = 'purchase' THEN value END, 0) AS DOUBLE) AS spent FROM events")
def null_default_cast(spark: SparkSession, d: str) -> DataFrame:
    spent = scalar.number_or_zero(F.when(F.col("event_type") == "purchase", F.col("value")))
    return table(spark, d, "events").select("event_id", scalar.as_day(F.col("ts")).cast("string").alias("day"), spent.alias("spent"))


@query(f"""WITH {P}, F AS (SELECT entity, min(day) AS born, min(season) AS first FROM P GROUP BY entity)
SELECT seq, round(date_diff('day', born, day) / 365.2425, 6) AS age, greatest(season - first, 0) AS experience FROM P JOIN F USING (entity)""")
def experience_age(spark: SparkSession, d: str) -> DataFrame:
    rows = p(spark, d)
    first = rows.groupBy("entity").agg(F.min("day").alias("born"), F.min("season").alias("first"))
    return rows.join(first, "entity").select("seq", F.round(scalar.age_years(F.col("born"), F.col("day")), 6).alias("age"), scalar.experience(F.col("season"), F.col("first")).alias("experience"))


@query("SELECT l_orderkey, l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_returnflag <> 'R') AS kept FROM lineitem GROUP BY ALL")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    back = F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count_if(back).alias("returned"), F.count_if(~back).alias("kept"))


@query("""WITH T AS (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1), K AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_suppkey, qty, total, round(CASE WHEN total > 0 THEN qty / total ELSE 0 END + 1.3e-7, 6) AS share FROM K JOIN T USING (l_orderkey)""")
def group_share(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("qty"))
    totals = panel.group_totals(lines, ["l_orderkey"], ["qty"])
    return lines.join(totals, "l_orderkey").select("l_orderkey", "l_suppkey", "qty", F.col("total_qty").alias("total"), r6(scalar.ratio_or_zero(F.col("qty"), F.col("total_qty"))).alias("share"))


@query("""SELECT l_orderkey, sum(coalesce(l_quantity, 0)) AS total_qty, count(*) FILTER (WHERE coalesce(l_extendedprice, 0) <> 0 OR coalesce(l_quantity, 0) > 0) AS active
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('ECONOMY', 'STANDARD') GROUP BY 1""")
def restricted_group_volume(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).where(F.col("p_type").isin("ECONOMY", "STANDARD"))
    active = scalar.participated(F.col("l_extendedprice"), [F.col("l_quantity")])
    return lines.groupBy("l_orderkey").agg(F.sum(F.coalesce("l_quantity", F.lit(0.0))).alias("total_qty"), F.count_if(active).alias("active"))


@query(f"""WITH {G} SELECT seq, home AS team, away_score AS allowed FROM G UNION ALL SELECT seq, away, home_score FROM G WHERE away <> home""")
def side_resolution(spark: SparkSession, d: str) -> DataFrame:
    games = g(spark, d)
    teams = games.select("seq", "home", "away", "home_score", "away_score", F.explode(F.array_distinct(F.array("home", "away"))).alias("team"))
    col = F.col
    return teams.select("seq", "team", roster.resolve_side(col("team"), col("home"), col("away"), col("away_score"), col("home_score")).alias("allowed"))


_DEF = """D AS (SELECT team, season, week, avg(allowed) AS allowed FROM (SELECT home AS team, season, week, away_score AS allowed FROM G UNION ALL SELECT away, season, week, home_score FROM G) GROUP BY ALL),
DH AS (SELECT team, season, week, lag(allowed) OVER w AS last_1, avg(allowed) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS last_10 FROM D WINDOW w AS (PARTITION BY team ORDER BY season, week))"""


@query(f"WITH {G}, {_DEF} SELECT seq, home, away, round(last_1 + 1.3e-7, 6) AS opponent_last_1, round(last_10 + 1.3e-7, 6) AS opponent_last_10 FROM G LEFT JOIN DH ON away = team AND G.season = DH.season AND G.week = DH.week")
def opponent_history_join(spark: SparkSession, d: str) -> DataFrame:
    games = staged(g(spark, d).select("seq", "season", "week", "home", "away", "home_score", "away_score"), "games")
    sides = roster.two_rows(games, ["season", "week"], {"team": ("home", "away"), "allowed": ("away_score", "home_score")})
    defense = sides.groupBy("team", "season", "week").agg(F.avg("allowed").alias("allowed"))
    history = panel.history_features(defense, ["allowed"], "d", ["team"]).select(F.col("team").alias("away"), "season", "week", "d_last_1_allowed", "d_last_10_allowed")
    return games.join(history, ["away", "season", "week"], "left").select("seq", "home", "away", r6(F.col("d_last_1_allowed")).alias("opponent_last_1"), r6(F.col("d_last_10_allowed")).alias("opponent_last_10"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS n_unmatched FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey")
def required_match_report(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return roster.match_report(table(spark, d, "lineitem").select("l_orderkey"), orders, ["l_orderkey"])


@query(f"WITH {G} SELECT seq, home AS team, away AS opponent, home_score AS points, CAST(1 AS BIGINT) AS home FROM G UNION ALL SELECT seq, away, home, away_score, 0 FROM G")
def home_away_rows(spark: SparkSession, d: str) -> DataFrame:
    return roster.two_rows(g(spark, d), ["seq"], {"team": ("home", "away"), "opponent": ("away", "home"), "points": ("home_score", "away_score")})


_COHORT = """FS AS (SELECT entity, min(season) AS first FROM P GROUP BY entity), PC AS (SELECT P.*, first FROM P JOIN FS USING (entity)),
PN AS (SELECT season, week, season * 100 + week AS k, count(*) FILTER (WHERE season = first) AS n, sum(score) FILTER (WHERE season = first) AS t, max(season * 100 + week) FILTER (WHERE season = first) AS u FROM PC GROUP BY ALL)"""


@query(f"""WITH {P}, {_COHORT} SELECT a.season, a.week, CAST(sum(b.n) AS BIGINT) AS cohort_rows, round(sum(b.t) / sum(b.n) + 1.3e-7, 4) AS cohort_score, max(b.u) AS cohort_through
FROM PN a JOIN PN b ON b.k < a.k GROUP BY a.season, a.week HAVING sum(b.n) > 0""")
def cohort_asof_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = p(spark, d)
    first = rows.groupBy("entity").agg(F.min("season").alias("first"))
    out = asof.cohort_means(rows.join(first, "entity"), F.col("season") == F.col("first"), ["score"])
    return out.select("season", "week", "cohort_rows", F.round(F.col("cohort_score") + 1.3e-7, 4).alias("cohort_score"), "cohort_through")


@query(f"""WITH {P}, {_COHORT}, A AS (SELECT round(avg(score) + 1.3e-7, 4) AS fallback FROM PC WHERE season = first), L AS (SELECT entity, max(season) AS newest, avg(score) AS own FROM P WHERE season < 1998 GROUP BY entity)
SELECT c_custkey AS entity, newest, round(own + 1.3e-7, 4) AS own, coalesce(round(own + 1.3e-7, 4), fallback) AS score FROM customer LEFT JOIN L ON c_custkey = entity CROSS JOIN A""")
def cohort_overall_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = p(spark, d)
    first = rows.groupBy("entity").agg(F.min("season").alias("first"))
    fallback = rows.join(first, "entity").where("season = first").agg(F.round(F.avg("score") + 1.3e-7, 4).alias("fallback"))
    known = rows.where("season < 1998").groupBy("entity").agg(F.max("season").alias("newest"), F.round(F.avg("score") + 1.3e-7, 4).alias("own"))
    everyone = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    return everyone.join(known, "entity", "left").crossJoin(F.broadcast(fallback)).select("entity", "newest", "own", F.coalesce("own", "fallback").alias("score"))


@query(f"WITH {X}, Y AS (SELECT * FROM X WHERE day <= DATE '2024-01-15') SELECT CAST(day AS VARCHAR) AS day, team, slot, event_id, rank FROM Y WHERE day = (SELECT max(day) FROM Y)")
def snapshot_asof_global(spark: SparkSession, d: str) -> DataFrame:
    return asof.snapshot(x(spark, d), "day", F.lit("2024-01-15").cast("date")).select(F.col("day").cast("string").alias("day"), "team", "slot", "event_id", "rank")


@query(f"WITH {X}, Y AS (SELECT * FROM X WHERE day <= DATE '2024-01-15' AND slot = 'signup') SELECT CAST(day AS VARCHAR) AS day, team, slot, event_id, rank FROM Y WHERE (team, day) IN (SELECT (team, max(day)) FROM Y GROUP BY team)")
def snapshot_asof_group(spark: SparkSession, d: str) -> DataFrame:
    return asof.snapshot(x(spark, d).where("slot = 'signup'"), "day", F.lit("2024-01-15").cast("date"), ["team"]).select(F.col("day").cast("string").alias("day"), "team", "slot", "event_id", "rank")


@query(f"""WITH {PD}, K AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY season DESC, week DESC) AS rank FROM PD WHERE season * 100 + week < 199706)
SELECT entity, season, week, score, rank, (SELECT least(DATE '1997-06-30', min(day) - 1) FROM P WHERE season = 1997)::DATE::VARCHAR AS as_of FROM K WHERE rank <= 3""")
def cutoff_history(spark: SparkSession, d: str) -> DataFrame:
    rows = pd(spark, d)
    day = asof.forecast_day(p(spark, d).where("season = 1997"), "day", "season", F.lit("1997-06-30").cast("date")).select(F.col("as_of").cast("string").alias("as_of"))
    return asof.before_cutoff(rows, ["entity"], F.lit(199706), 3).crossJoin(F.broadcast(day)).select(*KEY, "score", "rank", "as_of")


@query(f"""WITH {X}, Y AS (SELECT day, team, CASE slot WHEN 'purchase' THEN 'K' ELSE slot END AS slot, event_id, rank FROM X), Z AS (SELECT *, min(rank) OVER (PARTITION BY day, team, slot) AS least FROM Y)
SELECT CAST(day AS VARCHAR) AS day, team, slot, event_id, rank FROM Z WHERE CASE WHEN slot IN ('K', 'signup') THEN rank = least ELSE rank <= CASE slot WHEN 'click' THEN 3 WHEN 'view' THEN 2 END END""")
def depth_filter(spark: SparkSession, d: str) -> DataFrame:
    slots = x(spark, d).withColumn("slot", F.when(F.col("slot") == "purchase", "K").otherwise(F.col("slot")))
    return roster.depth_filter(slots, ["day", "team"], "slot", "rank", ["K", "signup"], {"click": 3, "view": 2}).select(F.col("day").cast("string").alias("day"), "team", "slot", "event_id", "rank")


@query(f"""WITH {P}, Q AS (SELECT DISTINCT team, position, week FROM P WHERE season = 1996), GRID AS (SELECT * FROM (SELECT DISTINCT team FROM P), (SELECT DISTINCT position FROM P), (SELECT DISTINCT week FROM P)),
GAP AS (SELECT * FROM GRID ANTI JOIN Q USING (team, position, week)), B AS (SELECT team, position, week, entity, seq, score, row_number() OVER (PARTITION BY team, position, week ORDER BY score DESC, seq) AS rank FROM P WHERE season = 1995)
SELECT team, position, week, entity, seq, score, rank FROM GAP JOIN B USING (team, position, week) WHERE rank <= 2""")
def grid_completion(spark: SparkSession, d: str) -> DataFrame:
    rows = staged(p(spark, d).select("team", "position", "season", "week", "entity", "seq", "score"), "panel")
    slots = rows.select("team").distinct().crossJoin(F.broadcast(rows.select("position").distinct()))
    gaps = roster.grid_gaps(rows.where("season = 1996"), slots, rows.select("week").distinct())
    best = rows.where("season = 1995").select("team", "position", "week", "entity", "seq", "score")
    return roster.fill_gaps(gaps, best, ["team", "position", "week"], [F.desc("score"), F.col("seq")], 2)


@query("""WITH C AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer),
W AS (SELECT *, greatest(c_acctbal, 0) * (1 / sqrt(greatest(rank, 1))) AS w FROM C)
SELECT c_custkey, rank, round(CASE WHEN sum(w) OVER (PARTITION BY c_nationkey, c_mktsegment) > 0 THEN w / sum(w) OVER (PARTITION BY c_nationkey, c_mktsegment) ELSE 0 END + 1.3e-7, 6) AS share FROM W""")
def share_normalise(spark: SparkSession, d: str) -> DataFrame:
    group = ["c_nationkey", "c_mktsegment"]
    ranked = ranks.ordinal(table(spark, d, "customer").select("c_custkey", *group, "c_acctbal"), group, "c_acctbal", ["c_custkey"])
    return roster.shares(ranked, group, F.greatest("c_acctbal", F.lit(0.0)), F.col("rank")).select("c_custkey", "rank", r6(F.col("share")).alias("share"))


@query(f"WITH {P} SELECT position, y AS target_year, round(avg(score) + 1.3e-7, 4) AS baseline, max(season) AS newest FROM P JOIN (SELECT unnest([1996, 1998]) AS y) ON season BETWEEN y - 3 AND y - 1 GROUP BY ALL")
def position_baseline(spark: SparkSession, d: str) -> DataFrame:
    years = spark.range(2).select((F.col("id") * 2 + 1996).cast("int").alias("target_year"))
    rows = p(spark, d).join(F.broadcast(years), F.col("season").between(F.col("target_year") - 3, F.col("target_year") - 1))
    return rows.groupBy("position", "target_year").agg(F.round(F.avg("score") + 1.3e-7, 4).alias("baseline"), F.max("season").alias("newest"))


@query(f"""WITH {G} SELECT 'own' AS side, home AS team, position, round(avg(score) + 1.3e-7, 4) AS mean FROM G WHERE season = 1996 GROUP BY ALL
UNION ALL SELECT 'opponent', away, position, round(avg(score) + 1.3e-7, 4) FROM G WHERE season = 1996 GROUP BY ALL""")
def context_means(spark: SparkSession, d: str) -> DataFrame:
    games = g(spark, d).where("season = 1996")
    sides = games.select("position", "score", F.explode(F.array(F.struct(F.lit("own").alias("side"), F.col("home").alias("team")), F.struct(F.lit("opponent").alias("side"), F.col("away").alias("team")))).alias("s"))
    return sides.groupBy("s.side", "s.team", "position").agg(F.round(F.avg("score") + 1.3e-7, 4).alias("mean"))


@query(f"""WITH {P}, {S}, V AS (SELECT team, season, seq, qty, n_o FROM P JOIN S ON seq = orderkey), Y AS (SELECT coalesce(max(season) FILTER (WHERE season = 2004), max(season)) AS y FROM V WHERE season < 2005),
T AS (SELECT team, avg(qty) AS qty, avg(n_o) AS n_o FROM V JOIN Y ON season = y GROUP BY team)
SELECT n_name AS team, round(coalesce(qty, avg(qty) OVER (), 0) + 1.3e-7, 6) AS qty, round(coalesce(n_o, avg(n_o) OVER (), 0) + 1.3e-7, 6) AS n_o FROM nation LEFT JOIN T ON n_name = team""")
def team_volume_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = p(spark, d).join(s(spark, d), F.col("seq") == F.col("orderkey")).dropDuplicates(["seq"])
    means = roster.newest_if_empty(rows, "season", 2005).groupBy("team").agg(F.avg("qty").alias("qty"), F.avg("n_o").alias("n_o"))
    mean_of = means.agg(F.avg("qty").alias("_q"), F.avg("n_o").alias("_n"))
    out = table(spark, d, "nation").select(F.col("n_name").alias("team")).join(means, "team", "left").crossJoin(F.broadcast(mean_of))
    return out.select("team", r6(F.coalesce("qty", "_q", F.lit(0.0))).alias("qty"), r6(F.coalesce("n_o", "_n", F.lit(0.0))).alias("n_o"))


@query(f"""WITH {PD}, W AS (
  SELECT *, count(score) OVER e AS career_games, avg(score) OVER e AS career_mean, avg(score) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last_5, avg(score) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS last_10,
         count(score) OVER o AS season_games, avg(score) OVER o AS season_mean, row_number() OVER (PARTITION BY entity, season ORDER BY week DESC) AS k
  FROM PD WINDOW w AS (PARTITION BY entity ORDER BY season, week), e AS (PARTITION BY entity ORDER BY season, week ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY entity, season)),
N AS (SELECT *, lead(season) OVER (PARTITION BY entity ORDER BY season) AS next_season FROM W WHERE k = 1), Y AS (SELECT unnest([1996, 1997, 1998]) AS target_year)
SELECT entity, target_year, season, career_games, round(career_mean + 1.3e-7, 4) AS career_mean, score AS last_1, round(last_5 + 1.3e-7, 6) AS last_5, round(last_10 + 1.3e-7, 6) AS last_10, season_games, round(season_mean + 1.3e-7, 4) AS season_mean,
       CAST(position = 'BUILDING' AS DOUBLE) AS is_building, CAST(coalesce(position = 'MACHINERY', false) AS DOUBLE) AS is_machinery, round(week / 18.0, 6) AS week_part
FROM N JOIN Y ON season < target_year AND target_year <= coalesce(next_season, 9999)""")
def season_snapshot_features(spark: SparkSession, d: str) -> DataFrame:
    years = spark.range(3).select((F.col("id") + 1996).cast("int").alias("target_year"))
    out = panel.target_features(panel.season_profile(pd(spark, d), "score"), years)
    r4 = lambda c: F.round(F.col(c) + 1.3e-7, 4).alias(c)
    return out.withColumns(scalar.one_hot(F.col("position"), ["BUILDING", "MACHINERY"], "is")).select(
        "entity", "target_year", "season", "career_games", r4("career_mean"), "last_1", r6(F.col("last_5")).alias("last_5"), r6(F.col("last_10")).alias("last_10"), "season_games", r4("season_mean"),
        "is_building", "is_machinery", F.round(F.col("week") / 18.0, 6).alias("week_part"))


@query(f"WITH {R} SELECT * FROM A")
def status_union_join(spark: SparkSession, d: str) -> DataFrame:
    _, listed, reserve = r(spark, d)
    return absence.joined_statuses([listed, reserve], KEY)


@query(f"""WITH {R}, T AS (SELECT * FROM (SELECT DISTINCT entity, season FROM E), (SELECT CAST(unnest(generate_series(1, 30)) AS BIGINT) AS week))
SELECT entity, season, week, score, status, score IS NULL AND status IS NOT NULL AS missed FROM T LEFT JOIN GAMES USING (entity, season, week) LEFT JOIN A USING (entity, season, week)""")
def absence_attach(spark: SparkSession, d: str) -> DataFrame:
    games, listed, reserve = r(spark, d)
    users = table(spark, d, "events").select(F.col("user_id").alias("entity")).distinct().withColumn("season", F.lit(2024).cast("bigint"))
    targets = users.crossJoin(F.broadcast(spark.range(1, 31).select(F.col("id").alias("week"))))
    return absence.attach_outcomes(targets, games, absence.joined_statuses([listed, reserve], KEY), KEY)


@query(f"""WITH {R}, B AS (SELECT entity FROM GAMES INTERSECT SELECT entity FROM A), H AS (SELECT *, avg(score) OVER (PARTITION BY entity ORDER BY season, week ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS pace FROM GAMES)
SELECT A.entity, A.season, A.week, A.status, h.score, h.score IS NOT NULL AS played,
  round((SELECT max_by(pace, season * 100 + week) FROM H q WHERE q.entity = A.entity AND q.season * 100 + q.week < A.season * 100 + A.week) + 1.3e-7, 6) AS pace,
  A.week - 1 - coalesce((SELECT max(week) FROM GAMES q WHERE q.entity = A.entity AND q.season = A.season AND q.week < A.week), 0) AS weeks_missed
FROM A JOIN B USING (entity) LEFT JOIN H h USING (entity, season, week) WHERE A.week <= 30""")
def pace_streak_report(spark: SparkSession, d: str) -> DataFrame:
    games, listed, reserve = r(spark, d)
    out = absence.pace_and_streak(games, absence.joined_statuses([listed, reserve], KEY), last_week=30)
    return out.select(*KEY, "status", "score", "played", r6(F.col("pace")).alias("pace"), "weeks_missed")


@query(f"WITH {R} SELECT status, count(*) AS reports, count(*) FILTER (WHERE score IS NOT NULL) AS played, count(*) FILTER (WHERE score IS NULL) AS missed FROM LISTED LEFT JOIN GAMES USING (entity, season, week) GROUP BY status")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    games, listed, _ = r(spark, d)
    return absence.status_counts(listed.join(games, KEY, "left"), "status", F.col("score").isNotNull())


@query(f"WITH {P} SELECT seq, entity, season FROM P WHERE season BETWEEN 1994 AND 1996")
def coverage_window(spark: SparkSession, d: str) -> DataFrame:
    return absence.covered(p(spark, d), "season", 1994, 1996).select("seq", "entity", "season")


@query(f"""WITH {G}, H AS (SELECT home AS team, season, min_by(entity, (day, seq)) AS holder FROM G GROUP BY ALL)
SELECT a.team, a.season, a.holder, coalesce(a.holder <> b.holder, false) AS changed FROM H a LEFT JOIN H b ON a.team = b.team AND b.season = a.season - 1""")
def earliest_holder_changed(spark: SparkSession, d: str) -> DataFrame:
    games = g(spark, d).withColumnRenamed("home", "team")
    return roster.holder_changes(games, "team", "season", [F.col("day"), F.col("seq")], "entity")


@query(f"WITH {P} SELECT position, season, count(DISTINCT team) AS teams, count(DISTINCT entity) AS players, count(DISTINCT (team, week)) AS cells FROM P GROUP BY ALL")
def roster_coverage(spark: SparkSession, d: str) -> DataFrame:
    return p(spark, d).groupBy("position", "season").agg(F.countDistinct("team").alias("teams"), F.countDistinct("entity").alias("players"), F.countDistinct("team", "week").alias("cells"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, n_name AS holder FROM events JOIN nation ON n_nationkey = CAST(json_extract(props, '$.k') AS BIGINT) WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_feed_flatten(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("j")).select("event_id", "j.k").where("k is not null")
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("holder"))
    return rows.join(F.broadcast(names), "k").select("event_id", "k", "holder")


@query(f"WITH {P} SELECT seq, entity, position, score FROM P WHERE entity IN (1, 4, 7, 10, 13, 100, 250) AND season >= 1995")
def head_cohort(spark: SparkSession, d: str) -> DataFrame:
    return p(spark, d).where(F.col("entity").isin(1, 4, 7, 10, 13, 100, 250) & (F.col("season") >= 1995)).select("seq", "entity", "position", "score")


@query(f"""WITH {S} SELECT orderkey, round(qty / 25 + n_a * 4 - n_r * 2 + price / 10000 / 10 + n_f * 6 - n_o * 2 + 1.3e-7, 6) AS quarterback,
round(n_a * 3 + n_n * 4 + n_r * 5 + n_f + 1.3e-7, 6) AS kicker, round(n_a + n_n * 0.5 + n_r * 4 + n_f * 6 + n_o * 2 + 1.3e-7, 6) AS defender, round(qty / 10 + n_a * 6 + n_f * 0.5 - n_o * 2 + 1.3e-7, 6) AS receiving FROM S""")
def score_presets(spark: SparkSession, d: str) -> DataFrame:
    rows = s(spark, d)
    zero = F.lit(0.0)
    qb = rows.select("orderkey", F.col("qty").alias("passing_yards"), F.col("n_a").alias("passing_touchdowns"), F.col("n_r").alias("passing_interceptions"), (F.col("price") / 10000).alias("rushing_yards"), F.col("n_f").alias("rushing_touchdowns"), zero.alias("two_point_conversions"), F.col("n_o").alias("fumbles"),
                     F.col("n_a").alias("field_goals_0_39"), F.col("n_n").alias("field_goals_40_49"), F.col("n_r").alias("field_goals_50_plus"), F.col("n_f").alias("extra_points"), zero.alias("field_goals_missed"), zero.alias("extra_points_missed"))
    idp = rows.select("orderkey", F.col("n_a").alias("solo_tackles"), F.col("n_n").alias("assisted_tackles"), F.col("n_r").alias("sacks"), F.col("n_f").alias("interceptions"), F.col("n_o").alias("passes_defended"), zero.alias("fumbles_forced"), zero.alias("touchdowns"),
                      F.col("qty").alias("rushing_yards"), F.col("n_a").alias("rushing_touchdowns"), zero.alias("receiving_yards"), zero.alias("receiving_touchdowns"), zero.alias("two_point_conversions"), F.col("n_o").alias("fumbles"), F.col("n_f").alias("receptions"))
    left = qb.select("orderkey", r6(presets.quarterback_score()).alias("quarterback"), r6(presets.kicker_score()).alias("kicker"))
    right = idp.select("orderkey", r6(presets.defender_score()).alias("defender"), r6(presets.receiving_score(0.5)).alias("receiving"))
    return left.join(right, "orderkey")


@query("SELECT 'DST-' || n_name AS entity, n_name || ' D/ST' AS name FROM nation UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name FROM customer")
def synthetic_entities(spark: SparkSession, d: str) -> DataFrame:
    teams = table(spark, d, "nation").select(F.concat(F.lit("DST-"), "n_name").alias("entity"), F.concat("n_name", F.lit(" D/ST")).alias("name"))
    return teams.unionByName(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("entity"), F.col("c_name").alias("name")))


@query(f"WITH {X} SELECT CAST(day AS VARCHAR) AS day, team, slot, min(rank) AS rank FROM X WHERE day >= DATE '2024-01-10' AND slot <> 'error' AND value IS NOT NULL GROUP BY ALL")
def eligible_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = x(spark, d).where((F.col("day") >= F.lit("2024-01-10").cast("date")) & (F.col("slot") != "error")).dropna(subset=["value"])
    return rows.groupBy(F.col("day").cast("string").alias("day"), "team", "slot").agg(F.min("rank").alias("rank"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, coalesce(p_name, 'part ' || l_partkey) AS part, coalesce(o_orderpriority, 'none') AS priority
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey""")
def fact_dimension_join(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    joined = table(spark, d, "lineitem").join(orders, "l_orderkey").join(parts, "l_partkey", "left")
    return joined.select("l_orderkey", "l_linenumber", "l_quantity", F.coalesce("p_name", F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("part"), F.coalesce("o_orderpriority", F.lit("none")).alias("priority"))


@query(f"""WITH {PD}, C AS (SELECT entity, count(*) AS games, round(avg(score) + 1.3e-7, 4) AS mean FROM PD WHERE season < 1998 GROUP BY entity), L AS (SELECT entity, count(*) AS last_games FROM PD WHERE season = 1997 GROUP BY entity)
SELECT entity, games, mean, last_games FROM C LEFT JOIN L USING (entity)""")
def profile_join(spark: SparkSession, d: str) -> DataFrame:
    rows = pd(spark, d)
    career = rows.where("season < 1998").groupBy("entity").agg(F.count(F.lit(1)).alias("games"), F.round(F.avg("score") + 1.3e-7, 4).alias("mean"))
    last = rows.where("season = 1997").groupBy("entity").agg(F.count(F.lit(1)).alias("last_games"))
    return career.join(last, "entity", "left")


@query(f"""WITH {G}, T AS (SELECT seq, home AS team FROM G WHERE season = 1996 UNION ALL SELECT seq, away FROM G WHERE season = 1996), {X}, Y AS (SELECT 'NATION_' || team AS team, slot, event_id FROM X WHERE day = DATE '2024-01-05' AND rank = 1)
SELECT seq, team, slot, event_id FROM T JOIN Y USING (team)""")
def matchup_roster(spark: SparkSession, d: str) -> DataFrame:
    games = roster.two_rows(g(spark, d).where("season = 1996"), ["seq"], {"team": ("home", "away")}).select("seq", "team")
    slots = x(spark, d).where((F.col("day") == F.lit("2024-01-05").cast("date")) & (F.col("rank") == 1))
    return games.join(slots.select(F.concat(F.lit("NATION_"), F.col("team").cast("string")).alias("team"), "slot", "event_id"), "team").select("seq", "team", "slot", "event_id")


