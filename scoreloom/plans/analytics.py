"""Queries of the statistics, ranking, reliability and cost operators over the scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.operators import costs, merging, quantiles, ranking, reporting, stats
from scoreloom.plans.fixture import FX, PAIRS, SC, evaluations, pairs, scored
from scoreloom.plans.registry import query, table
from scoreloom.scratch import new_path
from scoreloom.sources.writers import ERRORS, SCORES, cost_table, session_summary

D = ["d1", "d2", "d3", "d4", "d5"]


def r6(c):
    return F.round(c, 6)


def _avg(x: str) -> str:
    return f"round(avg({x}), 6)"


def _q(x: str, q: float) -> str:
    return f"round(quantile_cont({x}, {q}), 6)"


_STALE1 = "(" + " OR ".join(f"contains(concat_ws(' ', rationale, major, moderate, minor, error_flag), '{w}')" for w in V.STALE_LAW_V1) + ")"
_STALE2 = "(" + " OR ".join(f"contains(lower(concat_ws(' ', rationale, major, moderate, minor)), '{w}')" for w in V.STALE_LAW_V2) + ")"
_REFUSED = "(answer IS NULL OR trim(answer) = '')"
_VALID = f"(NOT {_REFUSED} AND lower(answer) <> 'nan')"
_STRIPPED = r"regexp_replace(answer, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')"
#: Model statistics in SQL, as ms.
_MS = f"""{SC}, q AS (SELECT model, quantile_cont(total, 0.1) AS p10 FROM sc GROUP BY model),
t AS (SELECT model, avg(total) AS cvar10 FROM sc JOIN q USING (model) WHERE total <= p10 GROUP BY model),
ms AS (SELECT model, count(*) AS n, avg(total) AS mean_score, any_value(p10) AS p10, any_value(cvar10) AS cvar10, count(*) FILTER (WHERE {_STALE1}) AS stale_count,
       count(major) AS major_count, count(moderate) AS moderate_count, count(minor) AS minor_count, count(*) FILTER (WHERE {_REFUSED}) AS refusal_count,
       avg(CASE WHEN NOT {_REFUSED} THEN length({_STRIPPED}) END) AS mean_length,
       avg(d1) AS d1_mean, avg(d2) AS d2_mean, avg(d3) AS d3_mean, avg(d4) AS d4_mean, avg(d5) AS d5_mean,
       CAST(count(*) FILTER (WHERE {_STALE1}) AS DOUBLE) / count(*) AS stale_rate, CAST(count(*) FILTER (WHERE {_REFUSED}) AS DOUBLE) / count(*) AS refusal_rate
       FROM sc JOIN q USING (model) JOIN t USING (model) GROUP BY model)"""
_TOK = "tk AS (SELECT model, avg(tokens_in) AS avg_in, avg(tokens_out) AS avg_out, avg(tokens_in + tokens_out) AS avg_total, CAST(count(*) AS DOUBLE) AS calls FROM fx WHERE mi <> 3 GROUP BY model)"


def _model_stats(spark, d):
    return stats.model_stats(scored(spark, d))


def _tokens(spark, d):
    calls = evaluations(spark, d).where("mi <> 3").withColumn("tokens_total", F.col("tokens_in") + F.col("tokens_out"))
    return costs.token_averages(calls, ["model"]).withColumn("calls", F.col("calls").cast("double"))


@query(f"{SC} SELECT model, count(*) AS n, {_avg('total')} AS mean, max(total) AS max, min(total) AS min, {_avg('total * 5')} AS pct FROM sc GROUP BY model")
def a01_model_scores(spark, d):
    return scored(spark, d).groupBy("model").agg(F.count("*").alias("n"), r6(F.avg("total")).alias("mean"), F.max("total").alias("max"), F.min("total").alias("min"), r6(F.avg(F.col("total") * 5)).alias("pct"))


@query(f"{FX} SELECT model, count(DISTINCT case_id) AS cases FROM fx GROUP BY model")
def a02_distinct_cases(spark, d):
    return evaluations(spark, d).groupBy("model").agg(F.count_distinct("case_id").alias("cases"))


@query(f"{_MS} SELECT model, n, round(mean_score, 6) AS mean_score, stale_count, major_count, moderate_count, minor_count, refusal_count, round(mean_length, 6) AS mean_length, round(stale_rate, 6) AS stale_rate, round(refusal_rate, 6) AS refusal_rate FROM ms")
def a03_model_stats(spark, d):
    return _model_stats(spark, d).select("model", "n", "stale_count", "major_count", "moderate_count", "minor_count", "refusal_count", *[r6(F.col(c)).alias(c) for c in ("mean_score", "mean_length", "stale_rate", "refusal_rate")])


@query(f"{_MS} SELECT model, round(p10, 6) AS p10 FROM ms")
def a04_p10(spark, d):
    return quantiles.exact_quantiles(scored(spark, d), ["model"], F.col("total"), [0.1]).select("model", r6(F.col("value")).alias("p10"))


@query(f"{_MS} SELECT model, round(p10, 6) AS p10, round(cvar10, 6) AS cvar10 FROM ms")
def a05_cvar10(spark, d):
    return _model_stats(spark, d).select("model", r6(F.col("p10")).alias("p10"), r6(F.col("cvar10")).alias("cvar10"))


@query()
def a06_bootstrap_ci(spark, d):
    return stats.bootstrap_means(scored(spark, d))


@query(f"{_MS} SELECT model, major_count, moderate_count, minor_count FROM ms")
def a07_error_counts(spark, d):
    return _model_stats(spark, d).select("model", "major_count", "moderate_count", "minor_count")


_DIMS = "d AS (" + " UNION ALL ".join(f"SELECT model, case_id, '{x}' AS dim, {x} AS score FROM sc" for x in D) + ")"


@query(f"{SC}, {_DIMS} SELECT model, dim, {_avg('score')} AS mean FROM d GROUP BY model, dim")
def a08_dimension_means(spark, d):
    return stats.dimension_rows(scored(spark, d), ["model"]).groupBy("model", "dim").agg(r6(F.avg("score")).alias("mean"))


@query(f"{SC}, {_DIMS} SELECT dim, {_avg('score')} AS mean, round(median(score), 6) AS median, max(score) AS max, min(score) AS min FROM d GROUP BY dim")
def a09_dimension_summary(spark, d):
    return stats.dimension_rows(scored(spark, d), ["model"]).groupBy("dim").agg(r6(F.avg("score")).alias("mean"), r6(F.median("score")).alias("median"), F.max("score").alias("max"), F.min("score").alias("min"))


@query(f"{SC} SELECT model, count(total) AS n, {_avg('total')} AS mean, round(median(total), 6) AS median, round(stddev_samp(total), 6) AS std, min(total) AS min, max(total) AS max FROM sc GROUP BY model")
def a10_score_distribution(spark, d):
    out = stats.score_summary(scored(spark, d), ["model"])
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "median", "std")})


@query(f"{SC} SELECT model, count(*) AS n, count(*) FILTER (WHERE total >= 16) AS high, count(*) FILTER (WHERE total >= 11 AND total < 16) AS good, count(*) FILTER (WHERE total >= 6 AND total < 11) AS fair, count(*) FILTER (WHERE total < 6) AS low, round(count(*) FILTER (WHERE total < 6) * 100::DOUBLE / count(*), 6) AS low_pct FROM sc GROUP BY model")
def a11_bands(spark, d):
    return stats.bands(scored(spark, d), ["model"]).select("model", "n", "high", "good", "fair", "low", r6(F.col("low_pct")).alias("low_pct"))


@query(f"{SC} SELECT grade, count(*) AS n, round(count(*) * 100::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM sc GROUP BY grade")
def a12_grade_counts(spark, d):
    return stats.shares(scored(spark, d), "grade", []).select("grade", "n", r6(F.col("pct")).alias("pct"))


@query(f"{SC} SELECT grade, {', '.join(f'{_avg(x)} AS {x}' for x in D)} FROM sc GROUP BY grade")
def a13_grade_dimensions(spark, d):
    return scored(spark, d).groupBy("grade").agg(*[r6(F.avg(x)).alias(x) for x in D])


_HOLES = "CASE WHEN n % 6 = 0 THEN NULL ELSE d1 END"


@query(f"{SC} SELECT case_id, round(avg({_HOLES}), 6) AS d1, {_avg('d2')} AS d2 FROM sc GROUP BY case_id")
def a14_case_means(spark, d):
    return scored(spark, d).withColumn("d1", F.when(F.col("n") % 6 != 0, F.col("d1"))).groupBy("case_id").agg(r6(F.avg("d1")).alias("d1"), r6(F.avg("d2")).alias("d2"))


@query(f"{SC} SELECT case_id, round(avg(coalesce({_HOLES}, 0)), 6) AS d1, {_avg('d2')} AS d2 FROM sc GROUP BY case_id")
def a15_case_means_null_zero(spark, d):
    return scored(spark, d).withColumn("d1", F.when(F.col("n") % 6 != 0, F.col("d1"))).groupBy("case_id").agg(r6(F.avg(F.coalesce("d1", F.lit(0.0)))).alias("d1"), r6(F.avg("d2")).alias("d2"))


@query(f"{SC} SELECT case_id, {_avg('total')} AS mean, min(title) AS title FROM sc GROUP BY case_id")
def a16_case_ranking(spark, d):
    return scored(spark, d).groupBy("case_id").agg(r6(F.avg("total")).alias("mean"), F.min_by("title", F.struct("q_no", "model")).alias("title"))


@query(f"{SC} SELECT error_flag IS NOT NULL AS has_error, count(*) AS n, {_avg('total')} AS mean, round(median(total), 6) AS median, max(total) AS max FROM sc GROUP BY 1")
def a17_error_cohorts(spark, d):
    return stats.error_cohorts(scored(spark, d)).withColumns({c: r6(F.col(c)) for c in ("mean", "median")})


@query(f"{SC}, {_DIMS.replace('case_id,', 'error_flag, n,').replace('d1 AS score', _HOLES + ' AS score')} SELECT dim, round(count(CASE WHEN error_flag IS NOT NULL THEN score END) * 100::DOUBLE / count(score), 6) AS error_rate FROM d GROUP BY dim")
def a18_error_rates(spark, d):
    rows = scored(spark, d).withColumn("d1", F.when(F.col("n") % 6 != 0, F.col("d1")))
    long = stats.dimension_rows(rows, ["error_flag"])
    return long.groupBy("dim").agg(r6(F.try_divide(F.count(F.when(F.col("error_flag").isNotNull(), F.col("score"))) * 100.0, F.count("score"))).alias("error_rate"))


@query(f"{FX} SELECT model, round(avg(CASE WHEN {_VALID} THEN length(answer) END), 6) AS mean_length, CAST(max(CASE WHEN {_VALID} THEN length(answer) END) AS INTEGER) AS max_length, CAST(min(CASE WHEN {_VALID} THEN length(answer) END) AS INTEGER) AS min_length, count(*) FILTER (WHERE NOT coalesce({_VALID}, false)) AS empty FROM fx GROUP BY model")
def a19_answer_lengths(spark, d):
    return stats.answer_lengths(evaluations(spark, d), ["model"]).withColumn("mean_length", r6(F.col("mean_length")))


@query(f"{FX}, {_TOK} SELECT model, round(avg_in, 6) AS avg_in, round(avg_out, 6) AS avg_out, round(avg_total, 6) AS avg_total, calls FROM tk")
def a20_token_averages(spark, d):
    return _tokens(spark, d).select("model", *[r6(F.col(c)).alias(c) for c in ("avg_in", "avg_out", "avg_total")], "calls")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(event_id % 1000) AS BIGINT) AS tokens_in, CAST(sum(event_id % 500) AS BIGINT) AS tokens_out, CAST(sum(event_id % 1000 + event_id % 500) AS BIGINT) AS tokens_total, count(*) AS calls FROM events GROUP BY 1")
def a21_token_totals_by_day(spark, d):
    calls = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 500).alias("tokens_out"))
    return costs.token_totals(calls.withColumn("tokens_total", F.col("tokens_in") + F.col("tokens_out")), ["day"])


@query(f"{SC} SELECT model, count(*) FILTER (WHERE {_STALE1}) AS questions, count(DISTINCT CASE WHEN {_STALE1} THEN case_id END) AS cases, round(count(*) FILTER (WHERE {_STALE1}) * 100::DOUBLE / count(*), 6) AS pct FROM sc GROUP BY model")
def a22_stale_questions(spark, d):
    rows = scored(spark, d).withColumn("stale", stats.mentions_stale_law(1))
    return rows.groupBy("model").agg(F.count_if("stale").alias("questions"), F.count_distinct(F.when(F.col("stale"), F.col("case_id"))).alias("cases"), r6(F.count_if("stale") * 100.0 / F.count("*")).alias("pct"))


_MATRIX = [("score", "mean_score / 5"), *[(x, f"{x}_mean") for x in D], *[(c, f"CAST({c}_count AS DOUBLE) / n * 4") for c in ("major", "moderate", "minor", "stale")]]


@query(f"{_MS} " + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, round({e}, 6) AS value FROM ms" for m, e in _MATRIX))
def a23_metric_matrix(spark, d):
    return stats.metric_matrix(_model_stats(spark, d)).withColumn("value", r6(F.col("value")))


@query(f"{_MS} SELECT model, round(avg(mean_score) OVER (), 6) AS macro, mean_score > avg(mean_score) OVER () AS above FROM ms")
def a24_macro_average(spark, d):
    from pyspark.sql import Window as W

    every = W.partitionBy(F.lit(0))  # a row a model
    return _model_stats(spark, d).select("model", r6(F.avg("mean_score").over(every)).alias("macro"), (F.col("mean_score") > F.avg("mean_score").over(every)).alias("above"))


_REASONING = "model IN ('m0', 'm2', 'm5')"


@query(f"{_MS} SELECT {_REASONING} AS reasoning, round(avg(mean_score), 6) AS mean, count(*) AS models FROM ms GROUP BY 1")
def a25_reasoning_contrast(spark, d):
    return _model_stats(spark, d).groupBy(F.col("model").isin("m0", "m2", "m5").alias("reasoning")).agg(r6(F.avg("mean_score")).alias("mean"), F.count("*").alias("models"))


@query(f"{_MS} SELECT round(max(CASE WHEN model = 'm0' THEN mean_score END) - max(CASE WHEN model = 'm1' THEN mean_score END), 6) AS score, max(CASE WHEN model = 'm0' THEN stale_count END) - max(CASE WHEN model = 'm1' THEN stale_count END) AS stale, max(CASE WHEN model = 'm0' THEN major_count END) - max(CASE WHEN model = 'm1' THEN major_count END) AS major FROM ms")
def a26_mode_delta(spark, d):
    of = lambda c, m: F.max(F.when(F.col("model") == m, F.col(c)))
    return _model_stats(spark, d).agg(r6(of("mean_score", "m0") - of("mean_score", "m1")).alias("score"), (of("stale_count", "m0") - of("stale_count", "m1")).alias("stale"), (of("major_count", "m0") - of("major_count", "m1")).alias("major"))


@query(f"{SC} SELECT model, count(*) AS n, count(*) FILTER (WHERE total < 4 + mi) AS failures, round(count(*) FILTER (WHERE total < 4 + mi) * 100::DOUBLE / count(*), 6) AS failure_rate, CASE WHEN count(*) FILTER (WHERE total < 4 + mi) * 100::DOUBLE / count(*) > 50 THEN 'severe' WHEN count(*) FILTER (WHERE total < 4 + mi) * 100::DOUBLE / count(*) > 20 THEN 'moderate' ELSE 'light' END AS severity FROM sc GROUP BY model")
def a27_failure_bands(spark, d):
    return stats.failure_bands(scored(spark, d), ["model"], F.col("total") < 4 + F.col("mi")).withColumn("failure_rate", r6(F.col("failure_rate")))


@query(f"{_MS}, {_TOK} SELECT model, round(mean_score / avg_total * 1000, 6) AS efficiency FROM ms LEFT JOIN tk USING (model)")
def a28_token_efficiency(spark, d):
    return costs.efficiency(_model_stats(spark, d), _tokens(spark, d)).select("model", r6(F.col("efficiency")).alias("efficiency"))


_COMPOSITE = "mean_score - 0.5::DOUBLE * stale_rate * 100 - 0.3::DOUBLE * refusal_rate * 100"


@query(f"{_MS} SELECT model, round({_COMPOSITE}, 6) AS composite, row_number() OVER (ORDER BY {_COMPOSITE} DESC, model) = 1 AND {_COMPOSITE} > -1 AS best FROM ms")
def a29_composite(spark, d):
    rows = ranking.rank(stats.composite(_model_stats(spark, d)), F.col("composite").desc(), F.col("model"))
    return rows.select("model", r6(F.col("composite")).alias("composite"), ((F.col("rank") == 1) & (F.col("composite") > -1)).alias("best"))


_SUMMARY = ("questions", *[f"mean_{c}" for c in SCORES], *ERRORS)


@query(f"""{SC}, s AS (SELECT case_id, CAST(count(*) AS DOUBLE) AS questions, {', '.join(f'round(avg({c}), 2) AS mean_{c}' for c in SCORES)}, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in ERRORS)} FROM sc GROUP BY case_id)
""" + " UNION ALL ".join(f"SELECT case_id, '{c}' AS metric, {c} AS value FROM s" for c in _SUMMARY))
def a30_session_summary(spark, d):
    return session_summary(scored(spark, d), ["case_id"])


@query(f"{PAIRS} SELECT source, round(avg(0.6::DOUBLE * CAST(least(length(a), length(b)) AS DOUBLE) / greatest(length(a), length(b))), 6) AS mean_ratio, count(*) AS rows FROM p GROUP BY source")
def a31_similarity_averages(spark, d):
    ratio = F.lit(0.6) * F.least(F.length("a"), F.length("b")) / F.greatest(F.length("a"), F.length("b"))
    return pairs(spark, d).groupBy("source").agg(r6(F.avg(ratio)).alias("mean_ratio"), F.count("*").alias("rows"))


@query(f"{SC} SELECT case_id, {_avg('total')} AS mean, CASE WHEN avg(total) >= 16 THEN '{V.GRADES[0]}' WHEN avg(total) >= 11 THEN '{V.GRADES[1]}' WHEN avg(total) >= 6 THEN '{V.GRADES[2]}' ELSE '{V.GRADES[3]}' END AS grade, CAST(sum(n_major) AS BIGINT) AS major FROM sc GROUP BY case_id")
def a32_case_grade(spark, d):
    rows = scored(spark, d).groupBy("case_id").agg(F.avg("total").alias("m"), F.sum("n_major").alias("major"))
    grade = F.when(F.col("m") >= 16, V.GRADES[0]).when(F.col("m") >= 11, V.GRADES[1]).when(F.col("m") >= 6, V.GRADES[2]).otherwise(V.GRADES[3])
    return rows.select("case_id", r6(F.col("m")).alias("mean"), grade.alias("grade"), "major")


@query(f"{SC} SELECT model, CAST(case_id AS VARCHAR) AS case_id, count(*) AS n, {_avg('total')} AS mean, max(total) AS max, min(total) AS min FROM sc GROUP BY GROUPING SETS ((), (model), (model, case_id))")
def a33_run_summary(spark, d):
    rows = scored(spark, d).groupingSets([[], [F.col("model")], [F.col("model"), F.col("case_id")]], "model", "case_id")
    summary = rows.agg(F.count("*").alias("n"), r6(F.avg("total")).alias("mean"), F.max("total").alias("max"), F.min("total").alias("min"))
    return summary.withColumn("case_id", F.col("case_id").cast("string"))


@query(f"{SC}, e AS (SELECT min(total) AS lo, max(total) AS hi FROM sc) SELECT CAST(least(floor((total - lo) / ((hi - lo) / 30)) + 1, 30) AS INTEGER) AS bin, count(*) AS n FROM sc, e GROUP BY 1")
def a34_histogram(spark, d):
    return stats.histogram(scored(spark, d), "total", 30)


@query(f"{SC} SELECT model, {_q('total', 0.25)} AS q1, {_q('total', 0.5)} AS q2, {_q('total', 0.75)} AS q3 FROM sc GROUP BY model")
def a34_quartiles(spark, d):
    found = quantiles.exact_quantiles(scored(spark, d), ["model"], F.col("total"), [0.25, 0.5, 0.75])
    return found.groupBy("model").agg(*[r6(F.max(F.when(F.col("q") == p, F.col("value")))).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])


@query(f"{SC} " + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(regr_slope({y}, {x}), 6) AS slope, round(regr_intercept({y}, {x}), 6) AS intercept FROM sc" for x in D for y in D if x != y))
def a35_trends(spark, d):
    return stats.trends(scored(spark, d)).withColumns({c: r6(F.col(c)) for c in ("slope", "intercept")})


@query(f"{_MS}, {_TOK} SELECT round(corr(mean_score, avg_total), 6) AS r FROM ms JOIN tk USING (model)")
def a36_score_token_correlation(spark, d):
    return _model_stats(spark, d).join(_tokens(spark, d), "model").agg(r6(F.corr("mean_score", "avg_total")).alias("r"))


# Ranks and orders.


@query(f"{_MS} SELECT model, stale_count, CAST(row_number() OVER (ORDER BY stale_count, model) AS INTEGER) AS rank FROM ms")
def w01_rank_stale(spark, d):
    return ranking.rank(_model_stats(spark, d), F.col("stale_count"), F.col("model")).select("model", "stale_count", "rank")


@query(f"{_MS} SELECT model, CAST(row_number() OVER (ORDER BY mean_score DESC, model) AS INTEGER) AS rank FROM ms")
def w02_rank_score(spark, d):
    return ranking.rank(_model_stats(spark, d), F.col("mean_score").desc(), F.col("model")).select("model", "rank")


@query(f"{_MS}, {_TOK} SELECT model, CAST(row_number() OVER (ORDER BY mean_score / avg_total DESC, model) AS INTEGER) AS rank FROM ms JOIN tk USING (model)")
def w03_rank_efficiency(spark, d):
    rows = costs.efficiency(_model_stats(spark, d), _tokens(spark, d)).where("efficiency is not null")
    return ranking.rank(rows, F.col("efficiency").desc(), F.col("model")).select("model", "rank")


@query(f"{_MS} SELECT model, CAST(row_number() OVER (ORDER BY model = 'm4', mean_score DESC, model) AS INTEGER) AS rank FROM ms")
def w04_pinned_last(spark, d):
    return ranking.rank(_model_stats(spark, d), ranking.pinned_last("model", "m4"), F.col("mean_score").desc(), F.col("model")).select("model", "rank")


@query("SELECT case_id, q_no, doc_id FROM (SELECT doc_id // 7 AS case_id, doc_id % 7 AS q_no, doc_id, row_number() OVER (PARTITION BY doc_id // 7 ORDER BY doc_id % 7) AS rn, count(*) OVER (PARTITION BY doc_id // 7) AS c FROM documents) WHERE rn <= 5 AND c >= 5")
def w05_first_five(spark, d):
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 7).cast("long").alias("case_id"), (F.col("doc_id") % 7).alias("q_no"), "doc_id")
    return ranking.first_rows(rows, ["case_id"], "q_no", 5, at_least=5)


@query(f"{SC} SELECT model, case_id, q_no, left(moderate, 5) AS part, CAST(row_number() OVER (PARTITION BY model ORDER BY case_id, q_no) AS INTEGER) AS rank FROM sc WHERE {_STALE1}")
def w06_stale_details(spark, d):
    rows = scored(spark, d).where(stats.mentions_stale_law(1))
    flagged = rows.select("model", "case_id", "q_no", F.left("moderate", F.lit(5)).alias("part"))
    return ranking.numbered_within(flagged, ["model"], F.col("case_id"), F.col("q_no")).withColumn("rank", F.col("rank").cast("int"))


@query("SELECT conv_id, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id")
def w07_first_value(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"))


@query("""WITH e AS (SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS done, count(*) OVER (PARTITION BY user_id) AS all_n FROM events)
SELECT user_id, event_id, done, all_n, CAST(floor(done * 100::DOUBLE / all_n) AS BIGINT) AS pct FROM e""")
def w08_progress(spark, d):
    return ranking.progress(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "done", "all_n", "pct")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS n60 FROM events")
def w09_look_back(spark, d):
    return ranking.look_back(table(spark, d, "events"), "event_type", "ts", 60, "n60").select("event_id", "n60")


@query(f"{SC} SELECT case_id, {_avg('total')} AS mean FROM sc GROUP BY case_id ORDER BY avg(total) DESC, case_id LIMIT 30")
def o01_top_cases(spark, d):
    rows = scored(spark, d).groupBy("case_id").agg(F.avg("total").alias("m"))
    return ranking.top(rows, 30, F.col("m").desc(), F.col("case_id")).select("case_id", r6(F.col("m")).alias("mean"))


@query(f"{SC}, c AS (SELECT case_id, avg(total) AS m FROM sc GROUP BY case_id) (SELECT 'top' AS side, case_id, round(m, 6) AS mean FROM c ORDER BY m DESC, case_id LIMIT 20) UNION ALL (SELECT 'bottom', case_id, round(m, 6) FROM c ORDER BY m, case_id LIMIT 20)")
def o02_top_bottom(spark, d):
    rows = scored(spark, d).groupBy("case_id").agg(F.avg("total").alias("m"))
    best, worst = ranking.top(rows, 20, F.col("m").desc(), F.col("case_id")), ranking.top(rows, 20, F.col("m"), F.col("case_id"))
    return best.withColumn("side", F.lit("top")).unionByName(worst.withColumn("side", F.lit("bottom"))).select("side", "case_id", r6(F.col("m")).alias("mean"))


@query(f"{FX} SELECT case_id, min(title) AS title FROM fx GROUP BY case_id ORDER BY case_id DESC LIMIT 10")
def o03_last_cases(spark, d):
    rows = evaluations(spark, d).groupBy("case_id").agg(F.min("title").alias("title"))
    return ranking.top(rows, 10, F.col("case_id").desc())


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def o04_first_documents(spark, d):
    return ranking.top(table(spark, d, "documents").select("doc_id"), 25, F.col("doc_id"))


_PRICE_ROWS = ", ".join(f"({i}, '{p}', {a}::DOUBLE, {b}::DOUBLE)" for i, (p, a, b) in enumerate(V.PRICES))
_COSTS = f"""WITH p(provider_no, provider, price_in, price_out) AS (VALUES {_PRICE_ROWS}),
t AS (SELECT CAST(floor(CAST(sum(n_chars) AS DOUBLE) / 5 * 100) AS BIGINT) AS tokens_in, CAST({float(V.FALLBACK_CASE_TOKENS[1])} * 100 AS BIGINT) AS tokens_out FROM documents),
c AS (SELECT provider, tokens_in, tokens_out, round(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 2) AS cost FROM t, p)"""


def _costs(spark, d):
    measured = table(spark, d, "documents").agg(F.sum("n_chars").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"))
    return costs.projected_costs(measured, costs.price_book(spark))


@query(f"{_COSTS} SELECT provider, cost, CAST(row_number() OVER (ORDER BY cost, provider) AS INTEGER) AS rank FROM c")
def o05_cost_order(spark, d):
    return ranking.rank(_costs(spark, d), F.col("cost"), F.col("provider")).select("provider", "cost", "rank")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 4 <> 0 THEN doc_id END, 999) AS place, row_number() OVER (ORDER BY coalesce(CASE WHEN doc_id % 4 <> 0 THEN doc_id END, 999), doc_id) AS rank FROM documents")
def o06_submit_order(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 4 != 0, F.col("doc_id")), F.lit(999)).alias("place"))
    return ranking.numbered(rows, F.col("place"), F.col("doc_id")).select("doc_id", "place", "rank")


@query()
def o07_random_sample(spark, d):
    return ranking.sample_rows(scored(spark, d), 1000, "model", "case_id", "q_no").select("model", "case_id", "q_no")


@query(f"{_MS} SELECT max_by(model, mean_score) AS best, min_by(model, mean_score) AS worst FROM ms")
def o08_extremes(spark, d):
    return _model_stats(spark, d).agg(F.max_by("model", "mean_score").alias("best"), F.min_by("model", "mean_score").alias("worst"))


# Costs.


@query("SELECT event_id, round((event_id % 1000) / 1e6 * 2.0::DOUBLE + (event_id % 500) / 1e6 * 8.0::DOUBLE + (event_id % 50) / 1e6 * 8.0::DOUBLE, 9) AS cost FROM events")
def c01_running_cost(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round(costs.running_cost(e % 1000, e % 500, e % 50), 9).alias("cost"))


@query(f"{_COSTS} SELECT provider, tokens_in, tokens_out, cost FROM c")
def c02_projected_costs(spark, d):
    return _costs(spark, d).select("provider", "tokens_in", "tokens_out", "cost")


@query(f"{_COSTS} SELECT provider, cost FROM c WHERE contains(provider, 'GPT')")
def c03_provider_filter(spark, d):
    return _costs(spark, d).where(F.col("provider").contains("GPT")).select("provider", "cost")


_CHART_PRICES = ", ".join(f"({i}, '{p}', {a}::DOUBLE, {b}::DOUBLE)" for i, (p, a, b) in enumerate(V.CHART_PRICES))


@query(f"""WITH p(provider_no, provider, price_in, price_out) AS (VALUES {_CHART_PRICES}), c AS (SELECT *, CAST(floor(t.a / 5.0::DOUBLE * 100) AS BIGINT) AS tokens_in, CAST(floor(t.b / 5.0::DOUBLE * 100) AS BIGINT) AS tokens_out FROM p, (SELECT sum(event_id % 1000) AS a, sum(event_id % 500) AS b FROM events) t)
SELECT provider_no, provider, tokens_in, tokens_out, round(tokens_in / 1e6 * price_in, 2) AS cost_in, round(tokens_out / 1e6 * price_out, 2) AS cost_out, round(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 2) AS cost FROM c""")
def c04_chart_costs(spark, d):
    used = table(spark, d, "events").agg(F.sum(F.col("event_id") % 1000).alias("tokens_in"), F.sum(F.col("event_id") % 500).alias("tokens_out"))
    rows = costs.projected_costs(used, costs.price_book(spark, V.CHART_PRICES), fallback=V.CHART_CASE_TOKENS)
    return rows.select("provider_no", "provider", "tokens_in", "tokens_out", F.round("cost_in", 2).alias("cost_in"), F.round("cost_out", 2).alias("cost_out"), "cost")


@query(f"{_COSTS} SELECT provider, tokens_in + tokens_out AS tokens_total, cost FROM c")
def k07_cost_table(spark, d):
    folder = new_path(spark, "cost-table")
    cost_table(_costs(spark, d), folder)
    rows = spark.read.option("header", "true").csv(folder)
    return rows.select("provider", F.col("tokens_total").cast("long").alias("tokens_total"), F.col("cost").cast("double").alias("cost"))


@query(f"{FX}, {_TOK} SELECT model, round(140 + least(greatest((avg_total - 1000) / 1000, 0), 1) * 280, 6) AS size FROM tk")
def z14_marker_size(spark, d):
    return _tokens(spark, d).select("model", r6(costs.marker_size(F.col("avg_total"), 1000.0, 2000.0)).alias("size"))


# Reports and charts.


def _long_sql(parts: dict[str, dict[str, str]], where: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS section, model, '{m}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value FROM ms LEFT JOIN tk USING (model){where}" for s, values in parts.items() for m, e in values.items())


_PCT = "CAST({0} AS DOUBLE) * 100 / n"
_DIM = {x: f"{x}_mean" for x in D}
_ERR = {e: f"{e}_count" for e in reporting.ERRORS}
_REPORT = {
    "scores": {"questions": "n", "mean": "mean_score", "percent": "mean_score * 5", "p10": "p10", "cvar10": "cvar10"}, "dimensions": _DIM,
    "answers": {"mean_length": "mean_length", "empty": "refusal_count", "empty_percent": _PCT.format("refusal_count")},
    "errors": {**_ERR, "errors_percent": _PCT.format("(major_count + moderate_count + minor_count)")}, "stale_law": {"questions": "stale_count", "percent": _PCT.format("stale_count")},
    "tokens": {"in": "avg_in", "out": "avg_out", "total": "avg_total", "efficiency": "mean_score / avg_total * 1000"},
}
_CHARTS = {
    "pareto": {"mean": "mean_score", "stale_rate": "stale_rate", "tokens": "avg_total"}, "tail_risk": {"mean": "mean_score", "p10": "p10", "cvar10": "cvar10"},
    "gating": {"stale_rate": "stale_rate", "passes": "CAST(stale_rate <= 0.01 AS INTEGER)"}, "mean_score": {"mean": "mean_score"}, "stale_law": {"count": "stale_count"},
    "dimension_heatmap": _DIM, "metric_heatmap": {m: e for m, e in _MATRIX}, "percentage": {"percent": "mean_score * 5"}, "errors": _ERR,
}
_TOKEN_CHARTS = {"efficiency": {"mean": "mean_score", "tokens": "avg_total"}, "token_usage": {"in": "avg_in", "out": "avg_out", "total": "avg_total"}}


@query(f"{_MS}, {_TOK} {_long_sql(_REPORT)}")
def k08_report_tables(spark, d):
    return reporting.report_tables(_model_stats(spark, d), _tokens(spark, d)).withColumn("value", r6(F.col("value")))


@query(f"{_MS}, {_TOK} {_long_sql(_CHARTS)} UNION ALL {_long_sql(_TOKEN_CHARTS, ' WHERE avg_total IS NOT NULL')}")
def k10_chart_frames(spark, d):
    return reporting.chart_frames(_model_stats(spark, d), _tokens(spark, d)).withColumn("value", r6(F.col("value")))


# Reliability.


@query(f"{_MS} SELECT model, stale_rate <= 0.2 AS passes FROM ms")
def r01_reliability_gate(spark, d):
    return stats.reliability_gate(_model_stats(spark, d), 0.2).select("model", "passes")


@query(f"""{_MS}, {_TOK} SELECT a.model, round(avg_total, 6) AS avg_total, EXISTS (SELECT 1 FROM ms b WHERE b.model <> a.model AND b.mean_score >= a.mean_score AND b.stale_rate <= a.stale_rate AND (b.mean_score > a.mean_score OR b.stale_rate < a.stale_rate)) AS dominated
FROM ms a LEFT JOIN tk USING (model)""")
def r02_pareto(spark, d):
    return stats.pareto(_model_stats(spark, d), _tokens(spark, d)).select("model", r6(F.col("avg_total")).alias("avg_total"), "dominated")


@query(f"{_MS} SELECT model, round(p10, 6) AS p10, round(cvar10, 6) AS cvar10, CAST(row_number() OVER (ORDER BY mean_score DESC, model) AS INTEGER) AS rank FROM ms")
def r03_tail_risk(spark, d):
    return ranking.rank(_model_stats(spark, d), F.col("mean_score").desc(), F.col("model")).select("model", r6(F.col("p10")).alias("p10"), r6(F.col("cvar10")).alias("cvar10"), "rank")


@query(f"{_MS}, {_TOK} SELECT model, round(mean_score, 6) AS mean_score, round(avg_total, 6) AS avg_total FROM ms JOIN tk USING (model)")
def r04_efficiency_frame(spark, d):
    return _model_stats(spark, d).join(_tokens(spark, d), "model").select("model", r6(F.col("mean_score")).alias("mean_score"), r6(F.col("avg_total")).alias("avg_total"))


@query(f"{FX}, {_TOK}, w AS (SELECT model FROM models UNION ALL SELECT 'm9') SELECT model, round(coalesce(avg_total, 0), 6) AS avg_total, avg_total IS NOT NULL AS available FROM w LEFT JOIN tk USING (model)")
def r05_token_frame(spark, d):
    wanted = evaluations(spark, d).select("model").distinct().unionByName(spark.range(1).select(F.lit("m9").alias("model")))
    return costs.token_frame(_tokens(spark, d), wanted).select("model", r6(F.col("avg_total")).alias("avg_total"), "available")


@query(f"{_MS} SELECT model, CAST(row_number() OVER (ORDER BY mean_score DESC, model) AS INTEGER) AS by_score, CAST(row_number() OVER (ORDER BY stale_rate, model) AS INTEGER) AS by_stale FROM ms")
def r06_ranking_frame(spark, d):
    rows = ranking.rank(_model_stats(spark, d), F.col("mean_score").desc(), F.col("model"), name="by_score")
    return ranking.rank(rows, F.col("stale_rate"), F.col("model"), name="by_stale").select("model", "by_score", "by_stale")


# Predicates over the same rows.


@query(f"{FX} SELECT model, count(*) FILTER (WHERE {_REFUSED}) AS refused FROM fx GROUP BY model")
def f05_refusals(spark, d):
    return evaluations(spark, d).groupBy("model").agg(F.count_if(stats.is_refusal(F.col("answer"))).alias("refused"))


@query(f"{FX} SELECT model, count(*) FILTER (WHERE {_VALID}) AS valid FROM fx GROUP BY model")
def f06_valid_answers(spark, d):
    return evaluations(spark, d).groupBy("model").agg(F.count_if(stats.is_valid_answer(F.col("answer"))).alias("valid"))


@query(f"{SC} SELECT model, case_id, q_no, {_STALE1} AS stale FROM sc")
def f07_stale_law_v1(spark, d):
    return scored(spark, d).select("model", "case_id", "q_no", stats.mentions_stale_law(1).alias("stale"))


@query(f"{SC} SELECT model, case_id, q_no, {_STALE2} AS stale FROM sc")
def f08_stale_law_v2(spark, d):
    return scored(spark, d).select("model", "case_id", "q_no", stats.mentions_stale_law(2).alias("stale"))


@query(f"{SC} SELECT model, count(*) FILTER (WHERE error_flag IS NOT NULL) AS n FROM sc GROUP BY model")
def f09_has_error(spark, d):
    return scored(spark, d).groupBy("model").agg(F.count(F.nullif(F.col("error_flag"), F.lit(""))).alias("n"))


@query(f"{SC} SELECT model, case_id, q_no FROM sc WHERE greatest(d1, d2, d3, d4, d5) > 2")
def f10_any_positive(spark, d):
    return scored(spark, d).where(F.greatest(*D) > 2).select("model", "case_id", "q_no")


@query(f"{_MS} SELECT a.model AS a, b.model AS b, round(a.mean_score - b.mean_score, 6) AS delta FROM ms a JOIN ms b ON a.model < b.model")
def j12_model_deltas(spark, d):
    return merging.model_deltas(_model_stats(spark, d), "mean_score").withColumn("delta", r6(F.col("delta")))


@query(f"{_MS}, {_TOK} SELECT model, round(mean_score, 6) AS mean_score, round(avg_total, 6) AS avg_total FROM ms LEFT JOIN tk USING (model)")
def j05_stats_tokens(spark, d):
    return _model_stats(spark, d).join(_tokens(spark, d), "model", "left").select("model", r6(F.col("mean_score")).alias("mean_score"), r6(F.col("avg_total")).alias("avg_total"))


@query(f"{FX}, {_TOK} SELECT model, round(CASE WHEN mi = 1 THEN 7 ELSE avg_total END, 6) AS avg_total FROM (SELECT *, CAST(right(model, 1) AS INTEGER) AS mi FROM tk)")
def j06_token_fallback(spark, d):
    current = _tokens(spark, d).withColumn("avg_total", F.when(F.col("model") != "m1", F.col("avg_total")))
    other = current.select("model", *[F.lit(7.0).alias(c) for c in ("avg_in", "avg_out", "avg_total", "calls")])
    return costs.with_fallback(current, other).select("model", r6(F.col("avg_total")).alias("avg_total"))


@query(f"{_MS} SELECT model, round(mean_score, 6) AS mean_score, {_REASONING} AS reasoning FROM ms")
def j07_model_metadata(spark, d):
    meta = spark.range(7).select(F.concat(F.lit("m"), "id").alias("model"), F.col("id").isin(0, 2, 5).alias("reasoning"))
    return _model_stats(spark, d).join(meta, "model", "left").select("model", r6(F.col("mean_score")).alias("mean_score"), "reasoning")
