"""Queries of the rubric, similarity, question, masking and document operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.operators import documents, masking, questions, rubric, similarity
from scoreloom.plans.fixture import FX, KEYS, PAIRS, SC, evaluations, models, pairs, scored
from scoreloom.plans.registry import query, table

D = ["d1", "d2", "d3", "d4", "d5"]
R6 = lambda c: F.round(c, 6)


@query(f"{SC} SELECT model, CAST(row_number() OVER (ORDER BY sum(total_h) * 1.0 / count(*) DESC, model) AS BIGINT) AS rank, count(*) AS n, CAST(sum(total_h) AS BIGINT) AS sum_h, round(sum(total_h) / 100.0 / count(*), 6) AS mean_score, round(quantile_cont(total, 0.1), 6) AS p10 FROM sc GROUP BY model".replace("sum(total_h) / 100.0 / count(*)", "CAST(sum(total_h) AS DOUBLE) / 100 / count(*)"))
def flagship_leaderboard(spark, d):
    from scoreloom.operators.ranking import rank

    rows = scored(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.sum("total_h").alias("sum_h"), R6(F.percentile("total", F.lit(0.1))).alias("p10"))
    rows = rank(rows, (F.col("sum_h") / F.col("n")).desc(), F.col("model"))
    return rows.select("model", F.col("rank").cast("long").alias("rank"), "n", "sum_h", R6(F.col("sum_h") / 100.0 / F.col("n")).alias("mean_score"), "p10")


@query(f"{SC} SELECT model, case_id, q_no, CAST(r1 AS DOUBLE) AS d1, CAST(r2 AS DOUBLE) AS d2, CAST(r3 AS DOUBLE) AS d3, CAST(r4 AS DOUBLE) AS d4, CAST(r5 AS DOUBLE) AS d5 FROM raw")
def e01_dim_scores(spark, d):
    return rubric.dimension_scores(evaluations(spark, d)).select(*KEYS, *D)


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 7 <= 4 THEN doc_id % 7 ELSE 0 END AS DOUBLE) AS d1, CAST(0 AS DOUBLE) AS d2 FROM documents")
def e02_lone_digit(spark, d):
    said = table(spark, d, "documents").select("doc_id", F.concat(F.lit("总 "), F.col("doc_id") % 7, F.lit(" 项")).alias("judge_text"))
    return rubric.dimension_scores(said).select("doc_id", "d1", "d2")


@query(f"{SC} SELECT model, case_id, q_no, CAST(c1 AS DOUBLE) AS d1, CAST(c2 AS DOUBLE) AS d2, CAST(c3 AS DOUBLE) AS d3, CAST(c4 AS DOUBLE) AS d4, CAST(c5 AS DOUBLE) AS d5 FROM capped")
def e03_threshold_caps(spark, d):
    return rubric.threshold_caps(rubric.dimension_scores(evaluations(spark, d))).select(*KEYS, *D)


@query(f"{FX} SELECT model, case_id, q_no, trim(substr(judge_text, instr(judge_text, '- 微小错误'))) AS section FROM fx")
def e04_flag_section(spark, d):
    return evaluations(spark, d).select(*KEYS, rubric.flag_section(F.col("judge_text")).alias("section"))


@query(f"{SC} SELECT model, case_id, q_no, coalesce(minor, '无') AS minor, coalesce(moderate, '无') AS moderate, coalesce(major, '无') AS major FROM raw")
def e05_severity_split(spark, d):
    section = rubric.flag_section(F.col("judge_text"))
    return evaluations(spark, d).select(*KEYS, *[rubric.severity_text(section, s).alias(n) for n, s in (("minor", V.MINOR), ("moderate", V.MODERATE), ("major", V.MAJOR))])


@query(r"""SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 WHEN length(text) < 200 THEN 1
ELSE len(list_filter(string_split_regex(text, '[。；;]'), lambda x: length(regexp_replace(x, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) > 10)) END AS BIGINT) AS n_items FROM documents""")
def e06_itemise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(rubric.flag_items(F.col("text"), V.MINOR)).cast("long").alias("n_items"))


@query(f"{SC} SELECT model, case_id, q_no, CAST(k AS BIGINT) AS kept, CAST(c1 * k AS BIGINT) AS left1 FROM kept")
def e07_penalty(spark, d):
    rows = rubric.error_flags(rubric.threshold_caps(rubric.dimension_scores(evaluations(spark, d))))
    return rows.select(*KEYS, rubric.kept_hundredths().cast("long").alias("kept"), (F.col("d1").cast("long") * rubric.kept_hundredths()).cast("long").alias("left1"))


@query(f"{SC} SELECT model, case_id, q_no, CAST(e1 AS BIGINT) AS e1, CAST(e2 AS BIGINT) AS e2, CAST(e3 AS BIGINT) AS e3, CAST(e4 AS BIGINT) AS e4, CAST(e5 AS BIGINT) AS e5 FROM sc")
def e08_breakers(spark, d):
    return scored(spark, d).select(*KEYS, "e1", "e2", "e3", "e4", "e5")


@query(f"{SC} SELECT model, case_id, q_no, total_h, total, CAST(total_h * 5 AS DOUBLE) / 100 AS pct FROM sc")
def e09_totals(spark, d):
    return scored(spark, d).select(*KEYS, "total_h", "total", "pct")


@query(f"{SC} SELECT model, case_id, q_no, grade FROM sc")
def e10_grades(spark, d):
    return scored(spark, d).select(*KEYS, "grade")


@query(f"{SC} SELECT model, case_id, q_no, error_flag FROM sc")
def e11_flag_summary(spark, d):
    return scored(spark, d).select(*KEYS, "error_flag")


@query(f"{SC} SELECT model, case_id, q_no, n_major AS major, n_moderate AS obvious, n_minor AS minor, CAST(0 AS BIGINT) AS stale FROM sc")
def e12_error_counts(spark, d):
    return scored(spark, d).select(*KEYS, F.col("n_major").alias("major"), F.col("n_moderate").alias("obvious"), F.col("n_minor").alias("minor"), F.lit(0).cast("long").alias("stale"))


@query(f"{SC} SELECT model, case_id, q_no, title, total, grade, minor, moderate, major, error_flag FROM sc")
def e13_flat_rows(spark, d):
    return scored(spark, d).select(*KEYS, "title", "total", "grade", "minor", "moderate", "major", "error_flag")


@query(f"{SC} SELECT model, case_id, q_no, CASE WHEN (n + mi) % 19 = 0 THEN 0 ELSE total END AS total, CASE WHEN (n + mi) % 19 = 0 THEN '{V.FAILED_GRADE}' ELSE grade END AS grade, CASE WHEN (n + mi) % 19 = 0 THEN NULL ELSE d1 END AS d1, (n + mi) % 19 = 0 AS failed FROM sc")
def e14_failure_rows(spark, d):
    done = scored(spark, d).where((F.col("n") + F.col("mi")) % 19 != 0).select(*KEYS, "total", "pct", "grade", "d1")
    return rubric.with_failures(evaluations(spark, d).select(*KEYS), done, KEYS).select(*KEYS, "total", "grade", "d1", "failed")


# Similarity: documents against benchmark items, words for Han runs, English markers for legal ones.

RUN = "[A-Za-zÀ-ÿ]+"
_SETS = f"{PAIRS}, s AS (SELECT doc_id, list_distinct(regexp_extract_all(a, '{RUN}')) AS x, list_distinct(regexp_extract_all(b, '{RUN}')) AS y FROM p), c AS (SELECT doc_id, len(x) AS nx, len(y) AS ny, len(list_intersect(x, y)) AS i FROM s)"


@query(f"{_SETS} SELECT doc_id, CAST(i AS BIGINT) AS common, round(CASE WHEN nx = 0 OR ny = 0 THEN 0 ELSE CAST(i AS DOUBLE) / (nx + ny - i) END, 6) AS similarity FROM c")
def v01_run_similarity(spark, d):
    a, b = F.col("a"), F.col("b")
    common = F.size(F.array_intersect(similarity.runs(a, RUN), similarity.runs(b, RUN))).cast("long")
    return pairs(spark, d).select("doc_id", common.alias("common"), R6(similarity.run_similarity(a, b, RUN)).alias("similarity"))


#: The document's whole text stands inside a phrase and inside a citation.
_HAN_TEXT = "'本院认定事实清楚，' || CASE WHEN n % 2 = 0 THEN '判决驳回上诉' || t || '，维持原判。' ELSE '支持原告请求' || t || '，' END || CASE WHEN n % 3 = 0 THEN '依据《民法典》第' || (n % 40) || '条，' ELSE '' END || '法院确认责任' || t || '。'"
_HAN_REF = "'判决' || CASE WHEN n % 5 < 2 THEN '驳回上诉' ELSE '支持原告请求' END || '。' || CASE WHEN n % 4 = 0 THEN '《民法典》第' || (n % 20) || '条' ELSE '' END || chr(10) || '责任明确'"
_HAN = f"WITH h AS (SELECT doc_id, {_HAN_TEXT} AS a, {_HAN_REF} AS b FROM (SELECT doc_id, n_chars AS n, coalesce(text, '') AS t FROM documents))"


def _han(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("n"), F.coalesce("text", F.lit("")).alias("t"))
    return docs.selectExpr("doc_id", f"{_HAN_TEXT} AS a", f"{_HAN_REF} AS b")


_PHRASES = "list_distinct(list_concat(list_filter([" + ", ".join(f"'{w}'" for w in V.LEGAL_KEYWORDS) + "], lambda w: contains({0}, w)), regexp_extract_all({0}, '支持[^，。]*'), regexp_extract_all({0}, '驳回[^，。]*'), regexp_extract_all({0}, '认定[^，。]*'), regexp_extract_all({0}, '判决[^，。]*')))"


@query(f"{_HAN} SELECT doc_id, array_to_string(list_sort({_PHRASES.format('a')}), '|') AS phrases FROM h")
def v02_key_phrases(spark, d):
    return _han(spark, d).select("doc_id", F.array_join(F.array_sort(similarity.key_phrases(F.col("a"))), "|").alias("phrases"))


@query(f"{_HAN}, s AS (SELECT doc_id, {_PHRASES.format('a')} AS x, {_PHRASES.format('b')} AS y FROM h) SELECT doc_id, round(CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM s")
def v03_keyword_similarity(spark, d):
    return _han(spark, d).select("doc_id", R6(similarity.phrase_similarity(F.col("a"), F.col("b"))).alias("similarity"))


_OUT = "list_filter([" + ", ".join(f"'{w}'" for w in V.OUTCOME_KEYWORDS) + "], lambda w: contains({0}, w))"


@query(f"{_HAN}, s AS (SELECT doc_id, {_OUT.format('a')} AS x, {_OUT.format('b')} AS y FROM h) SELECT doc_id, CAST(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.5 WHEN len(list_intersect(x, y)) > 0 THEN 0.8 ELSE 0.3 END AS DOUBLE) AS consistency FROM s")
def v04_outcome_consistency(spark, d):
    return _han(spark, d).select("doc_id", similarity.outcome_consistency(F.col("a"), F.col("b")).cast("double").alias("consistency"))


_LAWS = "list_distinct(regexp_extract_all({0}, '第[一二三四五六七八九十\\d]+条|《[^》]+》|法[^，。]*'))"


@query(f"{_HAN}, s AS (SELECT doc_id, {_LAWS.format('a')} AS x, {_LAWS.format('b')} AS y FROM h) SELECT doc_id, round(CAST(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 0.5 WHEN len(x) = 0 OR len(y) = 0 THEN 0.2 ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) END AS DOUBLE), 6) AS similarity FROM s")
def v05_legal_basis(spark, d):
    return _han(spark, d).select("doc_id", R6(similarity.basis_similarity(F.col("a"), F.col("b")).cast("double")).alias("similarity"))


_LINES = "len(list_filter(string_split({0}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''))"
_RATIO = "CAST(least({0}, {1}) AS DOUBLE) / greatest({0}, {1})"


@query(f"{PAIRS}, s AS (SELECT doc_id, length(a) AS n, length(b) AS m, {_LINES.format('a')} AS p, {_LINES.format('b')} AS q FROM p) SELECT doc_id, round(CASE WHEN n = 0 OR m = 0 THEN 0 ELSE 0.6::DOUBLE * {_RATIO.format('n', 'm')} + 0.4::DOUBLE * CASE WHEN p = 0 OR q = 0 THEN 0.5 ELSE {_RATIO.format('p', 'q')} END END, 6) AS similarity FROM s")
def v06_structure(spark, d):
    return pairs(spark, d).select("doc_id", R6(similarity.structure_similarity(F.col("a"), F.col("b"))).alias("similarity"))


_SHARE = "CAST(len(list_intersect({0}, {1})) AS DOUBLE) / len(list_distinct(list_concat({0}, {1})))"
_BUNDLE = f"""{_HAN}, s AS (SELECT doc_id, doc_id % 9 <> 0 AS has, length(a) AS n, length(b) AS m, {_LINES.format('a')} AS p, {_LINES.format('b')} AS q, {_PHRASES.format('a')} AS x, {_PHRASES.format('b')} AS y,
  list_distinct(regexp_extract_all(a, '[一-龥]+')) AS ra, list_distinct(regexp_extract_all(b, '[一-龥]+')) AS rb, {_OUT.format('a')} AS oa, {_OUT.format('b')} AS ob, {_LAWS.format('a')} AS la, {_LAWS.format('b')} AS lb FROM h),
v AS (SELECT *, CASE WHEN len(ra) = 0 OR len(rb) = 0 THEN 0 ELSE {_SHARE.format('ra', 'rb')} END AS overall, coalesce({_SHARE.format('x', 'y')}, 0) AS keyword,
  CAST(CASE WHEN len(oa) = 0 OR len(ob) = 0 THEN 0.5 WHEN len(list_intersect(oa, ob)) > 0 THEN 0.8 ELSE 0.3 END AS DOUBLE) AS result,
  CAST(CASE WHEN len(la) = 0 AND len(lb) = 0 THEN 0.5 WHEN len(la) = 0 OR len(lb) = 0 THEN 0.2 ELSE {_SHARE.format('la', 'lb')} END AS DOUBLE) AS basis,
  0.6::DOUBLE * {_RATIO.format('n', 'm')} + 0.4::DOUBLE * CASE WHEN p = 0 OR q = 0 THEN 0.5 ELSE {_RATIO.format('p', 'q')} END AS reasoning FROM s)
SELECT doc_id, has AS has_decision, CAST(CASE WHEN has THEN len(x) ELSE 0 END AS BIGINT) AS ai_keywords, CAST(CASE WHEN has THEN len(y) ELSE 0 END AS BIGINT) AS judge_keywords, CAST(CASE WHEN has THEN len(list_intersect(x, y)) ELSE 0 END AS BIGINT) AS common_keywords,
  {', '.join(f"CASE WHEN has THEN round({c} * 100, 2) ELSE 0 END AS {name}" for c, name in (('overall', 'overall_similarity'), ('keyword', 'keyword_similarity'), ('result', 'result_consistency'), ('basis', 'legal_basis_similarity'), ('reasoning', 'reasoning_similarity')))} FROM v"""


@query(_BUNDLE)
def v07_metric_bundle(spark, d):
    rows = _han(spark, d).withColumn("b", F.when(F.col("doc_id") % 9 != 0, F.col("b")))
    shares = ("overall_similarity", "keyword_similarity", "result_consistency", "legal_basis_similarity", "reasoning_similarity")
    found = similarity.similarity_metrics(rows, "a", "b")
    return found.select("doc_id", "has_decision", "ai_keywords", "judge_keywords", "common_keywords", *[F.round(F.col(c) * 100, 2).alias(c) for c in shares])


# Questions and replies.

_STRIP = r"regexp_replace({0}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"
_BARE = _STRIP.format("regexp_replace(regexp_replace(x, '(?s)^[^.]*\\.', ''), '(?s)^[^、]*、', '')")


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')[1:5] AS lines FROM documents)
SELECT doc_id, CAST(k AS INTEGER) AS q_no, {_BARE.replace('(x,', '(lines[k],')} AS question FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM l)""")
def q01_parse_questions(spark, d):
    return questions.question_rows(table(spark, d, "documents"), "text", ["doc_id"])


@query(f"{PAIRS} SELECT doc_id, contains(a, b) AS verbatim FROM p")
def q02_verbatim(spark, d):
    return pairs(spark, d).select("doc_id", questions.is_verbatim(F.col("b"), F.col("a")).alias("verbatim"))


_Q3 = PAIRS + """,
k AS (SELECT doc_id, b AS ai, a AS src, regexp_extract_all(b, '[A-Za-z]{2,}') AS keys FROM p),
s AS (SELECT doc_id, ai, src, keys, i, trim(x, ' ' || chr(9) || chr(13)) AS sentence, len(list_filter(keys, lambda w: contains(x, w))) AS hits
      FROM (SELECT *, unnest(string_split_regex(src, '[.;\\n]')) AS x, generate_subscripts(string_split_regex(src, '[.;\\n]'), 1) AS i FROM k) WHERE length(trim(x, ' ' || chr(9) || chr(13))) >= 20),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) AS rn FROM s)
SELECT k.doc_id, length(k.ai) >= 20 AND len(k.keys) > 0 AND coalesce(CAST(best.hits AS DOUBLE) / len(k.keys) > 0.3, false) AS found, CAST(coalesce(best.hits, 0) AS BIGINT) AS hits
FROM k LEFT JOIN best ON best.doc_id = k.doc_id AND best.rn = 1"""


@query(_Q3)
def q03_best_passage(spark, d):
    keys = F.regexp_extract_all("b", F.lit("[A-Za-z]{2,}"), 0)
    sentences = F.filter(F.split("a", "[.;\n]"), lambda s: F.length(F.btrim(s, F.lit(" \t\r"))) >= 20)
    hits = F.coalesce(F.array_max(F.transform(sentences, lambda s: F.size(F.filter(keys, lambda w: F.contains(s, w))))), F.lit(0))
    passage = questions.best_passage(F.col("b"), F.col("a"), keyword="[A-Za-z]{2,}", stops="[.;\n]")
    found = (passage != F.col("b")) | F.contains(F.col("a"), F.col("b"))
    return pairs(spark, d).select("doc_id", ((F.try_divide(hits, F.size(keys)) > 0.3) & found).alias("found"), hits.cast("long").alias("hits"))


@query("SELECT doc_id, left(text, CASE WHEN doc_id % 2 = 0 THEN 2000 ELSE 3000 END) AS context FROM documents")
def q04_context(spark, d):
    return table(spark, d, "documents").select("doc_id", questions.context(F.col("text"), F.col("doc_id") % 2 == 0).alias("context"))


@query("SELECT doc_id, '案例：' || text || chr(10) || '问题：' || source AS prompt FROM documents")
def q05_prompt(spark, d):
    return table(spark, d, "documents").select("doc_id", questions.prompt("案例：{case}\n问题：{question}", case=F.col("text"), question=F.col("source")).alias("prompt"))


@query("SELECT doc_id, text AS answer, CASE doc_id % 3 WHEN 0 THEN 'r' || doc_id WHEN 1 THEN 't' || doc_id END AS thinking FROM documents")
def q06_parse_reply(spark, d):
    inner = F.struct(F.col("text").alias("content"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("r"), "doc_id")).alias("reasoning_content"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("t"), "doc_id")).alias("thinking"))
    reply = F.to_json(F.struct(F.array(F.struct(inner.alias("message"))).alias("choices")))
    answer, thinking = questions.parse_reply(F.col("reply"))
    return table(spark, d, "documents").select("doc_id", reply.alias("reply")).select("doc_id", answer.alias("answer"), thinking.alias("thinking"))


# Masking.

def _sql_rules(text: str, rules) -> str:
    """The rules as nested SQL replacements. A look-ahead at the end becomes a group that is put back."""
    for pattern, new in rules:
        new = re.sub(r"\$(\d)", r"\\\1", new)
        if "(?=" in pattern:
            head, tail = pattern[: pattern.index("(?=")], pattern[pattern.index("(?=") + 3 : -1]
            groups = len(re.findall(r"\((?!\?)", head))
            pattern, new = f"{head}({tail})", f"{new}\\{groups + 1}"
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


def _texts(spark, d, made: str):
    """Each document's text with ``made``, SQL over ``n``, below it."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("n_chars").alias("n"))
    return docs.select("doc_id", F.concat("text", F.lit("\n"), F.expr(made)).alias("t"))


def _made(made: str) -> str:
    return f"(SELECT doc_id, text || chr(10) || {made.replace('AS STRING', 'AS VARCHAR')} AS t FROM (SELECT doc_id, text, n_chars AS n FROM documents))"


_PADDED = "lpad(CAST(n AS STRING), {0}, '{1}')"
#: Something for each of the eleven rules.
_NUM = (
    "'案号（20' || (10 + n % 10) || '）京行终' || n || '号，（2019）最高法民辖' || n || '刑初7号；海政复决字〔2023〕' || n || '号；公民身份号码：' || "
    + _PADDED.format(18, 1) + " || '；身份证号' || " + _PADDED.format(15, 2) + " || '；身份证号码：' || " + _PADDED.format(17, 4) + " || 'X，电话1' || (3 + n % 7) || "
    + _PADDED.format(9, 0) + " || '，座机0' || (10 + n % 80) || '-' || " + _PADDED.format(8, 6) + " || '；卡622' || (n % 10) || 'xxxx' || " + _PADDED.format(4, 3)
    + " || '；账号：' || " + _PADDED.format(12, 6) + " || '；账户' || " + _PADDED.format(12, 7) + " || '。'"
)


@query(f"SELECT doc_id, {_sql_rules('t', V.SENSITIVE_RULES)} AS masked FROM {_made(_NUM)}")
def m01_sensitive(spark, d):
    return _texts(spark, d, _NUM).select("doc_id", masking.mask_sensitive(F.col("t")).alias("masked"))


#: Something for each of the nine rules, those for half-masked dates too.
_DATES = (
    "'于20' || (10 + n % 10) || '年' || (1 + n % 12) || '月' || (1 + n % 28) || '日' || (n % 24) || '时' || (n % 60) || '分立案；2020-1-' || (1 + n % 9) || '，2019年止。二〇二一年十月二十' || "
    "CASE WHEN n % 2 = 0 THEN '三日' ELSE '四号' END || '；某年' || (1 + n % 12) || '月4日5时' || (n % 60) || '分；某年3月' || (1 + n % 28) || '日5时；某年3月' || (1 + n % 9) || '日；某年某月某日' || (n % 24) || '时8分，某年某月某日' || (n % 24) || '时。'"
)


@query(f"SELECT doc_id, {_sql_rules('t', V.DATE_RULES)} AS masked FROM {_made(_DATES)}")
def m02_dates(spark, d):
    return _texts(spark, d, _DATES).select("doc_id", masking.mask_dates(F.col("t")).alias("masked"))


#: Addresses with digits end before a stop or give back their last digit before a unit of time, so that SQL can say it without
#: looking ahead.
_PLACES = "'住乐府江南' || n || '号楼' || (n % 9) || '单元306号，江南3-' || (n % 9) || '-306。在' || (100 + n % 800) || '日内，于' || (10 + n % 80) || '时；广东省，深圳市，海淀区，中关村路，第五单元。内蒙古自治区。'"
_DIGITS_BEFORE_TIME = r"regexp_replace({0}, '[一-龥]+[\d\-]{{2,}}[\d号]*([\d号][月日时分])', '某地址\1', 'g')"
_DIGITS_BEFORE_STOP = r"regexp_replace({0}, '[一-龥]+[\d\-]{{2,}}[\d号]*([^月日时分\d号\-]|$)', '某地址\1', 'g')"


@query(f"SELECT doc_id, {_sql_rules(_DIGITS_BEFORE_STOP.format(_DIGITS_BEFORE_TIME.format(_sql_rules('t', V.LOCATION_RULES[:1]))), V.LOCATION_RULES[2:])} AS masked FROM {_made(_PLACES)}")
def m03_locations(spark, d):
    return _texts(spark, d, _PLACES).select("doc_id", masking.mask_locations(F.col("t")).alias("masked"))


#: Names that a stop follows, so that what follows one rule's match begins no other match.
_NAMES = (
    "'张' || CASE WHEN n % 2 = 0 THEN '某女' ELSE '某男' END || '，原告：李四，被告王五某，证人：赵六，审判长孙七，委托代理人：周八' || (n % 9) || '，委托代理人吴九。钱某某，郑某甲，冯某。陈某某等人'"
)


@query(f"SELECT doc_id, {_sql_rules('t', V.NAME_RULES)} AS masked FROM {_made(_NAMES)}")
def m04_role_names(spark, d):
    return _texts(spark, d, _NAMES).select("doc_id", masking.mask_role_names(F.col("t")).alias("masked"))


def _sql_matches(rows: str, name: str, after: str, decided: str) -> str:
    """SQL that replaces, from left to right, each ``name`` that one of ``after`` or the end follows: takes the first match off the rest, again and
    again. ``decided`` is what ``m.name`` becomes."""
    return f"""(WITH RECURSIVE steps AS (
  SELECT doc_id, '' AS done, t AS rest, true AS more FROM {rows}
  UNION ALL
  SELECT doc_id, CASE WHEN m.name <> '' THEN done || m.pre || {decided} ELSE done END AS done, CASE WHEN m.name <> '' THEN m.post ELSE rest END AS rest, m.name <> '' AS more
  FROM (SELECT *, regexp_extract(rest, '(?s)^(.*?)({name})({after}.*|)$', ['pre', 'name', 'post']) AS m FROM steps WHERE more)
) SELECT doc_id, done || rest AS t FROM steps WHERE NOT more)"""


_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)


def _sql_gendered(rows: str) -> str:
    decided = f"CASE WHEN regexp_replace(m.name, '[,，]?[女男]$', '') IN ({_QUOTED(V.LEGAL_TERMS)}) THEN m.name WHEN contains(m.name, '女') THEN '某女' ELSE '某男' END"
    return _sql_matches(rows, "[一-龥]{2,4}[,，]?[女男]", r"[，。；：\s、]", decided)


def _sql_standalone(rows: str) -> str:
    decided = f"CASE WHEN contains(m.name, '某') OR m.name IN ({_QUOTED(sorted(masking.KEPT_TOKENS))}) THEN m.name ELSE '某' END"
    return _sql_matches(rows, "[一-龥]{2,4}", r"[，。；：\s、与在和为是向等]", decided)


#: For the rules that decide by a function of the match.
CASE_TEXT = "'原告张三' || (n % 3) || '，女，住北京市海淀区中关村路' || n || '号。证人：李四、王五某，审判长赵六。某某甲等认为' || n || '元应予支持。'"


def _case_texts(spark, d):
    return _texts(spark, d, CASE_TEXT)


@query(f"SELECT doc_id, t AS masked FROM {_sql_gendered(_made(CASE_TEXT))}")
def m05_gendered_names(spark, d):
    return _case_texts(spark, d).select("doc_id", masking.mask_gendered_names(F.col("t")).alias("masked"))


@query(f"SELECT doc_id, t AS masked FROM {_sql_standalone(_made(CASE_TEXT))}")
def m06_standalone_names(spark, d):
    return _case_texts(spark, d).select("doc_id", masking.mask_standalone_names(F.col("t")).alias("masked"))


@query("SELECT doc_id, replace(replace('原某' || doc_id || coalesce(text, '') || '被某', '原某', '原告'), '被某', '被告') AS masked FROM documents")
def m07_corrections(spark, d):
    return table(spark, d, "documents").select("doc_id", masking.correct(F.concat(F.lit("原某"), "doc_id", F.coalesce("text", F.lit("")), F.lit("被某"))).alias("masked"))


def _sql_mask(rows: str) -> str:
    """The cascade as SQL. Places are masked as in M3, names of a role as in M4."""
    numbers = _sql_rules(_sql_rules("t", V.SENSITIVE_RULES), V.DATE_RULES)
    places = _sql_rules(_DIGITS_BEFORE_STOP.format(_DIGITS_BEFORE_TIME.format(_sql_rules(numbers, V.LOCATION_RULES[:1]))), V.LOCATION_RULES[2:])
    gendered = _sql_gendered(f"(SELECT doc_id, {places} AS t FROM {rows})")
    alone = _sql_standalone(f"(SELECT doc_id, {_sql_rules('t', V.NAME_RULES)} AS t FROM {gendered})")
    corrected = "t"
    for wrong, right in V.CORRECTIONS:
        corrected = f"replace({corrected}, '{wrong}', '{right}')"
    return f"(SELECT doc_id, {corrected} AS t FROM {alone})"


_DECISION = f"(SELECT doc_id, '判决：' || t AS t FROM {_made(CASE_TEXT)})"


@query(f"SELECT a.doc_id, a.t AS case_text_masked, b.t AS judge_decision_masked FROM {_sql_mask(_made(CASE_TEXT))} a JOIN {_sql_mask(_DECISION)} b ON a.doc_id = b.doc_id")
def m08_mask_case(spark, d):
    rows = _case_texts(spark, d).select("doc_id", F.col("t").alias("case_text"), F.concat(F.lit("判决："), "t").alias("judge_decision"))
    return masking.mask_cases(rows).select("doc_id", "case_text_masked", "judge_decision_masked")


@query(r"SELECT doc_id, regexp_replace('x' || doc_id || coalesce(text, ''), '\s+$', '') AS cleaned FROM documents")
def m09_clean_reply(spark, d):
    said = F.concat(F.lit("好的。脱敏后的文本：\n x"), "doc_id", F.coalesce("text", F.lit("")), F.lit(" \n原始文本：y"))
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(masking.clean_reply(said), r"^\s+|\s+$", "").alias("cleaned"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'remote' ELSE text END AS masked FROM documents")
def m10_mode_switch(spark, d):
    remote = F.when(F.col("doc_id") % 3 == 0, "remote").when(F.col("doc_id") % 3 == 1, " ")
    return table(spark, d, "documents").select("doc_id", masking.choose_masked(remote, F.col("text")).alias("masked"))


# Documents.


@query()
def p01_clean_pages(spark, d):
    return table(spark, d, "pages").select("page_id", documents.clean_text(F.col("html"), full_entities=True).alias("text"))


_TRIM = "trim({0}, ' ' || chr(9) || chr(13) || chr(160))"


@query("""WITH p AS (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages),
q AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM p),
r AS (SELECT page_id, regexp_replace(regexp_replace(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]', '', 'g'), '[ \\t]+', ' ', 'g') AS t FROM q)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM r""")
def p01_clean_pages_builtin(spark, d):
    return table(spark, d, "pages").select("page_id", documents.clean_text(F.col("html")).alias("text"))


#: The document's whole text stands among the facts and in the reasoning.
_DOC = "'案情' || n || '。' || t || chr(10) || CASE WHEN n % 4 = 1 THEN '' WHEN n % 4 = 2 THEN '本院经审查认为，' || t || '理由甲' ELSE '本院认为：' || t || '理由乙' END || CASE WHEN n % 3 = 0 THEN '' ELSE '。判决如下：驳回' || n END || CASE WHEN n % 2 = 0 THEN '。本判决为终审判决。' ELSE '审判长某' END || '二〇二' || '一年十' || CASE WHEN n % 5 = 0 THEN '二' ELSE '' END || '月二十三日'"
_PARTS = """SELECT doc_id, n, n % 4 <> 1 AS has_r, n % 3 <> 0 AS has_d, t, CASE WHEN n % 4 = 2 THEN '本院经审查认为，' || t || '理由甲' ELSE '本院认为：' || t || '理由乙' END AS r, '驳回' || n || CASE WHEN n % 2 = 0 THEN '。' ELSE '' END AS dec FROM (SELECT doc_id, n_chars AS n, coalesce(text, '') AS t FROM documents)"""


def _contents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("n"), F.coalesce("text", F.lit("")).alias("t"))
    return docs.selectExpr("doc_id", f"{_DOC} AS content")


@query(f"""WITH x AS ({_PARTS}), y AS (SELECT doc_id, n, has_r, has_d, r || CASE WHEN has_d THEN '。判决如下：驳回' || n ELSE '' END || CASE WHEN n % 2 = 0 THEN '。' ELSE '' END AS reasoning, dec FROM x)
SELECT doc_id, CASE WHEN has_r THEN reasoning END AS reasoning, CASE WHEN has_d THEN dec END AS decision_part,
CASE WHEN has_r AND has_d THEN reasoning || chr(10) || chr(10) || dec WHEN has_r THEN reasoning WHEN has_d THEN dec ELSE '' END AS judge_decision FROM y""")
def p02_p06_split(spark, d):
    return documents.split_document(_contents(spark, d)).select("doc_id", "reasoning", "decision_part", "judge_decision")


@query(f"""WITH x AS ({_PARTS}) SELECT doc_id, regexp_replace('案情' || n || '。' || t || chr(10) || CASE WHEN has_r THEN '' WHEN has_d THEN '。' ELSE CASE WHEN n % 2 = 0 THEN '。本判决为终审判决。' ELSE '审判长某' END || '二〇二一年十' || CASE WHEN n % 5 = 0 THEN '二' ELSE '' END || '月二十三日' END, '[\\s\\x{{a0}}]+$', '') AS facts FROM x""")
def p07_facts(spark, d):
    return documents.split_document(_contents(spark, d)).select("doc_id", "facts")


@query("SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN '2021-12-23' ELSE '2021-10-23' END AS case_date FROM documents")
def p08_han_date(spark, d):
    return _contents(spark, d).select("doc_id", documents.case_date(F.col("content")).alias("case_date"))


@query("SELECT doc_id, '20' || (10 + n_chars % 15) || '-' || lpad(CAST(1 + n_chars % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + n_chars % 28 AS VARCHAR), 2, '0') AS case_date FROM documents")
def p09_arabic_date(spark, d):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("自1999-1-1起，20"), 10 + F.col("n_chars") % 15, F.lit("年"), 1 + F.col("n_chars") % 12, F.lit("月"), 1 + F.col("n_chars") % 28, F.lit("日止"))
    return table(spark, d, "documents").select("doc_id", documents.case_date(text).alias("case_date"))


@query("SELECT page_id, 'p' || page_id || '.v1' AS title FROM pages")
def p10_title(spark, d):
    return table(spark, d, "pages").select("page_id", documents.title_of(F.concat(F.lit("/a.b/p"), "page_id", F.lit(".v1.docx"))).alias("title"))


@query(f"{FX} SELECT model, case_id, q_no, CAST(length(regexp_replace(left(judge_text, 200), '[^一-龥]', '', 'g')) AS BIGINT) AS han FROM fx")
def p11_han_count(spark, d):
    return evaluations(spark, d).select(*KEYS, documents.han_count(F.col("judge_text")).cast("long").alias("han"))


@query(f"{FX} SELECT count(*) AS rows FROM fx")
def j10_evaluation_grid(spark, d):
    from scoreloom.operators.merging import evaluation_grid

    return evaluation_grid(table(spark, d, "documents").select("doc_id"), models(spark)).agg(F.count("*").alias("rows"))
