"""Golden rows and brute-force versions of the evaluation operators."""

import html
import io
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.operators import costs, documents, masking, merging, questions, ranking, rubric, similarity, stats
from scoreloom.sources import models, readers, writers


def judge(scores, minor="无", moderate="无", major="无"):
    parts = [f"【{n}】\n得分：{s}分\n理由：略" if s is not None else f"【{n}】\n理由：略" for n, s in zip(V.DIMENSIONS, scores, strict=True)]
    return "\n".join(parts) + f"\n【错误标记】：\n- 微小错误：{minor}\n- 明显错误：{moderate}\n- 重大错误：{major}"


def evaluate(spark, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, judge_text string")
    return [r for r in rubric.evaluate(frame).orderBy("i").collect()]


@pytest.mark.parametrize("text,total,grade", [
    (judge([3, 4, 2, 1, 4]), 12.0, 1),
    (judge([0, 4, 3, 3, 4]), 8.0, 2),
    (judge([4] * 5, minor="措辞", moderate="引用不准"), 16.4, 0),
    (judge([4] * 5, major="编造事实"), 6.0, 2),
    (judge([4] * 5, major="未出现受害者责备"), 10.0, 2),
    (judge([4] * 5, minor="无（仅提示）"), 19.4, 0),
    (judge([4] * 5, major="无，仅提示"), 20.0, 0),
])
def test_rubric_golden_rows(spark, text, total, grade):
    row = evaluate(spark, text)[0]
    assert row["total"] == pytest.approx(total) and row["grade"] == V.GRADES[grade]
    assert row["pct"] == pytest.approx(total * 5)


def test_rubric_quirks(spark):
    long = "第一个重大问题描述得相当长" * 9 + "。" + "第二个重大问题描述得也相当长" * 9
    two, borrowed = evaluate(spark, judge([4] * 5, major=long), judge([4, 4, None, 2, 4]))
    assert len(two["major"]) == 2 and two["total"] == pytest.approx(4.0) and two["grade"] == V.GRADES[3]
    assert borrowed["d3"] == 2.0
    frame = spark.createDataFrame([(judge([4, 4, None, 2, 4]),)], "judge_text string")
    assert rubric.dimension_scores(frame, strict=True).first()["d3"] == 0.0
    swallowed = "【错误标记】：\n- 明显错误：甲\n- 微小错误：乙\n- 重大错误：丙"
    row = evaluate(spark, swallowed)[0]
    assert row["moderate"] == ["甲\n- 微小错误：乙"] and row["minor"] == ["乙"] and row["major"] == ["丙"]
    assert evaluate(spark, "没有任何格式")[0]["total"] == 0.0


def brute_mask(text):
    """The cascade as plain re, from the rule tables."""
    for pattern, new in (*V.SENSITIVE_RULES, *V.DATE_RULES, *V.LOCATION_RULES):
        text = re.sub(pattern, new, text)
    text = re.sub(V.GENDER_NAME_PATTERN, lambda m: m[0] if m[1] in V.LEGAL_TERMS else ("某女" if "女" in m[0] else "某男"), text)
    for pattern, new in V.NAME_RULES:
        text = re.sub(pattern, new.replace("$", "\\"), text)
    text = re.sub(V.STANDALONE_NAME_PATTERN, lambda m: m[0] if "某" in m[0] or m[0] in masking.KEPT_TOKENS else "某", text)
    for wrong, right in V.CORRECTIONS:
        text = text.replace(wrong, right)
    return text


def test_masking_cascade(spark):
    texts = [
        "原告张雨，女，住北京市海淀区中关村路12号。", "（2024）京行终6147号，电话13812345678，账号：1234567890123", "二〇二一年十月三日，2020-1-2，2019年5月6日3时4分，2018年",
        "审判长：赵六；书记员 钱七。王某某、李某甲等与某公司在审理中。", "乐府江南3-3-306，公民身份号码110101199001011234", "", "english only 12-34", "证人李四、王五，刘聪魁,男。原某认为",
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["m"] for r in frame.select("i", masking.mask(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == [brute_mask(t) for t in texts]
    assert "张雨" not in got[0] and "13812345678" not in got[1]


def test_document_split_and_dates(spark):
    texts = [
        "案情甲。本院认为，理由。判决如下：驳回。本判决为终审判决。审判长某", "判决如下：一审。本院认为，二审理由。审判长某",
        "没有标记", "前文本院认为后文", "二〇二三年十二月三十一日 2020年1月2日", "2021-3-4，2022/05/06",
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    rows = documents.split_document(frame).withColumn("date", documents.case_date(F.col("content"))).orderBy("i").collect()
    assert rows[0]["judge_decision"] == "本院认为，理由。判决如下：驳回。\n\n驳回。" and rows[0]["facts"] == "案情甲。"
    assert rows[1]["judge_decision"] == "一审。本院认为，二审理由。" and rows[1]["facts"] == ""
    assert rows[2]["judge_decision"] == "" and rows[2]["facts"] == "没有标记" and rows[3]["facts"] == "前文"
    assert rows[4]["date"] == "2023-12-31" and rows[5]["date"] == "2022-05-06"


def test_clean_text_like_plain_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")

    def brute(text):
        text = html.unescape(re.sub("<[^>]+>", "", text))
        text = "".join(c for c in text if 32 <= ord(c) <= 126 or ord(c) in (9, 10, 13) or ord(c) >= 160)
        return "\n".join(x for x in (line.strip() for line in re.sub("[ \t]+", " ", text).split("\n")) if x)

    for row in pages.withColumn("clean", documents.clean_text(F.col("html"), full_entities=True)).collect():
        assert row["clean"] == brute(row["html"])


def test_questions(spark):
    text = "1. 是否构成家暴？\n\n  根据第3.2条、第4条是否适用？\n2、如何判？"
    frame = spark.createDataFrame([(1, text)], "k int, t string")
    assert [r["question"] for r in questions.question_rows(frame, "t", ["k"]).orderBy("q_no").collect()] == ["是否构成家暴？", "第4条是否适用？", "如何判？"]
    safe = frame.select(questions.parse_questions(F.col("t"), safe=True).alias("q")).first()["q"]
    assert safe[1] == "根据第3.2条、第4条是否适用？"
    source = "开头。" + "原告主张被告应当赔偿损失五万元并承担诉讼费用。" + "其余无关内容占位文字若干若干若干若干。"
    pair = spark.createDataFrame([("法院指出：原告主张被告应当赔偿损失，五万元", source), ("太短", source), ("毫不相关的另一段文字在这里出现了对吧真的", source)], "a string, b string")
    found = [r["p"] for r in pair.select(questions.best_passage(F.col("a"), F.col("b")).alias("p")).collect()]
    assert "太短" in found and any("五万元" in p for p in found)


def test_similarity_golden_rows(spark):
    text = "依据《民法典》第一千零七十九条，法院认为。第12条"
    rows = spark.createDataFrame([(text, "无引用"), ("x", "y"), (text, text)], "a string, b string").select(
        F.array_sort(similarity.citations(F.col("a"))).alias("c"), similarity.basis_similarity(F.col("a"), F.col("b")).alias("s")
    ).collect()
    assert set(rows[0]["c"]) == {"《民法典》", "法院认为", "第12条"}
    assert [r["s"] for r in rows] == [0.2, 0.5, 1.0]


def test_p10_and_cvar(spark):
    scores = [2.6, 5, 7, 9, 14, 16.5, 17, 18, 19, 20]
    frame = spark.createDataFrame([("m", i, 1, float(s), "a", None, None, None, None, "ok", 1.0, 1.0, 1.0, 1.0, 1.0) for i, s in enumerate(scores)], "model string, case_id int, q_no int, total double, answer string, minor string, moderate string, major string, error_flag string, rationale string, d1 double, d2 double, d3 double, d4 double, d5 double")
    row = stats.model_stats(frame).first()
    assert row["p10"] == pytest.approx(4.76) and row["cvar10"] == pytest.approx(2.6)
    exact = stats.bootstrap_exact(frame, 500).first()
    assert exact["low"] <= np.mean(scores) <= exact["high"]
    drawn = stats.bootstrap_means(frame).first()
    assert abs(drawn["low"] - exact["low"]) < 0.5 and abs(drawn["high"] - exact["high"]) < 0.5 and drawn["mean"] == pytest.approx(np.mean(scores))
    assert stats.bootstrap_means(frame.repartition(3)).first() == drawn
    many = np.repeat(np.round(np.linspace(0, 20, 400), 1), 5)
    rows = spark.createDataFrame([("m", float(x)) for x in many], "model string, total double")
    rng = np.random.default_rng(1)
    means = many[rng.integers(0, len(many), (4000, len(many)))].mean(1)
    drawn = stats.bootstrap_means(rows).first()
    assert abs(drawn["low"] - np.quantile(means, 0.025)) < 0.03 and abs(drawn["high"] - np.quantile(means, 0.975)) < 0.03


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "cases.json").write_text('{"1": {"id": "1", "title": "a", "case_text": "t", "metadata": {"k": "v"}}}', encoding="utf-8")
    (tmp_path / "bad.json").write_text("{broken", encoding="utf-8")
    assert [r["title"] for r in readers.case_store(spark, str(tmp_path / "cases.json")).collect()] == ["a"]
    assert readers.case_store(spark, str(tmp_path / "bad.json")).count() == 0
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    folder = tmp_path / "docs"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{para('one')}{para(' ')}<w:tbl><w:tr><w:tc>{para('cell')}</w:tc></w:tr></w:tbl></w:body></w:document>")
    (folder / "b.docx").write_bytes(b"not a zip")
    (folder / "c.doc").write_bytes(("法院的判决" * 30).encode("gbk"))
    rows = {r["path"].rsplit("/", 1)[1]: r["content"] for r in readers.document_folder(spark, str(folder)).collect()}
    assert rows == {"a.docx": "one\ncell", "b.docx": None, "c.doc": "法院的判决" * 30}
    assert readers.docx_text(io.BytesIO(b"x").getvalue()) is None
    page = ("<html><body><p>" + "法院的判决&amp;" * 20 + "</p>\n<p>完</p></body></html>").encode("gbk")
    assert readers.decode_document(page) == "法院的判决&" * 20 + "\n完"
    assert readers.decode_document(b"\xff\x00" + page) == "法院的判决&" * 20 + "\n完" or readers.decode_document(b"\xff" + page) is not None
    assert readers.decode_document(b"<html>no</html>") is None
    out = str(tmp_path / "evals")
    frame = spark.createDataFrame([("m1", 1), ("m2", 2)], "model string, v int")
    writers.replace_models(frame, out)
    writers.replace_models(frame.where("model = 'm1'").withColumn("v", F.lit(9)), out)
    assert {(r["model"], r["v"]) for r in spark.read.parquet(out).collect()} == {("m1", 9), ("m2", 2)}
    with pytest.raises(ValueError):
        readers.import_sheet(frame)


def test_model_calls():
    waits = []
    clock = iter(range(0, 1000)).__next__

    class Flaky:
        def __init__(self):
            self.replies = [RuntimeError("x"), {"content": " ", "finish_reason": "stop"}, {"content": "cut", "finish_reason": "length"}, {"content": "whole", "finish_reason": "stop"}]
            self.tokens = []

        def complete(self, prompt, temperature, max_tokens):
            self.tokens.append(max_tokens)
            reply = self.replies.pop(0)
            if isinstance(reply, Exception):
                raise reply
            return reply

    client = Flaky()
    pace = models.Pace(2, 0.1, lambda: float(clock()), waits.append)
    assert models.call(client, "p", 0.3, pace, sleep=waits.append) == ("whole", None)
    assert client.tokens == [3000, 3000, 3000, 6000] and any(w > 10 for w in waits)


def test_kinds_of_calls(spark):
    class Scripted:
        """Answers by the kind of prompt."""

        def complete(self, prompt, temperature, max_tokens):
            if temperature == models.TEMPERATURES["questions"]:
                return {"content": "1. 是否构成家暴？\n\n2、赔偿是否支持\n3. 第三个", "finish_reason": "stop"}
            if temperature == models.TEMPERATURES["extract"]:
                return {"content": "驳回其余请求。" if "家暴" in prompt else "支持赔偿五百元的请求，证据充分，其余不予以支持", "finish_reason": "stop"}
            return {"content": f"{temperature}:{prompt[:4]}", "finish_reason": "stop"}

    decision = "经查，事实清楚。本院支持赔偿五百元的请求，因为证据充分而且没有相反证据。驳回其余请求。"
    frame = spark.createDataFrame([(1, "案情", decision)], "case_id int, text string, decision string")
    rows = models.questions_with_answers(frame, "text", "decision", 2, Scripted).orderBy("q_no").collect()
    assert [(r["q_no"], r["question"]) for r in rows] == [(1, "是否构成家暴？"), (2, "赔偿是否支持")]
    assert rows[0]["judge_answer"] == "驳回其余请求。" and rows[1]["judge_answer"] in decision and "五百元" in rows[1]["judge_answer"]
    assert models.analyse(frame, "text", "decision", Scripted).first()["answer"] == "0.3:问题：经"
    assert models.compare(frame, "text", "decision", Scripted).first()["comparison"] == "0.5:比较两份"
    assert models.ask_questions(frame, "text", client=Scripted).first()["questions"] == ["是否构成家暴？", "赔偿是否支持", "第三个"]
    models.register("Scripted", lambda model: Scripted())
    assert isinstance(models.client_for("SCRIPTED")(), Scripted) and isinstance(models.client_for("unknown")(), models.EchoClient)


def test_places_and_look_back(spark):
    rows = [(i % 7, f"k{i % 2}", i * 7 % 100) for i in range(300)]
    frame = spark.createDataFrame(rows, "x int, k string, s int").selectExpr("x", "k", "timestamp_seconds(s) as ts", "s")
    placed = ranking.numbered(frame.select("x", "k", "s"), F.col("x").desc(), F.col("s")).orderBy("rank").collect()
    assert [r["rank"] for r in placed] == list(range(1, 301)) and [(-r["x"], r["s"]) for r in placed] == sorted((-x, s) for x, _, s in rows)
    assert ranking.numbered(frame.limit(0), F.col("x")).count() == 0
    got = sorted((r["k"], r["s"], r["n"]) for r in ranking.look_back(frame, "k", "ts", 10, "n").collect())
    assert got == sorted((k, s, sum(k == j and s - 10 <= t <= s for _, j, t in rows)) for _, k, s in rows)


def test_costs_and_merging(spark):
    book = costs.price_book(spark)
    measured = spark.createDataFrame([(0, 0)], "tokens_in long, tokens_out long")
    got = {r["provider"]: r["cost"] for r in costs.projected_costs(measured, book).collect()}
    assert got["Gemini 2.0 Flash"] == pytest.approx(6.97, abs=0.01) and got["GPT-4 Turbo"] == pytest.approx(568.09, abs=0.01)
    a = spark.createDataFrame([("m", "x", "1"), ("n", None, "bad")], "model string, t string, v string")
    both = merging.union_coerced(a, a.drop("t"), ["t"], ["v"])
    assert sorted((r["t"], r["v"]) for r in both.where("v is not null").collect()) == [("", 1.0), ("x", 1.0)]
    placed = ranking.rank(a, F.col("model").desc())
    assert placed.where("rank = 1").first()["model"] == "n"


def test_running_sums_of_keys_of_any_size(spark, monkeypatch):
    """One key has a third of the rows; its rows are spread over tasks like all others."""
    import random

    from pyspark.sql import functions as F

    from scoreloom.operators import ranking

    rng = random.Random(5)
    rows = [(rng.choice(("hot", f"k{rng.randrange(40)}", f"k{rng.randrange(40)}")) if i % 50 else None, rng.randrange(500), i, rng.choice((None, rng.randrange(-9, 9)))) for i in range(6000)]
    written = []
    real = ranking.materialise
    monkeypatch.setattr(ranking, "materialise", lambda df, tag: written.append((tag, real(df, tag))) or written[-1][1])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.createDataFrame(rows, "key string, at int, id int, v int")
        got = ranking.running(df, ["key"], [F.col("at"), F.col("id")], {"n": F.lit(1).cast("long"), "s": F.col("v")}, {"most": F.max("v")}).collect()
        sizes = sorted(r["count"] for r in dict(written)["stretches"].groupBy("__part").count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert len(sizes) > 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    wanted = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        total = 0
        for n, r in enumerate(own, 1):
            total += r[3] or 0
            wanted[r[2]] = (key, n, total, max((x[3] for x in own if x[3] is not None), default=None))
    assert {r["id"]: (r["key"], r["n"], r["s"], r["most"]) for r in got} == wanted
    assert ranking.running(df.limit(0), ["key"], [F.col("id")], {"n": F.lit(1)}).count() == 0
    places = ranking.numbered_within(df, ["key"], F.col("at").desc(), F.col("id")).where("key = 'hot'").orderBy("rank").collect()
    assert [r["rank"] for r in places] == list(range(1, len(places) + 1)) and [(-r["at"], r["id"]) for r in places] == sorted((-r["at"], r["id"]) for r in places)


def test_matches_are_replaced_without_python(spark):
    import re

    from pyspark.sql import functions as F

    from scoreloom.functions import fixed_values as V
    from scoreloom.operators import masking

    texts = ["原告张三，女，", "甲乙丙女丁戊己庚男，", "张三女", "张三女\n", "x\x01张三，男。\x02b\x02a\x01", "", None, "某某男、李四和王五", "证人赵六　", "张三\x1c李四", "甲乙丙丁戊己庚辛壬癸，", "  ", "女，男，"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    masked = df.select("id", masking.mask_gendered_names(F.col("t")).alias("g"), masking.mask_standalone_names(F.col("t")).alias("s"))
    assert "Python" not in masked._jdf.queryExecution().toString()
    gendered = lambda m: m[0] if m[1] in V.LEGAL_TERMS else ("某女" if "女" in m[0] else "某男")
    alone = lambda m: m[0] if "某" in m[0] or m[0] in masking.KEPT_TOKENS else "某"
    for r in masked.collect():
        t = texts[r["id"]]
        assert r["g"] == (t and re.sub(V.GENDER_NAME_PATTERN, gendered, t)), t
        assert r["s"] == (t and re.sub(V.STANDALONE_NAME_PATTERN, alone, t)), t


def test_asking_a_stand_in_waits_for_no_quota(spark):
    """More rows in one task than the usual pace has in a minute; who gives a pace is held to it."""
    import time

    rows = spark.range(0, 3100, 1, 1).selectExpr("id", "concat('text ', id) AS t", "'q' AS q")
    began = time.monotonic()
    assert models.analyse(rows, "t", "q", lambda: models.DigestClient(blanks=False)).where("answer is not null").count() == 3100
    assert models.ask(rows.limit(3), "t", per_minute=3000).count() == 3 and time.monotonic() - began < 40
    began = time.monotonic()
    assert models.ask(rows.limit(3), "t", spacing=0.4).count() == 3 and time.monotonic() - began > 0.7


def test_masking_rules_see_only_what_they_can_match(spark):
    import random

    from scoreloom.functions import replace_all

    rng = random.Random(4)
    bits = ["原告", "张三", "某", "某某", "女", "号", "2024", "7", "年", "月", "日", "北京市", "证人", "字", "（", "）", "〔", "〕", "，", "、", "。", "-", "x", "X", "×", "：", ":", ",", "/", " ", "\n", "\r\n", "\x85", "\x01", "\x02", "\x03", "\x04", "\x04a", "\x04b", "a", "13800000000", "等", "hello world and more", "words, words x--x words", "\n\n", "é😀é😀é😀é😀é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(6000)]

    def plain(c):
        for rules in (V.SENSITIVE_RULES, V.DATE_RULES, V.LOCATION_RULES):
            c = replace_all(c, rules)
        return masking.correct(masking.mask_standalone_names(replace_all(masking.mask_gendered_names(c), V.NAME_RULES)))

    t = F.col("t")
    groups = {"sensitive": V.SENSITIVE_RULES, "dates": V.DATE_RULES, "locations": V.LOCATION_RULES, "role_names": V.NAME_RULES}
    wrong = masking.mask(t) != plain(t)
    for name, rules in groups.items():
        wrong = wrong | (getattr(masking, f"mask_{name}")(t) != replace_all(t, rules))
    frame = spark.createDataFrame([(x,) for x in texts], "t string").repartition(4).localCheckpoint()
    assert [r["t"] for r in frame.where(wrong).collect()] == []
    assert frame.where(masking.mask(t) != t).count() > 1000
    (row,) = spark.createDataFrame([("原告张三。" + "long prose of words, " * 5000 + "1999 and 证人李四",)], "t string").select(masking._condensed(t, lambda x: F.concat(x, F.lit("|"), F.length(x))).alias("m")).collect()
    assert int(row["m"].rsplit("|")[1]) < 40 and len(row["m"]) > 100_000


def test_dates_search_a_text_once(spark):
    for found, n in ((documents.han_date(F.col("content")), 1), (documents.arabic_date(F.col("content")), 1)):
        assert str(found).count("content") == n
    texts = {
        "x年二〇二一年十月二十三日，二〇二二年一月一日": "2021-10-23", "二零零九年十二月三十一号": "2009-12-31", "一九年三月四日": None, "三年二〇二〇年五月六日": "2020-05-06",
        "二〇二一年十五月四十日 2020-1-2": "2021-01-01", "自1999-1-1起，2020年3月4日止": "2020-03-04", "2020年3月": None, "": None, "九年一月一日 2001/2/3": "2001-02-03",
    }
    frame = spark.createDataFrame([*((t,) for t in texts), (None,)], "t string")
    assert {r["t"]: r["d"] for r in frame.select("t", documents.case_date(F.col("t")).alias("d")).collect()} == texts | {None: None}


def test_metric_bundle_searches_each_side_once(spark):
    df = spark.createDataFrame([("判决驳回，支持x。依据《法》", "认定，判决"), (None, "判决"), ("", "判决")], "a string, b string")
    found = similarity.similarity_metrics(df, "a", "b")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 12  # runs, phrases of four verbs, citations
    got = found.collect()
    assert [r["has_decision"] for r in got] == [True, False, False] and [r["ai_keywords"] for r in got] == [6, 0, 0] and [r["common_keywords"] for r in got] == [1, 0, 0]
    assert got[1]["overall_similarity"] == got[2]["reasoning_similarity"] == 0.0 and got[0]["result_consistency"] == 0.8
    words = ("a.b", "]", "z-", "认")
    texts = spark.createDataFrame([("xa.b",), ("a,b]",), ("认z -",), ("z-认",), (None,), ("",)], "t string")
    plain = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("t"), w))
    assert all(r["w"] == r["p"] for r in texts.select(similarity._present(F.col("t"), words).alias("w"), plain.alias("p")).collect())
