"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import re

import duckdb
import pandas as pd
import pytest

from scoreloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def show(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "null"
    return repr(round(float(v), 6)) if isinstance(v, float) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF).toPandas()
    wanted = duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    n = {"o07_random_sample": 1000, "a06_bootstrap_ci": 7, "p01_clean_pages": spark.read.parquet(f"{SF}/pages.parquet").count()}
    assert len(plans.queries()[name](spark, SF).collect()) == n.get(name, spark.read.parquet(f"{SF}/documents.parquet").count())


def test_masking_queries_equal_plain_python(spark):
    from test_operators import brute_mask

    from scoreloom.functions import fixed_values as V
    from scoreloom.operators import masking
    from scoreloom.plans import scoring

    gendered = lambda m: m[0] if m[1] in V.LEGAL_TERMS else ("某女" if "女" in m[0] else "某男")
    standalone = lambda m: m[0] if "某" in m[0] or m[0] in masking.KEPT_TOKENS else "某"
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "n_chars as n").selectExpr("doc_id", f"concat(text, '\\n', {scoring.CASE_TEXT}) as t").collect()
    found = {name: {r["doc_id"]: r for r in plans.queries()[name](spark, SF).collect()} for name in ("m05_gendered_names", "m06_standalone_names", "m08_mask_case")}
    for r in docs:
        assert found["m05_gendered_names"][r["doc_id"]]["masked"] == re.sub(V.GENDER_NAME_PATTERN, gendered, r["t"])
        assert found["m06_standalone_names"][r["doc_id"]]["masked"] == re.sub(V.STANDALONE_NAME_PATTERN, standalone, r["t"])
        whole = found["m08_mask_case"][r["doc_id"]]
        assert whole["case_text_masked"] == brute_mask(r["t"]) and whole["judge_decision_masked"] == brute_mask("判决：" + r["t"])


def test_random_sample_is_the_same_again(spark):
    query = plans.queries()["o07_random_sample"]
    rows = query(spark, SF).collect()
    assert len(set(rows)) == 1000 and sorted(rows) == sorted(query(spark, SF).collect())


def test_streaming_counters(spark, tmp_path):
    from scoreloom import streaming

    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts as timestamp) as ts", "event_type", "event_id")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = streaming.task_progress(stream.selectExpr("event_type", "event_id % 2 = 0 as done"), "event_type", "done").writeStream.outputMode("complete").format("memory").queryName("progress").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(seen) from progress").first()[0] == events.count()


def test_session_steps_on_a_stream(spark, tmp_path):
    from scoreloom import streaming

    steps = ("upload", "mask", "ask", "score")
    rows = [("a", s) for s in steps] + [("b", "upload"), ("b", "ask"), ("b", "upload"), ("c", "other"), ("d", "upload"), ("d", "mask")]
    spark.createDataFrame(rows, "session string, step string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, step string").parquet(str(tmp_path / "in"))
    query = streaming.session_steps(stream, "session", "step", steps).writeStream.outputMode("complete").format("memory").queryName("steps").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("steps").collect()} == {("a", 4, True), ("b", 1, False), ("c", 0, False), ("d", 2, False)}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _shuffled(spark):
    """Bytes that all stages so far wrote to shuffles."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_session_export_shuffles_a_text_once(spark, tmp_path):
    import random

    rng = random.Random(3)
    texts = [None, "", " ", "same", "same"] + [rng.randbytes(20_000).hex() for _ in range(35)]
    docs = [(i, t, i * 31) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 3 % 2) for k in range(0, 40, 2)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = _shuffled(spark)
    got = plans.queries()["k06_session_export"](spark, str(tmp_path)).toPandas()
    assert _shuffled(spark) - before < 2 * sum(len(t or "") for t in texts)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert rows(got) == rows(con.sql(plans.oracle_sql()["k06_session_export"]).df())
