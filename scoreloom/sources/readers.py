"""Readers. Each takes paths that Spark can open and returns a DataFrame."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scoreloom.functions import strip
from scoreloom.operators.ranking import numbered
from scoreloom.sources.compound import doc_text, is_compound
from scoreloom.sources.jsonmap import read_json_map

CASE = "struct<id:string,title:string,case_text:string,judge_decision:string,case_date:string,created_at:string,metadata:map<string,string>>"
PREPARED = "struct<case_title:string,masked_title:string,masked_content:string,masked_judge:string,questions:array<string>>"


def case_store(spark: SparkSession, path: str) -> DataFrame:
    """Cases of JSON maps of any size, by id."""
    return read_json_map(spark, path, CASE).drop("id")


def prepared_cases(spark: SparkSession, path: str) -> DataFrame:
    """Prepared cases with a row for each question."""
    rows = read_json_map(spark, path, PREPARED)
    return rows.select("case_id", "case_title", "masked_title", "masked_content", "masked_judge", F.posexplode_outer("questions").alias("p", "question")).withColumn("q_no", F.col("p") + 1).drop("p")


def import_sheet(df: DataFrame, required: tuple[str, str] = ("title", "case_text"), optional: tuple[str, ...] = ("case_date", "judge_decision")) -> DataFrame:
    """Rows with both required texts, all stripped; optional ones are blank where missing. A required column
    that isn't there is an error."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    columns = {c: strip(F.col(c).cast("string")) for c in required}
    columns |= {c: F.coalesce(strip(F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit("") for c in optional}
    rows = df.na.drop(subset=list(required)).select(*[x for x in df.columns if x not in columns], *[c.alias(n) for n, c in columns.items()])
    return rows.where(" and ".join(f"{c} <> ''" for c in required))


def validate_import(df: DataFrame, order: str) -> DataFrame:
    """Adds the sheet row (from 2), by ``order``, and the list of errors."""
    date = F.col("case_date")
    exact = date.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & F.try_to_timestamp(date, F.lit("yyyy-M-d")).isNotNull()
    errors = F.array_compact(F.array(
        F.when(F.coalesce(strip(F.col("title")), F.lit("")) == "", "title is blank"),
        F.when(F.coalesce(strip(F.col("case_text")), F.lit("")) == "", "text is blank"),
        F.when((F.coalesce(date, F.lit("")) != "") & ~F.coalesce(exact, F.lit(False)), "date is not yyyy-mm-dd"),
    ))
    return numbered(df.withColumn("errors", errors), F.col(order), name="sheet_row").withColumn("sheet_row", F.col("sheet_row") + 1)


def model_sheets(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Evaluation rows partitioned by sheet (``sheet=...`` folders); known sheets only, with their model names."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = spark.read.parquet(path)
    return rows.where(F.col("sheet").isin(*names)).withColumn("model", F.try_element_at(table, F.col("sheet"))).drop("sheet")


def latest_file(spark: SparkSession, pattern: str) -> DataFrame:
    """Path of the file changed last; none for no match."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).where("path is not null")


def latest_dir(paths: DataFrame, path: str = "path", must_contain: str = "") -> DataFrame:
    """The greatest of the folder names."""
    return paths.where(F.col(path).contains(must_contain)).agg(F.max(path).alias(path))


def route_model(name: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Model of a file name: the first rule whose text it contains; null for none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for part, model in rules:
        out = out.when(F.contains(F.lower(name), F.lit(part.lower())), model)
    return out


def melt_questions(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each non-blank question column."""
    long = df.unpivot(keys, columns, "column", "question")
    number = F.regexp_extract("column", r"(\d+)$", 1).cast("int")
    return long.withColumn("q_no", number).where((F.coalesce(strip(F.col("question")), F.lit("")) != "") & (F.lower("question") != "nan")).select(*keys, "q_no", "question")


TOKEN_LINE = r"\[Token使用\] 输入: (\d+), 输出: (\d+), 总计: (\d+)"
TOKEN_LINE_REASONING = r"\[Token使用\] 输入: (\d+), 输出: (\d+),(?: 推理: \d+,)? 总计: (\d+)"


def token_log(lines: DataFrame, value: str = "value", extended: bool = False) -> DataFrame:
    """Calls of a run log; ``extended`` also takes lines with a reasoning count."""
    pattern = TOKEN_LINE_REASONING if extended else TOKEN_LINE
    names = ("tokens_in", "tokens_out", "tokens_total")
    found = lines.where(F.col(value).rlike(pattern))
    return found.select(*[c for c in lines.columns if c != value], *[F.regexp_extract(value, pattern, k + 1).cast("long").alias(n) for k, n in enumerate(names)])


def token_report(reports: DataFrame, heading: str, value: str = "value", nothing: str = "数据不可用") -> DataFrame:
    """The token table of a text report: lines after the heading up to a blank one, columns parted by two or more
    blanks; rules and the header are skipped, and cells that say so are null."""
    section = F.regexp_extract(value, "(?s)" + re.escape(heading) + r"[^\n]*\n(.*?)(?=\n\s*\n|\z)", 1)
    lines = reports.select(F.explode(F.split(section, "\n")).alias("line")).where(~F.col("line").rlike(r"^\s*[-=]*\s*$"))
    cells = F.split(F.btrim("line"), r"\s{2,}")
    numbers = [F.when(F.get(cells, F.lit(k)) != nothing, F.replace(F.get(cells, F.lit(k)), F.lit(","), F.lit(""))).try_cast("double").alias(n) for k, n in ((1, "avg_in"), (2, "avg_out"), (3, "avg_total"), (4, "calls"))]
    rows = lines.select(F.get(cells, F.lit(0)).alias("model"), F.size(cells).alias("width"), F.get(cells, F.lit(1)).alias("first"), *numbers)
    return rows.where("width >= 4").where(F.col("avg_in").isNotNull() | (F.col("first") == nothing)).drop("width", "first")


def split_sheets(spark: SparkSession, path: str, schema: StructType, sheet: str) -> DataFrame:
    """The rows of a split workbook, with the name of their sheet."""
    whole = StructType([*schema.fields, StructField(sheet, StringType())])
    return spark.read.schema(whole).option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str | None:
    """Non-blank paragraphs, then table cells, a line each; None for a broken file."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    own = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    lines = [own(p) for p in body.findall(f"{_W}p")]
    lines += ["\n".join(own(p) for p in cell.findall(f"{_W}p")) for cell in body.iter(f"{_W}tc")]
    return "\n".join(x.strip() for x in lines if x.strip())


ENCODINGS = ("utf-8", "gbk", "gb2312", "big5", "mac_roman")
_COMMON_HAN = re.compile("[的是在有和人法院]")


def decode_cascade(content: bytes, least: int = 100) -> str | None:
    """Text by the first encoding that gives more than ``least`` characters with a common Han one."""
    for encoding in ENCODINGS:
        try:
            text = content.decode(encoding)
        except UnicodeDecodeError:
            continue
        if len(text) > least and _COMMON_HAN.search(text):
            return text
    return None


_TAG = re.compile(r"<[^>]+>")


def decode_document(content: bytes, least: int = 100) -> str | None:
    """Text of a file that is not a .docx: by the cascade; a page of HTML without its tags, whatever its broken bytes."""
    text = decode_cascade(content, least)
    candidates = [text] if text else [content.decode(e, "ignore") for e in ENCODINGS]
    for page in candidates:
        if ("<html" in page.lower() or "<body" in page.lower()) and _COMMON_HAN.search(page):
            bare = "\n".join(x.strip() for x in html.unescape(_TAG.sub("", page)).split("\n") if x.strip())
            if len(bare) > least:
                return bare
    return text


def document_folder(spark: SparkSession, pattern: str, limit: int | None = None) -> DataFrame:
    """``(path, content)`` of .docx, binary .doc and other text files; content is null where a file can't be read."""
    files = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").load(pattern).select("path", F.col("content").alias("raw"))
    if limit is not None:
        files = files.orderBy("path").limit(limit)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            content = [docx_text(raw) if path.lower().endswith(".docx") else doc_text(raw) if is_compound(raw) else decode_document(raw) for path, raw in zip(f["path"], f["raw"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "content": content})

    return files.mapInPandas(decode, "path string, content string")
