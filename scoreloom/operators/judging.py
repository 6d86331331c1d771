"""What the judging model is asked: the question, the answer, the decision it is held against, and how to reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.functions import null_if_blank
from scoreloom.operators.questions import context

#: What each dimension asks for. Callers may give their own.
CRITERIA = dict(
    zip(
        V.DIMENSIONS,
        (
            "引用的规范是否与争点相关、准确，并说明其作用。",
            "是否从争点到规范、要件、事实再到结论，逐步推理而无断裂。",
            "是否识别应当衡量的价值，理由克制，不责备受害者。",
            "是否抓住决定性的事实，不遗漏、不编造，并区分是否查明。",
            "结论和救济是否与参照一致，或在作用上相当。",
        ),
        strict=True,
    )
)

#: The form that the scoring operators read.
REPLY_FORM = (
    "\n".join(f"【{d}】得分：X分\n理由：...\n" for d in V.DIMENSIONS)
    + f"\n【错误标记】（如有）：\n- {V.MINOR}：...\n- {V.MODERATE}：...\n- {V.MAJOR}：..."
)
_RULES = "每个维度给出0到4的整数原始分，不因错误标记减分。错误按严重程度分列，没有则写“无”。请严格按下列格式回答：\n{form}"
WITH_DECISION = "请对照法官判决，按评分标准评价回答。\n\n问题：\n{question}\n\n回答：\n{answer}\n\n法官判决：\n{decision}\n\n{case}评分标准：\n{criteria}\n\n" + _RULES
WITHOUT_DECISION = "本案没有参照判决，请按评分标准和案例评价回答。\n\n问题：\n{question}\n\n回答：\n{answer}\n\n案例内容：\n{case}\n\n评分标准：\n{criteria}\n\n" + _RULES


def criteria_text(criteria: dict[str, str]) -> str:
    return "\n".join(f"{name}（满分4分）：{text}" for name, text in criteria.items())


def judge_prompt(question: Column, answer: Column, decision: Column, case: Column, criteria: dict[str, str] = CRITERIA) -> Column:
    """The judging prompt. A blank decision is none: then the case stands for it with its first 3,000 characters, else it follows with
    its first 2,000, or not at all when empty. Questions, answers and decisions go in whole; nulls are blank."""
    has = null_if_blank(decision).isNotNull()
    said = F.nullif(context(case, has), F.lit(""))
    block = F.when(has, F.coalesce(F.concat(F.lit("案例内容：\n"), said, F.lit("\n\n")), F.lit(""))).otherwise(F.coalesce(said, F.lit("无")))
    fixed = {"criteria": F.lit(criteria_text(criteria)), "form": F.lit(REPLY_FORM)}
    parts = {"case": block, "decision": decision, "answer": answer, "question": question}
    return F.when(has, _filled(WITH_DECISION, fixed, parts)).otherwise(_filled(WITHOUT_DECISION, fixed, parts))


def _filled(template: str, fixed: dict[str, Column], parts: dict[str, Column]) -> Column:
    """Each place of the template once, by concatenation: what is put in may itself hold names in braces."""
    pieces: list[Column] = []
    rest = template
    columns = fixed | parts
    while rest:
        found = [(rest.index("{" + k + "}"), k) for k in columns if "{" + k + "}" in rest]
        if not found:
            pieces.append(F.lit(rest))
            break
        at, name = min(found)
        pieces += [F.lit(rest[:at]), F.coalesce(columns[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def with_judge_prompt(df: DataFrame, question: str, answer: str, decision: str, case: str, name: str = "judge_prompt", criteria: dict[str, str] = CRITERIA) -> DataFrame:
    return df.withColumn(name, judge_prompt(F.col(question), F.col(answer), F.col(decision), F.col(case), criteria))
