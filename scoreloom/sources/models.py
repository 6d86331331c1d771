"""Calls of remote models behind a replaceable client; scoring works on the written replies."""

from __future__ import annotations

import hashlib
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.operators.questions import best_passage, is_verbatim, parse_questions, prompt


class Client(Protocol):
    """May state ``per_minute``, the most calls of one task in a minute: None where it makes its replies itself and asks no provider."""

    def complete(self, prompt: str, temperature: float, max_tokens: int) -> dict:
        """A reply with ``content`` and ``finish_reason``; raises on failure."""


class EchoClient:
    """A deterministic stand-in: the first 200 characters of the prompt."""

    per_minute = None

    def complete(self, prompt: str, temperature: float, max_tokens: int) -> dict:
        return {"content": prompt[:200], "finish_reason": "stop"}


class DigestClient:
    """A deterministic stand-in whose reply depends on every character of the prompt: its MD5, and with ``blanks`` no reply at all where
    that begins with 0."""

    per_minute = None

    def __init__(self, blanks: bool = True):
        self.blanks = blanks

    def complete(self, prompt: str, temperature: float, max_tokens: int) -> dict:
        found = hashlib.md5(prompt.encode(), usedforsecurity=False).hexdigest()
        return {"content": "" if self.blanks and found[0] == "0" else f"回答{found}", "finish_reason": "stop"}


class DigestJudge:
    """A deterministic stand-in for a judge: scores and flags by the digits of the prompt's MD5."""

    per_minute = None

    def complete(self, prompt: str, temperature: float, max_tokens: int) -> dict:
        x = [int(c, 16) for c in hashlib.md5(prompt.encode(), usedforsecurity=False).hexdigest()]
        scores = "".join(f"【{d}】\n得分：{x[k] % 5}分\n理由：见上\n" for k, d in enumerate(V.DIMENSIONS))
        flags = "表述略有瑕疵" if x[5] % 3 == 0 else "无", "引用了已废止的旧法条文" if x[6] % 5 == 0 else "无", "回答中编造事实" if x[7] == 0 else "出现受害者责备" if x[7] == 1 else "无"
        marks = "".join(f"\n- {severity}：{text}" for severity, text in zip((V.MINOR, V.MODERATE, V.MAJOR), flags, strict=True))
        return {"content": f"{scores}【错误标记】（如有）：{marks}", "finish_reason": "stop"}


#: Makers of clients by provider; each takes the model's name, or None for the provider's own.
PROVIDERS: dict[str, Callable[[str | None], Client]] = {"echo": lambda model: EchoClient(), "digest": lambda model: DigestClient(), "digest-judge": lambda model: DigestJudge()}


def register(provider: str, maker: Callable[[str | None], Client]) -> None:
    PROVIDERS[provider.lower()] = maker


def client_for(provider: str | None = None, model: str | None = None, default: str = "echo") -> Callable[[], Client]:
    """What makes a provider's client in a task; an unknown provider, or none, is the default one."""
    maker = PROVIDERS.get((provider or default).lower(), PROVIDERS[default])
    return lambda: maker(model)


class RateLimited(Exception):
    """The provider asks to wait."""

    def __init__(self, retry_after: float = 60.0):
        super().__init__(f"retry after {retry_after} s")
        self.retry_after = retry_after


#: Temperatures by kind of call (fixed values).
TEMPERATURES = {"analyse": 0.3, "questions": 0.7, "extract": 0.1, "compare": 0.5, "judge": 0.3}
MAX_TOKENS, MAX_TOKENS_CAP = 3000, 16000


#: Most calls of one task in a minute, where neither the caller nor the client says otherwise.
CALLS_A_MINUTE = 3000


class Pace:
    """Least spacing and most calls a minute of one task, or no such limit; keep tasks times rate within the quota."""

    def __init__(self, per_minute: int | None, spacing: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.per_minute, self.spacing, self.clock, self.sleep = per_minute, spacing, clock, sleep
        #: The last calls: no more than may be made in a minute.
        self.calls: deque[float] = deque(maxlen=per_minute or 1)

    def wait(self) -> None:
        now = self.clock()
        pause = 0.0
        if self.calls:
            pause = max(0.0, self.calls[-1] + self.spacing - now)
        if self.per_minute and len(self.calls) == self.per_minute:
            pause = max(pause, self.calls[0] + 60 - now)
        if pause > 0:
            self.sleep(pause)
        self.calls.append(self.clock())


def pace_of(client: Client) -> Pace:
    """The pace that a client states for its provider, or the usual one."""
    return Pace(getattr(client, "per_minute", CALLS_A_MINUTE), 0.0)


def in_time(client: Client, prompt: str, temperature: float, tokens: int, limit_s: float | None) -> dict:
    """A client's reply, or TimeoutError after ``limit_s`` seconds; the call itself is then left behind."""
    if limit_s is None:
        return client.complete(prompt, temperature, tokens)
    got: list = []

    def complete() -> None:
        try:
            got.append((client.complete(prompt, temperature, tokens), None))
        except BaseException as failed:  # noqa: BLE001  given to the waiting thread
            got.append((None, failed))

    thread = threading.Thread(target=complete, daemon=True)
    thread.start()
    thread.join(limit_s)
    if not got:
        raise TimeoutError(f"no reply in {limit_s:g} s")
    reply, failed = got[0]
    if failed is not None:
        raise failed
    return reply


def exchange(client: Client, prompt: str, temperature: float, pace: Pace, attempts: int = 3, sleep: Callable[[float], None] = time.sleep, limit_s: float | None = None) -> dict:
    """``reply``, ``thinking``, ``error`` and the number of ``attempts``. Failures, late and empty replies are tried again with growing
    pauses; a cut reply once more with twice the tokens."""
    error, tokens = None, MAX_TOKENS
    for attempt in range(attempts):
        pace.wait()
        try:
            reply = in_time(client, prompt, temperature, tokens, limit_s)
            if reply.get("finish_reason") == "length" and tokens < MAX_TOKENS_CAP:
                tokens = min(2 * tokens, MAX_TOKENS_CAP)
                pace.wait()
                reply = in_time(client, prompt, temperature, tokens, limit_s)
        except RateLimited as limited:
            error = str(limited)
            sleep(limited.retry_after)
            continue
        except Exception as failed:  # noqa: BLE001  a provider's client may raise anything
            error = str(failed) or type(failed).__name__
            sleep(2.0 * (attempt + 1))
            continue
        if (reply.get("content") or "").strip():
            return {"reply": reply["content"], "thinking": reply.get("thinking"), "error": None, "attempts": attempt + 1}
        error = "empty reply"
        sleep(2.0)
    return {"reply": None, "thinking": None, "error": error, "attempts": attempts}


def call(client: Client, prompt: str, temperature: float, pace: Pace, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(content, error) of an exchange."""
    found = exchange(client, prompt, temperature, pace, attempts, sleep)
    return found["reply"], found["error"]


#: Rows whose prompts and replies a task holds as Python texts.
ROWS_AT_HAND = 256


def parts(batch: pa.RecordBatch, rows: int = ROWS_AT_HAND) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch in parts of so many rows, each with the number of the batch's rows before it."""
    for at in range(0, batch.num_rows, rows):
        yield at, batch.slice(at, rows)


def with_texts(part: pa.RecordBatch, **texts: list[str | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, pa.string()) for x in texts.values()]], [*part.schema.names, *texts])


def ask(df: DataFrame, prompt: str, client: Callable[[], Client] = EchoClient, kind: str = "analyse", per_minute: int | None = None, spacing: float = 0.0, name: str = "reply") -> DataFrame:
    """Adds the model's ``reply`` and ``<reply>_error`` to each row. ``client`` is called once a task; ``per_minute`` is what it
    states where none is given. Write the result before scoring: a second action would call again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = client()
        pace = Pace(per_minute or pace_of(own).per_minute, spacing)
        for batch in batches:
            for _, part in parts(batch):
                replies = [call(own, p.as_py(), TEMPERATURES[kind], pace) for p in part.column(prompt)]
                yield with_texts(part, **{name: [r for r, _ in replies], f"{name}_error": [e for _, e in replies]})

    schema = df.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.mapInArrow(run, f"{fields}, `{name}` string, `{name}_error` string")


#: Prompts of the four kinds of call; callers may give their own with the same places.
QUESTION_PROMPT = "请为下面的案例提出{n}个有争议的法律问题，每行一个：\n{text}\n{decision}"
ANALYSIS_PROMPT = "问题：{question}\n案例：{text}"
EXTRACT_PROMPT = "从判决中逐字摘出回答这个问题的句子。\n问题：{question}\n判决：{decision}"
COMPARE_PROMPT = "比较两份判决。\n甲：{a}\n乙：{b}"


def _asked(df: DataFrame, text: Column, kind: str, client: Callable[[], Client], **limits) -> DataFrame:
    """Adds ``reply`` and ``reply_error`` to the given prompt, which is dropped again."""
    return ask(df.withColumn("__prompt", text), "__prompt", client, kind, **limits).drop("__prompt")


def ask_questions(df: DataFrame, text: str, decision: str | None = None, n: int = 5, client: Callable[[], Client] = EchoClient, template: str = QUESTION_PROMPT, **limits) -> DataFrame:
    """Adds ``questions``, at most ``n``, read from the reply's lines; null where the model gave none."""
    filled = prompt(template, n=F.lit(n), text=F.col(text), decision=F.col(decision) if decision else F.lit(""))
    asked = _asked(df, filled, "questions", client, **limits)
    return asked.withColumn("questions", parse_questions(F.col("reply"), n)).drop("reply")


def analyse(df: DataFrame, text: str, question: str, client: Callable[[], Client] = EchoClient, template: str = ANALYSIS_PROMPT, **limits) -> DataFrame:
    """Adds the ``answer`` to a question about a case."""
    asked = _asked(df, prompt(template, question=F.col(question), text=F.col(text)), "analyse", client, **limits)
    return asked.withColumnRenamed("reply", "answer")


def extract_answers(df: DataFrame, question: str, decision: str, client: Callable[[], Client] = EchoClient, template: str = EXTRACT_PROMPT, **limits) -> DataFrame:
    """Adds ``judge_answer``: what the reply quotes from the decision, or the decision's passage nearest to it."""
    asked = _asked(df, prompt(template, question=F.col(question), decision=F.col(decision)), "extract", client, **limits)
    said = F.btrim("reply")
    return asked.withColumn("judge_answer", F.when(is_verbatim(said, F.col(decision)), said).otherwise(best_passage(said, F.col(decision)))).drop("reply")


def compare(df: DataFrame, a: str, b: str, client: Callable[[], Client] = EchoClient, template: str = COMPARE_PROMPT, **limits) -> DataFrame:
    """Adds the ``comparison`` of two decisions."""
    asked = _asked(df, prompt(template, a=F.col(a), b=F.col(b)), "compare", client, **limits)
    return asked.withColumnRenamed("reply", "comparison")


def questions_with_answers(df: DataFrame, text: str, decision: str, n: int = 5, client: Callable[[], Client] = EchoClient, write: Callable[[DataFrame], DataFrame] = lambda x: x, **limits) -> DataFrame:
    """A row for each question that the model asks about a case and its decision, with the decision's own answer. ``write`` is
    given the questions before answers are looked for and should write and reread them, or they are asked again."""
    asked = write(ask_questions(df, text, decision, n, client, **limits).drop("reply_error"))
    rows = asked.select(*[c for c in asked.columns if c != "questions"], F.posexplode("questions").alias("p", "question")).withColumn("q_no", F.col("p") + 1).drop("p")
    return extract_answers(rows, "question", decision, client, **limits)
