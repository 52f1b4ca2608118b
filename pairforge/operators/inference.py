"""Ask a model, with resume: answered questions are skipped, failed ones are asked again."""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairforge.functions.scoring import REPORTED, finite
from pairforge.functions.text import strip
from pairforge.operators.qa import TASKS

# Our own wording, one message per task.
_ROLE = "You edit molecules written as SMILES or SAFE. Return only the JSON object that the question asks for. "
SYSTEM = {
    "task1": _ROLE + "Its answer is the toxic fragment, or the toxic fragments joined by dots.",
    "task2": _ROLE + "Its answer is the fragment that replaces the toxic one, or the fragments joined by dots.",
    "task3": _ROLE + "Its answer is the whole molecule as SMILES.",
    "task3_nontoxic_safe_generation": _ROLE + "Its answer is the whole molecule as SAFE.",
    "task3_stepwise_cot_safe_generation": _ROLE + "It has a key for each step, and the answer is the whole molecule as SAFE.",
}


class Provider(Protocol):
    """A model: one reply per question, in order."""

    def generate(self, system: str, questions: list[str]) -> list[str]: ...


class EchoProvider:
    """Answers each question with itself, as JSON."""

    def generate(self, system: str, questions: list[str]) -> list[str]:
        import json

        return [json.dumps({"answer": q}) for q in questions]


class ReplayProvider:
    """Returns stored replies; an error text where there is none."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def generate(self, system: str, questions: list[str]) -> list[str]:
        return [self.replies.get(q, "ERROR: no reply stored") for q in questions]


class RemoteProvider:
    """Calls ``ask(system, question)`` from several threads.  A call that fails is made again after pauses that double; what fails
    ``retries`` times becomes an ``ERROR: `` text, which a later run asks again."""

    def __init__(self, ask, workers: int = 8, retries: int = 3, pause: float = 1.0):
        self.ask, self.workers, self.retries, self.pause = ask, workers, retries, pause

    def generate(self, system: str, questions: list[str]) -> list[str]:
        replies: dict[int, str] = {}
        open_ = list(range(len(questions)))

        def attempt(i: int) -> str | Exception:
            try:
                return self.ask(system, questions[i])
            except Exception as x:  # noqa: BLE001
                return x

        with ThreadPoolExecutor(self.workers) as pool:
            for k in range(self.retries):
                if k and open_:
                    time.sleep(self.pause * 2 ** (k - 1))
                said = dict(zip(open_, pool.map(attempt, open_)))
                replies |= {i: f"ERROR: {x}" if isinstance(x, Exception) else x for i, x in said.items()}
                open_ = [i for i, x in said.items() if isinstance(x, Exception)]
        return [replies[i] for i in range(len(questions))]


class ChatProvider(RemoteProvider):
    """A chat service in JSON mode through the client library ``openai``, if it is installed; its key comes from the environment of the
    executors.  The client is made where it is used."""

    def __init__(self, name: str, temperature: float = 0.7, workers: int = 8, retries: int = 3):
        super().__init__(self._chat, workers, retries)
        self.name, self.temperature, self._client = name, temperature, None

    def __getstate__(self):
        return self.__dict__ | {"_client": None}

    def _chat(self, system: str, question: str) -> str:
        if self._client is None:
            from openai import OpenAI

            self._client = OpenAI()
        talk = [{"role": role, "content": text} for role, text in (("system", system), ("user", question))]
        made = self._client.chat.completions.create(model=self.name, messages=talk, temperature=self.temperature, response_format={"type": "json_object"})
        return made.choices[0].message.content or ""


class LocalProvider:
    """A model from a folder, run by the libraries ``vllm`` and ``transformers`` if they are installed; loaded once per Python worker.
    Replies are sampled freely: a schema forced on them would be met by empty fields, too."""

    def __init__(self, folder: str, temperature: float = 0.7, tensor_parallel_size: int = 1, max_model_len: int = 4096, max_tokens: int = 1024):
        self.folder, self.temperature, self.tensor_parallel_size, self.max_model_len, self.max_tokens, self._loaded = folder, temperature, tensor_parallel_size, max_model_len, max_tokens, None

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}

    def load(self):
        from transformers import AutoTokenizer
        from vllm import LLM, SamplingParams

        engine = LLM(model=self.folder, trust_remote_code=True, tensor_parallel_size=self.tensor_parallel_size, max_model_len=self.max_model_len)
        return AutoTokenizer.from_pretrained(self.folder, trust_remote_code=True), engine, SamplingParams(temperature=self.temperature, max_tokens=self.max_tokens)

    def generate(self, system: str, questions: list[str]) -> list[str]:
        self._loaded = self._loaded or self.load()
        tokenizer, engine, sampling = self._loaded
        chat = lambda q: tokenizer.apply_chat_template([{"role": "system", "content": system}, {"role": "user", "content": q}], tokenize=False, add_generation_prompt=True)
        return [x.outputs[0].text for x in engine.generate(list(map(chat, questions)), sampling)]


def load_provider(name: str, temperature: float = 0.7, workers: int = 8, tensor_parallel_size: int = 1) -> Provider:
    """``echo`` (a dry run), a model in a folder, or the name of a remote one."""
    if name == "echo":
        return EchoProvider()
    folder = Path(name).expanduser()
    return LocalProvider(str(folder), temperature, tensor_parallel_size) if folder.is_dir() else ChatProvider(name, temperature, workers)


def task_of_file(stem: Column) -> Column:
    """Task of a file name: the longest part known, between underscores or at the start, wins; null if there is none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for part in sorted(TASKS, key=len, reverse=True):
        out = out.when(F.contains(stem, F.lit(f"_{part}_")) | F.startswith(stem, F.lit(f"{part}_")), F.lit(TASKS[part]))
    return out


def step_of_file(stem: Column) -> Column:
    return F.when(F.endswith(stem, F.lit("_multi")), "multi_step").otherwise("single_step")


def first_questions(qa: DataFrame, limit: int | None, keys: list[str] | None = None) -> DataFrame:
    """The first records by id, of each file if its ``keys`` are given (a limit is the feature: a trial run)."""
    if not limit:
        return qa
    if not keys:
        return qa.orderBy("id").limit(limit)
    # Spark keeps at most ``limit`` rows of a file per task before it shuffles them.
    return qa.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where(F.col("__r") <= limit).drop("__r")


def unanswered(qa: DataFrame, predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Questions without a reply; replies that begin with ``ERROR`` do not count."""
    keys = keys or ["id"]
    done = predictions.where(~F.coalesce(F.startswith("raw", F.lit("ERROR:")), F.lit(False))).select(*keys).distinct()
    return qa.join(done, keys, "left_anti")


def ask(qa: DataFrame, provider: Provider, system: str | dict[str, str] = "", batch: int = 256) -> DataFrame:
    """``qa`` with ``raw``, the replies; ``system`` is one message or one per ``task``.  Materialise the result before scoring: a
    stage that is tried again asks again."""
    from pyspark.sql import types as T

    schema = T.StructType([*qa.schema.fields, T.StructField("raw", T.StringType())])
    task = F.col("task") if isinstance(system, dict) else F.lit("")
    packed = qa.select(F.to_json(F.struct(*[F.col(c) for c in qa.columns])).alias("row"), F.col("question").alias("q"), task.alias("task"))
    message = system if isinstance(system, dict) else {"": system}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for kind, rows in pdf.groupby("task", sort=False):
                for at in range(0, len(rows), batch):
                    piece = rows.iloc[at : at + batch]
                    yield pd.DataFrame({"row": piece["row"], "raw": provider.generate(message[kind], [q or "" for q in piece["q"]])})

    replies = packed.mapInPandas(run, "row string, raw string")
    return replies.select(F.from_json("row", T.StructType(qa.schema.fields)).alias("r"), "raw").select("r.*", "raw").to(schema)


def salvage(raw: Column) -> Column:
    """The JSON text in a reply: all of it, else from the first ``{`` to the last ``}``; null if neither parses."""
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(raw).isNotNull(), raw).when((inner != "") & F.try_parse_json(inner).isNotNull(), inner)


def answer_text(raw: Column, compat: bool = False) -> Column:
    """The answer in a reply: the key ``answer`` of an object, another value as its text, or the reply itself.

    Empty and null replies give the empty text.  A null answer gives ``None`` with ``compat``, else the empty text.
    """
    found = F.try_parse_json(salvage(raw))
    as_text = found.cast("string")
    is_object = F.startswith(F.ltrim(salvage(raw)), F.lit("{"))
    has_key = F.array_contains(F.json_object_keys(salvage(raw)), F.lit("answer"))
    answer = F.try_variant_get(found, "$.answer", "string")
    nothing = F.lit("None" if compat else "")
    value = F.when(is_object, F.when(has_key, F.coalesce(answer, nothing)).otherwise(F.lit(""))).when(as_text.isin("0", "[]", "false", "null"), F.lit("")).otherwise(as_text)
    return strip(F.coalesce(F.when(found.isNotNull(), value), raw, F.lit("")))


def input_molecule(toxic: Column, question: Column) -> Column:
    """The molecule a question is about: the given one if not empty, else what the question shows after ``SMILES = ``."""
    return F.coalesce(F.nullif(strip(toxic), F.lit("")), F.nullif(F.regexp_extract(question, r"SMILES = '([^']+)'", 1), F.lit("")), F.lit(""))


def latest(predictions: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One prediction per key: the latest without error, else the latest."""
    good = ~F.coalesce(F.startswith("raw", F.lit("ERROR")), F.lit(False))
    return predictions.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(good.desc(), F.col(at).desc()))).where("__r = 1").drop("__r")


def summarise(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per model, split, task and step: rows, and the map of reported means over finite values, with ``_Acc`` (per cent)
    beside exact-match metrics; a mean of nothing is null."""
    keys = keys or ["model", "split", "task", "step"]
    metrics = sorted({m for v in REPORTED.values() for m in v})
    sums = predictions.groupBy(*keys).agg(F.count("*").alias("total"), *[F.avg(finite(F.col(m))).alias(m) for m in metrics])
    accuracy = lambda m: m.endswith("_EM") or m in ("EM", "exact_match")
    family = F.when(F.startswith("task", F.lit("task3")), "task3").otherwise(F.col("task"))
    out = F.when(F.lit(False), F.lit(None).cast("map<string,double>"))
    for (task, step), names in REPORTED.items():
        pairs = [x for m in names for x in ([F.lit(m), F.col(m)] + ([F.lit(f"{m}_Acc"), F.col(m) * 100] if accuracy(m) else []))]
        out = out.when((family == task) & (F.col("step") == step), F.create_map(*pairs))
    return sums.select(*keys, "total", out.alias("metrics_mean"))
