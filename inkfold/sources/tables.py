"""Sources and sinks: tables, documents with a quarantine, results, and a rewriter behind an HTTP endpoint."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import DEFAULT, Config
from ..functions.text import SPACE


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is small for the number of cores, dealt over them; larger tables stay as they are, without a shuffle.

    A file of one row group is one task however it is split, which only matters where there are few files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SMALL_BYTES else df


def load_documents(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Documents of any format that Spark reads; pass ``schema`` for text formats, so that nothing is read twice."""
    reader = spark.read.format(fmt)
    if schema := options.pop("schema", None):
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def problem(text, cfg: Config = DEFAULT):
    """Why a document isn't accepted, or null."""
    return F.when(text.isNull() | ~text.rlike(f"[^{SPACE}]"), "blank").when(F.length(text) > cfg.max_chars, "too_long")


def validate(docs: DataFrame, text_col: str = "text", cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with a ``problem``)."""
    judged = docs.withColumn("problem", problem(F.col(text_col), cfg))
    return judged.where("problem is null").drop("problem"), judged.where("problem is not null")


def write_results(df: DataFrame, path: str, drop: tuple[str, ...] = ("input_text", "output_text"), mode: str = "errorifexists") -> None:
    """Results as JSON lines without the full texts; pass ``drop=()`` to keep them."""
    df.drop(*drop).write.mode(mode).json(path)


RETRIED = frozenset({429, 500, 502, 503, 504})


def _object(data: str) -> dict:
    """A JSON object, or an empty one."""
    try:
        found = json.loads(data)
    except ValueError:
        found = None
    return found if isinstance(found, dict) else {}


@dataclass
class HttpRewriter:
    """One request a call to a chat endpoint; connection errors and overload are tried once more."""

    url: str
    model: str
    key: str | None = None
    auth: str = "bearer"  # bearer, x-api-key, raw or none
    kind: str = "chat"  # chat, messages or completion
    timeout: float = 120.0
    max_tokens: int = 2048
    stream: bool = False  # ask for server-sent events
    headers: dict = field(default_factory=dict)

    def payload(self, prompt: str, temperature: float) -> dict:
        body = {"model": self.model, "temperature": temperature, "max_tokens": self.max_tokens} | ({"stream": True} if self.stream else {})
        return body | ({"prompt": prompt} if self.kind == "completion" else {"messages": [dict(content=prompt, role="user")]})

    def auth_headers(self) -> dict:
        own = {"bearer": {"Authorization": f"Bearer {self.key}"}, "x-api-key": {"x-api-key": self.key}, "raw": {"Authorization": self.key}}
        return own.get(self.auth, {}) if self.key else {}

    @staticmethod
    def answer_text(answer: dict) -> str:
        """The text of an answer: a message as a string or parts, content blocks, or a completion."""
        if answer.get("choices"):
            choice = answer["choices"][0]
            content = choice.get("message", {}).get("content", choice.get("text", ""))
        else:
            content = answer.get("content", "")
        if isinstance(content, list):
            content = "".join(p.get("text", "") for p in content if isinstance(p, dict))
        return content or ""

    @staticmethod
    def stream_text(lines) -> str:
        """The text of a stream of server-sent events, or of plain JSON sent instead."""
        out, plain = [], []
        for line in lines:
            line = line.strip()
            if not line.startswith("data:"):
                plain.append(line)
                continue
            data = line[5:].strip()
            if "[DONE]" == data:
                break
            event = _object(data)
            delta = (event.get("choices") or [{}])[0].get("delta", {}).get("content") or event.get("delta", {}).get("text")
            out.append(delta or "")
        if not out and any(plain):
            return HttpRewriter.answer_text(json.loads("".join(plain)))
        return "".join(out)

    def rewrite(self, prompt: str, temperature: float) -> str:
        request = urllib.request.Request(self.url, json.dumps(self.payload(prompt, temperature)).encode(), {"Content-Type": "application/json", **self.auth_headers(), **self.headers})
        for attempt in (0, 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return self.stream_text(line.decode() for line in r) if self.stream else self.answer_text(json.load(r))
            except urllib.error.HTTPError as e:
                if attempt or e.code not in RETRIED:
                    raise
            except (urllib.error.URLError, TimeoutError):
                if attempt:
                    raise
            time.sleep(1)
        raise AssertionError("not reached")
