"""Candidates to skills through a language model, or offline by a fixed template."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motif.functions import exprs, llmjson, pyast
from motif.operators.compositions import combined_source
from motif.schema import Settings
from motif.storage import kept, table_if_there

ANSWERS = "digest string, model string, raw string"
#: A model: prompts of a batch to answers; None for a prompt that failed, which is not asked again.
Model = Callable[[list[str]], list[str | None]]


def offline(prompts: list[str]) -> list[str | None]:
    """Answers made from the prompts alone, the same every time."""
    out = []
    for p in prompts:
        head, _, code = p.partition("\nCode:\n")
        facts = dict(re.findall(r"^(Kind|Language): (.*)$", head, re.M))
        name = (re.search(r"(?:def|class|function|const|let|var)\s+([A-Za-z_$][\w$]*)", code) or ["", "pattern"])[1]
        answer = {
            "skill_name": re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower(), "category": "composed" if facts.get("Kind") == "composed" else "io", "description": f"Reusable form of {name}.",
            "tags": [facts.get("Language", ""), facts.get("Kind", "")], "code": code, "usage_example": f"{name}()", "complexity": "simple", "composes_with": [], "parameters": [],
        }
        out.append(json.dumps(answer))
    return out


def http_model(backend: str, key: str = "", name: str = "", base: str = "", timeout: float = 180.0) -> Model:
    """A model behind HTTP: `ollama`, `claude` or `gemini`. A request that fails gives None."""
    from urllib import request
    from urllib.parse import quote

    shapes = {
        "ollama": (f"{base or 'http://localhost:11434'}/api/generate", {}, lambda p: {"model": name, "prompt": p, "stream": False}, lambda r: r["response"]),
        "claude": (
            "https://api.anthropic.com/v1/messages", {"x-api-key": key, "anthropic-version": "2023-06-01"},
            lambda p: {"model": name, "max_tokens": 4096, "messages": [{"role": "user", "content": p}]}, lambda r: r["content"][0]["text"],
        ),
        "gemini": (
            f"https://generativelanguage.googleapis.com/v1beta/models/{quote(name)}:generateContent", {"x-goog-api-key": key},
            lambda p: {"contents": [{"parts": [{"text": p}]}]}, lambda r: r["candidates"][0]["content"]["parts"][0]["text"],
        ),
    }
    if backend not in shapes:
        raise ValueError(f"unknown backend {backend!r}")
    url, headers, body, answer = shapes[backend]

    def ask(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            try:
                call = request.Request(url, json.dumps(body(p)).encode(), {"Content-Type": "application/json", **headers})
                with request.urlopen(call, timeout=timeout) as got:
                    out.append(answer(json.load(got)))
            except (OSError, ValueError, KeyError, IndexError, TypeError):
                out.append(None)
        return out

    return ask


def active_model(settings: Settings) -> str:
    """The backend in use and its model, for logs."""
    return f"{settings.backend}:{settings.model}" if settings.model else settings.backend


def attempted(work: Callable, attempts: int = 3, least: float = 2.0, most: float = 15.0, sleep: Callable[[float], None] = time.sleep):
    """What work returns; after an error it is tried again, with pauses that double from least up to most seconds."""
    for k in range(attempts):
        try:
            return work()
        except Exception:
            if k + 1 == attempts:
                raise
            sleep(min(most, least * 2**k))


def patient(model: Model, attempts: int = 3, least: float = 2.0, most: float = 15.0, gap: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Model:
    """model, asked with one prompt at a time, `gap` seconds apart; only what failed is asked again, with pauses as in attempted()."""

    def ask(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(prompts)
        left = list(range(len(prompts)))
        for k in range(attempts):
            for n, i in enumerate(left):
                if gap and (n or k):
                    sleep(gap)
                out[i] = model([prompts[i]])[0]
            left = [i for i in left if out[i] is None]
            if not left or k + 1 == attempts:
                break
            sleep(min(most, least * 2**k))
        return out

    return ask


def answered(asked: DataFrame, model: Model, log: str, name: str = "", at_once: int = 64) -> DataFrame:
    """asked (prompt, ...) with raw: the answer of the model of that name, from the log where it is there.

    The log at a path keeps answers by digest of the prompt. What it lacks is asked once for each prompt, about at_once
    prompts in a job; each job's answers stay in the log, so after a failure only later ones are asked again. Prompts without
    an answer have no row and are not logged.
    """
    spark = asked.sparkSession
    asked = asked.withColumn("_digest", F.sha2("prompt", 256))

    def logged() -> DataFrame | None:
        found = table_if_there(spark, log, ANSWERS)
        return None if found is None else found.where(F.col("model") == name).groupBy("digest").agg(F.min("raw").alias("raw")).withColumnRenamed("digest", "_digest")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"digest": b["_digest"], "model": name, "raw": model(b["prompt"].tolist())})

    before = logged()
    pending = asked.select("_digest", "prompt").dropDuplicates(["_digest"])
    if before is not None:
        pending = pending.join(before.select("_digest"), "_digest", "left_anti")
    pending = kept(pending, "asked")
    slices = -(-pending.count() // at_once)
    for part in range(slices):
        few = pending.where(F.pmod(F.xxhash64("_digest"), F.lit(slices)) == part)
        few.mapInPandas(ask, ANSWERS).where("raw is not null").write.mode("append").parquet(log)
    now = logged()
    if now is None:
        return asked.drop("_digest").withColumn("raw", F.lit(None).cast("string")).where("false")
    return asked.join(now, "_digest").drop("_digest")


def from_compositions(found: DataFrame) -> DataFrame:
    """Compositions in the form of candidates, of complexity 5."""
    names = F.col("component_names")
    return found.select(
        exprs.composite_hash(names).alias("structural_hash"), combined_source().alias("source_code"), F.array_join(F.slice(names, 1, 4), " → ").alias("abstract_signature"), "language",
        "frequency", F.coalesce(F.get("contexts", F.lit(0)), F.lit("")).alias("first_seen_file"), "contexts", F.lit(5.0).alias("complexity_score"), F.lit("composed").alias("node_type"),
        F.array().cast("array<string>").alias("decorators"), names.alias("calls"),
    )


def crystallize(candidates: DataFrame, model: Model = offline, now: float = 0.0, log: str | None = None, name: str = "") -> DataFrame:
    """Skills of those candidates that the model answers with a name and code. code_valid tells; invalid code stays too.

    With a log, the model of that name is asked only for what the log doesn't have; see answered().
    """
    asked = candidates.select(
        "structural_hash", "frequency", "contexts", "language", "node_type",
        exprs.prompt(F.col("node_type"), F.col("language"), F.col("frequency"), F.col("contexts"), F.col("source_code")).alias("prompt"),
    )
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(raw=model(b["prompt"].tolist()))

    raw = answered(asked, model, log, name) if log else asked.mapInPandas(of, f"{names}, raw string").where("raw is not null")
    code = exprs.unescape_code(F.col("code"))
    skills = llmjson.parse_answers(raw).withColumn("code", code).withColumn("crystallized_at", F.lit(now)).withColumnRenamed("structural_hash", "pattern_hash").drop("prompt", "raw")
    valid = F.when(F.col("language") == "python", pyast.python_facts(F.when(F.col("language") == "python", F.col("code")))["valid"]).otherwise(exprs.brackets_balanced(F.col("code")))
    return skills.withColumn("code_valid", valid)
