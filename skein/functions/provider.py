"""The seam for language-model calls: a provider is called batch by batch in the workers.

The engine brings a deterministic stub only; what stands around a call (coercion, filters,
merging) is the engine's own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str]]


def stub(prompts: list[str]) -> list[str]:
    """Answers that depend on the prompt alone: its capitalised words as entities."""
    return [json.dumps({"entities": [{"name": n, "confidence": 0.9 if len(n) > 5 else 0.5} for n in dict.fromkeys(re.findall(r"\b[A-Z][a-z]{2,}\b", p))]}) for p in prompts]


def complete(prompts: DataFrame, provider: Provider = stub, key: str = "id", prompt: str = "prompt", batch: int = 32) -> DataFrame:
    """(key, answer) of each prompt; a failed batch gives null answers and no failed task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k in range(0, len(pdf), batch):
                own = pdf.iloc[k : k + batch]
                try:
                    answers: list[str | None] = list(provider([p or "" for p in own[prompt]]))
                except Exception:  # a provider's failure is data
                    answers = [None] * len(own)
                yield pd.DataFrame({key: own[key].astype(str), "answer": answers})

    return prompts.select(key, prompt).mapInPandas(run, f"{key} string, answer string")


def clean_answer(answer: Column) -> Column:
    """Without thinking blocks and code fences, and with confidences such as 0-0.95 mended."""
    text = F.regexp_replace(answer, r"(?s)<think>.*?</think>", "")
    text = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.regexp_replace(text, r'("confidence"\s*:\s*)0-(0?\.?\d+)', "$1$2")


def discovered(answers: DataFrame, least: float = 0.6, key: str = "id") -> DataFrame:
    """Entities (key, name, confidence) of answers, those below ``least`` dropped; a missing confidence is 0."""
    own = F.from_json(clean_answer(F.col("answer")), "entities array<struct<name:string,confidence:double>>")
    rows = answers.select(key, F.explode(own["entities"]).alias("e")).select(key, "e.name", F.coalesce("e.confidence", F.lit(0.0)).alias("confidence"))
    return rows.where(F.col("confidence") >= least)
