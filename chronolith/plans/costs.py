"""Counters and costs of model calls: totals over a table of calls, and a tracker on the driver that saves a report."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dollars for a thousand tokens of prompt, completion and embedding (fixed values).
PRICES = {"prompt": 0.0015, "completion": 0.002, "embedding": 0.00002}


def cost(prompt: Column, completion: Column, embedding: Column) -> Column:
    return prompt / 1000 * PRICES["prompt"] + completion / 1000 * PRICES["completion"] + embedding / 1000 * PRICES["embedding"]


def totals(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums, cost in dollars and cache hits in percent of ``calls(prompt, completion, embedding, hit)``, per key."""
    n = F.count(F.lit(1))
    sums = {c: F.coalesce(F.sum(c), F.lit(0.0)) for c in ("prompt", "completion", "embedding")}
    return calls.groupBy(*(by or [])).agg(
        n.alias("calls"),
        *[x.cast("double").alias(f"{c}_tokens") for c, x in sums.items()],
        cost(*sums.values()).alias("cost"),
        F.when(n > 0, 100.0 * F.sum(F.col("hit").cast("int")) / n).otherwise(0.0).alias("cache_hit_pct"),
    )


@dataclass
class Tracker:
    """What a build or a run of queries used. Counts come from tables of calls; nothing is counted inside tasks."""

    prompt: float = 0.0
    completion: float = 0.0
    embedding: float = 0.0
    calls: int = 0
    cache_hits: int = 0
    queries: int = 0
    answered: int = 0
    began: float = field(default_factory=time.time)
    progress: dict[str, int] = field(default_factory=dict)
    facts: dict[str, object] = field(default_factory=dict)

    def add(self, calls: DataFrame) -> None:
        """The totals of a table of calls."""
        r = totals(calls).first()
        self.prompt += r.prompt_tokens
        self.completion += r.completion_tokens
        self.embedding += r.embedding_tokens
        self.calls += r.calls
        self.cache_hits += round(r.cache_hit_pct * r.calls / 100)

    def done(self, **counts: int) -> None:
        """Chunks, entities, relations .. that a build has gone through."""
        for k, v in counts.items():
            self.progress[k] = self.progress.get(k, 0) + v

    def asked(self, answered: bool) -> None:
        self.queries += 1
        self.answered += answered

    def note(self, **facts: object) -> None:
        """Settings, corpus and places that the report names."""
        self.facts |= facts

    def summary(self) -> dict:
        tokens, seconds = self.prompt + self.completion + self.embedding, max(time.time() - self.began, 1e-9)
        return {
            "calls": self.calls,
            "prompt_tokens": self.prompt,
            "completion_tokens": self.completion,
            "embedding_tokens": self.embedding,
            "tokens": tokens,
            "seconds": round(seconds, 2),
            "tokens_per_second": round(tokens / seconds, 2),
            "tokens_per_call": round(tokens / self.calls, 2) if self.calls else 0.0,
            "cost_usd": round(self.prompt / 1000 * PRICES["prompt"] + self.completion / 1000 * PRICES["completion"] + self.embedding / 1000 * PRICES["embedding"], 4),
            "cache_hit_pct": round(100 * self.cache_hits / self.calls, 2) if self.calls else 0.0,
            "prompt_to_completion": round(self.prompt / self.completion, 2) if self.completion else 0.0,
            "queries": self.queries,
            "answered_pct": round(100 * self.answered / self.queries, 2) if self.queries else 0.0,
            "progress": self.progress,
        }

    def save(self, spark, path: str) -> None:  # noqa: ANN001
        """The report as one JSON line, through Spark's writer, so any file system will do."""
        line = json.dumps({"summary": self.summary(), **self.facts}, ensure_ascii=False, default=str)
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def __str__(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in self.summary().items())
