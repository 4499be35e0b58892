"""Where a language model answers: a protocol, recorded answers, a deterministic stand-in, and the cache around them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expressions import cache_key
from ..functions.vocabulary import AGENT_TYPES, DEFAULT_AGENT_TYPE

#: Items of one call, and tries of a call that fails.
BATCH, TRIES = 50, 5


class RateLimited(Exception):
    """What a call raises when the model asks for a pause: waits are longer, and the last one is raised again."""


def backoff(failed: int, limited: bool) -> float:
    """Seconds to wait after a number of failed tries (0: the first)."""
    return 30.0 + 15 * failed if limited else 2.0**failed


class Assessor(Protocol):
    """Answers for the rows of a DataFrame; the same rows get the same answers."""

    def assess(self, rows: DataFrame) -> DataFrame: ...


class Recorded:
    """Answers from a table, by the content of the key columns; rows without an answer get nulls."""

    def __init__(self, answers: DataFrame, keys: list[str]):
        self.answers, self.keys = answers, keys

    def assess(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.answers, self.keys, "left")


class RuleBased:
    """Answers from column expressions: no model and no network."""

    def __init__(self, **columns):
        self.columns = columns

    def assess(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns(self.columns)


class Batched:
    """Answers from a Python function over batches of `size` rows: a hook for a remote model.

    A batch that fails is tried again after `wait`; then its rows get nulls, and with report=True `status` (ok or failed)
    and `error`, so that a dead model doesn't pass for a silent one. A rate limit that outlasts all tries ends the task.
    Called inside mapInPandas, one batch in memory at a time.
    """

    def __init__(self, call: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str, size: int = BATCH, tries: int = TRIES, wait: Callable[[int, bool], float] = backoff, report: bool = False):
        self.call, self.schema, self.size, self.tries, self.wait, self.report = call, schema, size, tries, wait, report

    def assess(self, rows: DataFrame) -> DataFrame:
        call, size, tries, wait, kept = self.call, self.size, self.tries, self.wait, rows.columns
        added = StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema
        state = StructType.fromDDL("status string, error string") if self.report else StructType([])
        out = StructType([*rows.schema.fields, *added.fields, *state.fields])
        names = [f.name for f in added.fields if f.name not in kept]

        def ask(part: pd.DataFrame) -> tuple[pd.DataFrame | None, str | None]:
            error = None
            for n in range(tries):
                try:
                    return call(part).reset_index(drop=True).reindex(range(len(part)))[names], None
                except Exception as e:  # noqa: BLE001  whatever the model's client raises
                    limited = isinstance(e, RateLimited)
                    if n + 1 < tries:
                        time.sleep(wait(n, limited))
                    elif limited:
                        raise
                    error = f"{type(e).__name__}: {e}"
            return None, error

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for a in range(0, len(frame), size):
                    part = frame.iloc[a : a + size].reset_index(drop=True)
                    answer, error = ask(part)
                    if answer is None:
                        answer = pd.DataFrame({n: [None] * len(part) for n in names})
                    if state.fields:
                        answer = answer.assign(status="ok" if error is None else "failed", error=error)
                    yield pd.concat([part, answer], axis=1)

        return rows.mapInPandas(run, out)


def failures(answered: DataFrame) -> DataFrame:
    """(rows, failed, rate, error): what a reporting assessor could not answer, and one of its errors."""
    bad = F.col("status") == "failed"
    out = answered.agg(F.count("*").alias("rows"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("failed"), F.min("error").alias("error"))
    return out.select("rows", "failed", F.round(F.col("failed") / F.greatest("rows", F.lit(1)), 4).alias("rate"), "error")


def cached(rows: DataFrame, cache: DataFrame, assessor: Assessor, model: str, content: list[str], answers: list[str]) -> tuple[DataFrame, DataFrame]:
    """(answered rows, new cache entries): known contents are joined from the cache (key, answers...), others are assessed."""
    keyed = rows.withColumn("key", cache_key(model, *content))
    known = keyed.join(cache, "key")
    fresh = assessor.assess(keyed.join(cache, "key", "left_anti"))
    return known.unionByName(fresh.select(*known.columns)).drop("key"), fresh.select("key", *answers).dropDuplicates(["key"])


def agent_types(names: DataFrame, answers: DataFrame, known: tuple[str, ...] = AGENT_TYPES) -> DataFrame:
    """(name, agent_type): answered types; NON_AGENT and unknown types are structural."""
    out = names.join(answers, "name", "left")
    return out.select("name", F.when(F.col("agent_type").isin(*known), F.col("agent_type")).otherwise(DEFAULT_AGENT_TYPE).alias("agent_type"))


def batches(rows: DataFrame, rank: str, size: int = BATCH) -> DataFrame:
    """rows with `batch`, by their rank."""
    return rows.withColumn("batch", F.floor(F.col(rank) / size).cast("long"))


def bulk_size(pairs: DataFrame, first: int = 50) -> DataFrame:
    """One row: how many pairs (ord, cause_text, effect_text) a prompt can take, from the texts of the first ones."""
    mean = pairs.orderBy("ord").limit(first).agg(F.coalesce(F.avg(F.char_length("cause_text")), F.lit(0.0)).alias("c"), F.coalesce(F.avg(F.char_length("effect_text")), F.lit(0.0)).alias("e"))
    return mean.select(F.greatest(F.lit(20), F.least(F.lit(50), F.floor((12_000 - 500) / ((F.col("c") + F.col("e")) / 4 + 80)).cast("int"))).alias("bulk"))
