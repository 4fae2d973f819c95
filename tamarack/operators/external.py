"""Calls to models, as injected clients over batches of rows (SRC-28, STR-20..24, STR-26..34, AGG-10).

A client is ``list of prompts -> list of answers``. It runs inside ``mapInPandas``: partitions are the workers, batches
the requests; a failed batch is retried one by one, and what still fails becomes an error row, never a lost one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Client = Callable[[list[str]], list[str]]


def call_model(df: DataFrame, prompt: str, client: Callable[[], Client], batch: int = 64, out: str = "answer") -> DataFrame:
    """``df`` with the answer and error of each prompt; a null prompt isn't sent and answers null."""
    schema = StructType(list(df.schema.fields)).add(out, "string").add("error", "string")

    def ask(c: Client, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            got = c(prompts)
            if len(got) != len(prompts):
                raise ValueError("the client returned another number of answers")
            return [(g, None) for g in got]
        except Exception as e:  # noqa: BLE001  any failure of the service is data here
            return [(None, f"{type(e).__name__}: {e}"[:200])] if len(prompts) == 1 else [x for p in prompts for x in ask(c, [p])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = client()
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch].copy()
                at = part[prompt].notna().to_numpy()
                got = iter(ask(c, part[prompt][at].tolist()) if at.any() else [])
                answers = [next(got) if a else (None, None) for a in at]
                part[out], part["error"] = [a for a, _ in answers], [e for _, e in answers]
                yield part

    return df.mapInPandas(run, schema)


def failover(slots: list[Client]) -> Client:
    """STR-23, SRT-12: each slot is tried once, the one with the fewest calls first."""
    calls = [0] * len(slots)

    def ask(prompts: list[str]) -> list[str]:
        last: Exception | None = None
        for k in sorted(range(len(slots)), key=lambda k: (calls[k], k)):
            calls[k] += 1
            try:
                return slots[k](prompts)
            except Exception as e:  # noqa: BLE001
                last = e
        raise last or RuntimeError("no slot")

    return ask


def with_cache(df: DataFrame, cache: DataFrame, key: str, call: Callable[[DataFrame], DataFrame], out: str = "answer") -> DataFrame:
    """SRC-19, STR-28, STR-29: cached answers, and calls for the rest only."""
    known = cache.groupBy(key).agg(F.max(out).alias(out))
    hit = df.join(known, key).withColumn("error", F.lit(None).cast("string"))
    return hit.unionByName(call(df.join(known.select(key), key, "left_anti")), allowMissingColumns=True)
