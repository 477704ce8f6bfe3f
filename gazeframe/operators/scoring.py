"""Batch scoring that can be resumed: pending items, a user-supplied scorer, dead letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(prompts: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts whose keys are not in the output yet."""
    return prompts.join(done.select(*keys).distinct(), keys, "left_anti")


def score(prompts: DataFrame, make_scorer: Callable[[], Callable[[list[str]], list[str]]], keys: list[str]) -> DataFrame:
    """(keys..., raw, error): ``make_scorer`` is called once for each partition; a text that fails gives an error, not a lost batch."""
    fields = {f.name: f.dataType.simpleString() for f in prompts.schema.fields}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            raw, error = [], []
            try:
                raw = list(scorer(batch["prompt"].tolist()))
                error = [None] * len(raw)
            except Exception:
                for text in batch["prompt"]:
                    try:
                        raw.append(scorer([text])[0])
                        error.append(None)
                    except Exception as e:
                        raw.append(None)
                        error.append(type(e).__name__)
            yield batch[keys].assign(raw=raw, error=error)

    return prompts.select(*keys, "prompt").mapInPandas(work, ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", raw string, error string")


def append(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)


def with_fallback(parsed: DataFrame, error: str = "error") -> DataFrame:
    """Rows with an error get the label ``mix``, confidence 0, and the error as reasoning."""
    failed = F.col(error).isNotNull()
    return (
        parsed.withColumn("label", F.when(failed, "mix").otherwise(F.col("label")))
        .withColumn("confidence", F.when(failed, 0.0).otherwise(F.col("confidence")))
        .withColumn("reasoning", F.when(failed, F.concat(F.lit("error:"), F.col(error))).otherwise(F.col("reasoning")))
    )


def dead_letters(parsed: DataFrame, error: str = "error") -> DataFrame:
    return parsed.where(F.col(error).isNotNull())
