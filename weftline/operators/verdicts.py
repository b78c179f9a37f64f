"""Judgements of a model as a column: any callable stands in for the model, and without an answer there is a fallback."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import first_json

RETRIES = 2
LOCAL_LIMIT, REMOTE_LIMIT = 2, 16


def judged(rows: DataFrame, prompt: str, model: Callable[[list[str]], list[str | None]], batch: int, pause: float = 0.0, retries: int = RETRIES) -> DataFrame:
    """rows with ``reply``. Distinct prompts are asked once, in batches; a batch that fails is asked again, then left null.

    Only as many requests run at once as there are tasks: repartition the rows to the provider's limit.
    """
    asked = rows.select(prompt).filter(F.col(prompt).isNotNull()).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[prompt].tolist()
            replies: list[str | None] = []
            for lo in range(0, len(texts), batch):
                own, answer = texts[lo : lo + batch], None
                for k in range(retries + 1):
                    try:
                        answer = model(own)
                        break
                    except Exception:  # whatever a provider raises; the fallback takes over
                        time.sleep(pause * 2**k)
                replies += answer if answer is not None and len(answer) == len(own) else [None] * len(own)
            yield pd.DataFrame({prompt: texts, "reply": replies})

    out = asked.mapInPandas(run, StructType([StructField(prompt, StringType()), StructField("reply", StringType())]))
    return rows.join(out, prompt, "left")


def kept_indexes(reply: Column) -> Column:
    """The indexes that a reply keeps, from its first JSON value; null if it can't be read."""
    parsed = first_json(reply, "keep array<int>")
    return F.coalesce(parsed["keep"], F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"\[[0-9,\s]*\]", 0), "array<int>"))


def navigation(reply: Column) -> Column:
    """(direction, target) that a reply plans; a missing target is null, which isn't 0."""
    return first_json(reply, "direction string, target int")


def approved(control_index: Column, reply: Column, payload: Column, override: int = 200) -> Column:
    """Whether a control is to be used: as the reply says, all if it can't be read, and always if much hides behind it."""
    keep = kept_indexes(reply)
    return keep.isNull() | F.array_contains(keep, control_index) | (F.coalesce(payload, F.lit(0)) >= override)
