"""The seams for text generation and speech: functions that the caller brings, over prompts or recordings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

Complete = Callable[[list[str]], list[str]]
Transcribe = Callable[[bytes, str], str | None]


def echo(prompts: list[str]) -> list[str]:
    """A deterministic stand-in: the prompts' last paragraphs."""
    return [p.rsplit("\n\n", 1)[-1] for p in prompts]


def _pass(complete: Complete) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        good = prompts.notna()
        out = pd.Series([None] * len(prompts), dtype=object)
        if good.any():
            out[good.to_numpy()] = complete(list(prompts[good]))
        return out

    return run


def drafted(frame: DataFrame, prompt: str, *, complete: Complete = echo, clean: Complete | None = None, column: str = "body") -> DataFrame:
    """Adds what ``complete`` makes of each prompt; ``clean`` goes over it, and where that gives nothing the first pass stays."""
    raw = frame.withColumn(column, _pass(complete)(F.col(prompt)))
    if clean is None:
        return raw
    return raw.withColumn(column, F.coalesce(F.nullif(_pass(clean)(F.col(column)), F.lit("")), column))


def transcribed(recordings: DataFrame, transcribe: Transcribe, *, content: str = "content", language: str = "ru") -> DataFrame:
    """Adds ``text``, what is said in each recording's bytes, stripped, and ``error``, null where that could be told.

    Text is empty where nothing was understood; a recording that is null or makes ``transcribe`` fail is a row with its error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, errors = [], []
            for recording in frame[content]:
                try:
                    if recording is None:
                        raise ValueError("no recording")
                    texts.append((transcribe(bytes(recording), language) or "").strip())
                    errors.append(None)
                except Exception as e:  # one bad recording is a row with its error, not a failed job
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame.assign(text=texts, error=errors)

    kept = [f for f in recordings.schema if f.name not in ("text", "error")]
    return recordings.select(*(f"`{f.name}`" for f in kept)).mapInPandas(run, StructType([*kept, StructField("text", StringType()), StructField("error", StringType())]))
