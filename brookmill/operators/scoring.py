"""The boundary to models: a scorer runs over rows in Arrow batches, fails row by row, and can be resumed."""

from __future__ import annotations

import importlib
import random
import sys
import time
import traceback
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "id string, ground_truth string, raw string, failed boolean, error string, traceback string"
_COLUMNS = ["id", "ground_truth", "raw", "failed", "error", "traceback"]


class Scorer(Protocol):
    """What answers prompts. Loaded once per task; raises MemoryError where a batch is too large."""

    def load(self) -> None: ...

    def generate(self, rows: list[dict]) -> list[str]: ...


class EchoScorer:
    """A stand-in without a model: answers by a rule and fails where the row says so."""

    def __init__(self, largest: int = 4):
        self.largest = largest

    def load(self) -> None:
        self.loaded = True

    def generate(self, rows: list[dict]) -> list[str]:
        if len(rows) > self.largest:
            raise MemoryError(f"batch of {len(rows)}")
        if any(r.get("answer") is None for r in rows):
            raise ValueError("no answer to echo")
        return [f"the answer is {r['answer']}" for r in rows]


#: Scorers by name: what makes one, or where it is found, ``module:name``, imported when it is first asked for.
BACKENDS: dict[str, Callable[..., Scorer] | str] = {"echo": EchoScorer}


def register(name: str, maker: Callable[..., Scorer] | str) -> None:
    """Adds a scorer; a name that is there already is replaced."""
    BACKENDS[name] = maker


def backend(name: str, **knobs: object) -> Scorer:
    if name not in BACKENDS:
        raise KeyError(f"{name} is none of {sorted(BACKENDS)}")
    maker = BACKENDS[name]
    if isinstance(maker, str):
        module, _, attribute = maker.partition(":")
        maker = BACKENDS[name] = getattr(importlib.import_module(module), attribute)
    return maker(**knobs)


def out_of_memory(error: BaseException) -> bool:
    """Whether an error says that memory ran out, by its type or its text."""
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


def _result(row: dict, raw: str | None, error: str | None) -> tuple:
    return row.get("id"), row.get("answer"), raw, error is not None, error, traceback.format_exc() if error is not None and sys.exc_info()[0] else None


def score_batch(scorer: Scorer, rows: list[dict]) -> list[tuple]:
    """Results of a batch. If memory runs out each row is tried alone; any other error fails the rows it hits."""
    try:
        return [_result(r, t, None) for r, t in zip(rows, scorer.generate(rows), strict=True)]
    except Exception as e:  # noqa: BLE001
        if out_of_memory(e) and len(rows) > 1:
            return [x for r in rows for x in score_batch(scorer, [r])]
        if isinstance(e, MemoryError):
            return [_result(rows[0], None, str(e))]
        return [_result(r, None, f"{type(e).__name__}: {e}") for r in rows]


def score_rows(df: DataFrame, make: Callable[[], Scorer], batch_size: int = 8) -> DataFrame:
    """One result per row of ``df`` (id, answer and whatever the scorer reads); the scorer is loaded once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        scorer.load()
        for pdf in batches:
            rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
            out = [x for k in range(0, len(rows), batch_size) for x in score_batch(scorer, rows[k : k + batch_size])]
            yield pd.DataFrame(out, columns=_COLUMNS)

    return df.mapInPandas(run, RESULT)


def with_retry(call: Callable[[], str], attempts: int = 3, base: float = 1.0, retry_on: tuple[type[Exception], ...] = (TimeoutError, ConnectionError), sleep: Callable[[float], None] = time.sleep) -> str:
    """``call``'s result, tried again on passing errors after base * 2**k and up to half a second."""
    for k in range(attempts):
        try:
            return call()
        except retry_on:
            if k + 1 == attempts:
                raise
            sleep(base * 2**k + random.uniform(0, 0.5))
    raise AssertionError


def score_calls(df: DataFrame, call: Callable[[dict], str], threads: int = 8) -> DataFrame:
    """As score_rows, for a service that takes a row at a time: ``threads`` calls at once in a task, each failing alone."""

    def one(row: dict) -> tuple:
        try:
            return _result(row, with_retry(lambda: call(row)), None)
        except Exception as e:  # noqa: BLE001
            return _result(row, None, f"{type(e).__name__}: {e}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
                yield pd.DataFrame(list(pool.map(one, rows)), columns=_COLUMNS)

    return df.mapInPandas(run, RESULT)
