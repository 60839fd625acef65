"""Answers of a chat model to user turns: each different text is asked once, and what came is kept.

The model is any callable from a text to its raw answer; transport and keys are the caller's. Calls
run in a bounded pool of threads in each task, each with a deadline. Answers lie in a table keyed by
the hash of the text, so a job that is tried again, or another one, asks nothing twice.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, wait
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.sources.files import exists

#: Seconds that a model may take, characters of an error that are kept.
DEADLINE, REASON = 20.0, 160
POOL = 8  # calls of one task at a time
ANSWERS = "text_key string, answer string, reason string"


class ModelError(RuntimeError):
    """Any failure of a model: refused, late, unreachable or without an answer that can be read."""


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def asked_in_time(analyse: Callable[[str], str], texts: list[str], deadline: float = DEADLINE, pool: int = POOL) -> list[tuple[str | None, str | None]]:
    """(answer, reason of a failure) of each text; no call is waited for longer than its deadline.

    At most `pool` calls are waited for at a time. A call that is late is given up: its thread ends
    by itself some time, and its place goes to the next text.
    """
    out: list[tuple[str | None, str | None]] = [(None, None)] * len(texts)
    waiting: dict[Future, tuple[int, float]] = {}
    following = iter(enumerate(texts))

    def call(future: Future, text: str) -> None:
        try:
            answer = analyse(text)
            future.set_result(None if answer is None else str(answer))
        except Exception as error:  # whatever a client raises is one kind of failure here
            future.set_exception(ModelError(f"{type(error).__name__}: {error}"))

    def begin() -> bool:
        for k, text in following:
            future: Future = Future()
            waiting[future] = (k, time.monotonic() + deadline)
            threading.Thread(target=call, args=(future, text), daemon=True).start()
            return True
        return False

    while len(waiting) < pool and begin():
        pass
    while waiting:
        first = min(end for _, end in waiting.values())
        done, _ = wait(waiting, timeout=max(0.0, first - time.monotonic()), return_when="FIRST_COMPLETED")
        now = time.monotonic()
        for future in [*done, *(f for f, (_, end) in list(waiting.items()) if f not in done and end <= now)]:
            k, _ = waiting.pop(future)
            try:
                answer = future.result(timeout=0)
                out[k] = (answer, None) if answer is not None else (None, "no answer")
            except Late:
                out[k] = (None, f"late: more than {deadline:g} s")
            except ModelError as error:
                out[k] = (None, str(error)[:REASON])
            begin()
    return out


def answers(texts: DataFrame, analyse: Callable[[str], str], deadline: float = DEADLINE, pool: int = POOL) -> DataFrame:
    """(text_key, answer, reason) of every different text of texts(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = asked_in_time(analyse, batch.column("text").to_pylist(), deadline, pool)
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array([a for a, _ in got], pa.string()), pa.array([r for _, r in got], pa.string())], names=["text_key", "answer", "reason"])

    unique = texts.select(text_key(F.col("text")).alias("text_key"), "text").filter("text is not null").dropDuplicates(["text_key"])
    return unique.mapInArrow(run, ANSWERS)


def stored_answers(texts: DataFrame, analyse: Callable[[str], str], path: str, deadline: float = DEADLINE, pool: int = POOL, again: bool = True) -> DataFrame:
    """The answers table at path, to which those of the texts it lacks were added. With `again`,
    texts whose calls failed are asked once more; the newest row of a text counts."""
    spark = texts.sparkSession
    keyed = texts.filter("text is not null").select("text", text_key(F.col("text")).alias("text_key"))
    kind = f"{ANSWERS}, at timestamp"
    if exists(spark, path):
        known = spark.read.schema(kind).parquet(path)
        keyed = keyed.join(known.filter("answer is not null") if again else known, "text_key", "left_anti")
    answers(keyed, analyse, deadline, pool).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
    newest = F.max_by(F.struct("answer", "reason"), F.struct(F.col("answer").isNotNull(), "at"))
    return spark.read.schema(kind).parquet(path).groupBy("text_key").agg(newest.alias("a")).select("text_key", "a.answer", "a.reason")
