"""Linking a stream of requests: requests are independent, so each micro-batch is a batch."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from moorline.operators import retrieve
from moorline.operators.decide import respond, unpersisted
from moorline.options import LinkOptions
from moorline.scratch import passing, setting
from moorline.sources.files import persist, write_traces
from moorline.sources.index import AliasIndexes

IN_ORDER = "spark.sql.execution.replaceHashWithSortAgg"


def link_stream(requests: DataFrame, entities: DataFrame, sink: str, checkpoint: str, options: LinkOptions = LinkOptions(), prior: DataFrame | None = None, available_now: bool = True, answers: str | None = None, indexes: AliasIndexes | None = None) -> StreamingQuery:
    """Write the responses of a request stream to the trace table `sink`.

    A micro-batch that is tried again replaces its own earlier rows, so each request is answered
    once. Requests that name an unknown base are answered with that route: one of them must not end
    the stream.

    With a folder `answers`, a batch is written in two phases: its responses are staged there first,
    then its traces are written from the stage, then the responses are published as `batch=N`, with
    `trace_persisted` false where the trace table failed: a broken trace table does not end the
    stream. Without it, it does.

    With `indexes`, the base's alias index is a table that is made before the first batch and read by
    all; requests with a greater top_k than options, or bases of their own, do without it.
    """
    found = retrieve.candidates
    if indexes is not None and not {"options", "inline_kb"} & set(requests.columns):
        found = functools.partial(found, index=indexes.of(entities, options.exact_cap))

    def write(batch: DataFrame, number: int) -> None:
        # Mentions lie by request and in order: gathered as they come, their candidates are never sorted.
        with passing(batch.sparkSession), setting(batch.sparkSession, IN_ORDER, "true"):
            answer(batch, number)

    def answer(batch: DataFrame, number: int) -> None:
        responses = respond(batch, entities, options, prior, unknown="mark", retriever=found)
        if answers is None:
            write_traces(responses, sink, number)
            return
        staged = f"{answers}/_staged/batch={number}"
        responses.write.mode("overwrite").parquet(staged)
        responses = batch.sparkSession.read.schema(responses.schema).parquet(staged)
        kept = responses if persist(responses, sink, number) else unpersisted(responses)
        kept.write.mode("overwrite").parquet(f"{answers}/batch={number}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
