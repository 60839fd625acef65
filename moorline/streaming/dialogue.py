"""Dialogue state over a stream of turns, one keyed state a conversation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from moorline.functions.dialogue import KNOWLEDGE_BASES, LONG_TEXT_REPLY, SWITCHED_REPLY, Words, parsed_turn
from moorline.operators.dialogue import modelled
from moorline.options import DEFAULT_KB

OUTPUT = "conv_id long, turn long, action string, kb_id string, text string, mentions array<string>, aliases map<string,array<string>>, runs boolean, reply string, confidence double, route string"
HELD = "turn long, kind string, kb_id string, text string, mentions array<string>, run boolean, model string"
State = tuple[str, str, list[str], dict[str, list[str]]]


def advance(state: State, said: dict, words: Words) -> tuple[str, bool, State]:
    """(action, run requested, next state) of one parsed turn, or of a model's action in its place."""
    kb_id, text, mentions, aliases = state
    model = said["model"]
    if model:
        action, run, named = model["action"], bool(model.get("run_requested")), model.get("kb_id")
        new_text, new_mentions, new_aliases = model.get("text") or "", list(model.get("mentions") or []), dict(model.get("mention_aliases") or {})
    else:
        new_text, new_mentions, new_aliases = ("", [], {}) if said["kind"] == "reply" else (said["text"], list(said["mentions"]), {})
        run = said["kind"] == "say" and (said["run"] or bool((new_text or text) and (new_mentions or mentions) and (new_text or new_mentions)))
        named = said["kb_id"] if said["kind"] == "say" else None
        action = said["kind"] if said["kind"] != "say" else "run" if run else "update" if named or new_text or new_mentions else "unknown"
    if action == "reset":
        return action, run, (DEFAULT_KB, "", [], {})
    if action == "help":
        return action, run, state
    text, mentions, aliases = new_text or text, new_mentions or mentions, new_aliases or aliases
    joined = " ".join([text, *mentions]) if mentions else text + " "
    if named:
        kb_id = named
    elif kb_id == DEFAULT_KB and not any(w in joined for w in words.energy) and any(w in joined for w in words.general):
        kb_id = KNOWLEDGE_BASES[0]
    return action, run, (kb_id, text, mentions, aliases)


def told(said: dict, action: str, run: bool) -> tuple[str | None, float, str]:
    """(reply, confidence, route) of a turn's action."""
    if said["model"]:
        return said["model"].get("reply"), said["model"].get("confidence"), "model"
    if said["kind"] == "reply":
        return LONG_TEXT_REPLY, 1.0, "rules"
    switched = said["kind"] == "say" and said["kb_id"] and not said["text"] and not len(said["mentions"]) and not run
    return SWITCHED_REPLY if switched else None, 0.0 if action == "unknown" else 1.0, "rules"


class Turns(StatefulProcessor):
    def __init__(self, words: Words, idle_ms: int | None, wait_ms: int | None = None, first: int = 0):
        self.words, self.idle_ms, self.wait_ms, self.first = words, idle_ms, wait_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("state", "kb_id string, text string, mentions array<string>, aliases string, next long", self.idle_ms)
        self.early = handle.getListState("early", HELD, self.idle_ms) if self.wait_ms is not None else None

    def moved(self, conv_id: int, rows: list[tuple], all_of_them: bool) -> Iterator[pd.DataFrame]:
        """States after those of the rows (in order of turn) whose predecessors came; others wait."""
        held = self.held.get() if self.held.exists() else (DEFAULT_KB, "", [], "{}", self.first)
        state, following, out, left = (held[0], held[1], list(held[2] or []), json.loads(held[3])), held[4], [], []
        for row in rows:
            r = dict(zip(("turn", "kind", "kb_id", "text", "mentions", "run", "model"), row))
            if self.early is not None and not all_of_them and r["turn"] > following:
                left.append(row)
                continue
            said = r | {"model": json.loads(r["model"]) if isinstance(r["model"], str) else None}
            action, run, state = advance(state, said, self.words)
            following = max(following, r["turn"] + 1)
            out.append((conv_id, r["turn"], action, *state, bool(run and state[1] and state[2]), *told(said, action, run)))
        self.held.update((*state[:3], json.dumps(state[3]), following))
        if self.early is not None:
            self.early.put(left) if left else self.early.clear()
        yield pd.DataFrame(out, columns=["conv_id", "turn", "action", "kb_id", "text", "mentions", "aliases", "runs", "reply", "confidence", "route"])

    def waiting(self) -> list[tuple]:
        return [(*r[:4], list(r[4]), *r[5:]) for r in self.early.get()] if self.early is not None and self.early.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        new = [(int(r["turn"]), r["kind"], r["kb_id"], r["text"], list(r["mentions"]), bool(r["run"]), r["model"] if isinstance(r["model"], str) else None) for r in batch.to_dict("records")]
        if self.wait_ms is not None:
            self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield from self.moved(key[0], sorted([*self.waiting(), *new], key=lambda r: r[0]), False)

    def handleExpiredTimer(self, key, timer, expired) -> Iterator[pd.DataFrame]:
        """What has waited long enough goes on without its predecessors."""
        left = self.waiting()
        yield from self.moved(key[0], sorted(left, key=lambda r: r[0]), True) if left else ()

    def close(self) -> None:
        pass


def dialogue_stream(turns: DataFrame, words: Words = Words(), idle_ms: int | None = None, wait_ms: int | None = None, first: int = 0) -> DataFrame:
    """States of a stream of (conv_id, turn, text[, answer]).

    Without wait_ms, turns of a conversation come in order of batches, and in order of turn within
    one. With it, turns are numbered from `first` without gaps: one that comes before its predecessor
    is held until that came, or for wait_ms after the conversation's latest rows (processing time);
    one that comes after its successors went on is taken at once.

    A conversation that says nothing for idle_ms (processing time) is forgotten, so that state does
    not grow for ever; without it none is. (A query that is to end by itself then needs
    spark.sql.streaming.noDataMicroBatches.enabled=false: batches without data wait for the limit.)
    """
    model = F.to_json(modelled(turns)).alias("model")
    said = turns.select("conv_id", "turn", parsed_turn(F.coalesce(F.col("text"), F.lit("")), words).alias("s"), model).select("conv_id", "turn", "s.*", "model")
    timed = idle_ms is not None or wait_ms is not None
    return said.groupBy("conv_id").transformWithStateInPandas(Turns(words, idle_ms, wait_ms, first), OUTPUT, "Append", "ProcessingTime" if timed else "None")
