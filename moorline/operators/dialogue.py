"""Dialogue state over the turns of a conversation, in a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline import schemas
from moorline.functions.dialogue import ALIASES, STRINGS, Words, accepted, alias_texts, guessed_mentions, inferred_kb, json_object, located, normalized_action, parsed_turn, rule_action
from moorline.functions.text import let
from moorline.options import DEFAULT_KB
from moorline.sources import model

STATE = "struct<kb_id:string,text:string,mentions:array<string>,aliases:map<string,array<string>>>"


def start() -> Column:
    return F.struct(F.lit(DEFAULT_KB).alias("kb_id"), F.lit("").alias("text"), F.array().cast(STRINGS).alias("mentions"), F.create_map().cast(ALIASES).alias("aliases"))


def moved(state: Column, action: Column, words: Words) -> Column:
    """The state after an action: what it states overwrites, a reset starts anew, help changes nothing."""
    text, mentions = F.coalesce(action["text"], state["text"]), F.when(F.size(action["mentions"]) > 0, action["mentions"]).otherwise(state["mentions"])
    aliases = F.when(F.size(action["mention_aliases"]) > 0, action["mention_aliases"]).otherwise(state["aliases"])
    kb_id = F.coalesce(action["kb_id"], inferred_kb(text, mentions, state["kb_id"], words), state["kb_id"])
    new = F.struct(kb_id.alias("kb_id"), text.alias("text"), mentions.alias("mentions"), aliases.alias("aliases"))
    return F.when(action["action"] == "help", state).when(action["action"] == "reset", start()).otherwise(new)


def modelled(turns: DataFrame, answer_col: str = "answer") -> Column:
    """A model's action from its raw answer; null where turns have none or it is not accepted."""
    if answer_col not in turns.columns:
        return F.lit(None).cast(schemas.ACTION_TYPE)
    said = F.col(answer_col)
    read = lambda answer: let(normalized_action(json_object(answer)), lambda a: F.when(accepted(a), a))
    return F.when(said.isNotNull(), read(said)).cast(schemas.ACTION_TYPE)


def states(turns: DataFrame, words: Words = Words(), key: str = "conv_id", order: str = "turn", text_col: str = "text", parser: Callable[[Column, Words], Column] = parsed_turn) -> DataFrame:
    """(key, order, action, reply, confidence, route, kb_id, text, mentions, aliases, missing, runs,
    guessed): every turn's action, what is said to it, and the state after it. A turn's column `answer`, a model's raw reply, decides where it is accepted (see
    `answered`); else the rules do. A run needs a text and mentions; `missing` names what is not
    there yet. `parser` reads a turn (see parsed_turn)."""
    parsed = turns.select(key, order, parser(F.coalesce(F.col(text_col), F.lit("")), words).alias("said"), modelled(turns).alias("model"))
    rows = parsed.groupBy(key).agg(F.collect_list(F.struct(order, "said", "model")).alias("turns"))
    rows = rows.withColumn("turns", F.array_sort("turns", lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)))
    kind = f"array<struct<{order}:{turns.schema[order].dataType.simpleString()},action:string,run:boolean,reply:string,confidence:double,route:string,state:{STATE}>>"

    def step(held: Column, turn: Column) -> Column:
        state = held["state"]
        rule = rule_action(turn["said"], state["text"] != "", F.size(state["mentions"]) > 0)
        return let(F.coalesce(turn["model"], rule.cast(schemas.ACTION_TYPE)), lambda action: let(moved(state, action, words), lambda after: added(held, turn, action, after)))

    def added(held: Column, turn: Column, action: Column, after: Column) -> Column:
        row = F.struct(turn[order].alias(order), action["action"].alias("action"), action["run_requested"].alias("run"), action["reply"].alias("reply"), action["confidence"].alias("confidence"), F.when(turn["model"].isNotNull(), F.lit("model")).otherwise(F.lit("rules")).alias("route"), after.alias("state"))
        return F.struct(after.alias("state"), F.concat(held["out"], F.array(row)).alias("out"))

    folded = F.aggregate("turns", F.struct(start().alias("state"), F.array().cast(kind).alias("out")), step, lambda h: h["out"])
    flat = rows.select(key, F.inline(folded)).select(key, order, "action", "run", "reply", "confidence", "route", "state.kb_id", "state.text", "state.mentions", "state.aliases")
    missing = F.when(F.col("text") == "", F.lit("text")).when(F.size("mentions") == 0, F.lit("mentions")).otherwise(F.lit(""))
    return flat.withColumn("missing", missing).withColumn("runs", F.col("run") & (F.col("missing") == "")).drop("run").withColumn("guessed", F.when(F.col("missing") == "mentions", guessed_mentions(F.col("text"))))


def answered(turns: DataFrame, analyse: Callable[[str], str], text_col: str = "text", store: str | None = None, deadline: float = model.DEADLINE, pool: int = model.POOL) -> DataFrame:
    """turns with `answer`, the model's raw reply; a failure, or a call that takes longer than
    `deadline` seconds, is a null answer. `analyse` is any callable that executors can run; there is
    no default one, as there is no network. Equal texts are asked once. With `store`, a table keyed
    by the texts' hashes, nothing that it holds is asked again; without, each run of the plan asks."""
    texts = turns.select(F.col(text_col).alias("text"))
    found = model.answers(texts, analyse, deadline, pool) if store is None else model.stored_answers(texts, analyse, store, deadline, pool)
    keyed = turns.withColumn("_text_key", model.text_key(F.col(text_col)))
    return keyed.join(found.select(F.col("text_key").alias("_text_key"), "answer"), "_text_key", "left").drop("_text_key")


def understood(turns: DataFrame, words: Words = Words(), text_col: str = "text", answer_col: str = "answer", has_text: Column | None = None, has_mentions: Column | None = None) -> DataFrame:
    """turns with `action` and `route`: the model's action where it is accepted, else the rules'."""
    rule = rule_action(parsed_turn(F.col(text_col), words), has_text if has_text is not None else F.lit(False), has_mentions if has_mentions is not None else F.lit(False))
    model = modelled(turns, answer_col)
    return turns.withColumns({"action": F.coalesce(model, rule.cast(schemas.ACTION_TYPE)), "route": F.when(model.isNotNull(), F.lit("model")).otherwise(F.lit("rules"))})


def run_requests(states: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Requests (schemas.REQUEST without options) of the turns that run, mentions found in the text."""
    spans = located("text", "mentions", "aliases")
    mention = lambda m: F.struct(m["mention_id"].alias("mention_id"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), F.lit(None).cast("string").alias("entity_type"), F.col("text").alias("sentence"), m["candidate_aliases"].alias("candidate_aliases"), F.lit(False).alias("coreference_hint"))
    return states.filter("runs").select(F.concat_ws(":", key, order).alias("request_id"), F.lit(None).cast("string").alias("trace_id"), "kb_id", "text", F.transform(spans, mention).alias("mentions"))


def wanted_names(states: DataFrame) -> DataFrame:
    """(text): the mentions and expansions of the turns that run, to cut a large base down to (`kb.subset`)."""
    return states.filter("runs").select(F.explode(alias_texts(F.col("mentions"), F.col("aliases"))).alias("text")).distinct()
