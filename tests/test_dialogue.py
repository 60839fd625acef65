"""Dialogue rules, state in batch and stream, and model answers."""

from __future__ import annotations

import json
import time

from pyspark.sql import functions as F

from moorline.functions import dialogue as talk
from moorline.operators import dialogue
from moorline.plans import catalog
from moorline.sources import model
from moorline.streaming.dialogue import dialogue_stream
from tests.conftest import SMALL


def parsed(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", talk.parsed_turn(F.col("t")).alias("s")).orderBy("i").collect()
    return [r.s for r in rows]


def test_payloads(spark):
    one, two, three, four = parsed(spark, "链接：南京南站:坐高铁在南京南站下。南京南站，实体是 南京南站,高铁", "实体 国家电网、南方电网和国网", "帮助", "支持长文本吗")
    assert one.text == "南京南站:坐高铁在南京南站下。南京南站" and one.mentions == ["南京南站", "高铁"] and one.kind == "say"
    assert two.mentions == ["国家电网", "南方电网", "国网"]
    assert (three.kind, four.kind) == ("help", "reply")


def test_states(spark):
    turns = ["换成CCKS知识库", "文本：看《断背山》电影", "实体是 断背山", "清空", "看《断背山》电影", "Mentions: 断背山"]
    rows = dialogue.states(spark.createDataFrame([(1, k, t) for k, t in enumerate(turns)], "conv_id long, turn int, text string")).orderBy("turn").collect()
    assert [r.action for r in rows] == ["update", "update", "run", "reset", "update", "run"]
    assert rows[0].kb_id == rows[2].kb_id == "ccks2019-v1" and rows[3].kb_id == "sample-energy-v1" and rows[4].kb_id == "ccks2019-v1"
    assert rows[1].missing == "mentions" and rows[1].guessed == ["断背山"]
    assert rows[2].runs and not rows[3].runs and rows[3].text == ""


def answer(text):
    if "bad" in text:
        raise ValueError("no answer")
    return "Sure: " + json.dumps({"action": "Update", "kb_id": "ccks2019-v1", "text": " 断背山 ", "mentions": ["李导演", "李导演", ""], "mention_aliases": {"李导演": ["李安", "李导演", " 李安"], "x": "x"}, "confidence": 0.9})


def test_model_answers(spark):
    turns = spark.createDataFrame([(1, "李导演的电影"), (2, "bad"), (3, None)], "conv_id long, text string")
    rows = {r.conv_id: r for r in dialogue.understood(dialogue.answered(turns.filter("text is not null"), answer)).collect()}
    assert rows[1].route == "model" and rows[1].action.text == "断背山" and rows[1].action.mentions == ["李导演"] and rows[1].action.mention_aliases == {"李导演": ["李安"]}
    assert rows[2].route == "rules"


def test_model_actions_move_the_state(spark):
    """A model's expansions stay in the state until other ones come or a reset, and reach the request of a run."""

    def analyse(text):
        if "导演" in text:
            return json.dumps({"action": "update", "text": "李导演的《断背山》真是令人动人", "mentions": ["李导演", "断背山"], "mention_aliases": {"李导演": ["李安"]}, "confidence": 0.95})
        return json.dumps({"action": "run", "confidence": 0.2})

    turns = spark.createDataFrame([(1, 0, "李导演的电影"), (1, 1, "运行"), (1, 2, "清空")], "conv_id long, turn int, text string")
    states = dialogue.states(dialogue.answered(turns, analyse))
    rows = states.orderBy("turn").collect()
    assert [(r.action, r.kb_id, r.aliases) for r in rows] == [("update", "ccks2019-v1", {"李导演": ["李安"]}), ("run", "ccks2019-v1", {"李导演": ["李安"]}), ("reset", "sample-energy-v1", {})]
    only = dialogue.run_requests(states).collect()
    assert len(only) == 1 and only[0].request_id == "1:1" and only[0].kb_id == "ccks2019-v1"
    assert [(m.mention_id, m.start, m.candidate_aliases) for m in only[0].mentions] == [("m1", 0, ["李安"]), ("m2", 5, [])]
    assert {r.text for r in dialogue.wanted_names(states).collect()} == {"李导演", "断背山", "李安"}


def test_idle_conversations_are_forgotten(spark, tmp_path):
    """With a limit the stream's state has a time to live; the states are the same meanwhile."""
    turns = catalog.conversation_turns(spark, SMALL)
    turns.coalesce(1).write.parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"  # batches without data would follow until the state is gone
    spark.conf.set(empty, "false")
    try:
        stream = dialogue_stream(spark.readStream.schema(turns.schema).parquet(f"{tmp_path}/in"), catalog.WORDS, idle_ms=3_600_000)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key)
        spark.conf.unset(empty)
    got = catalog.state_columns(spark.read.parquet(f"{tmp_path}/out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalog.dialogue_state(spark, SMALL).collect()))


def test_shuffled_turns_wait_for_their_predecessors(spark, tmp_path):
    """One file a batch, turns in any order: the stream's states are those of the batch."""
    turns = catalog.conversation_turns(spark, SMALL)
    first = {r[0]: r[1] for r in turns.groupBy("conv_id").agg(F.min("turn")).collect()}
    assert set(first.values()) == {0}
    parts = turns.withColumn("file", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)))
    for k in range(3):
        parts.filter(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    key, empty = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(empty, "false")
    try:
        source = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream = dialogue_stream(source, catalog.WORDS, wait_ms=3_600_000)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key)
        spark.conf.unset(empty)
    columns = ["conv_id", "turn", "action", "kb_id", "text", "runs", "reply", "confidence", "route"]
    got, want = spark.read.parquet(f"{tmp_path}/out"), dialogue.states(turns, catalog.WORDS)
    rows = lambda f: sorted((tuple(r) for r in f.select(columns).collect()), key=str)
    assert rows(got) == rows(want) and got.filter("route = 'model'").count() and got.filter("reply is not null or confidence = 0").count() >= 0


def test_replies_and_routes(spark):
    turns = ["支持长文本吗", "换成CCKS知识库", "嗯", "看《断背山》电影"]
    rows = dialogue.states(spark.createDataFrame([(1, k, t) for k, t in enumerate(turns)], "conv_id long, turn int, text string")).orderBy("turn").collect()
    assert [r.reply for r in rows] == [talk.LONG_TEXT_REPLY, talk.SWITCHED_REPLY, None, None]
    assert [r.confidence for r in rows] == [1.0, 1.0, 0.0, 1.0] and {r.route for r in rows} == {"rules"}


def test_model_calls_have_deadlines_and_one_kind_of_error():
    calls = []

    def fake(text):
        calls.append(text)
        if text == "slow":
            time.sleep(3)
        if text == "broken":
            raise KeyError("choices")
        return None if text == "nothing" else text.upper()

    began = time.monotonic()
    got = model.asked_in_time(fake, ["a", "slow", "broken", "nothing", "b", "slow", "c"], deadline=0.5, pool=2)
    assert time.monotonic() - began < 2.5
    assert [a for a, _ in got] == ["A", None, None, None, "B", None, "C"] and len(calls) == 7
    assert got[1][1].startswith("late") and got[2][1].startswith("KeyError") and got[3][1] == "no answer"


def test_answers_are_kept_and_nothing_is_asked_twice(spark, tmp_path):
    log = tmp_path / "asked"

    def fake(text):
        with open(log, "a") as f:
            f.write(text + "\n")
        if "bad" in text:
            raise OSError("down")
        return text[::-1]

    turns = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "bad"), (4, None), (5, "xyz")], "conv_id long, text string")
    for _ in range(2):
        rows = {r.conv_id: r.answer for r in dialogue.answered(turns, fake, store=f"{tmp_path}/answers").collect()}
        assert rows == {1: "cba", 2: "cba", 3: None, 4: None, 5: "zyx"}
    asked = log.read_text().split()
    assert sorted(asked) == ["abc", "bad", "bad", "xyz"]  # only the failure was tried again
    kept = model.stored_answers(turns.select("text"), fake, f"{tmp_path}/answers", again=False)
    assert {(r.answer, r.reason) for r in kept.collect()} == {("cba", None), ("zyx", None), (None, "OSError: down")} and len(log.read_text().split()) == 4


def test_low_confidence_falls_back(spark):
    rows = spark.createDataFrame([(json.dumps({"action": "run", "confidence": c}),) for c in (0.44, 0.45, "x", 7)], "a string")
    got = [r[0] for r in rows.select(talk.accepted(talk.normalized_action(talk.json_object(F.col("a"))))).collect()]
    assert got == [False, True, False, True]


def test_quoted_guesses(spark):
    got = spark.range(1).select(talk.guessed_mentions(F.lit('《a》“b”"c"《a》《d》《e》《f》'))).first()[0]
    assert got == ["a", "b", "c", "d", "e"]
