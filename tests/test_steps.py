"""How the linking engine moves its rows."""

from pyspark.sql import functions as F

from moorline.functions import text as tx
from moorline.operators import decide
from moorline.plans import catalog, testdata
from moorline.sources import kb
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_signatures_are_read_not_derived_again(spark):
    unique = decide.signatures(decide.signed(testdata.line_mentions(spark, SMALL)))
    assert "Exchange" not in plan(unique) and unique.count() == unique.select("sig").distinct().count()


def test_reviews_move_no_results(spark):
    """Requests are joined before results pass through Python: nothing is exchanged above it."""
    responses = decide.respond(catalog.order_requests(spark, SMALL), testdata.catalog_kb(spark, SMALL), catalog.OPTIONS, whole=False)
    assert "Exchange hashpartitioning" not in plan(responses).split("ArrowEvalPython")[0]
    assert "candidates" not in responses.schema["results"].dataType.elementType.names


def test_han_characters_of_runs(spark):
    row = spark.createDataFrame([("天地x天、玄", "")], "a string, b string").select(tx.han_characters(F.col("a")), tx.han_characters(F.col("b"))).first()
    assert row[0] == ["天", "地", "玄"] and row[1] == []


def test_mentions_meet_facts_without_keys(spark):
    """A cryptographic key is worked out once a signature, never in the job that goes over the mentions."""
    for name in ("link_decisions", "rescored_candidates"):
        assert "sha2(" not in plan(catalog.QUERIES[name](spark, SMALL)), name


def test_documents_carry_what_is_wanted(spark):
    of = lambda *wanted: catalog.documents(spark, SMALL, *wanted).schema["results"].dataType.elementType.names
    assert "rationale" in of("rationale") and not {"rationale", "canonical_name", "text"} & set(of())


def test_names_are_normalised_once(spark):
    base = spark.createDataFrame([("b", 0, "e", "A b", ["a-b", "c", "", "C", None])], "kb_id string, entity_ord long, entity_id string, canonical_name string, aliases array<string>")
    names = kb.aliases(base)
    assert [(r.alias_ord, r.alias, r.norm) for r in names.orderBy("alias_ord").collect()] == [(0, "A b", "ab"), (2, "c", "c")]
    assert plan(names.select("norm")).count("regexp_replace") == 1


def test_heirs_are_places(spark):
    item = "array<struct<type:string,held:boolean,confidence:double,fallible:boolean>>"
    docs = [([("org", True, 0.9, False), ("", False, 0.0, True), ("org", False, 0.1, True), ("place", False, 0.2, True)],), (None,), ([],), ([("org", False, 0.2, True)],)]
    got = [r.h for r in spark.createDataFrame(docs, f"items {item}").coalesce(1).select(decide.heirs("items").alias("h")).collect()]
    assert [None if x is None else (x.before, x.source, x.confidence) for x in got[0]] == [None, (0, 0, 0.75), (1, 0, 0.6), (1, 0, 0.6)]
    assert got[1] is None and got[2] == [] and got[3] == [None]


def test_requests_move_once(spark, monkeypatch):
    """Responses read and key their requests once, and join nothing to them but what is small; a stream keeps the partitions of its requests."""
    requests = catalog.order_requests(spark, SMALL)
    responses = decide.respond(requests, testdata.catalog_kb(spark, SMALL), catalog.OPTIONS, whole=False)
    assert plan(responses).count("sha2(") == 1 and "dropDuplicates" not in plan(responses)
    streams = []
    monkeypatch.setattr(catalog, "streamed", lambda spark, frame, folder, real=catalog.streamed: streams.append(plan(frame)) or real(spark, frame, folder))
    assert catalog.QUERIES["streaming_link"](spark, SMALL).count() == requests.count()
    assert "Coalesce" not in streams[0]


def test_equal_and_invalid_requests_are_each_answered(spark):
    asked = lambda name, *texts, text="t": (name, f"tr-{name}", "b", text, [(f"m{i}", x, None, None, None, None, [], False) for i, x in enumerate(texts)])
    rows = [asked("a", "alpha", "beta"), asked("a", "alpha", "beta"), asked("b"), asked("b"), asked("c", "alpha", text=" "), asked("d", "nothing like it")]
    kind = "request_id string, trace_id string, kb_id string, text string, mentions array<struct<mention_id:string,text:string,start:int,end:int,entity_type:string,sentence:string,candidate_aliases:array<string>,coreference_hint:boolean>>"
    base = spark.createDataFrame([("b", "1", 0, "e0", "Alpha", [], "t", [], "", None), ("b", "1", 1, "e1", "Beta", [], "t", [], "", None)], "kb_id string, version string, entity_ord long, entity_id string, canonical_name string, aliases array<string>, entity_type string, keywords array<string>, description string, metadata_json string")
    got = sorted((r.request_id, r.route_decision, [(x.mention_id, x.linked_entity_id) for x in r.results]) for r in decide.respond(spark.createDataFrame(rows, kind), base).collect())
    linked = [("m0", "e0"), ("m1", "e1")]
    assert got[:5] == [("a", "resolved", linked)] * 2 + [("b", "invalid_input", [])] * 2 + [("c", "invalid_input", [])]
    assert got[5][0] == "d" and len(got) == 6 and len(got[5][2]) == 1
