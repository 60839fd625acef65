"""Decisions by mention, coreference in document order, routes, review and responses."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moorline import schemas
from moorline.functions.text import context_window, normalize, round_binary, strip, trace_id
from moorline.operators import rerank, retrieve
from moorline.sources.files import explode_requests
from moorline.scratch import shared_folder, stored
from moorline.options import COREFERENCE_FLOOR, COREFERENCE_LOSS, COREFERENCE_TERMS, LinkOptions, Settings
from moorline.sources.kb import inline_entities

CANDIDATE = "struct<rank:int,entity_id:string,canonical_name:string,entity_type:string,score:double,alias_similarity:double,matched_alias:string,overlapping_keywords:array<string>,reasons:array<string>>"
STRINGS = "array<string>"


def with_options(rows: DataFrame, options: LinkOptions) -> DataFrame:
    """rows with top_k, nil_threshold and ambiguity_margin: their own, else those of options."""
    given = {"top_k": options.top_k, "nil_threshold": options.nil_threshold, "ambiguity_margin": options.ambiguity_margin}
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in rows.columns else F.lit(v) for k, v in given.items()})


SIGNATURE = ("kb_id", "text", "candidate_aliases", "top_k", "entity_type", "context")


def signed(mentions: DataFrame, options: LinkOptions = LinkOptions()) -> DataFrame:
    """mentions with options and context, and so with all that a score depends on (SIGNATURE)."""
    return with_options(mentions, options).withColumn("context", context_window(F.col("doc_text"), F.col("start"), F.col("end"), F.col("sentence")))


def signatures(mentions: DataFrame) -> DataFrame:
    """Each signature once, with its key (`sig`), the key of what can be found for it (`q`) and the marks by
    which mentions meet it. Stored: retrieval, facts and scores all read it, and none of them goes over the
    mentions again. Its job runs here."""
    unique = mentions.select(*SIGNATURE).distinct().withColumn("sig", retrieve.key(*SIGNATURE))
    return stored(retrieve.with_key(retrieve.marked(unique, SIGNATURE)), shared_folder(mentions.sparkSession), "signatures")


#: A stage that finds candidates (lists of queries, entities, greatest top_k), and one that scores them (built, prior).
Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]
Scorer = Callable[[DataFrame, DataFrame | None], DataFrame]


def scored(mentions: DataFrame, entities: DataFrame, most_k: int, prior: DataFrame | None = None, retriever: Retriever = retrieve.candidates, scorer: Scorer = rerank.rescore) -> DataFrame:
    """Ranked candidates of every signature of (signed) mentions, with its marks; most_k is their greatest top_k. Stored,
    so that Spark knows their size where mentions meet them: where they are few, mentions stay where they lie."""
    unique = signatures(mentions)
    lists = retrieve.asked(unique)
    ranked = rerank.top(scorer(retrieve.build(retriever(lists, entities, most_k), unique, entities, prior), prior), most_k)
    ranked = ranked.join(unique.select("sig", "mark", "asks"), "sig")
    return stored(ranked, shared_folder(mentions.sparkSession), "ranked")


def first_decisions(mentions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Each mention's decision on its own candidates alone; `fallible` marks those that coreference may replace."""
    none = F.array().cast(f"array<{CANDIDATE}>")
    # What decisions need is taken out for each signature: whoever wants no candidates carries none.
    found = F.col("candidates")
    best = rerank.collected(ranked).select("mark", "asks", "candidates", "retrieved", F.get(found, F.lit(0)).alias("first"), F.get(found, F.lit(1))["score"].alias("second_score"), F.size(found).alias("n_candidates"))
    rows = retrieve.meet(mentions, best, SIGNATURE, "left").withColumns({"candidates": F.coalesce("candidates", none), "n_candidates": F.coalesce("n_candidates", F.lit(0))})
    first = F.col("first")
    low = F.coalesce(first["score"] < F.col("nil_threshold"), F.lit(True))
    close = F.coalesce((first["score"] - F.col("second_score")) < F.col("ambiguity_margin"), F.lit(False))
    empty = F.col("n_candidates") == 0
    status = F.when(low, F.lit("nil")).when(close, F.lit("ambiguous")).otherwise(F.lit("linked"))
    nil_reason = F.array_compact(F.array(F.lit("nil_detected_due_to_low_score"), F.when(empty, F.lit("no_candidate_retrieved"))))
    link_reason = F.concat(first["reasons"], F.array(F.when(close, F.lit("margin_below_ambiguity_threshold")).otherwise(F.lit("score_above_link_threshold"))))
    return rows.withColumns(
        {
            "status": status,
            "linked_entity_id": F.when(~low, first["entity_id"]),
            "canonical_name": F.when(~low, first["canonical_name"]),
            "confidence": F.coalesce(first["score"], F.lit(0.0)),
            "needs_review": F.when(low, ~empty).otherwise(close),
            "matched_alias": first["matched_alias"],
            "overlapping_keywords": F.coalesce(first["overlapping_keywords"], F.array().cast(STRINGS)),
            "rationale": F.when(low, nil_reason).otherwise(link_reason),
            "fallible": low & (F.col("text").isin(*COREFERENCE_TERMS) | F.coalesce("coreference_hint", F.lit(False))),
            "coreference_source": F.lit(None).cast("string"),
            "retrieved": F.coalesce("retrieved", F.lit(0)).cast("long"),
        }
    )


FIELDS = ["pos", "mention_id", "text", "entity_type", "status", "linked_entity_id", "canonical_name", "confidence", "needs_review", "candidates", "matched_alias", "overlapping_keywords", "rationale", "context", "fallible", "coreference_source", "retrieved", "n_candidates"]
HEIR = T.StructType([T.StructField("before", T.IntegerType()), T.StructField("source", T.IntegerType()), T.StructField("confidence", T.DoubleType())])
#: Parts that routes, heirs and the order of decisions depend on.
NEEDED = ("pos", "mention_id", "entity_type", "status", "linked_entity_id", "confidence", "needs_review", "fallible", "n_candidates")
#: Parts of a decision that only whole responses need.
HEAVY = ("candidates", "matched_alias", "overlapping_keywords", "context")


@F.arrow_udf(T.ArrayType(HEIR))
def heirs(documents: pa.Array) -> pa.Array:
    """For each decision of each document in order, the link it inherits (null for most): the last one
    of a type that fits, as the place of the decision that holds it, the place of the one that found
    its entity, and the confidence.

    One pass over a document carries the latest link of each type, the newest last: an older one of
    the same type can never be the most recent that fits. Documents come as arrays of (type, held,
    confidence, fallible), nulls where there is nothing to follow.
    """
    kinds, held, confidences, fallible = (c.to_pylist() for c in documents.flatten().flatten())
    inherits, before_of, source_of, passed_on = [False] * len(kinds), [0] * len(kinds), [0] * len(kinds), [0.0] * len(kinds)
    offsets = [0]
    for n in documents.value_lengths().to_pylist():
        base = offsets[-1]
        latest: dict[str, tuple[int, int, float]] = {}
        for i in range(base, base + (n or 0)):
            kind, link = kinds[i], None
            if fallible[i]:
                before = next((x for k, x in reversed(latest.items()) if not kind or not k or k == kind), None)
                if before is not None:
                    link = (i - base, before[1], round(max(COREFERENCE_FLOOR, before[2] - COREFERENCE_LOSS), 3))
                    inherits[i], before_of[i], source_of[i], passed_on[i] = True, before[0], before[1], link[2]
            if link is None and held[i]:
                link = (i - base, i - base, confidences[i])
            if link is not None:
                latest.pop(kind, None)
                latest[kind] = link
        offsets.append(base + (n or 0))
    nothing = pa.array([not x for x in inherits], pa.bool_())
    found = pa.StructArray.from_arrays([pa.array(before_of, pa.int32()), pa.array(source_of, pa.int32()), pa.array(passed_on, pa.float64())], names=HEIR.names, mask=nothing)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found, mask=documents.is_null())


def compared(items: Column) -> Column:
    """What `heirs` compares, and nothing else."""
    return F.transform(items, lambda x: F.struct(F.coalesce(x["entity_type"], F.lit("")).alias("type"), x["linked_entity_id"].isNotNull().alias("held"), x["confidence"].alias("confidence"), x["fallible"].alias("fallible")))


def gathered(decided: DataFrame, keys: tuple[str, ...] = ("request_id",), whole: bool = True, wanted: tuple[str, ...] | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """(keys, items, least_score, carried): one row a document, its decisions in order; not whole, they are
    without the HEAVY parts; with wanted, they have those parts and the NEEDED ones only. A document's rows
    have the same in the columns carried; one without a pos is no decision."""
    fields = [f for f in FIELDS if (whole or f not in HEAVY) and (wanted is None or f in NEEDED or f in wanted)]
    some = F.when(F.col("pos").isNotNull(), F.struct(*fields))
    return decided.groupBy(*keys).agg(F.array_sort(F.collect_list(some)).alias("items"), F.max("nil_threshold").alias("least_score"), *[F.first(c).alias(c) for c in carried])


def reviewed(rows: DataFrame) -> DataFrame:
    """rows of documents (`items` and `least_score` as gathered) with `route` and `results` in their
    place: back-references followed, the doubtful marked."""
    others, fields = [c for c in rows.columns if c not in ("items", "least_score")], rows.schema["items"].dataType.elementType.names
    items, told = F.col("items"), F.col("heirs")
    rows = rows.withColumn("some", F.exists("items", lambda x: x["n_candidates"] > 0))
    # Documents without a fallible mention, which are most, have nothing to fold.
    rows = rows.withColumn("heirs", heirs(F.when(F.col("some") & F.exists("items", lambda x: x["fallible"]), compared(items))))
    # Whoever inherits is to be reviewed, so the route needs no results.
    inherited = F.coalesce(F.exists(told, lambda h: h.isNotNull()), F.lit(False))
    doubtful = inherited | F.exists("items", lambda x: x["needs_review"] | (x["status"] == "ambiguous") | ((x["n_candidates"] > 0) & (x["confidence"] < F.col("least_score"))))
    rows = rows.withColumn("route", F.when(~F.col("some"), F.lit("empty_candidates")).when(doubtful, F.lit("needs_review")).otherwise(F.lit("resolved")))

    def nil(item: Column) -> Column:
        changed = {"rationale": F.array(F.lit("candidate_route_empty"), F.lit("nil_fallback")), "needs_review": F.lit(False), "confidence": F.lit(0.0), "status": F.lit("nil")}
        return F.struct(*[changed.get(f, item[f]).alias(f) for f in fields])

    def settled(item: Column, i: Column) -> Column:
        """The decision as it stands after review: with the link that it inherits, and marked where doubtful."""
        heir = F.get(told, i)
        follows, source = heir.isNotNull(), F.get(items, heir["source"])
        before = F.get(items, heir["before"])["mention_id"]
        flagged = follows | item["needs_review"] | (item["status"] == "ambiguous")
        inherits = {
            "status": F.lit("linked"),
            "linked_entity_id": source["linked_entity_id"],
            "confidence": heir["confidence"],
            "n_candidates": F.lit(0),
            "candidates": F.array().cast(f"array<{CANDIDATE}>"),
            "matched_alias": F.lit(None).cast("string"),
            "overlapping_keywords": F.array().cast(STRINGS),
            "coreference_source": before,
        }
        changed = {f: F.when(follows, c).otherwise(item[f]) for f, c in inherits.items() if f in fields} | {"needs_review": flagged}
        if "canonical_name" in fields:
            changed["canonical_name"] = F.when(follows, source["canonical_name"]).otherwise(item["canonical_name"])
        if "rationale" in fields:
            reason = F.when(follows, F.array(F.lit("coreference_fallback"), F.concat(F.lit("inherits_recent_link:"), before))).otherwise(item["rationale"])
            changed["rationale"] = F.when(flagged, F.concat(reason, F.array(F.lit("human_review_required")))).otherwise(reason)
        return F.struct(*[changed.get(f, item[f]).alias(f) for f in fields])

    results = F.when(F.col("route") == "empty_candidates", F.transform("items", nil)).when(F.col("route") == "needs_review", F.transform("items", settled)).otherwise(items)
    return rows.select(*others, "route", results.alias("results"))


def decisions(documents: DataFrame) -> DataFrame:
    """One row a mention from one row a document."""
    return documents.select("request_id", "route", F.inline("results"))


def link_mentions(mentions: DataFrame, entities: DataFrame, options: LinkOptions = LinkOptions(), prior: DataFrame | None = None, retriever: Retriever = retrieve.candidates, scorer: Scorer = rerank.rescore, keys: tuple[str, ...] = ("request_id",), most_k: int | None = None, whole: bool = True, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The engine on valid mentions: (keys, route, results). Stages can be replaced.

    Mentions may state top_k, nil_threshold and ambiguity_margin of their own, those of one request
    alike; options stand in for what they leave out. most_k, the greatest top_k, is looked up where
    mentions have their own and it is not given. Not whole, results lack the parts named by HEAVY,
    which decisions do not depend on. With wanted, they have these parts and the NEEDED ones only: Spark drops no
    field of a collected array by itself.
    """
    return reviewed(linked(mentions, entities, options, prior, retriever, scorer, keys, most_k, whole, wanted=wanted))


def linked(mentions: DataFrame, entities: DataFrame, options: LinkOptions, prior: DataFrame | None, retriever: Retriever, scorer: Scorer, keys: tuple[str, ...], most_k: int | None, whole: bool, alike: DataFrame | None = None, wanted: tuple[str, ...] | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """The part of link_mentions before documents are reviewed. alike: rows with the signatures of mentions, where
    those are cheaper to come by."""
    if options.errors():
        raise ValueError(", ".join(options.errors()))
    ready = signed(mentions, options)
    if most_k is None:
        most_k = retrieve.most_asked(ready) if "top_k" in mentions.columns else options.top_k
    return gathered(first_decisions(ready, scored(ready if alike is None else signed(alike, options), entities, most_k, prior, retriever, scorer)), keys, whole, wanted, carried)


# -- requests and responses -------------------------------------------------------------------


def validation_errors() -> Column:
    """Error codes of a request row (text, mentions, top_k, nil_threshold, ambiguity_margin), in the
    order: text, mentions, options."""
    mentions = F.col("mentions")

    def code(bad: Column, text: Column) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), text)

    def of(m: Column) -> Column:
        name = F.coalesce(m["mention_id"], F.lit(""))
        return F.array(
            code(name == "", F.lit("mention_id_required")),
            code(strip(F.coalesce(m["text"], F.lit(""))) == "", F.concat(F.lit("mention_text_required:"), name)),
            code(m["start"] < 0, F.concat(F.lit("mention_start_invalid:"), name)),
            code(m["end"] < 0, F.concat(F.lit("mention_end_invalid:"), name)),
            code(m["start"] > m["end"], F.concat(F.lit("mention_span_invalid:"), name)),
        )

    none = F.array().cast(STRINGS)
    head = F.array(
        F.when(strip(F.coalesce(F.col("text"), F.lit(""))) == "", F.lit("text_required")),
        F.when(F.coalesce(F.size(mentions), F.lit(0)) <= 0, F.lit("mentions_required")),
    )
    tail = F.array(
        code(F.col("top_k") < 1, F.lit("top_k_candidates_must_be_positive")),
        code(~F.col("nil_threshold").between(0, 1), F.lit("nil_threshold_out_of_range")),
        code(~F.col("ambiguity_margin").between(0, 1), F.lit("ambiguity_margin_out_of_range")),
    )
    return F.array_compact(F.concat(head, F.coalesce(F.flatten(F.transform(mentions, of)), none), tail))


#: The names of the stages that each route runs through.
NODES = {
    "invalid_input": ["validate_input", "build_response", "persist_trace"],
    "unknown_kb": ["validate_input", "build_response", "persist_trace"],
    "empty_candidates": ["validate_input", "load_kb", "generate_candidates", "nil_fallback", "build_response", "persist_trace"],
    "resolved": ["validate_input", "load_kb", "generate_candidates", "rerank_candidates", "resolve_mentions", "build_response", "persist_trace"],
    "needs_review": ["validate_input", "load_kb", "generate_candidates", "rerank_candidates", "resolve_mentions", "human_review", "build_response", "persist_trace"],
}


def nodes(route: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in NODES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), route)


def summary(results: Column) -> Column:
    count = lambda test: F.size(F.filter(results, test))
    return F.struct(
        F.size(results).alias("total_mentions"),
        count(lambda x: x["status"] == "linked").alias("linked"),
        count(lambda x: x["status"] == "ambiguous").alias("ambiguous"),
        count(lambda x: x["status"] == "nil").alias("nil"),
        count(lambda x: x["needs_review"]).alias("review_required"),
    )


def events(route: Column, results: Column, counts: Column, kb_id: Column, entity_count: Column, errors: Column) -> Column:
    """One {node, detail JSON} for each stage that ran; others are not built. counts is the results' summary."""
    flagged = F.filter(results, lambda x: x["needs_review"])
    total = counts["total_mentions"]
    detail = {
        "validate_input": F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors")),
        "load_kb": F.struct(kb_id.alias("kb_id"), entity_count.alias("entity_count")),
        # What retrieval gave, whatever became of it: a heir's candidates are gone, but it had some.
        "generate_candidates": F.struct(total.alias("mention_count"), F.aggregate(results, F.lit(0).cast("long"), lambda n, x: n + x["retrieved"]).alias("candidate_count"), F.transform(F.filter(results, lambda x: x["retrieved"] == 0), lambda x: x["mention_id"]).alias("empty_mentions")),
        "nil_fallback": F.struct(total.alias("nil_mentions"), F.lit("no_candidates_for_all_mentions").alias("reason")),
        "rerank_candidates": F.struct(total.alias("reranked_mentions")),
        "resolve_mentions": F.struct(counts["linked"].alias("linked"), counts["nil"].alias("nil"), counts["ambiguous"].alias("ambiguous")),
        "human_review": F.struct(counts["review_required"].alias("review_required"), F.transform(flagged, lambda x: F.struct(x["mention_id"], x["status"], x["confidence"])).alias("items"), F.lit("low_confidence_or_ambiguous").alias("policy")),
        "build_response": F.struct(total.alias("total_mentions"), route.alias("route_decision")),
        "persist_trace": F.struct(F.lit(True).alias("trace_persisted")),
    }

    def told(n: Column) -> Column:
        text = F.lit(None).cast("string")
        for name, value in detail.items():
            text = F.when(n == name, F.to_json(value)).otherwise(text)
        return F.struct(n.alias("node"), text.alias("detail"))

    return F.transform(nodes(route), told)


def log_of(results: Column, trace: Column) -> Column:
    return F.transform(results, lambda x: F.struct(trace.alias("trace_id"), x["mention_id"].alias("mention_id"), x["status"].alias("status"), x["linked_entity_id"].alias("linked_entity_id"), x["confidence"].alias("confidence"), x["needs_review"].alias("needs_review")))


def decision_log(responses: DataFrame) -> DataFrame:
    """One flat row a result."""
    return responses.select("request_id", F.inline(log_of(F.col("results"), F.col("trace_id"))))


def public(results: Column, whole: bool = True) -> Column:
    """Results as clients see them: evidence nested, no working columns; not whole, no HEAVY parts."""

    def shown(x: Column) -> Column:
        heavy = (x["matched_alias"].alias("matched_alias"), x["context"].alias("context_snippet"), x["overlapping_keywords"].alias("overlapping_keywords")) if whole else ()
        evidence = F.struct(normalize(x["text"]).alias("normalized_mention"), *heavy, x["rationale"].alias("rationale"))
        fields = ("mention_id", "text", "entity_type", "linked_entity_id", "canonical_name", "status", "confidence", "needs_review", *(("candidates",) if whole else ()))
        return F.struct(*[x[f].alias(f) for f in fields], evidence.alias("evidence"), x["coreference_source"].alias("coreference_source_mention_id"))

    return F.transform(results, shown)


def with_defaults(requests: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Requests with the default base and a trace id where they have none. Trace ids are drawn
    anew each time the plan runs: store the result before it is used twice."""
    return requests.withColumns({"kb_id": F.coalesce("kb_id", F.lit(settings.default_kb)), "trace_id": F.coalesce("trace_id", trace_id(settings.trace_prefix))})


def respond(requests: DataFrame, entities: DataFrame, options: LinkOptions = LinkOptions(), prior: DataFrame | None = None, unknown: str = "fail", retriever: Retriever = retrieve.candidates, whole: bool = True) -> DataFrame:
    """Responses to requests (see schemas.REQUEST): one row each, requests being independent even
    where their ids repeat.

    A request may bring options of its own (`options`; missing parts are filled from the argument)
    and a base of its own (`inline_kb`, which wins over kb_id; an empty one counts). Invalid requests
    do not touch a base: route invalid_input, version unloaded, no results. A valid request that
    names a base which entities does not hold fails the job (unknown="fail"), or gets the route
    unknown_kb and an error code (unknown="mark"). Not whole, results lack the parts named by HEAVY: for
    those who want events, counts or decisions, since Spark drops no field of a collected array.
    """
    if unknown not in ("fail", "mark"):
        raise ValueError(unknown)
    # The whole row is the key: it does not depend on order or retries. Equal rows are told apart by number.
    keyed = requests.withColumn("request_key", retrieve.key(*requests.columns))
    given = with_options(keyed.select("*", "options.*") if "options" in requests.columns else keyed, options)
    checked = given.withColumn("validation_errors", validation_errors())
    named = F.col("kb_id")
    if "inline_kb" in requests.columns:
        brought = F.col("inline_kb").isNotNull()
        named = F.when(brought, F.coalesce("inline_kb.kb_id", F.lit("inline"))).otherwise(named)
        checked = checked.withColumn("base", F.when(brought, F.concat(F.lit("inline:"), "request_key")).otherwise(F.col("kb_id")))
        entities = entities.select(*schemas.ENTITY_COLUMNS).unionByName(inline_entities(checked.filter(brought), "base"))
        owned = F.when(brought, F.size("inline_kb.entities"))
    else:
        checked = checked.withColumn("base", F.col("kb_id"))
        owned = F.lit(None).cast("int")
    checked = checked.withColumn("named", F.coalesce(named, F.lit("unknown"))).withColumn("owned", owned)
    bad = F.size("validation_errors") > 0
    stated = ("top_k", "nil_threshold", "ambiguity_margin")
    # Requests move once, whole; their mentions lie by request from then on, in order, and so are gathered where they are.
    # Short to move and long to answer: the number of tasks is fixed, by their bytes they would be packed into a few.
    dealt = checked.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "request_key")
    numbered = dealt.withColumn("request_copy", F.row_number().over(Window.partitionBy("request_key").orderBy("request_key")))
    document, carried = ("request_key", "request_copy"), ("request_id", "trace_id", "validation_errors", "base", "named", "owned")
    some = numbered.withColumns({"kb_id": F.col("base"), "mentions": F.when(~bad, F.col("mentions"))})
    mentions = explode_requests(some, (*document, *carried, *stated), outer=True)
    place = F.row_number().over(Window.partitionBy(*document).orderBy("pos")) - 1
    mentions = mentions.withColumn("pos", F.when(F.col("pos").isNotNull(), place))
    # Signatures are each once anyway: for them, requests need neither be keyed nor moved.
    alike = explode_requests(checked.filter(~bad).withColumn("kb_id", F.col("base")), stated)
    safe = options if not options.errors() else LinkOptions()
    most_k = retrieve.most_asked(checked) if "options" in requests.columns else safe.top_k
    found = linked(mentions, entities, safe, prior, retriever, rerank.rescore, document, most_k, whole, alike, carried=carried)
    bases = entities.groupBy(F.col("kb_id").alias("base")).agg(F.first("version").alias("kb_version"), F.count("*").alias("entity_count"))
    none = F.array().cast(found.schema["items"].dataType)
    rows = reviewed(found).join(bases, "base", "left")
    rows = rows.withColumn("kb_version", F.when(F.col("owned").isNotNull(), F.lit("inline")).otherwise(F.col("kb_version")))
    rows = rows.withColumn("entity_count", F.coalesce("owned", "entity_count"))
    lost = ~bad & F.col("kb_version").isNull()
    if unknown == "fail":
        # A filter goes with the row, whichever columns are asked for.
        error = F.raise_error(F.concat(F.lit("unknown knowledge base: "), F.col("named"))).cast("boolean")
        rows = rows.filter(F.when(lost, error).otherwise(F.lit(True)))
    route = F.when(bad, F.lit("invalid_input")).when(lost, F.lit("unknown_kb")).otherwise(F.col("route"))
    errors = F.when(lost, F.array(F.concat(F.lit("unknown_knowledge_base:"), F.col("named")))).otherwise(F.col("validation_errors"))
    rows = rows.withColumns(
        {
            "route_decision": route,
            "validation_errors": errors,
            "results": F.when(bad | lost, none).otherwise(F.coalesce("results", none)),
            "kb_version": F.when(bad | lost, F.lit("unloaded")).otherwise(F.col("kb_version")),
        }
    ).withColumn("summary", summary(F.col("results")))
    return rows.select(
        "request_id", "trace_id", F.col("named").alias("kb_id"), "kb_version", F.lit("spark").alias("workflow_engine"), "route_decision", "validation_errors",
        nodes(F.col("route_decision")).alias("graph_nodes"),
        events(F.col("route_decision"), F.col("results"), F.col("summary"), F.col("named"), F.col("entity_count"), F.col("validation_errors")).alias("node_events"),
        public(F.col("results"), whole).alias("results"), "summary", log_of(F.col("results"), F.col("trace_id")).alias("decision_log"), F.lit(True).alias("trace_persisted"),
    )


def unpersisted(responses: DataFrame) -> DataFrame:
    """Responses as they are when their traces could not be written."""
    failed = F.transform("node_events", lambda e: F.struct(e["node"].alias("node"), F.when(e["node"] == "persist_trace", F.to_json(F.struct(F.lit(False).alias("trace_persisted")))).otherwise(e["detail"]).alias("detail")))
    return responses.withColumns({"node_events": failed, "trace_persisted": F.lit(False)})
