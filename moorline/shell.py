"""A small command line over the batch API.

    python -m moorline.shell --kb base.json --text "..." --mentions "a,b" [--json]
    python -m moorline.shell --kb base.json --requests requests.jsonl --out traces/
    python -m moorline.shell --kb base.json --dialogue [turns.txt]      # a turn a line; reads the terminal without a file
    python -m moorline.shell --demo

Bases and paths that are not given come from the environment (see options.Settings). A model for
dialogues is given to `talk` by the caller; this command line uses the rules alone.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from moorline import schemas
from moorline.functions.dialogue import mention_list
from moorline.operators import dialogue
from moorline.operators.decide import respond, unpersisted, with_defaults
from moorline.options import DEFAULT_KB, Settings
from moorline.sources.files import persist, read_prior, read_requests
from moorline.sources.kb import Catalog, read_kb, subset

PREVIEW = 300  # characters of the text that a dialogue shows
#: Words that end a dialogue.
EXIT = ("q", "quit", "exit", "退出", "结束", "再见")
DEMO_KB = [("demo", "1", 0, "city:nanjing", "Nanjing", ["Nanking"], "city", ["station", "river"], "", None), ("demo", "1", 1, "city:beijing", "Beijing", ["Peking"], "city", ["capital"], "", None)]
DEMO_TEXT, DEMO_MENTIONS = "The train left Nanking station for the capital Peking.", "Nanking, Peking, Atlantis"


def one_request(spark: SparkSession, text: str, mentions: str, kb_id: str) -> DataFrame:
    """A request whose mentions are found in the text, one behind the other."""
    rows = spark.createDataFrame([("r", 1, kb_id, text, mentions)], "conv_id string, turn int, kb_id string, text string, names string")
    rows = rows.select("conv_id", "turn", "kb_id", "text", mention_list(F.col("names")).alias("mentions"), F.create_map().cast("map<string,array<string>>").alias("aliases"), F.lit(True).alias("runs"))
    return dialogue.run_requests(rows)


def rendered(response: Row) -> str:
    """A response for reading: summary, results with evidence and the first candidates, stages."""
    counts = response.summary
    lines = [
        f"trace {response.trace_id}  route {response.route_decision}  stages {' > '.join(response.graph_nodes)}",
        f"mentions {counts.total_mentions}, linked {counts.linked}, ambiguous {counts.ambiguous}, nil {counts.nil}, to review {counts.review_required}",
    ]
    lines += [f"error: {e}" for e in response.validation_errors]
    for r in response.results:
        lines.append(f"[{r.mention_id}] {r.text}: {r.status} {r.confidence}  {r.canonical_name or '-'} ({r.linked_entity_id or '-'})  {' / '.join(r.evidence.rationale)}")
        lines += [f"    {c.canonical_name} ({c.entity_id}) {c.score}" for c in r.candidates[:5]]
    return "\n".join(lines)


def talk(spark: SparkSession, lines: Iterable[str], link: Callable[[DataFrame, DataFrame], DataFrame], analyse: Callable[[str], str] | None = None) -> Iterator[str]:
    """Replies to the turns of one conversation. link(requests, names) gives the responses of a turn
    that runs, names being what its base may be cut down to; analyse is a model's raw answer to a turn."""
    held: list[tuple] = []
    for line in lines:
        said = line.strip()
        if not said:
            continue
        if said.lower() in EXIT:
            return
        held.append((1, len(held), said))
        turns = spark.createDataFrame(held, "conv_id long, turn int, text string")
        if analyse is not None:
            turns = dialogue.answered(turns, analyse)
        states = dialogue.states(turns).filter(F.col("turn") == len(held) - 1)
        now = states.first()
        reply = f"[{now.action}] base {now.kb_id}, text {now.text[:PREVIEW]!r}, mentions {', '.join(now.mentions) or '-'}"
        if now.missing:
            reply += f"; missing: {now.missing}" + (f" (perhaps {', '.join(now.guessed)})" if now.guessed else "")
        yield reply
        if now.runs:
            yield from (rendered(r) for r in link(dialogue.run_requests(states), dialogue.wanted_names(states)).collect())


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--kb", help="knowledge base document (JSON)")
    parser.add_argument("--prior", help="alias prior document (JSON)")
    parser.add_argument("--text")
    parser.add_argument("--mentions", default="")
    parser.add_argument("--requests", help="JSON lines of requests")
    parser.add_argument("--out", help="trace table to add to")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--demo", action="store_true", help="link a built-in text against a built-in base")
    parser.add_argument("--dialogue", nargs="?", const="-", help="a file of turns, or the terminal")
    args = parser.parse_args(argv)
    spark, settings = SparkSession.builder.appName("moorline").getOrCreate(), Settings.from_env()
    if args.demo:
        entities = spark.createDataFrame(DEMO_KB, schemas.ENTITY)
        args.text, args.mentions = DEMO_TEXT, DEMO_MENTIONS
    elif args.kb:
        entities = read_kb(spark, args.kb, DEFAULT_KB)
    else:
        entities = Catalog(spark, settings.kb_paths, settings.ccks_kb).load(settings.default_kb)
    entities = entities.cache()
    kb_id = entities.first()["kb_id"]
    prior = read_prior(spark, args.prior or settings.prior_path)

    def link(requests: DataFrame, names: DataFrame | None = None) -> DataFrame:
        known = entities if names is None else subset(entities, alias_texts=names)
        ready = with_defaults(requests.withColumn("kb_id", F.lit(kb_id)), settings)
        if not args.requests:  # one request: made once, so that it is not part of every plan
            ready = spark.createDataFrame(ready.collect(), ready.schema)
        return respond(ready, known, settings.options, prior, unknown="mark")

    if args.dialogue:
        lines = sys.stdin if args.dialogue == "-" else open(args.dialogue, encoding="utf-8")
        for reply in talk(spark, lines, lambda requests, _: link(requests)):
            print(reply)
        return 0
    responses = link(read_requests(spark, args.requests) if args.requests else one_request(spark, args.text or "", args.mentions, kb_id))
    if args.out:
        # Trace ids are drawn anew by each run of the plan: write what is shown.
        responses = responses.cache()
        if not persist(responses, args.out):
            print("traces could not be written", file=sys.stderr)
            responses = unpersisted(responses)
        elif args.requests:
            return 0
    for r in responses.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), ensure_ascii=False) if args.json else rendered(r))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
