"""Candidate retrieval: exact alias join, and best-first fuzzy search for what it leaves.

What can be found depends on the base, the list of queries (text and expansions) and top_k alone, so
each distinct such list is asked once, `q` being its key, and what it finds is one array. All that
depends on the list and the entity alone is worked out there too; types and contexts come in only
when candidates are scored. Nothing is counted or collected while a plan is built, but exact hits are
stored: Spark broadcasts a side where its own size estimate or, once it ran, its size allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorline.functions.similarity import AliasMatcher
from moorline.functions.text import clamp, han_characters, normalize, query_texts, round_binary
from moorline.options import exact_cap, fuzzy_cap
from moorline.scratch import shared_folder, stored
from moorline.sources.kb import alias_index, aliases

FUZZY_ALIASES = 4096  # about so many aliases of a base are searched at once,
FUZZY_LISTS = 64  # for about so many lists of queries
LIST = ("text", "kb_id", "candidate_aliases", "top_k")  # what can be found depends on
FOUND = "array<struct<entity_ord:bigint,matched_alias:string,similarity:double>>"


def key(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def mark(*columns: str) -> Column:
    """A hash that is cheap enough for every mention; `key` is for what is there once."""
    return F.xxhash64(*columns)


def marked(unique: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows that differ in `columns`, with their `mark` and, for those that share it with others, the
    columns themselves (`asks`)."""
    shared = F.count("*").over(Window.partitionBy("mark")) > 1
    return unique.withColumn("mark", mark(*columns)).withColumn("asks", F.when(shared, F.struct(*columns)))


def meet(rows: DataFrame, facts: DataFrame, columns: tuple[str, ...], how: str = "inner") -> DataFrame:
    """rows with the facts of the marked row that their `columns` state. Every row has one there, so an
    unshared mark tells which; where several share it, the columns are compared."""
    own = F.struct(*[F.col(f"r.{c}").alias(c) for c in columns])
    met = (F.col("r.mark") == F.col("f.mark")) & (F.col("f.asks").isNull() | F.col("f.asks").eqNullSafe(own))
    kept = [c for c in facts.columns if c not in ("mark", "asks")]
    return rows.withColumn("mark", mark(*columns)).alias("r").join(facts.alias("f"), met, how).select(*[f"r.{c}" for c in rows.columns], *[f"f.{c}" for c in kept])


def with_key(rows: DataFrame) -> DataFrame:
    """rows and `q`, the key of what can be found for them."""
    return rows.withColumn("q", key(*LIST))


def listed(rows: DataFrame) -> DataFrame:
    """The distinct lists of rows as these state them, with `q` and marks to meet rows by."""
    return marked(with_key(rows.select(*LIST).distinct()), LIST)


def asked(rows: DataFrame) -> DataFrame:
    """(q, kb_id, queries, top_k), each q once."""
    # Keys are made of what is left of many rows.
    unique = rows if "asks" in rows.columns and "sig" not in rows.columns else with_key(rows.select(*LIST).distinct())
    return unique.select("q", "kb_id", query_texts(F.col("text"), F.col("candidate_aliases")).alias("queries"), "top_k")


def most_asked(lists: DataFrame) -> int:
    return max(1, lists.agg(F.max("top_k")).first()[0] or 1)


def exact(lists: DataFrame, entities: DataFrame, most_k: int, index: DataFrame | None = None) -> DataFrame:
    """(q, found): the entities that have one of the queries as an alias, in order of query and
    entity, the first exact_cap(top_k) of them. most_k is the greatest top_k of lists. `index`, where
    it is given, is the base's alias index for that most_k or a greater one (see `sources.index`)."""
    if index is None:
        index = alias_index(entities, exact_cap(most_k)).select("kb_id", "norm", "entity_ord")
    single = lists.select("q", "kb_id", "top_k", F.posexplode("queries").alias("query_ord", "query")).withColumn("norm", normalize(F.col("query"))).filter("norm != ''")
    pairs = single.join(index, ["kb_id", "norm"])
    # At most the index's cap for each query.
    rows = pairs.groupBy("q", "top_k").agg(F.array_sort(F.collect_list(F.struct("entity_ord", "query_ord", "query"))).alias("hits"))
    once = F.filter("hits", lambda x, i: (i == 0) | (x["entity_ord"] != F.get(F.col("hits"), i - 1)["entity_ord"]))
    rows = rows.select("q", "top_k", F.array_sort(F.transform(once, lambda x: F.struct(x["query_ord"], x["entity_ord"], x["query"]))).alias("hits"))
    found = F.transform(F.slice("hits", F.lit(1), exact_cap(F.col("top_k"))), lambda x: F.struct(x["entity_ord"].alias("entity_ord"), x["query"].alias("matched_alias"), F.lit(1.0).alias("similarity")))
    return rows.select("q", found.cast(FOUND).alias("found"))


def hits(lists: DataFrame, entities: DataFrame, most_k: int, index: DataFrame | None = None) -> DataFrame:
    """`exact`, stored: fuzzy search asks more than once which lists are left. Its job runs here."""
    return stored(exact(lists, entities, most_k, index), shared_folder(lists.sparkSession), "hits")


def unmatched(lists: DataFrame, found: DataFrame) -> DataFrame:
    return lists.join(found.select("q"), "q", "left_anti")


def fuzzy(lists: DataFrame, entities: DataFrame, most_entities: int | None = None) -> DataFrame:
    """(q, found): the fuzzy_cap(top_k) best entities by similarity.

    All aliases of a base that share a character with any of its query lists lie in blocks by entity,
    its lists in parts; each block meets each part, where an index of characters bounds the similarity
    of every alias to every list and only the best bounds are matched. What the blocks found for a list
    is merged: an entity that is among the best of all is among the best of its block. A task holds one
    block and one part at a time. With most_entities, bases of more entities are not searched.
    """
    texts = F.filter(F.transform("queries", normalize), lambda x: x != "")
    work = lists.select("q", "kb_id", fuzzy_cap(F.col("top_k")).cast("int").alias("keep"), texts.alias("texts")).filter(F.size("texts") > 0)
    # A row for each character of a list, and one without any for the list itself.
    characters = work.select("kb_id", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(F.split(F.array_join("texts", ""), "")))).alias("c"))
    bases = characters.groupBy("kb_id").agg(F.array_join(F.array_sort(F.collect_set("c")), "").alias("letters"), F.ceil(F.count_if(F.col("c").isNull()) / FUZZY_LISTS).alias("parts"))
    n = F.size(F.coalesce("aliases", F.array().cast("array<string>"))) + 1
    sizes = entities.groupBy("kb_id").agg(F.count("*").alias("n"), F.ceil(F.sum(n) / FUZZY_ALIASES).alias("blocks"))
    if most_entities is not None:
        sizes = sizes.filter(F.col("n") <= most_entities)
    bases = bases.join(sizes, "kb_id").select("kb_id", "letters", "parts", "blocks")
    names = aliases(entities.join(bases, "kb_id"), ("letters", "blocks"))
    # Without a common character the similarity is 0, which is below the floor.
    names = names.filter("length(translate(norm, letters, '')) < length(norm)")
    beside = names.groupBy("kb_id", F.pmod(F.xxhash64("entity_ord"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("entity_ord", "alias_ord", "alias", "norm")).alias("names"))
    dealt = work.join(bases.select("kb_id", "parts"), "kb_id").groupBy("kb_id", F.pmod(F.xxhash64("q"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("q", "texts", "keep")).alias("lists"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("entity_ord", pa.int64()), ("matched_alias", pa.string()), ("similarity", pa.float64())]))
        held, matcher = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = tuple(row.select(["kb_id", "block"]).to_pylist()[0].values())
                if block != held:
                    held, matcher = block, AliasMatcher([tuple(n.values()) for n in row.column("names").to_pylist()[0]])
                asked = row.column("lists").to_pylist()[0]
                found = [[{"entity_ord": e, "matched_alias": a, "similarity": s} for e, s, a in matcher.best(x["texts"], x["keep"])] for x in asked]
                yield pa.RecordBatch.from_arrays([pa.array([x["q"] for x in asked], pa.string()), pa.array([x["keep"] for x in asked], pa.int32()), pa.array(found, kind)], names=["q", "keep", "found"])

    # Few bytes, but long to search: dealt in turn to all partitions, so they are not left to be packed into a few tasks.
    # A block's parts come one after the other.
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.pmod(F.pmod(F.xxhash64("kb_id"), F.lit(tasks)) + F.col("part") + F.col("block"), F.lit(tasks))
    met = dealt.join(beside, "kb_id").repartitionById(tasks, turn.cast("int")).sortWithinPartitions("kb_id", "block")
    parted = met.select("kb_id", "block", "lists", "names").mapInArrow(search, f"q string, keep int, found {FOUND}").filter(F.size("found") > 0)
    every = F.flatten(F.collect_list("found"))
    ranked = F.array_sort(F.transform(every, lambda x: F.struct((-round_binary(clamp(x["similarity"]), 3)).alias("rank"), x["entity_ord"].alias("entity_ord"), x.alias("c"))))
    merged = parted.groupBy("q").agg(F.max("keep").alias("keep"), ranked.alias("found"))
    return merged.select("q", F.transform(F.slice("found", F.lit(1), F.col("keep")), lambda x: x["c"]).cast(FOUND).alias("found"))


def candidates(lists: DataFrame, entities: DataFrame, most_k: int, index: DataFrame | None = None) -> DataFrame:
    """(q, found): exact hits, or fuzzy ones for lists without any; lists that find nothing give no row."""
    found = hits(lists, entities, most_k, index)
    return found.unionByName(fuzzy(unmatched(lists, found), entities))


def known(found: DataFrame, lists: DataFrame, entities: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(q, found) with all that a list's candidates need for scoring but types and contexts: the
    entity's columns, the rounded similarity, how the name was met, the learned prior."""
    single = found.join(lists.select("q", "kb_id", "queries"), "q").select("q", "kb_id", "queries", F.posexplode("found").alias("place", "c"))
    single = single.select("q", "kb_id", "queries", (F.col("place") + 1).alias("retrieval_rank"), "c.entity_ord", "c.matched_alias", "c.similarity")
    rows = single.join(entities.select("kb_id", "entity_ord", "entity_id", "canonical_name", "entity_type", "keywords", "description"), ["kb_id", "entity_ord"])
    mention = normalize(F.get("queries", F.lit(0)))
    rows = rows.withColumns({"mention": mention, "matched": normalize(F.col("matched_alias"))})
    expansions = F.transform(F.slice("queries", 2, 10_000), normalize)
    kind = (
        F.when((F.col("matched") != F.col("mention")) & F.array_contains(expansions, F.col("matched")), F.lit("llm_alias_expansion"))
        .when(F.col("matched") == F.col("mention"), F.lit("exact_or_alias_match"))
        .otherwise(F.lit("fuzzy_alias_match"))
    )
    value = F.lit(0.0)
    if prior is not None:  # its key is the mention's own text, never an expansion
        learned = prior.select(F.col("norm_mention").alias("mention"), "entity_id", F.col("prior").alias("learned"))
        rows, value = rows.join(learned, ["mention", "entity_id"], "left"), F.coalesce("learned", F.lit(0.0))
    facts = {
        "retrieval_rank": F.col("retrieval_rank"), "entity_ord": F.col("entity_ord"), "entity_id": F.col("entity_id"), "canonical_name": F.col("canonical_name"), "entity_type": F.col("entity_type"), "keywords": F.col("keywords"),
        "described": normalize(F.coalesce("description", F.lit(""))), "matched_alias": F.col("matched_alias"), "alias_similarity": round_binary(clamp(F.col("similarity")), 3), "kind": kind, "same_name": F.col("mention") == normalize(F.col("canonical_name")), "prior": value,
    }
    return rows.groupBy("q").agg(F.array_sort(F.collect_list(F.struct(*[c.alias(n) for n, c in facts.items()]))).alias("found"))


def build(found: DataFrame, signatures: DataFrame, entities: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """A row for each candidate of each signature, with the entity's columns, the rounded similarity
    and the first reasons; `retrieved` counts the signature's candidates."""
    facts = known(found, asked(signatures), entities, prior)
    named = signatures.select("sig", "q", "top_k", F.col("entity_type").alias("mention_type"), "context", han_characters(F.col("context")).alias("characters"))
    # Arrays are short to move and long to score: they are dealt evenly before they are exploded, by the
    # key that ranking and decisions go by, so that scored rows move no more. The number is fixed: by
    # their bytes they would be packed into a few tasks, and a key is one row, so none is skewed.
    parts = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = named.join(facts, "q").repartition(parts, "sig").withColumn("retrieved", F.size("found"))
    single = wanted.select("sig", "top_k", "mention_type", "context", "characters", "retrieved", F.inline("found"))
    aligned = F.coalesce((F.col("mention_type") != "") & (F.col("mention_type") == F.col("entity_type")), F.lit(False))
    return single.withColumns({"type_aligned": aligned, "reasons": F.array_compact(F.array("kind", F.when(aligned, F.lit("entity_type_aligned"))))})
