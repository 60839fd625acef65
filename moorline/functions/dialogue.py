"""Reading a user's turn: knowledge base, text, mentions and intent, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from moorline.functions.text import clamp, let, strip
from moorline.options import DEFAULT_KB

STRINGS, ALIASES = "array<string>", "map<string,array<string>>"
#: Mention markers in the order in which they are tried.
MARKERS = (
    "mentions是", "mentions为", "mention是", "mention为", "mention:", "mention：", "实体是",
    "实体为", "实体:", "实体：", "指称是", "指称为", "指称:", "指称：",
)
#: Patterns of labelled and quoted texts, of mention clauses and of quoted mentions.
TEXT_LABELS = "(?dU)(?:文本|句子|短句|短文本|链接|分析)[：:]\\s*(.+)$"
TEXT_QUOTES = "(?d)[“\"](.+?)[”\"]"
TEXT_END = "(?U)(?:，|,)?\\s*(?:实体|mention|mentions)[是为:：]"
MENTION_LABELS = ("(?diuU)(?:实体|mention|mentions|指称)[是为:：]\\s*(.+)$", "(?diuU)(?:实体|mention|mentions|指称)\\s+(.+)$")
QUOTED_MENTIONS = "(?d)《(.+?)》|“(.+?)”|\"(.+?)\""
ENDS = " 　。.!！?？"
#: Words of the rules.
ACTIONS = ("update", "run", "reply", "reset", "help", "unknown")
KNOWLEDGE_BASES = ("ccks2019-v1", "sample-energy-v1")
ACCEPTED_CONFIDENCE = 0.45


@dataclass(frozen=True)
class Words:
    """Words that the rules listen for (fixed values); another language gives its own."""

    help: tuple[str, ...] = ("帮助",)
    help_exact: tuple[str, ...] = ("help",)
    run: tuple[str, ...] = ("运行", "开始", "链接", "执行", "分析", "识别")
    reset: tuple[str, ...] = ("清空", "重置", "重新来", "重新开始")
    command: tuple[str, ...] = ("知识库", "ccks", "sample", "实体", "mention", "运行", "帮助", "长文本")
    long_text: tuple[str, ...] = ("长文本",)
    asking: tuple[str, ...] = ("吗", "能", "可以", "支持", "行不行", "只能", "不能")
    general: tuple[str, ...] = ("《", "》", "电影", "导演", "演员", "主演", "歌曲", "小说", "作品", "人物", "地点")
    energy: tuple[str, ...] = ("电网", "国网", "南方电网", "配电", "能源", "风电", "光伏")
    general_kb: tuple[str, ...] = ("2019", "比赛")
    sample_kb: tuple[str, ...] = ("示例", "能源")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def strip_of(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, f"^[{characters}]+|[{characters}]+$", "")


def mention_list(value: Column) -> Column:
    items = F.split(F.translate(value, "，、；;和", ",,,,,"), ",")
    return F.filter(F.transform(items, lambda x: strip_of(x, ENDS)), lambda x: x != "")


def split_clause(text: Column) -> Column:
    """{before, after}: the parts around the first marker of the list that occurs; all and nothing if none does."""
    marks = F.array(*[F.struct(F.instr(text, m).alias("at"), F.lit(len(m)).alias("size")) for m in MARKERS])
    first = F.get(F.filter(marks, lambda m: m["at"] > 0), F.lit(0))

    def cut(m: Column) -> Column:
        head, tail = F.substring(text, F.lit(1), m["at"] - 1), F.substring(text, m["at"] + m["size"], F.length(text))
        return F.struct(F.when(m.isNull(), text).otherwise(strip_of(head, " ，,。")).alias("before"), F.when(m.isNull(), F.lit("")).otherwise(strip(tail)).alias("after"))

    return let(first, cut)


def extracted_text(text: Column) -> Column:
    def cut(value: Column) -> Column:
        return strip(F.get(F.split(strip(value), TEXT_END, 2), F.lit(0)))

    labelled, quoted = cut(F.regexp_extract(text, TEXT_LABELS, 1)), cut(F.regexp_extract(text, TEXT_QUOTES, 1))
    return F.coalesce(F.nullif(labelled, F.lit("")), quoted)


def extracted_mentions(text: Column) -> Column:
    first, second = MENTION_LABELS
    return (
        F.when(F.rlike(text, F.lit(first)), mention_list(F.regexp_extract(text, first, 1)))
        .when(F.rlike(text, F.lit(second)), mention_list(F.regexp_extract(text, second, 1)))
        .otherwise(F.array().cast(STRINGS))
    )


def payload(text: Column) -> Column:
    """{text, mentions} of one utterance."""
    return let(split_clause(text), lambda c: F.struct(extracted_text(c["before"]).alias("text"), F.when(c["after"] != "", mention_list(c["after"])).otherwise(extracted_mentions(text)).alias("mentions")))


def guessed_mentions(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(QUOTED_MENTIONS), F.lit(0))
    inner = F.transform(found, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.slice(F.array_distinct(inner), 1, 5)


def detected_kb(text: Column, words: Words = Words()) -> Column:
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("ccks")) | any_of(text, words.general_kb), F.lit(KNOWLEDGE_BASES[0])).when(any_of(text, words.sample_kb) | F.contains(low, F.lit("sample")), F.lit(KNOWLEDGE_BASES[1]))


def inferred_kb(text: Column, mentions: Column, current: Column, words: Words = Words()) -> Column:
    """Null keeps the current base: only the default one gives way, and not on energy words."""
    joined = F.concat(text, F.lit(" "), F.array_join(mentions, " "))
    return F.when((current == DEFAULT_KB) & ~any_of(joined, words.energy) & any_of(joined, words.general), F.lit(KNOWLEDGE_BASES[0]))


def plain_text(text: Column, words: Words = Words()) -> Column:
    return ~any_of(F.lower(text), tuple(w.lower() for w in words.command)) & (F.length(text) >= 4)


def long_text_question(text: Column, words: Words = Words()) -> Column:
    low = F.lower(text)
    return (any_of(text, words.long_text) | (F.contains(low, F.lit("long")) & F.contains(low, F.lit("text")))) & any_of(text, words.asking)


def alias_texts(mentions: Column, aliases: Column) -> Column:
    return F.array_union(mentions, F.flatten(F.map_values(aliases)))


def located(text: str, mentions: str, aliases: str | None = None) -> Column:
    """Spans of mentions (SQL expressions): each searched behind the one before, else from the start.
    `candidate_aliases` are those that the map `aliases` has for a mention."""
    kind = "array<struct<mention_id:string,text:string,start:int,end:int,candidate_aliases:array<string>>>"
    known = f"coalesce(try_element_at({aliases}, m), cast(array() as array<string>))" if aliases else "cast(array() as array<string>)"
    at = "CASE WHEN locate(m, {t}, s.cursor + 1) > 0 THEN locate(m, {t}, s.cursor + 1) ELSE locate(m, {t}) END - 1".format(t=text)
    return F.expr(
        f"""aggregate({mentions}, named_struct('cursor', 0, 'out', cast(array() as {kind})), (s, m) -> named_struct(
          'cursor', CASE WHEN {at} >= 0 THEN {at} + length(m) ELSE s.cursor END,
          'out', concat(s.out, array(named_struct('mention_id', concat('m', size(s.out) + 1), 'text', m,
             'start', CASE WHEN {at} >= 0 THEN {at} END, 'end', CASE WHEN {at} >= 0 THEN {at} + length(m) END, 'candidate_aliases', {known})))), s -> s.out)"""
    )


def parsed_turn(text: Column, words: Words = Words()) -> Column:
    """What a turn says by itself: kind (help, reply, reset or say), kb_id, text, mentions, run."""
    low = F.lower(text)
    helps = any_of(text, words.help) | low.isin(*words.help_exact)
    kind = F.when(helps, F.lit("help")).when(long_text_question(text, words), F.lit("reply")).when(any_of(text, words.reset), F.lit("reset")).otherwise(F.lit("say"))
    whole = lambda said: F.when(said != "", said).when(plain_text(text, words), text).otherwise(F.lit(""))
    return let(payload(text), lambda p: F.struct(kind.alias("kind"), detected_kb(text, words).alias("kb_id"), whole(p["text"]).alias("text"), p["mentions"].alias("mentions"), any_of(text, words.run).alias("run")))


LONG_TEXT_REPLY = "A text may be of any length; name the mentions to link along with it."
SWITCHED_REPLY = "The knowledge base is switched; a text and its mentions come next."


def rule_action(turn: Column, has_text: Column, has_mentions: Column) -> Column:
    """The action of a parsed turn, given what the dialogue holds already."""
    text, mentions = turn["text"], turn["mentions"]
    some_text, some_mentions = text != "", F.size(mentions) > 0
    ready = (some_text | has_text) & (some_mentions | has_mentions) & (some_text | some_mentions)
    run = turn["run"] | ready
    say = turn["kind"] == "say"
    nothing = turn["kb_id"].isNull() & ~some_text & ~some_mentions & ~run
    action = F.when(~say, turn["kind"]).when(nothing, F.lit("unknown")).when(run, F.lit("run")).otherwise(F.lit("update"))
    switched = say & turn["kb_id"].isNotNull() & ~some_text & ~some_mentions & ~run
    reply = F.when(turn["kind"] == "reply", F.lit(LONG_TEXT_REPLY)).when(switched, F.lit(SWITCHED_REPLY))
    return F.struct(
        action.alias("action"),
        F.when(say, turn["kb_id"]).alias("kb_id"),
        F.when(say & some_text, text).alias("text"),
        F.when(say, mentions).otherwise(F.array().cast(STRINGS)).alias("mentions"),
        F.create_map().cast(ALIASES).alias("mention_aliases"),
        (say & run).alias("run_requested"),
        reply.alias("reply"),
        F.when(say & nothing, F.lit(0.0)).otherwise(F.lit(1.0)).alias("confidence"),
    )


def json_object(content: Column) -> Column:
    """The answer's JSON object as map<string,string>: the whole answer, else from the first { to the last }."""
    kind = "map<string,string>"
    inner = F.regexp_extract(content, "(?s)\\{.*\\}", 0)
    return F.coalesce(F.from_json(content, kind), F.from_json(F.nullif(inner, F.lit("")), kind))


def normalized_action(fields: Column) -> Column:
    """A model's answer made predictable; unknown values become empty ones."""
    return let(fields, normalized_fields)


def normalized_fields(fields: Column) -> Column:
    stated = F.lower(strip(F.coalesce(F.nullif(fields["action"], F.lit("")), F.lit("unknown"))))
    action = F.when(stated.isin(*ACTIONS), stated).otherwise(F.lit("unknown"))
    given = lambda name: F.nullif(strip(fields[name]), F.lit(""))
    clean = lambda values: F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast(STRINGS)), strip), lambda x: x != ""))
    mentions = clean(F.from_json(fields["mentions"], STRINGS))
    raw = F.coalesce(F.from_json(fields["mention_aliases"], "map<string,string>"), F.create_map().cast("map<string,string>"))
    pairs = F.transform(F.map_entries(raw), lambda e: F.struct(strip(e["key"]).alias("key"), clean(F.when(F.startswith(strip(e["value"]), F.lit("[")), F.from_json(e["value"], STRINGS)).otherwise(F.array(e["value"]))).alias("value")))
    pairs = F.transform(pairs, lambda e: F.struct(e["key"].alias("key"), F.filter(e["value"], lambda a: a != e["key"]).alias("value")))
    pairs = F.filter(pairs, lambda e: (e["key"] != "") & (F.size(e["value"]) > 0))
    falsy = F.coalesce(F.lower(strip(fields["run_requested"])), F.lit("")).isin("", "false", "0", "0.0", "null", "[]", "{}")
    return F.struct(
        action.alias("action"),
        F.when(fields["kb_id"].isin(*KNOWLEDGE_BASES), fields["kb_id"]).alias("kb_id"),
        given("text").alias("text"),
        mentions.alias("mentions"),
        F.map_from_entries(pairs).alias("mention_aliases"),
        (~falsy | (action == "run")).alias("run_requested"),
        given("reply").alias("reply"),
        clamp(F.coalesce(fields["confidence"].try_cast("double"), F.lit(0.0))).alias("confidence"),
    )


def accepted(action: Column) -> Column:
    return F.coalesce((action["action"] != "unknown") & (action["confidence"] >= ACCEPTED_CONFIDENCE), F.lit(False))
