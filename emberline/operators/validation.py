"""Answers of a model against the schema and against their messages, as columns.

An answer is a VARIANT. Its entities and claims are taken apart by array functions, each with a flag that says whether it fits; claims
then stand in rows of their own, where joins of conditions decide what happens to them, and go back into their message.
Only excerpts that a message holds neither exactly nor but for white space are compared in Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.names import collapse, partial_ratio_at_least
from emberline.session import scratch, stored

#: Kinds of entities and claims, bounds, and the reasons of events.
ENTITY_TYPES = ("Person", "Organization", "Project", "Topic", "Document", "Meeting")
CLAIM_TYPES = ("WORKS_AT", "REPORTS_TO", "PARTICIPATES_IN", "DISCUSSES", "DECIDED", "MENTIONS", "SENT_TO", "REFERENCES_DOC", "SCHEDULED")
MIN_CONFIDENCE, CLOSE, LONGEST_NAME = 0.4, 0.9, 500
UNREADABLE, UNFIT, UNFIT_ITEM, RENAMED, UNSURE, UNFOUND, PASSED = (
    "json_parse_failure", "schema_validation_failure", "partial_recovery_failed", "name_normalized", "below_confidence_threshold", "evidence_not_found", "validated",
)
#: Fixed value: JSON between fences.
FENCE = r"(?s)```(?:json)?\s*(.*?)```"
RESULT = "is_valid boolean, entities array<struct<name:string,type:string,aliases:array<string>,properties:map<string,string>>>, claims array<struct<type:string,subject:string,object:string,properties:map<string,string>,excerpt:string,confidence:double,start:int,end:int>>, events array<struct<action:string,target:string,reason:string,detail:string>>"
FIELDS = ["is_valid", "entities", "claims", "events"]


def json_text(raw: Column) -> Column:
    """The JSON in an answer: a fenced block, else a text that begins with a brace, else the first to the last brace, else all."""
    cut = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    between = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(F.regexp_like(raw, F.lit(FENCE)), cut(F.regexp_extract(raw, FENCE, 1))).when(cut(raw).startswith("{"), cut(raw)).when(between != "", between).otherwise(raw)


def iso_date(text: Column) -> Column:
    """The instant of an ISO date text, Z meaning UTC; what cannot be read is null."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def title(text: Column) -> Column:
    """Every run of letters with a capital first letter and small others (``initcap`` looks at blanks alone)."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def person_name(name: Column) -> Column:
    """A name in title case, what stands behind the first comma in front; white space collapsed."""
    return collapse(title(F.regexp_replace(name, r"(?s)^([^,]*),(.*)$", "$2 $1")))


def entity_name(name: Column, kind: Column) -> Column:
    return F.when(kind == "Person", person_name(name)).otherwise(collapse(name))


def _kind(v: Column, path: str) -> Column:
    """STRING, OBJECT<..>, ARRAY<..> and so on; null where nothing is there."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, name: str) -> Column:
    """The text at a key; null if it is anything else."""
    return F.when(_kind(v, f"$.{name}") == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def _list(v: Column, name: str) -> Column:
    """The items at a key; null if it is there and no list."""
    kind = _kind(v, f"$.{name}")
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(v, f"$.{name}", "array<variant>")).when(kind.isNull(), F.array().cast("array<variant>"))


def _properties(v: Column) -> Column:
    """Properties as texts; null if they are no object."""
    kind = _kind(v, "$.properties")
    held = F.try_variant_get(v, "$.properties", "map<string,variant>")
    plain = F.transform_values(held, lambda _, x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x)))
    return F.when(kind.startswith("OBJECT"), plain).when(kind.isNull(), F.create_map().cast("map<string,string>"))


def _aliases(v: Column) -> Column:
    """Aliases cut at both ends, the first of those that differ in case alone; null if they are no list of texts."""
    kind = _kind(v, "$.aliases")
    texts = F.when((kind == "ARRAY<STRING>") | (kind == "ARRAY<VOID>"), F.try_variant_get(v, "$.aliases", "array<string>")).when(kind.isNull(), F.array().cast("array<string>"))
    some = F.filter(F.transform(texts, lambda a: F.regexp_replace(a, r"^\s+|\s+$", "")), lambda a: a != "")
    return F.filter(some, lambda a, i: F.array_position(F.transform(some, lambda x: F.lower(x)), F.lower(a)) == i + 1)


def _within(x: Column, least: int, most: int) -> Column:
    return F.coalesce(F.length(x).between(least, most), F.lit(False))


def _entity(v: Column) -> Column:
    name, kind, aliases, properties = _text(v, "name"), _text(v, "type"), _aliases(v), _properties(v)
    fits = _within(name, 1, LONGEST_NAME) & F.coalesce(kind.isin(*ENTITY_TYPES), F.lit(False)) & aliases.isNotNull() & properties.isNotNull()
    return F.struct(collapse(name).alias("name"), kind.alias("type"), aliases.alias("aliases"), properties.alias("properties"), fits.alias("fits"), F.left(F.to_json(v), F.lit(200)).alias("raw"))


def _claim(v: Column) -> Column:
    kind, subject, object_, excerpt, properties = _text(v, "type"), _text(v, "subject"), _text(v, "object"), _text(v, "evidence_excerpt"), _properties(v)
    sure = F.when(_kind(v, "$.confidence") != "BOOLEAN", F.try_variant_get(v, "$.confidence", "double"))
    most = 2**31 - 1
    fits = F.coalesce(kind.isin(*CLAIM_TYPES) & sure.between(0, 1), F.lit(False)) & properties.isNotNull()
    fits = reduce(lambda a, b: a & _within(b, 1, most), (subject, object_, excerpt), fits)
    return F.struct(kind.alias("type"), collapse(subject).alias("subject"), collapse(object_).alias("object"), properties.alias("properties"), excerpt.alias("excerpt"), sure.alias("confidence"), fits.alias("fits"), F.left(F.to_json(v), F.lit(200)).alias("raw"))


def _event(action: str, target: str, reason: Column | str, detail: Column | str = "") -> Column:
    plain = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(action).alias("action"), F.lit(target).alias("target"), plain(reason).alias("reason"), F.coalesce(plain(detail), F.lit("")).alias("detail"))


def parsed(answers: DataFrame) -> DataFrame:
    """(message_id, body, readable, whole, entities, claims) of (message_id, raw_response, body), the items with their flags."""
    v = F.try_parse_json(json_text(F.coalesce("raw_response", F.lit(""))))
    rows = answers.select("message_id", F.coalesce("body", F.lit("")).alias("body"), v.alias("v"))
    lists = rows.select("*", _list(F.col("v"), "entities").alias("e"), _list(F.col("v"), "claims").alias("c"), F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("object"))
    none = F.array().cast("array<variant>")
    items = lists.select("message_id", "body", F.col("v").isNotNull().alias("readable"), (F.col("object") & F.col("e").isNotNull() & F.col("c").isNotNull()).alias("lists"), F.transform(F.coalesce("e", none), _entity).alias("entities"), F.transform(F.coalesce("c", none), _claim).alias("claims"))
    bad = F.exists("entities", lambda x: ~x["fits"]) | F.exists("claims", lambda x: ~x["fits"])
    return items.select("message_id", "body", "readable", (F.col("lists") & ~bad).alias("whole"), "entities", "claims")


def _placed(claims: DataFrame) -> DataFrame:
    """``claims`` (excerpt, body) with found, start and end: exactly, but for white space, or but for a tenth of the characters."""
    at = F.expr("locate(excerpt, body)")
    short, long = collapse(F.col("excerpt")), collapse(F.col("body"))
    exact = F.when(at > 0, at - 1)
    rows = claims.withColumn("start", exact).withColumn("end", exact + F.length("excerpt")).withColumn("found", (at > 0) | F.contains(long, short))
    names = rows.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [partial_ratio_at_least(x, y, CLOSE) for x, y in zip(b["_short"].to_pylist(), b["_long"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names if c != "found"), pa.array(near, pa.bool_())], [*(c for c in names if c != "found"), "found"])

    left = rows.filter("NOT found").withColumn("_short", short).withColumn("_long", long)
    shape = left.select(*[c for c in names if c != "found"], "found").schema
    return rows.filter("found").unionByName(left.mapInArrow(compare, shape))


def validated(rows: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(message_id, is_valid, entities, claims, events) of rows (message_id, raw_response, body), one row a message_id.

    Where something does not fit the schema, what fits is kept. Claims stay if their ends are names or aliases of the answer's entities
    (in any case), with ``min_confidence`` or more and an excerpt that the message holds. Names are normalised, those of claims' ends
    too. Valid answers have an entity. Events tell what was dropped, repaired or passed, in that order of steps. Nulls count as empty texts.
    """
    with scratch(rows.sparkSession) as own:
        items = stored(parsed(rows), "parsed")
        fit = lambda c: F.filter(c, lambda x: x["fits"])
        unfit = lambda c, target: F.transform(F.filter(c, lambda x: ~x["fits"]), lambda x: _event("dropped", target, UNFIT_ITEM, x["raw"]))
        named = F.transform(fit("entities"), lambda e: F.struct(entity_name(e["name"], e["type"]).alias("name"), e["type"].alias("type"), e["aliases"].alias("aliases"), e["properties"].alias("properties"), e["name"].alias("was")))
        known = F.flatten(F.transform(fit("entities"), lambda e: F.transform(F.array_append(e["aliases"], e["name"]), lambda x: F.lower(x))))
        base = items.select("message_id", "body", "readable", "whole", named.alias("named"), known.alias("known"), fit("claims").alias("fitting"), F.concat(unfit("entities", "entity"), unfit("claims", "claim")).alias("unfit"))

        each = base.select("message_id", "body", "known", "named", F.posexplode("fitting").alias("place", "c")).filter(F.array_contains("known", F.lower("c.subject")) & F.array_contains("known", F.lower("c.object")))

        def renamed(end: str) -> Column:
            """The end of a claim as its entity is named now; of entities of one name the last counts."""
            met = F.filter("named", lambda e: (F.lower(e["was"]) == F.lower(f"c.{end}")) & (e["was"] != e["name"]))
            return F.coalesce(F.try_element_at(met, F.lit(-1))["name"], F.col(f"c.{end}")).alias(end)

        each = each.select("message_id", "body", "place", "c.type", renamed("subject"), renamed("object"), "c.properties", "c.excerpt", "c.confidence")
        sure = each.filter(F.col("confidence") >= min_confidence)
        unsure = each.filter(F.col("confidence") < min_confidence).withColumn("start", F.lit(None).cast("int")).withColumn("end", F.lit(None).cast("int")).withColumn("found", F.lit(False))
        judged = _placed(sure).unionByName(unsure)
        event = F.when(F.col("confidence") < min_confidence, _event("dropped", "claim", UNSURE, F.col("type"))).when(~F.col("found"), _event("dropped", "claim", UNFOUND, F.left("excerpt", F.lit(100)))).otherwise(_event("passed", "claim", PASSED, F.col("type")))
        claim = F.when(F.col("found"), F.struct("type", "subject", "object", "properties", "excerpt", "confidence", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))
        # properties are a map, which has no order; the place decides before it would be asked for
        back = judged.select("message_id", F.struct("place", event.alias("event"), claim.alias("claim")).alias("x")).groupBy("message_id").agg(F.collect_list("x").alias("x"))
        back = back.select("message_id", F.array_sort("x", lambda a, b: a["place"] - b["place"]).alias("x"))
        whole = base.join(back, "message_id", "left")

        nothing = F.array().cast(RESULT.split("events ")[1])
        repaired = F.transform(F.filter("named", lambda e: e["name"] != e["was"]), lambda e: _event("repaired", "entity", RENAMED, e["was"]))
        judgements = F.coalesce(F.transform("x", lambda y: y["event"]), nothing)
        events = F.when(~F.col("readable"), F.array(_event("dropped", "extraction", UNREADABLE))).otherwise(F.concat(F.when(~F.col("whole"), F.array(_event("dropped", "extraction", UNFIT))).otherwise(nothing), F.col("unfit"), repaired, judgements))
        kept = F.coalesce(F.filter(F.transform("x", lambda y: y["claim"]), lambda c: c.isNotNull()), F.array().cast(RESULT.split("claims ")[1].split(", events")[0]))
        entities = F.transform("named", lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), e["aliases"].alias("aliases"), e["properties"].alias("properties")))
        return own.result(whole.select("message_id", (F.size("named") > 0).alias("is_valid"), entities.alias("entities"), kept.alias("claims"), events.alias("events")), "validated")


def validation_counts(results: DataFrame) -> DataFrame:
    """(message_id, dropped, repaired, passed): events of each message by action."""
    count = lambda what: F.size(F.filter("events", lambda e: e["action"] == what)).alias(what)
    return results.select("message_id", count("dropped"), count("repaired"), count("passed"))
