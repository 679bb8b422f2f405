"""Entities and claims by id, by exact name or alias, by a part of a name; the texts that are embedded for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The properties that an entity's text names, in this order.
TOLD = ("role", "title", "department", "description")


def names(entities: DataFrame) -> Column:
    """The canonical name and the aliases, as they are written, without nulls and repeats."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.array_union(F.array(entities["canonical_name"]), F.coalesce(entities["aliases"], none))))


def by_id(rows: DataFrame, asked: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose ``key`` is among those of ``asked`` (a column of the same name), each once however often it is asked for; null ids find nothing."""
    return rows.join(asked.select(key).distinct(), key, "left_semi")


def by_name(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(name, and the columns of ``entities``): for each different name of ``asked`` the entities that have it as name or alias.

    Case counts. Where ``asked`` has a column entity_type, a row of it asks for that type only (null: for any). Null names find nothing.
    """
    kind = F.col("entity_type") if "entity_type" in asked.columns else F.lit(None).cast("string")
    # a name that is asked for without a type is asked for with every type
    want = asked.groupBy(F.col("name").alias("_name")).agg(F.bool_or(kind.isNull()).alias("_any"), F.collect_set(kind).alias("_types"))
    found = entities.withColumn("_name", F.explode(names(entities))).join(want, "_name")
    found = found.filter(F.col("_any") | F.array_contains("_types", F.col("entity_type")))
    return found.select(F.col("_name").alias("name"), *entities.columns)


def search(entities: DataFrame, term: str, types: Sequence[str] | None = None) -> DataFrame:
    """The entities of these types with ``term`` in their name or an alias, whatever the case; a blank term finds all. By name."""
    found = entities if types is None else entities.filter(F.col("entity_type").isin(*types))
    part = term.lower()
    if part.strip():
        found = found.filter(F.exists(names(found), lambda n: F.contains(F.lower(n), F.lit(part))))
    return found.orderBy(F.asc_nulls_first("canonical_name"), "id")


def entity_text(entities: DataFrame) -> Column:
    """Name, type, aliases and the told properties; what is null or missing is left out, but for an empty name or type."""
    blank = lambda c: F.coalesce(entities[c], F.lit(""))
    aliases = F.array_join(entities["aliases"], ", ")
    also = F.when(F.size(F.coalesce(entities["aliases"], F.array())) > 0, F.concat(F.lit("also known as: "), aliases))
    told = [F.concat(F.lit(f"{key}: "), F.try_element_at(entities["properties"], F.lit(key))) for key in TOLD]
    return F.concat_ws(" ", blank("canonical_name"), F.concat(F.lit("("), blank("entity_type"), F.lit(")")), also, *told)


def claim_text(claims: DataFrame) -> Column:
    """Subject, type, object (subject_name, claim_type, object_name; null: empty) and every property, in the map's order; null values are left out."""
    ends = [F.coalesce(claims[c], F.lit("")) for c in ("subject_name", "claim_type", "object_name")]
    every = F.transform(F.map_entries(claims["properties"]), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws(" ", *ends, F.array_compact(every))
