"""Entity resolution: entities that share an address are one, then names of one type that are alike merge greedily.

``entities``: id, canonical_name, entity_type, aliases array<string>, properties map<string,string>. Results are the
canonical entities and the merge events (merged_from, merged_into, reason, confidence, reversed).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.names import WEIGHTS, email_addresses, name_parts, similarity
from emberline.operators import nameparts
from emberline.operators.components import connected_components
from emberline.session import scratch, stored

THRESHOLD, BY_ADDRESS = 0.82, 0.95
MOST = 1 << 18  # pairs of a group that one task decides


def _plain(entities: DataFrame) -> DataFrame:
    none, nothing = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    return entities.select(F.col("id").cast("string").alias("id"), "canonical_name", "entity_type", F.coalesce("aliases", none).alias("aliases"), F.coalesce("properties", nothing).alias("properties"))


def shared_addresses(entities: DataFrame) -> DataFrame:
    """(address, id) of every address that more than one entity has in its aliases or name."""
    each = entities.select("id", F.explode(email_addresses(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("canonical_name")))).alias("address")).distinct()
    many = each.groupBy("address").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("address")
    return each.join(many, "address")


def absorbed(entities: DataFrame, into: DataFrame) -> DataFrame:
    """Entities of one ``canonical_id`` (id, canonical_id, place) as one row, of the entity that gave the id.

    It takes the aliases and names of all, and of each property the value of the first by ``place`` that has it.
    """
    rows = entities.join(into, "id")
    own = rows.filter("id = canonical_id").select("canonical_id", "canonical_name", "entity_type")
    names = F.when(F.col("id") != F.col("canonical_id"), F.array_append("aliases", F.col("canonical_name"))).otherwise(F.col("aliases"))
    aliases = rows.select("canonical_id", F.explode(names).alias("alias")).groupBy("canonical_id").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    first = rows.select("canonical_id", "place", F.explode("properties")).groupBy("canonical_id", "key").agg(F.min_by("value", "place").alias("value"))
    properties = first.groupBy("canonical_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("properties"))
    out = own.join(aliases, "canonical_id", "left").join(properties, "canonical_id", "left")
    return _plain(out.withColumnRenamed("canonical_id", "id"))


def merge_by_address(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical entities, events): entities tied by shared addresses are one, under the longest name, of equal ones the smallest id."""
    with scratch(entities.sparkSession) as own:
        rows = stored(_plain(entities), "entities")
        shared = stored(shared_addresses(rows), "addresses")
        hubs = shared.groupBy("address").agg(F.min("id").alias("v"))
        tied = connected_components(shared.join(hubs, "address").select(F.col("id").alias("u"), "v")).withColumnRenamed("node", "id")
        order = Window.partitionBy("component").orderBy(F.desc(F.length("canonical_name")), "id")
        into = rows.join(tied, "id", "left").select("id", "canonical_name", F.coalesce("component", "id").alias("component"))
        into = into.withColumn("place", F.row_number().over(order)).withColumn("canonical_id", F.first("id").over(order))
        into = stored(into.select("id", "canonical_id", "place"), "into")
        why = shared.groupBy("id").agg(F.min("address").alias("address"))
        events = into.filter("id != canonical_id").join(why, "id")
        events = events.select(F.col("id").alias("merged_from"), F.col("canonical_id").alias("merged_into"), F.concat(F.lit("email_address_match:"), "address").alias("reason"), F.lit(BY_ADDRESS).alias("confidence"), F.lit(False).alias("reversed"))
        return own.result(absorbed(rows, into), "by-address"), own.result(events, "events")


def similar_pairs(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, sim): entities of one type, a < b, with a name alike: name to name, or a name to an alias of the other.

    Names of a single part never reach the threshold of 0.7 or more, so both have a first and a last one. No pair is lost: with d =
    1 - threshold, the last or the first names of a pair have a ratio of 1 - d / 0.6 or more (or one first name begins the
    other), since these two weigh 0.6; and where the last names have less, the whole names have more than 1 - 1.25 * d. Each
    different pair of names that meets so is compared once.
    """
    if threshold < 0.7:
        raise ValueError("names of one part are not paired: the threshold must be 0.7 or more")
    d = 1 - threshold
    least, whole = 1 - d / (WEIGHTS[1] + WEIGHTS[2]), 1 - d / 2 / WEIGHTS[0]
    with scratch(entities.sparkSession) as own:
        main = entities.select("id", "entity_type", F.col("canonical_name").alias("name"), F.lit(True).alias("main"))
        also = entities.select("id", "entity_type", F.explode("aliases").alias("name"), F.lit(False).alias("main"))
        rows = main.unionByName(also).filter("name IS NOT NULL").withColumn("p", name_parts(F.col("name"))).filter("p.last != '' AND p.first != ''")
        rows = stored(rows, "names")
        names = stored(rows.select("entity_type", "name", F.length("name").alias("n"), "p.first", "p.last").distinct(), "parts")
        parts = lambda c: names.select(F.col(c).alias("part"))
        same = lambda c: parts(c).distinct().select(F.col("part").alias("x"), F.col("part").alias("y"))

        def met_by(part: str, alike: DataFrame) -> DataFrame:
            """Pairs of names whose parts are a pair of ``alike``."""
            x = names.select("entity_type", F.col("name").alias("a"), F.col("n").alias("m"), F.col(part).alias("x"))
            y = names.select("entity_type", F.col("name").alias("b"), "n", F.col(part).alias("y"))
            found = alike.join(x, "x").join(y, ["entity_type", "y"]).filter("x != y OR a <= b")
            return found.select("entity_type", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "m", "n")

        lasts = nameparts.similar_parts(parts("last"), least).unionByName(same("last"))
        firsts = nameparts.similar_parts(parts("first"), least).unionByName(nameparts.begun(parts("first"))).unionByName(same("first")).distinct()
        # the shorter name bounds what whole names share
        by_first = met_by("first", firsts).filter(2 * F.least("m", "n") >= (F.col("m") + F.col("n")) * whole - 1e-9)
        met = met_by("last", lasts).unionByName(by_first).select("entity_type", "x", "y").distinct()

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sims = [similarity(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sims, pa.float64())], ["entity_type", "x", "y", "sim"])

        alike = stored(met.mapInArrow(compare, "entity_type string, x string, y string, sim double").filter(F.col("sim") >= threshold), "alike")
        both = alike.unionByName(alike.filter("x != y").select("entity_type", F.col("y").alias("x"), F.col("x").alias("y"), "sim"))
        a = rows.select("entity_type", F.col("name").alias("x"), F.col("id").alias("a"), F.col("main").alias("am"))
        b = rows.select("entity_type", F.col("name").alias("y"), F.col("id").alias("b"), F.col("main").alias("bm"))
        pairs = both.join(a, ["entity_type", "x"]).join(b, ["entity_type", "y"]).filter("a < b AND (am OR bm)")
        return own.result(pairs.groupBy("a", "b").agg(F.max("sim").alias("sim")), "pairs")


def _in_order(group: pd.DataFrame) -> pd.DataFrame:
    """The merges of one group, one after the other."""
    gone, out = set(), []
    for r in group.sort_values(["sim", "a", "b"], ascending=[False, True, True]).itertuples():
        if r.a in gone or r.b in gone:
            continue
        stays, goes = (r.a, r.b) if r.na >= r.nb else (r.b, r.a)
        gone.add(goes)
        out.append((goes, stays, r.sim))
    return pd.DataFrame(out, columns=["goes", "stays", "sim"])


def greedy_merges(pairs: DataFrame, most: int = MOST, rounds: int = 8) -> DataFrame:
    """(goes, stays, sim): what merging ``pairs`` (a, b, sim, na, nb) in order of similarity, then a and b, gives.

    A pair merges while both are there; the longer name stays (of equal ones a). A pair that is first among the open ones at both its
    ends merges whatever happens elsewhere, so each round merges all such pairs at once and drops the pairs of what went. That
    is exact, and breaks large groups up; a connected group of ``most`` pairs or fewer is decided in one task. Groups are looked for again
    after every ``rounds`` rounds.
    """
    with scratch(pairs.sparkSession) as own:
        open_, found = stored(pairs, "open"), []
        while True:
            tied = connected_components(open_.select(F.col("a").alias("u"), F.col("b").alias("v")))
            work = stored(open_.join(tied.select(F.col("node").alias("a"), "component"), "a"), "work")
            size = work.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
            work = work.join(size, "component")
            found.append(stored(work.filter(F.col("_n") <= most).select("component", "a", "b", "sim", "na", "nb").groupBy("component").applyInPandas(_in_order, "goes string, stays string, sim double"), "merged"))
            open_ = stored(work.filter(F.col("_n") > most).select("a", "b", "sim", "na", "nb"), "open")
            for _ in range(rounds):
                if open_.isEmpty():
                    break
                key = F.struct((-F.col("sim")).alias("s"), "a", "b").alias("key")
                keyed = open_.select("*", key)
                first = keyed.select(F.explode(F.array("a", "b")).alias("node"), "key").groupBy("node").agg(F.min("key").alias("first"))
                at = lambda end: first.select(F.col("node").alias(end), F.col("first").alias(f"_{end}"))
                lead = keyed.join(at("a"), "a").join(at("b"), "b").filter((F.col("_a") == F.col("key")) & (F.col("_b") == F.col("key")))
                a_stays = F.col("na") >= F.col("nb")
                merged = stored(lead.select(F.when(a_stays, F.col("b")).otherwise(F.col("a")).alias("goes"), F.when(a_stays, F.col("a")).otherwise(F.col("b")).alias("stays"), "sim"), "merged")
                found.append(merged)
                gone = lambda end: merged.select(F.col("goes").alias(end))
                open_ = stored(open_.join(gone("a"), "a", "left_anti").join(gone("b"), "b", "left_anti"), "open")
            if open_.isEmpty():
                break
        return own.result(reduce(DataFrame.unionByName, found), "merges")


def merge_by_name(entities: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(canonical entities, events): the most similar pairs merge first while both are there, the longer name stays (of equal ones a).

    Similarities are not recomputed.
    """
    with scratch(entities.sparkSession) as own:
        rows = stored(_plain(entities), "entities")
        pairs = stored(similar_pairs(rows, threshold), "pairs")
        size = rows.select("id", F.length("canonical_name").alias("n"))
        merged = greedy_merges(pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").select("a", "b", "sim", "na", "nb"))
        reason = F.format_string("fuzzy_name_%.2f", "sim")
        events = stored(merged.select(F.col("goes").alias("merged_from"), F.col("stays").alias("merged_into"), reason.alias("reason"), F.col("sim").alias("confidence"), F.lit(False).alias("reversed")), "events")
        # who absorbed whom is a forest; a survivor may itself go later, so its members follow it to the root
        links = events.select(F.col("merged_from").alias("u"), F.col("merged_into").alias("v"))
        tree = connected_components(links)
        roots = tree.join(links.select(F.col("u").alias("node")), "node", "left_anti").select("component", F.col("node").alias("canonical_id"))
        into = rows.select("id").join(tree.join(roots, "component").select(F.col("node").alias("id"), "canonical_id"), "id", "left")
        into = into.select("id", F.coalesce("canonical_id", "id").alias("canonical_id"))
        into = into.join(events.select(F.col("merged_from").alias("id"), (-F.col("confidence")).alias("by")), "id", "left")
        into = into.select("id", "canonical_id", F.struct(F.when(F.col("id") == F.col("canonical_id"), F.lit(-2.0)).otherwise(F.col("by")).alias("by"), "id").alias("place"))
        return own.result(absorbed(rows, into), "by-name"), own.result(events, "events")


def resolve(entities: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(canonical entities, merge events): first by address, then by name."""
    first, events = merge_by_address(entities)
    last, more = merge_by_name(first, threshold)
    return last, events.unionByName(more)


def mapping(events: DataFrame) -> DataFrame:
    """(source_id, canonical_id) of every entity that was merged, followed to the one that is left; reversed events do not count."""
    links = events.filter(~F.col("reversed")).select(F.col("merged_from").alias("u"), F.col("merged_into").alias("v"))
    tree = connected_components(links)
    roots = tree.join(links.select(F.col("u").alias("node")), "node", "left_anti").select("component", F.col("node").alias("canonical_id"))
    return tree.join(roots, "component").filter("node != canonical_id").select(F.col("node").alias("source_id"), "canonical_id")
