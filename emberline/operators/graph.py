"""The memory graph: claims of entities, bounded expansion, evidence maps, conflicts and timelines as DataFrames.

Frames: ``entities`` (id, canonical_name, entity_type, ...), ``claims`` (claim_id, subject_id, object_id, claim_type,
confidence, is_current, valid_from, valid_to, ...), ``evidence`` (claim_id, source_id, source_date, ...). All operators
take many entities or questions at once; a single one is a frame of one row. Joins are on ids and left to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import scratch, stored

LIMIT, PER_TYPE, MAX_DEPTH = 50, 5, 3
#: So many ids at most are looked for by a filter.
FEW = 1000


def best_first() -> list[Column]:
    """The order of claims: most confident, then latest, then smallest id."""
    return [F.desc("confidence"), F.desc_nulls_last("valid_from"), F.asc("claim_id")]


def with_names(claims: DataFrame, entities: DataFrame, how: str = "inner") -> DataFrame:
    """``claims`` with subject_name and object_name; claims with an unknown end are left out (``how`` "left": they have a null there)."""
    s = entities.select(F.col("id").alias("subject_id"), F.col("canonical_name").alias("subject_name"))
    o = entities.select(F.col("id").alias("object_id"), F.col("canonical_name").alias("object_name"))
    return claims.join(s, "subject_id", how).join(o, "object_id", how)


def hashed(entities: DataFrame) -> DataFrame:
    """``entities`` to be joined with a whole table of claims: hashed part by part, so that the claims are never sorted."""
    return entities.hint("shuffle_hash")


def few(ids: DataFrame, most: int = FEW) -> list | None:
    """The different values of the one column of ``ids``, nulls left out, if there are ``most`` at the most; else None.

    A filter by a list moves below the joins and columns that rows are made of, down to where the tables are read; a join does not.
    """
    found = [r[0] for r in ids.distinct().limit(most + 2).collect()]
    some = [x for x in found if x is not None]
    return some if len(some) <= most else None


def among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose ``column`` is among ``ids`` (a stored frame of that one column): few by a filter, more by a semi-join."""
    some = few(ids)
    return rows.join(ids, column, "left_semi") if some is None else rows.filter(F.col(column).isin(some))


def claims_at(claims: DataFrame, asked: DataFrame, on: str = "entity_id") -> DataFrame:
    """Each row of ``asked`` with each claim that has its entity as subject or object, a claim once a row.

    Two equi-joins, one an end. Where few entities are asked for, the claims are filtered first, so that few are made.
    """
    names = [c for c in asked.columns if c != on]
    ids = few(asked.select(on))
    some = {c: claims if ids is None else claims.filter(F.col(c).isin(ids)) for c in ("subject_id", "object_id")}
    ends = [asked.join(met, asked[on] == met[c]).select(asked[on].alias(on), *[asked[n] for n in names], *[met[x] for x in claims.columns]) for c, met in some.items()]
    return ends[0].unionByName(ends[1].filter("subject_id IS DISTINCT FROM object_id"))


def entity_claims(claims: DataFrame, entities: DataFrame, asked: DataFrame, current_only: bool = True, claim_type: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The ``limit`` most confident claims of each entity of ``asked`` (entity_id), with names; the later, then the smaller id first."""
    some = claims.filter("is_current") if current_only else claims
    some = some.filter(F.col("claim_type") == claim_type) if claim_type else some
    ranked = claims_at(some, asked.select("entity_id").distinct()).withColumn("_k", F.row_number().over(Window.partitionBy("entity_id").orderBy(*best_first())))
    return with_names(ranked.filter(F.col("_k") <= limit).drop("_k"), entities)


def diverse(rows: DataFrame, *group: str, limit: int = LIMIT, per_type: int = PER_TYPE) -> DataFrame:
    """Of each group the ``limit`` most confident claims, and of these at most ``per_type`` of one type."""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*best_first()))).filter(F.col("_k") <= limit)
    by_type = Window.partitionBy(*group, "claim_type").orderBy("_k")
    return first.withColumn("_t", F.row_number().over(by_type)).filter(F.col("_t") <= per_type).drop("_k", "_t")


def expand(claims: DataFrame, seeds: DataFrame, depth: int = 1, include_historical: bool = False, min_confidence: float = 0.5, per_type: int = PER_TYPE, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Breadth-first expansion of every question at once: (nodes, edges).

    ``seeds`` (question_id, entity_id). nodes: (question_id, entity_id, hop) with the hop that first met the entity;
    edges: question_id, hop and the claim's columns, each claim once a question, at its first hop. A frontier entity
    contributes ``diverse`` claims. The frontier of the next hop is the new ends: no entity is expanded twice.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must lie in 1 to {MAX_DEPTH}")
    some = claims if include_historical else claims.filter("is_current")
    some = some.filter(F.col("confidence") >= min_confidence)
    with scratch(claims.sparkSession) as own:
        visited = stored(seeds.select("question_id", "entity_id").distinct().withColumn("hop", F.lit(0)), "visited")
        frontier, edges = visited, None
        for hop in range(1, depth + 1):
            met = diverse(claims_at(some, frontier.select("question_id", "entity_id")), "question_id", "entity_id", limit=limit, per_type=per_type)
            met = stored(met.drop("entity_id").dropDuplicates(["question_id", "claim_id"]).withColumn("hop", F.lit(hop)), "met")
            ends = met.select("question_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id")).distinct()
            frontier = stored(ends.join(visited, ["question_id", "entity_id"], "left_anti").withColumn("hop", F.lit(hop)), "frontier")
            visited = visited.unionByName(frontier)
            edges = met if edges is None else edges.unionByName(met.join(edges, ["question_id", "claim_id"], "left_anti").select(*met.columns))
        return own.result(visited, "nodes"), own.result(edges, "edges")


def evidence_map(ids: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, evidence): the evidence of each claim id of ``ids`` by date; a claim without any has an empty list."""
    rest = [c for c in evidence.columns if c not in ("claim_id", "source_date")]
    # ids and evidence in one frame: each is read and shuffled once, and an id that was not asked for is dropped where it is grouped
    held = evidence.filter("claim_id IS NOT NULL").select("claim_id", F.struct("source_date", *rest).alias("_e"), F.lit(False).alias("_asked"))
    asked = ids.select("claim_id", F.lit(None).cast(held.schema["_e"].dataType).alias("_e"), F.lit(True).alias("_asked"))
    found = held.unionByName(asked).groupBy("claim_id").agg(F.array_sort(F.collect_list("_e")).alias("evidence"), F.bool_or("_asked").alias("_asked"))
    return found.filter("_asked").select("claim_id", "evidence")


def degrees(claims: DataFrame) -> DataFrame:
    """(entity_id, claim_count): claims that an entity takes part in."""
    ends = claims.select("claim_id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity_id"))
    return ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("claim_count"))


def graph(claims: DataFrame, entities: DataFrame, center: DataFrame | None = None, depth: int = 2, min_confidence: float = 0.5, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges to draw: around ``center`` (question_id, entity_id), or one hop around the ``top`` entities by claims."""
    if center is None:
        counted = entities.select(F.col("id").alias("entity_id")).join(degrees(claims), "entity_id", "left").withColumn("claim_count", F.coalesce("claim_count", F.lit(0)))
        center, depth = counted.orderBy(F.desc("claim_count"), "entity_id").limit(top).select(F.lit(0).alias("question_id"), "entity_id"), 1
    nodes, edges = expand(claims, center, depth, min_confidence=min_confidence)
    named = nodes.join(entities, nodes["entity_id"] == entities["id"]).select("question_id", "id", F.col("canonical_name").alias("label"), F.col("entity_type").alias("type"), "aliases")
    drawn = edges.select("question_id", F.col("claim_id").alias("id"), F.col("subject_id").alias("source"), F.col("object_id").alias("target"), F.col("claim_type").alias("type"), "confidence", F.col("claim_type").alias("label"))
    return named, drawn


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Whether two closed validity windows meet; a missing bound is open, so a window without bounds meets every other."""
    return F.coalesce(a_from <= b_to, F.lit(True)) & F.coalesce(b_from <= a_to, F.lit(True))


def conflicts(claims: DataFrame, *group: str, subject: str = "subject_id", target: str = "object_id") -> DataFrame:
    """Pairs (a, b) of claims of one subject and type, and one ``group``, with different objects and overlapping windows.

    ``reason`` says so; a has the smaller claim_id.
    """
    a, b = claims.alias("a"), claims.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*group, subject, "claim_type")]
    differ = (F.col(f"a.{target}") != F.col(f"b.{target}")) & (F.col("a.claim_id") < F.col("b.claim_id"))
    meet = overlaps(F.col("a.valid_from"), F.col("a.valid_to"), F.col("b.valid_from"), F.col("b.valid_to"))
    on = same[0]
    for c in same[1:]:
        on = on & c
    reason = F.format_string("Same subject '%s' has conflicting '%s' claims with overlapping time ranges", F.col(f"a.{subject}"), F.col("a.claim_type"))
    return a.join(b, on & differ & meet).select(*[F.col(f"a.{g}").alias(g) for g in group], F.col("a.claim_id").alias("a_id"), F.col("b.claim_id").alias("b_id"), reason.alias("reason"))


def timeline(claims: DataFrame, entities: DataFrame, evidence: DataFrame, asked: DataFrame, historical: bool = True, limit: int = 100) -> DataFrame:
    """The ``limit`` (1 to 500) most confident claims of each entity of ``asked`` (entity_id), by time, with evidence_count."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must lie in 1 to 500")
    with scratch(claims.sparkSession) as own:
        asked = stored(asked.select("entity_id").distinct(), "asked")
        found = stored(entity_claims(claims, entities, asked, current_only=not historical, limit=limit), "found")
        # only the evidence of these claims is counted
        counts = among(evidence, "claim_id", found.select("claim_id")).groupBy("claim_id").agg(F.count(F.lit(1)).alias("evidence_count"))
        found = own.result(found.join(counts, "claim_id", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0))), "timeline")
    return found.orderBy("entity_id", F.asc_nulls_first("valid_from"), "claim_id")


def permitted(claims: DataFrame, evidence: DataFrame, access: DataFrame, user: str) -> DataFrame:
    """The claims with evidence in a source that ``access`` (source_id, user_id) lets the user read."""
    with scratch(claims.sparkSession) as own:
        seen = stored(access.filter(F.col("user_id") == user).select("source_id"), "seen")
        found = own.result(among(evidence, "source_id", seen).select("claim_id").distinct(), "permitted")
    return among(claims, "claim_id", found)


def subgraph(claims: DataFrame, entities: DataFrame, types: list[str], min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The entities of the given types, and the claims of at least this confidence between two of them."""
    kept = entities.filter(F.col("entity_type").isin(types))
    edges = claims.filter(F.col("confidence") >= min_confidence)
    for c in ("subject_id", "object_id"):
        edges = edges.join(kept.select(F.col("id").alias(c)), c, "left_semi")
    return kept, edges


def merge_history(events: DataFrame, target: str) -> DataFrame:
    """Merge events into or from ``target``, latest first. ``events`` (id, target_id, source_ids, created_at, ...)."""
    return events.filter((F.col("target_id") == target) | F.array_contains("source_ids", target)).orderBy(F.desc("created_at"), "id")


def resolve_names(rows: DataFrame, entities: DataFrame, columns: dict[str, str], *scope: str) -> DataFrame:
    """``rows`` with an id column for each name column (``columns``: name column -> id column), by lower-cased names and aliases.

    Of several entities with one name the last by ``seq``, or id where there is none, wins, names and aliases alike.
    With ``scope`` columns (an e-mail, say) names are known only within it. Rows with an unknown name are left out.
    """
    order = "seq" if "seq" in entities.columns else "id"
    every = F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    known = entities.select(*scope, F.explode(F.transform(every, F.lower)).alias("_name"), "id", F.col(order).alias("_at"))
    known = known.groupBy(*scope, "_name").agg(F.max_by("id", "_at").alias("_id"))
    for name, found in columns.items():
        step = known.withColumnRenamed("_id", found)
        rows = rows.withColumn("_name", F.lower(name)).join(step, [*scope, "_name"]).drop("_name")
    return rows
