"""From questions to evidence-backed context packs, for a frame of questions at once.

A question is linked to entities by exact names and aliases, by trigram similarity of names and by embeddings; its
entities are expanded in the claim graph, and claims, evidence, entities and conflicts are packed into one nested row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.embed import embedded, hashed
from emberline.functions.names import candidate_names
from emberline.operators import graph, trigram
from emberline.session import scratch, stored

CANDIDATES, FUZZY, FALLBACK, THRESHOLD = 10, 3, 2, 0.3


def fuzzy_matches(names: DataFrame, entities: DataFrame, limit: int, threshold: float = THRESHOLD) -> DataFrame:
    """names (question_id, place, name) -> (question_id, place, id, sim): the ``limit`` most similar entities of each.

    Similarity is that of trigram sets, above ``threshold``; names meet entities over their rarest trigrams.
    """
    alike = trigram.similar_names(names, entities.select(F.col("canonical_name").alias("name")), threshold)
    alike = alike.select(F.col("q").alias("name"), F.col("name").alias("canonical_name"), F.col("similarity").alias("sim"))
    sim = names.select("question_id", "place", "name").join(alike, "name").join(entities.select("id", "canonical_name"), "canonical_name")
    first = Window.partitionBy("question_id", "place").orderBy(F.desc("sim"), "id")
    return sim.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit).select("question_id", "place", "id", "sim", "rank")


def nearest(questions: DataFrame, vectors: DataFrame, limit: int, embed: Callable[[list[str]], np.ndarray], block: int = 256) -> DataFrame:
    """(question_id, id, sim, rank): the ``limit`` entities of ``vectors`` (id, embedding) nearest to each question.

    The stated questions go against all vectors, in blocks of ``block`` questions; a task keeps ``limit`` rows a question and batch.
    """
    asked = embedded(questions, "question_id", "question", embed).toArrow()
    spark, parts = questions.sparkSession, []
    kinds = questions.schema["question_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    schema = f"question_id {kinds[0]}, id {kinds[1]}, sim double"
    for at in range(0, asked.num_rows, block):
        part = asked.slice(at, block)
        ids, matrix = part["question_id"].combine_chunks(), np.stack(part["embedding"].to_pylist()).astype(np.float64)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                # vectors of one length lie one behind the other
                rows = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, matrix.shape[1])
                if len(rows) != b.num_rows:
                    raise ValueError("a vector is missing or of another length")
                sims = matrix @ rows.T
                k = min(limit, sims.shape[1])
                best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                q = np.repeat(np.arange(len(ids)), k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), b.column(0).take(pa.array(best.ravel())), pa.array(sims[q, best.ravel()])], ["question_id", "id", "sim"])

        parts.append(vectors.select("id", "embedding").mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    first = Window.partitionBy("question_id").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit)


def link_entities(questions: DataFrame, entities: DataFrame, vectors: DataFrame | None = None, embed: Callable[[list[str]], np.ndarray] = hashed, limit: int = CANDIDATES) -> DataFrame:
    """(question_id, id, link_source, place): at most ``limit`` entities of each question, the first strategy that finds one counts.

    ``questions`` (question_id, question), ``entities`` (id, canonical_name, aliases). Strategies in order: names of the
    question equal to a name or alias, whatever its case; the three most similar names of each; the nearest ten
    ``vectors``; and only where all that finds nothing, the two most similar names of each of its first five words of over
    three letters.
    """
    with scratch(questions.sparkSession) as own:
        # stored, its size is known: it goes to the entities and not they to it
        names = stored(questions.select("question_id", F.posexplode(candidate_names(F.col("question"))).alias("place", "name")), "names")
        every = F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
        known = entities.select("id", F.explode(F.array_distinct(F.transform(every, F.lower))).alias("_name"))
        exact = names.withColumn("_name", F.lower("name")).join(known, "_name")
        exact = exact.select("question_id", "id", F.struct(F.lit(1).alias("step"), "place", F.lit(0).alias("rank"), F.col("id").alias("tie")).alias("at"))
        fuzzy = fuzzy_matches(names, entities, FUZZY).select("question_id", "id", F.struct(F.lit(2).alias("step"), "place", "rank", F.col("id").alias("tie")).alias("at"))
        found = exact.unionByName(fuzzy)
        if vectors is not None:
            near = nearest(questions, vectors, limit, embed)
            found = found.unionByName(near.select("question_id", "id", F.struct(F.lit(3).alias("step"), F.lit(0).alias("place"), "rank", F.col("id").alias("tie")).alias("at")))
        found = stored(found, "linked")
        words = F.slice(F.filter(F.split(F.coalesce("question", F.lit("")), r"\s+"), lambda w: F.length(w) > 3), 1, 5)
        left = questions.join(found.select("question_id").distinct(), "question_id", "left_anti").select("question_id", F.posexplode(words).alias("place", "name"))
        last = fuzzy_matches(left, entities, FALLBACK).select("question_id", "id", F.struct(F.lit(4).alias("step"), "place", "rank", F.col("id").alias("tie")).alias("at"))
        first = found.unionByName(last).groupBy("question_id", "id").agg(F.min("at").alias("at"))
        first = first.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("at"))).filter(F.col("place") <= limit)
        source = F.element_at(F.array(*map(F.lit, ("keyword_exact", "keyword_fuzzy", "embedding", "fallback_fuzzy"))), F.col("at.step"))
        return own.result(first.select("question_id", "id", source.alias("link_source"), "place"), "links")


def context_packs(questions: DataFrame, nodes: DataFrame, edges: DataFrame, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """One nested row a question: question_id, question, entities, claims with their evidence, conflicts, total_evidence_count.

    ``nodes`` and ``edges`` as ``graph.expand`` gives them. A pack is as bounded as the expansion: at most 45 claims an entity of its frontiers.
    """
    summary = nodes.join(entities, nodes["entity_id"] == entities["id"]).groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("hop", F.col("id").alias("entity_id"), "canonical_name", "entity_type", "aliases"))).alias("entities")
    )
    claims = graph.with_names(edges, entities).join(graph.evidence_map(edges, graph.among(evidence, "claim_id", edges.select("claim_id"))), "claim_id")
    body = F.struct("claim_id", "claim_type", F.col("subject_name").alias("subject"), F.col("object_name").alias("object"), "confidence", "valid_from", "valid_to", "is_current", "evidence")
    packed = claims.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("hop", (-F.col("confidence")).alias("_by"), body.alias("claim")))).alias("_claims"), F.sum(F.size("evidence")).alias("total_evidence_count"))
    packed = packed.select("question_id", F.transform("_claims", lambda c: c["claim"]).alias("claims"), "total_evidence_count")
    met = graph.conflicts(claims, "question_id", subject="subject_name", target="object_name")
    met = met.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("a_id", "b_id", "reason"))).alias("conflicts"))
    out = questions.select("question_id", "question").join(summary, "question_id", "left").join(packed, "question_id", "left").join(met, "question_id", "left")
    empty = lambda c: F.coalesce(c, F.array()).alias(c)
    return out.select("question_id", "question", empty("entities"), empty("claims"), empty("conflicts"), F.coalesce("total_evidence_count", F.lit(0)).alias("total_evidence_count"))


def answer(questions: DataFrame, entities: DataFrame, claims: DataFrame, evidence: DataFrame, vectors: DataFrame | None = None, depth: int = 1, include_historical: bool = False, min_confidence: float = 0.5, access: DataFrame | None = None, user: str | None = None) -> DataFrame:
    """Context packs of ``questions`` (question_id, question): linked, expanded and assembled.

    With ``access`` (source_id, user_id) and ``user`` only claims and evidence in sources that the user may read take part.
    """
    if access is not None:
        claims = graph.permitted(claims, evidence, access, user)
        evidence = evidence.join(access.filter(F.col("user_id") == user).select("source_id"), "source_id", "left_semi")
    links = link_entities(questions, entities, vectors)
    nodes, edges = graph.expand(claims, links.select("question_id", F.col("id").alias("entity_id")), depth, include_historical, min_confidence)
    return context_packs(questions, nodes, edges, entities, evidence)
