"""SQL that the queries of ``browse_queries`` are held against, and the adapters of both.

Each text is over the roles below. Roles are adapters from the star schema: entities, claims, emails and messages; Spark and
DuckDB read them alike, so queries and SQL begin from the same rows and share nothing behind them.
"""

from __future__ import annotations

ROLES = {
    "entities": """
  SELECT concat('c:', CAST(c_custkey AS STRING)) AS id, c_name AS canonical_name, 'Person' AS entity_type FROM customer
  UNION ALL SELECT concat('s:', CAST(s_suppkey AS STRING)), s_name, 'Organization' FROM supplier
  UNION ALL SELECT concat('p:', CAST(p_partkey AS STRING)), p_name, 'Document' FROM part
  UNION ALL SELECT concat('n:', CAST(n_nationkey AS STRING)), n_name, 'Topic' FROM nation
  UNION ALL SELECT concat('r:', CAST(r_regionkey AS STRING)), r_name, 'Topic' FROM region""",
    "claims": """
  SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
      CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), CAST(CAST(l_quantity AS BIGINT) AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING)) AS claim_id,
    concat('c:', CAST(o_custkey AS STRING)) AS subject_id, concat('s:', CAST(l_suppkey AS STRING)) AS object_id,
    CASE WHEN l_linestatus = 'O' THEN CASE l_returnflag WHEN 'A' THEN 'WORKS_AT' WHEN 'N' THEN 'REPORTS_TO' ELSE 'MENTIONS' END
      ELSE CASE l_returnflag WHEN 'A' THEN 'PARTICIPATES_IN' WHEN 'N' THEN 'DISCUSSES' ELSE 'SENT_TO' END END AS claim_type,
    round(1 - 8 * CAST(l_discount AS DOUBLE), 4) AS confidence, l_linestatus = 'O' AS is_current, l_orderkey AS source_id,
    least(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS valid_from,
    CASE WHEN l_linestatus <> 'O' THEN greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) END AS valid_to
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "emails": "SELECT doc_id AS message_id, source AS sender, lang AS folder, coalesce(text, '') AS body FROM documents",
    "messages": """
  SELECT concat(CAST(conv_id AS STRING), ':', CAST(turn AS STRING)) AS message_id, conv_id, turn, role AS sender,
    CASE WHEN turn > 0 THEN concat(CAST(conv_id AS STRING), ':', CAST(turn - 1 AS STRING)) END AS in_reply_to FROM conversations""",
    "ends": "SELECT claim_id, subject_id AS entity_id FROM claims UNION ALL SELECT claim_id, object_id FROM claims WHERE object_id <> subject_id",
}
NEEDS = {"ends": ["claims"]}

TOP = "row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, valid_from DESC, claim_id)"

#: Operator name -> (roles, further CTEs, final SELECT).
OPERATORS: dict[str, tuple[list[str], str, str]] = {
    "f3_exact_match": (["entities"], "", "SELECT id, canonical_name, entity_type FROM entities WHERE canonical_name = 'Customer#000000007' AND entity_type = 'Person'"),
    "f4_entity_by_id": (["entities"], "", "SELECT id, canonical_name, entity_type FROM entities WHERE id = 's:3'"),
    "f5_list_entities": (["entities"], "", "SELECT id, canonical_name FROM entities WHERE entity_type = 'Person' ORDER BY canonical_name, id LIMIT 50 OFFSET 20"),
    "f7_confidence_gate": (["claims"], "", "SELECT claim_id, confidence FROM claims WHERE confidence >= 0.45"),
    "f8_review_queue": (["claims"], "", "SELECT claim_id, subject_id, object_id, confidence FROM claims WHERE confidence < 0.5 ORDER BY confidence, valid_from DESC, claim_id LIMIT 50"),
    "f9_as_of": (["claims"], "", "SELECT claim_id FROM claims WHERE valid_from <= DATE '1996-01-01' AND (valid_to IS NULL OR valid_to > DATE '1996-01-01')"),
    "f11_graph_edges": (["claims"], "", "SELECT claim_id AS id, subject_id AS source, object_id AS target, claim_type AS type, confidence, claim_type AS label FROM claims"),
    "f13_entity_search": (["entities"], "", "SELECT id, canonical_name FROM entities WHERE contains(lower(canonical_name), '00001') ORDER BY canonical_name, id"),
    "f14_confidence_band": (["claims"], "", "SELECT claim_id, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM claims"),
    "f18_check_violations": (["claims"], "", "SELECT claim_id FROM claims WHERE confidence NOT BETWEEN 0 AND 1 OR valid_to < valid_from OR claim_type NOT IN ('WORKS_AT', 'REPORTS_TO', 'MENTIONS', 'PARTICIPATES_IN', 'DISCUSSES', 'SENT_TO')"),
    "j1_unprocessed": (
        [],
        "",
        """SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)
ORDER BY d.n_chars NULLS LAST, d.doc_id LIMIT 200""",
    ),
    "j2_named_claims": (["entities", "claims"], "", "SELECT claim_id, s.canonical_name AS subject_name, claim_type, o.canonical_name AS object_name FROM claims JOIN entities s ON s.id = subject_id JOIN entities o ON o.id = object_id"),
    "j3_evidence_sources": (["claims"], "", "SELECT claim_id, source_id, o_orderpriority AS email_subject, CAST(o_orderdate AS DATE) AS source_date FROM claims LEFT JOIN orders ON o_orderkey = source_id"),
    "j5_visited_entities": (["entities", "claims"], "", "SELECT id, canonical_name FROM entities WHERE id IN (SELECT object_id FROM claims WHERE subject_id = 'c:7')"),
    "j6_top_entities": (
        ["entities", "claims", "ends"],
        ", counts AS (SELECT entity_id, count(*) AS n FROM ends GROUP BY entity_id)",
        "SELECT id, canonical_name, coalesce(n, 0) AS claim_count FROM entities LEFT JOIN counts ON entity_id = id ORDER BY claim_count DESC, id LIMIT 20",
    ),
    "j7_duplicate_claims": (
        ["claims"],
        ", counted AS (SELECT claim_id, subject_id, claim_type, object_id, count(*) OVER (PARTITION BY subject_id, claim_type, object_id) AS n FROM claims)",
        "SELECT claim_id, subject_id, claim_type, object_id FROM counted WHERE n > 1",
    ),
    "j9_reply_edges": (["messages"], "", "SELECT a.message_id AS child, b.message_id AS parent FROM messages a JOIN messages b ON a.in_reply_to = b.message_id"),
    "j13_conflicts": (
        ["claims"],
        "",
        """SELECT a.claim_id AS a_id, b.claim_id AS b_id FROM claims a JOIN claims b
ON a.subject_id = b.subject_id AND a.claim_type = b.claim_type AND a.object_id <> b.object_id AND a.claim_id < b.claim_id
WHERE a.valid_from <= coalesce(b.valid_to, DATE '9999-12-31') AND b.valid_from <= coalesce(a.valid_to, DATE '9999-12-31')""",
    ),
    "u1_table_counts": ([], "", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem"),
    "a1_stats": (["entities", "claims"], "", "SELECT (SELECT count(*) FROM documents) AS emails, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM claims) AS claims, (SELECT count(*) FROM lineitem) AS evidence"),
    "a4_duplicate_groups": (["claims"], "", "SELECT subject_id, claim_type, object_id, count(*) AS n, max(confidence) AS confidence, min(claim_id) AS first_id FROM claims GROUP BY subject_id, claim_type, object_id HAVING count(*) > 1"),
    "a6_thread_rollup": (["messages"], "", "SELECT conv_id, min(message_id) AS thread_id, count(*) AS size, count(DISTINCT sender) AS participants, min(turn) AS first_turn, max(turn) AS last_turn FROM messages GROUP BY conv_id"),
    "a7_exact_dedup": (["emails"], ", ranked AS (SELECT message_id, row_number() OVER (PARTITION BY sender, body ORDER BY message_id) AS k FROM emails)", "SELECT message_id FROM ranked WHERE k = 1"),
    "a8_dedup_stats": (["emails"], ", kept AS (SELECT DISTINCT sender, body FROM emails)", "SELECT (SELECT count(*) FROM emails) AS input, (SELECT count(*) FROM kept) AS after_exact, (SELECT count(*) FROM emails) - (SELECT count(*) FROM kept) AS removed"),
    "a9_thread_stats": (["messages"], ", sizes AS (SELECT conv_id, count(*) AS n FROM messages GROUP BY conv_id)", "SELECT count(*) AS threads, round(avg(n), 6) AS avg_size, max(n) AS max_size FROM sizes"),
    "a10_parse_stats": (["emails"], "", "SELECT count(*) AS total, count(DISTINCT body) AS bodies, count(DISTINCT sender) AS senders FROM emails"),
    "a11_claim_type_counts": (["claims"], "", "SELECT claim_type, count(*) AS n, count(CASE WHEN is_current THEN 1 END) AS current_claims, round(avg(confidence), 4) AS avg_confidence FROM claims GROUP BY claim_type"),
    "a14_log_stats": ([], "", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"),
    "a15_node_degree": (["claims", "ends"], "", "SELECT entity_id, count(*) AS degree, 8 + least(3 * count(*), 24) AS size FROM ends GROUP BY entity_id"),
    "a16_entity_types": (["entities"], "", "SELECT DISTINCT entity_type FROM entities ORDER BY entity_type"),
    "n2_canonical_claim": (["claims"], ", r AS (SELECT claim_id, row_number() OVER (PARTITION BY subject_id, claim_type, object_id ORDER BY confidence DESC, claim_id) AS k FROM claims)", "SELECT claim_id FROM r WHERE k = 1"),
    "n4_window_closing": (
        ["claims"],
        ", n AS (SELECT claim_id, valid_from, lead(valid_from) OVER (PARTITION BY subject_id, claim_type ORDER BY valid_from, claim_id) AS cutoff FROM claims WHERE claim_type IN ('WORKS_AT', 'REPORTS_TO') AND is_current)",
        "SELECT claim_id, valid_from, cutoff AS valid_to, cutoff IS NULL AS is_current FROM n",
    ),
    "t18_entity_text": (["entities"], "", "SELECT id, concat_ws(' ', canonical_name, concat('(', entity_type, ')')) AS text FROM entities"),
    "t19_claim_text": (["entities", "claims"], "", "SELECT claim_id, concat_ws(' ', s.canonical_name, claim_type, o.canonical_name) AS text FROM claims JOIN entities s ON s.id = subject_id JOIN entities o ON o.id = object_id"),
}


def needed(roles: list[str]) -> list[str]:
    """The roles and those that they build on, in order of definition."""
    every = set(roles) | {n for r in roles for n in NEEDS.get(r, [])}
    return [r for r in ROLES if r in every]


def text(name: str) -> str:
    """The whole SQL of an operator."""
    roles, more, select = OPERATORS[name]
    ctes = ", ".join(f"{r} AS ({ROLES[r]})" for r in needed(roles)) + more
    return f"WITH {ctes.removeprefix(', ')}\n{select}" if ctes else select
