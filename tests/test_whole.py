"""That operators do their whole job: brute force that shares no text with the query."""

import itertools

import duckdb
import numpy as np
import pyarrow.parquet as pq
from emberline.plans import catalog, graph_sql

from tests.helpers import SF


def test_conflicts_of_every_claim_type(spark):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    claims = con.execute(f"WITH claims AS ({graph_sql.ROLES['claims']}) SELECT subject_id, claim_type, claim_id, object_id, CAST(valid_from AS STRING), coalesce(CAST(valid_to AS STRING), '9999') FROM claims ORDER BY ALL").fetchall()
    want, types = set(), set()
    for (_, kind), group in itertools.groupby(claims, key=lambda r: r[:2]):
        for a, b in itertools.combinations(group, 2):
            if a[3] != b[3] and a[4] <= b[5] and b[4] <= a[5]:
                want.add(tuple(sorted((a[2], b[2]))))
                types.add(kind)
    assert len(types) > 1
    assert {tuple(sorted(r)) for r in catalog.queries()["j13_conflicts"](spark, SF).collect()} == want


def test_knn_of_every_hundredth_vector(spark, monkeypatch):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    ids, e = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    want = set()
    for k in np.flatnonzero(ids % 100 == 0):
        near = sorted((-round(float(x), 6), int(i)) for x, i in zip(e @ e[k], ids, strict=True) if i != ids[k])[:10]
        want |= {(int(ids[k]), i) for _, i in near}
    assert len({q for q, _ in want}) > 1
    monkeypatch.setattr(catalog, "ROW_BLOCK", 64)
    monkeypatch.setattr(catalog, "QUERY_BLOCK", 2)
    assert {(r.query_id, r.vec_id) for r in catalog.queries()["v2_knn"](spark, SF).collect()} == want


def test_trigram_search_of_every_hundredth_part(spark):
    parts = {r["p_partkey"]: r["p_name"] for r in pq.read_table(f"{SF}/part.parquet").to_pylist()}
    grams = lambda x: {f"  {w} "[i : i + 3] for w in x.split() for i in range(len(w) + 1)}
    want = set()
    for q in [k for k in parts if k % 100 == 0]:
        a = grams(parts[q])
        like = [(-round(len(a & b) / len(a | b), 6), k) for k, x in parts.items() if k != q for b in [grams(x)]]
        want |= {(q, k) for s, k in sorted(like)[:10] if s < -0.3}
    assert want
    assert {(r.query_id, r.id) for r in catalog.queries()["v3_trigram_search"](spark, SF).collect()} == want


def test_near_pairs_name_every_document(spark, tmp_path):
    text = "the same words of one text stand here"
    rows = [(5, text), (3, text), (4, text + "s"), (9, "else"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.kind, r.a, r.b) for r in catalog.queries()["j8_near_pairs"](spark, str(tmp_path)).collect()}
    assert got == {("pair", 3, 4)} | {("member", a, b) for a, b in [(3, 3), (3, 5), (4, 4), (9, 9), (7, 7)]}
