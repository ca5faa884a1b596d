"""All queries of the subpackage, and SQL for those that SQL can state."""

from __future__ import annotations

from voxmill.llm import p1_repetition, p2_truncation, p3_personal, p4_near_duplicates, p5_neighbours, p6_language, p7_clusters, p8_packing, p9_mixing, p10_abuse
from voxmill.plans.queries import strip_sql

MODULES = (p1_repetition, p2_truncation, p3_personal, p4_near_duplicates, p5_neighbours, p6_language, p7_clusters, p8_packing, p9_mixing, p10_abuse)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}

ORACLES = {
    # Exact search over all pairs of probes and points.
    "p5_found": """
        WITH v AS (
          SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM voc_collection
          WHERE embedding IS NOT NULL AND len(embedding) = (SELECT CAST(embedding_dim AS INT) FROM collection_meta)
        ), u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
        s AS (
          SELECT p.probe_no, b.id, p.k, row_number() OVER (PARTITION BY p.probe_no ORDER BY list_dot_product(a.e, b.e) / (a.n * b.n) DESC, b.id) AS r
          FROM probe_points p JOIN u a ON a.id = p.id JOIN u b ON b.id <> a.id
        )
        SELECT probe_no, id FROM s WHERE r <= k
    """,
    # A word counts as repeated if a stretch of three words that covers it stands earlier too.
    "p1_shares": f"""
        WITH c AS (SELECT case_id, regexp_extract_all(lower(min(verbatim)), '\\p{{L}}+') AS w FROM feedback_raw WHERE {strip_sql("coalesce(case_id, '')")} <> '' AND {strip_sql("coalesce(verbatim, '')")} <> '' GROUP BY case_id),
        g AS (SELECT case_id, i, list_slice(w, i, i + 2) AS g FROM c, range(1, 100000) r(i) WHERE i <= len(w) - 2),
        a AS (SELECT case_id, i FROM (SELECT case_id, i, min(i) OVER (PARTITION BY case_id, g) AS first FROM g) WHERE i > first),
        d AS (SELECT case_id, count(DISTINCT i + o) AS n FROM a, range(0, 3) s(o) GROUP BY case_id)
        SELECT c.case_id, len(c.w) AS n_words, coalesce(d.n, 0) AS n_repeated FROM c LEFT JOIN d ON d.case_id = c.case_id
    """,
    "p8_checks": "SELECT spec_id, (SELECT count(*) FROM documents) AS n_documents, 0 AS n_overfull, 0 AS n_split_without_need, true AS near_bound FROM container_specs",
    "p9_checks": "SELECT mix_id, source, true AS within, true AS hit, false AS repeated_too_often FROM mix_targets",
    # Every pair of distinct texts compared; groups by repeated passing on of the least id.
    "p4_found": """
        WITH RECURSIVE c AS (SELECT case_id, min(verbatim) AS t FROM feedback_raw WHERE regexp_matches(coalesce(case_id, ''), '\\S') AND regexp_matches(coalesce(verbatim, ''), '\\S') GROUP BY case_id),
        w AS (SELECT case_id, list_sort(list_distinct(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+'))) AS ws FROM c),
        k AS (SELECT ws, min(case_id) AS rep, len(ws) AS n FROM w WHERE len(ws) > 0 GROUP BY ws),
        near AS (SELECT a.rep AS a, b.rep AS b FROM k a JOIN k b ON a.rep < b.rep AND a.n >= 0.75 * b.n AND b.n >= 0.75 * a.n WHERE len(list_intersect(a.ws, b.ws)) >= 0.75 * (a.n + b.n - len(list_intersect(a.ws, b.ws)))),
        e AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
        r AS (SELECT rep AS node, rep AS root FROM k UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
        g AS (SELECT node, min(root) AS root FROM r GROUP BY node),
        m AS (SELECT w.case_id, g.root FROM w JOIN k ON k.ws = w.ws JOIN g ON g.node = k.rep)
        SELECT x.case_id AS case_id_a, y.case_id AS case_id_b FROM m x JOIN m y ON x.root = y.root AND x.case_id < y.case_id
    """,
}
