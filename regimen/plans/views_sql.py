"""The views of testbed.py as DuckDB common table expressions."""

from __future__ import annotations

ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
CATEGORY = "CASE {0} % 4 WHEN 0 THEN 'common_comorbidity' WHEN 1 THEN 'mechanistically_synergistic' WHEN 2 THEN 'other' ELSE 'side_effect_relief' END"

VIEWS = {
    "li": f"SELECT l_orderkey, 'DRUG:' || l_suppkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS rn FROM lineitem",
    "ex": """SELECT o_orderkey AS row_id, list(id ORDER BY rn) AS ids, list(id ORDER BY id) AS ds, 'COND:' || (any_value(o_custkey) % 25) AS cond,
        CASE WHEN any_value(o_orderpriority) IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END AS label,
        CASE WHEN any_value(o_orderpriority) IN ('1-URGENT', '2-HIGH') THEN 'contraindications' ELSE 'indications' END AS source_file,
        array_to_string(list(id ORDER BY id), '|') || '||' || cond AS key
        FROM li JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "dd": "SELECT key, any_value(ds) AS ds, any_value(cond) AS cond, min(label) AS label, min(label) <> max(label) AS conflict FROM ex GROUP BY key",
    "req": "SELECT DISTINCT id FROM (SELECT unnest(list_append(ds, cond)) AS id FROM ex)",
    "known": "SELECT id FROM req WHERE split_part(id, ':', 2)::INT % 7 <> 0",
    "ed": "SELECT DISTINCT 'PART:' || l_partkey AS src, l_returnflag || l_linestatus AS relation, 'SUPP:' || l_suppkey AS dst FROM lineitem",
    "cat": """SELECT 'PART:' || p_partkey AS id, CASE WHEN p_partkey % 11 <> 0 THEN p_type ELSE 'UNKNOWN' END AS category FROM part
        UNION ALL SELECT 'SUPP:' || s_suppkey, CASE WHEN s_suppkey % 13 <> 0 THEN n_name ELSE 'UNKNOWN' END FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "nbr": "SELECT DISTINCT * FROM (SELECT src AS node, dst AS other FROM ed UNION ALL SELECT dst, src FROM ed)",
    "emb": "SELECT CASE label % 3 WHEN 0 THEN 'CHEBI' WHEN 1 THEN 'MONDO' ELSE 'UNII' END || ':' || vec_id AS id, embedding[1:32] AS pca, CASE WHEN vec_id % 9 <> 0 THEN embedding[33:64] END AS topo, vec_id FROM embeddings",
    "vec": "SELECT 'DRUG:' || vec_id AS id, embedding AS vector FROM embeddings UNION ALL SELECT 'COND:' || vec_id, embedding FROM embeddings",
    "pred": "SELECT event_id, (event_type = 'purchase')::INT AS label, least(floor(value / 5) / 100, 1.0) AS prob, (user_id % 7)::INT AS length, (user_id % 5)::INT AS replicate FROM events",
    "pay": f"""SELECT 'DOC:' || doc_id AS key, CASE WHEN doc_id % 10 = 1 THEN 'no json ' || doc_id ELSE '{{"category": "' || CASE WHEN doc_id % 10 = 0 THEN 'unknown' ELSE {CATEGORY.format("doc_id")} END
        || '", "confidence": ' || CASE WHEN doc_id % 10 = 2 THEN '1.5' ELSE '0.' || lpad((doc_id % 100)::VARCHAR, 2, '0') END || ', "rationale_short": "  ' || source || ' ' || lang || ' ", "needs_human_review": '
        || CASE WHEN doc_id % 10 = 3 THEN '"yes"' WHEN toxic = 1 THEN 'true' ELSE 'false' END || '}}' END AS payload FROM labels JOIN documents USING (doc_id)""",
    "lab": f"SELECT *, CASE WHEN row_id % 29 <> 0 THEN {CATEGORY.format('row_id')} END AS category, round(row_id % 61 / 60, 2) AS confidence, CASE WHEN row_id % 23 <> 0 THEN row_id % 9 = 0 END AS review FROM ex",
}
NEEDS = {"ex": ["li"], "dd": ["li", "ex"], "req": ["li", "ex"], "known": ["li", "ex", "req"], "nbr": ["ed"], "lab": ["li", "ex"]}


def sql(views: list[str], select: str) -> str:
    """A statement with the named views and what they need in front; select may begin with more CTEs after a leading comma."""
    wanted = {w for v in views for w in [*NEEDS.get(v, []), v]}
    return "WITH " + ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in VIEWS if v in wanted) + ("\n" if select.lstrip().startswith("SELECT") else "") + select
