"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

PARTS = r"""i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS u FROM lineitem),
e1 AS (SELECT a.u AS src, b.u AS dst, count(*) AS w FROM i a JOIN i b ON a.o = b.o AND a.u < b.u GROUP BY 1, 2),
c AS (SELECT p_partkey AS node, CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INTEGER) AS cid FROM part)"""
SUPPLIERS = """i AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS u FROM lineitem),
e AS (SELECT a.u AS src, b.u AS dst FROM i a JOIN i b ON a.o = b.o AND a.u < b.u GROUP BY 1, 2),
x AS (SELECT src, dst FROM e JOIN supplier s ON s.s_suppkey = src JOIN supplier t ON t.s_suppkey = dst WHERE s.s_nationkey = t.s_nationkey)"""
BOTH = "ee AS (SELECT src AS u, dst AS v FROM x UNION ALL SELECT dst, src FROM x)"
LABEL = """r(n, l) AS (SELECT DISTINCT u, u FROM ee UNION SELECT ee.v, r.l FROM r JOIN ee ON ee.u = r.n WHERE r.l < ee.v),
lab AS (SELECT n, min(l) AS cid FROM r GROUP BY 1)"""


def parts(rest: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{PARTS}{rest}"


def intra(edges: str) -> str:
    """Edges inside brands, and the labels of their components."""
    return f", x AS (SELECT src, dst FROM {edges} JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.cid = b.cid), {BOTH}, {LABEL}"


SMALL = f"""WITH RECURSIVE {SUPPLIERS}, {BOTH}, {LABEL},
idx AS (SELECT n, cid, row_number() OVER (PARTITION BY cid ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY cid) AS sz FROM lab),
ed AS (SELECT a.cid, a.i AS ai, b.i AS bi FROM x JOIN idx a ON a.n = x.src JOIN idx b ON b.n = x.dst)"""
MINCUT = f"""{SMALL}, masks AS (SELECT DISTINCT cid, sz, unnest(range(1, 1 << (sz - 1)::INTEGER)) * 2 AS m FROM (SELECT DISTINCT cid, sz FROM idx)),
cuts AS (SELECT cid, sz, m, sum((((m >> ai) & 1) <> ((m >> bi) & 1))::INTEGER) AS cut FROM masks JOIN ed USING (cid) GROUP BY 1, 2, 3),
mc AS (SELECT cid AS component, CAST(sz AS BIGINT) AS n_nodes, CAST(min(cut) AS BIGINT) AS cut_size FROM cuts GROUP BY 1, 2)"""
SUBSETS = f"""{SMALL}, comp AS (SELECT DISTINCT cid, sz FROM idx),
sets AS (SELECT cid, unnest(range(1, (1 << sz::INTEGER)::BIGINT)) AS s FROM comp),
subs AS (SELECT cid, s, m FROM (SELECT cid, s, unnest(range(1, s)) AS m FROM sets WHERE bit_count(s) >= 2) WHERE (m & s) = m),
cuts AS (SELECT k.cid, k.s, k.m, sum(((k.s >> ai) & 1) * ((k.s >> bi) & 1) * (((k.m >> ai) & 1) <> ((k.m >> bi) & 1))::INTEGER) AS cut FROM subs k JOIN ed USING (cid) GROUP BY 1, 2, 3),
best AS (SELECT cid, s, min(cut) AS cut, arg_min(m, [cut, CASE WHEN bit_count(m) = 1 THEN 0 ELSE 1 END, m]) AS m FROM cuts GROUP BY 1, 2)"""


def wcc(f: str) -> str:
    """All minimum cuts of all subsets first, then the splits by joins; f(n) of a subset w.s."""
    return f"""{SUBSETS}, w(cid, s) AS (SELECT cid, ((1 << sz::INTEGER) - 1)::BIGINT FROM comp UNION ALL
  SELECT y.cid, y.part FROM (SELECT w.cid, unnest([b.m, w.s - b.m]) AS part FROM w JOIN best b ON b.cid = w.cid AND b.s = w.s
    WHERE NOT ({f} < b.cut)) y WHERE bit_count(y.part) > 1),
fin AS (SELECT w.cid, w.s FROM w JOIN best b ON b.cid = w.cid AND b.s = w.s WHERE {f} < b.cut)
SELECT idx.n AS node, min(idx.n) OVER (PARTITION BY fin.cid, fin.s) AS cluster FROM fin JOIN idx ON idx.cid = fin.cid AND (fin.s >> idx.i) & 1 = 1"""


COMPONENTS = parts(intra("e1") + " SELECT n AS node, cid AS component FROM lab", True)
CC = parts(intra("e1") + " SELECT n AS node, cid AS cluster FROM lab", True)
LOG10, TWICE_LOG10, ROOT = "(1 / ln(10.0::DOUBLE)) * ln(bit_count(w.s)::DOUBLE)", "(2 / ln(10.0::DOUBLE)) * ln(bit_count(w.s)::DOUBLE)", "pow(bit_count(w.s)::DOUBLE, 0.5::DOUBLE)"
#: Brands have 11 to 100 parts here, where 1log_10(n) asks for a cut of 2 and only leaves are cut off: what is left is the 2-core.
CORE_ROUNDS = 12
CORE = parts(
    ", x0 AS (SELECT src, dst FROM e1 JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.cid = b.cid)"
    + "".join(f", k{i} AS (SELECT n FROM (SELECT src AS n FROM x{i} UNION ALL SELECT dst FROM x{i}) GROUP BY 1 HAVING count(*) > 1), x{i + 1} AS (SELECT src, dst FROM x{i} WHERE src IN (SELECT n FROM k{i}) AND dst IN (SELECT n FROM k{i}))" for i in range(CORE_ROUNDS))
    + f", x AS (SELECT * FROM x{CORE_ROUNDS}), {BOTH}, {LABEL} SELECT n AS node, cid AS cluster FROM lab",
    True,
)
PAIRS = "m AS (SELECT a.cid AS c1, b.cid AS c2 FROM {e} JOIN c a ON a.node = src JOIN c b ON b.node = dst), s AS (SELECT c1, c2, count(*) AS n_edges FROM (SELECT c1, c2 FROM m UNION ALL SELECT c2, c1 FROM m WHERE c1 <> c2) GROUP BY 1, 2)"
BRAND_GRAPH = "y AS (SELECT src, dst FROM e1 JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand = b.p_brand OR (a.p_size <= 17 AND b.p_size <= 17))"
SPARSE = "z AS (SELECT c1 AS cid, n_edges AS n FROM s WHERE c1 = c2), p AS (SELECT c1, c2, n_edges, n_edges / (a.n + b.n) AS ratio FROM s JOIN z a ON a.cid = c1 JOIN z b ON b.cid = c2 WHERE c1 < c2 AND a.n / 4 > n_edges AND b.n / 4 > n_edges)"
SUPPLIER_EDGES = "i AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS u FROM lineitem), e AS (SELECT a.u AS src, b.u AS dst, CAST(count(*) AS DOUBLE) AS weight FROM i a JOIN i b ON a.o = b.o AND a.u < b.u GROUP BY 1, 2)"
FIRST = "d AS (SELECT n, row_number() OVER (ORDER BY min(k)) - 1 AS id FROM (SELECT src AS n, [src, dst, 0] AS k FROM e UNION ALL SELECT dst, [src, dst, 1] FROM e) GROUP BY 1)"
LAST = "l AS (SELECT l_suppkey AS s, arg_max(l_partkey, [l_orderkey, l_linenumber, l_partkey]) AS p FROM lineitem GROUP BY 1)"
KL = "CASE WHEN q > 0 AND p > 0 THEN q * ln(q / p) ELSE 0 END + CASE WHEN q < 1 AND p < 1 THEN (1 - q) * ln((1 - q) / (1 - p)) ELSE 0 END"

ORACLE_SQL = {
    "node_dictionary": parts(" SELECT n AS node, row_number() OVER (ORDER BY n) - 1 AS id FROM (SELECT src AS n FROM e1 UNION SELECT dst FROM e1)"),
    "encoded_edges": parts(", d AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS id FROM (SELECT src AS n FROM e1 UNION SELECT dst FROM e1)) SELECT a.id AS src, b.id AS dst FROM e1 JOIN d a ON a.n = src JOIN d b ON b.n = dst"),
    "decoded_clusters": "SELECT s_name AS node, CAST(s_nationkey AS INTEGER) AS cluster_id FROM supplier",
    "last_row_wins": "SELECT l_partkey AS node, arg_max(l_suppkey, l_orderkey * 100 + l_linenumber) AS cluster_id FROM lineitem GROUP BY 1",
    "graph_summary": parts(" SELECT (SELECT count(*) FROM (SELECT src FROM e1 UNION SELECT dst FROM e1)) AS n_nodes, count(*) AS n_edges, CAST(0 AS BIGINT) AS n_loops, CAST(sum(w) AS DOUBLE) AS total_weight FROM e1"),
    "clustering_summary": parts(" SELECT count(DISTINCT cid) AS n_clusters, count(DISTINCT node) AS n_nodes FROM c"),
    "node_degree": parts(" SELECT n AS node, count(*) AS degree FROM (SELECT src AS n FROM e1 UNION ALL SELECT dst FROM e1) GROUP BY 1"),
    "node_strength": parts(" SELECT n AS node, count(*) AS degree, CAST(sum(w) AS DOUBLE) AS strength FROM (SELECT src AS n, w FROM e1 UNION ALL SELECT dst, w FROM e1) GROUP BY 1"),
    "directed_strength": parts(" SELECT n AS node, CAST(sum(i) AS BIGINT) AS degree_in, CAST(sum(1 - i) AS BIGINT) AS degree_out, CAST(sum(i * w) AS DOUBLE) AS strength_in, CAST(sum((1 - i) * w) AS DOUBLE) AS strength_out FROM (SELECT src AS n, 0 AS i, w FROM e1 UNION ALL SELECT dst, 1, w FROM e1) GROUP BY 1"),
    "self_weights": parts(" SELECT CAST(a.cid AS INTEGER) AS node, CAST(sum(w) AS DOUBLE) AS self_weight FROM e1 JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.cid = b.cid GROUP BY 1"),
    "adjacency_list": parts(" SELECT u AS node, array_to_string(list(v ORDER BY v), ',') AS neighbours FROM (SELECT src AS u, dst AS v FROM e1 UNION ALL SELECT dst, src FROM e1) GROUP BY 1"),
    "intra_cluster_edges": parts(" SELECT src, dst, a.cid AS cluster_id FROM e1 JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.cid = b.cid"),
    "inter_cluster_edges": parts(" SELECT src, dst FROM e1 LEFT JOIN c a ON a.node = src LEFT JOIN c b ON b.node = dst WHERE (a.cid = b.cid) IS NOT TRUE"),
    "induced_subgraph": parts(" SELECT src, dst FROM e1 WHERE src IN (SELECT p_partkey FROM part WHERE p_size <= 10) AND dst IN (SELECT p_partkey FROM part WHERE p_size <= 10)"),
    "deleted_nodes": parts(" SELECT src, dst FROM e1 WHERE src NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) AND dst NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)"),
    "degree_one_nodes": parts(intra("e1") + " SELECT cid AS component, min(n) AS node FROM (SELECT u AS n FROM ee GROUP BY 1 HAVING count(*) = 1) JOIN lab USING (n) GROUP BY 1", True),
    "component_sizes": parts(intra("e1") + " SELECT cid AS component, count(*) AS size FROM lab GROUP BY 1", True),
    "cluster_internal_edges": parts(" SELECT a.cid AS cluster_id, count(*) AS n_edges FROM e1 JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.cid = b.cid GROUP BY 1"),
    "cluster_pair_edges": parts(f", {PAIRS.format(e='e1')} SELECT * FROM s"),
    "sparse_cluster_pairs": parts(f", {BRAND_GRAPH}, {PAIRS.format(e='y')}, {SPARSE} SELECT c1, c2, n_edges, round(ratio, 6) AS ratio FROM p"),
    "restored_edges": parts(f", {BRAND_GRAPH}, {PAIRS.format(e='y')}, {SPARSE} SELECT src, dst FROM y JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.cid = b.cid OR EXISTS (SELECT 1 FROM p WHERE c1 = least(a.cid, b.cid) AND c2 = greatest(a.cid, b.cid))"),
    "collapse_graph": parts(" SELECT least(a.cid, b.cid) AS src, greatest(a.cid, b.cid) AS dst, CAST(sum(w) AS DOUBLE) AS weight FROM e1 JOIN c a ON a.node = e1.src JOIN c b ON b.node = e1.dst GROUP BY 1, 2"),
    "collapsed_sizes": parts(" SELECT cid AS node, CAST(count(*) AS DOUBLE) AS size FROM c GROUP BY 1"),
    "graph_nodes": parts(", q AS (SELECT a.cid, CAST(sum(w) AS DOUBLE) AS w FROM e1 JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.cid = b.cid GROUP BY 1) SELECT CAST(c.cid AS INTEGER) AS node, CAST(count(*) AS DOUBLE) AS size, coalesce(max(q.w), 0) AS self_weight FROM c LEFT JOIN q USING (cid) GROUP BY 1"),
    "graph_density": parts(", n AS (SELECT count(*) AS k FROM (SELECT src FROM e1 UNION SELECT dst FROM e1)) SELECT k AS n_nodes, m AS n_edges, t AS total_weight, round(CASE WHEN k > 1 THEN 2 * t / (k::DOUBLE * (k - 1)) ELSE 0 END, 9) AS density FROM n, (SELECT count(*) AS m, CAST(sum(w) AS DOUBLE) AS t FROM e1)"),
    "modularity": parts(", m AS (SELECT count(*)::DOUBLE AS m FROM e1), k AS (SELECT cid, count(*) AS k FROM (SELECT src AS n FROM e1 UNION ALL SELECT dst FROM e1) JOIN c ON c.node = n GROUP BY 1), w AS (SELECT a.cid, count(*) AS w FROM e1 JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.cid = b.cid GROUP BY 1) SELECT round(sum(coalesce(w, 0) / m - pow(k / (2 * m), 2)), 6) AS modularity FROM k LEFT JOIN w USING (cid), m"),
    "cpm_quality": parts(", k AS (SELECT cid, count(*)::DOUBLE AS n FROM c GROUP BY 1), w AS (SELECT a.cid, count(*) AS w FROM e1 JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.cid = b.cid GROUP BY 1) SELECT round(sum(coalesce(w, 0) - 0.01::DOUBLE * n * (n - 1) / 2), 6) AS cpm FROM k LEFT JOIN w USING (cid)"),
    "cluster_partition_assignment": parts(" SELECT cid AS cluster_id, CAST(floor((row_number() OVER (ORDER BY cid) - 1) / ceil(count(*) OVER () / 4.0)) AS BIGINT) AS part FROM (SELECT DISTINCT cid FROM c)"),
    "rank_displacements": parts(" SELECT rank, n, CAST(coalesce(sum(n) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM (SELECT cid AS rank, count(*) AS n FROM c GROUP BY 1)"),
    "kl_divergence": f"SELECT l_linenumber, round(sum(k), 4) AS kl, round(sum(CASE WHEN q < p THEN -k ELSE k END), 4) AS kll FROM (SELECT l_linenumber, q, p, {KL} AS k FROM (SELECT l_linenumber, l_discount AS q, l_tax AS p FROM lineitem)) GROUP BY 1",
    "telemetry_totals": "SELECT op, round(sum(w), 4) AS wall_s, CAST(sum(b) AS BIGINT) AS bytes, max(n) AS most_steps FROM (SELECT event_type AS op, user_id % 8 AS st, sum(value) AS w, sum(length(props)) AS b, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
    "criterion_flags": "SELECT p_partkey + 1 AS n, CAST(p_size % 6 AS BIGINT) AS cut, (1 / ln(10.0::DOUBLE)) * ln(n::DOUBLE) < cut AS log10, (1 / ln(2.0::DOUBLE)) * ln(n::DOUBLE) < cut AS log2, (2 / ln(10.0::DOUBLE)) * ln(n::DOUBLE) < cut AS twice_log10, 0.1::DOUBLE * pow(n::DOUBLE, 0.5::DOUBLE) < cut AS sqrt, false AS simple FROM part",
    "connected_components_by_task": COMPONENTS,
    "connected_components_by_star": COMPONENTS,
    "mincut_value": f"{MINCUT} SELECT * FROM mc",
    "well_connected_flag": f"{MINCUT} SELECT component, n_nodes, cut_size, cut_size >= 1 AS connected, (1 / ln(10.0::DOUBLE)) * ln(n_nodes::DOUBLE) < cut_size AS log10, (2 / ln(10.0::DOUBLE)) * ln(n_nodes::DOUBLE) < cut_size AS twice_log10 FROM mc",
    "cc_clusters": CC,
    "cc_numbered": parts(intra("e1") + " SELECT n AS node, dense_rank() OVER (ORDER BY cid) - 1 AS cluster FROM lab", True),
    "wcc_log10": wcc(LOG10),
    "wcc_2log10": wcc(TWICE_LOG10),
    "wcc_2log10_rounds": wcc(TWICE_LOG10),
    "wcc_sqrt": wcc(ROOT),
    "wcc_copurchase": CORE,
    "cut_sides": f"{SUBSETS}, b AS (SELECT cid, s, m, sz FROM best JOIN comp USING (cid) WHERE s = (1 << sz::INTEGER) - 1), z AS (SELECT cid, CASE WHEN 2 * bit_count(m) < sz OR (2 * bit_count(m) = sz AND (m & 1) = 1) THEN m ELSE s - m END AS m FROM b) SELECT cid AS component, n AS node, CAST(1 - ((m >> i) & 1) AS INTEGER) AS side FROM z JOIN idx USING (cid)",
    "out_neighbours": parts(" SELECT src AS node, dst AS other FROM e1"),
    "in_neighbours": parts(" SELECT dst AS node, src AS other FROM e1"),
    "incident_edges": f"WITH {SUPPLIER_EDGES} SELECT src AS node, dst AS other, src, dst, weight FROM e UNION ALL SELECT dst, src, src, dst, weight FROM e",
    "density_variants": parts(", q AS (SELECT least(a.cid, b.cid) AS s, greatest(a.cid, b.cid) AS t, sum(w) AS w FROM e1 JOIN c a ON a.node = src JOIN c b ON b.node = dst GROUP BY 1, 2), k AS (SELECT count(*) AS n FROM (SELECT s FROM q UNION SELECT t FROM q)), v AS (SELECT * FROM (VALUES (false), (true)) a(loops), (VALUES (false), (true)) b(directed)) SELECT loops, directed, n AS n_nodes, n * (n - 1) / 2.0::DOUBLE + CASE WHEN loops THEN n ELSE 0 END AS possible, round(CASE WHEN directed THEN 1 ELSE 2 END * t / (n * CASE WHEN loops THEN n ELSE n - 1 END)::DOUBLE, 9) AS density FROM v, k, (SELECT CAST(sum(w) AS DOUBLE) AS t FROM q)"),
    "ordered_communities": parts(", q AS (SELECT cid AS id, count(*) AS size, max(p_size) AS third FROM c JOIN part ON p_partkey = node GROUP BY 1) SELECT id, size, third, row_number() OVER (ORDER BY size DESC, third DESC, id) - 1 AS place FROM q"),
    "sniffed_delimiters": "SELECT * FROM (VALUES ('comma', ','), ('tab', chr(9)), ('space', ' ')) v(file, delimiter)",
    "read_edge_file": f"WITH {SUPPLIER_EDGES} SELECT 's' || src AS src, 's' || dst AS dst FROM e",
    "read_edge_dictionary": f"WITH {SUPPLIER_EDGES}, {FIRST} SELECT 's' || n AS node, id FROM d",
    "read_weighted_edges": f"WITH {SUPPLIER_EDGES} SELECT 's' || src AS src, 's' || dst AS dst, weight FROM e",
    "read_clusters": f"WITH {LAST} SELECT 's' || s AS node, CAST(p AS INTEGER) AS cluster_id FROM l",
    "read_cluster_ints": f"WITH {LAST} SELECT s AS node, CAST(p AS INTEGER) AS cluster_id FROM l",
    "read_clusters_reindexed": f"WITH {LAST}, f AS (SELECT l_partkey AS p, row_number() OVER (ORDER BY min([l_orderkey, l_linenumber, l_partkey, l_suppkey])) - 1 AS id FROM lineitem GROUP BY 1) SELECT 's' || s AS node, id AS cluster_id FROM l JOIN f USING (p)",
    "encoded_clusters": f"WITH {SUPPLIER_EDGES}, {FIRST} SELECT id AS node, CAST(s_nationkey AS INTEGER) AS cluster_id FROM d JOIN supplier ON s_suppkey = n",
    "written_clusters": parts(" SELECT node AS node_id, dense_rank() OVER (ORDER BY low) - 1 AS cluster_id FROM (SELECT node, min(node) OVER (PARTITION BY cid) AS low FROM c)"),
    "written_partition_map": parts(" SELECT node, cid AS cluster_id FROM c"),
}
RULES = "SELECT 0::BIGINT AS repeated, 0::BIGINT AS spanning, 0::BIGINT AS small_or_misnamed, 0::BIGINT AS in_parts"
ORACLE_SQL |= {f"rules_of_{name}": RULES + ", 0::BIGINT AS weak" for name in ("wcc_2log10_parts", "cm_leiden_cpm", "cm_leiden_mod", "cm_louvain")}
ORACLE_SQL |= {f"rules_of_{name}": RULES for name in ("leiden_cpm", "leiden_mod")}
