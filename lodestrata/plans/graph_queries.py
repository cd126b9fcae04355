"""Queries over the knowledge graph, the CRUD matrix, seams and the dependency graph, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.tables import cut
from lodestrata.operators import crud, depgraph, graph, metrics
from lodestrata.plans.estate import CALLS_SQL, CLUSTER_EDGES_SQL, EDGES_SQL, LAYERED_EDGES_SQL, MATRIX_SQL, NODES_SQL, SEAMS_SQL, UNIT_EDGES_SQL, cluster_edges, kg_edges, kg_nodes, layered_edges, service_calls, table, unit_edges, units

KINDS = ["dataset", "file", "sql_block", "txn", "unknown"]
_matrix = lambda s, d: crud.crud_matrix(kg_nodes(s, d), kg_edges(s, d))
#: Without evidence, and written once, for questions that ask it twice.
_facts = lambda s, d: cut(_matrix(s, d).drop("evidence"))
_flags = "program, kind, name, create_, read_, update_, delete_, touches_only, n_evidence, symbol"


def _seam_scores(s, d):
    m = _facts(s, d)
    return crud.seam_score_by_unit(m, crud.seams(m))


def _text_grid(s, d):
    m = _facts(s, d)
    return crud.crud_grid(m, crud.resources_of(m.where("touches_only")))


def _renamed(s, d):
    """Nodes, and new names for a third of them."""
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(F.format_string("n%d", "n_nationkey").alias("id"), F.col("r_name").alias("kind"), F.col("n_name").alias("name"))
    return n, n.where("cast(substr(id, 2) as int) % 3 = 0").select("id", F.lower("name").alias("name"))


def _programs(s, d):
    return table(s, d, "supplier").select(F.format_string("prog:%d", "s_suppkey").alias("root"))


def _waves(s, d, scored=False):
    scores = units(s, d).withColumn("seam_score", (F.substring("unit_id", 2, 9).cast("int") % 7) / 7) if scored else None
    return depgraph.waves(units(s, d), layered_edges(s, d), scores)


def _context_paths(s, d):
    edges = unit_edges(s, d).withColumn("ord", F.substring("target", 2, 9).cast("int"))
    return depgraph.context_paths(edges, unit_files(s, d)).select("unit_id", F.array_join("paths", ",").alias("paths"))


def _condensed(s, d):
    e = cut(layered_edges(s, d).select("source", "target").where("source <> target").distinct())
    return depgraph.condensation(e, graph.strongly_connected(e))


def _condensed_heights(s, d):
    """Heights of the clusters of units, whose edges are those between clusters."""
    e = cut(cluster_edges(s, d).select("source", "target").distinct())
    clusters = cut(graph.strongly_connected(e))
    return graph.heights(clusters.select(F.col("cluster").alias("id")), depgraph.condensation(e, clusters))


def _forest(s, d):
    """Regions, nations, suppliers and their paragraphs as trees, in the order in which children come before parents."""
    n, p = table(s, d, "nation"), table(s, d, "supplier")
    of = lambda form, c: F.format_string(form, c)
    edge = lambda df, a, b, o: df.select(a.alias("source"), b.alias("target"), F.lit("contains").alias("kind"), o.cast("long").alias("ord"))
    paragraphs = table(s, d, "lineitem").select("l_suppkey", "l_linenumber").distinct()
    e = graph.union_all([
        edge(n, of("r%d", "n_regionkey"), of("n%d", "n_nationkey"), -F.col("n_nationkey")), edge(p, of("n%d", "s_nationkey"), of("s%d", "s_suppkey"), F.col("s_suppkey") % 5),
        edge(paragraphs, of("s%d", "l_suppkey"), F.format_string("p%d.%d", "l_suppkey", "l_linenumber"), F.col("l_linenumber")),
    ])
    ids = graph.union_all([table(s, d, "region").select(of("r%d", "r_regionkey").alias("id")), e.select(F.col("target").alias("id"))])
    return graph.forest_order(ids, e).select("id", "root", "place", "size")


def _named_calls(s, d):
    """(nodes, edges): suppliers as programs; line items as calls of external programs by name, some of which there are, and as reads of paragraphs and of programs themselves."""
    i, p = table(s, d, "lineitem"), table(s, d, "supplier")
    of = lambda form, *c: F.format_string(form, *c)
    node = lambda df, id, kind, name: df.select(id.alias("id"), F.lit(kind).alias("kind"), name.alias("name")).distinct()
    external = of("ext:%d:%d", "l_suppkey", F.col("l_partkey") % 150)
    nodes = node(p, of("prog:%d", "s_suppkey"), "program", of("PGM%d", "s_suppkey")).unionByName(node(i, external, "external_call", of("pgm%d", F.col("l_partkey") % 150)))
    para = F.when(F.col("l_linenumber") % 3 == 0, of("prog:%d", "l_suppkey")).otherwise(of("para:%d:%d", "l_suppkey", "l_linenumber"))
    edge = lambda df, source, target, kind: df.select(source.alias("source"), target.alias("target"), kind.alias("kind"))
    calls = edge(i, of("para:%d:%d", "l_suppkey", "l_linenumber"), external, F.lit("calls"))
    return nodes, calls.unionByName(edge(i, para, of("res:%d", "l_partkey"), F.when(F.col("l_returnflag") == "R", "reads").otherwise("writes")))


def _resolved_centrality(s, d):
    nodes, edges = _named_calls(s, d)
    return graph.centrality(nodes, graph.resolved_calls(nodes, edges))


def unit_files(s, d):
    """(unit_id, path, ord): a file a supplier, shared by those of a nation."""
    path = F.format_string("src/%s.py", F.col("s_nationkey").cast("string"))
    return table(s, d, "supplier").select(F.format_string("u%06d", "s_suppkey").alias("unit_id"), path.alias("path"), F.lit(0).alias("ord"))


def _styled(s, d):
    """Programs that are callable, have steps in some nations, and call the transactions that their seventh paragraphs write."""
    n = kg_nodes(s, d).withColumn("callable", (F.col("kind") == "program") & (F.split_part("id", F.lit(":"), F.lit(2)).cast("int") % 3 == 0))
    e = kg_edges(s, d)
    steps = e.where("kind = 'contains' or (kind = 'step_of' and cast(split_part(target, ':', 2) as int) % 2 = 0)")
    talks = e.where("kind = 'writes' and source like '%:7'").join(n.where("kind = 'txn_call'").select(F.col("id").alias("target")), "target", "left_semi")
    return metrics.target_style(n, steps.unionByName(talks.select(*e.columns).withColumn("kind", F.lit("calls"))))


QUERIES = {
    "crud_matrix": lambda s, d: _matrix(s, d).select(*_flags.split(", ")),
    "kind_grid": lambda s, d: crud.kind_grid(_matrix(s, d), KINDS),
    "crud_grid": _text_grid,
    "crud_evidence": lambda s, d: _matrix(s, d).select("program", "kind", "name", F.array_join("evidence", ",").alias("evidence")),
    "crud_programs": lambda s, d: crud.programs_of(_matrix(s, d)),
    "crud_resources": lambda s, d: crud.resources_of(_matrix(s, d)),
    "resources_touched_by": lambda s, d: crud.resources_touched_by(_matrix(s, d)),
    "programs_touching": lambda s, d: crud.programs_touching(_matrix(s, d), "dataset"),
    "target_style": _styled,
    "kg_update_nodes": lambda s, d: graph.update_nodes(_renamed(s, d)[0], _renamed(s, d)[1]),
    "kg_missing_updates": lambda s, d: graph.missing_updates(_renamed(s, d)[0].where("kind <> 'ASIA'"), _renamed(s, d)[1]),
    "kg_edges_where": lambda s, d: graph.edges_where(kg_edges(s, d), target="prog:3", kind="calls").select("source", "evidence"),
    "kg_post_order_walk": lambda s, d: graph.post_order(kg_edges(s, d), _programs(s, d), ["contains", "step_of"]),
    "readers_of": lambda s, d: crud.readers_of(_matrix(s, d)),
    "writers_of": lambda s, d: crud.writers_of(_matrix(s, d)),
    "touches_only": lambda s, d: _matrix(s, d).where("touches_only").select("program", "kind", "name"),
    "dd_lookup": lambda s, d: crud.dd_lookup(kg_nodes(s, d), kg_edges(s, d)),
    "seam_rank": lambda s, d: crud.seam_rank(crud.seams(_matrix(s, d))),
    "seam_rank_min2": lambda s, d: crud.seam_rank(crud.seams(_matrix(s, d), 2)),
    "seam_evidence": lambda s, d: crud.seam_evidence(_matrix(s, d)),
    "seam_score_by_unit": _seam_scores,
    "kg_upsert_nodes": lambda s, d: graph.upsert_nodes(table(s, d, "orders").select(F.format_string("c%d", "o_custkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("ord"))),
    "kg_distinct_edges": lambda s, d: graph.distinct_edges(table(s, d, "lineitem").select(F.format_string("s%d", "l_suppkey").alias("source"), F.format_string("p%d", F.col("l_partkey") % 50).alias("target"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_linenumber") > 3, "late").alias("evidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))),
    "kg_dangling_edges": lambda s, d: graph.dangling_edges(kg_nodes(s, d).where("name <> 'R7' and name <> 'PARA-3'"), kg_edges(s, d).select("source", "target", "kind")),
    "kg_nodes_by_kind": lambda s, d: kg_nodes(s, d).groupBy("kind").agg(F.count("*").alias("n")),
    "kg_neighbors": lambda s, d: graph.neighbors(kg_edges(s, d), "both", ["contains", "step_of", "dd_of"]),
    "kg_descendants": lambda s, d: graph.closure(kg_edges(s, d), _programs(s, d), ["contains", "reads", "step_of", "dd_of"]),
    "kg_ancestors": lambda s, d: graph.ancestors(kg_edges(s, d), table(s, d, "region").select(F.format_string("dsn:%d", "r_regionkey").alias("root")), ["step_of", "dd_of"]),
    "kg_roots": lambda s, d: graph.roots(kg_nodes(s, d), kg_edges(s, d), "contains").select("id", "kind"),
    "kg_post_order": _condensed_heights,
    "kg_forest_order": _forest,
    "kg_reaching": lambda s, d: graph.reaching(kg_edges(s, d), kg_nodes(s, d).where("kind = 'txn_call'").select(F.col("id").alias("node")), ["contains", "calls", "writes"]),
    "centrality": lambda s, d: graph.centrality(kg_nodes(s, d), kg_edges(s, d)),
    "centrality_top": lambda s, d: graph.centrality(kg_nodes(s, d), kg_edges(s, d), 10),
    "centrality_resolved": _resolved_centrality,
    "program_level_facts": lambda s, d: graph.program_level_facts(*_named_calls(s, d)),
    "call_graph": lambda s, d: graph.call_graph(kg_nodes(s, d), kg_edges(s, d)),
    "dataflow": lambda s, d: graph.dataflow(kg_nodes(s, d), kg_edges(s, d)),
    "edge_kind": lambda s, d: depgraph.resource_edges(service_calls(s, d)).groupBy("source_unit", "kind").agg(F.count("*").alias("n")),
    "resource_edges": lambda s, d: depgraph.resource_edges(service_calls(s, d)),
    "ambiguous_edges": lambda s, d: depgraph.resource_edges(service_calls(s, d)).where("ambiguous").groupBy("source_unit").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence")),
    "derived_edges": lambda s, d: depgraph.derived_edges(depgraph.resource_edges(service_calls(s, d))),
    "import_edges": lambda s, d: depgraph.import_edges(table(s, d, "lineitem").select(F.format_string("u%06d", "l_suppkey").alias("unit_id"), F.when(F.col("l_linenumber") == 1, "").otherwise(F.format_string("u%06d.m%d", F.col("l_partkey") % 150, "l_linenumber")).alias("module"), (F.col("l_quantity") > 25).alias("is_external")), units(s, d)),
    "call_hints": lambda s, d: depgraph.call_hints(table(s, d, "lineitem").select(F.format_string("u%06d", "l_suppkey").alias("caller"), F.format_string("u%06d", F.col("l_partkey") % 150).alias("callee")), units(s, d)),
    "scc": lambda s, d: graph.strongly_connected(unit_edges(s, d)),
    "scc_clusters": lambda s, d: graph.strongly_connected(cluster_edges(s, d)),
    "condensation": _condensed,
    "waves": _waves,
    "waves_by_seam": lambda s, d: _waves(s, d, True),
    "acceptance_counts": lambda s, d: depgraph.acceptance(units(s, d), table(s, d, "lineitem").select(F.format_string("u%06d", "l_suppkey").alias("source"), F.when(F.col("l_partkey") % 3 > 0, F.format_string("u%06d", F.col("l_partkey") % 100)).alias("target"))),
    "context_paths": _context_paths,
}

_W = f"WITH {MATRIX_SQL}"
_G = f"WITH {NODES_SQL}, {EDGES_SQL}"
_RANK = "row_number() OVER (ORDER BY total_score DESC, kind, name) AS rank"
_CLOSE = "r AS (SELECT DISTINCT source AS root, source AS node FROM {e} UNION SELECT r.root, e.target FROM r JOIN {e} e ON e.source = r.node)"
_SCC = """plus AS (SELECT DISTINCT source AS root, target AS node FROM ue UNION SELECT p.root, e.target FROM plus p JOIN ue e ON e.source = p.node),
scc AS (SELECT n.id, CASE WHEN m.least IS NULL THEN n.id ELSE 'cluster-' || m.least END AS cluster FROM (SELECT source AS id FROM ue UNION SELECT target FROM ue) n
  LEFT JOIN (SELECT a.root, least(min(a.node), a.root) AS least FROM plus a JOIN plus b ON a.root = b.node AND a.node = b.root WHERE a.root <> a.node GROUP BY a.root) m ON m.root = n.id)"""
_LEVELS = f"""{_SCC}, cu AS (SELECT unit_id AS id, coalesce(cluster, unit_id) AS cluster FROM units LEFT JOIN scc ON id = unit_id),
dag AS (SELECT DISTINCT a.cluster AS source, b.cluster AS target FROM ue JOIN cu a ON a.id = ue.source JOIN cu b ON b.id = ue.target WHERE a.cluster <> b.cluster),
depth AS (SELECT cluster AS id, 0 AS h FROM cu UNION SELECT e.source, d.h + 1 FROM depth d JOIN dag e ON e.target = d.id),
lv AS (SELECT cu.id, cluster, max(h) AS height FROM depth JOIN cu ON cu.cluster = depth.id GROUP BY cu.id, cluster)"""

ORACLES = {
    "crud_matrix": f"{_W} SELECT {_flags} FROM matrix",
    "kind_grid": f"""{_W}, g AS (SELECT program, kind, bool_or(create_) AS c, bool_or(read_) AS r, bool_or(touches_only) AS t FROM matrix GROUP BY 1, 2),
s AS (SELECT program, kind, CASE WHEN NOT c AND NOT r AND t THEN '*' ELSE CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN r THEN 'R' ELSE '' END || CASE WHEN c THEN 'U' ELSE '' END END AS symbol FROM g)
SELECT program, {', '.join(f"coalesce(max(symbol) FILTER (kind = '{k}'), '.') AS {k}" for k in KINDS)} FROM s GROUP BY program""",
    "readers_of": f"{_W} SELECT kind, name, program FROM matrix WHERE read_",
    "writers_of": f"{_W} SELECT kind, name, program FROM matrix WHERE create_",
    "crud_grid": f"""{_W}, r AS (SELECT DISTINCT kind, name, kind || ':' || name AS shown FROM matrix WHERE touches_only), w AS (SELECT (max(length(shown)) + 2)::INTEGER AS w FROM r),
p AS (SELECT DISTINCT program FROM matrix), c AS (SELECT p.program, r.kind, r.name, rpad(coalesce(m.symbol, '.'), w, ' ') AS cell FROM p, r, w LEFT JOIN matrix m ON m.program = p.program AND m.kind = r.kind AND m.name = r.name),
l AS (SELECT NULL AS program, rpad('program', 24, ' ') || string_agg(rpad(shown, w, ' '), '' ORDER BY kind, name) AS line FROM r, w
  UNION ALL SELECT program, rpad(program, 24, ' ') || string_agg(cell, '' ORDER BY kind, name) FROM c GROUP BY program)
SELECT row_number() OVER (ORDER BY program NULLS FIRST) AS line_no, line FROM l""",
    "crud_evidence": f"""{_W}, u AS (SELECT p.name AS program, r.kind, CASE WHEN own THEN p.name || ':' || r.name ELSE r.name END AS name, string_agg(f.evidence, ',' ORDER BY f.ord, f.evidence) AS evidence
  FROM kg_edges f JOIN kg_edges c ON c.kind = 'contains' AND c.target = f.source JOIN kg_nodes p ON p.id = c.source JOIN res r ON r.target = f.target WHERE f.kind IN ('reads', 'writes') GROUP BY 1, 2, 3)
SELECT * FROM u UNION ALL SELECT p.name, 'dataset', d.name, string_agg(b.evidence, ',' ORDER BY b.ord) FROM kg_edges s JOIN kg_nodes p ON p.id = s.source JOIN kg_edges b ON b.kind = 'dd_of' AND b.source = s.target
  JOIN kg_nodes d ON d.id = b.target WHERE s.kind = 'step_of' AND NOT EXISTS (SELECT 1 FROM u WHERE u.program = p.name AND u.kind = 'dataset' AND u.name = d.name) GROUP BY 1, 3""",
    "crud_programs": f"{_W} SELECT DISTINCT program FROM matrix",
    "crud_resources": f"{_W} SELECT DISTINCT kind, name FROM matrix",
    "resources_touched_by": f"{_W} SELECT DISTINCT program, kind, name FROM matrix",
    "programs_touching": f"{_W} SELECT DISTINCT kind, name, program FROM matrix WHERE kind = 'dataset'",
    "target_style": f"""{_G} SELECT s_name AS program, CASE
  WHEN EXISTS (SELECT 1 FROM kg_edges e JOIN kg_nodes t ON t.id = e.target AND t.kind = 'txn_call' WHERE e.kind = 'writes' AND e.source = 'para:' || s_suppkey || ':7') THEN 'cics'
  WHEN s_suppkey % 3 = 0 THEN 'subroutine' WHEN s_nationkey % 2 = 0 THEN 'batch' ELSE 'subroutine' END AS style FROM supplier""",
    "kg_update_nodes": "SELECT 'n' || n_nationkey AS id, r_name AS kind, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS name FROM nation JOIN region ON r_regionkey = n_regionkey",
    "kg_missing_updates": "SELECT 'n' || n_nationkey AS id, lower(n_name) AS name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 = 0 AND r_name = 'ASIA'",
    "kg_edges_where": f"{_G} SELECT source, evidence FROM kg_edges WHERE kind = 'calls' AND target = 'prog:3'",
    "kg_post_order_walk": f"""{_G}, c AS (SELECT source AS root, target AS node, min(ord) AS ord FROM kg_edges WHERE kind IN ('contains', 'step_of') GROUP BY 1, 2),
x AS (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY ord, node) - 1 AS pos FROM c)
SELECT * FROM x UNION ALL SELECT 'prog:' || s_suppkey, 'prog:' || s_suppkey, (SELECT count(*) FROM x WHERE root = 'prog:' || s_suppkey) FROM supplier""",
    "touches_only": f"{_W} SELECT program, kind, name FROM matrix WHERE touches_only",
    "dd_lookup": f"{_W} SELECT dd, dataset FROM dd",
    "seam_rank": f"WITH {SEAMS_SQL} SELECT *, {_RANK} FROM seams",
    "seam_rank_min2": f"WITH {SEAMS_SQL} SELECT *, {_RANK} FROM seams WHERE n_programs >= 2",
    "seam_evidence": f"""{_W}, e AS (SELECT kind, name, count(DISTINCT program) AS n, string_agg(program, ', ' ORDER BY program) FILTER (read_) AS r,
string_agg(program, ', ' ORDER BY program) FILTER (create_) AS w, string_agg(program, ', ' ORDER BY program) FILTER (NOT read_ AND NOT create_) AS t FROM matrix GROUP BY 1, 2)
SELECT kind, name, concat_ws(chr(10), 'Touched by ' || n || ' programs', 'Readers: ' || r, 'Writers: ' || w, 'Touches: ' || t) AS evidence FROM e""",
    "seam_score_by_unit": f"""WITH {SEAMS_SQL} SELECT m.program, coalesce(max(s.total_score) FILTER (m.read_ OR m.create_), 0.0::DOUBLE) AS seam_score FROM matrix m LEFT JOIN seams s USING (kind, name) GROUP BY 1""",
    "kg_upsert_nodes": "SELECT 'c' || o_custkey AS id, max_by(o_orderstatus, o_orderkey) AS kind, max(o_orderkey) AS ord FROM orders GROUP BY o_custkey",
    "kg_distinct_edges": "SELECT 's' || l_suppkey AS source, 'p' || (l_partkey % 50) AS target, l_returnflag AS kind, CASE WHEN l_linenumber > 3 THEN 'late' END AS evidence, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY 1, 2, 3, 4",
    "kg_dangling_edges": f"{_G}, n AS (SELECT id FROM kg_nodes WHERE name <> 'R7' AND name <> 'PARA-3') SELECT DISTINCT source, target, kind FROM kg_edges WHERE source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n)",
    "kg_nodes_by_kind": f"WITH {NODES_SQL} SELECT kind, count(*) AS n FROM kg_nodes GROUP BY kind",
    "kg_neighbors": f"{_G}, e AS (SELECT * FROM kg_edges WHERE kind IN ('contains', 'step_of', 'dd_of')) SELECT source AS id, target AS neighbor FROM e UNION SELECT target, source FROM e",
    "kg_descendants": f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, e AS (SELECT DISTINCT source, target FROM kg_edges WHERE kind IN ('contains', 'reads', 'step_of', 'dd_of')), r AS (SELECT 'prog:' || s_suppkey AS root, 'prog:' || s_suppkey AS node FROM supplier UNION SELECT r.root, e.target FROM r JOIN e ON e.source = r.node) SELECT root, node FROM r WHERE root <> node",
    "kg_ancestors": f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, e AS (SELECT DISTINCT source, target FROM kg_edges WHERE kind IN ('step_of', 'dd_of')), r AS (SELECT 'dsn:' || r_regionkey AS root, 'dsn:' || r_regionkey AS node FROM region UNION SELECT r.root, e.source FROM r JOIN e ON e.target = r.node) SELECT root, node FROM r WHERE root <> node",
    "kg_roots": f"{_G} SELECT id, kind FROM kg_nodes WHERE id NOT IN (SELECT target FROM kg_edges WHERE kind = 'contains')",
    "kg_post_order": f"""WITH RECURSIVE {CLUSTER_EDGES_SQL}, {_SCC}, dag AS (SELECT DISTINCT a.cluster AS source, b.cluster AS target FROM ue JOIN scc a ON a.id = ue.source JOIN scc b ON b.id = ue.target WHERE a.cluster <> b.cluster),
depth AS (SELECT cluster AS id, 0 AS h FROM scc UNION SELECT e.source, d.h + 1 FROM depth d JOIN dag e ON e.target = d.id) SELECT id, max(h) AS height FROM depth GROUP BY id""",
    "kg_forest_order": """WITH p AS (SELECT DISTINCT l_suppkey AS s, l_linenumber AS l FROM lineitem), x AS (SELECT 's' || s_suppkey AS s, 'n' || s_nationkey AS n, s_suppkey % 5 AS o, 'r' || n_regionkey AS r, -n_nationkey AS a FROM supplier JOIN nation ON n_nationkey = s_nationkey),
every AS (SELECT 0 AS kind, 'r' || r_regionkey AS id, 'r' || r_regionkey AS root, 999 AS a, 999 AS o, '~' AS s, 999 AS l FROM region UNION ALL SELECT 1, 'n' || n_nationkey, 'r' || n_regionkey, -n_nationkey, 999, '~', 999 FROM nation
  UNION ALL SELECT 2, s, r, a, o, s, 999 FROM x UNION ALL SELECT 3, 'p' || p.s || '.' || l, r, a, o, x.s, l FROM p JOIN x ON x.s = 's' || p.s)
SELECT id, root, row_number() OVER (PARTITION BY root ORDER BY a, o, s, l) - 1 AS place,
  CASE kind WHEN 0 THEN count(*) OVER (PARTITION BY root) WHEN 1 THEN count(*) OVER (PARTITION BY root, a) WHEN 2 THEN count(*) OVER (PARTITION BY root, a, o, s) ELSE 1 END AS size FROM every""",
    "kg_reaching": f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, r AS (SELECT id AS node FROM kg_nodes WHERE kind = 'txn_call' UNION SELECT e.source FROM r JOIN kg_edges e ON e.target = r.node WHERE e.kind IN ('contains', 'calls', 'writes')) SELECT node FROM r",
    "centrality": f"{_G} SELECT n.id, n.name, ((SELECT coalesce(sum(CASE e.kind WHEN 'step_of' THEN 2 WHEN 'contains' THEN 1 ELSE 0 END), 0) FROM kg_edges e WHERE e.source = n.id) + 3 * (SELECT count(*) FROM kg_edges e WHERE e.kind = 'calls' AND e.target = n.id))::BIGINT AS score FROM kg_nodes n WHERE n.kind = 'program'",
    "centrality_top": f"{_G}, c AS (SELECT n.id, n.name, ((SELECT coalesce(sum(CASE e.kind WHEN 'step_of' THEN 2 WHEN 'contains' THEN 1 ELSE 0 END), 0) FROM kg_edges e WHERE e.source = n.id) + 3 * (SELECT count(*) FROM kg_edges e WHERE e.kind = 'calls' AND e.target = n.id))::BIGINT AS score FROM kg_nodes n WHERE n.kind = 'program') SELECT * FROM c ORDER BY score DESC, name LIMIT 10",
    "centrality_resolved": "SELECT 'prog:' || s_suppkey AS id, 'PGM' || s_suppkey AS name, (3 * (SELECT count(*) FROM lineitem WHERE l_partkey % 150 = s_suppkey))::BIGINT AS score FROM supplier",
    "program_level_facts": "SELECT 'PGM' || l_suppkey AS program, CASE WHEN l_returnflag = 'R' THEN 'reads' ELSE 'writes' END AS kind, count(*) AS n FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY 1, 2",
    "call_graph": f"""{_G} SELECT source AS program, source, target, kind FROM kg_edges WHERE kind = 'step_of'
UNION SELECT c.source, f.source, f.target, f.kind FROM kg_edges f JOIN kg_edges c ON c.kind = 'contains' AND c.target = f.source WHERE f.kind = 'calls'""",
    "dataflow": f"{_G} SELECT c.source AS program, f.target, max(f.kind) AS kind FROM kg_edges f JOIN kg_edges c ON c.kind = 'contains' AND c.target = f.source WHERE f.kind IN ('reads', 'writes') GROUP BY 1, 2",
    "edge_kind": f"WITH {CALLS_SQL} SELECT source_unit, kind, count(*) AS n FROM call_edges GROUP BY 1, 2",
    "resource_edges": f"WITH {CALLS_SQL} SELECT * FROM call_edges",
    "ambiguous_edges": f"WITH {CALLS_SQL} SELECT source_unit, count(*) AS n, max(confidence) AS confidence FROM call_edges WHERE ambiguous GROUP BY 1",
    "derived_edges": f"WITH {CALLS_SQL} SELECT w.source_unit, r.source_unit AS target_unit, count(*) AS n FROM call_edges w JOIN call_edges r ON w.resource = r.resource AND w.source_unit <> r.source_unit WHERE w.kind IN ('queues_to', 'publishes_to', 'writes_to') AND r.kind IN ('reads_from', 'invokes') GROUP BY 1, 2",
    "import_edges": f"WITH {UNIT_EDGES_SQL} SELECT printf('u%06d', l_suppkey) AS source_unit, printf('u%06d', l_partkey % 150) AS target_unit FROM lineitem WHERE l_linenumber <> 1 AND l_quantity <= 25 AND l_suppkey <> l_partkey % 150 AND l_partkey % 150 IN (SELECT s_suppkey FROM supplier)",
    "call_hints": "SELECT DISTINCT printf('u%06d', l_suppkey) AS caller, printf('u%06d', l_partkey % 150) AS callee FROM lineitem WHERE l_partkey % 150 IN (SELECT s_suppkey FROM supplier)",
    "scc": f"WITH RECURSIVE {UNIT_EDGES_SQL}, {_SCC} SELECT id, cluster FROM scc",
    "scc_clusters": f"WITH RECURSIVE {CLUSTER_EDGES_SQL}, {_SCC} SELECT id, cluster FROM scc",
    "condensation": f"WITH RECURSIVE {LAYERED_EDGES_SQL}, {_SCC} SELECT DISTINCT a.cluster AS source, b.cluster AS target FROM ue JOIN scc a ON a.id = ue.source JOIN scc b ON b.id = ue.target WHERE a.cluster <> b.cluster",
    "waves": f"WITH RECURSIVE {LAYERED_EDGES_SQL}, {_LEVELS} SELECT id AS unit_id, cluster, height + 1 AS wave, (row_number() OVER (PARTITION BY height ORDER BY id))::INTEGER AS pos FROM lv",
    "waves_by_seam": f"WITH RECURSIVE {LAYERED_EDGES_SQL}, {_LEVELS} SELECT id AS unit_id, cluster, height + 1 AS wave, (row_number() OVER (PARTITION BY height ORDER BY substr(id, 2)::INTEGER % 7 DESC, id))::INTEGER AS pos FROM lv",
    "acceptance_counts": f"WITH {UNIT_EDGES_SQL}, e AS (SELECT printf('u%06d', l_suppkey) AS source, CASE WHEN l_partkey % 3 > 0 THEN printf('u%06d', l_partkey % 100) END AS target FROM lineitem), c AS (SELECT unit_id, (SELECT count(*) FROM e WHERE target = unit_id) AS n_in, (SELECT count(*) FROM e WHERE source = unit_id) AS n_out FROM units) SELECT *, 'Migrate ' || unit_id || ' preserving its public contract. Cross-unit edges: ' || n_in || ' inbound, ' || n_out || ' outbound. All unit tests must pass. No new deprecated APIs. Rubrics green.' AS criteria FROM c",
    "context_paths": f"WITH {UNIT_EDGES_SQL}, p AS (SELECT source AS unit_id, 'src/' || s_nationkey || '.py' AS path, min(target) AS seen FROM ue JOIN supplier ON printf('u%06d', s_suppkey) = target GROUP BY 1, 2) SELECT unit_id, string_agg(path, ',' ORDER BY seen, path) AS paths FROM p GROUP BY 1",
}
