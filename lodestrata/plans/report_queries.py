"""Queries of plans, reports, renders and round trips through files, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.tables import shared_path
from lodestrata.operators import business, depgraph, dualrun, graph, metrics
from lodestrata.plans.estate import CALLS_SQL, EDGES_SQL, LAYERED_EDGES_SQL, NODES_SQL, UNIT_EDGES_SQL, kg_edges, kg_nodes, layered_edges, service_calls, table, units
from lodestrata.plans.graph_queries import _LEVELS, unit_files
from lodestrata.plans.text_queries import _FIELDS, _fields, _fixtures
from lodestrata.sources import files, renders, tree


def _n(form, *columns):
    return F.format_string(form, *columns)


def _drawn(s, d):
    """(nodes, edges) of the estate with attributes as renders take them."""
    n = kg_nodes(s, d)
    attributes = F.map_filter(F.create_map(F.lit("dd_name"), F.col("dd_name"), F.lit("verb"), F.col("verb")), lambda _, v: v.isNotNull())
    return n.select("id", "kind", "name", attributes.alias("attributes")), kg_edges(s, d)


def _lines(of, form):
    return lambda s, d: of(*_drawn(s, d), form).select("section", "line")


def _unit_graph(s, d, form="dot"):
    calls = service_calls(s, d).where("rkind is not null").withColumn("ord", F.lit(0))
    e = depgraph.resource_edges(calls).select("source_unit", F.lit(None).cast("string").alias("target_unit"), "resource", "kind").distinct()
    return renders.unit_graph(units(s, d), depgraph.resources(calls), e, form).select("section", "line")


def _resources(s, d):
    i = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    provider = F.when(F.col("l_quantity") > 40, "aws-eu").otherwise("aws")
    calls = table(s, d, "lineitem").select(
        provider.alias("provider"), F.when(F.col("l_quantity") >= 5, "queue").alias("rkind"), F.when(F.col("l_partkey") % 3 == 0, "").otherwise(_n("n%d", F.col("l_partkey") % 50)).alias("rname"),
        _n("i%d", F.col("l_partkey") % 20).alias("identifier"), i.alias("ord"),
    )
    return depgraph.resources(calls)


def _graph(s, d):
    """All edges: imports, calls, hints of nations to units, and what follows through shared resources."""
    i, n = table(s, d, "lineitem"), table(s, d, "nation")
    unit = _n("u%06d", "l_suppkey")
    imports = i.where("l_linenumber = 1").select(unit.alias("unit_id"), _n("u%06d.m", F.col("l_partkey") % 150).alias("module"), (F.col("l_quantity") > 25).alias("is_external"), _n("f:%d", "l_orderkey").alias("evidence"))
    calls = i.select(
        unit.alias("unit_id"), F.lit("sqs").alias("service"), F.when(F.col("l_returnflag") == "R", "get_it").otherwise("send_it").alias("operation"), F.lit("aws").alias("provider"),
        F.when(F.col("l_quantity") >= 5, "queue").alias("rkind"), _n("q%d", F.col("l_partkey") % 20).alias("rname"), F.lit(None).cast("string").alias("identifier"),
        F.concat(_n("f:%d:%d", "l_orderkey", "l_linenumber"), F.lit(" sqs")).alias("evidence"),
    )
    hints = n.select(
        F.when(F.col("n_nationkey") % 5 > 0, _n("u%06d", "n_nationkey")).alias("source_unit"), F.lit("queue").alias("target_kind"), F.lit("aws").alias("provider"),
        F.when(F.col("n_nationkey") % 4 > 0, _n("q%d", "n_nationkey")).alias("name"), F.lit("reads_from").alias("kind"), _n("t%d", "n_nationkey").alias("evidence"),
        F.when(F.col("n_nationkey") % 4 > 0, 1.0).otherwise(0.7).alias("confidence"),
    )
    return depgraph.build_graph(units(s, d), imports, calls, hints)


def _backlog(s, d):
    e = layered_edges(s, d).where("source <> target").groupBy("source", "target").agg(F.min("ord").alias("ord"))
    level = units(s, d).where("cast(substr(unit_id, 2) as int) % 3 > 0").select("unit_id", F.when(F.substring("unit_id", 7, 1) == "1", "LOW").otherwise("HIGH").alias("level"))
    scores = units(s, d).withColumn("seam_score", (F.substring("unit_id", 2, 9).cast("int") % 7) / 7)
    b = depgraph.backlog(units(s, d), e, unit_files(s, d), level, scores)
    return b.select("wave", "pos", "unit_id", "cluster", "complexity", F.array_join("source_paths", ",").alias("source_paths"), F.array_join("context_paths", ",").alias("context_paths"), "criteria")


def _runs(s, d):
    o = F.col("o_custkey")
    return table(s, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("fixture"), _n("P%d", o % 50).alias("program_id"), F.lit("batch").alias("target_style"), F.when(o % 5 == 0, "no runner").alias("skip_reason"),
        F.when(o % 50 == 7, "boom").alias("error"), F.col("o_orderkey").alias("place"),
    )


def _report(s, d):
    place = F.coalesce(*(F.when(F.col("field") == f, i) for i, f in enumerate(("total", "status", "priority", "key"))), F.lit(9))
    fields = _fields(s, d).withColumn("fixture", F.col("fixture").cast("string")).withColumn("place", place)
    return dualrun.markdown(_runs(s, d), fields, dualrun.verdict(_fixtures(s, d)))


def _round(s, name):
    return shared_path(s, name)


def _sources(s, d):
    """Each nation's name as the text of a file of its own, found again below its folder."""
    path = _round(s, "tree")
    tree.write_tree(table(s, d, "nation").select(_n("unit-%d/name.txt", "n_nationkey").alias("path"), F.concat("n_name", F.lit("\n")).alias("text")), path)
    found = files.relative(files.read_sources(s, path, [".txt"]), path)
    return found.select(F.substring_index("path", "/", 1).alias("unit"), "text")


def _fixture_fields(s, d):
    """A fixture file a nation, read back as its expected fields."""
    path = _round(s, "fixtures")
    tolerance = F.struct(F.lit("decimal").alias("kind"), F.lit("9(5)V9(2)").alias("pic"), F.lit(2).alias("scale"), F.lit(True).alias("trim"), F.lit(False).alias("signed"), F.lit(0.5).alias("abs_tol"), F.lit(False).alias("case_insensitive"))
    fixture = table(s, d, "nation").select(
        F.col("n_name").alias("name"), F.lit("batch").alias("target_style"), _n("P%d", "n_regionkey").alias("program_id"), F.create_map(F.lit("in"), F.lit("1")).alias("inputs"),
        F.create_map(F.lit("key"), F.col("n_nationkey").cast("string"), F.lit("name"), F.lower("n_name")).alias("expected_outputs"), F.create_map(F.lit("key"), tolerance).alias("tolerances"),
    )
    fixture.write.option("maxRecordsPerFile", 1).json(path)
    return files.expected_fields(files.read_fixtures(s, path)).select("fixture", "field", "value", "kind", "scale", "abs_tol")


def _snapshot(s, d):
    path = _round(s, "kg")
    n, e = kg_nodes(s, d), kg_edges(s, d)
    files.write_snapshot(n, e, path)
    as_text = lambda df: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return files.read_snapshot_tables(s, path, as_text(n), as_text(e))[1].select("source", "target", "kind", "evidence")


def _checkpoints(s, d):
    """A run an order, its line items as units in two waves."""
    # line items are grouped once and as they are; what a unit has beside them is put in after
    item = F.struct((F.col("l_linenumber") % 2).alias("wave"), "l_suppkey", "l_linestatus", "l_quantity", "l_partkey")
    unit = lambda x: F.struct(
        F.format_string("u%d", x["l_suppkey"]).alias("unit_id"), x["wave"].alias("wave"), x["l_linestatus"].alias("status"), F.lit("pass").alias("reviewer_verdict"), F.lit(True).alias("tests_passed"),
        F.lit(0.5).alias("rubric_score"), (x["l_quantity"] / 100).alias("cost_usd"), F.create_map(F.lit("t.input_tokens"), x["l_partkey"]).alias("tokens"),
    )
    own = lambda w: F.transform(F.filter("items", lambda x: x["wave"] == w), unit)
    waves = F.transform(F.array_distinct(F.transform("items", lambda x: x["wave"])), lambda w: F.struct(w.alias("wave"), F.lit(True).alias("verification_passed"), own(w).alias("unit_results")))
    runs = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items")).select("l_orderkey", waves.alias("waves"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    own = runs.select(_n("r%d", "l_orderkey").alias("run_id"), F.lit("c").alias("cartridge_id"), F.lit("/r").alias("repo_root"), F.lit("/w").alias("workdir"), at.alias("started_at"), at.alias("updated_at"), F.lit("done").alias("stage"), "waves")
    path = _round(s, "runs")
    files.write_checkpoint(own, path)
    return files.read_checkpoints(s, path)


def _unit_results(s, d):
    return files.unit_results(_checkpoints(s, d)).select("run_id", "wave", "unit_id", "status", "cost_usd", F.element_at("tokens", "t.input_tokens").alias("tokens"))


def _cost_log(s, d):
    """The history of runs, read back from its file."""
    runs = _checkpoints(s, d)
    budgets = runs.select("run_id", F.lit(3).alias("calls"), F.lit(10).alias("input_tokens"), F.lit(20).alias("output_tokens"), F.lit(0.1234567).alias("used_usd"), F.lit(5.0).alias("max_usd"), F.lit(False).alias("halted"))
    path = _round(s, "log")
    files.append_cost_log(files.cost_reports(runs, budgets)[1], path)
    return s.read.schema("run_id string, units long, calls long, used_usd double, halted boolean").json(path).drop("epoch")


def _pipes(s, d):
    layout = [("id", 10), ("name", 12), ("bal", None)]
    path = _round(s, "pipe")
    own = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), "c_name").alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("bal"))
    files.write_pipe(own, path, layout)
    return files.read_pipe(s, path, layout).withColumn("bal", F.col("bal").cast("double"))


def _artifacts(s, d):
    """What an export writes, by the rows that are read back; a second export writes nothing."""
    path = _round(s, "export")
    n, e = _drawn(s, d)
    own = units(s, d)
    renders.export_graph(n, e, own, path)
    again = len(renders.export_graph(n, e, own, path))
    parts = ("kg/nodes", "kg/edges", "units", "graphs/dataflow.mmd")
    return graph.union_all([s.read.text(f"{path}/{p}").agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n", F.lit(again).alias("again")) for p in parts])


def _exported(s, d, part, schema=None):
    """What an export writes of one part, read back."""
    path = _round(s, "export")
    n, e = _drawn(s, d)
    renders.export_graph(n, e, units(s, d), path)
    return s.read.text(f"{path}/{part}") if schema is None else s.read.schema(schema).json(f"{path}/{part}")


_CODE = {
    "python": ("def f%d():", "def f%d():"), "node": ("class F%d {", "async function f%d() {"), "typescript": ("export async function f%d() {", "class F%d {"), "java": ("  public class F%d {", "  static interface F%d {"),
    "csharp": ("  internal struct F%d {", "  public record F%d {"), "go": ("func F%d() {", "func F%d() {"),
}


def _chunks(language):
    """Sources of one to four blocks of four lines after a first line, in chunks of five lines or more."""

    def run(s, d):
        k = F.col("c_custkey")
        even, odd = (F.lit(x) for x in _CODE[language])
        block = lambda i: F.concat(F.format_string("\n%s\n  x;\n  y;\n}", F.replace(F.when(i % 2 == 0, even).otherwise(odd), F.lit("%d"), i.cast("string"))))
        text = F.concat(F.lit("// head"), F.array_join(F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), block), ""))
        return metrics.chunks_of(table(s, d, "customer").select(k.alias("doc_id"), text.alias("text")), language, 5, 2)

    return run


def _chunk_oracle(language):
    even, odd = (x.strip().split("%d")[0].split()[-1] for x in _CODE[language])
    name = f"CASE WHEN i % 2 = 0 THEN '{even}' ELSE '{odd}' END || i"
    symbols = "''" if language == "go" else f"(SELECT string_agg({name}, ',' ORDER BY i) FROM (SELECT unnest([2 * c, 2 * c + 1]) AS i) WHERE i < n)"
    return f"""WITH b AS (SELECT c_custkey AS doc_id, c_custkey % 4 + 1 AS n FROM customer), k AS (SELECT doc_id, n, unnest(range(0, (n + 1) // 2)) AS c FROM b)
SELECT doc_id, c::BIGINT AS index, (CASE WHEN c > 0 THEN 8 * c ELSE 2 END)::BIGINT AS start_line, least(1 + 4 * n, 1 + 8 * (c + 1))::BIGINT AS end_line, {symbols} AS symbols FROM k"""


def _filings(s, d):
    k = F.col("o_orderkey")
    own = table(s, d, "orders").select(
        k.alias("key"), F.col("o_orderpriority").alias("jurisdiction"), F.col("o_orderstatus").alias("service_type"), F.when(k % 2 == 0, "X").alias("source_system"),
        F.create_map(F.lit("entity"), F.concat(F.lit(" e"), k.cast("string"), F.lit("\n")), F.lit("other"), F.lit("o")).alias("payload"),
    )
    checked = business.required(table(s, d, "orders").select(k.alias("key"), F.when(k % 3 > 0, "x").alias("name")), "key", ["name"])
    queued, _ = business.queue(business.filing_records(own), checked)
    return queued.select("key", F.element_at("payload", "entity").alias("entity"), F.element_at("payload", "order").alias("order_"), F.col("_meta.sourceSystem").alias("source"), F.col("place").cast("long").alias("place"))


def _planned_below(s, d):
    """Summaries to be made of all programs and what they contain, bottom-up, without what is done or in the cache."""
    n = kg_nodes(s, d).select("id", F.lit("text").alias("raw_text"), "name", "kind", F.when(F.col("name") == "PARA-2", "done").alias("summary"), F.lit("p").alias("prompt"))
    key = metrics.cache_key(F.col("id"), F.col("raw_text"), F.col("name"), F.col("kind"), F.col("prompt"))
    cache = n.where("kind = 'paragraph' and id like '%:5'").select(key.alias("key"))
    roots = n.where("kind = 'program'").select(F.col("id").alias("root"))
    return metrics.summary_plan(n, cache, None, roots, kg_edges(s, d)).select("place", "id")


QUERIES = {
    "call_graph_dot": _lines(renders.call_graph, "dot"),
    "call_graph_mermaid": _lines(renders.call_graph, "mermaid"),
    "data_flow_dot": _lines(renders.data_flow, "dot"),
    "data_flow_mermaid": _lines(renders.data_flow, "mermaid"),
    "unit_graph_dot": _unit_graph,
    "unit_graph_mermaid": lambda s, d: _unit_graph(s, d, "mermaid"),
    "kg_artifacts": _artifacts,
    "kg_artifact_lines": lambda s, d: _exported(s, d, "graphs/dataflow.mmd").select(F.col("value").alias("line")),
    "kg_artifact_nodes": lambda s, d: _exported(s, d, "kg/nodes", "id string, kind string, name string, attributes map<string,string>").select("id", "kind", "name", F.try_element_at("attributes", F.lit("verb")).alias("verb")),
    "kg_snapshot": _snapshot,
    "source_files": _sources,
    "fixture_fields": _fixture_fields,
    "checkpoint_units": _unit_results,
    "cost_log": _cost_log,
    "pipe_round_trip": _pipes,
    "resources": _resources,
    "build_graph": lambda s, d: _graph(s, d)[0],
    "hint_orphans": lambda s, d: _graph(s, d)[1].select("source_unit", "name", "evidence", "reason"),
    "memberships": lambda s, d: depgraph.memberships(depgraph.resource_edges(service_calls(s, d))),
    "backlog": _backlog,
    "dualrun_markdown": _report,
    "dualrun_of_program": lambda s, d: dualrun.verdict(dualrun.of_program(_fixtures(s, d), "P3")).select("program_id", "total", "matched"),
    "filing_queue": _filings,
    "summary_plan_roots": _planned_below,
    **{f"chunks_{language}": _chunks(language) for language in _CODE},
}

_G = f"WITH {NODES_SQL}, {EDGES_SQL}"
_S = "replace({0}, ':', '_')"
_SRC, _TGT, _ID = (_S.format(c) for c in ("source", "target", "id"))
_LABEL = """CASE kind WHEN 'program' THEN '<b>' || name || '</b>\\n(program)' WHEN 'file' THEN name || '\\n(FD' || coalesce(' → DD ' || dd_name, '') || ')' WHEN 'dataset_ref' THEN name || '\\n(dataset)'
  WHEN 'txn_call' THEN 'EXEC CICS ' || verb WHEN 'sql_block' THEN 'EXEC SQL ' || verb WHEN 'external_call' THEN 'CALL ''' || name || '''' ELSE name END"""
_BOX = f"""{_ID} || ' [label="' || {_LABEL} || '" shape=' || CASE kind WHEN 'program' THEN 'box fillcolor="#cde4ff" style=filled penwidth=2' WHEN 'paragraph' THEN 'box fillcolor="#f7fbff" style=filled'
  WHEN 'step' THEN 'component fillcolor="#f0e0ff" style=filled' WHEN 'file' THEN 'cylinder fillcolor="#ffe0b3" style=filled' WHEN 'txn_call' THEN 'trapezium fillcolor="#ffccf2" style=filled'
  WHEN 'sql_block' THEN 'parallelogram fillcolor="#d0f0d0" style=filled' ELSE 'cylinder fillcolor="#fff0b3" style=filled style="filled,rounded"' END || '];'"""
_STYLE = """CASE kind WHEN 'calls' THEN 'color="#cc0000" style="solid" fontcolor="#cc0000"' WHEN 'reads' THEN 'color="#1a7f37" style="solid" fontcolor="#1a7f37"' WHEN 'writes' THEN 'color="#cc6600" style="solid" fontcolor="#cc6600"'
  ELSE 'color="#0066cc" style="dashed" fontcolor="#0066cc"' END"""
_DOT_EDGE = f"""'  ' || {_SRC} || ' -> ' || {_TGT} || ' [label="' || kind || '" ' || {_STYLE} || '];'"""
_MMD_EDGE = f"'  ' || {_SRC} || ' -->|' || kind || '| ' || {_TGT}"
_FONTS = """'  node [fontname="Helvetica" fontsize=10];' || chr(10) || '  edge [fontname="Helvetica" fontsize=9];'"""
_LIFTED = f"""{_G}, lifted AS (SELECT c.source, f.target, max(f.kind) AS kind FROM kg_edges f JOIN kg_edges c ON c.kind = 'contains' AND c.target = f.source JOIN kg_nodes n ON n.id = f.target AND n.kind IN ('file', 'dataset_ref', 'sql_block', 'txn_call')
  WHERE f.kind IN ('reads', 'writes') GROUP BY 1, 2), shown AS (SELECT * FROM kg_nodes WHERE kind IN ('program', 'file', 'dataset_ref', 'sql_block', 'txn_call'))"""
_FLOW = "flow AS (SELECT DISTINCT source, target, kind FROM kg_edges WHERE kind IN ('calls', 'step_of'))"

ORACLES = {
    "call_graph_dot": f"""{_G}, {_FLOW} SELECT 0 AS section, 'digraph call_graph {{' || chr(10) || '  rankdir=LR;' || chr(10) || {_FONTS} || chr(10) || '  compound=true;' AS line UNION ALL SELECT 9, '}}'
UNION ALL SELECT 1, '  subgraph cluster_' || {_ID} || ' {{' || chr(10) || '    label="' || name || '";' || chr(10) || '    style="rounded,filled";' || chr(10) || '    fillcolor="#f5f8fc";' || chr(10) || '    ' || {_BOX} FROM kg_nodes WHERE kind = 'program'
UNION ALL SELECT 1, '  }}' FROM kg_nodes WHERE kind = 'program' UNION ALL SELECT 1, '    ' || {_BOX} FROM kg_nodes WHERE kind = 'paragraph' UNION ALL SELECT 2, '  ' || {_BOX} FROM kg_nodes WHERE kind = 'step'
UNION ALL SELECT 3, {_DOT_EDGE} FROM flow""",
    "call_graph_mermaid": f"""{_G}, {_FLOW} SELECT 0 AS section, '```mermaid' || chr(10) || 'flowchart LR' AS line UNION ALL SELECT 9, '```'
UNION ALL SELECT 1, '  subgraph ' || {_ID} || '[' || name || ']' || chr(10) || '    ' || {_ID} || '_self["<b>' || name || '</b>"]' FROM kg_nodes WHERE kind = 'program' UNION ALL SELECT 1, '  end' FROM kg_nodes WHERE kind = 'program'
UNION ALL SELECT 1, '    ' || {_ID} || '["' || name || '"]' FROM kg_nodes WHERE kind = 'paragraph' UNION ALL SELECT 2, '  ' || {_ID} || '["' || name || '"]' FROM kg_nodes WHERE id IN (SELECT target FROM flow WHERE kind = 'step_of')
UNION ALL SELECT 3, {_MMD_EDGE} FROM flow""",
    "data_flow_dot": f"""{_LIFTED}, jobs AS (SELECT DISTINCT source, target, kind FROM kg_edges WHERE kind IN ('step_of', 'dd_of'))
SELECT 0 AS section, 'digraph dataflow {{' || chr(10) || '  rankdir=LR;' || chr(10) || {_FONTS} AS line UNION ALL SELECT 9, '}}' UNION ALL SELECT 1, '  ' || {_BOX} FROM shown
UNION ALL SELECT 2, '  ' || {_BOX} FROM kg_nodes WHERE kind = 'step' UNION ALL SELECT 3, {_DOT_EDGE} FROM lifted UNION ALL SELECT 3, {_DOT_EDGE} FROM jobs""",
    "data_flow_mermaid": f"""{_LIFTED} SELECT 0 AS section, '```mermaid' || chr(10) || 'flowchart LR' AS line UNION ALL SELECT 9, '```'
UNION ALL SELECT 1, '  ' || {_ID} || CASE kind WHEN 'dataset_ref' THEN '[("' || {_LABEL} || '")]' WHEN 'program' THEN '["<b>' || {_LABEL} || '</b>"]' ELSE '["' || {_LABEL} || '"]' END FROM shown UNION ALL SELECT 3, {_MMD_EDGE} FROM lifted""",
    "unit_graph_dot": f"""WITH {UNIT_EDGES_SQL}, {CALLS_SQL}, x AS (SELECT DISTINCT source_unit, resource, kind, split_part(resource, ':', 2) AS rk, split_part(resource, ':', 3) AS nm FROM call_edges WHERE resource IS NOT NULL),
r AS (SELECT DISTINCT service, coalesce(nullif(rname, ''), nullif(identifier, ''), '?') AS nm, CASE WHEN rname = '' THEN '' ELSE rname END AS rname FROM calls WHERE known),
c AS (SELECT *, CASE kind WHEN 'reads_from' THEN '#1a7f37' WHEN 'writes_to' THEN '#b35900' WHEN 'invokes' THEN '#cc0000' ELSE '#9a00cc' END AS colour FROM x)
SELECT 0 AS section, 'digraph G {{' || chr(10) || '  rankdir=LR;' || chr(10) || {_FONTS} AS line UNION ALL SELECT 9, '}}' UNION ALL SELECT 1, '  ' || unit_id || ' [label="' || unit_id || '" shape="box" style="filled" fillcolor="#cde4ff"];' FROM units
UNION ALL SELECT 2, '  aws_' || service || '_' || CASE WHEN rname = '' THEN 'unknown' ELSE rname END || ' [label="' || service || '\\n' || CASE WHEN rname = '' THEN '?' ELSE rname END || '" shape="cylinder" style="filled" fillcolor="#ffe0b3"];' FROM r
UNION ALL SELECT 3, '  ' || source_unit || ' -> aws_' || rk || '_' || CASE WHEN nm = '?' THEN 'unknown' ELSE nm END || ' [label="' || kind || '" color="' || colour || '" fontcolor="' || colour || '"];' FROM c""",
    "unit_graph_mermaid": f"""WITH {UNIT_EDGES_SQL}, {CALLS_SQL}, x AS (SELECT DISTINCT source_unit, resource, kind, split_part(resource, ':', 2) AS rk, split_part(resource, ':', 3) AS nm FROM call_edges WHERE resource IS NOT NULL),
r AS (SELECT DISTINCT service, coalesce(nullif(rname, ''), nullif(identifier, ''), '?') AS nm, rname FROM calls WHERE known)
SELECT 0 AS section, '```mermaid' || chr(10) || 'flowchart LR' AS line UNION ALL SELECT 9, '```' UNION ALL SELECT 1, '    ' || unit_id || '[' || unit_id || ']' FROM units
UNION ALL SELECT 2, '    aws_' || service || '_' || CASE WHEN rname = '' THEN 'unknown' ELSE rname END || '[(' || service || ': ' || CASE WHEN rname = '' THEN '?' ELSE rname END || ')]' FROM r
UNION ALL SELECT 3, '    ' || source_unit || ' -->|' || kind || '| aws_' || rk || '_' || CASE WHEN nm = '?' THEN 'unknown' ELSE nm END FROM x""",
    "kg_artifacts": f"""{_LIFTED} SELECT 'kg/nodes' AS part, count(*) AS n, 0 AS again FROM kg_nodes UNION ALL SELECT 'kg/edges', count(*), 0 FROM kg_edges UNION ALL SELECT 'units', count(*), 0 FROM supplier
UNION ALL SELECT 'graphs/dataflow.mmd', 3 + (SELECT count(*) FROM shown) + (SELECT count(*) FROM lifted), 0""",
    "kg_snapshot": f"{_G} SELECT DISTINCT source, target, kind, evidence FROM kg_edges",
    "source_files": "SELECT 'unit-' || n_nationkey AS unit, n_name || chr(10) AS text FROM nation",
    "fixture_fields": """SELECT n_name AS fixture, unnest(['key', 'name']) AS field, unnest([n_nationkey::VARCHAR, lower(n_name)]) AS value, unnest(['decimal', NULL]) AS kind, unnest([2, NULL]) AS scale, unnest([0.5::DOUBLE, NULL]) AS abs_tol FROM nation""",
    "checkpoint_units": "SELECT 'r' || l_orderkey AS run_id, l_linenumber % 2 AS wave, 'u' || l_suppkey AS unit_id, l_linestatus AS status, l_quantity / 100 AS cost_usd, l_partkey AS tokens FROM lineitem",
    "cost_log": "SELECT 'r' || l_orderkey AS run_id, count(*) AS units, 3::BIGINT AS calls, 0.123457::DOUBLE AS used_usd, false AS halted FROM lineitem GROUP BY l_orderkey",
    "pipe_round_trip": "SELECT c_custkey::VARCHAR AS id, substr(c_name, 1, 12) AS name, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal::DECIMAL(18,2) END::DOUBLE AS bal FROM customer",
    "resources": """WITH c AS (SELECT CASE WHEN l_quantity > 40 THEN 'aws-eu' ELSE 'aws' END AS provider, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'n' || (l_partkey % 50) END AS name, 'i' || (l_partkey % 20) AS identifier, l_orderkey * 10 + l_linenumber AS ord
  FROM lineitem WHERE l_quantity >= 5), k AS (SELECT *, provider || ':queue:' || coalesce(nullif(name, ''), identifier) AS resource FROM c)
SELECT resource, min_by(provider, ord) AS provider, 'queue' AS kind, min_by(name, ord) AS name, min_by(identifier, ord) AS identifier FROM k GROUP BY 1""",
    "build_graph": """WITH i AS (SELECT printf('u%06d', l_suppkey) AS source_unit, printf('u%06d', l_partkey % 150) AS target_unit, NULL AS resource, 'imports' AS kind, 'f:' || l_orderkey AS evidence, 1.0::DOUBLE AS confidence, false AS ambiguous FROM lineitem
  WHERE l_linenumber = 1 AND l_quantity <= 25 AND l_suppkey <> l_partkey % 150 AND l_partkey % 150 IN (SELECT s_suppkey FROM supplier)),
c AS (SELECT printf('u%06d', l_suppkey) AS source_unit, NULL AS target_unit, CASE WHEN l_quantity >= 5 THEN 'aws:queue:q' || (l_partkey % 20) END AS resource, CASE WHEN l_quantity < 5 THEN 'invokes' WHEN l_returnflag = 'R' THEN 'reads_from' ELSE 'queues_to' END AS kind,
  'f:' || l_orderkey || ':' || l_linenumber || ' sqs' || CASE WHEN l_quantity < 5 THEN ' (unresolved)' ELSE '' END AS evidence, CASE WHEN l_quantity < 5 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS confidence, l_quantity < 5 AS ambiguous FROM lineitem),
h AS (SELECT printf('u%06d', n_nationkey) AS source_unit, NULL AS target_unit, 'aws:queue:' || CASE WHEN n_nationkey % 4 > 0 THEN 'q' || n_nationkey ELSE '?' END AS resource, 'reads_from' AS kind, 't' || n_nationkey AS evidence,
  CASE WHEN n_nationkey % 4 > 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence, false AS ambiguous FROM nation WHERE n_nationkey % 5 > 0 AND n_nationkey IN (SELECT s_suppkey FROM supplier)),
b AS (SELECT * FROM c UNION ALL SELECT * FROM h),
g AS (SELECT w.source_unit, r.source_unit AS target_unit, w.resource, count(*) AS n FROM b w JOIN b r ON w.resource = r.resource AND w.source_unit <> r.source_unit WHERE w.kind = 'queues_to' AND r.kind = 'reads_from' GROUP BY 1, 2, 3)
SELECT *, 1::BIGINT AS n FROM i UNION ALL SELECT *, 1 FROM b UNION ALL SELECT source_unit, target_unit, resource, 'invokes', 'derived via shared resource ' || resource, 0.9::DOUBLE, false, n FROM g""",
    "hint_orphans": """SELECT CASE WHEN n_nationkey % 5 > 0 THEN printf('u%06d', n_nationkey) END AS source_unit, CASE WHEN n_nationkey % 4 > 0 THEN 'q' || n_nationkey END AS name, 't' || n_nationkey AS evidence,
  CASE WHEN n_nationkey % 5 > 0 THEN 'unit not in the inventory' ELSE 'no unit' END AS reason FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey NOT IN (SELECT s_suppkey FROM supplier)""",
    "memberships": f"""WITH {CALLS_SQL}, e AS (SELECT * FROM call_edges WHERE NOT ambiguous)
SELECT resource, source_unit AS unit, 'writer' AS side, count(*) AS n FROM e WHERE kind IN ('queues_to', 'publishes_to', 'writes_to') GROUP BY 1, 2 UNION ALL SELECT resource, source_unit, 'reader', count(*) FROM e WHERE kind IN ('reads_from', 'invokes') GROUP BY 1, 2""",
    "backlog": f"""WITH RECURSIVE {LAYERED_EDGES_SQL}, {_LEVELS}, f AS (SELECT printf('u%06d', s_suppkey) AS unit_id, 'src/' || s_nationkey || '.py' AS path FROM supplier),
q AS (SELECT source, target, min(ord) AS ord FROM allce WHERE source <> target GROUP BY 1, 2),
p AS (SELECT source AS unit_id, path, min(ord) AS seen FROM q JOIN f ON f.unit_id = target GROUP BY 1, 2), c AS (SELECT unit_id, string_agg(path, ',' ORDER BY seen, path) AS context_paths FROM p GROUP BY 1),
n AS (SELECT unit_id, (SELECT count(*) FROM q WHERE target = unit_id) AS n_in, (SELECT count(*) FROM q WHERE source = unit_id) AS n_out FROM units)
SELECT height + 1 AS wave, (row_number() OVER (PARTITION BY height ORDER BY substr(id, 2)::INTEGER % 7 DESC, id))::INTEGER AS pos, id AS unit_id, cluster, CASE WHEN substr(id, 2)::INTEGER % 3 = 0 THEN 'MEDIUM' WHEN id[7] = '1' THEN 'LOW' ELSE 'HIGH' END AS complexity,
  f.path AS source_paths, coalesce(context_paths, '') AS context_paths, 'Migrate ' || id || ' preserving its public contract. Cross-unit edges: ' || n_in || ' inbound, ' || n_out
  || ' outbound. All unit tests must pass. No new deprecated APIs. Rubrics green.' AS criteria FROM lv JOIN f ON f.unit_id = id JOIN n ON n.unit_id = id LEFT JOIN c ON c.unit_id = id""",
    "dualrun_markdown": f"""WITH {_FIELDS}, t AS (SELECT o_orderkey AS fixture, o_custkey, o_totalprice::DECIMAL(18,2) AS price, o_orderstatus, o_orderpriority FROM orders),
w AS (SELECT g.fixture, field, list_position(['total', 'status', 'priority', 'key'], field) AS place, CASE field WHEN 'total' THEN price::VARCHAR WHEN 'status' THEN o_orderstatus WHEN 'priority' THEN o_orderpriority ELSE o_custkey::VARCHAR END AS expected,
  CASE WHEN status = 'missing' THEN 'None' WHEN field = 'key' THEN 'n/a' WHEN g.fixture % 7 = 0 THEN (price + 0.005::DECIMAL(18,3))::DECIMAL(18,3)::VARCHAR ELSE (price + 1)::DECIMAL(18,2)::VARCHAR END AS actual, reason FROM g JOIN t USING (fixture) WHERE status IN ('mismatched', 'missing')),
r AS (SELECT fixture, string_agg('| `' || field || '` | `' || expected || '` | `' || actual || '` | ' || reason || ' |', chr(10) ORDER BY place) AS rows FROM w GROUP BY 1),
s AS (SELECT fixture, count(*) FILTER (status <> 'extra') AS n, count(*) FILTER (status = 'matched') AS m, count(*) FILTER (status = 'extra') AS x FROM g GROUP BY 1),
f AS (SELECT t.fixture, 'P' || (o_custkey % 50) AS program_id, o_custkey % 5 = 0 AS skipped, o_custkey % 50 = 7 AS errored, n, m, x, rows, n = m AND x = 0 AS matched FROM t JOIN s USING (fixture) LEFT JOIN r USING (fixture)),
b AS (SELECT *, '## ' || fixture || ' — ' || CASE WHEN skipped THEN 'SKIPPED' || chr(10) || '_skipped: no runner_' || chr(10) WHEN errored THEN 'ERROR' || chr(10) || '_runner error: boom_' || chr(10) ELSE
  CASE WHEN matched THEN 'PASS' ELSE 'FAIL' END || chr(10) || '- Target style: `batch`' || chr(10) || '- Fields matched: ' || m || '/' || n || chr(10)
  || coalesce(chr(10) || '### Field mismatches' || chr(10) || chr(10) || '| Field | Expected | Actual | Reason |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || rows || chr(10), '')
  || CASE WHEN x > 0 THEN chr(10) || '### Extra fields in actual (not in fixture): `extra`' || chr(10) ELSE '' END END AS sec FROM f)
SELECT program_id, '# Dual-run verdict: ' || program_id || chr(10) || chr(10) || '- Fixtures: ' || count(*) || chr(10) || '- Matched: ' || count(*) FILTER (matched AND NOT skipped AND NOT errored) || chr(10) || '- Mismatched: ' || count(*) FILTER (NOT matched AND NOT skipped AND NOT errored)
  || chr(10) || '- Skipped: ' || count(*) FILTER (skipped) || chr(10) || '- Errored: ' || count(*) FILTER (errored) || chr(10) || '- **Overall: '
  || CASE WHEN count(*) FILTER (errored) = 0 AND count(*) FILTER (NOT matched AND NOT skipped AND NOT errored) = 0 THEN 'PASS' ELSE 'FAIL' END || '**' || chr(10) || chr(10)
  || rtrim(string_agg(sec, chr(10) ORDER BY fixture), chr(10)) || chr(10) AS report FROM b GROUP BY program_id""",
    "dualrun_of_program": f"""WITH {_FIELDS}, r AS (SELECT o_orderkey AS fixture, o_custkey % 5 = 0 AS skipped FROM orders WHERE o_custkey % 50 = 3), m AS (SELECT fixture, bool_and(status = 'matched') AS ok FROM g GROUP BY 1)
SELECT 'P3' AS program_id, count(*) AS total, count(*) FILTER (ok) AS matched FROM r JOIN m USING (fixture) HAVING count(*) > 0""",
    "filing_queue": """SELECT o_orderkey AS key, 'e' || o_orderkey AS entity, '{}' AS order_, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE 'UPSTREAM' END AS source, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS place
FROM orders WHERE o_orderkey % 3 > 0""",
    "summary_plan_roots": f"""{_G}, c AS (SELECT source AS root, 0 AS last, ord, target AS id FROM kg_edges WHERE kind = 'contains' UNION ALL SELECT id, 1, 0, id FROM kg_nodes WHERE kind = 'program')
SELECT row_number() OVER (ORDER BY root, last, ord, c.id) AS place, c.id FROM c JOIN kg_nodes n ON n.id = c.id WHERE n.name <> 'PARA-2' AND c.id NOT LIKE 'para:%:5'""",
    **{f"chunks_{language}": _chunk_oracle(language) for language in _CODE},
}
ORACLES["kg_artifact_lines"] = ORACLES["data_flow_mermaid"].replace(_LIFTED, f"{_LIFTED}, every AS (", 1) + ") SELECT unnest(string_split(line, chr(10))) AS line FROM every"
ORACLES["kg_artifact_nodes"] = f"{_G} SELECT id, kind, name, verb FROM kg_nodes"
