"""Text sinks: renders of the graphs as ordered lines, which a writer may put in files or join into one text.

A line has a place (section, owner, ord), so that renders stay tables however large a graph is. ``document`` joins
the lines of a graph that a reader can look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.tables import cut
from lodestrata.operators.fixed import EDGE_STYLES, NODE_SHAPES, UNIT_EDGE_COLOURS
from lodestrata.operators.graph import dataflow, program_members, union_all

CALL_NODES = ("program", "section", "paragraph", "external_call", "txn_call", "job", "step")
CALL_EDGES = ("performs", "calls", "step_of")
DATA_NODES = ("file", "dataset_ref", "sql_block", "txn_call")
_FONTS = '  node [fontname="Helvetica" fontsize=10];\n  edge [fontname="Helvetica" fontsize=9];'


def safe(c: Column | str) -> Column:
    """An id of letters, digits and underscores."""
    made = F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    return F.when(made == "", "n").otherwise(made)


def _attribute(key: str) -> Column:
    return F.try_element_at("attributes", F.lit(key))


def label() -> Column:
    """The label of a node (kind, name, attributes)."""
    name, kind = F.col("name"), F.col("kind")
    both = lambda prefix, text: F.concat(name, F.lit("\\n"), F.lit(prefix), text)
    dd, pgm, verb = _attribute("dd_name"), _attribute("pgm"), F.coalesce(_attribute("verb"), F.lit("?"))
    return (
        F.when(kind == "program", F.concat(F.lit("<b>"), name, F.lit("</b>\\n(program)")))
        .when(kind == "file", both("(FD", F.concat(F.coalesce(F.concat(F.lit(" → DD "), dd), F.lit("")), F.lit(")"))))
        .when(kind == "dataset_ref", both("(dataset)", F.lit("")))
        .when(kind.isin("step", "job") & pgm.isNotNull(), both("(step → ", F.concat(pgm, F.lit(")"))))
        .when(kind == "external_call", F.concat(F.lit("CALL '"), name, F.lit("'")))
        .when(kind == "txn_call", F.concat(F.lit("EXEC CICS "), verb))
        .when(kind == "sql_block", F.concat(F.lit("EXEC SQL "), verb))
        .otherwise(name)
    )


def _of(values: dict, index: int, key: Column, otherwise: str) -> Column:
    return F.coalesce(*(F.when(key == k, v[index]) for k, v in values.items()), F.lit(otherwise))


def _dot_node(indent: str) -> Column:
    kind = F.col("kind")
    added = _of({k: (v[2] or "",) for k, v in NODE_SHAPES.items()}, 0, kind, "")
    more = F.when(added == "bold", " penwidth=2").when(added == "filled", ' style="filled,rounded"').otherwise("")
    shape, fill = _of(NODE_SHAPES, 0, kind, "box"), _of(NODE_SHAPES, 1, kind, "#ffffff")
    return F.concat(F.lit(indent), safe("id"), F.lit(' [label="'), label(), F.lit('" shape='), shape, F.lit(' fillcolor="'), fill, F.lit('" style=filled'), more, F.lit("];"))


def _dot_edge() -> Column:
    colour, style = _of(EDGE_STYLES, 0, F.col("kind"), "#000000"), _of(EDGE_STYLES, 1, F.col("kind"), "solid")
    told = F.concat(F.lit(' [label="'), "kind", F.lit('" color="'), colour, F.lit('" style="'), style, F.lit('" fontcolor="'), colour, F.lit('"];'))
    return F.concat(F.lit("  "), safe("source"), F.lit(" -> "), safe("target"), told)


def _mermaid_edge() -> Column:
    return F.concat(F.lit("  "), safe("source"), F.lit(" -->|"), "kind", F.lit("| "), safe("target"))


def _rows(df: DataFrame, section: int, owner: Column, ord: Column, line: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), owner.cast("string").alias("owner"), ord.cast("string").alias("ord"), line.alias("line"))


def _frame(df: DataFrame, head: str, tail: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(0, "", "", head), (9, "", "", tail)], "section int, owner string, ord string, line string")


def call_graph(nodes: DataFrame, edges: DataFrame, form: str = "dot", members: DataFrame | None = None) -> DataFrame:
    """(section, owner, ord, line): programs as clusters of what they contain, jobs, steps and call targets outside of them, control-flow edges."""
    dot = form == "dot"
    inside = (program_members(nodes, edges) if members is None else members).where("program <> node")
    names = nodes.where("kind = 'program'").select(F.col("id").alias("program"), F.col("name").alias("owner"))
    kids = nodes.where(F.col("kind").isin(*CALL_NODES)).join(inside.withColumnRenamed("node", "id"), "id").join(names, "program")
    flow = edges.where(F.col("kind").isin(*CALL_EDGES)).groupBy("source", "target", "kind").agg(F.min("ord").alias("ord"))
    flow = flow.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    ends = flow.select(F.col("source").alias("id")).union(flow.select("target")).distinct()
    others = nodes.where("kind in ('job', 'step')").select("id").union(ends).distinct() if dot else ends
    shown = nodes.where("kind = 'program'").select("id").union(kids.select("id"))
    loose = nodes.join(others.join(shown, "id", "left_anti"), "id", "left_semi")
    own, name = nodes.where("kind = 'program'"), F.col("name")
    if dot:
        head = F.concat(F.lit("  subgraph cluster_"), safe("id"), F.lit(' {\n    label="'), name, F.lit('";\n    style="rounded,filled";\n    fillcolor="#f5f8fc";\n'), _dot_node("    "))
        frame, line, edge = _frame(nodes, "digraph call_graph {\n  rankdir=LR;\n" + _FONTS + "\n  compound=true;", "}"), _dot_node("    "), _dot_edge()
        outside, close = _dot_node("  "), "  }"
    else:
        head = F.concat(F.lit("  subgraph "), safe("id"), F.lit("["), name, F.lit("]\n    "), safe("id"), F.lit('_self["<b>'), name, F.lit('</b>"]'))
        boxed = lambda indent: F.concat(F.lit(indent), safe("id"), F.lit('["'), label(), F.lit('"]'))
        frame, line, edge, outside, close = _frame(nodes, "```mermaid\nflowchart LR", "```"), boxed("    "), _mermaid_edge(), boxed("  "), "  end"
    owner = F.concat_ws(chr(1), "name", "id")
    return union_all([
        frame, _rows(own, 1, owner, F.lit("0"), head), _rows(kids, 1, F.concat_ws(chr(1), "owner", "program"), F.concat(F.lit("1"), "id"), line),
        _rows(own, 1, owner, F.lit("2"), F.lit(close)), _rows(loose, 2, F.col("id"), F.lit(""), outside), _rows(flow, 3, F.lpad(F.col("ord").cast("string"), 20, "0"), F.concat_ws(">", "source", "target", "kind"), edge),
    ])


def data_flow(nodes: DataFrame, edges: DataFrame, form: str = "dot", lifted: DataFrame | None = None) -> DataFrame:
    """(section, owner, ord, line): programs and what they read or write, lifted from their paragraphs; in DOT also steps, their datasets and redefinitions."""
    shown = nodes.where((F.col("kind") == "program") | F.col("kind").isin(*DATA_NODES))
    data = nodes.where(F.col("kind").isin(*DATA_NODES)).select(F.col("id").alias("target"))
    flow = (dataflow(nodes, edges) if lifted is None else lifted).join(data, "target", "left_semi").select(F.col("program").alias("source"), "target", "kind")
    ends = F.concat_ws(">", "source", "target", "kind")
    if form == "mermaid":
        around = F.when(F.col("kind") == "dataset_ref", F.array(F.lit('[("'), F.lit('")]'))).when(F.col("kind") == "program", F.array(F.lit('["<b>'), F.lit('</b>"]'))).otherwise(F.array(F.lit('["'), F.lit('"]')))
        line = F.concat(F.lit("  "), safe("id"), around[0], label(), around[1])
        return union_all([_frame(nodes, "```mermaid\nflowchart LR", "```"), _rows(shown, 1, F.col("id"), F.lit(""), line), _rows(flow, 3, ends, F.lit(""), _mermaid_edge())])
    jobs = edges.where("kind in ('dd_of', 'step_of')").select("source", "target", "kind").distinct()
    steps = jobs.select(F.col("source").alias("id")).distinct().join(shown.select("id"), "id", "left_anti")
    drawn = shown.select("id").union(steps)
    to = drawn.withColumnRenamed("id", "target")
    jobs = jobs.join(to, "target", "left_semi")
    over = edges.where("kind = 'redefines'").select("source", "target", "kind").distinct().join(to, "target", "left_semi").join(drawn.withColumnRenamed("id", "source"), "source", "left_semi")
    return union_all([
        _frame(nodes, "digraph dataflow {\n  rankdir=LR;\n" + _FONTS, "}"), _rows(shown, 1, F.col("id"), F.lit(""), _dot_node("  ")), _rows(nodes.join(steps, "id", "left_semi"), 2, F.col("id"), F.lit(""), _dot_node("  ")),
        _rows(flow.unionByName(jobs).unionByName(over), 3, ends, F.lit(""), _dot_edge()),
    ])


def unit_graph(units: DataFrame, resources: DataFrame, edges: DataFrame, form: str = "dot") -> DataFrame:
    """(section, owner, ord, line): units (unit_id), resources (provider, kind, name) and edges (source_unit, target_unit, resource, kind, ord) of the dependency graph.

    An edge goes to its unit if it has one, else to its resource (``provider:kind:name``).
    """
    dot = form == "dot"
    own = F.concat_ws("_", "provider", "kind", F.coalesce(F.nullif("name", F.lit("")), F.lit("unknown")))
    part = lambda n: F.split_part("resource", F.lit(":"), F.lit(n))
    named = F.concat_ws("_", part(1), part(2), F.when(part(3) == "?", "unknown").otherwise(F.expr("substr(resource, length(split_part(resource, ':', 1)) + length(split_part(resource, ':', 2)) + 3)")))
    target = F.coalesce("target_unit", named)
    shown = F.coalesce(F.nullif("name", F.lit("")), F.lit("?"))
    if dot:
        unit = F.concat(F.lit("  "), safe("unit_id"), F.lit(' [label="'), "unit_id", F.lit('" shape="box" style="filled" fillcolor="#cde4ff"];'))
        box = F.concat(F.lit("  "), safe(own), F.lit(' [label="'), "kind", F.lit("\\n"), shown, F.lit('" shape="cylinder" style="filled" fillcolor="#ffe0b3"];'))
        colour = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in UNIT_EDGE_COLOURS.items()), F.lit("#000000"))
        edge = F.concat(F.lit("  "), safe("source_unit"), F.lit(" -> "), safe(target), F.lit(' [label="'), "kind", F.lit('" color="'), colour, F.lit('" fontcolor="'), colour, F.lit('"];'))
        frame = _frame(units, "digraph G {\n  rankdir=LR;\n" + _FONTS, "}")
    else:
        unit = F.concat(F.lit("    "), safe("unit_id"), F.lit("["), "unit_id", F.lit("]"))
        box = F.concat(F.lit("    "), safe(own), F.lit("[("), "kind", F.lit(": "), shown, F.lit(")]"))
        edge = F.concat(F.lit("    "), safe("source_unit"), F.lit(" -->|"), "kind", F.lit("| "), safe(target))
        frame = _frame(units, "```mermaid\nflowchart LR", "```")
    drawn = edges.where(target.isNotNull())
    place = F.concat_ws(">", "source_unit", target, "kind")
    return union_all([frame, _rows(units, 1, F.col("unit_id"), F.lit(""), unit), _rows(resources, 2, own, F.lit(""), box), _rows(drawn, 3, place, F.lit(""), edge)])


def document(lines: DataFrame) -> DataFrame:
    """One text of all lines in the order of their places; for graphs that a reader can look at."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "owner", "ord", "line")))
    return lines.agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in files whose names follow the order of places, range-partitioned, for graphs of any size."""
    places = ("section", "owner", "ord")
    # written once: ranges are sampled from what is then dealt
    lines = cut(lines)
    lines.repartitionByRange(*places).sortWithinPartitions(*places).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def export_graph(nodes: DataFrame, edges: DataFrame, units: DataFrame, path: str) -> list[str]:
    """The graph's tables, the units' records and the four renders below ``path``, unless they are there; the parts that were written."""
    from lodestrata.sources.files import write_snapshot

    spark = nodes.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/DONE")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(done):
        return []
    # all parts ask the same tables, members and flow
    nodes, edges = cut(nodes), cut(edges)
    members = cut(program_members(nodes, edges))
    lifted = cut(dataflow(nodes, edges, members))
    write_snapshot(nodes, edges, f"{path}/kg")
    units.write.mode("overwrite").json(f"{path}/units")
    renders = {f"call_graph.{end}": call_graph(nodes, edges, form, members) for end, form in (("dot", "dot"), ("mmd", "mermaid"))}
    renders |= {f"dataflow.{end}": data_flow(nodes, edges, form, lifted) for end, form in (("dot", "dot"), ("mmd", "mermaid"))}
    for name, lines in renders.items():
        write_lines(lines, f"{path}/graphs/{name}")
    fs.create(done).close()
    return ["kg/nodes", "kg/edges", "units", *(f"graphs/{name}" for name in renders)]
