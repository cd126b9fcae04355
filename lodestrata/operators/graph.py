"""Property-graph operators over kg_nodes (id, kind, name, ...) and kg_edges (source, target, kind, evidence, ord).

Extractors give nodes as NODE and edges as EDGE; the operators here need the columns that they name only.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.ranking import numbered, running
from lodestrata.functions.tables import cut, drop

NODE = "id string, kind string, name string, file string, start_line int, end_line int, raw_text string, attributes map<string,string>, ord long"
EDGE = "source string, target string, kind string, evidence string, attributes map<string,string>, ord long"


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _none() -> Column:
    return F.lit(None).cast("map<string,string>")


def node_rows(df: DataFrame, id: Column, kind: Column, name: Column, start: Column, end: Column, raw: Column, attributes: Column | None = None) -> DataFrame:
    """Rows of ``df`` (path, ...) as NODE; ``ord`` is the first line, so that the last of an id in a file stands."""
    empty = F.create_map().cast("map<string,string>")
    return df.select(
        id.alias("id"), kind.alias("kind"), name.alias("name"), F.col("path").alias("file"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"),
        raw.alias("raw_text"), (empty if attributes is None else attributes).alias("attributes"), F.coalesce(start.cast("long"), F.lit(0)).alias("ord"),
    )


def edge_rows(df: DataFrame, source: Column, target: Column, kind: Column, evidence: Column, ord: Column, attributes: Column | None = None) -> DataFrame:
    """Rows of ``df`` as EDGE."""
    return df.select(
        source.alias("source"), target.alias("target"), kind.alias("kind"), evidence.alias("evidence"), (_none() if attributes is None else attributes).alias("attributes"), ord.cast("long").alias("ord"),
    )


def flat(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NODE and EDGE with the attributes that the matrix reads as columns: dd_name and verb of nodes, dd_name of edges."""
    a = lambda k: F.try_element_at("attributes", F.lit(k)).alias(k)
    return nodes.select("id", "kind", "name", a("dd_name"), a("verb"), "start_line"), edges.select("source", "target", "kind", "evidence", "ord", a("dd_name"))


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """The last row of each id by ``ord`` (add_node, update_node): an aggregate that is combined before its exchange."""
    rest = [c for c in nodes.columns if c != "id"]
    return nodes.groupBy("id").agg(F.max_by(F.struct(*rest), "ord").alias("_r")).select(*(F.col(f"_r.{c}").alias(c) if c != "id" else F.col(c) for c in nodes.columns))


def edges_where(edges: DataFrame, source: str | None = None, target: str | None = None, kind: str | None = None) -> DataFrame:
    """Edges that have all the ends and the kind that are given."""
    for column, value in (("source", source), ("target", target), ("kind", kind)):
        edges = edges if value is None else edges.where(F.col(column) == value)
    return edges


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Non-null fields of ``changes`` (by id) replace those of ``nodes``; ids without a node are dropped, see ``missing_updates``."""
    own = [c for c in changes.columns if c != "id"]
    joined = nodes.join(changes.select("id", *(F.col(c).alias(f"_{c}") for c in own)), "id", "left")
    return joined.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in own else F.col(c) for c in nodes.columns))


def missing_updates(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.join(nodes.select("id"), "id", "left_anti")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges once per (source, target, kind, evidence), the first by ``ord``."""
    return edges.groupBy("source", "target", "kind", "evidence").agg(F.min("ord").alias("ord"))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an endpoint that is no node."""
    ids = nodes.select(F.col("id"))
    source = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    target = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return source.select(*edges.columns).unionByName(target.select(*edges.columns)).distinct()


def of_kinds(edges: DataFrame, kinds: Iterable[str] | None) -> DataFrame:
    return edges if kinds is None else edges.where(F.col("kind").isin(*kinds))


def neighbors(edges: DataFrame, direction: str = "out", kinds: Iterable[str] | None = None) -> DataFrame:
    """(id, neighbor), distinct, for all nodes at once; filter by id for one."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction is out, in or both, not {direction!r}")
    e = of_kinds(edges, kinds)
    out = e.select(F.col("source").alias("id"), F.col("target").alias("neighbor"))
    into = e.select(F.col("target").alias("id"), F.col("source").alias("neighbor"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct()


def closure(edges: DataFrame, roots: DataFrame, kinds: Iterable[str] | None = None, include_root: bool = False) -> DataFrame:
    """(root, node) reachable from ``roots`` (root), all roots at once, cycles or not.

    Each round joins the frontier with the edges and drops pairs already seen; a round's pairs are written
    to the shared folder, so lineage stays one round deep.
    """
    step = cut(of_kinds(edges, kinds).select(F.col("source").alias("node"), F.col("target").alias("next")).distinct())
    start = roots.select("root").distinct().withColumn("node", F.col("root"))
    seen = frontier = cut(start)
    while True:
        found = frontier.join(step, "node").select("root", F.col("next").alias("node")).distinct()
        frontier = cut(found.join(seen, ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if include_root else seen.where("root <> node")


def reaching(edges: DataFrame, targets: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """(node): all nodes from which one of ``targets`` (node) is reached, and the targets.

    One frontier goes backward from all targets at once, so a node is a row once, in whatever number of them it ends; no
    pairs are made.
    """
    back = cut(of_kinds(edges, kinds).select(F.col("target").alias("node"), F.col("source").alias("before")).distinct())
    seen = frontier = cut(targets.select("node").distinct())
    while True:
        found = frontier.join(back, "node").select(F.col("before").alias("node")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def forest_order(nodes: DataFrame, edges: DataFrame, kinds: Iterable[str] = ("contains",)) -> DataFrame:
    """(id, root, place, height, size): depth-first order of a forest, children before parents; place counts from 0 within a tree.

    Children come in the order of their edges, then of their ids. No task holds a tree: nodes are numbered from the sizes
    of subtrees, which are added up level by level from below, and the sizes of the siblings before, which are running
    sums over ranges, so that neither a large tree nor a node of many children is one task's. Rounds are as many as the
    forest is high. A node with two parents, or on a cycle, is refused.
    """
    e = of_kinds(edges, kinds).where("source <> target").groupBy("source", "target").agg(F.min("ord").alias("ord"))
    e = cut(e.select(F.col("source").alias("parent"), F.col("target").alias("id"), "ord"))
    two = e.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").head()
    if two is not None:
        raise ValueError(f"{two['id']} has {two['n']} parents")
    every = cut(nodes.select("id").distinct())
    top = every.join(e.select("id"), "id", "left_anti").select(F.lit(None).cast("string").alias("parent"), "id", F.lit(0).cast("long").alias("ord"), F.col("id").alias("root"))
    levels = [cut(top)]
    while True:
        below = cut(levels[-1].select(F.col("id").alias("parent"), "root").join(e, "parent").select("parent", "id", "ord", "root"))
        if below.isEmpty():
            break
        levels.append(below)
    if sum(x.count() for x in levels) < every.count():
        raise ValueError("the graph has a cycle")
    sized, below = [], None
    for level in reversed(levels):
        one = level.withColumns({"size": F.lit(1).cast("long"), "height": F.lit(0)})
        if below is not None:
            add = below.groupBy(F.col("parent").alias("id")).agg((F.sum("size") + 1).alias("more"), (F.max("height") + 1).alias("up"))
            one = level.join(add, "id", "left").select("parent", "id", "ord", "root", F.coalesce("more", F.lit(1)).alias("size"), F.coalesce("up", F.lit(0)).alias("height"))
        below = cut(one)
        sized.append(below)
    out, above = None, None
    for level in reversed(sized):
        if above is None:
            begun = level.withColumn("begin", F.lit(0).cast("long"))
        else:
            run = running(level, "upto", "size", ["ord", "id"], ("parent",))
            begun = run.join(above, "parent").select("parent", "id", "ord", "root", "size", "height", (F.col("first") + F.col("upto") - F.col("size")).alias("begin"))
        begun = cut(begun)
        above = begun.select(F.col("id").alias("parent"), F.col("begin").alias("first"))
        placed = begun.select("id", "root", (F.col("begin") + F.col("size") - 1).alias("place"), "height", "size")
        out = placed if out is None else out.unionByName(placed)
    return out


def ancestors(edges: DataFrame, nodes: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """(root, node): nodes that reach root. On a cycle a node is its own ancestor."""
    swapped = of_kinds(edges, kinds).select(F.col("target").alias("source"), F.col("source").alias("target"), "kind")
    reached = closure(swapped, nodes, include_root=True)
    back = reached.join(swapped.select(F.col("source").alias("node"), F.col("target").alias("root")), ["root", "node"], "left_semi").select("root", F.col("root").alias("node"))
    return reached.where("root <> node").unionByName(back.distinct())


def roots(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """Nodes without an incoming edge of this kind."""
    return nodes.join(edges.where(F.col("kind") == kind).select(F.col("target").alias("id")), "id", "left_anti")


#: Edges that one task holds at most when layers are counted through, and the share of open edges from which the others are still read past.
BATCH_EDGES, OPEN_SHARE = 1 << 21, 0.75


def coded(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(names, step): the (id, code) of all ends of ``edges`` and of ``nodes`` (id), codes in the order of ids, and the distinct edges (source, target) in codes, without loops."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target"))
    ends = ends if nodes is None else ends.union(nodes.select("id"))
    names = cut(numbered(ends.where("id is not null").distinct(), "code", [F.col("id")]))
    a, b = names.select(F.col("id").alias("source"), F.col("code").alias("a")), names.select(F.col("id").alias("target"), F.col("code").alias("b"))
    return names, cut(edges.where("source <> target").join(a, "source").join(b, "target").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct())


def _settled(part: pd.DataFrame) -> pd.DataFrame:
    """(id, height) of the sources of edges (source, base, target, known, state) all of whose targets are known or follow in turn from known ones."""
    m = len(part)
    codes, names = pd.factorize(pd.concat([part["source"], part["target"]], ignore_index=True))
    source, target = codes[:m], codes[m:]
    height = np.zeros(len(names), np.int64)
    height[source] = part["base"]
    free = (part["state"] == 0).to_numpy()
    height[target[free]] = part["known"].to_numpy()[free]
    waits, order = np.bincount(source, minlength=len(names)).tolist(), np.argsort(target, kind="stable")
    begin, before = np.searchsorted(target[order], np.arange(len(names) + 1)).tolist(), source[order]
    ready, height, out = np.unique(target[free]).tolist(), height.tolist(), []
    while ready:
        x = ready.pop()
        for y in before[begin[x]:begin[x + 1]].tolist():
            height[y] = max(height[y], height[x] + 1)
            waits[y] -= 1
            if not waits[y]:
                ready.append(y)
                out.append(y)
    return pd.DataFrame({"id": np.asarray(names)[out], "height": [height[y] for y in out]})


def layered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, left): the (id, height) of the nodes that reach no cycle, 0 without successors, else one more than the highest successor; the (id) of the rest.

    A round places the nodes whose successors are all placed, and what follows from them among the nodes of fewest open
    edges: as many of those as have BATCH_EDGES together go to one task, which counts through all their layers. So rounds
    go with the number of edges, not with the number of layers, and what a task holds doesn't grow with the graph. A
    round exchanges what it tells of nodes; edges are read past, and written anew only when a part of them is closed.
    """
    every = cut(nodes.select("id").distinct())
    own = lambda name: every.withColumnRenamed("id", name)
    step = edges.select("source", "target").where("source <> target").distinct()
    step = cut(step.join(own("source"), "source", "left_semi").join(own("target"), "target", "left_semi").select("source", "target"))
    # nodes by the number of their open edges, in classes of which there are a few hundred at most
    size = F.when(F.col("n") == 0, 0).otherwise((8 * F.log2("n")).cast("int") + 1).alias("size")
    n = step.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    left, placed, written = every.join(n, "id", "left").select("id", F.lit(0).alias("base"), F.coalesce("n", F.lit(0)).alias("n")), None, 0
    left = cut(left.select("id", "base", "n", size))
    while True:
        held = {r["size"]: r["n"] for r in left.groupBy("size").agg(F.sum("n").alias("n")).collect()}
        if 0 not in held:
            placed = every.select("id", F.lit(0).alias("height")).where("false") if placed is None else placed
            return placed, left.select("id")
        now = sum(held.values())
        if now < OPEN_SHARE * written:
            kept = cut(step.join(left.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target"))
            drop(step)
            step = kept
        written = now if now < OPEN_SHARE * written else max(written, now)
        most = total = 0
        for k in sorted(held)[1:]:
            total += held[k]
            if total > BATCH_EDGES:
                break
            most = k
        found = left.where("size = 0").select("id", F.col("base").alias("height"))
        if most:
            state = F.when(F.col("size") == 0, 0).when(F.col("size") <= most, 1).otherwise(2).alias("state")
            asked = step.join(left.where(F.col("size").between(1, most)).select(F.col("id").alias("source"), "base"), "source")
            asked = asked.join(left.select(F.col("id").alias("target"), F.col("base").alias("known"), state), "target").select("source", "base", "target", "known", "state")
            found = found.unionByName(asked.groupBy().applyInPandas(_settled, f"id {every.schema['id'].dataType.simpleString()}, height int"))
        found = cut(found)
        placed = found if placed is None else placed.unionByName(found)
        up = step.join(found.withColumnRenamed("id", "target"), "target").groupBy(F.col("source").alias("id")).agg((F.max("height") + 1).alias("up"), F.count("*").alias("closed"))
        rest = left.join(found, "id", "left_anti").join(up, "id", "left")
        rest = cut(rest.select("id", F.greatest("base", F.coalesce("up", "base")).alias("base"), (F.col("n") - F.coalesce("closed", F.lit(0))).alias("n")).select("id", "base", "n", size))
        drop(left)
        left = rest


def heights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, height) of an acyclic graph: 0 without successors, else one more than the highest successor.

    Processing by height is a post-order (children before parents). A graph with cycles is condensed first.
    """
    placed, left = layered(nodes, edges)
    if not left.isEmpty():
        raise ValueError("the graph has a cycle")
    return placed


def post_order(edges: DataFrame, roots: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """(root, pos, node): depth-first from each of ``roots`` (root), children before parents, each node once, cycles or not.

    Children come in the order of their edges. A task holds what one root reaches.
    """
    e = of_kinds(edges, kinds).groupBy("source", "target").agg(F.min("ord").alias("ord"))
    reached = closure(edges, roots, kinds, include_root=True)
    own = reached.join(e.withColumnRenamed("source", "node"), "node", "left").select("root", "node", "target", "ord")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list[str]] = {}
        for node, target in part.dropna(subset=["target"]).sort_values(["ord", "target"], kind="stable")[["node", "target"]].itertuples(index=False):
            after.setdefault(node, []).append(target)
        root = part["root"].iloc[0]
        seen, out, stack = {root}, [], [(root, iter(after.get(root, ())))]
        while stack:
            node, rest = stack[-1]
            for child in rest:
                if child not in seen:
                    seen.add(child)
                    stack.append((child, iter(after.get(child, ()))))
                    break
            else:
                out.append(stack.pop()[0])
        return pd.DataFrame({"root": root, "pos": range(len(out)), "node": out})

    return own.groupBy("root").applyInPandas(walk, "root string, pos long, node string")


def centrality(nodes: DataFrame, edges: DataFrame, top: int | None = None) -> DataFrame:
    """(id, name, score) of programs: 3 for an incoming call, 2 for a step, 1 for a contained node."""
    weight = F.when(F.col("kind") == "step_of", 2).when(F.col("kind") == "contains", 1)
    out = edges.select(F.col("source").alias("id"), weight.alias("w")).where("w is not null")
    into = edges.where("kind = 'calls'").select(F.col("target").alias("id"), F.lit(3).alias("w"))
    total = out.unionByName(into).groupBy("id").agg(F.sum("w").alias("w"))
    scored = nodes.where("kind = 'program'").join(total, "id", "left").select("id", "name", F.coalesce("w", F.lit(0)).cast("long").alias("score"))
    return scored if top is None else scored.orderBy(F.col("score").desc(), "name").limit(top)


def resolved_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with calls of external programs led to the program of that name (in any case, of several the least id), where the graph has it.

    With them, centrality's incoming calls count what extractors can only name.
    """
    named = nodes.where("kind = 'program'").groupBy(F.upper("name").alias("called")).agg(F.min("id").alias("program"))
    to = nodes.where("kind = 'external_call'").select(F.col("id").alias("target"), F.upper("name").alias("called")).join(named, "called").select("target", "program")
    led = edges.join(to, "target", "left").withColumn("target", F.when(F.col("kind") == "calls", F.coalesce("program", "target")).otherwise(F.col("target")))
    return led.select(*edges.columns)


def program_level_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(program, kind, n): reads and writes that hang under a program itself, which the matrix, made of paragraphs' facts, doesn't have."""
    own = nodes.where("kind = 'program'").select(F.col("id").alias("source"), F.col("name").alias("program"))
    return edges.where("kind in ('reads', 'writes')").join(own, "source").groupBy("program", "kind").agg(F.count("*").alias("n"))


def call_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(program, source, target, kind): control-flow edges by the program that contains their source."""
    own = program_members(nodes, edges)
    flow = edges.where(F.col("kind").isin("performs", "calls", "step_of")).select("source", "target", "kind").distinct()
    return flow.join(own.select("program", F.col("node").alias("source")), "source").select("program", "source", "target", "kind")


def program_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(program, node): each program with itself and what it contains, at any depth."""
    programs = nodes.where("kind = 'program'").select(F.col("id").alias("root"))
    return closure(edges, programs, ["contains"], include_root=True).select(F.col("root").alias("program"), "node")


def dataflow(nodes: DataFrame, edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(program, target, kind): reads and writes lifted to programs; a write beats a read. ``members`` are those of program_members, where they are there."""
    flow = edges.where(F.col("kind").isin("reads", "writes")).groupBy("source", "target").agg(F.max("kind").alias("kind"))
    members = program_members(nodes, edges) if members is None else members
    lifted = flow.join(members.withColumnRenamed("node", "source"), "source")
    return lifted.groupBy("program", "target").agg(F.max("kind").alias("kind"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(id, cluster) of all nodes of a simple digraph: the least member's name for larger components, else the node itself."""
    names, step = coded(edges)
    every = step.select(F.col("source").alias("code")).union(step.select("target")).distinct()
    return every.join(names, "code").join(named_components(names, components(step)), "code", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def named_components(names: DataFrame, found: DataFrame) -> DataFrame:
    """(code, cluster): the members of larger components (id, least), with the names of their clusters."""
    least = names.select(F.col("code").alias("least"), F.concat(F.lit("cluster-"), "id").alias("cluster"))
    return found.join(least, "least").select(F.col("id").alias("code"), "cluster")


def components(step: DataFrame) -> DataFrame:
    """(id, least): the members of the strongly connected components of more than one node of distinct edges (source, target) without loops.

    Nodes outside of cycles are trimmed first, from both ends; only what is left, the cyclic
    cores, takes more: colors that spread along the edges and back, whose joins carry an edge once a round, not the pairs of
    nodes that reach each other. After the first round only nodes whose color has changed tell it on. All components of a core are found at once.
    """
    every = step.select(F.col("source").alias("id")).union(step.select("target")).distinct()
    within = lambda e, ids: e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")
    _, left = layered(every, step)
    core = cut(within(step, left))
    if not core.isEmpty():
        _, left = layered(left, core.select(F.col("target").alias("source"), F.col("source").alias("target")))
        core = cut(within(core, left))
    if core.isEmpty():
        return every.select("id", F.col("id").alias("least")).where("false")
    found = None
    while not core.isEmpty():
        # the least node that reaches each node; of those nodes, the ones that reach it back are its component
        color = core.select(F.col("source").alias("id")).union(core.select("target")).distinct().withColumn("color", F.col("id"))
        near = core.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("near"))
        while True:
            told = cut(color.join(near, "id", "left").select("id", F.col("color").alias("old"), F.least("color", F.coalesce("near", "color")).alias("color")))
            moved, color = told.where("old <> color"), told.select("id", "color")
            if moved.isEmpty():
                break
            near = core.join(moved.select(F.col("id").alias("source"), "color"), "source").groupBy(F.col("target").alias("id")).agg(F.min("color").alias("near"))
        inside = core.join(color.select(F.col("id").alias("source"), F.col("color").alias("a")), "source").join(color.select(F.col("id").alias("target"), F.col("color").alias("b")), "target")
        inside = cut(inside.where("a = b").select("source", "target"))
        part = frontier = cut(color.where("id = color"))
        while True:
            back = inside.join(frontier.withColumnRenamed("id", "target"), "target").select(F.col("source").alias("id"), "color").distinct()
            frontier = cut(back.join(part, "id", "left_anti"))
            if frontier.isEmpty():
                break
            part = part.unionByName(frontier)
        part = cut(part)
        found = part if found is None else found.unionByName(part)
        # a component has one color
        rest = inside.join(part.select(F.col("id").alias("source")), "source", "left_anti").join(part.select(F.col("id").alias("target")), "target", "left_anti")
        core = cut(rest.select("source", "target"))
    return cut(found.join(found.groupBy("color").agg(F.count("*").alias("n")).where("n > 1").select("color"), "color", "left_semi").select("id", F.col("color").alias("least")))
