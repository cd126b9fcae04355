"""CRUD matrix of programs by resources, and integration seams ranked from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.ranking import numbered
from lodestrata.functions.tables import cut
from lodestrata.operators.graph import program_members

FLAGS = ("create_", "read_", "update_", "delete_", "touches_only")


def dd_lookup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dd, dataset): the last dataset bound to each DD name, by edge order."""
    names = nodes.where("kind = 'dataset_ref'").select(F.col("id").alias("target"), F.col("name").alias("dataset"))
    bound = edges.where("kind = 'dd_of' and dd_name is not null").join(names, "target")
    return bound.groupBy(F.upper("dd_name").alias("dd")).agg(F.max_by("dataset", F.struct("ord", "source")).alias("dataset"))


def symbol(of: str = "") -> Column:
    """The letters of the flags, whose columns end in ``of``."""
    letters = F.concat(*(F.when(F.col(f"{c}{of}"), x).otherwise("") for c, x in zip(FLAGS, "CRUD")))
    return F.coalesce(F.when(letters != "", letters), F.when(F.col(f"touches_only{of}"), "*"), F.lit("?"))


def _resources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, rkind, rname, own): what a read or write of a node touches; a file also touches the dataset its DD is bound to.

    The name of an SQL block is led by the program that touches it; ``own`` says so.
    """
    dd = dd_lookup(nodes, edges)
    kind = F.col("kind")
    typed = F.when(kind == "file", "file").when(kind == "dataset_ref", "dataset").when(kind == "sql_block", "sql_block").when(kind == "txn_call", "txn").otherwise("unknown")
    verb = F.coalesce("verb", F.lit("?"))
    block = F.concat(verb, F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("?")))
    name = F.when(kind == "txn_call", F.concat(F.lit("CICS-"), verb)).when(kind == "sql_block", block).otherwise(F.col("name"))
    own = nodes.select(F.col("id").alias("target"), typed.alias("rkind"), name.alias("rname"), (kind == "sql_block").alias("own"))
    files = nodes.where("kind = 'file' and dd_name is not null").select(F.col("id").alias("target"), F.upper("dd_name").alias("key"))
    short = F.when(F.col("key").startswith("DD"), F.expr("substr(key, 3)"))
    probe = files.select("target", "key", F.lit(0).alias("tier")).unionByName(files.select("target", short.alias("key"), F.lit(1).alias("tier")).where("key is not null"))
    found = probe.join(dd, probe["key"] == dd["dd"]).groupBy("target").agg(F.min_by("dataset", "tier").alias("rname"))
    return own.unionByName(found.select("target", F.lit("dataset").alias("rkind"), "rname", F.lit(False).alias("own")))


def crud_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(program, kind, name, flags, n_evidence, evidence, symbol). A read gives R, a write C and U; only paragraphs' edges count.

    nodes: (id, kind, name, dd_name, verb, start_line); edges: (source, target, kind, evidence, ord, dd_name). Edges are
    combined by (source, target, kind) before anything is joined, so the large side of every later join is the number
    of distinct pairs, not of facts; evidence is held once an edge, by ``ord``. What job control touches counts where
    nothing reads or writes it; both are told apart in one aggregate, so that reads and writes are joined once.
    """
    told = F.array_compact(F.collect_list(F.when(F.col("evidence").isNotNull(), F.struct("ord", "evidence"))))
    flow = edges.where(F.col("kind").isin("reads", "writes")).groupBy("source", "target", "kind").agg(F.count("*").alias("n"), told.alias("told"))
    names = nodes.where("kind = 'program'").select(F.col("id").alias("program"), F.col("name").alias("pname"))
    inside = program_members(nodes, edges).join(nodes.where("kind = 'paragraph'").select(F.col("id").alias("node")), "node").join(names, "program")
    rows = flow.join(inside.select("pname", F.col("node").alias("source")), "source").join(_resources(nodes, edges), "target")
    name = F.when(F.col("own"), F.concat_ws(":", "pname", "rname")).otherwise(F.col("rname"))
    used = rows.select(F.col("pname").alias("program"), F.col("rkind").alias("kind"), name.alias("name"), (F.col("kind") == "writes").alias("w"), F.lit(True).alias("used"), "n", "told")
    steps = edges.where("kind = 'step_of'").select(F.col("source").alias("program"), F.col("target").alias("step")).join(names, "program")
    bound = edges.where("kind = 'dd_of'").select(F.col("source").alias("step"), F.col("target").alias("id"), F.array(F.struct("ord", "evidence")).alias("told"))
    datasets = nodes.where("kind = 'dataset_ref'").select("id", F.col("name").alias("rname"))
    touched = steps.join(bound, "step").join(datasets, "id").select(
        F.col("pname").alias("program"), F.lit("dataset").alias("kind"), F.col("rname").alias("name"), F.lit(False).alias("w"), F.lit(False).alias("used"), F.lit(1).cast("long").alias("n"),
        F.filter("told", lambda x: x["evidence"].isNotNull()).alias("told"))
    evidence = lambda cond: F.transform(F.array_sort(F.flatten(F.collect_list(F.when(cond, F.col("told"))))), lambda x: x["evidence"])
    both = used.unionByName(touched).groupBy("program", "kind", "name").agg(
        F.bool_or("w").alias("c"), F.bool_or(F.col("used") & ~F.col("w")).alias("r"), F.sum(F.when(F.col("used"), F.col("n"))).alias("n_used"),
        F.sum(F.when(~F.col("used"), F.col("n"))).alias("n_touched"), evidence(F.col("used")).alias("e_used"), evidence(~F.col("used")).alias("e_touched"),
    )
    # a missing name is no other's equal: what is touched there stays beside what is used
    is_used, unnamed = F.col("n_used").isNotNull(), F.col("program").isNull() | F.col("name").isNull()
    both = both.withColumn("of", F.explode(F.when(unnamed & is_used & F.col("n_touched").isNotNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array(is_used))))
    of = F.col("of")
    creates = of & F.col("c")
    return both.select(
        "program", "kind", "name", creates.alias("create_"), (of & F.col("r")).alias("read_"), creates.alias("update_"), F.lit(False).alias("delete_"), (~of).alias("touches_only"),
        F.when(of, F.col("n_used")).otherwise(F.col("n_touched")).alias("n_evidence"), F.when(of, F.col("e_used")).otherwise(F.col("e_touched")).alias("evidence"),
    ).withColumn("symbol", symbol())


def programs_of(matrix: DataFrame) -> DataFrame:
    return matrix.select("program").distinct()


def resources_of(matrix: DataFrame) -> DataFrame:
    return matrix.select("kind", "name").distinct()


def resources_touched_by(matrix: DataFrame, program: str | None = None) -> DataFrame:
    """(program, kind, name), of one program or of all."""
    return (matrix if program is None else matrix.where(F.col("program") == program)).select("program", "kind", "name").distinct()


def programs_touching(matrix: DataFrame, kind: str | None = None, name: str | None = None) -> DataFrame:
    """(kind, name, program), of one resource or of all."""
    for column, value in (("kind", kind), ("name", name)):
        matrix = matrix if value is None else matrix.where(F.col(column) == value)
    return matrix.select("kind", "name", "program").distinct()


#: Resources that a text grid has columns for.
MOST_COLUMNS = 10_000


def readers_of(matrix: DataFrame) -> DataFrame:
    return matrix.where("read_").select("kind", "name", "program")


def writers_of(matrix: DataFrame) -> DataFrame:
    return matrix.where("create_ or update_ or delete_").select("kind", "name", "program")


def kind_grid(matrix: DataFrame, kinds: list[str]) -> DataFrame:
    """A row a program, a column a resource kind: the merged symbol, ``.`` where there is none."""
    here = lambda k: F.col("kind") == k
    flags = (F.bool_or(F.when(here(k), F.col(c))).alias(f"{c}{i}") for i, k in enumerate(kinds) for c in FLAGS)
    merged = matrix.groupBy("program").agg(*flags, *(F.count_if(here(k)).alias(f"n{i}") for i, k in enumerate(kinds)))
    return merged.select("program", *(F.when(F.col(f"n{i}") > 0, symbol(str(i))).otherwise(".").alias(k) for i, k in enumerate(kinds)))


def crud_grid(matrix: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """(line_no, line): the padded text grid, a header and a line a program, a column a resource (kind, name), of all if none are given.

    A line has as many cells as there are resources, so it is for a chosen set of them: more than MOST_COLUMNS are refused,
    as the header is sent to all tasks; ``kind_grid`` is the form for any number.
    """
    chosen = cut(resources_of(matrix) if resources is None else resources.select("kind", "name").distinct())
    n = chosen.count()
    if n > MOST_COLUMNS:
        raise ValueError(f"a grid of {n} columns; {MOST_COLUMNS} at most")
    shown = F.concat_ws(":", "kind", "name")
    head = chosen.agg(F.array_sort(F.collect_list(F.struct("kind", "name", shown.alias("shown")))).alias("r"), (F.coalesce(F.max(F.length(shown)), F.lit(10)) + 2).alias("w"))
    pad = lambda c, w: F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), w - F.length(c))))
    own = matrix.join(chosen, ["kind", "name"], "left_semi").groupBy("program").agg(F.map_from_entries(F.collect_list(F.struct(shown.alias("k"), "symbol"))).alias("m"))
    every = programs_of(matrix).join(own, "program", "left")
    cell = lambda x: pad(F.coalesce(F.try_element_at("m", x["shown"]), F.lit(".")), F.col("w"))
    each = every.join(F.broadcast(head))  # one row
    body = each.select("program", F.concat(pad(F.col("program"), 24), F.array_join(F.transform("r", cell), "")).alias("line"))
    top = head.select(F.lit(None).cast("string").alias("program"), F.concat(pad(F.lit("program"), 24), F.array_join(F.transform("r", lambda x: pad(x["shown"], F.col("w"))), "")).alias("line"))
    return numbered(top.unionByName(body), "line_no", [F.col("program").asc_nulls_first()]).select("line_no", "line")


def observable(kind: Column) -> Column:
    # The prior that a resource of a kind can be observed.
    return F.when(kind == "dataset", 1.0).when(kind == "txn", 0.8).when(kind == "sql_block", 0.5).when(kind == "file", 0.2).otherwise(0.1)


def seams(matrix: DataFrame, min_programs: int = 1) -> DataFrame:
    """(kind, name, n_programs, n_readers, n_writers, scores, total, rank): 0.4 observable + 0.4 funnel + 0.2 asymmetry.

    The funnel is relative to the most programs that touch any resource, taken before the filter. That
    maximum is a one-row aggregate. The matrix has a row a program and resource, so rows are counted, and held a row a
    resource; only for resources without a name, of which a program may have two, programs are told apart first. The
    counts are written once, as they are asked twice.
    """
    counted, lost = ("n_programs", "n_readers", "n_writers"), F.col("name").isNull()
    known = F.col("program").isNotNull()
    each = matrix.groupBy("kind", "name", F.when(lost, F.col("program")).alias("apart")).agg(
        F.count("program").alias("n_programs"), F.count_if(known & F.col("read_")).alias("n_readers"), F.count_if(known & F.expr("create_ or update_ or delete_")).alias("n_writers"))
    n = cut(each.groupBy("kind", "name").agg(*(F.sum(F.when(lost, F.least(F.col(c), F.lit(1))).otherwise(F.col(c))).alias(c) for c in counted)))
    most = n.agg(F.coalesce(F.max("n_programs"), F.lit(1)).alias("most"))
    r, w = F.col("n_readers"), F.col("n_writers")
    asymmetry = F.when((r == 0) & (w == 0), 0.0).otherwise(F.abs(r - w) / F.greatest(r, w))
    counts = ("kind", "name", "n_programs", "n_readers", "n_writers")
    parts = n.join(F.broadcast(most)).select(*counts, observable(F.col("kind")).alias("o"), (F.col("n_programs") / F.col("most")).alias("f"), asymmetry.alias("a"))
    return parts.where(F.col("n_programs") >= min_programs).select(
        *counts, F.round("o", 3).alias("observable_score"), F.round("f", 3).alias("funnel_score"), F.round("a", 3).alias("asymmetry_score"),
        F.round(F.lit(0.4) * F.col("o") + F.lit(0.4) * F.col("f") + F.lit(0.2) * F.col("a"), 3).alias("total_score"),
    )


def seam_rank(ranked: DataFrame) -> DataFrame:
    """Seams with their 1-based rank by total, kind and name, numbered from range-partitioned parts."""
    return numbered(ranked, "rank", [F.col("total_score").desc(), F.col("kind"), F.col("name")])


def seam_evidence(matrix: DataFrame) -> DataFrame:
    """(kind, name, evidence): who touches, reads, writes and only touches a resource, names in order."""
    names = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("program")))), ", ")
    writes = F.expr("create_ or update_ or delete_")
    g = matrix.groupBy("kind", "name").agg(F.count_distinct("program").alias("n"), names(F.col("read_")).alias("r"), names(writes).alias("w"), names(~F.col("read_") & ~writes).alias("t"))
    line = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    return g.select("kind", "name", F.concat_ws("\n", F.format_string("Touched by %d programs", "n"), line("Readers: ", "r"), line("Writers: ", "w"), line("Touches: ", "t")).alias("evidence"))


def seam_score_by_unit(matrix: DataFrame, ranked: DataFrame) -> DataFrame:
    """(program, seam_score): the best total of the seams a program reads or writes, 0 without any."""
    used = matrix.where("read_ or create_ or update_ or delete_").select("program", "kind", "name")
    best = used.join(ranked.select("kind", "name", "total_score"), ["kind", "name"]).groupBy("program").agg(F.max("total_score").alias("best"))
    return matrix.select("program").distinct().join(best, "program", "left").select("program", F.coalesce("best", F.lit(0.0)).alias("seam_score"))
