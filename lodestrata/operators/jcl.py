"""Job control: cards, facts, and their projection to the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.tables import cut
from lodestrata.functions.text import any_case, group, lines
from lodestrata.operators.fixed import DATASET_NAME, DD_CARD, EXEC_CARD, JOB_CARD, SYSOUT_CLASS
from lodestrata.operators.graph import edge_rows, node_rows, union_all


def cards(files: DataFrame) -> DataFrame:
    """(path, line_no, card): logical cards with their first line; a line of ``//`` and a blank goes on with the card before it.

    Comments and lines that don't start with ``//`` are left out, as is what goes on with no card.
    """
    own = lines(files).where("line like '//%' and line not like '//*%'").withColumn("first", ~F.col("line").startswith("// "))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = own.withColumn("card_no", F.sum(F.col("first").cast("int")).over(w)).where("card_no > 0")
    piece = F.when(F.col("first"), F.rtrim("line")).otherwise(F.trim(F.expr("substr(line, 3)")))
    g = numbered.groupBy("path", "card_no").agg(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("piece")))).alias("p"))
    return g.select("path", F.element_at("p", 1)["line_no"].alias("line_no"), F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("card"))


def _dataset(body: Column) -> Column:
    named = F.substring_index(group(body, any_case(DATASET_NAME)), "(", 1)
    return F.coalesce(named, F.concat(F.lit("SYSOUT-"), group(body, any_case(SYSOUT_CLASS))))


def facts(own: DataFrame) -> DataFrame:
    """(path, line_no, kind, job, step, program, dd, dataset) of cards: jobs, steps, and the datasets bound to a step of the job."""
    x = lambda p, g=1: group(F.col("card"), any_case(p), g)
    c = own.select(
        "path", "line_no", x(JOB_CARD).alias("j"), x(EXEC_CARD).alias("s"), x(EXEC_CARD, 2).alias("program"), x(DD_CARD).alias("dd"), _dataset(x(DD_CARD, 2)).alias("dataset")
    )
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("s", F.when(F.col("j").isNull(), F.col("s")))
    tagged = c.withColumns({"job": F.last("j", True).over(w), "job_line": F.last(F.when(F.col("j").isNotNull(), F.col("line_no")), True).over(w)})
    # a job starts without a step
    in_job = Window.partitionBy("path", "job_line").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    tagged = tagged.withColumn("step", F.last("s", True).over(in_job))
    bound = F.col("dd").isNotNull() & F.col("dataset").isNotNull() & F.col("step").isNotNull()
    kind = F.when(F.col("j").isNotNull(), "job").when(F.col("s").isNotNull(), "step").when(bound, "dd")
    return tagged.select(
        "path", "line_no", kind.alias("kind"), "job", F.when(kind != "job", F.col("step")).alias("step"), F.when(kind == "step", F.col("program")).alias("program"),
        F.when(kind == "dd", F.col("dd")).alias("dd"), F.when(kind == "dd", F.col("dataset")).alias("dataset"),
    ).where("kind is not null")


def graph_of(files: DataFrame, programs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of job control (path, text): jobs, steps and datasets; a step hangs under its program if ``programs`` (program) has it."""
    f = cut(facts(cards(files)).withColumns({c: F.upper(c) for c in ("job", "step", "program", "dd")}))
    job, dataset = F.concat(F.lit("job:"), F.coalesce("job", F.lit("?"))), F.concat(F.lit("dataset_ref:"), "dataset")
    step = F.concat(F.lit("step:"), F.coalesce("job", F.lit("?")), F.lit(":"), "step")
    pgm = F.concat(F.lit("program:"), "program")
    at = F.concat_ws(":", "path", "line_no")
    blank, line = F.lit(None).cast("string"), F.col("line_no")
    jobs, steps, dds = (f.where(F.col("kind") == k) for k in ("job", "step", "dd"))
    nodes = union_all([
        node_rows(jobs, job, F.lit("job"), F.col("job"), line, line, blank),
        node_rows(steps, step, F.lit("step"), F.col("step"), line, line, blank, F.create_map(F.lit("pgm"), F.col("program"))),
        # a dataset is told by the first card that binds it
        node_rows(dds.groupBy("dataset").agg(F.min(F.struct("path", "line_no")).alias("m")).select("dataset", "m.*"), dataset, F.lit("dataset_ref"), F.col("dataset"), line, line, blank),
    ])
    known = steps.join(programs.select("program").distinct(), "program", "left_semi")
    edges = union_all([
        edge_rows(steps.where("job is not null"), job, step, F.lit("contains"), at, line),
        edge_rows(known, pgm, step, F.lit("step_of"), F.concat(at, F.lit(" PGM="), "program"), line),
        edge_rows(dds, step, dataset, F.lit("dd_of"), F.concat(at, F.lit(" DD "), "dd"), line, F.create_map(F.lit("dd_name"), F.col("dd"))),
    ])
    return nodes, edges
