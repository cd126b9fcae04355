"""From extracted facts of units to the knowledge graph, and to typed hints of the dependency graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.tables import cut
from lodestrata.functions.text import stem
from lodestrata.operators.extract import access
from lodestrata.operators.fixed import GRAPH_EDGES, HINT_EDGES
from lodestrata.operators.graph import edge_rows, node_rows, union_all
from lodestrata.operators.spans import holding


def _mapped(how: Column, kinds: dict[str, str], rest: str) -> Column:
    return F.coalesce(*(F.when(how == k, v) for k, v in kinds.items()), F.lit(rest))


def in_functions(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``calls`` (unit_id, file, line, ord, ...) with the name of the first function (unit_id, file, ord, name, start_line, end_line) that holds each.

    Functions may be nested; a call meets only those around it.
    """
    near = holding(calls.select("unit_id", "file", "line", "ord"), functions.select("unit_id", "file", "name", "start_line", "end_line", F.col("ord").alias("place")), ["unit_id", "file"])
    first = near.groupBy("unit_id", "ord").agg(F.min_by("name", "place").alias("function"))
    return calls.join(first, ["unit_id", "ord"], "left")


def graph_of(units: DataFrame, calls: DataFrame, functions: DataFrame, runtime: str = "aws-lambda") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of units (unit_id, language, root_path, handler_entry, first_file, loc).

    calls: (unit_id, ord, service, operation, name, file, line); functions: (unit_id, ord, name, file, start_line,
    end_line, raw_text), none for languages without them. A unit is a program, a function a paragraph; calls outside of
    functions hang under ``_module_`` where the unit has functions, else under ``_file_`` and the file's stem. A service's
    operation is one external call of the unit; what it does to a resource is an edge from the paragraph to a dataset.
    """
    own = in_functions(calls, functions)
    has = functions.select("unit_id").distinct().withColumn("has", F.lit(True))
    fallback = F.when(F.col("has"), "_module_").otherwise(F.concat(F.lit("_file_"), stem(F.col("file"))))
    kind, how = access(F.col("service"), F.col("operation"))
    own = own.join(has, "unit_id", "left").withColumns({"paragraph": F.coalesce("function", fallback), "rkind": kind, "access": how, "name": F.nullif("name", F.lit(""))})
    own = cut(own.withColumn("path", F.col("file")))
    program = F.concat(F.lit("program:"), "unit_id")
    para = lambda c: F.concat_ws(":", F.lit("paragraph"), "unit_id", c)
    ext = F.concat_ws(":", F.lit("external_call"), "unit_id", "service", "operation")
    dataset = F.concat_ws(":", F.lit("dataset_ref"), "rkind", F.coalesce("name", F.lit("_unnamed")))
    blank = F.lit(None).cast("string")
    pairs = lambda **kv: F.map_filter(F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    by_first = lambda df, *keys: df.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where("at = 1")
    spans = functions.select("unit_id", F.col("file").alias("path"), "name", "start_line", "end_line", "raw_text", "ord")
    spans = by_first(spans, "unit_id", "name")
    loose = by_first(own.where("function is null"), "unit_id", "paragraph").join(spans.select("unit_id", F.col("name").alias("paragraph")), ["unit_id", "paragraph"], "left_anti")
    resolved = own.where("rkind is not null")
    named = resolved.groupBy("rkind", "name").agg(F.first("path").alias("path"))
    line, one = F.col("line"), F.greatest(F.lit(1), F.col("line"))
    nodes = union_all([
        node_rows(units.withColumn("path", F.col("first_file")), program, F.lit("program"), F.col("unit_id"), F.lit(1), F.greatest(F.lit(1), F.col("loc")), blank,
                  pairs(language=F.col("language"), runtime=F.lit(runtime), root_path=F.col("root_path"), handler_entry=F.col("handler_entry"))),
        node_rows(spans, para("name"), F.lit("paragraph"), F.col("name"), F.col("start_line"), F.col("end_line"), F.col("raw_text")),
        node_rows(loose, para("paragraph"), F.lit("paragraph"), F.col("paragraph"), F.lit(1), F.lit(1), blank),
        node_rows(by_first(own, "unit_id", "service", "operation"), ext, F.lit("external_call"), F.concat_ws(".", "service", "operation"), one, one, blank,
                  pairs(service=F.col("service"), operation=F.col("operation"))),
        node_rows(named, dataset, F.lit("dataset_ref"), F.coalesce("name", "rkind"), F.lit(None), F.lit(None), blank, pairs(resource_kind=F.col("rkind"), resource_name=F.col("name"))),
    ])
    at = F.concat_ws(":", "path", line.cast("string"))
    used = F.concat(at, F.lit(" "), F.col("service"), F.lit("."), F.col("operation"), F.lit(" ("), F.col("access"), F.lit(")"))
    edges = union_all([
        edge_rows(spans, program, para("name"), F.lit("contains"), F.concat_ws(":", "path", "start_line"), F.col("ord")),
        edge_rows(loose, program, para("paragraph"), F.lit("contains"), F.concat(F.col("path"), F.lit(":1")), F.col("ord")),
        edge_rows(own, para("paragraph"), ext, F.lit("calls"), at, F.col("ord")),
        edge_rows(resolved, para("paragraph"), dataset, _mapped(F.col("access"), GRAPH_EDGES, "calls"), used, F.col("ord"), F.create_map(F.lit("access"), F.col("access"))),
    ])
    return nodes, edges


def typed_hints(calls: DataFrame) -> DataFrame:
    """(source_unit, target_kind, provider, name, kind, evidence, confidence) of calls whose resource is known by their service.

    The kind is the second word of the resource's, as surveyed; a hint without a name has a confidence of 0.7.
    """
    kind, how = access(F.col("service"), F.col("operation"))
    own = calls.withColumns({"rkind": kind, "access": how}).where("rkind is not null")
    name = F.nullif("name", F.lit(""))
    evidence = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(" "), "service", F.lit("."), "operation", F.lit(" ("), "access", F.lit(")"))
    return own.select(
        F.col("unit_id").alias("source_unit"), F.split_part("rkind", F.lit("_"), F.lit(2)).alias("target_kind"), F.lit("aws").alias("provider"), name.alias("name"),
        _mapped(F.col("access"), HINT_EDGES, "invokes").alias("kind"), evidence.alias("evidence"), F.when(name.isNotNull(), 1.0).otherwise(0.7).alias("confidence"),
    )
