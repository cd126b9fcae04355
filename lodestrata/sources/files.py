"""Readers and writers: source trees, fixtures, graph snapshots, checkpoints, logs and record files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.log import append_lines
from lodestrata.sources.tree import read_tree

_TOLERANCE = "kind:string,pic:string,scale:int,trim:boolean,signed:boolean,abs_tol:double,case_insensitive:boolean"
FIXTURE = (
    "name string, target_style string, program_id string, inputs map<string,string>, expected_outputs map<string,string>, "
    f"tolerances map<string,struct<{_TOLERANCE}>>, metadata map<string,string>"
)
_SPAN = "span:struct<file:string,start_line:int,end_line:int>"
SNAPSHOT = (
    f"nodes array<struct<id:string,kind:string,name:string,{_SPAN},raw_text:string,attributes:map<string,string>,llm_summary:string,embedding:array<double>>>, "
    "edges array<struct<source:string,target:string,kind:string,evidence:string,attributes:map<string,string>>>"
)
_UNIT = (
    "unit_id:string,wave:int,status:string,reviewer_verdict:string,tests_passed:boolean,rubric_score:double,cost_usd:double,tokens:map<string,bigint>"
)
CHECKPOINT = (
    "run_id string, cartridge_id string, repo_root string, workdir string, started_at timestamp, updated_at timestamp, stage string, "
    f"waves array<struct<wave:int,verification_passed:boolean,unit_results:array<struct<{_UNIT}>>>>"
)


def read_sources(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """(path, text) of a tree's files, hidden ones and those that start with ``_`` too; bytes that aren't UTF-8 are replaced."""
    return read_tree(spark, root, suffixes).select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"), "text")


def relative(files: DataFrame, root: str) -> DataFrame:
    """``files`` with paths from the root on, whatever scheme the reader gives them."""
    plain = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/+", "/")
    base = plain(F.lit(root.rstrip("/") + "/"))
    return files.withColumn("path", F.substr(plain(F.col("path")), F.length(base) + 1))


def read_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """One row a fixture; a file that isn't valid fails the read."""
    return spark.read.schema(FIXTURE).option("multiLine", "true").option("mode", "FAILFAST").json(folder)


def expected_fields(fixtures: DataFrame) -> DataFrame:
    """(fixture, field, value and its tolerance), a row a field."""
    e = fixtures.select("name", "tolerances", F.explode("expected_outputs").alias("field", "value"))
    return e.select(F.col("name").alias("fixture"), "field", "value", F.try_element_at("tolerances", F.col("field")).alias("t")).select("fixture", "field", "value", "t.*")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph snapshot, one document; edges carry their place as ``ord``.

    Edges are taken anew: once per (source, target, kind, evidence), and one whose end is no node ends the read.
    """
    doc = spark.read.schema(SNAPSHOT).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    edges = doc.select(F.posexplode("edges").alias("ord", "e")).select("e.*", F.col("ord").cast("long").alias("ord"))
    return validated(nodes, edges)


def validated(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    rest = [c for c in edges.columns if c not in ("source", "target", "kind", "evidence")]
    once = edges.groupBy("source", "target", "kind", "evidence").agg(F.min_by(F.struct(*rest), "ord").alias("r")).select("source", "target", "kind", "evidence", "r.*")
    ends = edges.select(F.col("source").alias("id")).distinct().union(edges.select("target").distinct()).distinct()
    lost = ends.join(nodes.select("id"), "id", "left_anti").head()
    loose = None if lost is None else edges.where((F.col("source") == lost["id"]) | (F.col("target") == lost["id"])).head()
    if loose is not None:
        raise KeyError(f"an end of {loose['source']} -> {loose['target']} is no node")
    return nodes, once.select(*edges.columns)


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two JSON tables, compressed: lines of nodes and of edges, distributed as they are."""
    nodes.write.mode("overwrite").option("compression", "gzip").json(f"{path}/nodes")
    edges.write.mode("overwrite").option("compression", "gzip").json(f"{path}/edges")


def read_snapshot_tables(spark: SparkSession, path: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that write_snapshot wrote, edges taken anew as read_snapshot does."""
    read = lambda name, schema: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}")
    return validated(read("nodes", node_schema), read("edges", edge_schema))


def write_checkpoint(runs: DataFrame, path: str) -> None:
    """Whole-run documents (CHECKPOINT), a line each, compressed."""
    runs.write.mode("overwrite").option("compression", "gzip").json(path)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHECKPOINT).option("mode", "FAILFAST").json(path)


def unit_results(checkpoints: DataFrame) -> DataFrame:
    """(run_id, wave, unit_id, status, ..., cost_usd, tokens), a row a unit of each wave of checkpoints."""
    waves = checkpoints.select("run_id", F.explode("waves").alias("w"))
    return waves.select("run_id", "w.wave", F.explode("w.unit_results").alias("u")).select("run_id", "wave", *(f"u.{c}" for c in (
        "unit_id", "status", "reviewer_verdict", "tests_passed", "rubric_score", "cost_usd", "tokens")))


def cost_reports(checkpoints: DataFrame, budgets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, log) of runs: the full report with its units, and a line a run for the history.

    budgets: (run_id, calls, input_tokens, output_tokens, used_usd, max_usd, halted).
    """
    unit = lambda u: F.struct(u["unit_id"].alias("unit_id"), u["wave"].alias("wave"), u["status"].alias("status"), F.round(u["cost_usd"], 6).alias("cost_usd"), u["tokens"].alias("tokens"))
    units = F.flatten(F.transform("waves", lambda w: F.transform(w["unit_results"], unit)))
    both = checkpoints.join(budgets, "run_id").withColumn("units", units)
    # the history needs the number of units alone, so they don't go through its join
    counted = checkpoints.select("run_id", "updated_at", "cartridge_id", F.size(units).alias("units")).join(budgets, "run_id")
    spent = F.struct(*(F.col(c) for c in budgets.columns if c != "run_id")).alias("budget")
    reports = both.select("run_id", "cartridge_id", "repo_root", "workdir", "started_at", F.col("updated_at").alias("finished_at"), "stage", spent, "units")
    log = counted.select(
        "run_id", F.col("updated_at").alias("finished_at"), "cartridge_id", "units", "calls", "input_tokens", "output_tokens", F.round("used_usd", 6).alias("used_usd"),
        F.round("max_usd", 2).alias("max_usd"), "halted",
    )
    return reports, log


def append_cost_log(log: DataFrame, path: str, epoch: int | None = None) -> int:
    """Lines added to the history of runs, in order of their ends; the number of the append, which replaces an earlier try of the same number."""
    return append_lines(log, path, ["finished_at", "run_id"], epoch)


def read_pipe(spark: SparkSession, path: str, columns: list[tuple[str, int | None]]) -> DataFrame:
    """Pipe-delimited records; text trimmed and cut to its width, a None width is a decimal whose blank is 0."""
    return spark.read.text(path).select(*pipe_fields(F.col("value"), columns))


def write_pipe(records: DataFrame, path: str, columns: list[tuple[str, int | None]]) -> None:
    """Pipe-delimited records as ``read_pipe`` reads them: text cut to its width, decimals with two places."""
    records.select(pipe_line(columns).alias("value")).write.mode("overwrite").text(path)


def pipe_line(columns: list[tuple[str, int | None]]) -> Column:
    money = lambda n: F.coalesce(F.col(n).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")).cast("string")
    word = lambda n, w: F.substring(F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))), 1, w)
    return F.concat_ws("|", *(word(n, w) if w else money(n) for n, w in columns))


def pipe_fields(line: Column, columns: list[tuple[str, int | None]]) -> list[Column]:
    part = lambda i: F.trim(F.coalesce(F.get(F.split(line, r"\|"), F.lit(i)), F.lit("")))
    money = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("0")).try_cast("decimal(18,2)")
    return [(F.substring(part(i), 1, w) if w else money(i)).alias(n) for i, (n, w) in enumerate(columns)]


def fixed_fields(line: Column, layout: list[tuple[str, int, int | None]], width: int) -> list[Column]:
    """Fields (name, length, implied decimals or None for text) of a record padded to ``width``."""
    out, at, padded = [], 1, F.rpad(line, width, " ")
    for name, length, scale in layout:
        raw = F.substring(padded, at, length)
        number = (F.coalesce(F.trim(raw).try_cast("decimal(18,0)"), F.lit(0)) / 10 ** (scale or 0)).cast(f"decimal(18,{scale or 0})")
        out.append((F.rtrim(raw) if scale is None else number).alias(name))
        at += length
    return out
