"""Operators against hand-built inputs with known results, and random graphs against plain Python."""

import json
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import ranking, tables
from lodestrata.functions.ranking import numbered
from lodestrata.functions.text import folders, located
from lodestrata.operators import business, cobol, crud, depgraph, discovery, dualrun, extract, fixed, graph, iac, jcl, metrics, packs, python_code, spans
from lodestrata.sources import files, renders

NODE, EDGE = "id string, kind string, name string, dd_name string, verb string, start_line int", "source string, target string, kind string, evidence string, ord long, dd_name string"

EDGE_COLUMNS = "source string, target string, kind string, ord long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def two_programs(spark, extra=()):
    own = [("L", "program", "LOADER", None), ("R", "program", "REPORTER", None), ("A", "program", "ARCHIVER", None), ("lp", "paragraph", "P", None), ("rp", "paragraph", "P", None), ("f", "file", "CUST-OUT", "OUT1")]
    own += [("d", "dataset_ref", "PROD.CUSTOMERS", None), ("s", "step", "S1", None)]
    n = spark.createDataFrame([(*r, None, None) for r in own], NODE)
    e = spark.createDataFrame([("L", "lp", "contains", None, 0, None), ("R", "rp", "contains", None, 1, None), ("lp", "f", "writes", "w", 2, None), ("rp", "f", "reads", "r", 3, None), ("s", "d", "dd_of", None, 4, "DDOUT1"), ("s", "d", "dd_of", None, 5, "OUT1"), *extra], EDGE)
    return n, e


def test_crud_matrix_resolves_files_to_datasets(spark):
    n, e = two_programs(spark, [("A", "s", "step_of", None, 6, None)])
    m = crud.crud_matrix(n, e)
    got = {(r["program"], r["kind"], r["name"]): r["symbol"] for r in m.collect()}
    assert got == {("LOADER", "file", "CUST-OUT"): "CU", ("LOADER", "dataset", "PROD.CUSTOMERS"): "CU", ("REPORTER", "file", "CUST-OUT"): "R", ("REPORTER", "dataset", "PROD.CUSTOMERS"): "R", ("ARCHIVER", "dataset", "PROD.CUSTOMERS"): "*"}
    assert rows(crud.readers_of(m).where("kind = 'dataset'").select("program")) == [("REPORTER",)]
    grid = {r["program"]: (r["dataset"], r["file"]) for r in crud.kind_grid(m, ["dataset", "file"]).collect()}
    assert grid == {"LOADER": ("CU", "CU"), "REPORTER": ("R", "R"), "ARCHIVER": ("*", ".")}
    text = [r["line"] for r in crud.crud_grid(m).orderBy("line_no").collect()]
    assert text[0] == "program".ljust(24) + "dataset:PROD.CUSTOMERS  " + "file:CUST-OUT".ljust(24) and text[1] == "ARCHIVER".ljust(24) + "*".ljust(24) + ".".ljust(24)


def _operators(df):
    """Names of the operators of the plan before it is run."""
    found, plans = [], [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        found.append(plan.nodeName())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def test_facts_are_joined_once(spark):
    """What a step touches counts where nothing reads or writes it, by evidence too; neither the matrix nor what follows makes reads and writes twice."""
    n, e = two_programs(spark, [("A", "s", "step_of", None, 6, None), ("L", "s", "step_of", None, 7, None)])
    m = crud.crud_matrix(n, e)
    got = {(r["program"], r["kind"]): (r["symbol"], r["n_evidence"], r["evidence"]) for r in m.where("kind = 'dataset'").collect()}
    assert got == {("LOADER", "dataset"): ("CU", 1, ["w"]), ("REPORTER", "dataset"): ("R", 1, ["r"]), ("ARCHIVER", "dataset"): ("*", 2, [])}
    joins = _operators(m).count("Join")
    assert _operators(crud.seam_rank(crud.seams(m))).count("Join") <= 2
    assert _operators(crud.kind_grid(m, ["dataset", "file"])).count("Join") == joins
    assert joins < 12 and "LeftAnti" not in m._jdf.queryExecution().optimizedPlan().toString() and _operators(crud.seams(m)).count("Expand") == 0
    # a program without a name isn't known to be the one that reads
    lost = n.withColumn("name", F.when(F.col("kind") != "program", F.col("name")))
    assert rows(crud.crud_matrix(lost, e).where("kind = 'dataset'").select("symbol", "n_evidence")) == [("*", 4), ("CRU", 2)]
    # a dataset without a name, which a program writes and touches, has it once
    bare = crud.crud_matrix(n.withColumn("name", F.when(F.col("kind") != "dataset_ref", F.col("name"))), e.unionByName(spark.createDataFrame([("lp", "d", "writes", "x", 8, None)], EDGE)))
    assert rows(bare.where("kind = 'dataset' and program = 'LOADER'").select("symbol")) == [("*",), ("CU",)]
    assert rows(crud.seams(bare).where("name is null").select("n_programs", "n_readers", "n_writers")) == [(3, 1, 1)]


def test_seam_scores(spark):
    m = spark.createDataFrame([("A", "dataset", "SHARED", False, True, False), ("B", "dataset", "SHARED", True, False, False), ("A", "file", "PRIVATE", False, True, False)], "program string, kind string, name string, create_ boolean, read_ boolean, touches_only boolean").withColumns({"update_": F.col("create_"), "delete_": F.lit(False)})
    got = {(r["name"]): (r["total_score"], r["rank"]) for r in crud.seam_rank(crud.seams(m)).collect()}
    assert got == {"SHARED": (0.8, 1), "PRIVATE": (0.48, 2)}
    assert rows(crud.seams(m, 2).select("name")) == [("SHARED",)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closure_components_and_layers_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(35)}
    e = spark.createDataFrame([(a, b, "x") for a, b in pairs], "source string, target string, kind string")
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    got = rows(graph.closure(e, e.select(F.col("source").alias("root"))))
    assert got == sorted((a, b) for a in after for b in reach(a) if a != b)
    own = {r["id"]: r["cluster"] for r in graph.strongly_connected(e).collect()}
    for a in own:
        mutual = sorted({b for b in own if b in reach(a) and a in reach(b)} | {a})
        assert own[a] == (f"cluster-{mutual[0]}" if len(mutual) > 1 else a)
    dag = e.where("source > target")
    h = {r["id"]: r["height"] for r in graph.heights(dag.select(F.col("source").alias("id")).union(dag.select("target")), dag).collect()}
    for a in h:
        assert h[a] == max((1 + h[b] for b in after.get(a, ()) if b < a), default=0)


def test_cycle_has_no_heights_and_its_own_ancestors(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "a", "x")], "source string, target string, kind string")
    with pytest.raises(ValueError):
        graph.heights(e.select(F.col("source").alias("id")), e)
    assert rows(graph.ancestors(e, spark.createDataFrame([("a",)], "root string"))) == [("a", "a"), ("a", "b")]
    with pytest.raises(ValueError):
        graph.neighbors(e, "up")


@pytest.mark.parametrize(
    "expected, actual, kind, pic, tol, signed, same",
    [
        ("3600.00", "3600.00", "picture", "9(5)V99", 0.0, False, True), ("3600.00", "3600", "picture", "9(5)V99", 0.0, False, True), ("3600.00", "3600.001", "picture", "9(5)V99", 0.0, False, False),
        ("3600.00", "3600.005", "picture", "9(5)V99", 0.01, False, True), ("3600.00", "not a number", "picture", "9(5)V99", 0.0, False, False), ("-42", "42-", "int", None, 0.0, True, True), ("42", "42", "int", None, 0.0, False, True),
        ("42", "43", "int", None, 0.0, False, False), ("Y", "YES", "bool", None, 0.0, False, True), ("N", "false", "bool", None, 0.0, False, True), ("Y", "N", "bool", None, 0.0, False, False), ("Y", "maybe", "bool", None, 0.0, False, False),
        ("hello", "hello", "picture", None, 0.0, False, True), ("hello", "world", "picture", None, 0.0, False, False), ("abc   ", "abc", "picture", "X(6)", 0.0, False, True), ("5", "05", "picture", "X(95)", 0.0, False, True), ("5", "05", "picture", "9", 0.0, False, False),
    ],
)
def test_tolerances(spark, expected, actual, kind, pic, tol, signed, same):
    row = spark.createDataFrame([(expected, actual, kind, pic, tol, signed)], "e string, a string, k string, p string, t double, s boolean")
    ok, _ = dualrun.compare(F.col("e"), F.col("a"), F.col("k"), F.col("p"), F.lit(None).cast("int"), F.lit(True), F.col("s"), F.col("t"), F.lit(False))
    assert row.select(ok.alias("x")).first()["x"] is same


def test_pic_scale_modes(spark):
    r = spark.createDataFrame([("9(5)V99",), ("9(3)V9(2)",), ("9(4)",)], "p string").select(dualrun.pic_scale(F.col("p")).alias("a"), dualrun.pic_scale(F.col("p"), "cobol").alias("b")).collect()
    assert [tuple(x) for x in r] == [(9, 2), (2, 2), (0, 0)]


def test_verdict_of_skipped_only(spark):
    f = spark.createDataFrame([("x", "P", True, False, False)], "fixture string, program_id string, skipped boolean, errored boolean, matched boolean")
    v = dualrun.verdict(f).first()
    assert v["passed"] and not v["passed_strict"] and not v["affirmed"]


def test_prefix_pricing_gives_the_known_total(spark):
    c = spark.createDataFrame([("gpt-5.4", 90254, 27239)], "model string, in_tokens long, out_tokens long")
    assert round(metrics.priced(c).first()["usd"], 6) == 0.498025


def test_semantic_chunks(spark):
    text = "\n".join(["import x", "def a():"] + ["  y"] * 4 + ["def b():"] + ["  y"] * 2 + ["def c():"] + ["  z"] * 3)
    d = spark.createDataFrame([(1, text), (2, "p\nq\nr")], "doc_id long, text string")
    assert rows(metrics.chunks_of(d, "python", 5, 2)) == [(1, 0, 2, 6, "a"), (1, 1, 5, 13, "b,c"), (2, 0, 1, 3, "")]
    with pytest.raises(ValueError):
        metrics.compress_history(d, 0)


def test_json_and_fences_and_summaries(spark):
    d = spark.createDataFrame([('a } {"x": "}", "y": {"z": 1}} {', "n\n```\nPurpose: p\nKey invariants:\n- a\n* b\n```")], "t string, s string")
    assert json.loads(d.select(extract.first_json_object("t").alias("j")).first()["j"]) == {"x": "}", "y": {"z": 1}}
    assert d.select(extract.invariants(extract.structured_summary(F.col("s"))["Key invariants"]).alias("i")).first()["i"] == ["a", "b"]


def test_interest_truncates_and_rejects(spark):
    d = spark.createDataFrame([(10.55, 0.333), (-1.0, 0.1), (1.0, 1.5)], "b double, r double")
    assert [None if r[0] is None else float(r[0]) for r in d.select(business.interest(F.col("b"), F.col("r"))).collect()] == [3.51, None, None]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.txt").write_text("no")
    assert [r["text"] for r in files.read_sources(spark, str(tmp_path / "src"), [".py"]).collect()] == ["x = 1\n"]
    (tmp_path / "fx.json").write_text(json.dumps({"name": "n", "program_id": "P", "target_style": "batch", "inputs": {}, "expected_outputs": {"g": "1.00"}, "tolerances": {"g": {"kind": "decimal", "scale": 2}}}))
    assert files.expected_fields(files.read_fixtures(spark, str(tmp_path / "fx.json"))).select("fixture", "field", "value", "kind", "scale").first() == ("n", "g", "1.00", "decimal", 2)
    units, none = spark.createDataFrame([("a",), ("b-1",)], "unit_id string"), "provider string, kind string, name string, resource string"
    e = spark.createDataFrame([("a", "b-1", None, "invokes"), ("a", None, "aws:queue:?", "queues_to")], "source_unit string, target_unit string, resource string, kind string")
    drawn = renders.unit_graph(units, spark.createDataFrame([("aws", "queue", None, "aws:queue:?")], none), e, "mermaid")
    assert renders.document(drawn).first()["text"] == "```mermaid\nflowchart LR\n    a[a]\n    b_1[b-1]\n    aws_queue_unknown[(queue: ?)]\n    a -->|queues_to| aws_queue_unknown\n    a -->|invokes| b_1\n```\n"


def test_budget_stream(spark, tmp_path):
    from lodestrata.streaming.budget import running_budget

    spark.createDataFrame([(1, i, "gpt-5", 100_000, 0) for i in range(6)], "run_id long, seq long, model string, in_tokens long, out_tokens long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id long, seq long, model string, in_tokens long, out_tokens long").parquet(str(tmp_path / "in"))
    q = running_budget(stream, 1.0).writeStream.format("memory").queryName("budget").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["seq"] for r in spark.table("budget").where("halted").collect()) == [3, 4, 5]


def test_waves_put_dependencies_first(spark):
    u = spark.createDataFrame([("a",), ("b",), ("c",)], "unit_id string")
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "source string, target string")
    assert rows(depgraph.waves(u, e)) == [("a", "cluster-a", 1, 1), ("b", "cluster-a", 1, 2), ("c", "c", 2, 1)]


def test_long_continuations_are_kept_whole(spark):
    text = "//A DD DISP=SHR,\n//   " + "X" * 1500
    df = spark.createDataFrame([("j", text)], "path string, text string")
    assert [r["card"] for r in jcl.cards(df).collect()] == ["//A DD DISP=SHR, " + "X" * 1500]


def files_of(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_matches_are_located_by_line(spark):
    text = "x\nEXEC SQL\n  select a\nEND-EXEC y EXEC SQL b END-EXEC\n\nEXEC SQL c\nEND-EXEC"
    got = located(files_of(spark, ("p", text), ("q", "none")), "(?is)" + fixed.EXEC_SQL, {"body": 1})
    assert rows(got) == [("p", 0, 2, 4, "select a"), ("p", 1, 4, 4, "b"), ("p", 2, 6, 7, "c")]
    assert files_of(spark, ("a/b/c.py", ""), ("d", "")).select(folders(F.col("path")).alias("f")).collect()[0]["f"] == ["", "a", "a/b"]


def test_numbers_of_ranges_equal_a_window(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.choice([None, "a", "b"]), rng.randrange(50)) for i in range(500)], "id int, g string, v int").repartition(7)
    got = {r["id"]: r["n"] for r in numbered(df, "n", [F.col("v").desc(), F.col("id")], ("g",)).collect()}
    own = sorted(((r["g"] or "", -r["v"], r["id"]) for r in df.collect()))
    want, seen = {}, {}
    for g, _, i in own:
        want[i] = seen[g] = seen.get(g, 0) + 1
    assert got == want
    assert sorted(r["n"] for r in numbered(df, "n", [F.col("id")]).collect()) == list(range(1, 501))
    assert numbered(df.limit(0), "n", [F.col("id")]).collect() == []


def test_components_and_heights_by_rounds(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "a"), ("g", "f"), ("h", "h")]
    e = spark.createDataFrame(pairs, "source string, target string")
    assert rows(graph.strongly_connected(e)) == [("a", "cluster-a"), ("b", "cluster-a"), ("c", "cluster-c"), ("d", "cluster-c"), ("e", "cluster-c"), ("f", "f"), ("g", "g")]
    dag = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")], "source string, target string")
    ids = spark.createDataFrame([(x,) for x in "abcdz"], "id string")
    assert rows(graph.heights(ids, dag)) == [("a", 2), ("b", 1), ("c", 0), ("d", 1), ("z", 0)]
    with pytest.raises(ValueError):
        graph.heights(ids, e)


def test_post_order_on_a_cycle(spark):
    e = spark.createDataFrame([("r", "b", "x", 2), ("r", "a", "x", 1), ("a", "c", "x", 3), ("c", "r", "x", 4), ("b", "c", "x", 5)], "source string, target string, kind string, ord long")
    assert [r["node"] for r in graph.post_order(e, spark.createDataFrame([("r",)], "root string")).orderBy("pos").collect()] == ["c", "a", "b", "r"]


def test_python_bindings(spark):
    text = """
import boto3
ddb = boto3.resource('dynamodb')
table: object = ddb.Table('T')
def f():
    table.put_item(Item={})
    boto3.resource('dynamodb').Table('V').delete_item(Key=1)
    q = aioboto3.client("sqs")
    q.send_message(QueueUrl="u")
    other.call('x')
"""
    got = python_code.python_facts(files_of(spark, ("a.py", text), ("b.py", "def (")))
    assert rows(got.where("kind = 'call'").select("line_no", "service", "value", F.coalesce("resource", F.lit("-")))) == [
        (4, "dynamodb", "Table", "T"), (6, "dynamodb", "put_item", "-"), (7, "dynamodb", "Table", "V"), (7, "dynamodb", "delete_item", "-"), (9, "sqs", "send_message", "u")]
    assert rows(got.where("kind = 'warning'").select("path")) == [("b.py",)]


def test_relative_imports_resolve_by_longest_prefix(spark):
    files = files_of(spark, ("a/b/m.py", "from ..c import d\nimport a.c.e.f\nfrom . import x"), ("a/c/__init__.py", ""), ("a/c/d.py", ""), ("a/c/e.py", "import zzz"), ("a/b/x.py", ""))
    assert rows(python_code.import_links(files)) == [("a/b/m.py", "a/b/x.py", "imports"), ("a/b/m.py", "a/c/__init__.py", "imports"), ("a/b/m.py", "a/c/d.py", "imports"), ("a/b/m.py", "a/c/e.py", "imports")]


def test_manifests_of_odd_shapes_give_nothing(spark):
    odd = ["Resources: {F: text}", "Resources: [1]", "- a", "a: [", "Resources:\n  F:\n    Type: AWS::Serverless::Function\n    Properties: [1]", "Resources:\n  F:\n    Type: AWS::Serverless::Function\n    Properties: {Events: {A: x, B: {Type: SQS, Properties: 3}}}"]
    got = iac.hints(files_of(spark, *((f"{i}/template.yml", t) for i, t in enumerate(odd)), ("x/serverless.yml", "functions: {a: 1, b: {events: 7}}"), ("c.template.json", '{"Resources": 5}'), ("n/template.yaml", None)))
    assert rows(got.select("source_unit", "target_kind", "name")) == [("F", "queue", None)]


def test_records_write_their_files(spark):
    text = """       PROGRAM-ID. P.
       FD  OUT-FILE.
       01  OUT-REC PIC X.
       FILE SECTION.
       FD  OUT-FILE.
       01  OUT-REC PIC X.
       LINKAGE SECTION.
       01  L-REC PIC X.
       PROCEDURE DIVISION.
           WRITE OUT-REC.
       A-PARA.
           rewrite out-rec.
           DELETE OUT-FILE.
           WRITE NO-REC."""
    n, e = cobol.graph_of(files_of(spark, ("p.cbl", text)))
    io = e.where("kind = 'writes'").select("source", "target", "evidence")
    assert rows(io) == [("paragraph:P:A-PARA", "file:P:OUT-FILE", "p.cbl:12 REWRITE"), ("paragraph:P:A-PARA", "file:P:OUT-FILE", "p.cbl:13 DELETE"), ("program:P", "file:P:OUT-FILE", "p.cbl:10 WRITE")]
    assert not {"L-REC"} & {r["name"] for r in n.collect()}


def test_nested_groups_and_overwritten_fields(spark):
    text = "\n".join(["       PROGRAM-ID. P.", "       WORKING-STORAGE SECTION.", "       01  R.", "           05  G.", "               10  A PIC 9.", "               10  B PIC X.", "           05  C REDEFINES G PIC XX.", "           05  A PIC 9(2).", "       01  S REDEFINES R.", "           05  Z OCCURS 3 TIMES PIC 9."])
    n, e = cobol.graph_of(files_of(spark, ("p.cbl", text)))
    held = {(r["target"], r["source"]) for r in e.where("kind = 'contains'").collect()}
    assert ("field:P:R:A", "field:P:R:G") in held and ("field:P:R:B", "field:P:R:G") in held and ("field:P:R:C", "record:P:R") in held
    assert rows(e.where("kind = 'redefines'").select("source", "target")) == [("field:P:R:C", "field:P:R:G"), ("record:P:S", "record:P:R")]
    fields = {r["id"]: r["attributes"] for r in graph.upsert_nodes(n).where("kind = 'field'").collect()}
    assert fields["field:P:R:A"]["pic"] == "9(2)" and fields["field:P:S:Z"]["occurs"] == "3 TIMES"


def test_job_resets_its_step(spark):
    text = "//A JOB\n//S EXEC PGM=P\n//D DD DSN=X(1)\n//B JOB\n//E DD DSN=Y\n//T EXEC PROC=Q\n//F DD SYSOUT=*"
    assert rows(jcl.facts(jcl.cards(files_of(spark, ("j", text)))).select("kind", "job", F.coalesce("step", F.lit("-")), F.coalesce("dataset", F.lit("-")))) == [("dd", "A", "S", "X"), ("job", "A", "-", "-"), ("job", "B", "-", "-"), ("step", "A", "S", "-")]


def test_model_output_of_odd_shapes(spark):
    d = spark.createDataFrame([("{bad} {\"a\": 1}", "A=1\nA=2\n", "a/../../b"), ("```json\n{\"a\": {\"b\": \"}\"}}\n```", "x", "./a//b/../c")], "t string, k string, p string")
    assert [r["j"] for r in d.select(extract.first_json_object("t").alias("j")).collect()] == [None, '{"a": {"b": "}"}}']
    assert [r["m"] for r in d.select(extract.key_values(F.col("k")).alias("m")).collect()] == [{"A": "2"}, None]
    assert [r["p"] for r in d.select(extract._resolved(F.col("p")).alias("p")).collect()] == [None, "a/c"]


def test_literal_scales(spark):
    d = spark.createDataFrame([("1e-3",), ("1.50e2",), ("3.600",), ("7",), (None,), ("1.2E-2",)], "v string")
    assert [r[0] for r in d.select(dualrun.literal_scale(F.col("v"))).collect()] == [3, 0, 3, 0, 0, 3]


def test_overtime_and_refused_starts(spark):
    e = [("k", 0, 1, "start", 1), ("k", 10, 2, "start", 1), ("k", 1800, 3, "check", 0), ("k", 1801, 4, "check", 0), ("k", 1900, 5, "start", 1), ("j", 0, 1, "finish", -1)]
    got = business.fold_events(spark.createDataFrame(e, "key string, ts long, seq long, type string, delta long"))
    assert rows(got) == [("j", "IDLE", None, -1, 0, 0, 0), ("k", "IN_PROGRESS", 1900, 3, 2, 1, 1)]


def test_styles_follow_the_graph(spark):
    n = spark.createDataFrame([("p", "program", "P", False), ("q", "program", "Q", True), ("r", "program", "R", True), ("b", "program", "B", False), ("t", "txn_call", "T", None)], "id string, kind string, name string, callable boolean")
    e = spark.createDataFrame([("p", "x", "contains"), ("x", "t", "calls"), ("q", "y", "reads"), ("r", "x", "calls"), ("b", "s", "step_of")], "source string, target string, kind string")
    s = metrics.target_style(n, e)
    assert rows(s) == [("B", "batch"), ("P", "cics"), ("Q", "subroutine"), ("R", "cics")] and metrics.style_of(s, "B") == "batch"
    with pytest.raises(KeyError):
        metrics.style_of(s, "none")


def test_unit_roots_by_depth(spark):
    files = files_of(spark, ("m/pom.xml", ""), ("m/a/b/X.java", "class X implements RequestHandler<A, B>"), ("m/a/build.gradle", ""), ("z/Y.java", "RequestStreamHandler"), ("one.py", "def handler(event): pass"))
    assert rows(discovery.handler_units(files)) == [("",), ("m/a",), ("z",)]
    own, warn = discovery.discover(spark.createDataFrame([("m/a",), ("m/pom.xml",), ("q",)], "unit string"), files)
    assert rows(own.select("unit", "language", "n_files")) == [("m/a", "java", 1)]
    assert rows(warn) == [("m/pom.xml", "[skip] m/pom.xml: no adapter for .xml (pom.xml)"), ("q", "[skip] q: no recognized source files under q")]


def test_snapshot_document_checks_its_edges(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "kind": "k", "name": "A"}], "edges": [{"source": "a", "target": "a", "kind": "x"}, {"source": "a", "target": "a", "kind": "x"}]}
    (tmp_path / "kg.json").write_text(json.dumps(doc))
    assert files.read_snapshot(spark, str(tmp_path / "kg.json"))[1].count() == 1
    doc["edges"].append({"source": "a", "target": "gone", "kind": "x"})
    (tmp_path / "bad.json").write_text(json.dumps(doc))
    with pytest.raises(KeyError):
        files.read_snapshot(spark, str(tmp_path / "bad.json"))


def test_cost_windows(spark, tmp_path):
    from lodestrata.streaming.budget import cost_windows

    data = spark.sql("SELECT timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int) * 20, 0) AS ts, 'gpt-5' AS model, 't' AS tag, 1000000L AS in_tokens, 0L AS out_tokens FROM range(6)")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = cost_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").count() >= 2


def test_tables_need_a_shared_folder_off_the_machine(spark, monkeypatch):
    class Away:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError):
        tables.shared_dir(Away)
    df = tables.cut(spark.range(3))
    assert df.count() == 3
    tables.drop(df)


def test_reaching_is_one_row_a_node(spark):
    e = spark.createDataFrame([("a", "b", "calls"), ("b", "a", "calls"), ("b", "t", "calls"), ("c", "u", "contains"), ("d", "e", "calls"), ("e", "d", "calls"), ("x", "t", "other"), ("t", "z", "calls")], "source string, target string, kind string")
    targets = spark.createDataFrame([("t",), ("u",), ("lone",)], "node string")
    assert rows(graph.reaching(e, targets, ["calls", "contains"])) == [("a",), ("b",), ("c",), ("lone",), ("t",), ("u",)]
    assert graph.reaching(e, targets.limit(0)).count() == 0


def _walk(nodes, edges):
    """{id: (root, place)} by a plain walk from each root."""
    after, below = {}, {t for _, t, _ in edges}
    for s, t, o in edges:
        after.setdefault(s, []).append((o, t))
    out = {}
    for root in sorted(n for n in nodes if n not in below):
        done, stack = [], [(root, iter(sorted(after.get(root, []))))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                done.append(stack.pop()[0])
            else:
                stack.append((child[1], iter(sorted(after.get(child[1], [])))))
        out |= {n: (root, i) for i, n in enumerate(done)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_order_is_the_walk(spark, seed):
    """Random trees with equal orders, one of them a hot root, one a chain, and nodes alone."""
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(120)]
    edges = [(nodes[0 if i < 40 else i - 1 if i < 46 else rng.randrange(46, i)], nodes[i], rng.randrange(4)) for i in range(1, 110) if i != 46]
    e = spark.createDataFrame([(s, t, "contains", o) for s, t, o in edges] + [("n1", "n2", "calls", 0)], EDGE_COLUMNS)
    got = {r["id"]: r for r in graph.forest_order(spark.createDataFrame([(n,) for n in nodes], "id string"), e).collect()}
    want = _walk(nodes, edges)
    assert {n: (r["root"], r["place"]) for n, r in got.items()} == want
    size = {n: 1 for n in nodes}
    for s, t, _ in reversed(edges):
        size[s] += size[t]
    assert {n: r["size"] for n, r in got.items()} == size
    assert graph.forest_order(spark.createDataFrame([], "id string"), e.limit(0)).count() == 0


def test_forest_order_refuses_what_is_no_forest(spark):
    ids = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    of = lambda pairs: spark.createDataFrame([(a, b, "contains", 0) for a, b in pairs], EDGE_COLUMNS)
    with pytest.raises(ValueError, match="2 parents"):
        graph.forest_order(ids, of([("a", "c"), ("b", "c")]))
    with pytest.raises(ValueError, match="cycle"):
        graph.forest_order(ids, of([("a", "b"), ("c", "d"), ("d", "c")]))


def test_summaries_are_planned_bottom_up_under_a_cap(spark):
    """Paragraphs before their section, sections before their program; the cap counts fresh ones and a later pass goes on."""
    edges = spark.createDataFrame([("p", "s1", "contains", 1), ("p", "s2", "contains", 0), ("s1", "a", "contains", 5), ("s1", "b", "contains", 4), ("s2", "c", "contains", 0)], EDGE_COLUMNS)
    nodes = spark.createDataFrame([(i, "text", i.upper(), "k", "told" if i == "b" else None, "h") for i in ("p", "s1", "s2", "a", "b", "c", "alone", "q")], "id string, raw_text string, name string, kind string, summary string, prompt string")
    none = spark.createDataFrame([], "key string")
    plan = lambda cache, most=None, roots=None: [r["id"] for r in metrics.summary_plan(nodes, cache, most, roots, edges).orderBy("place").collect()]
    assert plan(none) == ["alone", "c", "s2", "a", "s1", "p", "q"]
    assert plan(none, 3) == ["alone", "c", "s2"] and plan(none, 0) == []
    roots = spark.createDataFrame([("s1",), ("p",)], "root string")
    assert plan(none, None, roots) == ["c", "s2", "a", "s1", "p"] and plan(none, None, roots.limit(1)) in (["a", "s1"],)
    done = metrics.summary_plan(nodes, none, 3, None, edges).select("key")
    assert plan(done, 3) == ["a", "s1", "p"]


def test_styles_by_reach(spark):
    """Transactions through calls and contained nodes, cycles, steps and callable programs."""
    nodes = spark.createDataFrame([(i, "program", i.upper(), c) for i, c in (("a", False), ("b", True), ("c", None), ("d", False), ("e", True), ("f", False))] + [("x", "paragraph", "X", None), ("t", "txn_call", "T", None)], "id string, kind string, name string, callable boolean")
    edges = spark.createDataFrame([("a", "x", "contains"), ("x", "t", "calls"), ("b", "a", "calls"), ("c", "s", "step_of"), ("d", "e", "calls"), ("e", "d", "calls"), ("d", "s", "step_of"), ("f", "t", "reads")], "source string, target string, kind string")
    assert rows(metrics.target_style(nodes, edges)) == [("A", "cics"), ("B", "cics"), ("C", "batch"), ("D", "batch"), ("E", "subroutine"), ("F", "subroutine")]


def test_budgets_inside_a_hot_unit(spark):
    """One unit that holds nearly all rows is many tasks, with the sums of a plain loop."""
    rng = random.Random(4)
    data = [("hot" if i % 50 else f"u{i % 3}", i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, i long, v long").repartition(7)
    got = {(r["g"], r["i"]): r["s"] for r in ranking.running(df, "s", "v", ["i"], ("g",)).collect()}
    total: dict = {}
    for g, i, v in data:
        total[g] = total.get(g, 0) + v
        assert got[g, i] == total[g]
    assert len(got) == 3000
    assert {r["i"]: r["s"] for r in ranking.running(df, "s", "v", ["i"]).collect()} == dict(zip(range(3000), accumulate(v for _, _, v in data)))


def test_spans_hold_points_as_a_range_join_does(spark):
    """Nested, overlapping, equal, empty and very long spans, and a file that has nearly all points."""
    rng = random.Random(6)
    own = [("f" if i % 9 else "g", i, a := rng.choice((0, 1, 15, 16, 17, 255, 256, rng.randrange(5000))), a + rng.choice((-1, 0, 1, 15, 16, 240, rng.randrange(4000), 2**31 - 6000))) for i in range(150)]
    at = [("f" if i % 20 else "g", i, rng.choice((0, 15, 16, 4095, 4096, 2**31 - 7000, rng.randrange(9000)))) for i in range(300)]
    s = spark.createDataFrame(own, "file string, name long, start_line long, end_line long")
    p = spark.createDataFrame(at, "file string, ord long, line long")
    want = sorted((o, n) for f, o, x in at for g, n, a, b in own if f == g and a <= x <= b)
    assert rows(spans.holding(p, s, ["file"]).select("ord", "name")) == want
    inner = {o: min((-a, b, n) for g, n, a, b in own if f == g and a <= x <= b)[2] for f, o, x in at if any(f == g and a <= x <= b for g, _, a, b in own)}
    assert {r["ord"]: r["name"] for r in spans.innermost(p, s, ["file"], ["ord"]).collect()} == inner
    plan = spans.holding(p, s, ["file"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_points_around_are_dealt_once(spark):
    """What is around a point, by key, of which some are told twice; no row is made for each span around it."""
    rng = random.Random(7)
    own = [("f" if i % 9 else "g", i, a := rng.choice((0, 1, 255, 256, 257, rng.randrange(5000))), a + rng.choice((-1, 0, 1, 255, rng.randrange(4000), 2**31 - 6000))) for i in range(150)]
    at = [("f" if i % 20 else "g", i // 2 if i < 40 else i, rng.choice((0, 255, 256, 4095, 2**31 - 7000, rng.randrange(9000)))) for i in range(300)] + [("h", 900, 5), ("f", 901, None)]
    s = spark.createDataFrame(own, "file string, name long, start_line long, end_line long")
    p = spark.createDataFrame(at, "file string, ord long, line long")
    want = {}
    for f, o, x in at:
        for g, n, a, b in own:
            if f == g and x is not None and a <= x <= b:
                want.setdefault(o, []).append((-a, b, n))
    got = spans.around(p, s, ["file"], ["ord"])
    assert rows(got.select("ord", "name", "n")) == sorted((o, min(w)[2], len(w)) for o, w in want.items())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spans.around(p, s, ["file"], ["ord"])
        df.collect()
        made, plans = 0, [df._jdf.queryExecution().executedPlan()]
        while plans:
            plan = plans.pop()
            if plan.nodeName().endswith("Join") and any(a.name() == "ord" for a in (plan.output().apply(i) for i in range(plan.output().size()))):
                made = max(made, plan.metrics().apply("numOutputRows").value())
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < made <= len(at)


def test_hints_are_checked_in_one_pass(spark):
    hints = spark.createDataFrame([("a", "q", "aws", "n", "reads_from", "e1", 1.0), (None, "q", "aws", "n", "reads_from", "e2", 1.0), ("a", "q", "aws", "n", None, "e3", 1.0), ("z", "q", "aws", None, "reads_from", "e4", 0.7)],
                                  "source_unit string, target_kind string, provider string, name string, kind string, evidence string, confidence double")
    good, refused, counts = depgraph.checked_hints(hints, spark.createDataFrame([("a",), ("a",), ("b",)], "unit_id string"))
    assert [r["evidence"] for r in good.collect()] == ["e1"]
    assert rows(refused.select("evidence", "reason")) == [("e2", depgraph.NO_UNIT), ("e3", depgraph.NO_KIND), ("e4", depgraph.ORPHAN)]
    assert counts.get == {"n_hints": 4, "n_malformed": 2, "n_orphans": 1}


def test_products_of_units_are_made_in_blocks(spark, monkeypatch):
    """A resource of all units, some of few, units that read only or write only; the sum of each pair is made in its block, without a row a resource."""
    monkeypatch.setattr(depgraph, "BLOCK_UNITS", 400)
    monkeypatch.setattr(depgraph, "BLOCK_ROWS", 1000)
    rng = random.Random(8)
    facts = [(f"u{u}", f"aws:sqs:{k}", rng.choice(("writes_to", "queues_to", "reads_from", "invokes")) if u % 5 else "reads_from", False) for u in range(1500) for k in ("?", "b") for _ in range(2)]
    facts += [(f"u{rng.randrange(1510)}", f"aws:s3:n{rng.randrange(300)}", rng.choice(("writes_to", "reads_from")), rng.random() < 0.1) for _ in range(2000)] + [("u1", None, "invokes", False)]
    e = spark.createDataFrame(facts, "source_unit string, resource string, kind string, ambiguous boolean")
    for drop in (False, True):
        want = depgraph.shared_edges(e, drop).groupBy("source_unit", "target_unit").agg(F.sum("n").alias("n"))
        got = depgraph.derived_edges(e, drop)
        assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
        assert got.count() == want.count() > 0
        assert got.exceptAll(want).isEmpty()
    assert depgraph.derived_edges(e.where("false")).isEmpty()


def test_rule_packs_are_told_apart(spark):
    own = packs.RulePack("test-only", (("sqs", "queue-x"),), {"python": (("a", 3),)}, (("sqs", "q", None, {"reads": ("get",)}),))
    assert packs.register(own) is own and packs.register(own) is own and packs.pack("test-only") is own
    try:
        with pytest.raises(ValueError, match="already"):
            packs.register(packs.RulePack("test-only"))
        calls = spark.createDataFrame([("sqs", "get"), ("sqs", "put"), ("s3", "get")], "service string, operation string")
        assert rows(packs.targets(own, calls).select("service", "operation", "target_kind").na.fill("-")) == [("s3", "get", "-"), ("sqs", "get", "queue-x"), ("sqs", "put", "queue-x")]
        assert rows(packs.accesses(own, calls).na.fill("-")) == [("s3", "get", "-", "-"), ("sqs", "get", "q", "reads"), ("sqs", "put", "-", "-")]
        files = spark.createDataFrame([("u", "python", "aa b"), ("v", "cobol", "aaa")], "unit string, language string, text string")
        assert rows(packs.complexities(own, files)) == [("u", 6, "MEDIUM"), ("v", 1, "LOW")]
    finally:
        packs._PACKS.pop("test-only")
    assert packs.FUNCTIONS.install(spark) == ["python_facts"]
    spark.createDataFrame([("a.py", "import os"), ("b.py", "def (")], "path string, text string").createOrReplaceTempView("pack_files")
    got = spark.sql("SELECT path, kind, value FROM python_facts(TABLE(pack_files) PARTITION BY path)")
    assert rows(got) == [("a.py", "import", "os"), ("b.py", "warning", "unparseable")]


def test_layers_are_counted_in_batches(spark, monkeypatch):
    """A chain of many layers takes few rounds, batches of few edges give the same, and what reaches a cycle is left."""
    n = 60
    chain = [(f"n{i + 1}", f"n{i}") for i in range(n)] + [(f"n{i}", "n0") for i in range(2, n, 3)]
    edges = spark.createDataFrame(chain, "source string, target string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n + 1)], "id string")
    written = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or cut(df))
    want = {f"n{i}": i for i in range(n + 1)}
    assert {r["id"]: r["height"] for r in graph.heights(nodes, edges).collect()} == want
    assert len(written) < 15
    monkeypatch.setattr(graph, "BATCH_EDGES", 40)
    assert {r["id"]: r["height"] for r in graph.heights(nodes, edges).collect()} == want
    placed, left = graph.layered(nodes, edges.union(spark.createDataFrame([("n50", "n52")], edges.schema)))
    assert {r["id"] for r in left.collect()} == {f"n{i}" for i in range(50, n + 1)} and placed.count() == 50


def test_layers_and_clusters_are_counted_by_codes(spark, monkeypatch):
    """Edges are written anew only when a part of them is closed, not in each round; what tasks exchange of them is numbers, and results are those of names."""
    monkeypatch.setattr(graph, "BATCH_EDGES", 20)
    monkeypatch.setattr(graph, "OPEN_SHARE", 0.5, raising=False)
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(dict(df.dtypes)) or cut(df))
    n = 40
    dense = [(f"n{i:02d}", f"n{j:02d}") for i in range(n) for j in range(i)]
    e = spark.createDataFrame(dense, "source string, target string")
    assert {r["id"]: r["height"] for r in graph.heights(spark.createDataFrame([(f"n{i:02d}",) for i in range(n)], "id string"), e).collect()} == {f"n{i:02d}": i for i in range(n)}
    rounds = sum(set(w) == {"id", "height"} for w in written)
    assert rounds > 3 and sum(set(w) == {"source", "target"} for w in written) < rounds
    written.clear()
    # cycles of two in a chain, a loop of one node, a null end
    pairs = [(f"c{i}", f"d{i}") for i in range(4)] + [(f"d{i}", f"c{i}") for i in range(4)] + [(f"c{i + 1}", f"d{i}") for i in range(3)] + [("e", "c3"), ("f", "f"), ("g", None)]
    e = spark.createDataFrame(pairs, "source string, target string")
    assert rows(graph.strongly_connected(e)) == sorted([(f"{x}{i}", f"cluster-c{i}") for i in range(4) for x in "cd"] + [("e", "e")])
    assert all(w[c] == "bigint" for w in written for c in ("source", "target") if c in w)
    u = spark.createDataFrame([(x,) for x in ("c0", "d0", "c3", "e", "f", "h")], "unit_id string")
    assert rows(depgraph.waves(u, e)) == [("c0", "cluster-c0", 1, 1), ("c3", "cluster-c3", 1, 2), ("d0", "cluster-c0", 1, 3), ("e", "e", 2, 1), ("f", "f", 1, 4), ("h", "h", 1, 5)]


def test_rows_through_a_wide_resource_are_many_tasks(spark, monkeypatch):
    """The rows of one resource of all units are dealt to several tasks, and are those of a plain join."""
    monkeypatch.setattr(depgraph, "PAIRS", 400, raising=False)
    facts = [(f"u{u}", "r", ("writes_to", "reads_from")[u % 2 if u % 5 else k]) for u in range(150) for k in range(2)] + [("u1", "few", "writes_to"), ("u2", "few", "invokes"), ("u3", "read", "invokes"), ("u4", None, "invokes")]
    e = spark.createDataFrame(facts, "source_unit string, resource string, kind string").withColumn("ambiguous", F.lit(False))
    got = depgraph.shared_edges(e)
    w, r = e.where("kind = 'writes_to'"), e.where("kind <> 'writes_to'").withColumnRenamed("source_unit", "target_unit")
    want = w.join(r, "resource").where("source_unit <> target_unit").groupBy("source_unit", "target_unit", "resource").agg(F.count("*").alias("n"))
    assert got.count() == want.count() > 5000 and got.exceptAll(want).isEmpty()
    tasks = [x["n"] for x in got.where("resource = 'r'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) > 4 and max(tasks) < sum(tasks) / 2


def test_blocks_of_many_units_are_added_up_in_squares(spark, monkeypatch):
    """A writer or reader of a wide resource is dealt to few blocks, and a block of more units than a square's is whole."""
    from collections import Counter

    import pyarrow as pa

    monkeypatch.setattr(depgraph, "BLOCK_UNITS", 6)
    monkeypatch.setattr(depgraph, "BLOCK_ROWS", 20)
    rng = random.Random(5)
    side = lambda k: [(f"u{u}", r, rng.randrange(1, 4)) for u in range(40) for r in "xyz" if r == "x" or u % 3 == k]
    w, r, pairs = side(0), side(1), [("u1", "u2", 5), ("u1", "v", 7), ("u39", "u0", 1)]
    cells = [(u, None, k, n) for u, k, n in w] + [(None, u, k, n) for u, k, n in r] + [(s, t, None, n) for s, t, n in pairs]
    batch = pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], pa.int64() if i == 3 else pa.string()) for i in range(4)], names=["source_unit", "target_unit", "resource", "n"])
    want = Counter({(s, t): n for s, t, n in pairs})
    for s, k, n in w:
        for t, q, m in r:
            want[s, t] += n * m * (k == q and s != t)
    got = [(x["source_unit"], x["target_unit"], x["n"]) for out in depgraph._products(iter([batch])) for x in out.to_pylist()]
    assert sorted(got) == sorted((s, t, n) for (s, t), n in want.items() if n)
    monkeypatch.undo()
    monkeypatch.setattr(depgraph, "BLOCK_UNITS", 8)
    e = spark.createDataFrame([(f"u{u}", "r", k) for u in range(400) for k in ("writes_to", "reads_from")], "source_unit string, resource string, kind string").withColumn("ambiguous", F.lit(False))
    # 50 squares a side, but 8 blocks, so that each of 800 rows is dealt 8 times
    seen, unions = [], depgraph.union_all
    monkeypatch.setattr(depgraph, "union_all", lambda parts: seen.append(unions(parts)) or unions(parts))
    assert depgraph.derived_edges(e).count() == 400 * 399
    assert seen[0].count() == 800 * 8
