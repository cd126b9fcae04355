"""Trees, logs and tokens of sources: what the queries over whole tables don't reach."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import extract, graph, python_code, script_code
from lodestrata.sources import files, log, renders, tree


def test_tree_reads_all_names(spark, tmp_path):
    names = ["__init__.py", "_x.py", ".env.py", "_priv/deep/.y/z.py", "a b/ü.py", "plain.PY", "none.txt", "bare"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"a\r\nb\rc\xff" if n == "plain.PY" else n.encode())
    (tmp_path / "empty").mkdir()
    got = {r["path"]: (r["size"], r["text"]) for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert got == {n: (7, "a\nb\nc\ufffd") if n == "plain.PY" else (len(n.encode()), n) for n in names}
    assert {r["path"] for r in tree.read_tree(spark, f"file://{tmp_path}", [".py"]).collect()} == {n for n in names if n.lower().endswith(".py")}
    assert tree.read_tree(spark, str(tmp_path / "empty")).count() == 0


def test_tree_is_dealt_by_bytes(spark, tmp_path):
    rng = random.Random(2)
    for i in range(60):
        (tmp_path / f"f{i:02d}").write_text("x" * rng.randrange(200_000))
    parts = tree.TreeReader({"path": str(tmp_path), "partBytes": "500000"}).partitions()
    assert [n for p in parts for n in p.names] == [f"f{i:02d}" for i in range(60)] and len(parts) > 5
    # no part is over its bytes unless its last file alone takes it there
    for p in parts:
        sizes = [(tmp_path / n).stat().st_size + tree.OPEN_BYTES for n in p.names]
        assert sum(sizes[:-1]) + sizes[-1] - tree.OPEN_BYTES <= 500_000 or len(sizes) == 1
    df = tree.read_tree(spark, str(tmp_path), None, 500_000)
    assert df.count() == 60 and df.rdd.getNumPartitions() == len(parts)


def test_a_large_tree_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Wide and deep folders, of which each task lists a few names only; the driver is given no file."""
    names = [f"w{i}/_{i}.py" for i in range(40)] + ["/".join(["d"] * n) + f"/f{n}.PY" for n in range(1, 9)] + [f"w{i}/n.txt" for i in range(5)] + ["top.py"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / "empty/er").mkdir(parents=True)
    reader = tree.TreeReader({"path": str(tmp_path), "suffixes": ".py"})
    assert sorted(r["path"] for r in tree.listed(spark, reader).collect()) == sorted(n for n in names if not n.endswith(".txt"))
    monkeypatch.setattr(tree, "LISTED", 10)
    monkeypatch.setattr(tree.TreeReader, "partitions", None)
    for walked in (0, 3, 50_000):
        # workers have their own module: the bound goes with the reader
        monkeypatch.setattr(tree, "WALKED", walked)
        got = [(r["path"], r["size"], r["text"]) for r in tree.read_tree(spark, str(tmp_path), [".py"]).collect()]
        assert sorted(got) == sorted((n, len(n), n) for n in names if not n.endswith(".txt"))


def test_tree_writes_again_and_refuses_paths_outside(spark, tmp_path):
    df = spark.createDataFrame([("a/_b.py", "1"), ("c", "2")], "path string, text string")
    for _ in range(2):
        tree.write_tree(df, str(tmp_path / "t"))
    assert sorted(str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t").rglob("*") if p.is_file()) == ["a/_b.py", "c"]
    for bad in ("../x", "/x", "a/../../x", ""):
        with pytest.raises(Exception, match="no path below"):
            tree.write_tree(spark.createDataFrame([(bad, "1")], "path string, text string"), str(tmp_path / "t"))


def test_log_keeps_the_last_line_of_many_files(spark, tmp_path):
    """Files of many lines and of few, of which the smallest come first when Spark deals them; lines that aren't whole."""
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "a.jsonl").write_text('{"key": "x", "summary": "old"}\n')
    (plain / "b.jsonl").write_text("".join('{"key": "k%d", "summary": "%d"}\n' % (i % 7, i) for i in range(20_000)) + '{"key": "x", "summary": "new"}\nbroken\n\n{"key": "x"}\n{"summary": "z"}\n"text"\n')
    (plain / "c.jsonl").write_text('{"key": "k0", "summary": "last"}\n{"key": "n", "summary": "1"}\n{"key": "n", "summary": null}\n')
    got = {r["key"]: r["summary"] for r in log.read_cache(spark, str(plain)).collect()}
    last = {f"k{i % 7}": str(i) for i in range(20_000)} | {"k0": "last", "x": "new", "n": None}
    assert got == last
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        assert {r["key"]: r["summary"] for r in log.read_cache(spark, str(plain)).collect()} == last
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_log_appends_are_numbered_and_replaced(spark, tmp_path):
    path = str(tmp_path / "log")
    of = lambda rows: spark.createDataFrame(rows, "key string, summary string, n long")
    assert log.append_lines(of([("a", "1", 1), ("a", "2", 2), ("b", "3", 0)]), path, ["n"]) == 1
    assert log.append_lines(of([("a", "4", 1)]), path, ["n"]) == 2
    assert log.append_lines(of([("a", "5", 1)]), path, ["n"], 2) == 2  # the second append tried again
    assert log.epochs(spark, path) == [1, 2] and log.read_lines(spark, path).count() == 4
    assert {(r["key"], r["summary"]) for r in log.read_cache(spark, path).collect()} == {("a", "5"), ("b", "3")}


CASES = {
    "node": [
        ("const { SQSClient, SendMessageCommand } = require('@aws-sdk/client-sqs');\nimport { SNSClient } from '@aws-sdk/client-sns';\nconst sqs = new SQSClient({});\nconst sns = new SNSClient();\nexport const handler = async (event) => {};\n",
         [(1, "import", "@aws-sdk/client-sqs"), (2, "import", "@aws-sdk/client-sns"), (3, "new", "SQSClient"), (4, "new", "SNSClient")]),
        ("import A, * as b from\n\n'x'; import{c}from\"y\"", [(1, "import", "x"), (3, "import", "y")]),
        ("const url = 'http://x'; const z = require('z') // 'open", [(1, "import", "z")]),
        ("a = b / c; d = 'x' / 2; new AClient(`${new BClient()}`)", [(1, "new", "AClient")]),
        ("export { a } from 'x'; importer from 'y'; $import 'z'; renew XClient; new ClientX()", []),
        ("if (/[/'\"]\\//.test(a)) new AClient()", [(1, "new", "AClient")]),
        ("/* never closed new XClient()", []), ("'it\\'s' + new AClient()", [(1, "new", "AClient")]), ("", []), (None, []),
    ],
    "typescript": [("import { DynamoDBClient } from '@aws-sdk/client-dynamodb';\nconst ddb = new DynamoDBClient({});\nexport async function handler() {}\n", [(1, "import", "@aws-sdk/client-dynamodb"), (2, "new", "DynamoDBClient")])],
    "java": [
        ("package com.example;\nimport software.amazon.awssdk.services.s3.S3Client;\nimport software.amazon.awssdk.services.sqs.SqsClient;\npublic class H {\n    private final S3Client s3 = S3Client.builder().build();\n    private final SqsClient sqs = SqsClient.builder().build();\n}\n",
         [(2, "import", "software.amazon.awssdk.services.s3.S3Client"), (3, "import", "software.amazon.awssdk.services.sqs.SqsClient"), (5, "builder", "S3Client"), (6, "builder", "SqsClient")]),
    ],
    "csharp": [
        ("using System;\nusing Amazon.DynamoDBv2;\nusing Amazon.SQS;\nnamespace Foo {\n    public class H {\n        private readonly AmazonDynamoDBClient _ddb = new AmazonDynamoDBClient();\n        private readonly AmazonSQSClient _sqs = new AmazonSQSClient();\n    }\n}\n",
         [(1, "import", "System"), (2, "import", "Amazon.DynamoDBv2"), (3, "import", "Amazon.SQS"), (6, "new", "AmazonDynamoDBClient"), (7, "new", "AmazonSQSClient")]),
    ],
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_statements_are_found_by_tokens(spark, language):
    cases = CASES[language]
    df = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(cases)], "path string, text string")
    got = {(r["path"], r["line_no"], r["kind"], r["value"]) for r in script_code.sdk_calls(df, language).collect()}
    assert got == {(str(i), *row) for i, (_, found) in enumerate(cases) for row in found}


def test_tokens_of_very_long_texts(spark):
    """Neither a statement without an end nor many escapes need depth."""
    texts = ["import " + "a, " * 300_000, "x = '" + "\\'" * 300_000 + "'; new AClient()", "import {" + "f /* from */ " * 100_000 + "} from 'x'", "/*" * 300_000, "`" + "\n" * 300_000 + "` + new BClient()", "= /" + "\\/" * 200_000 + "/"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {(r["path"], r["value"]) for r in script_code.sdk_calls(df, "node").collect()}
    assert got == {("1", "AClient"), ("2", "x"), ("4", "BClient")}


def test_patterns_go_over_lines(spark):
    df = spark.createDataFrame([("p", "\nimport {\n A\n} from 'x';\nnew\n SQSClient(\n)")], "path string, text string")
    assert {tuple(r) for r in extract.sdk_calls_by_regex(df, "node").collect()} == {("p", 1, "import", "x", None, True), ("p", 5, "new", "SQSClient", "sqs", None)}


def test_many_small_files_are_not_many_tasks(tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"n{i}.py").write_text("x" * (i % 7))
    monkeypatch.setattr(tree, "MANY_PARTS", 10)
    parts = tree.TreeReader({"path": str(tmp_path), "partBytes": "100000"}).partitions()
    assert len(parts) <= 11
    assert sorted(n for p in parts for n in p.names) == sorted(f"n{i}.py" for i in range(300))


def test_rows_of_one_small_file_are_dealt_to_many_tasks(spark):
    rows = spark.createDataFrame([(f"m{i}.py", f"import m{i}\n") for i in range(64)], "path string, text string").coalesce(1)
    tasks = lambda df: df.select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks(python_code.python_facts(rows)) > 4
    assert tasks(script_code.sdk_calls(rows.withColumn("text", F.lit("import './a'")), "node")) > 1


def test_snapshots_are_compressed_and_loose_ends_named(spark, tmp_path):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", "k", None, 1), ("a", "b", "k", None, 2)], "source string, target string, kind string, evidence string, ord long")
    files.write_snapshot(nodes, edges, str(tmp_path / "g"))
    assert {p.suffix for p in (tmp_path / "g").rglob("part-*")} == {".gz"}
    read = lambda: files.read_snapshot_tables(spark, str(tmp_path / "g"), "id string", "source string, target string, kind string, evidence string, ord long")[1].collect()
    assert [tuple(r) for r in read()] == [("a", "b", "k", None, 1)]
    files.write_snapshot(nodes.where("id = 'a'"), edges, str(tmp_path / "g"))
    with pytest.raises(KeyError, match="a -> b"):
        read()


def test_an_export_asks_members_once(spark, tmp_path, monkeypatch):
    nodes = spark.createDataFrame([("p", "program", "P", {}), ("q", "paragraph", "Q", {}), ("f", "file", "F", {})], "id string, kind string, name string, attributes map<string,string>")
    edges = spark.createDataFrame([("p", "q", "contains", None, 1), ("q", "f", "reads", None, 2)], "source string, target string, kind string, evidence string, ord long")
    asked, real = [], graph.program_members
    for module in (graph, renders):
        monkeypatch.setattr(module, "program_members", lambda n, e: asked.append(1) or real(n, e))
    renders.export_graph(nodes, edges, nodes.select(F.col("id").alias("unit_id")), f"file://{tmp_path}/x")
    assert len(asked) == 1
    assert any("p -->|reads| f" in r["value"] for r in spark.read.text(f"file://{tmp_path}/x/graphs/dataflow.mmd").collect())
