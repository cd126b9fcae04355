"""Queries over trees and logs that are written and read back, and over tokens of sources, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.tables import shared_path
from lodestrata.operators import python_code, script_code
from lodestrata.plans.estate import table
from lodestrata.sources import files, log, tree


def _n(form, *columns):
    return F.format_string(form, *columns)


def _text(*parts):
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _tree(s, d):
    """A file a customer: packages, names with ``_`` and ``.`` before them, hidden folders, bytes that are no text, line ends of two kinds, a suffix that isn't asked for."""
    k = F.col("c_custkey")
    forms = ("p%d/m%d/__init__.py", "p%d/_x%d.py", ".hid%d/y%d.py", "p%d/_priv/z%d.PY", "p%d/b%d.py", "p%d/n%d.txt")
    path = F.element_at(F.array(*(_n(f, k % 37, k) for f in forms)), (k % 6 + 1).cast("int"))
    content = F.concat(F.encode(_n("x = %d\r\né", k), "UTF-8"), F.when(k % 6 == 4, F.unhex(F.lit("FF41C3"))).otherwise(F.unhex(F.lit(""))))
    root = shared_path(s, "tree")
    tree.write_tree(table(s, d, "customer").select(path.alias("path"), content.alias("content")), root)
    return tree.read_tree(s, root, [".py"], 1 << 20)


def _packages(s, d):
    """What each package of a tree imports at any depth: by its ``__init__.py`` its private module, and by that the next package of five."""
    k = F.col("c_custkey")
    own = table(s, d, "customer").select(k)
    head = own.select(_n("q%d/__init__.py", k).alias("path"), F.lit("from . import _x\n").alias("text"))
    module = own.select(_n("q%d/_x.py", k).alias("path"), F.when(k % 5 < 4, _n("import os\nimport q%d\n", k + 1)).otherwise("import os\n").alias("text"))
    root = shared_path(s, "packages")
    tree.write_tree(head.unionByName(module), root)
    seeds = own.select(_n("q%d", k).alias("unit"), _n("q%d/__init__.py", k).alias("path"), F.lit(0).alias("ord"))
    found = files.relative(files.read_sources(s, root, [".py"]), root)
    return python_code.import_closure(found, seeds).select("unit", F.col("pos").cast("long").alias("pos"), "path")


def _summary_log(s, d):
    """A cache of summaries in three appends, the second one tried twice, and a file of others with broken lines."""
    own = table(s, d, "lineitem").select(
        _n("k%d", "l_suppkey").alias("key"), F.when(F.col("l_linenumber") % 4 < 3, _n("s%d:%d", "l_orderkey", "l_linenumber")).alias("summary"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    path = shared_path(s, "cache")
    at = F.when(F.col("n") <= 2, 1).when(F.col("n") <= 4, 2).otherwise(3)
    for epoch in (1, 2, 2, 3):
        log.append_lines(own.where(at == epoch), path, ["o", "n"], epoch)
    broken = table(s, d, "supplier").select(F.explode(F.array(_n('{"key": "k%d"', "s_suppkey"), _n('{"key": "k%d", "text": 1}', "s_suppkey"), F.lit(""), F.lit("[1]"))).alias("value"))
    broken.write.text(f"{path}/others")
    return log.read_cache(s, path)


def _retried_costs(s, d):
    """The costs of orders, appended in two batches of which the first came twice, added up by customer."""
    own = table(s, d, "orders").select(_n("r%d", "o_orderkey").alias("run_id"), F.col("o_orderdate").cast("string").alias("finished_at"), _n("c%d", "o_custkey").alias("customer"), (F.col("o_totalprice") * 100).cast("long").alias("cents"))
    path = shared_path(s, "costs")
    batch = F.substring("run_id", -1, 1).cast("int") % 2
    for n in (0, 0, 1):
        files.append_cost_log(own.where(batch == n), path, n)
    of = lambda name: F.try_element_at("line", F.lit(name))
    lines = log.read_lines(s, path).select(of("customer").alias("customer"), of("cents").cast("long").alias("cents"))
    return lines.groupBy("customer").agg(F.count("*").alias("runs"), F.sum("cents").alias("cents"))


_CODE = {
    "node": lambda k: _text(
        "/* import { Z } from 'no'; new NoClient() */", "import {", "  A, // from 'no'", "  from_, B } ", _n("  from '@aws-sdk/c%d';", k), "const s = \"require('no')\", t = `import x from 'no'", " new NoClient(` + \"\\\" new NoClient()\";",
        "const r = require(", "  \"./x\");", F.when(k % 2 == 0, "const q = new\n  SQSClient({});").otherwise("new aws.OddThingClient"), "// new NoClient()", "const e = x.split(/['\"]/); import './side';", "import('no'); a.require('no')",
    ),
    "typescript": lambda k: _text("import type {", "  A,", _n("} from './c%d'; // import 'no'", k), "const t = 'new NoClient()';", "const c: Map<string, X> = new DynamoDBDocumentClient<A>(x)"),
    "java": lambda k: _text(
        "/** import no.No; */ import", _n("  static com.acme.C%d.*;", k), "String s = \"new NoClient(\\\")\";", "String t = \"\"\"", "  import no.No; \" new NoClient()", "\"\"\"; char c = '\"';", "var a = S3Client", "  .builder().build(); // NoClient.builder()",
        F.when(k % 2 == 0, "new SfnClient (x);").otherwise("new FooClient<A>(x);"), "import java.util.List;",
    ),
    "csharp": lambda k: _text(
        "using System.Text; // using No;", "global using static", _n("  Acme.C%d;", k), "using (var x = y) { using var z = w; }", "var p = @\"c:\\\"; var q = @\"\"\"new AmazonNoClient()\"; var i = $\"{a} new AmazonNoClient()\";", "var c = new", "  AmazonSimpleNotificationServiceClient();",
        F.when(k % 2 == 0, "new AmazonKinesisClient { A = 1 };").otherwise("new OddClient();"), "using Alias = Acme.Long.Name;",
    ),
}


def _syntax(language):
    def run(s, d):
        k = F.col("c_custkey")
        found = script_code.sdk_calls(table(s, d, "customer").select(_n("c%d", k).alias("path"), _CODE[language](k).alias("text")), language)
        return found.select("path", F.col("line_no").cast("long").alias("line_no"), "kind", "value", "service", "is_external")

    return run


def _syntax_oracle(*rows):
    """Rows (condition on k or none, line, kind, value as SQL, service or none, external or none) of each customer."""
    sql = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"
    return " UNION ALL ".join(
        f"SELECT 'c' || k AS path, {line}::BIGINT AS line_no, '{kind}' AS kind, {value} AS value, {sql(service)}::VARCHAR AS service, {sql(external)}::BOOLEAN AS is_external FROM (SELECT c_custkey AS k FROM customer) WHERE {when or 'true'}"
        for when, line, kind, value, service, external in rows)


QUERIES = {
    "source_tree": _tree,
    "import_closure_tree": _packages,
    "summary_log": _summary_log,
    "cost_log_retried": _retried_costs,
    "sdk_syntax": _syntax("node"),
    "sdk_syntax_typescript": _syntax("typescript"),
    "sdk_syntax_java": _syntax("java"),
    "sdk_syntax_csharp": _syntax("csharp"),
}

ORACLES = {
    "source_tree": """WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT CASE k % 6 WHEN 0 THEN 'p' || k % 37 || '/m' || k || '/__init__.py' WHEN 1 THEN 'p' || k % 37 || '/_x' || k || '.py' WHEN 2 THEN '.hid' || k % 37 || '/y' || k || '.py'
  WHEN 3 THEN 'p' || k % 37 || '/_priv/z' || k || '.PY' ELSE 'p' || k % 37 || '/b' || k || '.py' END AS path,
  (8 + length(k::VARCHAR) + CASE WHEN k % 6 = 4 THEN 3 ELSE 0 END)::BIGINT AS size,
  'x = ' || k || chr(10) || 'é' || CASE WHEN k % 6 = 4 THEN chr(65533) || 'A' || chr(65533) ELSE '' END AS text FROM c WHERE k % 6 < 5""",
    "import_closure_tree": """WITH c AS (SELECT c_custkey AS k FROM customer), r AS (SELECT a.k, b.k AS j FROM c a JOIN c b ON b.k >= a.k AND b.k // 5 = a.k // 5),
f AS (SELECT k, 'q' || j || '/__init__.py' AS path, (j = k)::INT AS own FROM r UNION ALL SELECT k, 'q' || j || '/_x.py', 0 FROM r)
SELECT 'q' || k AS unit, row_number() OVER (PARTITION BY k ORDER BY own DESC, path) - 1 AS pos, path FROM f""",
    "summary_log": """SELECT 'k' || l_suppkey AS key, arg_max('s' || l_orderkey || ':' || l_linenumber, (CASE WHEN l_linenumber <= 2 THEN 1 WHEN l_linenumber <= 4 THEN 2 ELSE 3 END, l_orderkey, l_linenumber)) AS summary
FROM lineitem WHERE l_linenumber % 4 < 3 GROUP BY 1""",
    "cost_log_retried": "SELECT 'c' || o_custkey AS customer, count(*) AS runs, sum(trunc(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1",
    "sdk_syntax": _syntax_oracle(
        (None, 2, "import", "'@aws-sdk/c' || k", None, True), (None, 8, "import", "'./x'", None, False), ("k % 2 = 0", 10, "new", "'SQSClient'", "sqs", None), ("k % 2 = 1", 10, "new", "'aws.OddThingClient'", "aws.oddthing", None),
        (None, "CASE WHEN k % 2 = 0 THEN 13 ELSE 12 END", "import", "'./side'", None, False)),
    "sdk_syntax_typescript": _syntax_oracle((None, 1, "import", "'./c' || k", None, False), (None, 5, "new", "'DynamoDBDocumentClient'", "dynamodb", None)),
    "sdk_syntax_java": _syntax_oracle(
        (None, 1, "import", "'com.acme.C' || k || '.*'", None, False), (None, 7, "builder", "'S3Client'", "s3", None), ("k % 2 = 0", 9, "new", "'SfnClient'", "stepfunctions", None), (None, 10, "import", "'java.util.List'", None, True)),
    "sdk_syntax_csharp": _syntax_oracle(
        (None, 1, "import", "'System.Text'", None, True), (None, 2, "import", "'Acme.C' || k", None, False), (None, 6, "new", "'AmazonSimpleNotificationServiceClient'", "sns", None),
        ("k % 2 = 0", 8, "new", "'AmazonKinesisClient'", "kinesis", None), (None, 9, "import", "'Alias'", None, False)),
}
