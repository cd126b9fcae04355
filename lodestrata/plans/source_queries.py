"""Queries from source text to graphs: programs, job control, Python, manifests and discovery, with their oracles.

Texts vary by key: where lines stand, which statements there are, which books and manifests are found.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.tables import cut
from lodestrata.operators import cobol, crud, discovery, extract, graph, iac, jcl, metrics, projection, python_code, spans
from lodestrata.plans.estate import table


def _text(*parts):
    """Lines, each a text or a column, joined."""
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _n(form, *columns):
    return F.format_string(form, *columns)


def programs(s, d):
    """(path, text): a COBOL program a supplier; comments, the book, USING, the SQL verb and the CICS block come and go."""
    k = F.col("s_suppkey")
    text = _text(
        "       IDENTIFICATION DIVISION.", _n("       program-id. Pgm%d.", k), F.when(k % 4 > 0, F.regexp_replace(F.repeat(F.lit("      * READ NOTHING.\n"), (k % 4).cast("int")), r"\n$", "")),
        "       ENVIRONMENT DIVISION.", _n("           SELECT IN-FILE ASSIGN TO DDIN%d.", k % 3), _n("           SELECT OUT-FILE ASSIGN TO OUT%d.", k % 3), "       DATA DIVISION.", "       FILE SECTION.",
        "       FD  IN-FILE.", "       01  IN-REC.", "           05  IN-KEY PIC 9(5).", "       FD  OUT-FILE.", "       01  OUT-REC.", "           05  OUT-KEY", "               PIC X(5).",
        "       WORKING-STORAGE SECTION.", _n("           COPY BOOK%d.", k % 5), "       LINKAGE SECTION.", "       01  LK-REC PIC X.",
        F.when(k % 3 == 0, "       PROCEDURE DIVISION USING LK-REC.").otherwise("       PROCEDURE DIVISION."), "       MAIN-SECT SECTION.", "       MAIN-PARA.", "           PERFORM WORK-PARA.",
        "           PERFORM NO-PARA.", _n("           CALL 'PGM%d'.", k + 1), "           READ IN-FILE.", "           END-READ.", "       WORK-PARA.", "           WRITE OUT-REC.", "           EXEC SQL",
        F.when(k % 2 == 0, "             select X FROM T").otherwise("             UPDATE T SET X = 1"), "           END-EXEC.", F.when(k % 2 == 0, "           EXEC CICS LINK END-EXEC.").otherwise("           DISPLAY X."),
    )
    return table(s, d, "supplier").select(_n("src/p%d.cbl", k).alias("path"), text.alias("text"))


def books(s, d):
    """(path, text): a book a nation in the copy folder, all but BOOK4, and one of the same name in a later folder."""
    n = F.col("n_nationkey") + (F.col("n_nationkey") >= 4).cast("int")
    good = _text(
        "       DATA DIVISION.", "       01  WS-REC.", "           05  WS-A PIC 9(3).", "               88  IS-ON VALUE 'Y'.", "               88  IS-LOW VALUE '1' THRU '3'.",
        "           05  WS-B REDEFINES WS-A PIC X(3).", "           05  WS-T OCCURS 1 TO 9 TIMES DEPENDING ON WS-A PIC X(4).",
    )
    own = table(s, d, "nation")
    return own.select(_n("copybooks/book%d.cpy", n).alias("path"), good.alias("text")).unionByName(own.select(_n("copy/BOOK%d.cob", n).alias("path"), F.lit("       01  OTHER PIC X.").alias("text")))


def jobs(s, d):
    """(path, text): a job a supplier; some programs are unknown, datasets are bound on continuations."""
    k = F.col("s_suppkey")
    text = _text(
        _n("//job%d JOB (1),", k), "// CLASS=A", "//* DD DSN=NOT.THIS", _n("//S1 EXEC PGM=PGM%d", F.when(k % 7 == 6, k + 100_000).otherwise(k)), _n("//IN%d DD DISP=SHR,", k % 3), _n("//      DSN=PROD.IN.D%d(0)", k),
        "//STEPLIB DD DSN=LOAD.LIB", _n("//OUT%d DD SYSOUT=A", k % 3), "NOT A CARD", "//NODATA DD DUMMY",
    )
    return table(s, d, "supplier").select(_n("jcl/j%d.jcl", k).alias("path"), text.alias("text"))


def _cobol(s, d):
    return cobol.graph_of(programs(s, d), cobol.copybooks(books(s, d)))


def _estate(s, d):
    """(nodes, edges) of programs and jobs, each written once before it is asked."""
    n, e = (cut(x) for x in _cobol(s, d))
    n2, e2 = jcl.graph_of(jobs(s, d), n.where("kind = 'program'").select(F.col("name").alias("program")))
    return cut(graph.upsert_nodes(n.unionByName(n2))), cut(e.unionByName(e2))


def _shown(nodes):
    pairs = F.transform(F.array_sort(F.map_entries("attributes")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return nodes.select("id", "kind", "name", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.array_join(pairs, ";").alias("attributes"))


def _dictionary(s, d):
    return cobol.data_dictionary(_cobol(s, d)[0])


def _paragraphs(s, d):
    n = _cobol(s, d)[0].where("kind = 'paragraph'").withColumn("program", F.split_part("id", F.lit(":"), F.lit(2)))
    told = F.when(F.col("name") == "MAIN-PARA", "does work")
    return metrics.paragraph_texts(n.select("program", "name", "file", "start_line", "end_line", "raw_text", told.alias("summary")), 60, 100)


def _summaries(s, d):
    n, e = _cobol(s, d)
    own = n.select("id", "kind", "name", "start_line", F.concat(F.lit("about "), "name").alias("summary"))
    return metrics.summaries(graph.program_members(n, e), own, "paragraph").select("program", F.col("pos").cast("long").alias("pos"), "name", "summary")


def _effects(s, d):
    n, e = _cobol(s, d)
    prose = n.where("kind = 'program'").select(F.col("id").alias("program"), F.when(F.col("name").endswith("3"), " None ").otherwise(" told ").alias("text"))
    flat = graph.flat(n, e)
    return metrics.side_effects(graph.program_members(n, e), flat[1], flat[0], prose).select("program", F.array_join("effects", "|").alias("effects"))


def modules(s, d):
    """(path, text, unit_id): a Python module a customer; every fiftieth doesn't parse."""
    k = F.col("c_custkey")
    text = _text(
        "import os", F.when(k % 3 > 0, F.repeat(F.lit("#\n"), (k % 3 - 1).cast("int"))), "ddb = boto3.resource('dynamodb')", _n("t: object = ddb.Table('T%d')", k), "async def put(x):", "    t.put_item(Item=x)",
        "    ddb.Table('U').get_item(Key=x)", "def send(q):", _n("    boto3.client('sqs').send_message(QueueUrl='q%d')", k), "boto3.client('s3').list_buckets()", "from ..pkg import y", F.when(k % 50 == 0, "def ("),
    )
    return table(s, d, "customer").select(_n("pkg/m%d.py", k).alias("path"), text.alias("text"), _n("pkg.m%d", k).alias("unit_id"))


def _calls(s, d):
    """(calls, functions, units) of the modules."""
    m = modules(s, d)
    f = cut(python_code.python_facts(m).join(m.select("path", "unit_id"), "path"))
    calls = f.where("kind = 'call'").select("unit_id", "ord", "service", F.col("value").alias("operation"), F.col("resource").alias("name"), F.col("path").alias("file"), F.col("line_no").alias("line"))
    raw = F.lit(None).cast("string").alias("raw_text")
    functions = f.where("kind = 'function'").select("unit_id", "ord", F.col("value").alias("name"), F.col("path").alias("file"), F.col("line_no").alias("start_line"), F.col("end_line").alias("end_line"), raw)
    units = m.select("unit_id", F.lit("python").alias("language"), F.col("path").alias("root_path"), F.lit(None).cast("string").alias("handler_entry"), F.col("path").alias("first_file"), F.lit(9).alias("loc"))
    return calls, functions, units


def _projected(s, d):
    calls, functions, units = _calls(s, d)
    return projection.graph_of(units, calls, functions)


def _closure(s, d):
    """Files of a chain of packages: each imports the next two by different forms, one of them relative."""
    k = F.col("n_nationkey")
    text = _text(_n("import p.m%d.deep.name", k + 1), _n("from . import m%d", k + 2), "import os, boto3")
    files = table(s, d, "nation").select(_n("p/m%d.py", k).alias("path"), text.alias("text"))
    seeds = table(s, d, "nation").select(_n("u%d", k).alias("unit"), _n("p/m%d.py", k).alias("path"), F.lit(0).alias("ord"))
    return python_code.import_closure(files, seeds).select("unit", F.col("pos").cast("long").alias("pos"), "path")


def manifests(s, d):
    """(path, text): three kinds of manifests a nation, with resources of other types and shapes, and some that don't parse."""
    n = F.col("n_nationkey")
    sam = _text(
        "Resources:", "  Bad: text", "  Worse: [1]", _n("  Q%d:", n), "    Type: AWS::SQS::Queue", _n("  F%d:", n), "    Type: AWS::Serverless::Function", "    Properties:", "      Events:", "        A:", "          Type: SQS",
        "          Properties:", _n("            Queue: !GetAtt Q%d.Arn", n), "        B:", "          Type: DynamoDB", "          Properties:", _n("            Stream: arn:aws:dynamodb:x:1:T%d", n), "        C:",
        "          Type: Api", "          Properties:", _n("            Path: /p%d", n), "        D: nothing",
    )
    service = _text("functions:", _n("  g%d:", n), "    events:", _n("      - sqs: {arn: 'arn:aws:sqs:x:1:s%d'}", n), "      - s3: {Bucket: b}", "      - schedule", _n("      - sns: 'arn:aws:sns:x:1:n%d'", n), F.when(n % 5 == 0, "  bad: ["))
    mapped = _n('{"Resources": {"M": {"Type": "AWS::Lambda::EventSourceMapping", "Properties": {"EventSourceArn": "arn:aws:kinesis:x:1:k%d", "FunctionName": "h%d"}}, "X": [], '
                '"N": {"Type": "AWS::Lambda::EventSourceMapping", "Properties": {"EventSourceArn": "short:%d", "FunctionName": {"Ref": "Y"}}}}}', n, n, n)
    own = table(s, d, "nation")
    files = [own.select(_n(p, n).alias("path"), t.alias("text")) for p, t in (("a%d/template.yaml", sam), ("b%d/serverless.yml", service), ("c/x%d.template.json", mapped), ("d%d/other.yaml", sam))]
    return graph.union_all(files)


def _declared(s, d):
    known = table(s, d, "nation").where("n_nationkey % 2 = 0").select(_n("dataset_ref:queue:Q%d", "n_nationkey").alias("id"))
    return iac.dataset_nodes(iac.hints(manifests(s, d)), known).select("id", "kind", "name", F.element_at("attributes", "origin").alias("origin"))


_TREE = (
    "import os\ndef handler(event, context):\n    pass", "# notes", "exports.handler = async () => {}", "class A implements RequestHandler<X, Y> {}", "<project/>",
    "public string FunctionHandler() {}", "exports.handler = 1", "def lambda_handler(event, context): pass",
)


def tree(s, d):
    """(path, text): a source tree from customers: handlers alone and many in a folder, tests, skipped folders, Java modules, C#, plain text."""
    k = F.col("c_custkey")
    of = lambda form: _n(form, k % 37, k)
    path = F.element_at(F.array(of("svc%d/h%d.py"), of("docs%d/n%d.md"), of("svc%d/j%d.js"), of("jav%d/src/main/A%d.java"), _n("jav%d/pom.xml", k % 37), of("cs%d/F%d.cs"), of("node_modules/x%d/i%d.js"), of("svc%d/test_h%d.py")), (k % 8 + 1).cast("int"))
    text = F.element_at(F.array(*(F.lit(t) for t in _TREE)), (k % 8 + 1).cast("int"))
    return table(s, d, "customer").select(path.alias("path"), text.alias("text")).distinct()


def _notes(s, d):
    """A tree without handlers: a note a customer, some in hidden and skipped folders, some at the top."""
    k = F.col("c_custkey")
    path = F.element_at(F.array(_n("docs%d/n%d.md", k % 37, k), _n(".git/n%d", k), _n("build/n%d.md", k), _n("n%d.md", k)), (k % 4 + 1).cast("int"))
    return table(s, d, "customer").select(path.alias("path"), F.lit("# notes").alias("text"))


def _discovered(s, d):
    files = tree(s, d)
    return discovery.discover(files.select(F.substring_index("path", "/", 1).alias("unit")), files)


def _cobol_tree(s, d):
    k = F.col("c_custkey")
    path = F.element_at(F.array(_n("a/p%d.cbl", k), _n("a/.old/p%d.cob", k), _n("p%d.COBOL", k), _n("a/p%d.cpy", k)), (k % 4 + 1).cast("int"))
    text = F.when(k % 3 == 0, "* nothing").otherwise(_n("       identification division.\n       Program-Id. X%d.", k))
    return table(s, d, "customer").select(path.alias("path"), text.alias("text"))


def _scripts(s, d, language):
    k = F.col("c_custkey")
    text = {
        "node": _text(_n("import { A } from '@aws-sdk/c%d';", k), "const r = require(\"./x\");", F.when(k % 2 == 0, "const q = new SQSClient({});").otherwise("new OddThingClient()")),
        "java": _text(_n("import static com.acme.C%d.*;", k), "import java.util.List;", "S3Client a = S3Client.builder().build();", F.when(k % 2 == 0, "new SfnClient(x);")),
        "csharp": _text("using System.Text;", _n("using Acme.C%d;", k), "var c = new AmazonSimpleNotificationServiceClient();"),
        "typescript": _text(_n("import type { A } from './c%d';", k), "new DynamoDBDocumentClient(x)"),
    }[language]
    files = table(s, d, "customer").select(_n("c%d", k).alias("path"), text.alias("text"))
    return extract.sdk_calls_by_regex(files, language).select("path", F.col("line_no").cast("long").alias("line_no"), "kind", "value", "service", "is_external")


def _around(s, d):
    """The part whose span of lines is innermost around each line item, in its supplier's file, and how many spans hold it; spans are nested and overlap."""
    n = table(s, d, "supplier").agg(F.count("*").alias("n"))
    own = table(s, d, "part").join(F.broadcast(n)).select((F.col("p_partkey") % F.col("n")).alias("file"), F.col("p_name").alias("name"), (F.col("p_partkey") % 89 * 11).alias("start_line"), (F.col("p_partkey") % 89 * 11 + F.col("p_size") * F.col("p_size")).alias("end_line"))
    items = table(s, d, "lineitem").select(F.col("l_suppkey").alias("file"), "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 4000).alias("line"))
    return spans.around(items, own, ["file"], ["l_orderkey", "l_linenumber"])


def _fences(s, d):
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("text\n```python path=a/"), k.cast("string"), F.lit(".py\nx = 1\n```\nmore\n```\n# path="), F.when(k % 5 == 0, "../up").otherwise("./ok//z/../y"), F.lit("\ny\n```\n"),
        F.lit("```\npath=bare\nz\n```\n```xml\n<!-- path=pom.xml -->\n<p/>\n```\n```\nno path\n```\n```c\n/* path=c.h */ int x;\n```"),
    )
    return extract.fenced_files(table(s, d, "customer").select(k.alias("id"), text.alias("text")))


def _jsons(s, d):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("{bad} then {\"a\": 1}"))).when(k % 4 == 1, _n('see ```json\n{"k": %d, "t": "}\\"{"}\n``` {', k)).when(k % 4 == 2, F.lit("none")).otherwise(_n('x {"n": {"k": %d}} {"o": 1}', k))
    return table(s, d, "customer").select("c_custkey", text.alias("t")).select("c_custkey", extract.first_json_object("t").alias("j"))


QUERIES = {
    "cobol_nodes": lambda s, d: _shown(graph.upsert_nodes(_cobol(s, d)[0])),
    "cobol_kg_edges": lambda s, d: graph.distinct_edges(_cobol(s, d)[1]).drop("ord"),
    "cobol_file_io": lambda s, d: _cobol(s, d)[1].where("kind in ('reads', 'writes') and target like 'file:%'").select("source", "target", "kind", "evidence"),
    "cobol_calls": lambda s, d: cobol.service_calls(programs(s, d)).select("path", F.col("line_no").cast("long").alias("line_no"), "service", "operation"),
    "cobol_imports": lambda s, d: cobol.copy_imports(programs(s, d)).select("path", F.col("line_no").cast("long").alias("line_no"), "module"),
    "cobol_programs": lambda s, d: cobol.programs(programs(s, d)).select("path", "program", "using"),
    "cobol_crud": lambda s, d: crud.crud_matrix(*graph.flat(*_estate(s, d))).select("program", "kind", "name", "symbol"),
    "data_dictionary": _dictionary,
    "dictionary_text": lambda s, d: cobol.dictionary_text(_dictionary(s, d)),
    "paragraph_texts": _paragraphs,
    "summaries": _summaries,
    "effects_with_narrative": _effects,
    "copybooks": lambda s, d: cobol.expanded(programs(s, d), cobol.copybooks(books(s, d))).select("path", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.col("text").contains("WS-T").alias("has_book"), F.col("text").contains("COPY").alias("has_copy")),
    "jcl_nodes": lambda s, d: _shown(graph.upsert_nodes(jcl.graph_of(jobs(s, d), _known(s, d))[0])),
    "jcl_kg_edges": lambda s, d: jcl.graph_of(jobs(s, d), _known(s, d))[1].select("source", "target", "kind", "evidence", F.try_element_at("attributes", F.lit("dd_name")).alias("dd_name")),
    "python_facts": lambda s, d: python_code.python_facts(modules(s, d)).where("kind <> 'call'").select("path", F.col("line_no").cast("long").alias("line_no"), "kind", "value"),
    "python_bindings": lambda s, d: python_code.python_facts(modules(s, d)).where("kind = 'call'").select("path", F.col("line_no").cast("long").alias("line_no"), "service", "value", "resource"),
    "import_closure": _closure,
    "kg_from_ir_nodes": lambda s, d: graph.upsert_nodes(_projected(s, d)[0]).select("id", "kind", "name"),
    "kg_from_ir_edges": lambda s, d: _projected(s, d)[1].select("source", "target", "kind", "evidence"),
    "typed_hints": lambda s, d: projection.typed_hints(_calls(s, d)[0]),
    "iac_hints": lambda s, d: iac.hints(manifests(s, d)),
    "iac_nodes": _declared,
    "handler_units": lambda s, d: discovery.handler_units(tree(s, d)),
    "handler_units_fallback": lambda s, d: discovery.handler_units(_notes(s, d)),
    "discovery": lambda s, d: _discovered(s, d)[0],
    "scan_warnings": lambda s, d: _discovered(s, d)[1],
    "program_units": lambda s, d: discovery.program_units(_cobol_tree(s, d)),
    "glob_files": lambda s, d: discovery.glob(tree(s, d), "svc[!12]*/*h?.py").select("path"),
    "sdk_regex": lambda s, d: _scripts(s, d, "node"),
    "sdk_regex_java": lambda s, d: _scripts(s, d, "java"),
    "sdk_regex_csharp": lambda s, d: _scripts(s, d, "csharp"),
    "sdk_regex_typescript": lambda s, d: _scripts(s, d, "typescript"),
    "spans_around": _around,
    "fenced_files": _fences,
    "json_first": _jsons,
}


def _known(s, d):
    return table(s, d, "supplier").select(_n("PGM%d", "s_suppkey").alias("program"))


# k: comment lines, m: lines that the book adds less one, b: whether there is one, o: where the procedure division stands.
_P = """p AS (SELECT s_suppkey AS s, 'PGM' || s_suppkey AS pgm, 'src/p' || s_suppkey || '.cbl' AS path, s_suppkey % 4 AS k, CASE WHEN s_suppkey % 5 < 4 THEN 5 ELSE 0 END AS m, s_suppkey % 5 < 4 AS b,
  19 + s_suppkey % 4 + CASE WHEN s_suppkey % 5 < 4 THEN 5 ELSE 0 END AS o, CASE WHEN s_suppkey % 2 = 0 THEN 'SELECT' ELSE 'UPDATE' END AS verb FROM supplier)"""
_FIELDS = """f AS (SELECT s, pgm, path, k, unnest([{'r': 'IN-REC', 'f': 'IN-KEY', 'l': 10, 'e': 10, 'a': 'level=05;pic=9(5)'}, {'r': 'OUT-REC', 'f': 'OUT-KEY', 'l': 13, 'e': 14, 'a': 'level=05;pic=X(5)'}]) AS x FROM p
  UNION ALL SELECT s, pgm, path, k, unnest([{'r': 'WS-REC', 'f': 'WS-A', 'l': 17, 'e': 17, 'a': 'condition_values=IS-ON=''Y''|IS-LOW=''1'' THRU ''3'';level=05;pic=9(3)'},
    {'r': 'WS-REC', 'f': 'WS-B', 'l': 20, 'e': 20, 'a': 'level=05;pic=X(3);redefines=WS-A'},
    {'r': 'WS-REC', 'f': 'WS-T', 'l': 21, 'e': 21, 'a': 'depending_on=WS-A;level=05;occurs=1 TO 9 TIMES DEPENDING ON WS-A;occurs_max=9;occurs_min=1;pic=X(4)'}]) FROM p WHERE b)"""
_DICT = f"""{_P}, {_FIELDS}, dict AS (SELECT pgm AS program, x.r AS record, x.f AS field, '05' AS level, regexp_extract(x.a, 'pic=([^;]+)', 1) AS pic, regexp_extract(x.a, 'redefines=([^;]+)', 1) AS redefines,
  regexp_extract(x.a, 'occurs=([^;]+)', 1) AS occurs, regexp_extract(x.a, 'condition_values=([^;]+)', 1) AS conditions, '' AS group_name FROM f)"""
_M = """m AS (SELECT c_custkey AS c, 'pkg/m' || c_custkey || '.py' AS path, 'pkg.m' || c_custkey AS u, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS k FROM customer WHERE c_custkey % 50 <> 0),
calls AS (SELECT c, path, u, k, unnest([{'l': 3, 's': 'dynamodb', 'o': 'Table', 'r': 'T' || c, 'f': '_module_'}, {'l': 5, 's': 'dynamodb', 'o': 'put_item', 'r': NULL, 'f': 'put'}, {'l': 6, 's': 'dynamodb', 'o': 'get_item', 'r': NULL, 'f': 'put'},
  {'l': 6, 's': 'dynamodb', 'o': 'Table', 'r': 'U', 'f': 'put'}, {'l': 8, 's': 'sqs', 'o': 'send_message', 'r': 'q' || c, 'f': 'send'}, {'l': 9, 's': 's3', 'o': 'list_buckets', 'r': NULL, 'f': '_module_'}]) AS x FROM m),
acc AS (SELECT *, CASE x.s WHEN 'dynamodb' THEN 'dynamodb_table' WHEN 'sqs' THEN 'sqs_queue' ELSE 's3_bucket' END AS kind, CASE x.o WHEN 'put_item' THEN 'writes' WHEN 'send_message' THEN 'produces' ELSE 'reads' END AS access FROM calls)"""
_T = """t AS (SELECT DISTINCT c_custkey % 8 AS k, CASE c_custkey % 8 WHEN 0 THEN 'svc' || g || '/h' || c_custkey || '.py' WHEN 1 THEN 'docs' || g || '/n' || c_custkey || '.md' WHEN 2 THEN 'svc' || g || '/j' || c_custkey || '.js'
  WHEN 3 THEN 'jav' || g || '/src/main/A' || c_custkey || '.java' WHEN 4 THEN 'jav' || g || '/pom.xml' WHEN 5 THEN 'cs' || g || '/F' || c_custkey || '.cs' WHEN 6 THEN 'node_modules/x' || g || '/i' || c_custkey || '.js'
  ELSE 'svc' || g || '/test_h' || c_custkey || '.py' END AS path, g FROM (SELECT c_custkey, c_custkey % 37 AS g FROM customer))"""
_JOBS = """j AS (SELECT s_suppkey AS s, 'JOB' || s_suppkey AS job, 'step:JOB' || s_suppkey || ':S1' AS step, 'jcl/j' || s_suppkey || '.jcl' AS path, CASE WHEN s_suppkey % 7 = 6 THEN s_suppkey + 100000 ELSE s_suppkey END AS p FROM supplier)"""

ORACLES = {
    "cobol_nodes": f"""WITH {_P}, {_FIELDS}, n AS (
SELECT 'program:' || pgm AS id, 'program' AS kind, pgm AS name, 1 AS start_line, o + 13 AS end_line, CASE WHEN s % 3 = 0 THEN 'callable=true;' ELSE '' END || 'language=cobol' || CASE WHEN s % 3 = 0 THEN ';linkage_using=LK-REC' ELSE '' END AS attributes FROM p
UNION ALL SELECT 'section:' || pgm || ':MAIN-SECT', 'section', 'MAIN-SECT', o + 1, o + 1, '' FROM p
UNION ALL SELECT 'paragraph:' || pgm || ':MAIN-PARA', 'paragraph', 'MAIN-PARA', o + 2, o + 7, '' FROM p
UNION ALL SELECT 'paragraph:' || pgm || ':WORK-PARA', 'paragraph', 'WORK-PARA', o + 8, o + 13, '' FROM p
UNION ALL SELECT 'file:' || pgm || ':IN-FILE', 'file', 'IN-FILE', 8 + k, 8 + k, 'dd_name=DDIN' || (s % 3) FROM p
UNION ALL SELECT 'file:' || pgm || ':OUT-FILE', 'file', 'OUT-FILE', 11 + k, 11 + k, 'dd_name=OUT' || (s % 3) FROM p
UNION ALL SELECT 'record:' || pgm || ':IN-REC', 'record', 'IN-REC', 9 + k, 9 + k, 'level=01' FROM p
UNION ALL SELECT 'record:' || pgm || ':OUT-REC', 'record', 'OUT-REC', 12 + k, 12 + k, 'level=01' FROM p
UNION ALL SELECT 'record:' || pgm || ':WS-REC', 'record', 'WS-REC', 16 + k, 16 + k, 'level=01' FROM p WHERE b
UNION ALL SELECT 'field:' || pgm || ':' || x.r || ':' || x.f, 'field', x.f, x.l + k, x.e + k, x.a FROM f
UNION ALL SELECT 'external_call:' || pgm || ':PGM' || (s + 1) || ':' || (o + 5), 'external_call', 'PGM' || (s + 1), o + 5, o + 5, 'call_style=literal;target=PGM' || (s + 1) FROM p
UNION ALL SELECT 'sql_block:' || pgm || ':0:' || (o + 10), 'sql_block', 'SQL-' || verb, o + 10, o + 12, 'verb=' || verb FROM p
UNION ALL SELECT 'txn_call:' || pgm || ':0:' || (o + 13), 'txn_call', 'CICS-LINK', o + 13, o + 13, 'verb=LINK' FROM p WHERE s % 2 = 0)
SELECT id, kind, name, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, attributes FROM n""",
    "cobol_kg_edges": f"""WITH {_P}, {_FIELDS}
SELECT 'program:' || pgm AS source, 'section:' || pgm || ':MAIN-SECT' AS target, 'contains' AS kind, path || ':' || (o + 1) AS evidence FROM p
UNION ALL SELECT 'section:' || pgm || ':MAIN-SECT', 'paragraph:' || pgm || ':MAIN-PARA', 'contains', path || ':' || (o + 2) FROM p
UNION ALL SELECT 'section:' || pgm || ':MAIN-SECT', 'paragraph:' || pgm || ':WORK-PARA', 'contains', path || ':' || (o + 8) FROM p
UNION ALL SELECT 'program:' || pgm, 'file:' || pgm || ':IN-FILE', 'contains', path || ':' || (8 + k) || ' FD' FROM p
UNION ALL SELECT 'program:' || pgm, 'file:' || pgm || ':OUT-FILE', 'contains', path || ':' || (11 + k) || ' FD' FROM p
UNION ALL SELECT 'file:' || pgm || ':IN-FILE', 'record:' || pgm || ':IN-REC', 'contains', path || ':' || (9 + k) FROM p
UNION ALL SELECT 'file:' || pgm || ':OUT-FILE', 'record:' || pgm || ':OUT-REC', 'contains', path || ':' || (12 + k) FROM p
UNION ALL SELECT 'program:' || pgm, 'record:' || pgm || ':WS-REC', 'contains', path || ':' || (16 + k) FROM p WHERE b
UNION ALL SELECT 'record:' || pgm || ':' || x.r, 'field:' || pgm || ':' || x.r || ':' || x.f, 'contains', path || ':' || (x.l + k) FROM f
UNION ALL SELECT 'field:' || pgm || ':WS-REC:WS-B', 'field:' || pgm || ':WS-REC:WS-A', 'redefines', 'REDEFINES WS-A' FROM p WHERE b
UNION ALL SELECT 'paragraph:' || pgm || ':MAIN-PARA', 'paragraph:' || pgm || ':WORK-PARA', 'performs', path || ':' || (o + 3) FROM p
UNION ALL SELECT 'paragraph:' || pgm || ':MAIN-PARA', 'external_call:' || pgm || ':PGM' || (s + 1) || ':' || (o + 5), 'calls', path || ':' || (o + 5) FROM p
UNION ALL SELECT 'paragraph:' || pgm || ':MAIN-PARA', 'file:' || pgm || ':IN-FILE', 'reads', path || ':' || (o + 6) || ' READ' FROM p
UNION ALL SELECT 'paragraph:' || pgm || ':WORK-PARA', 'file:' || pgm || ':OUT-FILE', 'writes', path || ':' || (o + 9) || ' WRITE' FROM p
UNION ALL SELECT 'paragraph:' || pgm || ':WORK-PARA', 'sql_block:' || pgm || ':0:' || (o + 10), CASE WHEN s % 2 = 0 THEN 'reads' ELSE 'writes' END, path || ':' || (o + 10) FROM p
UNION ALL SELECT 'paragraph:' || pgm || ':WORK-PARA', 'txn_call:' || pgm || ':0:' || (o + 13), 'calls', path || ':' || (o + 13) FROM p WHERE s % 2 = 0""",
    "cobol_file_io": f"""WITH {_P} SELECT 'paragraph:' || pgm || ':MAIN-PARA' AS source, 'file:' || pgm || ':IN-FILE' AS target, 'reads' AS kind, path || ':' || (o + 6) || ' READ' AS evidence FROM p
UNION ALL SELECT 'paragraph:' || pgm || ':WORK-PARA', 'file:' || pgm || ':OUT-FILE', 'writes', path || ':' || (o + 9) || ' WRITE' FROM p""",
    "cobol_calls": f"""WITH {_P}, q AS (SELECT *, 19 + k AS o1 FROM p) SELECT path, (o1 + 5)::BIGINT AS line_no, 'cobol-call' AS service, 'PGM' || (s + 1) AS operation FROM q UNION ALL SELECT path, o1 + 6, 'vsam', 'read:IN-FILE' FROM q
UNION ALL SELECT path, o1 + 9, 'vsam', 'write:OUT-REC' FROM q UNION ALL SELECT path, o1 + 10, 'db2-exec-sql', verb FROM q UNION ALL SELECT path, o1 + 13, 'cics', 'LINK' FROM q WHERE s % 2 = 0""",
    "cobol_imports": f"WITH {_P} SELECT path, (16 + k)::BIGINT AS line_no, 'BOOK' || (s % 5) AS module FROM p",
    "cobol_programs": f"WITH {_P} SELECT path, pgm AS program, CASE WHEN s % 3 = 0 THEN 'LK-REC' END AS using FROM p",
    "cobol_crud": f"""WITH {_P}, {_JOBS}, dd AS (SELECT s % 3 AS g, 'PROD.IN.D' || max_by(s, step) AS dataset FROM j GROUP BY 1),
u AS (SELECT pgm AS program, 'file' AS kind, 'IN-FILE' AS name, 'R' AS symbol FROM p UNION ALL SELECT pgm, 'dataset', dataset, 'R' FROM p JOIN dd ON g = s % 3 UNION ALL SELECT pgm, 'file', 'OUT-FILE', 'CU' FROM p
  UNION ALL SELECT pgm, 'dataset', 'SYSOUT-A', 'CU' FROM p UNION ALL SELECT pgm, 'sql_block', pgm || ':' || verb || ':' || (o + 10), CASE WHEN s % 2 = 0 THEN 'R' ELSE 'CU' END FROM p),
t AS (SELECT pgm AS program, 'dataset' AS kind, 'LOAD.LIB' AS name, '*' AS symbol FROM p WHERE s % 7 <> 6 UNION ALL SELECT pgm, 'dataset', 'PROD.IN.D' || s, '*' FROM p WHERE s % 7 <> 6)
SELECT * FROM u UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.program = t.program AND u.kind = t.kind AND u.name = t.name)""",
    "data_dictionary": f"WITH {_DICT} SELECT * FROM dict",
    "dictionary_text": f"""WITH {_DICT}, q AS (SELECT program, record, field, '| `' || record || '` | `' || field || '` | `' || level || '` | ' || array_to_string(list_transform([pic, redefines, occurs, conditions, group_name],
  lambda v: CASE WHEN v = '' THEN '—' ELSE '`' || v || '`' END), ' | ') || ' |' AS line FROM dict)
SELECT program, '| Record | Field | Level | PIC | REDEFINES | OCCURS | Conditions (88) | Group |' || chr(10) || '| --- | --- | --- | --- | --- | --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY record, field) AS text FROM q GROUP BY 1""",
    "paragraph_texts": f"""WITH {_P}, r AS (SELECT *, '       MAIN-PARA.' || chr(10) || '           PERFORM WORK-PARA.' || chr(10) || '           PERFORM NO-PARA.' AS main, '       WORK-PARA.' || chr(10) || '           WRITE OUT-REC.' AS work FROM p)
SELECT pgm AS program, '### Paragraph `MAIN-PARA` (' || path || ':' || (o + 2) || '-' || (o + 7) || ')' || chr(10) || 'Summary: does work' || chr(10) || chr(10) || '```cobol' || chr(10) || substr(main, 1, 60) || chr(10) || '... <truncated>' || chr(10)
  || '```' || chr(10) || chr(10) || '### Paragraph `WORK-PARA` (' || path || ':' || (o + 8) || '-' || (o + 13) || ')' || chr(10) || 'Summary: (not summarized)' || chr(10) || chr(10) || '```cobol' || chr(10) || substr(work, 1, 24) || chr(10) || '... <truncated>'
  || chr(10) || '```' || chr(10) AS text FROM r""",
    "summaries": f"WITH {_P} SELECT 'program:' || pgm AS program, unnest([1, 2])::BIGINT AS pos, unnest(['MAIN-PARA', 'WORK-PARA']) AS name, unnest(['about MAIN-PARA', 'about WORK-PARA']) AS summary FROM p",
    "effects_with_narrative": f"""WITH {_P} SELECT 'program:' || pgm AS program, 'CALL PGM' || (s + 1) || '|EXEC SQL ' || verb || CASE WHEN s % 2 = 0 THEN '|EXEC CICS LINK' ELSE '' END
  || CASE WHEN s % 10 = 3 THEN '' ELSE '|(LLM narrative) told' END AS effects FROM p""",
    "copybooks": f"WITH {_P} SELECT path, (o + 13)::BIGINT AS n_lines, b AS has_book, NOT b AS has_copy FROM p",
    "jcl_nodes": f"""WITH {_JOBS} SELECT 'job:' || job AS id, 'job' AS kind, job AS name, 1::BIGINT AS start_line, 1::BIGINT AS end_line, '' AS attributes FROM j UNION ALL SELECT step, 'step', 'S1', 4, 4, 'pgm=PGM' || p FROM j
UNION ALL SELECT 'dataset_ref:PROD.IN.D' || s, 'dataset_ref', 'PROD.IN.D' || s, 5, 5, '' FROM j UNION ALL SELECT 'dataset_ref:LOAD.LIB', 'dataset_ref', 'LOAD.LIB', 7, 7, '' UNION ALL SELECT 'dataset_ref:SYSOUT-A', 'dataset_ref', 'SYSOUT-A', 8, 8, ''""",
    "jcl_kg_edges": f"""WITH {_JOBS} SELECT 'job:' || job AS source, step AS target, 'contains' AS kind, path || ':4' AS evidence, NULL AS dd_name FROM j
UNION ALL SELECT 'program:PGM' || p, step, 'step_of', path || ':4 PGM=PGM' || p, NULL FROM j WHERE p = s UNION ALL SELECT step, 'dataset_ref:PROD.IN.D' || s, 'dd_of', path || ':5 DD IN' || (s % 3), 'IN' || (s % 3) FROM j
UNION ALL SELECT step, 'dataset_ref:LOAD.LIB', 'dd_of', path || ':7 DD STEPLIB', 'STEPLIB' FROM j UNION ALL SELECT step, 'dataset_ref:SYSOUT-A', 'dd_of', path || ':8 DD OUT' || (s % 3), 'OUT' || (s % 3) FROM j""",
    "python_facts": f"""WITH {_M} SELECT path, unnest([1, 10 + k, 4 + k, 7 + k])::BIGINT AS line_no, unnest(['import', 'import', 'function', 'function']) AS kind, unnest(['os', '..pkg', 'put', 'send']) AS value FROM m
UNION ALL SELECT 'pkg/m' || c_custkey || '.py', 0, 'warning', 'unparseable' FROM customer WHERE c_custkey % 50 = 0""",
    "python_bindings": f"WITH {_M} SELECT path, (x.l + k)::BIGINT AS line_no, x.s AS service, x.o AS value, x.r AS resource FROM calls",
    "import_closure": """WITH RECURSIVE l AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey IN (a.n_nationkey + 1, a.n_nationkey + 2)),
r AS (SELECT n_nationkey AS root, n_nationkey AS node FROM nation UNION SELECT r.root, l.b FROM r JOIN l ON l.a = r.node)
SELECT 'u' || root AS unit, (row_number() OVER (PARTITION BY root ORDER BY node <> root, 'p/m' || node || '.py') - 1)::BIGINT AS pos, 'p/m' || node || '.py' AS path FROM r""",
    "kg_from_ir_nodes": f"""WITH {_M} SELECT 'program:pkg.m' || c_custkey AS id, 'program' AS kind, 'pkg.m' || c_custkey AS name FROM customer UNION ALL SELECT DISTINCT 'paragraph:' || u || ':' || x.f, 'paragraph', x.f FROM calls
UNION ALL SELECT DISTINCT 'external_call:' || u || ':' || x.s || ':' || x.o, 'external_call', x.s || '.' || x.o FROM calls UNION ALL SELECT DISTINCT 'dataset_ref:' || kind || ':' || coalesce(x.r, '_unnamed'), 'dataset_ref', coalesce(x.r, kind) FROM acc""",
    "kg_from_ir_edges": f"""WITH {_M} SELECT 'program:' || u AS source, 'paragraph:' || u || ':put' AS target, 'contains' AS kind, path || ':' || (4 + k) AS evidence FROM m UNION ALL SELECT 'program:' || u, 'paragraph:' || u || ':send', 'contains', path || ':' || (7 + k) FROM m
UNION ALL SELECT 'program:' || u, 'paragraph:' || u || ':_module_', 'contains', path || ':1' FROM m UNION ALL SELECT 'paragraph:' || u || ':' || x.f, 'external_call:' || u || ':' || x.s || ':' || x.o, 'calls', path || ':' || (x.l + k) FROM calls
UNION ALL SELECT 'paragraph:' || u || ':' || x.f, 'dataset_ref:' || kind || ':' || coalesce(x.r, '_unnamed'), CASE WHEN access = 'reads' THEN 'reads' ELSE 'writes' END, path || ':' || (x.l + k) || ' ' || x.s || '.' || x.o || ' (' || access || ')' FROM acc""",
    "typed_hints": f"""WITH {_M} SELECT u AS source_unit, split_part(kind, '_', 2) AS target_kind, 'aws' AS provider, x.r AS name, CASE access WHEN 'writes' THEN 'writes_to' WHEN 'produces' THEN 'queues_to' ELSE 'reads_from' END AS kind,
  path || ':' || (x.l + k) || ' ' || x.s || '.' || x.o || ' (' || access || ')' AS evidence, CASE WHEN x.r IS NULL THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM acc""",
    "iac_hints": """WITH h AS (SELECT 'a' || n_nationkey || '/template.yaml' AS path, 'F' || n_nationkey AS source_unit, unnest(['queue', 'table', 'api']) AS target_kind, unnest(['Q' || n_nationkey, 'T' || n_nationkey, '/p' || n_nationkey]) AS name,
  unnest(['F' || n_nationkey || '.Events.A', 'F' || n_nationkey || '.Events.B', 'F' || n_nationkey || '.Events.C']) AS e FROM nation
UNION ALL SELECT 'b' || n_nationkey || '/serverless.yml', 'g' || n_nationkey, unnest(['queue', 'bucket', 'topic']), unnest(['s' || n_nationkey, 'b', 'n' || n_nationkey]), unnest(['g' || n_nationkey || '.events.sqs', 'g' || n_nationkey || '.events.s3', 'g' || n_nationkey || '.events.sns'])
  FROM nation WHERE n_nationkey % 5 <> 0
UNION ALL SELECT 'c/x' || n_nationkey || '.template.json', unnest(['h' || n_nationkey, NULL]), unnest(['stream', 'resource']), unnest(['k' || n_nationkey, 'short:' || n_nationkey]), unnest(['M', 'N']) FROM nation)
SELECT path, source_unit, target_kind, 'aws' AS provider, name, 'reads_from' AS kind, path || ': ' || e AS evidence FROM h""",
    "iac_nodes": """WITH h AS (SELECT n_nationkey AS n, unnest(['queue', 'table', 'api', 'stream', 'resource']) AS k, unnest(['Q' || n_nationkey, 'T' || n_nationkey, '/p' || n_nationkey, 'k' || n_nationkey, 'short:' || n_nationkey]) AS name FROM nation
  UNION SELECT n_nationkey, unnest(['queue', 'topic']), unnest(['s' || n_nationkey, 'n' || n_nationkey]) FROM nation WHERE n_nationkey % 5 <> 0 UNION SELECT -1, 'bucket', 'b')
SELECT 'dataset_ref:' || k || ':' || name AS id, 'dataset_ref' AS kind, name, 'iac' AS origin FROM h WHERE NOT (name LIKE 'Q%' AND n % 2 = 0)""",
    "handler_units": f"""WITH {_T}, h AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder, count(*) OVER (PARTITION BY k, regexp_replace(path, '/[^/]*$', '')) AS n FROM t)
SELECT DISTINCT CASE WHEN k IN (0, 2) AND n > 1 THEN path WHEN k IN (0, 2, 5) THEN folder WHEN g IN (SELECT g FROM t WHERE k = 4) THEN 'jav' || g ELSE folder END AS unit FROM h WHERE k IN (0, 2, 3, 5)""",
    "handler_units_fallback": "SELECT DISTINCT 'docs' || (c_custkey % 37) AS unit FROM customer WHERE c_custkey % 4 = 0",
    "discovery": f"""WITH {_T}, x AS (SELECT split_part(path, '/', 1) AS unit, ['python', '', 'node', 'java', '', 'csharp', 'node', 'python'][k + 1] AS language, [3, 1, 1, 1, 1, 1, 1, 1][k + 1] AS loc, {[len(t) for t in _TREE]}[k + 1] AS size FROM t WHERE k NOT IN (1, 4)),
l AS (SELECT unit, language, count(*) AS n FROM x GROUP BY 1, 2), b AS (SELECT unit, min_by(language, (-n, language)) AS language FROM l GROUP BY 1)
SELECT unit, unit AS unit_id, language, count(*) AS n_files, sum(loc)::BIGINT AS loc, sum(size)::BIGINT AS byte_size FROM x JOIN b USING (unit) GROUP BY unit, b.language""".replace("SELECT unit, unit AS unit_id, language, count", "SELECT unit, unit AS unit_id, b.language AS language, count"),
    "scan_warnings": f"""WITH {_T}, x AS (SELECT DISTINCT split_part(path, '/', 1) AS unit FROM t) SELECT unit, '[skip] ' || unit || ': no recognized source files under ' || unit AS warning FROM x
WHERE unit NOT IN (SELECT split_part(path, '/', 1) FROM t WHERE k NOT IN (1, 4))""",
    "program_units": "SELECT CASE WHEN c_custkey % 4 = 0 THEN 'a/p' || c_custkey || '.cbl' ELSE 'p' || c_custkey || '.COBOL' END AS unit FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 IN (0, 2)",
    "glob_files": f"WITH {_T} SELECT path FROM t WHERE regexp_full_match(path, 'svc[^12].*/.*h.\\.py')",
    "sdk_regex": """SELECT 'c' || c_custkey AS path, unnest([1, 2, 3])::BIGINT AS line_no, unnest(['import', 'import', 'new']) AS kind, unnest(['@aws-sdk/c' || c_custkey, './x', CASE WHEN c_custkey % 2 = 0 THEN 'SQSClient' ELSE 'OddThingClient' END]) AS value,
  unnest([NULL, NULL, CASE WHEN c_custkey % 2 = 0 THEN 'sqs' ELSE 'oddthing' END]) AS service, unnest([true, false, NULL]) AS is_external FROM customer""",
    "sdk_regex_java": """SELECT 'c' || c_custkey AS path, unnest([1, 2, 3])::BIGINT AS line_no, unnest(['import', 'import', 'builder']) AS kind, unnest(['com.acme.C' || c_custkey || '.*', 'java.util.List', 'S3Client']) AS value, unnest([NULL, NULL, 's3']) AS service,
  unnest([false, true, NULL]) AS is_external FROM customer UNION ALL SELECT 'c' || c_custkey, 4, 'new', 'SfnClient', 'stepfunctions', NULL FROM customer WHERE c_custkey % 2 = 0""",
    "sdk_regex_csharp": """SELECT 'c' || c_custkey AS path, unnest([1, 2, 3])::BIGINT AS line_no, unnest(['import', 'import', 'new']) AS kind, unnest(['System.Text', 'Acme.C' || c_custkey, 'AmazonSimpleNotificationServiceClient']) AS value,
  unnest([NULL, NULL, 'sns']) AS service, unnest([true, false, NULL]) AS is_external FROM customer""",
    "sdk_regex_typescript": """SELECT 'c' || c_custkey AS path, unnest([1, 2])::BIGINT AS line_no, unnest(['import', 'new']) AS kind, unnest(['./c' || c_custkey, 'DynamoDBDocumentClient']) AS value, unnest([NULL, 'dynamodb']) AS service,
  unnest([false, NULL]) AS is_external FROM customer""",
    "spans_around": """WITH p AS (SELECT p_partkey % (SELECT count(*) FROM supplier) AS file, p_name AS name, p_partkey % 89 * 11 AS a, p_partkey % 89 * 11 + p_size * p_size AS b FROM part)
SELECT l_orderkey, l_linenumber, arg_min(name, (-a, b, name)) AS name, count(*) AS n FROM lineitem JOIN p ON file = l_suppkey AND l_orderkey % 4000 BETWEEN a AND b GROUP BY 1, 2""",
    "fenced_files": """SELECT c_custkey AS id, unnest(['a/' || c_custkey || '.py', CASE WHEN c_custkey % 5 = 0 THEN '../up' ELSE 'ok/y' END, 'bare', 'pom.xml', 'c.h']) AS path,
  unnest(['x = 1' || chr(10), 'y' || chr(10), 'z' || chr(10), '<p/>' || chr(10), '/* path=c.h */ int x;' || chr(10)]) AS body, unnest([false, c_custkey % 5 = 0, false, false, false]) AS refused FROM customer""",
    "json_first": """SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN '{"k": ' || c_custkey || ', "t": "}\\"{"}' WHEN 3 THEN '{"n": {"k": ' || c_custkey || '}}' END AS j FROM customer""",
}
