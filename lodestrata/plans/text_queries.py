"""Queries over text, runs, costs, comparisons and business records, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.text import lines
from lodestrata.operators import business, cobol, discovery, dualrun, extract, jcl, metrics
from lodestrata.operators.fixed import COMPLEXITY
from lodestrata.operators.graph import program_members
from lodestrata.plans.estate import LLM_SQL, MATRIX_SQL, NODES_SQL, EDGES_SQL, kg_edges, kg_nodes, llm_calls, table
from lodestrata.plans.graph_queries import _matrix
from lodestrata.sources.files import fixed_fields, pipe_fields

# Each document is also put to use as a source file of its language, and each supplier's items as job-control and COBOL text.
_docs = lambda s, d: table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
_files = lambda s, d: _docs(s, d).select(F.format_string("f%d", "doc_id").alias("path"), "text")
_suffix = lambda: F.element_at(F.array(*(F.lit(x) for x in (".py", ".js", ".java", ".cs", ".txt"))), (F.col("doc_id") % 5 + 1).cast("int"))
_nth = lambda c, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (F.pmod(c, F.lit(len(v))) + 1).cast("int"))


def _fields(s, d):
    o = table(s, d, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    e = o.select(F.col("o_orderkey").alias("fixture"), F.explode(F.map_from_arrays(F.array(F.lit("total"), F.lit("status"), F.lit("priority"), F.lit("key")), F.array(price.cast("string"), "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")))).alias("field", "value"))
    pic = F.when(F.col("field") == "total", "S9(9)V9(2)").when(F.col("field") == "key", "9(8)")
    e = e.withColumns({"kind": F.lit("picture"), "pic": pic, "scale": F.lit(None).cast("int"), "trim": F.lit(True), "signed": F.lit(False), "abs_tol": F.when(F.col("field") == "total", 0.01), "case_insensitive": F.col("field") == "priority"})
    k = F.col("o_orderkey")
    new = (price + F.when(k % 7 == 0, F.lit("0.005").cast("decimal(18,3)")).when(k % 13 == 0, F.lit("1.00").cast("decimal(18,2)")).otherwise(F.lit("0.00").cast("decimal(18,2)")))
    new = F.when(k % 7 == 0, new.cast("decimal(18,3)").cast("string")).otherwise(new.cast("decimal(18,2)").cast("string"))
    a = o.where("o_orderkey % 11 <> 0").select(k.alias("fixture"), F.explode(F.map_from_arrays(F.array(F.lit("total"), F.lit("status"), F.lit("priority"), F.when(k % 17 == 0, "extra").otherwise("key")), F.array(new, F.concat("o_orderstatus", F.lit("  ")), F.lower("o_orderpriority"), F.when(k % 19 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))))).alias("field", "value"))
    return dualrun.diff(e, a)


def _fixtures(s, d):
    runs = table(s, d, "orders").select(F.col("o_orderkey").alias("fixture"), F.format_string("P%d", F.col("o_custkey") % 50).alias("program_id"), (F.col("o_custkey") % 5 == 0).alias("skipped"), (F.col("o_custkey") % 50 == 7).alias("errored"))
    return dualrun.fixtures(_fields(s, d), runs)


def _jcl(s, d):
    """A job a supplier with a step for every line number: two datasets a step, one on a continuation."""
    i = table(s, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi"))
    form = "//STEP%d EXEC PGM=PROG%d\n//IN%d DD DISP=SHR,\n//            DSN=PROD.P%d(0)\n//* comment\n//OUT%d DD SYSOUT=A"
    step = F.format_string(form, "l_linenumber", F.col("hi") % 9, "l_linenumber", "lo", "l_linenumber")
    g = i.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", step.alias("t")))).alias("p"))
    head = F.format_string("//JOB%d JOB (1)\n", "l_suppkey")
    return g.select(F.format_string("s%d.jcl", "l_suppkey").alias("path"), F.concat(head, F.array_join(F.transform("p", lambda x: x["t"]), "\n")).alias("text"))


def _cobol(s, d):
    """A program a supplier: a paragraph for each line number, a perform of the next one, a read or a write."""
    i = table(s, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    para = F.format_string("       P%d.\n      * READ NOTHING\n           PERFORM P%d.\n           %s R%d.", "l_linenumber", F.col("l_linenumber") + 1, F.when(F.col("p") % 2 == 0, "READ").otherwise("WRITE"), "p")
    g = i.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", para.alias("t")))).alias("a"))
    head = F.lit("       PROGRAM-ID. X.\n       PROCEDURE DIVISION.\n")
    return g.select(F.format_string("s%d.cbl", "l_suppkey").alias("path"), F.concat(head, F.array_join(F.transform("a", lambda x: x["t"]), "\n")).alias("text"))


def _rubric(s, d):
    l = table(s, d, "labels")
    return l.select(F.col("doc_id").alias("unit"), F.explode(F.array(F.struct(F.lit(0.4).alias("weight"), (F.col("quality") * 1.5).alias("score"), F.lit(None).cast("string").alias("error")), F.struct(F.lit(0.6).alias("weight"), (0.8 - F.col("toxic")).alias("score"), F.when(F.col("doc_id") % 10 == 0, "boom").alias("error")))).alias("r")).select("unit", "r.*")


def _txns(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("cust"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))


def _periods(s, d):
    """(cust, period): every month in which a customer has orders, and for those without any the month 1996-01."""
    asked = table(s, d, "customer").select(F.col("c_custkey").alias("cust")).join(_txns(s, d).select("cust", "period").distinct(), "cust", "left")
    return asked.select("cust", F.coalesce("period", F.lit("1996-01")).alias("period"))


def _accounts(s, d):
    """Customers with what they ordered in their last month."""
    last = _periods(s, d).groupBy("cust").agg(F.max("period").alias("period"))
    c = table(s, d, "customer").join(last, F.col("cust") == F.col("c_custkey")).select("cust", "period", F.col("c_acctbal").cast("decimal(18,2)").alias("balance"), (F.col("c_custkey") % 1100 / 1000).cast("decimal(9,3)").alias("rate"))
    return c.join(business.transaction_totals(c.select("cust", "period"), _txns(s, d)).select("cust", "total"), "cust")


def _residual_files(s, d):
    p = table(s, d, "pages")
    name = F.when(F.col("page_id") % 7 == 0, "function_app.py").otherwise(F.format_string("m%d.py", "page_id"))
    tail = _nth(F.col("page_id"), "import boto3\nx = boto3.client('s3')", "@app.route('/x')", "def lambda_handler(e, c): pass", "plain")
    return p.select((F.col("page_id") % 20).alias("unit"), name.alias("path"), F.concat(F.coalesce("html", F.lit("")), F.lit("\n"), tail).alias("text"))


_LANGUAGES = ("python", "node", "java", "csharp", "cobol", "go")
_SNIPPETS = {
    "python": "c = boto3.client( 'sqs' )\nrequests.get(u)\nimport asyncio", "node": "new SFNClient({}); await Promise.all([a])", "java": "SfnClient x; S3Client y; CompletableFuture.allOf(z)",
    "csharp": "var c = new AmazonSQSClient(); await Task.WhenAll(t);", "cobol": "ALTER X TO PROCEED.\nPERFORM A THRU B.\nX REDEFINES Y COMP-3", "go": "func main() {}",
}


def _code(s, d):
    """Documents as sources of six languages, with a snippet of each."""
    language = _nth(F.col("doc_id"), *_LANGUAGES)
    snippet = F.coalesce(*(F.when(language == k, v) for k, v in _SNIPPETS.items()))
    return _docs(s, d).select(F.col("source").alias("unit"), language.alias("language"), F.concat("text", F.lit("\n"), F.repeat(F.concat(snippet, F.lit("\n")), (F.col("doc_id") % 3).cast("int"))).alias("text"))


def _folded(s, d):
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "view", "check").when(F.col("event_type") == "error", "finish").otherwise("other")
    delta = F.when(F.col("value") > 50, 1).otherwise(-1)
    return business.fold_events(table(s, d, "events").select(F.col("user_id").alias("key"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("seq"), kind.alias("type"), delta.alias("delta")))


def _units_run(s, d):
    """Orders as units of runs, with what is known of some of them."""
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(
        (F.col("o_custkey") % 20).alias("run_id"), (F.year("o_orderdate") % 3).alias("wave"), F.format_string("u%d", k).alias("unit_id"), F.col("o_orderstatus").alias("status"),
        F.when(k % 5 == 0, "pass").alias("reviewer_verdict"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("tests_passed"), F.when(k % 4 == 0, 0.75).alias("rubric_score"),
        (k % 7 / 10).alias("cost_usd"),
    )


def _key():
    return metrics.cache_key(F.col("doc_id").cast("string"), F.col("text"), F.col("lang"), F.col("source"), F.lit("p1"))


def _planned(s, d):
    docs = _docs(s, d)
    summary = F.when(F.col("doc_id") % 3 == 0, "s").alias("summary")
    nodes = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("raw_text"), F.col("lang").alias("name"), F.col("source").alias("kind"), summary, F.lit("p1").alias("prompt"))
    return metrics.summary_plan(nodes, docs.where("doc_id % 5 = 0").select(_key().alias("key"))).select("id", "needs_chunks")


_json = lambda: F.format_string('ok: {"verdict": "%s", "findings": [{"severity": "low", "file": "f%d", "line": 7, "message": "m"}, {"file": "g"}], "usage": {"n": {}}} end }', F.when(F.col("event_id") % 3 > 0, F.upper("event_type")).otherwise("Pass"), "event_id")
_KEY = r"^[A-Z]\w* "

QUERIES = {
    "dualrun_fields": lambda s, d: _fields(s, d).drop("expected", "actual"),
    "dualrun_fixtures": _fixtures,
    "dualrun_verdict": lambda s, d: dualrun.verdict(_fixtures(s, d)),
    "cost_rates": lambda s, d: metrics.priced(llm_calls(s, d)).select("seq", F.round("usd", 9).alias("usd")),
    "cost_by_model": lambda s, d: metrics.cost_by_model(llm_calls(s, d)),
    "cost_by_tag": lambda s, d: llm_calls(s, d).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("calls")),
    "cost_grouping_sets": lambda s, d: metrics.cost_grouping_sets(llm_calls(s, d)),
    "cost_halt": lambda s, d: metrics.cost_halt(llm_calls(s, d), 5.0),
    "run_summary": lambda s, d: metrics.run_summary(_units_run(s, d)).select("run_id", "wave", "n_units", "summary"),
    "unit_lines": lambda s, d: metrics.unit_lines(_units_run(s, d)),
    "rubric_score": lambda s, d: metrics.rubric_totals(_rubric(s, d)),
    "rubric_scorers": lambda s, d: _residual_files(s, d).select("path", *(c.alias(n) for n, c in metrics.rubric_scorers(F.col("text"), F.col("path").startswith("m1")).items())),
    "complexity": lambda s, d: _docs(s, d).select("doc_id", metrics.complexity_score(F.col("text"), ((r"\bthe\b", 2), (r"tion", 1), (r"que\s", 3))).alias("score")).withColumn("level", metrics.complexity_level(F.col("score"))),
    "unit_complexity": lambda s, d: metrics.unit_complexity(_code(s, d)),
    "complexity_plain": lambda s, d: _docs(s, d).select("doc_id", metrics.complexity_score(F.col("text"), ()).alias("score")),
    "tokens": lambda s, d: _docs(s, d).select("doc_id", metrics.estimated_tokens(F.col("text"), _nth(F.col("doc_id"), "low", "medium", "high", "x")).alias("tokens")).withColumn("output", metrics.output_tokens(F.col("tokens"), F.lit("low"))).withColumn("remaining", F.greatest(F.lit(0), 120_000 - F.col("tokens")).cast("long")),
    "needs_chunk": lambda s, d: _docs(s, d).select("doc_id", metrics.needs_chunking(F.col("text")).alias("needed")),
    "chunks_fixed": lambda s, d: metrics.fixed_chunks(_docs(s, d), 20, 5),
    "chunks_semantic": lambda s, d: metrics.semantic_chunks(_docs(s, d), _KEY, size=10, overlap=3),
    "history": lambda s, d: metrics.compressed_history(table(s, d, "conversations"), pattern=_KEY).select("conv_id", "history", F.array_join("recent", "\n").alias("recent")),
    "compress": lambda s, d: metrics.compress_history(table(s, d, "conversations"), pattern=_KEY).drop("full"),
    "inline_budget": lambda s, d: metrics.inline_within(_docs(s, d).select(F.col("source").alias("unit"), F.col("doc_id").alias("path"), F.octet_length("text").alias("size"))),
    "paragraph_budget": lambda s, d: metrics.paragraph_budget(_docs(s, d).select(F.col("source").alias("unit"), F.col("doc_id").alias("pos"), F.length("text").alias("size"))),
    "names": lambda s, d: table(s, d, "supplier").select("s_suppkey", *(c.alias(n) for n, c in metrics.names_for(F.replace("s_name", F.lit("#"), F.lit("-"))).items())),
    "cache_key": lambda s, d: _docs(s, d).select("doc_id", _key().alias("key")),
    "chunk_key": lambda s, d: _docs(s, d).select("doc_id", metrics.chunk_key(F.lit("n"), F.lit(2), F.lit(11), F.col("doc_id"), F.col("text"), F.lit("p")).alias("key")),
    "summary_cache": lambda s, d: metrics.latest_by_key(table(s, d, "events").select((F.col("user_id") % 40).alias("key"), F.col("props").alias("value"), F.col("event_id").alias("ord"))),
    "summary_plan": _planned,
    "spec_inputs": lambda s, d: metrics.spec_inputs(_matrix(s, d), table(s, d, "supplier").select(F.col("s_name").alias("program"), F.when(F.col("s_suppkey") % 2 == 0, "batch").otherwise("cics").alias("style"))),
    "spec_outputs": lambda s, d: metrics.spec_outputs(_matrix(s, d)),
    "side_effects": lambda s, d: metrics.side_effects(program_members(kg_nodes(s, d), kg_edges(s, d)), kg_edges(s, d), kg_nodes(s, d)).select("program", F.size("effects").cast("long").alias("n"), F.element_at("effects", 1).alias("first")),
    "grep_lines": lambda s, d: extract.grep(_files(s, d), r"licen[sc]e", True),
    "read_slice": lambda s, d: extract.read_slice(_files(s, d), 2, 3).select("path", F.col("line_no").cast("long").alias("line_no"), "line"),
    "language_majority": lambda s, d: discovery.language_majority(_docs(s, d).select(F.col("source").alias("unit"), F.concat(F.col("source"), _suffix()).alias("path"))),
    "unit_stats": lambda s, d: discovery.unit_stats(_docs(s, d).withColumnRenamed("source", "unit")),
    "unit_ids": lambda s, d: _docs(s, d).select("doc_id", discovery.unit_id(F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), _suffix())).alias("unit_id")),
    "residual_scan": lambda s, d: extract.residuals(_residual_files(s, d)),
    "residual_lines": lambda s, d: extract.residual_lines(_residual_files(s, d)).select("unit", "path", "kind", "line"),
    "jcl_cards": lambda s, d: jcl.cards(_jcl(s, d)).select("path", F.col("line_no").cast("long").alias("line_no"), "card"),
    "jcl_facts": lambda s, d: jcl.facts(jcl.cards(_jcl(s, d))).drop("line_no"),
    "cobol_spans": lambda s, d: cobol.cobol_spans(lines(_cobol(s, d))).select("path", "name", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line")),
    "sdk_access": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in zip(("kind", "access"), extract.access(_nth(F.col("l_orderkey"), "s3", "dynamodb", "sqs", "ssm", "other"), _nth(F.col("l_partkey"), "put_object", "get_item", "send_message", "get_parameter", "anything", "delete_message"))))),
    "service_map": lambda s, d: extract.service_map(table(s, d, "orders").select("o_orderkey", _nth(F.col("o_orderkey"), "sqs", "s3", "cognito", "none").alias("source_kind"))),
    "ecosystem_matches": lambda s, d: extract.ecosystem_matches(table(s, d, "region").select(F.col("r_regionkey").alias("sig_id"), F.when(F.col("r_regionkey") > 1, F.col("r_regionkey") % 3).alias("a"), F.when(F.col("r_regionkey") > 2, F.lit(1)).alias("b")), table(s, d, "nation").select(F.col("n_nationkey").alias("cand_id"), (F.col("n_nationkey") % 3).alias("a"), (F.col("n_nationkey") % 2).alias("b")), ("a", "b")),
    "json_objects": lambda s, d: table(s, d, "events").select("event_id", extract.first_json_object(_json()).alias("j")).select("event_id", extract.reviewer_verdict(F.col("j")).alias("verdict"), extract.security_findings(F.col("j")).alias("findings")),
    "usage_by_tag": lambda s, d: extract.usage_by_tag(table(s, d, "events").select((F.col("user_id") % 10).alias("unit"), F.col("event_type").alias("tag"), F.format_string('{"input_tokens": %d, "output_token_count": %d}', "user_id", F.col("event_id") % 2).alias("usage"))),
    "usage": lambda s, d: table(s, d, "events").select("event_id", *(c.alias(n) for n, c in zip(("i", "o", "t"), extract.usage(F.format_string('{"%s": %d, "completion_tokens": %d}', _nth(F.col("event_id"), "input_tokens", "prompt_tokens"), "user_id", F.col("user_id") * 2))))),
    "summary_parse": lambda s, d: table(s, d, "customer").select("c_custkey", *(c.alias(n.lower().replace(" ", "_")) for n, c in extract.structured_summary(F.concat(F.lit("noise\nPurpose: "), "c_name", F.lit("\nInputs: a\nb\nKey invariants:\n- x\n- "), F.col("c_custkey").cast("string"))).items())),
    "key_values": lambda s, d: table(s, d, "customer").select("c_custkey", extract.key_values(F.concat(F.lit("A=old\nA="), "c_name", F.lit("\n\nB=x=y\n"), F.when(F.col("c_custkey") % 4 == 0, "oops").otherwise(""))).alias("m")).select("c_custkey", F.col("m")["A"].alias("a"), F.col("m")["B"].alias("b")),
    "pipe_records": lambda s, d: table(s, d, "customer").select(F.concat_ws("|", F.col("c_custkey").cast("string"), F.concat(F.lit(" "), "c_name"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string"))).alias("v")).select(*pipe_fields(F.col("v"), [("id", 10), ("name", 12), ("bal", None)])).withColumn("bal", F.col("bal").cast("double")),
    "fixed_width": lambda s, d: table(s, d, "customer").select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.rpad("c_name", 20, " "), F.lpad(F.abs(F.round(F.col("c_acctbal") * 100)).cast("long").cast("string"), 9, "0")).alias("v")).select(*fixed_fields(F.col("v"), [("id", 8, None), ("name", 20, None), ("bal", 9, 2)], 108)).withColumn("bal", F.col("bal").cast("double")),
    "txn_total": lambda s, d: business.transaction_totals(_periods(s, d), _txns(s, d)).withColumn("total", F.col("total").cast("double")),
    "interest": lambda s, d: _accounts(s, d).select("cust", business.interest(F.col("balance"), F.col("rate")).cast("double").alias("interest")),
    "statement": lambda s, d: business.statements(_accounts(s, d)).withColumn("statement", F.col("statement").cast("double")),
    "gross_pay": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(business.gross_pay(F.col("l_quantity"), F.lit(22.5)), 2).alias("pay")),
    "validation": lambda s, d: business.required(table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, "x").alias("name"), F.when(F.col("o_orderkey") % 4 == 0, "  ").otherwise("y").alias("state"), "o_orderstatus"), "o_orderkey", ["name", "state", "o_orderstatus"]),
    "layered_key": lambda s, d: table(s, d, "nation").select("n_nationkey", business.layered([F.concat(F.lit("j_e_"), F.col("n_nationkey").cast("string")), F.concat(F.lit("j_"), F.col("n_nationkey").cast("string")), F.lit("d")], F.map_from_arrays(F.array(*(F.lit(k) for k in ("j_e_3", "j_4", "j_3", "d"))), F.array(*(F.lit(v) for v in ("deep", "mid", "no", "base"))))).alias("value")),
    "strip_nested": lambda s, d: business.strip_all(table(s, d, "nation").select("n_nationkey", F.struct(F.concat(F.lit("  "), "n_name", F.lit(" \n")).alias("a"), F.array(F.lit(" b ")).alias("l")).alias("v"))).select("n_nationkey", F.col("v.a").alias("a"), F.col("v.l")[0].alias("l")),
    "state_fold": _folded,
}

_TXT = "coalesce(text, '')"
_NL = "(length(t) - length(replace(t, chr(10), '')) + 1)"
_D = f"d AS (SELECT doc_id, {_TXT} AS t, lang, source FROM documents)"
_LINES = f"{_D}, l AS (SELECT doc_id, generate_subscripts(a, 1) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS a FROM d))"
_RATES = """CASE WHEN lower(model) = '' THEN {f} WHEN lower(model) = 'gpt-5.4-mini' THEN {a} WHEN lower(model) LIKE 'gpt-5.4-mini%' THEN {a} WHEN lower(model) LIKE 'gpt-5%' THEN {b} WHEN lower(model) LIKE 'gpt-4o-mini%' THEN {a} WHEN lower(model) LIKE 'gpt-4o%' THEN {b} WHEN lower(model) LIKE 'llama%' THEN 0 ELSE {f} END"""
_USD = f"(in_tokens / 1e6::DOUBLE * {_RATES.format(a=0.15, b=2.5, f=1.0)} + out_tokens / 1e6::DOUBLE * {_RATES.format(a=0.6, b=10.0, f=5.0)})::DOUBLE"
_PRICED = f"{LLM_SQL}, c AS (SELECT *, {_USD} AS usd, CASE WHEN model = '' THEN 'unknown' ELSE lower(model) END AS m FROM llm_calls)"
_FIELDS = """o AS (SELECT o_orderkey AS fixture, o_custkey, o_orderstatus, o_orderpriority FROM orders),
x AS (SELECT fixture, o_custkey, unnest(['total', 'status', 'priority', 'key']) AS field FROM o),
g AS (SELECT fixture, field, CASE WHEN fixture % 11 = 0 THEN 'missing' WHEN field = 'key' AND fixture % 17 = 0 THEN 'missing' WHEN field = 'key' AND fixture % 19 = 0 THEN 'mismatched'
    WHEN field = 'total' AND fixture % 7 = 0 THEN 'mismatched' WHEN field = 'total' AND fixture % 13 = 0 THEN 'mismatched' ELSE 'matched' END AS status,
  CASE WHEN fixture % 11 = 0 OR (field = 'key' AND fixture % 17 = 0) THEN 'missing from actual outputs' WHEN field = 'key' AND fixture % 19 = 0 THEN 'not an integer'
    WHEN field = 'total' AND fixture % 7 = 0 THEN 'scale too large' WHEN field = 'total' AND fixture % 13 = 0 THEN 'value differs' END AS reason FROM x
  UNION ALL SELECT fixture, 'extra', 'extra', NULL FROM o WHERE fixture % 11 <> 0 AND fixture % 17 = 0)"""
_FIX = f"""{_FIELDS}, r AS (SELECT o_orderkey AS fixture, 'P' || (o_custkey % 50) AS program_id, o_custkey % 5 = 0 AS skipped, o_custkey % 50 = 7 AS errored FROM orders),
fx AS (SELECT r.*, count(*) FILTER (status <> 'extra') AS n_fields, count(*) FILTER (status = 'matched') AS n_matched, count(*) FILTER (status = 'extra') AS n_extra FROM r JOIN g USING (fixture) GROUP BY ALL),
fy AS (SELECT *, NOT skipped AND NOT errored AND n_fields = n_matched AND n_extra = 0 AS matched FROM fx)"""
_VER = f"""{_FIX}, v AS (SELECT program_id, count(*) AS total, count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched AND NOT skipped AND NOT errored) AS mismatched, count(*) FILTER (skipped) AS skipped, count(*) FILTER (errored) AS errored FROM fy GROUP BY 1),
vv AS (SELECT *, errored = 0 AND mismatched = 0 AND total > 0 AS passed, errored = 0 AND mismatched = 0 AND total > 0 AND skipped = 0 AS passed_strict, matched > 0 AS affirmed FROM v)"""
_RES = """rf AS (SELECT page_id % 20 AS unit, CASE WHEN page_id % 7 = 0 THEN 'function_app.py' ELSE 'm' || page_id || '.py' END AS path, page_id % 4 AS k, html FROM pages)"""
_J = "j AS (SELECT l_suppkey AS s, l_linenumber AS n, min(l_partkey) AS lo, max(l_partkey) AS hi, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) AS k FROM lineitem GROUP BY 1, 2)"
_C = "c AS (SELECT l_suppkey AS s, l_linenumber AS n, max(l_partkey) AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) AS k, lead(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) AS nx FROM lineitem GROUP BY 1, 2)"
_ACC = """p AS (SELECT o_custkey AS cust, strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice::DECIMAL(18,2)) AS total FROM orders GROUP BY 1, 2),
t AS (SELECT cust, arg_max(total, period) AS total FROM p GROUP BY cust),
a AS (SELECT c_custkey AS cust, c_acctbal::DECIMAL(18,2) AS balance, (c_custkey % 1100)::DECIMAL(18,3) / 1000 AS rate, coalesce(total, 0) AS total FROM customer LEFT JOIN t ON cust = c_custkey),
i AS (SELECT *, CASE WHEN balance >= 0 AND rate <= 1 THEN floor((balance * 100)::BIGINT * (cust % 1100) / 1000.0) / 100 END AS interest FROM a)"""

ORACLES = {
    "dualrun_fields": f"WITH {_FIELDS} SELECT fixture, field, status, reason FROM g",
    "dualrun_fixtures": f"WITH {_FIX} SELECT * FROM fy",
    "dualrun_verdict": f"WITH {_VER} SELECT * FROM vv",
    "cost_rates": f"WITH {_PRICED} SELECT seq, round(usd, 9) AS usd FROM c",
    "cost_by_model": f"WITH {_PRICED} SELECT m AS model, count(*) AS calls, sum(in_tokens)::BIGINT AS in_tokens, sum(out_tokens)::BIGINT AS out_tokens, round(sum(usd), 6) AS usd FROM c GROUP BY 1",
    "cost_by_tag": f"WITH {LLM_SQL} SELECT tag, count(*) AS calls FROM llm_calls WHERE tag <> '' GROUP BY 1",
    "cost_grouping_sets": f"WITH {_PRICED} SELECT m AS model, tag, grouping(m, tag)::INTEGER AS level, count(*) AS calls, round(sum(usd), 6) AS usd FROM c GROUP BY GROUPING SETS ((m), (tag), ())",
    "cost_halt": f"WITH {_PRICED}, w AS (SELECT run_id, seq, sum(round(usd * 1e9)::BIGINT) OVER (PARTITION BY run_id ORDER BY seq) AS total FROM c) SELECT run_id, min(seq) AS halt_seq, round((min(total) / 1e9)::DOUBLE, 6) AS charged_usd FROM w WHERE total >= 5000000000 GROUP BY 1",
    "run_summary": """WITH n AS (SELECT o_custkey % 20 AS run_id, year(o_orderdate) % 3 AS wave, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2, 3)
SELECT run_id, wave::INTEGER AS wave, sum(n)::BIGINT AS n_units, string_agg(status || '=' || n, ' ' ORDER BY status) AS summary FROM n GROUP BY 1, 2""",
    "unit_lines": """SELECT o_custkey % 20 AS run_id, 'u' || o_orderkey AS unit_id, 'u' || o_orderkey || '  status=' || o_orderstatus || CASE WHEN o_orderkey % 5 = 0 THEN ' verdict=pass' ELSE '' END
  || CASE o_orderkey % 3 WHEN 0 THEN ' tests=pass' WHEN 1 THEN ' tests=fail' ELSE '' END || CASE WHEN o_orderkey % 4 = 0 THEN ' score=75/100' ELSE '' END || CASE WHEN o_orderkey % 7 > 0 THEN ' cost=$0.' || (o_orderkey % 7) || '000' ELSE '' END AS line FROM orders""",
    "rubric_score": "WITH t AS (SELECT doc_id AS unit, round((0.4::DOUBLE * least(1, quality * 1.5::DOUBLE) + CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 0.6::DOUBLE * greatest(0, 0.8::DOUBLE - toxic) END)::DOUBLE, 6) AS total FROM labels) SELECT unit, total, total >= 0.75 AS passed FROM t",
    "rubric_scorers": f"""WITH {_RES}, x AS (SELECT path, html || chr(10) || ['import boto3 x = boto3.client(''s3'')', '@app.route(''/x'')', 'def lambda_handler(e, c): pass', 'plain'][k + 1] AS t, k FROM rf)
SELECT path, CASE WHEN contains(t, 'def ') THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS contract_preserved, CASE WHEN k = 0 THEN 0::DOUBLE ELSE 0.5::DOUBLE END AS sdk_replaced, CASE WHEN k = 1 THEN 1::DOUBLE ELSE 0::DOUBLE END AS handler_shape,
CASE WHEN path LIKE 'm1%' THEN 1::DOUBLE ELSE 0::DOUBLE END AS tests_parity, 0.5::DOUBLE AS auth_managed_identity, CASE WHEN regexp_matches(t, '\\bvar\\b') THEN 0.8::DOUBLE ELSE 1::DOUBLE END AS idiomatic_python FROM x""",
    "complexity": f"WITH {_D}, s AS (SELECT doc_id, (2 * len(regexp_extract_all(t, '\\bthe\\b')) + len(regexp_extract_all(t, 'tion')) + 3 * len(regexp_extract_all(t, 'que\\s')))::BIGINT AS score FROM d) SELECT *, CASE WHEN score >= 15 THEN 'HIGH' WHEN score >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s",
    "unit_complexity": f"""WITH {_D}, l AS (SELECT source AS unit, doc_id % 6 AS k, doc_id % 3 AS n, t FROM d),
h AS (SELECT unit, k, n, t, t || chr(10) || repeat([{', '.join("'" + _SNIPPETS[k].replace("'", "''") + "'" for k in _LANGUAGES)}][k + 1] || chr(10), n) AS x FROM l),
c AS (SELECT unit, CASE k {' '.join(f"WHEN {i} THEN " + (' + '.join("len(regexp_extract_all(x, '" + p.replace("'", "''") + f"')) * {w}" for p, w in COMPLEXITY[k]) if k in COMPLEXITY else "greatest(1, (length(x) - length(replace(x, chr(10), '')) + 1) // 500)") for i, k in enumerate(_LANGUAGES))} END AS s FROM h),
u AS (SELECT unit, sum(s)::BIGINT AS score FROM c GROUP BY 1) SELECT *, CASE WHEN score >= 15 THEN 'HIGH' WHEN score >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM u""",
    "complexity_plain": f"WITH {_D} SELECT doc_id, greatest(1, {_NL} // 500)::BIGINT AS score FROM d",
    "tokens": f"WITH {_D}, k AS (SELECT doc_id, floor(length(t) / 3.0::DOUBLE * [1.5, 2, 2.5, 2][doc_id % 4 + 1]::DOUBLE)::BIGINT AS tokens FROM d) SELECT *, floor(tokens * 1.5)::BIGINT AS output, greatest(0, 120000 - tokens)::BIGINT AS remaining FROM k",
    "needs_chunk": f"WITH {_D} SELECT doc_id, {_NL} > 3000 OR length(t) > 150000 AS needed FROM d",
    "chunks_fixed": f"WITH {_D}, n AS (SELECT doc_id, {_NL} AS n FROM d), k AS (SELECT doc_id, n, unnest(range(0, (n - 1) // 20 + 1)) AS index FROM n) SELECT doc_id, index, greatest(0, index * 20 - CASE WHEN index > 0 THEN 5 ELSE 0 END) + 1 AS start_line, least(n, (index + 1) * 20) AS end_line FROM k",
    "chunks_semantic": f"""WITH RECURSIVE {_LINES}, n AS (SELECT doc_id, max(line_no) AS n FROM l GROUP BY 1), b AS (SELECT doc_id, line_no - 1 AS p FROM l WHERE regexp_matches(line, '{_KEY}')),
s AS (SELECT doc_id, min(p) AS p, 0 AS index FROM b GROUP BY 1 UNION ALL SELECT s.doc_id, (SELECT min(b.p) FROM b WHERE b.doc_id = s.doc_id AND b.p >= s.p + 10), s.index + 1 FROM s WHERE s.p IS NOT NULL),
f AS (SELECT doc_id, unnest(range(0, (n - 1) // 10 + 1)) AS index FROM n WHERE doc_id NOT IN (SELECT doc_id FROM b)),
a AS (SELECT doc_id, p, index FROM s WHERE p IS NOT NULL UNION ALL SELECT doc_id, index * 10, index FROM f)
SELECT a.doc_id, a.index::BIGINT AS index, (CASE WHEN a.index > 0 THEN greatest(0, a.p - 3) ELSE a.p END + 1)::BIGINT AS start_line, coalesce(lead(a.p) OVER (PARTITION BY a.doc_id ORDER BY a.index), n)::BIGINT AS end_line, '' AS symbols
FROM a JOIN n USING (doc_id)""",
    "compress": """WITH b AS (SELECT conv_id, turn, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
a AS (SELECT *, string_split(t, chr(10)) AS l FROM b) SELECT conv_id, turn, CASE WHEN r <= 3 THEN t ELSE array_to_string(list_filter(l, lambda x: regexp_matches(x, '^[A-Z]\\w* '))[:greatest(5, len(l) * 30 // 100)], chr(10)) END AS kept FROM a""",
    "history": """WITH b AS (SELECT conv_id, turn, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
a AS (SELECT *, string_split(t, chr(10)) AS l FROM b), k AS (SELECT *, array_to_string(list_filter(l, lambda x: regexp_matches(x, '^[A-Z]\\w* '))[:greatest(5, len(l) * 30 // 100)], chr(10)) AS kept FROM a)
SELECT conv_id, coalesce(string_agg('--- chunk ' || i || ' (compressed) ---' || CASE WHEN kept = '' THEN '' ELSE chr(10) || kept END, chr(10) ORDER BY turn) FILTER (r > 3), '') AS history,
  string_agg(t, chr(10) ORDER BY turn) FILTER (r <= 3) AS recent FROM k GROUP BY conv_id""",
    "inline_budget": f"WITH {_D}, f AS (SELECT source AS unit, doc_id AS path, strlen(t)::INTEGER AS size FROM d) SELECT *, size <= 15000 AND sum(CASE WHEN size <= 15000 THEN size ELSE 0 END) OVER (PARTITION BY unit ORDER BY size, path ROWS UNBOUNDED PRECEDING) <= 40000 AS included FROM f",
    "paragraph_budget": f"WITH {_D}, w AS (SELECT source AS unit, doc_id AS pos, least(length(t), 4000) AS want FROM d) SELECT unit, pos, greatest(0, least(want, 30000 - coalesce(sum(want) OVER (PARTITION BY unit ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken FROM w",
    "names": "WITH n AS (SELECT s_suppkey, lower(replace(s_name, '#', '-')) AS a FROM supplier) SELECT s_suppkey, a AS artifact, replace(a, '-', '') AS package, array_to_string(list_transform(string_split(replace(a, '-', ' '), ' '), lambda x: upper(x[1]) || x[2:]), '') AS class_name FROM n",
    "cache_key": f"WITH {_D} SELECT doc_id, doc_id || ':' || left(sha256(concat_ws('|', t, lang, source)), 16) || ':p1' AS key FROM d",
    "chunk_key": f"WITH {_D} SELECT doc_id, 'n#chunk2:' || left(sha256('11:' || doc_id || ':' || t), 16) || ':p' AS key FROM d",
    "summary_cache": "SELECT user_id % 40 AS key, max_by(props, event_id) AS value FROM events GROUP BY 1",
    "summary_plan": f"WITH {_D} SELECT doc_id::VARCHAR AS id, floor(length(t) / 3.0::DOUBLE * 2) > 80000 AS needs_chunks FROM d WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0",
    "spec_inputs": f"WITH {MATRIX_SQL} SELECT program, m.name FROM matrix m JOIN supplier ON s_name = program WHERE kind = 'dataset' AND (read_ OR (touches_only AND s_nationkey % 7 <> 0 AND s_suppkey % 2 = 0))",
    "spec_outputs": f"WITH {MATRIX_SQL} SELECT program, name FROM matrix WHERE kind = 'dataset' AND create_",
    "side_effects": f"""WITH {NODES_SQL}, {EDGES_SQL}, e AS (SELECT c.source AS program, CASE n.kind WHEN 'external_call' THEN 'CALL ' || n.name WHEN 'txn_call' THEN 'EXEC CICS ' || n.verb ELSE 'EXEC SQL ' || n.verb END AS effect, min(f.ord) AS ord
FROM kg_edges f JOIN kg_edges c ON c.kind = 'contains' AND c.target = f.source JOIN kg_nodes n ON n.id = f.target AND n.kind IN ('external_call', 'txn_call', 'sql_block') WHERE f.kind IN ('reads', 'writes', 'calls') GROUP BY 1, 2)
SELECT program, count(*) AS n, min_by(effect, (ord, effect)) AS first FROM e GROUP BY 1""",
    "grep_lines": f"WITH {_LINES} SELECT 'f' || doc_id AS path, line_no, substr(line, 1, 200) AS match FROM l WHERE regexp_matches(line, '(?i)licen[sc]e')",
    "read_slice": f"WITH {_LINES} SELECT 'f' || doc_id AS path, line_no, line FROM l WHERE line_no BETWEEN 2 AND 4",
    "language_majority": f"WITH {_D}, g AS (SELECT source AS unit, ['python', 'node', 'java', 'csharp', NULL][doc_id % 5 + 1] AS language, count(*) AS n FROM d GROUP BY 1, 2) SELECT unit, min_by(language, (-n, language)) AS language FROM g WHERE language IS NOT NULL GROUP BY 1",
    "unit_stats": f"WITH {_D} SELECT source AS unit, sum({_NL})::BIGINT AS loc, sum(strlen(t))::BIGINT AS byte_size FROM d GROUP BY 1",
    "unit_ids": "SELECT doc_id, 'src.' || source || '.' || doc_id AS unit_id FROM documents",
    "residual_scan": f"""WITH {_RES}, g AS (SELECT unit, count(*) FILTER (k = 0 AND path <> 'function_app.py') AS n, bool_or(path = 'function_app.py') AS has, bool_or(k = 1) AS v2, bool_or(path = 'function_app.py' AND k = 2) AS old, count(*) FILTER (path = 'function_app.py') AS entries FROM rf GROUP BY 1)
SELECT unit, CASE WHEN has AND v2 AND NOT old THEN 0 ELSE n END AS n_imports, CASE WHEN has AND v2 AND NOT old THEN 0 ELSE n END AS n_calls, old OR (NOT v2 AND NOT has) AS needs_rewrite, entries AS without_target FROM g""",
    "residual_lines": f"WITH {_RES} SELECT unit, path, unnest(['import', 'call']) AS kind, unnest(['import boto3', 'x = boto3.client(''s3'')']) AS line FROM rf WHERE k = 0 AND path <> 'function_app.py'",
    "jcl_cards": f"""WITH {_J} SELECT 's' || s || '.jcl' AS path, 1 AS line_no, '//JOB' || s || ' JOB (1)' AS card FROM j GROUP BY s UNION ALL SELECT 's' || s || '.jcl', 2 + 5 * (k - 1), '//STEP' || n || ' EXEC PGM=PROG' || (hi % 9) FROM j
UNION ALL SELECT 's' || s || '.jcl', 3 + 5 * (k - 1), '//IN' || n || ' DD DISP=SHR, DSN=PROD.P' || lo || '(0)' FROM j UNION ALL SELECT 's' || s || '.jcl', 6 + 5 * (k - 1), '//OUT' || n || ' DD SYSOUT=A' FROM j""",
    "jcl_facts": f"""WITH {_J} SELECT DISTINCT 's' || s || '.jcl' AS path, 'job' AS kind, 'JOB' || s AS job, NULL AS step, NULL AS program, NULL AS dd, NULL AS dataset FROM j UNION ALL SELECT 's' || s || '.jcl', 'step', 'JOB' || s, 'STEP' || n, 'PROG' || (hi % 9), NULL, NULL FROM j
UNION ALL SELECT 's' || s || '.jcl', 'dd', 'JOB' || s, 'STEP' || n, NULL, 'IN' || n, 'PROD.P' || lo FROM j UNION ALL SELECT 's' || s || '.jcl', 'dd', 'JOB' || s, 'STEP' || n, NULL, 'OUT' || n, 'SYSOUT-A' FROM j""",
    "cobol_spans": f"WITH {_C} SELECT 's' || s || '.cbl' AS path, 'P' || n AS name, 3 + 4 * (k - 1) AS start_line, 6 + 4 * (k - 1) AS end_line FROM c",
    "sdk_access": """WITH x AS (SELECT l_orderkey, l_linenumber, ['s3', 'dynamodb', 'sqs', 'ssm', 'other'][l_orderkey % 5 + 1] AS s, ['put_object', 'get_item', 'send_message', 'get_parameter', 'anything', 'delete_message'][l_partkey % 6 + 1] AS o FROM lineitem),
y AS (SELECT l_orderkey, l_linenumber, s, CASE WHEN s = 's3' THEN CASE WHEN o = 'put_object' THEN 'writes' ELSE 'reads' END WHEN s = 'dynamodb' THEN 'reads' WHEN s = 'sqs' AND o = 'send_message' THEN 'produces' WHEN s = 'sqs' AND o = 'delete_message' THEN 'consumes' WHEN s = 'ssm' AND o = 'get_parameter' THEN 'reads' END AS access FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN access IS NOT NULL THEN CASE s WHEN 's3' THEN 's3_bucket' WHEN 'dynamodb' THEN 'dynamodb_table' WHEN 'sqs' THEN 'sqs_queue' ELSE 'ssm_parameter' END END AS kind, access FROM y""",
    "service_map": "SELECT ['sqs', 's3', 'cognito', 'none'][o_orderkey % 4 + 1] AS source_kind, o_orderkey, ['service-bus-queue', 'blob-storage', 'entra-id', NULL][o_orderkey % 4 + 1] AS target_kind FROM orders",
    "ecosystem_matches": "SELECT r_regionkey AS sig_id, n_nationkey AS cand_id FROM region, nation WHERE (r_regionkey <= 1 OR r_regionkey % 3 = n_nationkey % 3) AND (r_regionkey <= 2 OR n_nationkey % 2 = 1)",
    "json_objects": "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN lower(event_type) ELSE 'pass' END AS verdict, '[low] f' || event_id || ':7 m' || chr(10) || '[?] g:? ?' AS findings FROM events",
    "usage": "SELECT event_id, user_id AS i, user_id * 2 AS o, user_id * 3 AS t FROM events",
    "usage_by_tag": """WITH t AS (SELECT user_id % 10 AS unit, event_type AS tag, user_id AS i, event_id % 2 AS o FROM events),
m AS (SELECT unit, tag, unnest(['input_tokens', 'output_tokens', 'total_tokens']) AS metric, unnest([i, o, i + o]) AS tokens FROM t)
SELECT unit, tag || '.' || metric AS metric, sum(tokens)::BIGINT AS tokens FROM m WHERE tokens <> 0 GROUP BY 1, 2""",
    "summary_parse": "SELECT c_custkey, c_name AS purpose, 'a' || chr(10) || 'b' AS inputs, '' AS outputs, '' AS side_effects, '- x' || chr(10) || '- ' || c_custkey AS key_invariants FROM customer",
    "key_values": "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS a, CASE WHEN c_custkey % 4 > 0 THEN 'x=y' END AS b FROM customer",
    "pipe_records": "SELECT c_custkey::VARCHAR AS id, substr(c_name, 1, 12) AS name, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal::DECIMAL(18,2) END::DOUBLE AS bal FROM customer",
    "fixed_width": "SELECT lpad(c_custkey::VARCHAR, 8, '0') AS id, substr(c_name, 1, 20) AS name, (abs(round(c_acctbal * 100)) / 100)::DOUBLE AS bal FROM customer",
    "txn_total": f"WITH {_ACC} SELECT c_custkey AS cust, coalesce(period, '1996-01') AS period, coalesce(p.total, 0)::DOUBLE AS total FROM customer LEFT JOIN p ON p.cust = c_custkey",
    "interest": f"WITH {_ACC} SELECT cust, interest::DOUBLE AS interest FROM i",
    "statement": f"WITH {_ACC} SELECT cust, (balance::DOUBLE + interest + total::DOUBLE)::DECIMAL(18,2)::DOUBLE AS statement FROM i WHERE interest IS NOT NULL",
    "gross_pay": "SELECT l_orderkey, l_linenumber, round((l_quantity * 22.5 + CASE WHEN l_quantity * 22.5 > 1000 THEN 50 ELSE 0 END)::DOUBLE, 2) AS pay FROM lineitem",
    "validation": "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'name' END, CASE WHEN o_orderkey % 4 = 0 THEN 'state' END) AS errors FROM orders",
    "layered_key": "SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'deep' WHEN 4 THEN 'mid' ELSE 'base' END AS value FROM nation",
    "strip_nested": "SELECT n_nationkey, n_name AS a, 'b' AS l FROM nation",
    "state_fold": """WITH RECURSIVE e AS (SELECT user_id AS key, floor(epoch(ts))::BIGINT AS t, CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'check' WHEN 'error' THEN 'finish' ELSE 'other' END AS type,
  CASE WHEN value > 50 THEN 1 ELSE -1 END AS delta, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS n FROM events),
f AS (SELECT DISTINCT key, 0::BIGINT AS n, 'IDLE' AS status, NULL::BIGINT AS started, 0::BIGINT AS n_started, 0::BIGINT AS n_refused, 0::BIGINT AS n_reset FROM e
  UNION ALL SELECT f.key, e.n, CASE WHEN type = 'start' AND status = 'IDLE' THEN 'IN_PROGRESS' WHEN type = 'finish' OR (type = 'check' AND status <> 'IDLE' AND t - started > 1800) THEN 'IDLE' ELSE status END,
    CASE WHEN type = 'start' AND status = 'IDLE' THEN t ELSE started END, n_started + (type = 'start' AND status = 'IDLE')::BIGINT, n_refused + (type = 'start' AND status <> 'IDLE')::BIGINT,
    n_reset + (type = 'check' AND status <> 'IDLE' AND t - started > 1800)::BIGINT FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
SELECT key, max_by(status, n) AS status, (SELECT g.started FROM f g WHERE g.key = f.key ORDER BY g.n DESC LIMIT 1) AS started, (SELECT sum(delta)::BIGINT FROM e WHERE e.key = f.key) AS filings,
  max_by(n_started, n) AS n_started, max_by(n_refused, n) AS n_refused, max_by(n_reset, n) AS n_reset FROM f GROUP BY key""",
}
