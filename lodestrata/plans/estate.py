"""Estate views over the driver's tables: programs, resources and flows from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.graph import union_all


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def kg_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, kind, name, dd_name, verb, start_line): suppliers are programs, their line numbers paragraphs, parts resources, nations steps, regions datasets."""
    none = [F.lit(None).cast("string").alias("dd_name"), F.lit(None).cast("string").alias("verb"), F.lit(None).cast("int").alias("start_line")]
    word = F.split_part(F.col("p_type"), F.lit(" "), F.lit(1))
    kind = (
        F.when(word.isin("STANDARD", "PROMO"), "dataset_ref").when(word == "ECONOMY", "txn_call").when(word == "LARGE", "sql_block")
        .when(word == "MEDIUM", "file").otherwise("external_call")
    )
    even = F.col("p_partkey") % 2 == 0
    verb = F.when(word == "ECONOMY", F.when(even, "LINK").otherwise("XCTL")).when(word == "LARGE", F.when(even, "SELECT").otherwise("UPDATE"))
    paragraphs = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber").distinct()
    node = lambda df, id, kind, name, *rest: df.select(id.alias("id"), kind.alias("kind"), name.alias("name"), *(rest or none))
    return union_all([
        node(table(spark, sf, "supplier"), F.format_string("prog:%d", "s_suppkey"), F.lit("program"), F.col("s_name")),
        node(paragraphs, F.format_string("para:%d:%d", "l_suppkey", "l_linenumber"), F.lit("paragraph"), F.format_string("PARA-%d", "l_linenumber")),
        node(
            table(spark, sf, "part"), F.format_string("res:%d", "p_partkey"), kind, F.format_string("R%d", "p_partkey"),
            F.when(kind == "file", F.format_string("DD%d", F.col("p_partkey") % 3)).alias("dd_name"), verb.alias("verb"), F.col("p_size").cast("int").alias("start_line"),
        ),
        node(table(spark, sf, "nation"), F.format_string("step:%d", "n_nationkey"), F.lit("step"), F.col("n_name")),
        node(table(spark, sf, "region"), F.format_string("dsn:%d", "r_regionkey"), F.lit("dataset_ref"), F.col("r_name")),
    ])


def kg_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(source, target, kind, evidence, ord, dd_name)."""
    text = none = F.lit(None).cast("string")
    items, supplier, nation = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    para = F.format_string("para:%d:%d", "l_suppkey", "l_linenumber")
    edge = lambda df, source, target, kind, evidence, ord, dd=none: df.select(
        source.alias("source"), target.alias("target"), kind.alias("kind"), evidence.alias("evidence"), ord.cast("long").alias("ord"), dd.alias("dd_name")
    )
    place, ord = F.format_string("%d:%d", "l_orderkey", "l_linenumber"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    flow = items.where("l_returnflag in ('R', 'A')")
    reads = F.when(F.col("l_returnflag") == "R", "reads").otherwise("writes")
    called = F.format_string("prog:%d", F.col("l_partkey") % 10)
    step, dd = F.format_string("step:%d", "n_nationkey"), F.format_string("dd%d", "n_nationkey")
    card = F.format_string("jcl:%d DD %s", F.col("n_nationkey"), F.when(F.col("n_nationkey") % 7 == 0, "STEPLIB").otherwise(dd))
    return union_all([
        edge(flow, para, F.format_string("res:%d", "l_partkey"), reads, place, ord),
        edge(items.where("l_returnflag = 'N'"), para, called, F.lit("calls"), place, ord),
        edge(items.select("l_suppkey", "l_linenumber").distinct(), F.format_string("prog:%d", "l_suppkey"), para, F.lit("contains"), text, F.col("l_linenumber")),
        edge(supplier, F.format_string("prog:%d", "s_suppkey"), F.format_string("step:%d", "s_nationkey"), F.lit("step_of"), text, F.col("s_suppkey")),
        edge(nation, step, F.format_string("dsn:%d", "n_regionkey"), F.lit("dd_of"), card, F.col("n_nationkey"), dd),
    ])


def unit_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(source, target): supplier to supplier, by each line item's supplier and part; dense, with one large cycle."""
    n = table(spark, sf, "supplier").agg(F.count("*").alias("n"))
    e = table(spark, sf, "lineitem").join(F.broadcast(n)).select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % F.col("n")).alias("target")).where("source <> target").distinct()
    return e.select(F.format_string("u%06d", "source").alias("source"), F.format_string("u%06d", "target").alias("target"))


def _unit(x):
    """``u%06d`` of a number that isn't negative, without a formatter a row."""
    plain = x.cast("string")
    return F.concat(F.lit("u"), F.when(x < 1_000_000, F.lpad(plain, 6, "0")).otherwise(plain))


def cluster_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(source, target, ord): all line items as edges within twelve suppliers each, which form cycles of one, two, three and six that need each other in this order.

    Of the last twelve, some are no suppliers.
    """
    s, t = F.col("l_suppkey") % 12, F.col("l_partkey") % 12
    level = lambda x: F.when(x < 1, 0).when(x < 3, 1).when(x < 6, 2).otherwise(3)
    turned, base = level(s) < level(t), F.col("l_suppkey") - s
    unit = lambda x: F.format_string("u%06d", base + x)
    return table(spark, sf, "lineitem").select(unit(F.when(turned, t).otherwise(s)).alias("source"), unit(F.when(turned, s).otherwise(t)).alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


def layered_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(source, target, ord): each line item as two edges, within its twelve suppliers as ``cluster_edges`` has it and from its supplier to its part's unit, whichever that is.

    Edges between groups (one, two, three and six of twelve) go to the earlier group, so that groups are layered behind each other; none is left out.
    """
    n = table(spark, sf, "supplier").agg(F.count("*").alias("n"))
    s, p, within = F.col("l_suppkey"), F.col("l_partkey"), lambda x: x % 12
    group = lambda x: F.floor(x / 12) * 4 + F.when(within(x) < 1, 0).when(within(x) < 3, 1).when(within(x) < 6, 2).otherwise(3)
    ends = F.explode(F.array(s - within(s) + within(p), p % F.col("n"))).alias("t")
    e = table(spark, sf, "lineitem").join(F.broadcast(n)).select(s.alias("s"), ends, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    turned = group(F.col("s")) < group(F.col("t"))
    unit = lambda a, b: _unit(F.when(turned, F.col(a)).otherwise(F.col(b)))
    return e.select(unit("t", "s").alias("source"), unit("s", "t").alias("target"), "ord")


def units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.format_string("u%06d", "s_suppkey").alias("unit_id"))


def service_calls(spark: SparkSession, sf: str) -> DataFrame:
    """(unit_id, service, operation, provider, rkind, rname, identifier): line items as calls on their part."""
    i = F.col("l_orderkey") + F.col("l_linenumber")
    service = F.element_at(F.array(*(F.lit(x) for x in ("sqs", "sns", "dynamodb", "s3", "eventbridge"))), (i % 5 + 1).cast("int"))
    op = F.element_at(F.array(*(F.lit(x) for x in ("send_message", "publish", "put_item", "get_object", "scan", "Describe", "delete_object"))), (i % 7 + 1).cast("int"))
    known = F.col("l_quantity") >= 5
    return table(spark, sf, "lineitem").select(
        F.format_string("u%06d", "l_suppkey").alias("unit_id"), service.alias("service"), op.alias("operation"), F.lit("aws").alias("provider"), F.when(known, service).alias("rkind"),
        F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.format_string("n%d", "l_partkey")).alias("rname"), F.when(F.col("l_partkey") % 2 == 0, F.format_string("i%d", "l_partkey")).alias("identifier"),
    )


def llm_calls(spark: SparkSession, sf: str) -> DataFrame:
    """(run_id, seq, model, tag, in_tokens, out_tokens): events as calls."""
    models = F.array(*(F.lit(x) for x in ("gpt-5.4-mini", "GPT-5.4", "gpt-4o-2024", "llama3.1:8b", "unknown-x", "")))
    return table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("run_id"), F.col("event_id").alias("seq"), F.element_at(models, (F.col("user_id") % 6 + 1).cast("int")).alias("model"), F.col("event_type").alias("tag"),
        F.floor(F.abs("value") * 1000).cast("long").alias("in_tokens"), F.floor(F.abs("value") * 100).cast("long").alias("out_tokens"),
    )


#: The same views in DuckDB SQL, put before the oracles that use them.
NODES_SQL = """
kg_nodes AS (
  SELECT 'prog:' || s_suppkey AS id, 'program' AS kind, s_name AS name, NULL::VARCHAR AS dd_name, NULL::VARCHAR AS verb, NULL::INTEGER AS start_line FROM supplier
  UNION ALL SELECT DISTINCT 'para:' || l_suppkey || ':' || l_linenumber, 'paragraph', 'PARA-' || l_linenumber, NULL, NULL, NULL FROM lineitem
  UNION ALL SELECT 'res:' || p_partkey, k, 'R' || p_partkey, CASE WHEN k = 'file' THEN 'DD' || (p_partkey % 3) END,
    CASE k WHEN 'txn_call' THEN ['LINK', 'XCTL'][p_partkey % 2 + 1] WHEN 'sql_block' THEN ['SELECT', 'UPDATE'][p_partkey % 2 + 1] END, p_size FROM (
    SELECT p_partkey, p_size, CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 'dataset_ref' WHEN 'PROMO' THEN 'dataset_ref' WHEN 'ECONOMY' THEN 'txn_call'
      WHEN 'LARGE' THEN 'sql_block' WHEN 'MEDIUM' THEN 'file' ELSE 'external_call' END AS k FROM part)
  UNION ALL SELECT 'step:' || n_nationkey, 'step', n_name, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'dsn:' || r_regionkey, 'dataset_ref', r_name, NULL, NULL, NULL FROM region)"""
EDGES_SQL = """
kg_edges AS (
  SELECT 'para:' || l_suppkey || ':' || l_linenumber AS source, 'res:' || l_partkey AS target, CASE WHEN l_returnflag = 'R' THEN 'reads' ELSE 'writes' END AS kind,
    l_orderkey || ':' || l_linenumber AS evidence, l_orderkey * 10 + l_linenumber AS ord, NULL::VARCHAR AS dd_name FROM lineitem WHERE l_returnflag IN ('R', 'A')
  UNION ALL SELECT 'para:' || l_suppkey || ':' || l_linenumber, 'prog:' || (l_partkey % 10), 'calls', l_orderkey || ':' || l_linenumber, l_orderkey * 10 + l_linenumber, NULL
    FROM lineitem WHERE l_returnflag = 'N'
  UNION ALL SELECT DISTINCT 'prog:' || l_suppkey, 'para:' || l_suppkey || ':' || l_linenumber, 'contains', NULL, l_linenumber, NULL FROM lineitem
  UNION ALL SELECT 'prog:' || s_suppkey, 'step:' || s_nationkey, 'step_of', NULL, s_suppkey, NULL FROM supplier
  UNION ALL SELECT 'step:' || n_nationkey, 'dsn:' || n_regionkey, 'dd_of',
    'jcl:' || n_nationkey || ' DD ' || CASE WHEN n_nationkey % 7 = 0 THEN 'STEPLIB' ELSE 'dd' || n_nationkey END, n_nationkey, 'dd' || n_nationkey FROM nation)"""
MATRIX_SQL = f"""{NODES_SQL}, {EDGES_SQL},
dd AS (SELECT upper(e.dd_name) AS dd, max_by(n.name, e.ord) AS dataset FROM kg_edges e JOIN kg_nodes n ON n.id = e.target AND n.kind = 'dataset_ref' WHERE e.kind = 'dd_of' GROUP BY 1),
res AS (
  SELECT id AS target, CASE kind WHEN 'file' THEN 'file' WHEN 'dataset_ref' THEN 'dataset' WHEN 'sql_block' THEN 'sql_block' WHEN 'txn_call' THEN 'txn' ELSE 'unknown' END AS kind,
    CASE kind WHEN 'txn_call' THEN 'CICS-' || verb WHEN 'sql_block' THEN verb || ':' || start_line ELSE name END AS name, kind = 'sql_block' AS own FROM kg_nodes
  UNION ALL SELECT n.id, 'dataset', coalesce(a.dataset, b.dataset), false FROM kg_nodes n LEFT JOIN dd a ON a.dd = upper(n.dd_name) LEFT JOIN dd b ON b.dd = substr(upper(n.dd_name), 3)
    WHERE n.kind = 'file' AND coalesce(a.dataset, b.dataset) IS NOT NULL),
used AS (SELECT p.name AS program, r.kind, CASE WHEN own THEN p.name || ':' || r.name ELSE r.name END AS name, bool_or(f.kind = 'writes') AS create_, bool_or(f.kind = 'reads') AS read_, count(*) AS n_evidence
  FROM kg_edges f JOIN kg_edges c ON c.kind = 'contains' AND c.target = f.source JOIN kg_nodes p ON p.id = c.source JOIN res r ON r.target = f.target
  WHERE f.kind IN ('reads', 'writes') GROUP BY 1, 2, 3),
touched AS (SELECT p.name AS program, 'dataset' AS kind, d.name, count(*) AS n_evidence FROM kg_edges s JOIN kg_nodes p ON p.id = s.source JOIN kg_edges b ON b.kind = 'dd_of' AND b.source = s.target
  JOIN kg_nodes d ON d.id = b.target WHERE s.kind = 'step_of' GROUP BY 1, 3),
m0 AS (SELECT program, kind, name, create_, read_, create_ AS update_, false AS delete_, false AS touches_only, n_evidence FROM used
  UNION ALL SELECT program, kind, name, false, false, false, false, true, n_evidence FROM touched t WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.program = t.program AND u.kind = t.kind AND u.name = t.name)),
matrix AS (SELECT *, CASE WHEN touches_only AND NOT create_ AND NOT read_ THEN '*' ELSE CASE WHEN create_ THEN 'C' ELSE '' END || CASE WHEN read_ THEN 'R' ELSE '' END || CASE WHEN update_ THEN 'U' ELSE '' END END AS symbol FROM m0)"""
SEAMS_SQL = f"""{MATRIX_SQL},
per AS (SELECT kind, name, count(DISTINCT program) AS n_programs, count(DISTINCT CASE WHEN read_ THEN program END) AS n_readers, count(DISTINCT CASE WHEN create_ OR update_ OR delete_ THEN program END) AS n_writers FROM matrix GROUP BY 1, 2),
parts AS (SELECT *, CASE kind WHEN 'dataset' THEN 1.0::DOUBLE WHEN 'txn' THEN 0.8::DOUBLE WHEN 'sql_block' THEN 0.5::DOUBLE WHEN 'file' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS o, n_programs::DOUBLE / max(n_programs) OVER () AS f,
  CASE WHEN n_readers = 0 AND n_writers = 0 THEN 0 ELSE abs(n_readers - n_writers)::DOUBLE / greatest(n_readers, n_writers) END AS a FROM per),
seams AS (SELECT kind, name, n_programs, n_readers, n_writers, round(o, 3) AS observable_score, round(f, 3) AS funnel_score, round(a, 3) AS asymmetry_score, round(0.4::DOUBLE * o + 0.4::DOUBLE * f + 0.2::DOUBLE * a, 3) AS total_score FROM parts)"""
UNIT_EDGES_SQL = """
ue AS (SELECT DISTINCT printf('u%06d', l_suppkey) AS source, printf('u%06d', l_partkey % (SELECT count(*) FROM supplier)) AS target FROM lineitem
  WHERE l_suppkey <> l_partkey % (SELECT count(*) FROM supplier)),
units AS (SELECT printf('u%06d', s_suppkey) AS unit_id FROM supplier)"""
_LEVEL = "CASE WHEN {0} < 1 THEN 0 WHEN {0} < 3 THEN 1 WHEN {0} < 6 THEN 2 ELSE 3 END"
CLUSTER_EDGES_SQL = f"""
lc AS (SELECT l_suppkey - l_suppkey % 12 AS base, l_suppkey % 12 AS s, l_partkey % 12 AS t, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
allce AS (SELECT printf('u%06d', base + CASE WHEN {_LEVEL.format('s')} < {_LEVEL.format('t')} THEN t ELSE s END) AS source, printf('u%06d', base + CASE WHEN {_LEVEL.format('s')} < {_LEVEL.format('t')} THEN s ELSE t END) AS target, ord FROM lc),
ue AS (SELECT DISTINCT source, target FROM allce WHERE source <> target),
units AS (SELECT printf('u%06d', s_suppkey) AS unit_id FROM supplier)"""
_GROUP = f"({{0}} // 12 * 4 + {_LEVEL.replace('{0}', '{0} % 12')})"
LAYERED_EDGES_SQL = f"""
le AS (SELECT l_suppkey AS s, unnest([l_suppkey - l_suppkey % 12 + l_partkey % 12, l_partkey % (SELECT count(*) FROM supplier)]) AS t, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
allce AS (SELECT printf('u%06d', CASE WHEN {_GROUP.format('s')} < {_GROUP.format('t')} THEN t ELSE s END) AS source, printf('u%06d', CASE WHEN {_GROUP.format('s')} < {_GROUP.format('t')} THEN s ELSE t END) AS target, ord FROM le),
ue AS (SELECT DISTINCT source, target FROM allce WHERE source <> target),
units AS (SELECT printf('u%06d', s_suppkey) AS unit_id FROM supplier)"""
CALLS_SQL = """
calls AS (SELECT printf('u%06d', l_suppkey) AS unit_id, ['sqs', 'sns', 'dynamodb', 's3', 'eventbridge'][(l_orderkey + l_linenumber) % 5 + 1] AS service,
  ['send_message', 'publish', 'put_item', 'get_object', 'scan', 'Describe', 'delete_object'][(l_orderkey + l_linenumber) % 7 + 1] AS operation, l_quantity >= 5 AS known,
  CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'n' || l_partkey END AS rname, CASE WHEN l_partkey % 2 = 0 THEN 'i' || l_partkey END AS identifier FROM lineitem),
call_edges AS (SELECT unit_id AS source_unit, CASE WHEN known THEN 'aws:' || service || ':' || coalesce(nullif(rname, ''), nullif(identifier, ''), '?') END AS resource,
  CASE WHEN NOT known THEN 'invokes'
    WHEN service = 'sqs' AND regexp_matches(lower(operation), 'send|publish') THEN 'queues_to' WHEN service IN ('sns', 'eventbridge') AND regexp_matches(lower(operation), 'publish|put') THEN 'publishes_to'
    WHEN regexp_matches(lower(operation), 'get|read|scan|query') THEN 'reads_from' WHEN regexp_matches(lower(operation), 'put|write|update|insert|delete') THEN 'writes_to' ELSE 'invokes' END AS kind,
  CASE WHEN known THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS confidence, NOT known AS ambiguous FROM calls)"""
LLM_SQL = """
llm_calls AS (SELECT user_id % 10 AS run_id, event_id AS seq, ['gpt-5.4-mini', 'GPT-5.4', 'gpt-4o-2024', 'llama3.1:8b', 'unknown-x', ''][user_id % 6 + 1] AS model, event_type AS tag,
  floor(abs(value) * 1000)::BIGINT AS in_tokens, floor(abs(value) * 100)::BIGINT AS out_tokens FROM events)"""
