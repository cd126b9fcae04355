"""The same questions asked with each rule pack, and parsers called from SQL, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import packs
from lodestrata.operators.fixed import ACCESS, SERVICES
from lodestrata.operators.graph import union_all
from lodestrata.plans.estate import CALLS_SQL, service_calls, table
from lodestrata.plans.source_queries import ORACLES as SOURCE_ORACLES
from lodestrata.plans.source_queries import modules


def _each(question):
    return union_all([question(packs.pack(n)).withColumn("pack", F.lit(n)) for n in packs.names()])


def _targets(s, d):
    calls = service_calls(s, d).select("unit_id", "service")
    return _each(lambda p: packs.targets(p, calls).groupBy("service", "target_kind").agg(F.count("*").alias("n")))


def _accesses(s, d):
    calls = service_calls(s, d).select("unit_id", "service", "operation")
    return _each(lambda p: packs.accesses(p, calls).groupBy("unit_id", "resource_kind", "access").agg(F.count("*").alias("n")))


def _complexities(s, d):
    """Programs of two languages, a file an order, as each pack weighs them."""
    k = F.col("o_orderkey")
    cobol = k % 2 == 0
    text = F.when(cobol, F.concat(F.lit("EXEC SQL x END-EXEC\n"), F.repeat(F.lit("ALTER A\n"), (k % 4).cast("int")))).otherwise(F.concat(F.lit("import asyncio\n"), F.repeat(F.lit("boto3.client('sqs')\n"), (k % 3).cast("int"))))
    files = table(s, d, "orders").select(F.col("o_custkey").alias("unit"), F.when(cobol, "cobol").otherwise("python").alias("language"), text.alias("text"))
    return _each(lambda p: packs.complexities(p, files)).select("pack", "unit", "score", "level")


def _sql_facts(s, d):
    """Python facts by the pack's table function, a file's rows in one call."""
    packs.FUNCTIONS.install(s)
    modules(s, d).createOrReplaceTempView("lodestrata_modules")
    return s.sql("SELECT path, cast(line_no AS bigint) AS line_no, kind, value FROM python_facts(TABLE(SELECT path, text FROM lodestrata_modules) PARTITION BY path) WHERE kind <> 'call'")


QUERIES = {"pack_targets": _targets, "pack_accesses": _accesses, "pack_complexity": _complexities, "python_facts_sql": _sql_facts}

_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in SERVICES)
_OPERATIONS = ", ".join(f"('{s}', '{o}', '{k}', '{v}')" for s, k, _, rules in ACCESS for v, os in rules.items() for o in os)
_DEFAULTS = ", ".join(f"('{s}', '{k}', '{v}')" for s, k, v, _ in ACCESS if v)
ORACLES = {
    "pack_targets": f"""WITH {CALLS_SQL}, t(service, target_kind) AS (VALUES {_VALUES})
SELECT 'functions' AS pack, service, target_kind, count(*) AS n FROM calls LEFT JOIN t USING (service) GROUP BY 2, 3 UNION ALL SELECT 'mainframe', service, NULL, count(*) FROM calls GROUP BY service""",
    "pack_accesses": f"""WITH {CALLS_SQL}, o(service, operation, kind, access) AS (VALUES {_OPERATIONS}), r(service, kind, access) AS (VALUES {_DEFAULTS})
SELECT 'functions' AS pack, unit_id, coalesce(o.kind, r.kind) AS resource_kind, coalesce(o.access, r.access) AS access, count(*) AS n FROM calls LEFT JOIN o USING (service, operation) LEFT JOIN r USING (service) GROUP BY 2, 3, 4
UNION ALL SELECT 'mainframe', unit_id, NULL, NULL, count(*) FROM calls GROUP BY unit_id""",
    "pack_complexity": """WITH f AS (SELECT o_custkey AS unit, o_orderkey % 2 = 0 AS cobol, o_orderkey % 4 AS a, o_orderkey % 3 AS b FROM orders),
s AS (SELECT pack, unit, sum(CASE WHEN pack = 'mainframe' AND cobol THEN 1 + 5 * a WHEN pack = 'functions' AND NOT cobol THEN 2 + 2 * b ELSE 1 END)::BIGINT AS score FROM f, (SELECT unnest(['functions', 'mainframe']) AS pack) GROUP BY 1, 2)
SELECT *, CASE WHEN score >= 15 THEN 'HIGH' WHEN score >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s""",
    "python_facts_sql": SOURCE_ORACLES["python_facts"],
}
