"""Streams over files, run to their ends, with oracles that tell the same of the whole tables at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.tables import shared_path
from lodestrata.plans.estate import llm_calls, table
from lodestrata.plans.text_queries import _PRICED as PRICED_SQL
from lodestrata.streaming import budget, filing

_OVERTIME, _LATE = 600, 3600


def _messages(s, d):
    """(jurisdiction, service, ts, seq, kind, id): events as messages of six bots."""
    k = F.col("user_id")
    place = F.element_at(F.array(F.lit("DELAWARE"), F.lit("TEXAS"), F.lit("NEVADA")), (k % 3 + 1).cast("int"))
    kind = F.when(F.col("event_type").isin("click", "error"), "done").otherwise("file")
    return table(s, d, "events").select(
        place.alias("jurisdiction"), F.when(k % 2 == 0, "COGS").otherwise("LLC").alias("service"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("id"))


def _run(s, stream, name):
    """The rows of a stream that is run over what its source holds."""
    out = shared_path(s, name)
    q = stream.writeStream.format("parquet").option("checkpointLocation", shared_path(s, f"{name}-checkpoint")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


def _until(m):
    return m.agg(F.max("ts").alias("t")).first()["t"] or 0


def _batch(s, d):
    m = _messages(s, d)
    return filing.filing_outcomes(m, _until(m), _OVERTIME)


def _stream(s, d):
    """The messages in two files' turns that overlap in time by less than the delay, and one that takes the watermark to the last of them."""
    m = _messages(s, d)
    last, source = _until(m), shared_path(s, "messages")
    half = m.agg(F.avg("ts").cast("long").alias("t")).first()["t"] or 0
    early = F.col("ts") + F.pmod("seq", F.lit(_LATE // 2)) < half
    end = s.range(1).select(F.lit("~").alias("jurisdiction"), F.lit("~").alias("service"), F.lit(last + _LATE).cast("long").alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit("done").alias("kind"), F.lit("").alias("id"))
    out, place = shared_path(s, "outcomes"), shared_path(s, "outcomes-checkpoint")
    for name, part in (("a", m.where(early)), ("b", m.where(~early)), ("c", end)):
        part.write.parquet(f"{source}/{name}")
        # each run takes the files that are new to it
        stream = filing.filing_stream(s.readStream.schema(m.schema).option("recursiveFileLookup", "true").parquet(source), f"{_LATE} seconds", _OVERTIME)
        stream.writeStream.format("parquet").option("checkpointLocation", place).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(filing.OUTCOMES).parquet(out)


def _budgets(s, d):
    """The running costs of runs, by a stream in one batch."""
    source = shared_path(s, "calls")
    llm_calls(s, d).select("run_id", "seq", "model", "in_tokens", "out_tokens").write.parquet(source)
    stream = s.readStream.schema("run_id long, seq long, model string, in_tokens long, out_tokens long").parquet(source)
    return _run(s, budget.running_budget(stream, 2.0), "budget").select("run_id", "seq", F.round(F.col("total_usd") * 1e9).cast("long").alias("nano_usd"), "halted")


QUERIES = {"filing_outcomes": _batch, "filing_stream": _stream, "budget_stream": _budgets}

_FILING = f"""WITH RECURSIVE m AS (SELECT ['DELAWARE', 'TEXAS', 'NEVADA'][user_id % 3 + 1] AS jurisdiction, CASE WHEN user_id % 2 = 0 THEN 'COGS' ELSE 'LLC' END AS service, floor(epoch(ts))::BIGINT AS ts, event_id,
  CASE WHEN event_type IN ('click', 'error') THEN 'done' ELSE 'file' END AS kind, 'm' || event_id AS id FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction, service ORDER BY ts, event_id) AS k, (SELECT max(ts) FROM m) AS last, jurisdiction = 'DELAWARE' AND service = 'COGS' AS bypass FROM m),
s AS (SELECT DISTINCT jurisdiction, service, last, bypass, 1::BIGINT AS k, NULL::VARCHAR AS busy, 0::BIGINT AS since, []::VARCHAR[] AS waiting, 0::BIGINT AS moment, []::STRUCT(id VARCHAR, outcome VARCHAR)[] AS told FROM e
  UNION ALL SELECT jurisdiction, service, last, bypass, CASE WHEN late THEN k ELSE k + 1 END,
    CASE WHEN frees THEN waiting[1] WHEN kind = 'file' AND NOT bypass AND NOT late AND busy IS NULL THEN id ELSE busy END,
    CASE WHEN frees OR (kind = 'file' AND NOT bypass AND NOT late AND busy IS NULL) THEN now ELSE since END,
    CASE WHEN frees THEN waiting[2:] WHEN kind = 'file' AND NOT bypass AND NOT late AND busy IS NOT NULL THEN list_append(waiting, id) ELSE waiting END, now,
    CASE WHEN frees THEN list_concat([{{'id': busy, 'outcome': CASE WHEN late THEN 'reset' ELSE 'finished' END}}], CASE WHEN len(waiting) > 0 THEN [{{'id': waiting[1], 'outcome': 'started'}}] ELSE [] END)
      WHEN kind = 'file' THEN [{{'id': id, 'outcome': CASE WHEN bypass THEN 'bypassed' WHEN busy IS NULL THEN 'started' ELSE 'left' END}}] ELSE [] END
  FROM (SELECT *, CASE WHEN late THEN since + {_OVERTIME + 1} ELSE ts END AS now, late OR (kind = 'done' AND busy IS NOT NULL) AS frees FROM (
    SELECT s.*, e.ts, e.kind, e.id, e.k AS found, coalesce(s.busy IS NOT NULL AND s.since + {_OVERTIME + 1} <= coalesce(e.ts, s.last), false) AS late
    FROM s LEFT JOIN e ON e.jurisdiction = s.jurisdiction AND e.service = s.service AND e.k = s.k) WHERE late OR found IS NOT NULL))
SELECT jurisdiction, service, moment AS "at", t.id AS id, t.outcome AS outcome FROM (SELECT jurisdiction, service, moment, unnest(told) AS t FROM s)"""

ORACLES = {
    "filing_outcomes": _FILING,
    "filing_stream": _FILING,
    "budget_stream": f"WITH {PRICED_SQL} SELECT run_id, seq, (sum(round(usd * 1e9)::BIGINT) OVER (PARTITION BY run_id ORDER BY seq))::BIGINT AS nano_usd, sum(round(usd * 1e9)::BIGINT) OVER (PARTITION BY run_id ORDER BY seq) >= 2000000000 AS halted FROM c",
}
