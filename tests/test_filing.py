"""The filing queue as a stream and as a batch against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.streaming import filing

MESSAGES = "jurisdiction string, service string, ts long, seq long, kind string, id string"


def plain(messages, until, overtime):
    """Outcomes by a plain loop over all seconds at which something happens."""
    out, bots = [], {}
    for j, s, ts, seq, kind, id in sorted(messages, key=lambda m: (m[2], m[3])):
        bots.setdefault((j, s), []).append((ts, seq, kind, id))
    for key, own in bots.items():
        busy, since, waiting = None, 0, []
        events = [(t, 1, n, k, i) for n, (t, _, k, i) in enumerate(own) if t <= until]
        while True:
            limit = (since + overtime + 1, 0, -1, "late", None) if busy is not None else None
            nxt = min([e for e in (events[0] if events else None, limit) if e], default=None)
            if nxt is None or nxt[0] > until:
                break
            t, _, _, kind, id = nxt
            if kind != "late":
                events.pop(0)
            if kind in ("late", "done"):
                if busy is None:
                    continue
                out.append((*key, t, busy, "reset" if kind == "late" else "finished"))
                busy, since = (waiting.pop(0), t) if waiting else (None, 0)
                if busy is not None:
                    out.append((*key, t, busy, "started"))
            elif key == filing.BYPASS:
                out.append((*key, t, id, "bypassed"))
            elif busy is None:
                busy, since = id, t
                out.append((*key, t, id, "started"))
            else:
                waiting.append(id)
                out.append((*key, t, id, "left"))
    return sorted(out)


def some(seed):
    rng = random.Random(seed)
    keys = [("TEXAS", "LLC"), ("DELAWARE", "COGS"), ("DELAWARE", "LLC")]
    return [(*rng.choice(keys), 1000 + rng.randrange(4000), i, rng.choice(("file", "file", "done")), f"m{i}") for i in range(120)]


@pytest.mark.parametrize("overtime", [50, 1800])
def test_outcomes_of_a_batch(spark, overtime):
    messages = some(overtime)
    for until in (3000, 99_999):
        got = filing.filing_outcomes(spark.createDataFrame(messages, MESSAGES), until, overtime)
        assert sorted(tuple(r) for r in got.collect()) == plain(messages, until, overtime)
    left = [r for r in plain(messages, 99_999, overtime) if r[4] == "left"]
    assert left and {r[4] for r in plain(messages, 99_999, overtime)} >= {"started", "finished", "bypassed"}
    assert filing.filing_outcomes(spark.createDataFrame([], MESSAGES), 1).count() == 0


@pytest.mark.parametrize("cuts", [1, 3])
def test_outcomes_of_a_stream_don_t_depend_on_its_batches(spark, tmp_path, cuts):
    """Messages out of order by less than the watermark's delay, over one or three batches; the last one moves the watermark on."""
    rng = random.Random(cuts)
    messages = some(7)
    order = sorted(messages, key=lambda m: m[2] + rng.randrange(300))
    last = [("~", "~", 8000, 999, "done", "end")]
    size = -(-len(order) // cuts)
    parts = [order[i : i + size] for i in range(0, len(order), size)] + [last]
    for part in parts:
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(MESSAGES).parquet(str(tmp_path / "in"))
        q = filing.filing_stream(stream, "400 seconds", 300).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == plain(messages, 7600, 300)
    assert got.where(F.col("outcome") == "reset").count() > 0
