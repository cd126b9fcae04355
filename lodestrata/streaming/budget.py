"""The budget tracker as a stream: running cost by run, with the call at which the budget is reached."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.operators.metrics import priced


def running_budget(calls: DataFrame, budget: float) -> DataFrame:
    """(run_id, seq, total_usd, halted) for a stream of calls (run_id, seq, model, in_tokens, out_tokens).

    State is one sum a run, in whole nano-dollars; calls of a batch are taken in order of ``seq``.
    """
    limit = int(budget * 1e9)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        rows = pd.concat(batches).sort_values("seq")
        sums = total + rows["nano"].cumsum()
        state.update((int(sums.iloc[-1]),))
        yield pd.DataFrame({"run_id": key[0], "seq": rows["seq"], "total_usd": sums / 1e9, "halted": sums >= limit})

    nano = priced(calls).select("run_id", "seq", F.round(F.col("usd") * 1e9).cast("long").alias("nano"))
    return nano.groupBy("run_id").applyInPandasWithState(step, "run_id long, seq long, total_usd double, halted boolean", "total long", "append", GroupStateTimeout.NoTimeout)


def cost_windows(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, tag, calls, usd) of tumbling windows of a stream with an event time ``ts``; later rows than the watermark are dropped."""
    w = priced(calls).withWatermark("ts", late).groupBy(F.window("ts", width), "tag").agg(F.count("*").alias("calls"), F.round(F.sum("usd"), 6).alias("usd"))
    return w.select(F.col("window.start").alias("start"), "tag", "calls", "usd")
