"""Computations of the sample business programs: totals, interest, statements, pay, validation, event folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.ranking import numbered


def transaction_totals(customers: DataFrame, txns: DataFrame) -> DataFrame:
    """(cust, period, total) for every customer and each period asked for in ``customers`` (cust, period); 0 without transactions."""
    t = txns.groupBy("cust", "period").agg(F.sum("amount").alias("t"))
    return customers.join(t, ["cust", "period"], "left").select("cust", "period", F.coalesce("t", F.lit(0).cast("decimal(18,2)")).cast("decimal(18,2)").alias("total"))


def interest(balance: Column, rate: Column) -> Column:
    """balance * rate cut to two places toward zero; null where the balance is below 0 or the rate out of [0, 1]."""
    exact = balance.cast("decimal(18,2)") * rate.cast("decimal(9,3)")
    return F.when((balance < 0) | (rate < 0) | (rate > 1), None).otherwise((F.floor(exact * 100) / 100).cast("decimal(18,2)"))


def statements(accounts: DataFrame) -> DataFrame:
    """(cust, statement) of accounts (cust, balance, rate, total); rows whose interest is rejected are skipped."""
    i = interest(F.col("balance"), F.col("rate"))
    return accounts.withColumn("i", i).where("i is not null").select("cust", (F.col("balance").cast("decimal(18,2)") + F.col("i") + F.col("total")).cast("decimal(18,2)").alias("statement"))


def gross_pay(hours: Column, rate: Column, limit: float = 1000.0, bonus: float = 50.0) -> Column:
    pay = hours * rate
    return pay + F.when(pay > limit, bonus).otherwise(0.0)


def required(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, errors): names of empty required fields, in order."""
    return df.select(key, F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", f) for f in fields))), ",").alias("errors"))


def filing_records(orders: DataFrame, sources: tuple[str, ...] = ("entity", "service", "order", "filingMetadata")) -> DataFrame:
    """(key, payload, _meta): records (key, jurisdiction, service_type, source_system, payload map of JSON texts) in the shape that filing takes.

    White space at both ends of every text goes; a part that is missing is an empty object.
    """
    part = lambda k: F.coalesce(F.regexp_replace(F.try_element_at("payload", F.lit(k)), r"^\s+|\s+$", ""), F.lit("{}"))
    shaped = F.map_from_arrays(F.array(*(F.lit(k) for k in sources)), F.array(*(part(k) for k in sources)))
    meta = F.struct(F.col("service_type").alias("serviceType"), F.col("jurisdiction"), F.coalesce("source_system", F.lit("UPSTREAM")).alias("sourceSystem"))
    return orders.select("key", shaped.alias("payload"), meta.alias("_meta"))


def queue(records: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queued, refused): records whose errors (key, errors) are empty, with their place in the queue of their jurisdiction and service; the others with their errors."""
    both = records.join(errors, "key", "left").withColumn("errors", F.coalesce("errors", F.lit("")))
    queued = both.where("errors = ''").drop("errors").withColumns({"_j": F.col("_meta.jurisdiction"), "_s": F.col("_meta.serviceType")})
    return numbered(queued, "place", ["key"], ("_j", "_s")).drop("_j", "_s"), both.where("errors <> ''").select("key", "errors")


def layered(keys: list[Column], table: Column) -> Column:
    """The value of the first of ``keys`` that a map column has."""
    return F.coalesce(*(F.try_element_at(table, k) for k in keys))


def strip_all(df: DataFrame) -> DataFrame:
    """White space stripped from both ends of every string, however nested."""

    def strip(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StringType):
            return F.regexp_replace(c, r"^\s+|\s+$", "")
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: strip(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda _, v: strip(v, t.valueType))
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(strip(c[f.name], f.dataType).alias(f.name) for f in t)))
        return c

    return df.select(*(strip(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


IDLE, BUSY = "IDLE", "IN_PROGRESS"
OVERTIME_SECONDS = 30 * 60


def fold_events(events: DataFrame, overtime: int = OVERTIME_SECONDS) -> DataFrame:
    """(key, status, started, filings, n_started, n_refused, n_reset) of events (key, ts seconds, seq, type, delta), in order of time.

    ``start`` makes an idle key busy and notes when, and is refused by a busy one; ``finish`` makes it idle; ``check``
    makes a key idle that has been busy for more than ``overtime`` seconds. The counter sums all deltas. The fold of a
    key's events is in one task, as its state follows from their order.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ts", "seq", "type")))
    g = events.groupBy("key").agg(ordered.alias("e"), F.sum("delta").alias("filings"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(IDLE).alias("status"), F.lit(None).cast("long").alias("started"), zero.alias("n_started"), zero.alias("n_refused"), zero.alias("n_reset"))

    def step(s: Column, e: Column) -> Column:
        idle = s["status"] == IDLE
        starts, refused = (e["type"] == "start") & idle, (e["type"] == "start") & ~idle
        late = (e["type"] == "check") & ~idle & (e["ts"] - s["started"] > overtime)
        status = F.when(starts, BUSY).when(late | (e["type"] == "finish"), IDLE).otherwise(s["status"])
        more = lambda name, c: (s[name] + F.when(c, 1).otherwise(0)).alias(name)
        return F.struct(status.alias("status"), F.when(starts, e["ts"]).otherwise(s["started"]).alias("started"), more("n_started", starts), more("n_refused", refused), more("n_reset", late))

    return g.select("key", F.aggregate("e", start, step).alias("s"), "filings").select("key", "s.status", "s.started", "filings", "s.n_started", "s.n_refused", "s.n_reset")
