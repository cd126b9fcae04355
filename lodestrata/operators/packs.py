"""Rule packs: what is known of one kind of estate, as tables that questions are joined with and functions that SQL can call.

A pack has dimension tables (small, of fixed size), patterns that become Column functions, and parsers that become table
functions. Questions are written once, for any pack: their results differ as the packs' tables do.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import fixed
from lodestrata.operators.metrics import complexity_level, complexity_score
from lodestrata.operators.python_code import PythonFacts

_NONE: Mapping = MappingProxyType({})


@dataclass(frozen=True)
class RulePack:
    """services: (source kind, target kind); languages: those that its estates are written in, with their complexity patterns (pattern, weight);
    accesses: (service, resource kind, default access, operations by access), as ``fixed.ACCESS``; parsers: table functions by their names."""

    name: str
    services: tuple[tuple[str, str], ...] = ()
    languages: Mapping[str, tuple] = field(default_factory=lambda: _NONE)
    accesses: tuple = ()
    parsers: Mapping[str, type] = field(default_factory=lambda: _NONE)

    def service_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.services), "source_kind string, target_kind string")

    def access_table(self, spark: SparkSession) -> DataFrame:
        """(service, operation, resource_kind, access), a row an operation; a null operation is the service's default."""
        rows = [(s, o, kind, verb) for s, kind, _, rules in self.accesses for verb, operations in rules.items() for o in operations]
        rows += [(s, None, kind, default) for s, kind, default, _ in self.accesses if default]
        return spark.createDataFrame(rows, "service string, operation string, resource_kind string, access string")

    def complexity(self, language: Column, text: Column) -> Column:
        """The weighed matches of a text by its language's patterns; of a language that the pack doesn't have, by its lines."""
        known = [F.when(language == k, complexity_score(text, p)) for k, p in self.languages.items()]
        return F.coalesce(*known, complexity_score(text, ()))

    def install(self, spark: SparkSession) -> list[str]:
        """Register the parsers as table functions of SQL; their names."""
        for name, parser in self.parsers.items():
            spark.udtf.register(name, F.arrow_udtf(parser, returnType=parser.returns))
        return sorted(self.parsers)


_PACKS: dict[str, RulePack] = {}


def register(pack: RulePack) -> RulePack:
    """Make a pack known by its name; another one of that name is refused."""
    if _PACKS.setdefault(pack.name, pack) is not pack:
        raise ValueError(f"there is a pack {pack.name} already")
    return pack


def pack(name: str) -> RulePack:
    return _PACKS[name]


def names() -> list[str]:
    return sorted(_PACKS)


def targets(own: RulePack, calls: DataFrame) -> DataFrame:
    """``calls`` (service, ...) with target_kind, null where the pack has none."""
    table = own.service_table(calls.sparkSession).withColumnRenamed("source_kind", "service")
    return calls.join(F.broadcast(table), "service", "left")  # a pack's table has a fixed size


def accesses(own: RulePack, calls: DataFrame) -> DataFrame:
    """``calls`` (service, operation, ...) with resource_kind and access: the operation's, else the service's default, else null."""
    table = own.access_table(calls.sparkSession)
    exact = table.where("operation is not null").select("service", "operation", F.struct("resource_kind", "access").alias("_own"))
    default = table.where("operation is null").select("service", F.struct("resource_kind", "access").alias("_rest"))
    both = calls.join(F.broadcast(exact), ["service", "operation"], "left").join(F.broadcast(default), "service", "left")
    found = F.coalesce("_own", "_rest")
    return both.select(*calls.columns, found["resource_kind"].alias("resource_kind"), found["access"].alias("access"))


def complexities(own: RulePack, files: DataFrame) -> DataFrame:
    """(unit, score, level) of files (unit, language, text) by the pack's patterns."""
    total = files.groupBy("unit").agg(F.sum(own.complexity(F.col("language"), F.col("text"))).alias("score"))
    return total.withColumn("level", complexity_level(F.col("score")))


FUNCTIONS = register(RulePack(
    "functions", fixed.SERVICES, {k: v for k, v in fixed.COMPLEXITY.items() if k != "cobol"}, fixed.ACCESS, {"python_facts": PythonFacts},
))
MAINFRAME = register(RulePack("mainframe", (), {"cobol": fixed.COMPLEXITY["cobol"]}))
