"""Points in spans: which spans of a group hold a line, nested and overlapping ones too, by equi-joins alone.

A span of lines is cut into blocks of sixteen to a power of lines each, a few a span; a point is in one block of each
power. A span holds a point just where they share a block, and then they share one. So the join meets only what
it gives: its rows are the spans around each point, not the points times the spans of their file, and the blocks deal out even
a file of all points. Only powers that the longest span reaches are asked.

What is around many points is told by ``around``: between two lines at which spans begin or end nothing changes, so just these
lines, and the first of each stretch of lines that has points, are joined with the spans, and a point is dealt once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.tables import cut

#: Powers of sixteen that cover lines of 31 bits.
_POWERS = 8
_BLOCK = "struct<power: int, block: bigint>"
#: Lines of a stretch, which has a step a line at most.
_STRETCH = 256


def _blocks(start: Column, end: Column, powers: int = _POWERS) -> Column:
    """array<struct<power, block>> of blocks that cover the lines from ``start`` to ``end`` once each; none where end is before start.

    ``powers`` is as many as the longest span has digits to the base of sixteen.
    """

    def run(a: Column, b: Column, power: Column) -> Column:
        some = F.transform(F.sequence(a, b), lambda x: F.struct(power.cast("int").alias("power"), x.alias("block")))
        return F.when(a <= b, some).otherwise(F.array().cast(f"array<{_BLOCK}>"))

    def step(s: Column, power: Column) -> Column:
        up, down = F.floor((s["lo"] + 15) / 16), F.floor((s["hi"] + 1) / 16) - 1
        last = up > down
        own = F.when(last, run(s["lo"], s["hi"], power)).otherwise(F.concat(run(s["lo"], up * 16 - 1, power), run((down + 1) * 16, s["hi"], power)))
        empty = F.lit(0).cast("long")
        # nothing is left: an end before its start
        lo, hi = F.when(last, empty + 1).otherwise(up), F.when(last, empty).otherwise(down)
        return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.concat(s["out"], F.when(s["lo"] <= s["hi"], own).otherwise(F.array().cast(f"array<{_BLOCK}>"))).alias("out"))

    begun = F.struct(start.cast("long").alias("lo"), end.cast("long").alias("hi"), F.array().cast(f"array<{_BLOCK}>").alias("out"))
    return F.aggregate(F.array(*(F.lit(p) for p in range(powers))), begun, step, lambda s: s["out"])


def holding(points: DataFrame, spans: DataFrame, groups: list[str], line: str = "line", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """All pairs of points (groups, line, ...) and spans (groups, start, end, ...) that hold them, with the columns of both; lines from 0."""
    longest = spans.agg(F.max(F.col(end).cast("long") - F.col(start) + 1)).head()[0] or 0
    used = max(1, next((k for k in range(_POWERS) if 16**k > longest), _POWERS))
    powers = F.array(*(F.struct(F.lit(p).alias("power"), F.floor(F.col(line) / 16**p).cast("long").alias("block")) for p in range(used)))
    at = points.withColumn("_b", F.explode(powers)).select(*points.columns, "_b.power", "_b.block")
    cut_up = spans.withColumn("_b", F.explode(_blocks(F.col(start), F.col(end), used))).select(*spans.columns, "_b.power", "_b.block")
    return at.join(cut_up, [*groups, "power", "block"]).drop("power", "block")


def _inner(name: str) -> Column:
    """The least of these is the span that begins last; of those the one that ends first, then the least name."""
    return F.struct((-F.col("start_line")).alias("late"), F.col("end_line").alias("short"), F.col(name).alias("name"))


def innermost(points: DataFrame, spans: DataFrame, groups: list[str], key: list[str], name: str = "name") -> DataFrame:
    """(key, name): for each point that a span holds, the span that begins last; of those the one that ends first, then the least name."""
    pairs = holding(points.select(*groups, *key, "line"), spans.select(*groups, "start_line", "end_line", name), groups)
    return pairs.groupBy(*key).agg(F.min(_inner(name)).alias("i")).select(*key, F.col("i.name").alias(name))


def around(points: DataFrame, spans: DataFrame, groups: list[str], key: list[str], name: str = "name") -> DataFrame:
    """(key, name, n): ``innermost``, and how many spans hold the points of this key, without a row for each pair of the two.

    The steps of a stretch are the lines in it at which spans begin or have ended, and its first line, each with what is around it;
    a point takes the last step up to it, by an equi-join on stretches, which adaptive execution can split.
    """
    stretch = lambda c: F.floor(c / _STRETCH).cast("long")
    spans = spans.where("start_line <= end_line").select(*groups, "start_line", "end_line", name)
    begun = points.select(*groups, stretch(F.col("line")).alias("_stretch")).distinct().select(*groups, (F.col("_stretch") * _STRETCH).alias("line"))
    ends = spans.select(*groups, F.explode(F.array(F.col("start_line").cast("long"), F.col("end_line").cast("long") + 1)).alias("line"))
    asked = cut(begun.unionByName(ends).distinct())
    held = holding(asked, spans, groups).groupBy(*groups, "line").agg(F.count("*").alias("n"), F.min(_inner(name)).alias("inner"))
    # where a line is held as well it has a second step, with a larger n, that comes behind
    none = asked.select(*groups, "line", F.lit(0).cast("long").alias("n"), F.lit(None).cast(held.schema["inner"].dataType).alias("inner"))
    steps = held.unionByName(none).groupBy(*groups, stretch(F.col("line")).alias("_stretch")).agg(F.array_sort(F.collect_list(F.struct("line", "n", "inner"))).alias("_steps"))
    at = points.select(*groups, *key, "line", stretch(F.col("line")).alias("_stretch")).join(steps, [*groups, "_stretch"])
    at = at.select(*key, F.element_at(F.filter("_steps", lambda x: x["line"] <= F.col("line")), -1).alias("_at"))
    return at.groupBy(*key).agg(F.min("_at.inner").alias("_i"), F.sum("_at.n").alias("n")).where("n > 0").select(*key, F.col("_i.name").alias(name), "n")
