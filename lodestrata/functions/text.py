"""Regular expressions over texts with the lines that their matches stand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_case(pattern: str) -> str:
    return f"(?i){pattern}"


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def group(c: Column, pattern: str, number: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, number), F.lit(""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The suffix of the file name in lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def parent(path: Column) -> Column:
    """The folder of a path; empty at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def folders(path: Column) -> Column:
    """All folders that hold a path, the root ("") first."""
    parts = F.split(parent(path), "/")
    deep = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(path.contains("/"), F.concat(F.array(F.lit("")), deep)).otherwise(F.array(F.lit("")))


def in_folder(path: Column, names: tuple[str, ...]) -> Column:
    """Whether a folder of the path has one of these names."""
    return F.arrays_overlap(F.split(parent(path), "/"), F.array(*(F.lit(n) for n in names)))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line), numbered from 1."""
    each = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return each.select("path", (F.col("n") + 1).alias("line_no"), "line")


def located(files: DataFrame, pattern: str, groups: dict[str, int]) -> DataFrame:
    """(path, number, line_no, end_line, *groups): all matches in each text (path, text), numbered from 0, with their first and last lines.

    The pieces between matches and the matches themselves are counted for line ends by a running sum in the file.
    """
    text = F.col("text")
    every = {name: F.regexp_extract_all(text, F.lit(pattern), F.lit(n)) for name, n in {"whole": 0, **groups}.items()}
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(every["whole"]))
    zipped = F.arrays_zip(pieces.alias("piece"), *(c.alias(name) for name, c in every.items()))
    each = files.select("path", F.posexplode(zipped).alias("number", "m")).select("path", "number", "m.*")
    before = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    first = 1 + F.sum(newlines(F.col("piece")) + F.col("inner")).over(before) - F.col("inner")
    at = each.withColumn("inner", newlines(F.col("whole"))).withColumn("line_no", first.cast("int"))
    return at.select("path", "number", "line_no", (F.col("line_no") + F.col("inner")).cast("int").alias("end_line"), *groups)
