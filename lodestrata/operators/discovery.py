"""Discovery: which folders and files of a source tree are units, in which language, and what was left out.

Files are (path, text), paths relative to the root. Units are found by what files hold, then joined to their files
by the folders above each file, an equi-join whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import file_name, folders, in_folder, newlines, parent, stem, suffix
from lodestrata.operators.fixed import (
    BUILD_MANIFESTS, COBOL_SUFFIXES, CSHARP_MARKERS, JAVA_MARKERS, LANGUAGES, PROGRAM_ID, PYTHON_HANDLER, SCRIPT_HANDLER, SKIPPED_FOLDERS,
)

SUPPORTED = ("python", "node", "typescript", "java", "csharp", "cobol")


def language(path: Column) -> Column:
    return F.coalesce(*(F.when(suffix(path) == k, v) for k, v in LANGUAGES.items()))


def language_majority(files: DataFrame) -> DataFrame:
    """(unit, language): the most frequent language of a unit's files (unit, path); ties go to the lexically first."""
    n = files.select("unit", language(F.col("path")).alias("language")).where("language is not null").groupBy("unit", "language").agg(F.count("*").alias("n"))
    return n.groupBy("unit").agg(F.min_by("language", F.struct(-F.col("n"), "language")).alias("language"))


def glob(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose whole path matches a pattern of ``*`` (any characters, folders too), ``?`` and ``[...]``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "[" and end > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]", end
        else:
            out += {"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_/" else "\\" + c)
        i += 1
    return files.where(F.col("path").rlike(f"(?s)^{out}$"))


def unit_id(path: Column) -> Column:
    """The id of a unit by its place: dots for slashes, without a file's suffix."""
    return F.replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit("/"), F.lit("."))


def unit_stats(files: DataFrame) -> DataFrame:
    """(unit, loc, byte_size)."""
    return files.groupBy("unit").agg(F.sum(newlines(F.col("text")) + 1).cast("long").alias("loc"), F.sum(F.octet_length("text")).alias("byte_size"))


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def handler_units(files: DataFrame) -> DataFrame:
    """(unit): the units of a tree of serverless functions.

    Python and script files with a handler: the folder of one, the files of several in a folder. Java: the nearest
    folder above with a build manifest, else the file's. C#: the file's folder. Without any, all top folders.
    """
    path, text, kind = F.col("path"), F.col("text"), suffix(F.col("path"))
    seen = files.where(~in_folder(path, SKIPPED_FOLDERS))
    name = file_name(path)
    is_test = name.startswith("test_") | stem(path).endswith("_test") | (name == "__init__.py")
    python = seen.where((kind == ".py") & ~is_test & text.rlike("(?m)" + PYTHON_HANDLER)).select(F.lit("python").alias("of"), "path")
    script = seen.where(kind.isin(".js", ".mjs", ".cjs", ".ts", ".tsx") & text.rlike(SCRIPT_HANDLER)).select(F.lit("script").alias("of"), "path")
    hit = python.unionByName(script).withColumn("folder", parent(path))
    alone = hit.groupBy("of", "folder").agg(F.count("*").alias("n"), F.collect_list("path").alias("paths"))
    units = alone.select(F.explode(F.when(F.col("n") == 1, F.array("folder")).otherwise(F.col("paths"))).alias("unit"))
    java = seen.where((kind == ".java") & _has_any(text, JAVA_MARKERS)).select("path", F.explode(folders(path)).alias("folder"))
    manifests = files.where(name.isin(*BUILD_MANIFESTS)).select(parent(path).alias("folder"), F.lit(True).alias("built")).distinct()
    near = java.join(manifests, "folder", "left").groupBy("path").agg(F.max(F.when(F.col("built"), F.struct(F.length("folder").alias("n"), "folder"))).alias("best"))
    units = units.unionByName(near.select(F.coalesce("best.folder", parent(path)).alias("unit")))
    sharp = seen.where((kind == ".cs") & _has_any(text, CSHARP_MARKERS))
    units = units.unionByName(sharp.select(parent(path).alias("unit"))).distinct()
    top = F.when(path.contains("/"), F.substring_index(path, "/", 1))
    none = units.agg((F.count("*") == 0).alias("none"))
    tops = files.select(top.alias("unit")).where(F.col("unit").isNotNull() & ~F.col("unit").startswith(".") & ~F.col("unit").isin(*SKIPPED_FOLDERS)).distinct()
    return units.unionByName(tops.join(F.broadcast(none)).where("none").select("unit"))  # one row says whether there are any


def program_units(files: DataFrame) -> DataFrame:
    """(unit): COBOL files with a PROGRAM-ID, but for those in hidden folders."""
    hidden = F.exists(F.split("path", "/"), lambda x: x.startswith("."))
    own = files.where(suffix(F.col("path")).isin(*COBOL_SUFFIXES) & ~hidden & F.col("text").rlike("(?im)" + PROGRAM_ID))
    return own.select(F.col("path").alias("unit"))


def files_of(units: DataFrame, files: DataFrame) -> DataFrame:
    """(unit, path, text): files of units (unit); a file belongs to each unit that is it or one of its folders."""
    places = files.withColumn("unit", F.explode(F.concat(folders(F.col("path")), F.array("path"))))
    return places.join(units.select("unit").distinct(), "unit", "left_semi").select("unit", "path", "text")


def discover(units: DataFrame, files: DataFrame, supported: tuple[str, ...] = SUPPORTED) -> tuple[DataFrame, DataFrame]:
    """(inventory, warnings) of units (unit) in files (path, text).

    inventory: (unit, unit_id, language, n_files, loc, byte_size). A unit without a file in a supported language is
    no unit: warnings (unit, warning) has it, and the rest goes on.
    """
    own = files_of(units, files).where(language(F.col("path")).isin(*supported))
    told = own.groupBy("unit").agg(F.count("*").alias("n_files"), F.sum(newlines(F.col("text")) + 1).cast("long").alias("loc"), F.sum(F.octet_length("text")).cast("long").alias("byte_size"))
    inventory = told.join(language_majority(own), "unit").select("unit", unit_id(F.col("unit")).alias("unit_id"), "language", "n_files", "loc", "byte_size")
    lost = units.select("unit").distinct().join(told.select("unit"), "unit", "left_anti")
    is_file = files.select(F.col("path").alias("unit"), F.lit(True).alias("is_file"))
    what = F.when(F.col("is_file"), F.concat(F.lit("no adapter for "), suffix(F.col("unit")), F.lit(" ("), file_name(F.col("unit")), F.lit(")")))
    warning = F.concat(F.lit("[skip] "), F.col("unit"), F.lit(": "), F.coalesce(what, F.concat(F.lit("no recognized source files under "), F.col("unit"))))
    return inventory, lost.join(is_file, "unit", "left").select("unit", warning.alias("warning"))
