"""Dual-run equivalence: typed, tolerant comparison of expected and actual records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DEC = "decimal(38,18)"
# The tokens of the boolean compare, and the pattern of a numeric picture.
NUMERIC_PIC = r"(?i)(?:^|[^\d])9\(?(\d+)\)?(?:V9\(?(\d+)\)?)?"
TRUE, FALSE = ("Y", "YES", "TRUE", "T", "1"), ("N", "NO", "FALSE", "F", "0", "")


def pic_scale(pic: Column, mode: str = "reference") -> Column:
    """Digits after the V. ``reference`` reads 9(5)V99 as scale 9 (the digits after the first 9 there); ``cobol`` counts the nines."""
    if mode == "cobol":
        after = F.regexp_extract(F.upper(pic), r"V(.*)$", 1)
        repeat = F.regexp_extract(after, r"^9\((\d+)\)", 1)
        return F.when(repeat != "", repeat.try_cast("int")).otherwise(F.length(F.regexp_extract(after, r"^(9*)", 1)))
    return F.coalesce(F.regexp_extract(pic, NUMERIC_PIC, 2).try_cast("int"), F.lit(0))


def resolved_kind(kind: Column, pic: Column) -> Column:
    """``picture`` by its PIC: none is string; digits of a numeric PIC with V decimal, without int; else string."""
    numeric = F.coalesce(F.trim(pic).rlike(NUMERIC_PIC), F.lit(False))
    by_pic = F.when(numeric & F.upper(pic).contains("V"), "decimal").when(numeric, "int").otherwise("string")
    return F.when(F.coalesce(kind, F.lit("picture")) == "picture", by_pic).otherwise(kind)


def signed_text(value: Column, signed: Column) -> Column:
    v = F.trim(value)
    moved = F.when(v.endswith("-"), F.concat(F.lit("-"), F.regexp_replace(v, r"-$", ""))).when(v.endswith("+"), F.regexp_replace(v, r"\+$", "")).otherwise(v)
    return F.when(signed, moved).otherwise(v)


def literal_scale(value: Column) -> Column:
    """Digits after the point as a decimal literal has them: those of the mantissa less the exponent, 0 at least."""
    v = F.coalesce(value, F.lit(""))
    exponent = F.coalesce(F.regexp_extract(v, r"[eE]([+-]?\d+)\s*$", 1).try_cast("int"), F.lit(0))
    return F.greatest(F.lit(0), F.length(F.regexp_extract(v, r"\.(\d*)", 1)) - exponent)


def compare(expected: Column, actual: Column, kind: Column, pic: Column, scale: Column, trim: Column, signed: Column, abs_tol: Column, fold: Column, mode: str = "reference") -> tuple[Column, Column]:
    """(matched, reason) of two values under a tolerance. Bad numbers and unknown booleans are mismatches with a reason."""
    how = resolved_kind(kind, pic)
    sign = F.coalesce(signed, F.lit(False)) | F.coalesce(F.upper(pic).startswith("S"), F.lit(False))

    def text(v: Column) -> Column:
        v = F.coalesce(v, F.lit(""))
        v = F.when(F.coalesce(trim, F.lit(True)), F.rtrim(v)).otherwise(v)
        return F.when(F.coalesce(fold, F.lit(False)), F.upper(v)).otherwise(v)

    def number(v: Column, type_: str) -> Column:
        return signed_text(F.coalesce(v, F.lit("")), sign).try_cast(type_)

    def truth(v: Column) -> Column:
        u = F.upper(F.trim(F.coalesce(v, F.lit(""))))
        return F.when(u.isin(*TRUE), True).when(u.isin(*FALSE), False)

    e, a, i, j, b, c = number(expected, _DEC), number(actual, _DEC), number(expected, "bigint"), number(actual, "bigint"), truth(expected), truth(actual)
    declared = F.coalesce(scale, F.when(F.upper(pic).contains("V"), pic_scale(pic, mode)))
    literal = literal_scale(actual)
    dec = (
        F.when(e.isNull() | a.isNull(), "not a decimal").when(F.abs(e - a) > F.coalesce(abs_tol, F.lit(0)).cast(_DEC), "value differs").when(declared.isNotNull() & (literal > declared), "scale too large")
    )
    integer = F.when(i.isNull() | j.isNull(), "not an integer").when(i != j, "value differs")
    boolean = F.when(b.isNull() | c.isNull(), "not a boolean").when(b != c, "value differs")
    reason = F.when(how == "decimal", dec).when(how == "int", integer).when(how == "bool", boolean).otherwise(F.when(text(expected) != text(actual), "value differs"))
    return reason.isNull(), reason


def diff(expected: DataFrame, actual: DataFrame, mode: str = "reference") -> DataFrame:
    """(fixture, field, status, reason, expected, actual) over fields of expected (fixture, field, value and a tolerance) and actual (fixture, field, value).

    ``status``: matched, mismatched, missing or extra.
    """
    a = actual.select("fixture", "field", F.col("value").alias("actual"), F.lit(True).alias("in_actual"))
    both = expected.withColumn("in_expected", F.lit(True)).join(a, ["fixture", "field"], "full_outer")
    same, why = compare(F.col("value"), F.col("actual"), F.col("kind"), F.col("pic"), F.col("scale"), F.col("trim"), F.col("signed"), F.col("abs_tol"), F.col("case_insensitive"), mode)
    status = F.when(F.col("in_expected").isNull(), "extra").when(F.col("in_actual").isNull(), "missing").when(same, "matched").otherwise("mismatched")
    reason = F.when(F.col("in_expected").isNull(), None).when(F.col("in_actual").isNull(), "missing from actual outputs").otherwise(why)
    return both.select("fixture", "field", status.alias("status"), reason.alias("reason"), F.col("value").alias("expected"), "actual")


def fixtures(fields: DataFrame, runs: DataFrame) -> DataFrame:
    """(fixture, program_id, skipped, errored, n_fields, n_matched, n_extra, matched) for every fixture of runs (fixture, program_id, skipped, errored)."""
    count = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    per = fields.groupBy("fixture").agg(count("matched", "mismatched", "missing").alias("n_fields"), count("matched").alias("n_matched"), count("extra").alias("n_extra"))
    got = runs.join(per, "fixture", "left").na.fill(0, ["n_fields", "n_matched", "n_extra"])
    return got.withColumn("matched", ~F.col("skipped") & ~F.col("errored") & (F.col("n_fields") == F.col("n_matched")) & (F.col("n_extra") == 0))


def verdict(judged: DataFrame) -> DataFrame:
    """(program_id, counts, passed, passed_strict, affirmed). All skipped passes; the strict form fails on any skip."""
    live = ~F.col("skipped") & ~F.col("errored")
    v = judged.groupBy("program_id").agg(
        F.count("*").alias("total"), F.count_if("matched").alias("matched"), F.count_if(live & ~F.col("matched")).alias("mismatched"), F.count_if("skipped").alias("skipped"), F.count_if("errored").alias("errored"),
    )
    ok = (F.col("errored") == 0) & (F.col("mismatched") == 0) & (F.col("total") > 0)
    return v.withColumns({"passed": ok, "passed_strict": ok & (F.col("skipped") == 0), "affirmed": F.col("matched") > 0})


def of_program(fixtures_: DataFrame, program_id: str) -> DataFrame:
    """Fixtures of one program, which is all that its run takes."""
    return fixtures_.where(F.col("program_id") == program_id)


def markdown(runs: DataFrame, fields: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(program_id, report): counts, then a section a fixture in the order of ``place``, with its mismatches and extra fields.

    runs: (fixture, program_id, target_style, skip_reason, error, place); fields: (fixture, field, status, expected,
    actual, reason, place); verdicts as ``verdict`` gives them. Sections are made by fixture and joined by program.
    """
    tick = lambda c: F.concat(F.lit("`"), F.coalesce(c, F.lit("None")), F.lit("`"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", tick(F.col("field")), tick(F.col("expected")), tick(F.col("actual")), F.col("reason")), F.lit(" |"))
    wrong, extra = F.col("status").isin("mismatched", "missing"), F.col("status") == "extra"
    texts = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"])
    per = fields.groupBy("fixture").agg(
        F.count_if(~extra).alias("n"), F.count_if(F.col("status") == "matched").alias("m"),
        texts(F.when(wrong, F.struct("place", row.alias("t")))).alias("rows"), texts(F.when(extra, F.struct("field", tick(F.col("field")).alias("t")))).alias("extras"),
    )
    got = runs.join(per, "fixture", "left").na.fill(0, ["n", "m"])
    bad, more = F.coalesce(F.size("rows"), F.lit(0)), F.coalesce(F.size("extras"), F.lit(0))
    passed = (F.col("n") == F.col("m")) & (more <= 0)
    skipped, errored = F.coalesce("skip_reason", F.lit("")) != "", F.coalesce("error", F.lit("")) != ""
    status = F.when(skipped, "SKIPPED").when(errored, "ERROR").when(passed, "PASS").otherwise("FAIL")
    head = F.concat(F.lit("## "), "fixture", F.lit(" — "), status, F.lit("\n"))
    table = F.when(bad > 0, F.concat(F.lit("\n### Field mismatches\n\n| Field | Expected | Actual | Reason |\n| --- | --- | --- | --- |\n"), F.array_join("rows", "\n"), F.lit("\n")))
    others = F.when(more > 0, F.concat(F.lit("\n### Extra fields in actual (not in fixture): "), F.array_join("extras", ", "), F.lit("\n")))
    counted = F.concat(F.lit("- Target style: `"), "target_style", F.lit("`\n- Fields matched: "), F.col("m").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("\n"))
    none = F.lit("")
    body = (
        F.when(skipped, F.concat(F.lit("_skipped: "), "skip_reason", F.lit("_\n"))).when(errored, F.concat(F.lit("_runner error: "), "error", F.lit("_\n")))
        .otherwise(F.concat(counted, F.coalesce(table, none), F.coalesce(others, none)))
    )
    sections = got.select("program_id", "place", F.concat(head, body).alias("t"))
    whole = sections.groupBy("program_id").agg(F.array_join(texts(F.struct("place", "t")), "\n").alias("sections"))
    c = lambda label, name: F.concat(F.lit(f"- {label}: "), F.col(name).cast("string"), F.lit("\n"))
    title = F.concat(F.lit("# Dual-run verdict: "), "program_id", F.lit("\n\n"))
    overall = F.concat(F.lit("- **Overall: "), F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.lit("**\n\n"))
    top = F.concat(title, c("Fixtures", "total"), c("Matched", "matched"), c("Mismatched", "mismatched"), c("Skipped", "skipped"), c("Errored", "errored"), overall)
    return verdicts.join(whole, "program_id").select("program_id", F.concat(top, F.regexp_replace("sections", r"\s+\z", ""), F.lit("\n")).alias("report"))
