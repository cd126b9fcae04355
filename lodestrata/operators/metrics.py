"""Context metrics, cost, rubric and specification operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.ranking import numbered, running
from lodestrata.operators.fixed import (
    BOUNDARY, COMPLEXITY, FALLBACK, FOREIGN_MARKERS, INFRA_DD, KEY_LINES, LOCAL, PRICING, SCORED_IDENTITY, SCORED_KEYS, SCORED_SDK, SCORED_TARGET,
    SYMBOLS, TARGET_DECORATOR,
)
from lodestrata.operators.graph import closure, forest_order, reaching


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def complexity_score(text: Column, patterns: tuple[tuple[str, int], ...]) -> Column:
    """Sum of matches by weight; without patterns a point for each 500 lines, 1 at least."""
    if not patterns:
        return F.greatest(F.lit(1), F.floor(line_count(text) / 500)).cast("long")
    return sum((F.regexp_count(text, F.lit(p)).cast("long") * w for p, w in patterns), F.lit(0).cast("long"))


def unit_complexity(files: DataFrame) -> DataFrame:
    """(unit, score, level) of files (unit, language, text): each by the patterns of its language, summed over the unit."""
    text = F.col("text")
    by = F.coalesce(*(F.when(F.col("language") == k, complexity_score(text, p)) for k, p in COMPLEXITY.items()), complexity_score(text, ()))
    total = files.groupBy("unit").agg(F.sum(by).alias("score"))
    return total.withColumn("level", complexity_level(F.col("score")))


def complexity_level(score: Column) -> Column:
    return F.when(score >= 15, "HIGH").when(score >= 5, "MEDIUM").otherwise("LOW")


def estimated_tokens(text: Column, level: Column) -> Column:
    """chars / 3 by 1.5, 2 or 2.5 for low, medium or high; 2 where the level is unknown."""
    by = F.when(F.lower(level) == "low", 1.5).when(F.lower(level) == "high", 2.5).otherwise(2.0)
    return (F.length(text) / F.lit(3.0) * by).cast("long")


def output_tokens(tokens: Column, level: Column) -> Column:
    return (tokens * F.when(F.lower(level) == "low", 1.5).when(F.lower(level) == "high", 3.0).otherwise(2.0)).cast("long")


def needs_chunking(text: Column) -> Column:
    return (line_count(text) > 3000) | (F.length(text) > 150_000)


def fixed_chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, index, start_line, end_line) of windows of ``size`` lines, each but the first reaching back ``overlap`` lines."""
    n = docs.select("doc_id", line_count(F.col("text")).alias("n"))
    at = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size))).alias("index"))
    start = F.greatest(F.lit(0), F.col("index") * size - F.when(F.col("index") > 0, overlap).otherwise(0))
    return at.select("doc_id", F.col("index").cast("long").alias("index"), (start + 1).cast("long").alias("start_line"), F.least(F.col("n"), (F.col("index") + 1) * size).cast("long").alias("end_line"))


def semantic_chunks(docs: DataFrame, boundary: str | None, symbol: tuple[str, int] | None = None, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, index, start_line, end_line, symbols): greedy starts at boundary lines at least ``size`` lines after the last.

    ``symbol`` is a pattern and its number of groups, of which the first that is found names a line. The choice of
    starts is a fold over the document's boundary lines. Lines before the first boundary belong to no chunk; a
    document without boundaries, or a language without a pattern, has fixed windows.
    """
    lines = F.split("text", "\n", -1)
    marks = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(boundary), i)), lambda i: i.isNotNull()) if boundary else F.expr("cast(array() as array<int>)")
    numbered = docs.select("doc_id", lines.alias("lines"), marks.alias("at"))
    far = lambda acc, i: (F.size(acc) == 0) | (i - F.element_at(acc, -1) >= size)
    fold = F.aggregate("at", F.expr("cast(array() as array<int>)"), lambda acc, i: F.when(far(acc, i), F.concat(acc, F.array(i))).otherwise(acc))
    n = F.size("lines")
    fixed = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: (k * size).cast("int"))
    starts = numbered.withColumn("starts", F.when(F.size("at") > 0, fold).otherwise(fixed)).withColumn("n", n)
    each = starts.select("doc_id", "lines", "starts", "n", F.posexplode("starts").alias("index", "start"))
    end = F.coalesce(F.try_element_at("starts", F.col("index") + 2), F.col("n"))
    begin = F.when(F.col("index") > 0, F.greatest(F.lit(0), F.col("start") - overlap)).otherwise(F.col("start"))
    own = F.slice("lines", F.col("start") + 1, end - F.col("start"))
    names = F.array().cast("array<string>")
    if symbol:
        found = lambda x: F.coalesce(*(F.nullif(F.regexp_extract(x, symbol[0], k + 1), F.lit("")) for k in range(symbol[1])))
        names = F.array_compact(F.transform(own, found))
    at = lambda c, name: c.cast("long").alias(name)
    return each.select("doc_id", at(F.col("index"), "index"), at(begin + 1, "start_line"), at(end, "end_line"), F.array_join(names, ",").alias("symbols"))


def chunks_of(files: DataFrame, language: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """Semantic chunks by the fixed patterns of a language; one without patterns has fixed windows."""
    return semantic_chunks(files, BOUNDARY.get(language), SYMBOLS.get(language), size, overlap)


def key_line(line: Column) -> Column:
    found = F.lit(False)
    for p in KEY_LINES:
        found = found | line.rlike(p)
    return found


def compress_history(turns: DataFrame, keep_full: int = 3, percent: int = 30, pattern: str | None = None) -> DataFrame:
    """(conv_id, turn, kept): of turns before the last ``keep_full``, the first key lines, max(5, percent of the lines) at most; later turns whole."""
    if keep_full < 1:
        raise ValueError("keep_full is 1 at least")
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    most = F.greatest(F.lit(5), F.floor(F.size(lines) * percent / 100)).cast("int")
    key = F.array_join(F.slice(F.filter(lines, lambda x: key_line(x) if pattern is None else x.rlike(pattern)), 1, most), "\n")
    full = F.col("_b") <= keep_full
    return turns.withColumn("_b", back).select("conv_id", "turn", F.when(full, F.coalesce("text", F.lit(""))).otherwise(key).alias("kept"), full.alias("full"))


def compressed_history(turns: DataFrame, keep_full: int = 3, percent: int = 30, pattern: str | None = None) -> DataFrame:
    """(conv_id, history, recent): compressed turns under numbered headers in one text, and the last turns whole, in order."""
    kept = compress_history(turns, keep_full, percent, pattern)
    ordered = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("turn", "kept"))))
    g = kept.groupBy("conv_id").agg(ordered(~F.col("full")).alias("old"), ordered(F.col("full")).alias("new"))
    head = lambda i: F.concat(F.lit("--- chunk "), i.cast("string"), F.lit(" (compressed) ---"))
    part = lambda x, i: F.when(x["kept"] == "", head(i)).otherwise(F.concat(head(i), F.lit("\n"), x["kept"]))
    return g.select("conv_id", F.array_join(F.transform("old", part), "\n").alias("history"), F.transform("new", lambda x: x["kept"]).alias("recent"))


def inline_within(files: DataFrame, each: int = 15_000, total: int = 40_000) -> DataFrame:
    """(unit, path, size, included): smallest first; too large ones and those past the total are left out. A unit of any number of files is many tasks."""
    fits = files.select("unit", "path", "size", F.when(F.col("size") <= each, F.col("size")).otherwise(0).cast("long").alias("fits"))
    run = running(fits, "run", "fits", ["size", "path"], ("unit",))
    return run.select("unit", "path", "size", ((F.col("size") <= each) & (F.col("run") <= total)).alias("included"))


def paragraph_budget(parts: DataFrame, each: int = 4_000, total: int = 30_000) -> DataFrame:
    """(unit, pos, taken): in order, each part cut to ``each`` and to what is left of ``total``. A unit of any number of parts is many tasks."""
    want = parts.select("unit", "pos", F.least(F.col("size"), F.lit(each)).cast("long").alias("want"))
    run = running(want, "run", "want", ["pos"], ("unit",))
    return run.select("unit", "pos", F.greatest(F.lit(0), F.least("want", total - F.col("run") + F.col("want"))).cast("long").alias("taken"))


def paragraph_texts(nodes: DataFrame, each: int = 4_000, total: int = 30_000) -> DataFrame:
    """(program, text): paragraphs (program, name, file, start_line, end_line, raw_text, summary) in source order, their sources cut to what is left.

    A source over its budget is cut and marked, and the mark counts; once nothing is left a paragraph has its summary only.
    """
    raw, mark = F.coalesce("raw_text", F.lit("")), "\n... <truncated>"
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "name", "file", "end_line", raw.alias("raw"), F.coalesce("summary", F.lit("(not summarized)")).alias("summary"))))
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        place = F.concat(F.lit(" ("), p["file"], F.lit(":"), p["start_line"].cast("string"), F.lit("-"), p["end_line"].cast("string"), F.lit(")"))
        head = F.concat(F.lit("### Paragraph `"), p["name"], F.lit("`"), F.coalesce(place, F.lit("")), F.lit("\nSummary: "), p["summary"], F.lit("\n\n"))
        budget = F.least(F.lit(each), F.lit(total) - acc["used"])
        source = F.when(F.length(p["raw"]) > budget, F.concat(F.substr(p["raw"], F.lit(1), budget), F.lit(mark))).otherwise(p["raw"])
        gone = budget <= 0
        text = F.when(gone, F.lit("`<elided — total source budget exhausted>`\n")).otherwise(F.concat(F.lit("```cobol\n"), source, F.lit("\n```\n")))
        used = acc["used"] + F.when(gone, 0).otherwise(F.length(source))
        return F.struct(used.cast("int").alias("used"), F.concat(acc["out"], F.array(F.concat(head, text))).alias("out"))

    return nodes.groupBy("program").agg(F.array_join(F.aggregate(ordered, start, step)["out"], "\n").alias("text"))


def rates(model: Column) -> tuple[Column, Column]:
    """(input, output) rates: exact name, then the first declared prefix, then local prefixes free, else the fallback."""
    key = F.lower(F.coalesce(model, F.lit("")))
    out = []
    for i in (0, 1):
        c = F.when(key == "", F.lit(FALLBACK[i]))
        for row in PRICING:
            c = c.when(key == row[0], F.lit(row[1 + i]))
        for row in PRICING:
            c = c.when(key.startswith(row[0]), F.lit(row[1 + i]))
        out.append(c.when(key.rlike("^(" + "|".join(LOCAL) + ")"), F.lit(0.0)).otherwise(F.lit(FALLBACK[i])))
    return out[0], out[1]


def priced(calls: DataFrame) -> DataFrame:
    """``calls`` (model, in_tokens, out_tokens) with ``usd``."""
    a, b = rates(F.col("model"))
    return calls.withColumn("usd", F.col("in_tokens") / 1e6 * a + F.col("out_tokens") / 1e6 * b)


def cost_by_model(calls: DataFrame) -> DataFrame:
    name = F.coalesce(F.when(F.col("model") != "", F.lower("model")), F.lit("unknown"))
    return priced(calls).groupBy(name.alias("model")).agg(F.count("*").alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.round(F.sum("usd"), 6).alias("usd"))


def cost_grouping_sets(calls: DataFrame) -> DataFrame:
    """Totals by model, by tag and over all, in one pass."""
    name = F.coalesce(F.when(F.col("model") != "", F.lower("model")), F.lit("unknown"))
    named = priced(calls).select(name.alias("model"), "tag", "usd")
    return named.groupingSets([["model"], ["tag"], []], "model", "tag").agg(F.grouping_id("model", "tag").cast("int").alias("level"), F.count("*").alias("calls"), F.round(F.sum("usd"), 6).alias("usd"))


def cost_halt(calls: DataFrame, budget: float) -> DataFrame:
    """(run_id, halt_seq, charged_usd): the first call at which the running cost reaches the budget; that call is charged.

    Costs are taken in whole micro-dollars of a cent's thousandth, so sums don't depend on their order.
    """
    micro = priced(calls).select("run_id", "seq", F.round(F.col("usd") * 1e9).cast("long").alias("micro"))
    over = running(micro, "total", "micro", ["seq"], ("run_id",)).where(F.col("total") >= int(budget * 1e9))
    return over.groupBy("run_id").agg(F.min("seq").alias("halt_seq"), F.round(F.min("total") / 1e9, 6).alias("charged_usd"))


def rubric_totals(rows: DataFrame, passing: float = 0.75) -> DataFrame:
    """(unit, total, passed) of rows (unit, weight, score, error): scores clamped to [0, 1], errors 0, weighed mean."""
    s = F.when(F.col("error").isNotNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)))))
    t = rows.groupBy("unit").agg(F.sum(s * F.col("weight")).alias("a"), F.sum("weight").alias("w"))
    total = F.round(F.col("a") / F.coalesce(F.nullif(F.col("w"), F.lit(0.0)), F.lit(1.0)), 6)
    return t.select("unit", total.alias("total"), (total >= passing).alias("passed"))


def rubric_scorers(text: Column, has_tests: Column) -> dict[str, Column]:
    """Presence scores of a migrated unit's text: (score, condition) pairs, the first that holds, else the last score."""

    def first(*rules: tuple[float, Column], otherwise: float) -> Column:
        out = None
        for score, holds in rules:
            out = F.when(holds, score) if out is None else out.when(holds, score)
        return out.otherwise(otherwise)

    foreign = sum((F.when(text.rlike(m), 1).otherwise(0) for m in FOREIGN_MARKERS), F.lit(0))
    return {
        "contract_preserved": first((0.9, text.contains("def ")), otherwise=0.5),
        "sdk_replaced": first((0.0, text.rlike(SCORED_SDK)), (1.0, text.rlike(SCORED_TARGET)), otherwise=0.5),
        "handler_shape": first((1.0, text.rlike(TARGET_DECORATOR)), otherwise=0.0),
        "tests_parity": first((1.0, has_tests), otherwise=0.0),
        "auth_managed_identity": first((0.0, text.rlike(SCORED_KEYS)), (1.0, text.rlike(SCORED_IDENTITY)), otherwise=0.5),
        "idiomatic_python": F.greatest(F.lit(0.0), F.round(1 - 0.2 * foreign, 6)),
    }


def names_for(program: Column) -> dict[str, Column]:
    """Artifact, package and class names of a program."""
    low = F.lower(program)
    return {"artifact": low, "package": F.replace(low, F.lit("-"), F.lit("")), "class_name": F.replace(F.initcap(F.replace(low, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit(""))}


def content_key(content: Column, name: Column, kind: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", F.coalesce(content, F.lit("")), name, kind), 256), F.lit(16))


def cache_key(id: Column, content: Column, name: Column, kind: Column, prompt: Column) -> Column:
    """The key of a node's summary: its id, what it holds, and the prompt's digest."""
    return F.concat_ws(":", id, content_key(content, name, kind), prompt)


def chunk_key(id: Column, index: Column, start: Column, end: Column, content: Column, prompt: Column) -> Column:
    """The key of a chunk of a node: an edit changes its own chunk's only."""
    digest = F.left(F.sha2(F.concat_ws(":", start.cast("string"), end.cast("string"), content), 256), F.lit(16))
    return F.concat_ws(":", F.concat(id, F.lit("#chunk"), index.cast("string")), digest, prompt)


def latest_by_key(entries: DataFrame) -> DataFrame:
    """The last row of each key by ``ord`` (summary cache)."""
    return entries.groupBy("key").agg(F.max_by("value", "ord").alias("value"))


def summary_plan(nodes: DataFrame, cache: DataFrame, most: int | None = None, roots: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(id, key, needs_chunks, place): nodes (id, raw_text, name, kind, summary, prompt) without a summary and not in the cache (key), and their turns from 1.

    With ``edges`` (source, target, kind, ord) turns follow the trees of contains edges, tree by tree in the order of the roots' ids, what a node contains
    before it; else ids. ``most`` fresh ones are taken, of which 0 are none; what is in the cache doesn't count. With ``roots``
    (root), those and what they contain only, in whose order each node comes once.
    """
    own = nodes.select("id", "raw_text", "name", "kind", "prompt", "summary")
    if edges is not None:
        order = forest_order(nodes.select("id"), edges)
        if roots is not None:
            top = roots.select(F.col("root").alias("node")).distinct()
            held = closure(edges, top.select(F.col("node").alias("root")), ["contains"], include_root=True).select(F.col("node").alias("id")).distinct()
            order = order.join(held, "id", "left_semi")
        own = own.join(order.select("id", "root", F.col("place").alias("at")), "id")
    else:
        own = own.withColumns({"root": F.col("id"), "at": F.lit(0).cast("long")})
    key = cache_key(F.col("id"), F.col("raw_text"), F.col("name"), F.col("kind"), F.col("prompt"))
    todo = own.where("summary is null").withColumn("key", key).join(cache.select("key").distinct(), "key", "left_anti")
    todo = todo.select("id", "key", (estimated_tokens(F.col("raw_text"), F.lit("medium")) > 80_000).alias("needs_chunks"), "root", "at")
    placed = numbered(todo, "place", ["root", "at", "id"]).drop("root", "at")
    return placed if most is None else placed.where(F.col("place") <= most)


def target_style(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(program, style) of programs among nodes (id, kind, name, callable) by edges (source, target, kind).

    A program that reaches a transaction call by contains and calls is cics; else one that is callable a subroutine;
    else one with a step batch; else a subroutine. What reaches a transaction is found backward from all of them, a row a node.
    """
    own = nodes.where("kind = 'program'").select(F.col("id").alias("root"), F.col("name").alias("program"), F.coalesce("callable", F.lit(False)).alias("callable"))
    reached = reaching(edges, nodes.where("kind = 'txn_call'").select(F.col("id").alias("node")), ["contains", "calls"])
    talks = reached.select(F.col("node").alias("root"), F.lit(True).alias("talks"))
    steps = edges.where("kind = 'step_of'").select(F.col("source").alias("root")).distinct().withColumn("steps", F.lit(True))
    style = F.when(F.col("talks"), "cics").when(F.col("callable"), "subroutine").when(F.col("steps"), "batch").otherwise("subroutine")
    return own.join(talks, "root", "left").join(steps, "root", "left").select("program", style.alias("style"))


def style_of(styles: DataFrame, program: str) -> str:
    """The style of one program; KeyError if there is none of that name."""
    found = styles.where(F.col("program") == program).head()
    if found is None:
        raise KeyError(program)
    return found["style"]


def _plumbing(evidence: Column) -> Column:
    return F.exists(evidence, lambda e: e.rlike(" DD (?:" + "|".join(INFRA_DD) + ")"))


def spec_inputs(matrix: DataFrame, styles: DataFrame) -> DataFrame:
    """(program, name): datasets read, or only touched by a batch program through a DD that isn't plumbing. Pure writers are out."""
    touched = F.col("touches_only") & ~_plumbing(F.col("evidence")) & F.coalesce("style", F.lit("unknown")).isin("batch", "unknown")
    return matrix.where("kind = 'dataset'").join(styles, "program", "left").where(F.col("read_") | touched).select("program", "name")


def spec_outputs(matrix: DataFrame) -> DataFrame:
    return matrix.where("kind = 'dataset' and (create_ or update_ or delete_)").select("program", "name")


def side_effects(members: DataFrame, edges: DataFrame, nodes: DataFrame, prose: DataFrame | None = None) -> DataFrame:
    """(program, effects): distinct calls, CICS and SQL blocks reached from descendants, first seen first, then the narrative of ``prose`` (program, text)."""
    inner = members.where("program <> node")
    verb = F.coalesce("verb", F.lit("?"))
    said = F.when(F.col("kind") == "external_call", F.concat(F.lit("CALL "), "name")).when(F.col("kind") == "txn_call", F.concat(F.lit("EXEC CICS "), verb)).otherwise(F.concat(F.lit("EXEC SQL "), verb))
    what = nodes.where(F.col("kind").isin("external_call", "txn_call", "sql_block")).select(F.col("id").alias("target"), said.alias("effect"))
    used = edges.where(F.col("kind").isin("calls", "reads", "writes")).groupBy(F.col("source").alias("node"), "target").agg(F.min("ord").alias("ord"))
    seen = inner.join(used, "node").join(what, "target").groupBy("program", "effect").agg(F.min("ord").alias("ord"))
    found = seen.groupBy("program").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "effect"))), lambda x: x["effect"]).alias("effects"))
    if prose is None:
        return found
    text = F.trim("text")
    told = prose.where((text != "") & ~F.lower(text).isin("none", "(none)")).select("program", F.array(F.concat(F.lit("(LLM narrative) "), text)).alias("told"))
    none = F.array().cast("array<string>")
    return found.join(told, "program", "full_outer").select("program", F.concat(F.coalesce("effects", none), F.coalesce("told", none)).alias("effects"))


def summaries(members: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """(program, pos, name, summary): summaries of a program's members of a kind, nodes (id, kind, name, start_line, summary), in source order."""
    own = nodes.where((F.col("kind") == kind) & F.col("summary").isNotNull() & (F.col("summary") != "")).select(F.col("id").alias("node"), "name", F.coalesce("start_line", F.lit(0)).alias("start_line"), "summary")
    got = members.where("program <> node").join(own, "node")
    pos = F.row_number().over(Window.partitionBy("program").orderBy("start_line", "node"))
    return got.select("program", pos.alias("pos"), "name", "summary")


def run_summary(units: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """(run_id, wave, n_units, summary): units (run_id, wave, unit_id, status) counted by status, ``status=n`` by status."""
    n = units.groupBy("run_id", "wave", "status").agg(F.count("*").alias("n"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda x: F.concat(x["status"], F.lit("="), x["n"].cast("string")))
    return n.groupBy("run_id", "wave").agg(F.sum("n").alias("n_units"), F.array_join(told, " ").alias("summary"))


def unit_lines(units: DataFrame) -> DataFrame:
    """(run_id, unit_id, line) of units (status, reviewer_verdict, tests_passed, rubric_score, cost_usd): what is known of each in a line."""
    score = F.concat(F.lit(" score="), F.format_string("%.0f", F.col("rubric_score") * 100), F.lit("/100"))
    tests = F.concat(F.lit(" tests="), F.when(F.col("tests_passed"), "pass").otherwise("fail"))
    verdict = F.when(F.col("reviewer_verdict") != "", F.concat(F.lit(" verdict="), "reviewer_verdict"))
    cost = F.when(F.col("cost_usd") != 0, F.concat(F.lit(" cost=$"), F.format_string("%.4f", "cost_usd")))
    parts = (verdict, F.when(F.col("tests_passed").isNotNull(), tests), F.when(F.col("rubric_score").isNotNull(), score), cost)
    line = F.concat(F.col("unit_id"), F.lit("  status="), F.col("status"), *(F.coalesce(p, F.lit("")) for p in parts))
    return units.select("run_id", "unit_id", line.alias("line"))
