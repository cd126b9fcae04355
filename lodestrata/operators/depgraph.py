"""Unit dependency graph and wave planning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestrata.functions.ranking import numbered
from lodestrata.functions.tables import cut
from lodestrata.operators.fixed import EDGE_KINDS
from lodestrata.operators.graph import coded, components, heights, named_components, union_all

#: Units a side of the square that is added up at once, squares a side of a block of the product where units are many, blocks a side up to which a block is one square, and rows that are given at once.
BLOCK_UNITS, WIDE, BLOCKS, BLOCK_ROWS = 2048, 8, 8, 1 << 18
#: Rows through one resource that are one key's, and tasks that share all of them.
PAIRS, MOST_TASKS = 1 << 18, 20_000
WRITES, READS = ("queues_to", "publishes_to", "writes_to"), ("reads_from", "invokes")


def edge_kind(service: Column, operation: Column) -> Column:
    """The edge kind of a service call, by the first rule whose service and words fit; else it invokes."""
    low, found = F.lower(operation), None
    for services, words, kind in EDGE_KINDS:
        fits = F.lit(False)
        for w in words:
            fits = fits | F.coalesce(low.contains(w), F.lit(False))
        if services:
            fits = fits & F.coalesce(service.isin(*services), F.lit(False))
        found = F.when(fits, kind) if found is None else found.when(fits, kind)
    return found.otherwise("invokes")


def resource_key(provider: Column, kind: Column, name: Column, identifier: Column) -> Column:
    return F.concat_ws(":", provider, kind, F.coalesce(F.when(name != "", name), F.when(identifier != "", identifier), F.lit("?")))


def resource_edges(calls: DataFrame) -> DataFrame:
    """(source_unit, resource, kind, confidence, ambiguous) of calls (unit_id, service, operation, provider, rkind, rname, identifier).

    A call whose resource is unknown (rkind null) is an ambiguous invocation of confidence 0.3.
    """
    known = F.col("rkind").isNotNull()
    return calls.select(
        F.col("unit_id").alias("source_unit"), F.when(known, resource_key(F.col("provider"), F.col("rkind"), F.col("rname"), F.col("identifier"))).alias("resource"),
        F.when(known, edge_kind(F.col("service"), F.col("operation"))).otherwise("invokes").alias("kind"), F.when(known, 1.0).otherwise(0.3).alias("confidence"), (~known).alias("ambiguous"),
    )


def resources(calls: DataFrame) -> DataFrame:
    """(resource, provider, kind, name, identifier) of calls with a known resource, of one key as its first call (ord) tells it."""
    known = calls.where("rkind is not null")
    key = resource_key(F.col("provider"), F.col("rkind"), F.col("rname"), F.col("identifier"))
    told = F.struct("provider", F.col("rkind").alias("kind"), F.col("rname").alias("name"), "identifier")
    return known.groupBy(key.alias("resource")).agg(F.min_by(told, "ord").alias("t")).select("resource", "t.*")


def hint_edges(hints: DataFrame) -> DataFrame:
    """(source_unit, target_unit, resource, kind, evidence, confidence) of hints (source_unit, target_kind, provider, name, kind, evidence, confidence).

    Malformed hints, without a unit or a kind, are left out.
    """
    own = hints.where("source_unit is not null and kind is not null")
    key = resource_key(F.col("provider"), F.col("target_kind"), F.col("name"), F.lit(None).cast("string"))
    return own.select("source_unit", F.lit(None).cast("string").alias("target_unit"), key.alias("resource"), "kind", "evidence", "confidence")


#: What is wrong with a hint, in the order in which it is told.
NO_UNIT, NO_KIND, ORPHAN = "no unit", "no kind", "unit not in the inventory"


def checked_hints(hints: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame, Observation]:
    """(good, refused, counts) of manifest hints, in one pass over them.

    Good hints have a unit of the inventory (units: unit_id) and a kind; refused ones come with their ``reason``: malformed, or an
    orphan whose unit isn't known. ``counts`` has n_hints, n_malformed and n_orphans, once either side has been read through.
    """
    known = units.select(F.col("unit_id").alias("source_unit")).distinct().withColumn("_known", F.lit(True))
    reason = F.when(F.col("source_unit").isNull(), NO_UNIT).when(F.col("kind").isNull(), NO_KIND).when(F.col("_known").isNull(), ORPHAN)
    counts = Observation()
    told = hints.join(known, "source_unit", "left").withColumn("reason", reason).select(*hints.columns, "reason")
    told = cut(told.observe(
        counts, F.count("*").alias("n_hints"), F.count_if(F.col("reason").isin(NO_UNIT, NO_KIND)).alias("n_malformed"), F.count_if(F.col("reason") == ORPHAN).alias("n_orphans")))
    return told.where("reason is null").drop("reason"), told.where("reason is not null"), counts


def build_graph(units: DataFrame, imports: DataFrame, calls: DataFrame, hints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, orphans): all edges of the dependency graph (source_unit, target_unit, resource, kind, evidence, confidence, ambiguous, n), and the hints that are refused.

    units (unit_id); imports (unit_id, module, is_external, evidence); calls (unit_id, service, operation, provider,
    rkind, rname, identifier, evidence); hints as hint_edges takes them. Edges through a shared resource follow from
    those of calls and hints, ``n`` at once; all others stand for one. Hints without a unit or a kind, and those of units that
    aren't in the inventory, give no edges; they come back with their reason.
    """
    good, refused, _ = checked_hints(hints, units)
    none = F.lit(None).cast("string")
    first = F.split_part(F.col("module"), F.lit("."), F.lit(1))
    told = imports.where("not is_external").select(F.col("unit_id").alias("source_unit"), first.alias("target_unit"), "evidence").where("target_unit <> ''")
    told = told.join(units.select(F.col("unit_id").alias("target_unit")), "target_unit", "left_semi").where("source_unit <> target_unit")
    told = told.select("source_unit", "target_unit", none.alias("resource"), F.lit("imports").alias("kind"), "evidence", F.lit(1.0).alias("confidence"), F.lit(False).alias("ambiguous"))
    known = F.col("rkind").isNotNull()
    of_calls = calls.select(
        F.col("unit_id").alias("source_unit"), none.alias("target_unit"), F.when(known, resource_key(F.col("provider"), F.col("rkind"), F.col("rname"), F.col("identifier"))).alias("resource"),
        F.when(known, edge_kind(F.col("service"), F.col("operation"))).otherwise("invokes").alias("kind"),
        F.when(known, F.col("evidence")).otherwise(F.concat("evidence", F.lit(" (unresolved)"))).alias("evidence"), F.when(known, 1.0).otherwise(0.3).alias("confidence"), (~known).alias("ambiguous"),
    )
    direct = cut(of_calls.unionByName(hint_edges(good).withColumn("ambiguous", F.lit(False))))
    through = shared_edges(direct)
    through = through.select(
        "source_unit", "target_unit", "resource", F.lit("invokes").alias("kind"), F.concat(F.lit("derived via shared resource "), "resource").alias("evidence"), F.lit(0.9).alias("confidence"),
        F.lit(False).alias("ambiguous"), "n",
    )
    return told.unionByName(direct).withColumn("n", F.lit(1).cast("long")).unionByName(through), refused


def import_edges(imports: DataFrame, units: DataFrame) -> DataFrame:
    """(source_unit, target_unit): internal imports whose first dotted segment is another unit; duplicates stay."""
    first = F.split_part(F.col("module"), F.lit("."), F.lit(1))
    named = imports.where("not is_external and module <> ''").select(F.col("unit_id").alias("source_unit"), first.alias("target_unit")).where("target_unit <> ''")
    return named.join(units.select(F.col("unit_id").alias("target_unit")), "target_unit", "left_semi").where("source_unit <> target_unit").select("source_unit", "target_unit")


def _sides(edges: DataFrame) -> DataFrame:
    """(source_unit, resource, writes, reads, n): facts by unit, resource and side."""
    writes, reads = F.col("kind").isin(*WRITES).alias("writes"), F.col("kind").isin(*READS).alias("reads")
    return edges.where("not ambiguous and resource is not null").groupBy("source_unit", "resource", writes, reads).agg(F.count("*").alias("n"))


def shared_edges(edges: DataFrame, drop_unnamed: bool = False) -> DataFrame:
    """(source_unit, target_unit, resource, n): writer to reader of each resource, n the multiplicity.

    Facts are counted by (unit, resource, side) first, and the join carries counts: n is the product, the number of
    rows that joining the facts would give. The result itself has writers x readers rows a resource, which for the
    unnamed resources of a kind is every unit that writes one by every unit that reads one; ``drop_unnamed`` leaves
    those out, and ``memberships`` gives the same in a row a unit and side.

    Writers by readers of a resource are dealt in blocks of about PAIRS rows, each a key of its own, so that a few wide
    resources are many tasks' work and what a task holds is bounded; a writer or reader is exchanged once a block of the other side.
    """
    side = _sides(edges)
    side = side.where(~F.col("resource").endswith(":?")) if drop_unnamed else side
    side = cut(side)
    size = side.groupBy("resource").agg(F.count_if("writes").alias("w"), F.count_if("reads").alias("r"))
    # one side of a square of PAIRS rows; a resource of fewer is one block
    edge = int(PAIRS ** 0.5)
    cuts = lambda c: F.when(F.col("w") * F.col("r") > PAIRS, F.ceil(F.col(c) / edge)).otherwise(1).cast("int").alias(f"{c}_blocks")
    size = cut(size.where("w > 0 and r > 0"))
    # told in numbers, as adaptive execution would put the few bytes of both sides in one task
    pairs = size.agg(F.coalesce(F.sum(F.col("w") * F.col("r")), F.lit(0))).head()[0]
    tasks = max(1, min(4 * side.sparkSession.sparkContext.defaultParallelism, pairs // PAIRS), min(MOST_TASKS, pairs // (64 * PAIRS)))
    dealt = side.join(size.select("resource", cuts("w"), cuts("r")), "resource")
    block = lambda c: F.pmod(F.xxhash64("source_unit"), F.col(c)).cast("int").alias
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias
    w = dealt.where("writes").select("resource", block("w_blocks")("a"), each("r_blocks")("b"), F.col("source_unit"), F.col("n").alias("nw"))
    r = dealt.where("reads").select("resource", each("w_blocks")("a"), block("r_blocks")("b"), F.col("source_unit").alias("target_unit"), F.col("n").alias("nr"))
    keys = ["resource", "a", "b"]
    return w.repartition(tasks, *keys).join(r.repartition(tasks, *keys).hint("merge"), keys).where("source_unit <> target_unit").select("source_unit", "target_unit", "resource", (F.col("nw") * F.col("nr")).alias("n"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source_unit, target_unit, n) of one block from its writers (no target), readers (no source) and counted pairs (both)."""
    t = pa.Table.from_batches(list(batches))
    (source, sources), (target, targets), (resource, _) = (
        ((d := t[c].combine_chunks().dictionary_encode()).indices.fill_null(-1).to_numpy(zero_copy_only=False), d.dictionary) for c in ("source_unit", "target_unit", "resource"))
    n = t["n"].to_numpy()
    writes, reads = (target < 0) & (source >= 0), (source < 0) & (target >= 0)
    pairs = (source >= 0) & (target >= 0)
    pairs = np.flatnonzero(pairs)[np.argsort(source[pairs], kind="stable")]
    by = lambda of: np.flatnonzero(of)[np.argsort(resource[of], kind="stable")]
    writes, reads = by(writes), by(reads)
    sides = []
    for k in np.intersect1d(resource[writes], resource[reads]):
        w, r = (x[slice(*np.searchsorted(resource[x], (k, k + 1)))] for x in (writes, reads))
        # a unit has a row or two a resource and side
        (su, si), (tu, ti) = np.unique(source[w], return_inverse=True), np.unique(target[r], return_inverse=True)
        nw, nr = np.zeros(len(su), np.int64), np.zeros(len(tu), np.int64)
        np.add.at(nw, si, n[w])
        np.add.at(nr, ti, n[r])
        sides.append((su, nw, tu, nr))
    own = {name: i for i, name in enumerate(targets.to_pylist())}
    same = np.array([(i, own[name]) for i, name in enumerate(sources.to_pylist()) if name in own], np.int64).reshape(-1, 2)
    some, step = max(1, BLOCK_UNITS ** 2 // max(1, len(targets))), max(1, BLOCK_ROWS // max(1, len(targets)))
    for begin in range(0, len(sources), some):
        end = min(begin + some, len(sources))
        total = np.zeros((end - begin, len(targets)), np.int64)
        within = pairs[slice(*np.searchsorted(source[pairs], (begin, end)))]
        np.add.at(total, (source[within] - begin, target[within]), n[within])
        for su, nw, tu, nr in sides:
            at = slice(*np.searchsorted(su, (begin, end)))
            if len(tu) == len(targets):
                total[su[at] - begin] += nw[at, None] * nr
            else:
                total[np.ix_(su[at] - begin, tu)] += nw[at, None] * nr
        mine = same[(same[:, 0] >= begin) & (same[:, 0] < end)]
        total[mine[:, 0] - begin, mine[:, 1]] = 0
        for at in range(0, end - begin, step):
            i, j = np.nonzero(total[at:at + step])
            yield pa.record_batch([sources.take(pa.array(i + at + begin)), targets.take(pa.array(j)), pa.array(total[at:at + step][i, j])], names=["source_unit", "target_unit", "n"])


def derived_edges(edges: DataFrame, drop_unnamed: bool = False) -> DataFrame:
    """(source_unit, target_unit, n) over all resources, as ``shared_edges`` has them.

    Where writers by readers of a resource are many more than its writers and readers dealt to all blocks they fall in, a
    block of sources by targets is one task's, which adds its resources up, a square of BLOCK_UNITS units a side at once: no row
    is made for each resource of two units, and none is exchanged after. A writer or reader is exchanged once a block, so blocks
    are up to WIDE squares a side where units are many. What is left, the pairs of the other resources, is joined and counted,
    and added to its block. The result is still up to units by units rows, each made once.
    """
    side = _sides(edges)
    side = cut(side.where(~F.col("resource").endswith(":?")) if drop_unnamed else side)
    units = side.agg(F.count_distinct("source_unit")).head()[0]
    blocks = max(-(-units // (WIDE * BLOCK_UNITS)), min(BLOCKS, -(-units // BLOCK_UNITS)))
    size = side.groupBy("resource").agg(F.count_if("writes").alias("w"), F.count_if("reads").alias("r"))
    wide = cut(size.where(F.col("w") * F.col("r") > 16 * blocks * (F.col("w") + F.col("r"))).select("resource"))
    few, many = side.join(wide, "resource", "left_anti"), side.join(wide, "resource", "left_semi")
    w = few.where("writes").select("resource", "source_unit", F.col("n").alias("nw"))
    r = few.where("reads").select("resource", F.col("source_unit").alias("target_unit"), F.col("n").alias("nr"))
    pairs = w.join(r, "resource").where("source_unit <> target_unit").groupBy("source_unit", "target_unit").agg(F.sum(F.col("nw") * F.col("nr")).alias("n"))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, blocks))).alias
    each, none = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, blocks) - 1).cast("long"))).alias, F.lit(None).cast("string").alias
    unit = F.col("source_unit")
    cells = union_all([
        pairs.select(block("source_unit")("a"), block("target_unit")("b"), "source_unit", "target_unit", none("resource"), "n"),
        many.where("writes").select(block("source_unit")("a"), each("b"), "source_unit", none("target_unit"), "resource", "n"),
        many.where("reads").select(each("a"), block("source_unit")("b"), none("source_unit"), unit.alias("target_unit"), "resource", "n"),
    ])
    return cells.groupBy("a", "b").applyInArrow(_products, "source_unit string, target_unit string, n long")


def memberships(edges: DataFrame) -> DataFrame:
    """(resource, unit, side, n): who writes and who reads each resource, from which derived edges follow without making them."""
    side = _sides(edges)
    w, r = (side.where(c).select("resource", F.col("source_unit").alias("unit"), F.lit(v).alias("side"), "n") for c, v in (("writes", "writer"), ("reads", "reader")))
    return w.unionByName(r)


def call_hints(calls: DataFrame, units: DataFrame) -> DataFrame:
    """Distinct (caller, callee) where both are units."""
    ids = units.select("unit_id")
    pairs = calls.select("caller", "callee").distinct()
    return pairs.join(ids.withColumnRenamed("unit_id", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("unit_id", "callee"), "callee", "left_semi").select("caller", "callee")


def condensation(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct edges between different clusters."""
    a, b = clusters.select(F.col("id").alias("source"), F.col("cluster").alias("a")), clusters.select(F.col("id").alias("target"), F.col("cluster").alias("b"))
    return edges.join(a, "source").join(b, "target").where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()


def waves(units: DataFrame, edges: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(unit_id, cluster, wave, pos): dependencies first; within a wave by seam score, then id.

    Units without edges are singletons of wave 1.
    """
    names, step = coded(edges, units.select(F.col("unit_id").alias("id")))
    larger = components(step)
    own = units.select(F.col("unit_id").alias("id")).join(names, "id")
    every = own.join(larger.select(F.col("id").alias("code"), "least"), "code", "left").join(named_components(names, larger), "code", "left")
    every = cut(every.select("id", "code", F.coalesce("cluster", "id").alias("cluster"), F.coalesce("least", "code").alias("least")))
    coded_clusters = every.select(F.col("code").alias("id"), F.col("least").alias("cluster"))
    level = heights(coded_clusters.select(F.col("cluster").alias("id")), condensation(step, coded_clusters))
    placed = every.join(level.select(F.col("id").alias("least"), (F.col("height") + 1).alias("wave")), "least")
    if scores is not None:
        placed = placed.join(scores.select(F.col("unit_id").alias("id"), "seam_score"), "id", "left").withColumn("seam_score", F.coalesce("seam_score", F.lit(0.0)))
    else:
        placed = placed.withColumn("seam_score", F.lit(0.0))
    placed = numbered(placed.select(F.col("id").alias("unit_id"), "cluster", "wave", "seam_score"), "pos", [F.col("seam_score").desc(), F.col("unit_id")], ("wave",))
    return placed.select("unit_id", "cluster", "wave", F.col("pos").cast("int").alias("pos"))


def acceptance(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit_id, n_in, n_out, text): counts keep multiplicity; edges to resources count as outbound."""
    out = edges.groupBy(F.col("source").alias("unit_id")).agg(F.count("*").alias("n_out"))
    into = edges.where("target is not null").groupBy(F.col("target").alias("unit_id")).agg(F.count("*").alias("n_in"))
    got = units.select("unit_id").join(out, "unit_id", "left").join(into, "unit_id", "left").na.fill(0, ["n_in", "n_out"])
    text = "Migrate %s preserving its public contract. Cross-unit edges: %d inbound, %d outbound. All unit tests must pass. No new deprecated APIs. Rubrics green."
    return got.select("unit_id", "n_in", "n_out", F.format_string(text, "unit_id", "n_in", "n_out").alias("criteria"))


def context_paths(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(unit_id, paths): files (unit_id, path, ord) of out-neighbours, first seen first, distinct."""
    near = edges.where("target is not null").groupBy("source", "target").agg(F.min("ord").alias("eo"))
    seen = near.join(files.withColumnRenamed("unit_id", "target"), "target").groupBy(F.col("source").alias("unit_id"), "path").agg(F.min(F.struct("eo", "ord")).alias("at"))
    return seen.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]).alias("paths"))


def backlog(units: DataFrame, edges: DataFrame, files: DataFrame, complexity: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(wave, pos, unit_id, cluster, complexity, source_paths, context_paths, criteria): the plan, a row a unit.

    units (unit_id); edges (source, target, ord), a target null for resources; files (unit_id, path, ord); complexity
    (unit_id, level), MEDIUM where it is missing; scores (unit_id, seam_score) order units within a wave.
    """
    edges = cut(edges)
    between = edges.where("target is not null")
    placed = waves(units, between, scores)
    paths = files.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("source_paths"))
    near = context_paths(between, files).withColumnRenamed("paths", "context_paths")
    told = acceptance(units, edges).select("unit_id", "criteria")
    none = F.array().cast("array<string>")
    out = placed.join(complexity.select("unit_id", "level"), "unit_id", "left").join(paths, "unit_id", "left").join(near, "unit_id", "left").join(told, "unit_id")
    return out.select(
        "wave", "pos", "unit_id", "cluster", F.coalesce("level", F.lit("MEDIUM")).alias("complexity"), F.coalesce("source_paths", none).alias("source_paths"),
        F.coalesce("context_paths", none).alias("context_paths"), "criteria",
    )
