"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources' targets are their weights' shares of ``total_share`` of all words, none above ``most_repeats``
times its source's words, what is cut going to the others by weight. A source's documents are dealt to
shards by a digest, each of about ``shard_words`` words; a shard laid end to end in seeded order is cut into
blocks of ``block_words`` words. The total of the targets in blocks is given to sources by highest
quotients q / (2k + 1), and each source's number likewise to its shards: integer quotas. A shard whose
quota is m of its n blocks takes each block m // n times and m % n blocks, by seeded choice, once more.

Only a row for each source reaches the driver, of ``MOST_SOURCES`` at most (more are refused); whether their
plan is sent to the tasks or joined in an exchange is left to the planner, which knows its size. Shards are
bounded, whatever a source holds, so a hot source is many tasks; texts without words are in none.

Defined results: a null text has size 0; a document without words is taken 0 times; a null source is a
source of its own and comes last; rows of equal id and text tie and are interchangeable; an empty table
gives no rows. A source without words has target 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, mix, small_batches, text_of

WEIGHTS = (5, 2, 1)
TOTAL_SHARE, MOST_REPEATS = 1.5, 2.0
BLOCK_WORDS, SHARD_WORDS = 128, 2_000_000
SEED = 20
MOST_SOURCES = 1_000_000


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_REPEATS) -> list[float]:
    """Shares of ``total`` by weight, capped at ``most`` times the size, the excess reshared until none is above."""
    caps = [most * s for s in sizes]
    capped: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(caps[i] for i in sorted(capped))
        weight = sum(weights[i] for i in free)
        share = {i: rest * weights[i] / weight for i in free} if weight else {}
        above = {i for i in free if share[i] > caps[i]}
        if not above:
            return [caps[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= above


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2k + 1); ties go to the lower index.

    The quotients from a level near the answer on are counted at once, so the work follows the number of
    parties, not of seats.
    """
    votes = np.asarray(votes, dtype=np.float64)
    won = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0 or votes.sum() <= 0:
        return won
    # every party with v / level >= 1 has at least floor((v / level + 1) / 2) quotients at or above level
    level = votes.sum() / (2 * seats) * (1 + len(votes) / seats)
    won = np.floor((votes / level + 1) / 2).astype(np.int64)
    while won.sum() > seats:
        level *= 1.5
        won = np.floor((votes / level + 1) / 2).astype(np.int64)
    import heapq

    heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, won)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(won.sum())):
        _, i = heap[0]
        won[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * won[i] + 1), i))
    return won


def _seeded(n: int, seed: int) -> np.ndarray:
    return np.argsort(mix(np.arange(n, dtype=np.uint64) + mix(np.array([seed], dtype=np.int64).astype(np.uint64))), kind="stable")


def taken_words(ends: np.ndarray, quota: int, block_words: int, seed: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(passes, chosen blocks' mask, words of each document in chosen blocks) of a shard with documents ending at ``ends``."""
    words = int(ends[-1]) if len(ends) else 0
    n = -(-words // block_words)
    if not n:
        return 0, np.zeros(0, dtype=bool), np.zeros(len(ends), dtype=np.int64)
    chosen = np.zeros(n, dtype=bool)
    chosen[_seeded(n, seed)[: quota % n]] = True
    edges = np.minimum(np.arange(n + 1) * block_words, words)
    upto = np.append(0, np.cumsum(np.where(chosen, np.diff(edges), 0)))

    def before(p: np.ndarray) -> np.ndarray:
        b = np.minimum(p // block_words, n - 1)
        return upto[b] + np.where(chosen[b], p - edges[b], 0)

    return quota // n, chosen, before(ends) - before(np.append(0, ends[:-1]))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """(row columns of ``docs`` but text, size, source_size, target, taken, passes, segments) for rows (doc_id, text, source).

    ``segments`` are the word ranges [start, end) of the document in blocks that are taken once more than ``passes`` times.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(seed), "doc_id", F.md5(text_of()))
    sized = cut(docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), key.alias("key"), F.md5(text_of()).alias("digest")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()  # a row a source
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; mix by a coarser one")
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in sources]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], total_share * sum(sizes))
    blocks = [int(-(-s // block_words)) for s in sizes]
    seats = np.minimum(sainte_lague(np.array(target), round(sum(target) / block_words)), [2 * b for b in blocks]) if sources else []
    plan = [(i, r["source"], int(s), float(t), int(q), max(1, -(-int(s) // shard_words))) for i, (r, s, t, q) in enumerate(zip(sources, sizes, target, seats))]
    table = spark.createDataFrame(plan, "source_no int, name string, source_size long, target double, quota long, shards int")
    placed = sized.join(table, F.col("source").eqNullSafe(F.col("name"))).withColumn("shard", F.pmod("key", "shards").cast("int"))
    worded = placed.where("size > 0")
    totals = worded.groupBy("source_no", "shard", "quota").agg(F.sum("size").alias("words"))

    def share(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("shard", ignore_index=True)
        own["shard_quota"] = sainte_lague(own["words"].to_numpy(), int(own["quota"].iloc[0]))
        return own[["source_no", "shard", "shard_quota"]]

    quotas = totals.groupBy("source_no").applyInPandas(share, "source_no int, shard int, shard_quota long")  # a row a shard

    def take(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["key", "doc_id", "digest"], ignore_index=True)
        size = own["size"].to_numpy()
        ends = np.cumsum(size)
        number = int(own["source_no"].iloc[0]) * 1_000_003 + int(own["shard"].iloc[0]) + seed * 7_919
        passes, chosen, words = taken_words(ends, int(own["shard_quota"].iloc[0]), block_words, number)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], chosen.astype(np.int8), [0]]))).reshape(-1, 2) * block_words  # runs of chosen blocks
        segments = []
        for start, end in zip(ends - size, ends):
            i, got = int(np.searchsorted(edges[:, 1], start, side="right")), []
            while i < len(edges) and edges[i, 0] < end:
                got += [int(max(edges[i, 0], start) - start), int(min(edges[i, 1], end) - start)]
                i += 1
            segments.append(got)
        own["passes"], own["taken"], own["segments"] = passes, passes * size + words, segments
        return own[["doc_id", "digest", "source_no", "size", "taken", "passes", "segments"]]

    out = worded.select("source_no", "shard", "doc_id", "digest", "key", "size").join(quotas, ["source_no", "shard"])
    got = out.groupBy("source_no", "shard").applyInPandas(take, "doc_id long, digest string, source_no int, size long, taken long, passes int, segments array<int>")
    none = placed.where("size = 0").select(
        "doc_id", "digest", "source_no", "size", F.lit(0).cast("long").alias("taken"), F.lit(0).alias("passes"), F.array().cast("array<int>").alias("segments")
    )
    return got.unionByName(none).join(table.select("source_no", F.col("name").alias("source"), "source_size", "target"), "source_no")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a whole copy for each pass, and one of the words in the blocks taken once more.

    Only such a copy is cut: its words keep the white space that follows them within a range.
    """
    import re

    spark = docs.sparkSession
    small_batches(spark)
    plan = mix_sources(docs, **options).where("taken > 0").select("doc_id", "digest", "passes", "segments", "size")
    plan = plan.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("passes", F.to_json("segments"))))
    columns = docs.columns
    text = docs.schema["text"].name
    id_, digest, copy, passes, segments = fresh(docs, "id", "digest", "copy", "passes", "segments")
    keyed = docs.withColumn(digest, F.md5(text_of()))
    number = F.lit(1) if plan.where("copy > 1").isEmpty() else F.row_number().over(Window.partitionBy("doc_id", digest).orderBy(F.lit(1)))
    keyed = keyed.withColumn(copy, number)
    p = plan.select(
        F.col("doc_id").alias(id_), F.col("digest").alias(f"{digest}_"), F.col("copy").alias(f"{copy}_"), F.col("passes").alias(passes), F.col("segments").alias(segments)
    )
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(digest) == F.col(f"{digest}_")) & (F.col(copy) == F.col(f"{copy}_"))
    joined = keyed.join(p, same).select(*columns, passes, segments)
    word = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")

    def expand(batches):
        for batch in batches:
            extra = []
            for t, s in zip(batch[text], batch[segments]):
                if not len(s):
                    extra.append(None)
                    continue
                at = [m.start() for m in word.finditer(t)] + [len(t)]
                extra.append("\n".join(t[at[a] : at[b]].strip() for a, b in zip(s[::2], s[1::2])))
            whole = batch[columns].loc[batch.index.repeat(batch[passes])]
            part = batch[columns].assign(**{text: extra})
            part = part[part[text].notna()]
            if "n_chars" in columns:
                part = part.assign(n_chars=part[text].str.len())
            yield pd.concat([whole, part])

    return joined.mapInPandas(expand, docs.schema)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "source_size", "target", "taken")
