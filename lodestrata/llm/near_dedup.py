"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded and verified.

Three passes. (1) A count-min sketch of fixed size takes the document frequency of every 5-word shingle of
every text. (2) Each text gets ``bands x rows`` improved consistent weighted samples of its TF-IDF
weighted shingles; a band's samples make its bucket key. (3) In each bucket every distinct text is
compared with its leader, the one whose shingles are the most common (a copy's own edits are rare); texts
that fail there but may have a partner elsewhere in the bucket are compared with each other unless already
connected. Two exact bounds rule most of those pairs out: the distance is a metric, and no text shares more
than what other such texts have of it. Pairs are accepted at a weighted Jaccard similarity of ``threshold``
on the whole texts; classes are the connected components.

Weights are tf * idf with idf = 1 + ln((1 + n) / (1 + df)) / 16, 1 at least, so no weight is 0. Frequencies
below 2**-16 of all (document, shingle) pairs count as that share. Above it there are fewer than 2**16
shingles however large the corpus, and a counter takes on average 2**-20 of the pairs from others, so what
the sketch adds to a frequency that matters is a sixteenth at most on average (less by the second counter),
at any size. Samples are drawn by the weights that pairs are accepted by, so a pair at the threshold falls
in a common bucket as often as any other, whatever its texts share.

A node is a text, by its 128-bit digest, never a doc_id: rows of one id with two texts are told apart.

Defined results: a null text equals an empty one; equal texts are one node whatever their length; a text
of under five words has no shingles and joins only equal texts. A class has the least doc_id of its rows as
its id. Of several classes with the same least doc_id (an id with several texts) the one of the least digest
has it; the others, and a class of rows without doc_id only, have a negative id derived from a digest. An
empty table gives no rows; columns but doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, components, cut, fresh, hash_texts, mix, shingles, small_batches, text_of, words_of

LOG2_SKETCH = 20
#: Counters a shingle falls on; the least of them counts.
DEPTH = 2
#: The share of all (document, shingle) pairs below which frequencies are taken as that share.
LEAST_SHARE = 2**-16
DAMPING = 16
SEGMENT = 1024
BANDS, ROWS = 16, 4
THRESHOLD = 0.8
_EPS = 1e-6


def _tf(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of a text's word hashes, and how often each occurs."""
    h, n = np.unique(shingles(words), return_counts=True)
    return h, n.astype(np.float32)


def _slots(h: np.ndarray, log2: int) -> list[np.ndarray]:
    """The counters of shingles, one in each row of the sketch."""
    mask = np.uint64((1 << log2) - 1)
    return [((h >> np.uint64(32 * d)) & mask).astype(np.int64) for d in range(DEPTH)]


def document_frequencies(docs: DataFrame, log2: int = LOG2_SKETCH) -> tuple[np.ndarray, int, int]:
    """(counters of ``DEPTH`` rows of 2**log2, documents, pairs of a document and a shingle).

    Tasks emit segments of their own counters, which are summed as streams by segment, so nothing but
    the fixed number of counters (16 MB at the default) ever reaches one place.
    """
    size = 1 << log2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, total, n = WordHasher(), np.zeros((DEPTH, size), dtype=np.int32), 0
        for batch in batches:
            n += len(batch)
            found = [np.unique(shingles(w)) for w in hash_texts(hasher, list(batch["text"]))]
            if found:
                for d, slots in enumerate(_slots(np.concatenate(found), log2)):
                    total[d] += np.bincount(slots, minlength=size).astype(np.int32)
        parts = total.reshape(-1, SEGMENT)
        some = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"segment": np.append(some, -1), "counts": [parts[i].tobytes() for i in some] + [np.int32(n).tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch["segment"], batch["counts"]):
                c = np.frombuffer(c, dtype=np.int32).astype(np.int64)
                sums[k] = sums[k] + c if k in sums else c
        yield pd.DataFrame({"segment": list(sums), "counts": [v.tobytes() for v in sums.values()]})

    schema = "segment long, counts binary"
    parts = docs.select(text_of().alias("text")).mapInPandas(count, schema)
    total, n = np.zeros(DEPTH * size, dtype=np.int64), 0
    for row in parts.repartition("segment").mapInPandas(add, schema).collect():  # DEPTH * size / SEGMENT + 1 rows
        c = np.frombuffer(row["counts"], dtype=np.int64)
        if row["segment"] < 0:
            n = int(c[0])
        else:
            total[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = c
    total = total.reshape(DEPTH, size)
    return total, n, int(total[0].sum())


def idf_table(counts: np.ndarray, n: int, pairs: int) -> np.ndarray:
    """The idf by counter, a row for each row of ``counts``; a shingle's idf is the largest of its counters'."""
    df = np.maximum(np.minimum(counts, n), pairs * LEAST_SHARE)
    return np.maximum(1, 1 + np.log((1 + n) / (1 + df)) / DAMPING).astype(np.float32)


def weights_of(h: np.ndarray, tf: np.ndarray, table: np.ndarray) -> np.ndarray:
    best = None
    for row, slots in zip(table, _slots(h, table.shape[1].bit_length() - 1)):
        got = row.take(slots)
        best = got if best is None else np.maximum(best, got)
    return tf * best


class Sampler:
    """Improved consistent weighted sampling: one (shingle, level) sample for each of k hash functions."""

    CHUNK = 1024

    def __init__(self, k: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.k = k
        self.odd = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # quantiles of Gamma(2, 1), for r by 12 bits and for c by 14
        self.r = self._gamma(rng, 12)
        self.ln_c = np.log(self._gamma(rng, 14)).astype(np.float32)

    @staticmethod
    def _gamma(rng: np.random.Generator, bits: int) -> np.ndarray:
        return np.sort(rng.gamma(2.0, 1.0, (64, 1 << bits)), axis=1).mean(axis=0).astype(np.float32)

    def __call__(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        best = best_a = None
        ln_w = np.log(weight).astype(np.float32)
        k = np.arange(self.k)
        for i in range(0, len(h), self.CHUNK):
            z = h[i : i + self.CHUNK, None] * self.odd
            z ^= z >> np.uint64(32)
            beta = z.astype(np.uint32).astype(np.float32)
            beta *= np.float32(2**-32)
            z >>= np.uint64(38)
            ln_c = self.ln_c.take((z & np.uint64(0x3FFF)).view(np.int64))
            z >>= np.uint64(14)
            r = self.r.take(z.view(np.int64))
            t = ln_w[i : i + self.CHUNK, None] / r
            t += beta
            np.floor(t, out=t)
            beta -= t
            beta -= np.float32(1)
            beta *= r
            beta += ln_c  # ln c - r * (t - beta + 1)
            at = beta.argmin(axis=0)
            low = beta[at, k]
            got = mix(h[i + at] ^ mix(t[at, k].astype(np.int64).astype(np.uint64)))
            if best is None:
                best, best_a = got, low
            else:
                better = low < best_a
                best, best_a = np.where(better, got, best), np.where(better, low, best_a)
        return best


def signatures(docs: DataFrame, idf, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, rarity, buckets): the text's digest, its shingles' mean idf and its bucket keys, none for under five words."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, sampler, table = WordHasher(), Sampler(bands * rows), idf.value
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            out, rarity = [], []
            for words in hash_texts(hasher, list(batch["text"])):
                h, n = _tf(words)
                if not len(h):
                    out.append(None)
                    rarity.append(0.0)
                    continue
                weight = weights_of(h, n, table)
                rarity.append(float(weight.sum(dtype=np.float64) / n.sum(dtype=np.float64)))
                s = sampler(h, weight).reshape(bands, rows)
                key = salt.copy()
                for j in range(rows):
                    key = mix(key ^ s[:, j])
                out.append(key.astype(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"], "rarity": rarity, "buckets": out})

    text = text_of()
    return docs.select("doc_id", F.md5(text).alias("key"), text.alias("text")).mapInPandas(sign, "doc_id long, key string, rarity double, buckets array<long>")


def weighted_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(x[1][i], y[1][j]).sum(dtype=np.float64))
    total = float(x[1].sum(dtype=np.float64) + y[1].sum(dtype=np.float64)) - both
    return both / total if total else 0.0


def verify(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b, similarity) of pairs (a, b) of nodes; texts: (node, text)."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, table = WordHasher(), idf.value
        last: dict[str, tuple] = {}

        def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
            h, n = _tf(hasher(words_of([text])[0]))
            return h, weights_of(h, n, table)

        for batch in batches:
            out = []
            for a, b in zip(batch["text_a"], batch["text_b"]):
                if a not in last:
                    last = {a: vector(a)}
                out.append(weighted_jaccard(last[a], vector(b)))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": out})

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return with_both.select("a", "b", "text_a", "text_b").mapInPandas(judge, "a long, b long, similarity double")


def shared_weights(texts: DataFrame, idf) -> DataFrame:
    """(node, total, shared): the weight of each text, and of its shingles that another of these texts has too.

    No two of them share more than the lesser ``shared``, which bounds their similarity exactly.
    """

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, table = WordHasher(), idf.value
        for batch in batches:
            hs, ws = [], []
            for words in hash_texts(hasher, list(batch["text"])):
                h, n = _tf(words)
                hs.append(h.astype(np.int64))
                ws.append(weights_of(h, n, table).astype(np.float64))
            yield pd.DataFrame({"node": batch["node"], "h": hs, "w": ws})

    vector = cut(texts.select("node", "text").mapInPandas(vectors, "node long, h array<long>, w array<double>").groupBy("node").agg(F.first("h").alias("h"), F.first("w").alias("w")), "vectors")
    each = vector.select("node", F.explode(F.arrays_zip("h", "w")).alias("s")).select("node", "s.h", "s.w")
    common = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    shared = each.join(common, "h").groupBy("node").agg(F.sum("w").alias("shared"))
    total = F.aggregate("w", F.lit(0.0), lambda a, b: a + b)
    return vector.select("node", total.alias("total")).join(shared, "node", "left").select("node", "total", F.coalesce("shared", F.lit(0.0)).alias("shared"))


def _nameless(key: Column) -> Column:
    """The id of a class without a doc_id of its own."""
    return -1 - F.abs(F.xxhash64(key) % F.lit(1 << 62))


class Classes:
    """The tables that near-duplicate search leaves: ``rows`` (doc_id, key, n_rows), ``nodes`` (key, node, component) and ``classes`` (component, class_id, least, key)."""

    def __init__(self, rows: DataFrame, nodes: DataFrame):
        named = F.struct(F.col("least").isNull().alias("no"), "least", "key")
        groups = nodes.groupBy("component").agg(F.min(named).alias("first")).select("component", "first.least", "first.key")
        owner = groups.where("least is not null").groupBy("least").agg(F.min("key").alias("key"), F.lit(True).alias("own"))
        self.rows = rows
        self.nodes = nodes.select("key", "component")
        self.classes = cut(
            groups.join(owner, ["least", "key"], "left").select(
            "component", F.when(F.col("own"), F.col("least")).otherwise(_nameless(F.col("key"))).alias("class_id"),
            "least", "key"), "classes")


def find_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, log2: int = LOG2_SKETCH) -> Classes:
    """The classes of near-duplicates of ``docs`` (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts, n, total = document_frequencies(docs, log2)
    idf = spark.sparkContext.broadcast(idf_table(counts, n, total))  # DEPTH rows of 2**log2 floats
    signed = cut(signatures(docs, idf, bands, rows), "signed")
    by_key = signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("buckets").alias("buckets"), F.first("rarity").alias("rarity"))
    # ids of nodes are made once, as the table is written
    nodes = cut(by_key.select("key", F.monotonically_increasing_id().alias("node"), "least", "rarity", "buckets"), "nodes")
    own = signed.groupBy("doc_id", "key").agg(F.count("*").alias("n_rows"))
    repeated = not own.where("n_rows > 1 and doc_id is not null").isEmpty()
    entries = nodes.select("node", "rarity", F.explode("buckets").alias("bucket"))
    first = F.min(F.struct("rarity", "node"))["node"]
    leaders = entries.groupBy("bucket").agg(first.alias("leader"), F.count("*").alias("n")).where("n > 1").select("bucket", "leader")
    entries = cut(entries.select("node", "bucket").join(leaders, "bucket"), "entries")
    pairs = cut(entries.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")

    def texts(of: DataFrame) -> DataFrame:
        """(node, text) of the nodes of pairs, each taken from one row."""
        named_in = of.select(F.col("a").alias("node")).distinct().union(of.select("b").distinct())
        wanted = nodes.join(named_in, "node", "left_semi").select("key", "node", "least")
        source = docs.select("doc_id", text_of().alias("text")).withColumn("key", F.md5("text"))
        named = source.join(wanted.where("least is not null").select("key", F.col("least").alias("doc_id"), "node"), ["key", "doc_id"]).select("node", "text")
        named = named.dropDuplicates(["node"]) if repeated else named
        if not nodes.where("least is null").isEmpty():
            nameless = source.where("doc_id is null").join(wanted.where("least is null").select("key", "node"), "key").select("node", "text")
            named = named.unionByName(nameless.dropDuplicates(["node"]))
        return named

    judged = cut(verify(pairs, texts(pairs), idf), "judged")
    edges = judged.where(F.col("similarity") >= threshold).select("a", "b")
    failed = judged.where(F.col("similarity") < threshold)
    labels = components(edges)
    if not failed.isEmpty():
        room = 1 - threshold + _EPS
        seen = entries.where("node <> leader").join(judged.select(F.col("a").alias("leader"), F.col("b").alias("node"), "similarity"), ["leader", "node"])
        best = seen.where(F.col("similarity") < threshold).groupBy("bucket").agg(F.max("similarity").alias("nearest"))
        left = seen.join(best, "bucket").where((F.col("similarity") < threshold) | (F.col("similarity") <= F.col("nearest") + room))
        left = cut(left.join(labels, "node", "left").select("bucket", "node", "similarity", F.coalesce("component", "node").alias("component")), "left")
        weights = shared_weights(texts(left.select(F.col("node").alias("a"), F.col("node").alias("b"))), idf).where(F.col("shared") >= (threshold - _EPS) * F.col("total"))
        left = cut(left.join(weights, "node"), "left")
        left = left.join(left.groupBy("node").agg(F.collect_set("bucket").alias("buckets")), "node")
        x, y = (left.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "similarity", "component", "shared", "total", "buckets"))) for s in "xy")
        most = F.least("shared_x", "shared_y")
        apart = (F.col("node_x") < F.col("node_y")) & (F.col("component_x") != F.col("component_y"))
        apart = apart & (F.least("similarity_x", "similarity_y") < threshold) & (F.abs(F.col("similarity_x") - F.col("similarity_y")) <= room)
        apart = apart & (most >= (threshold - _EPS) * (F.col("total_x") + F.col("total_y") - most))
        # a pair is made in the least of its buckets; a bound that rules it out there holds everywhere
        apart = apart & (F.array_min(F.array_intersect("buckets_x", "buckets_y")) == F.col("bucket"))
        more = cut(x.join(y, "bucket").where(apart).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct(), "more")
        if not more.isEmpty():
            edges = edges.unionByName(verify(more, texts(more), idf).where(F.col("similarity") >= threshold).select("a", "b"))
            labels = components(cut(edges, "edges"))
    placed = nodes.select("key", "node", "least").join(labels, "node", "left").select("key", "least", F.coalesce("component", "node").alias("component"))
    return Classes(own, cut(placed, "placed"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs`` (doc_id, text)."""
    found = find_classes(docs, **options)
    placed = found.nodes.join(found.classes.select("component", "class_id"), "component").select("key", "class_id")
    copies = F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int")))
    return found.rows.join(placed, "key").select("doc_id", "class_id", copies.alias("copy")).drop("copy")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each class: the one of its least doc_id, of the least digest where that id has several texts in it."""
    found = find_classes(docs, **options)
    id_, key = fresh(docs, "id", "key")
    first = found.classes.select(F.col("least").alias(id_), F.col("key").alias(f"{key}_"))
    keyed = docs.withColumn(key, F.md5(text_of()))
    out = keyed.join(first, (F.col(key) == F.col(f"{key}_")) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left_semi")
    twice = found.rows.where("n_rows > 1").select("key")
    if twice.isEmpty():
        return out.select(*docs.columns)
    # one row of those that repeat; the others need no exchange
    twice = cut(twice.distinct().withColumnRenamed("key", f"{key}_"), "twice")
    some = out.join(twice, F.col(key) == F.col(f"{key}_"), "left_semi").dropDuplicates([key])
    return out.join(twice, F.col(key) == F.col(f"{key}_"), "left_anti").unionByName(some).select(*docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
