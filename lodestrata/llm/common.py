"""Shared pieces of the training-data operators: shared-folder tables, word hashing, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it (Java and Python syntax alike).
WORD = r"[^\x20\x09-\x0D]+"
_MINE: list[str] = []
#: Tasks that a very common label of a component is dealt to.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset (as in tests) one of our own, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _MINE:
        _MINE.append("file://" + tempfile.mkdtemp(prefix="lodestrata-"))
    return _MINE[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the driver ends
        pass


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again.

    Unlike a local checkpoint this survives the loss of any executor.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the files of a table that ``cut`` gave and that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Bound the rows and the bytes of an Arrow batch, so that batches of very long texts fit in a Python worker.

    The bounds stay set, as plans run after the call; smaller ones of the session are left alone.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        held = re.match(r"\d+", spark.conf.get(name))
        if not held or not 0 < int(held[0]) <= most:
            spark.conf.set(name, str(most))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = f"__{name}"
        while own.lower() in taken or f"{own}_".lower() in taken:
            own = f"_{own}"
        taken.add(own.lower())
        out.append(own)
    return out


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is made once however often body has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts(sizes: Column) -> Column:
    """The sum of the sizes before each of an array of integers, in DataFrame functions.

    A fold that grows an array copies it each step; here one grows an array of runs, and each run's own is as short as
    there are runs, so n sizes take n ** 1.5 copies.
    """
    none = F.expr("cast(array() as array<int>)")

    def of(s: Column) -> Column:
        run = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(s)))).cast("int")

        def one(done: Column, i: Column) -> Column:
            first = F.struct(F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0)).alias("end"), none.alias("starts"))
            grown = F.aggregate(F.slice(s, i * run + 1, run), first, lambda a, x: F.struct((a["end"] + x).cast("int").alias("end"), F.concat(a["starts"], F.array(a["end"])).alias("starts")))
            return F.concat(done, F.array(grown))

        runs = F.sequence(F.lit(0), F.ceil(F.size(s) / run).cast("int") - 1)
        folded = F.aggregate(runs, F.expr("cast(array() as array<struct<end: int, starts: array<int>>>)"), one)
        return F.when(F.size(s) > 0, F.flatten(F.transform(folded, lambda r: r["starts"]))).otherwise(none)

    return let(sizes, of)


def word_hash(word: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), seed)


class WordHasher:
    """64-bit hashes of words, remembered up to a bound so that common words are hashed once."""

    def __init__(self, limit: int = 400_000):
        self.limit, self.seen = limit, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.limit:
            seen.clear()
        got = list(map(seen.get, words))
        if None in got:
            for i, h in enumerate(got):
                if h is None:
                    w = words[i]
                    h = word_hash(w)
                    got[i] = seen[w] = h - (1 << 64) if h >= 1 << 63 else h  # signed: numpy reads those faster
        return np.array(got, dtype=np.int64).view(np.uint64)


def hash_texts(hasher: WordHasher, texts: list[str], chars: int = 4_000_000) -> list[np.ndarray]:
    """The word hashes of each text. Texts are split and their words numbered by Arrow, a bounded number of characters at once, so each different word is looked up once."""
    out: list[np.ndarray] = []
    some: list[str] = []
    held = 0
    for k, t in enumerate(texts):
        some.append(t.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " "))
        held += len(t)
        if held >= chars or k == len(texts) - 1:
            lists = pc.split_pattern(pa.array(some, pa.large_string()), " ")
            words = lists.flatten().dictionary_encode()
            names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
            at = words.indices.to_numpy()
            full = at != (names.index("") if "" in names else -1)
            ends = np.append(0, np.cumsum(full))[lists.offsets.to_numpy()]
            hashes = hasher(names)[at[full]]
            out += [hashes[i:j] for i, j in zip(ends[:-1], ends[1:])]
            some, held = [], 0
    return out


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words; empty where there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out += np.bitwise_xor(hashes[i : i + n], hashes[i : i + n] >> np.uint64(29)) * _ODD[i % 5] ** np.uint64(1 + i // 5)
    return mix(out)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (node, component), component the least node.

    Least labels travel over the edges and are then looked up in themselves (pointer jumping), so a
    component of diameter d takes about log d rounds. Each round is a join and a map-side-combined
    aggregate; the labels are written to the shared folder, and only a count of changes reaches the driver.
    """
    salts = F.array(*(F.lit(i) for i in range(SALTS)))
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct(), "edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        # only labels are looked up, of which there are few; a very common one is dealt to SALTS tasks
        named = labels.select(F.col("label").alias("node")).distinct()
        jump = labels.join(named, "node", "left_semi").select(F.col("node").alias("label"), F.col("label").alias("further"), F.explode(salts).alias("salt"))
        salted = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        step = cut(salted.join(jump, ["label", "salt"], "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        drop(labels)
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")


_FIND = re.compile(WORD).findall
# White space to str.split() but not to WORD.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


def words_of(texts: Iterable[str | None]) -> list[list[str]]:
    return [(_FIND(t) if _OTHER_SPACE(t) else t.split()) if t else [] for t in texts]
