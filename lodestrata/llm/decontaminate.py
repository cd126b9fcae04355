"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by their number of 5-word shingles into classes (u / 2, u]. For each class a document is
covered by windows of 2u shingles, u apart, so that any run of u shingles lies within one window and the
Jaccard similarity of an item and the window that holds it is bounded below whatever the document's
length. Windows and items have MinHash signatures; a window that agrees with an item in any of ``perms``
values makes the document a candidate, which is verified by exact containment of the item's shingles in
the whole document. With u / 2 shingles, 0.8 of them in one window, the similarity is at least 0.19, and
all of 64 values miss with a chance of 1.4e-6.

Items (a test set, whose total size is checked) are sent to the tasks, a text once however many items have
it; beyond ``most_bytes`` of text they are handled in parts, each a pass over the documents, so that what is
sent has a bound (one text at least, and texts whose digests fall in one part).

Words are runs of letters and digits, case-folded, so changes of case and punctuation don't hide an item.
An item of under five words is one shingle of all its words, looked for as it is.

Defined results: null texts have no words; an item without words matches nothing; equal items match alike;
rows without doc_id are reported without; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, fresh, shingles, small_batches, text_of

PERMS = 64
THRESHOLD = 0.8
MOST_BYTES = 8_000_000
WIDTH = 5
_TOKEN = re.compile(r"\w+")


def _words(text: str | None) -> list[str]:
    return _TOKEN.findall(text.casefold()) if text else []


class Searcher:
    """Items by size class, with their MinHash values by permutation."""

    def __init__(self, items: list[tuple[str, str]], perms: int, threshold: float):
        hasher = WordHasher()
        rng = np.random.default_rng(9)
        self.odd = rng.integers(1, 1 << 63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.threshold, self.ids, self.sets = threshold, [], []
        by_class: dict[int, list[int]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for item, text in items:
            words = hasher(_words(text))
            if 0 < len(words) < WIDTH:
                short.setdefault(len(words), []).append((int(shingles(words, len(words))[0]), item))
            own = np.unique(shingles(words))
            if len(own):
                by_class.setdefault(1 << int(len(own) - 1).bit_length(), []).append(len(self.ids))
                self.ids.append(item)
                self.sets.append(own)
        # of items under five words, the hashes in order and the items that have them
        self.short = {w: (np.array([h for h, _ in sorted(own)], dtype=np.uint64), [i for _, i in sorted(own)]) for w, own in sorted(short.items())}
        self.classes = []
        for u, members in sorted(by_class.items()):
            mins = np.array([self._hashed(self.sets[i]).min(axis=0) for i in members])
            tables = []
            for k in range(perms):
                order = np.argsort(mins[:, k], kind="stable")
                tables.append((mins[order, k], np.array(members)[order]))
            self.classes.append((u, tables))

    def _hashed(self, h: np.ndarray) -> np.ndarray:
        z = h[:, None] * self.odd
        return (z ^ (z >> np.uint64(31))).astype(np.uint32)

    def candidates(self, s: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) pairs that share a window's MinHash value, of documents whose shingles stand in ``s`` from ``starts`` on."""
        sizes = np.diff(np.append(starts, len(s)))
        blocks = []
        for u, _ in self.classes:
            n = -(-sizes // u)
            owner = np.repeat(np.arange(len(sizes)), n)
            first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            blocks.append((owner, starts[owner] + first * u, np.flatnonzero(owner[:-1] == owner[1:])))
        out: set[tuple[int, int]] = set()
        for k, odd in enumerate(self.odd):
            z = s * odd
            z = (z ^ (z >> np.uint64(31))).astype(np.uint32)
            for (_, tables), (owner, at, paired) in zip(self.classes, blocks):
                values, members = tables[k]
                mins = np.minimum.reduceat(z, at)
                # a window is a block with the next one of its document; the last block is a window too
                mins[paired] = np.minimum(mins[paired], mins[paired + 1])
                lo = np.searchsorted(values, mins)
                for i in np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == mins):
                    out.update((int(owner[i]), int(m)) for m in members[lo[i] : np.searchsorted(values, mins[i], side="right")])
        return sorted(out)

    def whole(self, words: list[np.ndarray]) -> list[tuple[int, str, float]]:
        """(document, item, 1.0) of the items under five words that documents with these word hashes hold."""
        out = []
        for width, (hashes, items) in self.short.items():
            for d, own in enumerate(words):
                s = np.unique(shingles(own, width))
                lo, hi = np.searchsorted(hashes, s), np.searchsorted(hashes, s, side="right")
                out += [(d, items[k], 1.0) for i in np.flatnonzero(hi > lo) for k in range(lo[i], hi[i])]
        return out

    def __call__(self, words: list[np.ndarray]) -> list[tuple[int, str, float]]:
        """(document, item, containment) of the documents with these word hashes."""
        out = self.whole(words)
        found = [shingles(w) for w in words]
        full = [i for i, s in enumerate(found) if len(s)]
        if not full or not self.classes:
            return out
        sizes = np.array([len(found[i]) for i in full])
        for d, m in self.candidates(np.concatenate([found[i] for i in full]), np.cumsum(sizes) - sizes):
            share = float(np.isin(self.sets[m], found[full[d]]).mean())
            if share >= self.threshold:
                out.append((full[d], self.ids[m], share))
        return out


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, perms: int = PERMS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, item_id, containment) for documents (doc_id, text) that hold items (item_id, text)."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    named = items.select("item_id", text_of().alias("text")).withColumn("key", F.md5("text"))
    texts = named.groupBy("key").agg(F.first("text").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // most_bytes))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for part in range(parts):
        own = [(r["key"], r["text"]) for r in texts.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).collect()]
        sent = spark.sparkContext.broadcast(own)  # about most_bytes at most

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            searcher, hasher = Searcher(sent.value, perms, threshold), WordHasher()
            for batch in batches:
                ids = batch["doc_id"].to_list()
                rows = [(ids[d], i, c) for d, i, c in searcher([hasher(_words(t)) for t in batch["text"]])]
                yield pd.DataFrame(rows, columns=["doc_id", "key", "containment"])

        got = docs.select("doc_id", text_of().alias("text")).mapInPandas(run, f"doc_id {id_type}, key string, containment double")
        out = got if out is None else out.unionByName(got)
    return out.join(named.select("item_id", "key"), "key").select("doc_id", F.col("item_id").cast("long").alias("item_id"), "containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, matched by the digest of their text."""
    (key,) = fresh(docs, "key")
    keyed = docs.withColumn(key, F.md5(text_of()))
    hit = search(keyed.select(F.col(key).alias("doc_id"), "text"), items, **options).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(hit, key, "left_anti").select(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
