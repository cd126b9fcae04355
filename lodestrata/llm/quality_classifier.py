"""Quality classifier by co-training of a text view and a page-metadata view.

The text view is hashed words and word beginnings, the metadata view the language, the source and layout
measures. Each has a logistic model for each label. Over rounds, each view labels the unlabelled documents
it is most sure of, and the other view learns from them. Each view is calibrated on held-out labelled
documents (Platt), the two are combined by a third logistic model fitted there, and all documents are
scored by the combination.

What is fitted is bounded: at most ``labelled`` labelled and ``pool`` unlabelled documents, those with
least digests of their id, reach the driver, as features. Scoring covers all documents and whole texts.

Defined results: a null text is empty (all word features 0); null lang and source are values of their own;
documents labelled more than once count as bad or toxic if any label says so; labels without a document
and null labels are left out; with no labels of a kind every document has probability 0.5 and is kept;
repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches

LABELLED, POOL = 6000, 4000
ROUNDS, PER_ROUND, SURE = 3, 400, 0.9
LOG2_TEXT, LOG2_META = 17, 12
_TOKEN = re.compile(r"\w+|[^\w\s]+")
# The layout measures of the metadata view.
LAYOUT = ("chars", "word_length", "upper", "digits", "symbols", "punctuation", "pipes", "lines", "repeated_lines", "distinct_words", "one")


class Features:
    """Sparse rows (indices, values, lengths) of both views for a batch (text, lang, source)."""

    def __init__(self, limit: int = 400_000):
        self.limit, self.seen = limit, {}

    def _bucket(self, word: str) -> int:
        got = self.seen.get(word)
        if got is None:
            own, head = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")), xxhash.xxh3_64_intdigest(b"^" + word[:5].encode("utf-8", "surrogatepass"))
            got = self.seen[word] = (own % (1 << LOG2_TEXT)) | (head % (1 << LOG2_TEXT)) << 32
        return got

    def text(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.seen) > self.limit:
            self.seen.clear()
        indices, values, lengths = [], [], []
        for t in texts:
            both = np.array(list(map(self._bucket, _TOKEN.findall(t.lower()))), dtype=np.int64)
            i, n = np.unique(np.concatenate([both & 0xFFFFFFFF, both >> 32]), return_counts=True)
            v = np.log1p(n)
            indices.append(i)
            values.append(v / max(1.0, float(np.sqrt(v @ v))) * 4)
            lengths.append(len(i))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        return join(indices, np.int64), join(values, np.float32), np.array(lengths, dtype=np.int64)

    def layout(self, t: str) -> list[float]:
        n = max(1, len(t))
        words = t.split()
        lines = t.split("\n")
        k = max(1, len(words))
        count = lambda chars: sum(map(t.count, chars)) / n
        upper = sum(map(t.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / n
        return [
            np.log1p(len(t)) / 10, sum(map(len, words)) / k / 10, upper * 5, count("0123456789") * 5,
            count("#*$%&<>") * 10, count(".,!?;:") * 5, count("|") * 20,
            np.log1p(len(lines)) / 5, 1 - len(set(lines)) / len(lines), len(set(words)) / k, 1.0]

    def meta(self, texts: list[str], langs: list, sources: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(LAYOUT)
        room = (1 << LOG2_META) - n
        rows = []
        for t, lang, source in zip(texts, langs, sources):
            rows.append([
                n + xxhash.xxh3_64_intdigest(f"lang {lang}".encode("utf-8", "surrogatepass")) % room,
                n + xxhash.xxh3_64_intdigest(f"source {source}".encode("utf-8", "surrogatepass")) % room])
        indices = np.hstack([np.tile(np.arange(n), (len(texts), 1)), np.array(rows, dtype=np.int64).reshape(-1, 2)])
        values = np.hstack([np.array([self.layout(t) for t in texts], dtype=np.float32).reshape(-1, n), np.full((len(texts), 2), 0.5, dtype=np.float32)])
        return indices.reshape(-1), values.reshape(-1), np.full(len(texts), n + 2, dtype=np.int64)


BLOCK = 256


def _blocks(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, row of each value, indices, values) of blocks of rows, so that temporary arrays stay small."""
    i, v, n = x
    ends = np.append(0, np.cumsum(n))
    for a in range(0, len(n), BLOCK):
        b = min(a + BLOCK, len(n))
        yield slice(a, b), np.repeat(np.arange(b - a), n[a:b]), i[ends[a] : ends[b]], v[ends[a] : ends[b]]


def _dots(x: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x[2]))
    for rows, row, i, v in _blocks(x):
        out[rows] = np.bincount(row, weights=v * w[i], minlength=rows.stop - rows.start)
    return out


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _subset(x: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, v, n = x
    ends = np.cumsum(n)
    at = np.concatenate([np.arange(ends[r] - n[r], ends[r]) for r in rows]) if len(rows) else np.empty(0, np.int64)
    return i[at], v[at], n[rows]


def fit_logistic(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray, size: int, steps: int = 150, l2: float = 1e-4, rate: float = 0.5, alike: bool = True) -> np.ndarray:
    """Weights and, last, the intercept, by AdaGrad on the whole set; ``alike`` weighs the classes alike, as calibration doesn't."""
    weight = weight / weight.sum() if not alike else weight * np.where(y > 0.5, 0.5 / max(1e-9, (weight * y).sum()), 0.5 / max(1e-9, (weight * (1 - y)).sum()))
    w, b, gw, gb = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        e, g = np.zeros(len(y)), l2 * w
        for rows, row, i, v in _blocks(x):
            own = (_probability(np.bincount(row, weights=v * w[i], minlength=rows.stop - rows.start) + b) - y[rows]) * weight[rows]
            e[rows] = own
            np.add.at(g, i, v * own[row])
        gw += g * g
        gb += e.sum() ** 2
        w -= rate * g / np.sqrt(gw)
        b -= rate * e.sum() / np.sqrt(gb)
    return np.append(w, b)


def _dense(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.tile(np.arange(m.shape[1]), len(m)), m.reshape(-1), np.full(len(m), m.shape[1])


class CoTrained:
    """Two views' models for one label, and the calibrated combination."""

    def __init__(self, views: list, y: np.ndarray, rounds: int = ROUNDS, per_round: int = PER_ROUND, sure: float = SURE):
        """views: for each, the sparse rows of labelled documents followed by the pool's; y: labels of the former."""
        sizes, n = (1 << LOG2_TEXT, 1 << LOG2_META), len(y)
        self.w = None
        held = np.arange(n) % 5 == 0
        train = np.flatnonzero(~held)
        if n < 20 or len(set(y[train])) < 2 or len(set(y[held])) < 2:
            return
        pool = np.arange(n, len(views[0][2]))
        added: list[dict[int, float]] = [{}, {}]
        for k in range(rounds + 1):
            self.w = []
            for view in (0, 1):
                rows = np.append(train, np.array(sorted(added[view]), dtype=np.int64))
                label = np.append(y[train], [added[view][r] for r in sorted(added[view])])
                weight = np.append(np.ones(len(train)), np.full(len(added[view]), 0.5))
                self.w.append(fit_logistic(_subset(views[view], rows), label, weight, sizes[view]))
            if k == rounds or not len(pool):
                break
            for view in (0, 1):
                p = _probability(_dots(_subset(views[view], pool), self.w[view][:-1]) + self.w[view][-1])
                other = added[1 - view]
                for value, score in ((1.0, p), (0.0, 1 - p)):
                    best = np.argsort(-score, kind="stable")[: per_round // 2]
                    other.update((int(pool[i]), value) for i in best if score[i] >= sure)
        at = np.flatnonzero(held)
        scores = np.stack([_dots(_subset(views[v], at), self.w[v][:-1]) + self.w[v][-1] for v in (0, 1)], axis=1)
        truth, ones = y[at], np.ones(len(at))
        self.platt = [fit_logistic(_dense(scores[:, v : v + 1]), truth, ones, 1, 400, alike=False) for v in (0, 1)]
        self.join = fit_logistic(_dense(self._calibrated(scores)), truth, ones, 2, 400, alike=False)
        self.held_accuracy = float(((self.combined(scores) >= 0.5) == (truth > 0.5)).mean())

    def _calibrated(self, scores: np.ndarray) -> np.ndarray:
        return np.stack([np.clip(scores[:, v] * self.platt[v][0] + self.platt[v][1], -10, 10) for v in (0, 1)], axis=1)

    def combined(self, scores: np.ndarray) -> np.ndarray:
        return _probability(self._calibrated(scores) @ self.join[:2] + self.join[2])

    def __call__(self, views: list) -> np.ndarray:
        if self.w is None:
            return np.full(len(views[0][2]), 0.5)
        return self.combined(np.stack([_dots(views[v], self.w[v][:-1]) + self.w[v][-1] for v in (0, 1)], axis=1))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> dict[str, CoTrained]:
    """Models for ``good`` (quality) and ``toxic``, from docs (doc_id, text, lang, source) and labels (doc_id, quality, toxic)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", "lang", "source")
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    least = lambda df, n: df.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(n)
    some = cut(least(known, labelled), "labelled")
    rest = docs.where("doc_id is not null").select("doc_id").join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti")
    wanted = cut(some.unionByName(least(rest, pool).distinct().select("doc_id", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))), "wanted")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            texts = list(batch["text"])
            out = batch[["doc_id", "good", "toxic"]].copy()
            for name, (i, v, n) in (("t", features.text(texts)), ("m", features.meta(texts, list(batch["lang"]), list(batch["source"])))):
                ends = np.cumsum(n)
                out[f"{name}i"] = [i[a:b].astype("<i4").tobytes() for a, b in zip(ends - n, ends)]
                out[f"{name}v"] = [v[a:b].astype("<f4").tobytes() for a, b in zip(ends - n, ends)]
            yield out

    # labelled + pool rows at most: of an id with several rows, the one of the least digest
    rows = docs.join(F.broadcast(wanted), "doc_id").select("doc_id", "good", "toxic", F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang", "source").alias("row"))
    rows = rows.groupBy("doc_id", "good", "toxic").agg(F.min_by("row", F.struct(F.md5("row.text"), "row.lang", "row.source")).alias("row")).select("doc_id", "good", "toxic", "row.*")
    got = rows.mapInPandas(extract, "doc_id long, good double, toxic double, ti binary, tv binary, mi binary, mv binary").toPandas()
    got = got.sort_values(["doc_id"], kind="stable")
    got = pd.concat([got[got["good"].notna()], got[got["good"].isna()]], ignore_index=True)
    views = [(np.frombuffer(b"".join(got[f"{x}i"]), "<i4"), np.frombuffer(b"".join(got[f"{x}v"]), "<f4"), got[f"{x}i"].map(len).to_numpy(dtype=np.int64) // 4) for x in "tm"]
    got = got[["doc_id", "good", "toxic"]]
    y = got[got["good"].notna()]
    return {name: CoTrained(views, (y[name].to_numpy() > 0).astype(np.float64)) for name in ("good", "toxic")}


def score(docs: DataFrame, models: dict[str, CoTrained]) -> DataFrame:
    """(doc_id, quality, toxicity, kept) of every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(models)  # a few weights for each of a fixed number of features

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, own = Features(), sent.value
        for batch in batches:
            texts = list(batch["text"])
            views = [features.text(texts), features.meta(texts, list(batch["lang"]), list(batch["source"]))]
            good, toxic = own["good"](views), own["toxic"](views)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": good, "toxicity": toxic, "kept": (good >= 0.5) & (toxic <= 0.5)})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source").mapInPandas(run, "doc_id long, quality double, toxicity double, kept boolean")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
