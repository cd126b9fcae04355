"""Quality rules with host-level verdicts.

Each document is measured and tested by the base rule and by soft rules. A host (for ``documents``, the
source) has a count of documents and of those that fail any rule; a beta prior is fitted to all hosts'
rates by moments, and a host's rate is shrunk to (failures + a) / (documents + a + b). A host is bad if that
lies above the prior's mean by more than ``margin`` of the prior's standard deviations, so verdicts act however alike hosts
are; what noise explains is shrunk away before. Host verdicts are joined back: in a bad host, documents that fail a soft
rule go too. A document that fails no rule is always kept.

Defined results: a null text has no words and fails the base rule; rows without a host form a host of
their own; repeated rows count each, and rows of equal text and host have one verdict; an empty table gives
no rows. Measures cover whole texts. Other columns, whatever their names, are kept and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, small_batches, text_of, words_of

LEAST_WORDS, MOST_REPEATED = 50, 50
#: The prior's standard deviations above its mean from which on a host's shrunk rate is bad.
MARGIN = 0.25
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
# The symbols that are counted.
SYMBOLS = "#*$%&|<>"


def measure_text(text: str) -> tuple[int, int, int, int, int]:
    """The measures of one text, in the order of MEASURES."""
    words = words_of([text])[0]
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    repeated = 0
    if n > 3:
        number: dict[str, int] = {}
        w = np.array([number.setdefault(x, len(number)) for x in words], dtype=np.int64)
        # windows as pairs of ranks, so that no product can overflow
        pair = w[:-1] * len(number) + w[1:]
        _, pair = np.unique(pair, return_inverse=True)
        _, window, count = np.unique(pair[:-1] * len(number) + w[2:], return_inverse=True, return_counts=True)
        twice = count[window] > 1
        covered = np.zeros(n, dtype=bool)
        for i in range(3):
            covered[i : n - 2 + i] |= twice
        repeated = int(covered.sum())
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def measured(docs: DataFrame, host: Column) -> DataFrame:
    """(doc_id, host, measures) per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = pd.DataFrame([measure_text(t) for t in batch["text"]], columns=[x.split()[0] for x in MEASURES.split(", ")], index=batch.index)
            yield pd.concat([batch[["doc_id", "host"]], got], axis=1)

    return docs.select("doc_id", host.cast("string").alias("host"), text_of().alias("text")).mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, {MEASURES}")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def soft_failed() -> Column:
    """Mean word length out of [2, 12], or over a tenth of the words' characters symbols, or over 30 % repeated lines' worth of words."""
    n = F.col("n_words")
    return (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n) | (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > 3 * n)


def host_rates(tested: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(host, n_docs, n_failed, rate, bad): failure rates shrunk by a beta prior fitted to all hosts by moments, and the verdicts."""
    hosts = tested.groupBy("host").agg(F.count("*").alias("n_docs"), F.count(F.when(F.col("base_failed") | F.col("soft_failed"), 1)).alias("n_failed"))
    hosts = cut(hosts, "hosts")
    raw = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(F.avg(raw).alias("mean"), F.var_pop(raw).alias("var"), F.avg(1 / F.col("n_docs")).alias("inverse")).first()
    mean = min(max(m["mean"] or 0.0, 1e-3), 1 - 1e-3)
    # the spread of true rates is what binomial noise doesn't explain
    spread = max((m["var"] or 0.0) - mean * (1 - mean) * (m["inverse"] or 0.0), mean * (1 - mean) / 1000)
    strength = max(mean * (1 - mean) / spread - 1, 1.0)
    a, b = mean * strength, (1 - mean) * strength
    limit = mean + margin * (mean * (1 - mean) / (strength + 1)) ** 0.5
    rated = hosts.withColumn("rate", (F.col("n_failed") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b)))
    return rated.withColumn("bad", F.col("rate") > limit)


def judge(docs: DataFrame, host: Column, margin: float = MARGIN) -> DataFrame:
    """(doc_id, measures, base_failed, soft_failed, host, rate, bad, kept) per row of ``docs`` (doc_id, text, ...)."""
    small_batches(docs.sparkSession)
    tested = cut(measured(docs, host).withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failed()), "tested")
    rates = host_rates(tested, margin).select(F.col("host").alias("_host"), "rate", "bad")
    joined = tested.join(rates, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col("soft_failed") & F.col("bad")))


def keep_good(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept. The measures are a property of the text, so rows are matched by its digest and host."""
    host = F.col("source") if host is None else host
    key, of = fresh(docs, "key", "host")
    keyed = docs.withColumn(key, F.md5(text_of())).withColumn(of, host.cast("string"))
    judged = judge(keyed.select(F.col(key).alias("doc_id"), "text", F.col(of).alias("host")), F.col("host"))
    rejected = judged.where("not kept").select(F.col("doc_id").alias(f"{key}_"), F.col("host").alias(f"{of}_")).distinct()
    same = (F.col(key) == F.col(f"{key}_")) & F.col(of).eqNullSafe(F.col(f"{of}_"))
    return keyed.join(rejected, same, "left_anti").select(*docs.columns)


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("source"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
