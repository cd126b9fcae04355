"""Spelling variants: words that are one edit apart, and the commoner form that each follows.

The dictionary is kept forward and reversed. One edit leaves a half of a word as it is: of two words whose shorter
one has m letters, either the first m // 2 letters are equal or the last m - m // 2. So the forward dictionary is
scanned in blocks of a shared prefix, the reversed one in blocks of a shared suffix; each is dealt to tasks by
ranges of its blocks and sorted. A block of more than ``most`` words is subdivided by the same argument: what is left
of its words beyond the shared part is again one edit apart, so a half of that is shared too. That is repeated until
blocks are small or their words differ in a letter or two only. The words of a block are then verified pair by pair.

A word's form is its near word of the largest count (of ties the first in code-point order), if it occurs
at least twice as often. Roots follow the forms to the last one, by doubling the steps a round.

Defined results: null texts have no words; rows without doc_id count as of an empty id; repeated rows count each
time; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, text_of

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words of a block that isn't subdivided.
MOST = 48


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id as text, run) of every run of letters, A to Z in lower case."""
    lower = F.translate(text_of(), string.ascii_uppercase, string.ascii_lowercase)
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))


def misspelt(found: DataFrame) -> Column:
    """The run of ``runs``, without one letter where the digest of id and run says so, for the query."""
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring("run", 1, at), F.substr("run", at + 2))).otherwise(F.col("run"))


def dictionary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words (word) that are long and common enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def one_edit(a: str, b: str) -> bool:
    """Whether one letter added, taken away or replaced makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if n < len(b) else i < n and a[i + 1 :] == b[i + 1 :]


def _halves(words: DataFrame) -> DataFrame:
    """(block, word, n, rest, m): each word in its blocks of both dictionaries; m is the length of the shorter rest of a pair."""
    n = F.length("word")
    each = words.withColumn("m", F.explode(F.array(n, n - 1))).withColumn("p", F.floor(F.col("m") / 2).cast("int"))
    back = F.reverse("word")
    side = lambda name, w, size: F.struct(F.concat_ws(":", F.lit(name), "m", F.substring(w, 1, size)).alias("block"), F.substr(w, size + 1).alias("rest"), (F.col("m") - size).alias("m"))
    both = F.array(side("f", F.col("word"), F.col("p")), side("r", back, F.col("m") - F.col("p")))
    return each.select("word", "n", F.explode(both).alias("e")).select("e.block", "word", "n", "e.rest", "e.m")


def _subdivided(entries: DataFrame) -> DataFrame:
    """The entries of blocks, in the two smaller blocks that share a half of what is left."""
    p = F.floor(F.col("m") / 2).cast("int")
    s = (F.col("m") - p).cast("int")
    cut_off = F.length("rest") - s
    first = F.struct(F.concat_ws(">", "block", F.substring("rest", 1, p)).alias("block"), F.substr("rest", p + 1).alias("rest"), s.alias("m"))
    last = F.struct(F.concat_ws("<", "block", F.substr("rest", cut_off + 1)).alias("block"), F.substring("rest", 1, cut_off).alias("rest"), p.alias("m"))
    return entries.select("word", "n", F.explode(F.array(first, last)).alias("e")).select("e.block", "word", "n", "e.rest", "e.m")


def blocks(words: DataFrame, most: int = MOST) -> DataFrame:
    """The entries of all blocks, subdivided until each has at most ``most`` words or its words have under two letters to differ in."""
    open_, done = cut(_halves(words), "blocks"), None
    while True:
        large = cut(open_.where("m >= 2").groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > most).select("block"), "large")
        if large.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        small = cut(open_.join(large, "block", "left_anti"), "blocks")
        done = small if done is None else done.unionByName(small)
        before, open_ = open_, cut(_subdivided(open_.join(large, "block", "left_semi")), "blocks")
        drop(before)


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(a, n_a, b, n_b), a < b: all pairs of words (word, n) that are one edit apart, once each."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def verified() -> list:
            return [(x[0], x[1], y[0], y[1]) if x[0] < y[0] else (y[0], y[1], x[0], x[1]) for x, y in combinations(held, 2) if one_edit(x[2], y[2])]

        for batch in batches:
            out = []
            for block, word, n, rest in batch[["block", "word", "n", "rest"]].itertuples(index=False):
                if block != now:
                    out += verified()
                    now, held = block, []
                held.append((word, n, rest))
            yield pd.DataFrame(out, columns=["a", "n_a", "b", "n_b"])
        yield pd.DataFrame(verified(), columns=["a", "n_a", "b", "n_b"])

    dealt = blocks(words, most).drop("m").repartitionByRange("block", "block").sortWithinPartitions("block", "word")
    return dealt.mapInPandas(scan, "a string, n_a long, b string, n_b long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form (word, form)."""
    at = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = cut(at.join(at.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop(at)
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n) of a dictionary."""
    words = cut(words, "words")
    pairs = near_words(words, most)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    followed = -F.col("best.less") >= 2 * F.col("n")
    judged = cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(followed, F.col("best.near")).alias("form"), F.when(followed, -F.col("best.less")).alias("form_n")), "judged")
    root = roots(judged.where("form is not null"))
    return judged.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return variants(dictionary(found.select(misspelt(found).alias("word"))))
