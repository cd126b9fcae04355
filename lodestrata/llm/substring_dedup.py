"""Substring dedup: suffix automata of shards of the corpus give matching statistics; long repeats are removed.

A window is ``WINDOW`` consecutive words of a document. A window whose words also start earlier (in a document of
a smaller id, or earlier in the same one) goes, with every word that it covers.

The reference is the corpus itself, so its automata have no bound and are not sent to every executor. They are
sharded by content: the least of the hashes of a window's runs of ``RUN`` words is its anchor, equal windows have equal anchors, and the
windows of an anchor belong to one shard. So a document is a row of segments, each the consecutive windows
with one place of their anchor, and a segment is streamed past the one automaton that can know its windows. Three passes:

1. Anchors that stand once in the corpus have nothing to match. Of the rest, segments of equal words are one, with all its places.
2. The words of each segment go to its shard, in the order of their first places. They are streamed through the shard's automaton
   of the segments before, which the segment then extends; a word at which the matching length is ``WINDOW`` or more
   ends a window that starts earlier. The other windows of the segment's first place are kept.
3. In a document, windows in segments that are not kept are removed, as maximal spans.

A shard has a bounded number of segments. An anchor with too many different segments for one task is dealt anew, window by
window: equal windows are then brought together before they are sent to the automata, however many there are.

Words are runs of what is not white space, compared as they are. Hashes are of 64 bits; two bring segments together
(the anchor's and the content's), so none of different words are expected to meet in 2 ** 60 segments; the automata compare words.

Defined results: null texts have no words; rows without doc_id come before all others; rows of one doc_id are ordered by
the digests of their texts, and equal rows count as one after the other; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, mix, shingles, small_batches, text_of, words_of

WINDOW = 20
#: Words of the runs whose hashes choose a window's anchor.
RUN = 4
#: Segments of a shard, and different ones of an anchor that is not dealt by window.
SHARD, HOT = 4096, 1024
#: Bytes whose words are hashed at once, and the base of their hashes (any odd number).
_PIECE, _BASE = 1 << 20, np.uint64(0x9E3779B97F4A7C15)
_FIRST = -(1 << 63)


class Automaton:
    """A suffix automaton of word sequences, that grows by a sequence at a time."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, moves: dict[str, int], size: int, link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        """The state of the strings that end in p's with ``word``: q itself, or q's shorter strings as a state of their own."""
        nxt, size = self.next, self.size
        if size[p] + 1 == size[q]:
            return q
        short = self._state(nxt[q].copy(), size[p] + 1, self.link[q])
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = short
            p = self.link[p]
        self.link[q] = short
        return short

    def _extend(self, last: int, word: str) -> int:
        nxt, link = self.next, self.link
        if word in nxt[last]:
            return self._split(last, word, nxt[last][word])
        new = self._state({}, self.size[last] + 1, 0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            link[new] = self._split(p, word, nxt[p][word])
        return new

    def stream(self, words: list[str]) -> list[int]:
        """The matching statistics of ``words``: at each, the length of the longest run that ends there and has ended before, in an earlier sequence or in this one."""
        nxt, link, size = self.next, self.link, self.size
        out, last, v, n = [], 0, 0, 0
        for word in words:
            while v and word not in nxt[v]:
                v = link[v]
                n = size[v]
            to = nxt[v].get(word)
            if to is not None:
                v, n = to, n + 1
            out.append(n)
            last = self._extend(last, word)
            while v and n <= size[link[v]]:  # a split may have taken the shorter strings away from v
                v = link[v]
        return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, number of words before each text and in all)."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    full = ~space
    starts = np.flatnonzero(full & np.append(True, space[:-1]))
    ends = np.flatnonzero(space & np.append(False, full[:-1]))
    sizes = ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    powers = np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 1, _BASE))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE)))
        n = sizes[i:j]
        before = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(before, n)
        value = (data[np.repeat(starts[i:j], n) + at].astype(np.uint64) + np.uint64(1)) * powers[at]
        out[i:j] = mix(np.add.reduceat(value, before) + n.astype(np.uint64))
        i = j
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return out, np.searchsorted(starts, bounds)


def segments(texts: list[bytes], window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, content) of the segments of texts, as arrays."""
    words, bounds = word_hashes(texts)
    none = np.empty(0, dtype=np.int64)
    if len(words) < window:
        return none, none, none, none, none
    hashes = shingles(words, run)
    least = np.arange(len(hashes))
    width, left = 1, window - run + 1
    while left > width:
        step = min(width, left - width)
        a, b = least[: len(least) - step], least[step:]
        least = np.where(hashes[a] <= hashes[b], a, b)
        width += step
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # windows that lie within a text
    at = np.flatnonzero(text[: len(words) - window + 1] == text[window - 1 :])
    if not len(at):
        return none, none, none, none, none
    # windows whose anchor stands at one place are no two equal
    own, anchor = text[at], least[at]
    new = np.append(True, (np.diff(own) != 0) | (np.diff(anchor) != 0))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    whole = shingles(words, window)
    # the first and the last window cover all words of a segment
    content = mix(whole[at[first]] * np.uint64(3) + mix(whole[at[first + n - 1]] ^ n.astype(np.uint64)))
    return own[first], at[first] - bounds[own[first]], n, hashes[anchor[first]].view(np.int64), content.view(np.int64)


_SEGMENTS = "anchor long, content long, n int, places array<struct<d:long,digest:long,start:long>>"


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = pa.struct([("d", pa.int64()), ("digest", pa.int64()), ("start", pa.int64())])
    for batch in batches:
        ids, digests = batch.column("d").to_numpy(), batch.column("digest").to_numpy()
        order = np.lexsort((digests, ids))  # so that of equal segments the first is the earliest
        texts = batch.column("text").to_pylist()
        text, start, n, anchor, content = segments([texts[i].encode() for i in order])
        by = np.lexsort((content, anchor))
        text, start, n, anchor, content = (x[by] for x in (text, start, n, anchor, content))
        first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))) if len(by) else by
        places = pa.StructArray.from_arrays([pa.array(ids[order][text]), pa.array(digests[order][text]), pa.array(start)], fields=list(place))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(by)), pa.int32()), places)
        yield pa.RecordBatch.from_arrays([pa.array(anchor[first]), pa.array(content[first]), pa.array(n[first].astype(np.int32)), lists], ["anchor", "content", "n", "places"])


def repeated_segments(keyed: DataFrame, hot: int = HOT) -> DataFrame:
    """(anchor, n, places, first, hot) of the segments of ``keyed`` (d, digest, text) whose anchor stands more than once.

    Equal segments of a batch are one row, so a hot anchor is combined before it is exchanged; first tells the row with
    the first place of all equal ones.
    """
    dealt = keyed.select("d", "digest", "text").mapInArrow(_segment_batches, _SEGMENTS).repartition("anchor")
    same, all_ = Window.partitionBy("anchor", "content"), Window.partitionBy("anchor")
    told = dealt.withColumn("first", F.min(F.element_at("places", 1)).over(same) == F.element_at("places", 1))
    told = told.withColumn("total", F.sum(F.size("places")).over(all_)).withColumn("different", F.sum(F.col("first").cast("int")).over(all_))
    return told.where("total > 1").select("anchor", "n", "places", "first", (F.col("different") > hot).alias("hot"))


def segment_words(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """(anchor, words, place, n) of the first of all equal segments; of hot anchors a row a different window, by its own hash."""

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, digest, words, wanted in zip(batch["d"], batch["digest"], words_of(batch["text"]), batch["wanted"]):
                for w in wanted:
                    start, n = int(w["start"]), int(w["n"])
                    if w["hot"]:
                        for s in range(start, start + n):
                            own = " ".join(words[s : s + WINDOW])
                            rows.append((xxhash.xxh3_64_intdigest(own.encode()) - (1 << 63), own, d, digest, s, 1, True))
                    else:
                        rows.append((int(w["anchor"]), " ".join(words[start : start + n + WINDOW - 1]), d, digest, start, n, False))
            yield pd.DataFrame(rows, columns=["anchor", "words", "d", "digest", "start", "n", "hot"])

    first = found.where("first").select(F.element_at("places", 1).alias("p"), "n", "anchor", "hot")
    wanted = first.groupBy("p.d", "p.digest").agg(F.collect_list(F.struct("p.start", "n", "anchor", "hot")).alias("wanted"))
    got = keyed.select("d", "digest", "text").join(wanted, ["d", "digest"]).mapInPandas(cut_out, "anchor long, words string, d long, digest long, start long, n int, hot boolean")
    place = F.struct("d", "digest", "start").alias("place")
    got = cut(got.select("anchor", "words", place, "n", "hot"), "segments")
    fine = got.where("hot").groupBy("anchor", "words").agg(F.min("place").alias("place"), F.max("n").alias("n"))
    return got.where("not hot").drop("hot").unionByName(fine)


def kept_windows(found: DataFrame, words: DataFrame) -> DataFrame:
    """(d, digest, start, n): runs of windows, of the segments with words, that start nowhere earlier."""
    shards = words.count() // SHARD + 1

    def run(own: pd.DataFrame) -> pd.DataFrame:
        automaton, rows = Automaton(), []
        for d, digest, start, text in own.sort_values(["d", "digest", "start"])[["d", "digest", "start", "words"]].itertuples(index=False):
            begun = None
            lengths = automaton.stream(text.split(" "))[WINDOW - 1 :]
            for i, length in enumerate(lengths):
                if length >= WINDOW:
                    if begun is not None:
                        rows.append((d, digest, start + begun, i - begun))
                    begun = None
                elif begun is None:
                    begun = i
            if begun is not None:
                rows.append((d, digest, start + begun, len(lengths) - begun))
        return pd.DataFrame(rows, columns=["d", "digest", "start", "n"])

    dealt = words.select(F.pmod("anchor", F.lit(shards)).alias("shard"), "place.*", "words")
    return dealt.groupBy("shard").applyInPandas(run, "d long, digest long, start long, n int")


def with_digests(docs: DataFrame) -> DataFrame:
    """(text, d, digest): documents with what they are told apart and ordered by."""
    return docs.select(text_of().alias("text"), F.coalesce("doc_id", F.lit(_FIRST)).cast("long").alias("d"), F.xxhash64(text_of()).alias("digest"))


def removed_words(keyed: DataFrame, found: DataFrame, kept: DataFrame) -> DataFrame:
    """(d, text, spans): of each row the runs of windows in repeated segments, and those of them that are kept; a later one of equal rows has null spans."""
    spans = found.select("n", F.explode("places").alias("p")).select("p.*", "n", F.lit(False).alias("kept")).unionByName(kept.withColumn("kept", F.lit(True)))
    listed = spans.groupBy("d", "digest").agg(F.collect_list(F.struct("start", "n", "kept")).alias("spans"))
    copy = F.row_number().over(Window.partitionBy("d", "digest").orderBy("d"))
    none = F.expr("cast(array() as array<struct<start: bigint, n: int, kept: boolean>>)")
    return keyed.join(listed, ["d", "digest"], "left").withColumn("copy", copy).select("d", "text", F.when(F.col("copy") == 1, F.coalesce("spans", none)).alias("spans"))


def _left(words: list[str], spans: list | None) -> list[str]:
    if len(words) < WINDOW or (spans is not None and not len(spans)):
        return words
    if spans is None:
        return []
    repeated, own = np.zeros(len(words) + 1, dtype=np.int64), np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        change = own if s["kept"] else repeated
        change[s["start"]] += 1
        change[s["start"] + s["n"]] -= 1
    gone = np.flatnonzero((np.cumsum(repeated) > 0) & (np.cumsum(own) == 0))
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, gone, 1)
    np.add.at(covered, gone + WINDOW, -1)
    return [w for w, c in zip(words, np.cumsum(covered)) if c == 0]


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words of each row of ``docs`` (doc_id, text) that are left, joined by spaces."""
    small_batches(docs.sparkSession, 500, 2 << 20)
    keyed = with_digests(docs)
    found = cut(repeated_segments(keyed), "found")
    kept = cut(kept_windows(found, segment_words(keyed, found)), "kept")

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = words_of(batch["text"])
            left = [_left(w, s) for w, s in zip(words, batch["spans"])]
            yield pd.DataFrame({"d": batch["d"], "n_words": [len(w) for w in words], "n_removed": [len(w) - len(x) for w, x in zip(words, left)], "kept": [" ".join(x) for x in left]})

    got = removed_words(keyed, found, kept).mapInPandas(removed, "d long, n_words long, n_removed long, kept string")
    return got.select(F.nullif("d", F.lit(_FIRST)).alias("doc_id"), "n_words", "n_removed", "kept")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
