"""Conversation structure repair: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``.

Each turn is kept, given another role, or deleted, and empty user or assistant turns are inserted. A backward
cost-to-go over (turn, state of the grammar) gives what the rest of a conversation costs from each state; a greedy
forward walk takes, among the edits that lie on a cheapest way, the one of the least letter (D, I, K, R).

A conversation may be of any length, so it is worked on in segments: turns get places in one order over all
conversations, and those of 4096 consecutive places are a task's group. A segment is summed up as its min-plus
matrix of four states by four; matrices are folded backward (a row a segment), which gives the cost-to-go at each
segment's end; then each segment is walked from all four states, and the states that were really entered are
chained forward. Rebuilt turns are made and hashed as streams, with one turn in memory.

Turns are ordered by turn (null first), then role and text. The first fault of a turn counts: blank (no character but white space), duplicate (an earlier
turn of the conversation has its role and text), truncated (its last such character is not one of ``.!?``).

Defined results: a null role or text is one space; rows without conv_id are one conversation; rows that are equal
in all four columns are interchangeable, all but the first are duplicates; an empty role has no initial and can't be
kept; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ENDS = ".!?"
#: Places of a segment: 2 ** 12 turns.
SEGMENT_BITS = 12
# States of the grammar: nothing yet, after s, after u, after ua. The state and the role that an added turn leads to.
_STATES = range(4)
_NEXT, _ADDED = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_FAR = 1 << 40
#: What is left to pay at the end of a conversation, and the turns that are added there.
_AT_END, _TAIL = (0, 2 * INSERT, INSERT, 0), (0, 2, 1, 0)


def _turn_costs(code: str) -> list[list[tuple[str, int, int]]]:
    """By state: (edit, cost, next state) of a turn. code: "-" for one that must go, else its initial and T if it is truncated."""
    out = []
    for q in _STATES:
        ways = [("D", DELETE, q)]
        if code != "-":
            more = TRUNCATED if code.endswith("T") else 0
            kept = _KEPT[q].get(code[:1])
            ways += [("K", KEEP + more, kept)] if kept is not None else []
            ways.append(("R", REROLE + more, _NEXT[q]))
        out.append(ways)
    return out


class _Costs(dict):
    def __missing__(self, code: str) -> list:
        self[code] = _turn_costs(code)
        return self[code]


_COSTS = _Costs()


def _before(ways: list, after: tuple[int, ...]) -> tuple[int, ...]:
    """The cost-to-go before a turn, with what may be added there, from that after it."""
    took = [min(c + after[to] for _, c, to in own) for own in ways]
    # three states follow each other by additions, so two rounds reach all
    took = [min(took[q], INSERT + took[_NEXT[q]]) for q in _STATES]
    return tuple(min(took[q], INSERT + took[_NEXT[q]]) for q in _STATES)


def matrix(codes: list[str]) -> list[int]:
    """Row by row, the least cost from each state before these turns to each state after them."""
    columns = []
    for end in _STATES:
        v = tuple(0 if q == end else _FAR for q in _STATES)
        for code in reversed(codes):
            v = _before(_COSTS[code], v)
        columns.append([min(x, _FAR) for x in v])
    return [columns[e][q] for q in _STATES for e in _STATES]


def walks(codes: list[str], after: tuple[int, ...]) -> list[tuple[str, int]]:
    """From each state: the edits of the least letters among the cheapest, and the state that they end in."""
    togo = [after]
    for code in reversed(codes):
        togo.append(_before(_COSTS[code], togo[-1]))
    togo.reverse()
    out = []
    for q in _STATES:
        edits = []
        for i, code in enumerate(codes):
            while True:
                ways, left = {e: (c, to) for e, c, to in _COSTS[code][q]}, togo[i][q]
                tight = [e for e in ways if ways[e][0] + togo[i + 1][ways[e][1]] == left]
                if INSERT + togo[i][_NEXT[q]] == left:
                    tight.append("I")
                edit = min(tight)
                edits.append(edit)
                if edit != "I":
                    q = ways[edit][1]
                    break
                q = _NEXT[q]
        out.append(("".join(edits), q))
    return out


def placed_turns(rows: DataFrame) -> DataFrame:
    """(c, turn, role, text, place): ``rows`` (conv_id, turn, role, text) by conversation, in order; c is the id as text.

    Dealt by ranges, equal rows too, so that neither a long conversation nor an often repeated row is one task's.
    """
    some = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["c", "turn", "role", "text", "dealt"]
    dealt = some.withColumn("dealt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("dealt")
    return cut(dealt.withColumn("place", F.monotonically_increasing_id()), "turns")


def faults(placed: DataFrame) -> DataFrame:
    """(c, place, initial, fault): fault is blank, duplicate, truncated or null."""
    ended = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    digest = F.when(ended != "", F.sha2("text", 256))
    small = placed.select("c", "place", "role", F.substring("role", 1, 1).alias("initial"), digest.alias("digest"), F.substring(ended, -1, 1).isin(*ENDS).alias("ends"))
    first = small.where("digest is not null").groupBy("c", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    fault = F.when(F.col("digest").isNull(), "blank").when(F.col("new").isNull(), "duplicate").when(~F.col("ends"), "truncated")
    return small.join(first, "place", "left").select("c", "place", "initial", fault.alias("fault"))


def _segment() -> Column:
    return F.shiftright("place", SEGMENT_BITS)


_SUMMED = "c string, segment long, m array<long>, first string, last string, bad long"
_FOLDED = "c string, segment long, after array<int>, cost long, illegal long"
_WALKED = "c string, place long, audits array<string>, exits array<int>"
_CHAINED = "c string, place long, state int, audit string"


def _frame(rows: list, schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])


def _by_conversation(own: pd.DataFrame) -> Iterator[tuple[str, list]]:
    """(c, rows) of the turns of a segment, in order, a row being (c, place, initial, code)."""
    own = own.sort_values("place", kind="stable")
    for c, rows in groupby(zip(own["c"], own["place"], own["initial"], own["code"]), key=lambda r: r[0]):
        yield c, list(rows)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def repairs(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(costs, pieces) of turns from ``faults``.

    costs: (c, cost, illegal); pieces: (c, place, state, audit), the edits of each segment of a conversation from its first
    place and the state before it; the edits at the end of a conversation belong to its last piece.
    """
    code = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("-")).otherwise(F.concat(F.rpad("initial", 1, " "), F.when(F.col("fault") == "truncated", "T").otherwise("")))
    coded = cut(marked.select("c", "place", "initial", code.alias("code"), _segment().alias("segment")), "coded")

    def summed(own: pd.DataFrame) -> pd.DataFrame:
        segment, out = int(own["segment"].iloc[0]), []
        for c, rows in _by_conversation(own):
            bad = sum(not _legal(a[2], b[2]) for a, b in zip(rows, rows[1:]))
            out.append((c, segment, matrix([r[3] for r in rows]), rows[0][2], rows[-1][2], bad))
        return _frame(out, _SUMMED)

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # segments of a conversation come last first; costs are given as differences, which add up
        now, togo, after = None, _AT_END, None
        for batch in batches:
            out = []
            for c, segment, m, first, last, bad in batch.itertuples(index=False):
                if c != now:
                    now, togo, after = c, _AT_END, None
                before = [min(int(m[4 * q + e]) + togo[e] for e in _STATES) for q in _STATES]
                seam = after is not None and not _legal(last, after)
                out.append((c, segment, list(togo), before[0] - togo[0], bad + seam))
                togo, after = before, first
            yield _frame(out, _FOLDED)

    def walked(own: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        after, out = dict(zip(ends["c"], ends["after"])), []
        for c, rows in _by_conversation(own):
            got = walks([r[3] for r in rows], tuple(int(x) for x in after[c]))
            out.append((c, rows[0][1], [a for a, _ in got], [q for _, q in got]))
        return _frame(out, _WALKED)

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, held = 0, None  # the last row is held until it is known whether its conversation goes on
        for batch in batches:
            out = []
            for c, place, audits, exits in batch.itertuples(index=False):
                if held is not None:
                    out.append((*held[:3], held[3] + "I" * _TAIL[state]) if held[0] != c else held)
                if held is None or held[0] != c:
                    state = 0
                held = (c, place, state, audits[state])
                state = int(exits[state])
            yield _frame(out, _CHAINED)
        if held is not None:
            yield _frame([(*held[:3], held[3] + "I" * _TAIL[state])], _CHAINED)

    segments = coded.groupBy("segment").applyInPandas(summed, _SUMMED)
    after = cut(segments.repartition("c").sortWithinPartitions("c", F.desc("segment")).mapInPandas(folded, _FOLDED), "costs")
    walked_from = coded.groupBy("segment").cogroup(after.groupBy("segment")).applyInPandas(walked, _WALKED)
    pieces = cut(walked_from.repartition("c").sortWithinPartitions("c", "place").mapInPandas(chained, _CHAINED), "pieces")
    return after.groupBy("c").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal")), pieces


def rebuilt(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """(c, edit, role, text): the repaired turns, those of a conversation in order and in one partition; deleted turns come with a null role.

    A conversation passes through one task, as its digest has to be made in order; it is not held there.
    """

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        audit, at, state = "", 0, 0
        for batch in batches:
            out = []
            for c, entry, own, role, text in batch[["c", "state", "audit", "role", "text"]].itertuples(index=False):
                if isinstance(own, str):
                    audit, at, state = own, 0, int(entry)
                else:
                    edit = audit[at]
                    at += 1
                    if edit == "K":
                        state = _KEPT[state][role[:1]]
                    elif edit == "R":
                        role, state = _ADDED[state], _NEXT[state]
                    out.append((c, edit, None if edit == "D" else role, None if edit == "D" else text))
                while at < len(audit) and audit[at] == "I":
                    out.append((c, "I", _ADDED[state], ""))
                    state, at = _NEXT[state], at + 1
            yield pd.DataFrame(out, columns=["c", "edit", "role", "text"])

    turns = placed.select("c", "place", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("audit"), "role", "text")
    heads = pieces.select("c", "place", F.lit(0).alias("kind"), "state", "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = turns.unionByName(heads).repartition("c").sortWithinPartitions("c", "place", "kind")
    return both.mapInPandas(rebuild, "c string, edit string, role string, text string")


def turn_digests(turns: DataFrame) -> DataFrame:
    """(c, audit, digest) of ``rebuilt``: the edits, and the SHA-256 of ``role:text`` of the turns, joined by line ends."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, edits, sha, none = None, [], None, True
        for batch in batches:
            out = []
            for c, edit, role, text in batch[["c", "edit", "role", "text"]].itertuples(index=False):
                if c != now:
                    if now is not None:
                        out.append((now, "".join(edits), sha.hexdigest()))
                    now, edits, sha, none = c, [], hashlib.sha256(), True
                edits.append(edit)
                if role is not None:
                    sha.update(f"{'' if none else chr(10)}{role}:{text}".encode())
                    none = False
            yield pd.DataFrame(out, columns=["c", "audit", "digest"])
        if now is not None:
            yield pd.DataFrame([(now, "".join(edits), sha.hexdigest())], columns=["c", "audit", "digest"])

    return turns.mapInPandas(digests, "c string, audit string, digest string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by the digest of their id and turn, for the query: dropped, emptied, unended, repeated, or all of users."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, r"[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    placed = placed_turns(damaged(source))
    marked = cut(faults(placed), "faults")
    costs, pieces = repairs(marked)
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    counts = marked.groupBy("c").agg(count("blank"), count("duplicate"), count("truncated"))
    turns = placed.where("turn is not null").select("c", "turn").distinct().groupBy("c").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    got = counts.join(costs, "c").join(turn_digests(rebuilt(placed, pieces)), "c").join(turns, "c", "left")
    every = source.select("conv_id").distinct().withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return every.join(got, "c", "left").select(
        "conv_id", *(zero(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
