"""Substring dedup, spelling variants and conversation repair against plain versions, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from lodestrata.llm import conversation_repair, spelling_variants, substring_dedup

LARGER = SF.replace("0.001", "0.01")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def plain_removed(docs, window=20):
    """{place in docs: words left}, documents in order of id (null first), then of the order given."""
    seen, out = set(), {}
    for i in sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0)):
        words = WORDS.findall(docs[i][1] or "")
        gone = set()
        for s in range(len(words) - window + 1):
            own = tuple(words[s : s + window])
            if own in seen:
                gone.update(range(s, s + window))
            seen.add(own)
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


def check_substrings(spark, docs, **kept):
    got = substring_dedup.dedup_substrings(spark.createDataFrame(docs, DOCS).repartition(3))
    want = plain_removed(docs)
    rows = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect())
    plain = Counter((d, len(w := WORDS.findall(t or "")), len(w) - len(want[i]), " ".join(want[i])) for i, (d, t) in enumerate(docs))
    assert rows == plain
    return rows


def test_query_op11_against_plain_version(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect())
    want = plain_removed(docs)
    got = {r["doc_id"]: r for r in entry.queries()["op11_substring_dedup"](spark, LARGER).collect()}
    assert len(got) == len(docs) and sum(r["n_removed"] for r in got.values()) > 1000
    for i, (d, text) in enumerate(docs):
        n = len(WORDS.findall(text or ""))
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (n, n - len(want[i]), hashlib.sha256(" ".join(want[i]).encode()).hexdigest())


def test_substrings_of_few_words(spark):
    """Few different words, so that runs, periods and repeats within a document meet."""
    rng = random.Random(3)
    docs = []
    for i in range(120):
        kind = i % 4
        if kind == 0:
            text = " ".join(rng.choice("ab") for _ in range(rng.randrange(120)))
        elif kind == 1:
            text = " ".join(["x", "y", "z"][: 1 + i % 3] * rng.randrange(60))
        elif kind == 2:
            text = "\n".join(rng.choice(("one two three four five six seven eight nine ten", "la li lu", "    é")) for _ in range(12))
        else:
            text = " ".join(f"w{rng.randrange(6)}" for _ in range(150))
        docs.append((i, text))
    check_substrings(spark, docs)


def test_substrings_edges(spark):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    passage = " ".join(f"p{i}" for i in range(25))
    docs = [(1, None), (2, ""), (3, long), (None, f"a {passage} b"), (4, f"c {passage} d"), (5, long), (6, "short"), (-7, f"{passage} z" + "w" * 2_000_000), (7, " ".join(passage.split()[:19]))]
    check_substrings(spark, docs)
    rows = check_substrings(spark, [(1, passage), (1, passage), (2, passage)])
    assert rows == {(1, 25, 0, passage): 1, (1, 25, 25, ""): 1, (2, 25, 25, ""): 1}
    clashing = spark.createDataFrame([(1, passage, 7), (2, passage, 7)], "doc_id long, text string, d int").withColumns({c: F.lit(7) for c in ("digest", "places", "anchor", "spans", "n", "copy", "kept")})
    assert {(r["doc_id"], r["n_removed"]) for r in substring_dedup.dedup_substrings(clashing).collect()} == {(1, 0), (2, 25)}
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0


def test_hot_anchors_are_dealt_by_window(spark, monkeypatch):
    """With every anchor taken for hot, the result is the same."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    docs = [(i, " ".join([f"u{rng.randrange(9)}" for _ in range(rng.randrange(30))] + passage[i % 3 :] + [f"v{rng.randrange(9)}" for _ in range(30)])) for i in range(60)]
    whole = substring_dedup.repeated_segments
    monkeypatch.setattr(substring_dedup, "repeated_segments", lambda keyed: whole(keyed, 0))
    check_substrings(spark, docs)


def test_automaton_gives_matching_statistics():
    rng = random.Random(1)
    for _ in range(200):
        automaton, before = substring_dedup.Automaton(), []
        for _ in range(4):
            words = [rng.choice("abc") for _ in range(rng.randrange(1, 14))]
            got = automaton.stream(words)
            for i in range(len(words)):
                ends = [(b, e) for b in before for e in range(len(b))] + [(words, e) for e in range(i)]
                assert got[i] == max((k for b, e in ends for k in range(1, min(e, i) + 2) if b[e - k + 1 : e + 1] == words[i - k + 1 : i + 1]), default=0)
            before.append(words)


def plain_variants(counts):
    """{word: (form, root, n, n_near, form_n)} by the words that share one with a letter taken away, verified by edit distance."""
    near = defaultdict(set)
    shared = defaultdict(set)
    for w in counts:
        for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            shared[x].add(w)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for group in shared.values():
        for a in group:
            near[a].update(b for b in group if a != b and b not in near[a] and distance(a, b) == 1)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def plain_counts(docs, least_length=5, least_count=3):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def test_query_op12_against_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()]
    want = plain_variants(plain_counts(docs))
    rows = entry.queries()["op12_spelling_variants"](spark, LARGER).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(rows) == len(got) and got == want
    assert sum(v[0] is not None for v in want.values()) > 100


@pytest.mark.parametrize("most", [2, 5, 1000])
def test_spelling_blocks_of_any_size(spark, most):
    """Few letters, so that blocks are large and subdivided down to single letters; ties of counts; long words."""
    rng = random.Random(most)
    counts = {"".join(rng.choice("abÀ") for _ in range(rng.randrange(5, 9))): rng.choice((3, 6, 12, 24)) for _ in range(400)}
    counts |= {"x" * 30: 9, "x" * 31: 3, "x" * 29 + "y": 18, "y" + "x" * 29: 3}
    got = spelling_variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), most)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()} == plain_variants(counts)


def test_spelling_edges(spark):
    docs = [(1, None), (2, ""), (None, "Wordy wordy WORDY wörde wörde wörde"), (3, "wordz wordz wordz wordz"), (3, "x" * 100_000), (4, "ÀÉÎÕÜ àéîõü ÷×÷×÷× " * 4)]
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(7) for c in ("id", "run", "word", "n", "block", "rest", "m")})
    found = spelling_variants.runs(df)
    got = spelling_variants.variants(spelling_variants.dictionary(found.select(spelling_variants.misspelt(found).alias("word"))))
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()} == plain_variants(plain_counts(docs))
    assert spelling_variants.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def plain_repair(turns):
    """(cost, audit, repaired turns) by keeping, for each state, the cheapest and least of all edits so far."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    added = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def with_added(best):
        for _ in range(3):
            for q in list(best):
                cost, audit, out = best[q]
                to = added[q]
                way = (cost + 3, audit + "I", out + [(name[to], "")])
                if to not in best or way[:2] < best[to][:2]:
                    best[to] = way
        return best

    best = with_added({"": (0, "", [])})
    for role, text, fault in turns:
        now = {}
        for q, (cost, audit, out) in best.items():
            ways = [(q, cost + 4, audit + "D", out)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (q, role[:1]) in step:
                    ways.append((step[q, role[:1]], cost + more, audit + "K", out + [(role, text)]))
                ways.append((added[q], cost + 3 + more, audit + "R", out + [(name[added[q]], text)]))
            for to, *way in ways:
                if to not in now or tuple(way[:2]) < now[to][:2]:
                    now[to] = tuple(way)
        best = with_added(now)
    return min((best[q] for q in ("", "a") if q in best), key=lambda w: w[:2])


def plain_conversations(rows):
    """{conv_id: result} of (conv_id, turn, role, text)."""
    after = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns = set(), []
        for _, role, text in own:
            ended = text.rstrip(" \t\n\x0b\x0c\r")
            turns.append((role, text, "blank" if not ended else "duplicate" if (role, text) in seen else "truncated" if ended[-1] not in ".!?" else ""))
            seen.add((role, text))
        cost, audit, repaired = plain_repair(turns)
        numbers = {t for t, *_ in own if t is not None}
        count = Counter(f for *_, f in turns)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
    return out


def check_conversations(spark, tmp_path, rows, extra=()):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumns({c: F.lit(7) for c in extra})
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = conversation_repair.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == plain_conversations(rows)


def test_query_op13_against_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{LARGER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in entry.queries()["op13_conversation_repair"](spark, LARGER).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == plain_conversations(rows) and len({v[6] for v in got.values()}) > 20


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_conversations_of_any_roles_in_segments(spark, tmp_path, monkeypatch, bits):
    """Random roles, nulls, ties and repeated rows; one conversation of many segments."""
    monkeypatch.setattr(conversation_repair, "SEGMENT_BITS", bits)
    rng = random.Random(bits)
    roles = ("user", "assistant", "system", "tool", "u", "", None, "Assistant")
    texts = ("Yes.", "No!", "what", "", " \n", None, "a ", "Long text? " + "\n" * 50, "end.\n")
    rows = [(c, rng.choice((0, 1, 2, 3, 4, 5, 6, None)), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randrange(50)}.") for c in (*range(40), None, -(2**60)) for _ in range(rng.randrange(9))]
    rows += [(99, t, rng.choice(roles[:2]), f"turn {t}.") for t in range(300)]
    check_conversations(spark, tmp_path, rows, extra=("c", "place", "digest", "fault", "audit", "segment", "times", "col"))


def test_conversation_edges(spark, tmp_path):
    dropped = next(t for t in range(999) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, dropped, "user", "gone."), (6, None, None, None), (7, 2**60, "user", "x" * 300_000 + " " * 300_000 + "."), (8, 1, "a", "b."), (8, 1, "a", "b."), (8, 1, "a", "b.")]
    check_conversations(spark, tmp_path, rows)
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert conversation_repair.op13_conversation_repair(spark, str(tmp_path / "none")).count() == 0
